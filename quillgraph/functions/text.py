"""Text scores as Column expressions, so that Catalyst fuses them into the plan that uses them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph import config

_BLANK = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def compact(text: Column) -> Column:
    """Lower case without any white space."""
    return F.regexp_replace(F.lower(text), _BLANK, "")


def grams(text: Column, size: int = 2) -> Column:
    """Distinct n-grams; a shorter text is its own only one, an empty text has none."""
    many = F.length(text)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(many - size + 1, F.lit(1))), lambda n: F.substring(text, n, F.lit(size)))
    return F.when(many >= size, F.array_distinct(cut)).when(many > 0, F.array(text)).otherwise(F.array().cast("array<string>"))


def tokens(text: Column) -> Column:
    """Distinct runs of letters, digits and underscores, and single Han characters."""
    low = F.lower(text)
    runs = F.regexp_extract_all(low, F.lit("[a-z0-9_]+"), F.lit(0))
    return F.array_distinct(F.concat(runs, F.regexp_extract_all(low, F.lit("[一-鿿]"), F.lit(0))))


def jaccard(a: Column, b: Column) -> Column:
    """1 for two empty sets, 0 for one."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap(query: Column, node: Column) -> Column:
    """2 + shorter/100 if one contains the other, else the share of the node's bigrams that the query has."""
    shorter = F.least(F.length(query), F.length(node))
    g = grams(node)
    share = F.size(F.array_intersect(grams(query), g)) / F.greatest(F.size(g), F.lit(1))
    blank = (F.length(query) == 0) | (F.length(node) == 0)
    return F.when(blank, 0.0).when(F.contains(query, node) | F.contains(node, query), 2.0 + shorter / 100.0).otherwise(share)


def keyword_score(query: Column, node: Column) -> Column:
    score = overlap(query, node)
    return F.when(score >= 2, 1.0).otherwise(F.least(F.lit(1.0), score))


def coverage(query: Column, text: Column) -> Column:
    """1 if equal; 0.55 + 0.45 * shorter / longer on containment of at least two characters; else shared bigrams of the query."""
    a, b = F.length(query), F.length(text)
    ratio = F.least(a, b) / F.greatest(a, b)
    g = grams(query)
    share = F.size(F.array_intersect(g, grams(text))) / F.greatest(F.size(g), F.lit(1))
    inside = (F.least(a, b) >= 2) & (F.contains(query, text) | F.contains(text, query))
    return F.when((a == 0) | (b == 0), 0.0).when(query == text, 1.0).when(inside, 0.55 + 0.45 * ratio).otherwise(share)


def replaced(text: Column, rules: dict[str, str]) -> Column:
    """Replacements, the longest first; of equal length in the order given."""
    for old, new in sorted(rules.items(), key=lambda x: -len(x[0])):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def percent(ratio: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(100), F.rint(100 * ratio).cast("int")))


def stable_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha1(F.concat_ws("\n", *[F.coalesce(p, F.lit("")) for p in parts]).cast("binary")), 1, 16))


def canonical_relation(raw: Column, aliases: dict[str, tuple[str, ...]]) -> Column:
    """The first name with an alias inside the raw name; otherwise the raw name."""
    out = raw
    for name, known in reversed(aliases.items()):
        hit = F.lit(False)
        for alias in known:
            hit = hit | F.contains(raw, F.lit(alias))
        out = F.when(hit, name).otherwise(out)
    return out


def alias_group(value: Column, groups: dict[str, tuple[str, ...]], fallback: str = "other") -> Column:
    """The group with an equal alias, else the one with the longest alias inside the value (first wins), else fallback."""
    longest = sorted(((a, g) for g, known in groups.items() for a in known), key=lambda x: -len(x[0]))
    out = F.lit(fallback)
    for alias, group in reversed(longest):
        out = F.when(F.contains(value, F.lit(alias)), group).otherwise(out)
    for group, known in reversed(groups.items()):
        out = F.when(value.isin(*known), group).otherwise(out)
    return F.when(F.coalesce(value, F.lit("")) == "", fallback).otherwise(out)


def weighted(value: Column, weights: dict[str, float], other: float = 0.0) -> Column:
    """The weight of a name; `other` for one that has none, also for null."""
    out = F.lit(other)
    for name, weight in weights.items():
        out = F.when(value == name, weight).otherwise(out)
    return out


def subject_match(subject: Column, value: Column, ratio: Column | None = None) -> Column:
    """1 if equal; on containment 0.99 at the end and 0.97 elsewhere for four characters or more, else 0.88 and a tenth
    of the share; otherwise 0.7 of `ratio`. 0 if either is empty."""
    a, b = F.length(subject), F.length(value)
    shorter, longer = F.when(a <= b, subject).otherwise(value), F.when(a <= b, value).otherwise(subject)
    inside = F.when(F.least(a, b) >= 4, F.when(F.endswith(longer, shorter), 0.99).otherwise(0.97)).otherwise(0.88 + 0.1 * F.least(a, b) / F.greatest(a, b))
    rest = F.lit(0.0) if ratio is None else 0.7 * ratio
    return F.when(F.coalesce(F.least(a, b), F.lit(0)) == 0, 0.0).when(subject == value, 1.0).when(F.contains(longer, shorter), inside).otherwise(rest)


def without_terms(text: Column, terms: tuple[str, ...]) -> Column:
    """The text with every term, the longest first, replaced by a blank."""
    for term in sorted(terms, key=len, reverse=True):
        text = F.replace(text, F.lit(term), F.lit(" "))
    return text


def subject_phrases(text: Column, terms: tuple[str, ...], limit: int = 8) -> Column:
    """Distinct compact parts of at least two characters that the terms leave of a query."""
    parts = F.transform(F.split(without_terms(F.lower(F.trim(text)), terms), "[\\s，,。；;、]+"), compact)
    return F.slice(F.array_distinct(F.filter(parts, lambda p: F.length(p) >= 2)), 1, limit)


def intent_alignment(query: Column, corpus: Column, failing: tuple[str, ...], working: tuple[str, ...]) -> Column:
    """1 if query and corpus both speak of the failure, -1 if the corpus only says that it works, else 0."""
    has = lambda text, terms: F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t))
    return F.when(has(query, failing), F.when(has(corpus, failing), 1.0).when(has(corpus, working), -1.0).otherwise(0.0)).otherwise(0.0)


def search_text(values: list[Column], groups: tuple[tuple[str, ...], ...]) -> Column:
    """Distinct filled values in order, joined by blanks, with every synonym group of which a term occurs."""
    filled = F.filter(F.array(*values), lambda v: F.coalesce(v, F.lit("")) != "")
    corpus = F.lower(F.array_join(filled, " "))
    more = [F.when(F.exists(F.array(*map(F.lit, g)), lambda t: F.contains(corpus, F.lower(t))), F.array(*map(F.lit, g))).otherwise(F.array().cast("array<string>")) for g in groups]
    return F.array_join(F.array_distinct(F.concat(filled, *more)), " ")


def property_values(text: Column) -> Column:
    """Distinct filled parts of a property's text at slashes, semicolons and commas; null and blank have none."""
    parts = F.transform(F.split(F.trim(text), r"\s*/\s*|[；;，,、]\s*", -1), lambda p: F.trim(p))
    found = F.array_distinct(F.filter(parts, lambda p: p != ""))
    whole = F.trim(F.coalesce(text, F.lit("")))
    return F.when(whole == "", F.array().cast("array<string>")).when(F.size(found) > 0, found).otherwise(F.array(whole))


def character_score(query: Column, text: Column) -> Column:
    """1 if the text contains the query, else the share of the query's distinct characters it has; 0 if either is blank."""
    q, t = F.lower(F.trim(F.coalesce(query, F.lit("")))), F.lower(F.trim(F.coalesce(text, F.lit(""))))
    own = F.array_distinct(F.split(q, ""))
    share = F.size(F.array_intersect(own, F.split(t, ""))) / F.size(own)
    return F.when((q == "") | (t == ""), 0.0).when(F.contains(t, q), 1.0).otherwise(share)


def stage_rank(level: Column) -> Column:
    """The stage that a level or label names, from component to whole; 99 if none, also for null."""
    rank = F.lit(99)
    for n, name in reversed(list(enumerate(config.STAGES))):
        rank = F.when(F.contains(level, F.lit(name)), n).otherwise(rank)
    return rank


def layout_place(label: Column, name: Column, columns: dict[str, int], other: int = 96) -> Column:
    """struct<x, y>: the label's column, and a height from 8 to 91 by the code points of label and name."""
    x = F.lit(float(other))
    for known, at in columns.items():
        x = F.when(label == known, float(at)).otherwise(x)
    title = F.concat(F.coalesce(label, F.lit("")), F.lit(":"), F.coalesce(name, F.lit("")))
    total = F.aggregate(F.split(title, ""), F.lit(0).cast("long"), lambda acc, c: acc + F.ascii(c))
    return F.struct(x.alias("x"), (total % 84 + 8).cast("double").alias("y"))


def exactly_matches(queries: Column, names: Column) -> Column:
    """Whether an array of queries and one of names have an equal text once both are compact; blanks match nothing."""
    tidy = lambda texts: F.filter(F.transform(texts, compact), lambda t: t != "")
    return F.arrays_overlap(tidy(queries), tidy(names))
