"""Op 10: personal data by candidate gradient boosting. DataFrame functions only.

Base spans (email, ip, card, phone) come from patterns and checks and always stay. Beside them, generators of high
recall propose overlapping candidates: written-out addresses, numbers in groups, long tokens with digits, and values
after words like password. Each candidate has binary features of its format and of the CONTEXT characters before it.
Boosted trees of depth two score it, and candidates over their generator's threshold are added unless they overlap a
base span or a better candidate.

Training: every candidate of the whole table is counted by (generator, features, weak label, half); a candidate is a
positive if it overlaps a base span or has a format that only keys have. The half comes from a hash of the whole text, so
copies share it. The counts are at most two rows for each feature vector and label, which is bounded by the features and
not by the table, so the driver gets a small table. The trees are fitted to one half; a generator's threshold is the least
score at which precision is PRECISION on the other. A generator without such a score adds nothing. The trees become CASE
expressions. Candidates have no greatest length.

Positions are code points. Patterns are written possessively and anchored at the start of a run of their characters,
which finds the same matches in linear time and without recursion.

Defined cases: null is the empty text and has no spans; repeated rows get the same spans; where the fitted half lacks
positives or negatives, or the other one positives (a single text, say), the method adds nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.tables import table

KINDS = ("email", "ip", "card", "phone")
# the contract's patterns, possessive and anchored
_LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

GENERATORS = {
    "contact": r"(?i)(?:(?<![a-z0-9._%+-])|\G)[a-z0-9._%+-]++(?:\s?(?:@|\(at\)|\[at\])\s?[a-z0-9-]++\s?(?:\.|\(dot\)|\[dot\]|\sdot\s)\s?|\sat\s[a-z0-9-]++\sdot\s)[a-z]{2,}+",
    "number": r"(?:(?<![0-9+])|\G)[0-9(](?:[0-9]|[\x20()./-](?=[\x20()./-]?[0-9(])){5,}+",
    "secret": r"(?i)(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key)\s{0,3}+[:=]\s{0,3}+[\"']?+[^\s\"']{6,}+",
    "key": r"(?:(?<![A-Za-z0-9+/_-])|\G)(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+",
}
ORDER = (*KINDS, *GENERATORS)
MAYBE = r"(?i)[0-9@]|\(at\)|\[at\]|\sdot\s|password|passwd|pwd|secret|token|key"
_NAMED = r"(?i:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key)\s{0,3}[:=]\s{0,3}[\"']?(?=[^\s\"']*[0-9])[^\s\"']{8,}"
SURE = rf"^(?:AKIA[0-9A-Z]{{16}}|(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{{32,}}|{_NAMED})$"
SURE_THERE = rf"{_NAMED}$"
CONTEXT = 24
ROUNDS, RATE, PRECISION = 40, 0.3, 0.99

#: name -> pattern on the span, or (with a leading "<") on the characters before it
FEATURES = {
    "long12": r"^.{12,}",
    "long20": r"^.{20,}",
    "long32": r"^.{32,}",
    "assigned": r"[:=]",
    "quoted": r"[\"']",
    "upper": r"[A-Z]",
    "lower": r"[a-z]",
    "digits4": r"(?:[0-9][^0-9]*){4}",
    "digits9": r"(?:[0-9][^0-9]*){9}",
    "digits15": r"(?:[0-9][^0-9]*){15}",
    "only_hex": r"^[0-9a-fA-F]+$",
    "only_caps": r"^[0-9A-Z]+$",
    "groups3": r"[0-9]+[^0-9]+[0-9]+[^0-9]+[0-9]+",
    "dotted": r"\.",
    "at": r"(?i)@|\(at\)|\[at\]",
    "dated": r"^(?:19|20)[0-9]{2}[-/.]",
    "<word": r"(?i)(?:mail|phone|tel|call|fax|card|visa|ssn|iban|passport|account|contact)\W*$",
    "<plus": r"\+[0-9]*[\s(]*$",
    "<secret": r"(?i)(?:password|passwd|pwd|secret|token|key)\W*$",
    "<number": r"(?i)(?:version|page|no\.|nr\.|section|chapter)\s*$",
}
_SPAN = "array<struct<s:int,e:int,t:string>>"


def found(text: Column, pattern: str) -> Column:
    """All leftmost matches that don't overlap, as array<struct<s, e, t>> in code points."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
    steps = F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("size"), h.alias("t")))
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {_SPAN})").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["gap"]
        span = F.struct(s.cast("int").alias("s"), (s + x["size"]).cast("int").alias("e"), x["t"].alias("t"))
        return F.struct((s + x["size"]).cast("int").alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    return F.aggregate(steps, start, step, lambda acc: acc["out"])


def _digits(span: Column) -> Column:
    return F.regexp_replace(span["t"], "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def value(n: Column) -> Column:
        d = F.substring(digits, -n, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(n % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, n: (acc + value(n)).cast("int")) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    nothing = F.expr(f"cast(array() as {_SPAN})")

    def of(needs: str, pattern: str, fits: Callable[[Column], Column]) -> Column:
        return F.when(text.contains(needs) if len(needs) == 1 else text.rlike(needs), F.filter(found(text, pattern), fits)).otherwise(nothing)

    return {
        "email": of("@", EMAIL, lambda x: F.lit(True)),
        "ip": of(r"[0-9]\.[0-9]", IP, lambda x: F.forall(F.split(x["t"], r"\."), lambda p: p.cast("double") <= 255)),
        "card": of("[0-9]{2}|[0-9][\\x20-][0-9]", CARD, lambda x: F.when(F.length(_digits(x)).between(16, 19), luhn(_digits(x))).otherwise(False)),
        "phone": of("+", PHONE, lambda x: F.length(_digits(x)).between(8, 15)),
    }


def _overlaps(a: Column, b: Column) -> Column:
    return (a["s"] < b["e"]) & (b["s"] < a["e"])


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, base spans by kind, and cands: candidates with generator, features (a 0/1 string) and weak label."""
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("maybe", text.rlike(MAYBE)).withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)))
    nothing = F.expr(f"cast(array() as {_SPAN})")
    rows = rows.withColumns({k: F.when(F.col("maybe"), c).otherwise(nothing) for k, c in base_spans(text).items()})
    rows = rows.withColumn("base", F.concat(*[F.col(k) for k in KINDS]))

    def candidate(kind: str) -> Callable[[Column], Column]:
        return lambda x: features(kind, x)

    def features(kind: str, x: Column) -> Column:
        before = F.substring(text, F.greatest(F.lit(1), x["s"] + 1 - CONTEXT), F.least(F.lit(CONTEXT), x["s"]))
        bits = [(before if n.startswith("<") else x["t"]).rlike(p).cast("string").substr(1, 1) for n, p in FEATURES.items()]
        hit = F.exists(F.col("base"), lambda b: _overlaps(x, b))
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("kind"), F.translate(F.concat(*bits), "tf", "10").alias("f"), hit.alias("hit"), (hit | x["t"].rlike(SURE) | F.concat(before, x["t"]).rlike(SURE_THERE)).alias("label"))

    empty = F.expr("cast(array() as array<struct<s:int,e:int,kind:string,f:string,hit:boolean,label:boolean>>)")
    cands = [F.transform(found(text, p), candidate(k)) for k, p in GENERATORS.items()]
    return rows.withColumn("cands", F.when(F.col("maybe"), F.concat(*cands)).otherwise(empty)).drop("text", "maybe")


class Model:
    """Boosted trees of depth two over binary features; each tree is (a, b if a is 0, b if a is 1, four values)."""

    def __init__(self) -> None:
        self.bias = 0.0
        self.trees: list[tuple[int, int, int, tuple[float, float, float, float]]] = []
        self.thresholds: dict[str, float] = {}

    def score(self, f: str) -> float:
        return self.bias + sum(v[2 * (f[a] == "1") + (f[c if f[a] == "1" else b] == "1")] for a, b, c, v in self.trees)

    def column(self, f: Column) -> Column:
        def bit(n: int) -> Column:
            return F.substring(f, n + 1, 1) == "1"

        total = F.lit(self.bias)
        for a, b, c, v in self.trees:
            low = F.when(bit(b), v[1]).otherwise(v[0])
            total = total + F.when(bit(a), F.when(bit(c), v[3]).otherwise(v[2])).otherwise(low)
        return total


def boost(counts: dict[tuple[str, str], tuple[int, int]], rounds: int = ROUNDS, rate: float = RATE) -> Model:
    """From (generator, features) -> (negatives, positives); generators are features too, appended by the caller."""
    model = Model()
    bad, good = (sum(c[n] for c in counts.values()) for n in (0, 1))
    if not bad or not good:
        return model
    model.bias = math.log(good / bad)
    rows = defaultdict(lambda: [0, 0])
    for (_, f), (b, g) in counts.items():
        rows[f][0] += b
        rows[f][1] += g
    scores = dict.fromkeys(rows, model.bias)
    width = len(next(iter(rows)))

    def best(part: list[tuple[str, float, float]]) -> tuple[float, int]:
        """The feature whose two sides have most gain, with Newton steps; ties to the first."""
        found_gain, at = -1.0, 0
        for n in range(width):
            sums = [[0.0, 0.0], [0.0, 0.0]]
            for f, g, h in part:
                side = sums[f[n] == "1"]
                side[0] += g
                side[1] += h
            gain = sum(g * g / (h + 1.0) for g, h in sums)
            if gain > found_gain + 1e-12:
                found_gain, at = gain, n
        return found_gain, at

    for _ in range(rounds):
        part = []
        for f in sorted(rows):
            b, g = rows[f]
            p = 1 / (1 + math.exp(-scores[f]))
            part.append((f, g - (b + g) * p, (b + g) * p * (1 - p)))
        _, a = best(part)
        sides = [[x for x in part if (x[0][a] == "1") == side] for side in (False, True)]
        splits = [best(side)[1] if side else 0 for side in sides]
        values = []
        for side, n in zip(sides, splits):
            for bit in (False, True):
                leaf = [x for x in side if (x[0][n] == "1") == bit]
                values.append(rate * sum(x[1] for x in leaf) / (sum(x[2] for x in leaf) + 1.0))
        model.trees.append((a, splits[0], splits[1], tuple(values)))
        scores = {f: model.score(f) for f in rows}
    return model


def calibrate(model: Model, counts: dict[tuple[str, str], tuple[int, int]], precision: float = PRECISION) -> None:
    if not model.trees:  # nothing was fitted: there is no score to hold a bound against
        return
    for kind in GENERATORS:
        by_score = defaultdict(lambda: [0, 0])
        for (k, f), (b, g) in counts.items():
            if k == kind:
                by_score[model.score(f)][0] += b
                by_score[model.score(f)][1] += g
        b = g = 0
        for score in sorted(by_score, reverse=True):
            b, g = b + by_score[score][0], g + by_score[score][1]
            if g and g >= precision * (b + g):
                model.thresholds[kind] = score - 1e-9


def _with_kind(f: str, kind: str) -> str:
    return f + "".join("1" if kind == k else "0" for k in GENERATORS)


def train(prepared: DataFrame) -> Model:
    rows = prepared.select("half", F.explode("cands").alias("c")).groupBy("half", "c.kind", "c.f", "c.label").count().collect()
    halves: list[dict[tuple[str, str], list[int]]] = [defaultdict(lambda: [0, 0]) for _ in range(2)]
    for half, kind, f, label, n in rows:
        halves[half][kind, _with_kind(f, kind)][bool(label)] += n
    fitted, held_out = ({k: (v[0], v[1]) for k, v in counts.items()} for counts in halves)
    model = boost(fitted)
    calibrate(model, held_out)
    return model


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """id, the base spans of each kind, and added: array<struct<s, e, kind, score>>."""
    prepared = _prepared(docs, id_col, text_col)
    model = model or train(prepared)

    def scored(c: Column) -> Column:
        kinds = F.concat(*[F.when(c["kind"] == k, "1").otherwise("0") for k in GENERATORS])
        return F.struct(c["s"].alias("s"), c["e"].alias("e"), c["kind"].alias("kind"), model.column(F.concat(c["f"], kinds)).alias("score"))

    def passes(c: Column) -> Column:
        fits = F.lit(False)
        for kind, least in model.thresholds.items():
            fits = fits | ((c["kind"] == kind) & (c["score"] >= least))
        return fits

    free = F.filter("cands", lambda c: ~c["hit"])
    rows = prepared.withColumn("picked", F.filter(F.transform(free, scored), passes)).drop("cands", "base", "half")

    def better(a: Column, b: Column) -> Column:
        return F.struct(-a["score"], a["s"], -a["e"], a["kind"]) < F.struct(-b["score"], b["s"], -b["e"], b["kind"])

    added = F.filter("picked", lambda c: ~F.exists("picked", lambda o: _overlaps(c, o) & better(o, c)))
    return rows.withColumn("added", added).drop("picked")


def _joined(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))


def op10_private_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_private(table(spark, sf_dir, "documents"))
    base = F.concat(*[_joined(k, F.col(k)) for k in KINDS])

    def of(kind: str) -> Column:
        return F.filter("added", lambda c: c["kind"] == kind)

    more = [_joined(k, F.array_sort(of(k))) for k in GENERATORS]
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select(
        F.col("id").alias("doc_id"), *counts, F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"), F.array_join(F.concat(base, *more), ",").alias("spans"), F.size("added").cast("long").alias("n_added")
    )
