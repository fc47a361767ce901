"""Plain documents to paragraphs, figures and triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNITS = ("MPa", "kPa", "Pa", "kN", "N", "kg", "g", "mm", "cm", "m", "s", "min", "h", "℃", "V", "A", "W", "kW", "Hz", "rpm", "%")
_UNIT = "|".join(sorted(UNITS, key=len, reverse=True))
FIGURE = rf"([\p{{L}}][\p{{L}} ]{{1,19}}?)\s*(?:为|是|：|:|=)\s*([0-9]+(?:\.[0-9]+)?)\s*({_UNIT})(?![A-Za-z])"


#: Units, and the patterns of names and numbers.
SPECIFIED_UNITS = "mm|cm|m|kg|g|N|kN|MPa|Pa|kW|W|V|A|Hz|℃|%|rpm|r/min"
SPECIFICATION = rf"([\x{{4e00}}-\x{{9fa5}}A-Za-z0-9 /_-]{{2,24}})[:：]?\s*([0-9]+(?:\.[0-9]+)?(?:\s*[~～-]\s*[0-9]+(?:\.[0-9]+)?)?)\s*({SPECIFIED_UNITS})"
MAX_SPECIFICATIONS = 8


def paragraphs(text: Column, least: int = 8) -> Column:
    """Parts at line ends and after 。；; with single blanks: no short ones, dot leaders or numbered headings."""
    parts = F.transform(F.split(text, r"\n+|(?<=[。；;])"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    dots = lambda p: F.length(p) - F.length(F.replace(p, F.lit("."), F.lit("")))
    heading = r"^\d+(?:\.\d+)*\s+[^。；;:：]{2,24}$"
    return F.filter(parts, lambda p: (F.length(p) >= least) & ~p.rlike(r"\.{4,}") & (dots(p) <= F.greatest(F.lit(6), F.floor(F.length(p) / 8))) & ~p.rlike(heading))


def specifications(text: Column, limit: int = MAX_SPECIFICATIONS) -> Column:
    """The first `limit` distinct structs (name, value, unit); a value may be a range."""
    # most texts have no number before a unit, which is found out at a fraction of the cost
    some = F.when(text.rlike(rf"[0-9]\s*(?:{SPECIFIED_UNITS})"), text)
    groups = [F.regexp_extract_all(some, F.lit(SPECIFICATION), F.lit(n)) for n in (1, 2, 3)]
    name = lambda x: F.regexp_replace(F.regexp_replace(x, r"\s+", ""), "^[，。,;；]+|[，。,;；]+$", "")
    found = F.transform(F.arrays_zip(*groups), lambda x: F.struct(name(x["0"]).alias("name"), F.replace(x["1"], F.lit(" "), F.lit("")).alias("value"), x["2"].alias("unit")))
    return F.slice(F.array_distinct(F.filter(found, lambda x: F.length(x["name"]) <= 24)), 1, limit)


def keyword_paragraphs(text: Column, keywords: tuple[str, ...], limit: int = 6, width: int = 220) -> Column:
    """The `limit` paragraphs that hold most keywords, the earlier first among equals, cut at `width` characters."""

    def hits(p: Column) -> Column:
        total = F.lit(0)
        for k in keywords:
            total = total + F.floor((F.length(p) - F.length(F.replace(p, F.lit(k), F.lit("")))) / len(k)).cast("int")
        return total

    scored = F.filter(F.transform(paragraphs(text), lambda p, n: F.struct((-hits(p)).alias("s"), n.alias("n"), p.alias("p"))), lambda x: x["s"] < 0)
    return F.transform(F.slice(F.array_sort(scored), 1, limit), lambda x: F.substring(x["p"], 1, width))


def figures(text: Column) -> Column:
    """Distinct structs (name, value, unit)."""
    groups = [F.regexp_extract_all(text, F.lit(FIGURE), F.lit(n)) for n in (1, 2, 3)]
    return F.array_distinct(F.transform(F.arrays_zip(*groups), lambda x: F.struct(F.trim(x["0"]).alias("name"), x["1"].cast("double").alias("value"), x["2"].alias("unit"))))


def figure_triples(docs: DataFrame, subject: str, text: str) -> DataFrame:
    """Rows (subject, subject_type, predicate, object, object_type) of a document's figures."""
    rows = docs.select(F.col(subject).alias("subject"), F.explode(figures(F.col(text))).alias("f"))
    value = F.concat_ws(" ", F.format_string("%s", F.col("f.value").cast("string")), "f.unit")
    return rows.select("subject", F.lit("Document").alias("subject_type"), F.col("f.name").alias("predicate"), value.alias("object"), F.lit("Figure").alias("object_type"))
