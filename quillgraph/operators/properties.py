"""Maps of properties: sanitising, overlays that fill or keep the larger value, ids that go on, version labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def without_blanks(props: Column) -> Column:
    """A map without null and blank values."""
    return F.map_filter(props, lambda k, v: F.coalesce(F.trim(v), F.lit("")) != "")


def filled(first: Column, more: Column) -> Column:
    """Values of `first`, and those of `more` where it has none or a blank one."""
    own = without_blanks(first)
    return F.map_concat(own, F.map_filter(without_blanks(more), lambda k, v: ~F.array_contains(F.map_keys(own), k)))


def largest(edges: DataFrame, keys: list[str], scores: list[str], digits: int = 6) -> DataFrame:
    """Repeated edges as one, with the largest of each score, rounded."""
    return edges.groupBy(*keys).agg(*[F.round(F.max(s), digits).alias(s) for s in scores])


def next_numbers(existing: DataFrame, key: str = "id") -> DataFrame:
    """(prefix, next): the number after the largest one of ids such as E12, for each prefix of letters."""
    parts = existing.select(F.regexp_extract(key, "^([A-Z]+)([0-9]+)$", 1).alias("prefix"), F.regexp_extract(key, "^([A-Z]+)([0-9]+)$", 2).try_cast("long").alias("n"))
    return parts.where("n is not null").groupBy("prefix").agg((F.max("n") + 1).alias("next"))


def next_version(label: Column) -> Column:
    """V1.n+1 of V1.n; V1.0 if there is none."""
    n = F.regexp_extract(F.coalesce(label, F.lit("")), r"^V1\.([0-9]+)$", 1)
    return F.when(n == "", "V1.0").otherwise(F.concat(F.lit("V1."), (n.try_cast("long") + 1).cast("string")))


def attribute_nodes(rows: DataFrame, key: str, lists: list[str], sep: str = " / ") -> DataFrame:
    """(key, property, value): each list property of a row as one node, its distinct filled values joined; empty lists make none."""
    tidy = lambda c: F.array_distinct(F.filter(F.transform(c, lambda v: F.trim(v)), lambda v: v != ""))
    parts = F.array(*[F.struct(F.lit(c).alias("property"), F.array_join(tidy(F.col(c)), sep).alias("value")) for c in lists])
    return rows.select(key, F.explode(parts).alias("p")).select(key, "p.property", "p.value").where("value <> ''")
