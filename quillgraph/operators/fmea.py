"""Failure-mode sheets to graph rows: header names, row-wise merge, pairs of causes and effects, keys, nodes and edges.

Blank cells are empty texts after `normalised`; rows without machine or unit failure mode don't count (row_valid).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNSET = "未标注"
#: Levels of owner keys.
LEVELS = ("unit", "component", "system")


def renamed_headers(rows: DataFrame, aliases: dict[str, str], required: tuple[str, ...] = ()) -> DataFrame:
    """Columns by their canonical names, white space around names aside; a required name that is missing is an error."""
    names = {c: aliases.get(c.strip(), c.strip()) for c in rows.columns}
    missing = [c for c in required if c not in names.values()]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return rows.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])


def normalised(rows: DataFrame) -> DataFrame:
    """Texts without white space at their ends; null becomes empty."""
    return rows.select(*[F.coalesce(F.trim(f"`{c}`"), F.lit("")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in rows.dtypes])


def merged_rows(first: DataFrame, more: DataFrame, number: str) -> DataFrame:
    """Rows of both sheets by row number: filled cells of `more` win. Numbers found on one side only stay as they are."""
    shared = [c for c in first.columns if c in more.columns and c != number]
    a, b = first.alias("a"), more.alias("b")
    both = a.join(b, number, "full_outer")
    out = [F.when(F.coalesce(F.col(f"b.{c}"), F.lit("")) != "", F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in shared]
    alone = [F.col(f"a.{c}") for c in first.columns if c not in (number, *shared)] + [F.col(f"b.{c}") for c in more.columns if c not in (number, *shared)]
    return both.select(number, *out, *alone)


def row_valid(machine: str = "machine_name", failure: str = "unit_failure_mode") -> Column:
    return (F.coalesce(F.col(machine), F.lit("")) != "") & (F.coalesce(F.col(failure), F.lit("")) != "")


def paired(a: Column, b: Column) -> Column:
    """Array of (number, left, right) to the longer length; the last element of the shorter one is repeated, empty: null."""
    many = F.greatest(F.size(a), F.size(b), F.lit(1))

    def at(x: Column, n: Column) -> Column:
        return F.when(F.size(x) > 0, F.get(x, F.least(n, F.size(x) - 1)))

    return F.transform(F.sequence(F.lit(0), many - 1), lambda n: F.struct(n.alias("number"), at(a, n).alias("left"), at(b, n).alias("right")))


def failure_key(level: str, owner: Column, mode: Column) -> Column:
    return F.concat_ws("::", F.lit(level), F.coalesce(owner, F.lit("")), F.coalesce(mode, F.lit("")))


def attribute_key(kind: str, value: Column) -> Column:
    return F.concat_ws("::", F.lit(kind), F.when(F.coalesce(value, F.lit("")) != "", value).otherwise(UNSET))


def exploded(rows: DataFrame, components: str, systems: str) -> DataFrame:
    """One row for each pair of component cause and system effect; both columns are array<struct<owner, mode>>."""
    out = rows.where(row_valid()).withColumn("pair", F.explode(paired(F.col(components), F.col(systems))))
    names = {"component_name": "left.owner", "component_failure_mode": "left.mode", "system_name": "right.owner", "system_failure_mode": "right.mode"}
    out = out.select("*", F.col("pair.number").alias("pair_number"), *[F.col(f"pair.{p}").alias(n) for n, p in names.items()]).drop("pair", components, systems)
    keys = {f"{x}_failure_key": failure_key(x, F.col("machine_name" if x == "unit" else f"{x}_name"), F.col(f"{x}_failure_mode")) for x in LEVELS}
    return out.withColumns(keys)


def merged_nodes(rows: DataFrame, specs: dict[str, tuple[str, str]]) -> DataFrame:
    """Distinct (label, key, name) of rows; specs has label -> (key column, name column); blank names make no node."""
    parts = F.array(*[F.struct(F.lit(label).alias("label"), F.col(key).cast("string").alias("key"), F.col(name).cast("string").alias("name")) for label, (key, name) in specs.items()])
    return rows.select(F.explode(parts).alias("x")).select("x.*").where("coalesce(name, '') <> ''").distinct()


def merged_edges(rows: DataFrame, specs: list[tuple[str, str, str]]) -> DataFrame:
    """Distinct (src, rel, dst) of rows; specs has (source key column, relation, target key column)."""
    parts = F.array(*[F.struct(F.col(a).cast("string").alias("src"), F.lit(rel).alias("rel"), F.col(b).cast("string").alias("dst")) for a, rel, b in specs])
    return rows.select(F.explode(parts).alias("x")).select("x.*").where("src is not null and dst is not null").distinct()
