"""Idempotent upserts, before/after change logs, version retention and rollback, over snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(state: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The state with the rows of `new` in place of rows of the same key; one full outer join."""
    others = [c for c in state.columns if c != key]
    joined = state.withColumn("_old", F.lit(True)).alias("s").join(new.withColumn("_new", F.lit(True)).alias("n"), key, "full_outer")
    return joined.select(key, *[F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in others])


def last_rows(new: DataFrame, key: str, order: str) -> DataFrame:
    """One row of each key, the one of the largest `order`: what an upsert takes if keys repeat; nulls in `order` lose."""
    last = new.groupBy(key).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in new.columns if c != key]), F.struct(order)).alias("_row"))
    return last.select(key, *[F.col(f"_row.`{c}`").alias(c) for c in new.columns if c != key])


def change_log(state: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, created, before, after): one row for each new row; before and after are structs, before null if created."""
    others = [c for c in state.columns if c != key]
    before = state.select(key, F.struct(*others).alias("before"))
    rows = new.select(key, F.struct(*others).alias("after")).join(before, key, "left")
    return rows.select(key, F.col("before").isNull().alias("created"), "before", "after")


def rollback(state: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """Created rows go, updated rows get their values from before."""
    others = [c for c in state.columns if c != key]
    undo = log.select(key, "created", "before")
    rows = state.join(undo, key, "left").where(~F.coalesce("created", F.lit(False)))
    return rows.select(key, *[F.when(F.col("before").isNotNull(), F.col(f"before.{c}")).otherwise(F.col(c)).alias(c) for c in others])


def newest(versions: DataFrame, by: str, order: str, tie: str, keep: int = 10) -> DataFrame:
    """The `keep` newest versions each `by`."""
    window = Window.partitionBy(by).orderBy(F.desc(order), F.desc(tie))
    return versions.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= keep)


def upsert_edges(state: DataFrame, new: DataFrame) -> DataFrame:
    """Edges (src, rel, dst, props map): properties of `new` lie over the old ones."""
    joined = state.withColumnRenamed("props", "old").join(new.withColumnRenamed("props", "more"), ["src", "rel", "dst"], "full_outer")
    old, more = (F.coalesce(c, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))) for c in ("old", "more"))
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(more), k))
    return joined.select("src", "rel", "dst", F.map_concat(kept, more).alias("props"))


def fold_relations(edges: DataFrame, order: str) -> DataFrame:
    """One row for each (src, rel, dst) without self-loops; the last attributes win, `order` tells which."""
    return edges.where("src <> dst").groupBy("src", "rel", "dst").agg(F.max_by("attribute", order).alias("attribute"))
