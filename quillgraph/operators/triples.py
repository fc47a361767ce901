"""Tables and payloads to triples: checks, stable ids, joined attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import stable_id


def repeated_ids(rows: DataFrame, key: str = "id") -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def dangling(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """(src, rel, dst, missing): triples with an end that is no entity."""
    ids = entities.select("id").distinct()
    lost = triples.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").withColumn("missing", F.lit("subject"))
    more = triples.join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti").withColumn("missing", F.lit("object"))
    return lost.unionByName(more)


def type_mismatches(triples: DataFrame, entities: DataFrame, expected: DataFrame) -> DataFrame:
    """Triples whose ends don't have the types of expected(rel, subject_type, object_type); blanks fit all."""
    s = entities.select(F.col("id").alias("src"), F.col("label").alias("actual_subject"))
    o = entities.select(F.col("id").alias("dst"), F.col("label").alias("actual_object"))
    rows = triples.join(expected, "rel").join(s, "src").join(o, "dst")
    wrong = lambda want, got: (F.col(want) != "") & (F.col(want) != F.col(got))
    return rows.where(wrong("subject_type", "actual_subject") | wrong("object_type", "actual_object"))


def joined_attributes(rows: DataFrame, keys: list[str], value: Column, order: Column, sep: str = " / ") -> DataFrame:
    """Distinct values of each key in the order they first come, joined."""
    first = rows.select(*keys, value.alias("v"), order.alias("o")).where("v is not null and v <> ''").groupBy(*keys, "v").agg(F.min("o").alias("o"))
    listed = F.array_sort(F.collect_list(F.struct("o", "v")))
    return first.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["v"]), sep).alias("value"))


def canonical(triples: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, relations, triples) with stable ids from rows (subject, subject_type, predicate, object, object_type)."""
    s, o = stable_id("E", F.col("subject_type"), F.col("subject")), stable_id("E", F.col("object_type"), F.col("object"))
    r = stable_id("R", F.col("predicate"), F.col("subject_type"), F.col("object_type"))
    rows = triples.where("coalesce(subject, '') <> '' and coalesce(predicate, '') <> '' and coalesce(object, '') <> ''").withColumns({"s": s, "o": o, "r": r})
    ends = rows.select(F.explode(F.array(F.struct(F.col("s").alias("id"), F.col("subject").alias("name"), F.col("subject_type").alias("type")), F.struct(F.col("o").alias("id"), F.col("object").alias("name"), F.col("object_type").alias("type")))).alias("e"))
    relations = rows.select(F.col("r").alias("id"), F.col("predicate").alias("name"), "subject_type", "object_type").distinct()
    facts = rows.select(stable_id("T", F.col("s"), F.col("r"), F.col("o")).alias("id"), F.col("s").alias("subject_id"), F.col("r").alias("predicate_id"), F.col("o").alias("object_id"))
    return ends.select("e.*").distinct(), relations, facts.distinct()


def absent(required: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct required rows whose keys no present row has; null keys are equal to null keys."""
    have = present.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return required.distinct().join(have, same, "left_anti")


def sanitised(edges: DataFrame, weak: str, strong: str, required: DataFrame) -> DataFrame:
    """Distinct (src, rel, dst) without `weak` edges between ends that a `strong` one joins, and with all required edges."""
    names = ["src", "rel", "dst"]
    led = edges.where(F.col("rel") == strong).select("src", "dst", F.lit(weak).alias("rel")).distinct()
    kept = edges.select(*names).distinct().join(led, names, "left_anti")
    return kept.select(*names).unionByName(absent(required.select(*names), kept, names))


def merged_batches(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, type, batch) of the first batch that has an entity, and (rel, n) with the counts of all batches added up."""
    first = entities.groupBy("name", "type").agg(F.min("batch").alias("batch"))
    return first, relations.groupBy("rel").agg(F.sum("n").alias("n"))
