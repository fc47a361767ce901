"""Op 4: mixing sources to target weights by Pareto order sampling. DataFrame functions only.

A source's target is its weight's share of all words, capped at MAX_COPIES times its own words, with the excess
reshared. Document i of a source with ratio rho = target / words expects lambda_i = rho + kappa * (m_i - 1) copies:
m_i is its preference over the source's word-weighted mean preference (short documents are preferred up to twofold,
so that long ones are repeated less), and kappa is the largest factor up to 1 that holds every lambda_i in
[0, MAX_COPIES]. So the expected words are exactly the target. floor(lambda_i) whole copies are certain. The
fraction f_i left is the inclusion probability of one more: documents are ranked by random odds over inclusion odds,
U/(1-U) / (f/(1-f)), U being a hash of seed and id, and taken in this order until the source's sample has the words
that are missing. The last one is taken if at least half of it fits, so a source misses its target by at most half
of one document.

Rank cut-offs come from a histogram of ranks and a window over the one bin that holds the cut, never from a sort of
a whole source. Only the table of sources is joined, by a broadcast if it has at most MAX_BROADCAST_SOURCES rows and
by a shuffle otherwise.

Defined cases: a null or blank text has size 0 and is taken 0 words; a null source is a source, the last one; equal
ids in a source share their random number, so repeated rows are taken alike; null ids count as one id; an empty table
gives an empty result. Other columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.tables import table
from quillgraph.session import cut

WORD = r"[^\x20\x09-\x0D]+"
MAX_COPIES = 3
WEIGHTS = (1, 2, 3)
SEED = 20240
BINS = 4096
MAX_BROADCAST_SOURCES = 100_000
_LAST = 2**63 - 1


def _unit(key: Column, seed: int) -> Column:
    """A number in (0, 1) from an md5: the same in every engine, run and order of rows."""
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))
    return (F.conv(F.substring(hashed, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = MAX_COPIES) -> DataFrame:
    """(source, source_size, preferred, target): weights repeat over the sources by code point, null last."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("preference")).alias("preferred"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    at = (F.row_number().over(order) - 1) % len(weights)
    sums = sums.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), at.cast("int") + 1))
    sums = sums.withColumn("cap", F.col("source_size") * F.lit(cap).cast("double")).withColumn("full_at", F.col("cap") / F.col("weight"))
    fill = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(fill), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(fill), F.lit(0))
    )
    sums = sums.withColumn("level", level).withColumn("open", F.col("full_at") >= F.col("level"))
    rest = F.max(F.when(F.col("open"), F.col("level"))).over(everything)
    return sums.select("source", "source_size", "preferred", F.when(F.col("open"), F.col("weight") * rest).otherwise(F.col("cap")).alias("target"))


def _expected(sized: DataFrame, cap: float, seed: int) -> DataFrame:
    """Adds copies (certain ones), rank (of the sample, in [0, 1)) and bin to rows that carry their source's figures."""
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    mean = F.when(F.col("preferred") > 0, F.col("preference") * F.col("source_size").cast("double") / F.col("preferred").cast("double")).otherwise(1.0)
    rows = sized.withColumn("ratio", ratio)
    rows = rows.withColumn("expected", F.col("ratio") + F.least(2 * F.col("ratio"), F.lit(float(cap)) - F.col("ratio"), F.lit(1.0)) * (mean - 1.0))
    rows = rows.withColumn("expected", F.greatest(F.lit(0.0), F.least(F.lit(float(cap)), F.col("expected")))).withColumn("copies", F.floor("expected"))
    part, unit = F.col("expected") - F.col("copies"), _unit(F.col("key"), seed)
    odds = (unit * (1.0 - part)) / ((1.0 - unit) * part)
    # a document with a fraction of 0 is never drawn; one without words changes nothing
    rows = rows.withColumn("rank", F.when((part > 0) & (F.col("size") > 0), odds / (1.0 + odds)))
    return rows.withColumn("bin", F.floor(F.col("rank") * BINS))


def _joined(rows: DataFrame, sources: DataFrame, broadcast: bool) -> DataFrame:
    sources = sources.withColumnRenamed("source", "of")
    return rows.join(F.broadcast(sources) if broadcast else sources, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_COPIES, seed: int = SEED) -> DataFrame:
    """One row per document: doc (all its columns as a struct), size, source_size, target, copies, taken."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(source_col).alias("source"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("key"), size.alias("size"))
    rows = rows.withColumn("preference", F.lit(1000) + F.floor(F.lit(1000000) / (F.lit(1000) + F.col("size"))))
    slim = cut(rows.drop("doc"))
    sources = cut(source_targets(slim, weights, cap))
    few = sources.count() <= MAX_BROADCAST_SOURCES
    ranked = _expected(_joined(slim, sources, few), cap, seed)
    certain = ranked.groupBy("source", "target").agg(F.sum(F.col("size") * F.col("copies")).alias("words")).select("source", (F.col("target") - F.col("words")).alias("missing"))
    bins = ranked.where("rank is not null").groupBy("source", "bin").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = _joined(bins.withColumn("before", before), certain, few).where("before <= missing")
    cuts = cut(bins.groupBy("source").agg(F.max(F.struct("bin", "before", "missing")).alias("c")).select("source", "c.*").withColumnRenamed("bin", "cut_bin"))
    inside = _joined(ranked, cuts, few).where("bin = cut_bin")
    inside = inside.groupBy("source", "rank", "key", "missing", "before").agg(F.sum("size").alias("words"))
    run = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("rank", "key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = inside.where("words > 0").withColumn("run", F.col("before") + run).where("run + words / 2 <= missing")
    last = taken.groupBy("source").agg(F.max(F.struct("rank", "key")).alias("last"))
    limits = cut(_joined(cuts, last, few).select("source", "cut_bin", "last"))
    out = _joined(_expected(_joined(rows, sources, few), cap, seed), limits, few)
    drawn = (F.col("bin") < F.col("cut_bin")) | ((F.col("bin") == F.col("cut_bin")) & F.coalesce(F.struct("rank", "key") <= F.col("last"), F.lit(False)))
    copies = F.col("copies") + F.when(F.coalesce(drawn, F.lit(False)), 1).otherwise(0)
    return out.select("doc", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op4_mixing_pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc.doc_id", "size", "source_size", "target", "taken")


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it."""
    rows = mix(docs).where("copies > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return rows.select("doc.*")


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(doc_id, {_LAST}) AS k,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END::BIGINT AS size
  FROM documents),
p AS (SELECT *, 1000 + 1000000 // (1000 + size) AS pref FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, sum(size * pref)::BIGINT AS preferred FROM p GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS weight, source_size * 3.0::DOUBLE AS cap FROM s),
f AS (SELECT *, cap / weight AS full_at FROM w),
l AS (SELECT *, ((SELECT sum(source_size) FROM w)::DOUBLE - coalesce(sum(cap) OVER b, 0)) / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER b, 0)) AS level
      FROM f WINDOW b AS (ORDER BY full_at, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, preferred, CASE WHEN full_at >= level THEN weight * (SELECT max(level) FROM l WHERE full_at >= level) ELSE cap END AS target FROM l),
r AS (SELECT p.*, source_size, preferred, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio,
        (('0x' || substr(md5('{SEED}:' || k::VARCHAR), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
      FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, greatest(0.0::DOUBLE, least(3.0::DOUBLE, ratio + least(2 * ratio, 3.0::DOUBLE - ratio, 1.0::DOUBLE)
        * (CASE WHEN preferred > 0 THEN pref * source_size::DOUBLE / preferred::DOUBLE ELSE 1.0 END - 1.0::DOUBLE))) AS expected FROM r),
c AS (SELECT *, floor(expected)::BIGINT AS copies, expected - floor(expected) AS part FROM e),
o AS (SELECT *, CASE WHEN part > 0 AND size > 0 THEN (u * (1.0::DOUBLE - part)) / ((1.0::DOUBLE - u) * part) END AS odds FROM c),
k AS (SELECT *, odds / (1.0::DOUBLE + odds) AS rank, target - sum(size * copies) OVER (PARTITION BY source) AS missing FROM o),
a AS (SELECT *, coalesce(sum(CASE WHEN rank IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM k)
SELECT doc_id, size, source_size, target,
  (size * (copies + CASE WHEN rank IS NOT NULL AND run + size / 2.0::DOUBLE <= missing THEN 1 ELSE 0 END))::BIGINT AS taken
FROM a"""
