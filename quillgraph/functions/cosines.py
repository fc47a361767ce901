"""The best cosines of vectors within their groups, by matrix products of chunks.

Vectors and queries of a group are dealt into chunks by a hash; every chunk of queries meets every chunk of vectors of its
group in a task, which works on two chunks at a time. All pairs are measured, which is quadratic in a group by nature.

Defined cases: a null vector has a null score, which comes last; a vector of length 0 has nan, which comes first; vectors of
two lengths don't meet, nor does anything with a null label or id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK, ASKED = 4096, 512
#: A score is rounded to six places; what is nearer than this to the k-th best may be equal to it then.
_SLACK = 2e-6


def _meet(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def side(row: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
        flat = row.values
        values = flat.field("v").flatten().to_numpy(zero_copy_only=False)
        return flat.field("id").to_numpy(zero_copy_only=False), values.reshape(len(flat), len(values) // len(flat))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                (own, q), (ids, v) = side(batch["asked"][n]), side(batch["members"][n])
                with np.errstate(all="ignore"):
                    scores = q @ v.T / np.sqrt((q * q).sum(1))[:, None] / np.sqrt((v * v).sum(1))[None, :]
                # a vector of length 0 has no cosine; in the SQL's order nan comes first
                ranks = np.where(np.isnan(scores), np.inf, scores)
                ranks[own[:, None] == ids[None, :]] = -np.inf
                least = np.partition(ranks, -k, 1)[:, -k] if ranks.shape[1] > k else np.full(len(own), -np.inf)
                x, y = np.nonzero((ranks >= least[:, None] - _SLACK) & (ranks > -np.inf))
                yield pa.RecordBatch.from_pydict({"query_id": own[x], "vec_id": ids[y], "score": scores[x, y]})

    return meet


def best_cosines(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): of vectors(label, vec_id, v) the k best of each query's label, other ids, by score and id."""

    def chunks(rows: DataFrame, size: int, chunk: str, name: str) -> DataFrame:
        pieces = rows.groupBy("label", F.size("v").alias("width")).agg(F.ceil(F.count("*") / size).cast("int").alias("pieces"))
        rows = rows.withColumn("width", F.size("v")).join(pieces, ["label", "width"])
        rows = rows.withColumn(chunk, F.pmod(F.xxhash64("vec_id"), F.col("pieces")).cast("int"))
        return rows.groupBy("label", "width", chunk).agg(F.collect_list(F.struct(F.col("vec_id").alias("id"), "v")).alias(name))

    vectors, queries = (rows.where("label is not null and vec_id is not null") for rows in (vectors, queries))
    filled = lambda rows: rows.where("v is not null")
    members, asked = chunks(filled(vectors), CHUNK, "chunk", "members"), chunks(filled(queries), ASKED, "part", "asked")
    met = members.join(asked, ["label", "width"]).select("asked", "members")
    found = met.mapInArrow(_meet(k), "query_id long, vec_id long, score double").withColumn("score", F.round("score", 6))
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    first = lambda rows: rows.withColumn("n", place).where(F.col("n") <= k + 1).select("label", "vec_id")
    own = lambda rows: rows.select("label", F.col("vec_id").alias("query_id"))
    blank = own(filled(queries)).join(first(vectors.where("v is null")), "label").unionByName(own(queries.where("v is null")).join(first(vectors), "label"))
    found = found.unionByName(blank.where("query_id <> vec_id").select("query_id", "vec_id", F.lit(None).cast("double").alias("score")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
