"""Op 7: exact top-k by inner product over a pivot-distance index.

Components become floor(256 * x), so scores are integers. Vectors are dealt into blocks of about BLOCK rows, and up to
WIDEST times that for many, by a hash of their id, which copies of one vector cannot make uneven. Each block is an index of its own: every vector is keyed
by its nearest pivot and its distance to it, sorted, and cut into annuli of up to ANNULUS rows. For a query q, a
pivot p and an annulus with distances [low, high], the triangle inequality gives |q-v| >= gap, the distance of |q-p|
from [low, high], so q.v <= (|q|^2 + max|v|^2 - gap^2) / 2. Annuli are opened by falling bound until the next bound
is under the k-th best score. Queries travel in blocks too and meet every block of vectors once, by a shuffle: their copies for
all blocks are many times their own size, which a broadcast would put on the driver. The k best of each meeting are merged. Pivots are PIVOTS rows with the least hash of their id (a bounded sample); every row is indexed
and every search is exact, so recall is 1.

Defined cases: vectors that are null or hold null or non-finite components take no part. Only vectors of one length
are compared; a query without partners has no rows. Repeated query rows give one result each distinct vector, and no
row with the query's own id is its candidate. Null ids can be found but are no queries; they come last among ties.
Scores that pass 64 bits are an error. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.tables import table

PIVOTS = 64
BLOCK = 4096
WIDEST, MANY = 8, 128
QUERIES = 1024
ANNULUS = 64
_NO_ID = 2**63 - 1
_SLACK = 1e-9
_MOST = 2.0**63 * (1 - 1e-9)


def quantized(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    whole = np.floor(256 * flat).reshape(-1, width)
    if whole.size and np.abs(whole).max() >= _MOST:
        raise ValueError("components of these vectors pass 64 bits")
    return whole.astype(np.int64)


def products(vectors: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products; sums that wrap around on their way are exact as long as the result fits."""
    if len(vectors) and float(np.abs(vectors).max()) * float(np.abs(q).max()) * len(q) >= _MOST and np.abs(vectors.astype(np.float64) @ q.astype(np.float64)).max() >= _MOST:
        raise ValueError("scores of these vectors pass 64 bits")
    return vectors @ q


def _packed(whole: np.ndarray) -> bytes:
    """Four bytes a component where that holds them, else eight."""
    return (whole.astype(np.int32) if not whole.size or np.abs(whole).max() < 2**31 else whole).tobytes()


def _whole(packed: bytes, width: int, many: int) -> np.ndarray:
    return np.frombuffer(packed, np.int32 if len(packed) == 4 * width * many else np.int64).reshape(many, width).astype(np.int64)


def build_index(ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, ...]:
    """ids and vectors by (nearest pivot, distance), and the annuli: start, pivot, least and most distance, most |v|^2."""
    exact = vectors.astype(np.float64)
    squares = (exact**2).sum(1)
    away = np.sqrt(np.maximum(0, squares[:, None] + (pivots**2).sum(1) - 2 * exact @ pivots.T))
    near = away.argmin(1)
    distance = away[np.arange(len(ids)), near]
    order = np.lexsort((distance, near))
    near, distance, squares = near[order], distance[order], squares[order]
    new_cell = np.r_[True, near[1:] != near[:-1]]
    first = np.maximum.accumulate(np.where(new_cell, np.arange(len(ids)), 0))
    starts = np.flatnonzero((np.arange(len(ids)) - first) % ANNULUS == 0)
    return ids[order], vectors[order], starts, near[starts], np.minimum.reduceat(distance, starts), np.maximum.reduceat(distance, starts), np.maximum.reduceat(squares, starts)


def search(q: np.ndarray, own: int, k: int, index: tuple[np.ndarray, ...], pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k best (ids, scores) of one index, by falling score and then rising id."""
    ids, vectors, starts, near, low, high, square = index
    exact = q.astype(np.float64)
    away = np.sqrt(((pivots - exact) ** 2).sum(1))[near]
    gap = np.maximum(0, np.maximum(low - away, away - high)) * (1 - _SLACK)
    bound = ((exact**2).sum() + square - gap**2) / 2
    bound += np.abs(bound) * _SLACK + 1
    order, ends = np.argsort(-bound), np.r_[starts[1:], len(ids)]
    best_ids, best = np.empty(0, np.int64), np.empty(0, np.int64)
    at, step = 0, 4
    while at < len(order) and (len(best) < k or bound[order[at]] >= best[-1]):
        rows = np.concatenate([np.arange(starts[a], ends[a]) for a in order[at : at + step]])
        rows = rows[ids[rows] != own]
        all_ids, scores = np.r_[best_ids, ids[rows]], np.r_[best, products(vectors[rows], q)]
        top = np.lexsort((all_ids, -scores))[:k]
        best_ids, best = all_ids[top], scores[top]
        at, step = at + step, 2 * step
    return best_ids, best


def block_rows(n: int) -> int:
    """Rows of a block: more than BLOCK where there would be over MANY blocks, as queries travel once for each."""
    return min(max(BLOCK, -(-n // MANY)), WIDEST * BLOCK)


def _pack(pivots: dict[int, np.ndarray]) -> Callable[[pa.Table], pa.Table]:
    def pack(rows: pa.Table) -> pa.Table:
        width = rows["width"][0].as_py()
        vectors, ids = quantized(rows["v"], width), rows["id"].to_numpy()
        marks = rows["mark"].to_numpy()
        parts = build_index(ids, vectors, pivots.get(width, np.zeros((1, width)))) if rows["indexed"][0].as_py() else (ids, vectors, marks)
        raw = [_packed(p) if n == 1 else p.tobytes() for n, p in enumerate(parts)] + [b""] * (7 - len(parts))
        return pa.table({"width": pa.array([width], pa.int32()), "block": pa.array([rows["block"][0].as_py()], pa.int32())} | {f"p{n}": pa.array([x], pa.binary()) for n, x in enumerate(raw)})

    return pack


def _meet(k: int, pivots: dict[int, np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                width = row["width"]
                at = pivots.get(width, np.zeros((1, width)))
                kinds = (np.int64, None, np.int64, np.int64, np.float64, np.float64, np.float64)
                index = [np.frombuffer(row[f"p{n}"], kind) if kind else None for n, kind in enumerate(kinds)]
                index[1] = _whole(row["p1"], width, len(index[0]))
                ids = np.frombuffer(row["q0"], np.int64)
                queries = _whole(row["q1"], width, len(ids))
                marks = np.frombuffer(row["q2"], np.int64)
                found = [search(q, own, k, tuple(index), at) for q, own in zip(queries, ids)]
                sizes = [len(x) for x, _ in found]
                yield pa.RecordBatch.from_pydict(
                    {
                        "query_id": np.repeat(ids, sizes),
                        "mark": np.repeat(marks, sizes),
                        "vec_id": np.concatenate([x for x, _ in found]),
                        "score": np.concatenate([s for _, s in found]),
                    }
                )

    return meet


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of `vectors` for each row of `queries`."""

    def clean(rows: DataFrame) -> DataFrame:
        values = F.col(vector_col).cast("array<double>")
        bad = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        rows = rows.where(F.col(vector_col).isNotNull() & ~bad)
        return rows.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), values.alias("v"), F.size(vector_col).alias("width"))

    data, asked = clean(vectors), clean(queries).where(F.col("id") != _NO_ID).dropDuplicates(["id", "v"])
    n, n_asked = data.count(), asked.count()
    sample = data.select("width", "v").orderBy(F.xxhash64("id"), "v").limit(PIVOTS).collect()
    pivots = {w: np.floor(256 * np.array([r.v for r in sample if r.width == w], np.float64)) for w in {r.width for r in sample}}
    blocks, asked_blocks = -(-n // block_rows(n)) or 1, -(-n_asked // QUERIES) or 1
    schema = "width int, block int, " + ", ".join(f"p{i} binary" for i in range(7))

    def packed(rows: DataFrame, many: int, indexed: bool) -> DataFrame:
        rows = rows.select("id", "v", "width", F.xxhash64("v").alias("mark"), F.pmod(F.xxhash64("id"), F.lit(many)).cast("int").alias("block"), F.lit(indexed).alias("indexed"))
        return rows.groupBy("width", "block").applyInArrow(_pack(pivots), schema)

    index = packed(data, blocks, True)
    q = packed(asked, asked_blocks, False).select("width", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.col("p0").alias("q0"), F.col("p1").alias("q1"), F.col("p2").alias("q2"))
    found = index.hint("merge").join(q, ["width", "block"]).mapInArrow(_meet(k, pivots), "query_id long, mark long, vec_id long, score long")
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", F.when(F.col("vec_id") != _NO_ID, F.col("vec_id")).alias("vec_id"), "score")


def op7_topk_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(rows, rows.where("vec_id % 50 = 0"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_dot_product(a.e, b.e)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
