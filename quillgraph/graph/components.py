"""Connected components by alternating large-star and small-star rounds, with hubs joined apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.session import cut

#: At most this many nodes count as hubs: the degree limit rises with the edges, so the broadcast stays this small.
MAX_HUBS = 2000


def _with_minimum(edges: DataFrame, lows: DataFrame, limit: int) -> DataFrame:
    """edges(u, v) with m, the minimum of u's row in lows(u, m, n).

    Nodes with over `limit` edges are joined by a broadcast; there are at most 2 * edges / limit of them.
    """
    hubs = F.broadcast(lows.where(F.col("n") > limit).select("u", "m"))
    rest = lows.where(F.col("n") <= limit).select("u", "m")
    return edges.join(hubs, "u").unionByName(edges.join(hubs, "u", "left_anti").join(rest, "u"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100, partitions: int | None = None) -> DataFrame:
    """(node, component) for every node that an edge names; component is the least node reachable.

    Edges are undirected; null ends, self-loops and repeated edges are allowed (edges with a null end are ignored,
    a node that only has self-loops is its own component). No edges: an empty result. With `partitions`, edges are few and
    the rounds keep them in so many partitions: a round's files otherwise outweigh its rows.
    """
    few = lambda rows: rows if partitions is None else rows.coalesce(partitions)
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    loops = pairs.where("a = b").select(F.col("a").alias("node")).distinct()
    now = cut(few(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()))
    stat = None
    for _ in range(max_rounds):
        new_stat = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if new_stat == stat or new_stat[0] == 0:
            break
        stat = new_stat
        limit = max(200, 2 * stat[0] // MAX_HUBS + 1)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = both.groupBy("u").agg(F.min("v").alias("w"), F.count("*").alias("n")).select("u", F.least("w", "u").alias("m"), "n")
        large = few(_with_minimum(both, lows, limit)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(few(large))
        lows = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = few(_with_minimum(large, lows, limit)).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        now = cut(few(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    ends = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    known = ends.unionByName(roots)
    return known.unionByName(loops.join(known, "node", "left_anti").select("node", F.col("node").alias("component")))
