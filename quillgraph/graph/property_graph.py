"""The property graph as two DataFrames, and its operators: neighbours, paths, reachability and pruning."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.session import cut


@dataclass(frozen=True)
class PropertyGraph:
    """nodes(id, label, name, owner, raw_text) and edges(src, rel, dst).

    `made(src, dst)` is for edges that are joins of nodes: all edges with a source in src(id), or a target in dst(id), and
    maybe others, without making all.
    """

    nodes: DataFrame
    edges: DataFrame
    made: Callable[[DataFrame | None, DataFrame | None], DataFrame] | None = None

    def visible(self) -> PropertyGraph:
        """Without edges that miss an end."""
        ids = self.nodes.select("id")
        edges = self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return PropertyGraph(self.nodes, edges.select("src", "rel", "dst"))

    def both_ways(self) -> DataFrame:
        """(id, other, rel): every edge from both of its ends."""
        ends = F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("id"), F.col("src").alias("other")))
        return self.edges.select("rel", F.explode(ends).alias("e")).select("e.id", "e.other", "rel")

    def without(self, ids: DataFrame) -> PropertyGraph:
        """Nodes of ids(id) go, and every edge at one of them."""
        edges = self.edges.join(ids.select(F.col("id").alias("src")), "src", "left_anti").join(ids.select(F.col("id").alias("dst")), "dst", "left_anti")
        return PropertyGraph(self.nodes.join(ids, "id", "left_anti"), edges.select("src", "rel", "dst"))


def from_tables(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The graph over the relational tables that tests and benches use."""

    def t(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def ident(prefix: str, key: str) -> Column:
        return F.concat(F.lit(prefix + "_"), F.col(key).cast("string"))

    def nodes(name: str, prefix: str, key: str, label: str, title: str, owner: Column, raw: Column) -> DataFrame:
        return t(name).select(ident(prefix, key).alias("id"), F.lit(label).alias("label"), F.col(title).alias("name"), owner.alias("owner"), raw.alias("raw_text"))

    none = F.lit(None).cast("string")
    every = nodes("region", "r", "r_regionkey", "总体", "r_name", none, none)
    every = every.unionByName(nodes("nation", "n", "n_nationkey", "系统", "n_name", ident("r", "n_regionkey"), none))
    every = every.unionByName(nodes("customer", "c", "c_custkey", "属性值", "c_name", ident("n", "c_nationkey"), F.col("c_mktsegment")))
    every = every.unionByName(nodes("supplier", "s", "s_suppkey", "单机", "s_name", ident("n", "s_nationkey"), none))
    every = every.unionByName(nodes("part", "p", "p_partkey", "故障模式", "p_name", F.col("p_brand"), F.col("p_type")))

    def edge(rows: DataFrame, src: Column, rel: str, dst: Column) -> DataFrame:
        return rows.select(src.alias("src"), F.lit(rel).alias("rel"), dst.alias("dst"))

    part = t("part")
    low, many = part.agg(F.min("p_partkey"), F.count("*")).first()
    following = F.concat(F.lit("p_"), ((F.lit(7) * F.col("p_partkey") + 3) % (many or 1) + (low or 0)).cast("string"))
    edges = edge(t("nation"), ident("r", "n_regionkey"), "INCLUDE", ident("n", "n_nationkey"))
    edges = edges.unionByName(edge(t("supplier"), ident("n", "s_nationkey"), "INCLUDE", ident("s", "s_suppkey")))
    edges = edges.unionByName(edge(t("customer"), ident("n", "c_nationkey"), "HAS", ident("c", "c_custkey")))
    edges = edges.unionByName(edge(t("lineitem").select("l_suppkey", "l_partkey").distinct(), ident("s", "l_suppkey"), "HAS_FAILURE_MODE", ident("p", "l_partkey")))
    edges = edges.unionByName(edge(part, ident("p", "p_partkey"), "LEADS_TO", following))
    near = t("supplier").select("s_suppkey", "s_nationkey", F.floor(F.col("s_acctbal") / 1000).alias("level"))
    other = near.select(F.col("s_suppkey").alias("o"), "s_nationkey", "level")

    def made(src: DataFrame | None, dst: DataFrame | None) -> DataFrame:
        known = lambda rows, key, ids: rows if ids is None else rows.join(ids, ident("s", key) == ids["id"], "left_semi")
        pairs = known(near, "s_suppkey", src).join(known(other, "o", dst), ["s_nationkey", "level"]).where("s_suppkey < o")
        return edges.unionByName(edge(pairs, ident("s", "s_suppkey"), "SIMILAR", ident("s", "o")))

    return PropertyGraph(every, made(None, None), made)


def direct_neighbours(graph: PropertyGraph, focus: DataFrame) -> DataFrame:
    """(id, other, rel) of the nodes of focus(id)."""
    return graph.both_ways().join(focus.select("id"), "id", "left_semi").select("id", "other", "rel").distinct()


def capped(edges: DataFrame, by: str, order: list[Column], limit: int) -> DataFrame:
    """At most `limit` rows each `by`, a top-k report."""
    return edges.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= limit)


def ego(graph: PropertyGraph, centres: DataFrame, hops: int) -> DataFrame:
    """(centre, id, depth): nodes within `hops` undirected steps, by the least depth.

    Each round joins the frontier to the edges at it and drops what is known; rows are (centre, node) pairs.
    """
    known = cut(centres.select(F.col("id").alias("centre"), "id", F.lit(0).alias("depth")))
    front = known
    for n in range(1, hops + 1):
        steps = edges_at(graph, front.select("id")).select("id", "other")
        found = front.join(steps, "id").select("centre", F.col("other").alias("id")).distinct()
        front = cut(found.join(known.select("centre", "id"), ["centre", "id"], "left_anti").withColumn("depth", F.lit(n)))
        known = known.unionByName(front)
    return known


#: So many ids are broadcast to filter edges; more are joined, with the same result.
FEW_IDS = 100_000


def edges_at(graph: PropertyGraph, ids: DataFrame) -> DataFrame:
    """(id, other, rel), distinct: the edges with an end in ids(id), from that end."""
    ids = cut(ids.distinct())
    if ids.count() <= FEW_IDS:
        ids = F.broadcast(ids)
    out, back = (graph.edges, graph.edges) if graph.made is None else (graph.made(ids, None), graph.made(None, ids))
    at = lambda edges, end, other: edges.join(ids.withColumnRenamed("id", end), end, "left_semi").select(F.col(end).alias("id"), F.col(other).alias("other"), "rel")
    return at(out, "src", "dst").unionByName(at(back, "dst", "src")).distinct()


def paths(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, end, hops, path) of directed simple paths of 1 to `depth` edges from starts(id); path joins ids by '>'."""
    step = edges.select(F.col("src").alias("end"), F.col("dst").alias("then")).distinct()
    now = starts.select(F.col("id").alias("start"), F.col("id").alias("end"), F.array("id").alias("nodes"))
    every = None
    for n in range(1, depth + 1):
        now = now.join(step, "end").where(~F.array_contains("nodes", F.col("then")))
        now = now.select("start", F.col("then").alias("end"), F.concat("nodes", F.array("then")).alias("nodes"))
        rows = now.withColumn("hops", F.lit(n))
        every = rows if every is None else every.unionByName(rows)
    return every.select("start", "end", "hops", F.array_join("nodes", ">").alias("path"))


def primary_path(found: DataFrame) -> DataFrame:
    """(start, path, hops): of each start the longest path, the least one among equals."""
    best = F.min_by("path", F.struct((-F.col("hops")).alias("n"), F.col("path")))
    return found.groupBy("start").agg(best.alias("path"), F.max("hops").alias("hops"))


def roots(edges: DataFrame) -> DataFrame:
    """(id): sources of edges that are no target."""
    return edges.select(F.col("src").alias("id")).distinct().join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with an end in ids(id), each as often as it comes."""
    known = ids.select("id").distinct()
    start = known.select(F.col("id").alias("src"), F.lit(True).alias("_s"))
    end = known.select(F.col("id").alias("dst"), F.lit(True).alias("_d"))
    return edges.join(start, "src", "left").join(end, "dst", "left").where("_s or _d").select("src", "rel", "dst")
