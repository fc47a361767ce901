"""A graph of several tables under versions: one commit over nodes, edges and link edges, and its undoing.

A folder holds base snapshots, a log of changed rows for each version, and commit records. A write appends only the rows
that it changes, with what was there before; the state is the base and, for each key, the last row of the published log.
The record of a commit is written last, so readers never see half of one, and a write that died is written over. A write
with a token that was committed before does nothing, so replays are safe. `compact` makes the state a new base.

Undoing goes by the newest commit that is not undone: its link edges first, then its edges, then its nodes: what it
created goes, and with a node every edge at it; what it changed gets its values from before. That is a commit of its own.
Only the `keep` newest writes can be undone.

Inputs are nodes(id, labels, properties, ordinal), edges and links(src, rel, dst, properties, ordinal). Defined cases: of
repeated nodes or edges the last by ordinal counts; a node's properties are replaced and its labels united with the old
ones; an edge's properties are replaced; a link's lie over the old ones, key by key; null values are no properties; null
keys are dropped; an edge to a node that is neither in the state nor in the payload is an error, and nothing is written.
All files go through Spark, so the folder may be any that driver and executors share.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quillgraph.session import cut

KEEP = 10
_MAP = "map<string,string>"
_NODE = "id string, labels array<string>, properties map<string,string>, deleted boolean, created boolean, before struct<labels:array<string>,properties:map<string,string>>"
_EDGE = "src string, rel string, dst string, kind string, properties map<string,string>, deleted boolean, created boolean, before map<string,string>"
_COMMIT = "version int, created_at string, token string, kind string, undoes int, base int, counters map<string,bigint>"
_ENDS = ["src", "rel", "dst"]


def _last(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    others = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_row"))
    return last.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others])


def _tidy(properties: str) -> Column:
    empty = F.create_map().cast(_MAP)
    return F.map_filter(F.coalesce(properties, empty), lambda k, v: v.isNotNull())


def overlaid(old: Column, more: Column) -> Column:
    """A map with another one over it."""
    empty = F.create_map().cast(_MAP)
    first, second = F.coalesce(old, empty), F.coalesce(more, empty)
    return F.map_concat(F.map_filter(first, lambda k, v: ~F.array_contains(F.map_keys(second), k)), second)


@dataclass(frozen=True)
class VersionedGraph:
    spark: SparkSession
    folder: str
    keep: int = KEEP

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def commits(self) -> list[Row]:
        """All published commits, the oldest first: one small record each."""
        return sorted(self._read("commits", _COMMIT).collect(), key=lambda c: c.version)

    def versions(self) -> DataFrame:
        """(version, created_at, counters): what can be undone, the newest first."""
        return self.spark.createDataFrame([(c.version, c.created_at, c.counters) for c in self._undoable()], "version int, created_at string, counters map<string,bigint>")

    def _undoable(self) -> list[Row]:
        commits = self.commits()
        gone = {c.undoes for c in commits if c.kind == "undo"}
        writes = [c for c in commits if c.kind in ("write", "delete") and c.version not in gone]
        return writes[: -self.keep - 1 : -1]

    def _state(self, name: str, schema: str, keys: list[str], commits: list[Row]) -> DataFrame:
        base = max((c.base for c in commits), default=0)
        since = [c.version for c in commits if c.version > base]
        log = self._read(f"log/{name}", f"{schema}, version int").where(F.col("version").isin(since))
        rows = self._read(f"base/{name}", f"{schema}, version int").where(F.col("version") == base).unionByName(log)
        order = F.struct("version", F.col("kind") == "link") if "kind" in rows.columns else F.col("version")
        return _last(rows, keys, order).where(~F.col("deleted"))

    def nodes(self) -> DataFrame:
        return self._state("nodes", _NODE, ["id"], self.commits()).select("id", "labels", "properties")

    def edges(self) -> DataFrame:
        return self._state("edges", _EDGE, _ENDS, self.commits()).select(*_ENDS, "properties")

    def _publish(self, kind: str, nodes: DataFrame, edges: DataFrame, counters: dict[str, int] | None = None, token: str | None = None, undoes: int | None = None) -> Row:
        commits = self.commits()
        version = max((c.version for c in commits), default=0) + 1
        nodes.select(*[c.split()[0] for c in _NODE.split(", ")]).write.mode("overwrite").parquet(f"{self.folder}/log/nodes/version={version}")
        edges.select(*[c.split()[0] for c in _EDGE.split(", ")]).write.mode("overwrite").parquet(f"{self.folder}/log/edges/version={version}")
        counters = counters or self._counted(version)
        row = (version, datetime.now(timezone.utc).isoformat(), token, kind, undoes, max((c.base for c in commits), default=0), counters)
        self.spark.createDataFrame([row], _COMMIT).coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")
        return next(c for c in self.commits() if c.version == version)

    def _counted(self, version: int) -> dict[str, int]:
        count = lambda rows, by: {(r[0], r.created): r.n for r in rows.groupBy(by, "created").agg(F.count("*").alias("n")).collect()}
        nodes = count(self._read(f"log/nodes/version={version}", _NODE), F.lit("node"))
        edges = count(self._read(f"log/edges/version={version}", _EDGE), "kind")
        found = nodes | edges
        return {f"{what}_{kind}s": found.get((kind, what == "created"), 0) for kind in ("node", "edge", "link") for what in ("created", "matched")}

    def write(self, nodes: DataFrame, edges: DataFrame, links: DataFrame | None = None, token: str | None = None) -> Row:
        """Commits a payload; of a token that was committed before, the record of then."""
        commits = self.commits()
        if token is not None and (done := [c for c in commits if c.token == token]):
            return done[0]
        old_nodes, old_edges = self.nodes(), self.edges()
        new = _last(nodes.where("id is not null").select("id", "labels", _tidy("properties").alias("properties"), "ordinal"), ["id"], F.col("ordinal")).drop("ordinal")
        was = old_nodes.select("id", F.struct("labels", "properties").alias("before"))
        node_rows = new.join(was, "id", "left").withColumn("created", F.col("before").isNull()).withColumn("deleted", F.lit(False))
        none = F.array().cast("array<string>")
        node_rows = cut(node_rows.withColumn("labels", F.array_distinct(F.concat(F.coalesce("before.labels", none), F.coalesce("labels", none)))))
        known = old_nodes.select("id").unionByName(node_rows.select("id"))

        def full(rows: DataFrame) -> DataFrame:
            return rows.where("src is not null and rel is not null and dst is not null").select(*_ENDS, _tidy("properties").alias("properties"), "ordinal")

        plain = _last(full(edges), _ENDS, F.col("ordinal")).drop("ordinal")
        before = old_edges.select(*_ENDS, F.col("properties").alias("before"))
        edge_rows = cut(plain.join(before, _ENDS, "left").withColumn("kind", F.lit("edge")))
        if links is not None:
            each = full(links)
            last = each.select(*_ENDS, "ordinal", F.explode_outer("properties").alias("k", "v")).groupBy(*_ENDS, "k").agg(F.max_by("v", "ordinal").alias("v"))
            over = last.groupBy(*_ENDS).agg(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "v"))))).alias("properties"))
            # a link finds the edge as this payload's edges leave it
            there = edge_rows.select(*_ENDS, F.col("properties").alias("before"))
            there = there.unionByName(before.join(there, _ENDS, "left_anti"))
            link_rows = over.join(there, _ENDS, "left").withColumn("properties", overlaid(F.col("before"), F.col("properties"))).withColumn("kind", F.lit("link"))
            edge_rows = cut(edge_rows.unionByName(link_rows))
        ends = edge_rows.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        lost = [r.id for r in ends.join(known, "id", "left_anti").limit(5).collect()]
        if lost:
            raise ValueError(f"edges name nodes that do not exist, such as {', '.join(lost)}")
        edge_rows = edge_rows.withColumn("created", F.col("before").isNull()).withColumn("deleted", F.lit(False))
        return self._publish("write", node_rows, edge_rows, token=token)

    def delete(self, ids: DataFrame) -> Row:
        """Nodes of ids(id) go, and every edge at one of them."""
        none = self.spark.createDataFrame([], _NODE)
        gone = self.nodes().join(ids.select("id").distinct(), "id", "left_semi")
        rows = cut(gone.withColumn("before", F.struct("labels", "properties")).withColumn("created", F.lit(False)).withColumn("deleted", F.lit(True)).select(*none.columns))
        return self._publish("delete", rows, self._cut_off(self.edges(), rows.select("id")))

    def _cut_off(self, edges: DataFrame, ids: DataFrame) -> DataFrame:
        """Deletions of the edges at some nodes, each once."""
        at = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi")
        at = at.unionByName(edges.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").select(*at.columns)).dropDuplicates(_ENDS)
        return at.withColumn("before", F.col("properties")).withColumn("created", F.lit(False)).withColumn("deleted", F.lit(True)).withColumn("kind", F.lit("edge"))

    def undo(self) -> Row | None:
        """Takes the newest commit back; None if there is none left."""
        undoable = self._undoable()
        if not undoable:
            return None
        version = undoable[0].version
        node_log = self._read(f"log/nodes/version={version}", _NODE)
        edge_log = self._read(f"log/edges/version={version}", _EDGE)
        # an edge that the commit wrote as edge and as link had its first values before the edge
        first = _last(edge_log.select(*_ENDS, "kind", "created", "before"), _ENDS, F.col("kind") == "edge")
        state = self.edges()
        back = first.withColumn("deleted", F.col("created")).withColumn("properties", F.col("before")).withColumn("before", F.lit(None).cast(_MAP))
        back = cut(back.select(*_ENDS, "kind", "properties", "deleted", "created", "before"))
        nodes = node_log.withColumn("deleted", F.col("created")).withColumn("labels", F.col("before.labels")).withColumn("properties", F.col("before.properties"))
        nodes = cut(nodes.withColumn("created", F.lit(False)))
        left = state.join(back.select(*_ENDS), _ENDS, "left_anti").unionByName(back.where("not deleted").select(*_ENDS, "properties"))
        cascade = cut(self._cut_off(left, nodes.where("deleted").select("id")))
        back = back.join(cascade.select(*_ENDS), _ENDS, "left_anti").unionByName(cascade.select(*back.columns)).withColumn("created", F.lit(False))
        counts = {f"{what}_nodes": nodes.where(F.col("deleted") == (what == "deleted")).count() for what in ("deleted", "restored")}
        counts |= {f"{what}_{kind}s": first.where((F.col("created") == (what == "deleted")) & (F.col("kind") == kind)).count() for kind in ("edge", "link") for what in ("deleted", "restored")}
        return self._publish("undo", nodes, back, counts, undoes=version)

    def compact(self) -> Row:
        """The state as a new base, which later reads start from; what can be undone stays so."""
        commits = self.commits()
        version = max((c.version for c in commits), default=0) + 1
        tables = {"nodes": self._state("nodes", _NODE, ["id"], commits), "edges": self._state("edges", _EDGE, _ENDS, commits)}
        for name, rows in tables.items():
            rows.drop("version").write.mode("overwrite").parquet(f"{self.folder}/base/{name}/version={version}")
        row = (version, datetime.now(timezone.utc).isoformat(), None, "base", None, version, {})
        self.spark.createDataFrame([row], _COMMIT).coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")
        return next(c for c in self.commits() if c.version == version)
