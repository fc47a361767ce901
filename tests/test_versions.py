import copy
import random

import pytest

from quillgraph.operators.versions import VersionedGraph

NODE, EDGE = "id string, labels array<string>, properties map<string,string>, ordinal int", "src string, rel string, dst string, properties map<string,string>, ordinal int"


class Plain:
    """Nodes and edges in dicts; a snapshot before each write is what undoing must give."""

    def __init__(self):
        self.nodes, self.edges, self.past = {}, {}, []

    def write(self, nodes, edges, links):
        self.past.append(copy.deepcopy((self.nodes, self.edges)))
        seen = {}
        for id_, labels, props, _ in sorted(nodes, key=lambda r: r[3]):
            old = self.past[-1][0].get(id_, ([], {}))[0]
            seen[id_] = (list(dict.fromkeys(old + labels)), {k: v for k, v in props.items() if v is not None})
        self.nodes |= seen
        for s, r, d, props, _ in sorted(edges, key=lambda r: r[4]):
            self.edges[s, r, d] = {k: v for k, v in (props or {}).items() if v is not None}
        for s, r, d, props, _ in sorted(links, key=lambda r: r[4]):
            self.edges.setdefault((s, r, d), {}).update({k: v for k, v in (props or {}).items() if v is not None})

    def delete(self, ids):
        self.past.append(copy.deepcopy((self.nodes, self.edges)))
        self.nodes = {i: n for i, n in self.nodes.items() if i not in ids}
        self.edges = {e: p for e, p in self.edges.items() if e[0] not in ids and e[2] not in ids}

    def undo(self):
        self.nodes, self.edges = self.past.pop()


def state(graph):
    return {r.id: (r.labels, r.properties) for r in graph.nodes().collect()}, {(r.src, r.rel, r.dst): r.properties for r in graph.edges().collect()}


def payload(draw, known):
    props = lambda: draw.choice([{}, {"a": str(draw.randrange(9))}, {"a": None, "b": "x"}])
    nodes = [(f"n{draw.randrange(12)}", draw.choice([["L"], ["M"], []]), props(), n) for n in range(6)]
    ids = sorted(known | {n[0] for n in nodes})
    edges = [(draw.choice(ids), draw.choice("AB"), draw.choice(ids), props(), n) for n in range(6)]
    links = [(draw.choice(ids), "SIMILAR", draw.choice(ids), draw.choice([None, *[props() for _ in range(2)]]), n) for n in range(4)]
    return nodes, edges, links + [(*edges[0][:3], {"over": "1"}, 9)]


def test_writes_and_undoing_leave_every_table_as_before(spark, tmp_path):
    draw, graph, plain = random.Random(2), VersionedGraph(spark, str(tmp_path / "g")), Plain()
    assert graph.undo() is None
    assert state(graph) == ({}, {})
    for n in range(4):
        nodes, edges, links = payload(draw, set(plain.nodes))
        frames = [spark.createDataFrame(rows, schema) for rows, schema in ((nodes, NODE), (edges, EDGE), (links, EDGE))]
        record = graph.write(*frames, token=f"t{n}")
        before = len(plain.nodes)
        plain.write(nodes, edges, links)
        assert state(graph) == (plain.nodes, plain.edges)
        assert record.counters["created_nodes"] == len(plain.nodes) - before
        assert graph.write(*frames, token=f"t{n}") == record
        if n == 2:
            graph.compact()
    some = sorted(plain.nodes)[:3]
    graph.delete(spark.createDataFrame([(i,) for i in some], "id string"))
    plain.delete(set(some))
    assert state(graph) == (plain.nodes, plain.edges)
    assert [r.version for r in graph.versions().collect()] == [6, 5, 3, 2, 1]
    for _ in range(5):
        assert graph.undo().kind == "undo"
        plain.undo()
        assert state(graph) == (plain.nodes, plain.edges)
    assert graph.undo() is None


def test_half_a_write_is_not_seen_and_is_written_over(spark, tmp_path):
    graph = VersionedGraph(spark, str(tmp_path / "g"), keep=1)
    nodes, none = spark.createDataFrame([("a", ["L"], {"k": "1"}, 0)], NODE), spark.createDataFrame([], EDGE)
    graph.write(nodes, none)
    # the rows of a write that died before its record
    half = spark.createDataFrame([("b", ["L"], {}, False, True, None)], "id string, labels array<string>, properties map<string,string>, deleted boolean, created boolean, before struct<labels:array<string>,properties:map<string,string>>")
    half.write.parquet(f"{graph.folder}/log/nodes/version=2")
    assert set(state(graph)[0]) == {"a"}
    graph.write(spark.createDataFrame([("c", [], {}, 0)], NODE), none)
    assert set(state(graph)[0]) == {"a", "c"}
    assert graph.versions().count() == 1


def test_edges_to_nowhere_are_refused(spark, tmp_path):
    graph = VersionedGraph(spark, str(tmp_path / "g"))
    nodes = spark.createDataFrame([("a", ["L"], {}, 0)], NODE)
    with pytest.raises(ValueError, match="nowhere"):
        graph.write(nodes, spark.createDataFrame([("a", "A", "nowhere", {}, 0)], EDGE))
    assert state(graph) == ({}, {})


def test_cascade_takes_edges_of_other_writes(spark, tmp_path):
    graph = VersionedGraph(spark, str(tmp_path / "g"))
    none = spark.createDataFrame([], EDGE)
    graph.write(spark.createDataFrame([("a", [], {}, 0)], NODE), none)
    graph.write(spark.createDataFrame([("b", [], {}, 0)], NODE), spark.createDataFrame([("a", "A", "b", {}, 0)], EDGE), spark.createDataFrame([("b", "SIMILAR", "a", {"s": "1"}, 0)], EDGE))
    record = graph.undo()
    assert state(graph) == ({"a": ([], {})}, {})
    assert (record.counters["deleted_nodes"], record.counters["deleted_edges"], record.counters["deleted_links"]) == (1, 1, 1)
