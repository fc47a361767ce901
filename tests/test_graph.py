import random

from pyspark.sql import functions as F

from quillgraph.graph import property_graph as G
from quillgraph.graph.components import connected_components


def roots(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    return {x: find(x) for x in parent}


def test_components_match_union_find(spark):
    draw = random.Random(1)
    pairs = [(draw.randrange(60), draw.randrange(60)) for _ in range(40)] + [(n, n + 1) for n in range(100, 130)] + [(200, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == roots(pairs)


def test_components_of_a_star_with_a_large_centre(spark):
    pairs = [(1000, n) for n in range(600)]
    got = connected_components(spark.createDataFrame(pairs, "src long, dst long"))
    assert {r.component for r in got.collect()} == {0}


def test_components_of_nothing(spark):
    rows = spark.createDataFrame([(None, 1), (2, None)], "src long, dst long")
    assert connected_components(rows).count() == 0


def graph(spark):
    nodes = spark.createDataFrame([(c, "x", c, None, None) for c in "abcd"], "id string, label string, name string, owner string, raw_text string")
    edges = spark.createDataFrame([("a", "r", "b"), ("b", "r", "c"), ("c", "r", "a"), ("c", "r", "lost"), ("d", "r", "d")], "src string, rel string, dst string")
    return G.PropertyGraph(nodes, edges)


def test_visible_drops_dangling_edges(spark):
    assert graph(spark).visible().edges.count() == 4


def test_paths_are_simple_and_bounded(spark):
    g = graph(spark)
    found = {r.path for r in G.paths(g.edges, g.nodes.where("id = 'a'").select("id"), 3).collect()}
    assert found == {"a>b", "a>b>c", "a>b>c>lost"}
    assert G.primary_path(G.paths(g.edges, g.nodes.where("id = 'a'").select("id"), 3)).first().path == "a>b>c>lost"


def test_ego_takes_the_least_depth(spark):
    g = graph(spark)
    got = {r.id: r.depth for r in G.ego(g, g.nodes.where("id = 'a'").select("id"), 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "lost": 2}


def test_without_takes_edges_along(spark):
    g = graph(spark).without(spark.createDataFrame([("c",)], "id string"))
    assert g.nodes.count() == 3 and g.edges.count() == 2


def test_roots(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    assert [r.id for r in G.roots(edges).collect()] == ["a"]
    assert G.capped(edges.withColumn("k", F.lit(1)), "k", [F.col("src")], 1).count() == 1


def test_anchors_texts_and_touching(spark):
    from quillgraph.graph import analysis as A
    from quillgraph.graph import property_graph as G

    nodes = spark.createDataFrame([("m", "单机", "泵", None), ("f", "故障模式", "漏", "x"), ("g", "故障模式", "卡", None), ("z", "系统", "空", None)], "id string, label string, name string, raw_text string")
    edges = spark.createDataFrame([("m", "HAS", "f"), ("g", "HAS", "m"), ("f", "LEADS_TO", "g")], "src string, rel string, dst string")
    faults = nodes.where("label = '故障模式'")
    found = A.fault_anchors(edges, faults, nodes)
    assert {tuple(r) for r in found.collect()} == {("m", "f"), ("m", "g"), ("f", "f"), ("g", "g")}
    ranked = spark.createDataFrame([("s", "a", 1, 99, 0.9, 0.0, "n"), ("s", "b", 1, 1, 0.1, 0.0, "n"), ("t", "a", 99, 99, 0.1, 0.0, "n"), ("t", "b", 99, 2, 0.5, 0.0, "n")], "start string, anchor string, start_rank int, rank int, keyword double, subject double, name string")
    assert {tuple(r) for r in A.primary_anchor(ranked).collect()} == {("s", "b"), ("t", "b")}
    texts = {r.id: r.text for r in A.node_texts(nodes, edges, limit=1).collect()}
    assert texts["f"] == "名称:漏。类型:故障模式。描述:x。邻域:HAS<-单机:泵" and texts["z"] == "名称:空。类型:系统"
    assert G.touching(edges, nodes.where("id = 'm'")).count() == 2
    assert G.touching(edges, nodes.limit(0)).count() == 0


def test_edges_at_ids_are_filtered_before_the_join_that_makes_them(spark):
    ids = spark.createDataFrame([("n_1",), ("n_1",), ("s_3",)], "id string")
    g = G.from_tables(spark, "/root/testdata/sf0.001")
    found = G.edges_at(g, ids)
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    pairs = [n for n, line in enumerate(plan) if "Join Inner" in line and "level" in line]
    assert len(pairs) == 2
    for n in pairs:
        end = next((m for m in range(n + 1, len(plan)) if depth(plan[m]) <= depth(plan[n])), len(plan))
        assert any("Join LeftSemi" in line for line in plan[n:end])
    known = {"n_1", "s_3"}
    want = {(x, y, e.rel) for e in g.edges.collect() for x, y in ((e.src, e.dst), (e.dst, e.src)) if x in known}
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_many_ids_are_joined_with_the_same_result(spark, monkeypatch):
    g = G.from_tables(spark, "/root/testdata/sf0.001")
    centres = g.nodes.where("label = '总体'").select("id")
    want = sorted(map(tuple, G.ego(g, centres, 2).collect()))
    monkeypatch.setattr(G, "FEW_IDS", 0)
    assert sorted(map(tuple, G.ego(g, centres, 2).collect())) == want
