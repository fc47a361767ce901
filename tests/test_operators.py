import difflib

from pyspark.sql import functions as F

from quillgraph import config
from quillgraph.functions import text as X
from quillgraph.functions.udfs import seq_ratio, split_owner, split_prefixed, text_similarity
from quillgraph.operators import changes, linking, properties, ranking, triples


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_edges(spark):
    assert one(spark, X.compact(F.lit(" A　b\t"))) == "ab"
    assert one(spark, X.grams(F.lit("a"))) == ["a"]
    assert one(spark, X.grams(F.lit(""))) == []
    assert one(spark, X.grams(F.lit("abab"))) == ["ab", "ba"]
    assert one(spark, X.tokens(F.lit("Valve_1 阀门 x"))) == ["valve_1", "x", "阀", "门"]
    empty = F.array().cast("array<string>")
    assert one(spark, X.jaccard(empty, empty)) == 1.0
    assert one(spark, X.keyword_score(F.lit("abc"), F.lit("b"))) == 1.0
    assert one(spark, X.keyword_score(F.lit(""), F.lit("b"))) == 0.0
    assert one(spark, X.coverage(F.lit("ab"), F.lit("ab"))) == 1.0
    assert one(spark, X.replaced(F.lit("液氧阀无法打开"), config.SYNONYMS)) == "阀打不开"
    assert [one(spark, X.percent(F.lit(x))) for x in (0.0, 0.5, 2.0)] == [1, 50, 100]


def test_relations_and_roles(spark):
    assert one(spark, X.canonical_relation(F.lit("具有复核要求（HAS_REVIEW_REQUIREMENT）"), config.RELATION_ALIASES)) == "HAS"
    assert one(spark, X.canonical_relation(F.lit("x"), config.RELATION_ALIASES)) == "x"
    assert one(spark, X.alias_group(F.lit("组件级故障模式"), config.ROLES)) == "fault_mode"
    assert one(spark, X.alias_group(F.lit("某系统级故障现象甲"), config.ROLES)) == "phenomenon"
    assert one(spark, X.alias_group(F.lit(None).cast("string"), config.ROLES)) == "other"


def test_udfs(spark):
    rows = spark.createDataFrame([("abcd", "bcde"), ("", "x"), (None, "x")], "a string, b string").select(seq_ratio("a", "b").alias("r")).collect()
    assert [r.r for r in rows] == [difflib.SequenceMatcher(None, "abcd", "bcde").ratio(), 0.0, 0.0]
    assert split_owner("泵(a:b)：漏") == ("泵(a:b)", "漏")
    row = spark.createDataFrame([("泵：漏；阀：卡；泵：漏",)], "t string").select(split_prefixed("t").alias("x")).first()
    assert [(p.owner, p.mode) for p in row.x] == [("泵", "漏"), ("阀", "卡")]


def test_changes_roll_back(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "id int, name string, note string")
    new = spark.createDataFrame([(2, "B", None), (3, "c", "y")], "id int, name string, note string")
    state = changes.upsert(old, new, "id")
    assert {tuple(r) for r in state.collect()} == {(1, "a", None), (2, "B", None), (3, "c", "y")}
    log = changes.change_log(old, new, "id")
    assert {(r.id, r.created) for r in log.collect()} == {(2, False), (3, True)}
    assert {tuple(r) for r in changes.rollback(state, log, "id").collect()} == {tuple(r) for r in old.collect()}


def test_edges_overlay_and_fold(spark):
    kind = "src string, rel string, dst string, props map<string,string>"
    old = spark.createDataFrame([("a", "r", "b", {"x": "1", "y": "2"})], kind)
    new = spark.createDataFrame([("a", "r", "b", {"y": "3"}), ("a", "r", "c", {})], kind)
    got = {r.dst: r.props for r in changes.upsert_edges(old, new).collect()}
    assert got == {"b": {"x": "1", "y": "3"}, "c": {}}
    rows = spark.createDataFrame([("a", "r", "b", "u", 1), ("a", "r", "b", "v", 2), ("a", "r", "a", "w", 3)], "src string, rel string, dst string, attribute string, n int")
    assert [tuple(r) for r in changes.fold_relations(rows, "n").collect()] == [("a", "r", "b", "v")]


def test_canonical_triples(spark):
    rows = spark.createDataFrame([("a", "t", "has", "b", "u"), ("a", "t", "has", "b", "u"), ("", "t", "has", "b", "u")], "subject string, subject_type string, predicate string, object string, object_type string")
    entities, relations, facts = triples.canonical(rows)
    assert (entities.count(), relations.count(), facts.count()) == (2, 1, 1)
    assert facts.first().id.startswith("T_") and len(facts.first().id) == 18


def test_values_scores_and_ranks(spark):
    assert one(spark, X.property_values(F.lit(" a / b；a, ,c"))) == ["a", "b", "c"]
    assert one(spark, X.property_values(F.lit("，"))) == ["，"]
    assert one(spark, X.property_values(F.lit(None).cast("string"))) == []
    assert one(spark, X.character_score(F.lit("ABx"), F.lit("b a"))) == 2 / 3
    assert one(spark, X.character_score(F.lit(None).cast("string"), F.lit("b"))) == 0.0
    assert [one(spark, X.stage_rank(F.lit(x))) for x in ("零部组件", "单机级故障模式", "系统", "总体", "", None)] == [0, 1, 2, 3, 99, 99]
    place = one(spark, X.layout_place(F.lit("系统"), F.lit("阀"), {"系统": 30}))
    assert (place.x, place.y) == (30.0, sum(map(ord, "系统:阀")) % 84 + 8)
    assert one(spark, X.exactly_matches(F.array(F.lit("A b")), F.array(F.lit("x"), F.lit("aB "))))
    assert not one(spark, X.exactly_matches(F.array(F.lit(" ")), F.array(F.lit(""))))


def test_text_similarity_equals_direct_form(spark):
    pairs = [("abcd", "bc de"), ("Valve 1", "valve 2"), ("阀门卡滞", "阀门"), ("", "x"), (None, "x"), (" ", " ")]
    got = spark.createDataFrame(pairs, "a string, b string").select(text_similarity(F.col("a"), F.col("b")).alias("s")).collect()

    def tokens(text):
        import re

        return set(re.findall("[a-z0-9_]+|[一-鿿]", text))

    def direct(a, b):
        a, b = ("".join((x or "").lower().split()) for x in (a, b))
        if not a or not b:
            return 0.0
        x, y = tokens(a), tokens(b)
        return max(difflib.SequenceMatcher(None, a, b).ratio(), len(x & y) / len(x | y) if x | y else 1.0)

    assert [r.s for r in got] == [direct(a, b) for a, b in pairs]


def test_promoted_order(spark):
    rows = [("q", "a", "other", 0.9, 0.1, 1), ("q", "b", "entity", 0.7, 0.9, 2), ("q", "cc", "entity", 0.8, 0.5, 3), ("q", "d", "entity", 0.8, 0.5, 4), ("q", "e", None, None, None, 5)]
    got = ranking.promoted(spark.createDataFrame(rows, "q string, name string, role string, subject double, recall double, place int"), "q", "place")
    assert [r.name for r in got.orderBy("rank").collect()] == ["d", "cc", "a", "b", "e"]


def test_edges_required_and_last_rows(spark):
    kind = "src string, rel string, dst string"
    edges = spark.createDataFrame([("a", "INCLUDE", "b"), ("a", "LEADS_TO", "b"), ("a", "INCLUDE", "c"), ("a", "INCLUDE", "c")], kind)
    must = spark.createDataFrame([("a", "INCLUDE", "c"), ("x", "HAS", "y")], kind)
    got = {tuple(r) for r in triples.sanitised(edges, "INCLUDE", "LEADS_TO", must).collect()}
    assert got == {("a", "LEADS_TO", "b"), ("a", "INCLUDE", "c"), ("x", "HAS", "y")}
    assert triples.sanitised(edges.limit(0), "INCLUDE", "LEADS_TO", must.limit(0)).count() == 0
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, None, 1)], "id int, name string, at int")
    assert {tuple(r) for r in changes.last_rows(rows, "id", "at").collect()} == {(1, "b", 2), (2, None, 1)}
    lists = spark.createDataFrame([(1, ["x", " ", "x", "y"], []), (2, None, ["z"])], "id int, a array<string>, b array<string>")
    assert {tuple(r) for r in properties.attribute_nodes(lists, "id", ["a", "b"]).collect()} == {(1, "a", "x / y"), (2, "b", "z")}


def test_banded_pairs_are_spread_and_whole(spark):
    rows = [(n, n % 2, None if v is None else float(v)) for n, v in enumerate([0, 10, 10, 20, 2.5, 7.5, -10, -2.5, 19.99, 30, None, 12.5] * 3)]
    found = linking.banded_pairs(spark.createDataFrame(rows, "id long, block int, value double"), "block", "value", 10.0)
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    want = [(a, b, x, y) for a, p, x in rows for b, q, y in rows if a < b and p == q and x is not None and y is not None and abs(x - y) <= 10]
    assert sorted(map(tuple, found.collect())) == sorted(want)
