"""The library's queries over the driver's tables, and the same in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph import config
from quillgraph.functions import text as X
from quillgraph.functions.cosines import best_cosines
from quillgraph.functions.udfs import seq_ratio, split_prefixed
from quillgraph.graph import property_graph as G
from quillgraph.graph.components import connected_components
from quillgraph.operators import changes, linking, triples

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_GRAPH = """
nodes AS (SELECT 'r_' || r_regionkey AS id, '总体' AS label, r_name AS name, NULL::VARCHAR AS owner, NULL::VARCHAR AS raw_text FROM region
  UNION ALL SELECT 'n_' || n_nationkey, '系统', n_name, 'r_' || n_regionkey, NULL FROM nation
  UNION ALL SELECT 'c_' || c_custkey, '属性值', c_name, 'n_' || c_nationkey, c_mktsegment FROM customer
  UNION ALL SELECT 's_' || s_suppkey, '单机', s_name, 'n_' || s_nationkey, NULL FROM supplier
  UNION ALL SELECT 'p_' || p_partkey, '故障模式', p_name, p_brand, p_type FROM part),
pm AS (SELECT min(p_partkey) AS lo, count(*) AS n FROM part),
sl AS (SELECT s_suppkey, s_nationkey, floor(s_acctbal / 1000)::BIGINT AS level FROM supplier),
edges AS (SELECT 'r_' || n_regionkey AS src, 'INCLUDE' AS rel, 'n_' || n_nationkey AS dst FROM nation
  UNION ALL SELECT 'n_' || s_nationkey, 'INCLUDE', 's_' || s_suppkey FROM supplier
  UNION ALL SELECT 'n_' || c_nationkey, 'HAS', 'c_' || c_custkey FROM customer
  UNION ALL SELECT DISTINCT 's_' || l_suppkey, 'HAS_FAILURE_MODE', 'p_' || l_partkey FROM lineitem
  UNION ALL SELECT 'p_' || p_partkey, 'LEADS_TO', 'p_' || ((7 * p_partkey + 3) % n + lo) FROM part, pm
  UNION ALL SELECT 's_' || a.s_suppkey, 'SIMILAR', 's_' || b.s_suppkey FROM sl a JOIN sl b ON a.s_nationkey = b.s_nationkey AND a.level = b.level AND a.s_suppkey < b.s_suppkey)
"""


def query(sql: str | None = None, graph: bool = False, recursive: bool = False) -> Callable:
    """Registers a query; `graph` puts nodes and edges before its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH {'RECURSIVE ' * recursive}{_GRAPH}{sql}" if graph else sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- scans, introspection and views


@query("SELECT label, count(*) AS n FROM nodes GROUP BY label", graph=True)
def graph_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.from_tables(spark, sf_dir).nodes.groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT rel, count(*) AS n FROM edges GROUP BY rel", graph=True)
def rel_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.from_tables(spark, sf_dir).edges.groupBy("rel").agg(F.count("*").alias("n"))


@query("SELECT label, count(*) AS n, count(owner) AS with_owner, count(raw_text) AS with_text, min(id) AS first_id FROM nodes GROUP BY label", graph=True)
def schema_introspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = G.from_tables(spark, sf_dir).nodes
    return nodes.groupBy("label").agg(F.count("*").alias("n"), F.count("owner").alias("with_owner"), F.count("raw_text").alias("with_text"), F.min("id").alias("first_id"))


_ROLE_SQL = "CASE WHEN label IN ('总体', '系统', '单机', '组件', '零部组件') THEN 'entity' WHEN label IN ('故障模式') THEN 'fault_mode' WHEN label IN ('属性值') THEN 'attribute_value' ELSE 'other' END"


@query(
    f"SELECT id, coalesce(nullif(name, ''), id) AS name, {_ROLE_SQL} AS role, coalesce(nullif(raw_text, ''), name, '') AS description, concat_ws('|', label, owner) AS tags, substr(name, 1, 12) AS short_name FROM nodes",
    graph=True,
)
def node_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = G.from_tables(spark, sf_dir).nodes
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    return nodes.select(
        "id", F.coalesce(blank("name"), "id").alias("name"), X.alias_group(F.col("label"), config.ROLES).alias("role"), F.coalesce(blank("raw_text"), "name", F.lit("")).alias("description"), F.concat_ws("|", "label", "owner").alias("tags"), F.substring("name", 1, 12).alias("short_name")
    )


@query(
    "SELECT src, dst, rel AS label, CASE rel WHEN 'INCLUDE' THEN 'hierarchy' WHEN 'HAS_FAILURE_MODE' THEN 'fault_link' WHEN 'LEADS_TO' THEN 'causal_link' WHEN 'HAS' THEN 'attribute_link' WHEN 'SIMILAR' THEN 'similarity' END AS relation_group, coalesce(CASE rel WHEN 'INCLUDE' THEN 0.65 WHEN 'HAS_FAILURE_MODE' THEN 1.0 WHEN 'LEADS_TO' THEN 0.95 WHEN 'HAS' THEN 0.85 END, 0)::DOUBLE AS weight FROM edges",
    graph=True,
)
def edge_view_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = G.from_tables(spark, sf_dir).edges.withColumn("label", X.canonical_relation(F.col("rel"), config.RELATION_ALIASES))
    edges = edges.withColumn("relation_group", X.alias_group(F.col("label"), config.RELATION_GROUPS))
    weight = F.lit(0.0)
    for group, value in config.GROUP_WEIGHTS.items():
        weight = F.when(F.col("relation_group") == group, value).otherwise(weight)
    return edges.select("src", "dst", "label", "relation_group", weight.alias("weight"))


@query("SELECT id, name FROM nodes WHERE NOT (owner IS NULL AND raw_text IS NULL AND (name = label OR label IN ('总体')))", graph=True)
def placeholder_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = G.from_tables(spark, sf_dir).nodes
    empty = F.col("owner").isNull() & F.col("raw_text").isNull() & ((F.col("name") == F.col("label")) | F.col("label").isin("总体"))
    return nodes.where(~empty).select("id", "name")


@query("SELECT count(*) AS n FROM nodes WHERE label IN ('总体', '系统', '单机')", graph=True)
def role_match_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = G.from_tables(spark, sf_dir).nodes
    return nodes.where(X.alias_group(F.col("label"), config.ROLES) == "entity").agg(F.count("*").alias("n"))


_LONGEST = "CASE WHEN p_type LIKE '%ANODIZED%' THEN 'a' WHEN p_type LIKE '%BURNISHED%' THEN 'b' WHEN p_type LIKE '%STEEL%' THEN 'c' WHEN p_type LIKE '%TIN%' THEN 'd' ELSE 'other' END"


@query(f"SELECT {_LONGEST} AS kind, count(*) AS n FROM (SELECT upper(p_type) AS p_type FROM part) GROUP BY 1")
def role_match_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    # aliases by falling length: BURNISHED, ANODIZED, STEEL, TIN; no type holds both of the long ones
    groups = {"a": ("ANODIZED",), "b": ("BURNISHED",), "c": ("STEEL",), "d": ("TIN",)}
    return _t(spark, sf_dir, "part").groupBy(X.alias_group(F.upper("p_type"), groups).alias("kind")).agg(F.count("*").alias("n"))


# --- joins and checks


@query("SELECT rel, count(*) AS n FROM edges WHERE src IN (SELECT id FROM nodes WHERE label <> '属性值') AND dst IN (SELECT id FROM nodes WHERE label <> '属性值') GROUP BY rel", graph=True)
def visible_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = G.from_tables(spark, sf_dir)
    return G.PropertyGraph(g.nodes.where("label <> '属性值'"), g.edges).visible().edges.groupBy("rel").agg(F.count("*").alias("n"))


@query("SELECT src, rel, dst, 'object' AS missing FROM edges WHERE dst NOT IN (SELECT id FROM nodes WHERE label <> '单机') UNION ALL SELECT src, rel, dst, 'subject' FROM edges WHERE src NOT IN (SELECT id FROM nodes WHERE label <> '单机')", graph=True)
def dangling_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = G.from_tables(spark, sf_dir)
    return triples.dangling(g.edges, g.nodes.where("label <> '单机'")).select("src", "rel", "dst", "missing")


@query("SELECT e.rel, s.label AS actual_subject, o.label AS actual_object, count(*) AS n FROM edges e JOIN nodes s ON s.id = e.src JOIN nodes o ON o.id = e.dst WHERE e.rel = 'INCLUDE' AND (s.label <> '系统' OR o.label <> '单机') GROUP BY ALL", graph=True)
def type_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = G.from_tables(spark, sf_dir)
    expected = spark.createDataFrame([("INCLUDE", "系统", "单机"), ("HAS", "", "属性值")], "rel string, subject_type string, object_type string")
    return triples.type_mismatches(g.edges, g.nodes, expected).groupBy("rel", "actual_subject", "actual_object").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triples.repeated_ids(_t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id")))


@query("SELECT DISTINCT id, other, rel FROM (SELECT src AS id, dst AS other, rel FROM edges UNION ALL SELECT dst, src, rel FROM edges) WHERE id IN (SELECT id FROM nodes WHERE label = '系统')", graph=True)
def direct_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = G.from_tables(spark, sf_dir)
    return G.direct_neighbours(g, g.nodes.where("label = '系统'"))


@query("SELECT src, dst, rank FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY rel, dst)::INT AS rank FROM edges) WHERE rank <= 20", graph=True)
def degree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = G.from_tables(spark, sf_dir)
    return G.capped(g.edges, "src", [F.col("rel"), F.col("dst")], config.MAX_EDGES_PER_NODE).select("src", "dst", "rank")


# --- graph

_BOTH = ", b AS (SELECT src AS id, dst AS other FROM edges UNION SELECT dst, src FROM edges)"


@query(
    _BOTH + ", c AS (SELECT id FROM nodes WHERE label = '总体'), one AS (SELECT DISTINCT c.id AS centre, b.other AS id FROM c JOIN b ON b.id = c.id), two AS (SELECT DISTINCT o.centre, b.other AS id FROM one o JOIN b ON b.id = o.id), u AS (SELECT id AS centre, id, 0 AS depth FROM c UNION ALL SELECT centre, id, 1 FROM one UNION ALL SELECT centre, id, 2 FROM two) SELECT centre, id, min(depth)::INT AS depth FROM u GROUP BY 1, 2",
    graph=True,
)
def two_hop_ego(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = G.from_tables(spark, sf_dir)
    return G.ego(g, g.nodes.where("label = '总体'").select("id"), 2)


_PATHS = """, p AS (SELECT 'p_' || p_partkey AS start, 'p_' || p_partkey AS fin, 0 AS hops, 'p_' || p_partkey AS path, ['p_' || p_partkey] AS seen FROM part
  UNION ALL SELECT p.start, e.dst, p.hops + 1, p.path || '>' || e.dst, list_append(p.seen, e.dst) FROM p JOIN edges e ON e.src = p.fin AND e.rel = 'LEADS_TO' WHERE p.hops < 3 AND NOT list_contains(p.seen, e.dst))"""


@query(_PATHS + ' SELECT start, fin AS "end", hops::INT AS hops, path FROM p WHERE hops > 0', graph=True, recursive=True)
def var_length_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = G.from_tables(spark, sf_dir)
    causal = g.edges.where("rel = 'LEADS_TO'")
    return G.paths(causal, causal.select(F.col("src").alias("id")), config.MAX_DEPTH)


@query(_PATHS + " SELECT start, arg_max(path, hops) AS path, max(hops)::INT AS hops FROM p WHERE hops > 0 GROUP BY start", graph=True, recursive=True)
def primary_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = G.from_tables(spark, sf_dir)
    causal = g.edges.where("rel = 'LEADS_TO'")
    return G.primary_path(G.paths(causal, causal.select(F.col("src").alias("id")), config.MAX_DEPTH))


@query("SELECT DISTINCT src AS id FROM edges WHERE rel = 'LEADS_TO' AND src NOT IN (SELECT dst FROM edges WHERE rel = 'LEADS_TO' AND src <> dst)", graph=True)
def causal_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = G.from_tables(spark, sf_dir)
    causal = g.edges.where("rel = 'LEADS_TO'")
    return G.roots(causal).join(causal.where("src = dst").select(F.col("src").alias("id")), "id", "left_anti").unionByName(
        causal.where("src = dst").select(F.col("src").alias("id")).join(causal.where("src <> dst").select(F.col("dst").alias("id")), "id", "left_anti")
    )


@query(
    _BOTH.replace("edges", "(SELECT * FROM edges WHERE rel = 'SIMILAR')") + ", w(node, reach) AS (SELECT id, id FROM b UNION SELECT w.node, b.other FROM w JOIN b ON b.id = w.reach) SELECT node, min(reach) AS component FROM w GROUP BY node",
    graph=True,
    recursive=True,
)
def components_min_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_components(G.from_tables(spark, sf_dir).edges.where("rel = 'SIMILAR'"))


@query("SELECT src, round(count(DISTINCT dst) / 6.0, 6)::DOUBLE AS completeness, round(avg(CASE rel WHEN 'INCLUDE' THEN 0.65 WHEN 'HAS_FAILURE_MODE' THEN 1.0 WHEN 'LEADS_TO' THEN 0.95 WHEN 'HAS' THEN 0.85 ELSE 0 END::DOUBLE), 6) AS mean_weight FROM edges GROUP BY src", graph=True)
def subgraph_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edge_view_canonical(spark, sf_dir)
    return rows.groupBy("src").agg(F.round(F.countDistinct("dst") / 6.0, 6).alias("completeness"), F.round(F.avg("weight"), 6).alias("mean_weight"))


# --- text

_COMPACT = r"regexp_replace(lower({0}), '[\s]+', '', 'g')"


@query(f"SELECT p_partkey, {_COMPACT.format('p_name')} AS norm FROM part")
def norm_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select("p_partkey", X.compact(F.col("p_name")).alias("norm"))


def _grams_sql(c: str) -> str:
    return f"(CASE WHEN length({c}) >= 2 THEN list_distinct(list_transform(range(1, length({c})), lambda i: substr({c}, i, 2))) WHEN length({c}) > 0 THEN [{c}] ELSE [] END)"


@query(f"SELECT p_partkey, len({_grams_sql('p_name')})::INT AS n FROM part")
def bigrams_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select("p_partkey", F.size(X.grams(F.col("p_name"))).alias("n"))


_Q = "green metal valve"


def _share_sql(q: str, n: str, of: str) -> str:
    return f"len(list_intersect({_grams_sql(q)}, {_grams_sql(n)})) / greatest(len({_grams_sql(of)}), 1)::DOUBLE"


@query(f"SELECT p_partkey, round(least(1.0, CASE WHEN contains(q, p_name) OR contains(p_name, q) THEN 1.0 ELSE {_share_sql('q', 'p_name', 'p_name')} END)::DOUBLE, 6) AS score FROM (SELECT p_partkey, lower(p_name) AS p_name, '{_Q}' AS q FROM part)")
def keyword_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select("p_partkey", F.round(X.keyword_score(F.lit(_Q), F.lower("p_name")), 6).alias("score"))


@query(
    f"SELECT p_partkey, round((CASE WHEN q = p THEN 1.0 WHEN least(length(q), length(p)) >= 2 AND (contains(q, p) OR contains(p, q)) THEN 0.55 + 0.45 * least(length(q), length(p))::DOUBLE / greatest(length(q), length(p)) ELSE {_share_sql('q', 'p', 'q')} END)::DOUBLE, 6) AS score FROM (SELECT p_partkey, lower(p_type) AS p, 'burnished tin' AS q FROM part)"
)
def coverage_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select("p_partkey", F.round(X.coverage(F.lit("burnished tin"), F.lower("p_type")), 6).alias("score"))


@query("SELECT a, b, round(len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))), 6) AS score FROM (SELECT p.p_partkey AS a, o.p_partkey AS b, list_distinct(string_split(p.p_name, '')) AS x, list_distinct(string_split(o.p_name, '')) AS y FROM part p JOIN part o ON o.p_partkey = p.p_partkey + 1)")
def char_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part").select("p_partkey", F.array_distinct(F.split("p_name", "")).alias("x"))
    other = part.select(F.col("p_partkey").alias("b"), F.col("x").alias("y"))
    return part.join(other, F.col("b") == F.col("p_partkey") + 1).select(F.col("p_partkey").alias("a"), "b", F.round(X.jaccard(F.col("x"), F.col("y")), 6).alias("score"))


def _replace_sql(c: str) -> str:
    for old, new in sorted(config.SYNONYMS.items(), key=lambda x: -len(x[0])):
        c = f"replace({c}, '{old}', '{new}')"
    return c


@query(f"SELECT p_partkey, {_replace_sql('t')} AS text FROM (SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 0 THEN '液氧阀门无法打开' WHEN 1 THEN '漏油' WHEN 2 THEN '阀门卡死' ELSE '' END AS t FROM part)")
def synonym_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_partkey") % 4
    t = F.concat("p_name", F.when(kind == 0, "液氧阀门无法打开").when(kind == 1, "漏油").when(kind == 2, "阀门卡死").otherwise(""))
    return _t(spark, sf_dir, "part").select("p_partkey", X.replaced(t, config.SYNONYMS).alias("text"))


@query("SELECT count(*) AS n, sum(CASE WHEN contains(text, 'the') AND NOT contains(text, 'from') THEN 1 WHEN contains(text, 'from') THEN -1 ELSE 0 END)::BIGINT AS total FROM documents")
def intent_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.when(F.col("text").contains("the") & ~F.col("text").contains("from"), 1).when(F.col("text").contains("from"), -1).otherwise(0)
    return _t(spark, sf_dir, "documents").agg(F.count("*").alias("n"), F.sum(score).alias("total"))


# --- ranking and vectors


@query(
    """WITH q AS (SELECT item_id, unnest(list_distinct(string_split(lower(text), ' '))) AS w FROM benchmark),
    d AS (SELECT doc_id, unnest(list_distinct(string_split(lower(text), ' '))) AS w FROM documents),
    s AS (SELECT item_id, doc_id, count(*) AS hits FROM q JOIN d USING (w) WHERE w <> '' GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id)::INT AS rank FROM s)
    SELECT item_id, rank, doc_id, hits FROM r WHERE rank <= 5"""
)
def query_top5_per_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall by shared words: each document meets the items of its words, hits are counted map-side first, five stay."""

    def postings(rows: DataFrame, key: str) -> DataFrame:
        return rows.select(key, F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("w")).where("w <> ''")

    d = postings(_t(spark, sf_dir, "documents"), "doc_id")
    q = postings(_t(spark, sf_dir, "benchmark"), "item_id")
    # a word's items are listed once, so a frequent word's documents are joined to one row and not to one for each item
    items = q.groupBy("w").agg(F.collect_list("item_id").alias("items"))
    hits = d.join(items, "w").select("doc_id", F.explode("items").alias("item_id")).groupBy("item_id", "doc_id").agg(F.count("*").alias("hits"))
    return G.capped(hits, "item_id", [F.desc("hits"), F.col("doc_id")], 5).select("item_id", "rank", "doc_id", "hits")


@query(
    """WITH c AS (SELECT label, vec_id, embedding AS e FROM embeddings), q AS (SELECT * FROM c WHERE vec_id % 20 = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[]) / sqrt(list_dot_product(q.e::DOUBLE[], q.e::DOUBLE[])) / sqrt(list_dot_product(c.e::DOUBLE[], c.e::DOUBLE[])), 6) AS score FROM q JOIN c ON q.label = c.label AND q.vec_id <> c.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 4"""
)
def block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top four by cosine within a block, for every row whose id is divisible by 20."""
    e = _t(spark, sf_dir, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return best_cosines(e, e.where("vec_id % 20 = 0"), 4)


@query("SELECT label, i::INT AS pos, round(avg(x), 5) AS mean FROM (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY 1, 2")
def mean_neighbor_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    return rows.groupBy("label", (F.col("pos") + 1).alias("pos")).agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"))


# --- triples, changes, versions


@query("SELECT p_partkey, 'E_' || substr(sha1(p_type || chr(10) || p_name), 1, 16) AS id FROM part")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select("p_partkey", X.stable_id("E", F.col("p_type"), F.col("p_name")).alias("id"))


@query("SELECT p_brand, string_agg(p_type, ' / ' ORDER BY o) AS value FROM (SELECT p_brand, p_type, min(p_partkey) AS o FROM part GROUP BY 1, 2) GROUP BY p_brand")
def attr_groups_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triples.joined_attributes(_t(spark, sf_dir, "part"), ["p_brand"], F.col("p_type"), F.col("p_partkey"))


@query(
    "WITH t AS (SELECT p_brand AS s, p_type AS o FROM part), e AS (SELECT 'E_' || substr(sha1('brand' || chr(10) || s), 1, 16) AS a, 'E_' || substr(sha1('type' || chr(10) || o), 1, 16) AS b, 'R_' || substr(sha1('has' || chr(10) || 'brand' || chr(10) || 'type'), 1, 16) AS r FROM t) SELECT DISTINCT 'T_' || substr(sha1(a || chr(10) || r || chr(10) || b), 1, 16) AS id, a AS subject_id, r AS predicate_id, b AS object_id FROM e"
)
def triples_from_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("subject"), F.lit("brand").alias("subject_type"), F.lit("has").alias("predicate"), F.col("p_type").alias("object"), F.lit("type").alias("object_type"))
    return triples.canonical(rows)[2]


def _state(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    old = c.where("id % 3 <> 0")
    return old, c.where("id % 2 = 0").select("id", F.upper("name").alias("name"), F.concat("segment", F.lit("!")).alias("segment"))


_STATE = "WITH c AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer), o AS (SELECT * FROM c WHERE id % 3 <> 0), n AS (SELECT id, upper(name) AS name, segment || '!' AS segment FROM c WHERE id % 2 = 0)"


@query(_STATE + " SELECT coalesce(n.id, o.id) AS id, coalesce(n.name, o.name) AS name, coalesce(n.segment, o.segment) AS segment FROM o FULL JOIN n ON o.id = n.id")
def upsert_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.upsert(*_state(spark, sf_dir), "id")


@query(_STATE + " SELECT n.id, o.id IS NULL AS created, o.name AS before_name, n.name AS after_name FROM n LEFT JOIN o ON o.id = n.id")
def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.change_log(*_state(spark, sf_dir), "id").select("id", "created", F.col("before.name").alias("before_name"), F.col("after.name").alias("after_name"))


@query(_STATE + " SELECT id, name, segment FROM o")
def rollback_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _state(spark, sf_dir)
    return changes.rollback(changes.upsert(old, new, "id"), changes.change_log(old, new, "id"), "id")


@query("SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INT AS rank FROM events) WHERE rank <= 10")
def version_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.newest(_t(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "rank")


@query("SELECT event_type, count(*) AS n, sum((props->>'k')::BIGINT)::BIGINT AS total FROM events GROUP BY 1")
def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k bigint")["k"])
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


# --- linking


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b, round(1 - abs(a.s_acctbal - b.s_acctbal) / 20000, 6) AS score FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey WHERE 1 - abs(a.s_acctbal - b.s_acctbal) / 20000 >= 0.9")
def pair_scores_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs within a block whose score passes the rule."""
    rows = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), "s_nationkey", "s_acctbal")
    # a score of 0.9 is a distance of 2000; the cent keeps rounding inside the band
    pairs = linking.banded_pairs(rows, "s_nationkey", "s_acctbal", 2000.01)
    score = 1 - F.abs(F.col("left_value") - F.col("right_value")) / 20000
    return pairs.withColumn("s", score).where("s >= 0.9").select(F.col("left").alias("a"), F.col("right").alias("b"), F.round("s", 6).alias("score"))


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey WHERE 1 - abs(a.s_acctbal - b.s_acctbal) / 20000 >= 0.9 AND floor(a.s_acctbal / 1000) <> floor(b.s_acctbal / 1000)")
def similar_edges_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passing pairs that the graph doesn't link yet, in either direction."""
    known = G.from_tables(spark, sf_dir).edges.where("rel = 'SIMILAR'").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))
    pairs = pair_scores_rules(spark, sf_dir).select("a", "b", F.concat(F.lit("s_"), "a").alias("s"), F.concat(F.lit("s_"), "b").alias("t"))
    pairs = pairs.withColumns({"u": F.least("s", "t"), "v": F.greatest("s", "t")})
    return pairs.join(known, ["u", "v"], "left_anti").select("a", "b")


# --- reports


@query("SELECT r_name AS region, n_name AS nation, c_mktsegment AS segment, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment)")
def hierarchy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "customer").join(_t(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(_t(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return rows.rollup(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))


@query("SELECT src AS parent, count(*) AS n, string_agg(dst, ',' ORDER BY dst) AS children FROM edges WHERE rel = 'INCLUDE' GROUP BY src", graph=True)
def tree_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = G.from_tables(spark, sf_dir).edges.where("rel = 'INCLUDE'")
    return edges.groupBy(F.col("src").alias("parent")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("dst")), ",").alias("children"))


@query(r"SELECT doc_id, count(*) AS n, max(length(p)) AS longest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p FROM documents) WHERE length(p) >= 8 GROUP BY 1")
def para_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("p")).where(F.length("p") >= 8)
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("p")).cast("long").alias("longest"))


@query("SELECT doc_id, rank, hits FROM (SELECT doc_id, hits, n, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, n)::INT AS rank FROM (SELECT doc_id, n, (length(p) - length(replace(p, 'the', '')))::BIGINT // 3 AS hits FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, unnest(range(0, len(string_split(text, chr(10))))) AS n FROM documents)) WHERE hits > 0) WHERE rank <= 6")
def keyword_para_top6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "p"))
    hits = F.floor((F.length("p") - F.length(F.replace("p", F.lit("the"), F.lit("")))) / 3)
    return G.capped(rows.withColumn("hits", hits).where("hits > 0"), "doc_id", [F.desc("hits"), F.col("n")], 6).select("doc_id", "rank", "hits")


@query(r"SELECT doc_id, count(*) AS n, min(v) AS first_value FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+\.[0-9]+')) AS v FROM documents) GROUP BY 1")
def spec_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[0-9]+\.[0-9]+"), F.lit(0))).alias("v"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("v").alias("first_value"))


@query("SELECT id AS node, dst AS effect, name AS fault_mode, owner, coalesce(nullif(raw_text, ''), '未标注') AS cause FROM nodes JOIN edges ON src = id AND rel = 'LEADS_TO'", graph=True)
def fmea_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = G.from_tables(spark, sf_dir)
    rows = g.nodes.join(g.edges.where("rel = 'LEADS_TO'"), F.col("src") == F.col("id"))
    cause = F.coalesce(F.when(F.col("raw_text") != "", F.col("raw_text")), F.lit("未标注"))
    return rows.select(F.col("id").alias("node"), F.col("dst").alias("effect"), F.col("name").alias("fault_mode"), "owner", cause.alias("cause"))


@query()
def seq_ratio_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_name")
    other = part.select(F.col("p_partkey").alias("b"), F.col("p_name").alias("o"))
    return part.join(other, F.col("b") == F.col("p_partkey") + 1).select(F.col("p_partkey").alias("a"), "b", seq_ratio("p_name", "o").alias("ratio"))


@query()
def prefixed_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws("", F.col("p_brand"), F.lit("："), F.col("p_name"), F.lit("；(a：b)"), F.col("p_type"))
    return _t(spark, sf_dir, "part").select("p_partkey", F.explode(split_prefixed(text)).alias("x")).select("p_partkey", "x.owner", "x.mode")


from quillgraph.plans import answers, catalog, causal, loads, profiles, recall  # noqa: E402, F401  they register their queries
