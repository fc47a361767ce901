"""Queries of node texts, profiles, anchors, ranks and edge checks, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph import config
from quillgraph.functions import text as X
from quillgraph.functions.udfs import text_similarity
from quillgraph.graph import analysis as A
from quillgraph.graph import property_graph as G
from quillgraph.operators import changes, properties, ranking, triples
from quillgraph.queries import _ROLE_SQL, _t, query

# --- nodes and what is around them


@query(", b AS (SELECT src AS id, dst AS other, rel FROM edges UNION ALL SELECT dst, src, rel FROM edges) SELECT b.id, string_agg(DISTINCT n.label, '|' ORDER BY n.label) AS types, string_agg(DISTINCT b.rel, '|' ORDER BY b.rel) AS rels FROM b JOIN nodes n ON n.id = b.other GROUP BY b.id", graph=True)
def neighbor_type_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = G.from_tables(spark, sf_dir)
    joined = lambda c: F.array_join(F.array_sort(c), "|").alias(c)
    return A.neighbour_sets(g.edges, g.nodes).select("id", joined("types"), joined("rels"))


@query(
    """, b AS (SELECT e.src AS id, e.rel, e.dst AS other, e.rel || '->' || n.label || ':' || n.name AS part, 0 AS back FROM edges e JOIN nodes n ON n.id = e.dst
      UNION ALL SELECT e.dst, e.rel, e.src, e.rel || '<-' || n.label || ':' || n.name, 1 FROM edges e JOIN nodes n ON n.id = e.src),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rel, other, back) AS k FROM b),
    c AS (SELECT id, string_agg(part, '；' ORDER BY k) AS parts FROM r WHERE k <= 8 GROUP BY id)
    SELECT nodes.id, concat_ws('。', '名称:' || name, '类型:' || label, '描述:' || nullif(raw_text, ''), '属性:owner:' || nullif(owner, ''), '邻域:' || parts) AS text FROM nodes LEFT JOIN c ON c.id = nodes.id""",
    graph=True,
)
def node_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = G.from_tables(spark, sf_dir)
    return A.node_texts(g.nodes, g.edges, ("owner",))


@query("SELECT label, count(*) AS n, concat_ws(',', CASE WHEN count(owner) > 0 THEN 'owner' END, CASE WHEN count(raw_text) > 0 THEN 'raw_text' END) AS keys FROM nodes GROUP BY label", graph=True)
def type_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.map_filter(F.create_map(F.lit("owner"), "owner", F.lit("raw_text"), "raw_text"), lambda k, v: v.isNotNull())
    return A.type_profiles(G.from_tables(spark, sf_dir).nodes, props).select("label", "n", F.array_join("keys", ",").alias("keys"))


_EXPECTED = ("entity", "fault_mode", "attribute_value", "measure", "function", "phenomenon")


@query(f", r AS (SELECT id, {_ROLE_SQL} AS role FROM nodes) SELECT e.src AS id, round(count(DISTINCT CASE WHEN r.role <> 'other' THEN r.role END) / 6.0, 6)::DOUBLE AS completeness FROM edges e JOIN r ON r.id = e.dst GROUP BY 1", graph=True)
def role_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = G.from_tables(spark, sf_dir)
    roles = g.nodes.select("id", X.alias_group(F.col("label"), config.ROLES).alias("role"))
    return A.role_completeness(g.edges, roles, _EXPECTED).select("id", F.round("completeness", 6).alias("completeness"))


_SHARE = "CASE WHEN {q} = '' OR {t} = '' THEN 0 WHEN contains({t}, {q}) THEN 1 ELSE len(list_intersect(list_distinct(string_split({q}, '')), list_distinct(string_split({t}, ''))))::DOUBLE / len(list_distinct(string_split({q}, ''))) END"


@query(
    f""", s AS (SELECT * FROM nodes WHERE label IN ('单机', '故障模式')), f AS (SELECT * FROM nodes WHERE label = '故障模式'),
    n AS (SELECT src AS a, dst AS b FROM edges WHERE rel IN ('HAS_FAILURE_MODE', 'LEADS_TO') UNION SELECT dst, src FROM edges WHERE rel IN ('HAS_FAILURE_MODE', 'LEADS_TO')),
    p AS (SELECT id AS start, id AS anchor FROM f UNION SELECT s.id, f.id FROM s JOIN n ON n.a = s.id JOIN f ON f.id = n.b WHERE s.label = '单机'),
    k AS (SELECT p.start, p.anchor, f.name, {_SHARE.format(q="lower(s.name)", t="lower(f.name)")} AS score FROM p JOIN s ON s.id = p.start JOIN f ON f.id = p.anchor)
    SELECT start, arg_min(anchor, (-score, name, anchor)) AS anchor FROM k GROUP BY start""",
    graph=True,
)
def primary_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The failure mode at which each machine's and each failure mode's causal chain begins."""
    g = G.from_tables(spark, sf_dir)
    faults, starts = g.nodes.where("label = '故障模式'"), g.nodes.where("label in ('单机', '故障模式')")
    found = A.fault_anchors(g.edges.where("rel in ('HAS_FAILURE_MODE', 'LEADS_TO')"), faults, starts)
    found = found.join(starts.select(F.col("id").alias("start"), F.col("name").alias("q"), X.stage_rank(F.col("label")).alias("start_rank")), "start")
    found = found.join(faults.select(F.col("id").alias("anchor"), "name", X.stage_rank(F.col("label")).alias("rank")), "anchor")
    return A.primary_anchor(found.withColumns({"keyword": X.character_score(F.col("q"), F.col("name")), "subject": F.lit(0.0)}))


@query("SELECT id, name FROM nodes WHERE id IN ('r_0', 'n_3', 'p_1', 'none')", graph=True)
def node_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.from_tables(spark, sf_dir).nodes.where(F.col("id").isin("r_0", "n_3", "p_1", "none")).select("id", "name")


@query("SELECT rel, count(*) AS n FROM edges WHERE src IN (SELECT id FROM nodes WHERE label = '系统') OR dst IN (SELECT id FROM nodes WHERE label = '系统') GROUP BY rel", graph=True)
def touching_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = G.from_tables(spark, sf_dir)
    return G.touching(g.edges, g.nodes.where("label = '系统'")).groupBy("rel").agg(F.count("*").alias("n"))


@query("SELECT id, CASE label WHEN '总体' THEN 10 WHEN '系统' THEN 30 WHEN '单机' THEN 50 ELSE 96 END::DOUBLE AS x, (list_sum(list_transform(string_split(label || ':' || name, ''), lambda c: unicode(c))) % 84 + 8)::DOUBLE AS y FROM nodes", graph=True)
def layout_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = G.from_tables(spark, sf_dir).nodes
    return nodes.select("id", X.layout_place(F.col("label"), F.col("name"), {"总体": 10, "系统": 30, "单机": 50}).alias("p")).select("id", "p.x", "p.y")


@query("SELECT CASE label WHEN '单机' THEN 1 WHEN '系统' THEN 2 WHEN '总体' THEN 3 ELSE 99 END::INT AS rank, count(*) AS n FROM nodes GROUP BY 1", graph=True)
def stage_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.from_tables(spark, sf_dir).nodes.groupBy(X.stage_rank(F.col("label")).alias("rank")).agg(F.count("*").alias("n"))


# --- edges


@query(
    ", p AS (SELECT 'p_' || p_partkey AS id FROM part), w AS (SELECT src, 'INCLUDE' AS rel, dst FROM edges WHERE rel = 'LEADS_TO' UNION SELECT src, rel, dst FROM edges WHERE rel <> 'SIMILAR') SELECT src, rel, dst FROM w EXCEPT SELECT src, 'INCLUDE', dst FROM edges WHERE rel = 'LEADS_TO' UNION SELECT 'root', 'HAS', id FROM p UNION SELECT 'r_0', 'INCLUDE', 'n_0'",
    graph=True,
)
def sanitised_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Includes beside a causal edge go, and edges that every part and the root must have are added."""
    edges = G.from_tables(spark, sf_dir).edges.where("rel <> 'SIMILAR'")
    doubled = edges.unionByName(edges.where("rel = 'LEADS_TO'").withColumn("rel", F.lit("INCLUDE")))
    must = _t(spark, sf_dir, "part").select(F.lit("root").alias("src"), F.lit("HAS").alias("rel"), F.concat(F.lit("p_"), F.col("p_partkey").cast("string")).alias("dst"))
    must = must.unionByName(spark.sql("select 'r_0' as src, 'INCLUDE' as rel, 'n_0' as dst"))
    return triples.sanitised(doubled, "INCLUDE", "LEADS_TO", must)


@query("SELECT p_brand, p_name FROM part EXCEPT SELECT p_brand, p_name FROM part WHERE p_size <= 10")
def absent_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that no small part of a brand has."""
    part = _t(spark, sf_dir, "part").select("p_brand", "p_name", "p_size")
    return triples.absent(part.select("p_brand", "p_name"), part.where("p_size <= 10"), ["p_brand", "p_name"])


@query("SELECT l_returnflag || l_linestatus AS rel, count(*) AS n FROM lineitem GROUP BY 1")
def batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relation counts of each ship mode's batch, added up."""
    rows = _t(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("rel"), (F.col("l_orderkey") % 7).alias("batch"), F.col("l_partkey").alias("name"), F.lit("part").alias("type"))
    return triples.merged_batches(rows, rows.groupBy("batch", "rel").agg(F.count("*").alias("n")))[1]


@query("SELECT o_custkey AS k, arg_max(o_orderstatus, o_orderkey) AS status, max(o_orderkey) AS at FROM orders GROUP BY 1")
def last_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("at"))
    return changes.last_rows(rows, "k", "at")


# --- texts and properties


@query(r"SELECT p_partkey, len(v)::INT AS n, v[1] AS first, array_to_string(list_sort(list_distinct(v)), '|') AS sorted FROM (SELECT p_partkey, list_filter(list_transform(string_split_regex(p_brand || ' / ' || p_type || '；' || p_name || ', ', '\s*/\s*|[；;，,、]\s*'), lambda x: trim(x)), lambda x: x <> '') AS v FROM part)")
def property_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = X.property_values(F.concat("p_brand", F.lit(" / "), "p_type", F.lit("；"), "p_name", F.lit(", ")))
    rows = _t(spark, sf_dir, "part").select("p_partkey", v.alias("v"))
    return rows.select("p_partkey", F.size("v").alias("n"), F.col("v")[0].alias("first"), F.array_join(F.array_sort("v"), "|").alias("sorted"))


@query(f"SELECT p_partkey, round({_SHARE.format(q='q', t='t')}, 6)::DOUBLE AS score FROM (SELECT p_partkey, 'polished tin' AS q, lower(trim(p_type)) AS t FROM part)")
def character_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select("p_partkey", F.round(X.character_score(F.lit(" Polished TIN"), F.col("p_type")), 6).alias("score"))


@query("SELECT p_partkey FROM part WHERE regexp_replace(lower(p_brand), '\\s+', '', 'g') IN ('brand#13', 'brand#21')")
def exact_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.array(F.lit("brand # 13"), F.lit("BRAND#21 "), F.lit(" "))
    return _t(spark, sf_dir, "part").where(X.exactly_matches(asked, F.array("p_brand", "p_name"))).select("p_partkey")


@query("SELECT p_partkey, property, value FROM (SELECT p_partkey, 'a' AS property, p_brand || CASE WHEN p_size % 2 = 0 THEN ' / ' || p_type ELSE '' END AS value FROM part UNION ALL SELECT p_partkey, 'b', p_name FROM part WHERE p_size % 3 = 0) WHERE value <> ''")
def attribute_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.array("p_brand", F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.lit(" ")), "p_brand")
    b = F.when(F.col("p_size") % 3 == 0, F.array("p_name")).otherwise(F.array().cast("array<string>"))
    return properties.attribute_nodes(_t(spark, sf_dir, "part").select("p_partkey", a.alias("a"), b.alias("b")), "p_partkey", ["a", "b"])


@query()
def text_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of each part's name and the next one's."""
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_name")
    other = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("o"))
    return part.join(other, "p_partkey").select("p_partkey", text_similarity(F.col("p_name"), F.col("o")).alias("score"))


# --- ranks


@query(
    """WITH c AS (SELECT p_brand AS q, p_partkey AS id, p_name AS name, p_size % 3 = 0 AND p_size / 50.0 >= 0.75 AS x, p_size / 50.0 AS s, (p_partkey % 10) / 10.0 AS r FROM part)
    SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY x DESC, CASE WHEN x THEN -s END, CASE WHEN x THEN -r END, CASE WHEN x THEN length(name) END, CASE WHEN x THEN name END, id)::INT AS rank FROM c"""
)
def entity_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "part").select(
        F.col("p_brand").alias("q"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 3 == 0, "entity").otherwise("other").alias("role"), (F.col("p_size") / 50.0).alias("subject"), (F.col("p_partkey") % 10 / 10.0).alias("recall")
    )
    return ranking.promoted(rows, "q", "id").select("q", "id", "rank")


@query(
    """WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, list_reverse(embedding::DOUBLE[]) AS g, label FROM embeddings), m AS (SELECT v FROM e ORDER BY id LIMIT 1),
    s AS (SELECT id, g, label, list_cosine_similarity(e.v, m.v) AS t FROM e, m), seeds AS (SELECT g FROM s ORDER BY t DESC, id LIMIT 10),
    b AS (SELECT s.id, max(list_cosine_similarity(s.g, seeds.g)) AS best FROM s, seeds GROUP BY 1),
    f AS (SELECT s.id, round(0.65 * t + 0.2 * best + 0.15 * CASE WHEN label = 3 THEN 1 ELSE 0 END, 4) AS score FROM s JOIN b ON b.id = s.id)
    SELECT id, score, row_number() OVER (ORDER BY score DESC, id)::INT AS rank FROM f ORDER BY score DESC, id LIMIT 10"""
)
def hybrid_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows for the first vector, by text, graph and keyword scores."""
    e = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("text_vector"), F.reverse("embedding").alias("graph_vector"), "label")
    first = e.orderBy("id").select("text_vector").first()
    if first is None:
        return spark.createDataFrame([], "id long, score double, rank int")
    return ranking.hybrid_rank(e, first.text_vector, (F.col("label") == 3).cast("double"))
