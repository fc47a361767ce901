"""Queries of sheet loading, mapping rules, merged groups and versions over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.graph import analysis as A
from quillgraph.graph import property_graph as G
from quillgraph.operators import sheet_load
from quillgraph.operators.versions import VersionedGraph
from quillgraph.plans.catalog import _GROUPS
from quillgraph.queries import _t, query
from quillgraph.session import shared_folder

#: Parts as rows of a failure-mode sheet.
_SHEET = """
s AS (SELECT p_partkey AS o, p_brand AS machine, p_type AS function, split_part(p_name, ' ', 1) AS component, 'S' || p_size % 7 AS system, p_name AS unit_mode, split_part(p_name, ' ', 2) AS component_mode,
        'F' || p_size % 5 AS system_mode, 'O' || p_size % 3 AS overall, CASE WHEN p_size % 2 = 0 THEN '是' ELSE '否' END AS single, 'L' || p_size % 4 AS severity FROM part),
k AS (SELECT *, 'unit::' || machine || '::' || unit_mode AS unit_key, 'component::' || component || '::' || component_mode AS component_key, 'system::' || system || '::' || system_mode AS system_key FROM s)"""


def _sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = lambda n: F.coalesce(F.get(F.split("p_name", " "), F.lit(n)), F.lit(""))
    of = lambda mark, n: F.concat(F.lit(mark), (F.col("p_size") % n).cast("string"))
    rows = _t(spark, sf_dir, "part").withColumns({"machine_name": F.col("p_brand"), "function_name": F.col("p_type"), "component_name": word(0), "system_name": of("S", 7), "unit_failure_mode": F.col("p_name")})
    rows = rows.withColumns({"component_failure_mode": word(1), "system_failure_mode": of("F", 5), "overall_failure_mode": of("O", 3), "component_reason_raw": F.col("p_name"), "system_effect_raw": F.col("p_type")})
    rows = rows.withColumns({"is_single_point": F.when(F.col("p_size") % 2 == 0, "是").otherwise("否"), "severity_level": of("L", 4), "probability_level": F.lit("P"), "mission_phase": F.lit(""), "design_measure": F.lit(None).cast("string")})
    key = lambda *parts: F.concat_ws("::", *parts)
    rows = rows.withColumns({"unit_failure_key": key(F.lit("unit"), "p_brand", "p_name"), "component_failure_key": key(F.lit("component"), "component_name", "component_failure_mode"), "system_failure_key": key(F.lit("system"), "system_name", "system_failure_mode")})
    rows = rows.withColumns({"overall_failure_key": key(F.lit("overall"), "overall_failure_mode"), "single_point_key": key(F.lit("single"), "is_single_point"), "severity_key": key(F.lit("severity"), "severity_level"), "probability_key": F.lit("probability::P"), "phase_key": F.lit("phase::未标注"), "measure_key": F.lit(None).cast("string")})
    extra = F.create_map(F.lit("price"), F.floor("p_retailprice").cast("string"), F.lit("size"), F.when(F.col("p_size") > 9, F.col("p_size").cast("string")))
    return rows.withColumn("extra", extra).withColumn("row_order", F.col("p_partkey"))


@query(
    f"""WITH {_SHEET},
    n AS (SELECT o, '单机' AS label, machine AS key, machine AS name, NULL AS owner FROM k UNION ALL SELECT o, '功能', function, function, NULL FROM k
      UNION ALL SELECT o, '组件', component, component, NULL FROM k UNION ALL SELECT o, '系统', system, system, NULL FROM k
      UNION ALL SELECT o, '单机级故障模式', unit_key, unit_mode, machine FROM k UNION ALL SELECT o, '组件级故障模式', component_key, component_mode, component FROM k
      UNION ALL SELECT o, '系统级故障模式', system_key, system_mode, system FROM k UNION ALL SELECT o, '总体级故障模式', 'overall::' || overall, overall, NULL FROM k
      UNION ALL SELECT o, '是否单点', 'single::' || single, single, NULL FROM k UNION ALL SELECT o, '严酷度等级', 'severity::' || severity, severity, NULL FROM k
      UNION ALL SELECT o, '发生概率', 'probability::P', 'P', NULL FROM k UNION ALL SELECT o, '发生阶段', 'phase::未标注', '', NULL FROM k)
    SELECT label, key, arg_min(name, o) AS name, arg_min(coalesce(owner, '-'), o) AS owner FROM n WHERE key <> '' GROUP BY 1, 2"""
)
def sheet_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheet_load.loaded(_sheet(spark, sf_dir)).nodes.select("label", "key", "name", F.coalesce("owner", F.lit("-")).alias("owner"))


@query(
    f"""WITH {_SHEET},
    e AS (SELECT machine AS src, '具有功能' AS rel, function AS dst FROM k UNION SELECT machine, '具有故障模式', unit_key FROM k UNION SELECT component, '具有故障模式', component_key FROM k UNION SELECT component_key, '导致', unit_key FROM k
      UNION SELECT system, '具有故障模式', system_key FROM k UNION SELECT unit_key, '导致', system_key FROM k UNION SELECT system_key, '导致', 'overall::' || overall FROM k UNION SELECT unit_key, '是否单点', 'single::' || single FROM k
      UNION SELECT unit_key, '严酷度等级', 'severity::' || severity FROM k UNION SELECT unit_key, '发生概率', 'probability::P' FROM k UNION SELECT unit_key, '发生阶段', 'phase::未标注' FROM k)
    SELECT * FROM e WHERE src <> '' AND dst <> ''"""
)
def sheet_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheet_load.loaded(_sheet(spark, sf_dir)).edges.select("src", "rel", "dst")


_RULES = (
    {"column": "price", "mode": "property", "target": "单机级故障模式", "property": "price"},
    {"column": "size", "mode": "property", "target": "machine", "property": "size"},
    {"column": "size", "mode": "node", "label": "尺寸", "key_prefix": "size", "connect_from": "machine", "relation": "有"},
    {"column": "size", "mode": "relationship", "source": "machine", "target": "system", "relation": "DELIVERS", "relationship_property": "size", "when": "equals", "equals": "20"},
)


def _ruled(spark: SparkSession, sf_dir: str) -> sheet_load.Loaded:
    rows = _sheet(spark, sf_dir)
    rules = [sheet_load.rule_of(dict(r), n, ["price", "size"]) for n, r in enumerate(_RULES, 1)]
    return sheet_load.mapped(rows, sheet_load.loaded(rows), rules)


@query(
    f"""WITH {_SHEET}, c AS (SELECT k.*, floor(p_retailprice)::BIGINT::VARCHAR AS price, CASE WHEN p_size > 9 THEN p_size::VARCHAR END AS size FROM k JOIN part ON p_partkey = o)
    SELECT '单机级故障模式' AS label, unit_key AS key, 'price' AS property, arg_max(price, o) AS value FROM c GROUP BY 2
    UNION ALL SELECT '单机', machine, 'size', arg_max(size, o) FROM c WHERE size IS NOT NULL GROUP BY 2
    UNION ALL SELECT DISTINCT '尺寸', 'size::' || size, 'name', size FROM c WHERE size IS NOT NULL
    UNION ALL SELECT DISTINCT '有', machine || '>size::' || size, '', '' FROM c WHERE size IS NOT NULL
    UNION ALL SELECT DISTINCT 'DELIVERS', machine || '>' || system, 'size', '20' FROM c WHERE size = '20'"""
)
def sheet_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What four mapping rules make of two further columns: properties, nodes and edges."""
    graph = _ruled(spark, sf_dir)
    props = graph.nodes.select("label", "key", F.explode("properties").alias("property", "value"))
    named = graph.nodes.where("label = '尺寸'").select("label", "key", F.lit("name").alias("property"), F.col("name").alias("value"))
    drawn = graph.edges.where("rel in ('有', 'DELIVERS')").select(F.col("rel").alias("label"), F.concat_ws(">", "src", "dst").alias("key"), F.explode_outer("properties").alias("property", "value"))
    drawn = drawn.withColumns({c: F.coalesce(c, F.lit("")) for c in ("property", "value")})
    return props.unionByName(named).unionByName(drawn)


@query(
    _GROUPS + """, m AS (SELECT g.representative AS id, n.id AS member, n.name, n.owner, n.id <> g.representative AS other FROM groups g JOIN nodes n ON n.id = g.id)
    SELECT id, min(CASE WHEN NOT other THEN name END) AS name, coalesce(string_agg(CASE WHEN other THEN name END, '|' ORDER BY member), '') AS aliases,
      arg_min(owner, (other, member)) AS owner, count(*) AS members FROM m GROUP BY id""",
    graph=True,
    recursive=True,
)
def merged_group_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that similar edges join, each group as one node."""
    g = G.from_tables(spark, sf_dir)
    own = g.nodes.where("label = '单机'")
    groups = A.merged_groups(own.withColumn("stage", F.lit(1)), g.edges.where("rel = 'SIMILAR'"), "stage", "name")
    none = F.array().cast("array<string>")
    nodes = own.select("id", "name", F.col("label").alias("type"), F.lit("").alias("description"), none.alias("aliases"), F.create_map(F.lit("owner"), "owner").alias("attributes"), none.alias("sources"))
    return A.merged_nodes(nodes, groups).select("id", "name", F.array_join("aliases", "|").alias("aliases"), F.element_at("attributes", "owner").alias("owner"), "members")


@query(
    """SELECT 's_' || s_suppkey AS id, s_name AS name, 'n_' || s_nationkey AS nation FROM supplier UNION ALL SELECT 'n_' || n_nationkey, n_name, NULL FROM nation"""
)
def undone_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and nations are written; a second write renames all suppliers, moves their edges and adds customers; it is undone."""
    graph = VersionedGraph(spark, shared_folder(spark, "versions"))
    ident = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    label = lambda name: F.array(F.lit(name)).alias("labels")
    named = lambda c: F.create_map(F.lit("name"), c).alias("properties")
    order = F.lit(0).alias("ordinal")
    supplier, nation, customer = (_t(spark, sf_dir, name) for name in ("supplier", "nation", "customer"))
    nations = nation.select(ident("n_", "n_nationkey").alias("id"), label("系统"), named(F.col("n_name")), order)
    suppliers = supplier.select(ident("s_", "s_suppkey").alias("id"), label("单机"), named(F.col("s_name")), order)
    bare = F.create_map().cast("map<string,string>").alias("properties")
    edges = supplier.select(ident("n_", "s_nationkey").alias("src"), F.lit("INCLUDE").alias("rel"), ident("s_", "s_suppkey").alias("dst"), bare, order)
    graph.write(nations.unionByName(suppliers), edges)
    renamed = supplier.select(ident("s_", "s_suppkey").alias("id"), label("组件"), named(F.upper("s_name")), order)
    added = customer.select(ident("c_", "c_custkey").alias("id"), label("属性值"), named(F.col("c_name")), order)
    more = customer.select(ident("n_", "c_nationkey").alias("src"), F.lit("HAS").alias("rel"), ident("c_", "c_custkey").alias("dst"), bare, order)
    marked = edges.withColumn("properties", F.create_map(F.lit("mark"), F.col("dst")))
    graph.write(renamed.unionByName(added), more.unionByName(marked), marked.withColumn("rel", F.lit("SIMILAR")))
    graph.undo()
    left = graph.edges().select(F.col("dst").alias("id"), F.col("src").alias("nation"))
    return graph.nodes().join(left, "id", "left").select("id", F.element_at("properties", "name").alias("name"), "nation")
