"""Loading failure-mode rows as a graph, and mapping further columns by rules that are data.

`loaded` makes thirteen kinds of nodes and twelve of edges out of each row in one pass: a row is exploded to its nodes
and edges, and one aggregation each keeps a node's first row and an edge once, combined before the shuffle, so values that
most rows share cost nothing. `mapped` joins the rows' other cells with the table of rules by column name; all rules of one
kind go through one plan, however many they are.

Rows have the fields of NODES, a `row_order` and `extra`, a map of the other columns. Defined cases: white space around
texts is none; null is empty; a node whose key field is null or, for names, blank makes no node, and an edge needs both ends;
of rows with one key the first by row_order names a node; rules apply in their order, so of several values for one property
the last rule wins, and within a rule the last row; nodes that are to get a property or an edge must exist; an unknown
column or a rule that lacks something is a ValueError. Fixed values: labels, relations, aliases, the unset mark.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.fmea import UNSET

#: alias -> label, key field, name field, owner field, raw text field
NODES = {
    "machine": ("单机", "machine_name", "machine_name", None, None),
    "function": ("功能", "function_name", "function_name", None, None),
    "component": ("组件", "component_name", "component_name", None, None),
    "system": ("系统", "system_name", "system_name", None, None),
    "unit_failure_mode": ("单机级故障模式", "unit_failure_key", "unit_failure_mode", "machine_name", None),
    "component_failure_mode": ("组件级故障模式", "component_failure_key", "component_failure_mode", "component_name", "component_reason_raw"),
    "system_failure_mode": ("系统级故障模式", "system_failure_key", "system_failure_mode", "system_name", "system_effect_raw"),
    "overall_failure_mode": ("总体级故障模式", "overall_failure_key", "overall_failure_mode", None, None),
    "is_single_point": ("是否单点", "single_point_key", "is_single_point", None, None),
    "severity_level": ("严酷度等级", "severity_key", "severity_level", None, None),
    "probability_level": ("发生概率", "probability_key", "probability_level", None, None),
    "mission_phase": ("发生阶段", "phase_key", "mission_phase", None, None),
    "design_measure": ("设计措施", "measure_key", "design_measure", None, None),
}
#: source alias, relation, target alias
EDGES = (
    ("machine", "具有功能", "function"),
    ("machine", "具有故障模式", "unit_failure_mode"),
    ("component", "具有故障模式", "component_failure_mode"),
    ("component_failure_mode", "导致", "unit_failure_mode"),
    ("system", "具有故障模式", "system_failure_mode"),
    ("unit_failure_mode", "导致", "system_failure_mode"),
    ("system_failure_mode", "导致", "overall_failure_mode"),
    ("unit_failure_mode", "是否单点", "is_single_point"),
    ("unit_failure_mode", "严酷度等级", "severity_level"),
    ("unit_failure_mode", "发生概率", "probability_level"),
    ("unit_failure_mode", "发生阶段", "mission_phase"),
    ("unit_failure_mode", "设计措施", "design_measure"),
)
MODES, WHENS = ("property", "node", "relationship"), ("nonempty", "equals")


@dataclass(frozen=True)
class Loaded:
    """nodes(label, key, name, owner, raw_text, properties) and edges(src_label, src, rel, dst_label, dst, properties)."""

    nodes: DataFrame
    edges: DataFrame


@dataclass(frozen=True)
class Rule:
    """What becomes of one column's cells: a property of a node, a node of its own, or an edge between two of a row's nodes."""

    column: str
    mode: str
    target: str | None = None
    property: str | None = None
    label: str | None = None
    key_prefix: str | None = None
    connect_from: str | None = None
    relation: str | None = None
    source: str | None = None
    relationship_property: str | None = None
    when: str = "nonempty"
    equals: str | None = None
    name_property: str = "name"


def rule_of(given: dict, number: int, columns: list[str]) -> Rule:
    """A checked rule; aliases may be given by label."""
    tidy = {k: str(v).strip() or None for k, v in given.items() if v is not None}
    labels = {label: alias for alias, (label, *_) in NODES.items()}
    need = lambda *names: [n for n in names if not tidy.get(n)]
    where = f"rule {number}"
    mode, when = (tidy.get("mode") or "").lower(), (tidy.get("when") or "nonempty").lower()
    if need("column"):
        raise ValueError(f"{where} names no column")
    if mode not in MODES:
        raise ValueError(f"{where} has no mode of {', '.join(MODES)}")
    if when not in WHENS or when == "equals" and need("equals"):
        raise ValueError(f"{where} has no condition of nonempty, or equals with a value")
    asks = {"property": ("target", "property"), "node": ("label", *(("relation",) if tidy.get("connect_from") else ())), "relationship": ("source", "target", "relation")}
    if lost := need(*asks[mode]):
        raise ValueError(f"{where} in mode {mode} lacks {', '.join(lost)}")
    if tidy["column"] not in columns:
        raise ValueError(f"{where}: no column {tidy['column']}")
    for end in ("target", "source", "connect_from"):
        if tidy.get(end) and mode != "node" or end == "connect_from" and tidy.get(end):
            tidy[end] = labels.get(tidy[end], tidy[end])
            if tidy[end] not in NODES:
                raise ValueError(f"{where}: no node {tidy[end]}")
    if mode == "node" and not tidy.get("key_prefix"):
        kept = "".join(c if c.isalnum() or c == "_" else " " for c in tidy["column"])
        tidy["key_prefix"] = "_".join(kept.split()).strip("_").lower() or "mapped"
    return Rule(**(tidy | {"mode": mode, "when": when}))


def _text(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))


def _key(alias: str) -> Column:
    """The key of a row's node; null where the row has none."""
    field = NODES[alias][1]
    return F.when(_text(field) != "", _text(field))


def loaded(rows: DataFrame) -> Loaded:
    """The nodes and edges of rows with the fields of NODES and row_order."""
    maybe = lambda c: _text(c) if c else F.lit(None).cast("string")
    nodes = F.array(*[F.struct(F.lit(label).alias("label"), _key(alias).alias("key"), _text(name).alias("name"), maybe(owner).alias("owner"), maybe(raw).alias("raw_text")) for alias, (label, _, name, owner, raw) in NODES.items()])
    found = rows.select("row_order", F.explode(nodes).alias("n")).select("row_order", "n.*").where("key is not null")
    first = found.groupBy("label", "key").agg(F.min_by(F.struct("name", "owner", "raw_text"), F.struct("row_order", "name")).alias("n"))
    empty = F.create_map().cast("map<string,string>").alias("properties")
    ends = F.array(*[F.struct(F.lit(NODES[a][0]).alias("src_label"), _key(a).alias("src"), F.lit(rel).alias("rel"), F.lit(NODES[b][0]).alias("dst_label"), _key(b).alias("dst")) for a, rel, b in EDGES])
    edges = rows.select(F.explode(ends).alias("e")).select("e.*").where("src is not null and dst is not null").distinct()
    return Loaded(first.select("label", "key", "n.name", "n.owner", "n.raw_text", empty), edges.withColumn("properties", empty))


def mapped(rows: DataFrame, graph: Loaded, rules: list[Rule]) -> Loaded:
    """The graph with what the rules make of the columns in `extra`."""
    if not rules:
        return graph
    spark = rows.sparkSession
    fields = list(asdict(rules[0]))
    table = spark.createDataFrame([(n, *asdict(r).values()) for n, r in enumerate(rules)], "rule int, " + ", ".join(f"r_{c} string" for c in fields))
    keys = F.map_from_arrays(F.array(*map(F.lit, NODES)), F.array(*[_key(alias) for alias in NODES])).alias("keys")
    cells = rows.select("row_order", keys, F.explode("extra").alias("column", "value"))
    cells = cells.withColumn("value", F.trim(F.coalesce("value", F.lit("")))).join(F.broadcast(table), F.trim("column") == F.col("r_column"))
    cells = cells.where(F.when(F.col("r_when") == "equals", F.col("value") == F.col("r_equals")).otherwise(F.col("value") != ""))
    labels = F.create_map(*[F.lit(x) for alias, (label, *_) in NODES.items() for x in (alias, label)])
    at = lambda alias: (F.element_at(labels, F.col(alias)), F.element_at("keys", F.col(alias)))
    turn = F.struct("rule", "row_order", "value")

    # new nodes: the first cell names them
    made = cells.where("r_mode = 'node'").withColumn("key", F.concat("r_key_prefix", F.lit("::"), F.when(F.col("value") != "", F.col("value")).otherwise(UNSET)))
    first = made.groupBy(F.col("r_label").alias("label"), "key").agg(F.min_by(F.struct("r_name_property", "value"), turn).alias("n"))
    fresh = first.join(graph.nodes.select("label", "key"), ["label", "key"], "left_anti")
    named = F.when(F.col("n.r_name_property") == "name", F.col("n.value"))
    other = F.when(F.col("n.r_name_property") != "name", F.create_map("n.r_name_property", "n.value")).otherwise(F.create_map().cast("map<string,string>"))
    none = F.lit(None).cast("string")
    fresh = fresh.select("label", "key", named.alias("name"), none.alias("owner"), none.alias("raw_text"), other.alias("properties"))

    # properties: the last cell of the last rule wins
    label, key = at("r_target")
    sets = cells.where("r_mode = 'property'").select(label.alias("label"), key.alias("key"), "r_property", "rule", "row_order", "value").where("key is not null")
    sets = sets.groupBy("label", "key", "r_property").agg(F.max_by("value", turn).alias("value"))
    sets = sets.groupBy("label", "key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("r_property", "value")))).alias("more"))
    over = lambda old, more: F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(more), k)), more)
    nodes = graph.nodes.join(sets, ["label", "key"], "left")
    nodes = nodes.withColumn("properties", F.when(F.col("more").isNull(), F.col("properties")).otherwise(over(F.col("properties"), F.col("more")))).drop("more").unionByName(fresh)

    # edges, to new nodes and between a row's own
    a_label, a = at("r_connect_from")
    to_new = made.where("r_connect_from is not null").select(a_label.alias("src_label"), a.alias("src"), F.col("r_relation").alias("rel"), F.col("r_label").alias("dst_label"), F.col("key").alias("dst"), none.alias("property"), "rule", "row_order", "value")
    (a_label, a), (b_label, b) = at("r_source"), at("r_target")
    own = cells.where("r_mode = 'relationship'").select(a_label.alias("src_label"), a.alias("src"), F.col("r_relation").alias("rel"), b_label.alias("dst_label"), b.alias("dst"), F.col("r_relationship_property").alias("property"), "rule", "row_order", "value")
    ends = ["src_label", "src", "rel", "dst_label", "dst"]
    drawn = to_new.unionByName(own).where("src is not null and dst is not null").groupBy(*ends, "property").agg(F.max_by("value", turn).alias("value"))
    drawn = drawn.groupBy(*ends).agg(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("property").isNotNull(), F.struct("property", "value"))))).alias("more"))
    known = nodes.select("label", "key")
    for end in ("src", "dst"):
        drawn = drawn.join(known.withColumnsRenamed({"label": f"{end}_label", "key": end}), [f"{end}_label", end], "left_semi")
    empty = F.create_map().cast("map<string,string>")
    edges = graph.edges.join(drawn.select(*ends, "more"), ends, "full_outer")
    edges = edges.select(*ends, over(F.coalesce("properties", empty), F.coalesce("more", empty)).alias("properties"))
    return Loaded(nodes, edges)
