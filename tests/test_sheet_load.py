import random

import pytest

from quillgraph.operators import sheet_load as S

FIELDS = sorted({f for spec in S.NODES.values() for f in spec[1:] if f})


def sheet(seed=4, many=60):
    draw, rows = random.Random(seed), []
    for n in range(many):
        row = {f: draw.choice([f"{f[:3]}{draw.randrange(3)}", f" {f[:3]}1 ", "", None]) for f in FIELDS}
        extra = {"检测方法": draw.choice(["目视", " 目视", "仪器", "", None]), "复核": draw.choice(["是", "否", ""]), "备注": draw.choice([f"v{draw.randrange(4)}", ""])}
        rows.append((row, n, extra if n % 7 else {}))
    return rows


RULES = [
    {"column": "检测方法", "mode": "node", "label": "检测方法", "connect_from": "单机级故障模式", "relation": "USES"},
    {"column": "备注", "mode": "property", "target": "machine", "property": "note"},
    {"column": "检测方法", "mode": "property", "target": "单机", "property": "note"},
    {"column": "复核", "mode": "relationship", "source": "machine", "target": "system", "relation": "REVIEWED", "relationship_property": "by", "when": "equals", "equals": "是"},
    {"column": "备注", "mode": "node", "label": "备注", "key_prefix": "note", "name_property": "text"},
    {"column": "备注", "mode": "relationship", "source": "machine", "target": "function", "relation": "具有功能", "relationship_property": "mark"},
]


def text(v):
    return (v or "").strip()


def brute(rows, rules):
    nodes, edges = {}, {}
    key = lambda row, alias: text(row[S.NODES[alias][1]]) or None
    for row, _, _ in rows:
        for alias, (label, _, name, owner, raw) in S.NODES.items():
            if key(row, alias):
                nodes.setdefault((label, key(row, alias)), [text(row[name]), text(row[owner]) if owner else None, text(row[raw]) if raw else None, {}])
        for a, rel, b in S.EDGES:
            if key(row, a) and key(row, b):
                edges.setdefault((S.NODES[a][0], key(row, a), rel, S.NODES[b][0], key(row, b)), {})
    for r in rules:
        for row, _, extra in rows:
            value = text(extra.get(r.column))
            if not (value == r.equals if r.when == "equals" else value):
                continue
            if r.mode == "property":
                target = (S.NODES[r.target][0], key(row, r.target))
                if target in nodes:
                    nodes[target][3][r.property] = value
            elif r.mode == "node":
                made = (r.label, f"{r.key_prefix}::{value}")
                if made not in nodes:
                    nodes[made] = [value if r.name_property == "name" else None, None, None, {} if r.name_property == "name" else {r.name_property: value}]
                if r.connect_from and key(row, r.connect_from):
                    edges.setdefault((S.NODES[r.connect_from][0], key(row, r.connect_from), r.relation, *made), {})
            elif key(row, r.source) and key(row, r.target):
                found = edges.setdefault((S.NODES[r.source][0], key(row, r.source), r.relation, S.NODES[r.target][0], key(row, r.target)), {})
                if r.relationship_property:
                    found[r.relationship_property] = value
    return nodes, edges


def frame(spark, rows):
    return spark.createDataFrame([(*[row[f] for f in FIELDS], n, extra) for row, n, extra in rows], ", ".join(f"{f} string" for f in FIELDS) + ", row_order int, extra map<string,string>")


def read(graph):
    nodes = {(r.label, r.key): [r.name, r.owner, r.raw_text, r.properties] for r in graph.nodes.collect()}
    return nodes, {(r.src_label, r.src, r.rel, r.dst_label, r.dst): r.properties for r in graph.edges.collect()}


def test_thirteen_kinds_of_nodes_and_twelve_of_edges(spark):
    row = {f: f"x {f}" for f in FIELDS}
    graph = S.loaded(frame(spark, [(row, 0, {}), (row, 1, {})]))
    assert graph.nodes.count() == 13
    assert graph.edges.count() == 12
    rows = sheet()
    assert read(S.loaded(frame(spark, rows))) == brute(rows, [])


def test_rules_are_applied_in_their_order(spark):
    rows = sheet()
    rules = [S.rule_of(r, n, ["检测方法", "复核", "备注"]) for n, r in enumerate(RULES, 1)]
    assert rules[0].key_prefix == "检测方法"
    data = frame(spark, rows)
    assert read(S.mapped(data, S.loaded(data), rules)) == brute(rows, rules)
    assert read(S.mapped(data.limit(0), S.loaded(data.limit(0)), rules)) == ({}, {})


@pytest.mark.parametrize(
    ("change", "said"),
    [({"column": ""}, "no column"), ({"mode": "x"}, "mode"), ({"label": None}, "label"), ({"relation": " "}, "relation"), ({"column": "q"}, "q"), ({"when": "equals"}, "equals"), ({"connect_from": "nobody"}, "nobody")],
)
def test_rules_that_lack_something_are_refused(change, said):
    with pytest.raises(ValueError, match=said):
        S.rule_of(RULES[0] | change, 1, ["检测方法"])
