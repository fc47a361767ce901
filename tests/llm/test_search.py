import random
from collections import defaultdict

import numpy as np
import pytest

from quillgraph.llm import mixing, topk, urlfilter
from quillgraph.llm.cutoff import kth_smallest


def test_kth_smallest(spark):
    draw = random.Random(1)
    values = [draw.choice([draw.random(), 0.5, -1e9, 1e-12 * draw.random()]) for _ in range(500)]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 2, 100, 250, 499, 500):
        assert kth_smallest(rows, "x", k, bins=8) == sorted(values)[k - 1]
    assert kth_smallest(rows, "x", 501) is None


def test_top_k_matches_brute_force(spark):
    draw = np.random.default_rng(2)
    vectors = draw.normal(0, 0.3, (300, 8)).astype(np.float32)
    vectors[50:80] = vectors[50]
    rows = [(int(n), [float(x) for x in v]) for n, v in enumerate(vectors)]
    rows += [(1000, None), (1001, [float("nan")] * 8), (1002, [1.0, None] * 4), (1050, [0.1, 0.2]), (None, [1.0] * 8)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in sorted(topk.top_k(data, data.where("vec_id % 50 = 0")).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append((-r.score, r.vec_id))
    whole = np.floor(256 * vectors.astype(np.float64)).astype(int)
    ones = np.full(8, 256)
    for q in range(0, 300, 50):
        scores = sorted([(-int(whole[q] @ whole[n]), n) for n in range(300) if n != q] + [(-int(whole[q] @ ones), 2**63)])[:5]
        assert got[q] == [(s, None if n == 2**63 else n) for s, n in scores]
    assert 1050 not in got


def test_top_k_of_large_components_and_empty_tables(spark):
    draw = np.random.default_rng(5)
    # a row's product with itself passes 64 bits, its products with others don't
    vectors = np.r_[[[2e7, 0, 0, 0]], draw.normal(0, 100, (59, 4))]
    data = spark.createDataFrame([(int(n), [float(x) for x in v]) for n, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    whole = [[int(x) for x in np.floor(256 * v)] for v in vectors]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(data, data.where("vec_id % 20 = 0")).collect()}
    for q in (0, 20, 40):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], whole[n])), n) for n in range(60) if n != q)[:5]
        assert [got[q, k] for k in range(1, 6)] == [(n, -s) for s, n in scores]
    huge = spark.createDataFrame([(0, [1e18]), (1, [1e18])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(huge, huge).collect()
    assert topk.top_k(data.limit(0), data.limit(0)).count() == 0


def test_top_k_does_not_broadcast_queries_for_all_blocks(spark, monkeypatch):
    draw = np.random.default_rng(6)
    vectors = draw.normal(0, 0.3, (400, 8))
    data = spark.createDataFrame([(int(n), [float(x) for x in v]) for n, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    asked = data.where("vec_id % 50 = 0")
    want = sorted(map(str, topk.top_k(data, asked).collect()))
    monkeypatch.setattr(topk, "BLOCK", 16)
    found = topk.top_k(data, asked)
    assert sorted(map(str, found.collect())) == want
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert topk.block_rows(400) == 16 and topk.block_rows(128 * 20) == 20 and topk.block_rows(10**9) == 8 * 16


def test_mix_meets_targets(spark):
    draw = random.Random(3)
    rows = [(n, " ".join(["w"] * draw.randint(1, 30)), draw.choice(["a", "b", "c", None])) for n in range(900)]
    rows += [(2000, None, "a"), (2001, " ", "zero"), (None, "x y", "b")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    again = mixing.mix(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string")).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    taken, target = defaultdict(int), {}
    for r in got:
        taken[r.doc.source] += r.taken
        target[r.doc.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    total = sum(r.size for r in got)
    assert abs(sum(target.values()) - total) < 1e-6 * total
    for source, words in target.items():
        assert abs(taken[source] - words) <= 15.5


def test_urls(spark):
    rows = [
        (1, "http://a.com/x", '<link rel="canonical" href="http://b.net/y">'),
        (2, "http://b.net/y", ""),
        (3, "https://A.com/x#f", None),
        (4, None, None),
        (5, "nothing", "<link rel=canonical href=/q>"),
        (6, "http://c.org/fr/k", '<meta http-equiv="refresh" content="0; url=/fr/z">'),
        (7, "http://c.org/fr/z", '<link rel="canonical" href="//b.net/y">'),
        (8, "http://z.example.net/en/", '<link href="http://a.com/x" rel="canonical">'),
        (9, "http://far.com/", None),
        (10, "http://x.example.net/de/", None),
    ]
    moves = spark.createDataFrame([("http://far.com/", "http://a.com/x")], "src string, dst string")
    got = {r.id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), redirects=moves).collect()}
    assert got[1] == ("a.com", "/x", None, "block") == got[3]
    assert got[2] == ("b.net", "/y", "net/", "block")
    assert got[4] == got[5] == ("", "", None, "allow")
    assert got[6][2:] == got[7][2:] == ("org/fr/", "allow")
    assert got[8][2:] == ("example.net/en/", "allow")
    assert got[9][3] == "block" and got[10][2:] == ("net/", "block")


def test_blocked_targets_that_are_no_page_block(spark):
    rows = [
        (1, "http://a.com/x", '<link rel="canonical" href="http://b.net/y?q=1">'),
        (2, "http://c.com/", '<link rel="canonical" href="http://a.com/x">'),
        (3, "http://d.com/", None),
        (4, "http://e.com/", '<link rel="canonical" href="http://f.com/z">'),
        (5, "http://c.org/fr/k", '<link rel="canonical" href="http://a.com/x">'),
    ]
    moves = spark.createDataFrame([("http://d.com/", "http://example.com/de/q")], "src string, dst string")
    got = {r.id: (r.verdict, r.inherited) for r in urlfilter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), redirects=moves).collect()}
    assert got == {1: ("block", True), 2: ("block", True), 3: ("block", True), 4: ("allow", False), 5: ("allow", False)}
