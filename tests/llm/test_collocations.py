import random
import re
from collections import Counter

import numpy as np
import pytest

from quillgraph.llm import collocations


def brute(rows, least, longest, absorbed=50, top=2000):
    words, grams = {}, {}
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            w = re.findall("[^ \t]+", piece)
            words.setdefault(lang, Counter()).update(w)
            for size in range(2, longest + 1):
                grams.setdefault(lang, Counter()).update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang in words:
        f = {(w,): n for w, n in words[lang].items()} | dict(grams.get(lang, {}))
        kept = {g: a for g, a in grams.get(lang, {}).items() if a >= least}
        found = []
        for g, a in kept.items():
            if any(len(h) > len(g) and 100 * b >= absorbed * a and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1)) for h, b in kept.items()):
                continue
            score, k = min((1000000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), a, f[g[:k]], f[g[k:]]))
        for rank, (score, _, phrase, a, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), a, l, r, sum(words[lang].values()), -score))
    return sorted(out)


def corpus(seed=5):
    draw = random.Random(seed)
    names = ["the", "Of", "IN", "Ünder", "über", "x", "|", "日本", "\x85q", "new", "york", "a-b"]
    rows = []
    for _ in range(160):
        parts = [draw.choice(names) if draw.random() < 0.7 else draw.choice(["new york", "the of the", "x x x", "the THE"]) for _ in range(draw.randint(0, 40))]
        rows.append((draw.choice(["{} ", "{}. ", "{}\t", "{}\n"]).join([""]).join(p + draw.choice([" ", " ", " ", ". ", "\t", "\n", ";", "  "]) for p in parts), draw.choice(["en", "en", "en", "de", None, "und"])))
    return rows + [(None, "en"), ("", "fr"), ("hot pair " * 500, "en"), ("same " * 300, "de")]


@pytest.mark.parametrize(("listed", "longest", "least"), [(1 << 19, 3, 10), (4, 3, 10), (1 << 19, 4, 3), (0, 2, 2)])
def test_phrases_match_brute_force(spark, monkeypatch, listed, longest, least):
    rows = corpus()
    # small buckets and units, so that hot pivots are split, and several flushes
    monkeypatch.setattr(collocations, "LOAD", 2000)
    monkeypatch.setattr(collocations, "UNIT", 150)
    monkeypatch.setattr(collocations, "FLUSH", 1500)
    monkeypatch.setattr(collocations, "ENTRIES", 20)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, items int").repartition(3)
    got = collocations.collocations(docs, least=least, longest=longest, listed=listed)
    assert sorted(map(tuple, got.collect())) == brute(rows, least, longest)


def test_top_is_cut_with_ties(spark):
    rows = [(f"w{n} v{n}. " * 10, "en") for n in range(50)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(map(tuple, collocations.collocations(docs, top=7).collect())) == brute(rows, 10, 3, top=7)


def test_every_ngram_has_one_fragment():
    draw = np.random.default_rng(2)
    for longest in (2, 3, 5):
        pieces = [draw.integers(1, 6, draw.integers(2, 12)) for _ in range(60)]
        ids = np.concatenate([np.r_[p, 0] for p in pieces])
        rows = collocations.windows(ids, longest - 1)
        got = Counter()
        for grams, counts in collocations.mined(rows, np.ones(len(rows), np.int64), longest):
            got.update({tuple(g): int(n) for g, n in zip(grams.tolist(), counts)})
        want = Counter(tuple(p[i : i + size].tolist()) for p in pieces for size in range(2, longest + 1) for i in range(len(p) - size + 1))
        assert got == want


def test_large_counts_stay_exact(spark):
    a, l, r = 10**12 + 7, 10**12 + 9, 10**12 + 11
    expr = "cast(1000000 as decimal(7, 0)) * cast(a as decimal(15, 0)) * cast(a as decimal(15, 0)) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))"
    assert spark.createDataFrame([(a, l, r)], "a long, l long, r long").selectExpr(expr).first()[0] == 1000000 * a * a // (l * r)


def test_empty_table_and_texts_without_words(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(docs).count() == 0
    docs = spark.createDataFrame([(None, None), (" .\n", "en")], "text string, lang string")
    assert collocations.collocations(docs).count() == 0
