import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import editprints, pieces, private, quality, simhash


def test_encoding_equals_the_library_and_decodes():
    sentencepiece = pytest.importorskip("sentencepiece")
    vocabulary = pieces.Vocabulary.load(pieces.default_model())
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    encoder, decoder = pieces.Encoder(vocabulary), pieces.Decoder(vocabulary)
    draw = random.Random(1)
    letters = " ▁abcdeinstr\n0=-*/#AétñßA中\x1f😀"
    for _ in range(3000):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 40)))
        text = draw.choice([text, " " * draw.randint(0, 40) + text, text.replace(" ", "") * 12])
        ids = np.frombuffer(encoder.encode(text), "<i4")
        assert ids.tolist() == model.encode(text)
        assert pieces.MARK in text or decoder.decode(ids) == text


def test_stream_commits_before_the_end():
    vocabulary = pieces.Vocabulary.load(pieces.default_model())
    parts = list(pieces.Encoder(vocabulary).stream(iter("internationalization" * 60)))
    assert len([p for p in parts if p]) > 3
    assert [n for p in parts for n in p] == pieces.Encoder(vocabulary).short("internationalization" * 60)


def test_unigram_takes_the_best_sum():
    vocabulary = pieces.Vocabulary(["<unk>", "a", "b", "ab", "aba"], [0, -1.5, -1.5, -1.0, -9.0], {0}, {}, 0, True)
    encoder = pieces.Encoder(vocabulary)
    assert encoder.short("aba") == [3, 1] == [n for p in encoder.stream(iter("aba")) for n in p]


def test_encode_nulls(spark):
    rows = pieces.encode(spark.createDataFrame([(1, None), (2, ""), (None, "a b")], "doc_id long, text string")).collect()
    assert [(r.n_ids, r.round_trip) for r in rows][:2] == [(0, True), (0, True)]
    assert pieces.decode(spark.createDataFrame([(3, rows[2].ids)], "id long, ids array<int>")).first().text == "a b"


def test_walks_match_direct_ones(spark):
    draw = random.Random(2)
    rows = [(n, "".join(draw.choice("abc é") for _ in range(draw.choice([0, 1, 2, 50, 300])))) for n in range(40)] + [(None, "last"), (77, None)]
    got = {r.id: r for r in editprints.walk_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = sorted(rows, key=lambda r: -1 if r[0] is None else r[0], reverse=True)
    walker = editprints.Walker()
    for n, (id_, text) in enumerate(order):
        new = editprints.edited(text or "", order[(n + 1) % len(order)][1] or "")
        r = got[id_]
        assert r.n_chars == len(text or "") and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert r.fingerprint == walker.fingerprint(text or "") and r.edited_fingerprint == walker.fingerprint(new)


def test_few_edits_stay_near_and_banding_finds_them(spark):
    draw = random.Random(3)
    base = ["".join(draw.choice("abcdefghij ") for _ in range(600)) for _ in range(8)]
    copies = [b[:300] + b[301:] for b in base]
    walker = editprints.Walker()
    # walks fall into step again sooner or later after an edit: nearly always soon, so a single one may miss
    near = [walker.likeness(walker.fingerprint(a), walker.fingerprint(b)) for a, b in zip(base, copies)]
    assert sum(x > 0.6 for x in near) >= 7 and np.mean(near) > 0.8
    assert walker.likeness(walker.fingerprint(base[0]), walker.fingerprint(base[1])) < 0.4
    assert walker.likeness(walker.fingerprint(""), walker.fingerprint("")) == 1.0
    rows = [(n, walker.fingerprint(x)) for n, x in enumerate(base + copies)]
    links = {(r.src, r.dst) for r in editprints.near_links(spark.createDataFrame(rows, "id long, fingerprint string")).collect()}
    assert links <= {(n + 8, n) for n in range(8)} and len(links) >= 7


def test_links_in_crowded_buckets_and_across_lengths(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 16)
    monkeypatch.setattr(editprints, "BAND_BITS", 3)
    draw = random.Random(23)
    walker = editprints.Walker()
    base = ["".join(draw.choice("abcdefghij ") for _ in range(draw.choice([90, 150, 230, 400]))) for _ in range(60)]
    texts = [(n, x) for n, x in enumerate(base)] + [(100 + n, x + x[: len(x) // 5]) for n, x in enumerate(base)]
    texts += [(200, base[50]), (None, base[51]), (None, base[52][:-1]), (300, "")]
    rows = [(i, walker.fingerprint(x)) for i, x in texts]
    prints = spark.createDataFrame(rows, "id long, fingerprint string")
    like = {(a, b): walker.likeness(p, q) for a, p in rows for b, q in rows if a is not None and b is not None and a > b}
    want = {pair for pair, x in like.items() if x >= 0.5} - {(200, 150)}
    links = {(r.src, r.dst): r.likeness for r in editprints.near_links(prints).collect()}
    assert {pair for pair in links if None not in pair} == want and links[200, 50] == 1.0 and links[None, 51] == 1.0
    assert all(links[pair] == like[pair] for pair in want)
    group = {r.fingerprint: r.near_group for r in editprints.near_groups(prints).collect()}
    assert all(group[rows[a][1]] == group[rows[b][1]] for a, b in ((n, n + 60) for n in range(60)) if like[100 + a, a] >= 0.5)
    assert group[walker.fingerprint(base[52][:-1])] == 52


def brute_spans(text):
    out = [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(f"ip:{m.start()}:{m.end()}")
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 16 <= len(digits) <= 19 and sum(d if n % 2 == 0 else 2 * d - 9 * (d > 4) for n, d in enumerate(digits)) % 10 == 0:
            out.append(f"card:{m.start()}:{m.end()}")
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(f"phone:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_spans_match_brute_force(spark):
    draw = random.Random(3)
    rows = [(n, "".join(draw.choice("ab.@_-+ 0123456789.()é") for _ in range(draw.randint(0, 200)))) for n in range(300)]
    rows += [(900, None), (901, "1" * 900), (902, "1 " * 700), (903, "+" + "1." * 700), (904, "a@b.co_x@d.com 4111 1111 1111 1111 x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    base = F.array_join(F.concat(*[private._joined(k, F.col(k)) for k in private.KINDS]), ",")
    got = {r.id: r.b for r in private.find_private(docs, model=private.Model()).select("id", base.alias("b")).collect()}
    assert got == {i: brute_spans(x or "") for i, x in rows}


def test_secrets_are_added_and_plain_text_left(spark):
    draw = random.Random(4)
    words = ["river", "stone", "walks", "under", "version", "2020-01-02", "chapter 12"]

    def prose():
        return " ".join(draw.choice(words) for _ in range(30))

    rows = [(n, f"{prose()} password={draw.getrandbits(72):018x} {prose()} x{n}@mail.example.com") for n in range(40)]
    rows += [(100 + n, prose()) for n in range(40)]
    got = {r.id: len(r.added) for r in private.find_private(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[n] == 1 for n in range(40)) and not any(got[100 + n] for n in range(40))


def test_candidates_have_no_greatest_length(spark):
    long_key, word = "k7" * 5000, "s3" * 400
    texts = [f"see {long_key} end", f"password={word} end", "call " + "12 " * 3000 + "end", f"{'u' * 90} at {'h' * 80} dot museum"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: {(c.kind, texts[r.id][c.s : c.e]) for c in r.cands} for r in private._prepared(rows, "doc_id", "text").collect()}
    assert ("key", long_key) in got[0] and ("secret", f"password={word}") in got[1]
    assert ("number", ("12 " * 3000).strip()) in got[2] and ("contact", texts[3]) in got[3]


def test_thresholds_come_from_the_half_that_trained_nothing(spark):
    draw = random.Random(5)
    rows = [(n, f"note {n} password={draw.getrandbits(72):018x} and {draw.randint(1, 9)} more") for n in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    half = {r.doc_id: r.h for r in docs.select("doc_id", F.pmod(F.xxhash64("text"), F.lit(2)).alias("h")).collect()}
    for side in (0, 1):
        one = docs.where(F.col("doc_id").isin([n for n in half if half[n] == side]))
        model = private.train(private._prepared(one, "doc_id", "text"))
        assert model.thresholds == {}
    assert "secret" in private.train(private._prepared(docs.unionByName(spark.createDataFrame([(90 + n, f"key: none {n}, token: no0{n}") for n in range(40)], docs.schema)), "doc_id", "text")).thresholds


def test_private_of_empty_tables_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a@b.co"), (1, "a@b.co"), (None, None), (2, "")], "doc_id long, text string")
    got = sorted((r.id or 0, len(r.email), len(r.added)) for r in private.find_private(docs).collect())
    assert got == [(0, 0, 0), (1, 1, 0), (1, 1, 0), (2, 0, 0)]
    assert private.find_private(docs.limit(0)).count() == 0


def test_quality_separates_and_keeps_good_documents(spark):
    draw = random.Random(7)
    words = ["".join(draw.choice("abcdefg") for _ in range(draw.randint(2, 6))) for _ in range(80)]
    rows, labels = [], []
    for n in range(240):
        text = [draw.choice(words) for _ in range(60)]
        bad = n % 6 == 0
        if bad:
            text = [w + draw.choice(["###", "%%%"]) for w in text]
        rows.append((n, " ".join(text), "x"))
        if n < 160:
            labels.append((n, int(not bad), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got, _, _ = quality.resample(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    wrong = [r.id for r in got.collect() if r.keep != (r.id % 6 != 0)]
    assert len(wrong) <= 2


def test_quality_without_labels_keeps_all(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (None, "")], "doc_id long, text string")
    got, _, _ = quality.resample(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert [r.keep for r in got.collect()] == [True] * 3


def test_toxic_documents_go(spark):
    draw = random.Random(17)
    words = ["".join(draw.choice("abcdefg") for _ in range(draw.randint(2, 6))) for _ in range(200)]
    rows, labels = [], []
    for n in range(400):
        text = [draw.choice(words) for _ in range(80)]
        if n % 8 == 0:
            text = [w + draw.choice(["###", "%%%"]) for w in text]
        elif n % 8 == 1:
            for at in draw.sample(range(80), 3):
                text[at] = draw.choice(["idiot", "moron,", "Clown"])
        rows.append((n, " ".join(text)))
        if n < 240:
            labels.append((n, int(n % 8 != 0), int(n % 8 == 1)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got, _, _ = quality.resample(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    kept = {r.id for r in got.collect() if r.keep}
    assert not [n for n in kept if n % 8 < 2]
    assert len(kept) >= 290


def plain_buckets(text):
    """Bucket numbers of words, word pairs and shape pairs, one n-gram at a time."""
    import zlib

    def mixed(x):
        return (x * 0xD6E8FEB86659FD93 % 2**64) >> 48

    words = text.encode().split()
    codes = [(zlib.crc32(w), zlib.crc32(quality.shape(w))) for w in words]
    out = [mixed(w + 77) for w, _ in codes]
    out += [mixed((a * 0x9E3779B97F4A7C15 + b) % 2**64) for (a, _), (b, _) in zip(codes, codes[1:])]
    out += [mixed((a * 0xC2B2AE3D27D4EB4F + b + (x == y) * 0x165667B19E3779F9 + 1) % 2**64) for (x, a), (y, b) in zip(codes, codes[1:])]
    return out


def test_resampling_matches_a_plain_version(spark):
    import math
    from collections import Counter

    draw = random.Random(27)
    words = ["".join(draw.choice("abCDé0#") for _ in range(draw.randint(1, 5))) for _ in range(60)]
    rows = [(n, " ".join(draw.choice(words[: 60 if n % 3 else 20]) for _ in range(draw.choice([0, 1, 5, 90, 400])))) for n in range(120)]
    labels = [(n, int(n % 3 == 0), 0) for n in range(80)]
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got, model, _ = quality.resample(spark.createDataFrame(rows, "doc_id long, text string"), marked, k=30)
    fitted = {i for n, (i, kind) in enumerate(quality.labelled_sample(marked).items()) if n % 2 == 0 and kind == quality.GOOD}
    raw, target = Counter(), Counter()
    for i, text in rows:
        raw.update(plain_buckets(text))
        if i in fitted:
            target.update(plain_buckets(text))
    size = quality.BUCKETS
    n_raw, n_target = sum(raw.values()) + size, sum(target.values()) + size
    want = {}
    for i, text in rows:
        found = plain_buckets(text)
        total = sum(math.log((target[b] + 1) / n_target) - math.log((raw[b] + 1) / n_raw) for b in found)
        u = (int(hashlib.md5(f"{quality.SEED}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        score = quality.LENGTH * total / (len(found) + quality.PRIOR)
        want[i] = (score, score - math.log(-math.log(u)))
    top = set(sorted(want, key=lambda i: -want[i][1])[:30])
    for r in got.collect():
        assert abs(r.score - want[r.id][0]) < 1e-6 and abs(r.rank_key - want[r.id][1]) < 1e-6 and r.keep == (r.id in top)


def test_bucket_forest_joins_what_links(spark, monkeypatch):
    """Large buckets in chunks of four give the components of all alike pairs."""
    from quillgraph.graph.components import connected_components
    from quillgraph.llm import editprints as E

    monkeypatch.setattr(E, "CHUNK", 4)
    draw = np.random.default_rng(5)
    bits = draw.integers(0, 256, (3, E.SAMPLES // 8), dtype=np.uint8)
    prints = {}
    for n in range(40):
        row = np.zeros(1, E._ROW)
        mine = bits[n % 3].copy()
        mine[n % 32] ^= 1 << n % 8
        row["total"], row["level"], row["side"], row["bits"] = 1 << 12, 12, E._SAME, mine
        prints[n] = row.tobytes()
    rows = spark.createDataFrame([(0, key, n, bytearray(x)) for key in (1, 2) for n, x in prints.items()], "shard int, key long, id long, print binary")
    got = {r.node: r.component for r in connected_components(E._bucket_forest(rows, 0.8)).collect()}
    assert got == {n: n % 3 for n in prints}


def test_words_of_one_form_are_shaped_once(monkeypatch):
    """Shapes equal the direct definition, and a word that is new costs no expressions if its form is known."""
    draw, shape, calls = random.Random(4), quality.shape, []

    def direct(word):
        for these, mark in ((rb"[a-z\x80-\xff]+", b"a"), (rb"[A-Z]+", b"A"), (rb"[0-9]+", b"0")):
            word = re.sub(these, mark, word)
        return re.sub(rb"(.)\1+", rb"\1", word, flags=re.S)

    for _ in range(500):
        word = "".join(draw.choice("abzAZ09é-_.!日\n") for _ in range(draw.randint(1, 9))).encode()
        assert shape(word) == direct(word)
    monkeypatch.setattr(quality, "shape", lambda word: calls.append(word) or shape(word))
    words = {"".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(300)}
    list(quality.Buckets().of(" ".join(words)))
    assert len(calls) == 1
