import random

import numpy as np
import pyarrow as pa
import pytest

from quillgraph.llm import oddsketch
from quillgraph.llm.simhash import gram_set


def shingle_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in words.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if w]
    return {tuple(words[i : i + 2]) for i in range(len(words) - 1)} if len(words) > 1 else {tuple(words)} if words else set()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(i)] = root(j)
    big = 2**63 - 1
    least = {}
    for i, (id_, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), big), big if id_ is None else id_)
    names = [None if least[root(i)] == big else least[root(i)] for i in range(len(rows))]
    return sorted(map(str, ((id_, len(s), c, id_ == c) for (id_, _), s, c in zip(rows, sets, names))))


def edited(draw, words, share, vocabulary):
    words = list(words)
    for at in draw.sample(range(len(words)), int(len(words) * share)):
        words[at] = draw.choice(vocabulary)
    return words


def corpus(seed):
    draw = random.Random(seed)
    vocabulary = [f"w{n}" for n in range(3000)]
    rows, id_ = [], 0
    for _ in range(25):
        base = draw.choices(vocabulary, k=draw.choice([3, 12, 60, 300]))
        for _ in range(draw.randint(1, 14)):
            # two of a pair's shingles fall with each word: from clearly alike to just apart
            rows.append((id_, " ".join(edited(draw, base, draw.choice([0, 0, 0.02, 0.05, 0.06, 0.09]), vocabulary))))
            id_ += 1
    rows += [(900, None), (901, ""), (902, " \n"), (903, "One"), (904, "one"), (905, "one two"), (905, "one  TWO"), (None, "one two"), (None, "alone null"), (906, rows[3][1].upper())]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk", [256, 3])
def test_components_match_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(oddsketch, "CHUNK", chunk)
    monkeypatch.setattr(oddsketch, "SHINGLES", 4 * chunk)
    rows = corpus(chunk)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, set string").repartition(3)
    got = oddsketch.near_duplicates(docs)
    assert sorted(map(str, map(tuple, got.collect()))) == brute(rows)


def test_a_large_group_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(oddsketch, "CHUNK", 16)
    monkeypatch.setattr(oddsketch, "SHINGLES", 3000)
    draw = random.Random(8)
    vocabulary = [f"w{n}" for n in range(5000)]
    base = draw.choices(vocabulary, k=200)
    rows = [(n, " ".join(edited(draw, base, draw.choice([0.03, 0.05, 0.07]), vocabulary))) for n in range(160)] + [(1000 + n, " ".join(base)) for n in range(100)]
    got = oddsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(str, map(tuple, got.collect()))) == brute(rows)


def pair(draw, size, similarity):
    """Two sets of hashes at the similarity."""
    both = round(2 * size * similarity / (1 + similarity))
    h = np.unique(draw.integers(-(2**63), 2**63, 2 * size, dtype=np.int64))
    draw.shuffle(h)
    return np.sort(h[:size]), np.sort(np.r_[h[:both], h[size : 2 * size - both]])


def test_bands_meet_and_sketches_estimate():
    draw = np.random.default_rng(6)
    limit, met, off = oddsketch.most_bits(), 0, []
    for n in range(400):
        a, b = (oddsketch.samples(x) for x in pair(draw, (40, 300, 1500)[n % 3], 0.8))
        met += bool((oddsketch.band_keys(a) == oddsketch.band_keys(b)).any())
        bits = int(np.bitwise_count(np.frombuffer(oddsketch.sketch(a), np.uint8) ^ np.frombuffer(oddsketch.sketch(b), np.uint8)).sum())
        assert bits <= limit
        off.append(oddsketch.estimated(np.array([bits]))[0] - 0.8)
    assert met == 400
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.03
    far = [int(np.bitwise_count(np.frombuffer(oddsketch.sketch(oddsketch.samples(x)), np.uint8) ^ np.frombuffer(oddsketch.sketch(oddsketch.samples(y)), np.uint8)).sum()) for x, y in (pair(draw, 300, 0.3) for _ in range(50))]
    assert sum(b > limit for b in far) >= 40


def test_very_long_text_is_read_whole():
    a = " ".join(f"w{n}" for n in range(60_000))
    b = a + " " + " ".join(f"v{n}" for n in range(30_000))
    assert len(gram_set(b, 2)) == 89_999
    x, y = oddsketch.samples(gram_set(a, 2)), oddsketch.samples(gram_set(b, 2))
    assert 0.6 < (x == y).mean() < 0.73


def test_empty_table(spark):
    assert oddsketch.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only = oddsketch.near_duplicates(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"))
    assert sorted(map(tuple, only.collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_waiting_members_come_once_a_meeting():
    """A row for each side of a meeting, with the members that have a partner, not a row for each member."""
    draw = random.Random(9)
    vocabulary = [f"w{n}" for n in range(3000)]
    base, members = draw.choices(vocabulary, k=150), []
    for n in range(40):
        grams = gram_set(" ".join(edited(draw, base, 0.03, vocabulary)), oddsketch.SHINGLE)
        values = oddsketch.samples(grams)
        members.append({"id": n, "n": len(grams), "component": n, "sketch": oddsketch.sketch(values), "bands": [7, *oddsketch.band_keys(values)[1:].tolist()], "chunk": n % 2})
    kind = pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int64()), ("component", pa.int64()), ("sketch", pa.binary()), ("bands", pa.list_(pa.int64())), ("chunk", pa.int32())]))
    even, odd = members[::2], members[1::2]
    batch = pa.RecordBatch.from_pydict({"key": pa.array([7, 7, 7], pa.int64()), "left": pa.array([even, odd, even], kind), "right": pa.array([None, None, odd], kind)})
    rows = pa.Table.from_batches(oddsketch._waiting(oddsketch.SIMILARITY)(iter([batch]))).to_pylist()
    assert [(r["key"], r["chunk"]) for r in rows] == [(7, 0), (7, 1), (7, 0), (7, 1)]
    assert {i for r in rows for i in r["ids"]} == set(range(40))
    assert all(i % 2 == r["chunk"] for r in rows for i in r["ids"])
