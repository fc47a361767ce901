import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from quillgraph.llm import linededup, simhash, suffixes

BIG = 2**63 - 1


def brute_bytes(rows):
    seen, out = set(), {}
    for id_, data in sorted((i, (x or "").encode()) for i, x in rows):
        cover = np.zeros(len(data) + 1, int)
        for s in range(len(data) - 99):
            w = data[s : s + 100]
            if w in seen:
                cover[s] += 1
                cover[s + 100] -= 1
            seen.add(w)
        gone = np.cumsum(cover[:-1]) > 0
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        out[id_] = (len(data), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(data, np.uint8)[~gone])).hexdigest())
    return out


def texts(seed):
    draw = random.Random(seed)
    parts = ["".join(draw.choice("abcdefgh ") for _ in range(draw.randint(60, 400))) for _ in range(8)]
    kinds = [lambda: draw.choice(parts), lambda: draw.choice(parts)[20:], lambda: "".join(draw.choice("xyzé") for _ in range(draw.randint(0, 50))), lambda: "q" * draw.randint(0, 300), lambda: "lo " * draw.randint(0, 80)]
    return [(n, "".join(draw.choice(kinds)() for _ in range(draw.randint(0, 7)))) for n in range(120)] + [(900, None), (901, "")]


def test_repeated_bytes_match_brute_force(spark, monkeypatch):
    rows = texts(2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block, hot in ((4 << 20, 512), (20_000, 3)):
        monkeypatch.setattr(suffixes, "BLOCK_BYTES", block)
        got = {r.id: tuple(r)[1:] for r in suffixes.repeated_bytes(docs, hot=hot).collect()}
        assert got == brute_bytes(rows)


def test_either_half_of_a_fingerprint_tells_windows_apart():
    draw = random.Random(12)
    base = bytes(draw.choice(b"abcd") for _ in range(suffixes.WINDOW))
    rows = [base]
    for at in range(suffixes.WINDOW):
        rows += [base[:at] + bytes([other]) + base[at + 1 :] for other in b"abcd" if other != base[at]]
    data = np.frombuffer(b"".join(rows) + base, np.uint8)
    at = np.arange(len(rows) + 1) * suffixes.WINDOW
    halves = [suffixes.window_hashes(data, at, by) for by in ((suffixes._A, suffixes._B, suffixes._C), suffixes._SECOND)]
    for half in halves:
        assert half[0] == half[-1] and len(set(half.tolist())) == len(rows)
    assert not set(halves[0].tolist()) & set(halves[1].tolist())


def test_repeated_rows_and_null_ids_keep_one_copy(spark):
    draw = random.Random(4)
    text = "".join(draw.choice("abcdef") for _ in range(300))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    assert sorted((r.id or 9, r.n_removed) for r in suffixes.repeated_bytes(docs).collect()) == [(1, 0), (1, 300), (9, 300)]
    assert suffixes.repeated_bytes(docs.limit(0)).count() == 0


def test_deep_shallow_sorts():
    draw = np.random.default_rng(1)
    rows = draw.integers(97, 99, (400, 40)).astype(np.uint8)
    rows[::3, :36] = rows[0, :36]
    order, prefix = suffixes.deep_shallow(rows)
    listed = [rows[n].tobytes() for n in order]
    assert listed == sorted(r.tobytes() for r in rows)
    for n in range(1, 400):
        a, b = listed[n - 1], listed[n]
        assert prefix[n] == next((k for k in range(40) if a[k] != b[k]), 40)


def brute_components(prints, radius):
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}


def test_bk_tree_finds_all_within():
    draw = random.Random(3)
    values = [draw.getrandbits(16) for _ in range(300)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for radius in (0, 3, 9):
        for v in values[:30]:
            assert sorted(n for _, n in tree.within(v, radius)) == [n for n, w in enumerate(values) if (v ^ w).bit_count() <= radius]


def test_near_groups_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 2)
    draw = random.Random(5)
    words = ["w%d" % n for n in range(40)]
    rows = []
    for n in range(30):
        base = [draw.choice(words) for _ in range(draw.choice([0, 1, 2, 5, 60]))]
        for _ in range(draw.randint(1, 4)):
            copy = list(base)
            if copy and draw.random() < 0.7:
                copy[draw.randrange(len(copy))] = draw.choice(words)
            rows.append((len(rows), draw.choice([" ", "\t"]).join(copy)))
    rows += [(500, None), (501, "")]
    prints = {i: int.from_bytes(simhash.fingerprint(x), "little") for i, x in rows}
    got = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.id: r.component for r in got} == brute_components(prints, simhash.RADIUS)


def test_near_copies_are_grouped_and_others_left(spark):
    draw = random.Random(6)
    words = ["".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    base = [[draw.choice(words) for _ in range(200)] for _ in range(12)]
    rows = [(n, " ".join(b)) for n, b in enumerate(base)]
    for n, b in enumerate(base[:6]):
        copy = list(b)
        copy[17] = "changed"
        rows.append((100 + n, " ".join(copy)))
    rows.append((200, " ".join(base[0])))
    docs = spark.createDataFrame([(i, x, "e") for i, x in rows], "doc_id long, text string, lang string")
    kept = sorted(r.doc_id for r in simhash.stage_near_dedup(spark, docs, "").collect())
    assert kept == list(range(12))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute_lines(rows):
    listed = sorted((BIG if i is None else i, x) for i, x in rows if x is not None)
    seen, out = [], {}
    for id_, text in listed:
        kept = []
        for line in text.split("\n"):
            if not line.strip(" "):
                kept.append(line)
                continue
            near = any(line == m or (min(len(line), len(m)) >= linededup.MIN_CHARS and distance(line, m) <= linededup.EDITS) for m in seen)
            seen.append(line)
            if not near:
                kept.append(line)
        out[id_] = "\n".join(kept)
    return out


def test_lines_match_brute_force(spark):
    draw = random.Random(5)
    base = ["".join(draw.choice("abcdef gh") for _ in range(draw.randint(22, 40))) for _ in range(10)]

    def changed(line):
        line = list(line)
        for _ in range(draw.randint(0, 4)):
            at, kind = draw.randrange(len(line)), draw.random()
            if kind < 0.4:
                line[at] = draw.choice("abcxyz")
            elif kind < 0.7:
                line.insert(at, draw.choice("abé"))
            else:
                line.pop(at)
        return "".join(line)

    rows = [(n, "\n".join(draw.choice(["", "  ", changed(draw.choice(base)), changed(draw.choice(base))]) for _ in range(draw.randint(0, 6)))) for n in range(50)]
    rows += [(100, None), (101, ""), (None, base[0] + "\n\nq")]
    got = {BIG if r.doc.doc_id is None else r.doc.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] is None
    assert {k: v for k, v in got.items() if v is not None} == brute_lines(rows)


def brute_near(rows, similarity=simhash.SIMILARITY, size=simhash.SHINGLE):
    sets = {i: set(simhash.shingles(x, size)) for i, x in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and both >= similarity * (len(sets[a]) + len(sets[b]) - both):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {i: root(i) for i in sets}


def families(draw, many, share):
    """Texts, each with variants that have one block changed, half of it and scattered words, or some words."""
    words = ["".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    rows = []
    for _ in range(many):
        base = [draw.choice(words) for _ in range(200)]
        at, long = draw.randrange(20, 150), share
        block = [draw.choice(words) for _ in range(long)]
        whole = base[:at] + block + base[at + long :]
        half = base[:at] + block[: long // 2] + base[at + long // 2 :]
        for _ in range(3):
            half[draw.randrange(200)] = draw.choice(words)
        rows += [" ".join(x) for x in (base, half, whole)]
    return list(enumerate(rows))


def test_a_failed_edge_leaves_no_true_pair_apart(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 8)
    rows = families(random.Random(21), 60, 17)
    got = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.id: r.component for r in got} == brute_near(rows)


def test_rows_without_an_id_of_their_own_go_only_as_near_copies(spark):
    draw = random.Random(8)
    words = ["".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    texts = [" ".join(draw.choice(words) for _ in range(60)) for _ in range(9)]
    rows = [(None, x) for x in texts[:4]] + [(7, x) for x in texts[4:7]] + [(8, texts[7]), (8, texts[7]), (None, texts[7]), (9, texts[0]), (6, texts[8]), (7, texts[8])]
    docs = spark.createDataFrame([(i, x, "e") for i, x in rows], "doc_id long, text string, lang string")
    got = [(r.doc_id, r.text) for r in simhash.stage_near_dedup(spark, docs, "").collect()]
    want = [(9, texts[0])] + [(None, x) for x in texts[1:4]] + [(7, x) for x in texts[4:7]] + [(8, texts[7]), (6, texts[8])]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_block_changes_at_the_similarity_are_found(spark):
    draw = random.Random(31)
    words = ["".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    rows = []
    for _ in range(80):
        base, at = [draw.choice(words) for _ in range(200)], draw.randrange(20, 150)
        changed = base[:at] + [draw.choice(words) for _ in range(17)] + base[at + 17 :]
        rows += [" ".join(base), " ".join(changed)]
    # many repeats in one text and few in the other: the sets are equal but for the seam
    tail = [draw.choice(words) for _ in range(60)]
    rows += [" ".join(tail[:30] * 40 + tail), " ".join(tail[:30] * 2 + tail)]
    rows = list(enumerate(rows))
    got = {r.id: r.component for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_near(rows) == {i: i - i % 2 for i, _ in rows}


def test_lines_that_share_hot_segments_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(linededup, "HOT", 4)
    draw = random.Random(15)
    alphabet = "abcdefghijklmnop é"
    head = "".join(draw.choice(alphabet) for _ in range(30))
    tails = ["".join(draw.choice(alphabet) for _ in range(draw.randint(8, 40))) for _ in range(12)]

    def variant(line, edits):
        line = list(line)
        for _ in range(edits):
            at, kind = draw.randrange(len(line)), draw.random()
            if kind < 0.5:
                line[at] = draw.choice(alphabet)
            elif kind < 0.75:
                line.insert(at, draw.choice(alphabet))
            else:
                line.pop(at)
        return "".join(line)

    lines = [variant(head + draw.choice(tails), draw.choice([0, 1, 2, 3])) for _ in range(60)]
    lines += [variant(draw.choice(tails) + head, draw.choice([0, 1, 2])) for _ in range(40)]
    lines += [variant(head * 9, draw.choice([1, 2])) for _ in range(20)] + ["%s number %05d of all" % (head, n) for n in range(40)]
    draw.shuffle(lines)
    rows = [(n, "\n".join(lines[3 * n : 3 * n + 3])) for n in range(54)]
    got = {r.doc.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_lines(rows)


def test_pairs_within_two_edits_share_a_key(spark):
    draw = random.Random(16)
    pairs = []
    for n in range(600):
        a = [draw.choice("abcde fghi") for _ in range(draw.randint(26, 140))]
        b = list(a)
        for _ in range(2):
            at, kind = draw.choice([0, 1, len(b) - 1, draw.randrange(len(b)), len(b) // 3, 2 * len(b) // 3]), draw.random()
            if kind < 0.3:
                b[at] = "x"
            elif kind < 0.65:
                b.insert(at, "y")
            else:
                b.pop(at)
        pairs.append((n, "".join(a), "".join(b)))
    rows = spark.createDataFrame(pairs, "n int, a string, b string")
    shared = F.size(F.array_intersect(linededup.segment_keys(F.col("a")), linededup.segment_keys(F.col("b")))) > 0
    close = linededup.difference(linededup.counts(F.col("a")), linededup.counts(F.col("b"))) <= 4
    assert rows.where(~(shared & close & linededup.near(F.col("a"), F.col("b")))).count() == 0


def test_line_dedup_with_null_ids_repeated_rows_and_clashing_columns(spark):
    draw = random.Random(17)
    lines = ["".join(draw.choice("abcdefgh ") for _ in range(60)) for _ in range(12)]
    rows = [(None, "\n".join(lines[:3]), 1, "x")] * 2 + [(None, "\n".join(lines[3:6]), 2, "y"), (None, None, 3, "z"), (4, lines[6] + "\n" + lines[0], 4, "w"), (4, lines[7], 5, "v"), (9, lines[8] * 400, 6, "u"), (10, lines[8] * 400 + "q", 7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int, doc string")
    got = sorted(((r.doc.key, r.doc.doc, r.text) for r in linededup.dedup_lines(docs).collect()), key=str)
    rest = "\n".join(lines[1:3])
    assert got == sorted([(1, "x", rest), (1, "x", rest), (2, "y", "\n".join(lines[3:6])), (3, "z", None), (4, "w", lines[6] + "\n" + lines[0]), (5, "v", lines[7]), (6, "u", lines[8] * 400), (7, None, "")], key=str)
    assert linededup.dedup_lines(docs.limit(0)).count() == 0


def test_near_copies_that_share_hot_shingles_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "RUN", 4)
    monkeypatch.setattr(simhash, "CHUNK", 6)
    draw = random.Random(41)
    words = ["".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(2000)]
    passage = [draw.choice(words) for _ in range(90)]
    rows = []
    for _ in range(40):
        own = [draw.choice(words) for _ in range(draw.choice([2, 12, 60, 150]))]
        text = own + passage
        changed = list(text)
        for at in draw.sample(range(len(text)), 2):
            changed[at] = draw.choice(words)
        rows += [" ".join(text), " ".join(changed), " ".join(passage + own)]
    rows = list(enumerate(rows + ["", " ", "one two", "one two"]))
    for few in (400_000, 0):
        monkeypatch.setattr(simhash, "MAX_BROADCAST_IDS", few)
        got = {r.id: r.component for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == brute_near(rows)


def test_fingerprint_is_the_majority_of_hash_bits():
    import xxhash

    draw = random.Random(42)
    for n in (0, 1, 2, 3, 4, 50):
        words = [draw.choice(["Aa", "b", "C", "dé", "È"]) for _ in range(n)]
        text = draw.choice([" ", "\t", "\r\n "]).join(words)
        lowered = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words]
        grams = [" ".join(lowered[k : k + 3]) for k in range(max(1, n - 2))] if n else []
        values = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
        want = sum(1 << bit for bit in range(64) if 2 * sum(v >> bit & 1 for v in values) > len(values))
        assert int.from_bytes(simhash.fingerprint(text), "little") == want


def test_a_large_group_of_near_copies_lists_few_pairs(spark, monkeypatch):
    """As many pairs as texts a round, not all pairs of the group."""
    draw, seen, verified = random.Random(51), [], simhash._verified_links
    words = ["".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    base, rows = [draw.choice(words) for _ in range(150)], []
    for n in range(90):
        text = list(base)
        text[draw.randrange(150)] = draw.choice(words)  # any two are at 0.87 or more
        rows.append((n, " ".join(text)))

    def counted(texts, found, links, *more):
        seen.append(links.count())
        return verified(texts, found, links, *more)

    monkeypatch.setattr(simhash, "_verified_links", counted)
    got = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.id: r.component for r in got} == brute_near(rows)
    # after the first, the links of fingerprints
    assert sum(seen[1:]) <= 2 * len(rows), seen


def test_texts_below_the_similarity_list_few_pairs(spark, monkeypatch):
    """Most share first shingles that sizes and places allow, and are no near copies; sketches part them, in runs and in chunks."""
    draw, seen, verified = random.Random(52), [], simhash._verified_links
    words = ["".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    base, rows = [draw.choice(words) for _ in range(150)], []
    for _ in range(60):
        text = list(base)
        for at in draw.sample(range(150), 10):
            text[at] = draw.choice(words)
        rows.append(" ".join(text))
    rows += [" ".join(x.split()[:-1]) for x in rows[:5]]
    rows = list(enumerate(rows))

    def counted(texts, found, links, *more):
        seen.append(links.count())
        return verified(texts, found, links, *more)

    monkeypatch.setattr(simhash, "_verified_links", counted)
    want = brute_near(rows)
    assert len(set(want.values())) == 60
    for run in (256, 8):
        monkeypatch.setattr(simhash, "RUN", run)
        seen.clear()
        got = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r.id: r.component for r in got} == want
        assert sum(seen[1:]) <= len(rows), seen


def test_sketches_differ_in_no_more_bits_than_sets_in_shingles():
    draw = np.random.default_rng(53)
    for many in (0, 1, 5, 100, 3000):
        a = np.unique(draw.integers(-(2**63), 2**63 - 1, many))
        for other in (0, 1, 7, 400):
            b = np.unique(np.concatenate([a[: len(a) - other // 2], draw.integers(-(2**63), 2**63 - 1, other)]))
            x, y = (np.frombuffer(simhash.sketch(v), np.uint8) for v in (a, b))
            assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))
