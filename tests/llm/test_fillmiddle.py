import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import fillmiddle


def brute(id_, text, unit=r"[^\n]*\n|[^\n]+", rate=100, spm=50):
    text = text or ""
    units = re.findall(unit, text)
    digest = hashlib.sha256(f"7:{'' if id_ is None else id_}".encode()).hexdigest()
    h = [int(digest[8 * n : 8 * n + 8], 16) for n in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    pre, mid, suf = ("".join(part) for part in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def texts():
    draw = random.Random(11)
    parts = ["\n", "\n\n", "é", "line\n", "a b", "日本語\n", "x" * 130, "\r\n", "<", "S>", "😀"]
    rows = [(n, "".join(draw.choice(parts) for _ in range(draw.randint(0, 60)))) for n in range(150)]
    rows += [(900, None), (901, ""), (902, "one <P> mark"), (903, "\n" * 700), (904, "no line end"), (None, "null id\nhere"), (905, "x" * 5000 + "\n" + "ü" * 3000), (905, "x" * 5000 + "\n" + "ü" * 3000)]
    return rows + [(1000 + n, "row %d\n" % n * draw.randint(200, 900)) for n in range(4)]


@pytest.mark.parametrize(("giant", "chunk"), [(fillmiddle.GIANT, fillmiddle.CHUNK), (40, 64)])
def test_outputs_match_brute_force(spark, giant, chunk):
    rows = texts()
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, form int, output string")
    got = fillmiddle.fill_in_middle(docs, giant=giant, chunk=chunk)
    back = fillmiddle.restored(F.col("output"), F.col("form")).alias("back")
    found = sorted(map(str, ((r.doc.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got.collect())))
    assert found == sorted(map(str, ((i, *brute(i, t)) for i, t in rows)))
    assert got.select(F.coalesce("doc.text", F.lit("")).alias("text"), back).where("text <> back").count() == 0


def test_words_as_units_and_rates(spark):
    rows = [(n, (t or "").lstrip(" \t\n\v\f\r")) for n, t in texts()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for giant in (fillmiddle.GIANT, 0):
        got = fillmiddle.fill_in_middle(docs, automaton=fillmiddle.WORDS, rate=60, spm=20, giant=giant, chunk=50)
        found = sorted(map(str, ((r.doc.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got.collect())))
        # white space as the automaton sees it
        assert found == sorted(map(str, ((i, *brute(i, t, r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", 60, 20)) for i, t in rows)))


def test_composition_is_associative_and_equals_a_walk():
    draw = np.random.default_rng(3)
    data = draw.choice(np.frombuffer(b"ab \n", np.uint8), 3000)
    for automaton in (fillmiddle.LINES, fillmiddle.WORDS):
        classes, steps, begins = automaton.tables()
        states = len(automaton.steps[0])
        for block in (1, 16, 999, 4000):
            scan = fillmiddle.Scan(automaton, data, np.array([len(data)]), block)
            ends, counts = fillmiddle.composed(*scan.functions(), np.zeros(scan.cells.shape[1], np.int64))
            for start in range(states):
                state, seen = start, 0
                for byte in data:
                    at = classes[byte] * states + state
                    state, seen = steps[at], seen + begins[at]
                assert (ends[-1, start], counts[-1, start]) == (state, seen)


def test_very_long_text_and_empty_batch():
    text = "ab\n" * 200_000
    n, a, b = fillmiddle.located(fillmiddle.LINES, pa.array([text, "", "q"]), np.array([5, 1, 1]), np.array([199_999, 0, 0]))
    assert (n.tolist(), a.tolist(), b.tolist()) == ([200_000, 0, 1], [15, 0, 0], [599_997, 0, 1])
    assert [len(x) for x in fillmiddle.located(fillmiddle.LINES, pa.array([], pa.string()), np.empty(0, np.int64), np.empty(0, np.int64))] == [0, 0, 0]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert fillmiddle.fill_in_middle(docs).count() == 0
