import random

import pytest

import corpus_pipeline
from quillgraph.llm import linededup, mixing, pieces, quality, simhash


def make(spark, folder):
    draw = random.Random(11)
    words = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for n in range(80):
        lines = [" ".join(draw.choice(words) for _ in range(40)) for _ in range(3)]
        bad = n % 8 == 0
        if bad:
            lines = [" ".join(w + draw.choice(["###", "%%%"]) for w in line.split()) for line in lines]
        rows.append((n, "\n".join(["shared boilerplate of all the documents here", *lines]), "en", f"s{n % 3}", None))
        labels.append((n, int(not bad), 0))
    rows.append((500, rows[1][1], "en", "s1", 3))
    rows += [(600, None, None, None, None), (601, "", "en", "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_stages_in_order(spark, tmp_path):
    assert [f for _, f in corpus_pipeline.STAGES] == [quality.stage_quality, linededup.stage_line_dedup, simhash.stage_near_dedup, mixing.stage_mixing, pieces.stage_encode]
    rows = make(spark, tmp_path)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if n < 4:
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/out{n}")
        docs = spark.read.parquet(f"{tmp_path}/out{n}")
        seen.append(docs.collect())
    kept = {r.doc_id for r in seen[0]}
    good = {r[0] for r in rows if r[0] < 80 and r[0] % 8}
    assert len(good - kept) <= 2 and not [n for n in kept if n < 80 and n % 8 == 0]
    texts = {r.doc_id: r.text for r in seen[1]}
    assert sum("shared boilerplate" in (t or "") for t in texts.values()) == 1
    # 500 is a copy of 1: nothing is left of it after line dedup, and it goes there at the latest
    assert 500 not in {r.doc_id for r in seen[2]}
    assert all(r.round_trip for r in seen[4]) and len(seen[4]) == len(seen[3])


def test_run(spark, tmp_path):
    make(spark, tmp_path)
    assert set(corpus_pipeline.run(spark, str(tmp_path)).columns) == {"doc_id", "n_ids", "ids", "round_trip"}


@pytest.mark.parametrize("n", range(5))
def test_stages_take_an_empty_table(spark, tmp_path, n):
    make(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    assert corpus_pipeline.STAGES[n][1](spark, docs, str(tmp_path)).count() == 0
