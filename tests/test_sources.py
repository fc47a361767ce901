import json

from pyspark.sql import functions as F

from quillgraph.operators import documents, ranking
from quillgraph.sources import files
from quillgraph.streaming.upserts import SnapshotTable


def test_spreadsheet_round_trip(spark, tmp_path):
    files.write_xlsx([["name", "note"], ["泵", " a<b "], ["阀", None]], str(tmp_path / "x.xlsx"))
    got = {r.row: r.record for r in files.read_records(spark, str(tmp_path)).collect()}
    assert got == {2: {"name": "泵", "note": "a<b"}, 3: {"name": "阀"}}
    assert [files.column_name(n) for n in (1, 26, 27, 703)] == ["A", "Z", "AA", "AAA"]


def test_encodings(spark, tmp_path):
    for n, raw in enumerate(("泵".encode("gb18030"), "泵".encode("utf-8-sig"), "泵".encode())):
        (tmp_path / f"{n}.txt").write_bytes(raw)
    assert [r.text for r in files.read_texts(spark, str(tmp_path)).collect()] == ["泵"] * 3


def test_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text("﻿name , note\n a ,b \n", "utf-8")
    rows = files.read_csv(spark, str(tmp_path / "x.csv"))
    assert rows.columns == ["name", "note"] and tuple(rows.first()) == ("a", "b")


def test_payload_and_faults(spark, tmp_path):
    payload = {"entities": [{"id": "a", "name": "A"}, {"id": "a", "name": ""}], "relations": [{"id": "r", "name": "R"}], "triples": [{"subject_id": "a", "predicate_id": "r", "object_id": "gone"}]}
    (tmp_path / "p.json").write_text(json.dumps(payload))
    parts = files.read_payload(spark, str(tmp_path / "p.json"))
    assert parts[2].first().id == "triple:0"
    assert {tuple(r) for r in files.payload_faults(*parts).collect()} == {("blank entity", "a"), ("repeated entity", "a"), ("unknown object_id", "triple:0")}


def test_snapshot(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"id": "a", "name": "A", "type": "t"}], "edges": [{"source": "a", "target": "a", "type": "r"}]}))
    nodes, edges = files.read_snapshot(spark, str(tmp_path / "g.json"))
    assert nodes.count() == edges.count() == 1


def test_stream_of_upserts(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "1.json").write_text('{"id": 1, "name": "a", "n": 1}\n{"id": 1, "name": "b", "n": 2}\n')
    table = SnapshotTable(spark, str(tmp_path / "t"), "id", "id int, name string, n int")
    stream = lambda: spark.readStream.schema("id int, name string, n int").json(str(inbox))
    table.follow(stream(), "n", str(tmp_path / "c")).awaitTermination()
    (inbox / "2.json").write_text('{"id": 1, "name": "c", "n": 3}\n{"id": 2, "name": "d", "n": 4}\n')
    table.follow(stream(), "n", str(tmp_path / "c")).awaitTermination()
    assert {(r.id, r.name) for r in table.current().collect()} == {(1, "c"), (2, "d")}
    assert {(r.id, r.name) for r in table.undone().collect()} == {(1, "b")}


def test_scores(spark):
    row = spark.range(1).select(ranking.recall_score(*[F.lit(x) for x in (1.0, 1.0, 1.0, 1.0, -1.0)]).alias("a"), ranking.chain_score(*[F.lit(x) for x in (1.0, 1.0, 1.0, 1.0, 1.0, 0.2)]).alias("b")).first()
    assert abs(row.a - 0.5) < 1e-9 and abs(row.b - 0.8) < 1e-9
    nodes = spark.createDataFrame([("a", ["x", "y"]), ("b", ["x", "y"]), ("c", ["z"])], "id string, keys array<string>")
    assert [tuple(r) for r in ranking.block_pairs(nodes, F.col("keys")).collect()] == [("a", "b")]


def test_documents(spark):
    docs = spark.createDataFrame([("d", "短。这一段文字足够长了；目录........12\n额定压力为12.5MPa，质量：3 kg")], "id string, t string")
    row = docs.select(documents.paragraphs(F.col("t")).alias("p"), documents.figures(F.col("t")).alias("f")).first()
    assert len(row.p) == 2
    assert {(f.name, f.value, f.unit) for f in row.f} == {("额定压力", 12.5, "MPa"), ("质量", 3.0, "kg")}
    assert documents.figure_triples(docs, "id", "t").count() == 2
