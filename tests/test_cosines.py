import duckdb
import numpy as np

from quillgraph.functions import cosines
from quillgraph.queries import ORACLES, QUERIES


def test_block_topk_of_odd_vectors_in_several_chunks(spark, tmp_path, monkeypatch):
    draw = np.random.default_rng(3)
    rows = [(n, n % 3, [float(x) for x in draw.normal(0, 1, 4)]) for n in range(200)]
    rows += [(n, 0, rows[40][2]) for n in (300, 320, 301)]  # copies
    rows += [(340, 1, [0.0] * 4), (341, 1, [0.0] * 4), (360, 2, None), (361, 2, None), (380, None, [1.0] * 4), (400, 7, None), (401, 7, [1.0] * 4), (None, 7, [1.0] * 4)]
    rows += [(420, 8, [1.0, 0.0, 0.0, 0.0]), (421, 8, None), (440, 9, None), *[(441 + n, 9, [1.0, 0.0, 0.0, float(n)]) for n in range(6)]]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(cosines, "CHUNK", 16)
    monkeypatch.setattr(cosines, "ASKED", 2)
    got = QUERIES["block_topk"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.sql(ORACLES["block_topk"]).fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert {x[0] for x in want} >= {340, 360, 400, 420, 440}
