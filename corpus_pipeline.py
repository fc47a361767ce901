"""A training-data pipeline over `documents`: quality, line dedup, near-dedup, mixing, encoding.

Each stage works on all its predecessor kept and is written as Parquet in the shared folder, so a lost executor costs
the stage it was in at most. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm.linededup import stage_line_dedup
from quillgraph.llm.mixing import stage_mixing
from quillgraph.llm.pieces import stage_encode
from quillgraph.llm.quality import stage_quality
from quillgraph.llm.simhash import stage_near_dedup
from quillgraph.session import ensure_checkpoint_dir

STAGES = [
    ("quality classifier", stage_quality),
    ("line dedup", stage_line_dedup),
    ("SimHash near-dedup", stage_near_dedup),
    ("mixing sources to target weights", stage_mixing),
    ("SentencePiece encoding and decoding", stage_encode),
]

#: The classifier is fitted and the pieces have no SQL form; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        rows = stage(spark, docs, sf_dir)
        if n == len(STAGES) - 1:
            return rows
        rows.write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
    raise ValueError("no stages")
