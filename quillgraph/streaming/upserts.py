"""Incremental upserts: a stream of rows is merged into numbered snapshots, each batch at most once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgraph.operators.changes import change_log, rollback, upsert


class SnapshotTable:
    """Snapshots and change logs under one folder: state/batch=n and log/batch=n.

    A batch that is run again writes the same folders over, from the snapshot before it, so replays change nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, schema: str) -> None:
        self.spark, self.folder, self.key, self.schema = spark, folder, key, schema

    def _batches(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/state")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        done = [s.getPath() for s in files.listStatus(path)]
        marker = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(p.getName().removeprefix("batch=")) for p in done if files.exists(marker(p, "_SUCCESS")))

    def current(self, before: int | None = None) -> DataFrame:
        known = [n for n in self._batches() if before is None or n < before]
        if not known:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/state/batch={known[-1]}")

    def merge(self, rows: DataFrame, batch: int, order: str) -> None:
        """Of the batch's rows of one key the last by `order` counts."""
        last = Window.partitionBy(self.key).orderBy(F.desc(order))
        rows = rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n").select(*self.current(batch).columns)
        old = self.current(batch)
        change_log(old, rows, self.key).write.mode("overwrite").parquet(f"{self.folder}/log/batch={batch}")
        upsert(old, rows, self.key).write.mode("overwrite").parquet(f"{self.folder}/state/batch={batch}")

    def undone(self) -> DataFrame:
        """The state before the newest batch, by its log."""
        newest = self._batches()[-1]
        return rollback(self.current(), self.spark.read.parquet(f"{self.folder}/log/batch={newest}"), self.key)

    def follow(self, stream: DataFrame, order: str, checkpoint: str) -> StreamingQuery:
        """Merges all that is there by now and stops."""
        writer = stream.writeStream.foreachBatch(lambda rows, n: self.merge(rows, n, order))
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
