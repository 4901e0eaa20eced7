"""A stream's sink that holds each batch once, however often it is played.

Spark plays a batch again when a run stopped before it was acknowledged, with the
same number and the same rows. A batch is written to a folder of its number, in
place of what an unfinished try has left there, and counts once its entry
stands in the log. Readers see the folders that have an entry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from loomstone.shipping import ship
from loomstone.sources.sinks import write_text


class BatchLog:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _entry(self, batch: int) -> str:
        return f"{self.folder}/log/{batch:012d}"

    def batches(self) -> list[int]:
        """Numbers of the batches that count."""
        at = self._path(f"{self.folder}/log")
        return sorted(int(f.getPath().getName()) for f in self._files.listStatus(at) if f.getPath().getName().isdigit()) if self._files.exists(at) else []

    def write(self, rows: DataFrame, batch: int) -> bool:
        """The rows of a batch; False, and nothing done, if it already counts."""
        if self._files.exists(self._path(self._entry(batch))):
            return False
        rows.write.mode("overwrite").parquet(f"{self.folder}/rows/{batch:012d}")
        self.enter(batch)
        return True

    def enter(self, batch: int) -> None:
        write_text(self.spark, self._entry(batch), "")

    def read(self, schema: object) -> DataFrame:
        """All rows of batches that count."""
        held = [f"{self.folder}/rows/{b:012d}" for b in self.batches()]
        return self.spark.read.schema(schema).parquet(*held) if held else self.spark.createDataFrame([], schema)

    def start(self, rows: DataFrame, **options: object) -> StreamingQuery:
        """The stream into this log; its progress is kept beside it, so a later start goes on where this one stopped."""
        ship(self.spark)
        writer = rows.writeStream.foreachBatch(lambda part, batch: self.write(part, batch) and None)
        return writer.option("checkpointLocation", f"{self.folder}/progress").trigger(**options or {"availableNow": True}).start()
