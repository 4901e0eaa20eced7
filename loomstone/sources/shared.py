"""Folders that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a local session gets a folder of its own; a cluster is an error."""
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not held:
        held = spark.sparkContext.getCheckpointDir()
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        held = "file://" + tempfile.mkdtemp(prefix="loomstone-")
        spark.sparkContext.setCheckpointDir(held)
    return held.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder there, deleted when the driver ends."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return at.toString()


def store(rows: DataFrame, name: str) -> DataFrame:
    """The rows written there and read back: worked out once, and read again by tasks whose executor was lost."""
    path = f"{scratch(rows.sparkSession, name)}/rows"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
