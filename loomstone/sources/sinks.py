"""Sinks: JSON lines, reports, baselines, metric and event logs."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = "run string, key string, value double, step long, ts double"
EVENTS = "trace_id string, seq long, name string, input string, output string, metadata string"


def write_jsonl(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object a row, columns in order, nulls and characters beyond ASCII kept."""
    rows.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_once(rows: DataFrame, path: str) -> None:
    """A sample table, left alone if it is there."""
    rows.write.mode("ignore").parquet(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file through Spark's file systems, so that the path may be remote."""
    jvm = spark.sparkContext._jvm
    to = jvm.org.apache.hadoop.fs.Path(path)
    out = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(to, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_report(scored: DataFrame, mode: str, folder: str) -> int:
    """JSON of all results and a Markdown summary (per topic, failures); returns the number passed.

    Results are one row per evaluation case, a table of hand-written size.
    """
    spark = scored.sparkSession
    results = [r.asDict(recursive=True) for r in scored.orderBy("id").toLocalIterator()]
    passed = sum(r["passed"] for r in results)
    write_text(spark, f"{folder}/report.json", json.dumps(results, indent=2, ensure_ascii=False))
    topics: dict[str, list[bool]] = {}
    for r in results:
        topics.setdefault(r["topic"], []).append(r["passed"])
    lines = [f"# Evaluation: {passed}/{len(results)} passed", "", f"Mode: {mode}", "", "| Topic | Passed |", "|---|---|"]
    lines += [f"| {t} | {sum(v)}/{len(v)} |" for t, v in topics.items()]
    lines += ["", "## Failures", ""]
    for r in (r for r in results if not r["passed"]):
        lines += [f"**{r['id']}. {r['question']}**", "", f"> {r['answer']}", "", *(f"- {x}" for x in r["failures"]), ""]
    write_text(spark, f"{folder}/report.md", "\n".join(lines))
    return passed


def save_baseline(spark: SparkSession, value: float, folder: str) -> None:
    spark.createDataFrame([(float(value),)], "accuracy double").coalesce(1).write.mode("overwrite").json(f"{folder}/baseline")


def load_baseline(spark: SparkSession, folder: str) -> float:
    try:
        rows = spark.read.schema("accuracy double").json(f"{folder}/baseline").collect()
    except Exception as e:
        raise FileNotFoundError(f"no baseline in {folder}") from e
    if not rows:
        raise FileNotFoundError(f"no baseline in {folder}")
    return rows[0].accuracy


class Log:
    """Append-only metric and event tables in a folder. Without one, writing does nothing.

    A log that has a folder but no run name, or the other way round, is an
    error: half of a setting is most likely a mistake.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, run: str | None = None) -> None:
        if bool(folder) != bool(run):
            raise ValueError("a log needs both a folder and a run name, or neither")
        self.spark, self.folder, self.run = spark, folder, run
        self.trace_id, self.rows = uuid.uuid4().hex, []

    def metrics(self, values: dict, step: int = 0) -> None:
        if self.folder:
            rows = [(self.run, k, float(v), step, time.time()) for k, v in values.items()]
            self.spark.createDataFrame(rows, METRICS).coalesce(1).write.mode("append").parquet(f"{self.folder}/metrics")

    def event(self, name: str, input: object = None, output: object = None, metadata: object = None) -> None:
        if self.folder:
            self.rows.append((self.trace_id, len(self.rows), name, *(json.dumps(x, ensure_ascii=False) if x is not None else None for x in (input, output, metadata))))

    def flush(self) -> None:
        if self.folder and self.rows:
            self.spark.createDataFrame(self.rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{self.folder}/events")
            self.rows = []


@contextmanager
def trace(log: Log, name: str) -> Iterator[Log]:
    """One trace around a run; its events are written at the end, also after an error."""
    log.event(name)
    try:
        yield log
    finally:
        log.flush()


def summary(rows: DataFrame, header: str) -> DataFrame:
    """One row: rows, with_context, verified (context starts with the header), intents."""
    return rows.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("context") != "").alias("with_context"),
        F.count_if(F.col("context").startswith(header)).alias("verified"),
        F.countDistinct("intent").alias("intents"),
    )
