"""Shared helpers: reading tables, tables in the shared folder, text casts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.shipping import map_arrow
from loomstone.sources.shared import shared_dir

__all__ = ["SPACE_CLASS", "as_bytes", "discard", "drawn_share", "fresh", "joined_small", "let", "map_arrow", "read", "shared_dir", "store", "text_or_empty"]

#: Spark deletes a query's shuffle files at its end where this is set.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows of a few short columns that may be broadcast: some tens of megabytes.
BROADCAST_ROWS = 1 << 18

#: Characters that separate words in most contracts: space, tab, LF, VT, FF, CR.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"


def read(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """One table of ``sf_dir``, only the named columns (all if none are named)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Lineage ends here: a lost executor costs at most the tasks that read the
    files again. The shuffle files of the write go when it is done, the table
    itself by ``discard`` or at the application's end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    at, files = _place(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def _place(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(*stored: DataFrame) -> None:
    """Delete stored tables that nothing to come reads."""
    for table in stored:
        at, files = _place(table.sparkSession, table._stored_at)
        files.delete(at, True)


def joined_small(rows: DataFrame, stored: DataFrame, on: list[str], how: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` joined with a stored table of few columns: broadcast if it has at most ``most`` rows, else by merging.

    The count comes from the files' footers. Both ways give the same rows; a
    merge join can be split where a key is hot.
    """
    few = stored.count() <= most
    return rows.join(F.broadcast(stored) if few else stored.hint("merge"), on, how)


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def as_bytes(col: str | Column = "text") -> Column:
    """UTF-8 of the text: Python splits and lower-cases ASCII in bytes without decoding."""
    return text_or_empty(col).cast("binary")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, inside a lambda as well."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drawn_share(key: Column, n: int, total: int) -> Column:
    """Condition that about 1.2 n of ``total`` rows meet, by their hash, so that a sample of n sorts few rows a task."""
    share = min(1.0, (1.2 * n + 50) / max(1, total))
    return F.pmod(key, F.lit(1 << 32)) <= int(share * (1 << 32))
