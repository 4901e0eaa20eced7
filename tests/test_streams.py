"""Streams that end by time, and a sink that holds a batch once."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from loomstone.shipping import ship
from loomstone.streaming import latch, timed
from loomstone.streaming.commits import BatchLog

START = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)
FRAGMENTS = "reply_id string, seq long, ts timestamp, token string, end boolean"


def fragment(reply, seq, minute, token, end=False):
    return (reply, seq, START + dt.timedelta(minutes=minute), token, end)


#: Replies that end by mark, by time, by a later fragment, and not at all.
ROWS = [
    fragment("a", 1, 0, "Fee is "), fragment("a", 2, 1, "PKR 4,"), fragment("a", 3, 2, "000 {{now}}.", True), fragment("b", 1, 3, "no "), fragment("b", 2, 4, None), fragment("b", 3, 5, "end"),
    fragment("c", 1, 6, "first"), fragment("c", 2, 40, "second", True), fragment("d", 1, 10, "x"), fragment("d", 2, 21, "y"), fragment("d", 3, 33, "z"), fragment(None, 1, 50, "open"), fragment("e", 1, 60, "late"),
]


def run(spark, tmp_path, rows, files):
    """The stream over ``rows`` in ``files`` batches; its rows and the numbers of its state's rows."""
    ship(spark)
    step = math.ceil(len(rows) / files)
    for i in range(files):
        folder = f"{tmp_path}/in/{i}"
        spark.createDataFrame(rows[i * step : (i + 1) * step], FRAGMENTS).coalesce(1).write.parquet(folder)
    source = spark.readStream.schema(FRAGMENTS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    spark.conf.set(latch.STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = timed.timed_stream(source, 600, "1 minute").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
    finally:
        spark.conf.unset(latch.STORE)
    query.awaitTermination()
    progress = [json.loads(p.json) if hasattr(p, "json") else p for p in query.recentProgress]
    return spark.read.parquet(f"{tmp_path}/out").collect(), [p["stateOperators"][0]["numRowsTotal"] for p in progress]


FINAL = [("a", 3, "Fee is PKR 4,000 now.", False), ("b", 3, "no end", True), ("c", 1, "first", True), ("c", 2, "second", False), ("d", 1, "x", True), ("d", 2, "y", True), ("d", 3, "z", True)]


@pytest.mark.parametrize("files", [1, 4])
def test_replies_end_by_mark_or_by_time(spark, tmp_path, files):
    out, held = run(spark, tmp_path, ROWS, files)
    assert sorted((r.reply_id, r.seq, r.piece, r.expired) for r in out if r.final) == FINAL
    pieces = sorted(((r.reply_id or "", r.seq, r.piece) for r in out if not r.final))
    # the figure is held back from where it begins to show
    assert pieces[:4] == [("", 1, "open"), ("a", 1, "Fee is "), ("a", 2, ""), ("a", 3, "")] and len(pieces) == len(ROWS)
    # two replies are open at the end: their fragment, mark and timer, and no more
    assert held[-1] < held[0] if files == 1 else held[-1] <= 10


def test_batch_form_gives_the_same_ends(spark):
    rows = spark.createDataFrame(ROWS, FRAGMENTS)
    until = START + dt.timedelta(minutes=59)
    got = sorted((r.reply_id, r.seq, r.chars, r.expired) for r in timed.ended(rows, 600, until).collect())
    chars = {"Fee is PKR 4,000 now.": 25}  # slots are still in the text
    assert got == [(i, s, chars.get(t, len(t)), e) for i, s, t, e in FINAL]


def test_a_batch_played_twice_counts_once(spark, tmp_path):
    log = BatchLog(spark, f"file://{tmp_path}/log")
    rows = spark.range(5)
    assert log.batches() == [] and log.read("id long").count() == 0
    assert log.write(rows, 0) and not log.write(rows, 0)
    log.enter, enter = lambda b: (_ for _ in ()).throw(OSError("stopped")), log.enter
    with pytest.raises(OSError):
        log.write(rows.where("id < 2"), 1)
    assert log.batches() == [0] and log.read("id long").count() == 5
    log.enter = enter
    assert log.write(rows.where("id < 3"), 1)
    assert sorted(r.id for r in log.read("id long").collect()) == [0, 0, 1, 1, 2, 2, 3, 4]
    assert log.write(rows.where("false"), 2) and log.batches() == [0, 1, 2]


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    log = BatchLog(spark, f"file://{tmp_path}/log")
    spark.range(3).write.parquet(f"{tmp_path}/in/a")
    source = spark.readStream.schema("id long").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    log.start(source).awaitTermination()
    spark.range(10, 12).write.parquet(f"{tmp_path}/in/b")
    log.start(source).awaitTermination()
    assert sorted(r.id for r in log.read("id long").collect()) == [0, 1, 2, 10, 11] and len(log.batches()) == 2
    assert log.read("id long").select(F.sum("id")).head()[0] == 24
