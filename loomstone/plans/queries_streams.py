"""Queries of streams that end and of sinks that don't repeat, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.plans.queries import query, read
from loomstone.sources.shared import scratch
from loomstone.streaming import latch, timed
from loomstone.streaming.commits import BatchLog

TTL, DELAY = 12 * 3600, "1 hour"


def _fragments(events):
    """Events of a user as fragments of replies, of which a purchase is the end."""
    # The table's times have no zone: they count as UTC, whatever the session's zone is.
    ts = F.timestamp_micros(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")).alias("ts")
    return events.select(F.col("user_id").alias("reply_id"), F.col("event_id").alias("seq"), ts, F.concat("event_type", F.lit(" ")).alias("token"), (F.col("event_type") == "purchase").alias("end"))


def _stream(spark, sf_dir):
    # A stream's path is a folder or a pattern; as a pattern it may be one file as well.
    return spark.readStream.schema(read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")


@query("""
    WITH e AS (SELECT user_id, event_id, ts, event_type, lag(ts) OVER w AS before, lag(event_type) OVER w AS left_by FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    p AS (SELECT *, sum(CASE WHEN left_by = 'purchase' OR ts > before + INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS part FROM e),
    g AS (
        SELECT user_id, part, arg_max(event_id, (ts, event_id)) AS seq, max(ts) AS last, bool_or(event_type = 'purchase') AS marked, string_agg(event_type || ' ', '' ORDER BY ts, event_id) AS text
        FROM p GROUP BY user_id, part
    ),
    n AS (SELECT *, max(part) OVER (PARTITION BY user_id) AS newest, (SELECT max(ts) FROM events) - INTERVAL 1 HOUR AS until FROM g)
    SELECT user_id AS reply_id, seq, text AS piece, NOT marked AS expired FROM n WHERE marked OR part < newest OR last + INTERVAL 12 HOUR < until
""")
def stream_timeouts(spark, sf_dir):
    """Whole replies of a stream: those with an end mark, and those that a timer ended since nothing came for twelve hours."""
    found = latch.run_available(spark, timed.timed_stream(_fragments(_stream(spark, sf_dir)), TTL, DELAY), "timeouts")
    return found.where("final").select("reply_id", "seq", "piece", "expired")


class Stopped(RuntimeError):
    """The end of a run between a batch's rows and its entry."""


@query("SELECT user_id::VARCHAR AS trace_id, event_id AS seq, event_type AS name, props AS input, value FROM events")
def replayed_log(spark, sf_dir):
    """The event log of a stream whose run stops after a batch is written and before it counts, and is started again: each row once."""
    log = BatchLog(spark, scratch(spark, "log"))
    rows = _stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("trace_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("name"), F.col("props").alias("input"), "value")
    enter = log.enter

    def stop(batch: int) -> None:
        raise Stopped(f"batch {batch}")

    log.enter = stop
    run = log.start(rows)
    try:
        run.awaitTermination()
    except Exception as e:  # noqa: BLE001  Spark wraps what the sink raised
        if "Stopped" not in str(e):
            raise
    if log.batches():
        raise AssertionError("a batch counts that was stopped")
    log.enter = enter
    log.start(rows).awaitTermination()
    # Played once more, the batch does nothing.
    log.write(log.read(rows.schema), log.batches()[0])
    return log.read(rows.schema)
