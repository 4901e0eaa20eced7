"""Streamed replies that end: by their end mark, or when nothing came for a time.

As ``latch``, a reply is held back once it quotes a figure. Its fragments are a list in
keyed state to which new ones are appended, so a batch writes what is new and not
the text so far; beside it stand the last characters, in which a match may begin. A
timer in event time ends a reply whose end mark never came: its text is emitted
as final with ``expired``, and its state goes. A reply whose next fragment comes
later than that counts as a new one, whether or not the timer had fired, so the
result does not depend on how the stream was cut into batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from loomstone.functions import fixed
from loomstone.streaming.latch import REACH, SLOT, matcher

COLUMNS = ["reply_id", "seq", "piece", "final", "expired"]
MARK = "seq long, held boolean, tail string, at long"


def _rows(out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=COLUMNS).astype({"seq": "int64", "final": "bool", "expired": "bool"})


class TimedLatch(StatefulProcessor):
    """Per reply: a row for each fragment, with the fragment as long as it may be shown, and one with the whole text at the end."""

    def __init__(self, pattern: str, ttl_us: int) -> None:
        self.pattern, self.ttl = matcher(pattern), ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getListState("parts", "text string")
        self.mark = handle.getValueState("mark", MARK)

    def _whole(self, new: list[str]) -> str:
        held = [p[0] for p in self.parts.get()] if self.mark.exists() else []
        return SLOT.sub(r"\1", "".join(held + new))

    def _drop(self) -> None:
        self.parts.clear()
        self.mark.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        seq, held, tail, last = self.mark.get() if self.mark.exists() else (None, False, "", None)
        out, new = [], []
        for row in pd.concat(list(rows)).sort_values(["at", "seq"]).itertuples():
            if last is not None and row.at - last > self.ttl:
                out.append((key[0], seq, self._whole(new), True, True))
                self._drop()
                new, held, tail = [], False, ""
            token = row.token or ""
            tail += token
            held = held or bool(self.pattern.search(tail, max(0, len(tail) - len(token) - REACH)))
            tail, seq, last = tail[-REACH - 1 :], row.seq, row.at
            new.append(token)
            out.append((key[0], seq, "" if held else token, False, False))
            if row.end:
                out.append((key[0], seq, self._whole(new), True, False))
                self._drop()
                new, held, tail, last = [], False, "", None
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        if last is not None:
            if new:
                self.parts.appendList([(t,) for t in new])
            self.mark.update((seq, held, tail, last))
            # Timers count milliseconds: the first that lies after the time to live.
            self.handle.registerTimer((last + self.ttl) // 1000 + 1)
        yield _rows(out)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        out = []
        if self.mark.exists():
            out.append((key[0], self.mark.get()[0], self._whole([]), True, True))
            self._drop()
        yield _rows(out)

    def close(self) -> None:
        pass


def timed_stream(fragments: DataFrame, ttl: int, delay: str, pattern: str = fixed.FIGURE) -> DataFrame:
    """The stream over (reply_id, seq, ts, token, end): rows ``COLUMNS``. ``ttl`` is in seconds, ``delay`` an interval like '2 hours'.

    Fragments older than the newest by more than ``delay`` may be dropped. A
    reply's fragments count in the order of ts, then seq; null tokens are empty,
    a null reply_id is one reply, a null ts or end mark is an error of the source.
    """
    kind = dict(fragments.dtypes)["reply_id"]
    rows = fragments.select("reply_id", "seq", "ts", "token", "end", F.unix_micros("ts").alias("at")).withWatermark("ts", delay)
    out = f"reply_id {kind}, seq long, piece string, final boolean, expired boolean"
    return rows.groupBy("reply_id").transformWithStateInPandas(TimedLatch(pattern, ttl * 1_000_000), out, "Append", "EventTime")


def ended(fragments: DataFrame, ttl: int, until: object) -> DataFrame:
    """The batch form of the final rows: (reply_id, seq, chars, expired), as if the stream had seen event time ``until``.

    Replies that are still open then have no row.
    """
    w = Window.partitionBy("reply_id").orderBy("ts", "seq")
    gap = F.expr(f"ts > previous + INTERVAL {ttl} SECONDS")
    rows = fragments.withColumn("previous", F.lag("ts").over(w)).withColumn("closed", F.lag("end").over(w))
    rows = rows.withColumn("part", F.sum(F.when(F.coalesce("closed", F.lit(False)) | F.coalesce(gap, F.lit(False)), 1).otherwise(0)).over(w))
    group = rows.groupBy("reply_id", "part").agg(
        F.max_by("seq", F.struct("ts", "seq")).alias("seq"), F.max("ts").alias("last"), F.bool_or("end").alias("marked"), F.sum(F.char_length(F.coalesce("token", F.lit("")))).alias("chars")
    )
    newest = group.withColumn("newest", F.max("part").over(Window.partitionBy("reply_id")))
    over = F.col("marked") | (F.col("part") < F.col("newest")) | (F.expr(f"last + INTERVAL {ttl} SECONDS") < F.lit(until))
    return newest.where(over).select("reply_id", "seq", "chars", (~F.col("marked")).alias("expired"))
