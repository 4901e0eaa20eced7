"""Streamed replies that are held back once they quote a figure, until they can be checked whole.

The text so far is held with a mark of whether the pattern has matched. The
pattern is tried on a new fragment and the ``REACH`` characters before it, so
each character is read a bounded number of times; a longer match counts once its
last ``REACH`` characters match by themselves. Batch form: a reply's fragments
in order, one after the other. Stream form: keyed state.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from loomstone.functions import fixed
from loomstone.shipping import map_arrow, ship
from loomstone.sources.shared import scratch

#: Characters before a fragment in which a match may begin.
REACH = 256
SLOT = re.compile(r"\{\{\s*([^{}]+?)\s*\}\}")
OUT = "reply_id string, seq long, text string, final boolean"


def matcher(pattern: str) -> re.Pattern:
    """The pattern as Spark's expressions read it: without case, classes of ASCII."""
    return re.compile(pattern, re.I | re.A)


def latch(fragments: DataFrame, pattern: str = fixed.FIGURE, with_text: bool = True) -> DataFrame:
    """(reply_id, seq, chars, shown, and text if asked for): the text so far, its length, and whether it may be shown as it stands.

    The pattern is tried on the text so far, so a figure split over fragments
    counts. Null fragments are empty, null replies are one reply; fragments of
    equal number stand in the order of their texts. The texts so far of a reply
    take the square of its length: without them a reply costs its length.
    """
    found = matcher(pattern)
    kinds = dict(fragments.dtypes)
    names = ["reply_id", "seq", "chars", "shown", *(["text"] if with_text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reply, text, tail, slots, size, held = object(), [], "", False, 0, False
        for b in batches:
            out = []
            for own, token in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if own != reply:
                    reply, text, tail, slots, size, held = own, [], "", False, 0, False
                token = token or ""
                tail += token
                held = held or bool(found.search(tail, max(0, len(tail) - len(token) - REACH)))
                slots = slots or "{{" in tail
                tail = tail[-REACH - 1 :]
                text.append(token)
                size += len(token)
                whole = SLOT.sub(r"\1", "".join(text)) if slots or with_text else None
                out.append((size if whole is None else len(whole), not held, *([whole] if with_text else [])))
            if out:
                types = [pa.int64(), pa.bool_(), *([pa.string()] if with_text else [])]
                cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=names)

    rows = fragments.select("reply_id", "seq", "token").repartition("reply_id").sortWithinPartitions("reply_id", "seq", "token")
    schema = f"reply_id {kinds['reply_id']}, seq {kinds['seq']}, chars long, shown boolean" + (", text string" if with_text else "")
    return rows.transform(map_arrow, run, schema)


class Latch(StatefulProcessor):
    """Per reply: emits the text so far while it quotes no figure; the end mark emits the whole text as final."""

    def __init__(self, pattern: str = fixed.FIGURE) -> None:
        self.pattern = matcher(pattern)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("reply", "text string, held boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        text, held = self.state.get() if self.state.exists() else ("", False)
        out = []
        for row in pd.concat(list(rows)).sort_values("seq").itertuples():
            before, text = len(text), text + (row.token or "")
            held = held or bool(self.pattern.search(text, max(0, before - REACH)))
            if row.end:
                out.append((key[0], row.seq, SLOT.sub(r"\1", text), True))
            elif not held:
                out.append((key[0], row.seq, SLOT.sub(r"\1", text), False))
            if row.end:
                text, held = "", False
        if text:
            self.state.update((text, held))
        else:
            self.state.clear()
        yield pd.DataFrame(out, columns=["reply_id", "seq", "text", "final"])

    def close(self) -> None:
        pass


def latch_stream(fragments: DataFrame, pattern: str = fixed.FIGURE) -> DataFrame:
    """The stream form over (reply_id, seq, token, end). Final rows are for the guard; the state of an ended reply is dropped."""
    return fragments.groupBy("reply_id").transformWithStateInPandas(Latch(pattern), OUT, "Append", "None")


class Chat(StatefulProcessor):
    """Per chat: keeps the last exchanges and gives each user message the history it is answered with."""

    def __init__(self, max_turns: int) -> None:
        self.max_turns = max_turns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getListState("turns", "role string, content string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        held = list(self.turns.get()) if self.turns.exists() else []
        out = []
        for row in pd.concat(list(rows)).sort_values("turn").itertuples():
            if row.role == "user":
                out.append((key[0], row.turn, row.text, [{"role": r, "content": c} for r, c in held]))
            if row.role in ("user", "assistant"):
                held.append((row.role, row.text))
            starts = [i for i, (r, _) in enumerate(held) if r == "user"]
            held = held[starts[-min(self.max_turns, len(starts))] :] if starts and self.max_turns > 0 else []
        if held:
            self.turns.put(held)
        else:
            self.turns.clear()
        yield pd.DataFrame(out, columns=["conv_id", "turn", "text", "history"])

    def close(self) -> None:
        pass


def chat_stream(turns: DataFrame, max_turns: int) -> DataFrame:
    """User messages of a stream (conv_id, turn, role, text) with their recent history; the state holds at most that."""
    kind = dict(turns.dtypes)["conv_id"]
    out = f"conv_id {kind}, turn long, text string, history array<struct<role:string,content:string>>"
    return turns.groupBy("conv_id").transformWithStateInPandas(Chat(max_turns), out, "Append", "None")


STORE = "spark.sql.streaming.stateStore.providerClass"


def run_available(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """All that a stream's sources hold by now, run through and read back; state, progress and rows are in the shared folder."""
    ship(spark)
    at = scratch(spark, name)
    held = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        run = rows.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start()
    finally:
        spark.conf.set(STORE, held)
    run.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{at}/rows")
