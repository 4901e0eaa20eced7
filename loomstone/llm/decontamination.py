"""Benchmark decontamination with a generalised suffix automaton of the test items.

An item's windows are its runs of ``length`` words, or of the share ``coverage``
of its words where that is fewer. The automaton holds all runs of words of many
items; a document's words are streamed through it, which gives at each word the
longest run ending there that some item holds, and by links to shorter runs the
windows that end there. A table of fixed size with the short word runs of all
items goes ahead of it: only stretches of words whose short runs are all in the
table can hold a window, so only those are streamed. The test is exact in both
directions; the table merely saves work.

Items are cut into pieces that overlap by a window and dealt into automata of at
most ``PART_WORDS`` words. The driver builds one at a time and sends it to all
tasks. Documents are read once, nothing is shuffled, and a task holds
``RESIDENT`` automata at most: more of them are loaded in turn for each batch.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import as_bytes, discard, fresh, map_arrow, store
from loomstone.llm.ngram_join import Hasher

LENGTH = 10
#: Words of an automaton, and automata that a task keeps loaded.
PART_WORDS = 1 << 17
RESIDENT = 4
#: The table of short runs has 2**GATE_BITS places of a byte.
GATE_BITS = 22
#: Bytes of a text that are hashed at a time.
SEGMENT = 1 << 20
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


class Words(Hasher):
    """Hashes, starts and ends of a text's words, and hashes of its runs of ``width`` words."""

    _SPACE = np.array([WORD.fullmatch(bytes([i]).lower()) is None for i in range(256)])

    def places(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found, at = [], 0
        while at < len(text):
            # a segment ends where no word goes on
            end = min(len(text), at + SEGMENT)
            if end < len(text) and (gap := re.compile(rb"[^0-9A-Za-z\x80-\xff]").search(text, end)):
                end = gap.start()
            elif end < len(text):
                end = len(text)
            part = text[at:end]
            inside = np.zeros(len(part) + 2, dtype=np.int8)
            inside[1:-1] = ~self._SPACE[np.frombuffer(part.lower(), dtype=np.uint8)]
            edge = np.diff(inside)
            found.append((self.words(part), np.flatnonzero(edge == 1) + at, np.flatnonzero(edge == -1) + at))
            at = end
        if not found:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def runs(self, h: np.ndarray) -> np.ndarray:
        """Places in the table of the runs of ``width`` words, in order."""
        out = np.full(max(0, len(h) - self.width + 1), self.width, dtype=np.uint64)
        for i in range(self.width if len(out) else 0):
            out ^= h[i : len(out) + i]
            out *= np.uint64(self._BASE)
            out ^= out >> np.uint64(29)
        return (out >> np.uint64(64 - GATE_BITS)).astype(np.int64)


def joined(spans: list[tuple[int, int]], lo: int, hi: int) -> None:
    """Adds a stretch that ends after, or begins after, all before it; stretches that touch become one."""
    while spans and spans[-1][1] >= lo - 1:
        last = spans.pop()
        lo, hi = min(lo, last[0]), max(hi, last[1])
    spans.append((lo, hi))


class Automaton:
    """The runs of words of many items; windows are marked at the state of their run."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        #: state -> [(words of the window, items)]
        self.marks: dict[int, list[tuple[int, list[str]]]] = {}
        #: state -> the nearest state of shorter runs with marks, 0 for none
        self.out: list[int] = []

    def _state(self, size: int, link: int, steps: dict[int, int]) -> int:
        self.next.append(steps)
        self.link.append(link)
        self.size.append(size)
        return len(self.size) - 1

    def _apart(self, p: int, q: int, c: int) -> int:
        """A state for the runs of q no longer than one word after p's longest."""
        if self.size[q] == self.size[p] + 1:
            return q
        shorter = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = shorter
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = shorter
            p = self.link[p]
        return shorter

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._apart(last, self.next[last][c], c)
        new = self._state(self.size[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._apart(p, self.next[p][c], c)
        return new

    def build(self, items: list[tuple[str, int, list[bytes]]]) -> Automaton:
        """``items``: (item, words of a window, words)."""
        coded = [(i, n, [self.number.setdefault(w, len(self.number)) for w in ws]) for i, n, ws in items]
        for _, _, ws in coded:
            last = 0
            for c in ws:
                last = self._extend(last, c)
        marked: dict[int, dict[int, set[str]]] = {}
        for item, n, ws in coded:
            s = 0
            for at, c in enumerate(ws):
                s = self.next[s][c]
                while at + 1 >= n and self.size[self.link[s]] >= n:
                    s = self.link[s]
                if at + 1 >= n:
                    marked.setdefault(s, {}).setdefault(n, set()).add(item)
        self.marks = {s: [(n, sorted(found)) for n, found in sorted(by.items())] for s, by in marked.items()}
        self.out = [0] * len(self.size)
        for s in sorted(range(1, len(self.size)), key=self.size.__getitem__):
            up = self.link[s]
            self.out[s] = up if up in self.marks else self.out[up]
        return self

    def stream(self, words: list[bytes], start: int, found: Found) -> None:
        """Adds the windows in ``words``, of which the first is number ``start`` of its document."""
        s = size = 0
        own: list[tuple[int, int]] = []
        for at, word in enumerate(words, start):
            c = self.number.get(word, -1)
            while s and c not in self.next[s]:
                s = self.link[s]
                size = self.size[s]
            if c not in self.next[s]:
                continue
            s = self.next[s][c]
            size += 1
            m = s if s in self.marks else self.out[s]
            widest = 0
            while m:
                for n, items in self.marks[m]:
                    if n <= size:
                        widest = max(widest, n)
                        found.items.update(items)
                m = self.out[m]
            if widest:
                found.longest = max(found.longest, size)
                joined(own, at - widest + 1, at)
        found.spans += own


@dataclass
class Found:
    """A document's words, its hit stretches (first and last word), the items with windows in it, and its longest run of an item's words."""

    n_words: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)
    items: set[str] = field(default_factory=set)
    longest: int = 0
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None

    def settle(self) -> None:
        """Stretches in order and apart, after several automata."""
        spans, self.spans = sorted(self.spans), []
        for lo, hi in spans:
            joined(self.spans, lo, hi)

    @property
    def n_hit(self) -> int:
        return sum(hi - lo + 1 for lo, hi in self.spans)


class Finder:
    """The items' windows in the texts of a batch."""

    def __init__(self, gate: np.ndarray, width: int, least: int, parts: list) -> None:
        self.gate, self.words, self.least, self.parts = gate, Words(width), least, parts

    def _stretches(self, h: np.ndarray) -> Iterator[tuple[int, int]]:
        """(first word, end) of the stretches that can hold a window of the least size."""
        need = self.least - self.words.width + 1
        known = self.gate[self.words.runs(h)]
        if np.count_nonzero(known) < need:
            return
        edge = np.diff(np.concatenate([[0], known.astype(np.int8), [0]]))
        for lo, hi in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
            if hi - lo >= need:
                yield int(lo), int(hi) + self.words.width - 1

    def __call__(self, texts: Iterator[bytes]) -> list[Found]:
        out, met = [], []
        for text in texts:
            found = Found()
            if self.parts and text:
                h, found.starts, found.ends = self.words.places(text)
                found.n_words = len(h)
                for lo, hi in self._stretches(h):
                    met.append((found, lo, words_of(text[found.starts[lo] : found.ends[hi - 1]])))
                if not (met and met[-1][0] is found):
                    found.starts = found.ends = None
            elif text:
                found.n_words = len(words_of(text))
            out.append(found)
        for part in self.parts if met else ():
            automaton = part.value
            for found, lo, words in met:
                automaton.stream(words, lo, found)
            if len(self.parts) > RESIDENT:
                vars(part).pop("_value", None)  # read again from the executor's copy for the next batch
        for found in {id(f): f for f, _, _ in met}.values():
            found.settle()
        return out


def pieces(items: DataFrame, length: int, coverage: float, id_col: str, text_col: str, part_words: int = PART_WORDS) -> DataFrame:
    """(item, n, words): items as text of at most ``part_words`` words between single spaces, cut so that each window of ``n`` words is whole in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ws = words_of(text)
                n = max(1, min(length, int(np.ceil(coverage * len(ws) - 1e-9))))
                step = max(1, part_words - n + 1)
                rows += [(item, n, b" ".join(ws[i : i + step + n - 1])) for i in range(0, max(0, len(ws) - n + 1), step)]
            if rows:
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.binary()), strict=True)], names=["item", "n", "words"])

    return items.select(F.col(id_col).cast("string"), as_bytes(text_col)).transform(map_arrow, run, "item string, n int, words binary")


def finder_of(items: DataFrame, length: int = LENGTH, coverage: float = 1.0, id_col: str = "item_id", text_col: str = "text", part_words: int = PART_WORDS) -> Finder:
    """The driver reads the items a piece at a time and holds one automaton."""
    context = items.sparkSession.sparkContext
    stored = store(pieces(items, length, coverage, id_col, text_col, part_words), "items")
    least = stored.agg(F.min("n")).head()[0] or 1
    width = min(3, least)
    words, gate, parts, held, total = Words(width), np.zeros(1 << GATE_BITS, dtype=bool), [], [], 0
    for row in stored.toLocalIterator():
        gate[words.runs(words.places(bytes(row.words))[0])] = True
        ws = bytes(row.words).split(b" ")
        if held and total + len(ws) > part_words:
            parts.append(context.broadcast(Automaton().build(held)))
            held, total = [], 0
        held.append((row.item, row.n, ws))
        total += len(ws)
    if held:
        parts.append(context.broadcast(Automaton().build(held)))
    discard(stored)
    return Finder(gate, width, least, parts)


def _listed(items: set) -> list[str]:
    return sorted(i for i in items if i is not None)


def scan(
    docs: DataFrame, items: DataFrame, length: int = LENGTH, coverage: float = 1.0,
    id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", part_words: int = PART_WORDS,
) -> DataFrame:
    """For every document: n_words, n_hit, n_items, items_sha256, contaminated, longest and spans.

    Words: runs of digits, letters with A-Z in lower case, and characters beyond
    ASCII. n_hit: words inside any occurrence of a window; n_items: items of
    which a window occurs; items_sha256: of their ids, sorted as text, joined by
    commas; longest: words of the longest run at a hit that some item holds;
    spans: array of (first, last) word of hit stretches.

    Null texts have no words, in documents and in items; an item without words
    has no window. Items without id mark words, but aren't counted; items of one
    id count once. Repeated documents each give their row, those without id too.
    Without items nothing is hit. Other columns are not read.
    """
    kind = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast(finder_of(items, length, coverage, item_id_col, item_text_col, part_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = shared.value(t.as_py() for t in b.column(1))
            listed = [_listed(f.items) for f in found]
            cols = [
                pa.array([f.n_words for f in found], pa.int64()), pa.array([f.n_hit for f in found], pa.int64()), pa.array([len(x) for x in listed], pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in listed], pa.string()), pa.array([bool(f.spans) for f in found], pa.bool_()),
                pa.array([f.longest for f in found], pa.int64()),
                pa.array([[{"first": a, "last": z} for a, z in f.spans] for f in found], pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest", "spans"])

    schema = f"id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long, spans array<struct<first:long,last:long>>"
    return docs.select(id_col, as_bytes(text_col)).transform(map_arrow, run, schema).withColumnRenamed("id", id_col)


def decontaminate(
    docs: DataFrame, items: DataFrame, length: int = LENGTH, coverage: float = 1.0, most: float = 0.5,
    text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", part_words: int = PART_WORDS,
) -> DataFrame:
    """The documents without hit stretches; those of which more than the share ``most`` of the words is hit go whole.

    A stretch goes from its first word's first character to its last word's
    last, a space takes its place. Columns, other texts, nulls and repeated rows
    stay as they are; without items all does.
    """
    shared = docs.sparkSession.sparkContext.broadcast(finder_of(items, length, coverage, item_id_col, item_text_col, part_words))
    left = fresh(docs, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1)
            out, kept = [], []
            for i, (text, found) in enumerate(zip(texts, shared.value(t.as_py() or b"" for t in texts), strict=True)):
                if found.spans and found.n_hit > most * found.n_words:
                    continue
                t = text.as_py()
                for lo, hi in reversed(found.spans):
                    t = t[: found.starts[lo]] + b" " + t[found.ends[hi] :]
                kept.append(i)
                out.append(None if t is None else t.decode())
            rest = b.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rest.columns[:-1], pa.array(out, pa.string())], names=b.schema.names)

    others = [c for c in docs.columns if c != text_col]
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*others).dtypes)
    rows = docs.select(*others, F.col(text_col).cast("binary").alias(left)).transform(map_arrow, run, f"{schema + ', ' if schema else ''}`{left}` string")
    return rows.withColumnRenamed(left, text_col).select(*docs.columns)
