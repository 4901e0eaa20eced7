"""Vector bin packing of tokenised examples into training sequences.

Every example has three sizes: tokens, segments (one per piece) and
loss-bearing tokens. A sequence is filled by the dot-product heuristic: among
the examples that fit whole, take the one whose size vector has the largest
dot product with what the sequence still has free, each dimension in units of
its limit. When none fits whole, one is cut so that the sequence ends exactly
at its limit, and the rest of it stays in line. Examples longer than a sequence
give whole sequences first. What can't fill a sequence at the end of a task's
rows is dealt out by powers of two, which need no padding.

A task packs its own rows in blocks of ``BLOCK`` examples and carries what is
left to the next block: no shuffle, and memory is bounded by a block. A lost
task packs the same rows again into the same sequences.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import map_arrow, text_or_empty

BLOCK = 1024
END_ID = 2
CACHE = 400_000


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 512
    loss: int = 4096


#: What keeps a Latin-1 text from the short way: control characters, odd white space, the soft hyphen, special tokens.
ODD = re.compile("[\\x00-\\x09\\x0B-\\x1F\\x7F-\\xA0\\xAD]|<\\|")
#: The tokenizer file's settings that ``WordCache`` mirrors.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_L, _N = "a-z\u00AA\u00B5\u00BA\u00DF-\u00F6\u00F8-\u00FF", "0-9\u00B2\u00B3\u00B9\u00BC-\u00BE"
#: The tokenizer's pre-tokens, for Latin-1 in lower case.
PRETOKEN = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_L}]+|[{_N}]|[^\\s{_L}{_N}]+")


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for letters from 256 up, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordCache:
    """Token ids of a text, as bytes, mostly by looking up its pre-tokens.

    In plain Latin-1 the tokenizer's normaliser only lowers the case, so the
    text is cut into pre-tokens here and each goes to the tokenizer's merge
    model once. Any other text is cut at spaces and line feeds, which nothing in
    the tokenizer crosses, and its runs beyond plain Latin-1 go through the whole
    tokenizer. Pre-tokens of up to 64 characters are held: ``CACHE`` newer ones
    and as many older ones, from which those in use move up.

    This holds for a tokenizer whose file has the ``NORMALIZER`` and the
    ``PRE_TOKENIZER`` that are mirrored here; any other codes whole texts itself.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        plain_model = held["model"]["type"] == "BPE" and not any(held["model"].get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "ignore_merges"))
        marked = all(t["content"].startswith("<|") for t in held["added_tokens"])
        self.mirrored = held["normalizer"] == NORMALIZER and held["pre_tokenizer"] == PRE_TOKENIZER and plain_model and marked
        self.encode, self.merge = tokenizer.encode_batch, tokenizer.model.tokenize
        self.letters = byte_letters()
        self.held: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def plain(text: str) -> bool:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return not ODD.search(text)

    def _coded(self, w: str) -> bytes:
        out = self.older.get(w)
        if out is None:
            coded = w if w.isascii() else w.encode().decode("latin-1").translate(self.letters)
            out = array("I", [t.id for t in self.merge(coded)]).tobytes()
        if len(w) <= 64:
            self.held[w] = out
        return out

    def _plain_ids(self, text: str) -> bytes:
        if len(self.held) > CACHE:
            self.held, self.older = {}, self.held
        words = PRETOKEN.findall(text.lower())
        found = list(map(self.held.get, words))
        if None in found:
            for i, x in enumerate(found):
                if x is None:
                    found[i] = self.held.get(words[i]) or self._coded(words[i])
        return b"".join(found)

    def ids(self, text: str) -> bytes:
        if not self.mirrored:
            return array("I", self.encode([text], add_special_tokens=False)[0].ids).tobytes()
        if self.plain(text):
            return self._plain_ids(text)
        runs = text.replace("\n", " ").split(" ")
        others = [x for x in dict.fromkeys(runs) if not self.plain(x)]
        coded = {x: array("I", c.ids).tobytes() for x, c in zip(others, self.encode(others, add_special_tokens=False), strict=True)}
        return b"".join([coded[x] if x in coded else self._plain_ids(x) for x in runs])


class Packer:
    """Places examples one block at a time. An example is (key, ids, first loss-bearing token).

    ``place`` yields sequences: lists of (key, start, stop). The loss-bearing
    part of an example runs from its first loss-bearing token to its end.
    """

    def __init__(self, limits: Limits) -> None:
        self.limits = limits
        self.unit = np.array([limits.tokens, limits.segments, limits.loss], dtype=float)
        self.line: list[list[int]] = []  # key, start, stop, loss from

    def _sizes(self, line: list[list[int]]) -> np.ndarray:
        a = np.array(line, dtype=np.int64).reshape(-1, 4)
        loss = a[:, 2] - np.maximum(a[:, 1], np.minimum(a[:, 3], a[:, 2]))
        return np.stack([a[:, 2] - a[:, 1], np.ones(len(a), dtype=np.int64), loss], axis=1)

    def add(self, key: int, n: int, loss_from: int) -> Iterator[list[tuple[int, int, int]]]:
        start = 0
        step = min(self.limits.tokens, self.limits.loss)
        while n - start > step:
            yield [(key, start, start + step)]
            start += step
        if n > start:
            self.line.append([key, start, n, loss_from])

    def fill(self, last: bool = False) -> Iterator[list[tuple[int, int, int]]]:
        """Sequences from the examples in line; unless ``last``, those that can't fill one stay."""
        line, size = self.line, self._sizes(self.line)
        alive = np.ones(len(line), dtype=bool)
        left = int(size[:, 0].sum())
        limit = np.array([self.limits.tokens, self.limits.segments, self.limits.loss])
        while alive.any() and (last or left >= 2 * self.limits.tokens):
            free, taken = limit.copy(), []
            while free[0] > 0 and free[1] > 0:
                fits = alive & (size <= free).all(axis=1)
                if not fits.any():
                    break
                score = (size / self.unit) @ (free / self.unit)
                i = int(np.argmax(np.where(fits, score, -1.0)))
                taken.append((line[i][0], line[i][1], line[i][2]))
                free -= size[i]
                left -= int(size[i, 0])
                alive[i] = False
            if free[0] > 0 and free[1] > 0 and alive.any():
                i = int(np.argmax(np.where(alive, size[:, 0], -1)))
                key, start, stop, loss_from = line[i]
                cut = min(start + int(free[0]), max(start, loss_from) + int(free[2]), stop)
                if cut > start:
                    taken.append((key, start, cut))
                    left -= cut - start
                    line[i][1] = cut
                    size[i] = self._sizes([line[i]])[0]
                    alive[i] = cut < stop
            yield taken
        self.line = [x for x, a in zip(line, alive, strict=True) if a]


def by_powers(pieces: list[tuple[int, int, int]], full: int) -> Iterator[list[tuple[int, int, int]]]:
    """A sequence as it is if full, else cut into sequences whose lengths are powers of two."""
    total = sum(stop - start for _, start, stop in pieces)
    if total == full:
        yield pieces
        return
    line = list(reversed(pieces))
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        out = []
        while room:
            key, start, stop = line.pop()
            cut = min(stop, start + room)
            out.append((key, start, cut))
            room -= cut - start
            if cut < stop:
                line.append((key, cut, stop))
        yield out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long, sequence_tokens long, sequence_segments long, sequence_loss long"
ARROW = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits(), prompt_lines: int = 0) -> DataFrame:
    """Pieces of all documents in sequences; each token of a document lies in exactly one piece.

    Each piece names its loss-bearing tokens and its sequence's three sums.
    Null text is empty and gives the end token alone. ``prompt_lines`` leading
    lines of a text bear no loss (instruction data: the prompt), all else does.
    Repeated rows and ids are packed as often as they occur; a null id stays
    null. An empty table gives no rows. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = WordCache(tokenizer_path), Packer(limits)
        held: dict[int, tuple[int | None, bytes, int]] = {}
        end = np.array([END_ID], dtype="<u4").tobytes()
        count, serial = 0, 0
        base = TaskContext.get().partitionId() << 32

        def rows(sequences: Iterator[list[tuple[int, int, int]]], finish: bool) -> Iterator[tuple]:
            nonlocal serial
            for found in sequences:
                for seq in by_powers(found, limits.tokens) if finish else [found]:
                    at = 0
                    loss = [max(0, stop - max(start, held[key][2])) for key, start, stop in seq]
                    sums = sum(stop - start for _, start, stop in seq), len(seq), sum(loss)
                    for (key, start, stop), own in zip(seq, loss, strict=True):
                        doc_id, ids, _ = held[key]
                        part = ids[4 * start : 4 * stop]
                        yield doc_id, start, stop - start, zlib.crc32(part), len(ids) // 4, base + serial, at, own, *sums
                        at += stop - start
                        if 4 * stop == len(ids):
                            ended.append(key)
                    serial += 1

        def batch(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=ARROW)

        ended: list[int] = []
        for b in batches:
            out: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py()
                ids = words.ids(text) + end
                loss_from = 0
                if prompt_lines:
                    prompt = text.split("\n", prompt_lines)
                    loss_from = len(words.ids("\n".join(prompt[:prompt_lines]))) // 4 if len(prompt) > prompt_lines else 0
                held[count] = (doc_id, ids, loss_from)
                out += rows(packer.add(count, len(ids) // 4, loss_from), True)
                count += 1
                if len(packer.line) >= BLOCK:
                    # a sequence that isn't full met another limit: cut so that it needs no padding
                    out += rows(packer.fill(), True)
                    for key in ended:
                        held.pop(key, None)
                    ended.clear()
            if out:
                yield batch(out)
        out = list(rows(packer.fill(last=True), True))
        if out:
            yield batch(out)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).transform(map_arrow, run, SCHEMA)
