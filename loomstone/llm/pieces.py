"""SentencePiece encoding and decoding with an Aho-Corasick automaton over the pieces.

The automaton reads a segment once. At each position the pieces that end there
are found along output links, longest first, and relaxed:

* Viterbi: best[i] is the best sum of scores over all ways to cut the first i
  characters. For a unigram model that is the library's encoding.
* BPE models: a model's scores are merge ranks, and the cut with the best sum of
  ranks (``best_ids``) is not what merging gives. So the same pass also keeps, for
  each position, the last piece of the merged prefix. A piece that ends at i
  extends the prefix before it if the two pieces, merged on their own, stay
  apart; exactly one does. This gives the library's ids (``ids``).

Text becomes segments at spaces (pieces hold the space mark only in front) and
at line ends, which no piece crosses, so that a text's best cut is that of its
segments. New segments are coded many at a time, a position of all of them in
one step on arrays (``Codec.cuts_of_many``); those that hold a character beyond
the ``CLASSES`` most frequent ones go one by one (``Codec.cuts``). Coded segments
are held, ``HELD`` at most. Characters without a piece fall back to their bytes,
or to the unknown piece.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from loomstone.llm.common import map_arrow, text_or_empty

MARK = "▁"
#: Segments held and, at most, their ids; pairs of pieces held.
HELD = 500_000
HELD_IDS = 1 << 22
PAIRS = 400_000
#: Bytes of text coded at a time, which bounds what a worker holds beside its input.
STEP = 1 << 20
#: Characters with a column in the array form of the automaton, and the longest segments that use it.
CLASSES = 250
LONGEST = 48
BATCH = 8192
UNKNOWN_PENALTY = 10.0
UNIGRAM, BPE = 1, 2


class Automaton:
    """Aho-Corasick over words: ``ends(text)`` gives, for each position, the numbers of words that end there, longest first."""

    def __init__(self, words: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.word: list[int] = [-1]
        for k, w in enumerate(words):
            at = 0
            for c in w:
                to = self.next[at].get(c)
                if to is None:
                    to = self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.word.append(-1)
                at = to
            self.word[at] = k
        self.fail = [0] * len(self.next)
        self.link = [-1] * len(self.next)  # output link: the longest proper suffix that is a word
        queue = deque(self.next[0].values())
        while queue:
            at = queue.popleft()
            f = self.fail[at]
            self.link[at] = f if self.word[f] >= 0 else self.link[f]
            for c, to in self.next[at].items():
                g = f
                while g and c not in self.next[g]:
                    g = self.fail[g]
                back = self.next[g].get(c, 0)
                self.fail[to] = back if back != to else 0
                queue.append(to)

        # All words that end at a node, longest first: its own and those along output links.
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        sizes = [len(w) for w in words]
        done = [False] * len(self.next)
        for start in range(len(self.next)):
            path = []
            node = start
            while node > 0 and not done[node]:
                path.append(node)
                node = self.link[node]
            for node in reversed(path):
                own = ((self.word[node], sizes[self.word[node]]),) if self.word[node] >= 0 else ()
                self.ends[node] = own + (self.ends[self.link[node]] if self.link[node] > 0 else ())
                done[node] = True

    def step(self, at: int, c: str) -> int:
        """The node after a character, by failure links where no branch goes on."""
        to = self.next[at].get(c)
        if to is None:
            g = self.fail[at]
            while g and c not in self.next[g]:
                g = self.fail[g]
            to = self.next[g].get(c, 0)
        return to


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str, model_type: int | None = None) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if len(model.normalizer_spec.precompiled_charsmap) or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models without text normalisation are supported")
        self.kind = model_type or model.trainer_spec.model_type
        self.dummy = model.normalizer_spec.add_dummy_prefix
        kinds = model.SentencePiece
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.words = list(self.ids)
        self.numbers = [self.ids[w] for w in self.words]
        self.lengths = [len(w) for w in self.words]
        self.scores = [model.pieces[i].score for i in self.numbers]
        self.rank = dict(zip(self.words, self.scores, strict=True))
        self.floor = min(self.scores, default=0.0) - UNKNOWN_PENALTY
        self.automaton = Automaton(self.words)
        self.pairs = {w[i : i + 2] for w in self.words for i in range(len(w) - 1)}
        self.table = [
            bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else " ⁇ ".encode() if p.type == kinds.UNKNOWN else b"" if p.type == kinds.CONTROL else p.piece.replace(MARK, " ").encode()
            for p in model.pieces
        ]
        if any(MARK in w.lstrip(MARK) or "\n" in w for w in self.words):
            raise ValueError("pieces that cross a space or a line end are not supported")
        self.size = len(self.words) + 1
        self.prepare()
        self.segment = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
        self.forget()

    def prepare(self) -> None:
        """The automaton as arrays: moves by class of character, failure links resolved, and what ends at each node."""
        automaton = self.automaton
        #: For each node the pieces that end there, longest first, as (piece, length, score).
        self.ends = [tuple([(k, n, self.scores[k]) for k, n in found]) for found in automaton.ends]
        self.apart: dict[int, bool] = {}
        counts = Counter(c for w in self.words for c in w)
        own = set(self.words)
        # A character that is itself a piece can always be cut off alone.
        chosen = [c for c, _ in counts.most_common() if c in own][:CLASSES]
        self.kind_of = np.zeros(0x110000, dtype=np.uint8)
        for k, c in enumerate(chosen, start=1):
            self.kind_of[ord(c)] = k
        column = {c: k for k, c in enumerate(chosen, start=1)}
        self.moves = np.zeros((len(automaton.next), len(chosen) + 1), dtype=np.min_scalar_type(len(automaton.next)))
        queue = deque([0])
        while queue:
            at = queue.popleft()
            if at:
                self.moves[at] = self.moves[automaton.fail[at]]
            for c, to in automaton.next[at].items():
                if c in column:
                    self.moves[at, column[c]] = to
                queue.append(to)
        self.n_ends = np.array([len(x) for x in automaton.ends], dtype=np.int32)
        self.first_end = np.concatenate([[0], np.cumsum(self.n_ends)[:-1]]).astype(np.int64)
        self.end_word = np.array([k for x in automaton.ends for k, _ in x], dtype=np.int64)
        self.length_of = np.array([len(w) for w in self.words], dtype=np.int64)
        self.score_of = np.array(self.scores, dtype=np.float64)
        #: Verdicts on pairs, by hash; what isn't here is in ``apart`` or worked out.
        self.pair_bits = 20
        self.pair_key = np.full(1 << self.pair_bits, -1, dtype=np.int64)
        self.pair_stays = np.zeros(1 << self.pair_bits, dtype=bool)

    def forget(self) -> None:
        """Drop the held segments."""
        self.held: dict[str, int] = {}
        self.spans = np.zeros((1024, 4), dtype=np.int64)  # start and end in ids, start and end in best
        self.best_score = np.zeros(1024)
        self.flat = [np.zeros(4096, dtype=np.uint32), np.zeros(4096, dtype=np.uint32)]
        self.used = [0, 0]

    def merged(self, text: str) -> list[str]:
        """Plain merging: the best-ranked neighbours first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                r = self.rank.get(parts[k] + parts[k + 1])
                if r is not None and (best is None or r > best):
                    best, at = r, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stay(self, a: int, b: int) -> bool:
        """Whether piece b stays apart from piece a before it (-1: none, or a character without a piece)."""
        if len(self.apart) > PAIRS:
            self.apart.clear()
        left, right = self.words[a] if a >= 0 else "", self.words[b]
        found = self.apart[a * self.size + b] = self.merged(left + right) == ([left, right] if left else [right])
        return found

    def cuts(self, text: str, merges: bool) -> tuple[list[int], list[int] | None, float]:
        """Best cut, merged cut and best sum of scores, in one pass.

        A cut lists numbers of words, or minus the place (from 1) of a character without a piece.
        """
        automaton, apart, size, floor = self.automaton, self.apart, self.size, self.floor
        following, ends, step = automaton.next, self.ends, automaton.step
        best, cut, last, at = [0.0], [-1], [-1], 0
        for c in text:
            to = following[at].get(c)
            at = step(at, c) if to is None else to
            found = ends[at]
            # A character without a piece of its own can be cut off alone, at a penalty.
            score, word = (None, -1) if found and found[-1][1] == 1 else (best[-1] + floor, -1)
            for k, n, s in found:
                s += best[-n]
                if score is None or s > score:
                    score, word = s, k
            best.append(score)
            cut.append(word)
            if merges:
                for k, n, _ in found:
                    before = last[-n]
                    stay = apart.get(before * size + k)
                    if self._stay(before, k) if stay is None else stay:
                        last.append(k)
                        break
                else:
                    last.append(-1)
        return self._back(cut), self._back(last) if merges else None, best[-1]

    def _back(self, ends: list[int]) -> list[int]:
        out, i, lengths = [], len(ends) - 1, self.lengths
        while i:
            k = ends[i]
            out.append(k if k >= 0 else -i)
            i -= lengths[k] if k >= 0 else 1
        return out[::-1]

    def _stays(self, before: np.ndarray, k: np.ndarray) -> np.ndarray:
        """``_stay`` of many pairs."""
        key = before * self.size + k
        at = ((key * 0x9E3779B1) >> 7) & ((1 << self.pair_bits) - 1)
        out = self.pair_stays[at]
        for i in np.flatnonzero(self.pair_key[at] != key).tolist():
            stay = self.apart.get(int(key[i]))
            out[i] = self._stay(int(before[i]), int(k[i])) if stay is None else stay
            self.pair_key[at[i]], self.pair_stays[at[i]] = key[i], out[i]
        return out

    def cuts_of_many(self, kinds: np.ndarray, lengths: np.ndarray, merges: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``cuts`` of many segments, as matrices: the last word of the best and of the merged cut at each position, and the best sums.

        ``kinds`` holds a segment's classes of characters in a row, longer segments first.
        """
        n, width = kinds.shape
        best = np.zeros((n, width + 1))
        cut = np.full((n, width + 1), -1, dtype=np.int64)
        last = np.full((n, width + 1), -1, dtype=np.int64)
        node = np.zeros(n, dtype=np.int64)
        for i in range(1, width + 1):
            alive = int(np.searchsorted(-lengths, -i, side="right"))
            node = self.moves[node[:alive], kinds[:alive, i - 1]].astype(np.int64)
            ends, first = self.n_ends[node], self.first_end[node]
            score, word = np.full(alive, -np.inf), np.full(alive, -1, dtype=np.int64)
            merged = np.full(alive, -1, dtype=np.int64)
            for j in range(int(ends.max(initial=0))):
                rows = np.flatnonzero(ends > j)
                k = self.end_word[first[rows] + j]
                start = i - self.length_of[k]
                sums = best[rows, start] + self.score_of[k]
                better = sums > score[rows]
                score[rows[better]], word[rows[better]] = sums[better], k[better]
                if merges:
                    left = merged[rows] < 0
                    rows, k = rows[left], k[left]
                    stays = self._stays(last[rows, start[left]], k)
                    merged[rows[stays]] = k[stays]
            best[:alive, i], cut[:alive, i], last[:alive, i] = score, word, merged
        return cut, last, best

    def _walked(self, ends: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words of each row's cut, one row after the other, and their numbers."""
        at, rows, back = lengths.copy(), np.arange(len(lengths)), []
        while len(rows):
            k = ends[rows, at[rows]]
            back.append((rows, k))
            at[rows] -= self.length_of[k]
            rows = rows[at[rows] > 0]
        row = np.concatenate([r for r, _ in back[::-1]])
        word = np.concatenate([k for _, k in back[::-1]])
        # Steps came last word first; a stable sort by row brings each row's words in order.
        order = np.argsort(row, kind="stable")
        return word[order], np.bincount(row, minlength=len(lengths))

    def _hold(self, segments: list[str], ids: list[np.ndarray], sizes: list[np.ndarray], scores: np.ndarray) -> None:
        """Add coded segments: for the library's and the best ids, all of them and their numbers by segment."""
        first, n = len(self.held), len(segments)
        if first + n > len(self.spans):
            room = max(2 * len(self.spans), first + n)
            self.spans = np.concatenate([self.spans, np.zeros((room - len(self.spans), 4), dtype=np.int64)])
            self.best_score = np.concatenate([self.best_score, np.zeros(room - len(self.best_score))])
        for side in (0, 1):
            total = self.used[side] + len(ids[side])
            if total > len(self.flat[side]):
                self.flat[side] = np.concatenate([self.flat[side], np.zeros(max(len(self.flat[side]), total - len(self.flat[side])), dtype=np.uint32)])
            self.flat[side][self.used[side] : total] = ids[side]
            ends = self.used[side] + np.cumsum(sizes[side])
            self.spans[first : first + n, 2 * side] = ends - sizes[side]
            self.spans[first : first + n, 2 * side + 1] = ends
            self.used[side] = total
        self.best_score[first : first + n] = scores
        self.held.update(zip(segments, range(first, first + n), strict=True))

    def _ids(self, segment: str, cut: list[int]) -> list[int]:
        ids: list[int] = []
        for k in cut:
            if k >= 0:
                ids.append(self.numbers[k])
            else:
                ids += [self.byte[b] for b in segment[-k - 1].encode("utf-8", "replace")] if self.byte else [self.unknown]
        return ids

    def _code(self, segments: list[str]) -> None:
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        kinds = self.kind_of[np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        starts = np.cumsum(lengths) - lengths
        plain = (np.minimum.reduceat(kinds, starts) > 0) & (lengths <= LONGEST)
        order = np.flatnonzero(plain)
        order = order[np.argsort(-lengths[order], kind="stable")]
        numbers = np.array(self.numbers, dtype=np.uint32)
        merges = self.kind == BPE
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            size = lengths[some]
            matrix = kinds[np.minimum(starts[some, None] + np.arange(size[0]), len(kinds) - 1)]
            cut, last, best = self.cuts_of_many(matrix, size, merges)
            word, n = self._walked(cut, size)
            merged, m = self._walked(last, size) if merges else (word, n)
            self._hold([segments[i] for i in some], [numbers[merged], numbers[word]], [m, n], best[np.arange(len(some)), size])
        for i in np.flatnonzero(~plain).tolist():
            best, merged, score = self.cuts(segments[i], merges)
            ids = [np.array(self._ids(segments[i], x), dtype=np.uint32) for x in (best if merged is None else merged, best)]
            self._hold([segments[i]], ids, [np.array([len(x)]) for x in ids], np.array([score]))

    def encode_many(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """For the library's ids and those of the best cut: where each text's ids begin and end, and all ids; and the best scores.

        The two lists of ids are the same for unigram models.
        """
        if len(self.held) > HELD or max(self.used) > HELD_IDS:
            self.forget()
        mark = MARK if self.dummy else ""
        by_text = [self.segment.findall(mark + t.replace(" ", MARK)) if t else [] for t in texts]
        counts = np.fromiter(map(len, by_text), np.int64, len(by_text))
        segments = list(chain.from_iterable(by_text))
        at = np.fromiter(map(self.held.get, segments, repeat(-1)), np.int64, len(segments))
        new = np.flatnonzero(at < 0).tolist()
        if new:
            self._code(list(dict.fromkeys([segments[i] for i in new])))
            at[new] = [self.held[segments[i]] for i in new]
        of = np.concatenate([[0], np.cumsum(counts)])
        offsets, ids = [], []
        for side in (0, 1):
            start, end = self.spans[at, 2 * side], self.spans[at, 2 * side + 1]
            ends = np.concatenate([[0], np.cumsum(end - start)])
            ids.append(self.flat[side][np.arange(ends[-1]) + np.repeat(start - ends[:-1], end - start)])
            offsets.append(ends[of])
        scores = np.array([self.best_score[at[a:b]].sum() for a, b in zip(of[:-1], of[1:], strict=True)])
        return offsets, ids, scores

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, float]:
        """The library's ids of one text, those of the best cut, and its score."""
        _, (ids, best), scores = self.encode_many([text])
        return ids, best, float(scores[0])

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.table.__getitem__, ids.tolist())).decode("utf-8", errors="replace")
        return text[1:] if self.dummy and text.startswith(" ") else text


_codecs: dict[tuple[str, int | None], Codec] = {}


def codec(path: str, model_type: int | None = None) -> Codec:
    """One codec a worker and model: its automaton and held segments serve all tasks there."""
    if (path, model_type) not in _codecs:
        _codecs[path, model_type] = Codec(path, model_type)
    return _codecs[path, model_type]


def steps(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Stretches of texts of about ``STEP`` bytes."""
    start, size = 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist(), start=1):
        size += n
        if size >= STEP or i == len(texts):
            yield start, i
            start, size = i, 0


SCHEMA = "doc_id long, ids array<int>, best_ids array<int>, best_score double, round_trip boolean"


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, the library's ids, the best cut's ids and score, and round_trip.

    round_trip says whether both lists of ids decode to the text. Null text is
    empty, has no ids and the score 0; repeats and null ids are coded row by row,
    an empty table gives no rows. A text that holds the space mark itself
    decodes to a space there, as the format has it. Ids must be whole numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for b in batches:
            for lo, hi in steps(b.column(1)):
                texts = b.column(1).slice(lo, hi - lo).to_pylist()
                offsets, ids, scores = c.encode_many(texts)
                same = [True] * len(texts)
                for at, x in zip(offsets, ids, strict=True):
                    same = [s and c.decode(x[a:z]) == t for s, a, z, t in zip(same, at[:-1], at[1:], texts, strict=True)]
                lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x.astype(np.int32))) for at, x in zip(offsets, ids, strict=True)]
                columns = [b.column(0).slice(lo, hi - lo), *lists, pa.array(scores, pa.float64()), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCHEMA.split(", ")])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.transform(map_arrow, run, SCHEMA)


def decode(coded: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """``coded`` with one more column, decoded; null ids give null."""
    names = [*coded.columns, "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for b in batches:
            texts = [c.decode(x.values.to_numpy()) if x.is_valid else None for x in b.column(names.index(ids_col))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=names)

    return coded.select(*names[:-1]).transform(map_arrow, run, StructType([*coded.schema.fields, StructField("decoded", StringType())]))
