"""An approximate index of product-quantised residuals, searched by distance tables and ranked anew on whole vectors.

Unit vectors belong to the cell of their nearest centre; what is left is cut
into stretches of components, and each stretch is coded by its nearest entry of
a book of 256. A vector is then one byte a stretch. The product of a query with
a vector is about its product with what the code stands for, so the search reads
codes alone, of the cells it probes, and only the ``rerank`` likeliest of each
query are compared as vectors. These aren't listed: codes are counted by level of
their product first, and what a query keeps is the level and the id of its last.
Products of codes are whole numbers, so each pass finds the same ones.

Centres and books are fitted in one task on a bounded sample (a parameter) and
are all that the driver sees. Every vector is coded. The index is a table
ordered by cell, so that probes skip row groups of other cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstone.operators.retrieval import BLOCK, _every, _part, _rows
from loomstone.shipping import map_arrow
from loomstone.sources.shared import store

#: Entries of a stretch's book: a code is one byte.
BOOK = 256
#: Pairs whose vectors are compared at once.
SMALL = 1 << 15
#: Queries and codes of a tile.
ASKED, CODED = 256, 1 << 13
#: Queries that a task counts codes for, and codes of a row that it reads.
COUNTED, BUNDLE = 1024, 256
#: Chunks that a task compares with a block of queries.
READ = 1 << 17
#: Components are coded in units of 1 / UNIT, and their products told apart by LEVELS from -2 to 2; level 0 is for what doesn't count.
UNIT, LEVELS = 1 << 10, 1 << 12


@dataclass
class Quantiser:
    """Unit centres (cells x n) and books (stretches x entries x n / stretches)."""

    centres: np.ndarray
    books: np.ndarray

    def cells(self, vectors: np.ndarray, probes: int = 1) -> np.ndarray:
        return np.argsort(-(vectors @ self.centres.T), axis=1, kind="stable")[:, :probes]

    def _cut(self, vectors: np.ndarray) -> np.ndarray:
        return vectors.reshape(len(vectors), len(self.books), -1)

    def codes(self, vectors: np.ndarray, cells: np.ndarray) -> np.ndarray:
        rest = self._cut(vectors - self.centres[cells])
        return np.stack([_nearest(rest[:, m], book) for m, book in enumerate(self.books)], axis=1).astype(np.uint8)

    def decoded(self, cells: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What codes stand for, in whole units: their products are exact in any order."""
        rest = np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], axis=1)
        return _units(self.centres[cells] + rest)


def _units(vectors: np.ndarray) -> np.ndarray:
    return np.rint(vectors * UNIT).astype(np.float32)


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (-2 * rows @ centres.T + (centres * centres).sum(axis=1)).argmin(axis=1)


def _means(rows: np.ndarray, at: np.ndarray, centres: np.ndarray) -> np.ndarray:
    n = np.bincount(at, minlength=len(centres))
    sums = np.zeros_like(centres)
    np.add.at(sums, at, rows)
    return np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)


def _fitted(rows: np.ndarray, cells: int, stretches: int, rounds: int) -> Quantiser:
    centres = rows[:: max(1, len(rows) // cells)][:cells].copy()
    for _ in range(rounds):
        centres = _means(rows, (rows @ centres.T).argmax(axis=1), centres)
        norm = np.linalg.norm(centres, axis=1, keepdims=True)
        centres = np.divide(centres, norm, out=centres, where=norm > 0)
    rest = (rows - centres[(rows @ centres.T).argmax(axis=1)]).reshape(len(rows), stretches, -1)
    books = []
    for m in range(stretches):
        book = rest[:: max(1, len(rest) // BOOK), m][:BOOK].copy()
        for _ in range(rounds):
            book = _means(rest[:, m], _nearest(rest[:, m], book), book)
        books.append(np.concatenate([book, np.repeat(book[-1:], BOOK - len(book), axis=0)]))
    return Quantiser(centres, np.stack(books))


def fit(chunks: DataFrame, cells: int = 32, stretches: int = 16, sample: int = 20_000, rounds: int = 8) -> Quantiser | None:
    """Centres and books from the ``sample`` rows of the smallest digests; None without a vector that has a direction.

    The number of components is a multiple of ``stretches``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [m for b in batches if b.num_rows for m in [_rows(b.column(0))]]
        rows = np.concatenate(parts) if parts else np.zeros((0, stretches))
        rows = rows[~np.isnan(rows).any(axis=1)]
        if len(rows):
            q = _fitted(rows, cells, stretches, rounds)
            out = [q.centres.astype("<f8").tobytes()], [q.books.astype("<f8").tobytes()], [rows.shape[1]]
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int32())], names=["centres", "books", "n"])

    named = chunks.select(F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("v")).where("id is not null and v is not null")
    drawn = named.select("v", F.md5("id").alias("h"), "id").orderBy("h", "id").limit(sample).select("v").coalesce(1)
    got = drawn.transform(map_arrow, run, "centres binary, books binary, n int").head()
    if got is None:
        return None
    return Quantiser(np.frombuffer(got.centres, dtype="<f8").reshape(-1, got.n), np.frombuffer(got.books, dtype="<f8").reshape(stretches, BOOK, -1))


@dataclass
class CodeIndex:
    """``rows``: (id, cell, code, embedding), ordered by cell; ``total`` of them."""

    quantiser: Quantiser | None
    rows: DataFrame
    total: int


def build(chunks: DataFrame, cells: int = 32, stretches: int = 16, sample: int = 20_000) -> CodeIndex:
    """The index of every chunk (id, embedding) that has an id and a vector with a direction, written to the shared folder."""
    quantiser = fit(chunks, cells, stretches, sample)
    shared = chunks.sparkSession.sparkContext.broadcast(quantiser)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = _rows(b.column(1))
            ok = np.flatnonzero(~np.isnan(vectors).any(axis=1))
            if len(ok) and shared.value is not None:
                at = shared.value.cells(vectors[ok])[:, 0]
                codes = shared.value.codes(vectors[ok], at)
                kept = b.take(pa.array(ok))
                cols = [kept.column(0), pa.array(at.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), kept.column(1)]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "cell", "code", "embedding"])

    vectors = chunks.select(F.col("id").cast("long"), F.col("embedding").cast("array<double>")).where("id is not null and embedding is not null")
    coded = vectors.transform(map_arrow, run, "id long, cell int, code binary, embedding array<double>")
    # A cell of many vectors is dealt over several files.
    rows = store(coded.repartitionByRange("cell", F.xxhash64("id")).sortWithinPartitions("cell", "id"), "codes")
    return CodeIndex(quantiser, rows, rows.count())


class Asked:
    """Queries of a task, and the products of codes with them."""

    def __init__(self, quantiser: Quantiser, ids: np.ndarray, vectors: np.ndarray, probes: int | None, same: bool) -> None:
        self.quantiser, self.ids, self.vectors, self.same = quantiser, ids, vectors, same
        self.units, self.probed = _units(vectors), None
        if probes is not None and probes < len(quantiser.centres) and len(ids):
            self.probed = np.zeros((len(ids), len(quantiser.centres)), dtype=bool)
            np.put_along_axis(self.probed, quantiser.cells(vectors, probes), True, axis=1)

    def levels(self, chunks: np.ndarray, cells: np.ndarray, codes: np.ndarray) -> Iterator[tuple[slice, slice, np.ndarray]]:
        """Tiles of (queries, chunks) with their levels."""
        for j in range(0, len(chunks), CODED):
            of = slice(j, j + CODED)
            stands = self.quantiser.decoded(cells[of], codes[of]).T
            for i in range(0, len(self.ids), ASKED):
                at = slice(i, i + ASKED)
                near = np.floor((self.units[at] @ stands + 2 * UNIT * UNIT) * (LEVELS / (4 * UNIT * UNIT)))
                level = np.clip(near, 1, LEVELS - 1).astype(np.int32)
                if not self.same:
                    level[self.ids[at][:, None] == chunks[of][None, :]] = 0
                if self.probed is not None:
                    level[~self.probed[at][:, cells[of]]] = 0
                yield at, of, level


class Cut:
    """The level and the id of the last of the n likeliest codes of each query; codes are seen twice, by ids the second time."""

    def __init__(self, asked: Asked, n: int) -> None:
        self.asked, self.n = asked, n
        self.counts = np.zeros((len(asked.ids), LEVELS), dtype=np.int64)
        self.level = self.left = self.last = None

    def count(self, *codes: np.ndarray) -> None:
        for at, _, level in self.asked.levels(*codes):
            level += (np.arange(len(level), dtype=np.int32) * LEVELS)[:, None]
            self.counts[at] += np.bincount(level.ravel(), minlength=len(level) * LEVELS).reshape(-1, LEVELS)

    def settle(self) -> None:
        """Levels of the last ones. Those of this level count up to ``left``, by their ids."""
        if self.level is None:
            above = np.cumsum(self.counts[:, :0:-1], axis=1)[:, ::-1]  # of levels 1, 2, ... and all beyond
            enough = (above >= self.n).sum(axis=1)  # the highest level with n codes from it on, 0 where all count
            beyond = np.where(enough < LEVELS - 1, np.take_along_axis(above, np.minimum(enough, LEVELS - 2)[:, None], axis=1)[:, 0], 0)
            self.level = enough if self.n > 0 else np.full(len(enough), LEVELS)
            self.left = np.where((enough > 0) & (self.n > 0), self.n - beyond, 0)
            self.last = np.full(len(enough), np.iinfo(np.int64).max)
            self.counts = None

    def find(self, chunks: np.ndarray, *codes: np.ndarray) -> None:
        self.settle()
        for at, of, level in self.asked.levels(chunks, *codes):
            left = self.left[at]
            r, c = np.nonzero((level == self.level[at][:, None]) & (left > 0)[:, None])
            n = np.bincount(r, minlength=len(left))
            here = np.flatnonzero((left > 0) & (n >= left))
            self.last[at][here] = chunks[of][c[(np.cumsum(n) - n + left - 1)[here]]]
            left -= n

    def rows(self) -> pa.RecordBatch:
        self.settle()
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (self.asked.ids, self.level.astype(np.int32), self.last)], names=["id", "level", "last"])


class Nearest:
    """The k nearest chunks of each query among its likeliest, and how many were compared."""

    def __init__(self, asked: Asked, level: np.ndarray, last: np.ndarray, k: int) -> None:
        self.asked, self.level, self.last, self.k = asked, level, last, k
        self.score, self.key = np.full((len(level), k), -np.inf), np.full((len(level), k), np.iinfo(np.int64).max)
        self.read = np.zeros(len(level), dtype=np.int64)

    def see(self, chunks: np.ndarray, cells: np.ndarray, codes: np.ndarray, vectors: np.ndarray) -> None:
        for at, of, level in self.asked.levels(chunks, cells, codes):
            cut = self.level[at][:, None]
            kept = (level > cut) | ((level == cut) & (cut > 0) & (chunks[of][None, :] <= self.last[at][:, None]))
            self.read[at] += kept.sum(axis=1)
            r, c = np.nonzero(kept)
            for i in range(0, len(r), SMALL):
                q, j = r[i : i + SMALL] + at.start, c[i : i + SMALL] + of.start
                self._add(q, chunks[j], (self.asked.vectors[q] * vectors[j]).sum(axis=1))

    def _add(self, q: np.ndarray, chunks: np.ndarray, sims: np.ndarray) -> None:
        if not self.k:
            return
        new = sims >= self.score[q, -1]
        q, chunks, sims = q[new], chunks[new], sims[new]
        some = np.unique(q)
        row = np.concatenate([q, np.repeat(some, self.k)])
        value, name = np.concatenate([sims, self.score[some].ravel()]), np.concatenate([chunks, self.key[some].ravel()])
        order = np.lexsort((name, -value, row))
        first = order[np.arange(len(row)) - np.searchsorted(row[order], row[order]) < self.k]
        self.score[some], self.key[some] = value[first].reshape(-1, self.k), name[first].reshape(-1, self.k)

    def rows(self) -> pa.RecordBatch:
        """Chunks of each query, and a row without chunk that says how many were compared."""
        r, c = np.nonzero(self.score > -np.inf)
        met = np.flatnonzero(self.read)
        none = pa.nulls(len(met), pa.int64()), pa.nulls(len(met), pa.float64())
        cols = [
            pa.array(np.concatenate([self.asked.ids[r], self.asked.ids[met]])),
            pa.concat_arrays([pa.array(self.key[r, c]), none[0]]),
            pa.concat_arrays([pa.array(self.score[r, c]), none[1]]),
            pa.array(np.concatenate([np.zeros(len(r), dtype=np.int64), self.read[met]])),
        ]
        return pa.RecordBatch.from_arrays(cols, names=["query_id", "chunk_id", "similarity", "read"])


def _bytes(column: pa.Array, kind: object) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind)


def _bundles(rows: DataFrame) -> DataFrame:
    """(first, ids, cells, codes): ``BUNDLE`` codes a row, so that rows by ``first`` have all codes by their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [b.slice(i, BUNDLE) for i in range(0, b.num_rows, BUNDLE)]
            cols = [
                pa.array([p.column(0)[0].as_py() for p in parts], pa.int64()),
                pa.array([p.column(0).to_numpy().astype("<i8").tobytes() for p in parts], pa.binary()),
                pa.array([p.column(1).to_numpy().astype("<i4").tobytes() for p in parts], pa.binary()),
                pa.array([b"".join(p.column(2).to_pylist()) for p in parts], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["first", "ids", "cells", "codes"])

    by_id = rows.select("id", "cell", "code").repartitionByRange("id").sortWithinPartitions("id")
    return by_id.transform(map_arrow, run, "first long, ids binary, cells binary, codes binary")


def cuts(queries: DataFrame, index: CodeIndex, rerank: int, probes: int | None = None, same: bool = True) -> DataFrame:
    """(id, level, last): the level of the last of each query's ``rerank`` likeliest codes, and its id.

    A task has a block of queries, each with as many counters as there are levels, and
    reads all codes twice, the second time by ids: its memory doesn't depend on the index.
    """
    total = queries.count()
    blocks = max(1, -(-total // max(1, min(COUNTED, -(-total // 64)))))
    shared = queries.sparkSession.sparkContext.broadcast(index.quantiser)
    asked = queries.select(_part("id", blocks).alias("q"), F.lit(0).alias("side"), F.col("id").alias("first"), F.expr("cast(null as binary) as ids"), F.expr("cast(null as binary) as cells"), F.expr("cast(null as binary) as codes"), "embedding")
    coded = _bundles(index.rows).select(_every(F.lit(blocks)).alias("q"), "*").select("q", F.explode(F.array(F.lit(1), F.lit(2))).alias("side"), "first", "ids", "cells", "codes", F.expr("cast(null as array<double>) as embedding"))
    dealt = asked.unionByName(coded).repartition("q").sortWithinPartitions("q", "side", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, vectors, cut = None, [], [], None
        stretches = len(shared.value.books)
        for b in batches:
            q, side = b.column(0).to_numpy(), b.column(1).to_numpy()
            # stretches of one block and one side, of at most a tile of codes
            ends = np.flatnonzero((np.diff(q) != 0) | (np.diff(side) != 0)) + 1
            for lo, hi in zip([0, *ends], [*ends, len(q)], strict=True) if len(q) else ():
                if q[lo] != block:
                    if cut is not None:
                        yield cut.rows()
                    block, ids, vectors, cut = q[lo], [], [], None
                if side[lo] == 0:
                    ids.append(b.column(2).slice(lo, hi - lo).to_numpy())
                    vectors.append(_rows(b.column(6).slice(lo, hi - lo)))
                elif ids:
                    cut = cut or Cut(Asked(shared.value, np.concatenate(ids), np.concatenate(vectors), probes, same), rerank)
                    for i in range(lo, hi, CODED // BUNDLE):
                        part = b.slice(i, min(CODED // BUNDLE, hi - i))
                        seen = _bytes(part.column(3), "<i8"), _bytes(part.column(4), "<i4"), _bytes(part.column(5), np.uint8).reshape(-1, stretches)
                        cut.count(*seen) if side[lo] == 1 else cut.find(*seen)
        if cut is not None:
            yield cut.rows()

    return dealt.transform(map_arrow, run, "id long, level int, last long")


READS = "query_id long, chunk_id long, similarity double, read long"


def top_k(queries: DataFrame, index: CodeIndex, k: int, rerank: int = 1000, probes: int | None = None, same: bool = True) -> DataFrame:
    """(query_id, chunk_id, similarity, rank, vectors_read): nearest chunks by whole vectors among each query's candidates.

    Ties go to the smaller chunk id; ``vectors_read`` is how many vectors were
    compared for the query. A chunk is found if it is among the ``rerank``
    likeliest by its code; with ``rerank`` of all chunks the result is exact.
    Up to ``BLOCK`` queries go to every task with the chunks it reads; more are
    dealt into blocks, and chunks into stretches of ``READ``. A task keeps k
    chunks a query, and what moves beside vectors is as much.
    """
    spark = queries.sparkSession
    asked = queries.select(F.col("id").cast("long"), F.col("embedding").cast("array<double>")).where("id is not null and embedding is not null")
    # a vector without a direction asks nothing
    asked = asked.where(F.exists("embedding", lambda x: x != 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)))
    if index.quantiser is None:
        found = spark.createDataFrame([], READS)
    elif asked.count() <= BLOCK:
        found = _to_all(asked, index, k, rerank, probes, same)
    else:
        found = _in_blocks(asked, index, k, rerank, probes, same)
    w = Window.partitionBy("query_id")
    ranked = found.withColumn("vectors_read", F.sum("read").over(w)).where("chunk_id is not null")
    ranked = ranked.withColumn("rank", F.row_number().over(w.orderBy(F.col("similarity").desc(), "chunk_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "chunk_id", "similarity", "rank", "vectors_read")


def _to_all(asked: DataFrame, index: CodeIndex, k: int, rerank: int, probes: int | None, same: bool) -> DataFrame:
    """At most ``BLOCK`` queries, sent with each task."""
    if probes is not None:
        # the codes of other cells aren't read
        table = asked.toArrow()
        near = index.quantiser.cells(_rows(table.column("embedding").combine_chunks()), probes) if table.num_rows else np.zeros((0, 1), dtype=int)
        index = CodeIndex(index.quantiser, index.rows.where(F.col("cell").isin(*np.unique(near).tolist())), index.total)
    table = asked.join(cuts(asked, index, rerank, probes, same), "id").select("id", "embedding", "level", "last").toArrow()
    found = table.column("embedding").combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.float64()))
    ids, level, last = (table.column(c).to_numpy() for c in ("id", "level", "last"))
    shared = asked.sparkSession.sparkContext.broadcast((index.quantiser, ids, _rows(found), level, last))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantiser, ids, vectors, level, last = shared.value
        if not len(ids):
            return
        best = Nearest(Asked(quantiser, ids, vectors, probes, same), level, last, k)
        for b in batches:
            _compare(best, *b.columns)
        yield best.rows()

    return index.rows.select("id", "cell", "code", "embedding").transform(map_arrow, run, READS)


def _compare(best: Nearest, ids: pa.Array, cells: pa.Array, codes: pa.Array, vectors: pa.Array) -> None:
    if len(ids):
        best.see(ids.to_numpy(), cells.to_numpy(), _bytes(codes, np.uint8).reshape(len(ids), -1), _rows(vectors))


def _in_blocks(asked: DataFrame, index: CodeIndex, k: int, rerank: int, probes: int | None, same: bool) -> DataFrame:
    """Blocks of queries against stretches of chunks, a pair at a time; a chunk is sent once for each block of queries."""
    held = store(asked, "asked")
    n_asked, n_stored = -(-held.count() // BLOCK), max(1, -(-index.total // READ))
    shared = asked.sparkSession.sparkContext.broadcast(index.quantiser)
    cut = held.join(cuts(held, index, rerank, probes, same), "id")
    left = cut.select(_part("id", n_asked).alias("q"), _every(F.lit(n_stored)).alias("c"), F.lit(0).alias("side"), "id", F.col("level").alias("cell"), "last", F.expr("cast(null as binary) as code"), "embedding")
    right = index.rows.select(_every(F.lit(n_asked)).alias("q"), _part("id", n_stored).alias("c"), F.lit(1).alias("side"), "id", "cell", F.expr("cast(null as long) as last"), "code", "embedding")
    dealt = left.unionByName(right).repartition("q", "c").sortWithinPartitions("q", "c", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, best = None, [], None
        for b in batches:
            q, c, side = (b.column(i).to_numpy() for i in range(3))
            ends = np.flatnonzero((np.diff(q) != 0) | (np.diff(c) != 0) | (np.diff(side) != 0)) + 1
            for lo, hi in zip([0, *ends], [*ends, len(q)], strict=True) if len(q) else ():
                if (q[lo], c[lo]) != key:
                    if best is not None:
                        yield best.rows()
                    key, parts, best = (q[lo], c[lo]), [], None
                part = b.slice(lo, hi - lo)
                if side[lo] == 0:
                    parts.append((part.column(3).to_numpy(), _rows(part.column(7)), part.column(4).to_numpy(), part.column(5).to_numpy()))
                elif parts:
                    if best is None:
                        ids, vectors, level, last = (np.concatenate(x) for x in zip(*parts, strict=True))
                        best = Nearest(Asked(shared.value, ids, vectors, probes, same), level, last, k)
                    _compare(best, part.column(3), part.column(4), part.column(6), part.column(7))
        if best is not None:
            yield best.rows()

    return dealt.transform(map_arrow, run, READS)
