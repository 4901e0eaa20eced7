"""Hard negatives by blocked products of vectors.

Anchors are read a block of ``BLOCK`` at a time; the block goes to every task,
which multiplies it with the vectors of its batches, a tile at a time. Scaled
components are whole numbers, so products in doubles are exact (``vectors``).
A first pass keeps each anchor's best positives: a task emits its own best, and
those of all tasks merge by rank. They set each pair's window of scores, with
which the second pass keeps the best negatives in the same way. What a task
holds is one block, its best so far and one tile; what moves is ``positives``
rows, then ``positives * negatives`` rows, an anchor and task. The anchors are
a set of queries against all rows: work is anchors times rows, a pass of the
vectors for each ``BLOCK`` anchors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm.common import map_arrow, store
from loomstone.llm.vectors import quantised, require_exact

#: Anchors of a block, 8 MB of 64 components.
BLOCK = 1 << 14
#: Rows of vectors and products of a tile.
ROWS = 1 << 12
TILE = 1 << 21
_NONE = np.iinfo(np.int64).max


class Kept:
    """The best k (score, id) so far of each of n rows, higher scores first, ties by the smaller id."""

    def __init__(self, n: int, k: int) -> None:
        self.score, self.id = np.full((n, k), -np.inf), np.full((n, k), _NONE)

    def see(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` of the rows ``at`` with columns ``ids``, which ascend; -inf doesn't count."""
        k = self.score.shape[1]
        top = scores.max(axis=1, initial=-np.inf)
        rows = np.flatnonzero((top >= self.score[at, -1]) & (top > -np.inf))
        if not len(rows):
            return
        s = scores[rows]
        least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(rows), -np.inf)
        take = s > least[:, None]
        # of those that tie for the last places, the smaller ids
        tied = (s == least[:, None]) & (least > -np.inf)[:, None]
        tied &= np.cumsum(tied, axis=1) <= (k - take.sum(axis=1))[:, None]
        r, c = np.nonzero(take | tied)
        own = at[rows]
        row = np.concatenate([r, np.repeat(np.arange(len(rows)), k)])
        score = np.concatenate([s[r, c], self.score[own].ravel()])
        key = np.concatenate([ids[c], self.id[own].ravel()])
        order = np.lexsort((key, -score, row))
        row = row[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        first = order[rank < k]
        self.score[own], self.id[own] = score[first].reshape(-1, k), key[first].reshape(-1, k)

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        return np.nonzero(self.score > -np.inf)


class Block:
    """Anchors with their numbers, which are those of their rows here."""

    def __init__(self, ids: list[int], labels: list[int], vectors: list[list[float]], scale: float) -> None:
        self.id, self.label = np.array(ids, dtype=np.int64), np.array(labels, dtype=np.int64)
        column = pa.array(vectors, pa.list_(pa.float64()))
        #: number of components -> (numbers of the anchors, their vectors)
        self.of_size = {m.shape[1]: (rows, m) for rows, m in quantised(column, scale)}
        for m in (m for _, m in self.of_size.values()):
            require_exact(m, _limit(m.shape[1]))

    def tiles(self, size: int, rows: np.ndarray) -> Iterator[np.ndarray]:
        """Stretches of the anchors ``rows`` that meet ``size`` vectors at a time."""
        step = max(1, TILE // max(1, size))
        return (rows[i : i + step] for i in range(0, len(rows), step))


def _limit(n: int) -> float:
    return np.floor(np.sqrt(2.0**53 / max(1, n)))


def _met(batches: Iterator[pa.RecordBatch], block: Block, scale: float) -> Iterator[tuple]:
    """(numbers of anchors, their vectors, ids, labels, vectors) for each stretch of rows as long as the anchors, ids ascending."""
    for b in batches:
        for at, m in quantised(b.column(2), scale):
            if m.shape[1] not in block.of_size:
                continue
            require_exact(m, _limit(m.shape[1]))
            ids, labels = b.column(0).to_numpy()[at], b.column(1).to_numpy()[at]
            for i in range(0, len(ids), ROWS):
                order = i + np.argsort(ids[i : i + ROWS], kind="stable")
                yield *block.of_size[m.shape[1]], ids[order], labels[order], m[order]


def _own(scores: np.ndarray, anchors: np.ndarray, ids: np.ndarray) -> None:
    """Rows of an anchor's own id don't count for it."""
    for j in np.flatnonzero(np.isin(ids, anchors)):
        scores[anchors == ids[j], j] = -np.inf


def best_positives(batches: Iterator[pa.RecordBatch], block: Block, k: int, scale: float) -> Kept:
    kept = Kept(len(block.id), k)
    for anchors, vectors, ids, labels, m in _met(batches, block, scale):
        of = block.label[anchors]
        for label in np.intersect1d(labels, of):
            c, a = np.flatnonzero(labels == label), np.flatnonzero(of == label)
            for part in block.tiles(len(c), a):
                scores = vectors[part] @ m[c].T
                _own(scores, block.id[anchors[part]], ids[c])
                kept.see(anchors[part], scores, ids[c])
    return kept


def best_negatives(batches: Iterator[pa.RecordBatch], block: Block, low: np.ndarray, high: np.ndarray, k: int, scale: float) -> list[Kept]:
    """For each place among the positives, the best rows of other labels with low <= score <= high; low > high for none."""
    kept = [Kept(len(block.id), k) for _ in range(low.shape[1])]
    for anchors, vectors, ids, labels, m in _met(batches, block, scale):
        for part in block.tiles(len(ids), np.flatnonzero((low[anchors] <= high[anchors]).any(axis=1))):
            scores = vectors[part] @ m.T
            at = anchors[part]
            scores[block.label[at][:, None] == labels[None, :]] = -np.inf
            for p, one in enumerate(kept):
                least = np.maximum(low[at, p], one.score[at, -1])
                inside = (scores >= least[:, None]) & (scores <= high[at, p][:, None])
                some = np.flatnonzero(inside.any(axis=1))
                if len(some):
                    one.see(at[some], np.where(inside[some], scores[some], -np.inf), ids)
    return kept


def _blocks(anchors: DataFrame, scale: float) -> Iterator[Block]:
    """The anchors, a block at a time; the driver holds one block and one partition's rows."""
    held: list = []
    for row in anchors.toLocalIterator():
        held.append(row)
        if len(held) == BLOCK:
            yield Block(*map(list, zip(*held, strict=True)), scale)
            held = []
    if held:
        yield Block(*map(list, zip(*held, strict=True)), scale)


FOUND = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(
    rows: DataFrame, asks: Column, label: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """For each anchor and each of its best ``positives`` rows of the same label, the best ``negatives`` of other labels in its window.

    ``asks`` says which rows are anchors, ``label`` is a whole number. Score:
    the inner product of floor(scale * x) with the anchor; higher first, ties by
    the smaller id. Window: low * positive <= 100 * negative <= high * positive,
    so a negative positive_score has none. Columns: ``FOUND``; ``rank`` from 1.

    Rows without id, label or vector, or with a null or non-finite component,
    take no part. Vectors of different length don't meet. Rows with the
    anchor's own id are not its positives; otherwise repeated rows count as
    often as they occur, and a repeated anchor is mined each time. An empty
    table gives none. Components whose products would not be exact in doubles
    (beyond 2**23 after scaling, for 64) are an error.
    """
    named = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).alias("v"), asks.alias("asks"))
    every = named.where("id is not null and label is not null and v is not null")
    anchors = store(every.where("asks").drop("asks"), "anchors")
    every = every.drop("asks")
    parts = []
    for block in _blocks(anchors, scale):
        if parts and parts[-1][1]:  # there is a further block: write what the last one gave
            parts[-1] = store(parts[-1][0], "negatives"), False
        parts.append((_mine_block(every, block, positives, negatives, low, high, scale), True))
    found = [p for p, _ in parts] or [rows.sparkSession.createDataFrame([], FOUND)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _mine_block(every: DataFrame, block: Block, positives: int, negatives: int, low: int, high: int, scale: float) -> DataFrame:
    context = every.sparkSession.sparkContext
    shared = context.broadcast(block)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = best_positives(batches, shared.value, positives, scale)
        r, c = kept.found()
        cols = r.astype(np.int32), kept.id[r, c], kept.score[r, c].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["a", "id", "score"])

    first = every.transform(map_arrow, near, "a int, id long, score long")
    w = Window.partitionBy("a").orderBy(F.col("score").desc(), "id")
    # At most ``positives`` rows an anchor of the block.
    best = first.withColumn("p", F.row_number().over(w) - 1).where(F.col("p") < positives).toArrow()
    a, p, ids, scores = (best.column(c).to_numpy() for c in ("a", "p", "id", "score"))
    of_id, of_score = np.zeros((len(block.id), positives), dtype=np.int64), np.zeros((len(block.id), positives), dtype=np.int64)
    of_id[a, p], of_score[a, p] = ids, scores
    least, most = np.full(of_id.shape, 1.0), np.full(of_id.shape, 0.0)
    least[a, p], most[a, p] = -((-low * scores) // 100), (high * scores) // 100
    windows = context.broadcast((of_id, of_score, least, most))

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, (of_id, of_score, least, most) = shared.value, windows.value
        for p, kept in enumerate(best_negatives(batches, block, least, most, negatives, scale)):
            r, c = kept.found()
            cols = r.astype(np.int32), np.full(len(r), p, dtype=np.int32), block.id[r], of_id[r, p], kept.id[r, c], of_score[r, p], kept.score[r, c].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["a", "p", "anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    second = every.transform(map_arrow, far, "a int, p int, anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    w = Window.partitionBy("a", "p").orderBy(F.col("negative_score").desc(), "negative_id")
    ranked = second.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
