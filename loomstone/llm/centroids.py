"""Centroid clustering with adaptive bounds, exact in whole numbers.

Each vector is kept with its cluster, the nearest few other centroids with a
lower bound of the distance to each, and one lower bound for all the rest. When
centroids move, bounds shrink by the way moved. A centroid whose bound stays
above the distance to the vector's own centroid can't be nearer, so only those
below it are looked at; where the rest isn't certified, all are. Distances are
worked out in whole numbers, so ties are seen exactly. How many bounds are kept
follows from how many the round before had to look at.

A round reads the vectors with their bounds, writes them again to the shared
folder, and sums each cluster in Spark: a task sends one row a cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import discard, map_arrow, store
from loomstone.llm.vectors import quantised, require_exact

#: What a bound must clear a distance by: far more than rounding can have moved either.
MARGIN = 1e-6
STATE = "id long, x array<int>, cluster int, near array<int>, lower array<double>, rest double, depth int"


def squares(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, exact for whole numbers within the limit."""
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ centroids.T) + (centroids * centroids).sum(axis=1)[None, :]


class Bounds:
    """Cluster, near centroids, their lower bounds and the bound of the rest, for some vectors."""

    def __init__(self, cluster: np.ndarray, near: np.ndarray, lower: np.ndarray, rest: np.ndarray) -> None:
        self.cluster, self.near, self.lower, self.rest = cluster, near, lower, rest

    @classmethod
    def of(cls, x: np.ndarray, centroids: np.ndarray, keep: int) -> Bounds:
        """By looking at all centroids."""
        d = squares(x, centroids)
        order = np.argsort(d, axis=1, kind="stable")  # ties: the smaller number
        far = np.sqrt(np.take_along_axis(d, order, axis=1))
        rest = far[:, keep + 1] if far.shape[1] > keep + 1 else np.full(len(x), np.inf)
        return cls(order[:, 0], order[:, 1 : keep + 1], far[:, 1 : keep + 1], rest)

    def moved(self, x: np.ndarray, centroids: np.ndarray, way: np.ndarray, keep: int) -> tuple[Bounds, np.ndarray]:
        """The same after centroids moved by ``way``, with ``keep`` bounds; and how many near centroids each vector had to look at (all: -1)."""
        n, every = len(x), np.arange(len(x))
        cluster, near = self.cluster.copy(), self.near.copy()
        lower = self.lower - way[near]
        rest = self.rest - way.max(initial=0)
        square = ((x - centroids[cluster]) ** 2).sum(axis=1)
        own = np.sqrt(square) + MARGIN
        depth = np.zeros(n, dtype=np.int32)
        scan = rest <= own
        look = np.flatnonzero(~scan & (lower <= own[:, None]).any(axis=1))
        if len(look):
            below = lower[look] <= own[look, None]
            d = np.full(below.shape, np.inf)
            for j in range(below.shape[1]):
                r = np.flatnonzero(below[:, j])
                d[r, j] = ((x[look[r]] - centroids[near[look[r], j]]) ** 2).sum(axis=1)
            lower[look] = np.where(below, np.sqrt(d), lower[look])
            depth[look] = below.shape[1] - np.argmax(below[:, ::-1], axis=1)
            # the first by (distance, number) of the own centroid and those looked at
            numbers = np.concatenate([cluster[look, None], near[look]], axis=1)
            both = np.concatenate([square[look, None], d], axis=1)
            tied = np.where(both == both.min(axis=1, keepdims=True), numbers, len(centroids))
            at = tied.argmin(axis=1)
            swap = np.flatnonzero(at > 0)
            r, j = look[swap], at[swap] - 1
            cluster[r], near[r, j], lower[r, j] = near[r, j], cluster[r], np.sqrt(square[r])
        if scan.any():
            anew = Bounds.of(x[scan], centroids, near.shape[1])
            cluster[scan], near[scan], lower[scan], rest[scan] = anew.cluster, anew.near, anew.lower, anew.rest
            depth[scan] = -1
        order = np.argsort(lower, axis=1, kind="stable")
        near, lower = near[every[:, None], order], lower[every[:, None], order]
        if near.shape[1] > keep:
            rest = np.minimum(rest, lower[:, keep:].min(axis=1))
            near, lower = near[:, :keep], lower[:, :keep]
        return Bounds(cluster, near, lower, rest), depth


def _state(ids: pa.Array, x: np.ndarray, b: Bounds, depth: np.ndarray) -> pa.RecordBatch:
    lists = lambda m, kind: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel(), kind))
    cols = [ids, lists(x, pa.int32()), pa.array(b.cluster, pa.int32()), lists(b.near, pa.int32()), lists(b.lower, pa.float64()), pa.array(b.rest), pa.array(depth, pa.int32())]
    return pa.RecordBatch.from_arrays(cols, names=["id", "x", "cluster", "near", "lower", "rest", "depth"])


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if len(flat) else np.zeros((n, 0), dtype=flat.dtype)


def _read(b: pa.RecordBatch) -> tuple[np.ndarray, Bounds]:
    n = b.num_rows
    return _matrix(b.column(1), n).astype(float), Bounds(b.column(2).to_numpy(), _matrix(b.column(3), n), _matrix(b.column(4), n), b.column(5).to_numpy())


def _whole(v: Column, dims: int) -> Column:
    """Exactly ``dims`` components, none null or non-finite."""
    return (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))


def starts(rows: DataFrame, k: int, dims: int, seed: str, scale: float) -> np.ndarray:
    """The vectors of the k smallest digests of ``seed:id``; rows without id start none, equal digests go by their components."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    drawn = rows.where(F.col("id").isNotNull() & _whole(F.col("v"), dims)).select(digest.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.floor(np.array([r.v for r in drawn], dtype=float).reshape(len(drawn), dims) * scale)


def _means(stored: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floors of each cluster's means; an empty cluster's centroid stays. One row a cluster reaches the driver."""
    sums = stored.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*(F.sum(F.col("x")[i].cast("long")) for i in range(centroids.shape[1]))).alias("s"))
    out = centroids.copy()
    for r in sums.collect():
        out[r.cluster] = [s // r.n for s in r.s]
    return out


def cluster(rows: DataFrame, k: int = 16, rounds: int = 3, scale: float = 64.0, dims: int = 64, seed: str = "1", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every vector of ``dims`` finite components, as floor(scale * x).

    Centroids start as the vectors of the k smallest digests of ``seed:id``;
    each round assigns every vector to the nearest (ties: the smaller number)
    and moves every centroid that has vectors to the floor of their mean; then
    vectors are assigned once more. Fewer vectors than k give as many
    centroids, an empty table no rows. Rows without vector, of another length
    or with a null or non-finite component are left out; a row without id is
    clustered but starts no centroid, unless no row has an id (then there is
    none and no row is returned). Repeated rows count as often as they occur.
    Components whose squares would not be exact in doubles (beyond 2**22 after
    scaling, for 64) are an error.
    """
    spark = rows.sparkSession
    named = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    limit = np.floor(np.sqrt(2.0**51 / dims))
    centroids = starts(named, k, dims, seed, scale)
    require_exact(centroids, limit)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    least = -(-k // 8)
    keep = max(1, min(-(-k // 4), len(centroids) - 1))
    shared = spark.sparkContext.broadcast(centroids)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in quantised(b.column(1), scale):
                if x.shape[1] == dims and len(at):
                    require_exact(x, limit)
                    yield _state(b.column(0).take(pa.array(at)), x, Bounds.of(x, shared.value, keep), np.full(len(at), -1))

    held = store(named.transform(map_arrow, first, STATE), "clusters")
    for _ in range(rounds):
        before, centroids = centroids, _means(held, centroids)
        deepest = held.agg(F.max("depth")).head()[0]
        # a first round looks at all: how deep is known from the second on
        keep = max(1, min(keep, max(least, deepest))) if deepest and deepest > 0 else keep
        moved = held.transform(map_arrow, _mover(spark, before, centroids, keep), STATE)
        after = store(moved, "clusters")
        discard(held)
        held = after
    return _described(held, centroids, id_col)


def _mover(spark, before: np.ndarray, centroids: np.ndarray, keep: int):
    shared = spark.sparkContext.broadcast((centroids, np.sqrt(((centroids - before) ** 2).sum(axis=1)) + MARGIN))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, bounds = _read(b)
                yield _state(b.column(0), x, *bounds.moved(x, *shared.value, keep))

    return run


def _described(held: DataFrame, centroids: np.ndarray, id_col: str) -> DataFrame:
    """Distances and sums of them; one row a centroid goes to every task."""
    spark = held.sparkSession
    shared = spark.sparkContext.broadcast(centroids)

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1), b.num_rows).astype(float)
                d = ((x - shared.value[b.column(2).to_numpy()]) ** 2).sum(axis=1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(d)], names=["id", "cluster", "distance"])

    ends = store(held.select("id", "x", "cluster").transform(map_arrow, distances, "id long, cluster int, distance long"), "distances")
    discard(held)
    inertia = {r.cluster: r.s for r in ends.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    total = sum(inertia.values())
    named = [(i, inertia.get(i, 0), total, hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest()) for i, c in enumerate(centroids)]
    table = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return ends.join(F.broadcast(table), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
