"""N-gram Jaccard join by grouped prefixes.

A document's set holds its distinct word shingles. Two sets of sizes m <= n
link when their Jaccard similarity reaches ``num / den``, which needs
n * num <= m * den and one common shingle among the first
n - ceil(n * num / den) + 1 of each in a fixed order of all shingles (prefix
filter). The order is by a counter of the shingle's hash cell, then the hash:
the counters cover all documents and have a fixed size (2**SKETCH_BITS), so
shingles of widely shared passages come late and stay out of prefixes. Any
order is right; the counters only make it a good one.

1. sketch: one pass counts shingles by cell.
2. prefixes: one pass gives each document its set's digest, size, prefix and
   parities: bits that tell whether a cell of shingles holds an odd number.
   Two sets differ in at least as many shingles as their parities differ in
   bits, so a pair that differs in too many can't link (parity filter).
3. classes: documents with equal sets become one class; classes with equal
   size and prefix become one group.
4. hubs: for each shingle, groups meet the group in which it stands earliest (a
   hub, usually the original of edited copies), members their group. Size,
   position and parity filters apply to each pair.
5. verify: what is left is compared on its words, exactly; a hub's text is sent
   once for each task that needs it.
6. families: groups that met one hub, and the members of one group, are a
   family; every pair that can link lies in one. Where a family is in several
   components after linking, its members are compared by size and parities, in
   blocks on arrays, a pair of blocks at a time. First, of the pairs that pass
   between two components, one a block leaves its task and is verified. Then
   only members leave that still have a pair which passes.
7. settle: texts of these members meet a pair of blocks at a time, where a
   product of their sets counts what any two share, on their words; links that
   join two components leave the task, at most one a member. So a text is sent
   once for each block of its family, however many pairs parities can't decide.
8. degrees (if asked for): linked classes are in one component, so the classes
   of a component are counted against each other, in blocks as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import as_bytes, discard, map_arrow, store
from loomstone.llm.components import connected_components

SKETCH_BITS = 20
BLOCK_BITS = 12
#: Shingles, with repeats over classes, and classes of a block in the count of links.
BLOCK_SHINGLES = 1 << 18
BLOCK_CLASSES = 1 << 9
#: Members of a family's block, and bytes of their parities.
BLOCK_MEMBERS = 1 << 12
BLOCK_BYTES = 1 << 23
#: Pairs with one hub that share a copy of its text.
HUB_PAIRS = 1 << 11


def shingles_of(words: list[bytes], width: int) -> list[tuple[bytes, ...]]:
    """Shingles in text order, with repeats; fewer words than ``width`` give one shingle of them all."""
    if len(words) >= width:
        return list(zip(*(words[i:] for i in range(width)), strict=False))
    return [tuple(words)] if words else []


class Hasher:
    """64-bit hashes of a text's distinct shingles, in numpy.

    A word's hash is its stretch of one running sum over the text's bytes, each
    weighted by a power of an odd number that has an inverse modulo 2**64.
    """

    _BASE = 0x9E3779B97F4A7C15
    _BYTES = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    _SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])

    def __init__(self, width: int) -> None:
        self.width = width
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        self.up = self._powers(self._BASE, n)
        self.down = self._powers(pow(self._BASE, -1, 2**64), n)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def words(self, text: bytes) -> np.ndarray:
        b = np.frombuffer(text.lower(), dtype=np.uint8)
        if len(b) > len(self.up):
            self._grow(2 * len(b))
        gap = np.ones(len(b) + 2, dtype=bool)
        gap[1:-1] = self._SPACE[b]
        at = np.flatnonzero(gap[1:] != gap[:-1])
        start, end = at[0::2], at[1::2]
        sums = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum(self._BYTES[b] * self.up[: len(b)], out=sums[1:])
        h = (sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        return h

    def __call__(self, text: bytes) -> np.ndarray:
        h = self.words(text)
        if not len(h):
            return h
        n = min(self.width, len(h))
        out = np.full(len(h) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            out ^= h[i : len(h) - n + 1 + i]
            out *= np.uint64(self._BASE)
            out ^= out >> np.uint64(29)
        out.sort()
        new = np.ones(len(out), dtype=bool)
        np.not_equal(out[1:], out[:-1], out=new[1:])
        return out[new]


def _cells(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def sketch(docs: DataFrame, text_col: str, width: int) -> np.ndarray:
    """How many documents hold a shingle of each cell, over all documents; 2**SKETCH_BITS counters."""
    size = 1 << BLOCK_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total = Hasher(width), np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for b in batches:
            parts = [_cells(hasher(t.as_py())) for t in b.column(0)]
            if parts:
                total += np.bincount(np.concatenate(parts), minlength=len(total))
        for k, part in enumerate(total.reshape(-1, size)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.astype("<i4").tobytes()], pa.binary())], names=["k", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[k] = np.minimum(total.get(k, 0) + np.frombuffer(part, dtype="<i4").astype(np.int64), 2**31 - 1)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.astype("<i4").tobytes() for v in total.values()], pa.binary())], names=["k", "part"])

    parts = docs.select(as_bytes(text_col).alias("t")).transform(map_arrow, count, "k int, part binary")
    summed = parts.repartition("k").transform(map_arrow, add, "k int, part binary")
    out = np.zeros(1 << SKETCH_BITS, dtype=np.int32)
    # At most 2**(SKETCH_BITS - BLOCK_BITS) rows, four bytes a counter in all.
    for row in summed.collect():
        out[row.k * size : (row.k + 1) * size] = np.frombuffer(row.part, dtype="<i4")
    return out


def parities(h: np.ndarray, num: int, den: int) -> bytes:
    """For each of a power of two of cells whether it holds an odd number of the set's hashes; about eight cells for each difference allowed."""
    allowed = 2 * len(h) * (den - num) // (den + num)
    cells = max(64, 1 << (8 * allowed).bit_length())
    return np.packbits(np.bincount((h & np.uint64(cells - 1)).astype(np.int64), minlength=cells).astype(np.uint8) & 1, bitorder="little").tobytes()


def folded(words: np.ndarray, n: int) -> np.ndarray:
    """Parities of ``n`` words from those of more: cells that become one add up."""
    while words.shape[-1] > n:
        half = words.shape[-1] // 2
        words = words[..., :half] ^ words[..., half:]
    return words


def prefixes(docs: DataFrame, counts: np.ndarray, text_col: str, width: int, num: int, den: int) -> DataFrame:
    """doc_id, n, digests of the set and of the prefix (two longs each), parities and the prefix in order, for each row."""
    spark = docs.sparkSession
    # Steps of a 256th of a doubling: sixteen bits sort fast, and any order will do.
    shared = spark.sparkContext.broadcast((np.log2(1.0 + counts) * 256).astype(np.uint16))
    schema = pa.schema([*((x, pa.int64()) for x in ("doc_id", "n", "s1", "s2", "p1", "p2")), ("par", pa.binary()), ("prefix", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = Hasher(width), shared.value
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                h = hasher(text.as_py())
                n = len(h)
                first = h[np.argsort(seen[_cells(h)], kind="stable")[: n - -(-n * num // den) + 1]] if n else h
                digests = xxhash.xxh3_128_digest(h.tobytes()) + xxhash.xxh3_128_digest(first.tobytes())
                rows.append((doc_id, n, *np.frombuffer(digests, dtype="<i8").tolist(), parities(h, num, den), first.view(np.int64)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return docs.select("doc_id", as_bytes(text_col).alias("t")).transform(map_arrow, run, "doc_id long, n long, s1 long, s2 long, p1 long, p2 long, par binary, prefix array<long>")


def possible(num: int, den: int) -> Column:
    """Size and position filters for a pair of sets (n, pos) and (n2, pos2) that share a prefix shingle."""
    least = F.ceil((F.col("n") + F.col("n2")) * num / (num + den))
    left = F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2"))
    # pos counts from 0. The first common shingle has at most this many common ones from it on; a later
    # one has fewer, but then the pair also meets at the first.
    return (F.least("n", "n2") * den >= F.greatest("n", "n2") * num) & (left >= least)


def sift(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of classes whose sizes and parities let them link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(2).to_numpy(), b.column(3).to_numpy()
            keep = []
            for m, k, x, y in zip(*n, b.column(4), b.column(5), strict=True):
                x, y = np.frombuffer(x.as_py(), dtype="<u8"), np.frombuffer(y.as_py(), dtype="<u8")
                words = min(len(x), len(y))
                differ = int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum())
                keep.append(min(m, k) * den >= max(m, k) * num and differ * (den + num) <= (m + k) * (den - num))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = (classes.select(F.col("class_id").alias(x), F.col("n").alias(f"n{x}"), F.col("par").alias(f"p{x}")) for x in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "pa", "pb").transform(map_arrow, run, "a long, b long")


def verify(pairs: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets, on their words, link.

    b's text comes ahead of the texts that meet it. Where many do, they are
    dealt to several stretches of rows, each with a copy of b's text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub: set = set()
        for batch in batches:
            a, b = [], []
            for y, x, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = set(shingles_of(text.as_py().lower().split(), width))
                if x is None:
                    hub = own
                    continue
                common = len(own & hub)
                if den * common >= num * (len(own) + len(hub) - common):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    stretches = pairs.groupBy("b").agg(F.ceil(F.count("*") / HUB_PAIRS).cast("int").alias("stretches"))
    met = pairs.join(stretches, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("stretches")).cast("int").alias("stretch"))
    met = met.join(texts.withColumnRenamed("doc_id", "a"), "a").select("b", "stretch", "a", "t")
    hubs = stretches.join(texts.withColumnRenamed("doc_id", "b"), "b")
    hubs = hubs.select("b", F.explode(F.sequence(F.lit(0), F.col("stretches") - 1)).alias("stretch"), F.lit(None).cast("long").alias("a"), "t")
    rows = met.unionByName(hubs).repartition("b", "stretch").sortWithinPartitions("b", "stretch", F.asc_nulls_first("a"))
    return rows.select("b", "a", "t").transform(map_arrow, run, "a long, b long")


def texts_of(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_id, t): the texts of the documents that a pair names, one for each id."""
    named = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    # Merged at every size, for a cost that grows with the documents alone.
    return store(docs.join(named.hint("merge"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(as_bytes()).alias("t")), "join-texts")


def common_counts(sets: list[list[int]], n_left: int) -> np.ndarray:
    """How many numbers each of the first ``n_left`` sets shares with each of the others, or of these if there are no others."""
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    col = np.fromiter((x for part in sets for x in part), np.int64, len(row))
    # What one set alone holds is common to no pair.
    held = np.bincount(col) > 1
    row, col = row[held[col]], (np.cumsum(held) - 1)[col[held[col]]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    n = int(col[-1]) + 1 if len(col) else 0
    out = np.zeros((n_left, len(sets) - n_left or n_left))
    step = max(1, (1 << 23) // len(sets))
    for at in range(0, n, step):
        lo, hi = np.searchsorted(col, (at, at + step))
        part = np.zeros((len(sets), min(step, n - at)), dtype=np.float32)
        part[row[lo:hi], col[lo:hi] - at] = 1
        # Whole numbers below 2**24 are exact as float32.
        out += part[:n_left] @ (part[n_left:] if n_left < len(sets) else part).T
    return out


def block_links(rows: list[tuple[int, int, bytes]], width: int, num: int, den: int) -> Iterator[tuple[int, int]]:
    """(class, number of links) over the pairs of two blocks (sides 0 and 1) or within one (side 2); rows are (class, side, text)."""
    ids: dict[tuple[bytes, ...], int] = {}
    rows = sorted(rows, key=lambda r: r[1] == 1)
    n_left = sum(r[1] != 1 for r in rows)
    within = rows[0][1] == 2
    if not n_left or (n_left == len(rows) and not within):
        return
    sets = [[ids.setdefault(x, len(ids)) for x in set(shingles_of(t.lower().split(), width))] for _, _, t in rows]
    common, size = common_counts(sets, n_left), np.array([len(x) for x in sets])
    links = den * common >= num * (size[:n_left, None] + (size if within else size[n_left:]) - common)
    if within:
        np.fill_diagonal(links, False)
    degree = links.sum(axis=1) if within else np.concatenate([links.sum(axis=1), links.sum(axis=0)])
    yield from ((r[0], int(d)) for r, d in zip(rows, degree, strict=True) if d)


def degrees(docs: DataFrame, classes: DataFrame, links: DataFrame, labels: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(node, n_links): with how many classes each class of a component links, over all pairs of the component.

    Where the links found are all pairs of the component, no text is read. Other
    components are dealt into blocks by a hash of the class; each pair of blocks
    meets in one task, which gives a number a class, so no list of pairs is made.
    """
    pairs = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    found = pairs.join(labels, pairs["a"] == labels["node"]).groupBy("component").agg(F.count("*").alias("found"))
    sized = labels.join(classes.select(F.col("class_id").alias("node"), "n"), "node")
    sizes = sized.groupBy("component").agg(F.count("*").alias("k"), F.sum("n").alias("total")).join(found, "component")
    blocks = F.ceil(F.greatest(F.col("total") / BLOCK_SHINGLES, F.col("k") / BLOCK_CLASSES)).cast("int")
    whole = F.col("found") * 2 == F.col("k") * (F.col("k") - 1)
    placed = store(sized.join(sizes.select("component", "k", whole.alias("whole"), blocks.alias("blocks")), "component"), "join-blocks")

    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = placed.where("not whole").select("node", "component", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    dealt = dealt.select("component", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "node", side.alias("side"))
    texts = texts_of(docs, placed.where("not whole").select(F.col("node").alias("a"), F.col("node").alias("b")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(rows: list) -> pa.RecordBatch:
            got = list(block_links(rows, width, num, den))
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], pa.int64()) for i in range(2)], names=["node", "n_links"])

        key, rows = None, []
        for b in batches:
            for *at, node, its, text in zip(*(b.column(i).to_pylist() for i in range(5)), b.column(5), strict=True):
                if at != key:
                    if rows:
                        yield counted(rows)
                    key, rows = at, []
                rows.append((node, its, text.as_py()))
        if rows:
            yield counted(rows)

    # A pair of blocks comes as one stretch of a task's rows.
    met = dealt.join(texts.withColumnRenamed("doc_id", "node"), "node").select("component", "lo", "hi", "node", "side", "t")
    counted = met.repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi").transform(map_arrow, run, "node long, n_links long")
    counted = counted.unionByName(placed.where("whole").select("node", (F.col("k") - 1).alias("n_links")))
    return store(counted.groupBy("node").agg(F.sum("n_links").alias("n_links")), "join-degrees")


def close_pairs(rows: list[tuple[int, int, int, int, bytes]], num: int, den: int, forest: bool) -> Iterator[tuple[int, int]]:
    """Pairs of classes in different components that sizes and parities let link, between sides 0 and 1 or within side 2.

    Rows are (class, side, component, n, parities). ``forest``: of the pairs
    between two components, as joined by earlier pairs, only the first.
    """
    within = rows[0][1] == 2
    order = sorted(range(len(rows)), key=lambda r: rows[r][3])
    right = [r for r in order if within or rows[r][1] == 1]
    place = {r: k for k, r in enumerate(right)}
    names = {c: k for k, c in enumerate(dict.fromkeys(r[2] for r in rows))}
    component = np.array([names[r[2]] for r in rows])
    of_right = np.array(right, dtype=np.int64)
    size = np.array([rows[r][3] for r in right], dtype=np.int64)
    words = np.array([len(rows[r][4]) // 8 for r in right])
    # Larger sets have no fewer cells, so rows of one width are one stretch of the right side.
    stretches = []
    for w in np.unique(words).tolist():
        lo, hi = np.searchsorted(words, (w, w + 1))
        stretches.append((int(lo), int(hi), {w: np.frombuffer(b"".join(rows[r][4] for r in right[lo:hi]), dtype="<u8").reshape(-1, w)}))
    for i in order:
        _, side, _, n, bits = rows[i]
        if side == 1:
            continue
        own = np.frombuffer(bits, dtype="<u8")
        low, high = np.searchsorted(size, -(-n * num // den)), np.searchsorted(size, n * den // num, side="right")
        if within:
            low = max(low, place[i] + 1)
        for lo, hi, held in stretches:
            lo_, hi_ = max(lo, int(low)), min(hi, int(high))
            if lo_ >= hi_:
                continue
            w = min(len(own), max(held))
            if w not in held:
                held[w] = folded(held[max(held)], w)
            differ = np.bitwise_count(held[w][lo_ - lo : hi_ - lo] ^ folded(own, w)).sum(axis=1, dtype=np.int64)
            met = of_right[lo_:hi_][differ * (den + num) <= (n + size[lo_:hi_]) * (den - num)]
            met = met[component[met] != component[i]]
            if forest:
                # one row of each component, which then is this row's own
                _, at = np.unique(component[met], return_index=True)
                met = met[at]
                for c in component[met].tolist():
                    component[component == c] = component[i]
            yield from ((rows[i][0], rows[r][0]) for r in met.tolist())


def stretches_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """The rows of each stretch with the same first ``keys`` columns, without these; the last column stays as Arrow has it until then."""
    key, rows = None, []
    for b in batches:
        n = b.num_columns - 1
        for *at, last in zip(*(b.column(i).to_pylist() for i in range(n)), b.column(n), strict=True):
            if at[:keys] != key:
                if rows:
                    yield rows
                key, rows = at[:keys], []
            rows.append((*at[keys:], last.as_py()))
    if rows:
        yield rows


def in_pairs(rows: DataFrame, key: str, node: str, blocks: Column, *more: str) -> DataFrame:
    """Rows of each ``key`` dealt into blocks by ``node``, once for each pair of blocks: key, lo, hi, side (0, 1, or 2 within a block) and ``more``."""
    own = F.pmod(F.xxhash64(node), blocks).cast("int")
    dealt = rows.select(key, node, *more, own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    return dealt.select(key, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), node, side.alias("side"), *more)


def family_blocks(families: DataFrame, members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of families in several components, a pair of blocks in one stretch of a task's rows."""
    label = F.coalesce(F.col("component"), F.col("class_id")).alias("c")
    spread = members.join(labels, members["class_id"] == labels["node"], "left").select("g", "class_id", label, "n", "par")
    placed = store(families.join(spread, "g").select("family", "class_id", "c", "n", "par"), "join-families")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_MEMBERS, F.sum(F.octet_length("par")) / BLOCK_BYTES)).cast("int")
    mixed = placed.groupBy("family").agg(F.min("c").alias("first"), F.max("c").alias("last"), blocks.alias("blocks")).where("first < last").select("family", "blocks")
    dealt = in_pairs(placed.join(mixed, "family"), "family", "class_id", F.col("blocks"), "c", "n", "par")
    return dealt.repartition("family", "lo", "hi").sortWithinPartitions("family", "lo", "hi")


def apart(families: DataFrame, members: DataFrame, labels: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of classes of one family that sizes and parities let link, for each pair of blocks at most one between two components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in stretches_of(batches, 3):
            got = list(close_pairs(rows, num, den, True))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], pa.int64()) for i in range(2)], names=["a", "b"])

    met = family_blocks(families, members, labels).transform(map_arrow, run, "a long, b long")
    return met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def undecided(families: DataFrame, members: DataFrame, labels: DataFrame, num: int, den: int) -> DataFrame:
    """(family, node, c): classes that sizes and parities let link with one of another component of their family."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in stretches_of(batches, 3):
            of = {r[1]: (r[0], r[3]) for r in rows}
            nodes = {x for pair in close_pairs([r[1:] for r in rows], num, den, False) for x in pair}
            cols = [(of[x][0] for x in nodes), nodes, (of[x][1] for x in nodes)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], names=["family", "node", "c"])

    met = family_blocks(families, members, labels).select("family", "lo", "hi", F.col("family").alias("of"), "class_id", "side", "c", "n", "par")
    return met.transform(map_arrow, run, "family long, node long, c long").distinct()


def joining_links(rows: list[tuple[int, int, int, bytes]], width: int, num: int, den: int) -> Iterator[tuple[int, int]]:
    """Links, on words, that join components, between sides 0 and 1 or within side 2; rows are (class, side, component, text).

    Of the links between two components, as joined by earlier links, only the first.
    """
    ids: dict[tuple[bytes, ...], int] = {}
    rows = sorted(rows, key=lambda r: r[1] == 1)
    n_left = sum(r[1] != 1 for r in rows)
    if not n_left or (n_left == len(rows) and rows[0][1] != 2):
        return
    sets = [[ids.setdefault(x, len(ids)) for x in set(shingles_of(r[3].lower().split(), width))] for r in rows]
    common, size = common_counts(sets, n_left), np.array([len(x) for x in sets])
    first = 0 if rows[0][1] == 2 else n_left
    links = den * common >= num * (size[:n_left, None] + size[first:] - common)
    component = np.unique([r[2] for r in rows], return_inverse=True)[1]
    for i in range(n_left):
        met = np.flatnonzero(links[i]) + first
        met = met[component[met] != component[i]]
        _, at = np.unique(component[met], return_index=True)
        for k in met[at].tolist():
            yield rows[i][0], rows[k][0]
            component[component == component[k]] = component[i]


def settle(nodes: DataFrame, members: DataFrame, docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links (a, b) that join what is apart among the ``nodes`` of each family; texts meet a pair of blocks at a time."""
    sized = nodes.join(members.select(F.col("class_id").alias("node"), "n"), "node")
    blocks = F.ceil(F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count("*") / BLOCK_CLASSES)).cast("int")
    placed = sized.join(sized.groupBy("family").agg(blocks.alias("blocks")), "family")
    texts = texts_of(docs, nodes.select(F.col("node").alias("a"), F.col("node").alias("b")))
    dealt = in_pairs(placed, "family", "node", F.col("blocks"), "c").join(texts.withColumnRenamed("doc_id", "node"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in stretches_of(batches, 3):
            got = list(joining_links(rows, width, num, den))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in got], pa.int64()) for i in range(2)], names=["a", "b"])

    met = dealt.select("family", "lo", "hi", "node", "side", "c", "t").repartition("family", "lo", "hi").sortWithinPartitions("family", "lo", "hi")
    return met.transform(map_arrow, run, "a long, b long").distinct()


def jaccard_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100, count_links: bool = True
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, class_id and, with ``count_links``, n_links.

    Links are those of ``num / den`` Jaccard similarity of the sets of distinct
    ``width``-word shingles (ASCII letters in lower case; words between ASCII
    white space). Fewer words give one shingle of them all; a text that is
    null or has no words links with nothing and is its own component.
    class_id is the smallest id with the same set, n_links the number of all other
    classes that link with it. Repeated rows fall in one class. Ids are taken as
    unique: of an id with several texts one stands for it, so links of the others
    may be missed. A row without id has no class and no component. An empty table
    gives no rows. Other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    full = store(prefixes(docs, sketch(docs, "text", width), "text", width, num, den), "join-sets")
    sets = store(full.drop("prefix"), "join-digests")
    filled = sets.where("n > 0 and doc_id is not null")
    # Equal sets have equal parities: grouping by them as well only carries them along.
    classes = store(filled.groupBy("s1", "s2", "n", "p1", "p2", "par").agg(F.min("doc_id").alias("class_id")), "join-classes")
    groups = classes.groupBy("n", "p1", "p2").agg(F.min("class_id").alias("g"))
    members = store(classes.join(groups, ["n", "p1", "p2"]).select("g", "class_id", "n", "par"), "join-members")
    # Rows of one id have one text; where they don't, the smallest set stands for them.
    heads = full.where("n > 0").join(members.select("g").distinct(), F.col("doc_id") == F.col("g"), "left_semi").groupBy("doc_id").agg(F.min(F.struct("n", "prefix")).alias("x"))
    heads = store(heads.select(F.col("doc_id").alias("g"), F.col("x.n").alias("n"), F.col("x.prefix").alias("prefix")), "join-heads")
    discard(full)

    # Lists of shingles are exploded twice rather than stored: once to find those that two groups share, once to keep
    # these. Each time one shuffle is alive, of a shingle, a group and, in one long, the place and the size.
    lists = heads.select("g", "n", F.posexplode("prefix").alias("pos", "token")).select("token", "g", (F.shiftleft(F.col("pos").cast("long"), 32) + F.col("n")).alias("at"))
    common = lists.groupBy("token").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo < hi").select("token")
    common = store(common, "join-tokens")
    # A merge join at every size: it can be split where a shingle is hot, and its cost grows with the lists.
    listed = store(lists.join(common.hint("merge"), "token", "left_semi"), "join-lists")
    discard(heads)
    hub = listed.groupBy("token").agg(F.min(F.struct(F.shiftright("at", 32).alias("pos2"), F.col("g").alias("g2"), "at")).alias("hub"))
    hub = hub.select("token", "hub.pos2", "hub.g2", F.col("hub.at").bitwiseAND(2**32 - 1).alias("n2"))
    spread = listed.select("token", "g", F.shiftright("at", 32).alias("pos"), F.col("at").bitwiseAND(2**32 - 1).alias("n"))
    shared = spread.join(hub, "token").groupBy("g2", "g").agg(F.max(possible(num, den)).alias("possible"))
    shared = store(shared, "join-shared")
    discard(listed)
    discard(common)

    # Round 1: every member of a group with the group's own representative, every group with its hubs.
    inner = members.where(F.col("class_id") != F.col("g")).select(F.col("class_id").alias("a"), F.col("g").alias("b"))
    outer = shared.where((F.col("g") != F.col("g2")) & F.col("possible")).select(F.col("g").alias("a"), F.col("g2").alias("b"))
    tried = store(sift(inner.unionByName(outer), members, num, den), "join-pairs")
    links = store(verify(tried, texts_of(docs, tried), width, num, den), "join-links")
    labels = store(connected_components(links), "join-labels")

    # Round 2: what round 1 left apart.
    several = members.groupBy("g").agg(F.count("*").alias("k")).where("k > 1").select(F.col("g").alias("family"), "g")
    families = store(shared.select(F.col("g2").alias("family"), "g").unionByName(several).distinct(), "join-family-groups")
    met = apart(families, members, labels, num, den)
    ends = [tried.select(x, y) for x, y in (("a", "b"), ("b", "a"))]
    met = met.join(ends[0], ["a", "b"], "left_anti").join(ends[1].toDF("a", "b"), ["a", "b"], "left_anti")
    met = store(met, "join-pairs")
    more = [] if met.isEmpty() else [store(verify(met, texts_of(docs, met), width, num, den), "join-links")]
    if more and not more[0].isEmpty():
        links = links.unionByName(more[0])
        labels = store(connected_components(links), "join-labels")
    nodes = store(undecided(families, members, labels, num, den), "join-undecided")
    if not nodes.isEmpty():
        found = store(settle(nodes, members, docs, width, num, den), "join-links")
        if not found.isEmpty():
            links = links.unionByName(found)
            labels = store(connected_components(links), "join-labels")

    discard(shared, families, members)
    named = classes.join(labels, classes["class_id"] == labels["node"], "left").drop("node")
    if count_links:
        ends = degrees(docs, classes, links, labels, width, num, den)
        named = named.join(ends, classes["class_id"] == ends["node"], "left")
    count = [F.coalesce("n_links", F.lit(0)).alias("n_links")] * count_links
    named = named.select("s1", "s2", "n", "class_id", F.coalesce("component", "class_id").alias("component_id"), *count)
    out = sets.select("doc_id", "n", "s1", "s2").join(named, ["s1", "s2", "n"], "left")
    has = F.col("doc_id").isNotNull()
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(has, F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.when(has, F.coalesce("class_id", "doc_id")).alias("class_id"),
        *count,
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` whose id is its component's smallest.

    Rows without id, and rows without words, stay; of repeated rows all stay or
    go together; an empty table gives no rows. All columns are returned.
    """
    joined = jaccard_join(docs, id_col, text_col, count_links=False, **how)
    gone = joined.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(id_col))
    return docs.join(gone, id_col, "left_anti").select(docs.columns)
