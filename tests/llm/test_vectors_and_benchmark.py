"""Hard negatives, decontamination and centroid clustering against plain versions."""

import hashlib
import math
import re
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstone.llm import centroids, decontamination, hard_negatives, queries
from loomstone.llm.vectors import quantised, require_exact

VECTORS = "vec_id long, embedding array<float>, label int, id long, v string, a int, p int, cluster int, score long"


def vectors(spark, rows):
    """Rows (vec_id, embedding, label) with further columns of names that the operators use inside."""
    return spark.createDataFrame([(*r, None, "x", 1, 2, 3, 4) for r in rows], VECTORS)


def random_rows(n, seed, dims=64, levels=5):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in rng.integers(-levels, levels + 1, dims) / 64], int(rng.integers(0, 4))) for i in range(n)]


def whole(v, scale):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(scale * x) for x in v]


# --- hard negatives -----------------------------------------------------------------


def plain_negatives(rows, anchor, label, scale=256, positives=5, negatives=10):
    kept = [(i, label(i, y), whole(v, scale)) for i, v, y in rows if i is not None and y is not None and whole(v, scale) is not None]
    out = []
    for i, y, x in kept:
        if not anchor(i):
            continue
        others = [(-sum(a * b for a, b in zip(x, z, strict=True)), j, w) for j, w, z in kept if j != i and len(z) == len(x)]
        near = sorted((s, j) for s, j, w in others if w == y)[:positives]
        for s, j in near:
            inside = sorted((t, k) for t, k, w in others if w != y and Fraction(3, 10) * -s <= -t <= Fraction(9, 10) * -s)[:negatives]
            out += [(i, j, r, k, -s, -t) for r, (t, k) in enumerate(inside, 1)]
    return sorted(out)


def mined(spark, rows, **how):
    df = vectors(spark, rows)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 10 == 0, label, **how).collect())


def moved(i, y):
    return (y + 1) % 10 if i % 7 == 0 else y


def test_hard_negatives_equal_the_plain_search(spark):
    rows = random_rows(300, 1)
    want = plain_negatives(rows, lambda i: i % 10 == 0, moved)
    assert len(want) > 500
    assert mined(spark, rows) == want


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 7)


def test_hard_negatives_of_several_blocks(spark, small_blocks):
    rows = random_rows(200, 2, dims=8)
    assert mined(spark, rows) == plain_negatives(rows, lambda i: i % 10 == 0, moved)


def test_tiles_of_few_rows_give_the_same():
    """Ties and repeated vectors over many tiles, in descending ids."""
    rng = np.random.default_rng(3)
    for k in (1, 3, 10):
        kept, seen = hard_negatives.Kept(6, k), [[] for _ in range(6)]
        ids = np.arange(200)[::-1]
        for i in range(0, 200, 9):
            part = np.sort(ids[i : i + 9])
            s = rng.integers(0, 4, (6, len(part))).astype(float)
            s[rng.random(s.shape) < 0.2] = -np.inf
            kept.see(np.arange(6), s, part)
            for r in range(6):
                seen[r] += [(-x, j) for x, j in zip(s[r], part, strict=True) if x > -np.inf]
        for r in range(6):
            n = min(k, len(seen[r]))
            assert [(-a, b) for a, b in sorted(seen[r])[:k]] == list(zip(kept.score[r, :n], kept.id[r, :n], strict=True))


def test_hard_negatives_of_ties_repeats_nulls_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = random_rows(60, 4, dims=4, levels=2) + [(10, [0.5] * 4, 1), (11, [0.5] * 4, 1), (11, [0.5] * 4, 1), (12, [0.25] * 4, 2), (12, [0.25] * 4, 2)]
    rows += [(20, None, 1), (None, [0.5] * 4, 1), (21, [0.5] * 4, None), (22, [0.5, None, 0.5, 0.5], 1), (23, [nan] * 4, 1), (24, [inf, 0.0, 0.0, 0.0], 1), (30, [0.5] * 3, 1), (31, [0.5] * 3, 1), (32, [0.3] * 3, 2), (40, [], 1)]
    got = mined(spark, rows)
    assert got == plain_negatives(rows, lambda i: i % 10 == 0, moved)
    assert {r[0] for r in got} >= {10, 30}
    assert mined(spark, []) == []
    assert mined(spark, [(3, [0.5] * 4, 1)]) == []


def test_products_that_would_not_be_exact_are_an_error(spark):
    with pytest.raises(ValueError):
        require_exact(np.array([[2.0**27]]), 2.0**26)
    with pytest.raises(Exception, match="exact in doubles"):
        mined(spark, [(10, [1e30], 1), (11, [1e30], 1), (12, [1e30], 2)])


# --- decontamination ----------------------------------------------------------------


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans({i: i + 32 for i in range(65, 91)})))


def plain_hits(docs, items, length=10, coverage=1.0):
    windows = {}
    for item, text in items:
        ws = words(text)
        n = max(1, min(length, math.ceil(coverage * len(ws))))
        for i in range(len(ws) - n + 1):
            windows.setdefault(tuple(ws[i : i + n]), set()).add(item)
    sizes = sorted({len(w) for w in windows})
    out = []
    for doc, text in docs:
        ws, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(ws) - n + 1):
                if (g := tuple(ws[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[g]
        listed = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(ws), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def found(spark, docs, items, **how):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, id long, left string")
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, n long")
    rows = decontamination.scan(d, b, **how)
    return sorted((tuple(r)[:6] for r in rows.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str)


def made(seed, letters=4, n_items=30, n_docs=60):
    """Texts over few words, so that runs overlap and repeat."""
    rng = np.random.default_rng(seed)
    text = lambda n: " ".join("abcdefgh"[i] for i in rng.integers(0, letters, n))
    items = [(i, text(rng.integers(0, 25))) for i in range(n_items)]
    docs = [(i, text(rng.integers(0, 80)) + " " + items[rng.integers(0, n_items)][1].upper() + ". " + text(5)) for i in range(n_docs)]
    return docs, items


@pytest.mark.parametrize("seed", range(3))
def test_hits_equal_the_plain_search(spark, seed):
    docs, items = made(seed)
    assert found(spark, docs, items) == plain_hits(docs, items)
    long_items = [(i, t) for i, t in items if len(words(t)) >= 12]
    assert found(spark, docs, long_items) == plain_hits(docs, long_items)
    assert found(spark, docs, items, length=4, coverage=0.6) == plain_hits(docs, items, 4, 0.6)


def test_hits_of_several_automata(spark):
    docs, items = made(7)
    items.append((99, " ".join("abcd"[i % 3] for i in range(200))))
    docs.append((99, items[-1][1]))
    assert found(spark, docs, items, part_words=30) == plain_hits(docs, items)


def test_hits_of_odd_texts(spark):
    ten = "one two three four five six seven eight nine ten"
    items = [(2, ten), (10, ten + " eleven"), (3, None), (4, ""), (5, "?!"), (6, "İstanbul Σίσυφος 日本語"), (None, "hidden words of nobody"), (2, "a second text of the same id")]
    docs = [(1, ten.upper() + ","), (1, ten.upper() + ","), (2, None), (3, ""), (None, "x " + ten + " eleven"), (4, ten.replace(" ten", "")), (5, "İstanbul\nΣίσυφος-日本語!"), (6, "HIDDEN words, of nobody"),
            (7, "filler text " * 20_000 + ten + " tail " * 5), (8, "a-second text of the same id"), (9, "w" * 3_000_000 + " " + ten)]
    got = found(spark, docs, items)
    assert got == plain_hits(docs, items)
    assert sum(r[5] for r in got) == 8
    assert found(spark, [], items) == [] and found(spark, docs, []) == plain_hits(docs, [])
    assert found(spark, docs, [(1, None)]) == plain_hits(docs, [])


def test_words_over_segments(monkeypatch):
    monkeypatch.setattr(decontamination, "SEGMENT", 11)
    text = "Ab  cd, efghijklmnopqrstuvwxyz é1 日本 x".encode() * 3
    h, starts, ends = decontamination.Words(3).places(text)
    assert [text[a:z].lower() for a, z in zip(starts, ends, strict=True)] == decontamination.words_of(text)
    monkeypatch.setattr(decontamination, "SEGMENT", 1 << 20)
    assert (decontamination.Words(3).places(text)[0] == h).all()


def test_longest_run_and_stretches(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h i j k l m")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x b c d e f g h i j k l z a b c d e f g h i j")], "doc_id long, text string")
    r = decontamination.scan(docs, items).head()
    assert (r.longest, [tuple(s) for s in r.spans]) == (11, [(1, 11), (13, 22)])


def test_decontaminate_removes_stretches_and_leaves_the_rest(spark):
    ten = "one two three four five six seven eight nine ten"
    items = spark.createDataFrame([(1, ten)], "item_id long, text string")
    clean = "Texts of the é kind, that nobody asks about; they stay as they are. " * 2
    docs = spark.createDataFrame([(1, clean + ten.upper() + ". More"), (2, clean), (3, ten), (None, None), (4, "")], "left long, text string").withColumn("x", F.lit(1))
    got = {r.left: r for r in decontamination.decontaminate(docs, items).collect()}
    assert docs.columns == list(got[1].asDict())
    assert {k: v.text for k, v in got.items()} == {1: clean + " . More", 2: clean, None: None, 4: ""}


# --- centroids ----------------------------------------------------------------------


def plain_clusters(rows, k=16, rounds=3):
    kept = [(i, x) for i, v, _ in rows if v is not None and len(v) == 64 and (x := whole(v, 64)) is not None]
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)
    at = [x for _, x in order[:k]]
    if not at:
        return []
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    near = lambda x: min((far(x, c), j) for j, c in enumerate(at))
    for _ in range(rounds):
        of = [near(x)[1] for _, x in kept]
        for j in range(len(at)):
            if own := [x for (_, x), c in zip(kept, of, strict=True) if c == j]:
                at[j] = [sum(xs) // len(own) for xs in zip(*own, strict=True)]
    ends = [(i, *near(x)) for i, x in kept]
    inertia = {j: sum(d for _, d, c in ends if c == j) for j in range(len(at))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, d, c in ends), key=str)


def clustered(spark, rows):
    return sorted((tuple(r) for r in centroids.cluster(vectors(spark, rows)).collect()), key=str)


def lumps(n, seed):
    rng = np.random.default_rng(seed)
    middle = rng.integers(-40, 41, (9, 64))
    return [(i, [float(x) for x in (middle[rng.integers(0, 9)] + rng.integers(-9, 10, 64)) / 64], 0) for i in range(n)]


def test_clusters_equal_the_plain_rounds(spark):
    for rows in (lumps(400, 1), random_rows(200, 2, levels=1)):
        assert clustered(spark, rows) == plain_clusters(rows)


def test_clusters_of_ties_repeats_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    few = [(i, [float(i % 3)] * 64, 0) for i in range(7)]
    odd = [(50, None, 0), (51, [1.0] * 63, 0), (52, [nan] + [0.0] * 63, 0), (53, [-inf] + [0.0] * 63, 0), (54, [None] + [0.0] * 63, 0), (55, [], 0), (None, [0.5] * 64, None)]
    for rows in (few + odd, few * 4 + odd, lumps(60, 3) + [(7, [0.01] * 64, 0)] * 90, few[:1], odd, []):
        assert clustered(spark, rows) == plain_clusters(rows)


def test_bounds_spare_distances():
    """Results equal a full scan in every round, all bounds hold, and on lumps most distances are never worked out."""
    x = np.floor(np.array([r[1] for r in lumps(600, 5)]) * 64)
    at = x[:16].copy()
    bounds, looked = centroids.Bounds.of(x, at, 4), []
    for _ in range(4):
        after = np.array([np.floor(x[bounds.cluster == j].mean(axis=0)) if (bounds.cluster == j).any() else at[j] for j in range(16)])
        way = np.sqrt(((after - at) ** 2).sum(axis=1)) + centroids.MARGIN
        at = after
        bounds, depth = bounds.moved(x, at, way, 3)
        assert (bounds.cluster == np.argmin(centroids.squares(x, at), axis=1)).all()
        d = np.sqrt(centroids.squares(x, at))
        for i in range(len(x)):
            others = set(range(16)) - {bounds.cluster[i], *bounds.near[i]}
            assert all(bounds.lower[i, j] <= d[i, c] + 1e-9 for j, c in enumerate(bounds.near[i])) and all(bounds.rest[i] <= d[i, c] + 1e-9 for c in others)
        looked.append(np.where(depth < 0, 16, depth).mean() / 16)
    assert looked[-1] < 0.5, looked


def test_quantised_groups_by_length():
    import pyarrow as pa

    column = pa.array([[1.0, 2.0], None, [0.26], [None, 1.0], [], [-0.3, 4.0], [float("inf")]], pa.list_(pa.float32()))[0:7]
    got = {m.shape[1]: (list(rows), m.tolist()) for rows, m in quantised(column, 4)}
    assert got == {0: ([4], [[]]), 1: ([2], [[1.0]]), 2: ([0, 5], [[4.0, 8.0], [-2.0, 16.0]])}


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_decontamination", "op13_centroids"])
def test_queries_equal_their_sql(spark, testdata, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"create view {t} as select * from read_parquet('{testdata}/{t}.parquet')")
    got = queries.QUERIES[name](spark, testdata).toPandas()
    want = con.sql(queries.ORACLES[name]).df()[list(got.columns)]
    assert sorted(map(str, got.values.tolist())) == sorted(map(str, want.values.tolist()))
