"""The coded index, snapshots, and the index in segments."""

import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstone.operators import codes, retrieval, segments
from loomstone.sources.shared import store
from loomstone.sources.snapshots import Drift, Snapshots

# --- Coded index ---------------------------------------------------------------------------


def table(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in enumerate(vectors)], "id long, embedding array<float>")


def near(rows):
    return {(r.query_id, r["rank"]): (r.chunk_id, round(r.similarity, 9)) for r in rows.collect()}


def lumps(n, dims=32, lumps=12, seed=0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(lumps, dims))
    return middle[rng.integers(0, lumps, n)] + 0.3 * rng.normal(size=(n, dims))


def test_all_candidates_give_the_exact_result(spark):
    rows = table(spark, lumps(300))
    index = codes.build(rows, cells=8, stretches=8)
    asked = rows.where("id % 25 = 0")
    for same in (True, False):
        assert near(codes.top_k(asked, index, 5, rerank=300, same=same)) == near(retrieval.top_k(asked, rows, 5, same=same))


def test_few_probes_and_vectors_find_the_neighbours(spark):
    rows = table(spark, lumps(2000, seed=1))
    index = codes.build(rows, cells=12, stretches=16)
    asked = rows.where("id % 50 = 0")
    got = codes.top_k(asked, index, 5, rerank=60, probes=3).collect()
    exact = {(r.query_id, r.chunk_id) for r in retrieval.top_k(asked, rows, 5).collect()}
    assert max(r.vectors_read for r in got) <= 60
    assert len(exact & {(r.query_id, r.chunk_id) for r in got}) >= 0.9 * len(exact)


def test_index_of_odd_vectors(spark):
    rng = np.random.default_rng(3)
    odd = [None, [0.0] * 16, [0.0] * 16, [None] + [1.0] * 15]
    rows = table(spark, odd + list(rng.normal(size=(5, 16)))).unionByName(table(spark, [[1.0] * 16] * 40, 100)).withColumn("code", F.lit("x"))
    index = codes.build(rows, cells=4, stretches=4)
    assert index.total == 45
    asked = rows.where("id in (0, 1, 4, 100)")
    got = near(codes.top_k(asked, index, 3, rerank=45))
    assert {q for q, _ in got} == {4, 100}
    assert [got[100, k][0] for k in (1, 2, 3)] == [100, 101, 102]  # ties by the smaller id
    none = codes.build(rows.where("id < 4"), cells=4, stretches=4)
    assert none.total == 0 and codes.top_k(asked, none, 3).count() == 0
    assert codes.top_k(asked.where("false"), index, 3).count() == 0


def test_queries_in_blocks(spark, monkeypatch):
    rows = table(spark, lumps(200, seed=4))
    index = codes.build(rows, cells=4, stretches=8)
    want = near(codes.top_k(rows, index, 2, rerank=20))
    monkeypatch.setattr(codes, "BLOCK", 64)
    monkeypatch.setattr(codes, "ASKED", 7)
    monkeypatch.setattr(codes, "SMALL", 10)
    assert near(codes.top_k(rows, index, 2, rerank=20)) == want


def test_candidates_are_counted_and_not_listed(spark, monkeypatch):
    rng = np.random.default_rng(5)
    some = lumps(150, seed=6)
    rows = table(spark, np.concatenate([some, some[:40].repeat(3, axis=0), rng.normal(size=(30, 32))]))
    index = codes.build(rows, cells=4, stretches=8)
    held = []
    monkeypatch.setattr(codes, "store", lambda df, name: held.append((name, df.count())) or df)
    for small in (False, True):
        if small:
            for name, size in {"BLOCK": 40, "ASKED": 7, "CODED": 64, "BUNDLE": 16, "COUNTED": 16, "READ": 50, "SMALL": 10}.items():
                monkeypatch.setattr(codes, name, size)
        got = codes.top_k(rows, index, 100, rerank=60, same=False).collect()
        assert {r.vectors_read for r in got} == {60} and len(got) == 300 * 60  # copies too are cut at the same id
        want = want if small else near(spark.createDataFrame(got))
        assert near(spark.createDataFrame(got)) == want
    assert all(n <= 300 for _, n in held)  # before, all 60 candidates of each of 300 queries were stored
    assert codes.top_k(rows, index, 3, rerank=0).count() == 0
    assert {r.vectors_read for r in codes.top_k(rows, index, 3, rerank=1000).collect()} == {300}


# --- Snapshots ------------------------------------------------------------------------------


@pytest.fixture
def kept(spark, tmp_path):
    return Snapshots(spark, f"file://{tmp_path}/t")


def ids(rows):
    return sorted(r.id for r in rows.collect())


def test_revisions_are_read_as_they_were(spark, kept):
    assert kept.revisions() == [] and kept.entry()["revision"] == 0
    with pytest.raises(KeyError):
        kept.read()
    assert kept.write(spark.range(3)) == 1
    assert kept.write(spark.range(10, 12), append=True) == 2
    assert kept.write(spark.range(5, 6), note={"why": "test"}) == 3
    assert [ids(kept.read(r, check=True)) for r in (1, 2, 3, None)] == [[0, 1, 2], [0, 1, 2, 10, 11], [5], [5]]
    assert kept.entry(3)["note"] == {"why": "test"}
    with pytest.raises(KeyError):
        kept.read(9)
    with pytest.raises(KeyError):
        kept.read(1, part="other")


def test_comparison_counts_repeats(spark, kept):
    rows = lambda *xs: spark.createDataFrame([(x,) for x in xs], "id string")
    kept.write(rows("a", "a", None, "b"))
    kept.write(rows("a", None, None, "c"))
    kept.write(rows("d"), append=True)
    changes = lambda a, b: sorted((r.change, str(r.id)) for r in kept.compare(a, b).collect())
    assert changes(1, 2) == [("added", "None"), ("added", "c"), ("removed", "a"), ("removed", "b")]
    assert changes(2, 3) == [("added", "d")] and changes(2, 2) == []


def test_empty_tables_are_revisions_too(spark, kept):
    kept.write(spark.range(0))
    assert kept.read(check=True).count() == 0 and kept.read().columns == ["id"]


def test_drift_is_found(spark, kept, tmp_path):
    kept.write(spark.range(3).coalesce(1))
    kept.write(spark.range(4).coalesce(1))
    assert kept.drifted().count() == 0
    folder = tmp_path / "t" / kept.entry(2)["parts"]["rows"][0]
    file = next(folder.glob("*.parquet"))
    for crc in folder.glob(".*.crc"):
        crc.unlink()
    whole = file.read_bytes()
    file.write_bytes(whole[:-1] + bytes([whole[-1] ^ 1]))
    assert [r.problem for r in kept.drifted().collect()] == ["changed"]
    file.rename(folder / "other.parquet")
    assert sorted(r.problem for r in kept.drifted().collect()) == ["missing", "new"]
    with pytest.raises(Drift, match="missing"):
        kept.read(2, check=True)
    assert ids(kept.read(1, check=True)) == [0, 1, 2]


def test_of_two_writers_one_wins(spark, kept, tmp_path):
    kept.write(spark.range(1))
    mine, theirs = kept.add(spark.range(2)), kept.add(spark.range(3))
    kept.commit({"rows": [theirs]}, 1)
    with pytest.raises(RuntimeError, match="another writer"):
        kept.commit({"rows": [mine]}, 1)
    assert ids(kept.read()) == [0, 1, 2]
    assert json.loads((Path(tmp_path) / "t/log/00000002.json").read_text())["parts"] == {"rows": [theirs]}


# --- Segments -------------------------------------------------------------------------------

WORDS = ["drone", "camera", "laptop", "price"]


@pytest.fixture
def index(spark, tmp_path):
    embed = lambda text: retrieval.keyword_embedding(text, WORDS)
    return segments.Segments(spark, f"file://{tmp_path}/index", embed, lambda d: retrieval.fixed_chunks(d, 40, 10).withColumnRenamed("doc_id", "id"))


def docs(spark, **texts):
    return spark.createDataFrame([(k, v) for k, v in texts.items()], "doc_id string, text string")


def held(index, revision=None):
    return sorted((r.doc_id, r.chunk_no, r.text) for r in index.live(revision).collect() if r.text is not None)


def anew(spark, tmp_path, index, **texts):
    fresh = segments.Segments(spark, f"file://{tmp_path}/anew{len(list(tmp_path.iterdir()))}", index.embed, index.chunks)
    fresh.upsert(docs(spark, **texts))
    return fresh


def test_updates_equal_an_index_built_anew(spark, index, tmp_path):
    long = "a drone with a camera, at a price. " * 4
    assert index.upsert(docs(spark, a=long, b="laptop", c="camera camera", d="price"))["changed"] == 4
    # the first chunks of a stay as they are: only what is new is embedded
    counts = index.upsert(docs(spark, a=long + "laptop", b="laptop", e="price", f=None))
    assert counts["changed"] == 3 and counts["chunks"] > 3 and counts["embedded"] == 2  # the last of a and the empty one of f
    index.delete(docs(spark, c="x", z="x"))
    want = dict(a=long + "laptop", b="laptop", d="price", e="price", f="")
    asked = spark.createDataFrame([(1, "camera drone"), (2, "laptop"), (3, "price")], "id long, text string").select("id", index.embed(F.col("text")).alias("embedding"))
    fresh = anew(spark, tmp_path, index, **want)
    contexts = lambda i: sorted(map(tuple, i.retrieve(asked, 2, 0.3).collect()))
    assert held(index) == held(fresh) and contexts(index) == contexts(fresh)
    before = held(index)
    index.compact()
    assert held(index) == before and contexts(index) == contexts(fresh)
    assert "tombstones" not in index.log.entry()["parts"] and held(index, 3) == before and ("c", 0, "camera camera") in held(index, 2)
    # nothing changes: nothing is embedded, also of the texts that compaction moved
    assert index.upsert(docs(spark, **want)) == {"changed": 0, "chunks": 0, "embedded": 0}


def test_documents_come_back_after_deletion(spark, index):
    index.upsert(docs(spark, a="camera"))
    index.delete(docs(spark, a=""))
    assert held(index) == []
    assert index.upsert(docs(spark, a="camera"))["embedded"] == 0  # its text is still held
    assert held(index) == [("a", 0, "camera")]
    index.delete(docs(spark, a=""))
    index.compact()
    assert held(index) == [] and index.upsert(docs(spark, a="camera"))["embedded"] == 1


def test_index_of_nulls_and_repeats(spark, index):
    rows = docs(spark, a="camera").unionByName(docs(spark, a="drone")).unionByName(spark.createDataFrame([(None, "x")], "doc_id string, text string"))
    assert index.upsert(rows)["changed"] == 1
    assert held(index) == [("a", 0, "drone")]
    assert index.upsert(rows.where("false"))["changed"] == 0
    index.delete(rows.where("false"))
    assert held(index) == [("a", 0, "drone")]


def test_tombstones_beyond_a_broadcast(spark, index, monkeypatch):
    monkeypatch.setattr(segments, "SMALL", 0)
    index.upsert(docs(spark, a="camera", b="drone"))
    index.upsert(docs(spark, a="laptop"))
    assert held(index) == [("a", 0, "laptop"), ("b", 0, "drone")]


def test_texts_that_come_once_are_not_shuffled(spark, index, monkeypatch):
    moved = []
    monkeypatch.setattr(segments, "store", lambda df, name: moved.append((name, store(df, name))) or moved[-1][1])
    texts = {f"d{i}": f"camera {i}" for i in range(30)} | {"same": "camera 3", "again": "camera 3", "none": ""}
    assert index.upsert(docs(spark, **texts)) == {"changed": 33, "chunks": 33, "embedded": 31}
    assert [x.count() for n, x in moved if n == "met"][0] < 10  # before, all chunks were joined by their digests
    assert held(index) == sorted((k, 0, v) for k, v in texts.items())
    assert index.upsert(docs(spark, new="camera 3", other="camera 99"))["embedded"] == 1
    want = {r.text: r.embedding for r in index.live().where("text is not null").select("text", index.embed(F.col("text")).alias("embedding")).collect()}
    got = index.live().where("text is not null").collect()
    assert len(got) == 35 and all(r.embedding == want[r.text] for r in got)
