"""The pipeline's stages, each on its own input, and whole."""

import sys
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline
from loomstone.llm.common import store


def test_stages_in_order_and_what_they_keep(spark, testdata):
    docs = spark.read.parquet(f"{testdata}/documents.parquet")
    columns = docs.columns
    clean = "The the of and to in is that for with on as by it was be of the and to the of in a the to and for.\n"
    docs = docs.unionByName(spark.createDataFrame([(10**6, clean + 'token = "0123456789abcdef"', "en", "s", 1)], docs.schema))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "ngram_jaccard_join", "secret_scans", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = store(stage(spark, docs, testdata), name)
        assert docs.columns == columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
        assert len(kept[name]) == docs.count()
    assert len(kept["exact_dedup"]) == len({" ".join(t.split()) for t in kept["quality_classifier"].values()})
    assert set(kept["ngram_jaccard_join"]) <= set(kept["exact_dedup"]) and set(kept["secret_scans"]) == set(kept["ngram_jaccard_join"])
    changed = {i for i, t in kept["secret_scans"].items() if t != kept["ngram_jaccard_join"][i]}
    assert changed and all("[SECRET]" in kept["secret_scans"][i] for i in changed)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, testdata)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == set(kept["secret_scans"])


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_take_nulls_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a fine text of some words here", None, 5), (1, "a fine text of some words here", None, 5), (None, None, "x", None), (2, "", "y", 1)], "doc_id long, text string, lang string, _key long")
    assert {(r.doc_id, r.doc_tokens) for r in corpus_pipeline.pack_sequences(spark, docs, "").collect()} >= {(None, 1), (2, 1)}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.select("doc_id", "text", "lang", F.lit(1).alias("source"), F.lit(1).cast("long").alias("n_chars"), F.lit("z").alias("_gone")), "")
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "_gone"], name
        out.collect()
