"""From raw documents to packed training sequences; every stage works on all its predecessor kept.

All stages take null and empty texts, null ids, texts of any length, repeated
rows, empty tables and further columns, which all but the last pass on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomstone.llm import exact_dedup, ngram_join, packing, quality, secrets
from loomstone.llm.common import store
from loomstone.llm.queries import tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null counts as empty; repeated rows go or stay together."""
    return quality.keep_good(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest doc_id stays, null ids last; of repeated rows one. Null counts as empty."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at five words and a similarity of 0.8, the smallest doc_id stays. Texts without words and rows without id stay."""
    return ngram_join.one_of_each(docs, width=5, num=80, den=100)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in a text become a mark; n_chars follows the text. All rows stay, null text stays null."""
    from pyspark.sql import functions as F

    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in out.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a sequence; null text is empty, repeated rows are packed as often as they occur."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("secret_scans", redact_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Tokenisation, the fitted classifier and packing are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None
