"""Queries of the coded index, of snapshots and of an index that is kept up to date, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.operators import codes, retrieval, segments
from loomstone.plans.queries import VECTORS, query, read
from loomstone.sources.shared import scratch
from loomstone.sources.snapshots import Snapshots

#: Of how many vectors one is read whole for a query.
SHARE = 10


@query(f"""
    WITH {VECTORS}
    SELECT query_id, chunk_id, round(similarity, 6) AS similarity, rank, (SELECT count(*) FROM v) // {SHARE} AS vectors_read FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM sims
    ) WHERE rank <= 5
""")
def coded_topk(spark, sf_dir):
    """The five nearest by the coded index, which reads a tenth of the vectors for a query; the SQL compares with all."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    index = codes.build(rows)
    found = codes.top_k(rows.where("id % 20 = 0"), index, 5, rerank=index.total // SHARE)
    return found.select("query_id", "chunk_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"), "vectors_read")


# --- Snapshots -----------------------------------------------------------------------------------


@query("""
    SELECT 'read' AS change, doc_id, lang FROM documents
    UNION ALL SELECT 'removed', doc_id, lang FROM documents WHERE doc_id % 3 = 0 OR doc_id % 7 = 1
    UNION ALL SELECT 'added', doc_id, lang || '!' FROM documents WHERE doc_id % 3 = 0 AND doc_id % 7 <> 1
    UNION ALL SELECT 'added', doc_id + 1000000000, 'new' FROM documents WHERE doc_id % 11 = 0
""")
def snapshot_revisions(spark, sf_dir):
    """A first revision read back, with its files checked, after a second one took its place and a third one was appended; and what has changed since."""
    kept = Snapshots(spark, scratch(spark, "snapshots"))
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang")
    first = kept.write(rows)
    kept.write(rows.where("doc_id % 7 <> 1").withColumn("lang", F.when(F.col("doc_id") % 3 == 0, F.concat("lang", F.lit("!"))).otherwise(F.col("lang"))))
    last = kept.write(rows.where("doc_id % 11 = 0").select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), F.lit("new").alias("lang")), append=True)
    return kept.read(first, check=True).select(F.lit("read").alias("change"), "doc_id", "lang").unionByName(kept.compare(first, last))


# --- An index kept up to date ------------------------------------------------------------------------

WORDS = ("the", "and", "th", "er", "in", "on", "es", "sch", "de", "qu")
BIAS = 0.5


def _vector_sql(text: str) -> str:
    return "[" + ", ".join(f"len(regexp_extract_all(lower({text}), '{w}'))::DOUBLE" for w in WORDS) + f", {BIAS}::DOUBLE]"


def _chunks_sql(docs: str) -> str:
    return f"""SELECT doc_id, (i / 800)::BIGINT AS chunk_no, substr(text, i + 1, 1000) AS chunk
        FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 1, 0) + 1, 800)) AS i FROM ({docs}))"""


NOW = "SELECT doc_id, coalesce(text, '') AS text FROM documents"
THEN = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'draft ' ELSE '' END || coalesce(text, '') AS text FROM documents WHERE doc_id % 5 <> 0"


@query(f"""
    WITH c AS MATERIALIZED (SELECT doc_id * 1000 + chunk_no AS id, chunk, {_vector_sql("chunk")} AS v FROM ({_chunks_sql(NOW + " WHERE doc_id % 7 <> 0")})),
    q AS (SELECT item_id, {_vector_sql("text")} AS v FROM benchmark),
    r AS (SELECT item_id, chunk, row_number() OVER (PARTITION BY item_id ORDER BY list_cosine_similarity(q.v, c.v) DESC, id) AS rank FROM q, c),
    e AS (
        SELECT count(*) AS n FROM (
            SELECT DISTINCT chunk FROM ({_chunks_sql(NOW + " WHERE doc_id % 3 = 0 OR doc_id % 5 = 0")})
            EXCEPT SELECT chunk FROM ({_chunks_sql(THEN)}))
    )
    SELECT item_id AS query_id, md5(string_agg(chunk, chr(10) || '---' || chr(10) ORDER BY rank)) AS context, any_value(n) AS embedded FROM r, e WHERE rank <= 3 GROUP BY item_id
""")
def index_updates(spark, sf_dir):
    """Contexts from an index after a third of its documents were replaced, a fifth added and a seventh deleted; the SQL builds it anew.

    ``embedded``: texts that the second commit had to embed, which are those that weren't held.
    """
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    embed = lambda text: retrieval.keyword_embedding(text, WORDS, BIAS)
    index = segments.Segments(
        spark, scratch(spark, "index"), embed, lambda d: retrieval.fixed_chunks(d).withColumnRenamed("doc_id", "id"), lambda doc, no: doc.cast("long") * 1000 + no
    )
    index.upsert(docs.where("doc_id % 5 <> 0").withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("draft "), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))))
    counts = index.upsert(docs)
    index.delete(docs.where("doc_id % 7 = 0"))
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), embed(F.col("text")).alias("embedding"))
    return index.retrieve(asked, 3, -1.0).select("query_id", F.md5("context").alias("context"), F.lit(counts["embedded"]).cast("long").alias("embedded"))
