"""The query of judged metrics, with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.operators import judged, retrieval
from loomstone.plans.queries import query, read
from loomstone.plans.queries_index import BIAS, WORDS, _vector_sql

SHARE, RANKS = 0.55, 3
TOKENS = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+'))"


def _holds(statement: str, context: str) -> str:
    own = TOKENS.format(statement)
    return f"(len({own}) > 0 AND len(list_intersect({own}, {TOKENS.format(context)})) >= {SHARE} * len({own}))"


@query(f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    c AS (SELECT item_id AS id, r AS rank, d.text AS context FROM benchmark, (SELECT unnest(range(1, {RANKS + 1})) AS r) JOIN d ON doc_id = item_id * {RANKS} + r),
    rows AS (SELECT item_id AS id, b.text AS question, substr(d.text, 1, 400) || '. ' || b.text AS answer, b.text AS truth FROM benchmark b JOIN d ON doc_id = item_id * {RANKS} + 2),
    parts AS (SELECT id, question, unnest(regexp_extract_all(answer, '[^.!?\\n]+')) AS claim, unnest(range(len(regexp_extract_all(answer, '[^.!?\\n]+')))) AS no FROM rows),
    claims AS MATERIALIZED (SELECT id, question, no, regexp_replace(claim, '^\\s+|\\s+$', '', 'g') AS claim FROM parts WHERE len({TOKENS.format("claim")}) > 0),
    held AS (SELECT id, no, bool_or({_holds("claim", "context")}) AS held FROM claims JOIN c USING (id) GROUP BY id, no),
    f AS (SELECT id, count(*) AS claims, count_if(coalesce(held, false))::BIGINT AS supported FROM claims LEFT JOIN held USING (id, no) GROUP BY id),
    v AS (SELECT id, rank, {_holds("truth", "context")} AS v FROM rows JOIN c USING (id)),
    k AS (SELECT id, v, row_number() OVER w AS k, count_if(v) OVER w AS hits FROM v WINDOW w AS (PARTITION BY id ORDER BY rank)),
    p AS (SELECT id, count(*) AS contexts, count_if(v)::BIGINT AS useful, coalesce(sum(CASE WHEN v THEN hits / k END) / count_if(v), 0) AS precision FROM k GROUP BY id),
    a AS (SELECT id, avg(list_cosine_similarity({_vector_sql("question")}, {_vector_sql("claim")})) AS relevancy FROM claims GROUP BY id)
    SELECT rows.id, coalesce(claims, 0) AS claims, coalesce(supported, 0) AS supported, round(CASE WHEN claims > 0 THEN supported / claims END, 6) AS faithfulness,
        coalesce(contexts, 0) AS contexts, coalesce(useful, 0) AS useful, round(precision, 6) AS context_precision, round(coalesce(relevancy, 0), 6) AS relevancy
    FROM rows LEFT JOIN f USING (id) LEFT JOIN p USING (id) LEFT JOIN a USING (id)
""")
def judged_metrics(spark, sf_dir):
    """Answers made of a document and a test item, judged by words against three documents."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    items = read(spark, sf_dir, "benchmark")
    ranks = items.select(F.col("item_id").alias("id"), F.explode(F.sequence(F.lit(1), F.lit(RANKS))).alias("rank")).withColumn("doc_id", F.col("id") * RANKS + F.col("rank"))
    contexts = ranks.join(docs, "doc_id").select("id", "rank", F.col("text").alias("context"))
    one = items.select("item_id", F.col("text").alias("question"), (F.col("item_id") * RANKS + 2).alias("doc_id")).join(docs, "doc_id")
    rows = one.select(F.col("item_id").alias("id"), "question", F.concat(F.substring("text", 1, 400), F.lit(". "), "question").alias("answer"), F.col("question").alias("ground_truth"))
    out = judged.judged(rows, contexts, judged.lexical(SHARE), lambda text: retrieval.keyword_embedding(text, WORDS, BIAS))
    return out.select("id", "claims", "supported", F.round("faithfulness", 6).alias("faithfulness"), "contexts", "useful", F.round("context_precision", 6).alias("context_precision"), F.round("relevancy", 6).alias("relevancy"))
