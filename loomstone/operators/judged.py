"""Judged metrics of retrieved answers: faithfulness, context precision, answer relevancy.

A judge is a function of a table with columns ``statement`` and ``context`` that
adds a column ``verdict`` (boolean): an outside model in batches, or ``lexical``. It
sees each pair once. A missing verdict is an error and never counts as a no.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.operators.retrieval import cosine

Judge = Callable[[DataFrame], DataFrame]


def words(text: Column) -> Column:
    """Distinct runs of small ASCII letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def lexical(share: float = 0.7) -> Judge:
    """A statement holds in a context that has at least this share of its words; one without words holds nowhere."""

    def judge(pairs: DataFrame) -> DataFrame:
        own, met = words(F.coalesce("statement", F.lit(""))), words(F.coalesce("context", F.lit("")))
        return pairs.withColumn("verdict", (F.size(own) > 0) & (F.size(F.array_intersect(own, met)) >= share * F.size(own)))

    return judge


def _judged(pairs: DataFrame, judge: Judge) -> DataFrame:
    checked = F.when(F.col("verdict").isNull(), F.raise_error(F.lit("the judge gave no verdict"))).otherwise(F.col("verdict")).cast("boolean")
    return judge(pairs).withColumn("verdict", checked)


def claims(answers: DataFrame, text: str = "answer") -> DataFrame:
    """(id, claim_no, claim): an answer's sentences without their end marks, those without a letter or digit left out."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[^.!?\n]+"), F.lit(0))
    rows = answers.select("id", F.posexplode(parts).alias("claim_no", "claim"))
    return rows.withColumn("claim", F.regexp_replace("claim", r"^\s+|\s+$", "")).where(F.size(words(F.col("claim"))) > 0)


def faithfulness(answers: DataFrame, contexts: DataFrame, judge: Judge) -> DataFrame:
    """(id, claims, supported, faithfulness): the share of an answer's claims that some context of it supports; null without claims.

    ``answers``: (id, answer); ``contexts``: (id, rank, context). Claims meet
    the contexts of their own id alone.
    """
    made = claims(answers)
    pairs = made.join(contexts.select("id", F.col("context")), "id").withColumnRenamed("claim", "statement")
    held = _judged(pairs, judge).groupBy("id", "claim_no").agg(F.bool_or("verdict").alias("held"))
    counted = made.join(held, ["id", "claim_no"], "left").groupBy("id").agg(F.count("*").alias("claims"), F.count_if(F.coalesce("held", F.lit(False))).alias("supported"))
    out = answers.select("id").join(counted, "id", "left").fillna(0, ["claims", "supported"])
    return out.withColumn("faithfulness", F.when(F.col("claims") > 0, F.col("supported") / F.col("claims")))


def context_precision(truths: DataFrame, contexts: DataFrame, judge: Judge) -> DataFrame:
    """(id, contexts, useful, context_precision): useful contexts weighted by rank, 0 where none is; null without contexts.

    ``truths``: (id, ground_truth). At each useful context's rank k stands the
    share of useful ones among the first k; the metric is their mean.
    """
    pairs = truths.select("id", F.col("ground_truth").alias("statement")).join(contexts.select("id", "rank", "context"), "id")
    w = Window.partitionBy("id").orderBy("rank")
    ranked = _judged(pairs, judge).withColumn("k", F.row_number().over(w)).withColumn("hits", F.count_if("verdict").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    by_id = ranked.groupBy("id").agg(F.count("*").alias("contexts"), F.count_if("verdict").alias("useful"), F.sum(F.when(F.col("verdict"), F.col("hits") / F.col("k"))).alias("s"))
    out = truths.select("id").join(by_id, "id", "left").fillna(0, ["contexts", "useful"])
    value = F.when(F.col("contexts") > 0, F.coalesce(F.col("s") / F.col("useful"), F.lit(0.0)))
    return out.withColumn("context_precision", value).drop("s")


def answer_relevancy(answers: DataFrame, embed: Callable[[Column], Column], asked_by: Callable[[DataFrame], DataFrame] = claims) -> DataFrame:
    """(id, relevancy): the mean cosine of a question with the questions that its answer would answer; 0 where there are none.

    ``answers``: (id, question, answer). ``asked_by`` gives (id, claim_no, claim)
    for an answer, from a model or, by default, its own sentences.
    """
    made = asked_by(answers.select("id", "answer")).join(answers.select("id", "question"), "id")
    close = made.groupBy("id").agg(F.avg(cosine(embed(F.col("question")), embed(F.col("claim")))).alias("relevancy"))
    return answers.select("id").join(close, "id", "left").fillna(0.0, ["relevancy"])


def judged(rows: DataFrame, contexts: DataFrame, judge: Judge, embed: Callable[[Column], Column]) -> DataFrame:
    """All three metrics of (id, question, answer, ground_truth) and (id, rank, context); ids are unique."""
    faithful = faithfulness(rows, contexts, judge).select("id", "claims", "supported", "faithfulness")
    precise = context_precision(rows, contexts, judge).select("id", "contexts", "useful", "context_precision")
    return faithful.join(precise, "id").join(answer_relevancy(rows, embed), "id")
