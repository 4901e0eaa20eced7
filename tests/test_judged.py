"""Judged metrics by hand."""

import pytest
from pyspark.sql import functions as F

from loomstone.operators import judged
from loomstone.operators.retrieval import keyword_embedding
from loomstone.plans import samples

ANSWERS = [(1, "The fee is low. Cars are red!", "q"), (2, "", "q"), (3, None, "q"), (4, "Only this?\n...", "q"), (5, "Nothing fits", "q")]
CONTEXTS = [(1, 1, "a fee that is low"), (1, 2, "boats are blue"), (4, 1, "only this"), (4, 2, None), (1, 3, "the fee is very low")]


@pytest.fixture(scope="module")
def tables(spark):
    answers = spark.createDataFrame(ANSWERS, "id int, answer string, question string").withColumn("ground_truth", F.lit("the fee is low"))
    return answers, spark.createDataFrame(CONTEXTS, "id int, rank int, context string")


def test_claims_are_sentences_with_a_word(tables):
    got = sorted((r.id, r.claim_no, r.claim) for r in judged.claims(tables[0]).collect())
    assert got == [(1, 0, "The fee is low"), (1, 1, "Cars are red"), (4, 0, "Only this"), (5, 0, "Nothing fits")]


def test_faithfulness_counts_supported_claims(tables):
    got = {r.id: (r.claims, r.supported, r.faithfulness) for r in judged.faithfulness(*tables, judged.lexical(0.75)).collect()}
    assert got == {1: (2, 1, 0.5), 2: (0, 0, None), 3: (0, 0, None), 4: (1, 1, 1.0), 5: (1, 0, 0.0)}


def test_precision_weighs_ranks(tables):
    got = {r.id: (r.contexts, r.useful, r.context_precision) for r in judged.context_precision(*tables, judged.lexical(0.75)).collect()}
    # ranks 1 and 3 are useful: (1/1 + 2/3) / 2
    assert got[1][:2] == (3, 2) and abs(got[1][2] - 5 / 6) < 1e-12
    assert got[4] == (2, 0, 0.0) and got[2] == (0, 0, None)


def test_relevancy_is_a_mean_of_cosines(tables):
    answers = tables[0].withColumn("question", F.lit("low fee"))
    got = {r.id: r.relevancy for r in judged.answer_relevancy(answers, lambda t: keyword_embedding(t, ["fee", "low", "red"], 0.0)).collect()}
    assert got[2] == got[3] == 0.0 and abs(got[1] - 0.5) < 1e-12


def test_a_judge_may_be_any_function_but_must_answer(tables):
    yes = lambda pairs: pairs.withColumn("verdict", F.lit(1))
    assert {r.id: r.supported for r in judged.faithfulness(*tables, yes).collect()} == {1: 2, 2: 0, 3: 0, 4: 1, 5: 0}
    silent = lambda pairs: pairs.withColumn("verdict", F.lit(None).cast("boolean"))
    with pytest.raises(Exception, match="no verdict"):
        judged.faithfulness(*tables, silent).collect()


def test_judged_set_is_answered_by_its_sections(spark):
    """The judged questions, each with the section that answers it as its context."""
    golden = spark.createDataFrame(samples.GOLDEN, "question string, ground_truth string, title string").withColumn("id", F.hash("question"))
    rows = golden.select("id", "question", F.col("ground_truth").alias("answer"), "ground_truth")
    texts = spark.createDataFrame(list(samples.SECTIONS.items()), "title string, context string")
    contexts = golden.join(texts, "title").select("id", F.lit(1).alias("rank"), "context")
    got = judged.judged(rows, contexts, judged.lexical(0.6), lambda t: keyword_embedding(t, ["a", "e", "o"], 0.5)).collect()
    assert len(got) == 5 and all(r.faithfulness == 1.0 and r.context_precision == 1.0 and r.relevancy > 0.5 for r in got)
