"""The plan of one answer, over a batch of chat messages: window, rewrite, search, facts, prompt, model, guard."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.functions import facts
from loomstone.functions.fixed import Domain
from loomstone.functions.text import reveal_slots
from loomstone.operators import history as H
from loomstone.operators import retrieval
from loomstone.operators.evaluate import score_with


def prompts(messages: DataFrame, chunks: DataFrame, embed: Callable, system: str, k: int = 2, min_similarity: float = 0.36, max_turns: int = 2, budget: int | None = None, domain: Domain = Domain()) -> DataFrame:
    """(id, message, history, context, prompt) for messages (id, message, history); ``embed`` maps a text column to a vector column."""
    rows = messages.withColumn("history", H.recent(F.col("history"), max_turns))
    queries = rows.select("id", embed(H.retrieval_text(F.col("message"), F.col("history"))).alias("embedding"))
    found = retrieval.retrieve(queries, chunks, k, min_similarity).withColumnRenamed("query_id", "id").withColumnRenamed("context", "retrieved")
    rows = rows.join(found, "id", "left")
    rows = rows.withColumn("facts", facts.detect(F.col("message"), F.col("history"), domain))
    rows = rows.withColumn("context", facts.build_context(F.col("facts"), F.col("retrieved")))
    if budget is not None:
        fitted = H.fit_budget(F.col("message"), F.col("history"), F.col("context"), budget)
        rows = rows.withColumn("_fit", fitted).withColumn("history", F.col("_fit.history")).withColumn("shown", F.col("_fit.context"))
    else:
        rows = rows.withColumn("shown", F.col("context"))
    return rows.select("id", "message", "history", "context", H.prompt(F.col("message"), F.col("history"), F.col("shown"), system).alias("prompt"))


def answers(prompted: DataFrame, model: Callable[[pd.DataFrame], pd.Series], domain: Domain = Domain()) -> DataFrame:
    """Guarded replies of an outside model to the prompts."""
    replied = score_with(prompted, model, "reply")
    return replied.withColumn("answer", reveal_slots(facts.guard(F.trim("reply"), F.col("context"), F.col("message"), F.col("history"), domain)))
