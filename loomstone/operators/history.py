"""Chat histories: normal form, windows of recent turns, queries from follow-ups, budgets, prompts.

Two shapes: nested, ``array<struct<role, content>>`` in a row, and long,
``(conv_id, turn, role, text)`` with one row per message. Nested expressions
need no shuffle; long ones use one window per conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions import fixed
from loomstone.functions.text import fill, follow_up, fresh, let, strip, translate_words, word_count

ROLES = ("user", "assistant")


def messages(history: Column) -> Column:
    """Messages of user and assistant that have text; null becomes empty."""
    kept = F.filter(history, lambda m: m["role"].isin(*ROLES) & m["content"].isNotNull())
    return F.coalesce(F.transform(kept, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))), F.array().cast("array<struct<role:string,content:string>>"))


def messages_from_blocks(history: Column) -> Column:
    """The same for messages whose content is an array of blocks with a text: texts joined by a space."""
    plain = F.transform(history, lambda m: F.struct(m["role"].alias("role"), F.array_join(F.transform(m["content"], lambda b: F.coalesce(b["text"], F.lit(""))), " ").alias("content")))
    return messages(plain)


def messages_from_pairs(pairs: Column) -> Column:
    """The same for pairs of a user's and an assistant's text; an empty or null answer is left out."""
    both = F.transform(
        pairs,
        lambda p: F.filter(
            F.array(F.struct(F.lit("user").alias("role"), p["user"].alias("content")), F.struct(F.lit("assistant").alias("role"), p["assistant"].alias("content"))),
            lambda m: (m["role"] == "user") | (F.coalesce(m["content"], F.lit("")) != ""),
        ),
    )
    return messages(F.flatten(both))


def recent(history: Column, max_turns: int) -> Column:
    """From the ``max_turns``-th user message from the end on; nothing without a user message."""

    def cut(h: Column) -> Column:
        starts = F.filter(F.transform(h, lambda m, i: F.when(m["role"] == "user", i + 1)), lambda i: i.isNotNull())
        first = F.try_element_at(starts, F.greatest(F.size(starts) - (max_turns - 1), F.lit(1)))
        return F.when((F.lit(max_turns) > 0) & first.isNotNull(), F.slice(h, first, F.size(h))).otherwise(F.slice(h, F.lit(1), F.lit(0)))

    return let(messages(history), cut)


def retrieval_text(message: Column, history: Column | None = None, pattern: str = fixed.FOLLOW_UP) -> Column:
    """What to search with: a follow-up takes the previous question before it; words are translated."""
    if history is None:
        return translate_words(message)
    asked = F.filter(messages(history), lambda m: m["role"] == "user")
    last = F.try_element_at(asked, F.lit(-1))["content"]
    return translate_words(F.when(follow_up(message, pattern) & last.isNotNull(), F.concat_ws(" ", last, message)).otherwise(message))


def user_content(question: Column, context: Column) -> Column:
    return F.when(F.coalesce(context, F.lit("")) != "", fill("Context:\n{c}\n\nQuestion: {q}", c=context, q=question)).otherwise(question)


def render(history: Column) -> Column:
    """Messages in chat form: ``<|role|>``, text, ``<|end|>``, each on its line."""
    return F.array_join(F.transform(history, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"], F.lit("<|end|>\n"))), "")


def prompt(question: Column, history: Column, context: Column, system: str, response: Column | None = None, end: str = "<|endoftext|>") -> Column:
    """A prompt that ends in the assistant's tag or, with a response, a whole example that ends in the end mark once."""
    first = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")))
    asked = F.array(F.struct(F.lit("user").alias("role"), user_content(question, context).alias("content")))
    turns = F.concat(first, messages(history), asked)
    if response is None:
        return F.concat(render(turns), F.lit("<|assistant|>\n"))
    whole = render(F.concat(turns, F.array(F.struct(F.lit("assistant").alias("role"), response.alias("content")))))
    return F.when(whole.endswith(end), whole).otherwise(F.concat(whole, F.lit(end)))


def stop_ids(ids: Column) -> Column:
    """Known ids, each once, in order."""
    return F.array_sort(F.array_distinct(F.filter(ids, lambda i: i.isNotNull())))


def fit_budget(question: Column, history: Column, context: Column, budget: int, fixed_tokens: int = 0) -> Column:
    """struct<history, context> that fit a budget of white-space tokens (system and tags: ``fixed_tokens``).

    The oldest messages go first, and the history then starts at a user message;
    if that isn't enough the context keeps its leading words.
    """
    count = lambda t: word_count(F.coalesce(t, F.lit("")))
    room = F.lit(budget - fixed_tokens) - count(question) - count(context)

    def trim(h: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(h) + 1), lambda i: (i == 1) | (F.try_element_at(h, i)["role"] == "user") | (i == F.size(h) + 1))
        tail = lambda i: F.aggregate(F.slice(h, i, F.size(h) + 1), F.lit(0), lambda a, m: a + count(m["content"]))
        first = F.try_element_at(F.filter(starts, lambda i: tail(i) <= room), F.lit(1))
        kept = F.slice(h, F.coalesce(first, F.size(h) + 1), F.size(h) + 1)
        words = F.filter(F.split(F.coalesce(context, F.lit("")), r"\s+"), lambda w: w != "")
        over = F.when(first.isNull(), -room).otherwise(F.lit(0))
        cut = F.when(over > 0, F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - over, F.lit(0))), " ")).otherwise(F.coalesce(context, F.lit("")))
        return F.struct(kept.alias("history"), cut.alias("context"))

    return let(messages(history), trim)


# --- Long form ---------------------------------------------------------------------------


def normalize_long(turns: DataFrame) -> DataFrame:
    """Messages of user and assistant with text."""
    return turns.where(F.col("role").isin(*ROLES) & F.col("text").isNotNull())


def recent_long(turns: DataFrame, max_turns: int) -> DataFrame:
    """The rows of each conversation's last ``max_turns`` exchanges."""
    w = Window.partitionBy("conv_id")
    back = w.orderBy(F.col("turn").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    user = F.when(F.col("role") == "user", 1).otherwise(0)
    c, n = fresh(turns, "users_since"), fresh(turns, "users_wanted")
    seen = normalize_long(turns).withColumn(c, F.sum(user).over(back)).withColumn(n, F.least(F.sum(user).over(w), F.lit(max_turns)))
    return seen.where((F.col(c) < F.col(n)) | ((F.col(c) == F.col(n)) & (F.col("role") == "user"))).drop(c, n)


def with_previous_question(turns: DataFrame) -> DataFrame:
    """User rows with ``previous``: the user text before, null for the first."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    asked = normalize_long(turns).where("role = 'user'")
    return asked.withColumn("previous", F.last("text", ignorenulls=True).over(w))


def carry_forward(turns: DataFrame, value: Column, name: str) -> DataFrame:
    """User rows with ``name``: the newest earlier value that isn't empty."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    v = fresh(turns, "value_held")
    asked = normalize_long(turns).where("role = 'user'").withColumn(v, F.when(F.size(value) > 0, value))
    return asked.withColumn(name, F.last(v, ignorenulls=True).over(w)).drop(v)


def trim_long(turns: DataFrame, budget: int) -> DataFrame:
    """The newest rows of each conversation whose running number of tokens fits, from a user row on."""
    w = Window.partitionBy("conv_id")
    back = w.orderBy(F.col("turn").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total, start = fresh(turns, "tokens_since"), fresh(turns, "first_turn")
    fits = normalize_long(turns).withColumn(total, F.sum(word_count(F.col("text"))).over(back)).where(F.col(total) <= budget)
    first = F.min(F.when(F.col("role") == "user", F.col("turn"))).over(w)
    return fits.withColumn(start, first).where(F.col("turn") >= F.col(start)).drop(total, start)


def nest(turns: DataFrame) -> DataFrame:
    """One row per conversation with its messages in order."""
    packed = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    return normalize_long(turns).groupBy("conv_id").agg(
        F.transform(packed, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("history")
    )
