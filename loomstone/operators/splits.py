"""Train and test splits that hold out whole questions, and contamination checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions.text import fresh, question_key
from loomstone.operators import gates
from loomstone.operators.draws import digest
from loomstone.sources.shared import store

#: Held-out keys that a plan may hold as one set.
SET = 10_000


def test_keys(rows: DataFrame, test_size: int, seed: int, question: str = "instruction") -> DataFrame:
    """(key): ``test_size`` distinct questions, by the order of their digests. The feature is the size, so it is bounded."""
    keys = rows.select(question_key(F.col(question)).alias("key")).distinct()
    return keys.orderBy(digest(seed, F.col("key")), "key").limit(test_size)


def split_by_question(rows: DataFrame, test_size: int, seed: int, question: str = "instruction", history: str = "history") -> tuple[DataFrame, DataFrame]:
    """(train, test): all rows of a test question go to test; a training row whose history asks one is left out of both.

    ``history`` is an array of struct<role, content>; without that column no
    row is left out for it. The held-out keys are ``test_size`` rows, stored
    once and joined as Spark sees fit; of more than ``SET`` keys see ``hold_out``.
    """
    own = fresh(rows, "own_key")
    held = store(test_keys(rows, test_size, seed, question).withColumnRenamed("key", own), "held")
    if test_size > SET:
        return hold_out(rows, held, own, question, history)
    keyed = rows.withColumn(own, question_key(F.col(question)))
    test = keyed.join(held, own, "left_semi").drop(own)
    rest = keyed.join(held, own, "left_anti").drop(own)
    if history in rows.columns:
        asked = F.transform(F.filter(history, lambda m: m["role"] == "user"), lambda m: question_key(m["content"]))
        # A scalar subquery of at most ``test_size`` keys: no explode, no join and no shuffle of histories.
        told = held.agg(F.collect_set(own)).scalar()
        rest = rest.where(~F.coalesce(F.arrays_overlap(asked, told), F.lit(False)))
    return rest, test


def hold_out(rows: DataFrame, held: DataFrame, key: str = "key", question: str = "instruction", history: str = "history") -> tuple[DataFrame, DataFrame]:
    """(train, test) as ``split_by_question``, for any table of held-out keys: rows are joined with them only behind a filter."""
    test, rest = gates.split_by_keys(rows, F.array(question_key(F.col(question))), held, key)
    if history in rows.columns:
        asked = F.transform(F.filter(history, lambda m: m["role"] == "user"), lambda m: question_key(m["content"]))
        rest = gates.split_by_keys(rest, asked, held, key)[1]
    return rest, test


def split_rows(rows: DataFrame, key: Column, test_size: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(train, test) by row: ``test_size`` rows by the order of their keys' digests."""
    d = digest(seed, key)
    last = rows.select(d.alias("d")).orderBy("d").limit(test_size).agg(F.max("d")).first()[0]
    cut = d <= F.lit(last) if last is not None else F.lit(False)
    return rows.where(~cut), rows.where(cut)


def shared_keys(a: DataFrame, b: DataFrame, question: str = "instruction") -> DataFrame:
    """Questions on both sides: empty for a good split."""
    key = lambda t: t.select(question_key(F.col(question)).alias("key"))
    return key(a).intersect(key(b))


def contaminated(protected: DataFrame, rows: DataFrame, question: str = "instruction", history: str = "history", protected_col: str = "q") -> DataFrame:
    """Protected questions that occur among the rows' questions or their histories' user messages.

    Rows pass a filter of the protected questions before anything of them is
    exploded or moved. Null questions match nothing; repeated ones stay repeated.
    """
    keys = F.array(question_key(F.col(question)))
    if history in rows.columns:
        told = F.transform(F.filter(history, lambda m: m["role"] == "user"), lambda m: question_key(m["content"]))
        keys = F.concat(keys, F.coalesce(told, F.array().cast("array<string>")))
    asked = protected.where(F.col(protected_col).isNotNull())
    gate = gates.Gate(asked.select(question_key(F.col(protected_col)).alias("key")))
    passed, _ = gate.parted(rows, keys)
    seen = passed.select(F.explode(keys).alias("key")).distinct()
    return asked.join(seen, question_key(F.col(protected_col)) == F.col("key"), "left_semi")


def require_clean(protected: DataFrame, rows: DataFrame, **how: str) -> None:
    found = [r[0] for r in contaminated(protected, rows, **how).select(how.get("protected_col", "q")).limit(20).collect()]
    if found:
        raise ValueError(f"protected questions must not be training rows: {sorted(found)}")
