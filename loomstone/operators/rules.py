"""Rule checks of answers, rule joins and reference checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.operators import patterns


def check(answer: Column, must: Column, must_not: Column) -> Column:
    """Failures of an answer: groups of patterns of which none matches, then forbidden patterns that match. Case doesn't count."""
    text = F.coalesce(answer, F.lit(""))
    hit = lambda p: F.rlike(text, F.concat(F.lit("(?iU)"), p))
    missing = F.transform(F.filter(F.coalesce(must, F.array().cast("array<array<string>>")), lambda g: ~F.exists(g, hit)), lambda g: F.concat(F.lit("missing: "), F.array_join(g, " | ")))
    forbidden = F.transform(F.filter(F.coalesce(must_not, F.array().cast("array<string>")), hit), lambda p: F.concat(F.lit("forbidden: "), p))
    return F.concat(missing, forbidden)


def score_cases(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """(id, topic, question, answer, passed, failures) for every case; a case without an answer has "" for one."""
    given = answers.select(F.col("id").cast("string").alias("answer_id"), F.col("answer").alias("answer"))
    asked = cases.select("id", "topic", "q", "must", "must_not")
    rows = asked.join(given, F.col("id").cast("string") == F.col("answer_id"), "left")
    failures = check(F.col("answer"), F.col("must"), F.col("must_not"))
    scored = rows.select("id", "topic", F.col("q").alias("question"), F.coalesce("answer", F.lit("")).alias("answer"), failures.alias("failures"))
    return scored.withColumn("passed", F.size("failures") == 0).select("id", "topic", "question", "answer", "passed", "failures")


def pass_rate(scored: DataFrame, topic: str = "topic", order: str = "id") -> DataFrame:
    """(topic, passed, total, rate), topics in the order of their first case."""
    table = scored.groupBy(topic).agg(F.count_if("passed").alias("passed"), F.count("*").alias("total"), F.min(order).alias("first_case"))
    return table.withColumn("rate", F.col("passed") / F.col("total")).orderBy("first_case").drop("first_case")


def first_match_join(rows: DataFrame, rules: DataFrame, text: str, key: str) -> DataFrame:
    """Rows with the value of the first rule (pattern, value, priority) that matches, null where none does; ``key`` comes first.

    For rule tables that are data rather than literals: see ``patterns``. Nothing
    is joined, so rows with a null or repeated key have their value as well.
    Literal rules are better stated as one CASE expression
    (functions.facts.first_match).
    """
    return patterns.first_match(rows.select(key, *(c for c in rows.columns if c != key)), rules, text)


def unknown_references(rows: DataFrame, column: str, known: DataFrame, name: str = "title") -> DataFrame:
    """Values of an array column that the known table hasn't."""
    used = rows.select(F.explode(column).alias(name)).distinct()
    return used.join(known.select(name).distinct(), name, "left_anti")


def require_known(rows: DataFrame, column: str, known: DataFrame, name: str = "title") -> None:
    found = [r[0] for r in unknown_references(rows, column, known, name).orderBy(name).limit(20).collect()]
    if found:
        raise KeyError(f"{name} not found: {found}")


#: Digits in groups as bank accounts have them, or an IBAN.
BANK = r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b|\b\d{4}-\d{4}-\d{4}\b"


def holding(rows: DataFrame, column: str, pattern: str = BANK) -> DataFrame:
    """The rows whose column holds the pattern."""
    return rows.where(F.col(column).rlike(pattern))


def require_absent(rows: DataFrame, column: str, pattern: str = BANK) -> None:
    if not holding(rows, column, pattern).isEmpty():
        raise ValueError(f"{column} holds what it must not: {pattern}")
