"""Evaluation: longest common subsequences, drift decisions, evaluation runs with pluggable models."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from loomstone.shipping import map_arrow, ship
from loomstone.sources import sinks


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a machine word of ``b`` at a time: bits that fall to 0 are matches."""
    places: dict[str, int] = {}
    for i, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << i
    full = state = (1 << len(b)) - 1
    for x in a:
        hit = state & places.get(x, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(b) - state.bit_count()


def with_rouge_l(rows: DataFrame, prediction: str = "prediction", reference: str = "response", out: str = "rouge_l") -> DataFrame:
    """Rows with the F1 of the longest common subsequence of two texts' tokens (0 where nothing is common).

    Tokens are runs of ASCII letters and digits in lower case; null counts as empty.
    """
    names = [*rows.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = re.compile("[a-z0-9]+")
        for b in batches:
            pairs = zip(*(b.column(names.index(c)).to_pylist() for c in (prediction, reference)), strict=True)
            scores = []
            for p, r in pairs:
                x, y = cut.findall((p or "").lower()), cut.findall((r or "").lower())
                n = lcs_length(x, y)
                scores.append(2.0 * n / (len(x) + len(y)) if n else 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=names)

    return map_arrow(rows, run, StructType([*rows.schema.fields, StructField(out, DoubleType())]))


def score_with(rows: DataFrame, model: Callable[[pd.DataFrame], pd.Series], out: str = "prediction", kind: str = "string") -> DataFrame:
    """Rows with a column that an outside model, judge or tokenizer gives, batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{out: model(b)})

    ship(rows.sparkSession)
    return rows.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in [*rows.dtypes, (out, kind)]))


def evaluate(test: DataFrame, model: Callable[[pd.DataFrame], pd.Series], samples: int, order: str = "id", reference: str = "response") -> float:
    """Mean ROUGE-L of a model over the first ``samples`` test rows by ``order``."""
    rows = test.orderBy(order).limit(samples)
    scored = with_rouge_l(score_with(rows, model), "prediction", reference)
    return float(scored.agg(F.coalesce(F.avg("rouge_l"), F.lit(0.0))).first()[0])


def answer_conversation(cases: DataFrame, answer: Callable[[dict, list[dict]], str], key: str = "chat", order: str = "id") -> DataFrame:
    """Answers of each chat's cases in order, every case seeing the chat before it unless it brings a history of its own.

    A chat is sequential by nature; chats run beside each other.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        chat: list[dict] = []
        out = []
        for case in pdf.sort_values(order).to_dict("records"):
            own = case.get("history")
            reply = answer(case, list(own) if own is not None and len(own) else chat)
            chat += [{"role": "user", "content": case["q"]}, {"role": "assistant", "content": reply}]
            out.append({key: case[key], order: case[order], "answer": reply})
        return pd.DataFrame(out, columns=[key, order, "answer"])

    kinds = dict(cases.dtypes)
    ship(cases.sparkSession)
    return cases.groupBy(key).applyInPandas(fold, f"{key} {kinds[key]}, {order} {kinds[order]}, answer string")


def drift(baseline: Column, current: Column, warn: float = 0.05, retrain: float = 0.10) -> Column:
    """struct<drop, decision>: "retrain" or "warn" if the drop is above the threshold, else "stable"."""
    drop = baseline - current
    return F.struct(drop.alias("drop"), F.when(drop > retrain, F.lit("retrain")).when(drop > warn, F.lit("warn")).otherwise(F.lit("stable")).alias("decision"))


EVENT = {"retrain": ("drift_triggered", "retrain"), "warn": ("drift_warning", "monitor"), "stable": ("no_drift_detected", "none")}


def detect_drift(spark: SparkSession, current: float, folder: str, warn: float = 0.05, retrain: float = 0.10, log: sinks.Log | None = None) -> bool:
    """Whether to retrain, against the baseline kept in ``folder``; metrics and the decision go to the log."""
    baseline = sinks.load_baseline(spark, folder)
    row = spark.range(1).select(drift(F.lit(baseline), F.lit(float(current)), warn, retrain).alias("d")).first().d
    if log is not None:
        log.metrics({"baseline_accuracy": baseline, "current_accuracy": current, "accuracy_drop": row["drop"]})
        name, action = EVENT[row["decision"]]
        log.event("accuracy_drift_check", output={"baseline_accuracy": baseline, "current_accuracy": current, "accuracy_drop": row["drop"], "warn_threshold": warn, "retrain_threshold": retrain})
        log.event(name, output={"action": action})
    return row["decision"] == "retrain"


def run_drift(spark: SparkSession, evaluate_once: Callable[[], float], retrain_model: Callable[[], None], folder: str, auto_retrain: bool, warn: float = 0.05, retrain: float = 0.10, log: sinks.Log | None = None) -> bool:
    """Evaluate, decide and, if allowed, retrain and keep the new score as the baseline. True if it retrained."""
    current = evaluate_once()
    wanted = detect_drift(spark, current, folder, warn, retrain, log)
    if log is not None:
        log.event("drift_check", output={"current_accuracy": current, "should_retrain": wanted})
    if wanted and auto_retrain:
        retrain_model()
        sinks.save_baseline(spark, evaluate_once(), folder)
        return True
    if wanted and log is not None:
        log.event("auto_retrain_disabled")
    return False
