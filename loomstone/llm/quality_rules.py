"""Quality rules whose cut-offs are chosen under risk control, in DataFrame operations only.

Every rule rejects a document whose rate is above a cut-off. The rules' cut-offs
move together along one fixed list of settings, from the loosest down
(``SETTINGS``). In each stratum (language) the good documents among the labelled
ones that the base rules leave are a holdout: a setting is allowed if the exact binomial bound on the
false rejections of all its rules together is within ``RISK``, that is, if as
few as were seen would have a probability of at most the level under that rate.
Testing goes on to the next setting only while it succeeds (fixed sequence),
which needs no correction; the level is ``CONFIDENCE_LOSS`` over the number of
strata (Bonferroni). So with probability 1 - CONFIDENCE_LOSS no stratum loses
more than RISK of its good documents to the method.

Strata with fewer good labels than could ever allow a setting (without one false
rejection) are pooled, and the bound holds for their pool as a whole; a stratum
there also stops at the last setting up to which its own holdout loses no more
than RISK. Where the pool has too few labels, too, and in strata without any,
there is no cut-off and nothing is lost.

One pass over the texts; labels are joined to the measured rates, not to texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import SPACE_CLASS, let, store, text_or_empty

RISK = 0.02
CONFIDENCE_LOSS = 0.05
WINDOW = 8

#: Rates, in the order in which rejections name them, and the settings of their cut-offs from the loosest down.
RULES = ("symbol_rate", "upper_rate", "dup_line_rate", "repeat_rate", "mean_word")
SETTINGS = (
    (2.0, 0.9, 0.9, 0.3, 40.0),
    (1.0, 0.7, 0.7, 0.25, 30.0),
    (0.5, 0.5, 0.5, 0.2, 20.0),
    (0.25, 0.4, 0.4, 0.15, 15.0),
    (0.1, 0.3, 0.3, 0.1, 12.0),
    (0.05, 0.2, 0.2, 0.07, 11.0),
    (0.02, 0.1, 0.1, 0.05, 10.0),
)


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words that lie in a window of ``width`` words found twice or more in the text.

    Windows are compared by 64-bit hash. Only texts in which one repeats sort
    their windows by hash and place and add up the stretches covered.
    """
    windows = F.when(F.size(words) >= width, F.transform(F.sequence(F.lit(1), F.size(words) - (width - 1)), lambda i: F.xxhash64(F.slice(words, i, width))))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.least(F.lit(width), F.coalesce(F.get(at, i + 1) - p, F.lit(width))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, v: a + v)

    def places(found: Column) -> Column:
        same = lambda x, i: F.coalesce(x["h"] == F.get(found, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(found, i + 1)["h"], F.lit(False))
        return let(F.sort_array(F.transform(F.filter(found, same), lambda x: x["i"])), covered)

    def total(w: Column) -> Column:
        keyed = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) < F.size(w), let(keyed, places)).otherwise(F.lit(0).cast("long"))

    return F.coalesce(let(windows, total), F.lit(0).cast("long"))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang") -> DataFrame:
    """One row per row of ``docs`` with counts of its whole text; null text has none."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), text.alias("text"))
    rows = rows.select(
        "doc_id", "stratum", "text",
        F.filter(F.split("text", f"{SPACE_CLASS}+"), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"),
    )
    without = lambda chars: (F.char_length("text") - F.char_length(F.regexp_replace("text", chars, ""))).cast("long")
    return rows.select(
        "doc_id",
        "stratum",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        without("[#*$%&|<>]").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        without("[A-Z]").alias("n_upper"),
    )


def rates(counts: DataFrame) -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbol_rate": F.col("n_symbols") / words,
        "upper_rate": F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)),
        "dup_line_rate": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_rate": F.col("n_repeat_words") / words,
        "mean_word": F.col("word_chars") / words,
    }


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) for X binomial (n, rate), exact by the recurrence of terms in logs; 1 where k is no less than the mean."""
    first = F.log(F.lit(1 - rate)) * n
    odds = F.log(F.lit(rate / (1 - rate)))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + odds
        top = F.greatest(acc["total"], term)
        return F.struct(term.alias("term"), (top + F.log(F.exp(acc["total"] - top) + F.exp(term - top))).alias("total"))

    terms = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    total = F.aggregate(terms, F.struct(first.alias("term"), first.alias("total")), step, lambda acc: acc["total"])
    return F.when(k >= n * rate, F.lit(1.0)).otherwise(F.exp(total))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def least_labels(strata: Column, risk: float, loss: float) -> Column:
    """The number of good labels at which a holdout without a false rejection allows a setting."""
    return F.ceil(F.log(F.lit(loss) / F.greatest(strata, F.lit(1))) / F.log(F.lit(1 - risk)))


def cutoffs(counts: DataFrame, labels: DataFrame, id_col: str = "doc_id", good_col: str = "quality", risk: float = RISK, loss: float = CONFIDENCE_LOSS) -> DataFrame:
    """One row per stratum with good labels: pool, good labels there, and the place of its last allowed setting, null where none is.

    Labels that are null, repeated or of unknown ids don't count twice or at
    all; of an id with several labels, one that says good is enough.
    """
    good = labels.where(F.col(good_col) == 1).select(F.col(id_col).alias("doc_id")).distinct()
    measured = counts.where(~base_failed()).select("doc_id", "stratum", *(v.alias(k) for k, v in rates(counts).items()))
    held = measured.join(good, "doc_id", "left_semi")
    lost = [F.count_if(reduce(lambda a, b: a | b, (F.col(r) > c for r, c in zip(RULES, cuts, strict=True)))).alias(f"lost_{i}") for i, cuts in enumerate(SETTINGS)]
    table = store(held.groupBy("stratum").agg(F.count("*").alias("n"), *lost), "rule-strata")

    whole = table.agg(F.count("*").alias("strata"))
    few = F.col("n") < least_labels(F.col("strata"), risk, loss)
    pool = F.when(few, F.lit("few")).otherwise(F.concat(F.lit("own "), F.col("stratum")))
    settings = range(len(SETTINGS))

    def leading(passed: list[Column]) -> Column:
        """The place of the last setting before the first that fails, null if that is the first."""
        held = F.array(*passed)
        first = F.coalesce(F.nullif(F.array_position(held, F.lit(False)), F.lit(0).cast("long")) - 1, F.size(held).cast("long"))
        return F.nullif(first - 1, F.lit(-1).cast("long"))

    spared = leading([F.col(f"lost_{i}") <= F.col("n") * risk for i in settings])
    placed = table.join(F.broadcast(whole), how="cross").select("stratum", pool.alias("pool"), spared.alias("spared"), "n", *(f"lost_{i}" for i in settings))
    pooled = placed.groupBy("pool").agg(F.sum("n").alias("n_good"), *(F.sum(f"lost_{i}").alias(f"lost_{i}") for i in settings))
    level = F.lit(loss) / F.col("pools")
    allowed = leading([binomial_tail(F.col(f"lost_{i}"), F.col("n_good"), risk) <= level for i in settings])
    tested = pooled.join(F.broadcast(pooled.agg(F.count("*").alias("pools"))), how="cross").select("pool", "n_good", allowed.alias("allowed"))
    both = F.when(F.col("allowed").isNotNull() & F.col("spared").isNotNull(), F.least("allowed", "spared"))
    return placed.select("stratum", "pool", "spared").join(tested, "pool").select("stratum", "pool", "n_good", both.alias("setting"))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang") -> DataFrame:
    """One row per row of ``docs``: its counts, base_failed, kept and the rules that reject it.

    Null text counts as empty and fails the base; a null stratum is "". Repeated
    rows are judged row by row; without labels no rule has a cut-off, and an
    empty table gives no rows. Columns other than those named are not read.
    """
    counts = store(measure(docs, id_col, text_col, stratum), "rule-counts")
    cuts = cutoffs(counts, labels, id_col).select("stratum", "setting")
    joined = counts.join(cuts, "stratum", "left")
    values = rates(counts)
    at = (F.col("setting") + 1).cast("int")
    cut = lambda k: F.element_at(F.array(*(F.lit(float(s[k])) for s in SETTINGS)), at)
    hits = F.when(F.col("setting").isNotNull(), F.array_join(F.array(*(F.when(values[r] > cut(k), F.lit(r)) for k, r in enumerate(RULES))), ","))
    joined = joined.withColumn("rejected_by", F.coalesce(hits, F.lit("")))
    failed = base_failed()
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("rejected_by") == "")).alias("kept"), "rejected_by",
    )
