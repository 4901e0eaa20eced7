"""Rule tables by automaton, band joins, and joins behind a filter."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from loomstone.functions import fixed
from loomstone.operators import bands, gates, patterns, rules, splits
from loomstone.plans import queries_joins
from loomstone.sources.shared import store

# --- Patterns -----------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        ("corolla cross", ["corolla cross"]), (r"\balto\b|mehran", ["alto", "mehran"]), ("wagon ?r", ["wagon"]), ("(?:ring|gear)$", ["gear", "ring"]),
        ("a|", []), (r"\d+cc", ["cc"]), ("x*", []), ("(ab)?cd{2}", ["c"]), ("(?:foo){1,3}", ["foo"]), ("(?<!no )sale(?= price)", ["sale"]), ("[abc]x[yz]", ["x"]), ("(?i:Straße)", ["stra"]), ("(?-i:Aa)", []), ("(?x)a b", []),
    ],
)
def test_factors_are_demanded(pattern, want):
    assert patterns.factors(pattern) == want


def test_candidates_hold_every_rule_that_matches():
    """On random texts and expressions, and with letters that equal ASCII ones without case."""
    rng = random.Random(5)
    part = lambda: "".join(rng.choice("abks") for _ in range(rng.randint(1, 3)))
    make = [lambda: part(), lambda: f"{part()}|{part()}", lambda: f"{part()}.?{part()}", lambda: f"(?:{part()}|{part()}){{1,2}}{part()}", lambda: rf"\b{part()}\b", lambda: f"[ab]{part()}?", lambda: f"({part()})?{part()}+"]
    known = patterns.FirstMatch([(rng.choice(make)(), n) for n in range(300)])
    for _ in range(300):
        text = "".join(rng.choice("abksABKS ſKıİ") for _ in range(rng.randint(0, 8)))
        hits = [n for n, (p, _) in enumerate(known.rules) if re.search(p, text, re.I)]
        assert set(hits) <= set(known.candidates(text)) and known.find(text) == (hits[0] if hits else -1)


def test_rules_beyond_the_text_cost_nothing():
    """Of ten times the rules the same few are tried."""
    words = [f"word{i}x" for i in range(20_000)]
    tried = [len(patterns.FirstMatch([(rf"\b{w}\b", w) for w in words[:n]]).candidates("a word17x and word1999x or so")) for n in (2_000, 20_000)]
    assert tried == [2, 2]


def test_first_match_of_a_table(spark, monkeypatch):
    table = [(p, name, i // 2) for i, (p, name, _) in enumerate(fixed.CARS)] + [(None, "never", -1), ("", "empty", 999), ("civic", None, 0)]
    known = spark.createDataFrame(table, "pattern string, value string, priority int")
    texts = ["Corolla Cross or corolla", "my SUZUKI EVERY", "civic", None, "", "nothing here", "civic"]
    rows = spark.createDataFrame([(None if i == 2 else i % 5, t, [1]) for i, t in enumerate(texts)], "id int, text string, value array<int>")
    order = sorted(((r, p, v or "") for p, v, r in table if p is not None), key=lambda x: (x[0], x[1], x[2]))
    want = [next((v or None for r, p, v in order if re.search(p, t, re.I)), None) if t is not None else None for t in texts]
    plain = lambda: [r.found for r in patterns.first_match(rows, known, "text", "found").collect()]
    assert plain() == want and want[2] is None
    monkeypatch.setattr(patterns, "RULES", 10)
    assert plain() == want
    assert patterns.first_match(rows, known.where("false"), "text", "found").where("found is null").count() == 7
    assert patterns.first_match(rows.where("false"), known, "text", "found").count() == 0
    with pytest.raises(TypeError):
        patterns.first_match(rows, known.withColumn("value", F.lit(1)), "text")


# --- Bands --------------------------------------------------------------------------------------


def plain_bands(values, held):
    return sorted((i, j) for i, v in values for j, lo, hi in held if None not in (v, lo, hi) and lo <= v < hi)


def paired(spark, values, held, **how):
    rows = spark.createDataFrame(values, "id long, v double")
    table = spark.createDataFrame(held, "id long, low double, high double")
    return sorted((r.id, r.id_band) for r in bands.band_join(rows, table, "v", **how).collect())


def test_bands_equal_the_plain_join(spark):
    rng = random.Random(1)
    inf, nan = math.inf, math.nan
    values = [(i, rng.choice([rng.uniform(-50, 1000), float(rng.randint(-5, 30)), 1e-9 * i])) for i in range(150)]
    held = [(i, lo, lo + rng.choice([0.0, 1e-9, 0.5, 3.0, 64.0, 500.0, -1.0])) for i, lo in enumerate(rng.choice([rng.uniform(-60, 1000), float(rng.randint(-5, 30))]) for _ in range(120))]
    odd_values = [(200, None), (201, nan), (202, inf), (203, -inf), (7, values[7][1]), (204, 1000.0)]
    odd_bands = [(200, -inf, inf), (201, None, 5.0), (202, 0.0, nan), (203, 10.0, inf), (204, -inf, 3.0), (3, *held[3][1:]), (205, 5.0, 5.0)]
    finite = [x for x in values + odd_values if x[1] is None or math.isfinite(x[1])]
    assert paired(spark, values + odd_values, held + odd_bands) == plain_bands(finite, held + odd_bands)


def test_bins_with_very_many_values_are_dealt(spark):
    values = [(i, 5.0) for i in range(100)] + [(100 + i, 5.0 + i / 7) for i in range(40)]
    held = [(1, 4.0, 6.0), (2, 5.0, 5.5), (3, 0.0, 100.0), (4, 9.0, 9.5)]
    assert paired(spark, values, held, hot=10) == plain_bands(values, held)


def test_bands_without_rows_and_of_one_value(spark):
    held = [(1, 4.0, 6.0), (2, 5.0, 5.5)]
    assert paired(spark, [], held) == [] and paired(spark, [(1, 5.0)], []) == [] and paired(spark, [(1, None)], held) == []
    assert paired(spark, [(1, 5.0)], held) == [(1, 1), (1, 2)] and paired(spark, [(1, 7.0)], held) == []


def test_band_join_has_no_nested_loop(spark):
    rows = spark.range(1000).selectExpr("id", "id * 1.5D v")
    held = spark.range(100).selectExpr("id", "id * 3.0D low", "id * 3.0D + id high")
    plan = bands.band_join(rows, held, "v")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


# --- Filters -------------------------------------------------------------------------------------


def test_filter_never_loses_a_key_and_passes_few_others(spark):
    keys = spark.range(20_000).selectExpr("concat('k', id) key")
    rows = spark.range(0, 40_000).selectExpr("id", "array(concat('k', id), null) ks")
    may, free = gates.Gate(keys).parted(rows, F.col("ks"))
    assert may.where("id < 20000").count() == 20_000 and free.where("id < 20000").count() == 0
    assert may.where("id >= 20000").count() < 500


def test_split_by_keys_is_exact(spark, monkeypatch):
    monkeypatch.setattr(gates, "PER_KEY", 1)  # a filter that lets much pass
    held = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "key string")
    rows = [(1, ["a"]), (1, ["a"]), (2, ["c", "b"]), (3, ["c", None]), (None, ["d"]), (4, None), (5, [])] + [(10 + i, [f"x{i}", f"y{i}"]) for i in range(100)]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "id long, keys array<string>, may int, bits string")
    own, other = gates.split_by_keys(df, F.col("keys"), held)
    assert own.columns == other.columns == df.columns
    assert sorted(r.id for r in own.collect()) == [1, 1, 2]
    assert sorted(r.id or 0 for r in other.collect()) == sorted([0, 3, 4, 5, *range(10, 110)])
    own, other = gates.split_by_keys(df, F.col("keys"), held.where("false"))
    assert own.count() == 0 and other.count() == len(rows)


def test_splits_behind_a_filter_equal_the_others(spark, monkeypatch):
    turn = lambda q: [{"role": "user", "content": q}, {"role": "assistant", "content": "q1"}]
    rows = [(f"q{i} ", []) for i in range(20)] + [(f"follow-up {i}", turn(f"Q{i}")) for i in range(20)] + [("alone", None)]
    df = spark.createDataFrame(rows, "instruction string, history array<struct<role:string,content:string>>")
    sides = lambda: [sorted(r.instruction for r in side.collect()) for side in splits.split_by_question(df, 10, 1)]
    want = sides()
    monkeypatch.setattr(splits, "SET", 5)
    assert sides() == want and len(want[0]) < len(rows) - 10


def test_first_match_join_of_rule_tables_still_agrees(spark):
    rows = spark.createDataFrame([(1, "blue bolt"), (2, "nothing")], "k int, t string")
    known = spark.createDataFrame([("blue", "thing", 2), ("bolt", "bolt", 1)], "pattern string, value string, priority int")
    got = {r.k: r.value for r in rules.first_match_join(rows, known, "t", "k").collect()}
    assert got == {r.k: r.value for r in patterns.first_match(rows, known, "t").collect()} == {1: "bolt", 2: None}


def test_only_pairs_that_may_be_questions_are_grouped(spark, testdata, monkeypatch):
    kept = {}
    monkeypatch.setattr(queries_joins, "store", lambda df, name: kept.setdefault(name, store(df, name)))
    queries_joins.gated_split(spark, testdata)
    assert kept["held"].count() < 2 * kept["asked"].count() + 100  # before, all pairs of words of all documents
