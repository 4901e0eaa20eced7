"""Goldens of cleaning, translation, chunks, histories and prompts."""

import re

import pytest
from pyspark.sql import functions as F

from loomstone.functions import facts, fixed, text
from loomstone.operators import history as H
from loomstone.operators import retrieval

TURNS = "array<struct<role:string,content:string>>"


def clean(spark, *pairs):
    df = spark.createDataFrame(list(pairs), "i string, r string")
    a, b = text.clean_pair(F.col("i"), F.col("r"))
    return [(x.a, x.b) for x in df.select(a.alias("a"), b.alias("b")).collect()]


def test_slots_are_filled_alike_and_nothing_is_invented(spark):
    row = ("cancel order {{Order Number}}", "Order {{Order Number}} is cancelled. Call {{Customer Support Phone Number}} or click '{{Forgot Password}}'.")
    (a, b), again = clean(spark, row, row)
    assert (a, b) == again and "{{" not in a + b
    order = a.split()[-1]
    assert re.fullmatch(r"ORD-\d{6}", order) and order in b and "Forgot Password" in b

    [(a, b)] = clean(spark, ("invoice from {{Person Name}}, refund of {{Refund Amount}} dollars", "The bill from {{Salutation}} {{Client Last Name}} for {{Currency Symbol}}{{Money Amount}} is ready."))
    first, last = a.split(",")[0].split()[-2:]
    assert f" {last} for ${a.split()[-2]} is ready." in b and (first, last) in {(p[0], p[1]) for p in fixed.PEOPLE}

    [(_, b)] = clean(spark, (
        "i paid for this item, help me get a refund on my platinum acocunt",
        "Please share the {{Order Number}} or {{Tracking Number}}. Your refund of {{Currency Symbol}}{{Refund Amount}} for the invoice with the number "
        "#{{Invoice Number}} from {{Salutation}} {{Client Last Name}} arrives in {{Date Range}} business days to your {{Account Type}} account.",
    ))
    assert b == (
        "Please share the order number or tracking number. Your refund of the amount you mentioned for the invoice from the person you mentioned "
        "arrives in a few business days to your Platinum account."
    )


def test_nested_unknown_and_null_slots(spark):
    got = clean(spark, ("help", "Use {{Switch to {{Account Type}}}} now"), (None, None), ("help me", "Visit our {{Website URL}} today."), ("help me", "Here is the invoice {{Invoice Number}}."), ("help me", "Please give the specific {{Date Range}}."))
    assert [b for _, b in got] == ["Use Switch to new now", "", "Visit our website today.", "Here is the invoice number.", "Please give the date range."]


def test_translation_and_follow_ups(spark):
    h = [("user", "How much is inspection for a Prado?"), ("assistant", "PKR 9,950.")]
    rows = [
        ("And what about a 1000cc car?", h, "How much is inspection for a Prado? And what about a 1000cc car?"),
        ("Where is my order?", h, "Where is my order?"),
        ("Gari bechni hai, ad kaise lagaun?", [], "car sell, ad how post?"),
        ("Feature ad ke kitne paise lagte hain?", [], "Feature ad how much price cost?"),
        ("How do I post an ad?", [], "How do I post an ad?"),
        ("", [], ""),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], f"m string, h {TURNS}")
    assert [r.q for r in df.select(H.retrieval_text(F.col("m"), F.col("h")).alias("q")).collect()] == [r[2] for r in rows]


def test_recent_keeps_the_last_exchanges(spark):
    h = [x for i in range(5) for x in (("user", f"q{i}"), ("assistant", f"a{i}"))]
    rows = [(h, 2, ["q3", "a3", "q4", "a4"]), (h, 0, []), (h[:2], 2, ["q0", "a0"]), ([("assistant", "x")], 2, []), ([("user", "a"), ("user", "b"), ("system", "s")], 1, ["b"]), (None, 2, [])]
    for turns, n, want in rows:
        df = spark.createDataFrame([(turns,)], f"h {TURNS}")
        assert [m.content for m in df.select(H.recent(F.col("h"), n).alias("r")).first().r] == want


def test_shapes_of_history_agree(spark):
    plain = spark.createDataFrame([([("user", "hi there"), ("assistant", "yo")],)], f"h {TURNS}").select(H.messages(F.col("h")).alias("m")).first().m
    blocks = spark.createDataFrame([([("user", [("hi",), ("there",)]), ("assistant", [("yo",)]), ("tool", [("x",)])],)], "h array<struct<role:string,content:array<struct<text:string>>>>")
    pairs = spark.createDataFrame([([("hi there", "yo")],)], "h array<struct<user:string,assistant:string>>")
    open_pair = spark.createDataFrame([([("hi there", None)],)], "h array<struct<user:string,assistant:string>>")
    assert blocks.select(H.messages_from_blocks(F.col("h")).alias("m")).first().m == plain
    assert pairs.select(H.messages_from_pairs(F.col("h")).alias("m")).first().m == plain
    assert open_pair.select(H.messages_from_pairs(F.col("h")).alias("m")).first().m == plain[:1]


def test_prompts(spark):
    df = spark.createDataFrame([("q?", [("user", "a"), ("assistant", "b")], "ctx", "r")], f"q string, h {TURNS}, c string, r string")
    gen = H.prompt(F.col("q"), F.col("h"), F.col("c"), "sys")
    full = H.prompt(F.col("q"), F.col("h"), F.col("c"), "sys", F.col("r"))
    x = df.select(gen.alias("g"), full.alias("f")).first()
    assert x.g == "<|system|>\nsys<|end|>\n<|user|>\na<|end|>\n<|assistant|>\nb<|end|>\n<|user|>\nContext:\nctx\n\nQuestion: q?<|end|>\n<|assistant|>\n"
    assert x.f == x.g + "r<|end|>\n<|endoftext|>"


def test_budget_drops_the_oldest_then_cuts_the_context(spark):
    h = [x for i in range(50) for x in (("user", f"q{i} " + "w " * 9), ("assistant", f"a{i} " + "w " * 9))]
    df = spark.createDataFrame([("now", h, ""), ("now", [], " ".join(f"c{i}" for i in range(5000)))], f"q string, h {TURNS}, c string")
    a, b = [r.f for r in df.select(H.fit_budget(F.col("q"), F.col("h"), F.col("c"), 200).alias("f")).collect()]
    assert 0 < len(a.history) < 100 and a.history[0].role == "user" and a.history[-1].content.startswith("a49")
    assert sum(len(m.content.split()) for m in a.history) <= 199
    assert b.context.split() == [f"c{i}" for i in range(199)]


@pytest.mark.parametrize("t, want", [("the the cat", "the cat"), ("Go go GO now", "Go now"), ("été été fini", "été fini"), ("a b a b", "a b a b"), ("", "")])
def test_doubled_words(spark, t, want):
    assert spark.createDataFrame([(t,)], "t string").select(text.dedup_words(F.col("t")).alias("d")).first().d == want


def test_recursive_chunks(spark):
    docs = spark.createDataFrame([(1, "a " * 1200), (2, "short"), (3, ""), (4, None), (5, "x" * 2500)], "doc_id int, text string")
    got = retrieval.recursive_chunks(docs).collect()
    assert {r.id for r in got} == {1, 2, 5} and max(len(r.chunk) for r in got) <= 1000
    assert "".join(r.chunk for r in got if r.id == 2) == "short"
    one = [r.chunk for r in sorted(got, key=lambda r: r.chunk_no) if r.id == 5]
    assert len(one) >= 3 and one[0] == "x" * 1000


def test_first_match_prefers_the_earlier_rule(spark):
    df = spark.createDataFrame([("corolla cross",), ("corolla",), ("none",)], "t string")
    got = df.select(facts.first_match(F.col("t"), [("corolla cross", F.lit("suv")), ("corolla", F.lit("mid"))]).alias("v")).collect()
    assert [r.v for r in got] == ["suv", "mid", None]


def test_folded_chunks_equal_the_others(spark):
    """Paragraphs, lines, words and bare runs, longer and shorter than a chunk, with characters of several bytes."""
    import random

    rng = random.Random(4)
    part = lambda: "".join(rng.choice(["ab", "é", "日本", "x" * 9, " ", "  ", "\n", "\n\n", "\t", "\U0001f600"]) for _ in range(rng.randint(0, 60)))
    texts = [None, "", " \n ", "y" * 95, *(part() for _ in range(60))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for size, overlap in ((20, 5), (30, 0), (12, 11)):
        rows = lambda f: sorted(map(tuple, f(docs, size, overlap).collect()))  # noqa: B023, E731
        assert rows(retrieval.folded_chunks) == rows(retrieval.recursive_chunks)
