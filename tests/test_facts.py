"""Goldens of reading questions, answering them and guarding answers."""

import pytest
from pyspark.sql import functions as F

from loomstone import catalog
from loomstone.functions import facts, fixed, text
from loomstone.functions.fixed import FACT_HEADER, Domain

DOMAIN = Domain(brand="Carhub", site="carhub.example", helpline="111")
TURNS = "array<struct<role:string,content:string>>"

PRICES = [
    # a listed model of each band, and engine sizes at the bands' ends
    ("Please quote the inspection cost of one Suzuki Bolan", "For a Suzuki Bolan (up to 1000cc), a used car inspection costs PKR 4,950"),
    ("What must I pay to have a Honda City inspected", "For a Honda City (1001cc to 2000cc), a used car inspection costs PKR 6,950"),
    ("inspection rate, Haval Jolion", "PKR 9,950"),
    ("Inspect a 1001cc vehicle: cost", "A 1001cc car falls in the 1001cc to 2000cc band"),
    ("Inspect an 1100cc vehicle: cost", "An 1100cc car falls in the 1001cc to 2000cc band"),
    ("Cost to inspect something with a 0.6 litre engine", "A 600cc car falls in the up to 1000cc band"),
    ("How costly is inspection of a 2500cc sedan", "isn't clearly listed"),
    ("Inspection, any 4x4", "PKR 9,950"),
    ("Inspection of an Audi A6: rate", "The Audi A6 is a German car"),
    # the onboarding fee
    ("sifm onboarding for a Suzuki Khyber", "the Sell It For Me onboarding fee is PKR 2,000"),
    ("What does sifm ask for a BMW 5 Series", "The BMW 5 Series is a German car, so its Sell It For Me onboarding fee is PKR 7,000"),
    # commission below, at and above the minimum's end
    ("commission if it is sold at 1.2 lakh", "1.2 lakh is 5 lakh or less, so the minimum commission applies: PKR 5,000"),
    ("commission if it is sold at 5 lakh", "the same amount here"),
    ("commission if it is sold at PKR 22,00,000", "PKR 22,000"),
    ("commission after it sold at 2 crore", "2 crore is more than 5 lakh"),
    # featured ads and bundles
    ("Feature a listing during two weeks: cost", "Featuring one ad for 14 days costs PKR 4,450"),
    ("feature, 3 days", "Single-ad feature options"),
    ("Total of 5 feature credits", "PKR 13,450"),
    ("Total of 8 feature credits", "The listed bundles are"),
    # new cars, and fees that aren't listed
    ("What is charged for pre-delivery checks, inspection included", "PKR 6,900"),
    ("Which fee has an auction sheet", "isn't listed in my information"),
]
VERDICTS = [
    ("sifm in Karachi", "Yes, Sell It For Me is available in Karachi"),
    ("sifm in Gujrat", "No, Sell It For Me isn't offered in Gujrat"),
    ("Ownership transfer, city: isb", "Yes, Carhub offers car registration"),
    ("Ownership transfer, city: Multan", "No, Carhub' registration and transfer"),
    ("inspection at Jhelum", "No, Jhelum isn't"),
    ("inspection at fsd", "Yes, Carhub car inspection is available in Faisalabad"),
    ("sifm with an open transfer letter", "No, open-letter cars"),
    ("sifm, year 1988", "No, Sell It For Me only accepts"),
    ("sifm, Honda City of 2011", "Yes, a 2011 Honda City meets"),
]
NONE = ["What would a 2014 Suzuki Bolan fetch today", "Who sets the price of diesel", "Change the e-mail of an account", "Opening hours of the Karachi branch", "Name a good tea"]


def told(spark, rows):
    df = spark.createDataFrame(rows, f"q string, h {TURNS}")
    found = facts.detect(F.col("q"), F.col("h"), DOMAIN)
    return {r.q: r.t for r in df.select("q", F.array_join(F.transform(found, lambda f: f["text"]), " ").alias("t")).collect()}


def test_prices_verdicts_and_silence(spark):
    got = told(spark, [(q, []) for q in [*(q for q, _ in PRICES + VERDICTS), *NONE]])
    assert not [(q, e, got[q]) for q, e in PRICES if e not in got[q]]
    assert not [(q, e, got[q]) for q, e in VERDICTS if not got[q].startswith(e)]
    assert not [(q, got[q]) for q in NONE if got[q]]


def test_a_short_follow_up_takes_the_service_of_the_last_question(spark):
    ask = lambda q: [("user", q), ("assistant", "...")]
    got = told(spark, [
        ("Then Hyderabad?", ask("Is ownership transfer done in Islamabad")),
        ("The same, Honda City", ask("Quote the inspection of one Suzuki Every")),
        ("Thanks a lot", ask("Quote the inspection of one Suzuki Every")),
    ])
    assert got["Then Hyderabad?"].startswith("No, Carhub' registration")
    assert "PKR 6,950" in got["The same, Honda City"]
    assert got["Thanks a lot"] == ""


def test_commission(spark):
    df = spark.createDataFrame([(2.0,), (5.0,), (7.25,)], "lakh double").select(facts.commission(F.col("lakh")).alias("c"))
    assert [tuple(r.c) for r in df.collect()] == [(200_000, 5_000, 2_000), (500_000, 5_000, 5_000), (725_000, 7_250, 7_250)]


def test_nulls_and_empty_messages_have_no_facts(spark):
    df = spark.createDataFrame([(None, None), ("", [])], f"q string, h {TURNS}")
    got = df.select(F.size(F.coalesce(facts.detect(F.col("q"), F.col("h")), F.array())).alias("n")).collect()
    assert [r.n for r in got] == [0, 0]


@pytest.mark.parametrize("answer, context, message, same", [
    ("The auction sheet is PKR 1,750.", "", "auction sheet, please: its fee", False),
    ("Banks take 18% a year.", "", "what do banks take", False),
    ("You pay PKR 4,450 for it.", "## Prices\nfourteen days: PKR 4,450", "", True),
    ("Ring 021-555-010-020 on one of 5 weekdays.", "", "", True),
    ("Rs.750 will do.", "PKR 750", "", False),
])
def test_guard(spark, answer, context, message, same):
    df = spark.createDataFrame([(answer, context, message)], "a string, c string, m string")
    got = df.select(facts.guard(F.col("a"), F.col("c"), F.col("m"), None, DOMAIN).alias("g")).first().g
    assert (got == answer) is same
    if "auction" in message:
        assert "the Auction Sheet Verification page" in got


def test_guard_keeps_the_verified_answers_own_figures(spark):
    q = "sifm commission on a car sold at 3.5 lakh"
    df = spark.createDataFrame([(q,)], "q string").withColumn("f", facts.detect(F.col("q"), None, DOMAIN))
    df = df.withColumn("c", facts.build_context(F.col("f"), F.lit("KB"))).withColumn("a", F.element_at("f", 1)["text"])
    r = df.select("a", "c", facts.guard(F.col("a"), F.col("c"), F.col("q")).alias("g"), facts.strip_fact_block(F.col("c")).alias("s")).first()
    assert r.g == r.a and r.c.startswith(FACT_HEADER) and r.s == "KB"


def test_patterns_are_tried_only_where_their_literals_occur(spark):
    said = ["my HONDA CITY", "a hondacity", "\u017fuzuki alto", "Su\u017e alto", "B\u004dW, Aud\u0130", "nis\u017fan note", "\u212ahyber", "suzuki \u212ahyber", "", None, "caf\u00e9 wagon r", "wagonr", "x-trail", "XTRAIL"]
    rows = spark.createDataFrame([(x,) for x in said], "t string")
    tried = lambda p: text.let(text.seen(F.col("t")), lambda t: text.says(t, p))
    cols = [F.struct(text.has(F.col("t"), p).alias("a"), tried(p).alias("b")) for p in [p for p, *_ in fixed.CARS] + ["a*", "(?:b|c*)"]]
    for r in rows.select("t", F.array(*cols).alias("c")).collect():
        assert [x.a for x in r.c] == [x.b for x in r.c], r.t
    plan = rows.select(facts.vehicle(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("contains(") >= 80  # before, every pattern was tried on every text


@pytest.mark.parametrize("name", ["slot_fill", "account_tier", "fact_verdict", "carried_services", "verified_rows", "detect_facts"])
def test_long_work_on_a_small_file_is_dealt_over_cores(spark, testdata, name):
    assert catalog.QUERIES[name](spark, testdata).rdd.getNumPartitions() >= 4  # before, one task a file
