"""Small tables to try the plans with: sections, intents, gaps, protected questions, evaluation cases and probes.

All of it is made up; a business brings its own tables of the same shape.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomstone.plans.build import INTENT
from loomstone.plans.generators import TITLES

#: Section titles and texts: those that the generators point to, and some of general help.
SECTIONS = {t: f"## {t}\nAll about {t[0].lower()}{t[1:]}." for t in TITLES.values()} | {
    "Opening an account": "## Opening an account\nSign up with a phone number and confirm the code.",
    "Posting an ad": "## Posting an ad\nAdd photos, a price and the city, then post.",
    "Reporting an ad": "## Reporting an ad\nUse the flag beside an ad; a moderator looks at it.",
    "Parcel delivery": "## Parcel delivery\nParcels take three to five working days.",
}
ALIKE = {
    TITLES["inspection"]: [TITLES["sifm"], TITLES["inspection_city"]],
    TITLES["sifm"]: [TITLES["inspection"], TITLES["sale_city"]],
    TITLES["returns"]: ["Parcel delivery"],
    "Posting an ad": ["Reporting an ad", TITLES["featured"]],
    "Parcel delivery": [TITLES["returns"]],
}
#: intent, category, questions, responses, kb, near, context_responses, ground_all, hard_distractor
INTENTS = [
    ("open_account", "ACCOUNT", ["where do I sign up?", "sign me up", "I need a login", "new user here, what now?", "account banana hai"], ["Sign up with your phone number.", "A phone number is all you need."], ["Opening an account"], None, None, None, None),
    ("post_ad", "SELLING", ["put my car online", "where do I add photos?", "ad lagana hai", "list my bike", "my first ad, any steps?", "start an ad"], ["Add photos and a price, then post."], ["Posting an ad"], None, None, None, "Reporting an ad"),
    ("report_ad", "SAFETY", ["this seller lies", "flag a fake ad", "an ad copies mine"], ["Use the flag beside the ad."], ["Reporting an ad"], None, None, True, None),
    ("parcel_time", "SHOP", ["when does my parcel come?", "parcel kab aayega?", "is my box on its way?", "delivery takes how long?"], ["Parcels are on their way soon."], ["Parcel delivery"], None, ["Parcels take three to five working days."], None, TITLES["returns"]),
    ("feature_cost", "SELLING", ["what is a top spot?", "top spot rates?", "top spot for my ad"], ["The page on featured ads has the rates."], [TITLES["featured"]], None, ["It depends on the number of days."], None, None),
    ("greeting", "GENERAL", ["good day", "salam ji", "hi there", "anyone home?", "hey"], ["Hello! How can I help?", "Good day! What can I do?"], None, None, None, None, None),
    ("thanks", "GENERAL", ["that was quick", "shukriya", "cheers, mate", "great, thanks"], ["You're welcome."], None, ["Posting an ad"], None, True, None),
    ("weather", "OFF_TOPIC", ["will it rain?", "cricket score?", "sing me a song", "who won?", "a joke please", "rate my poem"], ["I can only help with cars and our services."], None, None, None, None, None),
    ("human", "SUPPORT", ["let me talk to a person", "agent please", "is this a bot?"], ["Please call the helpline."], None, None, None, None, None),
    ("password", "ACCOUNT", ["locked out", "no code arrives", "code nahi aata", "reset my login", "login broken"], ["Ask for a new code."], ["Opening an account"], None, None, None, None),
]
GAPS = [
    ("do parcels come on Sundays?", "Parcel delivery", "I don't have that detail; please ask the helpline.", "SHOP", "parcel_gap"),
    ("how many photos may an ad have?", "Posting an ad", "I don't have that detail; please ask the helpline.", "SELLING", "ad_gap"),
]
#: Evaluation cases, which no training row may ask: id, topic, question, must, must_not.
CASES = [
    ("c1", "price", "What will you charge to look over a 1000cc hatchback?", [["4,950"]], ["6,950"]),
    ("c2", "price", "Do a 1300cc and a 1500cc car cost the same to inspect?", [["6,950"]], ["4,950"]),
    ("c3", "city", "I live in Skardu, will you inspect there?", [["^no", "isn't"]], ["^yes"]),
    ("c4", "account", "What do I need before I can sign up?", [["phone"]], []),
    ("c5", "off_topic", "Which phone should I buy?", [["only help", "can't help"]], [r"PKR \d"]),
]
#: Questions with the section that answers them, and questions that none does: id, question, title.
PROBES = [
    (1, "parcel delivery days", "Parcel delivery"), (2, "posting an ad with photos", "Posting an ad"), (3, "reporting an ad with a flag", "Reporting an ad"),
    (4, "opening an account by phone", "Opening an account"), (5, "boil an egg", None), (6, "capital of Peru", None),
]


def tables(spark: SparkSession) -> dict[str, DataFrame]:
    """intents, gaps, cases, probes and protected questions as tables."""
    cases = spark.createDataFrame(CASES, "id string, topic string, q string, must array<array<string>>, must_not array<string>")
    return {
        "intents": spark.createDataFrame(INTENTS, INTENT),
        "gaps": spark.createDataFrame(GAPS, "instruction string, title string, response string, category string, intent string"),
        "cases": cases,
        "probes": spark.createDataFrame(PROBES, "id long, question string, title string"),
        "protected": cases.select("q"),
    }

#: Judged questions: question, true answer, the section that holds it.
GOLDEN = [
    ("What do I need for an account?", "Sign up with a phone number and confirm the code.", "Opening an account"),
    ("What goes into an ad?", "Add photos, a price and the city.", "Posting an ad"),
    ("How is an ad reported?", "Use the flag beside an ad.", "Reporting an ad"),
    ("Who looks at a reported ad?", "A moderator looks at it.", "Reporting an ad"),
    ("How long is a parcel on its way?", "Parcels take three to five working days.", "Parcel delivery"),
]
