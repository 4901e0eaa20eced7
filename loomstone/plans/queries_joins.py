"""Queries of rule tables, bands, and gated joins, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.functions import fixed
from loomstone.functions.text import question_key
from loomstone.operators import bands, gates, patterns, splits
from loomstone.plans.queries import PAIRS, query, questions, read
from loomstone.sources.shared import store

# --- Many patterns ---------------------------------------------------------------------------------

N_RULES = 5000
NAMES = tuple(dict.fromkeys(name for _, name, _ in fixed.CARS))
#: A third of the texts name a car; car rules come among the first half of the others.
CAR_STEP = N_RULES // (2 * len(fixed.CARS))
NAMED_SQL = f"regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g') || CASE WHEN doc_id % 3 = 0 THEN ' ' || [{', '.join(f"'{n}'" for n in NAMES)}][doc_id % {len(NAMES)} + 1] ELSE '' END"


@query(f"""
    WITH d AS MATERIALIZED (SELECT doc_id, {NAMED_SQL} AS text FROM documents),
    words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM d),
    rules AS (SELECT word, row_number() OVER (ORDER BY md5(word), word) AS priority FROM (SELECT DISTINCT word FROM words WHERE length(word) >= 6) QUALIFY priority <= {N_RULES}),
    met AS (
        SELECT doc_id, word AS value, priority * 1.0 AS priority FROM words JOIN rules USING (word)
        {" ".join(f"UNION ALL SELECT doc_id, '{name}', {n * CAR_STEP + 0.5} FROM d WHERE regexp_matches(text, '(?i){p}')" for n, (p, name, _) in enumerate(fixed.CARS))}
    )
    SELECT doc_id, min_by(value, priority) AS value FROM d LEFT JOIN met USING (doc_id) GROUP BY doc_id
""")
def first_of_many(spark, sf_dir):
    """The first of 5,086 rules that matches: 5,000 words of the texts themselves, and the car patterns among them.

    Characters beyond ASCII become spaces: word boundaries of the SQL know no others.
    """
    named = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), F.element_at(F.array(*map(F.lit, NAMES)), (F.col("doc_id") % len(NAMES) + 1).cast("int")))).otherwise(F.lit(""))
    docs = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.regexp_replace("text", r"[^\x00-\x7F]", " "), named).alias("text"))
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).where("length(word) >= 6").distinct()
    drawn = words.orderBy(F.md5("word"), "word").limit(N_RULES)
    # The numbers of 5,000 drawn words, which are the table's feature.
    numbered = drawn.selectExpr("word", "row_number() over (order by md5(word), word) * 1.0D as priority")
    listed = numbered.select(F.concat(F.lit("(?<![a-z])"), "word", F.lit("(?![a-z])")).alias("pattern"), F.col("word").alias("value"), "priority")
    cars = spark.createDataFrame([(p, name, n * CAR_STEP + 0.5) for n, (p, name, _) in enumerate(fixed.CARS)], "pattern string, value string, priority double")
    return patterns.first_match(docs, listed.unionByName(cars), "text").select("doc_id", "value")


# --- Bands ----------------------------------------------------------------------------------------


@query("""
    SELECT o_orderkey, p_partkey FROM orders JOIN (SELECT p_partkey, p_partkey * 200.0 AS low, p_partkey * 200.0 + p_size * p_size AS high FROM part) ON low <= o_totalprice AND o_totalprice < high
""")
def band_pairs(spark, sf_dir):
    """Orders in the price bands of all parts, which overlap and differ in width by a thousand times."""
    low = F.col("p_partkey") * 200.0
    offered = read(spark, sf_dir, "part").select("p_partkey", low.alias("low"), (low + F.col("p_size") * F.col("p_size")).alias("high"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return bands.band_join(orders, offered, "o_totalprice").select("o_orderkey", "p_partkey")


# --- Held-out keys behind a filter --------------------------------------------------------------------

PAIRS_SQL = """
    w AS (SELECT regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents WHERE text IS NOT NULL),
    pairs AS (SELECT DISTINCT w[i] || ' ' || w[i + 1] AS key FROM (SELECT w, unnest(range(1, len(w))) AS i FROM w))"""


@query(f"""
    WITH {PAIRS}, {PAIRS_SQL},
    hold AS (SELECT key FROM pairs UNION SELECT key FROM q WHERE substr(md5(key), 1, 1) IN ('0', '1', '2', '3', '4'))
    SELECT conv_id, turn, CASE WHEN key IN (SELECT key FROM hold) THEN 'test' ELSE 'train' END AS side FROM q
    WHERE key IN (SELECT key FROM hold) OR told IS NULL OR told NOT IN (SELECT key FROM hold)
""")
def gated_split(spark, sf_dir):
    """Conversations without leaks of very many held-out keys: all pairs of words of the documents, and a third of the questions."""
    rows = questions(spark, sf_dir)
    words = read(spark, sf_dir, "documents").where("text is not null").select(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("w"))
    pairs = words.select(F.explode(F.transform(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), F.get("w", i + 1)))).alias("key"))
    own = rows.select(question_key(F.col("instruction")).alias("key")).where(F.substring(F.md5("key"), 1, 1).isin("0", "1", "2", "3", "4"))
    # A pair that no question is holds none out: a filter of the questions' keys leaves these before anything is grouped.
    told = F.transform("history", lambda m: question_key(m["content"]))
    asked = rows.select(F.explode(F.concat(F.array(question_key(F.col("instruction"))), told)).alias("key")).distinct()
    met, _ = gates.Gate(store(asked, "asked")).parted(pairs, F.array("key"))
    held = store(met.unionByName(own).distinct(), "held")
    train, test = splits.hold_out(rows, held)
    side = lambda rows, name: rows.select("conv_id", "turn", F.lit(name).alias("side"))
    return side(train, "train").unionByName(side(test, "test"))
