"""Queries over the driver's tables, one for each operator, with the same query in SQL.

Floats that SQL and Spark may add up in different order are rounded to six
places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.functions import facts, fixed, text
from loomstone.operators import draws, evaluate, history, retrieval, rules, splits
from loomstone.plans import build
from loomstone.sources import readers, sinks
from loomstone.streaming import latch as latches

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: str) -> F.Column:
    return F.round(c, 6).alias(c)


# --- Retrieval: every vector whose id is divisible by 20 asks, all vectors answer --------------

VECTORS = """
    v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, label FROM embeddings),
    sims AS (
        SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, list_cosine_similarity(q.e, c.e) AS similarity, q.label AS ql, c.label AS cl
        FROM v q JOIN v c ON q.vec_id % 20 = 0
    )"""


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return rows.where("id % 20 = 0"), rows


def chunk_texts(rows: DataFrame) -> DataFrame:
    return rows.withColumn("text", F.concat(F.lit("chunk "), F.col("id").cast("string"), F.lit(" of "), F.col("label").cast("string")))


@query(f"""
    WITH {VECTORS}
    SELECT query_id, chunk_id, round(similarity, 6) AS similarity, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM sims
    ) WHERE rank <= 5
""")
def cosine_topk(spark, sf_dir):
    asked, stored = vectors(spark, sf_dir)
    return retrieval.top_k(asked, stored, 5).select("query_id", "chunk_id", r6("similarity"), F.col("rank").cast("long"))


@query(f"""
    WITH {VECTORS},
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM sims WHERE query_id <> chunk_id)
    SELECT query_id, string_agg('chunk ' || chunk_id || ' of ' || cl, chr(10) || '---' || chr(10) ORDER BY rank) AS context FROM r WHERE rank <= 3 GROUP BY query_id
""")
def context_assembly(spark, sf_dir):
    asked, stored = vectors(spark, sf_dir)
    return retrieval.assemble(retrieval.top_k(asked, stored, 3, same=False), chunk_texts(stored))


@query(f"""
    WITH {VECTORS},
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM sims),
    c AS (SELECT query_id, string_agg('chunk ' || chunk_id || ' of ' || cl, chr(10) || '---' || chr(10) ORDER BY rank) AS context FROM r WHERE rank <= 2 AND similarity >= 0.36 GROUP BY query_id)
    SELECT vec_id AS query_id, coalesce(context, '') AS context FROM embeddings LEFT JOIN c ON vec_id = query_id WHERE vec_id % 20 = 0
""")
def retrieve_context(spark, sf_dir):
    asked, stored = vectors(spark, sf_dir)
    return retrieval.retrieve(asked, chunk_texts(stored), 2, 0.36)


@query(f"""
    WITH {VECTORS}
    SELECT round(low_in, 6) AS low_in, round(high_off, 6) AS high_off, low_in > high_off AS separable,
        CASE WHEN low_in > high_off THEN round((low_in + high_off) / 2, 6) END AS suggested
    FROM (SELECT min(similarity) FILTER (query_id = chunk_id) AS low_in, max(similarity) FILTER (query_id <> chunk_id) AS high_off FROM sims)
""")
def threshold_calibration(spark, sf_dir):
    asked, stored = vectors(spark, sf_dir)
    own = retrieval.top_k(asked, stored, 1).select(F.lit(True).alias("in_scope"), "similarity")
    other = retrieval.top_k(asked, stored, 1, same=False).select(F.lit(False).alias("in_scope"), "similarity")
    return retrieval.calibrate(own.unionByName(other)).select(r6("low_in"), r6("high_off"), "separable", r6("suggested"))


# --- Histories ----------------------------------------------------------------------------------

NORMAL = "n AS (SELECT * FROM conversations WHERE role IN ('user', 'assistant') AND text IS NOT NULL)"
WORDS = "len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda x: x <> ''))"


@query(f"WITH {NORMAL} SELECT conv_id, turn, role, text FROM n")
def history_normalize(spark, sf_dir):
    return history.normalize_long(read(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "text")


@query(f"""
    WITH {NORMAL},
    w AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS c, least(2, sum((role = 'user')::INT) OVER (PARTITION BY conv_id)) AS k FROM n)
    SELECT conv_id, turn, role, text FROM w WHERE c < k OR (c = k AND role = 'user')
""")
def recent_history(spark, sf_dir):
    return history.recent_long(read(spark, sf_dir, "conversations"), 2).select("conv_id", "turn", "role", "text")


PREFIXES = "the|of|to|for|is|and|in"


@query(f"""
    WITH {NORMAL}, p AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM n WHERE role = 'user')
    SELECT conv_id, turn, CASE WHEN previous IS NOT NULL AND regexp_matches(text, '(?i)^\\s*(?:{PREFIXES})(?:\\s|$)') THEN previous || ' ' || text ELSE text END AS query FROM p
""")
def retrieval_query(spark, sf_dir):
    rows = history.with_previous_question(read(spark, sf_dir, "conversations"))
    again = text.follow_up(F.col("text"), rf"^\s*(?:{PREFIXES})(?:\s|$)") & F.col("previous").isNotNull()
    return rows.select("conv_id", "turn", F.when(again, F.concat_ws(" ", "previous", "text")).otherwise(F.col("text")).alias("query"))


@query(f"""
    WITH {NORMAL} SELECT conv_id, turn, regexp_matches(text, '(?i)^\\s*(?:{PREFIXES})(?:\\s|$)') AS follow_up FROM n WHERE role = 'user'
""")
def follow_up_flag(spark, sf_dir):
    rows = history.normalize_long(read(spark, sf_dir, "conversations")).where("role = 'user'")
    return rows.select("conv_id", "turn", text.follow_up(F.col("text"), rf"^\s*(?:{PREFIXES})(?:\s|$)").alias("follow_up"))


TOPICS = (("the", "(?i)(?:^|[^a-z])the(?:[^a-z]|$)"), ("die", "(?i)(?:^|[^a-z])die(?:[^a-z]|$)"), ("que", "(?i)(?:^|[^a-z])que(?:[^a-z]|$)"))
TOPIC_SQL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in TOPICS) + "], lambda x: x IS NOT NULL)"


@query(f"""
    WITH {NORMAL}, t AS (SELECT conv_id, turn, {TOPIC_SQL} AS topics FROM n WHERE role = 'user'),
    l AS (SELECT *, last_value(CASE WHEN len(topics) > 0 THEN topics END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM t)
    SELECT conv_id, turn, array_to_string(topics, ',') AS topics, array_to_string(held, ',') AS held FROM l
""")
def carry_forward(spark, sf_dir):
    topics = F.array_compact(F.array(*(F.when(F.col("text").rlike(p), F.lit(n)) for n, p in TOPICS)))
    rows = history.carry_forward(read(spark, sf_dir, "conversations"), topics, "held")
    return rows.select("conv_id", "turn", F.array_join(topics, ",").alias("topics"), F.array_join("held", ",").alias("held"))


@query(f"""
    WITH {NORMAL},
    s AS (SELECT *, sum({WORDS.format("text")}) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS tokens FROM n),
    f AS (SELECT *, min(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS start FROM s WHERE tokens <= 300)
    SELECT conv_id, turn, role, text FROM f WHERE turn >= start
""")
def budget_trim(spark, sf_dir):
    return history.trim_long(read(spark, sf_dir, "conversations"), 300).select("conv_id", "turn", "role", "text")


@query(f"""
    WITH {NORMAL}
    SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY turn, role, text) || '<|endoftext|>' AS prompt FROM n GROUP BY conv_id
""")
def chat_render(spark, sf_dir):
    rows = history.nest(read(spark, sf_dir, "conversations"))
    return rows.select("conv_id", F.concat(history.render(F.col("history")), F.lit("<|endoftext|>")).alias("prompt"))


# --- Text ------------------------------------------------------------------------------------------


@query(r"""
    WITH s AS (SELECT doc_id, regexp_split_to_array(replace(chr(10) || text, '. ', '.' || chr(10) || '## '), '\n## ')[2:] AS blocks FROM documents),
    b AS (SELECT doc_id, generate_subscripts(blocks, 1) - 1 AS no, unnest(blocks) AS block FROM s),
    t AS (SELECT doc_id, no, regexp_replace(string_split(block, chr(10))[1], '^\s+|\s+$', '', 'g') AS title, substr(block, length(string_split(block, chr(10))[1]) + 2) AS body FROM b)
    SELECT doc_id, no, title, '## ' || title || chr(10) || regexp_replace(body, '^\s+|\s+$', '', 'g') AS content FROM t
""")
def section_split(spark, sf_dir):
    """Sentences stand for sections: the documents have no Markdown headings of their own."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.replace(F.col("text"), F.lit(". "), F.lit(".\n## ")).alias("md"))
    return readers.sections(docs, "md", ("doc_id",)).select("doc_id", F.col("no").cast("long").alias("no"), "title", "content")


@query("""
    SELECT doc_id, (i / 800)::BIGINT AS chunk_no, substr(text, i + 1, 1000) AS chunk
    FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 1, 0) + 1, 800)) AS i FROM documents)
""")
def chunk_fixed(spark, sf_dir):
    return retrieval.fixed_chunks(read(spark, sf_dir, "documents")).withColumn("chunk_no", F.col("chunk_no").cast("long"))


NUMBER = r"[0-9][0-9,.]*"


@query(rf"""
    SELECT doc_id, array_to_string(regexp_extract_all(text, '(?i)(?:PKR|Rs\.?)\s?\d[\d,]*(?:\.\d+)?|\b\d{{1,3}}(?:,\d{{3}})+\b|\b\d+(?:\.\d+)?\s?%', 0), '|') AS figures,
        array_to_string(regexp_extract_all(text, '{NUMBER}', 0), '|') AS numbers FROM documents
""")
def figure_extract(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.array_join(text.figures(F.col("text")), "|").alias("figures"), F.array_join(text.figures(F.col("text"), NUMBER), "|").alias("numbers"))


WORD_MAP = {"the": "le", "of": "de", "to": "a", "and": "et", "in": "dans"}
DROPPED = ("is", "it", "be")
_MAP_SQL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in WORD_MAP.items()) + "}"
_DROPPED_SQL = ", ".join(f"'{w}'" for w in DROPPED)


@query(rf"""
    WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(text, '[A-Za-z'']+|[^A-Za-z'']+', 0), lambda x: lower(x) NOT IN ({_DROPPED_SQL})) AS runs FROM documents),
    j AS (SELECT doc_id, regexp_replace(array_to_string(list_transform(runs, lambda x: coalesce({_MAP_SQL}[lower(x)], x)), ''), '\s+', ' ', 'g') AS s FROM t)
    SELECT doc_id, regexp_replace(regexp_replace(s, '\s+([,.?!])', '\1', 'g'), '^\s+|\s+$', '', 'g') AS query FROM j
""")
def dict_translate(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.translate_words(F.col("text"), WORD_MAP, DROPPED).alias("query"))


@query("""
    SELECT c_custkey, 'Order ORD-' || c_custkey || ' of Forgot Password for Live Chat' AS instruction,
        'Dear customer, the order number goes to your city; Forgot Password or Live Chat at our website.' AS response
    FROM customer
""")
def placeholder_clean(spark, sf_dir):
    """Templates around each customer's key: unknown and generic slots, and slots the instruction doesn't name."""
    key = F.col("c_custkey").cast("string")
    asked = F.concat(F.lit("Order ORD-"), key, F.lit(" of {{Forgot Password}} for {{ live chat support }}"))
    given = F.lit("Dear customer, the {{Order Number}} goes to {{Delivery City}}; {{Forgot Password}} or {{Live Chat Support}} at our {{Website URL}}.")
    a, b = text.clean_pair(asked, given, F.col("c_custkey"))
    customers = text.spread(read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    return customers.select("c_custkey", a.alias("instruction"), b.alias("response"))


@query(r"""
    WITH w AS (SELECT doc_id, unnest(string_split_regex(text, '\s+')) AS word, generate_subscripts(string_split_regex(text, '\s+'), 1) AS i FROM documents),
    k AS (SELECT doc_id, word, i, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM w WHERE word <> '')
    SELECT doc_id, count(*) AS n_words, count_if(regexp_full_match(word, '[A-Za-z]+') AND regexp_full_match(coalesce(before, ''), '[A-Za-z]+') AND lower(word) = lower(before))::BIGINT AS n_doubled FROM k GROUP BY doc_id
""")
def doubled_words(spark, sf_dir):
    """Words, and those of ASCII letters that repeat the one before."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    plain = "^[A-Za-z]+$"
    again = lambda w, i: w.rlike(plain) & F.coalesce(F.lower(w) == F.lower(F.get("words", i - 1)), F.lit(False))
    rows = read(spark, sf_dir, "documents").withColumn("words", words).where(F.size("words") > 0)
    return rows.select("doc_id", F.size("words").cast("long").alias("n_words"), F.size(F.filter("words", again)).cast("long").alias("n_doubled"))


@query(r"""
    WITH t AS (SELECT p_partkey, string_split(p_name, ' ') AS ws FROM part)
    SELECT p_partkey, array_to_string(ws, ' ') || ', the ' || ws[1] AS text FROM t
""")
def dedup_words(spark, sf_dir):
    """Each word of a name said one to three times in a row, in changing case."""
    said = F.transform(F.split("p_name", " "), lambda w, i: F.array_join(F.slice(F.array(w, F.upper(w), w), F.lit(1), (i + F.col("p_partkey")).cast("int") % 3 + 1), " "))
    rows = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.array_join(said, " "), F.lit(", the the "), F.get(F.split("p_name", " "), 0)).alias("text"))
    return rows.select("p_partkey", text.dedup_words(F.col("text")).alias("text"))


# --- Lookups -----------------------------------------------------------------------------------------


@query("SELECT p_partkey, CASE WHEN p_size * 50 <= 1000 THEN 'small' WHEN p_size * 50 <= 2000 THEN 'mid' ELSE 'large' END AS band FROM part")
def band_range_join(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", facts.band_of(F.col("p_size") * 50).alias("band"))


@query("""
    SELECT p_partkey, label, price FROM part JOIN (VALUES ('small', 'up to 1000cc', '4,950'), ('mid', '1001cc to 2000cc', '6,950')) AS d(band, label, price)
    ON band = CASE WHEN p_size * 50 <= 1000 THEN 'small' WHEN p_size * 50 <= 2000 THEN 'mid' ELSE 'large' END
""")
def band_price_lookup(spark, sf_dir):
    """The dimension has one row a band, so its literal rows go to every task."""
    bands = spark.createDataFrame([(b, fixed.BAND_LABEL[b], p) for b, p in fixed.INSPECTION_PRICE.items()], "band string, label string, price string")
    rows = read(spark, sf_dir, "part").withColumn("band", facts.band_of(F.col("p_size") * 50))
    return rows.join(F.broadcast(bands), "band").select("p_partkey", "label", "price")


PART_RULES = (("blue bolt", "blue bolt"), ("blue", "blue thing"), ("(?:ring|gear)$", "round thing"), ("hot", "hot thing"))


@query(f"""
    SELECT p_partkey, CASE {" ".join(f"WHEN regexp_matches(p_name, '(?i){p}') THEN '{v}'" for p, v in PART_RULES)} END AS value FROM part
""")
def first_match_rule(spark, sf_dir):
    rows = read(spark, sf_dir, "part")
    return rows.select("p_partkey", facts.first_match(F.col("p_name"), [(p, F.lit(v)) for p, v in PART_RULES]).alias("value"))


@query(f"""
    WITH rules(pattern, value, priority) AS (VALUES {", ".join(f"('{p}', '{v}', {i})" for i, (p, v) in enumerate(PART_RULES))}),
    best AS (SELECT p_partkey, min_by(value, priority) AS value FROM part JOIN rules ON regexp_matches(p_name, '(?i)' || pattern) GROUP BY p_partkey)
    SELECT p_partkey, value FROM part LEFT JOIN best USING (p_partkey)
""")
def first_match_join(spark, sf_dir):
    table = spark.createDataFrame([(p, v, i) for i, (p, v) in enumerate(PART_RULES)], "pattern string, value string, priority int")
    return rules.first_match_join(read(spark, sf_dir, "part").select("p_partkey", "p_name"), table, "p_name", "p_partkey").select("p_partkey", "value")


@query("""
    WITH p AS (SELECT o_orderkey, round_even(o_totalprice / 10000 * 100000, 0)::BIGINT AS price, o_totalprice / 10000 AS lakh FROM orders)
    SELECT o_orderkey, price, price // 100 AS one_percent, CASE WHEN lakh <= 5 THEN greatest(price // 100, 5000) ELSE price // 100 END AS commission FROM p
""")
def commission_floor(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").withColumn("c", facts.commission(F.col("o_totalprice") / 10000))
    return rows.select("o_orderkey", "c.price", "c.one_percent", "c.commission")


SERVED = ("NATION_1", "NATION_4", "NATION_9", "NATION_16")


@query(f"""
    SELECT s_suppkey, r_name, CASE WHEN n_name IN {SERVED} THEN 'Yes, available in ' || n_name || '.'
        ELSE 'No, ' || n_name || ' isn''t served. Available in {", ".join(SERVED[:-1])} and {SERVED[-1]}.' END AS verdict
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")
def membership_verdict(spark, sf_dir):
    joined = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    joined = joined.join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    yes = text.fill("Yes, available in {n}.", n=F.col("n_name"))
    no = text.fill("No, {n} isn't served. Available in {all}.", n=F.col("n_name"), all=facts.name_list(SERVED))
    return joined.select("s_suppkey", "r_name", F.when(F.col("n_name").isin(*SERVED), yes).otherwise(no).alias("verdict"))


@query(f"SELECT doc_id, array_to_string({TOPIC_SQL}, ',') AS labels FROM documents")
def multi_label_rules(spark, sf_dir):
    found = F.array_compact(F.array(*(F.when(F.col("text").rlike(p), F.lit(n)) for n, p in TOPICS)))
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(found, ",").alias("labels"))


@query()
def detect_facts(spark, sf_dir):
    """Facts of a question made of every part's size and name; too long for SQL, tested by goldens."""
    asked = text.fill("Inspection and Sell It For Me fee for my {cc}cc {name} in Lahore or Quetta?", cc=(F.col("p_size") * 50).cast("string"), name=F.col("p_name"))
    found = F.transform(facts.detect(asked), lambda f: F.concat_ws(": ", f["service"], f["text"]))
    parts = text.spread(read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name"), "p_partkey")
    return parts.select("p_partkey", F.array_join(found, "\n").alias("facts"))


# --- Guard: an order's amount is the answer, the customer's earlier orders are the sources ---------------

GUARD = """
    k AS (SELECT o_orderkey, o_custkey, 'It costs PKR ' || format('{:,}', round_even(o_totalprice, 0)::BIGINT) || '.' AS answer, format('{:,}', round_even(o_totalprice, 0)::BIGINT) AS amount FROM orders),
    s AS (SELECT *, lag(amount) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM k),
    g AS (SELECT *, CASE WHEN n % 2 = 0 THEN 'PKR ' || amount ELSE 'PKR ' || coalesce(before, '0') END AS sources FROM s)"""


# Facts read from questions made of the tables' numbers; the SQL has the sentences and works out which one applies.


def told(spark: SparkSession, rows: DataFrame, key: str) -> DataFrame:
    """(key, answer): the sentences of the facts found in ``question``."""
    found = facts.detect(F.col("question"), None, FACT_DOMAIN)
    return text.spread(rows, key).select(key, F.array_join(F.transform(found, lambda f: f["text"]), " ").alias("answer"))


FACT_DOMAIN = fixed.Domain(brand="Carhub", site="carhub.example", helpline="111")


def said(sentence: str, **parts: str) -> str:
    """A fixed sentence as SQL text, its places filled with SQL expressions."""
    out = "'" + fixed.SENTENCES[sentence].replace("{brand}", FACT_DOMAIN.brand).replace("'", "''") + "'"
    for name, value in parts.items():
        out = out.replace("{" + name + "}", f"' || {value} || '")
    return f"({out})"


def case_of(key: str, values: dict) -> str:
    return f"(CASE {key} {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}' for k, v in values.items())} END)"


def _price_sql(service: str, table: dict[str, str]) -> str:
    lead = said("cc", article="CASE WHEN regexp_matches(cc::VARCHAR, '^(8|11|18)') THEN 'An' ELSE 'A' END", cc="cc::VARCHAR", label=case_of("band", fixed.BAND_LABEL))
    verb = f"'{fixed.SENTENCES[service + '_verb']}'"
    return f"""
        WITH p AS (SELECT p_partkey, p_size * 50 AS cc, CASE WHEN p_size * 50 <= 1000 THEN 'small' WHEN p_size * 50 <= 2000 THEN 'mid' ELSE 'large' END AS band FROM part)
        SELECT p_partkey, CASE WHEN cc < 100 THEN '' WHEN band = 'large' THEN {said("large_" + service)} ELSE {said(service, lead=lead, verb=verb, price=case_of("band", table))} END AS answer FROM p
    """


def sized(spark: SparkSession, sf_dir: str, question: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(question), (F.col("p_size") * 50).cast("string"), F.lit("cc car")).alias("question"))


@query(_price_sql("inspection", fixed.INSPECTION_PRICE))
def fact_price(spark, sf_dir):
    return told(spark, sized(spark, sf_dir, "Cost of inspection, "), "p_partkey")


@query(_price_sql("sifm", fixed.SALE_FEE))
def fact_sale_fee(spark, sf_dir):
    return told(spark, sized(spark, sf_dir, "Sell it for me, "), "p_partkey")


#: Places as questions write them, and their usual names.
PLACES = {"Lahore": "Lahore", "khi": "Karachi", "Multan": "Multan", "di khan": "Dera Ismail Khan", "PINDI": "Rawalpindi", "Sialkot": "Sialkot", "isb": "Islamabad"}
ASKS = {"inspection": "inspection in ", "sifm": "sifm in ", "transfer": "car transfer in "}


def _verdict_sql() -> str:
    where = f"CASE WHEN city = 'Lahore' THEN {said('where_home')} ELSE {said('where_other')} END"
    held = lambda names: "city IN (" + ", ".join(f"'{n}'" for n in names) + ")"
    listed = lambda names: f"'{facts.name_list(names)}'"
    inspected, sold, moved = held(fixed.INSPECTION_CITIES), held(fixed.SALE_CITIES), held(fixed.TRANSFER_CITIES)
    extra = f"CASE WHEN {inspected} THEN {said('sifm_no_extra', city='city')} ELSE '' END"
    return f"""
        WITH places(i, city) AS (VALUES {", ".join(f"({i}, '{c}')" for i, c in enumerate(PLACES.values()))}),
        asks(j, service) AS (VALUES {", ".join(f"({j}, '{a}')" for j, a in enumerate(ASKS))})
        SELECT c_custkey, CASE service
            WHEN 'inspection' THEN CASE WHEN {inspected} THEN {said("inspection_yes", city="city", where=f"({where})")} ELSE {said("inspection_no", city="city", cities=listed(fixed.INSPECTION_CITIES))} END
            WHEN 'sifm' THEN CASE WHEN {sold} THEN {said("sifm_yes", city="city")} ELSE {said("sifm_no", city="city", cities=listed(fixed.SALE_CITIES), extra=f"({extra})")} END
            ELSE CASE WHEN {moved} THEN {said("transfer_yes", city="city")} ELSE {said("transfer_no", city="city", cities=listed(fixed.TRANSFER_CITIES))} END
        END AS answer
        FROM customer JOIN places ON i = c_custkey % {len(PLACES)} JOIN asks ON j = c_nationkey % {len(ASKS)}
    """


def pick(options: list[str], at: F.Column) -> F.Column:
    return F.element_at(F.array(*map(F.lit, options)), (at % len(options) + 1).cast("int"))


VERDICT_SQL = _verdict_sql()


@query(VERDICT_SQL)
def fact_verdict(spark, sf_dir):
    rows = read(spark, sf_dir, "customer")
    return told(spark, rows.select("c_custkey", F.concat(pick(list(ASKS.values()), F.col("c_nationkey")), pick(list(PLACES), F.col("c_custkey"))).alias("question")), "c_custkey")


@query(f"""
    WITH y AS (SELECT o_orderkey, 1960 + o_orderkey % 70 AS year, o_orderkey % 2 = 0 AS named FROM orders),
    s AS (SELECT *, CASE WHEN named THEN year || ' Honda City' ELSE year || ' model car' END AS subject FROM y)
    SELECT o_orderkey, CASE WHEN year < 2000 THEN {said("year_no", subject="subject")} ELSE {said("year_yes", subject="subject", cities=f"'{facts.name_list(fixed.SALE_CITIES)}'")} END AS answer FROM s
""")
def fact_model_year(spark, sf_dir):
    year = (F.col("o_orderkey") % 70 + 1960).cast("string")
    named = F.when(F.col("o_orderkey") % 2 == 0, F.lit("Honda City, ")).otherwise(F.lit(""))
    return told(spark, read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("sifm, "), named, F.lit("year "), year).alias("question")), "o_orderkey")


SPANS = {"7 days": "7 days", "one week": "7 days", "two weeks": "14 days", "14 din": "14 days", "a month": "28 days", "28 days": "28 days", "3 days": None}


@query(f"""
    WITH spans(i, days) AS (VALUES {", ".join(f"({i}, " + (f"'{d}'" if d else "NULL") + ")" for i, d in enumerate(SPANS.values()))})
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CASE o_orderkey % 12 {" ".join(f"WHEN {n} THEN {said('bundle', n=f"'{n}'", price=f"'{p}'")}" for n, p in fixed.BUNDLE_PRICE.items())} ELSE {said("bundles")} END
        WHEN days IS NULL THEN {said("featured_options")}
        ELSE {said("featured", days="days", price=case_of("days", fixed.FEATURED_PRICE))} || {said("featured_tail")} END AS answer
    FROM orders JOIN spans ON i = o_orderkey % {len(SPANS)}
""")
def fact_featured(spark, sf_dir):
    """Bundles of feature credits, else one ad for a number of days."""
    credits = F.concat((F.col("o_orderkey") % 12).cast("string"), F.lit(" feature credits"))
    days = F.concat(F.lit("feature an ad, "), pick(list(SPANS), F.col("o_orderkey")))
    return told(spark, read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, credits).otherwise(days).alias("question")), "o_orderkey")


@query("""
    WITH n AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS v FROM orders)
    SELECT o_orderkey, round(CASE o_orderkey % 4 WHEN 0 THEN (v % 900 + 100) / 10 WHEN 1 THEN (v % 90 + 10) / 10 * 100 WHEN 2 THEN CASE WHEN v >= 100000 THEN v / 100000 END END, 6) AS lakh FROM n
""")
def fact_amount(spark, sf_dir):
    """Sale prices written in lakh, crore and rupees, and none; a tenth at most after the point."""
    v = F.floor("o_totalprice").cast("long")
    words = (
        F.when(F.col("o_orderkey") % 4 == 0, F.concat(((v % 900 + 100) / 10).cast("string"), F.lit(" lakh")))
        .when(F.col("o_orderkey") % 4 == 1, F.concat(((v % 90 + 10) / 10).cast("string"), F.lit(" crore")))
        .when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("Rs. "), F.format_number(v, 0)))
        .otherwise(F.lit("sold today"))
    )
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("it sold for "), words).alias("question"))
    return rows.select("o_orderkey", F.round(facts.amount_in_lakh(F.col("question")), 6).alias("lakh"))


GERMANS = (("bmw", "3 series", "BMW 3 Series"), ("AUDI", "a4", "Audi A4"), ("mercedes benz", "c-class", "Mercedes Benz C-Class"), ("vw", None, "Volkswagen"), ("Benz", "e-class", "Benz E-Class"))


@query(f"""
    WITH g(i, name) AS (VALUES {", ".join(f"({i}, '{fixed.GERMAN_BRANDS[b.lower()]}' || {chr(39) + ' ' + n.split(' ', b.count(' ') + 1)[-1] + chr(39) if m else chr(39) * 2})" for i, (b, m, n) in enumerate(GERMANS))})
    SELECT p_partkey, name, 'german' AS band FROM part JOIN g ON i = p_partkey % {len(GERMANS)}
""")
def german_name(spark, sf_dir):
    """The car that a question names, by German brand and model."""
    asked = pick([" ".join(x for x in g[:2] if x) for g in GERMANS], F.col("p_partkey"))
    rows = read(spark, sf_dir, "part").select("p_partkey", facts.vehicle(F.concat(F.lit("my "), asked, F.lit(", please"))).alias("v"))
    return rows.select("p_partkey", "v.name", "v.band")


PHRASES = ("auction sheet of the {p}", "boost the {p} listing", "sifm commission on a {p}", "register a {p}, then inspect it", "PDI of a {p}", "an open letter {p}", "{p}")


@query(f"""
    WITH t AS (SELECT p_partkey, regexp_replace(replace(list_extract([{", ".join(f"'{x}'" for x in PHRASES)}], (p_partkey % {len(PHRASES)} + 1)::INT), '{{p}}', p_name), '(?i){fixed.OPEN_LETTER}', ' ', 'g') AS t FROM part)
    SELECT p_partkey, concat_ws(',', {", ".join("CASE WHEN regexp_matches(t, '(?i)" + p.replace("{brand}", "Carhub").replace("'", "''") + f"') THEN '{name}' END" for name, p in fixed.SERVICES)}) AS services FROM t
""")
def services_of(spark, sf_dir):
    asked = F.replace(pick(list(PHRASES), F.col("p_partkey")), F.lit("{p}"), F.col("p_name"))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(facts.services(asked, FACT_DOMAIN), ",").alias("services"))


@query("""
    WITH d(i, who) AS (VALUES (0, 'Daniel Morgan'), (1, 'Sarah Lee'), (2, 'James Patel'), (3, 'Maria Garcia')),
    c(i, city) AS (VALUES (0, 'Chicago'), (1, 'Toronto'), (2, 'Manchester'), (3, 'Sydney')),
    n AS (SELECT c_custkey, ('0x' || substr(md5(c_custkey || '|person'), 1, 8))::BIGINT % 4 AS p, ('0x' || substr(md5(c_custkey || '|city'), 1, 8))::BIGINT % 4 AS k,
        'ORD-' || (('0x' || substr(md5(c_custkey || '|order'), 1, 12))::BIGINT % 900000 + 100000) AS o FROM customer)
    SELECT c_custkey, 'Where is ' || o || ' for ' || who || '?' AS instruction, 'Order ' || o || ' of ' || who || ' goes to your city, ' || o || ' it is.' AS response
    FROM n JOIN d ON d.i = p JOIN c ON c.i = k
""")
def slot_fill(spark, sf_dir):
    """Slots that the instruction names take the row's drawn values on both sides; a city that it doesn't name stays neutral."""
    asked = F.lit("Where is {{Order Number}} for {{Person Name}}?")
    given = F.lit("Order {{order number}} of {{ Person Name }} goes to {{Delivery City}}, {{Order Number}} it is.")
    a, b = text.clean_pair(asked, given, F.col("c_custkey"))
    customers = text.spread(read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    return customers.select("c_custkey", a.alias("instruction"), b.alias("response"))


def guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    amount = F.format_number(F.bround("o_totalprice").cast("long"), 0)
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", amount.alias("amount"))
    rows = rows.withColumn("before", F.lag("amount").over(w)).withColumn("n", F.row_number().over(w))
    told = F.when(F.col("n") % 2 == 0, F.col("amount")).otherwise(F.coalesce("before", F.lit("0")))
    return rows.select("o_orderkey", text.fill("It costs PKR {a}.", a=F.col("amount")).alias("answer"), F.concat(F.lit("PKR "), told).alias("sources"))


@query(f"WITH {GUARD} SELECT o_orderkey, CASE WHEN sources = 'PKR ' || amount THEN '' ELSE 'PKR ' || amount END AS unsupported FROM g")
def unsupported_figures(spark, sf_dir):
    rows = guarded(spark, sf_dir)
    return rows.select("o_orderkey", F.array_join(text.unsupported_figures(F.col("answer"), F.col("sources")), "|").alias("unsupported"))


@query(f"""
    WITH {GUARD} SELECT o_orderkey, CASE WHEN sources = 'PKR ' || amount THEN answer
        ELSE 'I don''t have a confirmed figure for that, so I won''t guess. Please check the Car Inspection page or call the Marketplace helpline at the number on the contact page, 9 am to 9 pm every day.' END AS answer FROM g
""")
def guard_answer(spark, sf_dir):
    rows = guarded(spark, sf_dir)
    return rows.select("o_orderkey", facts.guard(F.col("answer"), F.col("sources"), F.lit("What does the inspection cost?")).alias("answer"))


CHECKS_SQL = """
    c AS (SELECT doc_id, source, lang, list_filter([
        CASE WHEN NOT (regexp_matches(text, '(?i)licen') OR regexp_matches(text, '(?i)the ')) THEN 'missing: licen | the ' END,
        CASE WHEN regexp_matches(text, '(?i)password|token') THEN 'forbidden: password|token' END], lambda x: x IS NOT NULL) AS failures FROM documents)"""


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    must, must_not = F.array(F.array(F.lit("licen"), F.lit("the "))), F.array(F.lit("password|token"))
    return read(spark, sf_dir, "documents").select("doc_id", "source", "lang", rules.check(F.col("text"), must, must_not).alias("failures"))


@query(f"WITH {CHECKS_SQL} SELECT doc_id, array_to_string(failures, '; ') AS failures, len(failures) = 0 AS passed FROM c")
def rule_check(spark, sf_dir):
    return checked(spark, sf_dir).select("doc_id", F.array_join("failures", "; ").alias("failures"), (F.size("failures") == 0).alias("passed"))


@query(f"WITH {CHECKS_SQL} SELECT source AS topic, count_if(len(failures) = 0)::BIGINT AS passed, count(*) AS total, round(count_if(len(failures) = 0) / count(*), 6) AS rate FROM c GROUP BY source")
def topic_pass_rate(spark, sf_dir):
    rows = checked(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("source").alias("topic"), (F.size("failures") == 0).alias("passed"))
    return rules.pass_rate(rows).select("topic", "passed", "total", r6("rate"))


# --- Splits, draws, synthesis -----------------------------------------------------------------------------

PAIRS = r"""
    u AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations WHERE role = 'user'),
    q AS (SELECT *, lower(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS key, lower(regexp_replace(previous, '^\s+|\s+$', '', 'g')) AS told FROM u),
    held AS (SELECT key FROM (SELECT DISTINCT key FROM q) ORDER BY md5('42|' || key), key LIMIT 20)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history.with_previous_question(read(spark, sf_dir, "conversations"))
    told = F.when(F.col("previous").isNotNull(), F.array(F.struct(F.lit("user").alias("role"), F.col("previous").alias("content")))).otherwise(F.array().cast(readers.HISTORY))
    return rows.select("conv_id", "turn", F.col("text").alias("instruction"), told.alias("history"))


@query(f"""
    WITH {PAIRS}
    SELECT conv_id, turn, CASE WHEN key IN (SELECT key FROM held) THEN 'test' ELSE 'train' END AS side FROM q
    WHERE key IN (SELECT key FROM held) OR told IS NULL OR told NOT IN (SELECT key FROM held)
""")
def leak_free_split(spark, sf_dir):
    train, test = splits.split_by_question(questions(spark, sf_dir), 20, 42)
    side = lambda rows, name: rows.select("conv_id", "turn", F.lit(name).alias("side"))
    return side(train, "train").unionByName(side(test, "test"))


@query(f"""
    WITH {PAIRS},
    side AS (SELECT key, told, key IN (SELECT key FROM held) AS test FROM q),
    kept AS (SELECT * FROM side WHERE test OR told IS NULL OR told NOT IN (SELECT key FROM held))
    SELECT count_if(test)::BIGINT AS test_rows, count_if(NOT test)::BIGINT AS train_rows, count(DISTINCT CASE WHEN test THEN key END) AS test_keys,
        (SELECT count(*) FROM (SELECT key FROM kept WHERE test INTERSECT SELECT key FROM kept WHERE NOT test)) AS shared,
        count_if(NOT test AND told IN (SELECT key FROM held))::BIGINT AS leaked
    FROM kept
""")
def split_disjoint(spark, sf_dir):
    """Rows and keys of both sides, keys on both, and training rows whose history asks a test question."""
    train, test = splits.split_by_question(questions(spark, sf_dir), 20, 42)
    keys = test.select(text.question_key(F.col("instruction")).alias("key")).distinct()
    told = train.select(F.explode("history").alias("m")).select(text.question_key(F.col("m.content")).alias("key"))
    out = test.agg(F.count("*").alias("test_rows")).crossJoin(train.agg(F.count("*").alias("train_rows"))).crossJoin(keys.agg(F.count("*").alias("test_keys")))
    out = out.crossJoin(splits.shared_keys(train, test).agg(F.count("*").alias("shared")))
    return out.crossJoin(told.join(keys, "key", "left_semi").agg(F.count("*").alias("leaked")))


TEMPLATES = ("What does {n} cost?", "Is {n} available?", "{n} ki qeemat?")


@query(f"SELECT n_name AS n, replace(t, '{{n}}', n_name) AS question FROM nation CROSS JOIN (VALUES {', '.join(f'(${chr(36)}{t}${chr(36)})' for t in TEMPLATES)}) AS v(t)")
def template_cross_join(spark, sf_dir):
    templates = spark.createDataFrame([(t,) for t in TEMPLATES], "template string")
    return build.cross(templates, read(spark, sf_dir, "nation").select(F.col("n_name").alias("n")), "n").select("n", "question")


@query("""
    SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('7|' || c_custkey), c_custkey) AS r FROM customer) WHERE r <= 3
""")
def sample_k_per_group(spark, sf_dir):
    return draws.sample_per_group(read(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey", 3, 7).select("c_mktsegment", "c_custkey")


HASH = "('0x' || substr(md5({0}), 1, 8))::BIGINT"


@query(f"SELECT event_id FROM events WHERE {HASH.format(chr(39) + '5|' + chr(39) + ' || event_id')} % 1000000 < 350000")
def bernoulli_hash(spark, sf_dir):
    return read(spark, sf_dir, "events").where(draws.chance(0.35, 5, F.col("event_id"))).select("event_id")


@query("""
    WITH p AS (SELECT a.n_name AS a, b.n_name AS b, a.n_regionkey = b.n_regionkey AS alike, md5('3|' || a.n_name || '|' || b.n_name) AS d FROM nation a JOIN nation b ON a.n_name <> b.n_name)
    SELECT a, b, alike FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY alike DESC, d) AS r FROM p) WHERE r <= 2
""")
def lookalike_join(spark, sf_dir):
    """Each nation with two others, of its own region first."""
    nation = read(spark, sf_dir, "nation")
    a, b = nation.select(F.col("n_name").alias("a"), F.col("n_regionkey").alias("ra")), nation.select(F.col("n_name").alias("b"), F.col("n_regionkey").alias("rb"))
    pairs = a.join(b, F.col("a") != F.col("b")).withColumn("alike", F.col("ra") == F.col("rb"))
    return build.pick_others(pairs, "a", "alike", F.col("b"), 2, 3).select("a", "b", "alike")


@query("""
    SELECT 'page' AS segment, page_id AS id FROM pages UNION ALL SELECT 'benchmark', item_id FROM benchmark UNION ALL SELECT 'document', doc_id FROM documents
""")
def segment_union(spark, sf_dir):
    part = lambda name, table, key: read(spark, sf_dir, table).select(F.lit(name).alias("segment"), F.col(key).alias("id"))
    return build.union_all(part("page", "pages", "page_id"), part("benchmark", "benchmark", "item_id"), part("document", "documents", "doc_id"))


@query(r"""
    WITH k AS (SELECT DISTINCT lower(regexp_replace(line, '^\s+|\s+$', '', 'g')) AS key FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)),
    b AS (SELECT DISTINCT item_id, lower(regexp_replace(line, '^\s+|\s+$', '', 'g')) AS key FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS line FROM benchmark))
    SELECT item_id, count(*) AS n_lines FROM b JOIN k USING (key) WHERE key <> '' GROUP BY item_id
""")
def contamination_check(spark, sf_dir):
    """Benchmark items with the number of their lines that occur as a line of a document."""
    lines = lambda table, *keys: read(spark, sf_dir, table).select(*keys, F.explode(F.split("text", "\n")).alias("instruction"))
    items = lines("benchmark", "item_id").withColumn("q", text.question_key(F.col("instruction"))).where("q <> ''").select("item_id", "q").distinct()
    return splits.contaminated(items, lines("documents")).groupBy("item_id").agg(F.count("*").alias("n_lines"))


@query("""
    SELECT count(*) AS rows, count_if(source <> '')::BIGINT AS with_context, count_if(starts_with(source, 'src1'))::BIGINT AS verified, count(DISTINCT lang) AS intents FROM documents
""")
def dataset_summary(spark, sf_dir):
    return sinks.summary(read(spark, sf_dir, "documents").select(F.col("source").alias("context"), F.col("lang").alias("intent")), "src1")


# --- Evaluation ---------------------------------------------------------------------------------------------

ROUGE = """
    p AS (SELECT conv_id, turn, role, text, lag(text) OVER w AS asked, lag(role) OVER w AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    t AS (SELECT conv_id, turn, regexp_extract_all(lower(asked), '[a-z0-9]+', 0) AS a, regexp_extract_all(lower(text), '[a-z0-9]+', 0) AS b FROM p WHERE role = 'assistant' AND before = 'user'),
    l AS (SELECT conv_id, turn, len(a) + len(b) AS total, list_reduce(
        list_prepend(list_transform(range(len(b) + 1), lambda z: 0), list_transform(a, lambda x: list_transform(b, lambda y: (x = y)::INT))),
        lambda prev, hits: list_reduce(list_prepend([0], list_transform(range(1, len(b) + 1), lambda j: [CASE WHEN hits[j] = 1 THEN prev[j] + 1 ELSE prev[j + 1] END])),
            lambda acc, v: list_append(acc, greatest(v[1], acc[-1])))
    )[-1] AS n FROM t),
    f AS (SELECT conv_id, turn, CASE WHEN n > 0 THEN 2.0 * n / total ELSE 0.0 END AS f1 FROM l)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = read(spark, sf_dir, "conversations").withColumn("asked", F.lag("text").over(w)).withColumn("before", F.lag("role").over(w))
    pairs = rows.where("role = 'assistant' and before = 'user'").select("conv_id", "turn", "asked", "text")
    return evaluate.with_rouge_l(pairs, "asked", "text").select("conv_id", "turn", "rouge_l")


@query(f"WITH {ROUGE} SELECT conv_id, turn, round(f1, 6) AS rouge_l FROM f")
def rouge_l(spark, sf_dir):
    return scored(spark, sf_dir).select("conv_id", "turn", r6("rouge_l"))


@query(f"WITH {ROUGE} SELECT round(avg(f1), 6) AS rouge_l, count(*) AS pairs FROM f")
def rouge_l_mean(spark, sf_dir):
    return scored(spark, sf_dir).agg(F.round(F.avg("rouge_l"), 6).alias("rouge_l"), F.count("*").alias("pairs"))


@query("""
    WITH h AS (SELECT source, avg(quality) FILTER (doc_id % 2 = 0) AS baseline, avg(quality) FILTER (doc_id % 2 = 1) AS current FROM documents JOIN labels USING (doc_id) GROUP BY source)
    SELECT source, round(baseline - current, 6) AS drop, CASE WHEN baseline - current > 0.10 THEN 'retrain' WHEN baseline - current > 0.05 THEN 'warn' ELSE 'stable' END AS decision FROM h
""")
def drift_decision(spark, sf_dir):
    """Mean quality by source: documents of even ids are the baseline, those of odd ids the current run."""
    rows = read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id")
    halves = rows.groupBy("source").agg(F.avg(F.when(F.col("doc_id") % 2 == 0, F.col("quality"))).alias("b"), F.avg(F.when(F.col("doc_id") % 2 == 1, F.col("quality"))).alias("c"))
    return halves.withColumn("d", evaluate.drift(F.col("b"), F.col("c"))).select("source", F.round("d.drop", 6).alias("drop"), "d.decision")


# --- Tables and streams ---------------------------------------------------------------------------------------


@query("""
    SELECT p_partkey, 'p_name: ' || coalesce(p_name, 'nan') || ', p_brand: ' || coalesce(p_brand, 'nan') || ', p_size: ' || coalesce(p_size::VARCHAR, 'nan') AS text FROM part
""")
def row_to_text(spark, sf_dir):
    rows = read(spark, sf_dir, "part")
    return rows.select("p_partkey", readers.row_text(rows, ["p_name", "p_brand", "p_size"]).alias("text"))


@query("""SELECT event_id, (props::JSON ->> 'k')::BIGINT AS "props.k" FROM events""")
def flatten_props(spark, sf_dir):
    return readers.flatten_columns(read(spark, sf_dir, "events").select("event_id", F.from_json("props", "struct<k:bigint>").alias("props")))


@query("""
    WITH t AS (SELECT user_id::VARCHAR AS reply_id, event_id AS seq, CASE WHEN event_type = 'error' THEN ' 5%' ELSE event_type END AS token FROM events),
    s AS (SELECT reply_id, seq, count_if(token = ' 5%') OVER w AS held, string_agg(token, '') OVER w AS so_far FROM t WINDOW w AS (PARTITION BY reply_id ORDER BY seq))
    SELECT reply_id, seq, held = 0 AS shown, length(so_far) AS chars FROM s
""")
def stream_latch(spark, sf_dir):
    token = F.when(F.col("event_type") == "error", F.lit(" 5%")).otherwise(F.col("event_type"))
    rows = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("reply_id"), F.col("event_id").alias("seq"), token.alias("token"))
    return latches.latch(rows, with_text=False).select("reply_id", "seq", "shown", "chars")
