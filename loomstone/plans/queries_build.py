"""Queries of generators, draws, segments, sources and sinks, with their SQL.

Generators ask about what the tables name: parts stand for cars and goods,
order keys give prices, nations and the listed cities give cities. Queries of
sinks write to the shared folder and read back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.functions import facts, fixed
from loomstone.operators import draws, evaluate, rules
from loomstone.plans import build, generators, samples
from loomstone.plans.generators import ASKED, TITLES
from loomstone.plans.queries import FACT_DOMAIN, ORACLES, case_of, pick, query, read, said
from loomstone.sources import readers, sinks
from loomstone.sources.shared import scratch

# --- Generators --------------------------------------------------------------------------------------


def quote(x: object) -> str:
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def values(rows: list[tuple]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


#: Entities in SQL, which Spark and the other engine read alike; lists count from 0 in {..} places.
LISTS = {
    "bands": ("small", "mid", "suv", "german"), "labels": tuple(fixed.FEATURED_LABELS), "inspection": fixed.INSPECTION_CITIES, "sale": fixed.SALE_CITIES,
    "transfer": fixed.TRANSFER_CITIES, "kinds": ("wrong", "damaged", "defective", "incomplete"),
}


def nth(name: str, number: str) -> str:
    """Element ``number`` modulo the list's length."""
    return f"CASE CAST({number} AS INT) % {len(LISTS[name])} " + " ".join(f"WHEN {i} THEN {quote(v)}" for i, v in enumerate(LISTS[name])) + " END"


def cities_sql(name: str) -> str:
    return f"SELECT DISTINCT CASE WHEN n_nationkey % 2 = 0 THEN {nth(name, 'n_nationkey')} ELSE n_name END AS c FROM nation"


ENTITIES = {
    "cars": f"SELECT DISTINCT p_name AS car, {nth('bands', 'length(p_name)')} AS band FROM part",
    "engines": "SELECT DISTINCT CAST(600 + p_size * 28 AS INT) AS cc FROM part",
    "prices": "SELECT DISTINCT CAST((o_orderkey % 300 + 1) / 2e0 AS DOUBLE) AS p FROM orders",
    "featured": f"SELECT DISTINCT {nth('labels', 'p_size')} AS d, ' of a ' || p_name AS x FROM part",
    "bundles": "SELECT DISTINCT CASE WHEN c_custkey % 2 = 0 THEN 5 ELSE 10 END AS n, ' for ' || lower(c_mktsegment) AS x FROM customer",
    "inspection_cities": cities_sql("inspection"), "sale_cities": cities_sql("sale"), "transfer_cities": cities_sql("transfer"),
    "years": "SELECT DISTINCT p_name AS car, CAST(1985 + p_size AS INT) AS y FROM part",
    "auctions": "SELECT DISTINCT ' of ' || p_brand AS x FROM part",
    "faulty": f"SELECT DISTINCT lower(p_type) AS item, {nth('kinds', 'length(p_type)')} AS kind FROM part",
    "unloved": "SELECT DISTINCT p_name AS item FROM part",
    "colours": "SELECT DISTINCT split_part(p_name, ' ', 2) AS item, split_part(p_name, ' ', 1) AS a, lower(p_brand) AS b FROM part",
}


def entities(spark, sf_dir) -> generators.Entities:
    found = {}
    for name, sql in ENTITIES.items():
        table = next(t for t in ("part", "orders", "customer", "nation") if sql.endswith(f" FROM {t}"))
        found[name] = spark.sql(sql.replace(f" FROM {table}", " FROM {table}"), table=read(spark, sf_dir, table))
    return generators.Entities(**found)


def asked_sql(source: str, cols: str, asked: str, k: str, answer: str, title: str, **places: str) -> str:
    """k templates of each entity, by the digests of the questions."""
    question = "t"
    for c in cols.split(", "):
        question = f"replace({question}, '{{{c}}}', {places.get(c, f'{c}::VARCHAR')})"
    return f"""SELECT question AS instruction, {answer} AS response, {quote(title)} AS title FROM (
        SELECT *, row_number() OVER (PARTITION BY {cols} ORDER BY md5('42|' || question), question) AS nth
        FROM (SELECT e.*, {question} AS question FROM ({ENTITIES[source]}) AS e CROSS JOIN ({values([(t,) for t in ASKED[asked]])}) AS v(t))) WHERE nth <= {k}"""


def said_sql(questions: list[str], answer: str, title: str) -> str:
    return f"SELECT q AS instruction, {answer} AS response, {quote(title)} AS title FROM ({values([(q,) for q in questions])}) AS v(q)"


def marked_sql(intent: str, category: str, *parts: str) -> str:
    return f"SELECT *, {quote(category)} AS category, {quote(intent)} AS intent FROM ({' UNION ALL '.join(parts)})"


CC_BAND = "(CASE WHEN cc <= 1000 THEN 'small' WHEN cc <= 2000 THEN 'mid' ELSE 'large' END)"


def priced_sql(service: str, kind: str) -> str:
    table = fixed.INSPECTION_PRICE if service == "inspection" else fixed.SALE_FEE
    verb, verb_the = (quote(fixed.SENTENCES[f"{service}_verb{x}"]) for x in ("", "_the"))
    if kind == "cc":
        lead = said("cc", article="CASE WHEN regexp_matches(cc::VARCHAR, '^(8|11|18)') THEN 'An' ELSE 'A' END", cc="cc::VARCHAR", label=case_of(CC_BAND, fixed.BAND_LABEL))
        return said(service, lead=lead, verb=verb, price=case_of(CC_BAND, table))
    label = case_of("band", fixed.BAND_LABEL)
    small = said(service, lead=said("car_small", car="car", label=label), verb=verb, price=case_of("band", table))
    other = said(service, lead=said("car_body", car="car", label=label), verb=verb_the, price=case_of("band", table))
    return f"CASE WHEN band IN ('small', 'mid') THEN {small} ELSE {other} END"


def price_rows_sql(intent: str, category: str, service: str, asked: str, per_car: int) -> str:
    by_size = asked_sql("engines", "cc", f"{asked}_cc", "2", priced_sql(service, "cc"), TITLES[service])
    return marked_sql(
        intent, category,
        asked_sql("cars", "car, band", f"{asked}_car", str(per_car), priced_sql(service, "car"), TITLES[service]),
        f"{by_size} AND cc <> {generators.HELD_OUT_ENGINE[service]}",
        said_sql(ASKED[f"{asked}_large"], said(f"large_{service}"), TITLES[service]),
    )


def made(spark, sf_dir, name: str):
    rows = getattr(generators.Generators(spark, 42, FACT_DOMAIN, entities(spark, sf_dir)), name)()
    return rows.select("instruction", "response", "title", "category", "intent")


@query(price_rows_sql("inspection_price_specific", "SERVICES", "inspection", "inspection", 2))
def inspection_price_rows(spark, sf_dir):
    return made(spark, sf_dir, "inspection_price")


@query(price_rows_sql("sifm_fee_specific", "SELLING", "sifm", "sale", 1))
def sale_fee_rows(spark, sf_dir):
    return made(spark, sf_dir, "sale_fee")


LABEL = "(CASE WHEN p >= 100 THEN format('{:g}', (p / 100)::DOUBLE) || ' crore' ELSE format('{:g}', p::DOUBLE) || ' lakh' END)"
RUPEES = {
    "label": LABEL, "price": "'PKR ' || format('{:,}', (p * 100000)::BIGINT)", "one": "'PKR ' || format('{:,}', (p * 1000)::BIGINT)",
    "commission": f"'PKR ' || format('{{:,}}', CASE WHEN p <= 5 THEN greatest((p * 1000)::BIGINT, {fixed.COMMISSION_MIN}) ELSE (p * 1000)::BIGINT END)",
}


@query(marked_sql("sifm_commission", "SELLING", asked_sql(
    "prices", "p", "commission", "CASE WHEN p <= 5 THEN 2 ELSE 1 END",
    f"CASE WHEN p < 5 THEN {said('commission_low', **RUPEES)} WHEN p = 5 THEN {said('commission_even', **RUPEES)} ELSE {said('commission_high', **RUPEES)} END", TITLES["sifm"], p=LABEL,
)))
def commission_rows(spark, sf_dir):
    return made(spark, sf_dir, "commission")


FEATURED = case_of(case_of("d", fixed.FEATURED_LABELS), fixed.FEATURED_PRICE)


@query(marked_sql(
    "featured_price_specific", "SELLING",
    asked_sql("featured", "d, x", "featured", "1",
        f"CASE WHEN d = 'a month' THEN {said('featured_month', price=FEATURED)} ELSE {said('featured', days=case_of('d', fixed.FEATURED_LABELS), price=FEATURED)} END || {said('featured_tail')}", TITLES["featured"]),
    asked_sql("bundles", "n, x", "bundle", "1",
        "CASE n " + " ".join(f"WHEN {n} THEN " + said("bundle", n=f"'{n}'", price=f"'{p}'") for n, p in fixed.BUNDLE_PRICE.items()) + " END", TITLES["featured"]),
))
def featured_rows(spark, sf_dir):
    return made(spark, sf_dir, "featured_price")


def in_cities(names: tuple) -> str:
    return "c IN (" + ", ".join(map(quote, names)) + ")"


WHERE = f"(CASE WHEN c = 'Lahore' THEN {said('where_home')} ELSE {said('where_other')} END)"
EXTRA = f"(CASE WHEN {in_cities(fixed.INSPECTION_CITIES)} THEN {said('sifm_no_extra', city='c')} ELSE '' END)"


def listed(names: tuple) -> str:
    return quote(facts.name_list(names))


@query(marked_sql(
    "city_eligibility", "SERVICES",
    asked_sql("inspection_cities", "c", "inspection_city", "1",
        f"CASE WHEN {in_cities(fixed.INSPECTION_CITIES)} THEN {said('inspection_yes', city='c', where=WHERE)} ELSE {said('inspection_no', city='c', cities=listed(fixed.INSPECTION_CITIES))} END", TITLES["inspection_city"]),
    asked_sql("sale_cities", "c", "sale_city", "1",
        f"CASE WHEN {in_cities(fixed.SALE_CITIES)} THEN {said('sifm_yes', city='c')} ELSE {said('sifm_no', city='c', cities=listed(fixed.SALE_CITIES), extra=EXTRA)} END", TITLES["sale_city"]),
))
def city_rows(spark, sf_dir):
    return made(spark, sf_dir, "city_eligibility")


@query(marked_sql("transfer_city", "SERVICES", asked_sql(
    "transfer_cities", "c", "transfer", f"CASE WHEN {in_cities(fixed.TRANSFER_CITIES)} THEN 3 ELSE 1 END",
    f"CASE WHEN {in_cities(fixed.TRANSFER_CITIES)} THEN {said('transfer_yes', city='c')} ELSE {said('transfer_no', city='c', cities=listed(fixed.TRANSFER_CITIES))} END", TITLES["transfer"],
)))
def transfer_rows(spark, sf_dir):
    return made(spark, sf_dir, "transfer_city")


SUBJECT = "(y || ' ' || car)"


@query(marked_sql(
    "sifm_model_year", "SELLING",
    asked_sql("years", "car, y", "year", "1",
        f"CASE WHEN y < 2000 THEN {said('year_no', subject=SUBJECT)} ELSE {said('year_yes', subject=SUBJECT, cities=listed(fixed.SALE_CITIES))} END", TITLES["sale_city"]),
    said_sql(ASKED["open_letter"], said("open_letter"), TITLES["sale_city"]),
))
def model_year_rows(spark, sf_dir):
    return made(spark, sf_dir, "model_year")


@query(marked_sql("auction_fee_unknown", "SERVICES", asked_sql("auctions", "x", "auction", str(len(ASKED["auction"])), said("auction_fee"), TITLES["auction"])))
def auction_rows(spark, sf_dir):
    return made(spark, sf_dir, "auction_fee")


RETURN_YES, RETURN_NO = quote(generators.RETURN_YES), quote(generators.RETURN_NO)


@query(marked_sql(
    "autostore_returns", "SHOP",
    asked_sql("faulty", "item, kind", "faulty", "1", f"replace({RETURN_YES}, '{{kind}}', kind)", TITLES["returns"]),
    asked_sql("unloved", "item", "unloved", "1", RETURN_NO, TITLES["returns"]),
    asked_sql("colours", "item, a, b", "tired", "1", RETURN_NO, TITLES["returns"]),
    asked_sql("colours", "item, a, b", "swapped", "1", f"replace({RETURN_YES}, '{{kind}}', 'wrong')", TITLES["returns"]),
))
def returns_rows(spark, sf_dir):
    return made(spark, sf_dir, "returns")


# --- Draws and sections ----------------------------------------------------------------------------------

WORDS = ("red", "green", "blue", "black", "white")


def drawn(*keys: str) -> str:
    """SQL of a draw's number: 32 bits of the digest of the seed and the keys."""
    return "('0x' || substr(md5(concat_ws('|', " + ", ".join(keys) + ")), 1, 8))::BIGINT"


@query(f"""
    WITH w AS (SELECT c_custkey, [{", ".join(map(quote, WORDS))}] AS words FROM customer)
    SELECT c_custkey, words[{drawn("'9'", "c_custkey")} % {len(WORDS)} + 1] AS one,
        array_to_string(list_transform(list_sort(list_transform(range({len(WORDS)}), lambda i: md5('9|' || c_custkey || '|' || i) || '|' || words[i + 1])), lambda s: substr(s, 34)), ',') AS everything FROM w
""")
def choose_one(spark, sf_dir):
    """One of five words a row, and all five in a drawn order."""
    words = F.array(*map(F.lit, WORDS))
    one, everything = draws.choose(words, 9, F.col("c_custkey")), F.array_join(draws.shuffled(words, 9, F.col("c_custkey")), ",")
    return read(spark, sf_dir, "customer").select("c_custkey", one.alias("one"), everything.alias("everything"))


@query("SELECT c_custkey FROM customer ORDER BY md5('11|' || c_custkey), c_custkey LIMIT 40")
def shuffled_head(spark, sf_dir):
    """The first 40 rows in drawn order: the number is the feature."""
    return draws.shuffle_rows(read(spark, sf_dir, "customer").select("c_custkey"), F.col("c_custkey"), 11).limit(40)


SECTIONS = {"Fees": "What we ask.", "Prices": "What it costs.", "Places": "Where we are.", "Times": "When we open.", "People": "Who we are."}
ALIKE = {"Fees": ["Prices"], "Prices": ["Fees", "Times"], "Times": ["Places", "Prices"]}
RATE = {k: int(v * 1_000_000) for k, v in build.RATES.items()}
TITLE_LIST = "[" + ", ".join(map(quote, SECTIONS)) + "]"


def by_title(title: str) -> str:
    return case_of(title, SECTIONS)


@query(f"""
    WITH o AS (SELECT c_custkey, ({TITLE_LIST})[(c_custkey % {len(SECTIONS)} + 1)::INT] AS own FROM customer),
    l AS (SELECT *, list_filter({TITLE_LIST}, lambda x: x <> own) AS others, CASE own {" ".join(f"WHEN '{t}' THEN [{', '.join(map(quote, v))}]" for t, v in ALIKE.items())} ELSE []::VARCHAR[] END AS looks FROM o),
    d AS (SELECT *, CASE WHEN len(looks) > 0 AND {drawn("'42'", "c_custkey", "'c'")} % 1000000 < {RATE["confusable"]} THEN looks[{drawn("'42'", "c_custkey", "'alike'")} % greatest(len(looks), 1) + 1]
        ELSE others[{drawn("'42'", "c_custkey", "'other'")} % len(others) + 1] END AS distractor FROM l)
    SELECT c_custkey, own, distractor, CASE WHEN {drawn("'42'", "c_custkey", "'g'")} % 1000000 >= {RATE["context"]} THEN {by_title("own")}
        WHEN md5('42|' || c_custkey || '|0') <= md5('42|' || c_custkey || '|1') THEN {by_title("own")} || chr(10) || '---' || chr(10) || {by_title("distractor")}
        ELSE {by_title("distractor")} || chr(10) || '---' || chr(10) || {by_title("own")} END AS context FROM d
""")
def grounded_context(spark, sf_dir):
    """A row's own section, often with another that looks like it, in a drawn order."""
    sections = build.Sections(SECTIONS, ALIKE, 42)
    rows = read(spark, sf_dir, "customer").select("c_custkey", pick(list(SECTIONS), F.col("c_custkey")).alias("own"))
    own, key = F.array("own"), F.col("c_custkey")
    return rows.select("c_custkey", "own", sections.distractor(own, key).alias("distractor"), sections.grounded(own, key).alias("context"))


FIRST, THEN = ("Tell me of {x}.", "{x}, please."), ("And {x}?", "What about {x}?", "aur {x}?")


def filled(templates: tuple, x: str, *keys: str) -> str:
    return "[" + ", ".join(f"replace({quote(t)}, '{{x}}', {x})" for t in templates) + f"][{drawn(*keys)} % {len(templates)} + 1]"


@query(f"""
    WITH s AS (SELECT list({{'s': n_name, 'a': 'Region ' || n_regionkey || '.'}} ORDER BY n_name, n_regionkey) AS pool FROM nation),
    k AS (SELECT pool, 'nation|' || i AS k FROM s, range(300) AS r(i)),
    x AS (SELECT *, pool[{drawn("'42'", "k", "'a'")} % len(pool) + 1] AS a FROM k),
    y AS (SELECT *, list_filter(pool, lambda p: p.s <> a.s) AS rest FROM x),
    z AS (SELECT *, rest[{drawn("'42'", "k", "'b'")} % len(rest) + 1] AS b FROM y)
    SELECT {filled(FIRST, "a.s", "'42'", "k", "'first'")} AS asked, a.a AS answered, {filled(THEN, "b.s", "'42'", "k", "'then'")} AS instruction, b.a AS response, 'Where we are.' AS context FROM z
""")
def follow_up_pairs(spark, sf_dir):
    """Chats of two turns: a question on one nation, then a short one on another."""
    subjects = read(spark, sf_dir, "nation").select(F.col("n_name").alias("subject"), F.concat(F.lit("Region "), F.col("n_regionkey").cast("string"), F.lit(".")).alias("answer"))
    sections = build.Sections({"Places": SECTIONS["Places"]}, {}, 42)
    rows = build.follow_ups(subjects, list(FIRST), list(THEN), "Places", sections, 300, "nation")
    return rows.select(F.col("history")[0]["content"].alias("asked"), F.col("history")[1]["content"].alias("answered"), "instruction", "response", "context")


MISSES = [("a", ["Fees"], True), ("b", ["Prices", "Times"], True), ("c", ["Places"], False)]
N_MISSES = 25


@query(f"""
    WITH i(intent, kb, figures) AS (VALUES {", ".join(f"('{n}', [{', '.join(map(quote, kb))}], {f})" for n, kb, f in MISSES)}),
    q AS (SELECT intent, kb, n_name || ' ' || intent || '?' AS instruction, intent || '|' || n_name || ' ' || intent || '?|miss' AS k FROM i CROSS JOIN nation WHERE figures),
    m AS (SELECT *, list_filter({TITLE_LIST}, lambda x: NOT list_contains(kb, x)) AS rest FROM q ORDER BY md5('42|' || k), k LIMIT {N_MISSES})
    SELECT intent, instruction, (['no', 'not here'])[{drawn("'42'", "k")} % 2 + 1] AS response, {by_title(f"rest[{drawn(chr(39) + '42' + chr(39), 'k')} % len(rest) + 1]")} AS context FROM m
""")
def retrieval_misses(spark, sf_dir):
    """Questions with figures beside a section that isn't theirs; their number is the segment's size."""
    names = read(spark, sf_dir, "nation").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    listed = spark.createDataFrame(MISSES, "intent string, kb array<string>, figures boolean")
    asked = F.transform("names", lambda n: F.concat(n, F.lit(" "), F.col("intent"), F.lit("?")))
    replies = F.array(F.lit("no"), F.lit("not here"))
    intents = listed.join(F.broadcast(names), how="cross").select("intent", F.lit("X").alias("category"), asked.alias("questions"), replies.alias("responses"), "kb", F.when(F.col("figures"), replies).alias("context_responses"))
    return build.retrieval_misses(intents, build.Sections(SECTIONS, ALIKE, 42), N_MISSES).select("intent", "instruction", "response", "context")


MADE = ("inspection_price_rows", "sale_fee_rows", "commission_rows", "featured_rows", "city_rows", "transfer_rows", "model_year_rows", "auction_rows", "returns_rows")
SIZE = build.SIZES
BARE = round(SIZE["switches"] * build.RATES["no_context_switch"])
INTENT_ROWS = ", ".join(f"('{r[0]}', {len(r[2])}, {r[4] is not None}, {r[6] is not None}, {bool(r[7])})" for r in samples.INTENTS)


@query(f"""
    WITH i(intent, n, own, figures, whole) AS (VALUES {INTENT_ROWS}),
    made AS (SELECT count(*) AS n FROM ({" UNION ALL ".join(f"SELECT instruction FROM ({ORACLES[m]})" for m in MADE)})),
    c AS (SELECT sum(n) AS plain, sum(CASE WHEN own THEN 0 WHEN whole THEN n ELSE least(n, {SIZE["irrelevant"]}) END) AS irrelevant, sum(CASE WHEN own THEN CASE WHEN figures OR whole THEN n ELSE least(n, {SIZE["grounded"]}) END ELSE 0 END) AS grounded,
        sum(CASE WHEN own THEN least(n, {SIZE["wrong"]}) ELSE 0 END) AS wrong, least({SIZE["misses"]}, sum(CASE WHEN figures THEN n ELSE 0 END)) AS miss, (SELECT n FROM made) AS specific FROM i),
    s(segment, n) AS (
        SELECT 'plain', plain FROM c UNION ALL SELECT 'irrelevant', irrelevant FROM c UNION ALL SELECT 'grounded', grounded FROM c UNION ALL SELECT 'wrong', wrong FROM c
        UNION ALL SELECT 'miss', miss FROM c UNION ALL SELECT 'specific', specific FROM c UNION ALL SELECT 'gap', {len(samples.GAPS)}
        UNION ALL SELECT 'follow_up', {5 * SIZE["follow_ups"] + len(generators.FOLLOW_UP_DAYS)}
        UNION ALL SELECT 'switch', least({BARE}, plain + irrelevant) + least({SIZE["switches"] - BARE}, grounded + specific) FROM c)
    SELECT segment, n::BIGINT AS rows, CASE WHEN segment IN ('switch', 'follow_up') THEN n ELSE 0 END::BIGINT AS chats, 0::BIGINT AS odd_histories, 0::BIGINT AS untold FROM s
""")
def build_segments(spark, sf_dir):
    """The whole training set by segment: rows, those with a history, histories that don't alternate, and answers without their verified facts."""
    t = samples.tables(spark)
    sections = build.Sections(samples.SECTIONS, samples.ALIKE, 42)
    made = generators.Generators(spark, 42, FACT_DOMAIN, entities(spark, sf_dir))
    questions = build.cut(made.all())
    rows = build.build(t["intents"], questions, made.chats(sections), t["gaps"], sections, t["protected"], FACT_DOMAIN)
    told = F.regexp_extract("context", rf"(?s)^{fixed.FACT_HEADER}\n(.*?)(?:\n---\n|$)", 1)
    alternates = F.forall(F.transform("history", lambda m, i: m["role"] == F.when(i % 2 == 0, "user").otherwise("assistant")), lambda ok: ok) & (F.size("history") % 2 == 0)
    return rows.groupBy("segment").agg(
        F.count("*").alias("rows"), F.count_if(F.size("history") > 0).alias("chats"), F.count_if(~alternates).alias("odd_histories"),
        F.count_if((told != "") & ~F.contains("response", told)).alias("untold"),
    )


# --- Sources and sinks ---------------------------------------------------------------------------------------


@query("""
    SELECT text AS instruction, source AS response, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS context, CASE WHEN doc_id % 2 = 0 THEN 'user: ' || source ELSE '' END AS history, 'c' AS category, doc_id::VARCHAR AS intent FROM documents
""")
def jsonl_round_trip(spark, sf_dir):
    """Rows written as JSON lines and read again; contexts and histories that are null become empty."""
    told = F.array(F.struct(F.lit("user").alias("role"), F.col("source").alias("content")))
    rows = read(spark, sf_dir, "documents").select(
        F.col("text").alias("instruction"), F.col("source").alias("response"), F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("context"),
        F.when(F.col("doc_id") % 2 == 0, told).alias("history"), F.lit("c").alias("category"), F.col("doc_id").cast("string").alias("intent"),
    )
    path = f"{scratch(spark, 'rows')}/rows.jsonl"
    sinks.write_jsonl(rows, path)
    back = readers.read_rows(spark, path)
    said = F.array_join(F.transform("history", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), ";")
    return back.select("instruction", "response", "context", said.alias("history"), "category", "intent")


@query("SELECT p_name AS instruction, p_brand || ', \"' || p_type || '\"' AS response, '' AS context, p_partkey::VARCHAR AS intent FROM part")
def csv_rows(spark, sf_dir):
    """Rows of a table of comma-separated values, with quotes and commas in them and without some columns."""
    rows = read(spark, sf_dir, "part").select(F.col("p_name").alias("instruction"), F.concat("p_brand", F.lit(', "'), "p_type", F.lit('"')).alias("response"), F.col("p_partkey").alias("intent"))
    path = f"{scratch(spark, 'rows')}/rows.csv"
    rows.write.option("header", True).option("escape", '"').csv(path)
    return readers.read_rows(spark, path).select("instruction", "response", "context", "intent")


@query("""
    SELECT 'n_nationkey: ' || n_nationkey || ', n_name: ' || n_name || ', n_regionkey: ' || n_regionkey AS page_content FROM nation
    UNION ALL SELECT 'r_regionkey: ' || r_regionkey || ', r_name: ' || r_name FROM region
""")
def union_documents(spark, sf_dir):
    """Documents of two tables; a file that isn't there and one of an unknown kind give none, with a warning."""
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        found = readers.union_documents(spark, [f"{sf_dir}/nation.parquet", f"{sf_dir}/none.md", f"{sf_dir}/region.parquet", f"{sf_dir}/none.odt"])
    return found.select("page_content")


@query("SELECT n_nationkey, n_name FROM nation")
def sample_kept(spark, sf_dir):
    """A sample table is written once; a second write leaves it alone."""
    rows = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    path = f"{scratch(spark, 'samples')}/nation"
    sinks.write_once(rows, path)
    sinks.write_once(rows.where("n_nationkey < 0"), path)
    return spark.read.parquet(path)


@query("SELECT n_nationkey::VARCHAR AS id, CASE WHEN n_regionkey > 0 THEN 'In region ' || n_regionkey ELSE '' END AS answer, n_regionkey IN (1, 2) AS passed FROM nation")
def saved_answers(spark, sf_dir):
    """A report's answers read back from its JSON, and from the plain object of ids and answers that they make."""
    import json

    nation = read(spark, sf_dir, "nation")
    pattern = F.array(F.array(F.lit("region [12]")))
    cases = nation.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").cast("string").alias("topic"), F.col("n_name").alias("q"), pattern.alias("must"), F.array().cast("array<string>").alias("must_not"))
    answers = nation.where("n_regionkey > 0").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("In region "), F.col("n_regionkey").cast("string")).alias("answer"))
    scored = rules.score_cases(cases, answers)
    folder = scratch(spark, "report")
    sinks.write_report(scored, "offline", folder)
    listed = readers.read_answers(spark, f"{folder}/report.json")
    sinks.write_text(spark, f"{folder}/answers.json", json.dumps({r.id: r.answer for r in listed.toLocalIterator()}))
    return readers.read_answers(spark, f"{folder}/answers.json").join(scored.select(F.col("id").cast("string").alias("id"), "passed"), "id")


@query("""
    WITH b AS (SELECT avg(quality) AS b FROM labels)
    SELECT 'metric' AS kind, 'baseline_accuracy' AS name, round(b, 6) AS value FROM b UNION ALL SELECT 'metric', 'current_accuracy', round(b - 0.07, 6) FROM b UNION ALL SELECT 'metric', 'accuracy_drop', 0.07
    UNION ALL SELECT 'event', '1 accuracy_drift_check', 0.0 UNION ALL SELECT 'event', '2 drift_warning', 0.0 UNION ALL SELECT 'event', '0 check', 0.0
""")
def drift_log(spark, sf_dir):
    """A run somewhat below its saved baseline: the metrics and events that its trace leaves in the log."""
    folder = scratch(spark, "drift")
    mean = read(spark, sf_dir, "labels").agg(F.avg("quality")).first()[0]
    sinks.save_baseline(spark, mean, folder)
    log = sinks.Log(spark, folder, "run")
    with sinks.trace(log, "check"):
        evaluate.detect_drift(spark, mean - 0.07, folder, log=log)
    metrics = spark.read.parquet(f"{folder}/metrics").select(F.lit("metric").alias("kind"), F.col("key").alias("name"), F.round("value", 6).alias("value"))
    events = spark.read.parquet(f"{folder}/events").select(F.lit("event").alias("kind"), F.concat_ws(" ", F.col("seq").cast("string"), "name").alias("name"), F.lit(0.0).alias("value"))
    return metrics.unionByName(events)


@query("SELECT true AS retrained, round(avg(quality), 6) AS baseline, false AS again FROM labels")
def drift_loop(spark, sf_dir):
    """A score far below the baseline retrains, the new score becomes the baseline, and the same score then is no drift."""
    folder = scratch(spark, "loop")
    mean = read(spark, sf_dir, "labels").agg(F.avg("quality")).first()[0]
    score = {"now": mean - 0.5}
    sinks.save_baseline(spark, mean + 0.2, folder)
    once = lambda: score["now"]
    retrained = evaluate.run_drift(spark, once, lambda: score.update(now=mean), folder, True)
    again = evaluate.run_drift(spark, once, lambda: None, folder, True)
    return spark.range(1).select(F.lit(retrained).alias("retrained"), F.lit(round(sinks.load_baseline(spark, folder), 6)).alias("baseline"), F.lit(again).alias("again"))
