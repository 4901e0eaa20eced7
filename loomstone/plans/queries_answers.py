"""Queries of facts, histories, prompts and evaluation over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstone.functions import facts, fixed, text
from loomstone.operators import evaluate, history, retrieval, rules
from loomstone.plans import build
from loomstone.plans.queries import ASKS, FACT_DOMAIN, NORMAL, PLACES, ROUGE, VERDICT_SQL, pick, query, read, said
from loomstone.streaming import latch


def turn(role: str, content: F.Column | str) -> F.Column:
    content = content if isinstance(content, F.Column) else F.lit(content)
    return F.struct(F.lit(role).alias("role"), content.cast("string").alias("content"))


# --- Facts -----------------------------------------------------------------------------------------

N = len(PLACES)


@query(f"""
    WITH p(i, city) AS (VALUES {", ".join(f"({i}, '{c}')" for i, c in enumerate(PLACES.values()))})
    SELECT c_custkey, a.city || CASE WHEN b.city <> a.city THEN ',' || b.city ELSE '' END || CASE WHEN d.city NOT IN (a.city, b.city) THEN ',' || d.city ELSE '' END AS cities
    FROM customer JOIN p a ON a.i = c_custkey % {N} JOIN p b ON b.i = (c_custkey // {N}) % {N} JOIN p d ON d.i = c_nationkey % {N}
""")
def cities_named(spark, sf_dir):
    """Usual names of three places that a question writes in its own way, each once, in the question's order."""
    key, names = F.col("c_custkey"), list(PLACES)
    asked = text.fill("from {a} via {b} to {c}", a=pick(names, key), b=pick(names, F.floor(key / N)), c=pick(names, F.col("c_nationkey")))
    return text.spread(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey").select("c_custkey", F.array_join(facts.cities(asked), ",").alias("cities"))


COMMISSION_PARTS = {
    "label": "label",
    "price": "'PKR ' || format('{:,}', k * 10000)",
    "commission": f"'PKR ' || format('{{:,}}', CASE WHEN k <= 50 THEN greatest(k * 100, {fixed.COMMISSION_MIN}) ELSE k * 100 END)",
    "one": "'PKR ' || format('{:,}', k * 100)",
}


@query(f"""
    WITH k AS (SELECT o_orderkey, (o_orderkey % 3000 + 10)::BIGINT AS k FROM orders),
    l AS (SELECT *, CASE WHEN k >= 1000 THEN format('{{:g}}', k / 1000.0::DOUBLE) || ' crore' ELSE format('{{:g}}', k / 10.0::DOUBLE) || ' lakh' END AS label FROM k)
    SELECT o_orderkey, CASE WHEN k < 50 THEN {said("commission_low", **COMMISSION_PARTS)} WHEN k = 50 THEN {said("commission_even", **COMMISSION_PARTS)}
        ELSE {said("commission_high", **COMMISSION_PARTS)} END AS answer FROM l
""")
def commission_sentence(spark, sf_dir):
    """The commission on prices of 1 to 300.9 lakh, in words."""
    lakh = (F.col("o_orderkey") % 3000 + 10) / F.lit(10.0)
    return read(spark, sf_dir, "orders").select("o_orderkey", facts.commission_answer(lakh).alias("answer"))


@query(f"""
    SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE answer END AS answer FROM ({VERDICT_SQL})
""")
def carried_services(spark, sf_dir):
    """A short question takes the service of the newest earlier one that names any; a question of more than ten words doesn't."""
    place = pick(list(PLACES), F.col("c_custkey"))
    short = text.fill("aur {p} mein?", p=place)
    long = text.fill("so then please tell me what it is like over in {p}", p=place)
    asked = F.concat(pick(list(ASKS.values()), F.col("c_nationkey")), F.lit("Quetta"))
    told = F.array(turn("user", "auction sheet of a car"), turn("user", asked), turn("assistant", "transfer?"), turn("user", "thanks a lot"))
    found = facts.detect(F.when(F.col("c_custkey") % 4 == 0, long).otherwise(short), told, FACT_DOMAIN)
    return text.spread(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey").select("c_custkey", F.array_join(F.transform(found, lambda f: f["text"]), " ").alias("answer"))


@query(f"""
    WITH v AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE answer END AS told, c_custkey % 2 = 0 AS kept, CASE WHEN c_custkey % 3 > 0 THEN 'section ' || c_custkey ELSE '' END AS held FROM ({VERDICT_SQL}))
    SELECT c_custkey, told <> '' AND NOT kept AS overridden, CASE WHEN told = '' OR kept THEN 'Sure. ' || CASE WHEN kept THEN told ELSE '' END ELSE told END AS response,
        concat_ws('{chr(10)}---{chr(10)}', CASE WHEN told <> '' THEN '{fixed.FACT_HEADER}' || chr(10) || told END, CASE WHEN held <> '' THEN held END) AS context FROM v
""")
def verified_rows(spark, sf_dir):
    """Training rows whose answer holds the verified facts, or is replaced by them; the facts lead the context."""
    key = F.col("c_custkey")
    asked = F.when(key % 5 == 0, F.lit("hello there")).otherwise(F.concat(pick(list(ASKS.values()), F.col("c_nationkey")), pick(list(PLACES), key)))
    rows = text.spread(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey").select("c_custkey", asked.alias("instruction"))
    truth = F.array_join(F.transform(facts.detect(F.col("instruction"), None, FACT_DOMAIN), lambda f: f["text"]), " ")
    rows = rows.withColumn("response", F.concat(F.lit("Sure. "), F.when(key % 2 == 0, truth).otherwise(F.lit(""))))
    rows = rows.withColumn("context", F.when(key % 3 > 0, text.fill("section {k}", k=key.cast("string")))).withColumn("history", F.array().cast(facts.HISTORY))
    return build.verified(rows, FACT_DOMAIN).select("c_custkey", "overridden", "response", "context")


@query(f"""
    WITH n AS (SELECT p_partkey, p_partkey % 3 AS n, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END AS held FROM part),
    b AS (SELECT *, CASE n WHEN 0 THEN NULL WHEN 1 THEN '{fixed.FACT_HEADER}' || chr(10) || 'one.' ELSE '{fixed.FACT_HEADER}' || chr(10) || 'one. two.' END AS block FROM n)
    SELECT p_partkey, concat_ws(chr(10) || '---' || chr(10), block, CASE WHEN held <> '' THEN held END) AS context, held AS stripped FROM b
""")
def fact_block(spark, sf_dir):
    """Facts before what was retrieved, and the context without them again."""
    told = [F.struct(F.lit("s").alias("service"), F.lit(t).alias("text")) for t in ("one.", "two.")]
    found = F.slice(F.array(*told), F.lit(1), (F.col("p_partkey") % 3).cast("int"))
    context = facts.build_context(found, F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")))
    return read(spark, sf_dir, "part").select("p_partkey", context.alias("context"), facts.strip_fact_block(context).alias("stripped"))


@query(f"""
    SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'No figure here.' ELSE
        {said("guard", page=f"(CASE o_orderkey % 4 WHEN 1 THEN '{fixed.PAGES['auction']}' ELSE 'the relevant page on {FACT_DOMAIN.site}' END)", helpline=f"'{FACT_DOMAIN.helpline}'")} END AS answer FROM orders
""")
def guard_pages(spark, sf_dir):
    """The page that an unconfirmed figure points to: that of the last service talked of, else the site's."""
    asked = F.when(F.col("o_orderkey") % 4 == 1, F.lit("auction sheet please")).otherwise(F.lit("good morning"))
    answer = F.when(F.col("o_orderkey") % 2 == 0, F.lit("No figure here.")).otherwise(F.lit("That is PKR 123,456."))
    guarded = facts.guard(answer, F.lit("PKR 5"), F.lit("what is it then?"), F.array(turn("user", asked)), FACT_DOMAIN)
    return read(spark, sf_dir, "orders").select("o_orderkey", guarded.alias("answer"))


@query("""
    SELECT c_custkey, 'open my' || CASE c_custkey % 3 WHEN 0 THEN ' pro' WHEN 1 THEN ' GOLD' ELSE '' END || ' account' AS instruction,
        'Your ' || CASE c_custkey % 3 WHEN 0 THEN 'Pro' WHEN 1 THEN 'Gold' ELSE 'new' END || ' account is open.' AS response FROM customer
""")
def account_tier(spark, sf_dir):
    """The tier that the instruction names in words fills the response's slot; without one the account is new."""
    asked = F.concat(F.lit("open my"), pick([" pro", " GOLD", ""], F.col("c_custkey")), F.lit(" account"))
    a, b = text.clean_pair(asked, F.lit("Your {{Account Type}} account is open."), F.col("c_custkey"))
    return text.spread(read(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", a.alias("instruction"), b.alias("response"))


@query("SELECT p_partkey, p_name || ' of x costs ' || p_size || ' {y}' AS text FROM part")
def reveal_slots(spark, sf_dir):
    slotted = F.concat(F.lit("{{ "), "p_name", F.lit(" }} of {{x}} costs "), F.col("p_size").cast("string"), F.lit(" {y}"))
    return read(spark, sf_dir, "part").select("p_partkey", text.reveal_slots(slotted).alias("text"))


# --- Histories and prompts ---------------------------------------------------------------------------


def shown(*turns: tuple[str, str]) -> str:
    """SQL of messages in chat form."""
    return " || ".join(f"'<|{role}|>' || chr(10) || {content} || '<|end|>' || chr(10)" for role, content in turns)


@query(f"""
    SELECT p_partkey, {shown(("user", "p_name || '  ' || p_brand"), ("assistant", "p_brand"))} AS blocks,
        {shown(("user", "p_name"))} || CASE WHEN p_partkey % 2 = 0 THEN {shown(("assistant", "p_brand"))} ELSE '' END || {shown(("user", "p_brand"))} AS pairs FROM part
""")
def history_shapes(spark, sf_dir):
    """Histories of blocks and of pairs in the common form; other roles, null contents and empty answers are left out."""
    block = lambda *parts: F.array(*(F.struct(p.cast("string").alias("text")) for p in parts))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    none = F.lit(None)
    blocks = F.array(
        message("user", block(F.col("p_name"), none, F.col("p_brand"))), message("system", block(F.lit("x"))),
        message("assistant", none.cast("array<struct<text:string>>")), message("assistant", block(F.col("p_brand"))),
    )
    pair = lambda a, b: F.struct(a.alias("user"), b.cast("string").alias("assistant"))
    answer = F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(F.lit(""))
    pairs = F.array(pair(F.col("p_name"), answer), pair(F.col("p_brand"), none))
    rows = read(spark, sf_dir, "part")
    return rows.select("p_partkey", history.render(history.messages_from_blocks(blocks)).alias("blocks"), history.render(history.messages_from_pairs(pairs)).alias("pairs"))


ASKED_SQL = "(CASE WHEN p_partkey % 2 = 0 THEN 'Context:' || chr(10) || p_type || chr(10) || chr(10) || 'Question: ' || p_name ELSE p_name END)"
TURNS_SQL = shown(("system", "'Be brief.'"), ("user", "p_brand"), ("assistant", "'Yes.'"), ("user", ASKED_SQL))


@query(f"SELECT p_partkey, {TURNS_SQL} || '<|assistant|>' || chr(10) AS asked, {TURNS_SQL} || {shown(('assistant', 'p_type'))} || '<|endoftext|>' AS whole FROM part")
def prompt_forms(spark, sf_dir):
    """The prompt that a model answers, and the whole example that it is trained on."""
    context = F.when(F.col("p_partkey") % 2 == 0, F.col("p_type"))
    told = F.array(turn("user", F.col("p_brand")), turn("system", "left out"), turn("assistant", "Yes."))
    ask = lambda response: history.prompt(F.col("p_name"), told, context, "Be brief.", response)
    return read(spark, sf_dir, "part").select("p_partkey", ask(None).alias("asked"), ask(F.col("p_type")).alias("whole"))


WORD_LIST = [f"w{i}" for i in range(26)]


@query("""
    WITH t AS (SELECT p_partkey, p_name, p_brand, len(list_filter(string_split_regex(p_name, '\\s+'), lambda w: w <> '')) + len(list_filter(string_split_regex(p_brand, '\\s+'), lambda w: w <> '')) AS n, (p_partkey % 26)::BIGINT AS c FROM part)
    SELECT p_partkey, CASE WHEN n + 3 <= 17 - c THEN p_name || '|' || p_brand || '|a b|c' WHEN 3 <= 17 - c THEN 'a b|c' ELSE '' END AS history,
        array_to_string(list_transform(range(least(c, 17)), lambda i: 'w' || i), ' ') AS context FROM t
""")
def budget_context(spark, sf_dir):
    """The oldest exchanges go first; if that isn't enough, the context keeps its leading words."""
    told = F.array(turn("user", F.col("p_name")), turn("assistant", F.col("p_brand")), turn("user", "a b"), turn("assistant", "c"))
    context = F.array_join(F.slice(F.array(*map(F.lit, WORD_LIST)), F.lit(1), (F.col("p_partkey") % 26).cast("int")), " ")
    fit = history.fit_budget(F.lit("question"), told, context, 20, 2)
    rows = read(spark, sf_dir, "part").select("p_partkey", fit.alias("fit"))
    return rows.select("p_partkey", F.array_join(F.transform("fit.history", lambda m: m["content"]), "|").alias("history"), F.col("fit.context").alias("context"))


@query("SELECT c_custkey, array_to_string(list_sort(list_distinct([c_custkey % 5, c_custkey % 3, 2])), ',') AS ids FROM customer")
def stop_ids(spark, sf_dir):
    ids = F.array(F.col("c_custkey") % 5, F.lit(None), F.col("c_custkey") % 3, F.lit(2), F.lit(None))
    return read(spark, sf_dir, "customer").select("c_custkey", F.array_join(history.stop_ids(ids).cast("array<string>"), ",").alias("ids"))


@query(f"""
    WITH {NORMAL}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM n),
    u AS (SELECT *, coalesce(lag(rn, 2) OVER w, lag(rn, 1) OVER w, rn) AS first FROM r WHERE role = 'user' WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT u.conv_id, u.turn, any_value(u.text) AS text, coalesce(string_agg(r.role || ': ' || r.text, chr(10) ORDER BY r.rn), '') AS history
    FROM u LEFT JOIN r ON r.conv_id = u.conv_id AND r.rn >= u.first AND r.rn < u.rn GROUP BY u.conv_id, u.turn
""")
def chat_state(spark, sf_dir):
    """Each user message of a stream with the last two exchanges, which the chat's state holds."""
    turns = read(spark, sf_dir, "conversations")
    # A stream's path is a folder or a pattern; as a pattern it may be one file as well.
    asked = history.normalize_long(spark.readStream.schema(turns.schema).parquet(f"{sf_dir}/conversations.parque[t]"))
    found = latch.run_available(spark, latch.chat_stream(asked, 2), "chats")
    said = F.array_join(F.transform("history", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
    return found.select("conv_id", "turn", "text", said.alias("history"))


VOCABULARY = ["the", "data", "licen", "e"]


@query("SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(lower(text), '{w}'))::DOUBLE AS {w}" for w in VOCABULARY) + ", 0.5::DOUBLE AS bias FROM documents")
def keyword_vectors(spark, sf_dir):
    """The stand-in embedding: how often each word of a vocabulary occurs, and a constant."""
    rows = read(spark, sf_dir, "documents").select("doc_id", retrieval.keyword_embedding(F.col("text"), VOCABULARY, 0.5).alias("v"))
    return rows.select("doc_id", *(F.get("v", F.lit(i)).alias(w) for i, w in enumerate([*VOCABULARY, "bias"])))


@query()
def near_topk(spark, sf_dir):
    """The five nearest by the approximate index; a test measures what it finds of the exact ones."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    found = retrieval.top_k_near(rows.where("id % 20 = 0"), rows, 5)
    return found.select("query_id", "chunk_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


SIZE, OVERLAP = 1000, 200


def _merged_sql(pieces: str, v: str) -> str:
    """A fold over pieces; ``v`` keeps the names of nested folds apart."""
    total = lambda xs: f"coalesce(list_sum(list_transform({xs}, lambda {v}x: length({v}x))), 0)"
    held, p = f"{v}s.held", f"{v}p.held[1]"
    kept = f"list_filter({held}, lambda {v}h, {v}i: {total(f'{held}[{v}i:]')} <= least({OVERLAP}, {SIZE} - length({p})))"
    step = f"""CASE WHEN len({held}) > 0 AND {total(held)} + length({p}) > {SIZE} THEN {{'out': list_append({v}s.out, array_to_string({held}, '')), 'held': list_append({kept}, {p})}}
        ELSE {{'out': {v}s.out, 'held': list_append({held}, {p})}} END"""
    first = "{'out': []::VARCHAR[], 'held': []::VARCHAR[]}"
    folded = f"list_reduce(list_transform({pieces}, lambda {v}e: {{'out': []::VARCHAR[], 'held': [{v}e]}}), lambda {v}s, {v}p: {step}, {first})"
    strip = lambda c: f"regexp_replace({c}, '^[\\x09-\\x0D\\x20]+|[\\x09-\\x0D\\x20]+$', '', 'g')"
    return f"list_filter(list_transform([{folded}], lambda {v}r: list_transform(list_append({v}r.out, array_to_string({v}r.held, '')), lambda {v}c: {strip(f'{v}c')}))[1], lambda {v}c: {v}c <> '')"


def _pieces_sql(text: str, separators: tuple[str, ...], v: str) -> str:
    sep, finer = separators[0], separators[1:]
    if sep == "":
        return f"regexp_extract_all({text}, '(?s).')"
    quoted = "'" + sep.replace("\n", "' || chr(10) || '") + "'"
    parts = f"list_filter(list_transform(string_split({text}, {quoted}), lambda {v}p, {v}i: CASE WHEN {v}i > 1 THEN {quoted} || {v}p ELSE {v}p END), lambda {v}p: {v}p <> '')"
    cut = f"CASE WHEN length({v}q) <= {SIZE} THEN [{v}q] ELSE {_merged_sql(_pieces_sql(f'{v}q', finer, v + 'n'), v + 'm')} END"
    return f"CASE WHEN contains({text}, {quoted}) THEN flatten(list_transform({parts}, lambda {v}q: {cut})) ELSE {_pieces_sql(text, finer, v + 'o')} END"


CHUNKS_SQL = f"""
    SELECT doc_id, unnest(range(len(chunks))) AS chunk_no, unnest(chunks) AS chunk
    FROM (SELECT doc_id, {_merged_sql(_pieces_sql("t", retrieval.SEPARATORS, "a"), "z")} AS chunks FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
"""


@query(CHUNKS_SQL)
def chunk_recursive(spark, sf_dir):
    """Chunks of at most 1,000 characters, cut at paragraphs, lines and words in this order."""
    return retrieval.recursive_chunks(read(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), F.col("chunk_no").cast("long").alias("chunk_no"), "chunk")


@query(CHUNKS_SQL)
def chunk_folded(spark, sf_dir):
    """The same by one expression in the JVM."""
    return retrieval.folded_chunks(read(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), F.col("chunk_no").cast("long").alias("chunk_no"), "chunk")


# --- Evaluation ------------------------------------------------------------------------------------------


@query("""
    WITH t AS (SELECT doc_id, source, lang, CASE WHEN doc_id % 3 > 0 THEN coalesce(text, '') ELSE '' END AS t FROM documents),
    f AS (SELECT *, list_filter([CASE WHEN NOT (regexp_matches(t, '(?i)licen') OR regexp_matches(t, '(?i)the ')) THEN 'missing: licen | the ' END,
        CASE WHEN regexp_matches(t, '(?i)password') THEN 'forbidden: password' END], lambda x: x IS NOT NULL) AS failures FROM t)
    SELECT doc_id AS id, source AS topic, lang AS question, t <> '' AS answered, array_to_string(failures, '; ') AS failures, len(failures) = 0 AS passed FROM f
""")
def case_scores(spark, sf_dir):
    """Every case beside its answer, two thirds of which there are; the rest counts as empty."""
    docs = read(spark, sf_dir, "documents")
    must, must_not = F.array(F.array(F.lit("licen"), F.lit("the "))), F.array(F.lit("password"))
    cases = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("topic"), F.col("lang").alias("q"), must.alias("must"), must_not.alias("must_not"))
    answers = docs.where("doc_id % 3 > 0").select(F.col("doc_id").alias("id"), F.col("text").alias("answer"))
    return rules.score_cases(cases, answers).select("id", "topic", "question", (F.col("answer") != "").alias("answered"), F.array_join("failures", "; ").alias("failures"), "passed")


@query("SELECT c_custkey FROM customer WHERE c_custkey % 4 IN (0, 1)")
def forbidden_found(spark, sf_dir):
    """Rows that hold an account number where there may be none: half of them, with two that only look like one."""
    written = ["pay to PK36SCBL0000001123456702", "1234-5678-9012, please", "call 1234-567-8901", "ref PK3SCBL"]
    rows = read(spark, sf_dir, "customer").select("c_custkey", pick(written, F.col("c_custkey")).alias("text"))
    return rules.holding(rows, "text").select("c_custkey")


@query("SELECT DISTINCT t AS title FROM (SELECT c_mktsegment AS t FROM customer UNION ALL SELECT 'region ' || c_nationkey FROM customer) WHERE t NOT IN (SELECT c_mktsegment FROM customer WHERE c_nationkey < 3)")
def unknown_references(spark, sf_dir):
    """Titles that rows refer to and the table of titles hasn't."""
    rows = read(spark, sf_dir, "customer")
    used = rows.select(F.array("c_mktsegment", F.concat(F.lit("region "), F.col("c_nationkey").cast("string"))).alias("refs"))
    return rules.unknown_references(used, "refs", rows.where("c_nationkey < 3").select(F.col("c_mktsegment").alias("title")))


@query(f"WITH {ROUGE} SELECT round(avg(f1), 6) AS score, count(*) AS samples FROM (SELECT f1 FROM f ORDER BY conv_id, turn LIMIT 50)")
def evaluation_run(spark, sf_dir):
    """Mean ROUGE-L of a model that repeats the question, over the first 50 exchanges: the number of samples is the feature."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = read(spark, sf_dir, "conversations").withColumn("asked", F.lag("text").over(w)).withColumn("before", F.lag("role").over(w))
    test = rows.where("role = 'assistant' and before = 'user'").select(F.struct("conv_id", "turn").alias("id"), "asked", F.col("text").alias("response"))
    test = test.select(F.format_string("%012d|%012d", "id.conv_id", "id.turn").alias("id"), "asked", "response")
    score = evaluate.evaluate(test, lambda pdf: pdf["asked"].fillna(""), 50)
    return spark.range(1).select(F.lit(round(score, 6)).alias("score"), F.lit(min(50, test.count())).cast("long").alias("samples"))


@query(f"WITH {NORMAL} SELECT conv_id AS chat, turn AS id, 2 * (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) || ' before: ' || text AS answer FROM n WHERE role = 'user'")
def chat_answers(spark, sf_dir):
    """Cases of a chat answered in order, each with the messages before it; the model says how many it was given."""
    asked = history.normalize_long(read(spark, sf_dir, "conversations")).where("role = 'user'")
    cases = asked.select(F.col("conv_id").alias("chat"), F.col("turn").alias("id"), F.col("text").alias("q"))
    return evaluate.answer_conversation(cases, lambda case, chat: f"{len(chat)} before: {case['q']}")
