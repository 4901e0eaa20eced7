"""Splits, rules, evaluation, drift, sources, sinks, streams and the build plan."""

import json

import pytest
from pyspark.sql import functions as F

from loomstone.functions.fixed import FACT_HEADER
from loomstone.operators import draws, evaluate, history, retrieval, rules, splits
from loomstone.plans import answer, build, samples
from loomstone.sources import readers, sinks
from loomstone.streaming import latch

TURNS = "array<struct<role:string,content:string>>"
KB = "# Head\nignored\n\n## Alpha\nBody a\n\nSource: https://x.example/a\n\n## Beta  \n### sub\nBody b\n"


def test_split_holds_out_questions_and_their_histories(spark):
    rows = [(f"q{i}", f"a{i}", []) for i in range(20)] + [(f"follow-up {i}", f"b{i}", [("user", f" Q{i} "), ("assistant", f"a{i}")]) for i in range(20)]
    df = spark.createDataFrame(rows, f"instruction string, response string, history {TURNS}")
    train, test = (t.collect() for t in splits.split_by_question(df, 10, 1))
    asked = {r.instruction for r in test}
    assert len(asked) == 10 and not asked & {r.instruction for r in train}
    assert not [r for r in train if any(m.content.strip().lower() in asked for m in r.history)]
    again = splits.split_by_question(df.repartition(7), 10, 1)[1].collect()
    assert {r.instruction for r in again} == asked
    by_row = splits.split_rows(df, F.col("instruction"), 8, 3)
    assert (by_row[0].count(), by_row[1].count()) == (32, 8)


def test_contamination(spark):
    rows = spark.createDataFrame([("Fine", [("user", " SECRET question "), ("assistant", "x")])], f"instruction string, history {TURNS}")
    asked = spark.createDataFrame([("secret question",), ("other",)], "q string")
    assert [r.q for r in splits.contaminated(asked, rows).collect()] == ["secret question"]
    with pytest.raises(ValueError):
        splits.require_clean(asked, rows)


def test_cases_reports_and_saved_answers(spark, tmp_path):
    cases = spark.createDataFrame([(1, "a", "q1", [["x", "y"], ["z"]], ["bad"]), (2, "a", "q2", [], ["BAD"]), (3, "b", "q3", [["x"]], [])], "id int, topic string, q string, must array<array<string>>, must_not array<string>")
    (tmp_path / "answers.json").write_text(json.dumps({"1": "Y and z", "2": "so bad"}))
    scored = rules.score_cases(cases, readers.read_answers(spark, f"file://{tmp_path}/answers.json"))
    got = {r.id: (r.passed, r.failures) for r in scored.collect()}
    assert got == {1: (True, []), 2: (False, ["forbidden: BAD"]), 3: (False, ["missing: x"])}
    assert [(r.topic, r.passed, r.total) for r in rules.pass_rate(scored).collect()] == [("a", 1, 2), ("b", 0, 1)]
    assert sinks.write_report(scored, "test", f"file://{tmp_path}/out") == 1
    assert "# Evaluation: 1/3 passed" in (tmp_path / "out/report.md").read_text()
    again = rules.score_cases(cases, readers.read_answers(spark, f"file://{tmp_path}/out/report.json"))
    assert {r.id: r.passed for r in again.collect()} == {k: v[0] for k, v in got.items()}


def test_drift_loop_and_logs(spark, tmp_path):
    folder = f"file://{tmp_path}"
    with pytest.raises(FileNotFoundError):
        evaluate.detect_drift(spark, 0.5, folder)
    with pytest.raises(ValueError):
        sinks.Log(spark, folder, None)
    sinks.save_baseline(spark, 0.8, folder)
    log = sinks.Log(spark, folder, "r1")
    scores, trained = iter([0.6, 0.9]), []
    with sinks.trace(log, "run"):
        assert evaluate.run_drift(spark, lambda: next(scores), lambda: trained.append(1), folder, True, log=log)
    assert trained == [1] and sinks.load_baseline(spark, folder) == 0.9
    assert not evaluate.detect_drift(spark, 0.85, folder)
    names = {r.name for r in spark.read.parquet(f"{folder}/events").collect()}
    assert {"run", "accuracy_drift_check", "drift_triggered", "drift_check"} <= names
    assert spark.read.parquet(f"{folder}/metrics").count() == 3
    sinks.Log(spark).event("nothing")
    edge = spark.range(1).select(evaluate.drift(F.lit(0.10), F.lit(0.0)).alias("d")).first().d
    assert edge.decision == "warn"


def test_rouge(spark):
    assert evaluate.lcs_length("a b c d".split(), "b x d a".split()) == 2
    df = spark.createDataFrame([(1, "The cat sat.", "the cat ran"), (2, "", "x"), (3, None, None)], "id int, prediction string, response string")
    assert [round(r.rouge_l, 4) for r in evaluate.with_rouge_l(df).orderBy("id").collect()] == [0.6667, 0.0, 0.0]
    assert round(evaluate.evaluate(df.drop("prediction"), lambda b: b["response"], 1), 4) == 1.0


def test_sources(spark, tmp_path):
    (tmp_path / "kb.md").write_text(KB)
    (tmp_path / "a.yaml").write_text("x: {a: 1}\ny: {b: {c: 2}, e: {}}\n")
    (tmp_path / "b.yaml").write_text("x: {z: 3}\n")
    got = readers.read_sections(spark, f"file://{tmp_path}/kb.md").orderBy("no").collect()
    assert [(r.title, r.content, r.source) for r in got] == [("Alpha", "## Alpha\nBody a\n\nSource: https://x.example/a", "https://x.example/a"), ("Beta", "## Beta\n### sub\nBody b", None)]
    docs = readers.union_documents(spark, [f"file://{tmp_path}/kb.md"]).collect()
    assert docs[1].metadata == {"title": "Beta", "source": f"file://{tmp_path}/kb.md"}
    with pytest.warns(UserWarning):
        assert readers.read_documents(spark, f"file://{tmp_path}/none.md").count() == 0
    with pytest.warns(UserWarning):
        assert readers.read_documents(spark, "x.docx").count() == 0
    with pytest.warns(UserWarning):
        cfg = readers.config([f"{tmp_path}/a.yaml", f"{tmp_path}/b.yaml", f"{tmp_path}/c.yaml"], {"OUTPUT_DIR": "/o"})
    assert readers.flatten(cfg) == {"x.z": 3, "y.b.c": 2, "training.output_dir": "/o"}
    with pytest.raises(FileNotFoundError):
        readers.read_rows(spark, f"file://{tmp_path}/rows.jsonl")


def test_jsonl_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("q", "è", None, None, "c", "i")], readers.ROWS)
    sinks.write_jsonl(rows, f"file://{tmp_path}/rows.jsonl")
    back = readers.read_rows(spark, f"file://{tmp_path}/rows.jsonl").first()
    assert (back.response, back.context, back.history) == ("è", "", [])


def test_row_text_reads_nulls(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert df.select(readers.row_text(df).alias("t")).first().t == "a: 1, b: nan"


def test_retrieval_with_keyword_vectors(spark):
    words = ["drone", "camera", "laptop"]
    docs = spark.createDataFrame([(1, "drone camera"), (2, "laptop laptop"), (3, "nothing here")], "id long, text string")
    embed = lambda c: retrieval.keyword_embedding(c, words)
    chunks = docs.withColumn("embedding", embed(F.col("text")))
    asked = spark.createDataFrame([(10, "a laptop please"), (11, "reset my password")], "id long, q string")
    got = retrieval.retrieve(asked.select("id", embed(F.col("q")).alias("embedding")), chunks, 1, 0.95)
    assert {r.query_id: r.context for r in got.collect()} == {10: "laptop laptop", 11: "nothing here"}
    none = retrieval.retrieve(asked.select("id", embed(F.col("q")).alias("embedding")), chunks.where("id < 3"), 2, 0.95)
    assert {r.query_id: r.context for r in none.collect()}[11] == ""
    with pytest.raises(RuntimeError):
        retrieval.retrieve(asked, None)


def test_answer_plan(spark):
    words = ["inspection", "fee"]
    embed = lambda c: retrieval.keyword_embedding(c, words)
    chunks = spark.createDataFrame([(1, "## Inspection\ninspection PKR 4,950")], "id long, text string").withColumn("embedding", embed(F.col("text")))
    asked = spark.createDataFrame([(1, "Inspection fee for an Alto?", []), (2, "Tell me a joke", [("user", "hi"), ("assistant", "yo")])], f"id long, message string, history {TURNS}")
    prompts = answer.prompts(asked, chunks, embed, "sys", min_similarity=0.5, budget=800)
    rows = {r.id: r for r in answer.answers(prompts, lambda b: b["id"].map({1: "It costs PKR 4,950.", 2: "It costs PKR 1."})).collect()}
    assert rows[1].context.startswith(FACT_HEADER) and rows[1].answer == "It costs PKR 4,950."
    assert rows[2].answer.startswith("I don't have a confirmed figure")


def test_draws_do_not_depend_on_partitions(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("g"))
    pick = lambda d: sorted(r.id for r in draws.sample_per_group(d, "g", "id", 5, 1).collect())
    assert pick(df) == pick(df.repartition(9)) and len(pick(df)) == 15
    share = df.where(draws.chance(0.3, 2, F.col("id"))).count()
    assert 250 < share < 350


INTENTS = [
    ("fees", "SELLING", ["fee of alpha?", "alpha price?", "how much is alpha?"], ["See the page."], ["Alpha"], None, ["It is 4."], None, "Beta"),
    ("beta_info", "INFO", ["what is beta?", "tell me of beta", "beta?", "beta now?", "beta again?"], ["Beta is b."], ["Beta"], None, None, None, None),
    ("hello", "GENERAL", ["hi", "hello", "salam"], ["Hello!", "Hi!"], None, None, None, None, None),
]


def test_build_plan(spark, tmp_path):
    intents = spark.createDataFrame(INTENTS, build.INTENT)
    kb = build.Sections({"Alpha": "## Alpha\na", "Beta": "## Beta\nb", "Gamma": "## Gamma\nc"}, {"Alpha": ["Beta"]}, 42)
    base = build.intent_segments(intents, kb)
    count = {r.segment: r["count"] for r in base.groupBy("segment").count().collect()}
    assert count == {"plain": 11, "irrelevant": 2, "grounded": 3 + 4, "wrong": 4}
    assert build.retrieval_misses(intents, kb, 2).count() == 2
    subjects = spark.createDataFrame([(c, f"About {c}.") for c in "abcd"], "subject string, answer string")
    turns = build.follow_ups(subjects, ["Price of {x}?"], ["And {x}?", "What about {x}?"], "Alpha", kb, 5)
    assert turns.count() == 5 and turns.where("size(history) = 2").count() == 5
    switches = build.topic_switches(base.where("segment in ('grounded', 'irrelevant')"), kb, 6)
    got = switches.collect()
    assert 0 < len(got) <= 6 and all([m.role for m in r.history] in (["user", "assistant"], ["user", "assistant"] * 2) for r in got)
    known = spark.createDataFrame([("Inspection for an Alto?", "dunno", "", [], "c", "i", "specific", None)], "instruction string, response string, context string, history " + TURNS + ", category string, intent string, segment string, title string")
    told = build.verified(known).first()
    assert told.overridden and "PKR 4,950" in told.response and told.context.startswith(FACT_HEADER)
    stats = build.write_dataset(build.verified(build.union_all(base, turns, switches)), f"file://{tmp_path}/d.jsonl")
    assert stats["rows"] == readers.read_rows(spark, f"file://{tmp_path}/d.jsonl").count()
    with pytest.raises(KeyError):
        rules.require_known(intents.select(F.array(F.lit("Delta")).alias("kb")), "kb", spark.createDataFrame([("Alpha",)], "title string"))


def test_latch_batch_and_stream_agree(spark, tmp_path):
    frags = [("r1", 0, "It costs ", False), ("r1", 1, "PKR 5", False), ("r1", 2, ",000 now", True), ("r2", 0, "Hello {{Name}}", False), ("r2", 1, "!", True)]
    schema = "reply_id string, seq long, token string, end boolean"
    df = spark.createDataFrame(frags, schema)
    batch = {(r.reply_id, r.seq): r.text for r in latch.latch(df).where("shown").collect()}
    assert batch == {("r1", 0): "It costs ", ("r2", 0): "Hello Name", ("r2", 1): "Hello Name!"}
    df.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = latch.latch_stream(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("latched").option("checkpointLocation", f"file://{tmp_path}/cp").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    rows = spark.table("latched").collect()
    assert {(r.reply_id, r.seq): r.text for r in rows if not r.final} == {k: v for k, v in batch.items() if k != ("r2", 1)}
    assert {r.reply_id: r.text for r in rows if r.final} == {"r1": "It costs PKR 5,000 now", "r2": "Hello Name!"}


def test_conversation_answers_see_the_chat(spark):
    cases = spark.createDataFrame([("c", 2, "b", None), ("c", 1, "a", None), ("c", 3, "d", [("user", "own")])], f"chat string, id int, q string, history {TURNS}")
    got = evaluate.answer_conversation(cases, lambda case, chat: f"{case['q']}{len(chat)}").collect()
    assert {r.id: r.answer for r in got} == {1: "a0", 2: "b2", 3: "d1"}


def test_generators_have_the_rows_their_lists_give(spark):
    from loomstone.functions import facts
    from loomstone.plans.generators import Generators

    rows = Generators(spark).all()
    count = {r.intent: r["count"] for r in rows.groupBy("intent").count().collect()}
    assert count == {
        "inspection_price_specific": 26 * 2 + 17 * 2 + 2, "sifm_fee_specific": 26 + 18 * 2 + 2, "sifm_commission": 9 * 2 + 8, "featured_price_specific": 6 + 2,
        "city_eligibility": 22 + 15, "transfer_city": 3 * 3 + 7, "sifm_model_year": 9 + 3, "auction_fee_unknown": 5, "autostore_returns": 6 + 4 + 3 + 3,
    }
    assert rows.select("instruction").distinct().count() == sum(count.values())
    # each answer is what reading the question gives
    told = F.array_join(F.transform(facts.detect(F.col("instruction")), lambda f: f["text"]), " ")
    rows = rows.where("intent != 'autostore_returns'")
    wrong = rows.withColumn("told", told).where(~F.contains("told", "response")).collect()
    # a month reads as 28 days, whose sentence then replaces the month's
    assert not [(r.instruction, r.response, r.told) for r in wrong if "month" not in r.instruction] and len(wrong) == 1


def test_the_whole_build(spark):
    from loomstone.plans.generators import TITLES, Generators

    made = Generators(spark)
    questions = made.all().cache()
    kb = build.Sections({t: f"## {t}\nbody of {t}" for t in [*TITLES.values(), "Alpha", "Beta"]}, {"Alpha": ["Beta"], TITLES["inspection"]: [TITLES["sifm"]]}, 42)
    intents = spark.createDataFrame([(*r[:4], [t for t in r[4] or [] if t != "Gamma"], *r[5:]) for r in INTENTS], build.INTENT)
    gaps = spark.createDataFrame([("Is there parking at night?", "Alpha", "That isn't in my information.", "C", "parking")], "instruction string, title string, response string, category string, intent string")
    protected = spark.createDataFrame([("a question that only the evaluation asks",)], "q string")
    rows = build.build(intents, questions, made.chats(kb), gaps, kb, protected).cache()
    count = {r.segment: r["count"] for r in rows.groupBy("segment").count().collect()}
    assert count["follow_up"] == 2 * 10 + 3 * 10 + 3 and count["gap"] == 1 and count["specific"] == questions.count()
    assert {"plain", "irrelevant", "grounded", "wrong", "miss", "specific", "follow_up", "gap", "switch"} == set(count)
    # a verified answer leads the context and is what the row replies
    for r in rows.collect():
        assert r.instruction and r.response and "{" not in r.instruction + r.response
        assert r.context.startswith(FACT_HEADER) or not r.overridden
        roles = [m.role for m in r.history]
        assert roles == ["user", "assistant"] * (len(roles) // 2) and len(roles) <= 4 and (len(roles) > 0) is (r.segment in ("follow_up", "switch"))
    asked = rows.where("segment = 'plain'").first().instruction
    with pytest.raises(ValueError):
        build.build(intents, questions, [], gaps, kb, spark.createDataFrame([(asked,)], "q string"))


def test_switches_find_the_only_look_alike_of_a_large_pool(spark):
    kb = build.Sections({"Alpha": "a", "Beta": "b", "Gamma": "c"}, {"Alpha": ["Beta"]}, 1)
    none = []
    rows = [(f"q{i}", "r", "", none, "c", f"g{i % 50}", "grounded", "Gamma") for i in range(3000)] + [("the one", "told", "", none, "c", "beta", "grounded", "Beta")]
    current = [(f"a{i}", "r", "", none, "c", "alpha", "grounded", "Alpha") for i in range(4000)]
    pool = spark.createDataFrame(rows + current, f"instruction string, response string, context string, history {TURNS}, category string, intent string, segment string, title string")
    got = build.topic_switches(pool, kb, 60).where("title = 'Alpha'").collect()
    assert got and all(r.history[0].content == "the one" for r in got)


def test_top_k_in_blocks_equals_one_pass(spark, monkeypatch):
    rows = spark.range(300).select("id", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.sin(F.col("id") * i)).alias("embedding"))
    rows = rows.unionByName(spark.createDataFrame([(1000, [0.0] * 8), (1001, None), (None, [1.0] * 8)], "id long, embedding array<double>"))
    for same in (True, False):
        one = sorted(map(tuple, retrieval.top_k(rows, rows, 4, same=same).collect()))
        with monkeypatch.context() as m:
            m.setattr(retrieval, "BLOCK", 64)
            m.setattr(retrieval, "BLOCK_BYTES", 8 * 8 * 64)
            m.setattr(retrieval, "READ", 90)
            m.setattr(retrieval, "TILE", 500)
            blocks = sorted(map(tuple, retrieval.top_k(rows, rows, 4, same=same).collect()))
        assert [r[:2] + r[3:] for r in one] == [r[:2] + r[3:] for r in blocks] and len(one) == 299 * 4  # sin(0) gives a norm of 0


def test_latch_reads_figures_across_fragments(spark):
    rows = [(r, i, t) for r, tokens in {"a": ["It is ", "PK", "R 9", "00", " now"], "b": ["no ", None, "figure {{ here }}"], "c": ["1", "2", " %"], "d": ["x" * 5000, "y 7%"], None: ["5", "%"]}.items() for i, t in enumerate(tokens)]
    df = spark.createDataFrame(rows, "reply_id string, seq long, token string")
    got = {}
    for r in latch.latch(df).orderBy("seq").collect():
        got.setdefault(r.reply_id, []).append((r.shown, r.chars, r.text))
    assert [s for s, _, _ in got["a"]] == [True, True, False, False, False] and [s for s, _, _ in got["b"]] == [True] * 3
    assert got["b"][-1][1:] == (14, "no figure here") and [s for s, _, _ in got["c"]] == [True, True, False]
    assert [s for s, _, _ in got["d"]] == [True, False] and [s for s, _, _ in got[None]] == [True, False]
    assert {(r.reply_id, r.seq): r.chars for r in latch.latch(df, with_text=False).collect()} == {(k, i): c for k, v in got.items() for i, (_, c, _) in enumerate(v)}


def test_near_index_finds_the_exact_neighbours(spark, monkeypatch):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    asked = rows.where("id % 20 = 0")
    pairs = lambda found: {(r.query_id, r.chunk_id) for r in found.select("query_id", "chunk_id").collect()}
    exact, near = pairs(retrieval.top_k(asked, rows, 5)), pairs(retrieval.top_k_near(asked, rows, 5))
    assert len(exact & near) >= 0.9 * len(exact)
    centres = retrieval.fit_cells(rows)
    assert retrieval.with_cells(rows, centres).count() == rows.count()
    # A look into every cell is the exact search, in blocks of any size.
    monkeypatch.setattr(retrieval, "BLOCK", 16)
    monkeypatch.setattr(retrieval, "CHUNKS", 50)
    assert pairs(retrieval.top_k_near(asked, rows, 5, cells=8, probes=8)) == exact
    none = spark.createDataFrame([(1, None), (None, [1.0] * 64)], "id long, embedding array<double>")
    assert retrieval.top_k_near(asked, none, 5).count() == 0 and retrieval.top_k_near(none, rows, 5).count() == 0
    zero = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0])], "id long, embedding array<double>")
    assert pairs(retrieval.top_k_near(zero, zero, 3)) == {(2, 2)}


def test_columns_of_like_names_are_kept(spark):
    names = ["rank_in_group", "users_since", "users_wanted", "value_held", "tokens_since", "first_turn", "own_key", "key", "_d", "_r"]
    turns = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}", *["x"] * len(names)) for i in range(4)], ["conv_id", "turn", "role", "text", *names])
    kept = lambda df: all(set(names) <= set(df.columns) and r.own_key == "x" and r.rank_in_group == "x" for r in df.collect())
    assert kept(history.recent_long(turns, 1)) and kept(history.trim_long(turns, 10))
    assert kept(history.carry_forward(turns, F.array("text"), "held")) and kept(draws.sample_per_group(turns, "conv_id", "turn", 2, 1))
    train, test = splits.split_by_question(turns, 2, 1, "text")
    assert kept(train) and kept(test) and (train.count(), test.count()) == (2, 2)
    assert sum(d.count() for d in splits.split_rows(turns, F.col("turn"), 1, 1)) == 4


def test_sample_tables_name_known_sections(spark):
    t = samples.tables(spark)
    known = spark.createDataFrame([(s,) for s in samples.SECTIONS], "title string")
    for rows, column in ((t["intents"].where("kb is not null"), "kb"), (t["gaps"].select(F.array("title").alias("kb")), "kb"), (t["probes"].where("title is not null").select(F.array("title").alias("kb")), "kb")):
        rules.require_known(rows, column, known)
    assert not set(sum(samples.ALIKE.values(), [*samples.ALIKE])) - set(samples.SECTIONS)
    assert splits.contaminated(t["protected"], t["intents"].select(F.explode("questions").alias("instruction"))).count() == 0
