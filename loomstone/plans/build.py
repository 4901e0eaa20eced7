"""Training rows from intents, templates and Markdown sections.

Intents, templates and look-alike sections are tables given by the caller.
Every draw is a row's digest with the seed, so the result doesn't depend on
partitioning. Segments: plain, irrelevant context, grounded, wrong section,
retrieval miss, context gap, specific, follow-up, topic switch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions import facts, fixed
from loomstone.functions.fixed import Domain
from loomstone.functions.text import fill, fresh
from loomstone.operators import draws, splits
from loomstone.sources import sinks

INTENT = (
    "intent string, category string, questions array<string>, responses array<string>, kb array<string>, near array<string>, "
    "context_responses array<string>, ground_all boolean, hard_distractor string"
)
ROW = ("instruction", "response", "context", "history", "category", "intent")

# --- Fixed values: rates and sizes of the segments --------------------------------
RATES = {"context": 0.6, "confusable": 0.6, "hard": 0.8, "no_context_switch": 0.35, "two_turns": 0.3}
SIZES = {"grounded": 4, "irrelevant": 2, "wrong": 2, "misses": 15, "switches": 120, "follow_ups": 10}


def cross(templates: DataFrame, entities: DataFrame, name: str, template: str = "template", out: str = "question") -> DataFrame:
    """Every template with every entity put in its ``{name}`` place. Both are hand-written lists; Spark broadcasts the one that is small enough."""
    return templates.join(entities, how="cross").withColumn(out, F.replace(F.col(template), F.lit(f"{{{name}}}"), F.col(name).cast("string")))


def sample_templates(templates: DataFrame, entities: DataFrame, name: str, k: int, seed: int) -> DataFrame:
    """k templates of each entity, filled in."""
    pairs = cross(templates, entities, name)
    return draws.sample_per_group(pairs, name, "question", k, seed)


def verified(rows: DataFrame, domain: Domain = Domain()) -> DataFrame:
    """Rows with their verified facts first in the context; a response without them is replaced and marked ``overridden``."""
    found, told = fresh(rows, "found_facts"), fresh(rows, "told_facts")
    rows = rows.withColumn(found, facts.detect(F.col("instruction"), F.col("history"), domain)).withColumn(told, F.array_join(F.transform(found, lambda f: f["text"]), " "))
    rows = rows.withColumn("overridden", (F.size(found) > 0) & ~F.contains(F.col("response"), F.col(told)))
    rows = rows.withColumn("context", facts.build_context(F.col(found), F.col("context")))
    return rows.withColumn("response", F.when(F.col("overridden"), F.col(told)).otherwise(F.col("response"))).drop(found, told)


class Sections:
    """Section texts by title and their look-alikes, as literal maps: a knowledge base is a hand-written file of a few dozen sections."""

    def __init__(self, by_title: dict[str, str], alike: dict[str, list[str]], seed: int) -> None:
        self.by_title, self.alike, self.seed = by_title, alike, seed
        pairs = [F.lit(x) for kv in by_title.items() for x in kv]
        self.texts = F.create_map(*pairs)
        self.titles = F.array(*map(F.lit, by_title))
        looks = [x for t, v in alike.items() for x in (F.lit(t), F.array(*map(F.lit, v)))]
        self.looks = F.create_map(*looks) if looks else F.create_map().cast("map<string,array<string>>")

    def text(self, title: Column) -> Column:
        return F.element_at(self.texts, title)

    def distractor(self, own: Column, key: Column) -> Column:
        """A look-alike of the row's sections most of the time, else any other section."""
        looks = F.array_except(F.flatten(F.transform(own, lambda t: F.coalesce(F.element_at(self.looks, t), F.array().cast("array<string>")))), own)
        other = draws.choose(F.array_except(self.titles, own), self.seed, key, F.lit("other"))
        near = draws.choose(looks, self.seed, key, F.lit("alike"))
        return F.when((F.size(looks) > 0) & draws.chance(RATES["confusable"], self.seed, key, F.lit("c")), near).otherwise(other)

    def grounded(self, own: Column, key: Column, hard: Column | None = None) -> Column:
        """The row's own sections, often with a distractor, in drawn order."""
        extra = self.distractor(own, key)
        if hard is not None:
            extra = F.when(hard.isNotNull() & draws.chance(RATES["hard"], self.seed, key, F.lit("h")), hard).otherwise(extra)
        more = draws.shuffled(F.concat(own, F.array(extra)), self.seed, key)
        chosen = F.when(draws.chance(RATES["context"], self.seed, key, F.lit("g")), more).otherwise(own)
        return F.array_join(F.transform(chosen, self.text), fixed.CONTEXT_BREAK)


def segment_rows(df: DataFrame, segment: str, title: Column | None = None) -> DataFrame:
    none = F.array().cast("array<struct<role:string,content:string>>")
    history = F.col("history") if "history" in df.columns else none
    title = F.lit(None).cast("string") if title is None else title
    return df.select("instruction", "response", F.coalesce("context", F.lit("")).alias("context"), F.coalesce(history, none).alias("history"), "category", "intent", F.lit(segment).alias("segment"), title.alias("title"))


def intent_segments(intents: DataFrame, sections: Sections) -> DataFrame:
    """Plain, irrelevant-context, grounded and wrong-section rows of the intents."""
    seed = sections.seed
    asked = intents.select("*", F.explode("questions").alias("instruction")).withColumn("_k", F.concat_ws("|", "intent", "instruction"))
    own, near = F.coalesce("kb", F.array().cast("array<string>")), F.coalesce("near", F.array().cast("array<string>"))
    asked = asked.withColumn("_own", own).withColumn("_near", near)
    reply = lambda tag: draws.choose(F.col("responses"), seed, F.col("_k"), F.lit(tag))
    whole = F.coalesce("ground_all", F.lit(False))
    some = lambda rows, k: draws.sample_per_group(rows, "intent", "_k", k, seed)

    plain = asked.withColumn("response", reply("plain")).withColumn("context", F.lit(""))
    bare, grounded = asked.where(F.size("_own") == 0), asked.where(F.size("_own") > 0)
    picked = bare.where(whole).unionByName(some(bare.where(~whole), SIZES["irrelevant"]))
    pool = draws.shuffled(F.when(F.size("_near") > 0, F.col("_near")).otherwise(sections.titles), seed, F.col("_k"))
    n = F.when(draws.chance(0.5, seed, F.col("_k"), F.lit("n")), 1).otherwise(2)
    irrelevant = picked.withColumn("response", reply("irrelevant")).withColumn("context", F.array_join(F.transform(F.slice(pool, F.lit(1), n), sections.text), fixed.CONTEXT_BREAK))
    figures = F.col("context_responses").isNotNull()
    picked = grounded.where(figures | whole).unionByName(some(grounded.where(~(figures | whole)), SIZES["grounded"]))
    replies = F.coalesce("context_responses", "responses")
    right = picked.withColumn("response", draws.choose(replies, seed, F.col("_k"), F.lit("grounded"))).withColumn("context", sections.grounded(F.col("_own"), F.col("_k"), F.col("hard_distractor")))
    wrong = some(grounded, SIZES["wrong"]).withColumn("response", reply("wrong")).withColumn("context", sections.text(sections.distractor(F.col("_own"), F.concat_ws("|", "_k", F.lit("wrong")))))
    return (
        segment_rows(plain, "plain").unionByName(segment_rows(irrelevant, "irrelevant")).unionByName(segment_rows(right, "grounded", F.get("_own", 0))).unionByName(segment_rows(wrong, "wrong"))
    )


def retrieval_misses(intents: DataFrame, sections: Sections, n: int = SIZES["misses"]) -> DataFrame:
    """Questions of intents with figures beside a section that isn't theirs, answered without figures."""
    seed = sections.seed
    rows = intents.where("context_responses is not null").select("*", F.explode("questions").alias("instruction"))
    rows = rows.withColumn("_k", F.concat_ws("|", "intent", "instruction", F.lit("miss"))).orderBy(draws.digest(seed, F.col("_k")), "_k").limit(n)
    other = draws.choose(F.array_except(sections.titles, F.col("kb")), seed, F.col("_k"))
    return segment_rows(rows.withColumn("response", draws.choose(F.col("responses"), seed, F.col("_k"))).withColumn("context", sections.text(other)), "miss")


def specific(questions: DataFrame, sections: Sections) -> DataFrame:
    """Rows of generated questions (instruction, response, title, category, intent), grounded in their section."""
    rows = questions.withColumn("context", sections.grounded(F.array("title"), F.concat_ws("|", "intent", "instruction")))
    return segment_rows(rows, "specific", F.col("title"))


def follow_ups(subjects: DataFrame, first: list[str], then: list[str], title: str, sections: Sections, n: int = SIZES["follow_ups"], group: str = "service") -> DataFrame:
    """n two-turn chats: a question on one subject and its answer, then a short follow-up on another.

    ``subjects``: (subject, answer), a hand-written list that goes to each row; a row draws its two by its number.
    """
    seed, spark = sections.seed, subjects.sparkSession
    listed = subjects.agg(F.array_sort(F.collect_list(F.struct("subject", "answer"))).alias("s"))
    rows = spark.range(n).join(F.broadcast(listed), how="cross").withColumn("_k", F.concat_ws("|", F.lit(group), "id"))
    rows = rows.withColumn("a", draws.choose(F.col("s"), seed, F.col("_k"), F.lit("a")))
    rows = rows.withColumn("b", draws.choose(F.filter("s", lambda x: x["subject"] != F.col("a.subject")), seed, F.col("_k"), F.lit("b")))
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    pick = lambda templates, x, tag: draws.choose(F.array(*(fill(t, x=x) for t in templates)), seed, F.col("_k"), F.lit(tag))
    history = F.array(turn("user", pick(first, F.col("a.subject"), "first")), turn("assistant", F.col("a.answer")))
    rows = rows.where("b is not null").select(
        "_k", pick(then, F.col("b.subject"), "then").alias("instruction"), F.col("b.answer").alias("response"), history.alias("history"), F.lit("FOLLOW_UP").alias("category"), F.lit("follow_up").alias("intent")
    )
    return segment_rows(rows.withColumn("context", sections.grounded(F.array(F.lit(title)), F.col("_k"))), "follow_up", F.lit(title))


def context_gaps(rows: DataFrame, sections: Sections) -> DataFrame:
    """Questions (instruction, title, response, category, intent) whose answer their section doesn't hold: the section alone is the context."""
    return segment_rows(rows.withColumn("context", sections.text(F.col("title"))), "gap", F.col("title"))


def pick_others(pairs: DataFrame, key: str, alike: str, other: Column, k: int, seed: int) -> DataFrame:
    """At most k partners of each key, look-alikes first, then by the digest of both."""
    r = fresh(pairs, "rank_in_group")
    w = Window.partitionBy(key).orderBy(F.col(alike).desc(), draws.digest(seed, F.col(key), other))
    return pairs.withColumn(r, F.row_number().over(w)).where(F.col(r) <= k).drop(r)


def topic_switches(pool: DataFrame, sections: Sections, n: int = SIZES["switches"]) -> DataFrame:
    """n rows of the pool after one or two earlier exchanges on other intents, of a look-alike section where there is one.

    The pool is the training set being built. A current row meets all rows of
    its look-alike sections, by equality of titles; where those have fewer than
    two of other intents, it meets two rows of each intent beside them.
    """
    seed = sections.seed
    key = F.concat_ws("|", "intent", "instruction", "segment")
    keyed = pool.withColumn("_k", key).dropDuplicates(["_k"])
    with_section, without = keyed.where("title is not null"), keyed.where("title is null")
    drawn = lambda rows, tag, k: rows.orderBy(draws.digest(f"{seed}{tag}", F.col("_k")), "_k").limit(k)
    bare = round(n * RATES["no_context_switch"])
    current = drawn(without, "c", bare).unionByName(drawn(with_section, "c", n - bare))
    other = with_section.select(F.col("_k").alias("_k2"), F.col("intent").alias("intent2"), F.col("title").alias("title2"), F.col("instruction").alias("q2"), F.col("response").alias("a2"))
    asking = current.select("_k", "intent", F.explode(F.coalesce(F.element_at(sections.looks, F.col("title")), F.array().cast("array<string>"))).alias("title2"))
    alike = asking.distinct().join(other, "title2").where("intent != intent2")
    some = draws.sample_per_group(other, "intent2", "_k2", 2, f"{seed}o")
    any_other = current.select("_k", "intent").join(some, F.col("intent") != F.col("intent2"))
    pair = lambda rows, far: rows.select("_k", F.lit(far).alias("far"), "_k2", "q2", "a2")
    w = Window.partitionBy("_k").orderBy("far", "d", "_k2")
    # A row that is met both ways comes first as a look-alike; the other way it is dropped.
    met = pair(alike, False).unionByName(pair(any_other.join(alike.select("_k", "_k2"), ["_k", "_k2"], "left_anti"), True))
    ranked = met.withColumn("d", draws.digest(seed, F.col("_k"), F.col("_k2"))).withColumn("r", F.row_number().over(w)).where("r <= 2")
    ranked = ranked.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("r", "q2", "a2"))).alias("ps"))
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    count = F.when(draws.chance(RATES["two_turns"], seed, F.col("_k"), F.lit("two")), 2).otherwise(1)
    history = F.flatten(F.transform(F.slice("ps", F.lit(1), count), lambda p: F.array(turn("user", p["q2"]), turn("assistant", p["a2"]))))
    rows = current.drop("history").join(ranked.select("_k", history.alias("history")), "_k")
    return segment_rows(rows.withColumn("context", facts.strip_fact_block(F.col("context"))), "switch", F.col("title"))


def union_all(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_dataset(rows: DataFrame, path: str, seed: int = 42) -> dict:
    """Rows in drawn order as JSON lines; returns the counts of rows, contexts, verified answers and intents."""
    key = F.concat_ws("|", "intent", "instruction", "context", "response")
    kept = draws.shuffle_rows(rows, key, seed).select(*ROW)
    sinks.write_jsonl(kept, path)
    return sinks.summary(rows, fixed.FACT_HEADER).first().asDict()


def cut(rows: DataFrame) -> DataFrame:
    """The rows without their lineage, in the session's checkpoint folder; as they are where it has none."""
    return rows.checkpoint() if rows.sparkSession.sparkContext.getCheckpointDir() else rows


def build(intents: DataFrame, questions: DataFrame, chats: list[DataFrame], gaps: DataFrame, sections: Sections, protected: DataFrame, domain: Domain = Domain()) -> DataFrame:
    """All segments' rows, verified, in the order in which they are to be trained on.

    ``questions``: rows of the generators; ``chats``: follow-up rows; ``gaps``:
    see ``context_gaps``; ``protected``: (q) questions of evaluation, none of
    which may be asked by a row or its history. The pool of topic switches are
    the single-turn rows that answer their own question.
    """
    base = cut(intent_segments(intents, sections).unionByName(specific(questions, sections)))
    misses = union_all(retrieval_misses(intents, sections), context_gaps(gaps, sections))
    pool = base.where("segment in ('plain', 'irrelevant', 'grounded', 'specific')")
    asked = cut(union_all(base, misses, *chats, topic_switches(pool, sections)))
    splits.require_clean(protected, asked)
    # Dealt, so that the facts are worked out on the rows and not in each segment's own plan.
    rows = verified(asked.repartition("intent", "instruction"), domain)
    return draws.shuffle_rows(rows, F.concat_ws("|", "intent", "instruction", "context", "response"), sections.seed)
