"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned: words and word heads, after undoing common
obfuscations, that labelled toxic texts use far more often than others. Texts
become densities of lexicon hits, their nearness to second-person words, and
rates of capitals, punctuation and obfuscation. Features of a training text
come from a lexicon that its fold didn't help to learn, and the calibration is
fitted on scores of trees that did not see the text's fold.

Labels come from a bounded sample (``SAMPLE`` labelled rows by hash). Counting,
features and scoring run on the executors; the driver gets at most ``ENTRIES``
lexicon candidates and ``SAMPLE`` rows of numbers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm import trees
from loomstone.llm.common import drawn_share, map_arrow, store, text_or_empty

SAMPLE = 8000
ENTRIES = 3000
LEXICON = 400
FOLDS = 3
TOXIC_AT = 0.7
HEADS = (4, 5, 6)
NEAR = 6

#: Second-person words of the languages at hand.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros os vuestro".split())
#: Characters that stand for letters in obfuscated words.
LEET = str.maketrans("013457@$€", "oieastase")
SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][ .\-_*]){3,}[^\W\d_](?!\w)")
STRIP = ".,;:!?\"'()[]{}<>|#%&*…„“”«»"


def plain(token: str) -> tuple[str, bool]:
    """The word behind a token, and whether it was obfuscated: digits or signs for letters, signs inside, letters drawn out."""
    word = token.strip(STRIP).lower()
    if word.isalpha():
        bare = word
    elif any(c.isalpha() for c in word):
        bare = "".join(c for c in word.translate(LEET) if c.isalpha())
    else:
        return "", False
    bare = re.sub(r"(.)\1{2,}", r"\1", bare)
    return bare, bare != word


def forms(word: str) -> list[str]:
    """A word and its heads, marked by a star."""
    return [word, *(f"{word[:k]}*" for k in HEADS if len(word) > k)] if len(word) >= 3 else []


def tokens_of(text: str) -> list[str]:
    """Tokens between white space; spelled-out words (l i k e t h i s) follow as one token each."""
    return text.split() + [re.sub(r"[ .\-_*]", "", x) for x in SPACED.findall(text)]


@dataclass
class Traits:
    weight: float
    hit: bool
    second: bool
    capital: bool
    masked: bool


class Reader:
    """Features of a text under a lexicon. At most 200,000 tokens' traits are held."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.lexicon = lexicon
        self.held: dict[str, Traits] = {}

    def traits(self, token: str) -> Traits:
        word, masked = plain(token)
        weight = max((self.lexicon.get(f, 0.0) for f in forms(word)), default=0.0)
        return Traits(weight, weight > 0, word in SECOND, len(token) > 2 and token.isupper(), masked)

    def __call__(self, text: str) -> list[float]:
        tokens = tokens_of(text)
        held = self.held
        if len(held) > 200_000:
            held.clear()
        counts = Counter(tokens)
        n = max(1, len(tokens))
        weight = top = 0.0
        hits = distinct = seconds = capitals = masked = masked_hits = loud_hits = 0
        for token, c in counts.items():
            t = held.get(token)
            if t is None:
                t = held[token] = self.traits(token)
            if t.hit:
                hits += c
                distinct += 1
                weight += c * t.weight
                top = max(top, t.weight)
                masked_hits += c * t.masked
                loud_hits += c * t.capital
            seconds += c * t.second
            capitals += c * t.capital
            masked += c * t.masked
        near = 0
        if hits and seconds:
            seen = [(i, held[x]) for i, x in enumerate(tokens) if held[x].hit or held[x].second]
            close: set[int] = set()
            for order in (seen, reversed(seen)):
                last = None
                for i, t in order:
                    if t.second:
                        last = i
                    if t.hit and last is not None and abs(i - last) <= NEAR:
                        close.add(i)
            near = len(close)
        chars = max(1, len(text))
        marks = sum(text.count(c) for c in "!?")
        return [
            hits / n, np.log1p(hits), np.log1p(distinct), weight / n, weight / max(1, hits), top, near / max(1, hits), near / n, seconds / n,
            capitals / n, marks / n, sum(text.count(c) for c in ".,;:") / n, sum(text.count(c) for c in "*#@$%&") / chars, masked / n, masked_hits / n, loud_hits / n, np.log1p(n),
        ]


N_FEATURES = 17


def lexicon_from(rows: list[tuple[str, np.ndarray, np.ndarray]], toxic: np.ndarray, other: np.ndarray, left_out: int | None) -> dict[str, float]:
    """Log odds of the forms that clear support and z-score, from (form, toxic by fold, other by fold)."""
    keep = [f for f in range(FOLDS) if f != left_out]
    n1, n0 = float(toxic[keep].sum()), float(other[keep].sum())
    least = max(4.0, 0.01 * n1)
    found = []
    for form, a, b in rows:
        x, y = float(a[keep].sum()), float(b[keep].sum())
        if x < least:
            continue
        odds = np.log((x + 0.5) / (n1 + 1)) - np.log((y + 0.5) / (n0 + 1))
        z = odds / np.sqrt(1 / (x + 0.5) + 1 / (y + 0.5))
        if odds > 2.0 and z > 2.5:
            found.append((z, form, float(odds)))
    found.sort(key=lambda v: (-v[0], v[1]))
    return {form: odds for _, form, odds in found[:LEXICON]}


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: trees.Boosted
    steps: trees.Isotonic

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.steps(self.trees.raw(x))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learn from labelled rows that are not held out; a row counts once per text and label."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("int").alias("y"))
    key = F.xxhash64("doc_id")
    drawn = known.where(drawn_share(key, sample, known.count())).orderBy(key, "doc_id").limit(sample)
    # ``drawn`` has at most ``sample`` rows of an id and a label.
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).join(F.broadcast(drawn), "doc_id")
    texts = texts.dropDuplicates(["text", "y"]).withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int"))
    texts = store(texts.select("text", "y", "fold"), "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: Counter = Counter()
            for text, y, fold in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = {plain(t)[0] for t in set(tokens_of(text))}
                found.update((f, y, fold) for f in {f for w in words for f in forms(w)})
                found["", y, fold] += 1
            keys = list(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int32()), pa.array([found[k] for k in keys], pa.int64())], names=["form", "y", "fold", "n"]
            )

    sums = [F.sum(F.when((F.col("y") == y) & (F.col("fold") == f), F.col("n")).otherwise(0)).alias(f"c{y}{f}") for y in (1, 0) for f in range(FOLDS)]
    table = texts.transform(map_arrow, count, "form string, y int, fold int, n long").groupBy("form").agg(*sums)
    toxic, other = sum(F.col(f"c1{f}") for f in range(FOLDS)), sum(F.col(f"c0{f}") for f in range(FOLDS))
    lean = toxic / F.sqrt(toxic + other + 1)
    best = table.where((F.col("form") == "") | ((toxic >= 4) & (toxic * 3 > other))).orderBy((F.col("form") != ""), lean.desc(), "form").limit(ENTRIES + 1)
    rows = [(r.form, np.array([r[f"c1{f}"] for f in range(FOLDS)]), np.array([r[f"c0{f}"] for f in range(FOLDS)])) for r in best.collect()]
    total = next(((a, b) for form, a, b in rows if form == ""), (np.zeros(FOLDS), np.zeros(FOLDS)))
    rows = [r for r in rows if r[0]]
    lexicons = [lexicon_from(rows, *total, f) for f in range(FOLDS)]
    whole = lexicon_from(rows, *total, None)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = [Reader(x) for x in lexicons]
        for b in batches:
            text, y, fold = (c.to_pylist() for c in b.columns)
            x = [readers[f](t) for t, f in zip(text, fold, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(fold, pa.int32()), pa.array(x, pa.list_(pa.float64()))], names=["y", "fold", "x"])

    measured = sorted((tuple(r.x), r.y, r.fold) for r in texts.transform(map_arrow, measure, "y int, fold int, x array<double>").collect())
    x = np.array([m[0] for m in measured], dtype=float).reshape(len(measured), N_FEATURES)
    y, fold = np.array([m[1] for m in measured], dtype=float), np.array([m[2] for m in measured], dtype=int)
    apart = np.zeros(len(y))
    for f in range(FOLDS):
        apart[fold == f] = trees.fit(x[fold != f], y[fold != f]).raw(x[fold == f])
    return Model(whole, trees.fit(x, y), trees.calibrate(apart, y))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, toxic_at: float = TOXIC_AT) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, and the lexicon hits per word.

    Null text is empty and scored like any other. Without usable labels every
    score is 0.5. Null labels don't count; an id labelled twice counts as toxic
    if one label is. A null id counts as not held out. Repeated rows are scored
    row by row; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        read = Reader(m.lexicon)
        for b in batches:
            texts = b.column(2).to_pylist()
            if texts:
                x = np.array([read(t) for t in texts], dtype=float)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(m(x)), pa.array(x[:, 0])], names=["doc_id", "held_out", "score", "hit_rate"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), text_or_empty(text_col).alias("text"))
    scored = rows.transform(map_arrow, run, "doc_id long, held_out boolean, score double, hit_rate double")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= toxic_at).cast("int").alias("predicted"), "hit_rate")
