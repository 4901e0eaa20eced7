"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on each text.
Expectation-maximisation estimates how often each labeller is right on good
and on bad texts and gives every vote pattern a posterior; it runs on the
counts of patterns over all documents, at most 3**len(LABELLERS) of them. The
posteriors then label a bounded sample (``SAMPLE`` rows by hash of id and
text), on which a logistic scorer over hashed words and shape features is
trained. The scorer rates every whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import drawn_share, map_arrow, text_or_empty

SAMPLE = 4000
BUCKETS = 1 << 12
HELD = 100_000
#: The first labellers, whose bad votes are signs of kinds of junk.
SIGNS = 5
#: How often, at most, such a sign is taken to show on a good text; else kinds that are rare hide among the good.
FALSE_SIGN = 0.002
REJECT_BELOW = 0.5
PRIOR_GOOD = 0.85

#: Frequent function words of the languages at hand; running prose holds many of them.
FUNCTION_WORDS = frozenset(
    "the of and to in is that it for as with was on be by this are from or an a he at "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch "
    "de la le et les des en un du une que est pour qui dans par plus au sur ne "
    "que el en y los se del las por con para una su al lo como más o".split()
)
SYMBOLS = re.compile(r"[#*$%&|<>{}\\^~]")
WORD = re.compile(r"[^\W\d_]+")


def shape(text: str) -> np.ndarray:
    """Rates that the labellers and the scorer share; all are 0 for a text without words."""
    tokens = text.split()
    n = len(tokens)
    if not n:
        return np.zeros(8)
    counts = Counter(tokens)
    lines = [x for x in text.split("\n") if x.strip()]
    letters = sum(map(len, WORD.findall(text))) or 1
    upper = sum(1 for w, c in counts.items() if len(w) > 1 and w.isupper() for _ in range(c))
    adjacent = sum(a == b for a, b in zip(tokens, tokens[1:], strict=False))
    return np.array([
        upper / n,
        len(SYMBOLS.findall(text)) / n,
        text.count("!") / n,
        counts["|"] / n,
        adjacent / n,
        1 - len(set(lines)) / len(lines),
        sum(c for w, c in counts.items() if w.lower().strip(".,") in FUNCTION_WORDS) / n,
        letters / len(text),
    ])


def _vote(bad: bool, good: bool) -> int:
    return 0 if bad else 2 if good else 1


#: Each gives 0 for bad, 2 for good, 1 for no vote, from the rates and the number of tokens.
LABELLERS: tuple[Callable[[np.ndarray, int], int], ...] = (
    lambda r, n: _vote(r[0] > 0.35, r[0] < 0.05),
    lambda r, n: _vote(r[1] > 0.5, r[1] < 0.02),
    lambda r, n: _vote(r[2] > 0.3, r[2] < 0.02),
    lambda r, n: _vote(r[3] > 0.15, r[3] == 0),
    lambda r, n: _vote(n >= 20 and r[4] > 0.3, r[4] < 0.05),
    lambda r, n: _vote(n >= 20 and r[5] > 0.5, r[5] < 0.1),
    lambda r, n: _vote(n >= 50 and r[6] < 0.05, r[6] > 0.15),
    lambda r, n: _vote(n >= 20 and r[7] < 0.6, r[7] > 0.7),
)


def pattern(rates: np.ndarray, n: int) -> str:
    return "".join(str(f(rates, n)) for f in LABELLERS)


def fit_labellers(patterns: dict[str, int], rounds: int = 100) -> dict[str, float]:
    """Posterior of "good" for each vote pattern, by EM over the counts of patterns.

    Two models of latent classes: good and bad, and good and a class of junk for
    each of the ``SIGNS`` first labellers (kinds of junk seldom share their
    signs). In each class every labeller votes with probabilities of its own.
    The model with the higher likelihood, less the usual penalty for its
    parameters (BIC), counts. Probabilities are smoothed, so one-sided tables
    stay defined.
    """
    if not patterns:
        return {}
    votes = np.array([[int(c) for c in p] for p in patterns])
    weight = np.array(list(patterns.values()), dtype=float)
    cast = votes != 1
    share = np.where(cast.any(axis=1), ((votes == 2).sum(axis=1) + 1.7) / (cast.sum(axis=1) + 2), PRIOR_GOOD)
    signs = votes[:, :SIGNS] == 0
    kind = np.where(signs.any(axis=1)[:, None], np.eye(SIGNS)[signs.argmax(axis=1)], 1 / SIGNS)
    good = np.where(signs.any(axis=1), 0.1, share)
    starts = (np.stack([share, 1 - share], axis=1), np.concatenate([good[:, None], (1 - good)[:, None] * kind], axis=1))
    found = [_maximise(votes, weight, start, rounds) for start in starts]
    size = [(1 + votes.shape[1]) * start.shape[1] - 1 for start in starts]
    scores = [reached - 0.5 * k * np.log(weight.sum() + 1) for (reached, _), k in zip(found, size, strict=True)]
    return dict(zip(patterns, found[int(np.argmax(scores))][1][:, 0].tolist(), strict=True))


def _maximise(votes: np.ndarray, weight: np.ndarray, post: np.ndarray, rounds: int) -> tuple[float, np.ndarray]:
    """Log-likelihood and class posteriors (good first) that EM reaches from a start."""
    bad, cast = (votes == 0).astype(float), (votes != 1).astype(float)
    # one and three pseudo-votes lean each class to its side
    lean = np.where(np.arange(post.shape[1]) == 0, 1.0, 2.0)[:, None]
    reached = -np.inf
    for _ in range(rounds):
        held = (post * weight[:, None]).T
        prior = (held.sum(axis=1) + 1) / (weight.sum() + len(held))
        p = (held @ bad + lean) / (held @ cast + 4)
        if len(held) > 2:
            p[0, :SIGNS] = np.minimum(p[0, :SIGNS], FALSE_SIGN)
        logs = np.log(prior)[None, :] + bad @ np.log(p).T + (cast - bad) @ np.log(1 - p).T
        top = logs.max(axis=1, keepdims=True)
        each = top[:, 0] + np.log(np.exp(logs - top).sum(axis=1))
        before, reached = reached, float(weight @ each)
        post = np.exp(logs - each[:, None])
        if abs(reached - before) < 1e-9 * abs(reached):
            break
    return reached, post


def bucket(word: str) -> int:
    return xxhash.xxh32_intdigest(word.encode()) % BUCKETS


class Features:
    """Sparse hashed word shares and dense rates of a text.

    Word hashes are held: ``HELD`` newer and as many older ones, from which those in use move up.
    """

    def __init__(self) -> None:
        self.held: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        tokens = text.split()
        counts = Counter(tokens)
        if len(self.held) > HELD:
            self.held, self.older = {}, self.held
        held, older = self.held, self.older
        for w in counts:
            if w not in held:
                known = older.get(w)
                held[w] = bucket(w.lower()) if known is None else known
        at = np.fromiter(map(held.__getitem__, counts), dtype=np.int64, count=len(counts))
        share = np.fromiter(counts.values(), dtype=float, count=len(counts)) / max(1, len(tokens))
        return at, share, shape(text), len(tokens)


class Scorer:
    """Logistic model over hashed words and rates."""

    def __init__(self, words: np.ndarray, rates: np.ndarray, scale: np.ndarray, bias: float) -> None:
        self.words, self.rates, self.scale, self.bias = words, rates, scale, bias

    def __call__(self, at: np.ndarray, share: np.ndarray, rates: np.ndarray) -> float:
        z = self.bias + self.words[at] @ share + self.rates @ (rates / self.scale)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(texts: list[str], target: np.ndarray, rounds: int = 300) -> Scorer:
    """Full-batch gradient descent with L2 on a bounded sample; targets are posteriors."""
    features = Features()
    rows = [features(t) for t in texts]
    scale = np.maximum(np.std([r[2] for r in rows], axis=0), 1e-3) if rows else np.ones(8)
    words, rates, bias = np.zeros(BUCKETS), np.zeros(8), 0.0
    if not rows:
        return Scorer(words, rates, scale, 2.0)
    at = np.concatenate([r[0] for r in rows])
    share = np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    dense = np.stack([r[2] for r in rows]) / scale
    for _ in range(rounds):
        z = bias + np.bincount(row, words[at] * share, minlength=len(rows)) + dense @ rates
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(rows)
        words -= 2.0 * (np.bincount(at, error[row] * share, minlength=BUCKETS) + 1e-5 * words)
        rates -= 1.0 * (dense.T @ error + 1e-4 * rates)
        bias -= 1.0 * error.sum()
    return Scorer(words, rates, scale, float(bias))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[dict[str, float], Scorer]:
    """Posteriors by vote pattern over all documents, and the scorer trained on ``sample`` of them."""

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                text = t.as_py()
                found[pattern(shape(text), len(text.split()))] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["p", "n"])

    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("t"))
    counted = texts.select("t").transform(map_arrow, votes, "p string, n long").groupBy("p").agg(F.sum("n").alias("n"))
    patterns = {r.p: r.n for r in counted.orderBy("p").collect()}
    posterior = fit_labellers(patterns)
    order = texts.select("t", F.xxhash64("doc_id", "t").alias("k")).where(drawn_share(F.col("k"), sample, sum(patterns.values())))
    drawn = [r.t for r in order.orderBy("k", "t").limit(sample).toLocalIterator()]
    target = np.array([posterior.get(pattern(shape(t), len(t.split())), PRIOR_GOOD) for t in drawn])
    return posterior, train(drawn, target)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, reject_below: float = REJECT_BELOW) -> DataFrame:
    """One row per row of ``docs``: doc_id, votes, posterior, score (1: good) and kept.

    A text is rejected if its score is below ``reject_below``. Null text is
    empty: no labeller votes on rates of a text without words beyond what the
    rates (all 0) say, and such rows are scored like others. Null and repeated
    ids and repeated rows are scored row by row; an empty table gives no rows.
    """
    posterior, scorer = fit(docs, id_col, text_col, sample)
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast((posterior, scorer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (post, rate), features = model.value, Features()
        for b in batches:
            out = []
            for held in b.column(1):
                text = held.as_py()
                at, share, rates, n = features(text)
                p = pattern(rates, n)
                out.append((p, post.get(p, PRIOR_GOOD), rate(at, share, rates)))
            if out:
                votes, p, s = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(votes, pa.string()), pa.array(p, pa.float64()), pa.array(s, pa.float64())], names=["doc_id", "votes", "posterior", "score"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("t"))
    scored = texts.transform(map_arrow, run, "doc_id long, votes string, posterior double, score double")
    return scored.withColumn("kept", F.col("score") >= reject_below)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, reject_below: float = REJECT_BELOW) -> DataFrame:
    """The rows of ``docs`` whose text is not rejected, in one pass beside the fit and without a shuffle."""
    _, scorer = fit(docs, id_col, text_col, sample)
    model = docs.sparkSession.sparkContext.broadcast(scorer)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate, features = model.value, Features()
        for b in batches:
            good = [rate(*features(t.as_py() or "")[:3]) >= reject_below for t in b.column(place)]
            yield b.filter(pa.array(good, pa.bool_()))

    return docs.transform(map_arrow, run, docs.schema)
