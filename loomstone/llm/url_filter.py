"""URL filter: ordered host and path rules, and gradient-boosted trees for the rest.

A rule fits its host and all subdomains if the url's path starts with the
rule's; the longest fitting rule decides. Trees trained on lexical features of
labelled urls judge the urls that no rule fits. Labels are a table of urls; a url
that it doesn't hold, or all where there is none, takes a fitting rule's verdict
as its label. Training draws a bounded sample of distinct labelled urls
(``SAMPLE``, by hash).
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm import trees
from loomstone.llm.common import drawn_share, map_arrow, store

SAMPLE = 20_000
BLOCK_AT = 0.5
FOLDS = 5
_LOWER = str.maketrans({i: i + 32 for i in range(65, 91)})


def parse(url: str | None) -> tuple[str, str]:
    """(host, path): host up to the first ``/``, ``?``, ``#`` after ``://``, A-Z in lower case; path up to ``?`` or ``#``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:end].translate(_LOWER), rest[end:]
    cut = min((i for i in (tail.find(c) for c in "?#") if i >= 0), default=len(tail))
    return host, tail[:cut]


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rule(line: str) -> Rule:
    """A rule from its text, such as ``block example.org/es/``."""
    verdict, _, where = line.partition(" ")
    host, slash, path = where.partition("/")
    return Rule(verdict, host.translate(_LOWER), slash + path)


class Rules:
    """Rules by host: a url looks up each suffix of its host, so their number doesn't matter."""

    def __init__(self, rules: Sequence[Rule]) -> None:
        self.by_host: dict[str, list[Rule]] = {}
        for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
            self.by_host.setdefault(r.host, []).append(r)

    def fitting(self, host: str, path: str) -> Rule | None:
        best, at = None, 0
        while host and at >= 0:
            for r in self.by_host.get(host[at:], ()):
                if path.startswith(r.path):
                    if best is None or (-len(r.text), r.text) < (-len(best.text), best.text):
                        best = r
                    break
            dot = host.find(".", at)
            at = dot + 1 if dot >= 0 else -1
        return best


@dataclass
class Suffixes:
    """How often labelled urls under a host suffix or path head are blocked, smoothed; the rest gets the mean."""

    blocked: dict[str, float]
    mean: float


def parts(host: str, path: str) -> tuple[str, ...]:
    """What statistics are kept of, each under its kind: the host's last label, last two and last three, and the path's first part."""
    labels = host.split(".")
    head = path.split("/")[1] if path.startswith("/") else ""
    return *(f"{n}:{'.'.join(labels[-n:])}" if len(labels) >= n else f"{n}:" for n in (1, 2, 3)), f"/:{head}"


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * np.log2(c / n) for c in Counter(s).values()) if n else 0.0


def features(url: str | None, host: str, path: str, known: Suffixes) -> list[float]:
    url = url or ""
    query = url.partition("?")[2].partition("#")[0]
    n = max(1, len(url))
    rates = [known.blocked.get(k, known.mean) for k in parts(host, path)]
    return [
        len(url), len(host), len(path), path.count("/"), host.count("."), host.count("-"),
        sum(c.isdigit() for c in url) / n, sum(c.isdigit() for c in host), entropy(url), entropy(host),
        query.count("&") + 1 if query else 0, len(query), float("#" in url), float(url.startswith("https")), float(host.startswith("www.")), *rates,
    ]


def train(rows: list[tuple[str | None, str, str, int]]) -> tuple[Suffixes, trees.Boosted]:
    """Suffix statistics and trees from labelled urls (url, host, path, 1 for blocked).

    A row's statistics come from the other folds of urls, so that they tell
    nothing of its own label and look as they would for a new url.
    """
    y = np.array([r[3] for r in rows], dtype=float)
    mean = float(y.mean()) if len(y) else 0.5
    fold = [zlib.crc32((r[0] or "").encode()) % FOLDS for r in rows]

    def learn(left_out: int | None) -> Suffixes:
        total: Counter = Counter()
        blocked: Counter = Counter()
        for f, (_, host, path, label) in zip(fold, rows, strict=True):
            if f != left_out:
                for k in parts(host, path):
                    total[k] += 1
                    blocked[k] += label
        return Suffixes({k: (blocked[k] + 2 * mean) / (n + 2) for k, n in total.items() if n >= 5}, mean)

    others = [learn(f) for f in range(FOLDS)]
    x = [features(url, host, path, others[f]) for f, (url, host, path, _) in zip(fold, rows, strict=True)]
    return learn(None), trees.fit(np.array(x, dtype=float) if rows else np.zeros((0, 1)), y)


SCHEMA = "page_id long, host string, path string, rule string, verdict string, score double"


def judge(
    pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", sample: int = SAMPLE, block_at: float = BLOCK_AT,
    labels: DataFrame | None = None, label_col: str = "blocked",
) -> DataFrame:
    """One row per row of ``pages``: host, path, the rule that fits, the verdict and the trees' score.

    Urls that are null or have no ``://`` have empty host and path, fit no rule
    and are judged by the trees. Without labelled urls, or with one label only,
    the trees are constant and block nothing that no rule blocks unless all
    labels do. Of a url with labels that differ, blocked wins; null labels don't
    count. Repeated rows are judged row by row; an empty table gives no rows.
    Ids must be whole numbers; other columns are not read.
    """
    known = Rules(rules)
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"))

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [(u, found.verdict == "block") for u in b.column(0).to_pylist() if (found := known.fitting(*parse(u)))]
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in keep], pa.string()), pa.array([v for _, v in keep], pa.bool_())], names=["url", "bad"])

    # A url is one training row, whatever the number of its copies; rules are tried once, then their labels are read.
    marked = urls.select("url").distinct().transform(map_arrow, labelled, "url string, bad boolean")
    if labels is not None:
        given = labels.where(F.col(label_col).isNotNull() & F.col(url_col).isNotNull()).groupBy(F.col(url_col).alias("url")).agg(F.max(F.col(label_col).cast("boolean")).alias("bad"))
        marked = marked.join(given, "url", "left_anti").unionByName(given)
    marked = store(marked, "url-labels")
    key = F.xxhash64("url")
    drawn = marked.where(drawn_share(key, sample, marked.count())).orderBy(key, "url").limit(sample)
    rows = [(r.url, *parse(r.url), int(r.bad)) for r in drawn.collect()]
    model = pages.sparkSession.sparkContext.broadcast(train(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suffixes, score = model.value
        for b in batches:
            urls = b.column(1).to_pylist()
            if not urls:
                continue
            at = [parse(u) for u in urls]
            s = score(np.array([features(u, h, p, suffixes) for u, (h, p) in zip(urls, at, strict=True)], dtype=float))
            fits = [known.fitting(h, p) for h, p in at]
            verdict = [f.verdict if f else "block" if v >= block_at else "allow" for f, v in zip(fits, s, strict=True)]
            cols = [b.column(0), pa.array([h for h, _ in at]), pa.array([p for _, p in at]), pa.array([f.text if f else None for f in fits], pa.string()), pa.array(verdict, pa.string()), pa.array(s)]
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SCHEMA.split(", ")])

    return urls.transform(map_arrow, run, SCHEMA)
