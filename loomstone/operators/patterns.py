"""Many patterns at once: the first rule, by priority, that matches a text.

Every match of a pattern holds one of its factors, literal stretches that its
expression demands. An Aho-Corasick automaton over the factors of all rules reads
a text once and names the rules that can match; only those are tried, in order.
So the work grows with the text and with the rules it points to, not with the
number of rules. Rules whose expression demands no literal are tried on each text.

Patterns are Python's, without case. Rules are a table: they are read in order of
priority, ``RULES`` at a time, and a later part is tried only on rows that no
earlier one matched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.functions.literals import factors
from loomstone.functions.text import fresh
from loomstone.shipping import map_arrow

#: Rules of an automaton, some megabytes.
RULES = 1 << 16
#: Characters beyond ASCII that match an ASCII letter when case doesn't count.
ALIKE = {0x130: "i", 0x131: "i", 0x17F: "s", 0x212A: "k"}


def folded(text: str) -> str:
    """A text in which every ASCII letter, and what equals one without case, is small."""
    if text.isascii():
        return text.lower()
    return text.translate(_LOWER)


_LOWER = {i: i + 32 for i in range(65, 91)} | {c: ord(x) for c, x in ALIKE.items()}


class FirstMatch:
    """Rules in order: (pattern, value). ``find`` gives the number of the first that matches, or -1."""

    def __init__(self, rules: list[tuple[str, object]]) -> None:
        self.rules, self.always = rules, []
        self.of: dict[str, list[int]] = {}
        for n, (p, _) in enumerate(rules):
            known = factors(p)
            for f in known:
                self.of.setdefault(f, []).append(n)
            if not known:
                self.always.append(n)

    def _ready(self) -> None:
        """Made once a worker."""
        self.compiled: dict[int, re.Pattern] = {}
        self.automaton = ahocorasick.Automaton()
        for f, numbers in self.of.items():
            self.automaton.add_word(f, (f, numbers))
        if self.of:
            self.automaton.make_automaton()

    def candidates(self, text: str) -> list[int]:
        if not hasattr(self, "automaton"):
            self._ready()
        met = dict(found for _, found in self.automaton.iter(folded(text))) if self.of else {}
        return sorted({*self.always, *(n for numbers in met.values() for n in numbers)})

    def find(self, text: str) -> int:
        for n in self.candidates(text):
            if n not in self.compiled:
                self.compiled[n] = re.compile(self.rules[n][0], re.I)
            if self.compiled[n].search(text):
                return n
        return -1


def _parts(rules: DataFrame) -> Iterator[FirstMatch]:
    """The rules in order of priority, ``RULES`` at a time; equal priorities by pattern and value. Rules without pattern match nothing."""
    held: list[tuple] = []
    for r in rules.where("pattern is not null").select("pattern", "value", "priority").orderBy("priority", "pattern", "value").toLocalIterator():
        held.append((r.pattern, r.value))
        if len(held) == RULES:
            yield FirstMatch(held)
            held = []
    if held:
        yield FirstMatch(held)


def first_match(rows: DataFrame, rules: DataFrame, text: str, name: str = "value") -> DataFrame:
    """The rows with ``name``: the value of the first rule (pattern, value, priority) that matches, null where none does.

    No row is moved or joined, so keys may be null or repeated. Null texts and
    null patterns match nothing; an empty text is matched by patterns that match
    it. Of rules of equal priority the smaller pattern, then value, comes first.
    """
    kind = dict(rules.dtypes)["value"]
    if kind != "string":
        raise TypeError(f"values are strings, not {kind}")
    found, out = fresh(rows, "found_rule"), rows.withColumn(fresh(rows, "found_rule"), F.lit(None).cast("string"))
    done = fresh(out, "rule_met")
    out = out.withColumn(done, F.lit(False))
    # Types as Spark names them; an array or struct passes through as it is.
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in out.schema.fields)
    at = rows.columns.index(text)
    for part in _parts(rules):
        shared = rows.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                first = shared.value
                values, met = b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()
                for i, t in enumerate(b.column(at).to_pylist()):
                    if t is not None and not met[i] and (n := first.find(t)) >= 0:
                        values[i], met[i] = first.rules[n][1], True
                yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(values, pa.string()), pa.array(met, pa.bool_())], names=b.schema.names)

        out = out.transform(map_arrow, run, schema)
    return out.drop(done).withColumnRenamed(found, name)
