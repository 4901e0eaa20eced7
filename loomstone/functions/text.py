"""Text expressions: matching, tokens, translation, figures, template slots."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions import fixed
from loomstone.functions.literals import factors

#: Case-insensitive and Unicode-aware, as the rules are meant.
CI = "(?iU)"


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def has(text: Column, pattern: str) -> Column:
    return text.rlike(CI + pattern)


def seen(text: Column) -> Column:
    """struct<text, low>: a text to be asked for many patterns; ``low`` in small letters, null if it isn't all ASCII."""
    return F.struct(text.alias("text"), F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).alias("low"))


def says(t: Column, pattern: str) -> Column:
    """As ``has`` of a text ``seen``: the pattern is tried only where a literal that it demands occurs, or beyond ASCII."""
    known = [F.contains(t["low"], F.lit(f)) for f in factors(pattern)]
    found = has(t["text"], pattern)
    return F.coalesce(reduce(or_, known), F.lit(True)) & found if known else found


def group(text: Column, pattern: str, n: int = 1) -> Column:
    """Group ``n`` of the first match, null where there is none."""
    found = F.regexp_extract(text, CI + pattern, n)
    return F.when(found != "", found)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """The rows dealt over all cores: for long work on each row of a table that is one small file."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def question_key(text: Column) -> Column:
    """What makes two questions the same: white space at the ends and case don't count."""
    return F.lower(strip(text))


def fill(template: str, **values: Column | str) -> Column:
    """A sentence with its ``{name}`` places filled in."""
    parts = re.split(r"\{(\w+)\}", template)
    cols = [(values[p] if isinstance(values[p], Column) else F.lit(values[p])) if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p]
    return F.concat(*cols) if cols else F.lit("")


def lookup(key: Column, table: dict) -> Column:
    """The table's value for a key, null where it has none."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda x: x != ""))


def runs(text: Column, letters: str = "A-Za-z'") -> Column:
    """Alternating runs of letters and of everything else; joined, they are the text."""
    return F.regexp_extract_all(text, F.lit(f"[{letters}]+|[^{letters}]+"), F.lit(0))


def translate_words(text: Column, table: dict[str, str] = fixed.TRANSLATIONS, fillers: tuple[str, ...] = fixed.FILLERS, letters: str = "A-Za-z'") -> Column:
    """Words of a dictionary translated, fillers dropped, white space tidied, all else kept."""
    kept = F.filter(runs(text, letters), lambda t: ~F.lower(t).isin(*fillers)) if fillers else runs(text, letters)
    words = F.transform(kept, lambda t: F.coalesce(lookup(F.lower(t), table), t))
    joined = F.regexp_replace(F.array_join(words, ""), r"(?U)\s+", " ")
    return strip(F.regexp_replace(joined, r"(?U)\s+([,.?!])", "$1"))


def follow_up(text: Column, pattern: str = fixed.FOLLOW_UP) -> Column:
    return has(text, pattern)


def figures(text: Column, pattern: str = fixed.FIGURE) -> Column:
    """Amounts and percentages in the text, in order, with repeats."""
    return F.regexp_extract_all(text, F.lit("(?i)" + pattern), F.lit(0))


def figure_key(figure: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(figure, r"[^\d.%]", ""), r"\.+$", "")


def unsupported_figures(answer: Column, sources: Column, pattern: str = fixed.FIGURE) -> Column:
    """Figures of the answer, repeats kept, whose key no figure of the sources has."""
    allowed = F.transform(figures(sources, pattern), figure_key)
    return let(allowed, lambda known: F.filter(figures(answer, pattern), lambda f: ~F.array_contains(known, figure_key(f))))


def dedup_words(text: Column) -> Column:
    """A word said twice or more in a row becomes one."""
    return F.regexp_replace(text, r"(?iU)\b(\w+)(?:\s+\1\b)+", "$1")


def reveal_slots(text: Column) -> Column:
    """Template slots replaced by their label."""
    return F.regexp_replace(text, r"\{\{\s*([^{}]+?)\s*\}\}", "$1")


def slot(name: str) -> str:
    return r"(?i)\{\{\s*" + re.escape(name) + r"\s*\}\}"


def _draw(seed: Column, what: str, n: int) -> Column:
    """A number below ``n`` that the row's seed and the group decide."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", seed.cast("string"), F.lit(what))), 1, 8), 16, 10).cast("long"), F.lit(n))


def slot_values(seed: Column) -> dict[tuple[str, str | None], Column]:
    """For each group (and field) of slots, the row's value."""
    out: dict[tuple[str, str | None], Column] = {}
    for g, (prefix, low, high) in fixed.SLOT_NUMBERS.items():
        wide = F.conv(F.substring(F.md5(F.concat_ws("|", seed.cast("string"), F.lit(g))), 1, 12), 16, 10).cast("long")
        out[g, None] = F.concat(F.lit(prefix), (F.pmod(wide, F.lit(high - low + 1)) + low).cast("string"))
    for g, choices in fixed.SLOT_CHOICES.items():
        out[g, "value" if g == "amount" else None] = F.element_at(F.array(*map(F.lit, choices)), (_draw(seed, g, len(choices)) + 1).cast("int"))
    out["amount", "currency"] = F.lit(fixed.CURRENCY)
    person = (_draw(seed, "person", len(fixed.PEOPLE)) + 1).cast("int")
    for field, pick in {"first": 0, "last": 1, "salutation": 2}.items():
        out["person", field] = F.element_at(F.array(*(F.lit(p[pick]) for p in fixed.PEOPLE)), person)
    out["person", "full"] = F.concat_ws(" ", out["person", "first"], out["person", "last"])
    return out


def _put(text: Column, name: str, value: Column) -> Column:
    """Every occurrence of a slot replaced by a value taken as it is."""
    return F.regexp_replace(text, F.lit(slot(name)), F.regexp_replace(value, r"([\\$])", r"\\$1"))


def clean_pair(instruction: Column, response: Column, seed: Column | None = None) -> tuple[Column, Column]:
    """Instruction and response with their template slots filled or made neutral.

    A group of slots has one value a row, drawn by the row's content. Groups
    that the instruction names keep their value in the response; the others get
    neutral wording, so that the response invents nothing. Unknown slots keep
    their label. Two passes resolve a slot within a slot.
    """
    instruction, response = F.coalesce(instruction, F.lit("")), F.coalesce(response, F.lit(""))
    seed = F.crc32(F.concat(instruction, response).cast("binary")) if seed is None else seed
    values = slot_values(seed)
    said: dict[str, Column] = {}
    for name, (g, _) in fixed.SLOTS.items():
        said[g] = said.get(g, F.lit(False)) | (F.contains(instruction, F.lit("{{")) & instruction.rlike(slot(name)))
    tier = group(instruction, fixed.ACCOUNT_TIER)
    account = F.when(said["account"], values["account", None]).when(tier.isNotNull(), F.initcap(tier))

    def one_pass(plain: Column, neutral: bool) -> Column:
        text = plain
        for name, (g, field) in fixed.SLOTS.items():
            value = values[g, field]
            if neutral:
                value = F.coalesce(account, F.lit(fixed.NEUTRAL_PHRASES[g])) if g == "account" else F.when(said[g], value).otherwise(fixed.NEUTRAL_PHRASES[g])
            text = _put(text, name, value)
        for name, phrase in fixed.GENERIC_PHRASES.items():
            text = F.regexp_replace(text, slot(name), phrase)
        # Most texts have no slot, and after the first pass few have one left.
        return F.when(F.contains(plain, F.lit("{{")), reveal_slots(text)).otherwise(plain)

    asked = F.transform(F.array(instruction), lambda t: one_pass(t, False))
    asked = F.element_at(F.transform(asked, lambda t: one_pass(t, False)), 1)
    given = response
    for g, pattern, phrase in fixed.NEUTRAL_REWRITES:
        silent = ~said[g] if g != "account" else account.isNull()
        # A pattern that can't match stands for "leave it": the text occurs once in the expression.
        given = F.regexp_replace(given, F.when(silent, F.lit("(?i)" + pattern)).otherwise(F.lit("(?!)")), F.lit(phrase))
    given = F.transform(F.array(given), lambda t: one_pass(t, True))
    given = F.element_at(F.transform(given, lambda t: one_pass(t, True)), 1)
    return asked, dedup_words(given)
