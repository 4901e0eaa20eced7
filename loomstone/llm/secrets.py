"""Secret scan in DataFrame operations only.

Base rules find assignments, access keys and long hex runs. The method adds
runs of secret-like characters outside the base spans that pass a battery of
randomness tests under the encoding inferred from their characters:

* chi-squared: cells of the alphabet (letters frequent in prose, other letters,
  digits, each case on its own) are as full as a uniform draw would fill them;
* runs: neighbours fall in the same cell as often as they would by chance;
* serial correlation of the symbols' places in the alphabet.

Three times the smallest p-value measures agreement with random symbols. A run
may pass at a level of 0.001 at the lowest, so that about one random key in a
thousand is lost to chance.

The encoding is the smallest alphabet that holds the run, so names of one shape
(small letters, small letters with separators, both cases without digits) are a
stratum of their own and don't hide the keys of another.

What else looks like a key, and how short a run can still tell, is decided by
the data: every document gives decoys made of its own text the way names in
code, paths and encoded text are made of words, of all encodings and length
bands: ``DECOYS`` of them, and in a table of few rows as many as give
``DECOYS_IN_ALL``, at most ``DECOYS_MOST``. The share of decoys that pass at a
level, times the runs of the stratum (encoding and length band) that aren't
keys, over the runs that pass there, bounds the false discoveries; a stratum
reports at the lowest level where this is within ``fdr``, or not at all. How
many runs aren't keys is estimated from those that pass at no level. Strata
borrow decoys of shorter bands, which pass more often, and with few of either
those of other encodings. The decision table is counted over all documents and
has at most 2 x 10 x 8 x 9 rows; equal runs count once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import fresh, let, text_or_empty

ASSIGN = r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: A run of 24 hex digits or more is the same whether shorter runs are matched and dropped or not matched.
HEX = r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")
FDR = 0.05
#: Levels a run can pass at, from the strictest down; a run's level is the number of these its p-value reaches.
LEVELS = (0.2, 0.1, 0.05, 0.02, 0.01, 0.005, 0.002, 0.001)
#: Length bands start here and widen by doubling.
BANDS = (20, 24, 32, 48, 80, 144, 272, 528)
#: Decoys of a document; decoys that a table of few rows gives in all, and the most of one document there.
DECOYS = 2
DECOYS_IN_ALL = 1 << 14
DECOYS_MOST = 32
#: How many decoys of its encoding a stratum needs before it borrows those of others.
ENOUGH = 100
#: Matches of a text whose starts are summed up in one go: a text with very many costs no square of them.
STRIDE = 256

_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Letters that prose in Latin script uses most, and its vowels and other frequent letters on their own.
_COMMON = "aeinorst"
_RARE = "".join(c for c in _LOWER if c not in _COMMON)
_VOWELS, _FREQUENT = "aeiou", "dhlnrst"
_OTHER = "".join(c for c in _LOWER if c not in _VOWELS + _FREQUENT)
_SMALL, _LARGE = (_VOWELS, _FREQUENT, _OTHER), (_VOWELS.upper(), _FREQUENT.upper(), _OTHER.upper())
_SIGNS = "+/-_"
#: Inferred encoding, the first that fits: the characters it allows, its alphabet in order, and the alphabet's cells.
ENCODINGS = {
    "decimal": ("^[0-9]+$", _DIGITS, ("01", "23", "45", "67", "89")),
    "hex": ("^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", ("0123", "4567", "89ab", "cdef")),
    "lower26": ("^[a-z]+$", _LOWER, _SMALL),
    "lower36": ("^[a-z0-9]+$", _LOWER + _DIGITS, (*_SMALL, _DIGITS)),
    "lower40": ("^[a-z0-9+/_-]+$", _LOWER + _DIGITS + _SIGNS, (*_SMALL, _DIGITS, _SIGNS)),
    "upper26": ("^[A-Z]+$", _UPPER, _LARGE),
    "base32": ("^[A-Z2-7]+$", _UPPER + "234567", (*_LARGE, "234567")),
    "upper40": ("^[A-Z0-9+/_-]+$", _UPPER + _DIGITS + _SIGNS, (*_LARGE, _DIGITS, _SIGNS)),
    "letters": ("^[A-Za-z]+$", _UPPER + _LOWER, (_COMMON, _RARE, _COMMON.upper(), _RARE.upper())),
    "base64": ("", _UPPER + _LOWER + _DIGITS + _SIGNS, (_COMMON, _RARE, _COMMON.upper(), _RARE.upper(), _DIGITS + _SIGNS)),
}
_SPAN = "struct<s:int,e:int,kind:string,hit:string>"


def _no_spans() -> Column:
    return F.array().cast(f"array<{_SPAN}>")


def starts(lengths: Column) -> Column:
    """The sums of all ``lengths`` before each, by blocks of ``STRIDE``."""

    def running(values: Column, first: Column) -> Column:
        none = F.struct(first.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        return F.aggregate(values, none, step, lambda a: a["out"])

    def whole(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x))
        return F.flatten(F.zip_with(blocks, running(sums, F.lit(0)), running))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / STRIDE).cast("int")), lambda b: F.slice(lengths, b * STRIDE + 1, F.lit(STRIDE)))
    return F.when(F.size(lengths) > 0, let(blocks, whole)).otherwise(F.array().cast("array<int>"))


def matches(text: Column, pattern: str, kind: str) -> Column:
    """array<struct<s, e, kind, hit>> of leftmost non-overlapping matches, in code points.

    Matches and the gaps between them are cut out in one pass each; a match
    starts where the gaps and matches before it end.
    """

    def placed(gaps: Column, hits: Column) -> Column:
        # The text after the last match is a gap that no match follows.
        pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(F.char_length(g).alias("gap"), F.char_length(h).alias("own"), h.alias("hit")))

        def spans(x: Column) -> Column:
            at = starts(F.transform(x, lambda y: y["gap"] + y["own"]))
            return F.zip_with(x, at, lambda y, a: F.struct((a + y["gap"]).alias("s"), (a + y["gap"] + y["own"]).alias("e"), F.lit(kind).alias("kind"), y["hit"].alias("hit")))

        return let(pairs, spans)

    def found(text: Column) -> Column:
        spans = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: placed(F.split(text, pattern, -1), hits))
        return F.when(text.rlike(pattern), spans).otherwise(_no_spans())

    return let(text, found)


#: The base rules: kind, expression, and what a match must have to stay.
_BASE: tuple[tuple[str, str, Callable[[Column], Column]], ...] = (
    ("assign", ASSIGN, lambda hit: F.char_length(F.regexp_extract(hit, ASSIGN, 1)) >= 6),
    ("access", ACCESS, lambda hit: F.char_length(hit) >= 20),
    ("hex", HEX, lambda hit: F.lit(True)),
)


def base_spans(text: Column) -> Column:
    """Spans of the three base rules, failing matches dropped, by kind as listed."""
    return F.concat(*(F.filter(matches(text, pattern, kind), partial(lambda stays, x: stays(x["hit"]), stays)) for kind, pattern, stays in _BASE))


def without_base(text: Column) -> Column:
    """The text with blanks for what the base rules find, so that every other character keeps its place."""

    def blanked(text: Column, pattern: str, stays: Callable[[Column], Column]) -> Column:
        blank = lambda g, h: F.concat(g, F.when(h.isNull(), F.lit("")).when(stays(h), F.repeat(F.lit(" "), F.char_length(h))).otherwise(h))
        parts = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), blank)
        return F.when(text.rlike(pattern), F.array_join(parts, "")).otherwise(text)

    for _, pattern, stays in _BASE:
        text = let(text, partial(lambda pattern, stays, t: blanked(t, pattern, stays), pattern, stays))
    return text


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind)


def in_order(spans: Column) -> Column:
    keyed = F.transform(spans, lambda x: F.struct(x["s"].alias("s"), _rank(x["kind"]).alias("r"), x["e"].alias("e"), x["kind"].alias("kind")))
    return F.array_sort(keyed)


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def bare(run: Column) -> Column:
    """A run without its padding."""
    return F.rtrim(run, F.lit("="))


def encoding_of(body: Column) -> Column:
    out = F.lit("base64")
    for name in reversed([x for x in ENCODINGS if x != "base64"]):
        out = F.when(body.rlike(ENCODINGS[name][0]), F.lit(name)).otherwise(out)
    return out


def _parameters(encoding: Column) -> Column:
    """What the battery needs to know of an encoding: struct<from, to, alphabet, cells, free, s2, s3, halves>."""

    def of(name: str) -> Column:
        _, alphabet, cells = ENCODINGS[name]
        share = [len(c) / len(alphabet) for c in cells]
        # Two hex digits write one byte: first and second ones are counted on their own.
        halves = name == "hex"
        return F.struct(
            F.lit("".join(cells)).alias("from"),
            F.lit("".join(chr(97 + k) * len(c) for k, c in enumerate(cells))).alias("to"),
            F.lit(alphabet).alias("alphabet"),
            F.array(*(F.struct(F.lit(chr(97 + k)).alias("sign"), F.lit(p).alias("p")) for k, p in enumerate(share))).alias("cells"),
            F.lit(float((1 + halves) * (len(cells) - 1))).alias("free"),
            F.lit(sum(p**2 for p in share)).alias("s2"),
            F.lit(sum(p**3 for p in share)).alias("s3"),
            F.lit(halves).alias("halves"),
        )

    out = of("base64")
    for name in reversed([x for x in ENCODINGS if x != "base64"]):
        out = F.when(encoding == name, of(name)).otherwise(out)
    return out


def tail(z: Column) -> Column:
    """Upper tail of the normal distribution for z >= 0, by the rational form of Abramowitz and Stegun (26.2.17), within 1e-7."""
    poly = lambda t: t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return let(z, lambda z: F.exp(-z * z / 2) * 0.3989422804014327 * let(1 / (1 + 0.2316419 * z), poly))


def battery(body: Column, encoding: Column) -> Column:
    """3 x the smallest p-value of the tests, at most 1, for a run without padding."""
    plain = F.when(encoding == "hex", F.lower(body)).otherwise(body)

    def tests(of: Column) -> Column:
        n = F.char_length(body).cast("double")

        def uniform(x: Column) -> Column:
            phases = F.when(of["halves"], F.array(F.regexp_replace(x, "(.).?", "$1"), F.regexp_replace(x, ".(.)?", "$1"))).otherwise(F.array(x))

            def square(phase: Column) -> Column:
                full = lambda c: F.char_length(phase) - F.char_length(F.replace(phase, c["sign"], F.lit("")))
                return F.aggregate(of["cells"], F.lit(0.0), lambda a, c: a + F.pow(full(c) - F.char_length(phase) * c["p"], F.lit(2.0)) / (F.char_length(phase) * c["p"]))

            # Wilson and Hilferty: the cube root of chi-squared over its freedom is close to normal.
            wide = 2 / (9 * of["free"])
            z = (F.pow(F.aggregate(phases, F.lit(0.0), lambda a, p: a + square(p)) / of["free"], F.lit(1 / 3)) - (1 - wide)) / F.sqrt(wide)
            # Fuller agreement than the middle of chance says nothing against a run.
            return tail(F.greatest(z, F.lit(0.0)))

        def changes(x: Column) -> Column:
            s2, s3 = of["s2"], of["s3"]
            runs = F.char_length(F.regexp_replace(x, r"(.)\1*", "x")).cast("double")
            spread = F.sqrt((n - 1) * (s2 * (1 - s2)) + 2 * (n - 2) * (s3 - s2 * s2))
            return 2 * tail(F.abs(runs - (1 + (n - 1) * (1 - s2))) / spread)

        on_cells = F.call_function("translate", plain, of["from"], of["to"])
        return F.least(let(on_cells, lambda x: F.least(uniform(x), changes(x))), serial(places(plain, of["alphabet"]), n))

    def places(x: Column, alphabet: Column) -> Column:
        return F.transform(F.filter(F.split(x, ""), lambda c: c != ""), lambda c: F.instr(alphabet, c).cast("double"))

    def serial(x: Column, n: Column) -> Column:
        def about(x: Column, mean: Column) -> Column:
            ahead = F.zip_with(F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0))), F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0))), lambda a, b: (a - mean) * (b - mean))
            lagged = F.aggregate(ahead, F.lit(0.0), lambda a, v: a + v)
            return let(F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)), lambda v: F.when(v == 0, F.lit(0.0)).otherwise(2 * tail(F.abs(lagged / v) * F.sqrt(n))))

        return let(x, lambda held: let(F.aggregate(held, F.lit(0.0), lambda a, v: a + v) / n, lambda mean: about(held, mean)))

    return F.least(F.lit(1.0), 3 * let(_parameters(encoding), tests))


def level_of(p: Column) -> Column:
    """How many of ``LEVELS`` the p-value reaches; 0: it passes at none."""
    return let(p, lambda v: sum((F.when(v >= x, 1).otherwise(0) for x in LEVELS), F.lit(0)).cast("int"))


def band_of(length: Column) -> Column:
    out = F.lit(len(BANDS) - 1)
    for k, upper in reversed(list(enumerate(BANDS[1:]))):
        out = F.when(length < upper, F.lit(k)).otherwise(out)
    return out


def judged(run: Column, extra: list[Column], decoy: bool) -> Column:
    """struct<(extra), run, encoding, band, level, decoy> of a run, as its hash, or decoy."""

    def measured(body: Column, e: Column) -> Column:
        return F.struct(*extra, F.xxhash64(body).alias("run"), e.alias("encoding"), band_of(F.char_length(body)).alias("band"), level_of(battery(body, e)).alias("level"), F.lit(decoy).alias("decoy"))

    return let(bare(run), lambda body: let(encoding_of(body), lambda e: measured(body, e)))


def candidates(text: Column) -> Column:
    """array<struct<s, e, run, encoding, band, level, decoy>> of a text's runs outside base spans."""
    found = F.transform(matches(without_base(text), RUN, "random"), lambda x: judged(x["hit"], [x["s"].alias("s"), x["e"].alias("e")], False))
    # What is shorter than a run without its padding can't be told from chance.
    return F.when(text.rlike(RUN), found).otherwise(F.array().cast("array<struct<s:int,e:int,run:bigint,encoding:string,band:int,level:int,decoy:boolean>>"))


def _numbered(words: Column, h: Column, each: int, most: int, case: Callable[[Column], Column]) -> Column:
    """The words in one, a number below ``most`` behind each ``each``-th."""
    number = lambda i: F.when(i % each == 1, F.pmod(h + i, F.lit(most)).cast("string")).otherwise(F.lit(""))
    return F.array_join(F.transform(words, lambda w, i: F.concat(case(w), number(i))), "")


def _mixed(words: Column, h: Column) -> Column:
    """The letters of the words in another order: what a word of any language with these letters may look like."""
    letters = F.filter(F.split(F.array_join(words, ""), ""), lambda c: c != "")
    keyed = F.array_sort(F.transform(letters, lambda c, i: F.struct(F.xxhash64(h, i).alias("at"), c.alias("c"))))
    return F.array_join(F.transform(keyed, lambda x: x["c"]), "")


#: How decoys come about: their words joined as names and paths are, their letters mixed, or text in another encoding.
_MADE: tuple[Callable[[Column, Column, Column], Column], ...] = (
    lambda text, words, h: F.array_join(F.transform(words, F.lower), "_"),
    lambda text, words, h: F.array_join(F.transform(words, F.lower), "/"),
    lambda text, words, h: F.array_join(F.transform(words, F.initcap), "/"),
    lambda text, words, h: F.array_join(F.transform(words, F.upper), "_"),
    lambda text, words, h: F.array_join(F.transform(words, F.initcap), ""),
    lambda text, words, h: _numbered(words, h, 3, 100, F.initcap),
    lambda text, words, h: _numbered(words, h, 2, 1000, F.lower),
    lambda text, words, h: F.regexp_replace(_numbered(words, h, 3, 100, F.upper), "[0189]", "2"),
    lambda text, words, h: F.upper(F.array_join(words, "")),
    lambda text, words, h: F.lower(F.array_join(words, "")),
    lambda text, words, h: F.upper(_mixed(words, h)),
    lambda text, words, h: F.lower(_mixed(words, h)),
    lambda text, words, h: F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("string")), ""),
    lambda text, words, h: F.lower(F.hex(text.cast("binary"))),
)


def decoys(text: Column, n: int = DECOYS) -> Column:
    """array<struct<run, encoding, band, level, decoy>>: up to ``n`` of a text, by its hash; short texts give fewer or none."""
    bands = list(pairwise(BANDS[:6]))
    lows, widths = F.array(*(F.lit(a) for a, _ in bands)), F.array(*(F.lit(b - a) for a, b in bands))

    def one(h: Column) -> Column:
        band = (h % len(bands)).cast("int") + 1
        length = F.element_at(lows, band) + (F.shiftright(h, 12) % F.element_at(widths, band)).cast("int")
        place = (F.shiftright(h, 20) % F.greatest(F.char_length(text) - 300, F.lit(1))).cast("int") + 1

        def made(piece: Column) -> Column:
            words = F.regexp_extract_all(piece, F.lit("[A-Za-z]+"), F.lit(0))
            out = _MADE[-1](piece, words, h)
            for i, how in enumerate(_MADE[:-1]):
                out = F.when(F.shiftright(h, 6) % len(_MADE) == i, how(piece, words, h)).otherwise(out)
            return F.substring(out, F.lit(1), length)

        run = let(F.substring(text, place, F.lit(300)), made)
        return let(run, lambda x: F.when(F.char_length(x) == length, judged(x, [], True)))

    drawn = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: let(F.pmod(F.xxhash64(text, k), F.lit(1 << 40)), one))
    return F.filter(drawn, lambda x: x.isNotNull())


def cutoffs(found: DataFrame, fdr: float = FDR) -> dict[tuple[str, int], int]:
    """The lowest level of each (encoding, band) at which false discoveries are within ``fdr``.

    Of D decoys d pass at the level, so a run that is no key passes with a chance
    of r = (d + 1) / (D + 1) at most; the one that is added keeps strata with few
    decoys silent. Of the T runs in the stratum, F pass at no level: about
    (F + 1) / (1 - r at the loosest level) are no keys, and never more than T.
    These, times r, are false among those that pass. A run or decoy that occurs
    many times counts once, so copies of a name are no evidence for each other.
    Counts come as one row per stratum and level.
    """
    table = found.distinct().groupBy("encoding", "band", "level", "decoy").agg(F.count("*").alias("n"))
    runs: dict[tuple[str, int], list[int]] = {}
    made: dict[tuple[str, int], list[int]] = {}
    for r in table.collect():
        (made if r.decoy else runs).setdefault((r.encoding, r.band), [0] * (len(LEVELS) + 1))[r.level] += r.n

    def rates(fits: Callable[[str, int], bool]) -> tuple[int, list[float]]:
        of = [sum(x) for x in zip(*(v for k, v in made.items() if fits(*k)), strict=True)] or [0] * (len(LEVELS) + 1)
        return sum(of), [(sum(of[level:]) + 1) / (sum(of) + 1) for level in range(len(LEVELS) + 1)]

    cuts = {}
    for key, of in runs.items():
        own = [rates(lambda e, b: (e, b) == key), rates(lambda e, b: e == key[0] and b <= key[1])]
        # Shorter bands pass more often, so the lower of both rates is still no lower than the truth but for chance.
        share = [min(x) for x in zip(*(r for _, r in own), strict=True)] if own[1][0] >= ENOUGH else rates(lambda e, b: b <= key[1])[1]
        others = min(sum(of), (of[0] + 1) / (1 - share[1])) if share[1] < 1 else sum(of)
        for level in range(1, len(LEVELS) + 1):
            t = sum(of[level:])
            if t and others * share[level] <= fdr * t:
                cuts[key] = level
                break
    return cuts


def scan(docs: DataFrame, text_col: str = "text", fdr: float = FDR, base_col: str = "_base", spans_col: str = "_spans") -> DataFrame:
    """``docs`` with two more columns, base spans and all spans: ordered arrays of struct<s, r, e, kind>.

    Null text is empty. Base spans are cut out before runs are sought, so the
    method's spans never overlap them, and what is left of a run beside one is
    tested on its own. Rows are scanned one by one: nulls and repeats in other
    columns don't matter, and an empty table gives an empty result. Two passes
    over the texts and a count of rows; hashes of runs and decoys are shuffled, no
    texts or spans.
    """
    text = text_or_empty(text_col)
    fields = ("run", "encoding", "band", "level", "decoy")
    tried = F.transform(candidates(F.col("text")), lambda x: F.struct(*(x[f].alias(f) for f in fields)))
    each = max(DECOYS, min(DECOYS_MOST, DECOYS_IN_ALL // max(1, docs.count())))
    found = docs.select(text.alias("text")).select(F.explode(F.concat(tried, decoys(F.col("text"), each))).alias("x")).select("x.*")
    cuts = cutoffs(found, fdr)
    rows = docs.withColumn(base_col, base_spans(text))

    def passes(x: Column) -> Column:
        out = F.lit(False)
        for (encoding, band), cut in sorted(cuts.items()):
            out = out | ((x["encoding"] == encoding) & (x["band"] == band) & (x["level"] >= cut))
        return out

    added = _no_spans()
    if cuts:
        passed = F.filter(candidates(text), passes)
        added = F.when(text.rlike(RUN), F.transform(passed, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit("random").alias("kind"), F.lit("").alias("hit")))).otherwise(added)
    return rows.withColumn(spans_col, in_order(F.concat(base_col, added))).withColumn(base_col, in_order(F.col(base_col)))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """One row per row of ``docs``: counts and digest of base spans, and all spans as text."""
    found = scan(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", fdr)
    count = lambda kind: F.size(F.filter("_base", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(as_text(F.col("_base")).cast("binary"), 256).alias("base_sha256"),
        as_text(F.col("_spans")).alias("spans"),
    )


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", fdr: float = FDR) -> DataFrame:
    """``docs`` with every span (overlapping ones merged) of the text replaced by ``mark``; null text stays null."""
    base, spans = fresh(docs, "_base"), fresh(docs, "_spans")
    found = scan(docs, text_col, fdr, base, spans)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.col(text_col)

    def step(acc: Column, x: Column) -> Column:
        gap = F.when(x["s"] >= acc["at"], F.concat(F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    done = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.lit(2**31 - 1))))
    return found.withColumn(text_col, F.when(F.size(spans) > 0, done).otherwise(text)).drop(base, spans)
