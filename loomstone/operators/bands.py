"""Joins of values with the bands (low, high) they lie in, as joins of equal keys.

A band belongs to the level whose bins are as wide as the band or up to twice as
wide, so it meets a few bins of its own level; a value has one bin on each
level that some band has. Values and bands meet by level and bin, and the bounds are compared
after that. Bins with very many values are dealt into parts, and their bands go
to each part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions.text import fresh
from loomstone.sources.shared import store

#: Values of a bin that one task takes, and rows of hot bins that may be broadcast.
HOT = 1 << 20
SMALL = 1 << 18
#: Levels below the spread of all values: narrower bands count as the narrowest.
DEPTH = 40


def _bin(x: Column, first: float, width: Column) -> Column:
    return F.floor((x - F.lit(first)) / width).cast("long")


def band_join(rows: DataFrame, bands: DataFrame, value: str, low: str = "low", high: str = "high", hot: int = HOT) -> DataFrame:
    """Every row with every band for which low <= value < high, numbers as doubles; columns of both.

    Null and not-a-number values and bounds match nothing, nor does a band whose
    low isn't below its high; infinite bounds are open ends. Repeated rows and
    bands each count. A column of ``bands`` with a name that ``rows`` has ends in
    ``_band``.
    """
    v, lo, hi = (F.col(c).cast("double") for c in (value, low, high))
    spread = rows.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))).agg(F.min(v), F.max(v)).head()
    named = [F.col(c).alias(c if c not in rows.columns else fresh(rows, f"{c}_band")) for c in bands.columns]
    first, last = spread
    names = {c: fresh(rows.join(bands.select(*named), F.lit(True)), c) for c in ("at_level", "at_bin", "at_part", "band_low", "band_high")}
    level, place, part, from_, to = (names[c] for c in names)
    held = bands.select(*named, lo.alias(from_), hi.alias(to)).where(F.col(from_) < F.col(to)).where(~F.isnan(from_) & ~F.isnan(to))
    if first is None:
        return rows.join(held, F.lit(False)).drop(from_, to)
    least = max((last - first) / 2.0**DEPTH, abs(first) * 2.0**-50, abs(last) * 2.0**-50, 2.0**-1000)
    start, end = F.greatest(F.col(from_), F.lit(first)), F.least(F.col(to), F.lit(last))
    held = held.where((F.col(from_) <= last) & (F.col(to) > first)).withColumn(level, F.ceil(F.log2(F.greatest(end - start, F.lit(least)))).cast("int"))
    width = F.pow(F.lit(2.0), F.col(level))
    held = held.withColumn(place, F.explode(F.sequence(_bin(start, first, width), _bin(end, first, width))))
    # A few dozen at most: they lie between the narrowest and the spread of all values.
    levels = sorted(r[0] for r in held.select(level).distinct().collect())
    if not levels:
        return rows.join(held.drop(level, place), F.lit(False)).drop(from_, to)
    bins = F.array(*(F.struct(F.lit(k).alias(level), _bin(v, first, F.lit(2.0**k)).alias(place)) for k in levels))
    inside = v.isNotNull() & ~F.isnan(v) & (v >= first) & (v <= last)
    spots = rows.where(inside).select("*", F.inline(bins))
    # Where no bin can be hot there is nothing to count.
    if rows.count() > hot:
        counts = rows.where(inside).select(F.inline(bins)).groupBy(level, place).agg(F.ceil(F.count("*") / hot).cast("int").alias(part)).where(F.col(part) > 1)
        full = store(counts, "bins")
        full = F.broadcast(full) if full.count() <= SMALL else full
        spots = spots.join(full, [level, place], "left").withColumn(part, F.pmod(F.monotonically_increasing_id(), F.coalesce(part, F.lit(1))).cast("int"))
        held = held.join(full, [level, place], "left").withColumn(part, F.explode(F.sequence(F.lit(0), F.coalesce(part, F.lit(1)) - 1)))
    else:
        spots, held = spots.withColumn(part, F.lit(0)), held.withColumn(part, F.lit(0))
    met = spots.join(held, [level, place, part]).where((v >= F.col(from_)) & (v < F.col(to)))
    return met.drop(level, place, part, from_, to)
