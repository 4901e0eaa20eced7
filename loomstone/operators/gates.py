"""Semi and anti joins with large key tables behind a Bloom filter.

The filter is aggregated from the keys: bits by words of 64, at most 2**26 bits
in one row of 8 MB. Rows look into it by a scalar subquery, in the JVM and
before anything is exploded or moved; a row that doesn't pass holds no key for
certain. Only rows that pass are joined with the keys, which settles them exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.functions.text import fresh
from loomstone.sources.shared import store

#: Bits a key, and the most of all: a filter of one row has a fixed bound.
PER_KEY, MOST_BITS = 12, 26


class Gate:
    """Which keys may be among those held; ``held`` has them in column ``key``, null for none."""

    def __init__(self, held: DataFrame, key: str = "key") -> None:
        spark, n = held.sparkSession, held.count()
        self.log = min(MOST_BITS, max(6, (PER_KEY * max(1, n) - 1).bit_length()))
        at = held.where(F.col(key).isNotNull()).select(F.explode(F.array(*self._places(F.col(key)))).alias("at"))
        # 1 << (at % 64), as a sum of a table of 64 words
        bit = F.element_at(F.array(*(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64))), (F.col("at").bitwiseAND(F.lit(63)) + 1).cast("int"))
        words = at.select(F.shiftright("at", 6).alias("id"), bit.alias("bit")).groupBy("id").agg(F.bit_or("bit").alias("bits"))
        every = spark.range(1 << (self.log - 6)).join(words, "id", "left").select(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("w"))
        self.row = store(every.agg(F.transform(F.array_sort(F.collect_list("w")), lambda w: w["bits"]).alias("bits")), "gate")

    def _places(self, key: Column) -> list[Column]:
        """Four bits a key, from the fields of two hashes."""
        mask = F.lit((1 << self.log) - 1).cast("long")
        hashes = F.xxhash64(key), F.xxhash64(key, F.lit(1))
        return [F.shiftrightunsigned(h, s).bitwiseAND(mask) for h in hashes for s in (0, 32)]

    def may_hold(self, key: Column, bits: Column) -> Column:
        """False only for keys that aren't held, and null."""
        found = F.lit(True)
        for at in self._places(key):
            word = F.element_at(bits, (F.shiftright(at, 6) + 1).cast("int"))
            found = found & (F.getbit(word, at.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return F.coalesce(found & key.isNotNull(), F.lit(False))

    def parted(self, rows: DataFrame, keys: Column) -> tuple[DataFrame, DataFrame]:
        """(rows that may hold one of their ``keys``, rows that hold none); ``keys`` is an array, null for none."""
        bits, may = fresh(rows, "bits"), fresh(rows, "may")
        looked = rows.withColumn(bits, self.row.scalar()).withColumn(may, F.coalesce(F.exists(keys, lambda k: self.may_hold(k, F.col(bits))), F.lit(False))).drop(bits)
        return looked.where(may).drop(may), looked.where(~F.col(may)).drop(may)


def split_by_keys(rows: DataFrame, keys: Column, held: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(rows of which some key is held, rows of which none is). ``keys`` is an array of strings, ``held`` has them in column ``key``.

    Null arrays, null keys and null held keys match nothing. Rows that pass the
    filter are written once with a number and only their keys are shuffled;
    repeated rows stay repeated, repeated held keys don't matter.
    """
    passed, free = Gate(held, key).parted(rows, keys)
    number = fresh(rows, "row_number")
    some = store(passed.withColumn(number, F.monotonically_increasing_id()), "passed")
    k = fresh(some, "held_key")
    met = some.select(number, F.explode(keys).alias(k)).distinct().join(held.select(F.col(key).alias(k)), k, "left_semi").select(number).distinct()
    own, other = some.join(met, number, "left_semi").drop(number), some.join(met, number, "left_anti").drop(number)
    return own, free.unionByName(other)
