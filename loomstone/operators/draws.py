"""Deterministic draws: a row's hash with a seed decides, so any partitioning gives the same result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.functions.text import fresh


def digest(seed: int | str, *keys: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in keys)))


def number(seed: int | str, *keys: Column) -> Column:
    """32 bits of the digest as a long."""
    return F.conv(F.substring(digest(seed, *keys), 1, 8), 16, 10).cast("long")


def chance(p: float, seed: int | str, *keys: Column) -> Column:
    return F.pmod(number(seed, *keys), F.lit(1_000_000)) < int(p * 1_000_000)


def choose(options: Column, seed: int | str, *keys: Column) -> Column:
    """One of an array's elements, null of an empty one."""
    return F.try_element_at(options, (F.pmod(number(seed, *keys), F.greatest(F.size(options), F.lit(1))) + 1).cast("int"))


def shuffled(options: Column, seed: int | str, *keys: Column) -> Column:
    """An array in the order of its elements' digests."""
    keyed = F.transform(options, lambda x, i: F.struct(digest(seed, *keys, i.cast("string")).alias("d"), x.alias("x")))
    return F.transform(F.sort_array(keyed), lambda v: v["x"])


def sample_per_group(rows: DataFrame, group: str | list[str], key: str, k: int, seed: int | str) -> DataFrame:
    """At most k rows of each group, by the order of their digests; groups are cut before they are shuffled whole."""
    by = [group] if isinstance(group, str) else group
    r = fresh(rows, "rank_in_group")
    w = Window.partitionBy(*by).orderBy(digest(seed, F.col(key)), key)
    return rows.withColumn(r, F.row_number().over(w)).where(F.col(r) <= k).drop(r)


def shuffle_rows(rows: DataFrame, key: Column, seed: int | str) -> DataFrame:
    return rows.orderBy(digest(seed, key), key)
