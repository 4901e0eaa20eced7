"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import store


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of a link.

    Each round points every node's larger neighbours, then its smaller ones, to
    the smallest neighbour, until no link changes; the number of rounds grows
    with the logarithm of the longest chain. A round's links are written to the
    shared folder. Minima are aggregated before the shuffle and the joins can
    be split, so a node with very many links doesn't fall to one task.
    Self links and null ends are dropped; an empty table gives no rows.
    """
    up = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    up = store(up, "links")

    def state(t: DataFrame) -> tuple:
        return tuple(t.agg(F.count("*"), F.sum("v"), F.sum(F.hash("u", "v").cast("long"))).first())

    seen = state(up)
    while seen[0]:
        both = up.unionByName(up.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("u"), F.least("u", "m").alias("m"))
        # large star: each larger neighbour of u points to the least of u's neighbourhood
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        # small star: u and its smaller neighbours point to the least of them
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        after = (
            joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v")))
            .distinct()
        )
        up = store(after, "links")
        now = state(up)
        if now == seen:
            break
        seen = now
    roots = up.groupBy("u").agg(F.min("v").alias("component"))
    return roots.select(F.col("u").alias("node"), "component").unionByName(
        roots.select(F.col("component").alias("node"), "component").distinct()
    )
