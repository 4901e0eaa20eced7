"""Exact dedup by an extendible-hash index on shared files, in DataFrame operations only.

A text's key is a 64-bit hash of its normalised form (runs of ASCII white space
become one space). Lookup goes through a directory of slots, addressed by the
hash's leading bits:

1. entries: one row per hash and digest, with the first row and the count.
   Copies collapse before the shuffle.
2. directory: a bucket that holds more than ``capacity`` hashes is split by one
   more bit, which doubles the part of the directory below it; the directory
   doubles until no bucket is overfull, whatever the number of texts.
3. chains: texts of hashes that occur twice or more are sent, once a task and
   text, to the owner of their bucket, which sorts its range by hash and chains
   what shares one. Links of a chain are told apart by their bytes alone. Texts
   of a hash that occurs once never move.
4. index: per bucket, hash and link: digest, first row, count; on shared files.
5. lookup: a row finds its bucket by slot, then its link by hash and digest.
   Should two links of a chain share the digest, rows find theirs by bytes.

The directory is broadcast only if it is small, else joined by slot; the same
goes for the hashes that occur twice. No group of copies reaches one task: it
is counted by partial sums, its text comes once from each task, and the lookup
can be split where a group is large.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import SPACE_CLASS, discard, fresh, joined_small, store, text_or_empty

#: Hashes in a bucket.
CAPACITY = 1 << 14
#: Bits by which the directory is looked at before and between splits.
SPARE_BITS = 3


def normalised(text: Column) -> Column:
    """White-space runs as one space; texts that have none to change skip the replacement."""
    plain = text_or_empty(text)
    return F.when(plain.rlike("[\\x09-\\x0D]|\\x20\\x20"), F.regexp_replace(plain, f"{SPACE_CLASS}+", " ")).otherwise(plain)


def slot_of(h: Column | str, bits: int) -> Column:
    """The leading ``bits`` of a 64-bit hash."""
    return F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("long")


def directory(hashes: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """The directory of distinct hashes ``h`` and its global depth in bits.

    One row per slot in use: slot, depth, bucket. A bucket is the ``depth``
    leading bits that its hashes share, with a one before them, so buckets of
    different depths never share a number. Buckets split one bit at a time
    while they hold more than ``capacity`` hashes.
    """
    bits = min(64, max(0, ceil(log2(max(1, hashes.count()) / capacity))) + SPARE_BITS)
    while True:
        slots = store(hashes.groupBy(slot_of("h", bits).alias("slot")).agg(F.count("*").alias("n")), "dedup-slots")
        if bits == 64 or (slots.agg(F.max("n").alias("n")).first().n or 0) <= capacity:
            break
        bits = min(64, bits + SPARE_BITS)
    nodes = slots.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"))
    nodes = nodes.withColumn("prefix", F.expr(f"shiftrightunsigned(slot, {bits} - depth)"))
    # A hash fills at most one slot of 64 bits, so every slot has a depth that fits.
    fit = nodes.groupBy("depth", "prefix").agg(F.sum("n").alias("held")).where((F.col("held") <= capacity) | (F.col("depth") == bits))
    depths = nodes.join(fit.select("depth", "prefix"), ["depth", "prefix"]).groupBy("slot").agg(F.min("depth").alias("depth"))
    bucket = F.expr(f"shiftrightunsigned(slot, {bits} - depth) + shiftleft(1L, depth)")
    return store(depths.select("slot", "depth", bucket.alias("bucket")), "dedup-directory"), bits


def index_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, hash_bits: int = 64, digest_chars: int = 64) -> DataFrame:
    """One row per row of ``docs``: its group, the row that stays, and the bucket and link that hold it.

    Null text counts as empty. The row with the smallest id stays; null ids sort
    last; of rows that tie (repeated rows, several null ids) exactly one is kept.
    An empty table gives an empty result. Other columns are not read.
    ``hash_bits`` and ``digest_chars`` shorten hash and digest, for tests of collisions.
    """
    digest = F.sha2("norm", 256)
    short = F.substring(digest, 1, digest_chars) if digest_chars < 64 else digest
    cut = F.xxhash64("norm")
    cut = F.shiftleft(F.shiftrightunsigned(cut, 64 - hash_bits), 64 - hash_bits) if hash_bits < 64 else cut
    texts = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm")).withColumn("h", cut)
    keys = store(texts.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "h", short.alias("sha"), *([digest.alias("whole")] if digest_chars < 64 else [])), "dedup-keys")
    whole = F.col("whole") if digest_chars < 64 else F.col("sha")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "rid")).alias("first")
    entries = store(keys.groupBy("h", "sha").agg(first, F.count("*").alias("n")), "dedup-entries")
    hashes = store(entries.groupBy("h").agg(F.sum("n").alias("n")), "dedup-hashes")
    slots, bits = directory(hashes, capacity)

    def owned(rows: DataFrame) -> DataFrame:
        return joined_small(rows.withColumn("slot", slot_of("h", bits)), slots, ["slot"], "inner").drop("slot")

    # Equal bytes meet here, each text once a task; then each chain at the owner of its bucket.
    twice = store(hashes.where("n > 1").select("h"), "dedup-twice")
    met = joined_small(texts, twice, ["h"], "left_semi").select("h", "norm", short.alias("sha"), F.col("doc_id").isNull().alias("z"), "doc_id")
    met = met.groupBy("h", "sha", "norm").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))
    chains = owned(met).repartition("bucket").sortWithinPartitions("bucket", "h", "norm")
    chains = store(chains.select("bucket", "depth", "h", "sha", "norm", "n", "least"), "dedup-chains")
    place = F.expr("row_number() over (partition by bucket, h order by norm)")
    alike = F.expr("count(*) over (partition by bucket, h, sha)")
    linked = chains.select("bucket", "depth", "h", "sha", place.alias("link"), alike.alias("alike"), "n", "least", F.when(alike > 1, F.col("norm")).alias("norm"))
    linked = store(linked, "dedup-links")

    once = owned(entries.join(hashes.where("n = 1").select("h"), "h", "left_semi")).select("bucket", "depth", "h", "sha", F.lit(1).alias("link"), "n", "first.doc_id", "first.rid")
    # Where a link has its digest to itself, its first row is known from the keys.
    alone = linked.where("alike = 1").select("bucket", "depth", "h", "sha", "link", "n", F.col("least").alias("doc_id"))
    alone = alone.join(entries.select("h", "sha", F.col("first.rid").alias("rid")), ["h", "sha"]).select(once.columns)
    index = store(once.unionByName(alone).repartition("bucket").sortWithinPartitions("bucket", "h", "link"), "dedup-index")

    rows = owned(keys).join(index.withColumnsRenamed({"doc_id": "keep_id", "rid": "keep_rid"}).drop("depth"), ["bucket", "h", "sha"])
    out = ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "bucket", "bucket_depth", "link"]
    found = rows.select(
        "doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("rid") == F.col("keep_rid")).alias("kept"),
        whole.alias("text_sha256"), "bucket", F.col("depth").cast("int").alias("bucket_depth"), F.col("link").cast("int").alias("link"),
    )
    twins = linked.where("alike > 1")
    if twins.isEmpty():
        discard(entries, hashes, twice, chains, linked)
        return found
    # Links that share hash and digest: their rows are read again and looked up by their bytes.
    rows = owned(joined_small(texts, store(twins.select("h").distinct(), "dedup-twins"), ["h"], "left_semi")).drop("depth")
    rows = rows.join(twins.withColumnRenamed("least", "keep_id"), ["bucket", "h", "norm"])
    nth = F.expr("row_number() over (partition by bucket, h, link order by doc_id asc nulls last)")
    by_bytes = rows.select(
        "doc_id", "keep_id", F.col("n").alias("group_size"), (nth == 1).alias("kept"), digest.alias("text_sha256"), "bucket",
        F.col("depth").cast("int").alias("bucket_depth"), F.col("link").cast("int").alias("link"),
    )
    return found.unionByName(by_bytes).select(out)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Null text counts as empty, white space as in ``index_documents``. Of rows
    that agree in id and text (repeated rows) one stays, whatever their other
    columns hold; an empty table gives no rows. Only the rows of groups are
    looked up, so a row that no other equals is read and kept where it is.
    """
    sha, at, null = fresh(docs, "_sha"), fresh(docs, "_at"), fresh(docs, "_null")
    keys = lambda i, h: [h.alias(sha), F.coalesce(i, F.lit(0)).alias(at), i.isNull().alias(null)]
    found = index_documents(docs, id_col, text_col).where("group_size > 1")
    named = store(found.groupBy(*keys(F.col("doc_id"), F.col("text_sha256"))).agg(F.count("*").alias("n"), F.max("kept").alias("kept")), "dedup-named")
    rows = docs.select("*", *keys(F.col(id_col), F.sha2(normalised(F.col(text_col)), 256)))
    by = [sha, at, null]
    repeated = store(named.where("kept and n > 1").select(by), "dedup-repeated")
    gone = store(named.where("not kept or n > 1").select(by), "dedup-gone")
    out = joined_small(rows, gone, by, "left_anti").select(docs.columns)
    if repeated.isEmpty():
        return out
    return out.unionByName(joined_small(rows, repeated, by, "left_semi").dropDuplicates(by).select(docs.columns))
