"""A retrieval index that is kept up to date in segments.

Chunks of a commit are one immutable segment: document, digest of its text,
chunk number, digest and text of the chunk, embedding, and the commit's number.
Replaced and deleted documents leave a tombstone with the commit's number, which
hides their rows of earlier commits. A document whose text has the digest it had
is left alone, and a chunk whose text is already held somewhere takes that
embedding: only new texts are embedded. Compaction writes the rows in sight as one
segment. The parts are kept as revisions (``sources.snapshots``), so a reader sees
one commit as a whole, and older ones can be read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.operators import gates, retrieval
from loomstone.sources.shared import store
from loomstone.sources.snapshots import Snapshots

SEGMENT = "doc_id string, doc_digest string, chunk_no int, digest string, text string, embedding array<double>, seq long"
TOMBSTONE = "doc_id string, seq long"
#: Tombstones that may be broadcast.
SMALL = 1 << 18


def _digest(c: Column) -> Column:
    return F.sha2(F.coalesce(c, F.lit("")), 256)


class Segments:
    """The index in ``folder``. ``embed`` maps a text column to a vector column; ``chunks`` maps (doc_id, text) to (id, chunk_no, chunk);
    ``number`` gives a chunk's id from doc_id (a string) and chunk_no."""

    def __init__(
        self, spark: SparkSession, folder: str, embed: Callable[[Column], Column], chunks: Callable[[DataFrame], DataFrame] = retrieval.recursive_chunks,
        number: Callable[[Column, Column], Column] = F.xxhash64,
    ) -> None:
        self.spark, self.embed, self.chunks, self.number = spark, embed, chunks, number
        self.log = Snapshots(spark, folder)

    def _part(self, name: str, schema: str, revision: int | None) -> DataFrame:
        held = self.log.entry(revision)["parts"].get(name)
        return self.log.read(revision, name) if held else self.spark.createDataFrame([], schema)

    def _in_sight(self, rows: DataFrame, revision: int | None) -> DataFrame:
        """Rows that no later tombstone hides."""
        stones = self._part("tombstones", TOMBSTONE, revision).groupBy("doc_id").agg(F.max("seq").alias("stone"))
        few = not self.log.entry(revision)["parts"].get("tombstones") or stones.count() <= SMALL
        met = rows.join(F.broadcast(stones) if few else stones, "doc_id", "left")
        return met.where("stone is null or seq >= stone").drop("stone")

    def live(self, revision: int | None = None) -> DataFrame:
        """The chunks in sight: (id, doc_id, chunk_no, text, embedding)."""
        rows = self._in_sight(self._part("segments", SEGMENT, revision), revision)
        return rows.select(self.number(F.col("doc_id"), F.col("chunk_no")).alias("id"), "doc_id", "chunk_no", "text", "embedding")

    def documents(self, revision: int | None = None) -> DataFrame:
        """(doc_id, doc_digest) of the documents in sight; chunks' texts aren't read."""
        rows = self._part("segments", SEGMENT, revision).select("doc_id", "doc_digest", "seq")
        return self._in_sight(rows, revision).select("doc_id", "doc_digest").distinct()

    def upsert(self, docs: DataFrame) -> dict:
        """Documents (doc_id, text) added, or put in place of those of their ids. Returns the commit's counts.

        Null texts are empty; rows without id are left out; of several rows of
        one id the greatest text counts. An empty text has no chunk, yet one row
        without text marks the document as known.
        """
        now = self.log.entry()
        seq = now["revision"] + 1
        named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null")
        one = named.groupBy("doc_id").agg(F.max("text").alias("text")).withColumn("doc_digest", _digest(F.col("text")))
        known = self.documents().withColumnRenamed("doc_digest", "old")
        changed = store(one.join(known, "doc_id", "left").where("old is null or old != doc_digest"), "changed")
        # The document's digest goes with its id: chunks needn't be joined with their documents.
        cut = self.chunks(changed.select(F.concat("doc_digest", "doc_id").alias("doc_id"), "text"))
        cut = cut.select(F.expr("substring(id, 65)").alias("doc_id"), F.substring("id", 1, 64).alias("doc_digest"), F.col("chunk_no").cast("int").alias("chunk_no"), F.col("chunk").alias("text"))
        empty = changed.join(cut.select("doc_id").distinct(), "doc_id", "left_anti")
        empty = empty.select("doc_id", "doc_digest", F.lit(-1).alias("chunk_no"), F.lit(None).cast("string").alias("text"))
        rows = store(cut.unionByName(empty).withColumn("digest", F.when(F.col("text").isNotNull(), _digest(F.col("text")))), "chunks")
        segment, embedded = self._embedded(rows)
        segment = segment.withColumn("seq", F.lit(seq)).select(*(c.split()[0] for c in SEGMENT.split(", ")))
        stones = changed.where("old is not null").select("doc_id", F.lit(seq).cast("long").alias("seq"))
        counts = {"changed": changed.count(), "chunks": rows.where("digest is not null").count(), "embedded": embedded}
        self._commit(now, counts, segments=segment, tombstones=stones)
        return counts

    def _embedded(self, rows: DataFrame) -> tuple[DataFrame, int]:
        """Stored chunks with their embedding, and how many texts had to be embedded.

        Only digests are shuffled to see which texts come twice or are held. The chunks
        of all others, which a filter tells, are embedded where they are read; the rest
        is joined by digest.
        """
        with_vector = lambda df: df.withColumn("embedding", self.embed(F.col("text")).cast("array<double>"))
        held = self._part("segments", SEGMENT, None).where("digest is not null")
        times = rows.where("digest is not null").groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "chunk_no")).alias("first"))
        known = times.join(held.select("digest").distinct().withColumn("held", F.lit(True)), "digest", "left").withColumn("held", F.coalesce("held", F.lit(False)))
        shared = store(known.where("n > 1 or held").select("digest", "first", "held"), "shared")
        maybe, alone = gates.Gate(shared, "digest").parted(rows, F.array("digest"))
        met = maybe.join(shared, "digest", "left").withColumn("new", F.coalesce(~F.col("held") & (F.col("first") == F.struct("doc_id", "chunk_no")), F.lit(True)))
        met = store(met.drop("first", "held"), "met")
        first = store(with_vector(met.where("new").drop("new")), "first")
        old = held.select("digest", "embedding").join(shared.where("held").select("digest"), "digest", "left_semi")
        vectors = first.select("digest", "embedding").unionByName(old).dropDuplicates(["digest"])
        again = met.where("not new").drop("new").join(vectors, "digest")
        single, none = alone.where("digest is not null"), rows.where("digest is null").withColumn("embedding", F.lit(None).cast("array<double>"))
        return with_vector(single).unionByName(first).unionByName(again).unionByName(none), single.count() + first.count()

    def delete(self, ids: DataFrame) -> dict:
        """Documents of these ids (doc_id) go; unknown ids and nulls don't matter."""
        now = self.log.entry()
        gone = self.documents().join(ids.select(F.col("doc_id").cast("string").alias("doc_id")).distinct(), "doc_id", "left_semi")
        stones = store(gone.select("doc_id", F.lit(now["revision"] + 1).cast("long").alias("seq")), "tombstones")
        counts = {"deleted": stones.count()}
        # A row of this commit would still be in sight; there is none.
        self._commit(now, counts, tombstones=stones)
        return counts

    def _commit(self, now: dict, counts: dict, **more: DataFrame) -> None:
        added = {part: [*now["parts"].get(part, []), self.log.add(rows)] for part, rows in more.items()}
        self.log.commit(now["parts"] | added, now["revision"], counts)

    def compact(self) -> int:
        """One segment of the rows in sight, no tombstones. Commits made meanwhile make it fail, and lose nothing."""
        now = self.log.entry()
        rows = self._in_sight(self._part("segments", SEGMENT, None), None)
        return self.log.commit({"segments": [self.log.add(rows)]}, now["revision"], {"compacted": len(now["parts"].get("segments", []))})

    def retrieve(self, queries: DataFrame, k: int = 3, min_similarity: float = 0.0, revision: int | None = None) -> DataFrame:
        """As ``retrieval.retrieve`` over the chunks in sight."""
        return retrieval.retrieve(queries, self.live(revision).where("text is not null"), k, min_similarity)

