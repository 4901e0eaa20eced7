"""Tables kept as revisions: a log of immutable folders, read back as they were at any revision.

A commit writes its rows to folders of their own and then one entry of the log,
``log/<number>.json``, which is created only if no other writer has: that is
the moment of the commit, and folders without an entry are never read. An entry
lists the folders that make up each part of the table. Files are pinned by
length and digest, which tasks work out and which are themselves a table; the
driver sees folders, never files or rows.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.sources.sinks import write_text


class Drift(ValueError):
    """The files of a revision aren't those that were committed."""


class Snapshots:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        at = self._path(self.folder)
        self._files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # --- The log ---------------------------------------------------------------------------------

    def revisions(self) -> list[int]:
        at = self._path(f"{self.folder}/log")
        if not self._files.exists(at):
            return []
        return sorted(int(f.getPath().getName().split(".")[0]) for f in self._files.listStatus(at) if f.getPath().getName().endswith(".json"))

    def entry(self, revision: int | None = None) -> dict:
        """The log's entry of a revision, by default the newest; {} of an empty log, KeyError of an unknown revision."""
        known = self.revisions()
        if revision is None and not known:
            return {"revision": 0, "parts": {}, "note": {}}
        number = known[-1] if revision is None else revision
        if number not in known:
            raise KeyError(f"no revision {number} in {self.folder}")
        return json.loads(self.spark.read.text(f"{self.folder}/log/{number:08d}.json", wholetext=True).head()[0])

    def _enter(self, entry: dict) -> None:
        at = f"{self.folder}/log/{entry['revision']:08d}.json"
        ready = f"{self.folder}/ready/{uuid.uuid4().hex}"
        write_text(self.spark, ready, json.dumps(entry))
        if not self._files.exists(self._path(f"{self.folder}/log")):
            self._files.mkdirs(self._path(f"{self.folder}/log"))
        # A rename onto a name that is taken fails: of two writers one wins.
        if self._files.exists(self._path(at)) or not self._files.rename(self._path(ready), self._path(at)):
            raise RuntimeError(f"revision {entry['revision']} of {self.folder} was committed by another writer; read it and try again")

    # --- Writing ----------------------------------------------------------------------------------

    def add(self, rows: DataFrame) -> str:
        """Rows in a folder of their own, which nothing reads until an entry lists it. Returns the folder's name."""
        name = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{name}")
        self._pins(name).write.parquet(f"{self.folder}/pins/{name}")
        return name

    def commit(self, parts: dict[str, list[str]], parent: int, note: dict | None = None) -> int:
        """A revision after ``parent`` made of the named folders; an error if another writer came first."""
        entry = {"revision": parent + 1, "parts": parts, "note": note or {}}
        self._enter(entry)
        return entry["revision"]

    def write(self, rows: DataFrame, append: bool = False, part: str = "rows", note: dict | None = None) -> int:
        """A revision whose part is these rows, after the ones it had if ``append``; other parts stay."""
        now = self.entry()
        before = now["parts"].get(part, []) if append else []
        return self.commit(now["parts"] | {part: [*before, self.add(rows)]}, now["revision"], note)

    # --- Reading ----------------------------------------------------------------------------------

    def _pins(self, name: str) -> DataFrame:
        """(file, length, digest) of a folder's files, read in tasks."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{self.folder}/{name}")
        return files.select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "length", F.sha2("content", 256).alias("digest"))

    def drifted(self, revision: int | None = None) -> DataFrame:
        """(folder, file, problem) of the files that are missing, changed or new since they were committed."""
        out = self.spark.createDataFrame([], "folder string, file string, problem string")
        for name in sorted({n for names in self.entry(revision)["parts"].values() for n in names}):
            then = self.spark.read.parquet(f"{self.folder}/pins/{name}").select("file", F.struct("length", "digest").alias("then"))
            try:
                now = self._pins(name).select("file", F.struct("length", "digest").alias("now"))
            except AnalysisException:  # the folder itself is gone
                now = then.where("false").withColumnRenamed("then", "now")
            problem = F.when(F.col("now").isNull(), "missing").when(F.col("then").isNull(), "new").when(F.col("now") != F.col("then"), "changed")
            found = then.join(now, "file", "full").select(F.lit(name).alias("folder"), "file", problem.alias("problem")).where("problem is not null")
            out = out.unionByName(found)
        return out

    def read(self, revision: int | None = None, part: str = "rows", check: bool = False) -> DataFrame:
        """The rows of a revision; with ``check``, ``Drift`` if a file isn't what was committed. KeyError of a part that isn't there."""
        entry = self.entry(revision)
        if part not in entry["parts"]:
            raise KeyError(f"revision {entry['revision']} of {self.folder} has no {part}")
        if check and (found := self.drifted(revision).orderBy("folder", "file").limit(5).collect()):
            raise Drift(f"revision {entry['revision']} of {self.folder}: " + ", ".join(f"{r.folder}/{r.file} {r.problem}" for r in found))
        return self.spark.read.parquet(*(f"{self.folder}/{n}" for n in entry["parts"][part]))

    def compare(self, old: int, new: int, part: str = "rows") -> DataFrame:
        """The part's rows that only one of two revisions has, as often as it has more of them, with ``change``: removed or added.

        Folders that both list are not read.
        """
        before, after = (self.entry(r)["parts"].get(part, []) for r in (old, new))
        load = lambda names, other: [f"{self.folder}/{n}" for n in names if n not in other]
        gone, come = load(before, after), load(after, before)
        schema = self.read(new if after else old, part).schema
        rows = lambda paths: self.spark.read.parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        a, b = rows(gone), rows(come)
        return a.exceptAll(b).withColumn("change", F.lit("removed")).unionByName(b.exceptAll(a).withColumn("change", F.lit("added")))
