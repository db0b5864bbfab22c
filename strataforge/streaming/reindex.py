"""A code index that follows versions of files: what a batch changes is resolved again, and nothing else.

Each batch adds three tables to the index, which earlier ones are never changed by: its files' versions (with
tombstones for deleted files), their definitions, and targets of calls. What holds is found on reading: the
last version of each file, the definitions and calls of that version, and of each call the last target.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strataforge.storage import keep

#: A version of a file as a batch has it.
VERSION = "path string, seq bigint, deleted boolean, definitions array<string>, calls array<string>"
TARGET = "path string, seq bigint, name string, target string"


def best_definitions(definitions: DataFrame) -> DataFrame:
    """(name, anywhere): the file that a name means outside files which define it themselves: the first by path."""
    return definitions.groupBy("name").agg(F.min("path").alias("anywhere"))


def resolve(calls: DataFrame, definitions: DataFrame) -> DataFrame:
    """calls (path, seq, name) with target: the file itself if it defines the name, else the first by path that does, else null."""
    own = definitions.select("path", "name", F.lit(True).alias("own")).distinct()
    # written first, so that joins deal out the calls of a common name anew where they are too many
    any_file = keep(best_definitions(definitions), "best")
    told = calls.join(any_file, "name", "left").join(own, ["path", "name"], "left")
    return told.select("path", "seq", "name", F.when(F.col("own"), F.col("path")).otherwise(F.col("anywhere")).alias("target"))


@dataclass
class Index:
    """The index below a folder that all executors share."""

    spark: SparkSession
    root: str

    def _log(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        table = self.spark.read.schema(f"{schema}, batch bigint").parquet(f"{self.root}/{name}") if there else self.spark.createDataFrame([], f"{schema}, batch bigint")
        return table

    def _write(self, table: DataFrame, name: str, batch: int) -> None:
        # a batch that is run again after a failure replaces what it has written
        table.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch}")

    def versions(self, before: int | None = None) -> DataFrame:
        """The last version of each file that isn't deleted, or any with deleted if the tombstone is last; before tells of batches before one only."""
        log = self._log("versions", VERSION)
        log = log if before is None else log.filter(F.col("batch") < before)
        rest = [c for c in log.columns if c not in ("path", "batch")]
        return log.groupBy("path").agg(F.max_by(F.struct(*rest), "seq").alias("v")).select("path", "v.*")

    def files(self, before: int | None = None) -> DataFrame:
        return self.versions(before).filter("not deleted")

    def definitions(self, before: int | None = None) -> DataFrame:
        """(path, name) of all that files define."""
        return self.files(before).select("path", F.explode("definitions").alias("name")).distinct()

    def calls(self, before: int | None = None) -> DataFrame:
        """(path, seq, name) of all that files call."""
        return self.files(before).select("path", "seq", F.explode("calls").alias("name")).distinct()

    def resolved(self) -> DataFrame:
        """(path, name, target): what each call of each file means now; a null target is external."""
        last = self._log("targets", TARGET).groupBy("path", "seq", "name").agg(F.max_by(F.struct("target"), "batch").alias("t"))
        return last.join(self.files().select("path", "seq"), ["path", "seq"], "left_semi").select("path", "name", "t.target")

    def apply(self, batch: DataFrame, number: int) -> None:
        """Adds a batch of versions, in any order; numbers of batches grow.

        Of a file's versions in a batch only the last counts, and only if it is later than what is known. Calls
        of the batch's files are resolved, and those of other files by a name that the batch's files define
        now or did before: these have lost their target or have a better one.
        """
        rest = ("seq", "deleted", "definitions", "calls")
        last = batch.groupBy("path").agg(F.max_by(F.struct(*rest), "seq").alias("v")).select("path", "v.*")
        known = self.versions(before=number).select("path", F.col("seq").alias("had"))
        fresh = keep(last.join(known, "path", "left").filter(F.col("had").isNull() | (F.col("seq") > F.col("had"))).select("path", *rest), "fresh")
        paths = fresh.select("path")
        before = self.definitions(before=number).join(paths, "path", "left_semi").select("name")
        names = keep(fresh.filter("not deleted").select(F.explode("definitions").alias("name")).union(before).distinct(), "names")
        self._write(fresh, "versions", number)
        now = keep(self.files(before=number + 1), "files")
        calls = now.select("path", "seq", F.explode("calls").alias("name")).distinct()
        again = calls.join(paths, "path", "left_semi").union(calls.join(names, "name", "left_semi").select("path", "seq", "name")).distinct()
        again = keep(again, "again")
        defined = now.select("path", F.explode("definitions").alias("name")).join(again.select("name").distinct(), "name", "left_semi").select("path", "name").distinct()
        self._write(resolve(again, defined), "targets", number)


def follow(versions: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Applies each micro-batch of a stream of versions (VERSION) to the index below root."""

    def step(batch: DataFrame, number: int) -> None:
        Index(batch.sparkSession, root).apply(batch, number)

    return versions.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_parse(changed: DataFrame, resolved: DataFrame, hops: int = 1) -> DataFrame:
    """(path): changed files, and those whose calls lead to them within so many hops: what has to be read again with them."""
    edges = keep(resolved.filter("target is not null and target != path").select("path", F.col("target")).distinct(), "edges")
    found = keep(changed.select("path").distinct(), "parse")
    for _ in range(hops):
        more = edges.join(found.withColumnRenamed("path", "target"), "target", "left_semi").select("path")
        found = keep(found.union(more).distinct(), "parse")
    return found
