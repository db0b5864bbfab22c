"""The index kept up to date from a stream of file versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strataforge.sources.python_source import parse_files


def follow(versions: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Parses each new version of a file (path, content, language, content_hash) once and appends it to out.

    A version that is in out already, by path and hash, is not parsed again, within a batch or after one.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(["path", "content_hash"])
        try:
            known = spark.read.parquet(out).select("path", "content_hash")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            known = None
        if known is not None:
            fresh = fresh.join(known, ["path", "content_hash"], "left_anti")
        parsed = parse_files(fresh).join(fresh.select("path", "content_hash"), "path")
        parsed.withColumn("version", F.lit(batch_id)).write.mode("append").parquet(out)

    return versions.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(parsed: DataFrame) -> DataFrame:
    """The last version of each path."""
    rest = [c for c in parsed.columns if c not in ("path", "version")]
    return parsed.groupBy("path").agg(F.max_by(F.struct(*rest), "version").alias("r")).select("path", "r.*")
