"""Tables kept between the steps of a job, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths written by keep() and not deleted yet, by application.
_KEPT: dict[str, set[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where none is set, a local one if all tasks run in this process, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return f"file://{tempfile.gettempdir()}/strataforge"
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _KEPT.get(spark.sparkContext.applicationId, set()).discard(path)


def folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder for tables, below the shared one; release() deletes it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _KEPT.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    This cuts the lineage, and a lost executor loses nothing: the files outlive it. They stay until
    drop_kept() or release().
    """
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_kept(*frames: DataFrame) -> None:
    """Delete tables written by keep() that no later step reads."""
    for df in frames:
        for root in {f.rpartition("/")[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, root)


def release(spark: SparkSession) -> None:
    """Delete all that keep() has written in this application. Results that still have to be read need these tables: call it after."""
    for path in list(_KEPT.get(spark.sparkContext.applicationId, ())):
        _delete(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
