"""Running sums and nearest later rows over a whole table in order, without a task that has it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataforge.storage import keep


def running(rows: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """rows with the sums (of longs) over all rows up to each in some order, itself included.

    Rows are dealt out by ranges of the order and written; only one row a range is brought together. The order
    has to tell all rows apart that should have sums of their own.
    """
    dealt = keep(rows.withColumns({f"_{k}": v for k, v in sums.items()}).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    ranges = dealt.groupBy("_range").agg(*(F.sum(f"_{k}").alias(f"_all_{k}") for k in sums))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = keep(ranges.select("_range", *(F.coalesce(F.sum(f"_all_{k}").over(before), F.lit(0)).alias(f"_base_{k}") for k in sums)), "bases")
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    told = dealt.join(base, "_range").withColumns({k: F.col(f"_base_{k}") + F.sum(f"_{k}").over(inside) for k in sums})
    return told.drop("_range", *(f"{x}_{k}" for k in sums for x in ("", "_base")))


def next_from(rows: DataFrame, key: str, found: list[str], probes: DataFrame) -> DataFrame:
    """probes (probe, and others) with the columns found of the row with the least key (a long) that isn't below probe, null if there is none.

    Of rows with the same key the one whose found columns come first counts. Rows and probes are dealt out by
    ranges of the key; a probe behind the last row of its range takes the first of the next that has one.
    """
    rest = [c for c in probes.columns if c != "probe"]
    own = rows.select(F.col(key).alias("_key"), F.lit(0).alias("_kind"), F.struct(*found).alias("_row"), *(F.lit(None).cast(probes.schema[c].dataType).alias(f"_p_{c}") for c in rest))
    asked = probes.select(F.col("probe").alias("_key"), F.lit(1).alias("_kind"), F.lit(None).cast(own.schema["_row"].dataType).alias("_row"), *(F.col(c).alias(f"_p_{c}") for c in rest))
    dealt = keep(own.unionByName(asked).repartitionByRange("_key").withColumn("_range", F.spark_partition_id()), "ranges")
    first = dealt.filter("_kind = 0").groupBy("_range").agg(F.min(F.struct("_key", "_row")).alias("first"))
    ranges = dealt.select("_range").distinct().join(first, "_range", "left")
    later = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    after = keep(ranges.select("_range", F.last("first", ignorenulls=True).over(later).alias("_after")), "firsts")
    # from behind, the last row seen is the nearest one; rows come before probes of the same key
    behind = Window.partitionBy("_range").orderBy(F.desc("_key"), "_kind", F.desc("_row")).rowsBetween(Window.unboundedPreceding, 0)
    told = dealt.withColumn("_near", F.last("_row", ignorenulls=True).over(behind)).filter("_kind = 1").join(after, "_range")
    near = F.coalesce("_near", F.col("_after._row"))
    return told.select(F.col("_key").alias("probe"), *(F.col(f"_p_{c}").alias(c) for c in rest), *(near[c].alias(c) for c in found))
