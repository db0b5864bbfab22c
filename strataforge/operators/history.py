"""The store as a log: what held when, and what it was at any moment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataforge.operators.graph import chain_ends

#: The end of what still holds.
OPEN = (1 << 63) - 1


def intervals(log: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """(key, value columns, valid_from, valid_to) from a log (key, seq, deleted, value columns): each version holds from its seq to before the next one's or the deletion's.

    Versions of equal seq can't be told apart in time and must not occur. What is deleted and written again holds in two intervals.
    """
    rest = [c for c in log.columns if c not in (key, seq, "deleted")]
    after = F.lead(seq).over(Window.partitionBy(key).orderBy(seq))
    told = log.withColumn("valid_to", F.coalesce(after, F.lit(OPEN)))
    return told.filter("not deleted").select(key, *rest, F.col(seq).alias("valid_from"), "valid_to")


def cascaded(children: DataFrame, parent: str, deletions: DataFrame) -> DataFrame:
    """Intervals of children, ended by the first deletion (parent, seq) of their parent after they began.

    Deletions and children of a parent are put in one order of time; from behind, the last deletion seen is the next one.
    """
    gone = deletions.select(F.col(parent), F.col("seq").alias("_at"), F.lit(True).alias("_gone"))
    rows = children.withColumns({"_at": F.col("valid_from"), "_gone": F.lit(False)})
    both = rows.unionByName(gone, allowMissingColumns=True)
    behind = Window.partitionBy(parent).orderBy(F.desc("_at"), F.col("_gone")).rowsBetween(Window.unboundedPreceding, -1)
    ended = both.withColumn("_end", F.last(F.when(F.col("_gone"), F.col("_at")), ignorenulls=True).over(behind)).filter("not _gone")
    return ended.withColumn("valid_to", F.least("valid_to", F.coalesce("_end", F.lit(OPEN)))).select(*children.columns).filter("valid_from < valid_to")


def as_of(held: DataFrame, moment: Column | int) -> DataFrame:
    """The rows of intervals that hold at a moment."""
    at = F.lit(moment) if isinstance(moment, int) else moment
    return held.filter((F.col("valid_from") <= at) & (at < F.col("valid_to"))).drop("valid_from", "valid_to")


def at_moments(held: DataFrame, moments: DataFrame) -> DataFrame:
    """(moment, ...): the rows of intervals that hold at each moment, from (moment) of bounded number; one pass over held."""
    few = [r["moment"] for r in moments.select("moment").distinct().collect()]
    each = F.filter(F.array(*map(F.lit, sorted(few))).cast("array<bigint>"), lambda m: (F.col("valid_from") <= m) & (m < F.col("valid_to")))
    return held.withColumn("moment", F.explode(each)).drop("valid_from", "valid_to")


def redirected(sessions: DataFrame, moment: int) -> DataFrame:
    """(id, active): where following redirects leads from each session that holds at a moment, as they were then. A redirect to what doesn't hold is followed to it and ends there."""
    now = as_of(sessions, moment)
    return chain_ends(now.select("id", F.col("redirect").alias("next"))).select("id", F.col("last").alias("active"))
