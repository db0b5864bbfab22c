"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.storage import drop_kept, keep


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for each node of the undirected edges (a, b), longs.

    Each round takes the least label among a node's neighbours and then that label's own label, so
    labels travel twice as far each round and long chains need few rounds. Labels are written to the
    shared folder each round; only the count of changed labels comes to the driver. No edges give no
    rows; loops and repeated edges change nothing.
    """
    both = keep(edges.select("a", "b").union(edges.select("b", "a")).distinct().toDF("node", "near"), "edges")
    labels = keep(both.groupBy("node").agg(F.least("node", F.min("near")).alias("component")), "labels")
    while True:
        own = labels.select("node", "component", F.col("component").alias("old"))
        near = both.join(labels.select(F.col("node").alias("near"), "component"), "near").select("node", "component", F.lit(None).cast("long").alias("old"))
        step = own.unionByName(near).groupBy("node").agg(F.max("old").alias("old"), F.min("component").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("component").alias("far"))
        after = keep(step.join(jump, "new", "left").select("node", "old", F.least("new", "far").alias("component")), "labels")
        changed = not after.filter("old != component").isEmpty()
        drop_kept(labels)
        labels = after.select("node", "component")
        if not changed:
            drop_kept(both)
            return labels
