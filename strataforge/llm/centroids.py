"""Centroid clustering with an annulus search.

Centroids are sorted by their norm. A vector's distance from one of them, the one whose norm is nearest
its own, bounds its distance from the nearest; only centroids whose norms lie in the annulus of that
width around the vector's norm can be as near. Two binary searches find them; these candidates, the ones
on the boundary included, are then compared exactly, and ties go to the smaller number.

A round is one pass over all vectors that emits a sum and a count for each centroid and task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.llm.vectors import above, below, distances, integers, matrix, means, norms
from strataforge.storage import keep

CLUSTERS, ROUNDS, DIMENSIONS, SEED = 8, 10, 64, 3


class Annuli:
    """Centroids by norm."""

    def __init__(self, centroids: np.ndarray):
        square = norms(centroids)
        self.order = np.argsort(square, kind="stable")
        self.sorted = centroids[self.order]
        self.root = np.sqrt(square[self.order].astype(np.float64))
        #: Distances that were compared, to see what the annuli save.
        self.compared = 0

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of v: the number of its nearest centroid and the squared distance."""
        square = norms(v)
        own, n, every = np.sqrt(square.astype(np.float64)), len(self.root), np.arange(len(v))
        right = np.clip(np.searchsorted(self.root, own), 0, n - 1)
        left = np.maximum(right - 1, 0)
        first = np.where(np.abs(self.root[left] - own) <= np.abs(self.root[right] - own), left, right)
        best, at = self._from(v, first), self.order[first]
        bound = above(best)
        # a norm that rounding moved out of the annulus is still inside this
        slack = (own + bound + self.root[-1]) * 1e-12
        low = np.searchsorted(self.root, own - bound - slack, side="left")
        high = np.searchsorted(self.root, own + bound + slack, side="right")
        for k in range(n):
            rows = every[(low <= k) & (k < high) & (first != k)]
            if not len(rows):
                continue
            found = distances(v[rows], self.sorted[[k]])[:, 0]
            self.compared += len(rows)
            number = self.order[k]
            better = (found < best[rows]) | ((found == best[rows]) & (number < at[rows]))
            best[rows[better]], at[rows[better]] = found[better], number
        return at, best

    def _from(self, v: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Squared distance of each row from one centroid of its own."""
        gap = v - self.sorted[which]
        self.compared += len(v)
        return (gap * gap).sum(axis=1)


def fit(kept: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Centroids of kept (vec_id, v), of whole numbers.

    They start as the rows with the least sha256 of seed, a colon and vec_id (rows without an id last, then by
    components). In each round a centroid becomes the componentwise floor of its vectors' mean; one without
    vectors stays.
    """
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.select(mark.alias("mark"), "v").orderBy(F.col("mark").asc_nulls_last(), "v").limit(clusters).collect()
    centroids = np.array([r["v"] for r in first], dtype=np.int64)
    for _ in range(rounds if len(first) else 0):
        annuli = Annuli(centroids)
        for (_, e), mean in means(kept, 1, centroids.shape[1], len(first), lambda v, a=annuli: [(a.nearest(v)[0], v)]).items():
            centroids[e] = mean
    return centroids


def assign(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and distance of each row of kept (vec_id, v)."""
    annuli = Annuli(centroids) if len(centroids) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and annuli:
                at, best = annuli.nearest(matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.int32()), pa.array(best, pa.int64())], names=["vec_id", "cluster", "distance"])

    return kept.select("vec_id", "v").mapInArrow(run, f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, cluster int, distance long")


def cluster(table: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """Clusters of all vectors of table (vec_id, embedding; other columns are ignored).

    Returns vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256. Embeddings that
    are null, hold a null or a component that isn't finite, or haven't exactly dimensions components, are
    dropped. Rows that repeat, vec_id included, are rows of their own. Fewer rows than clusters give so many
    clusters. An empty table gives an empty result.
    """
    kept = keep(integers(table.filter(F.size("embedding") == dimensions), "vec_id"), "vectors")
    centroids = fit(kept, clusters, rounds, seed)
    told = keep(assign(kept, centroids), "clusters")
    # a row a cluster: their number is a parameter
    sums = dict(told.groupBy("cluster").agg(F.sum("distance").alias("n")).collect())
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    of = lambda values, kind: F.get(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.col("cluster"))
    inertia = F.lit(sum(sums.values())).cast("long")
    return told.select("vec_id", "cluster", "distance", of([sums.get(k, 0) for k in range(len(centroids))], "bigint").alias("cluster_inertia"), inertia.alias("inertia"), of(names, "string").alias("centroid_sha256"))
