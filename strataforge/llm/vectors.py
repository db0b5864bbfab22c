"""Vectors of whole numbers: read once from an embedding table, and exact squared distances between them.

A component x becomes floor(1024 * x). Rows are written once as whole numbers, which are smaller than
the floats, and every round of a clustering reads that table. All comparisons that decide a result are
made on whole numbers: products are taken in doubles only where every sum stays below 2**53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A component is floor(SCALE * x).
SCALE = 1024
#: Components lie below this, so that squared distances of a few hundred of them, and their sums over many rows, fit longs.
MOST = 1 << 27


def whole(x: Column) -> Column:
    """floor(SCALE * x), the product in doubles."""
    return F.floor(F.lit(float(SCALE)) * x.cast("double"))


def integers(table: DataFrame, *carry: str) -> DataFrame:
    """carry and v (array<int>) for each row of table whose embedding is not null and holds only finite components.

    A finite component of MOST / SCALE or more in size raises an error: its squares don't fit the
    results. An embedding without components is kept as one.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    kept = table.filter(F.col("embedding").isNotNull() & finite)
    size = lambda x: F.abs(F.lit(float(SCALE)) * x.cast("double"))
    fits = lambda x: F.when(size(x) < MOST - 1, whole(x)).otherwise(F.raise_error(F.lit(f"a component of {MOST // SCALE} or more doesn't fit"))).cast("int")
    return kept.select(*carry, F.transform("embedding", fits).alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list<int> array, all of one length, as a matrix of longs."""
    if not len(column):
        return np.zeros((0, 0), dtype=np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of longs, exact."""
    top = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 1 << 52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def norms(a: np.ndarray) -> np.ndarray:
    """Squared lengths of rows."""
    return (a * a).sum(axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a from all rows of b, exact."""
    return norms(a)[:, None] - 2 * products(a, b) + norms(b)[None, :]


def below(square: np.ndarray | int) -> np.ndarray:
    """A double that isn't over the root of a whole number."""
    return np.sqrt(np.asarray(square, dtype=np.float64)) * (1 - 1e-12)


def above(square: np.ndarray | int) -> np.ndarray:
    """A double that isn't under the root of a whole number."""
    return np.sqrt(np.asarray(square, dtype=np.float64)) * (1 + 1e-12)


def sums_by(code: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of v by code, as longs: one row for each code below n. Exact for batches whose sums stay below 2**53."""
    return np.stack([np.bincount(code, weights=v[:, k], minlength=n) for k in range(v.shape[1])], axis=1).astype(np.int64) if v.shape[1] else np.zeros((n, 0), dtype=np.int64)


def total_rows(batches: Iterator[pa.RecordBatch], parts: int, size: int, assign) -> pa.RecordBatch:
    """Counts and sums of a partition's vectors: a row (part, entry, n, s) for each entry used. assign(v) gives (codes, v) for each part."""
    count, total = None, None
    for batch in batches:
        v = matrix(batch.column(batch.schema.names.index("v")))
        if not len(v):
            continue
        told = assign(v)
        if total is None:
            count, total = np.zeros((parts, size), dtype=np.int64), np.zeros((parts, size, told[0][1].shape[1]), dtype=np.int64)
        for p, (code, own) in enumerate(told):
            count[p] += np.bincount(code, minlength=size)
            total[p] += sums_by(code, own, size)
    used = np.argwhere(count > 0) if total is not None else np.zeros((0, 2), dtype=np.int64)
    rows = [total[p, e].tolist() for p, e in used] if total is not None else []
    n = [int(count[p, e]) for p, e in used] if total is not None else []
    return pa.RecordBatch.from_arrays([pa.array(used[:, 0], pa.int32()), pa.array(used[:, 1], pa.int32()), pa.array(n, pa.int64()), pa.array(rows, pa.list_(pa.int64()))], names=["part", "entry", "n", "s"])


def means(kept: DataFrame, parts: int, width: int, size: int, assign) -> dict[tuple[int, int], np.ndarray]:
    """By (part, entry): floor(sum / count) of the vectors assigned to it. At most parts * size rows come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield total_rows(batches, parts, size, assign)

    partial = kept.select("v").mapInArrow(run, "part int, entry int, n long, s array<long>")
    rows = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.get("s", F.lit(k))).alias(f"s{k}") for k in range(width))).collect()
    return {(r["part"], r["entry"]): np.array([r[f"s{k}"] // r["n"] for k in range(width)], dtype=np.int64) for r in rows}
