"""Compression of vectors to codes of a few bytes, one for each part, by trees over the codebooks' entries.

A vector is cut into equal parts; each part position has a codebook, and a part's code is the index of
its nearest entry. Entries of a codebook hang in a vantage-point tree: each node has one entry as its
vantage point, and the others below it by their distance from that. A search first goes down to the
nearer child each time, which gives a bound, then visits every child whose ring of distances comes as
near as the best found so far, ties included. Radii are rounded outwards, so that rounding never hides an
entry; what decides is the whole squared distance, then the index.

Codebooks are fitted by rounds over all vectors. A round is one pass: tasks assign their vectors and
emit a sum and a count for each entry used, so what is shuffled and what comes to the driver is bounded
by the codebooks' size, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.llm.vectors import above, below, distances, integers, matrix, means
from strataforge.storage import keep

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Nodes with so many entries or fewer hold them in a list.
LEAF = 8


@dataclass
class Node:
    """A vantage point, and the entries below it: a list, or two children with the least and the largest distance of theirs from it."""

    point: int
    listed: np.ndarray | None = None
    children: tuple[tuple[Node, float, float], ...] = ()


def grow(entries: np.ndarray, below_it: np.ndarray | None = None) -> Node | None:
    """The tree of some entries (all, if not told). The vantage point is the one farthest from their first, so that rings differ."""
    ids = np.arange(len(entries)) if below_it is None else below_it
    if not len(ids):
        return None
    if len(ids) <= LEAF:
        return Node(int(ids[0]), ids)
    point = int(ids[np.argmax(distances(entries[ids], entries[ids[:1]])[:, 0])])
    rest = ids[ids != point]
    far = distances(entries[rest], entries[[point]])[:, 0]
    order = np.argsort(far, kind="stable")
    halves = np.array_split(order, 2)
    return Node(point, None, tuple((grow(entries, rest[h]), float(below(far[h[0]])), float(above(far[h[-1]]))) for h in halves))


class Search:
    """Nearest entries of many points at once: best squared distances and their indexes, ties to the lower index."""

    def __init__(self, tree: Node | None, entries: np.ndarray, points: np.ndarray):
        self.entries, self.points = entries, points
        self.best = np.full(len(points), np.iinfo(np.int64).max)
        self.at = np.full(len(points), -1, dtype=np.int64)
        #: Distances that were compared, to see what the tree saves.
        self.compared = 0
        if tree is not None and len(points):
            every = np.arange(len(points))
            self.descend(tree, every)
            self.visit(tree, every)

    def compare(self, rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whole distances of some points from some entries; the best are taken over."""
        found = distances(self.points[rows], self.entries[ids])
        self.compared += found.size
        low = found.min(axis=1)
        # the least index among the nearest
        index = np.where(found == low[:, None], ids[None, :], len(self.entries)).min(axis=1)
        better = (low < self.best[rows]) | ((low == self.best[rows]) & (index < self.at[rows]))
        self.best[rows[better]], self.at[rows[better]] = low[better], index[better]
        return found

    def descend(self, node: Node, rows: np.ndarray) -> None:
        """Down to one list each, by the nearer ring: the bound that visit() starts from."""
        if not len(rows):
            return
        if node.listed is not None:
            self.compare(rows, node.listed)
            return
        d = np.sqrt(self.compare(rows, np.array([node.point]))[:, 0].astype(np.float64))
        (inner, _, top), (outer, bottom, _) = node.children
        near = d * 2 <= top + bottom
        self.descend(inner, rows[near])
        self.descend(outer, rows[~near])

    def visit(self, node: Node, rows: np.ndarray) -> None:
        """All entries below node that may be as near as the best so far."""
        if not len(rows):
            return
        if node.listed is not None:
            self.compare(rows, node.listed)
            return
        square = self.compare(rows, np.array([node.point]))[:, 0]
        low, high = below(square), above(square)
        for child, least, most in node.children:
            # by the triangle inequality nothing below child is nearer than this
            gap = np.maximum(least - high, low - most)
            self.visit(child, rows[gap <= above(self.best[rows])])


def _assign(books: list[np.ndarray]):
    trees = [grow(b) for b in books]

    def run(v: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each part: codes, the part's components, squared distances."""
        out = []
        for p, own in enumerate(np.split(v, len(books), axis=1)):
            found = Search(trees[p], books[p], own)
            out.append((found.at, own, found.best))
        return out

    return run


def fit(kept: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks of kept (vec_id, v of parts * width components): one matrix of whole numbers for each part.

    They start as the parts of the rows with the least vec_id (null last, then by components). In each round
    an entry becomes the componentwise floor of the mean of its parts; one without parts stays.
    """
    first = kept.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    start = np.array([r["v"] for r in first], dtype=np.int64).reshape(len(first), parts * width)
    books = [b.copy() for b in np.split(start, parts, axis=1)]
    for _ in range(rounds if len(first) else 0):
        assign = _assign(books)
        for (p, e), mean in means(kept, parts, width, len(first), lambda v, f=assign: [x[:2] for x in f(v)]).items():
            books[p][e] = mean
    return books


def encode(kept: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code (hex digits, two or more for each part) and error of each row of kept (vec_id, label, v)."""
    assign = _assign(books)
    digits = max(2, len(f"{max(len(books[0]) - 1, 0):x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            told = assign(matrix(batch.column(2)))
            text = ["".join(f"{c:0{digits}x}" for c in codes) for codes in zip(*(x[0].tolist() for x in told))]
            error = np.sum([x[2] for x in told], axis=0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return kept.select("vec_id", "label", "v").mapInArrow(run, f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, label {kept.schema['label'].dataType.simpleString()}, code string, error long")


def digest(books: list[np.ndarray]) -> str:
    """sha256 of all components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Codes of all vectors of table (vec_id, embedding, label; other columns are ignored).

    Returns vec_id, code, error, label_error and codebooks_sha256. Embeddings that are null or hold a null or
    a component that isn't finite are dropped. Parts are equal only where the length is a multiple of parts, and
    distances need one length: where lengths differ, the commonest such length is taken (the shortest of
    equally common ones), and rows of another have no code and are dropped. Rows that repeat, vec_id
    included, are rows of their own; null labels are one label. Fewer rows than entries give so many entries. An
    empty table gives an empty result.
    """
    kept = keep(integers(table, "vec_id", "label"), "vectors")
    length = kept.groupBy(F.size("v").alias("n")).count().filter((F.col("n") > 0) & (F.col("n") % parts == 0)).orderBy(F.desc("count"), "n").first()
    width = length["n"] // parts if length else 1
    kept = kept.filter(F.size("v") == parts * width)
    books = fit(kept, width, parts, entries, rounds)
    coded = keep(encode(kept, books), "codes")
    # written first: Spark sees the size of a row a label, and splits a hot label's rows where it can't broadcast
    by_label = keep(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "errors")
    told = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return told.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
