"""Substring deduplication by seeds that are extended both ways.

Seeds are winnowed anchors: of each WINDOW - ANCHOR + 1 consecutive runs of ANCHOR words, the one
with the least hash. Every window of WINDOW words has exactly one anchor, found from the window
alone, so equal windows have equal anchors and only documents that share an anchor can share a
window. Seeds that meet are extended left and right to the windows around them: a seed stands for a
run of consecutive windows. Seeds of one anchor whose extended runs are equal repeat as a whole; the
others are compared window by window. Joined windows make up the maximal repeats.

All comparisons are counts by hash, so a passage that very many documents share costs no pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.llm.words import mix, shingles, slices
from strataforge.storage import drop_kept, keep

WINDOW = 35
ANCHOR = 12


#: The low bits of a hash, in which its place in the document is put: texts of up to 2**28 words.
_PLACE = np.uint64((1 << 28) - 1)
_ROW = "n_words long, seq_a long, seq_b long"


def window_anchors(hashes: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """Of one document's word hashes: where runs of windows with the same anchor begin (and the end), and their anchors' hashes.

    Of equal hashes in a window the last one counts, so no two windows of one run are equal.
    """
    grams, width, span = shingles(hashes, anchor), 1, window - anchor + 1
    if len(grams) < span:
        return np.zeros(1, np.int64), np.zeros(0, np.uint64)
    least = (grams | _PLACE) - np.arange(len(grams), dtype=np.uint64)
    while 2 * width <= span:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    limits = np.flatnonzero(np.r_[True, least[1:] != least[:-1], True])
    return limits, grams[(_PLACE - (least[limits[:-1]] & _PLACE)).astype(np.int64)]


def _sequence(hashes: np.ndarray) -> tuple[int, int]:
    """Two hashes of a whole word sequence."""
    placed = mix(hashes + np.arange(len(hashes), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return int(placed.sum(dtype=np.uint64)), int(mix(placed ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _signed(values: list) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch.column(3), lower=False):
            out: list[list] = [[] for _ in range(5)]
            rows = slice(part.rows.start, part.rows.stop)
            for text, a, b in zip(batch.column(3)[rows], part.first[:-1], part.first[1:]):
                hashes = part.hash[a:b]
                seeds = window_anchors(hashes)[1]
                for column, value in zip(out, (b - a, *_sequence(hashes), _digest((text.as_py() or "").encode().split()), seeds.view(np.int64))):
                    column.append(value)
            same = [batch.column(k)[rows] for k in (0, 1, 2)]
            arrays = [*same, pa.array(out[0], pa.int64()), _signed(out[1]), _signed(out[2]), pa.array(out[3], pa.string()), pa.array(out[4], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "key", "print", "n_words", "seq_a", "seq_b", "kept_sha256", "anchors"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, print, anchors, text): the runs of windows around the given anchors."""
    names = ["key", "print", "anchor", "span", "start", "windows"]
    for batch in batches:
        for part in slices(batch.column(3), lower=False):
            out: list[list] = [[] for _ in names]
            for k, a, b in zip(part.rows, part.first[:-1], part.first[1:]):
                hashes = part.hash[a:b]
                (limits, anchors), windows = window_anchors(hashes), shingles(hashes, WINDOW)
                given = np.array(batch.column(2)[k].as_py(), dtype=np.int64).view(np.uint64)
                spans = np.add.reduceat(mix(windows), limits[:-1])
                for r in np.flatnonzero(np.isin(anchors, given)):
                    low, high = limits[r], limits[r + 1]
                    for column, value in zip(out, (batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), int(anchors[r]), int(spans[r]), int(low), windows[low:high].view(np.int64))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), _signed(out[2]), _signed(out[3]), pa.array(out[4], pa.int64()), pa.array(out[5], pa.list_(pa.int64()))], names=names)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (seq_a, seq_b, text, ranges of window starts): how many words go, and the digest of those that stay."""
    for batch in batches:
        gone, told = [], []
        for text, ranges in zip(batch.column(2), batch.column(3)):
            words = text.as_py().encode().split()
            edge = np.zeros(len(words) + 1, dtype=np.int64)
            for r in ranges.as_py():
                edge[r["start"]] += 1
                edge[min(len(words), r["start"] + r["n"] + WINDOW - 1)] -= 1
            stay = np.cumsum(edge[:-1]) == 0
            gone.append(int(len(words) - stay.sum()))
            told.append(_digest([w for w, s in zip(words, stay) if s]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gone, pa.int64()), pa.array(told, pa.string())], names=["seq_a", "seq_b", "n_cut", "cut_sha256"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Removes each word covered by a window of WINDOW words whose sequence also starts elsewhere.

    docs needs doc_id and text; other columns are ignored. Returns doc_id, n_words, n_removed and
    kept_sha256 (of the kept words joined by one space), one row for each input row. Windows are judged
    on the input: all places of a repeat lose it, the first too. Rows with the same words are copies of
    each other, whatever their doc_id, null included. A null text has no words; texts under WINDOW words
    lose nothing. An empty table gives an empty result.
    """
    # a text's own name: its id, should that be null or repeated, is told apart by a hash of the text
    print_of = F.xxhash64("text")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), print_of).alias("key"), print_of.alias("print"), "text")
    name = ["key", "print"]
    scan = keep(texts.mapInArrow(_scan, f"doc_id long, key long, print long, {_ROW}, kept_sha256 string, anchors array<long>"), "scan")
    least = F.min(F.struct(*name))
    classes = scan.filter(F.col("n_words") >= WINDOW).groupBy("seq_a", "seq_b").agg(least.alias("name"), F.count("*").alias("copies"), F.any_value("anchors").alias("anchors"))
    classes = keep(classes.select("seq_a", "seq_b", "name.key", "name.print", "copies", "anchors"), "classes")

    seeds = classes.select("key", F.explode("anchors").alias("anchor"))
    # written first: with two plain exchanges below it, Spark can split the join of a very common anchor
    shared = keep(seeds.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "shared")
    met = seeds.join(shared, "anchor").groupBy("key").agg(F.collect_set("anchor").alias("anchors"))
    unique = texts.select(*name, "text").join(classes.drop("anchors").join(met, "key"), name)
    found = keep(unique.select("seq_a", "seq_b", *name, "copies", "anchors", "text"), "met")
    runs = keep(found.select(*name, "anchors", "text").mapInArrow(_runs, "key long, print long, anchor long, span long, start long, windows array<long>"), "runs")

    place = F.xxhash64(*name, "start")
    spans = keep(runs.groupBy("anchor", "span").agg(F.min(place).alias("one"), F.max(place).alias("two")), "spans")
    differ = keep(spans.groupBy("anchor").agg(F.min("span").alias("low"), F.max("span").alias("high")).filter("low != high").select("anchor"), "differ")
    repeated = keep(spans.filter("one != two").select("anchor", "span"), "repeated")
    whole = runs.select(*name, "anchor", "span", "start", F.size("windows").alias("n")).join(repeated, ["anchor", "span"]).select(*name, "start", "n")
    # runs that differ around one anchor may share some of their windows; one run stands for all equal ones
    several = keep(spans.join(differ, "anchor"), "several")
    apart = runs.join(several, ["anchor", "span"]).filter(place == F.col("one"))
    windows = keep(apart.select(*name, "anchor", "start", (F.col("one") == F.col("two")).alias("once"), F.posexplode("windows").alias("k", "window")), "windows")
    at = F.xxhash64(*name, F.col("start") + F.col("k"))
    # equal windows have equal anchors, so the two hashes together name a window; written first, as shared
    twice = keep(windows.groupBy("anchor", "window").agg(F.min(at).alias("low"), F.max(at).alias("high")).filter("low != high").select("anchor", "window"), "twice")
    single = windows.filter("once").join(twice, ["anchor", "window"]).select(*name, (F.col("start") + F.col("k")).alias("start"), F.lit(1).alias("n"))
    ranges = whole.union(single).groupBy(*name).agg(F.collect_set(F.struct("start", "n")).alias("ranges"))

    cut = found.filter("copies = 1").join(ranges, name).select("seq_a", "seq_b", "text", "ranges").mapInArrow(_cut, "seq_a long, seq_b long, n_cut long, cut_sha256 string")
    copied = classes.filter("copies > 1").select("seq_a", "seq_b", F.lit(-1).cast("long").alias("n_cut"), F.sha2(F.lit(""), 256).alias("cut_sha256"))
    changed = keep(cut.union(copied), "changed")
    drop_kept(shared, classes, found, runs, spans, differ, repeated, several, windows, twice)
    out = scan.drop("anchors").join(changed, ["seq_a", "seq_b"], "left")
    removed = F.when(F.col("n_cut") < 0, F.col("n_words")).otherwise(F.coalesce("n_cut", F.lit(0).cast("long")))
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.coalesce("cut_sha256", "kept_sha256").alias("kept_sha256"))
