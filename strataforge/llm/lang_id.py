"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A run of three letters is bound into one vector: the
first letter's rotated twice, times the second's rotated once, times the third's. The sum of these
vectors is a text's profile; the sum over all texts of a language is its prototype. A text gets the
language whose prototype has the largest cosine with its profile.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.storage import keep

DIMENSIONS = 512
#: Code points of text handled at once.
SLICE_CHARS = 1 << 19
#: Letters are told apart by so many classes of code points; Latin and other small alphabets don't meet.
LETTERS = 1 << 10
UNKNOWN = "und"
#: A run of letters is usual in a language if at least this part of the language's runs, and so many of them, are it.
USUAL, USUAL_LEAST = 3e-5, 3
#: Languages that one pass judges: what comes to the driver and goes to all tasks at once has a fixed bound, whatever is in lang. More languages take more passes.
AT_ONCE = 250


@cache
def _letters() -> np.ndarray:
    """For each code point: the class (1 or more) of its lower-case letter, or 0 if it is none."""
    out = np.zeros(0x110000, dtype=np.uint16)
    for point in range(len(out)):
        if unicodedata.category(chr(point))[0] == "L":
            out[point] = 1 + ord(chr(point).lower()[0]) % (LETTERS - 1)
    return out


@cache
def _vectors() -> np.ndarray:
    signs = np.random.default_rng(11).integers(0, 2, (LETTERS, DIMENSIONS), dtype=np.int8) * 2 - 1
    signs[0] = 1  # what is no letter separates words and doesn't change a bound vector
    return signs


def bound(codes: np.ndarray) -> np.ndarray:
    """The vectors of n-grams given by their codes."""
    v = _vectors()
    first, second, third = codes // (LETTERS * LETTERS), codes // LETTERS % LETTERS, codes % LETTERS
    return (np.roll(v, 2, axis=1)[first] * np.roll(v, 1, axis=1)[second] * v[third]).astype(np.float32)


def grams(letters: np.ndarray) -> np.ndarray:
    """Codes of runs of three, of which the middle one is a letter: word starts and ends count too."""
    padded = np.concatenate(([0], letters, [0])).astype(np.int64)
    codes = (padded[:-2] * LETTERS + padded[1:-1]) * LETTERS + padded[2:]
    return codes[padded[1:-1] > 0]


def _parts(texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Row numbers and the letter classes of the rows from there on, some rows at a time."""
    table, start, held, size = _letters(), 0, [], 0
    for k, text in enumerate(texts):
        points = np.frombuffer((text.as_py() or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        held.append(table[points])
        size += len(points)
        if size >= SLICE_CHARS:
            yield start, held
            start, held, size = k + 1, [], 0
    if held:
        yield start, held


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Profiles of (text, lang) rows, summed by language within the partition; the last number of each is that of its rows."""
    total: dict[str, np.ndarray] = {}
    rows_of: Counter[str] = Counter()
    for batch in batches:
        langs = batch.column(1).to_pylist()
        rows_of.update(langs)
        for start, held in _parts(batch.column(0)):
            by_lang: dict[str, list] = {}
            for k, letters in enumerate(held):
                by_lang.setdefault(langs[start + k], []).append(grams(letters))
            for lang, found in by_lang.items():
                codes, counts = np.unique(np.concatenate(found), return_counts=True)
                total[lang] = total.get(lang, 0) + (counts.astype(np.float64) @ bound(codes) if len(codes) else np.zeros(DIMENSIONS))
    rows = [(lang, k, float(x)) for lang, v in total.items() for k, x in enumerate([*v, rows_of[lang]])]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.float64())], names=["lang", "k", "x"])


def learn(docs: DataFrame) -> DataFrame:
    """(lang, prototype) from all rows of docs (text, lang) whose lang is not null: one row for each language."""
    sums = docs.filter("lang is not null").select("text", "lang").mapInArrow(_sum, "lang string, k int, x double").groupBy("lang", "k").agg(F.sum("x").alias("x"))
    whole = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "x")))["x"].alias("v"))
    return whole.select("lang", F.slice("v", 1, DIMENSIONS).alias("prototype"))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each run occurs in (text, lang) rows, summed by language within the partition."""
    total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        langs = batch.column(1).to_pylist()
        for start, held in _parts(batch.column(0)):
            by_lang: dict[str, list] = {}
            for k, letters in enumerate(held):
                by_lang.setdefault(langs[start + k], []).append(grams(letters))
            for lang, found in by_lang.items():
                codes, counts = np.unique(np.concatenate(found), return_counts=True)
                if lang in total:
                    codes, place = np.unique(np.concatenate((total[lang][0], codes)), return_inverse=True)
                    counts = np.bincount(place, weights=np.concatenate((total[lang][1], counts)), minlength=len(codes)).astype(np.int64)
                total[lang] = codes, counts
    for lang, (codes, counts) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes, pa.int64()), pa.array(counts, pa.int64())], names=["lang", "code", "n"])


def usual(docs: DataFrame) -> DataFrame:
    """(lang, least, total, codes): the runs usual in each language of docs (text, lang), each with its count, from all rows whose lang is not null.

    At most 1 / USUAL runs a language; total counts all of the language's runs, and least of them make one usual.
    """
    counts = keep(docs.filter("lang is not null").select("text", "lang").mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")), "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total")).withColumn("least", F.greatest(F.lit(float(USUAL_LEAST)), USUAL * F.col("total")))
    totals = keep(totals, "totals")
    found = counts.join(totals, "lang").filter("n >= least").groupBy("lang").agg(F.collect_list(F.struct("code", "n")).alias("codes"))
    return totals.join(found, "lang", "left")


def _tables(frequent: DataFrame) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
    """By language: least, and the usual runs in order with their counts."""
    out = {}
    for batch in frequent.select("lang", "least", "codes").toArrow().to_batches():
        for k, (lang, least) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            pairs = batch.column(2)[k].values
            codes, counts = (x.to_numpy(zero_copy_only=False) for x in pairs.flatten()) if pairs is not None else (np.zeros(0, dtype=np.int64),) * 2
            order = np.argsort(codes)
            out[lang] = least, codes[order].astype(np.int32), counts[order].astype(np.int64)
    return out


def _often(tables: dict, codes: np.ndarray) -> dict[str, np.ndarray]:
    """For each language the counts of these runs, 0 where a run isn't usual."""
    out = {}
    for lang, (_, usual_codes, counts) in tables.items():
        at = np.minimum(np.searchsorted(usual_codes, codes), max(len(usual_codes) - 1, 0))
        out[lang] = np.where(usual_codes[at] == codes, counts[at], 0) if len(usual_codes) else np.zeros(len(codes), dtype=np.int64)
    return out


def _scrambled(letters: np.ndarray) -> np.ndarray:
    """A text's letters in another order, with its words as long as before; the same for the same text."""
    out, at = letters.copy(), np.flatnonzero(letters)
    out[at] = letters[np.random.default_rng(len(at)).permutation(at)]
    return out


def _judge(langs: list[str], target: np.ndarray, centre: np.ndarray, tables: dict, last: bool, scramble: bool):
    """Rows (doc_id, text, best, cosine, known, runs, own columns): the best so far against these languages. Without text after the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for start, held in _parts(batch.column(1)):
                part = batch.slice(start, len(held))
                best, cosines, known, runs = (part.column(k).to_pylist() for k in (2, 3, 4, 5))
                own_lang = part.column(names.index("own_lang")).to_pylist() if "own_lang" in names else [None] * len(held)
                each = [np.unique(grams(_scrambled(x) if scramble else x), return_counts=True) for x in held]
                codes = np.unique(np.concatenate([c for c, _ in each]))
                vectors, often = bound(codes), _often(tables, codes)
                for k, (own, counts) in enumerate(each):
                    if not len(own) or not langs:
                        continue
                    runs[k] = int(counts.sum())
                    place = np.searchsorted(codes, own)
                    profile = counts.astype(np.float32) @ vectors[place]
                    profile = profile / max(float(np.linalg.norm(profile)), 1e-9) - centre
                    cosine = profile @ target / max(float(np.linalg.norm(profile)), 1e-9)
                    top = int(np.argmax(cosine))
                    if best[k] is None or cosine[top] > cosines[k]:
                        best[k], cosines[k] = langs[top], float(cosine[top])
                    # a text doesn't make its own runs usual
                    shares = [float(counts[often[x][place] - (counts if x == own_lang[k] else 0) >= tables[x][0]].sum()) for x in tables]
                    known[k] = max([known[k], *(n / runs[k] for n in shares)])
                told = [pa.array(best, pa.string()), pa.array(cosines, pa.float64()), pa.array(known, pa.float64()), pa.array(runs, pa.int64())]
                same = [part.column(k) for k in range(part.num_columns)]
                yield pa.RecordBatch.from_arrays([same[0], *([] if last else [same[1]]), *told, *same[6:]], names=[n for n in names if n != "text" or not last])

    return run


def _blocks(table: DataFrame) -> Iterator[tuple[str | None, list]]:
    """The rows of a table with lang, AT_ONCE at a time in the order of lang, each with the last lang before them."""
    after = None
    while rows := (table if after is None else table.filter(F.col("lang") > after)).orderBy("lang").limit(AT_ONCE).collect():
        yield after, rows
        after = rows[-1]["lang"]
        if len(rows) < AT_ONCE:
            break


def identify(docs: DataFrame, prototypes: DataFrame, carry: tuple[str, ...] = (), frequent: DataFrame | None = None, scramble: bool = False) -> DataFrame:
    """doc_id, lang_pred and score (the cosine, 0 to 1) for each row of docs (doc_id, text), and the columns in carry as `own_` and their name.

    A text that is null or has no letter gets `und` and 0; so does every text if there is no prototype.
    Ties go to the language that comes first by code point. AT_ONCE prototypes at a time, rows of fixed size,
    come to the driver and go to all tasks; rows pass on with the best language so far.

    With frequent (from usual(), over the same languages) there is also known: the share of the text's runs
    of letters that are usual in the language that knows most of them, not counting the text itself if lang
    is carried; and runs, their number. Both are 0 without a letter. scramble judges each text with its letters in another order: what
    is known of such texts is known by chance.
    """
    few = prototypes.limit(AT_ONCE + 1).count() <= AT_ONCE
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    centre = None
    if not few:
        # what all languages share doesn't tell them apart: the mean of their unit vectors
        size = F.sqrt(F.aggregate("prototype", F.lit(0.0), lambda t, x: t + x * x))
        means = prototypes.select(F.posexplode(F.transform("prototype", lambda x: x / F.greatest(size, F.lit(1e-9))))).groupBy("pos").agg(F.avg("col").alias("x")).collect()
        centre = np.array([r["x"] for r in sorted(means)])
    none = [F.lit(None).cast("string").alias("best"), F.lit(-2.0).alias("cosine"), F.lit(0.0).alias("known"), F.lit(0).cast("long").alias("runs")]
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *none, *(F.col(c).alias(f"own_{c}") for c in carry))
    blocks = _blocks(prototypes)
    block = next(blocks, None)
    while block is not None:
        after, rows = block
        matrix = unit(np.array([r["prototype"] for r in rows]))
        if few:
            centre = matrix.mean(axis=0) if len(rows) > 1 else np.zeros(DIMENSIONS)
        target = unit(matrix - centre).T.astype(np.float32)
        tables = {} if frequent is None else _tables(frequent.filter((F.col("lang") <= rows[-1]["lang"]) & (F.lit(True) if after is None else F.col("lang") > after)))
        block = next(blocks, None)
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema.fields if f.name != "text" or block is not None)
        found = found.mapInArrow(_judge([r["lang"] for r in rows], target, centre, tables, block is None, scramble), schema)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.col("best").isNull(), 0.0).otherwise(F.col("cosine"))))
    told = [F.coalesce("best", F.lit(UNKNOWN)).alias("lang_pred"), score.alias("score"), *([] if frequent is None else [F.col("known"), F.col("runs")])]
    return found.select("doc_id", *told, *(f"own_{c}" for c in carry))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    return F.crc32(doc_id.cast("string")) % parts


def held_out_languages(docs: DataFrame) -> DataFrame:
    """Languages of all rows, learned from the rows whose fold of three is not 1.

    Returns doc_id, held_out, lang_pred and score. A null doc_id is in no fold: it is not learned from
    and not held out. An empty table gives an empty result.
    """
    part = fold(F.col("doc_id"), 3)
    prototypes = keep(learn(docs.filter(part != 1)), "prototypes")
    return identify(docs, prototypes).select("doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
