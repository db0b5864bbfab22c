"""Benchmark decontamination by a prefix-filtered set join, with DataFrame functions only.

An item's windows are its runs of WINDOW words (the whole item if it is shorter). A window is held in
a document only if all its shingles are, in their places. Shingles are ordered by how many places in
the corpus hold them, and only each window's rarest one, its necessary prefix, is joined. Its place in
the document and in the window bounds where the window would start; the words there are then
compared.

Documents are read twice: to count the benchmark's shingles and to join their prefixes. A bitmap of
fixed size drops nearly all other places before they become rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.operators.bitmap import Bitmap
from strataforge.storage import drop_kept, keep

WINDOW = 10
SHINGLE = 3
_NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: Column) -> Column:
    """Runs of digits, letters a-z (A-Z in lower case) and code points from 0x80; a null text has none."""
    whole = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(whole) == F.length(whole)
    lower = F.when(ascii_only, F.lower(whole)).otherwise(F.translate(whole, _UPPER, _LOWER))
    return F.filter(F.split(lower, _NOT_WORD), lambda w: w != "")


def _hashed(table: DataFrame, *ids: str) -> DataFrame:
    """The ids and hashes of the words, in order."""
    return table.select(*ids, _words(F.col("text")).alias("words")).select(*ids, F.transform("words", lambda w: F.xxhash64(w)).alias("h"))


def _shingles(h: Column, width: int) -> Column:
    """Hashes of the runs of width words; with fewer words there is none."""
    n, out = F.size(h), h
    for k in range(1, width):
        out = F.zip_with(out, F.slice(h, k + 1, n), lambda a, b: F.xxhash64(a, b))
    return F.slice(out, 1, F.greatest(n - (width - 1), F.lit(0)))


def _windows(items: DataFrame) -> DataFrame:
    """item_id and window (an array of word hashes), all distinct."""
    n = F.size("h")
    width = F.least(n, F.lit(WINDOW))
    each = F.transform(F.sequence(F.lit(0), n - width), lambda s: F.slice(F.col("h"), s + 1, width))
    return items.filter(n > 0).select("item_id", F.explode(each).alias("window")).distinct()


def _matches(docs: DataFrame, windows: DataFrame, width: int) -> DataFrame:
    """(key, print, n_words, starts): for each of docs (key, print, h) the places of windows, by shingles of width words.

    starts is an array of (start, n, id): where the window starts, its words, and a hash of it.
    """
    parts = windows.select("id", F.posexplode(_shingles(F.col("window"), width)).alias("offset", "shingle"))
    parts = keep(parts, "parts")
    bits = Bitmap(parts, F.col("shingle"))
    # counted before it is joined: a common shingle is a row for each partition, not for each of its places
    inside = docs.select(F.explode(F.filter(_shingles(F.col("h"), width), bits.fills)).alias("shingle")).groupBy("shingle").agg(F.count("*").alias("places"))
    held = keep(inside.join(parts.select("shingle").distinct(), "shingle"), "held")
    rarest = parts.join(held, "shingle", "left").groupBy("id").agg(F.min_by(F.struct("shingle", "offset"), F.struct(F.coalesce("places", F.lit(0)), "shingle", "offset")).alias("p"))
    # a window whose rarest shingle is nowhere in the corpus is not there either
    prefixes = keep(rarest.select("id", "p.*").join(held.select("shingle"), "shingle").join(windows, "id"), "prefixes")
    first = Bitmap(prefixes, F.col("shingle"))
    reach = WINDOW - width
    low = lambda at: F.greatest(at - reach, F.lit(0))
    placed = F.filter(F.transform(_shingles(F.col("h"), width), lambda s, at: F.struct(s.alias("shingle"), at.alias("at"))), lambda x: first.fills(x["shingle"]))
    around = F.transform(placed, lambda x: F.struct(x["shingle"].alias("shingle"), x["at"].alias("at"), F.slice(F.col("h"), low(x["at"]) + 1, 2 * reach + width).alias("near")))
    found = keep(docs.select("key", "print", F.size("h").cast("long").alias("n_words"), around.alias("places")), "places")
    place = found.select("key", "print", F.explode("places").alias("x")).select("key", "print", "x.*").join(prefixes, "shingle")
    start = F.col("at") - F.col("offset")
    begins = start - low(F.col("at"))
    n = F.size("window")
    fits = (start >= 0) & (begins >= 0) & (begins + n <= F.size("near"))
    equal = place.filter(fits).filter(F.slice("near", F.greatest(begins, F.lit(0)) + 1, n) == F.col("window"))
    starts = equal.groupBy("key", "print").agg(F.collect_set(F.struct(start.alias("start"), n.alias("n"), F.col("id"))).alias("starts"))
    out = keep(found.select("key", "print", "n_words").distinct().join(starts, ["key", "print"], "left"), "starts")
    drop_kept(parts, held, prefixes, found)
    return out


def _covered(starts: Column) -> Column:
    """How many words the windows cover together."""

    def add(state: Column, s: Column) -> Column:
        end = F.greatest(state["end"], s["start"] + s["n"])
        return F.struct(end.alias("end"), (state["total"] + end - F.greatest(state["end"], s["start"])).alias("total"))

    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
    return F.aggregate(F.array_sort(starts), zero, add, lambda state: state["total"].cast("long"))


def _judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """contamination() with a name of each row: key and print."""
    own = F.xxhash64("text").alias("print")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), own, "text").withColumn("key", F.coalesce("doc_id", "print"))
    hashed = _hashed(named, "key", "print")
    held = keep(_windows(_hashed(benchmark, "item_id")).withColumn("id", F.xxhash64("window")), "windows")
    windows = held.select("id", "window").distinct()
    short, long = F.size("window") < SHINGLE, F.size("window") >= SHINGLE
    first = found = _matches(hashed, windows.filter(long), SHINGLE)
    if not windows.filter(short).isEmpty():
        more = _matches(hashed, windows.filter(short), 1).select("key", "print", F.col("starts").alias("more"))
        none = F.array().cast("array<struct<start:int,n:int,id:bigint>>")
        found = found.join(more, ["key", "print"], "left").withColumn("starts", F.concat(F.coalesce("starts", none), F.coalesce("more", none))).drop("more")
    found = keep(found, "found")
    drop_kept(first)
    items = found.select("key", "print", F.explode(F.array_distinct(F.col("starts")["id"])).alias("id")).join(held.select("id", "item_id"), "id")
    items = items.groupBy("key", "print").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    # written first: a text that many rows repeat is then split over tasks
    told = keep(found.join(items, ["key", "print"], "left"), "told")
    drop_kept(held, found)
    out = named.select("doc_id", "key", "print").join(told, ["key", "print"], "left")
    n_hit = F.coalesce(_covered(F.col("starts")), F.lit(0).cast("long"))
    names = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "key", "print", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Which words of docs (doc_id, text) are inside windows of benchmark (item_id, text).

    Returns doc_id, n_words, n_hit, n_items, items_sha256 and contaminated, one row for each row of
    docs; other columns of either table are ignored. Null or empty texts have no words, items without
    words no windows. An item without item_id makes hits but is not counted or named; rows that repeat
    an item_id are one item. An empty benchmark hits nothing; empty docs give an empty result.
    """
    return _judged(docs, benchmark).drop("key", "print")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without a hit, with all their columns; rows without doc_id or text among them."""
    hit = keep(_judged(docs, benchmark).filter("contaminated").select(F.col("key").alias("_key"), F.col("print").alias("_print")).distinct(), "hit")
    print_of = F.xxhash64("text")
    named = docs.withColumns({"_key": F.coalesce(F.col("doc_id").cast("long"), print_of), "_print": print_of})
    return named.join(hit, ["_key", "_print"], "left_anti").drop("_key", "_print")
