"""Quality rules: counts on whole texts, and the divergence of a text's histograms from its language's.

A first pass over all documents finds the commonest words of each language. A second counts, for each
document, characters by class and these words. Their sums over all other documents of its language are a
document's reference. A document whose histograms are farther from the reference than a limit is not kept:
the distance is the root of the Jensen-Shannon divergence in bits (0 to 1), less what samples of these sizes
differ by chance. All steps are DataFrame functions; only counts are shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataforge.llm.pii import once
from strataforge.storage import keep

SPACE = "[\\x20\\x09-\\x0D]+"
#: Classes of characters beside white space and small letters, the last of them letters outside ASCII: what each expression finds is taken out and the rest counted.
CLASSES = tuple(f"[^{c}]+" for c in ("A-Z", "0-9", ".,;:!?'\"()-", "#*$%&|<>@=+~^_/\\\\{}\\[\\]`")) + ("[\\P{L}A-Za-z]+",)
#: Bins of the histogram of common words, one for each of a language's commonest words; and bits for a place in a text's words.
WORD_BINS, PLACE_BITS = 40, 24
#: Parts of a language's words that are ranked apart before the best of them are.
RANK_PARTS = 64
MIN_WORDS = 50
#: Texts with fewer words than this are not judged by their words.
MIN_WORDS_HISTOGRAM = 100
#: Fitted on the documents of quality 1 in four fifths of one table's labels: 1 in 1000 is farther off by its characters, and none by its words, of which the farthest is at 0.21.
MAX_CHAR_DISTANCE = 0.22
MAX_WORD_DISTANCE = 0.25


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeated_words(table: DataFrame) -> DataFrame:
    """table (with hashes, an array of word hashes) with n_repeat_words: how many words lie in runs of three that occur twice or more.

    Run hashes are sorted as longs whose low bits hold the place. Neighbours that agree in the high
    bits may be repeats; only these few are then compared in full.
    """
    n = F.size("hashes")
    pairs = F.zip_with("hashes", F.slice("hashes", 2, n), lambda a, b: F.xxhash64(a, b))
    triples = F.slice(F.zip_with(pairs, F.slice("hashes", 3, n), lambda ab, c: F.xxhash64(ab, c)), 1, F.greatest(n - 2, F.lit(0)))
    table = table.withColumn("triples", triples)
    high, low = F.lit(-(1 << PLACE_BITS)), F.lit((1 << PLACE_BITS) - 1)
    packed = F.sort_array(F.transform("triples", lambda t, k: t.bitwiseAND(high).bitwiseOR(k.cast("long").bitwiseAND(low))))
    table = table.withColumn("packed", packed)
    alike = lambda a, b: F.shiftright(a.bitwiseXOR(b), PLACE_BITS) == 0
    left = F.zip_with("packed", F.slice("packed", 2, F.size("packed")), lambda a, b: F.when(alike(a, b), a))
    right = F.zip_with("packed", F.slice("packed", 2, F.size("packed")), lambda a, b: F.when(alike(a, b), b))
    maybe = F.array_distinct(F.filter(F.concat(left, right), lambda x: x.isNotNull()))
    # a text of 2**PLACE_BITS words or more is compared in full
    places = F.when(F.size("triples") < (1 << PLACE_BITS), F.transform(maybe, lambda x: x.bitwiseAND(low).cast("int"))).otherwise(F.sequence(F.lit(0), F.size("triples") - 1))
    table = table.withColumn("places", places)
    placed = F.array_sort(F.transform("places", lambda k: F.struct(F.get("triples", k).alias("t"), k.alias("k"))))
    after = F.zip_with(placed, F.slice(placed, 2, F.size("places")), lambda x, y: F.when(x["t"] == y["t"], F.array(x["k"], y["k"])))
    at = F.array_sort(F.array_distinct(F.flatten(F.filter(after, lambda k: k.isNotNull()))))
    # a window covers three words, less what the next one covers too
    cover = F.zip_with(at, F.slice(at, 2, F.size("places")), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)))
    counted = F.when(F.size("places") == 0, F.lit(0)).otherwise(F.aggregate(cover, F.lit(0), lambda total, c: total + c))
    return table.withColumn("n_repeat_words", counted.cast("long")).drop("triples", "packed", "places")


def _key(lang: Column) -> Column:
    """A language's name apart from null's, which is a language of its own."""
    return F.when(lang.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), lang))


def common_words(docs: DataFrame) -> DataFrame:
    """(key, common, by_size, before): the WORD_BINS commonest words of each language of docs (text, lang), in lower case, ties by the word.

    common has them by their bytes and then how common they are; by_size has those of 0, 1, 2, ... bytes apart, and
    before how many are shorter: a word is looked for among few.
    """
    words = docs.select(_key(F.col("lang")).alias("key"), F.explode(F.split(F.lower("text"), SPACE)).alias("word")).filter("word != ''")
    counts = words.groupBy("key", "word").agg(F.count("*").alias("n"))
    best = lambda t, *by: t.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "word"))).filter(F.col("rank") <= WORD_BINS)
    # a language's words are too many for one task, but not the best of each part of them
    few = best(best(counts.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(RANK_PARTS))), "key", "part"), "key")
    listed = few.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.octet_length("word").alias("size"), "rank", "word"))), lambda x: x["word"]).alias("common"))
    sizes = F.sequence(F.lit(0), F.octet_length(F.element_at("common", -1)))
    of_size = F.transform(sizes, lambda n: F.filter("common", lambda w: F.octet_length(w) == n))
    shorter = F.transform(sizes, lambda n: F.size(F.filter("common", lambda w: F.octet_length(w) < n)))
    return listed.select("key", "common", of_size.alias("by_size"), shorter.alias("before"))


def measure(docs: DataFrame, common: DataFrame) -> DataFrame:
    """doc_id, key and the counts of each document: the base ones, chars (by class) and words (by the language's common words, from common_words())."""
    texts = docs.select("doc_id", _key(F.col("lang")).alias("key"), F.coalesce("text", F.lit("")).alias("text")).join(common, "key", "left")
    # nearly all of a text is small letters and white space; the classes are counted on the rest
    texts = texts.withColumn("rest", F.regexp_replace("text", "[a-z\\x20\\x09-\\x0D]+", ""))
    split = texts.withColumns({"words": _words(F.col("text")), "lines": F.filter(F.split("text", "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))})
    # a letter for each common word in the text: what taking a letter out makes it shorter by is the word's count
    place = lambda w: F.array_position(F.get("by_size", F.octet_length(w)), w)
    letter = lambda w: F.when(place(w) > 0, F.char((F.get("before", F.octet_length(w)) + place(w) + 64).cast("int"))).otherwise("")
    short = F.filter(F.transform("words", lambda w: F.lower(w)), lambda w: F.octet_length(w) < F.size("by_size"))
    marks = F.array_join(F.transform(short, letter), "")
    hashed = repeated_words(split.withColumns({"hashes": F.transform("words", lambda w: F.xxhash64(w)), "marks": F.coalesce(marks, F.lit(""))}))
    n_words, n_chars = F.size("words").cast("long"), F.length("text").cast("long")
    word_chars = F.length(F.array_join("words", "")).cast("long")
    # in one lambda, so that the marks are made once
    counts = once(F.col("marks"), lambda m: F.array(*((F.octet_length(m) - F.octet_length(F.replace(m, F.lit(chr(65 + k)), F.lit("")))).cast("long") for k in range(WORD_BINS))))
    count = lambda other: F.length(F.regexp_replace("rest", other, "")).cast("long")
    small = (word_chars - F.length("rest")).cast("long")
    return hashed.select(
        "doc_id", "key", n_words.alias("n_words"), word_chars.alias("word_chars"), count("[^#*$%&|<>]+").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
        F.array(n_chars, n_chars - word_chars, small, *(count(c) for c in CLASSES)).alias("chars"), F.concat(F.array(n_words), counts).alias("words"),
    )


def _shares(counts: Column) -> Column:
    """The total comes first, then the bins; what is in no bin is the last share."""
    total = F.greatest(F.get(counts, F.lit(0)), F.lit(1)).cast("double")
    parts = F.transform(F.slice(counts, 2, F.size(counts)), lambda c: c / total)
    rest = F.lit(1.0) - F.aggregate(parts, F.lit(0.0), lambda s, p: s + p)
    return F.concat(parts, F.array(F.greatest(rest, F.lit(0.0))))


def distance(p: Column, q: Column) -> Column:
    """The Jensen-Shannon distance of two arrays of shares: the root of their divergence in bits, 0 to 1."""
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    terms = F.zip_with(p, q, lambda a, b: 0.5 * part(a, (a + b) / 2) + 0.5 * part(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)))


def excess(own: Column, reference: Column, bins: int) -> Column:
    """How far counts (the total first) are from a reference's: the distance less what two samples of these sizes from one source have on average; 0 without a reference.

    Of the divergence that is (bins - 1) / (8 ln 2) * (1 / n + 1 / m) bits, so that short texts and small languages aren't far off by their size.
    """
    n, m = F.greatest(F.get(own, F.lit(0)), F.lit(1)), F.get(reference, F.lit(0))
    chance = (bins - 1) / (8 * math.log(2)) * (1 / n + 1 / F.greatest(m, F.lit(1)))
    far = distance(_shares(own), _shares(reference))
    return F.when(m > 0, F.sqrt(F.greatest(F.lit(0.0), far * far - chance))).otherwise(0.0)


def quality(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text, lang; other columns are ignored).

    Returns doc_id, the base counts, base_failed, kept, and the distances of character classes and common
    words from the reference: the other documents of MIN_WORDS words or more in the same lang (null is a
    lang of its own). A distance is 0 where there is none. A null text has no words and fails. Documents
    under MIN_WORDS_HISTOGRAM words are judged by their characters only. Very long texts count whole. Rows
    that repeat count each. An empty table gives an empty result.
    """
    # a row a language, written first: Spark sees its size and broadcasts it if it is under its threshold
    found = keep(measure(docs, keep(common_words(docs), "common")), "measures")
    widths = {"chars": len(CLASSES) + 3, "words": WORD_BINS + 1}
    sums = [F.sum(F.get(c, F.lit(k))).alias(f"{c}_{k}") for c, n in widths.items() for k in range(n)]
    arrays = [F.array(*(F.coalesce(f"{c}_{k}", F.lit(0)) for k in range(n))).alias(f"{c}_of") for c, n in widths.items()]
    references = keep(found.filter(F.col("n_words") >= MIN_WORDS).groupBy("key").agg(*sums).select("key", *arrays), "references")
    own = lambda c: F.when(F.col("n_words") >= MIN_WORDS, F.col(c)).otherwise(F.transform(c, lambda x: F.lit(0).cast("long")))
    both = found.join(references, "key", "left").withColumns({f"{c}_ref": F.coalesce(F.zip_with(f"{c}_of", own(c), lambda a, b: a - b), F.array(F.lit(0).cast("long"))) for c in widths})
    far = lambda c: excess(F.col(c), F.col(f"{c}_ref"), widths[c])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    told = both.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), far("chars").alias("char_distance"), far("words").alias("word_distance"))
    fits = (F.col("char_distance") <= MAX_CHAR_DISTANCE) & ((F.col("n_words") < MIN_WORDS_HISTOGRAM) | (F.col("word_distance") <= MAX_WORD_DISTANCE))
    return told.withColumn("kept", ~F.col("base_failed") & fits)
