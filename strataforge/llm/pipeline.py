"""A corpus from raw documents: language, near-duplicates, benchmark leaks, personal data, mixture.

Each stage takes (spark, docs, sf_dir) and returns documents; its result is written as Parquet and
read again as the next stage's docs. All stages take null ids, langs, sources and texts, empty and very
long texts, repeated rows and ids, empty tables, and other columns of docs, whatever their names; all
but the last return COLUMNS and leave other columns out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.llm.contamination import clean
from strataforge.llm.lang_id import UNKNOWN, identify, learn, usual
from strataforge.llm.mixing import mix_rows
from strataforge.llm.near_dedup import survivors
from strataforge.llm.pii import redact
from strataforge.storage import drop_kept, keep, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A language's limit is so many standard deviations over what scrambled texts have on average.
DEVIATIONS = 2.0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty texts too), and those of any length that are like none of the languages; lang becomes the one found.

    A document is like none if no more of its runs of three letters are usual in any language than chance
    makes: the language's own documents with their letters in another order say how many these are, by
    their average and DEVIATIONS, less a standard error of the text's own share, as a short text's says less.
    Prototypes, usual runs and limits are learned from all documents with a lang; where none has one,
    no document has a language and all go. Equal texts get equal languages if their langs are equal.
    """
    prototypes, frequent = keep(learn(docs), "prototypes"), keep(usual(docs), "usual")
    chance = identify(docs.select("doc_id", "text", "lang"), prototypes, carry=("lang",), frequent=frequent, scramble=True).filter("own_lang is not null and lang_pred != 'und'")
    # a row a language, written first: Spark sees its size
    least = keep(chance.groupBy(F.col("own_lang").alias("of")).agg((F.avg("known") + DEVIATIONS * F.stddev_pop("known")).alias("least")), "least")
    found = identify(docs.select(*COLUMNS), prototypes, carry=("text", "source", "n_chars", "lang"), frequent=frequent)
    error = F.sqrt(F.col("least") * (1 - F.least("least", F.lit(1.0))) / F.greatest("runs", F.lit(1)))
    judged = found.filter(F.col("lang_pred") != UNKNOWN).join(least, F.col("lang_pred") == F.col("of"), "left").filter(F.col("known") >= F.coalesce(F.col("least") - error, F.lit(0.0)))
    return judged.select("doc_id", F.col("own_text").alias("text"), F.col("lang_pred").alias("lang"), F.col("own_source").alias("source"), F.col("own_n_chars").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: the one with the least id, or the least hash of its text where none has an id.

    Texts without a word are like nothing and stay. Of rows with the same id and text one stays; rows that
    share an id but not the text are documents of their own.
    """
    return survivors(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item; null and empty texts hold none and stay, as all do if there are no items."""
    return clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in brackets for each span of personal data; all rows stay, a null text stays null and its n_chars becomes null."""
    return redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def emitted(mixed: DataFrame) -> DataFrame:
    """The mixed corpus from mixture()'s rows: each document as often as the mix takes it, without those that it doesn't take.

    Each copy (0, 1, ...) is a row with the whole text; the last is cut to its first words where the mix
    takes only these. words says how many a row has, so that they add up to taken.
    """
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    copies = mixed.filter("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), times - 1)))
    words = F.least("size", F.col("taken") - F.col("copy") * F.col("size"))
    rows = copies.withColumn("words", words)
    # each piece is a word and the white space behind it; white space before the first word is a piece of its own
    pieces = F.split("text", "(?<=[\\x20\\x09-\\x0D])(?=[^\\x20\\x09-\\x0D])")
    lead = F.when(F.col("text").rlike("^[\\x20\\x09-\\x0D]"), 1).otherwise(0)
    cut = F.regexp_replace(F.array_join(F.slice(pieces, F.lit(1), (F.col("words") + lead).cast("int")), ""), "[\\x20\\x09-\\x0D]+$", "")
    rows = rows.withColumn("text", F.when(F.col("words") < F.col("size"), cut).otherwise(F.col("text")))
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*mixed.columns, "copy", "words")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, with how many words of each the mix takes; emitted() makes the mixed corpus of them.

    All rows stay; texts without a word have size and taken 0. A null source is a source of its own.
    """
    return mix_rows(docs.select(*COLUMNS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("private", private),
    ("mixture", mixture),
]
#: No SQL: language profiles and MinHash links are not SQL's to express. The tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the documents below sf_dir, and emits the documents as the mix takes them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, keep(stage(spark, docs, sf_dir), name)
        if name != STAGES[0][0]:
            drop_kept(before)
    return emitted(docs)
