"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataforge.llm import centroids, contamination, html_extract, lang_id, mixing, oracles, pii, pipeline, quality, repeats, text_quality, token_counts, toxicity, vector_codes
from strataforge.llm.near_dedup import near_duplicates
from strataforge.storage import table


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all documents by 3-word shingles at 85 %. Odd rows are as in the operator's docstring."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that the mix of all sources takes. Odd rows are as in the operator's docstring."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document, learned from two thirds of them. Odd rows are as in the operator's docstring."""
    return lang_id.held_out_languages(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of personal data in each document. Odd rows are as in the operator's docstring."""
    return pii.digest(table(spark, sf_dir, "documents"))


def op5_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that are inside windows of benchmark items. Odd rows are as in the operator's docstring."""
    return contamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each page. Odd rows are as in the operator's docstring."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, distances and verdict of each document. Odd rows are as in the operator's docstring."""
    return quality.quality(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document under the vocabulary file's tokenizer. Odd rows are as in the operator's docstring.

    This departs from the method dealt: the vocabulary at hand is a BPE one, and no tokenizer may be trained, so
    the pass over the automaton's matches carries an end and a count and decides by the tokenizer's merge rule
    instead of the best score. The pass by scores is in the operator for vocabularies that have them.
    """
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that repeats of 35 words cover. Odd rows are as in the operator's docstring."""
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document, learned from four fifths of the labels. Odd rows are as in the operator's docstring."""
    return toxicity.held_out_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of four bytes for all vectors. Odd rows are as in the operator's docstring."""
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all vectors around eight centroids. Odd rows are as in the operator's docstring."""
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op13_text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each document, learned from four fifths of the labels. Odd rows are as in the operator's docstring."""
    return text_quality.held_out_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_near_dedup, op2_mixing, op3_lang_id, op4_pii, op5_contamination, op6_html, op7_quality, op8_token_counts, op9_repeats, op10_toxicity, op11_vector_codes, op12_centroids, op13_text_quality]
    return {f.__name__: f for f in found} | {"pipeline": pipeline.run}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
