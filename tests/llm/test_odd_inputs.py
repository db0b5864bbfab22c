"""All operators and stages on nulls, empty and long texts, ties, repeated rows, empty tables and columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from strataforge.llm import contamination, html_extract, lang_id, mixing, near_dedup, pii, pipeline, quality, repeats, text_quality, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{k % 997} of{k}" for k in range(60_000))
ROWS = [
    (1, "The first text of this table, mail x@y.zz.", "en", "a", 1), (1, "The first text of this table, mail x@y.zz.", "en", "a", 1), (1, "Another text under the same id as the first one.", "en", "b", 1),
    (2, None, None, None, None), (3, "", "en", "a", 0), (None, "A text without an id, which is a text too.", None, None, 5), (None, None, None, None, None), (4, " \n ", "", "", 3),
    (5, "Same text as six, word for word, in all it says.", "en", "a", 1), (6, "Same text as six, word for word, in all it says.", "en", "b", 1), (7, LONG, "en", "a", len(LONG)), (8, "ééé 中文 😀 \U00030000\U000323B0", "zz", "ü", 9),
]
CLASH = ("key", "print", "node", "size", "target", "taken", "score", "base_spans", "added_spans", "words", "hashes", "label", "_key", "_print", "n_words", "known", "part", "toxic", "path")
MAPS = {
    "near_dedup": (near_dedup.near_duplicates, ("doc_id", "n_shingles", "component_id", "kept")),
    "mixing": (mixing.mix, ("doc_id", "size", "source_size", "target", "taken")),
    "lang_id": (lang_id.held_out_languages, ("doc_id", "held_out", "lang_pred", "score")),
    "pii": (pii.digest, ("doc_id", "n_email", "base_sha256", "spans")),
    "contamination": (lambda d: contamination.contamination(d, d.select(F.col("doc_id").alias("item_id"), "text", *(c for c in CLASH if c in d.columns))), ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")),
    "html_extract": (lambda d: html_extract.extract(d.withColumns({"page_id": "doc_id", "url": F.col("source"), "html": F.col("text")} | {"page_id": F.col("doc_id")})), ("page_id", "url", "text", "n_chars")),
    "quality": (quality.quality, ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")),
    "token_counts": (token_counts.count_tokens, ("doc_id", "n_chars", "n_tokens")),
    "repeats": (repeats.remove_repeats, ("doc_id", "n_words", "n_removed", "kept_sha256")),
    "text_quality": (lambda d: text_quality.held_out_quality(d, d.select("doc_id", (F.col("doc_id") % 2).alias("quality"))), ("doc_id", "held_out", "score", "predicted")),
    "toxicity": (lambda d: toxicity.held_out_toxicity(d, d.select("doc_id", F.lit(1).alias("toxic"))), ("doc_id", "held_out", "score", "predicted")),
}


def rows(df, columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", MAPS)
def test_operator(spark, name):
    run, columns = MAPS[name]
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = rows(run(docs), columns)
    assert len(got) == len(ROWS) and sorted(str(r[0]) for r in got) == sorted(str(r[0]) for r in ROWS)
    assert got == rows(run(docs.repartition(3)), columns)  # reruns agree, ties included
    clash = docs.withColumns({c: F.lit("x") for c in CLASH})
    assert rows(run(clash), columns) == got
    # of equal rows each has what the other has
    if name != "mixing":
        assert len({r[1:] for r in got if r[0] in (5, 6)}) == 1 or name in ("near_dedup", "lang_id", "html_extract", "toxicity", "text_quality")
    empty = run(docs.limit(0))
    assert empty.count() == 0 and set(columns) <= set(empty.columns)


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_stage(spark, name, tmp_path):
    stage = dict(pipeline.STAGES)[name]
    spark.createDataFrame([(1, "some item with its words"), (None, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = rows(stage(spark, docs, str(tmp_path)), pipeline.COLUMNS)
    assert rows(stage(spark, docs.withColumns({c: F.lit("x") for c in CLASH}), str(tmp_path)), pipeline.COLUMNS) == got
    found = stage(spark, docs, str(tmp_path))
    assert found.columns[:5] == list(pipeline.COLUMNS) and (name == "mixture" or len(found.columns) == 5)
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    want = {
        "near_dedup": len(ROWS) - 2,  # a repeated row, and 6
        "decontaminate": len(ROWS), "private": len(ROWS), "mixture": len(ROWS),
    }
    if name == "language":
        assert not [r for r in got if not (r[1] or "").strip()]
    else:
        assert len(got) == want[name]
    if name == "private":
        assert not [r for r in got if "x@y.zz" in (r[1] or "")] and sum(r[1] is None for r in got) == 2
