"""What the pipeline emits holds the sources as the mix takes them."""

from collections import Counter

from strataforge.llm import pipeline as corpus_pipeline

DATA = "/root/testdata/sf0.001"


def test_emitted_rows_are_mixed_to_the_targets(spark):
    rows = [(k, " a\n" + "w  " * (k % 40), "xx", "big" if k % 4 else ("ä", "one")[k % 8 > 3], 0) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    old, corpus_pipeline.STAGES = corpus_pipeline.STAGES, [("mixture", corpus_pipeline.mixture)]
    read, corpus_pipeline.table = corpus_pipeline.table, lambda *_: docs
    try:
        got = corpus_pipeline.run(spark, DATA).collect()
    finally:
        corpus_pipeline.STAGES, corpus_pipeline.table = old, read
    whole, words, target, copies = {r[0]: r[1] for r in rows}, Counter(), {}, Counter()
    for r in got:
        n = len(r["text"].split())
        assert n == r["words"] > 0 and r["n_chars"] == len(r["text"]) and whole[r["doc_id"]].startswith(r["text"])
        assert n < r["size"] or r["text"] == whole[r["doc_id"]]
        words[r["source"]] += n
        target[r["source"]] = r["target"]
        copies[r["doc_id"]] += 1
    assert set(words) == {"big", "ä", "one"}
    assert all(abs(words[s] - t) <= max(3, t / 50) for s, t in target.items()), (words, target)
    assert len(copies) < len(rows) and 1 < max(copies.values()) <= 3
