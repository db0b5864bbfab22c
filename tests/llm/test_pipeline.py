import re

from strataforge.llm import pipeline as corpus_pipeline
from strataforge.llm.contamination import contamination
from strataforge.storage import keep, table

DATA = "/root/testdata/sf0.001"


def five(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def test_stages_in_turn(spark):
    docs, kept = table(spark, DATA, "documents"), {}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "decontaminate", "private", "mixture"]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, keep(stage(spark, docs, DATA), name)
        assert docs.columns[:5] == list(corpus_pipeline.COLUMNS)
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
        assert set(kept[name]) <= {r["doc_id"] for r in before.select("doc_id").collect()}
    raw = {r["doc_id"]: r for r in table(spark, DATA, "documents").collect()}
    assert set(kept["language"]) == {i for i, r in raw.items() if re.search(r"[^\W\d_]", r["text"])}
    sets = {i: five(r["text"]) for i, r in kept["near_dedup"].items()}
    ids = sorted(sets)
    assert not [(a, b) for k, a in enumerate(ids) for b in ids[:k] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    left = contamination(docs, table(spark, DATA, "benchmark")).filter("contaminated")
    assert left.count() == 0
    assert not any(re.search(r"[a-z0-9]@[a-z]+[0-9]*\.example", r["text"]) for r in kept["private"].values())
    assert set(kept["mixture"]) == set(kept["private"])
    total = sum(r["size"] for r in kept["mixture"].values())
    assert abs(sum(r["taken"] for r in kept["mixture"].values()) - total) <= 0.01 * total
