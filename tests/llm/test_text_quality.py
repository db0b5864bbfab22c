"""The quality classifier: features against plain Python, trees against all cuts, held-out accuracy."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strataforge.llm import text_quality
from strataforge.llm.words import slices

DATA = "/root/testdata/sf0.01"
TEXTS = [
    "The cat, the CAT sat. The the the end", "", None, " \n\t ", "x", "A1 $$$ b%% c!! ###\nÜber über\n\n| a | b |", "no end" * 50, "zero 0 00 0.5", "A B", "a a", "é", "it is, (what) it is; is it?",
]


def plain_features(text, common):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    if not words:
        return [0.0] * len(text_quality.FEATURES)
    n, pairs = len(words), list(zip(words, words[1:]))
    data = text.encode()

    def kind(b):
        c = chr(b)
        return 7 if b > 127 else 0 if c in "abcdefghijklmnopqrstuvwxyz" else 1 if "A" <= c <= "Z" else 2 if c.isdigit() else 3 if c in ".,;:?" else 4 if c in "!'\"()-" else 6 if b in (9, 10, 11, 12, 13, 32) else 5

    chars = [sum(kind(b) == k for b in data) / len(data) for k in range(8)]
    kinds = [[kind(b) for b in w.encode()] for w in words]
    letters = [sum(k in (0, 1, 7) for k in ks) for ks in kinds]
    shares = [
        sum(w in common for w in words), sum(ks[-1] in (4, 5) for ks in kinds), sum(ks[-1] == 3 for ks in kinds), sum(x == 0 for x in letters),
        sum(x > 1 and all(k != 0 and k != 7 for k in ks) for x, ks in zip(letters, kinds)), max(words.count(w) for w in set(words)),
    ]
    return [np.log1p(n), sum(len(w.encode()) for w in words) / n, *chars, text.count("\n") / n, sum(a == b for a, b in pairs) / max(1, len(pairs)), len(set(words)) / n, len(set(pairs)) / max(1, len(pairs)), *(s / n for s in shares)]


def test_features_equal_plain_python(monkeypatch):
    common = {"the", "is", "it,"}
    hashes = np.sort(np.concatenate([s.hash for s in slices(pa.array(sorted(common)), lower=False)]))
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("ab B1.$!é \n") for _ in range(rng.randint(0, 80))) for _ in range(200)]
    want = np.array([plain_features(t, common) for t in texts])
    assert np.allclose(text_quality.features(pa.array(texts, pa.string()), hashes), want)
    monkeypatch.setattr("strataforge.llm.words.SLICE_BYTES", 64)
    assert np.allclose(text_quality.features(pa.array(texts, pa.string()), hashes), want)
    assert text_quality.features(pa.array(texts[:3], pa.string()), np.zeros(0, dtype=np.uint64)).shape == (3, len(text_quality.FEATURES))


def test_first_cut_is_the_best():
    """The first of two cuts gains most of all; the second gains most given the first."""
    rng = np.random.default_rng(2)
    gain = lambda g, h: g.sum() ** 2 / (h.sum() + text_quality.RIDGE)
    for _ in range(50):
        g, h = rng.normal(size=9), rng.random(9)
        out = text_quality.tree(g, h)
        edges = [0, *(np.flatnonzero(np.diff(out)) + 1), 9]
        assert len(edges) <= 4
        assert all(np.allclose(out[a:b], g[a:b].sum() / (h[a:b].sum() + text_quality.RIDGE)) for a, b in zip(edges, edges[1:]))
        one = {k: gain(g[:k], h[:k]) + gain(g[k:], h[k:]) for k in range(1, 9)}
        first = max(one, key=one.get)
        two = {k: sum(gain(g[a:b], h[a:b]) for a, b in zip(sorted([0, first, k]), sorted([first, k, 9]))) for k in range(1, 9) if k != first}
        second = max(two, key=two.get)
        if one[first] > gain(g, h) + 1e-6 and two[second] > one[first] + 1e-6:
            assert set(edges) == {0, first, second, 9}


def test_quadrants_are_the_best_cut():
    rng = np.random.default_rng(3)
    for _ in range(30):
        g, h = rng.normal(size=(4, 5)), rng.random((4, 5))
        gain = lambda a, b: a.sum() ** 2 / (b.sum() + text_quality.RIDGE)
        cut = lambda i, j: [(slice(0, i), slice(0, j)), (slice(0, i), slice(j, 5)), (slice(i, 4), slice(0, j)), (slice(i, 4), slice(j, 5))]
        every = {(i, j): sum(gain(g[q], h[q]) for q in cut(i, j)) - gain(g, h) for i in range(1, 4) for j in range(1, 5)}
        best = max(every, key=every.get)
        found, out = text_quality.quadrants(g, h)
        assert np.isclose(found, every[best]) and all(np.allclose(out[q], g[q].sum() / (h[q].sum() + text_quality.RIDGE)) for q in cut(*best))
    assert text_quality.quadrants(np.ones((1, 3)), np.ones((1, 3)))[0] == 0


def test_pairs_learn_what_features_alone_cannot():
    rng = np.random.default_rng(4)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = text_quality.train(x, y)
    assert model.pairs[0] == (0, 1)
    fresh = rng.random((2000, 3))
    assert ((model.scores(fresh) > 0.5) == ((fresh[:, 0] > 0.5) ^ (fresh[:, 1] > 0.5))).mean() > 0.9


def test_scores_are_sums_of_lookups():
    rng = np.random.default_rng(5)
    x = rng.random((500, 4)).round(1)
    model = text_quality.train(x, (x[:, 0] + x[:, 2] > 1).astype(float))
    for row, got in zip(x[:40], model.logits(x[:40])):
        want = model.base + sum(t[int((c <= v).sum())] for t, c, v in zip(model.tables, model.cuts, row))
        want += sum(t[int((model.pair_cuts[a] <= row[a]).sum()), int((model.pair_cuts[b] <= row[b]).sum())] for (a, b), t in zip(model.pairs, model.pair_tables))
        assert np.isclose(got, want)


def test_held_out(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = {r["doc_id"]: r for r in text_quality.held_out_quality(docs.withColumn("score", F.lit("x")), labels).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    held = [(got[k]["predicted"], truth[k]) for k in truth if got[k]["held_out"]]
    assert len(held) > 50 and sum(a == b for a, b in held) >= 0.95 * len(held)
    # neither the labels of held-out rows nor lang, source and id count
    other = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    moved = docs.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("x")}).repartition(7)
    again = {r["doc_id"]: r["score"] for r in text_quality.held_out_quality(moved, other).collect()}
    assert again == {k: r["score"] for k, r in got.items()}


def test_the_sample_is_bounded_however_often_an_id_stands(spark):
    docs = spark.range(300).select((F.col("id") % 40).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = spark.range(40).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    labels = labels.union(labels.select("doc_id", F.lit(0))).union(labels.limit(1).select(F.lit(None).cast("long"), F.lit(1)))
    got = text_quality.sample(docs, labels, 25)
    assert got.count() == 25 and sorted(map(tuple, got.collect())) == sorted(map(tuple, text_quality.sample(docs.repartition(5), labels, 25).collect()))
    assert all(r["y"] == r["doc_id"] % 2 for r in got.collect())
    assert {r["score"] for r in text_quality.held_out_quality(docs, labels.limit(0)).collect()} == {0.5}
