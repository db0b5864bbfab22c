"""Toxic passages by maximum-scoring segments of token log-odds.

A token's score is the log-odds of its rate in toxic against other documents, each smoothed by a
Dirichlet prior with the rates of both together. A linear scan finds all maximal-scoring segments of a
document. Chance alone makes segments whose scores follow an extreme-value law: its location and scale
are fitted on segments of labelled documents that aren't toxic and weren't learned from. Each document's
significant segments add up to one measure of evidence, which a logistic curve turns into a score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.llm.lang_id import fold
from strataforge.storage import drop_kept, keep

#: Labelled documents learned from at most, those with the least hash of their id. The model has a number for each token that tells toxic ones among them.
MOST_LABELLED = 40_000
#: The Dirichlet prior of a token: a share of its own documents and a part of one, which keeps what is in one class only from counting as unknown.
PRIOR, FLOOR = 0.01, 0.25
#: Tokens whose log-odds are within so many standard deviations of 0 score as any other token. With FLOOR, the best of 12 settings by cross-validation within the rows learned from.
Z = 2.0
#: Segments with a larger expected number by chance in their document are not evidence.
MOST_EXPECTED = 0.5
#: The least that any other token loses.
LEAST_LOSS = 0.05
_TOKEN = re.compile(r"[^\W\d_]+")


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), disjoint, in linear time (Ruzzo and Tompa).

    Each segment in the list knows the last one before it that begins lower. A search follows these links, so
    that what one search has passed over no later one looks at again.
    """
    found: list[tuple[int, int, float, float, int]] = []  # start, end, sums before and after, the last that begins lower
    total = 0.0
    for k, score in enumerate(scores):
        before, total = total, total + score
        if score <= 0:
            continue
        start, left, j = k, before, len(found) - 1
        while j >= 0 and found[j][2] >= left:
            j = found[j][4]
        while j >= 0 and found[j][3] < total:
            start, _, left, _, lower = found[j]
            del found[j:]
            j = lower
        found.append((start, k + 1, left, total, j))
    return [(a, b, after - before) for a, b, before, after, _ in found]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of (text, toxic) rows that hold a token, counted by class within the partition."""
    counted: dict[tuple[str, int], int] = {}

    def told() -> pa.RecordBatch:
        keys = list(counted)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([counted[k] for k in keys], pa.int64())], names=["token", "toxic", "n"])

    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
            for token in set(tokens(text.as_py())):
                counted[token, toxic] = counted.get((token, toxic), 0) + 1
            if len(counted) > 200_000:
                yield told()
                counted = {}
    yield told()


def learn(labelled: DataFrame) -> tuple[dict[str, float], float]:
    """From rows (text, toxic): log-odds of the tokens that tell toxic texts, and the score of any other token."""
    share = lambda toxic: F.sum(F.when(F.col("toxic") == toxic, F.col("n")).otherwise(0))
    counts = keep(labelled.select("text", "toxic").mapInArrow(_counts, "token string, toxic int, n long").groupBy("token").agg(share(1).alias("t"), share(0).alias("c")), "tokens")
    total = counts.agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.count("*").alias("n")).first()
    n_t, n_c = total["t"] or 0, total["c"] or 0
    if not n_t or not n_c:
        drop_kept(counts)
        return {}, -1.0
    prior = PRIOR * (n_t + n_c) + FLOOR * total["n"]
    own = PRIOR * (F.col("t") + F.col("c")) + FLOOR
    a, b = F.col("t") + own, F.col("c") + own
    odds = F.log(a / (n_t + prior - a)) - F.log(b / (n_c + prior - b))
    told = counts.select("token", odds.alias("odds"), (odds / F.sqrt(1 / a + 1 / b)).alias("z"), (b / (n_c + prior)).alias("rate")).filter(F.col("z") >= Z)
    rows = sorted(told.select("token", "odds", "rate").collect())
    drop_kept(counts)
    # other tokens lose twice what telling tokens gain in texts that are not toxic, so that segments end
    return {r["token"]: r["odds"] for r in rows}, -max(LEAST_LOSS, 2 * sum(r["odds"] * r["rate"] for r in rows))


def _segments(model: dict[str, float], rest: float):
    """(rows of doc_id, text) to (doc_id, n_words, scores): the scores of each document's segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [tokens(text.as_py()) for text in batch.column(1)]
            scores = [[x for _, _, x in segments([model.get(w, rest) for w in each])] for each in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array(scores, pa.list_(pa.float64()))], names=["doc_id", "n_words", "scores"])

    return run


def fit_law(clean: DataFrame) -> tuple[float, float]:
    """(k, scale) of the law for chance segments, from rows (n_words, scores) of texts that are not toxic.

    A text of n words has k * n * exp(-scale * x) segments of score x or more by chance, and its largest
    score so follows a Gumbel law with location log(k * n) / scale. Above their median, scores exceed it
    by 1 / scale on average; one segment that exceeds it by 1 is added, so that few give a fit too.
    """
    each = clean.select(F.explode("scores").alias("x"))
    median = each.agg(F.percentile_approx("x", 0.5, 10_000)).first()[0] or 0.0
    over = each.filter(F.col("x") >= median).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("x") - median), F.lit(0.0)).alias("more")).first()
    words = clean.agg(F.sum("n_words")).first()[0] or 1
    scale = (over["n"] + 1) / (over["more"] + 1)
    return (over["n"] + 1) / max(words, 1) * math.exp(min(700.0, scale * median)), scale


def evidence(scores: Column, n_words: Column, k: float, scale: float) -> Column:
    """log(1 + the sum, over a document's significant segments, of how unlikely each is by chance)."""
    surprise = lambda x: F.lit(scale) * x - F.log(F.lit(k) * n_words)
    least = -math.log(MOST_EXPECTED)
    return F.log1p(F.aggregate(scores, F.lit(0.0), lambda total, x: total + F.when(surprise(x) >= least, surprise(x)).otherwise(0.0)))


def passages(scores: Column, n_words: Column, k: float, scale: float) -> Column:
    """How many significant segments a document has."""
    return F.size(F.filter(scores, lambda x: F.lit(scale) * x - F.log(F.lit(k) * n_words) >= -math.log(MOST_EXPECTED))).cast("long")


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic regression with a small ridge, by Newton's method."""
    w = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - y) + 1e-3 * w
        hess = (design * (p * (1 - p) + 1e-9)[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def score(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """doc_id, score (0 to 1), predicted and passages for each row of docs (doc_id, text), learned from labelled (doc_id, toxic).

    At most MOST_LABELLED rows are learned from; they have text in docs. Three quarters of them, by hash, give
    the log-odds and the others the curve. Null and empty texts have no evidence and get the score of
    that. Without labels of both classes no token tells anything and every score is the base rate.
    """
    chosen = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED)
    chosen = keep(chosen, "labelled")
    # the bound on labelled rows is a bound on what is broadcast
    sample = keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(4))), "sample")
    run = _segments(*learn(sample.filter("part > 0")))
    schema = "doc_id long, n_words long, scores array<double>"
    held = keep(sample.filter("part = 0").select("doc_id", "text").mapInArrow(run, schema).join(F.broadcast(chosen), "doc_id"), "calibration")
    k, scale = fit_law(held.filter("toxic = 0"))
    told = lambda f: f(F.col("scores"), F.col("n_words"), k, scale)
    rows = held.select(told(evidence).alias("evidence"), "toxic").collect()
    drop_kept(sample, held)
    x, y = np.array([r["evidence"] for r in rows]), np.array([float(r["toxic"]) for r in rows])
    slope, base = _logistic(x, y) if len(rows) else (0.0, -5.0)
    p = 1 / (1 + F.exp(-(F.lit(slope) * F.col("evidence") + F.lit(base))))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
    found = found.select("doc_id", told(evidence).alias("evidence"), told(passages).alias("passages")).withColumn("score", p)
    return found.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")


def held_out_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all rows of docs, learned from labels of rows whose fold of five is not 0.

    Returns doc_id, held_out, score, predicted and passages, one row for each row of docs. A null
    doc_id is in no fold and not held out. An empty table gives an empty result.
    """
    part: Column = fold(F.col("doc_id"), 5)
    told = score(docs, labels.filter(part != 0))
    return told.select("doc_id", F.coalesce(part == 0, F.lit(False)).alias("held_out"), "score", "predicted", "passages")
