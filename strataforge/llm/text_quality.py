"""A quality classifier: a generalised additive model with pairwise interactions over features of whole texts.

Each feature of a text is put into a bin, and the model has a table of numbers for each feature and for some
pairs of them. A score is the logistic function of the sum of what a text's bins find in the tables.
The tables are learned by cyclic boosting: round after round each feature in turn gets a shallow tree, of
two cuts, fitted to the gradient of what all tables say so far, and a small part of it is added to the
feature's table. Then pairs are ranked by what the best cut on both axes would gain, and the best of
them are boosted alike.

The model is fitted on a bounded sample of labelled documents; features are those of whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.llm.lang_id import fold
from strataforge.llm.words import mix, slices
from strataforge.storage import drop_kept, keep

#: Labelled documents learned from at most: those with the least hash of their id and text.
MOST_LABELLED = 20_000
#: Bins of a feature, bins of each axis of a pair, and pairs.
BINS, PAIR_BINS, PAIRS = 32, 8, 6
#: Rounds of boosting at most, the part of a tree that is added, rounds without gain after which it ends, and the weight that pulls a leaf to 0.
ROUNDS, RATE, PATIENCE, RIDGE = 300, 0.1, 25, 2.0
#: Words that so large a part of the sample's documents hold are common, these many at most.
COMMON_SHARE, MOST_COMMON = 0.02, 2_000
#: A score from here on predicts label 1.
LEAST_SCORE = 0.3

_CLASSES = ("lower", "upper", "digit", "stop", "mark", "symbol", "space", "other")
_LOWER, _UPPER, _DIGIT, _STOP, _MARK, _SYMBOL, _SPACE, _OTHER = range(len(_CLASSES))
FEATURES = (
    "log_words", "word_length", *(f"{c}_chars" for c in _CLASSES), "lines", "repeated_neighbours", "distinct_words", "distinct_pairs",
    "common_words", "words_ending_in_symbols", "words_ending_in_stops", "words_without_letters", "upper_words", "most_frequent",
)


def _classes() -> np.ndarray:
    """The class of each byte. Letters outside ASCII are bytes of the class other."""
    table = np.full(256, _SYMBOL, dtype=np.int64)
    table[128:] = _OTHER
    for what, chars in ((_LOWER, range(97, 123)), (_UPPER, range(65, 91)), (_DIGIT, range(48, 58)), (_SPACE, (9, 10, 11, 12, 13, 32)), (_STOP, b".,;:?"), (_MARK, b"!'\"()-")):
        table[list(chars)] = what
    return table


_CLASS = _classes()


def _sum_by(of: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(of, weights=weights, minlength=n).astype(np.float64)


def features(text: pa.Array, common: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text of a string array; common: sorted hashes of common words. Without words all are 0."""
    out = np.zeros((len(text), len(FEATURES)))
    for s in slices(text, lower=False):
        n = len(s.rows)
        of_word = np.repeat(np.arange(n), np.diff(s.first))
        words = np.maximum(_sum_by(of_word, n), 1)
        length = s.end - s.start
        kinds = _CLASS[s.data]
        by_class = np.zeros((n, len(_CLASSES)))
        for c in range(len(_CLASSES)):
            total = np.concatenate(([0], np.cumsum(kinds == c)))
            by_class[:, c] = np.diff(total[s.offset])
        chars = np.maximum(by_class.sum(axis=1), 1)
        lines = np.diff(np.concatenate(([0], np.cumsum(s.data == 10)))[s.offset])
        key = mix(s.hash + of_word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        same = of_word[1:] == of_word[:-1]
        _, first, times = np.unique(key, return_index=True, return_counts=True)
        most = np.zeros(n)
        np.maximum.at(most, of_word[first], times)
        pairs = np.unique(mix(key[:-1] * np.uint64(3) + key[1:])[same], return_index=True)[1]
        of_pair = of_word[1:][same]
        last = kinds[s.end - 1] if len(length) else np.zeros(0, dtype=np.int64)
        upper, letter = (np.concatenate(([0], np.cumsum(x))) for x in (kinds == _UPPER, (kinds == _LOWER) | (kinds == _UPPER) | (kinds == _OTHER)))
        n_upper, n_letter = upper[s.end] - upper[s.start], letter[s.end] - letter[s.start]
        place = np.minimum(np.searchsorted(common, s.hash), max(len(common) - 1, 0))
        known = common[place] == s.hash if len(common) else np.zeros(len(length), dtype=bool)
        share = lambda chosen: _sum_by(of_word, n, chosen.astype(np.float64)) / words
        table = [np.log1p(_sum_by(of_word, n)), _sum_by(of_word, n, length) / words, *(by_class / chars[:, None]).T, lines / words]
        neighbours = np.maximum(_sum_by(of_pair, n), 1)
        table += [_sum_by(of_pair, n, (s.hash[1:] == s.hash[:-1])[same]) / neighbours, _sum_by(of_word[first], n) / words, _sum_by(of_pair[pairs], n) / neighbours]
        table += [share(known), share((last == _SYMBOL) | (last == _MARK)), share(last == _STOP), share(n_letter == 0), share((n_upper == n_letter) & (n_letter > 1)), most / words]
        out[s.rows.start : s.rows.stop] = np.where((np.diff(s.first) > 0)[:, None], np.stack(table, axis=1), 0.0)
    return out


@dataclass
class Model:
    """Cuts of each feature; tables over its bins; pairs of features, with cuts of their own and tables over both."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def logits(self, x: np.ndarray) -> np.ndarray:
        """What the tables add up to for each row of features."""
        total = np.full(len(x), self.base)
        for k, table in enumerate(self.tables):
            total += table[np.searchsorted(self.cuts[k], x[:, k], side="right")]
        coarse = {k: np.searchsorted(self.pair_cuts[k], x[:, k], side="right") for pair in self.pairs for k in pair}
        for (a, b), table in zip(self.pairs, self.pair_tables):
            total += table[coarse[a], coarse[b]]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -40, 40)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Values that part the sample into at most so many bins of about equal size."""
    return np.unique(np.quantile(values, np.arange(1, bins) / bins, method="higher")) if len(values) else np.zeros(0)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The leaf value of each bin for a tree of up to two cuts, by sums of gradients and curvatures of the bins."""
    edges = [0, len(g)]
    G, H = (np.concatenate(([0.0], np.cumsum(x))) for x in (g, h))
    for _ in range(2):
        best = (1e-9, None)
        for a, b in zip(edges, edges[1:]):
            at = np.arange(a + 1, b)
            if not len(at):
                continue
            gain = _gain(G[at] - G[a], H[at] - H[a]) + _gain(G[b] - G[at], H[b] - H[at]) - _gain(G[b] - G[a], H[b] - H[a])
            k = int(np.argmax(gain))
            best = max(best, (float(gain[k]), int(at[k])), key=lambda x: x[0])
        if best[1] is None:
            break
        edges = sorted([*edges, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(edges, edges[1:]):
        out[a:b] = (G[b] - G[a]) / (H[b] - H[a] + RIDGE)
    return out


def quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """For sums over a grid: the gain of the best cut on both axes, and the leaf value of each cell under it."""
    corner = lambda x: np.pad(x.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
    G, H = corner(g), corner(h)

    def parts(total: np.ndarray) -> list[np.ndarray]:
        inner, left, top, every = total[1:-1, 1:-1], total[1:-1, -1:], total[-1:, 1:-1], total[-1, -1]
        return [inner, left - inner, top - inner, every - left - top + inner]

    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)
    gs, hs = parts(G), parts(H)
    gain = sum(_gain(a, b) for a, b in zip(gs, hs)) - _gain(G[-1, -1], H[-1, -1])
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.zeros_like(g)
    value = [float(a[i, j] / (b[i, j] + RIDGE)) for a, b in zip(gs, hs)]
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = value
    return float(gain[i, j]), out


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """A model of features x and labels y (0 or 1). Each fifth row is held back and says when to stop.

    Without rows of both labels, all scores are the share of label 1, drawn to a half.
    """
    rate = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(float(np.log(rate / (1 - rate))), [_cuts(x[:, k], BINS) for k in range(x.shape[1])], [])
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    if not len(y) or y.min() == y.max():
        return model
    bins = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(model.cuts)]
    held = np.arange(len(y)) % 5 == 4
    total = np.full(len(y), model.base)

    def slope(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total[rows], -40, 40)))
        return y[rows] - p, p * (1 - p)

    def loss() -> float:
        own = total[held] if held.any() else total
        return float(np.logaddexp(0, np.where((y[held] if held.any() else y) > 0, -own, own)).mean())

    def boost(tables: list[np.ndarray], places: list[np.ndarray], fitted) -> None:
        """Round after round a tree for each table in turn; at last the tables of the round with the least loss."""
        nonlocal total
        best, kept, since = loss(), [t.copy() for t in tables], 0
        for _ in range(ROUNDS):
            for table, place in zip(tables, places):
                g, h = slope(~held)
                own = place[~held]
                step = RATE * fitted(*(np.bincount(own, weights=w, minlength=table.size).reshape(table.shape) for w in (g, h)))
                table += step
                total = total + step.ravel()[place]
            now = loss()
            since = 0 if now < best - 1e-6 else since + 1
            if now < best:
                best, kept = now, [t.copy() for t in tables]
            if since >= PATIENCE:
                break
        for table, good, place in zip(tables, kept, places):
            total = total + (good - table).ravel()[place]
            table[...] = good

    boost(model.tables, bins, tree)
    model.pair_cuts = [_cuts(x[:, k], PAIR_BINS) for k in range(x.shape[1])]
    coarse = [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(model.pair_cuts)]
    g, h = slope(~held)
    ranked = []
    for a in range(x.shape[1]):
        for b in range(a + 1, x.shape[1]):
            shape = len(model.pair_cuts[a]) + 1, len(model.pair_cuts[b]) + 1
            grid = [np.bincount((coarse[a] * shape[1] + coarse[b])[~held], weights=w, minlength=shape[0] * shape[1]).reshape(shape) for w in (g, h)]
            ranked.append((-quadrants(*grid)[0], a, b))
    model.pairs = [(a, b) for gain, a, b in sorted(ranked)[:PAIRS] if gain < 0]
    model.pair_tables = [np.zeros((len(model.pair_cuts[a]) + 1, len(model.pair_cuts[b]) + 1)) for a, b in model.pairs]
    places = [coarse[a] * (len(model.pair_cuts[b]) + 1) + coarse[b] for a, b in model.pairs]
    boost(model.pair_tables, places, lambda g, h: quadrants(g, h)[1])
    return model


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a partition of texts that hold a word, by the word's hash."""
    for batch in batches:
        found = [np.unique(s.hash[s.first[k] : s.first[k + 1]]) for s in slices(batch.column(0), lower=False) for k in range(len(s.rows))]
        words, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64), pa.int64()), pa.array(n, pa.int64())], names=["word", "n"])


def sample(docs: DataFrame, labelled: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, text, y): documents of docs that labelled (doc_id, quality) tells of, most at most, those with the least hash of id and text.

    Of several labels of an id the larger counts. Labels are thinned by their hash first, so that no task
    gathers more than a few times the rows wanted.
    """
    told = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).dropna().groupBy("doc_id").agg(F.max("y").alias("y"))
    n, fine = told.count(), 1 << 20
    if n > most:
        told = told.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(fine)) < int(np.ceil(fine * min(1.0, 1.1 * most / n))))
    # a bounded number of ids and labels, so they may be broadcast
    chosen = keep(told.orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(most), "labelled")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    rows = keep(rows.withColumn("mark", F.xxhash64("doc_id", "text", F.lit(1))), "rows")
    # an id may stand on any number of rows
    return rows.drop("mark") if rows.count() <= most else keep(rows.orderBy("mark", "doc_id", "text").limit(most).drop("mark"), "sample")


def learn(labelled: DataFrame) -> tuple[Model, np.ndarray]:
    """The model and the hashes of common words from rows (doc_id, text, y), of bounded number: their features come to the driver."""
    n = labelled.count()
    counts = labelled.select("text").mapInArrow(_common, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = counts.filter(F.col("n") >= max(2, COMMON_SHARE * n)).orderBy(F.desc("n"), "word").limit(MOST_COMMON).collect()
    common = np.sort(np.array([r["word"] for r in words], dtype=np.int64).view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(0), common)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    # in an order of their own, so that sums don't depend on that of the rows
    rows = sorted((r["x"], r["y"]) for r in labelled.select("text", "y").mapInArrow(run, "x array<double>, y int").collect())
    rows = [rows[k] for k in np.random.default_rng(5).permutation(len(rows))]
    x = np.array([r[0] for r in rows]).reshape(len(rows), len(FEATURES))
    return train(x, np.array([float(r[1] > 0) for r in rows])), common


def score(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """doc_id, score (0 to 1) and predicted for each row of docs (doc_id, text), learned from labelled (doc_id, quality)."""
    rows = sample(docs, labelled)
    model, common = learn(rows)
    drop_kept(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(features(batch.column(1), common)), pa.float64())], names=["doc_id", "score"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return found.withColumn("predicted", (F.col("score") >= LEAST_SCORE).cast("int"))


def held_out_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all rows of docs, learned from labels of rows whose fold of five is not 0.

    docs needs doc_id and text, labels doc_id and quality; other columns are ignored. Returns doc_id,
    held_out, score and predicted, one row for each row of docs. A null doc_id is in no fold and not held
    out. Null texts and texts without a word get the score that the tables have for no words. Very long
    texts count whole, equal texts get equal scores. Without labels of both kinds every score is the
    share of label 1, and a half if there are none. An empty table gives an empty result.
    """
    part: Column = fold(F.col("doc_id"), 5)
    told = score(docs, labels.filter(part != 0))
    return told.select("doc_id", F.coalesce(part == 0, F.lit(False)).alias("held_out"), "score", "predicted")
