"""Codes and clusters of vectors against plain loops over all entries."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataforge.llm import centroids, vector_codes, vectors

DATA = "/root/testdata/sf0.001"


def plain_nearest(points, entries):
    return [min((sum((int(a) - int(b)) ** 2 for a, b in zip(p, e)), k) for k, e in enumerate(entries)) for p in points]


@pytest.mark.parametrize("spread,entries,width", [(2, 60, 3), (1, 256, 2), (300, 256, 16), (4, 9, 1), (1 << 26, 40, 4), (0, 20, 2), (5, 1, 4)])
def test_tree_equals_all_pairs(spread, entries, width):
    rng = np.random.default_rng(entries)
    book, points = rng.integers(-spread, spread + 1, (entries, width)), rng.integers(-spread, spread + 1, (400, width))
    points[:20] = book[rng.integers(0, entries, 20)]
    found = vector_codes.Search(vector_codes.grow(book), book, points)
    assert list(zip(found.best.tolist(), found.at.tolist())) == plain_nearest(points, book)


def test_tree_leaves_out_far_entries():
    rng = np.random.default_rng(1)
    middle = rng.integers(-5000, 5000, (16, 4))
    book = np.repeat(middle, 16, axis=0) + rng.integers(-20, 20, (256, 4))
    points = middle[rng.integers(0, 16, 2000)] + rng.integers(-20, 20, (2000, 4))
    found = vector_codes.Search(vector_codes.grow(book), book, points)
    assert found.compared < 0.5 * 2000 * 256


@pytest.mark.parametrize("spread,n,width", [(1, 8, 2), (3, 40, 3), (400, 8, 64), (1 << 26, 8, 64), (0, 5, 3), (2, 1, 2)])
def test_annuli_equal_all_pairs(spread, n, width):
    rng = np.random.default_rng(n)
    middle, v = rng.integers(-spread, spread + 1, (n, width)), rng.integers(-spread, spread + 1, (500, width))
    at, best = centroids.Annuli(middle).nearest(v)
    assert list(zip(best.tolist(), at.tolist())) == plain_nearest(v, middle)


def test_annulus_boundary_ties():
    """The first candidate by norm and one whose norm lies exactly on the annulus are equally near."""
    middle = np.array([[9, 0], [3, 0]])
    at, best = centroids.Annuli(middle).nearest(np.array([[6, 0], [5, 0], [-6, 0]]))
    assert at.tolist() == [0, 1, 1] and best.tolist() == [9, 4, 81]


def test_annuli_leave_out_far_norms():
    middle = np.stack([np.full(4, 100 * k) for k in range(50)])
    found = centroids.Annuli(middle)
    found.nearest(np.repeat(middle, 20, axis=0) + 3)
    assert found.compared < 0.2 * 1000 * 50


def test_products_are_exact():
    rng = np.random.default_rng(3)
    for top in (10, 1 << 20, vectors.MOST - 1):
        a, b = rng.integers(-top, top + 1, (7, 64)), rng.integers(-top, top + 1, (5, 64))
        assert vectors.distances(a, b).tolist() == [[sum((int(x) - int(y)) ** 2 for x, y in zip(p, q)) for q in b] for p in a]


def whole(row):
    v = row[1]
    return None if v is None or any(x is None or not np.isfinite(x) for x in v) else [int(np.floor(1024 * x)) for x in v]


def plain_codes(rows, parts=4, entries=256, rounds=4):
    kept = sorted(((r[0], whole(r), r[2]) for r in rows if whole(r) and len(whole(r)) % parts == 0), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    w = len(kept[0][1]) // parts
    cut = [[r[1][p * w : (p + 1) * w] for r in kept] for p in range(parts)]
    books = [c[:entries] for c in cut]
    for _ in range(rounds):
        for p in range(parts):
            codes = [k for _, k in plain_nearest(cut[p], books[p])]
            books[p] = [[sum(c) // len(c) for c in zip(*own)] if (own := [x for x, k in zip(cut[p], codes) if k == e]) else list(books[p][e]) for e in range(len(books[p]))]
    last = [plain_nearest(cut[p], books[p]) for p in range(parts)]
    name = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(last[p][i][0] for p in range(parts)) for i in range(len(kept))]
    of = {lab: sum(e for e, r in zip(errors, kept) if r[2] == lab) for lab in {r[2] for r in kept}}
    return sorted(((r[0], "".join(f"{last[p][i][1]:02x}" for p in range(parts)), errors[i], of[r[2]], name) for i, r in enumerate(kept)), key=str)


def plain_clusters(rows, clusters=8, rounds=10, dimensions=64):
    mark = lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest()
    kept = sorted(((r[0], whole(r)) for r in rows if whole(r) and len(r[1]) == dimensions), key=lambda r: (r[0] is None, mark(r[0]), r[1]))
    if not kept:
        return []
    middle = [r[1] for r in kept[:clusters]]
    for _ in range(rounds):
        at = [k for _, k in plain_nearest([r[1] for r in kept], middle)]
        middle = [[sum(c) // len(c) for c in zip(*own)] if (own := [r[1] for r, k in zip(kept, at) if k == e]) else middle[e] for e in range(len(middle))]
    last = plain_nearest([r[1] for r in kept], middle)
    inertia = [sum(d for d, k in last if k == e) for e in range(len(middle))]
    name = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in middle]
    return sorted(((r[0], k, d, inertia[k], sum(inertia), name[k]) for r, (d, k) in zip(kept, last)), key=str)


def odd_rows(length):
    """Ties, repeated ids and rows, one hot vector, nulls, components that aren't finite and other lengths."""
    rng = random.Random(length)
    vector = lambda: [rng.choice([-0.75, -0.5, 0.0, 0.25, 0.2501, 1.0]) for _ in range(length)]
    rows = [(k, vector(), rng.choice([0, 1, None])) for k in range(90)] + [(200 + k, [0.5] * length, 1) for k in range(60)]
    rows += [(5, vector(), 2), (5, vector(), None), rows[7], rows[7], (None, vector(), 1), (None, vector(), None), (300, None, 1), (301, [], 1), (302, [0.0] * (length + 1), 1), (303, [0.0] * (length + 4), 1)]
    return rows + [(304 + k, [x, *[0.0] * (length - 1)], 1) for k, x in enumerate([None, float("nan"), float("inf"), -float("inf")])]


@pytest.mark.parametrize("entries", [256, 20])
def test_codes_equal_loops(spark, entries):
    rows = odd_rows(8)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("v", F.lit("x")).withColumn("code", F.lit(1)).withColumn("of", F.lit(1))
    got = vector_codes.compress(table, entries=entries)
    want = plain_codes([r for r in rows if r[1] is None or len(r[1]) == 8], entries=entries)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert sorted(map(tuple, vector_codes.compress(table.repartition(5), entries=entries).collect()), key=str) == want


def test_clusters_equal_loops(spark):
    rows = odd_rows(64)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("cluster", F.lit("x")).withColumn("v", F.lit(1))
    got = centroids.cluster(table)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_clusters(rows)
    assert sorted(map(tuple, centroids.cluster(table.repartition(5)).collect()), key=str) == plain_clusters(rows)


def test_few_rows_and_none(spark):
    schema = "vec_id long, embedding array<float>, label int"
    table = spark.createDataFrame([(3, [0.5] * 64, None), (1, [-0.25] * 64, None), (2, None, 1)], schema)
    assert sorted((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in vector_codes.compress(table).collect()) == [(1, "00000000", 0, 0), (3, "01010101", 0, 0)]
    assert sorted((r["vec_id"], r["distance"]) for r in centroids.cluster(table).collect()) == [(1, 0), (3, 0)]
    for empty in (table.limit(0), table.filter("vec_id = 2")):
        assert vector_codes.compress(empty).count() == 0 and centroids.cluster(empty).count() == 0
    with pytest.raises(Exception, match="doesn't fit"):
        centroids.cluster(spark.createDataFrame([(1, [2e5] * 64, 1)], schema)).count()


def test_tables_equal_loops(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet").limit(120)
    rows = [tuple(r) for r in table.collect()]
    assert sorted(map(tuple, vector_codes.compress(table, entries=32).collect()), key=str) == plain_codes(rows, entries=32)
    assert sorted(map(tuple, centroids.cluster(table).collect()), key=str) == plain_clusters(rows)
