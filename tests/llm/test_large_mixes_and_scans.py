"""Slots and sources in the numbers of large inputs, and scans of many toxic places."""

import random
import time

import pytest
from pyspark.sql import functions as F

from strataforge.llm import mixing, toxicity


def test_points_of_far_slots(spark):
    slots = [0, 1, 5, 2**31 - 1, 2**31, 2**32 + 7, 8_000_000_000, 2**34, 2**40 + 3, 2**61]
    got = {r["slot"]: r["x"] for r in spark.createDataFrame([(s,) for s in slots], "slot long").select("slot", mixing.point(F.col("slot")).alias("x")).collect()}
    assert got == {s: (s * mixing.STEP % 2**62 >> 10) / 2**52 for s in slots}


def test_a_million_sources(spark):
    sizes = spark.range(1_000_000).select(F.format_string("host%07d", "id").alias("source"), (F.col("id") % 7).alias("size"))
    got = mixing.targets(sizes).agg(F.count("*").alias("n"), F.sum("target").alias("t"), F.sum("source_size").alias("s"), F.max(F.col("target") - 3 * F.col("source_size")).alias("over")).first()
    assert got["n"] == 1_000_000 and abs(got["t"] - got["s"]) < 1e-3 * got["s"] and got["over"] <= 0


def test_targets_equal_the_rule(spark):
    rng = random.Random(3)
    for n in (1, 2, 9, 60):
        sizes = [(None if k == 4 else f"s{k:02d}", rng.choice([0, 1, 5, 1000, 90_000])) for k in range(n)]
        weight = {s: (1, 2, 3)[k % 3] for k, (s, _) in enumerate(sorted(sizes, key=lambda x: (x[0] is None, x[0] or "")))}
        left, free, want = float(sum(x for _, x in sizes)), dict(sizes), {}
        while free:
            share = left / sum(weight[s] for s in free)
            full = [s for s, x in free.items() if share * weight[s] >= 3 * x]
            if not full:
                want |= {s: share * weight[s] for s in free}
                break
            for s in full:
                want[s] = 3.0 * free.pop(s)
                left -= want[s]
        got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(sizes, "source string, size long")).collect()}
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * (1 + want[s]) for s in want)


def test_running_sums(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 50).alias("k"), F.col("id"))
    got = mixing.running(rows, [F.col("k"), F.col("id")], n=F.lit(1).cast("long"), s=F.col("id")).orderBy("k", "id").collect()
    total = 0
    for place, r in enumerate(got, 1):
        total += r["id"]
        assert (r["n"], r["s"]) == (place, total)


def plain_segments(scores):
    """Ruzzo and Tompa's own recursion: the best segment (shortest of the best), then what is left and right of it."""
    best = None
    for i in range(len(scores)):
        total = 0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > 0 and (best is None or (total, i - j) > (best[2], best[0] - best[1] + 1)):
                best = (i, j + 1, total)
    if best is None:
        return []
    return plain_segments(scores[: best[0]]) + [best] + [(a + best[1], b + best[1], s) for a, b, s in plain_segments(scores[best[1] :])]


def test_all_maximal_segments():
    rng = random.Random(7)
    for _ in range(1500):
        # powers of two, so that no two segments have the same score
        scores = [rng.choice([-1, 1]) * (2**k + rng.randrange(3) * 2**12) for k in rng.sample(range(12), rng.randint(1, 12))]
        assert toxicity.segments(scores) == plain_segments(scores)


@pytest.mark.parametrize("make", [lambda k: [1.0, -2.0][k % 2], lambda k: [2.0, -1.0][k % 2], lambda k: [1.0, -1.0][k % 2], lambda k: float((k * 7919) % 13 - 6), lambda k: -2.0 if k % 3 == 0 else 0.9, lambda k: 1.0 + k if k % 2 == 0 else -0.5 - k])
def test_scans_take_linear_time(make):
    scores = [make(k) for k in range(400_000)]
    began = time.process_time()
    toxicity.segments(scores)
    assert time.process_time() - began < 4
