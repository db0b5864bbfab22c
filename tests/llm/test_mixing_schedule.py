"""The schedule at the slot count of large inputs."""

from collections import Counter

from pyspark.sql import functions as F

from strataforge.llm import mixing

SLOTS = 5_000_000


def test_every_source_of_five_million_slots_meets_its_aim(spark):
    aims = [3] * 300 + [30] * 300 + [2000] * 50
    aims = [("s%04d" % k, a) for k, a in enumerate([*aims, SLOTS - sum(aims)])]
    rows, low = [], 0
    for name, aim in aims:
        rows.append((name, max(1, -(-aim // 3)), float(aim), aim, low / SLOTS, (low + aim) / SLOTS, SLOTS))
        low += aim
    sources = spark.createDataFrame(rows, "source_key string, blocks long, slots double, aim long, low double, high double, total long")
    dealt = mixing.schedule(sources)
    got = {r["source_key"]: r for r in dealt.groupBy("source_key").agg(F.count("*").alias("n"), F.max("turn").alias("last"), F.count(F.when(F.col("slot") >= SLOTS, 1)).alias("late")).collect()}
    for name, aim in aims:
        assert got[name]["n"] == aim and got[name]["last"] == aim - 1, name
        assert got[name]["late"] <= 2, name


def test_small_source_beside_a_large_one_is_mixed_to_its_target(spark):
    docs = [(k, "w " * 500, "big") for k in range(1000)] + [(5000 + k, "w", f"one{k:02d}") for k in range(40)] + [(6000 + k, "w " * 90, "low") for k in range(10)]
    table = spark.createDataFrame(docs, "doc_id long, text string, source string")
    source, taken, target = {i: s for i, _, s in docs}, Counter(), {}
    old = mixing.SLOTS
    mixing.SLOTS = 1 << 8  # blocks as long as on large inputs
    try:
        rows = mixing.mix(table).collect()
    finally:
        mixing.SLOTS = old
    for r in rows:
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    assert all(abs(taken[s] - t) <= max(1, t / 50) for s, t in target.items()), (taken, target)
