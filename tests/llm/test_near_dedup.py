import random
import re

import pytest

from strataforge.llm import near_dedup
from strataforge.llm.near_dedup import least_matches, near_duplicates, recall, survivors

SCHEMA = "doc_id long, text string"


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))) if words else frozenset()


def brute(rows, width, percent):
    sets = {i: shingles(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80), (3, 50), (2, 60), (3, 70)])
def test_equals_brute_force(spark, width, percent):
    rng = random.Random(width)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    bases = [[word() for _ in range(n)] for n in (1, 2, 3, 6, 40, 150, 400)]
    rows = []
    for k in range(220):
        base = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 4, len(base) // 40])):
            base[rng.randrange(len(base))] = word()
        rows.append((k, rng.choice([" ", "\n", "  "]).join(base).upper() if k % 3 == 0 else " ".join(base)))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "Same same")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA), width, percent).collect()}
    assert got == brute(rows, width, percent)


def test_chains_and_one_large_group(spark):
    """A base with many variants that only link to it, and a chain in which only neighbours link."""
    rng = random.Random(1)
    base = [f"w{k}" for k in range(300)]
    rows = [(500, " ".join(base))]
    for k in range(400):
        own = list(base)
        for at in rng.sample(range(300), 7):
            own[at] = f"x{k}_{at}"
        rows.append((k, " ".join(own)))
    for k in range(20):
        rows.append((600 + k, " ".join(f"c{j}" for j in range(5 * k, 5 * k + 100))))
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, SCHEMA), 3, 85).collect()}
    assert got == {i: c for i, (_, c, _) in brute(rows, 3, 85).items()}


def test_lists_longer_than_a_block(spark, monkeypatch):
    """Lists are split by shingles and by blocks, and no link is lost: variants that only link to some of the others."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng, rows = random.Random(6), []
    common = [f"w{k}" for k in range(200)]
    for k in range(150):  # alike, most under the threshold, in chains of which neighbours link
        own = list(common)
        for at in range(3 * (k % 50), 3 * (k % 50) + 12):
            own[at] = f"x{k // 50}_{at}"
        own[199 - k % 7] = f"y{rng.randrange(3)}"
        rows.append((k, " ".join(own)))
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, SCHEMA), 3, 85).collect()}
    assert got == {i: c for i, (_, c, _) in brute(rows, 3, 85).items()}


def test_sharers_without_links_cost_rows_in_proportion(spark, monkeypatch):
    """Documents that share most of their words but aren't linked: no step's rows grow with the square of their number."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    written = []
    keep = near_dedup.keep

    def counted(df, name):
        out = keep(df, name)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(near_dedup, "keep", counted)
    most = {}
    for n in (100, 400):
        written.clear()
        common = " ".join(f"w{k}" for k in range(150))
        rows = [(k, common + " " + " ".join(f"x{k}_{j}" for j in range(60))) for k in range(n)]
        assert near_duplicates(spark.createDataFrame(rows, SCHEMA), 3, 85).filter("kept").count() == n
        most[n] = max(c for _, c in written)
    assert most[400] <= 5 * most[100], written


def test_survivors(spark):
    rows = [(1, "a b c d", "p"), (1, "a b c d", "p"), (1, "e f g h", "q"), (None, "a b c d", "p"), (None, "alone here now", "x"), (None, "alone here now", "x"), (3, None, None), (4, "", "z")]
    table = spark.createDataFrame(rows, SCHEMA + ", key string")
    got = sorted((tuple(r) for r in survivors(table).collect()), key=str)
    assert got == sorted([(1, "a b c d", "p"), (1, "e f g h", "q"), (None, "alone here now", "x"), (3, None, None), (4, "", "z")], key=str)
    assert survivors(table.limit(0)).count() == 0


def test_recall_of_signatures():
    """What the README states: links at and above the threshold that have too few collisions."""
    for percent in (50, 60, 70, 80, 85, 90):
        assert recall(percent, percent / 100) > 1 - 1 / 10_000
        assert recall(percent, percent / 100 + 0.05) > 1 - 1 / 1_000_000


def test_odd_rows(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "A B c d"), (None, "a b c d"), (None, "alone here now"), (3, None)]
    table = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", node string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(table, 3, 85).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (None, 1, False), (None, None, False), (3, 3, True)], key=str)
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert least_matches(85) == 41
    for percent in (0, 101):
        with pytest.raises(ValueError):
            near_duplicates(table, 3, percent)
