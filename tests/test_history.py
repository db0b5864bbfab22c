"""Sums in order, handovers, edits, undo and redo, validity and re-indexing against plain loops."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from strataforge.operators import history, ordered, sessions, snapshots
from strataforge.streaming import reindex


def test_running_sums_and_nearest_rows(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(60), k) for k in range(500)]
    table = spark.createDataFrame(rows, "k long, id long").repartition(5)
    total = 0
    for r in sorted(ordered.running(table, [F.col("k"), F.col("id")], s=F.col("id"), n=F.lit(1).cast("long")).collect(), key=lambda r: (r["k"], r["id"])):
        total += r["id"]
        assert r["s"] == total
    few = [r for r in rows if r[0] % 9 == 0]
    probes = spark.createDataFrame([(p, p * 3) for p in range(-5, 80)], "probe long, tag long")
    got = {r["probe"]: (r["tag"], r["id"]) for r in ordered.next_from(spark.createDataFrame(few, "k long, id long"), "k", ["id"], probes).collect()}
    assert got == {p: (3 * p, min(((k, i) for k, i in few if k >= p), default=(0, None))[1]) for p in range(-5, 80)}
    empty = table.limit(0)
    assert ordered.running(empty, [F.col("k")], s=F.col("id")).count() == 0
    assert {r["id"] for r in ordered.next_from(empty, "k", ["id"], probes).collect()} == {None} and ordered.next_from(table, "k", ["id"], probes.limit(0)).count() == 0


def plain_parts(lengths, window, left):
    out, part, chars = [], 0, 0
    for n in lengths:
        chars += n
        cut = window - chars // 4 < left
        out.append((part, chars // 4, cut))
        part, chars = (part + 1, 0) if cut else (part, chars)
    return out


@pytest.mark.parametrize("window,left", [(100, 60), (60, 50), (50, 50), (1000, 1)])
def test_handovers_equal_the_loop(spark, window, left):
    rng = random.Random(window)
    talks = {s: [rng.choice([0, 0, 3, 17, 40, 170, 900]) for _ in range(rng.randint(1, 60))] for s in ("a", "b", "c")} | {"one": [5]}
    rows = [(s, t, "x" * n if n or t % 2 else None) for s, each in talks.items() for t, n in enumerate(each)]
    got = {(r["session_id"], r["turn"]): (r["part"], r["tokens"], r["cut"]) for r in sessions.handovers(spark.createDataFrame(rows, "session_id string, turn long, text string"), window, left).collect()}
    assert got == {(s, t): x for s, each in talks.items() for t, x in enumerate(plain_parts(each, window, left))}


def test_edits_equal_the_loop(spark):
    rng = random.Random(2)
    tasks = {k: [(i * 3 + k, f"t{k}.{i}") for i in range(rng.randint(0, 5))] for k in range(12)}
    edits = [(k, s, rng.choice(["insert", "insert", "cancel", "none"]), f"e{s}", rng.choice([None, -1, 0, 1, 2, 3, 9])) for s, k in enumerate(rng.choices(range(14), k=200))]
    want = {k: list(v) for k, v in tasks.items()}
    for k, _, op, goal, after in edits:
        shown = want.setdefault(k, [])
        if op == "insert":
            if after is None or max(after, 0) >= len(shown):
                shown.append((shown[-1][0] + 1 if shown else 0, goal))
            else:
                a = max(after, 0)
                index = shown[0][0] if a == 0 else shown[a - 1][0] + 1
                want[k] = shown[:a] + [(index, goal)] + [(i + 1, g) for i, g in shown[a:]]
        elif op == "cancel" and after is not None and 1 <= after <= len(shown):
            del shown[after - 1]
    got = sessions.edited_lists(spark.createDataFrame([(k, i, g) for k, v in tasks.items() for i, g in v], "list_id long, order_index int, goal string"), spark.createDataFrame(edits, "list_id long, seq long, op string, goal string, after int"))
    assert sorted(map(tuple, got.collect())) == sorted((k, i, g) for k, v in want.items() for i, g in v)


def test_undo_and_redo_equal_a_replay(spark):
    rng = random.Random(3)
    operations = [(f"r{rng.randrange(4)}", s, rng.choice(["commit", "undo", "undo", "redo", "redo", "look"])) for s in range(600)] + [("none", 1000, "undo"), ("none", 1001, "redo")]
    logs, stacks, want = {}, {}, []
    for repo, seq, kind in operations:
        log, stack = logs.setdefault(repo, []), stacks.setdefault(repo, [])
        done = kind == "commit" or kind == "undo" and len(log) > 1 or kind == "redo" and bool(stack)
        if kind == "commit":
            log.append(seq)
            stack.clear()
        elif done and kind == "undo":
            stack.append(log.pop())
        elif done:
            log.append(stack.pop())
        want.append((repo, seq, kind, done, len(log), len(stack), log[-1] if log else None))
    table = spark.createDataFrame(operations, "repo string, seq long, kind string").repartition(6)
    assert sorted(map(tuple, snapshots.heads(table).select("repo", "seq", "kind", "done", "depth", "undone", "head").collect())) == sorted(want)
    rows = [(r, k + 1, c, False) for r, log in logs.items() for k, c in enumerate(log)] + [(r, len(logs[r]) + k + 1, c, True) for r, stack in stacks.items() for k, c in enumerate(reversed(stack))]
    assert sorted(map(tuple, snapshots.lineage(table).collect())) == sorted(rows)
    assert snapshots.heads(table.limit(0)).count() == 0 and snapshots.lineage(table.limit(0)).count() == 0


def test_states_equal_a_replay(spark):
    rng = random.Random(4)
    log, gone, now, states = [], [], {}, {}
    for seq in range(300):
        if rng.random() < 0.1:
            chat = rng.randrange(3)
            gone.append((chat, seq))
            now = {i: v for i, v in now.items() if v[0] != chat}
        else:
            i, deleted = rng.randrange(9), rng.random() < 0.2
            chat, redirect = i % 3, rng.choice([None, i + 1, i + 2])
            log.append((seq, i, deleted, chat, redirect))
            if deleted:
                now.pop(i, None)
            else:
                now[i] = (chat, redirect)
        states[seq] = dict(now)
    held = history.cascaded(history.intervals(spark.createDataFrame(log, "seq long, id long, deleted boolean, chat_id long, redirect long"), "id"), "chat_id", spark.createDataFrame(gone, "chat_id long, seq long"))
    for seq in (0, 77, 150, 299):
        assert {r["id"]: (r["chat_id"], r["redirect"]) for r in history.as_of(held, seq).collect()} == states[seq]
        active = {r["id"]: r["active"] for r in history.redirected(held, seq).collect()}
        for i in states[seq]:
            end = i
            while end in states[seq] and states[seq][end][1] is not None:
                end = states[seq][end][1]
            assert active[i] == end
    moments = spark.createDataFrame([(77,), (150,), (77,)], "moment long")
    assert sorted((r["moment"], r["id"]) for r in history.at_moments(held, moments).collect()) == sorted((m, i) for m in (77, 150) for i in states[m])


def full_build(versions):
    last = {}
    for v in versions:
        if v[0] not in last or v[1] > last[v[0]][1]:
            last[v[0]] = v
    files = {p: v for p, v in last.items() if not v[2]}
    best = {}
    for p in sorted(files, reverse=True):
        best.update({n: p for n in files[p][3]})
    return {(p, n, p if n in v[3] else best.get(n)) for p, v in files.items() for n in v[4]}


def some_versions(seed):
    rng = random.Random(seed)
    names = [f"n{k}" for k in range(8)]
    return [(f"f{rng.randrange(7)}", seq, rng.random() < 0.15, rng.sample(names, 2), [*rng.sample(names, 3), "lib"]) for seq in range(40)]


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_batches_gives_the_full_index(spark, tmp_path, seed):
    versions = some_versions(seed)
    rng = random.Random(seed)
    rng.shuffle(versions)
    index = reindex.Index(spark, f"file://{tmp_path}/index")
    seen = []
    for k in range(4):
        part = versions[k * 10 : k * 10 + 10]
        seen += part
        index.apply(spark.createDataFrame(part, reindex.VERSION), k)
        if k == 1:  # run again, as after a failure
            index.apply(spark.createDataFrame(part, reindex.VERSION), k)
        got = [tuple(r) for r in index.resolved().collect()]
        assert len(got) == len(set(got)) and set(got) == full_build(seen)


def test_a_stream_keeps_the_index(spark, tmp_path):
    versions = some_versions(9)
    for k, part in enumerate(itertools.batched(versions, 14)):
        spark.createDataFrame(part, reindex.VERSION).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema(reindex.VERSION).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
        reindex.follow(stream, f"file://{tmp_path}/index", f"file://{tmp_path}/checkpoint").awaitTermination(120)
        assert {tuple(r) for r in reindex.Index(spark, f"file://{tmp_path}/index").resolved().collect()} == full_build(versions[: 14 * (k + 1)])


def test_files_to_parse_again(spark):
    resolved = spark.createDataFrame([("a", "x", "b"), ("b", "y", "c"), ("d", "x", "b"), ("e", "z", None), ("c", "w", "c")], "path string, name string, target string")
    changed = spark.createDataFrame([("c",)], "path string")
    told = lambda hops: sorted(r["path"] for r in reindex.to_parse(changed, resolved, hops).collect())
    assert (told(0), told(1), told(2)) == (["c"], ["b", "c"], ["a", "b", "c", "d"])


def test_finished_sessions_are_asked_where_they_lead(spark):
    messages = spark.createDataFrame([(1, 0, "user", 0), (2, 0, "user", 0), (2, 1, "assistant", 0), (3, 0, "assistant", 2)], "session_id long, turn long, role string, n_calls int")
    redirects = spark.createDataFrame([(1, 2), (2, None), (3, None), (4, 3), (5, 9), (6, None)], "id long, next long")
    assert {r["session_id"]: r["finished"] for r in sessions.session_finished(messages, redirects).collect()} == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False}
