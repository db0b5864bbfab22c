"""The store's tables against a plain replay of the log."""

import random

from strataforge.operators import store


def replay(log, moment):
    tables = {e: {} for e in store.PARENTS}

    def drop(entity, key):
        tables[entity].pop(key, None)
        for below, above in store.PARENTS.items():
            if above == entity:
                for k in [k for k, r in tables[below].items() if r["parent"] == key]:
                    drop(below, k)

    for seq, op, entity, key, parent, fields in log:
        if seq > moment:
            break
        above = store.PARENTS[entity]
        if op == "create" and (above is None or parent in tables[above]):
            values = dict.fromkeys(store.FIELDS[entity]) | store.DEFAULTS.get(entity, {})
            tables[entity][key] = {"parent": parent, "created_at": seq, "updated_at": seq, **values, **{k: v for k, v in fields.items() if k in values}}
            if entity == "messages":
                tables["sessions"][parent]["updated_at"] = tables["chats"][tables["sessions"][parent]["parent"]]["updated_at"] = seq
        elif op == "update" and key in tables[entity]:
            tables[entity][key] |= {k: v for k, v in fields.items() if k in store.FIELDS[entity]} | {"updated_at": seq}
        elif op == "delete":
            drop(entity, key)
    for r in tables["chats"].values():
        r["title"] = r["title"] if r["title"] is not None else r["role"]
    return tables


def some_log(seed, n):
    rng, log, made = random.Random(seed), [], {e: [] for e in store.PARENTS}
    for seq in range(1, n):
        entity = rng.choice(["chats", "sessions", "sessions", "messages", "messages", "messages", "todo_lists", "todo_tasks", "skills"])
        op = rng.choice(["create", "create", "update", "update", "delete"]) if entity != "messages" else "create"
        above = store.PARENTS[entity]
        parent = rng.choice(made[above]) if above and made[above] else None
        fields = {f: rng.choice([None, "a", "b", "pending"]) for f in rng.sample(store.FIELDS[entity], rng.randint(0, min(2, len(store.FIELDS[entity]))))}
        if op == "create" and (above is None or parent is not None):
            made[entity].append(seq)
            log.append((seq, op, entity, seq, parent, fields))
        elif made[entity]:
            log.append((seq, op, entity, rng.choice(made[entity]), None, fields))
        else:
            log.append((seq, "update", entity, 10_000, None, {}))
    return log


def test_tables_equal_a_replay(spark):
    log = some_log(3, 260)
    table = spark.createDataFrame(log, store.LOG).repartition(5)
    for moment in (130, 259):
        want = replay(log, moment)
        for entity in ("chats", "sessions", "messages", "todo_lists", "todo_tasks", "skills"):
            got = {r["id"]: {k: v for k, v in r.asDict().items() if k != "id"} for r in store.table(table, entity, moment).collect()}
            assert got == want[entity], entity
    assert {r["id"] for r in store.table(table, "todo_tasks").collect()} == set(replay(log, 10**9)["todo_tasks"])
    assert all(store.table(table.limit(0), e).count() == 0 for e in ("chats", "messages"))


def test_active_sessions_and_open_work(spark):
    log = [
        (1, "create", "chats", 1, None, {"role": "r"}), (2, "create", "sessions", 2, 1, {"redirect_session_id": "4"}), (3, "create", "sessions", 3, 1, {"parent_session_id": "2"}), (4, "create", "sessions", 4, 1, {"parent_session_id": "2"}), (5, "create", "chats", 5, None, {"role": "q"}), (6, "create", "sessions", 6, 5, {}),
        (7, "create", "messages", 7, 6, {"role": "assistant", "tool_calls": "[1]"}), (8, "create", "messages", 8, 4, {"role": "user"}), (9, "create", "messages", 9, 2, {"role": "tool"}), (10, "create", "messages", 10, 3, {"role": "user", "tool_call_id": "c"}),
        (11, "create", "todo_lists", 11, 6, {}), (12, "create", "todo_tasks", 12, 11, {"goal": "g"}), (13, "create", "todo_lists", 13, 4, {}), (14, "create", "todo_tasks", 14, 13, {"status": "completed"}), (15, "update", "todo_lists", 13, None, {"status": "approved"}),
    ]
    table = spark.createDataFrame(log, store.LOG)
    assert sorted(map(tuple, store.active_sessions(table).collect())) == [(1, 4), (5, 6)]
    assert {r["session_id"]: r["dangling"] for r in store.dangling(store.table(table, "messages")).collect()} == {6: True, 4: False, 2: True, 3: True}
    assert [tuple(r) for r in store.unfinished_lists(store.table(table, "todo_lists"), store.table(table, "todo_tasks")).collect()] == [(6, 11)]
