"""Conversations, sessions, task lists, audit logs and skills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataforge.operators.graph import chain_ends, chain_members
from strataforge.operators.ordered import next_from, running
from strataforge.storage import keep

#: Number of an effort, its name, and the depth of subagents that it allows.
EFFORTS = ((1, "Low", 1), (2, "Medium", 2), (3, "High", 4), (4, "Maximum", 8), (99, "Unlimited", 16))
#: Tokens left below which a session is handed over, and the usual size of a context window.
HANDOVER_LEFT, CONTEXT_WINDOW = 50_000, 200_000
ACTIVE = ("pending", "in_progress", "rejected")
#: Members of chains that one task reads with what their sessions did.
CHAIN_ROWS = 100_000


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, "^\\s+|\\s+$", "")


def title(message: Column) -> Column:
    """A chat's title: `Untitled` for an empty message, else the trimmed message, cut after 50 characters."""
    short = trimmed(message)
    return F.when(F.coalesce(message, F.lit("")) == "", "Untitled").when(F.length(short) > 50, F.concat(F.left(short, F.lit(50)), F.lit("..."))).otherwise(short)


def chats_with_user(messages: DataFrame) -> DataFrame:
    """session_id of sessions in which a user wrote, the latest first: what a listing of chats keeps."""
    return messages.filter(F.col("role") == "user").select("session_id").distinct().orderBy(F.desc("session_id"))


def chats_without_user(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions in which no user wrote: what a listing purges."""
    return sessions.join(messages.filter(F.col("role") == "user").select("session_id"), "session_id", "left_anti")


def session_finished(messages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(session_id, finished): whether the last message (by turn) is the assistant's and calls no tools.

    messages: session_id, turn, role, n_calls. With redirects (id, next), one row a session, a session's active
    one is asked, which the redirects lead to; one without messages isn't finished.
    """
    last = messages.groupBy("session_id").agg(F.max_by(F.struct("role", "n_calls"), "turn").alias("m"))
    told = last.select("session_id", ((F.col("m.role") == "assistant") & (F.coalesce("m.n_calls", F.lit(0)) == 0)).alias("finished"))
    if redirects is None:
        return told
    active = chain_ends(redirects).select(F.col("id").alias("asked"), F.col("last").alias("session_id"))
    return active.join(told, "session_id", "left").select(F.col("asked").alias("session_id"), F.coalesce("finished", F.lit(False)).alias("finished"))


def pending_calls(messages: DataFrame) -> DataFrame:
    """(session_id, call) of each session's last assistant message that no later message answers.

    messages: session_id, turn, role, calls (array of ids), answers (id or null).
    """
    last = messages.filter(F.col("role") == "assistant").groupBy("session_id").agg(F.max_by("calls", "turn").alias("calls"), F.max("turn").alias("turn"))
    asked = last.select("session_id", "turn", F.explode("calls").alias("call"))
    answers = messages.filter("answers is not null").select("session_id", F.col("turn").alias("at"), F.col("answers").alias("call"))
    return asked.join(answers, (asked.session_id == answers.session_id) & (asked.call == answers.call) & (F.col("at") > asked.turn), "left_anti").select("session_id", "call")


def handover_flags(messages: DataFrame, context_window: int = CONTEXT_WINDOW, left: int = HANDOVER_LEFT) -> DataFrame:
    """messages (session_id, turn, text) with tokens (a fourth of the characters so far) and whether so few tokens are left that the session is handed over."""
    so_far = F.sum(F.length("text")).over(Window.partitionBy("session_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    counted = messages.withColumn("tokens", F.floor(so_far / 4).cast("long"))
    return counted.withColumn("handover", (F.lit(context_window) - F.col("tokens")) < left)


def handovers(messages: DataFrame, context_window: int = CONTEXT_WINDOW, left: int = HANDOVER_LEFT) -> DataFrame:
    """messages (session_id, turn, text) as the sessions that handovers cut them into: part (0, 1, ...), tokens and cut.

    tokens is a fourth of the characters since the part began; where fewer than left are left of the window,
    the part is cut and the next message begins another one. Sums over all messages in order give, for each
    one, where a part that begins with it would end; pointers from these to the next are then followed from
    each session's first message, twice as far each round. (session_id, turn) tells messages apart.
    """
    key = ["session_id", "turn"]
    lengths = messages.select(*key, F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"))
    rows = keep(running(lengths, [F.col("session_id"), F.col("turn")], upto=F.col("chars"), place=F.lit(1).cast("long")).withColumn("from", F.col("upto") - F.col("chars")), "places")
    # a part is over with the first message that brings its characters here
    enough = 4 * (context_window - left + 1)
    begins = next_from(rows, "from", ["place", "session_id"], rows.select((F.col("from") + enough).alias("probe"), F.col("place").alias("id"), F.col("session_id").alias("of")))
    pointers = begins.select("id", F.when(F.col("session_id").eqNullSafe(F.col("of")), F.col("place")).alias("next"))
    first = rows.groupBy("session_id").agg(F.min("place").alias("id"))
    starts = chain_members(pointers, first.select("id")).select(F.col("id").alias("place"), F.col("hop").cast("long").alias("part"))
    marked = rows.join(starts, "place", "left")
    numbered = keep(running(marked.withColumn("starts", F.col("part").isNotNull().cast("long")), [F.col("place")], n=F.col("starts")), "parts")
    heads = numbered.filter("part is not null").select("n", F.col("part").alias("number"), F.col("from").alias("begin"))
    tokens = F.floor((F.col("upto") - F.col("begin")) / 4).cast("long")
    return numbered.join(heads, "n").select("session_id", "turn", F.col("number").alias("part"), tokens.alias("tokens"), ((context_window - tokens) < left).alias("cut"))


def edited_lists(tasks: DataFrame, edits: DataFrame) -> DataFrame:
    """(list_id, order_index, goal) after all edits of each list, in the order of seq.

    edits: list_id, seq, op, goal, after. `insert` puts a task behind the after-th shown (0 or less: before the
    first; null, or more than there are: at the end) and moves later ones up by one; `cancel` takes out the
    after-th, if there is one, and leaves the others' order_index. Lists are written by people: one list's
    tasks and edits are gathered and replayed in one expression, all lists at once.
    """
    entry = "array<struct<order_index:bigint,goal:string>>"
    had = tasks.groupBy("list_id").agg(F.array_sort(F.collect_list(F.struct(F.col("order_index").cast("bigint").alias("order_index"), "goal"))).alias("tasks"))
    done = edits.groupBy("list_id").agg(F.array_sort(F.collect_list(F.struct("seq", "op", "goal", F.col("after").cast("bigint").alias("after")))).alias("edits"))
    both = had.join(done, "list_id", "full_outer").withColumns({"tasks": F.coalesce("tasks", F.array().cast(entry)), "edits": F.coalesce("edits", F.array().cast(done.schema["edits"].dataType))})

    def step(shown: Column, edit: Column) -> Column:
        n = F.size(shown)
        last = F.coalesce(F.try_element_at(shown, F.lit(-1))["order_index"] + 1, F.lit(0))
        after = F.greatest(edit["after"], F.lit(0)).cast("int")
        at_end = edit["after"].isNull() | (after >= n)
        index = F.when(at_end, last).when(after == 0, F.get(shown, F.lit(0))["order_index"]).otherwise(F.get(shown, after - 1)["order_index"] + 1)
        moved = F.transform(F.slice(shown, after + 1, n), lambda t: F.struct((t["order_index"] + 1).alias("order_index"), t["goal"].alias("goal")))
        new = F.array(F.struct(index.alias("order_index"), edit["goal"].alias("goal")))
        inserted = F.when(at_end, F.concat(shown, new)).otherwise(F.concat(F.slice(shown, F.lit(1), after), new, moved))
        without = F.when((after < 1) | (after > n) | edit["after"].isNull(), shown).otherwise(F.concat(F.slice(shown, F.lit(1), F.greatest(after - 1, F.lit(0))), F.slice(shown, after + 1, n)))
        return F.when(edit["op"] == "insert", inserted).when(edit["op"] == "cancel", without).otherwise(shown).cast(entry)

    return both.select("list_id", F.explode(F.aggregate("edits", F.col("tasks"), step)).alias("t")).select("list_id", "t.*")


def next_task(tasks: DataFrame) -> DataFrame:
    """One task for each list: those in progress before those pending, then by order_index and id."""
    rank = F.when(F.col("status") == "in_progress", 0).when(F.col("status") == "pending", 1)
    return tasks.filter(rank.isNotNull()).groupBy("list_id").agg(F.min_by(F.struct("id", "status", "order_index"), F.struct(rank.alias("r"), "order_index", "id")).alias("t")).select("list_id", "t.*")


def all_done(lists: DataFrame, tasks: DataFrame) -> DataFrame:
    """(list_id, done): whether all tasks of a list are completed; a list without tasks is done."""
    done = tasks.groupBy("list_id").agg(F.bool_and(F.col("status") == "completed").alias("done"))
    return lists.join(done, "list_id", "left").select("list_id", F.coalesce("done", F.lit(True)).alias("done"))


def ordered_insert(tasks: DataFrame, list_id: int, goal: str, after: int | None = None) -> DataFrame:
    """tasks (list_id, order_index, goal) with a new one after the after-th of the list (0: first, None: last); later ones move up."""
    spark = tasks.sparkSession
    mine = tasks.filter(F.col("list_id") == list_id)
    last = mine.agg(F.coalesce(F.max("order_index") + 1, F.lit(0)).alias("order_index"))
    at = last if after is None else last.select(F.least(F.lit(after), "order_index").alias("order_index"))
    moved = mine if after is None else mine.withColumn("order_index", F.when(F.col("order_index") >= after, F.col("order_index") + 1).otherwise(F.col("order_index")))
    new = at.select(F.lit(list_id).cast("long").alias("list_id"), F.col("order_index").cast(dict(tasks.dtypes)["order_index"]).alias("order_index"), F.lit(goal).alias("goal"))
    return moved.select("list_id", "order_index", "goal").unionByName(new)


def active_list(lists: DataFrame) -> DataFrame:
    """(session_id, id, status) of each session's newest list that is pending, in progress or rejected."""
    return lists.filter(F.col("status").isin(*ACTIVE)).groupBy("session_id").agg(F.max_by(F.struct("id", "status"), "id").alias("l")).select("session_id", "l.*")


def page(changes: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Changes, the newest first; offset only counts with a limit."""
    ordered = changes.orderBy(F.desc("timestamp"), F.desc("id"))
    return ordered if limit is None else ordered.offset(offset).limit(limit)


def _by_start(members: DataFrame) -> DataFrame:
    """members dealt by start, so that what is then grouped by start moves no more; parts hold CHAIN_ROWS rows or so, however many there are."""
    parts = max(members.sparkSession.sparkContext.defaultParallelism, members.count() // CHAIN_ROWS + 1)
    return members.repartition(parts, "start")


def by_chain(members: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows (session_id, ...) of all sessions along each start's chain (start, id, hop). Where only sums are wanted, rows may be a session's sums.

    Rows of sessions on no chain are left out first; where few are left, no member moves to a session's place.
    """
    asked = members.select("start", F.col("id").alias("session_id"), "hop")
    wanted = keep(rows.join(asked.select("session_id").distinct(), "session_id", "left_semi"), "asked")
    return _by_start(asked).join(wanted, "session_id")


def effort_depth(effort: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for n, _, d in EFFORTS for x in (n, d))), effort)


def depth_allowed(effort: Column, depth: Column) -> Column:
    """Whether a subagent may be this deep; an unknown effort allows any."""
    return F.coalesce(depth < effort_depth(effort), F.lit(True))


def upsert(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The latest row of each key."""
    rest = [c for c in rows.columns if c not in (*keys, seq)]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(*keys, "r.*")


def skill_summary(content: Column) -> Column:
    """The first line of the trimmed text, 200 characters of it at most."""
    return F.left(F.substring_index(trimmed(content), "\n", 1), F.lit(200))


def load_messages(messages: DataFrame, session_id: int) -> DataFrame:
    """A session's messages in order; those without content, calls and an answered call are left out."""
    there = (F.coalesce("content", F.lit("")) != "") | F.col("tool_calls").isNotNull() | F.col("tool_call_id").isNotNull()
    return messages.filter((F.col("session_id") == session_id) & there).orderBy("timestamp", "id")


def latest_root(sessions: DataFrame) -> DataFrame:
    """(chat_id, id): each chat's newest session without a parent."""
    return sessions.filter("parent_session_id is null").groupBy("chat_id").agg(F.max("id").alias("id"))


def old_roots(sessions: DataFrame) -> DataFrame:
    """(chat_id, id): each chat's sessions without a parent but for the newest."""
    return sessions.filter("parent_session_id is null").select("chat_id", "id").join(latest_root(sessions), ["chat_id", "id"], "left_anti")


def children(sessions: DataFrame, parent: int) -> DataFrame:
    return sessions.filter(F.col("parent_session_id") == parent).orderBy("id")


def render_list(tasks: DataFrame) -> DataFrame:
    """(list_id, text): each list as lines `n. [status] goal`."""
    line = F.concat((F.col("order_index") + 1).cast("string"), F.lit(". ["), F.col("status"), F.lit("] "), F.col("goal"))
    rows = tasks.groupBy("list_id").agg(F.array_sort(F.collect_list(F.struct("order_index", "id", line.alias("line")))).alias("rows"))
    return rows.select("list_id", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("text"))


def migrated(lists: DataFrame, old: int, new: int) -> DataFrame:
    """Lists with those of one session moved to another."""
    return lists.withColumn("session_id", F.when(F.col("session_id") == old, F.lit(new)).otherwise(F.col("session_id")))


def without_chats(chats: DataFrame, sessions: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """chats (id), sessions (id, chat_id) and messages (session_id) without the chats in gone (id) and all that belongs to them."""
    ids = gone.select("id").distinct()
    lost = sessions.join(ids.withColumnRenamed("id", "chat_id"), "chat_id", "left_semi").select(F.col("id").alias("session_id"))
    return (
        chats.join(ids, "id", "left_anti").select(*chats.columns),
        sessions.join(ids.withColumnRenamed("id", "chat_id"), "chat_id", "left_anti").select(*sessions.columns),
        messages.join(lost, "session_id", "left_anti").select(*messages.columns),
    )


def session_info(sessions: DataFrame, chats: DataFrame) -> DataFrame:
    """(id, role, is_subagent): the role of each session's chat, and whether it has a parent."""
    return sessions.join(chats.select(F.col("id").alias("chat_id"), "role"), "chat_id", "left").select("id", "role", F.col("parent_session_id").isNotNull().alias("is_subagent"))


def files_of_chain(members: DataFrame, operations: DataFrame) -> DataFrame:
    """(start, file_path, operations): what the sessions of each chain (start, id) did to which files, each operation once, sorted and joined by commas.

    A session's operations on a file are a number with a bit for each kind, so that a chain's are its bits
    together, in a buffer of fixed size; with more than 62 kinds they are sets.
    """
    asked = members.select("start", F.col("id").alias("session_id"))
    done = operations.join(asked.select("session_id").distinct(), "session_id", "left_semi")
    kinds = [r[0] for r in done.filter("operation is not null").select("operation").distinct().orderBy("operation").limit(63).collect()]
    if len(kinds) > 62:
        each = keep(done.select("session_id", "file_path", "operation").distinct(), "asked")
        found = _by_start(asked).distinct().join(each, "session_id").groupBy("start", "file_path")
        return found.agg(F.array_join(F.array_sort(F.collect_set("operation")), ",").alias("operations"))
    bit = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, kind in enumerate(kinds) for x in (kind, 1 << k))), F.col("operation")) if kinds else F.lit(0), F.lit(0)).cast("long")
    each = keep(done.groupBy("session_id", "file_path").agg(F.bit_or(bit).alias("bits")), "asked")
    found = _by_start(asked).distinct().join(each, "session_id").groupBy("start", "file_path").agg(F.bit_or("bits").alias("bits"))
    told = [F.when(F.col("bits").bitwiseAND(F.lit(1 << k).cast("long")) != 0, F.lit(kind)) for k, kind in enumerate(kinds)]
    return found.select("start", "file_path", F.concat_ws(",", *told).alias("operations") if told else F.lit("").alias("operations"))


def latest_handover(handovers: DataFrame) -> DataFrame:
    """(session_id, id, new_session_id): the last handover of each session."""
    return handovers.groupBy("session_id").agg(F.max_by(F.struct("id", "new_session_id"), "id").alias("h")).select("session_id", "h.*")


def update_status(tasks: DataFrame, updates: DataFrame) -> DataFrame:
    """tasks (id, status) with the last status written for each (id, status, seq)."""
    last = updates.groupBy("id").agg(F.max_by("status", "seq").alias("_status"))
    return tasks.join(last, "id", "left").withColumn("status", F.coalesce("_status", "status")).drop("_status").select(*tasks.columns)
