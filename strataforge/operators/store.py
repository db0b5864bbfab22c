"""The session store's tables from a log of what was written to it, as of any moment.

A log row is (seq, op, entity, id, parent, fields): `create` makes a row of an entity below a parent, `update` sets
some of its fields, `delete` takes it away and with it all that hangs below. fields is a map of texts; what
isn't in it stays, what is null in it becomes null. Ids are never made twice. Whatever is written to a row
that isn't there does nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.operators.graph import chain_ends

LOG = "seq bigint, op string, entity string, id bigint, parent bigint, fields map<string,string>"
#: What the rows of each entity hang below, and what they say.
PARENTS = {"chats": None, "sessions": "chats", "messages": "sessions", "todo_lists": "sessions", "todo_tasks": "todo_lists", "session_files": "sessions", "handovers": "sessions", "changes": None, "skills": None}
FIELDS = {
    "chats": ("role", "title"), "sessions": ("parent_session_id", "redirect_session_id", "toolcall_id", "effort", "depth"), "messages": ("role", "content", "tool_calls", "tool_call_id"), "todo_lists": ("status",),
    "todo_tasks": ("goal", "requirements", "notes", "context", "status", "order_index", "toolcall_id", "cancel_reason"), "session_files": ("file_path", "operation"), "handovers": ("new_session_id", "handover_text", "token_usage", "context_window"),
    "changes": ("prompt_id", "role", "session_id", "change_type", "file_path", "description", "details"), "skills": ("role", "name", "content"),
}
#: Fields that aren't told when a row is made. A chat's title is its role then.
DEFAULTS = {"sessions": {"depth": "0"}, "todo_lists": {"status": "pending"}, "todo_tasks": {"status": "pending"}}
#: Rows of these are touched by rows of the second that are made below them, at any depth.
TOUCHED = {"sessions": ("messages",), "chats": ("messages",)}


def lives(log: DataFrame, entity: str) -> DataFrame:
    """(id, parent, made, until): from when to when each row of an entity is there; until is null for what still is.

    A row ends with its deletion or its parent's end. What is made below a row that isn't there is never there.
    """
    own = log.filter(F.col("entity") == entity)
    made = own.filter("op = 'create'").groupBy("id").agg(F.min(F.struct("seq", "parent")).alias("m")).select("id", "m.parent", F.col("m.seq").alias("made"))
    # a deletion before the row was made has deleted nothing
    gone = own.filter("op = 'delete'").select("id", "seq").join(made.select("id", "made"), "id").filter("seq > made").groupBy("id").agg(F.min("seq").alias("until"))
    rows = made.join(gone, "id", "left")
    if PARENTS[entity] is None:
        return rows.select("id", "parent", "made", "until")
    above = lives(log, PARENTS[entity]).select(F.col("id").alias("parent"), F.col("made").alias("_from"), F.col("until").alias("_to"))
    held = rows.join(above, "parent").filter((F.col("made") > F.col("_from")) & (F.col("_to").isNull() | (F.col("made") < F.col("_to"))))
    return held.select("id", "parent", "made", F.least("until", "_to").alias("until"))


def _until(log: DataFrame, moment: int | None) -> DataFrame:
    return log if moment is None else log.filter(F.col("seq") <= moment)


def _touches(log: DataFrame, entity: str) -> DataFrame | None:
    """(id, touched): when rows below an entity's were last made."""
    out = None
    for below in TOUCHED.get(entity, ()):
        made, up = lives(log, below).select(F.col("parent").alias("at"), F.col("made").alias("seq")), PARENTS[below]
        while up != entity:
            # a row's last touch is enough to go on with
            made = made.groupBy("at").agg(F.max("seq").alias("seq")).join(lives(log, up).select(F.col("id").alias("at"), "parent"), "at").select(F.col("parent").alias("at"), "seq")
            up = PARENTS[up]
        out = made if out is None else out.unionByName(made)
    return None if out is None else out.groupBy(F.col("at").alias("id")).agg(F.max("seq").alias("touched"))


def table(log: DataFrame, entity: str, moment: int | None = None) -> DataFrame:
    """(id, parent, FIELDS of the entity, created_at, updated_at) at a moment, times being seqs of the log."""
    log = _until(log, moment)
    rows = lives(log, entity).filter("until is null")
    own = log.filter((F.col("entity") == entity) & F.col("op").isin("create", "update"))
    written = own.join(rows.select("id", "made"), "id").filter(F.col("seq") >= F.col("made"))
    # the last text written to each field, null being one too
    said = written.select("id", "seq", F.explode("fields").alias("field", "value")).groupBy("id", "field").agg(F.max_by(F.struct("value"), "seq").alias("v"))
    there = lambda f: F.max(F.when(F.col("field") == f, F.struct(F.col("v.value").alias("value"), F.lit(True).alias("set"))))
    values = said.groupBy("id").agg(*(there(f).alias(f"_{f}") for f in FIELDS[entity]))
    last = written.groupBy("id").agg(F.max("seq").alias("last"))
    both = rows.join(values, "id", "left").join(last, "id", "left")
    touched = _touches(log, entity)
    both = both.withColumn("touched", F.lit(None).cast("bigint")) if touched is None else both.join(touched, "id", "left")
    default = DEFAULTS.get(entity, {})
    told = [F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}.value")).otherwise(F.lit(default.get(f)).cast("string")).alias(f) for f in FIELDS[entity]]
    out = both.select("id", "parent", *told, F.col("made").alias("created_at"), F.greatest("last", "touched").alias("updated_at"))
    return out.withColumn("title", F.coalesce("title", "role")) if entity == "chats" else out


def active_sessions(log: DataFrame, moment: int | None = None) -> DataFrame:
    """(chat_id, session_id): where the newest session without a parent of each chat leads along redirects."""
    sessions = table(log, "sessions", moment)
    newest = sessions.filter("parent_session_id is null").groupBy(F.col("parent").alias("chat_id")).agg(F.max("id").alias("id"))
    ends = chain_ends(sessions.select("id", F.expr("try_cast(redirect_session_id as bigint)").alias("next"))).select("id", F.col("last").alias("session_id"))
    return newest.join(ends, "id").select("chat_id", "session_id")


def dangling(messages: DataFrame) -> DataFrame:
    """(session_id, dangling): whether a session's last message (by id) leaves tool work open: a tool's answer, a user's with a call's id, or an assistant's with calls."""
    last = messages.groupBy(F.col("parent").alias("session_id")).agg(F.max_by(F.struct("role", "tool_calls", "tool_call_id"), "id").alias("m"))
    has = lambda c: F.coalesce(F.col(f"m.{c}"), F.lit("")) != ""
    open_ = (F.col("m.role") == "tool") | ((F.col("m.role") == "user") & has("tool_call_id")) | ((F.col("m.role") == "assistant") & has("tool_calls"))
    return last.select("session_id", F.coalesce(open_, F.lit(False)).alias("dangling"))


def unfinished_lists(lists: DataFrame, tasks: DataFrame) -> DataFrame:
    """(session_id, list_id) of each session's newest list that is pending, in progress or rejected, if it has a task that is pending or in progress."""
    newest = lists.filter(F.col("status").isin("pending", "in_progress", "rejected")).groupBy(F.col("parent").alias("session_id")).agg(F.max("id").alias("list_id"))
    waiting = tasks.filter(F.col("status").isin("pending", "in_progress")).select(F.col("parent").alias("list_id"))
    return newest.join(waiting, "list_id", "left_semi").select("session_id", "list_id")
