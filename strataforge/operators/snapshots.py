"""Content-addressed snapshots: ids, status, diff and log."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataforge.storage import keep

#: Lines of a diff shown of one file, and paths of a status shown of one category.
MOST_LINES, MOST_PATHS = 500, 50


def blob_id(content: Column) -> Column:
    """The id of a file's bytes: SHA-1 over a header with their number, and them."""
    data = content.cast("binary")
    return F.sha1(F.concat(F.concat(F.lit("blob "), F.octet_length(data).cast("string")).cast("binary"), F.unhex(F.lit("00")), data))


def status(working: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(path, status) of (path, blob_id) tables: added, modified, deleted or unchanged."""
    w, s = working.select("path", F.col("blob_id").alias("new")), snapshot.select("path", F.col("blob_id").alias("old"))
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") == F.col("new"), "unchanged").otherwise("modified")
    return w.join(s, "path", "full_outer").select("path", state.alias("status"))


def status_capped(found: DataFrame, most: int = MOST_PATHS, parts: int = 64) -> DataFrame:
    """(status, paths, more): the first paths of each category and how many more there are.

    Categories are few and may hold any number of paths, so the first ones of each part are found before those of all.
    """
    ranked = lambda t, *by: t.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("path"))).filter(F.col("n") <= most)
    first = ranked(ranked(found.withColumn("part", F.pmod(F.xxhash64("path"), F.lit(parts))), "status", "part"), "status")
    paths = first.groupBy("status").agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("paths"))
    counts = found.groupBy("status").agg(F.greatest(F.count("*") - most, F.lit(0)).alias("more"))
    return paths.join(counts, "status")


def truncated(lines: Column, most: int = MOST_LINES) -> Column:
    """An array of lines cut in the middle: the first and last half of most, with a mark between."""
    half = most // 2
    mark = F.concat(F.lit("... ("), (F.size(lines) - 2 * half).cast("string"), F.lit(" lines truncated) ..."))
    head, tail = F.slice(lines, 1, half), F.slice(lines, F.size(lines) - half + 1, half) if half else F.array().cast("array<string>")
    return F.when(F.size(lines) <= most, lines).otherwise(F.concat(head, F.array(mark), tail))


def diff(old: DataFrame, new: DataFrame, most: int = MOST_LINES, contains: str = "") -> DataFrame:
    """(path, change_type, content) of (path, content) tables: unified diffs of modified files, the whole of added and deleted ones, each cut to most lines.

    content may be text or bytes; what isn't UTF-8 is told by its size only. Equal files are left out, and
    paths that don't hold contains. Only modified texts go through Python.
    """
    side = lambda t, name: t.filter(F.contains("path", F.lit(contains))).select("path", F.col("content").cast("binary").alias(name))
    both = side(old, "old").join(side(new, "new"), "path", "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")))
    text = lambda c: F.col(c).cast("string")
    size = lambda c: F.octet_length(c).cast("string")
    cut = lambda whole: F.array_join(truncated(F.split(whole, "\n"), most), "\n")
    alone = F.coalesce("new", "old")
    one = both.filter(F.col("old").isNull() | F.col("new").isNull()).select(
        "path", F.when(F.col("old").isNull(), "added").otherwise("deleted").alias("change_type"),
        F.when(F.is_valid_utf8(alone.cast("string")), cut(alone.cast("string"))).otherwise(F.concat(F.lit("[binary file, "), F.octet_length(alone).cast("string"), F.lit(" bytes]"))).alias("content"),
    )
    changed = both.filter(F.col("old").isNotNull() & F.col("new").isNotNull())
    plain = F.is_valid_utf8(text("old")) & F.is_valid_utf8(text("new"))
    binary = changed.filter(~plain).select("path", F.lit("modified").alias("change_type"), F.concat(F.lit("[binary file, old: "), size("old"), F.lit(" bytes, new: "), size("new"), F.lit(" bytes]")).alias("content"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = ["\n".join(difflib.unified_diff(a.splitlines(), b.splitlines(), f"a/{path}", f"b/{path}", lineterm="")) for path, a, b in zip(batch["path"], batch["old"], batch["new"])]
            yield pd.DataFrame({"path": batch["path"], "text": texts})

    told = changed.filter(plain).select("path", text("old").alias("old"), text("new").alias("new")).mapInPandas(run, "path string, text string")
    return one.unionByName(binary).unionByName(told.select("path", F.lit("modified").alias("change_type"), cut(F.col("text")).alias("content")))


def tree_ids(files: DataFrame) -> DataFrame:
    """(directory, tree_id) of files (path, blob_id): the id of each directory's tree, '' being the root's, bottom up.

    A tree lists its files and directories by name (a directory's as if it ended in a slash), each with its mode,
    its name and its id; its own id is the SHA-1 of a header with the list's length, and the list.
    """
    parts = F.split("path", "/")
    entries = files.select(F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("directory"), F.element_at(parts, -1).alias("name"), F.lit("100644").alias("mode"), F.col("blob_id").alias("id"), (F.size(parts) - 1).alias("depth"))
    deepest = entries.agg(F.max("depth")).first()[0]
    out = None
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        here = entries.filter(F.col("depth") == depth)
        line = F.concat(F.hex(F.concat_ws(" ", "mode", "name").cast("binary")), F.lit("00"), F.upper("id"))
        name = F.concat("name", F.when(F.col("mode") == "40000", "/").otherwise(""))
        body = F.unhex(F.array_join(F.array_sort(F.collect_list(F.struct(name.alias("by"), line.alias("line"))))["line"], ""))
        header = lambda b: F.concat(F.concat(F.lit("tree "), F.octet_length(b).cast("string")).cast("binary"), F.unhex(F.lit("00")))
        trees = here.groupBy("directory").agg(body.alias("body")).select("directory", F.sha1(F.concat(header(F.col("body")), "body")).alias("tree_id"))
        # read by the level above and by the result
        trees = keep(trees, "trees")
        out = trees if out is None else out.unionByName(trees)
        up = F.split("directory", "/")
        entries = entries.unionByName(trees.filter("directory != ''").select(F.array_join(F.slice(up, 1, F.size(up) - 1), "/").alias("directory"), F.element_at(up, -1).alias("name"), F.lit("40000").alias("mode"), F.col("tree_id").alias("id"), (F.size(up) - 1).alias("depth")))
    return out if out is not None else files.select(F.lit("").alias("directory"), F.lit("").alias("tree_id")).limit(0)


def restore(snapshot: DataFrame, blobs: DataFrame) -> DataFrame:
    """(path, content) of a snapshot (path, blob_id), from the store (blob_id, content); blobs that the store lacks are left out."""
    return snapshot.join(blobs.select("blob_id", "content"), "blob_id").select("path", "content")


def redone(heads: DataFrame, undone: DataFrame) -> DataFrame:
    """(id, head, rest): each head moved to the last commit of its stack of undone ones, and what is left of the stack; a head without one stays.

    undone: id, stack (an array of commits, the last undone last).
    """
    stack = F.coalesce("stack", F.array().cast("array<bigint>"))
    return heads.join(undone, "id", "left").select("id", F.coalesce(F.try_element_at(stack, F.lit(-1)), "head").alias("head"), F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0))).alias("rest"))


def replayed(operations: DataFrame) -> DataFrame:
    """operations (repo, seq, kind) with done, depth and undone: whether each did something, and how many commits are in the log and on the redo stack after it.

    `commit` adds one and clears the stack; `undo` takes the head off the log onto the stack, unless it is the
    first; `redo` puts the stack's top back, if there is one; other kinds do nothing. What an operation does
    depends on all before it, so a repository's are read in order by one task, which remembers two numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repo, depth, undone = None, 0, 0
        for batch in batches:
            done, depths, stacks = [], [], []
            for own, kind in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if own != repo:
                    repo, depth, undone = own, 0, 0
                did = kind == "commit" or kind == "undo" and depth > 1 or kind == "redo" and undone > 0
                if did:
                    depth, undone = depth + (-1 if kind == "undo" else 1), 0 if kind == "commit" else undone + (1 if kind == "undo" else -1)
                done.append(did)
                depths.append(depth)
                stacks.append(undone)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(done, pa.bool_()), pa.array(depths, pa.int64()), pa.array(stacks, pa.int64())], names=[*batch.schema.names, "done", "depth", "undone"])

    ordered = operations.select("repo", "seq", "kind").repartition("repo").sortWithinPartitions("repo", "seq")
    return ordered.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema.fields) + ", done boolean, depth long, undone long")


def heads(operations: DataFrame) -> DataFrame:
    """operations (repo, seq, kind) with done, depth, undone and head: the commit (its seq) that is the head after each, null before the first.

    The head at some depth is the last commit made at that depth, so one window over each depth finds it.
    """
    level = Window.partitionBy("repo", "depth").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return replayed(operations).withColumn("head", F.last(F.when(F.col("kind") == "commit", F.col("seq")), ignorenulls=True).over(level))


def lineage(operations: DataFrame) -> DataFrame:
    """(repo, position, commit, undone): each repository's log after all operations, from 1, and behind its head the commits that redo would bring back, next first."""
    after = keep(replayed(operations), "replayed")
    last = after.groupBy("repo").agg(F.max_by(F.struct("depth", "undone"), "seq").alias("l")).select("repo", F.col("l.depth").alias("end"), F.col("l.undone").alias("stack"))
    made = after.filter("kind = 'commit'").groupBy("repo", F.col("depth").alias("position")).agg(F.max("seq").alias("commit"))
    return made.join(last, "repo").filter(F.col("position") <= F.col("end") + F.col("stack")).select("repo", "position", "commit", (F.col("position") > F.col("end")).alias("undone"))


def directories(files: DataFrame) -> DataFrame:
    """(directory, n_files): files below each directory of their paths, at any depth."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return files.filter(F.size(parts) > 1).select(F.explode(above).alias("directory")).groupBy("directory").agg(F.count("*").alias("n_files"))


def new_blobs(files: DataFrame, blobs: DataFrame) -> DataFrame:
    """(blob_id, content) of files (path, content) that the store doesn't have yet."""
    return files.select(blob_id(F.col("content")).alias("blob_id"), "content").dropDuplicates(["blob_id"]).join(blobs.select("blob_id"), "blob_id", "left_anti")


def moved_head(commits: DataFrame, heads: DataFrame) -> DataFrame:
    """(id, head): each head moved to its parent, as undo does; a head without a parent stays. Redo is the head before."""
    parents = commits.select(F.col("id").alias("head"), "parent")
    return heads.join(parents, "head", "left").select("id", F.coalesce("parent", "head").alias("head"))
