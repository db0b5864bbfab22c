"""Symbols of source text by what its lines look like: depths, declarations, what encloses what, and branches.

Nothing is parsed. A line's depth is the number of braces open before it, or its indent; a declaration goes
on to the line that closes its brace, or before the next line that isn't indented further. What encloses a
declaration is the innermost interval around it. Strings in quotes and comments of one line are taken off first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataforge.storage import keep

#: What declares a symbol at the beginning of a line, by kind; the first group is the name.
BRACED = (
    ("class", r"^(?:(?:public|private|protected|internal|static|abstract|final|export|sealed)\s+)*class\s+([A-Za-z_]\w*)"), ("struct", r"^(?:(?:pub|public|typedef)\s+)*struct\s+([A-Za-z_]\w*)"),
    ("interface", r"^(?:(?:pub|public|export)\s+)*(?:interface|trait)\s+([A-Za-z_]\w*)"), ("enum", r"^(?:(?:pub|public|export)\s+)*enum\s+([A-Za-z_]\w*)"),
    ("namespace", r"^(?:namespace|module|mod)\s+([A-Za-z_][\w.:]*)"), ("function", r"^(?:(?:pub|public|private|protected|static|async|export)\s+)*(?:fn|func|function|fun|def)\s+([A-Za-z_]\w*)"),
)
INDENTED = (("class", r"^class\s+([A-Za-z_]\w*)"), ("function", r"^(?:async\s+)?def\s+([A-Za-z_]\w*)"))
BRANCHES = r"(?:^|[^\w.])(?:if|for|while|switch|match|try|with|case|catch)(?![\w])"
#: Kinds that symbols are members of.
OWNERS = ("class", "struct", "interface", "enum", "namespace")
#: Strings are taken out of a line, then what follows these signs.
_STRINGS = r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'"
#: Lines that intervals are told apart by, so that a line meets only those that reach its part of the file.
PART = 64


def _bare(line: Column, comment: str) -> Column:
    return F.regexp_replace(F.regexp_replace(line, _STRINGS, "\"\""), comment + ".*$", "")


def lines(files: DataFrame, indented: bool) -> DataFrame:
    """(path, n, text, depth, after): the lines of files (path, content) that hold code, numbered from 1, with their depth and that of the next line.

    text is trimmed and without strings and comments.
    """
    each = files.select("path", F.posexplode(F.split("content", "\n")).alias("n", "line")).withColumn("n", F.col("n") + 1)
    bare = each.withColumn("bare", _bare(F.col("line"), "#" if indented else "//"))
    code = bare.filter(F.trim("bare") != "")
    order = Window.partitionBy("path").orderBy("n")
    if indented:
        depth = F.length("bare") - F.length(F.ltrim("bare"))
        return code.select("path", "n", F.trim("bare").alias("text"), depth.alias("depth")).withColumn("after", F.coalesce(F.lead("depth").over(order), F.lit(0)))
    net = lambda sign: F.length("bare") - F.length(F.replace("bare", F.lit(sign), F.lit("")))
    change = (net("{") - net("}")).cast("long")
    after = F.sum(change).over(order.rowsBetween(Window.unboundedPreceding, 0))
    told = code.withColumn("after", after).withColumn("depth", F.col("after") - change)
    return told.select("path", "n", F.trim("bare").alias("text"), "depth", "after")


def declarations(files: DataFrame, indented: bool) -> DataFrame:
    """(path, kind, name, depth, first, last): what files declare, with the lines from the first to the last of it.

    Each depth's lines are looked at from behind: the last line seen at the depth or above it ends what is open.
    """
    code = keep(lines(files, indented), "lines")
    kinds = INDENTED if indented else BRACED
    kind, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, pattern in reversed(kinds):
        kind = F.when(F.col("text").rlike(pattern), k).otherwise(kind)
        name = F.when(F.col("text").rlike(pattern), F.regexp_extract("text", pattern, 1)).otherwise(name)
    # the brace may stand on the next line
    below = F.coalesce(F.lead("text").over(Window.partitionBy("path").orderBy("n")).startswith("{"), F.lit(False))
    found = code.withColumns({"kind": kind, "name": name, "opens": (F.col("after") > F.col("depth")) | below}).filter("kind is not null").select("path", "kind", "name", "depth", F.col("n").alias("first"), "opens")
    # a line that brings the depth down to some level ends all that began at that level or deeper and is open
    down = code.select("path", "n", F.col("after" if not indented else "depth").alias("level"), F.lag("after" if not indented else "depth").over(Window.partitionBy("path").orderBy("n")).alias("was"))
    fell = F.col("level") <= F.col("was") if indented else F.col("level") < F.col("was")
    ends = down.filter(F.coalesce(fell, F.lit(True))).select("path", "n", "level", F.coalesce("was", F.col("level") + 1).alias("was"))
    closes = ends.select("path", F.col("n").alias("at"), F.explode(F.sequence("level", F.greatest(F.col("level"), F.col("was") - 1))).alias("depth"))
    total = code.groupBy("path").agg(F.max("n").alias("total"))
    both = found.select("path", "depth", F.col("first").alias("at"), "kind", "name", "first", "opens", F.lit(0).alias("closes")).unionByName(closes.select("path", "depth", "at", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("boolean").alias("opens"), F.lit(1).alias("closes")), allowMissingColumns=True)
    behind = Window.partitionBy("path", "depth").orderBy(F.desc("at"), "closes").rowsBetween(Window.unboundedPreceding, -1)
    until = F.last(F.when(F.col("closes") == 1, F.col("at")), ignorenulls=True).over(behind)
    told = both.withColumn("until", until).filter("closes = 0").join(total, "path")
    if indented:
        last_code = code.select("path", F.col("n").alias("line"), F.lead("n").over(Window.partitionBy("path").orderBy("n")).alias("until"))
        told = told.join(last_code, ["path", "until"], "left")
        last = F.greatest("first", F.coalesce("line", "total"))
    else:
        # what opens no brace on its line is over with it
        last = F.when(~F.col("opens"), F.col("first")).otherwise(F.coalesce("until", "total"))
    return told.select("path", "kind", "name", "depth", "first", last.alias("last"))


def nested(files: DataFrame, indented: bool) -> DataFrame:
    """(path, kind, name, first, last, owner, owner_kind, branches) for each declaration of files (path, content).

    owner is the innermost declaration around it, null if there is none; branches counts the lines inside it,
    inner declarations included, that begin or hold a branch.
    """
    found = keep(declarations(files, indented), "declarations")
    parts = found.withColumn("part", F.explode(F.sequence(F.floor(F.col("first") / PART), F.floor(F.col("last") / PART))))
    around = parts.select("path", "part", F.col("first").alias("from"), F.col("last").alias("to"), F.col("name").alias("owner"), F.col("kind").alias("owner_kind"))
    inner = found.withColumn("part", F.floor(F.col("first") / PART))
    pairs = inner.join(around, ["path", "part"]).filter((F.col("from") < F.col("first")) & (F.col("to") >= F.col("last")))
    owners = pairs.groupBy("path", "first", "kind").agg(F.max_by(F.struct("owner", "owner_kind"), "from").alias("o"))
    branch = lines(files, indented).filter(F.col("text").rlike(BRANCHES)).select("path", "n", F.floor(F.col("n") / PART).alias("part"))
    counts = parts.join(branch, ["path", "part"]).filter((F.col("n") >= F.col("first")) & (F.col("n") <= F.col("last"))).groupBy("path", "first", "kind").agg(F.count("*").alias("branches"))
    told = found.join(owners, ["path", "first", "kind"], "left").join(counts, ["path", "first", "kind"], "left")
    return told.select("path", "kind", "name", "first", "last", F.col("o.owner").alias("owner"), F.col("o.owner_kind").alias("owner_kind"), F.coalesce("branches", F.lit(0)).alias("branches"))
