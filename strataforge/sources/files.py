"""Source trees as tables: scan, ignore rules, languages, change detection."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.schemas import LANGUAGES


def ignore_patterns(root: str) -> list[tuple[bool, str]]:
    """(negated, regular expression) of the rules of .aiignore, or else of .gitignore, below root; one small file, read on the driver."""
    for name in (".aiignore", ".gitignore"):
        path = Path(root) / name
        if path.is_file():
            return [compile_rule(line) for line in path.read_text().splitlines() if line.strip() and not line.startswith("#")]
    return []


def compile_rule(rule: str) -> tuple[bool, str]:
    """One ignore rule as a regular expression over relative paths."""
    negated, rule = rule.startswith("!"), rule.strip().lstrip("!")
    folder, anchored = rule.endswith("/"), "/" in rule.rstrip("/")
    parts = []
    for piece in re.split(r"(\*\*/|/\*\*|\*\*|\*|\?)", rule.strip("/")):
        parts.append({"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(piece, re.escape(piece)))
    return negated, ("^" if anchored else "(?:^|/)") + "".join(parts) + ("/" if folder else "(?:/|$)")


def ignored(path: Column, rules: list[tuple[bool, str]]) -> Column:
    """Whether the last rule that matches a path drops it."""
    out = F.lit(False)
    for negated, pattern in rules:
        out = F.when(path.rlike(pattern), not negated).otherwise(out)
    return out


def language(path: Column) -> Column:
    """A file's language by its extension; null if it is none's."""
    first = {e: name for name, ends in reversed(LANGUAGES) for e in ends.split()}
    ends = F.create_map(*(F.lit(x) for pair in first.items() for x in pair))
    return F.element_at(ends, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)))


def scan(spark: SparkSession, root: str, rules: list[tuple[bool, str]] | None = None) -> DataFrame:
    """(path, content, mtime, language) of the source files below root; files under test or tests folders and ignored ones are left out."""
    base = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.regexp_replace("path", f"^(?:file:)?/*{re.escape(str(root).removeprefix('file:').strip('/'))}/+", "")
    found = base.select(name.alias("path"), F.col("content"), F.col("modificationTime").alias("mtime")).withColumn("language", language(F.col("path")))
    return found.filter(F.col("language").isNotNull() & ~F.col("path").rlike("(?:^|/)tests?/") & ~ignored(F.col("path"), rules if rules is not None else ignore_patterns(str(root).removeprefix("file:"))))


def with_hash(files: DataFrame) -> DataFrame:
    return files.withColumn("content_hash", F.sha1("content"))


def changes(scanned: DataFrame, known: DataFrame) -> DataFrame:
    """(path, change) of (path, mtime, content_hash) tables: new, changed, touched (same bytes), same or deleted."""
    s = scanned.select("path", F.col("mtime").alias("m"), F.col("content_hash").alias("h"), F.lit(True).alias("here"))
    k = known.select("path", F.col("mtime").alias("m0"), F.col("content_hash").alias("h0"), F.lit(True).alias("there"))
    change = F.when(F.col("there").isNull(), "new").when(F.col("here").isNull(), "deleted").when(F.col("m") == F.col("m0"), "same").when(F.col("h") == F.col("h0"), "touched").otherwise("changed")
    return s.join(k, "path", "full_outer").select("path", change.alias("change"))
