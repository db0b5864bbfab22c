"""Imports resolved against the scanned tree: which are internal, and which files they may mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.storage import keep

#: Namespaces that are external whatever the tree holds.
STANDARD = {"csharp": ("System", "Microsoft", "Newtonsoft", "Serilog"), "php": ("PHP", "Symfony", "Laravel", "Doctrine")}
#: What a path may end in beside itself.
ENDINGS = {"javascript": (".js", ".ts", ".tsx"), "typescript": (".js", ".ts", ".tsx"), "tsx": (".js", ".ts", ".tsx"), "java": (".java",), "kotlin": (".kt",), "elixir": (".ex",)}


def tree(files: DataFrame) -> DataFrame:
    """(place, is_dir): every path of files (path), and every folder above one."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    folders = files.filter(F.size(parts) > 1).select(F.explode(above).alias("place")).distinct().withColumn("is_dir", F.lit(True))
    return files.select(F.col("path").alias("place"), F.lit(False).alias("is_dir")).distinct().unionByName(folders)


def _begins(text: Column, *starts: str) -> Column:
    out = F.lit(False)
    for s in starts:
        out = out | text.startswith(s)
    return out


def _token(text: Column, n: int) -> Column:
    """The n-th word of a text, null if it has fewer."""
    return F.get(F.filter(F.split(text, "\\s+"), lambda w: w != ""), F.lit(n))


def _bare(text: Column, signs: str) -> Column:
    """text without these signs (of a class of a regular expression) at either end."""
    return F.regexp_replace(text, f"^[{signs}]+|[{signs}]+$", "")


def _quoted(text: Column) -> Column:
    """What stands between the first quotes, single ones first; null without any."""
    return F.when(F.contains(text, F.lit("'")), F.get(F.split(text, "'"), F.lit(1))).when(F.contains(text, F.lit('"')), F.get(F.split(text, '"'), F.lit(1)))


def _double_first(text: Column) -> Column:
    return F.when(F.contains(text, F.lit('"')), F.get(F.split(text, '"'), F.lit(1))).when(F.contains(text, F.lit("'")), F.get(F.split(text, "'"), F.lit(1)))


def module(language: Column, text: Column) -> Column:
    """The path or name that an import's text means, by its language; null where it names none."""
    statement = lambda word: F.when(text.startswith(word), F.regexp_replace(F.trim(F.substr(text, F.lit(len(word) + 1))), ";+$", ""))
    script = F.when(F.contains(text, F.lit("from ")), F.element_at(F.split(text, "from "), -1)).when(text.startswith("import "), F.substr(text, F.lit(8)))
    script = _bare(F.trim(F.regexp_replace(F.trim(script), ";+$", "")), "\"'`")
    included = F.when(_begins(text, "include ", "include_once ", "require ", "require_once "), _bare(_token(text, 1), "\"'();"))
    snake = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(text), "\\.+$", ""), "([a-z0-9])([A-Z])", "$1_$2"), "([A-Z]+)([A-Z][a-z])", "$1_$2"))
    dotted = F.when(text.startswith("import "), F.regexp_replace(_token(text, 1), ";+$", ""))
    return (
        F.when(language == "python", F.get(F.split(_token(text, 1), "\\."), F.lit(0)))
        .when(language == "go", F.when(text.startswith('"'), _bare(text, '"')).otherwise(text))
        .when(language.isin("javascript", "typescript", "tsx"), script)
        .when(language == "csharp", statement("using "))
        .when(language == "php", F.coalesce(included, statement("use ")))
        .when(language == "dart", F.when(text.startswith("import "), _quoted(text)))
        .when(language == "java", F.replace(dotted, F.lit("."), F.lit("/")))
        .when(language == "kotlin", F.when(text.startswith("import "), F.replace(_token(text, 1), F.lit("."), F.lit("/"))))
        .when(language == "zig", F.when(F.contains(text, F.lit("@import")), _double_first(text)))
        .when(language == "elixir", F.when(snake != "", F.concat(F.lit("lib/"), F.replace(snake, F.lit("."), F.lit("/")))))
    )


def by_form(language: Column, text: Column, name: Column) -> Column:
    """Whether an import is external by its form alone; null where the tree has to tell. name: module()'s."""
    relative = _begins(name, "./", "../")
    std = lambda lang: _begins(name, *STANDARD[lang])
    inner = lambda inside: F.when(inside, False)
    scripts = F.when(relative, False).when(_begins(name, ".", "@"), True)
    return (
        F.when(language == "rust", ~(F.contains(text, F.lit("crate::")) | _begins(text, "super::", "self::")))
        .when(language.isin("c", "cpp"), ~text.startswith('#include "'))
        .when(name.isNull() | (name == ""), True)
        .when(language == "go", inner(name.startswith(".")))
        .when(language.isin("javascript", "typescript", "tsx"), scripts)
        .when(language == "csharp", F.when(std("csharp"), True))
        .when(language == "php", F.when(text.startswith("use "), F.when(std("php"), True)).otherwise(inner(relative)))
        .when(language == "dart", F.when(_begins(name, "dart:", "package:"), True).when(relative | name.startswith("/"), False))
        .when(language == "zig", F.when(_begins(name, "std", "builtin", "root"), True))
        .when(language.isin("python", "java", "kotlin", "elixir"), F.lit(None).cast("boolean"))
        .otherwise(True)
    )


def candidates(language: Column, text: Column, name: Column) -> Column:
    """The places in the tree that would make an import internal."""
    place = F.when(language == "go", F.element_at(F.split(name, "/"), -1)).when(language == "csharp", F.replace(name, F.lit("."), F.lit("/"))).when((language == "php") & text.startswith("use "), F.replace(name, F.lit("\\"), F.lit("/"))).otherwise(name)
    ends = F.array(F.lit(""))
    for lang, more in ENDINGS.items():
        ends = F.when(language == lang, F.array(F.lit(""), *map(F.lit, more))).otherwise(ends)
    return F.transform(ends, lambda e: F.concat(place, e))


def resolved(imports: DataFrame, places: DataFrame) -> DataFrame:
    """imports (id, language, name) with external and places: whether each is external, and which of the tree's places it means.

    places is tree()'s. Some imports tell by their form; the others are internal if one of their candidates is
    there. A Python module has to be a folder: a lone file beside the root isn't taken for one.
    """
    name = module(F.col("language"), F.col("name"))
    told = imports.withColumn("_module", name)
    told = told.withColumns({"_form": by_form(F.col("language"), F.col("name"), F.col("_module")), "_candidates": candidates(F.col("language"), F.col("name"), F.col("_module"))})
    told = keep(told, "imports")
    # candidates once each, however many imports have them
    asked = told.filter("_form is null").select("language", F.explode("_candidates").alias("place")).distinct()
    there = asked.join(places, "place").filter((F.col("language") != "python") | F.col("is_dir")).select(F.col("language").alias("_lang"), "place").distinct()
    # written first, so that joins deal out what a common place is asked for by
    there = keep(there, "places")
    hits = told.filter("_form is null").select("id", "language", F.explode("_candidates").alias("asked")).join(there, (F.col("language") == F.col("_lang")) & (F.col("asked") == F.col("place"))).select("id", "place")
    found = hits.groupBy("id").agg(F.array_sort(F.collect_set("place")).alias("places"))
    out = told.join(found, "id", "left")
    return out.select(*imports.columns, F.coalesce("_form", F.col("places").isNull()).alias("external"), F.coalesce("places", F.array().cast("array<string>")).alias("places"))
