"""Lookups, searches, audits and reports over a code index.

All functions take DataFrames of the shapes in strataforge.schemas and return lazy DataFrames. A
symbol's file comes from one join with files; rows whose file is missing are dropped by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataforge.storage import keep

#: Dependency kinds in the order of reports.
DEPENDENCY_KINDS = ("import", "function_call", "method_call", "class_reference", "variable_reference", "module_reference")


def like(column: Column | str, pattern: str) -> Column:
    """Case-insensitive containment in which % and _ of the pattern are wildcards and nothing escapes them."""
    return F.col(column).ilike("%" + pattern.replace("\\", "\\\\") + "%") if isinstance(column, str) else column.ilike("%" + pattern.replace("\\", "\\\\") + "%")


def with_path(symbols: DataFrame, files: DataFrame) -> DataFrame:
    return symbols.join(files.select(F.col("id").alias("file_id"), F.col("path").alias("file_path")), "file_id")


def clean_path(path: str) -> str:
    """Without one leading ./"""
    return path[2:] if path.startswith("./") else path


def files_by_language(files: DataFrame, language: str | None = None) -> DataFrame:
    return (files.filter(F.col("language") == language) if language else files).orderBy("path")


def file_by_path(files: DataFrame, path: str) -> DataFrame:
    return files.filter(F.col("path") == clean_path(path))


def by_id(symbols: DataFrame, symbol_id: int) -> DataFrame:
    return symbols.filter(F.col("id") == symbol_id)


def by_name(symbols: DataFrame, name: str, file_id: int | None = None) -> DataFrame:
    """All of that name, by id."""
    found = symbols.filter(F.col("name") == name)
    return (found.filter(F.col("file_id") == file_id) if file_id is not None else found).orderBy("id")


def search(symbols: DataFrame, pattern: str, file_id: int | None = None) -> DataFrame:
    found = symbols.filter(like("name", pattern))
    return (found.filter(F.col("file_id") == file_id) if file_id is not None else found).orderBy("name", "id")


def top_level(symbols: DataFrame, file_id: int | None = None) -> DataFrame:
    """Symbols without a parent, by name."""
    found = symbols.filter("parent_id is null")
    return (found.filter(F.col("file_id") == file_id) if file_id is not None else found).orderBy("name", "id")


def members(symbols: DataFrame, class_id: int) -> DataFrame:
    """Methods or variables of a class, by name."""
    return symbols.filter((F.col("parent_id") == class_id) & (F.col("parent_type") == "class")).orderBy("name", "id")


def nested_classes(classes: DataFrame, class_id: int) -> DataFrame:
    return classes.filter(F.col("parent_id") == class_id).orderBy("name", "id")


def n_lines() -> Column:
    return F.col("end_line") - F.col("start_line") + 1


def by_complexity(functions: DataFrame, min_branches: int | None = None, min_lines: int | None = None, max_branches: int | None = None, max_lines: int | None = None, match_any: bool = False, class_id: int | None = None, grouped: bool = False) -> DataFrame:
    """Functions (or a class's methods) within limits of branches and lines; the most branches first.

    With match_any the limits are alternatives. As executed by the original, the first alternative
    binds with the condition on the parent and the others stand alone; grouped binds them all.
    """
    limits = [
        (min_branches, F.col("branch_count") >= F.lit(min_branches)), (min_lines, n_lines() >= F.lit(min_lines)),
        (max_branches, F.col("branch_count") <= F.lit(max_branches)), (max_lines, n_lines() <= F.lit(max_lines)),
    ]
    tests = [test for given, test in limits if given is not None]
    scope = F.col("parent_id").isNull() if class_id is None else (F.col("parent_id") == class_id) & (F.col("parent_type") == "class")
    if not tests:
        where = scope
    elif not match_any:
        where = scope
        for test in tests:
            where = where & test
    elif grouped:
        either = tests[0]
        for test in tests[1:]:
            either = either | test
        where = scope & either
    else:
        where = scope & tests[0]
        for test in tests[1:]:
            where = where | test
    return functions.filter(where).orderBy(F.desc("branch_count"), "name", "id")


def statistics(files: DataFrame, functions: DataFrame, classes: DataFrame, variables: DataFrame, **others: DataFrame) -> DataFrame:
    """(metric, value): one count for each kind, each table read once."""
    counts = [
        files.agg(F.lit("files").alias("metric"), F.count("*").alias("value")),
        functions.agg(F.count_if(F.col("parent_id").isNull()).alias("functions"), F.count_if(F.col("parent_id").isNotNull()).alias("methods")).unpivot([], ["functions", "methods"], "metric", "value"),
        classes.agg(F.lit("classes").alias("metric"), F.count_if(F.col("parent_id").isNull()).alias("value")),
        variables.agg(F.lit("variables").alias("metric"), F.count_if(F.col("parent_id").isNull()).alias("value")),
        *(t.agg(F.lit(name).alias("metric"), F.count("*").alias("value")) for name, t in others.items()),
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def language_statistics(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "language")


def dependencies(deps: DataFrame, file_id: int | None = None, source: int | None = None, kind: str | None = None, external: bool | None = None) -> DataFrame:
    """Dependencies by file, source function, kind and whether they leave the tree; by kind and name."""
    for column, value in (("file_id", file_id), ("source_function_id", source), ("dependency_type", kind), ("is_external", external)):
        if value is not None:
            deps = deps.filter(F.col(column) == value)
    return deps.orderBy("dependency_type", "name", "id")


def dependencies_by_name(functions: DataFrame, deps: DataFrame, name: str) -> DataFrame:
    """Dependencies of the first function of that name."""
    first = functions.filter(F.col("name") == name).agg(F.min("id").alias("source_function_id"))
    return deps.join(first, "source_function_id", "left_semi")


def dependencies_grouped(deps: DataFrame, source: int) -> DataFrame:
    """(dependency_type, names): one row for each fixed kind, empty where there is none."""
    spark = deps.sparkSession
    kinds = spark.createDataFrame([(k,) for k in DEPENDENCY_KINDS], "dependency_type string")
    found = deps.filter(F.col("source_function_id") == source).groupBy("dependency_type").agg(F.array_sort(F.collect_list("name")).alias("names"))
    return kinds.join(found, "dependency_type", "left").select("dependency_type", F.coalesce("names", F.array().cast("array<string>")).alias("names"))


def blast_radius(deps: DataFrame, functions: DataFrame, classes: DataFrame, file_id: int) -> DataFrame:
    """file_id of each file with a dependency on a function or class of the given file."""
    in_file = lambda t, name: t.filter(F.col("file_id") == file_id).select(F.col("id").alias(name))
    calls = deps.join(in_file(functions, "target_function_id"), "target_function_id", "left_semi").select("file_id")
    refs = deps.join(in_file(classes, "target_class_id"), "target_class_id", "left_semi").select("file_id")
    return calls.union(refs).distinct()


def describe(symbols: DataFrame, descriptions: DataFrame, kind: str) -> DataFrame:
    """symbols with the latest description written for them, from an append-only table (kind, symbol_id, description, seq)."""
    latest = descriptions.filter(F.col("kind") == kind).groupBy("symbol_id").agg(F.max_by("description", "seq").alias("latest"))
    return symbols.join(latest, symbols.id == latest.symbol_id, "left").withColumn("description", F.coalesce("latest", "description")).drop("symbol_id", "latest")


def description_rows(symbols: DataFrame, kind: str, name: str, text: str, seq: int, file_id: int | None = None) -> DataFrame:
    """The rows to append so that all symbols of a name [and file] get a description."""
    found = by_name(symbols, name, file_id)
    return found.select(F.lit(kind).alias("kind"), F.col("id").alias("symbol_id"), F.lit(text).alias("description"), F.lit(seq).cast("long").alias("seq"))


def union_kinds(tables: dict[str, DataFrame]) -> DataFrame:
    """(kind_ord, kind, id, file_id, name, description) of several kinds."""
    parts = [t.select(F.lit(k).alias("kind_ord"), F.lit(kind).alias("kind"), "id", "file_id", "name", "description") for k, (kind, t) in enumerate(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def search_descriptions(tables: dict[str, DataFrame], query: str, limit: int = 50) -> DataFrame:
    """The first limit matches of each kind in turn, the first limit of these."""
    found = union_kinds(tables).filter(like("description", query))
    first = found.withColumn("n", F.row_number().over(Window.partitionBy("kind").orderBy("id"))).filter(F.col("n") <= limit)
    return first.orderBy("kind_ord", "id").limit(limit).drop("n", "kind_ord")


def undocumented(tables: dict[str, DataFrame]) -> DataFrame:
    """(kind, name, n): how many symbols of a name have no description, for each kind and name that has such."""
    return union_kinds(tables).filter(F.coalesce("description", F.lit("")) == "").groupBy("kind", "name").agg(F.count("*").alias("n"))


def search_symbols(tables: dict[str, DataFrame], query: str, limit: int = 10) -> DataFrame:
    """Ranked search: exact names (rank 0), names that contain the query (1), then descriptions that do (2).

    Of each rank and kind the first limit by id count; of these the first limit by rank and name.
    """
    rank = F.when(F.col("name") == query, 0).when(like("name", query), 1).when(like("description", query), 2)
    found = union_kinds(tables).withColumn("rank", rank).filter("rank is not null")
    bucket = F.row_number().over(Window.partitionBy("rank", "kind").orderBy("id"))
    return found.withColumn("n", bucket).filter(F.col("n") <= limit).orderBy("rank", "name", "kind_ord", "id").limit(limit).select("rank", "kind", "id", "name", "description")


def first_definition(symbols: DataFrame, prefer_methods: bool = False) -> DataFrame:
    """One symbol for each name: the one with the least id, of those in a class first if these are preferred."""
    order = F.struct((F.col("parent_type") != "class") | F.col("parent_type").isNull(), F.col("id")) if prefer_methods else F.struct("id")
    return symbols.groupBy("name").agg(F.min_by(F.struct("id", "file_id"), order).alias("d")).select("name", "d.id", "d.file_id")


def resolve(deps: DataFrame, functions: DataFrame, classes: DataFrame, variables: DataFrame) -> DataFrame:
    """Dependencies (id, name, dependency_type, file_id) with the symbol that their name means.

    Calls mean a function (method calls one in a class, by the name after the last dot), else a class;
    class references a class; variable references a variable. The same file comes first, then the least
    id. Adds target_kind, target_id and is_external (no target).
    """
    last = F.when(F.col("dependency_type") == "method_call", F.substring_index("name", ".", -1)).otherwise(F.col("name"))
    wanted = deps.withColumn("wanted", last)
    parts = [t.select(F.lit(kind).alias("target_kind"), F.lit(k).alias("kind_ord"), F.col("name").alias("wanted"), F.col("id").alias("target_id"), F.col("file_id").alias("target_file"), (F.col("parent_type") == "class" if kind == "function" else F.lit(False)).alias("in_class")) for k, (kind, t) in enumerate({"function": functions, "class": classes, "variable": variables}.items())]
    symbols = parts[0].unionByName(parts[1]).unionByName(parts[2])
    kind = F.col("dependency_type")
    # the least of each file and the least of all are enough, so that a common name makes no pairs
    best = symbols.groupBy("wanted", "target_kind", "kind_ord", "target_file").agg(F.min("target_id").alias("all_id"), F.min(F.when(F.coalesce("in_class", F.lit(False)), F.col("target_id"))).alias("class_id"))
    # written first, so that joins deal out the rows of a common name anew where they are too many
    best = keep(best, "names")
    any_file = best.groupBy("wanted", "target_kind", "kind_ord").agg(F.min("all_id").alias("all_id"), F.min("class_id").alias("class_id"))
    any_file = keep(any_file, "anywhere")
    near = wanted.join(best.withColumnRenamed("target_file", "file_id"), ["wanted", "file_id"]).withColumn("far", F.lit(0))
    anywhere = wanted.join(any_file, "wanted").withColumn("far", F.lit(1))
    fits = F.when(kind.isin("function_call", "method_call"), F.col("target_kind").isin("function", "class")).when(kind == "class_reference", F.col("target_kind") == "class").when(kind == "variable_reference", F.col("target_kind") == "variable").otherwise(False)
    target = F.when((kind == "method_call") & (F.col("target_kind") == "function"), F.col("class_id")).otherwise(F.col("all_id"))
    found = near.unionByName(anywhere).withColumn("target_id", target).filter(fits & F.col("target_id").isNotNull())
    one = found.groupBy("id").agg(F.min_by(F.struct("target_kind", "target_id"), F.struct("kind_ord", "far", "target_id")).alias("t"))
    return deps.join(one, "id", "left").select(*deps.columns, F.col("t.target_kind").alias("target_kind"), F.col("t.target_id").alias("target_id"), F.col("t").isNull().alias("unresolved"))


def call_functions(resolved: DataFrame, functions: DataFrame, init: str = "__init__") -> DataFrame:
    """Calls and class references (id, target_kind, target_id) with the function that runs: the target, or a class's init method of least id; null if there is none."""
    inits = functions.filter((F.col("name") == init) & (F.col("parent_type") == "class")).groupBy(F.col("parent_id").alias("target_id")).agg(F.min("id").alias("init_id"))
    calls = resolved.filter(F.col("dependency_type").isin("function_call", "method_call", "class_reference"))
    runs = F.when(F.col("target_kind") == "function", F.col("target_id")).when(F.col("target_kind") == "class", F.col("init_id"))
    return calls.join(inits, "target_id", "left").select("id", "dependency_type", runs.alias("function_id"))


def remove_files(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """An index's tables without the files in gone (file_id) and their symbols; dependencies of other files lose targets in them.

    tables has files, deps, functions and classes, and any other tables with file_id.
    """
    gone = gone.select("file_id").distinct()
    rest = {name: t.join(gone, "file_id", "left_anti").select(*t.columns) for name, t in tables.items() if name != "files"}
    rest["files"] = tables["files"].join(gone.withColumnRenamed("file_id", "id"), "id", "left_anti").select(*tables["files"].columns)
    for kind, target in (("functions", "target_function_id"), ("classes", "target_class_id")):
        lost = tables[kind].join(gone, "file_id", "left_semi").select(F.col("id").alias(target), F.lit(True).alias("_lost"))
        deps = rest["deps"]
        rest["deps"] = deps.join(lost, target, "left").withColumn(target, F.when(F.col("_lost").isNull(), F.col(target))).select(*deps.columns)
    return rest


#: Signs of an expression. A name with two of them or more is one.
_OPERATORS = ("+", "-", "*", "/", "=", "==", "!=", "<", ">", "<=", ">=")


def is_likely_literal(name: Column) -> Column:
    """Whether a dependency's name looks like a literal or an expression.

    Quotes, blanks, `.format(`, two percent signs beside an open bracket, or two of the operators make it
    one; signs in signs count each, so `==` is two.
    """
    has = lambda x: F.contains(name, F.lit(x))
    operators = F.size(F.filter(F.array(*map(F.lit, _OPERATORS)), lambda x: F.contains(name, x)))
    percents = F.length(name) - F.length(F.replace(name, F.lit("%"), F.lit("")))
    return has('"') | has("'") | has(" ") | has(".format(") | ((percents > 1) & has("(")) | (operators >= 2)


def format_parameters(parameters: Column) -> Column:
    """`a, b: T` from an array of (name, type)."""
    return F.array_join(F.transform(parameters, lambda p: F.concat(p["name"], F.coalesce(F.concat(F.lit(": "), p["type"]), F.lit("")))), ", ")


def source_lines(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end of a text, counted from 1, both included."""
    return F.array_join(F.slice(F.split(text, "\n"), start, F.greatest(end - start + 1, F.lit(0))), "\n")


#: What a line that is passed over in a search for code begins with, and what it is.
_PASSED_STARTS = ("#", "//", "/*", '"""', "'''", "@", "def ", "class ", "print(")
_PASSED = ("", "{", "}", "};")


def snippet(text: Column, start: Column) -> Column:
    """The first line of code in the 50 lines after start, trimmed and cut to 120 characters; '' if an empty line (not one of blanks) comes first.

    Blank lines, comments, strings in three quotes, decorators, definitions, lone braces and prints are passed over.
    """
    after = F.slice(F.split(text, "\n"), start + 1, F.lit(50))
    end = F.array_position(after, "")
    lines = F.transform(F.when(end > 0, F.slice(after, F.lit(1), (end - 1).cast("int"))).otherwise(after), lambda line: F.regexp_replace(line, "^\\s+|\\s+$", ""))
    passed = lambda line: line.isin(*_PASSED) | F.exists(F.array(*map(F.lit, _PASSED_STARTS)), lambda x: F.startswith(line, x))
    return F.left(F.coalesce(F.get(F.filter(lines, lambda line: ~passed(line)), F.lit(0)), F.lit("")), F.lit(120))


def nested(parents: DataFrame, children: dict[str, DataFrame], key: str) -> DataFrame:
    """parents (id) with, for each kind, the names of its children (rows with key = id) as a sorted array."""
    out = parents
    for name, table in children.items():
        lists = table.groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_list("name")).alias(name))
        out = out.join(lists, "id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out


def dependency_report(files: DataFrame, functions: DataFrame, variables: DataFrame, deps: DataFrame, classes: DataFrame) -> DataFrame:
    """(path, report): for each file its functions, variables, imports and classes as lines of text."""
    rows = [(0, "functions", functions.filter("parent_id is null")), (1, "variables", variables.filter("parent_id is null")), (2, "imports", deps.filter("dependency_type = 'import'")), (3, "classes", classes)]
    parts = [t.select("file_id", F.lit(k).alias("section"), F.lit(label).alias("label"), "name").distinct() for k, label, t in rows]
    lines = parts[0]
    for p in parts[1:]:
        lines = lines.unionByName(p)
    sections = lines.groupBy("file_id", "section", "label").agg(F.array_sort(F.collect_list("name")).alias("names"))
    text = sections.select("file_id", "section", F.concat("label", F.lit(":\n  - "), F.array_join("names", "\n  - ")).alias("text"))
    reports = text.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "text"))), lambda s: s["text"]), "\n").alias("report"))
    return files.select(F.col("id").alias("file_id"), "path").join(reports, "file_id").select("path", "report")


def find_location(functions: DataFrame, classes: DataFrame, name: str) -> DataFrame:
    """(kind, id, file_id, start_line, end_line): the function of that name, one in a class first, or else the class."""
    f = by_name(functions, name).select(F.lit(0).alias("o"), F.lit("function").alias("kind"), F.when(F.col("parent_type") == "class", 0).otherwise(1).alias("p"), "id", "file_id", "start_line", "end_line")
    c = by_name(classes, name).select(F.lit(1).alias("o"), F.lit("class").alias("kind"), F.lit(0).alias("p"), "id", "file_id", F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"))
    return f.unionByName(c).orderBy("o", "p", "id").limit(1).drop("o", "p")


def implementation(functions: DataFrame, classes: DataFrame, files: DataFrame, suggestions: DataFrame, name: str) -> DataFrame:
    """(kind, text): the source of a symbol, or the names of ranked suggestions if there is none of that name."""
    found = find_location(functions, classes, name)
    source = found.join(files.select(F.col("id").alias("file_id"), "content"), "file_id").select("kind", source_lines(F.col("content"), F.coalesce("start_line", F.lit(1)), F.coalesce("end_line", F.lit(1 << 20))).alias("text"))
    none = suggestions.agg(F.lit("suggestions").alias("kind"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("text"))
    return source.unionByName(none.join(found.select(F.lit(True).alias("there")), how="left_anti"))


def export_json(files: DataFrame, functions: DataFrame, classes: DataFrame, variables: DataFrame) -> DataFrame:
    """(path, document): one JSON document for each file, with its functions, classes with their methods and variables, and variables.

    Methods and variables whose class is missing are left out.
    """
    sorted_names = lambda t, key: t.groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_list("name")).alias("names"))
    methods = sorted_names(functions.filter("parent_type = 'class'"), "parent_id").withColumnRenamed("names", "methods")
    own = sorted_names(variables.filter("parent_type = 'class'"), "parent_id").withColumnRenamed("names", "own")
    empty = F.array().cast("array<string>")
    full = classes.join(methods, "id", "left").join(own, "id", "left").select("file_id", F.struct("name", F.coalesce("methods", empty).alias("methods"), F.coalesce("own", empty).alias("variables")).alias("c"))
    by_file = full.groupBy(F.col("file_id").alias("id")).agg(F.array_sort(F.collect_list("c")).alias("classes"))
    free = lambda t, name: sorted_names(t.filter("parent_id is null"), "file_id").withColumnRenamed("names", name)
    every = files.select("id", "path", "language").join(free(functions, "functions"), "id", "left").join(by_file, "id", "left").join(free(variables, "variables"), "id", "left")
    return every.select("path", F.to_json(F.struct("path", "language", F.coalesce("functions", empty).alias("functions"), F.coalesce("classes", F.array().cast("array<struct<name:string,methods:array<string>,variables:array<string>>>")).alias("classes"), F.coalesce("variables", empty).alias("variables"))).alias("document"))
