"""Reports on files as text: rows with a place in the report, joined at the end."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataforge.operators.symbols import format_parameters, is_likely_literal, source_lines
from strataforge.storage import keep

#: What a report calls a kind of dependency, and what stands behind its name.
KINDS = (("function_call", "function", "()"), ("method_call", "method", "()"), ("class_reference", "class", ""), ("variable_reference", "variable", ""))

#: Bytes of text over which a file's report is long, and for how many cores one task makes long ones: it has a report several times at once where it is written.
LONG, CORES = 32_000_000, 4


def _note(value: Column | str, label: str = "") -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"  # {label}"), value)).otherwise("")


def _first(table: DataFrame, files: DataFrame) -> DataFrame:
    """(wanted, path): the file of the symbol of least id for each name."""
    best = table.groupBy(F.col("name").alias("wanted")).agg(F.min_by("file_id", "id").alias("file_id"))
    return best.join(files.select(F.col("id").alias("file_id"), "path"), "file_id").select("wanted", "path")


def told_dependencies(deps: DataFrame, functions: DataFrame, classes: DataFrame, variables: DataFrame, files: DataFrame) -> DataFrame:
    """(function_id, place, text): what each function depends on, once for each kind and name, by kind and then name; what looks like a literal or isn't defined is left out."""
    places = {kind: k for k, (kind, _, _) in enumerate(KINDS)}
    wanted = F.when(F.col("dependency_type") == "method_call", F.substring_index("name", ".", -1)).otherwise(F.col("name"))
    asked = deps.filter(F.col("dependency_type").isin(*places) & F.col("source_function_id").isNotNull() & ~is_likely_literal(F.col("name")))
    asked = asked.select(F.col("source_function_id").alias("function_id"), "dependency_type", "name", wanted.alias("wanted")).distinct()
    tables = {"function_call": functions, "method_call": functions.filter("parent_type = 'class'"), "class_reference": classes, "variable_reference": variables}
    known = reduce(DataFrame.unionByName, [_first(t, files).withColumn("dependency_type", F.lit(kind)) for kind, t in tables.items()])
    # written first, so that joins deal out what asks for a common name anew
    found = asked.join(keep(known, "known"), ["dependency_type", "wanted"])
    texts = [F.concat(F.lit(f"- {label} "), "name", F.lit(f'{suffix} in file "'), "path", F.lit('"')) for _, label, suffix in KINDS]
    pick = lambda values: reduce(lambda out, pair: F.when(F.col("dependency_type") == pair[0], pair[1]).otherwise(out), zip(places, values), F.lit(None))
    return found.select("function_id", pick(F.lit(k) for k in places.values()).cast("int").alias("kind"), "name", pick(texts).alias("text"))


def dependency_graphs(files: DataFrame, functions: DataFrame, classes: DataFrame, variables: DataFrame, deps: DataFrame, namespaces: DataFrame) -> DataFrame:
    """(file_id, path, report) for each file: its functions with what they depend on and the classes in them, variables, imports, namespaces, and classes with their members.

    functions need id, file_id, name, parent_id, parent_type, parameters and description; classes id, file_id,
    name, parent_id, namespace and description; variables id, file_id, name, parent_id, parent_type, field_type
    and description.
    """
    return _reports(_lines(files, functions, classes, variables, deps, namespaces))


def explored(files: DataFrame, functions: DataFrame, classes: DataFrame, variables: DataFrame, deps: DataFrame, namespaces: DataFrame) -> DataFrame:
    """structures() of dependency_graphs(), but the sources are lines of the reports, which so are made once and not moved."""
    content = files.select(F.col("id").alias("file_id"), "content")
    place = lambda section, *more: F.array(F.struct(F.lit(section).alias("section"), F.lit("").alias("name"), F.lit("").alias("id")), *more)
    found = []
    for section, table, title in ((7, functions, "Function"), (8, classes, "Class")):
        # ids that are numbers in the order of numbers
        ident = F.lpad((F.col("id").cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")).cast("string"), 21, "0") if dict(table.dtypes)["id"] != "string" else F.col("id")
        own = F.struct(F.lit(0).alias("section"), F.col("name"), ident.alias("id"))
        rows = table.filter("parent_id is null").join(content, "file_id").select("file_id", place(section, own).alias("place"), F.concat(F.lit("### "), _body()).alias("text"))
        found += [rows, rows.select("file_id").distinct().select("file_id", place(section).alias("place"), F.lit(f"## {title} Bodies").alias("text"))]
    blank = found[1].unionByName(found[3]).select("file_id").distinct().select("file_id", place(6).alias("place"), F.lit("").alias("text"))
    bodies = reduce(DataFrame.unionByName, [blank, *found])
    return _reports(_lines(files, functions, classes, variables, deps, namespaces).unionByName(bodies, allowMissingColumns=True))


def _body() -> Column:
    """A symbol's name, description and source."""
    body = source_lines(F.col("content"), F.col("start_line"), F.col("end_line"))
    described = F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit("# Description: "), "description", F.lit("\n\n"))).otherwise("")
    return F.concat("name", F.lit("\n"), described, body)


def _reports(lines: DataFrame) -> DataFrame:
    """(file_id, path, report): lines (file_id, of, place, text) joined by place. of has the path and stands in one line of each file.

    Lines are written first, so that it is known which reports are long. These are made apart, one after the
    other in few tasks: beside many others, Spark would sort their texts by file, each in one piece.
    """
    lines = keep(lines, "lines")
    sizes = lines.groupBy("file_id").agg(F.sum(F.octet_length("text")).alias("size"))
    long = F.broadcast(keep(sizes.filter(F.col("size") > LONG).select("file_id"), "long"))
    # concat_ws knows a text's length before it makes it; nothing stands behind, so that a report is in one row only
    text = F.concat_ws("\n", F.sort_array(F.collect_list(F.struct("place", "text"))).getField("text"))
    made = lambda t: t.groupBy("file_id").agg(F.max("of").getField("path").alias("path"), text.alias("report"))
    few = max(1, lines.sparkSession.sparkContext.defaultParallelism // CORES)
    return made(lines.join(long, "file_id", "left_semi")).coalesce(few).unionByName(made(lines.join(long, "file_id", "left_anti")))


def _lines(files: DataFrame, functions: DataFrame, classes: DataFrame, variables: DataFrame, deps: DataFrame, namespaces: DataFrame) -> DataFrame:
    """(file_id, of, place, text) of dependency_graphs().

    A line's place is an array of names and ids from the top down; a file's lines are joined in that order. All
    that one function depends on is joined to one text first, so that a file's lines are no more than its symbols.
    """
    deps = keep(deps.select("file_id", "id", "dependency_type", "name", "source_function_id"), "deps")
    told = told_dependencies(deps, functions, classes, variables, files)
    told = keep(told.groupBy(F.col("function_id").alias("owner")).agg(F.array_sort(F.collect_list(F.struct("kind", "name", "text"))).getField("text").alias("texts")), "dependencies")
    path = files.select(F.col("id").alias("file_id"), "path")
    part = lambda n, name, ident: F.struct(F.lit(n).alias("section"), name.alias("name"), ident.cast("string").alias("id"))
    row = lambda t, place, text: t.select("file_id", place.alias("place"), text.alias("text"))
    name, ident, nothing = F.col("name"), F.col("id"), F.lit("")
    top = lambda n: F.array(part(n, name, ident))
    inside = F.concat(F.lit(' in file "'), "path", F.lit('"'))
    call = F.concat(name, F.lit("("), format_parameters(F.col("parameters")), F.lit(")"))
    kind = lambda t: F.when(F.coalesce(t, F.lit("")) != "", F.concat(F.lit(" : "), t)).otherwise("")

    def depending(owners: DataFrame, indent: str) -> DataFrame:
        """What owners (file_id, owner, place) depend on, in lines of one text."""
        texts = F.transform(F.coalesce("texts", F.array(F.lit("NONE"))), lambda text: F.concat(F.lit(f"{indent}  "), F.coalesce(text, F.lit("NONE"))))
        return row(owners.join(told, "owner", "left"), F.concat("place", F.array(part(0, nothing, nothing))), F.concat(F.lit(f"{indent}depending on:\n"), F.array_join(texts, "\n")))

    def members(owners: DataFrame, indent: str) -> list[DataFrame]:
        """Lines of the members of classes (file_id, owner, place)."""
        own = owners.select("file_id", "owner", "place")
        methods = functions.filter("parent_type = 'class'").select(F.col("parent_id").alias("owner"), "id", "name", "parameters", "description")
        fields = variables.filter("parent_type = 'class'").select(F.col("parent_id").alias("owner"), "id", "name", "field_type", "description")
        mine = own.join(methods, "owner").withColumn("place", F.concat("place", F.array(part(1, name, ident))))
        lines = [row(mine, F.col("place"), F.concat(F.lit(f"{indent}- method "), call, _note("description"), F.lit(":")))]
        lines.append(depending(mine.select("file_id", F.col("id").alias("owner"), "place"), indent + "     "))
        lines.append(row(own.join(fields, "owner"), F.concat("place", F.array(part(2, name, ident))), F.concat(F.lit(f"{indent}- variable "), name, kind(F.col("field_type")), _note("description"))))
        some = methods.select("owner").union(fields.select("owner")).distinct()
        lines.append(row(own.join(some, "owner", "left_anti"), F.concat("place", F.array(part(1, nothing, nothing))), F.lit(f"{indent}  NONE")))
        return lines

    lines = []
    free = functions.filter("parent_id is null").join(path, "file_id")
    lines.append(row(free, top(1), F.concat(F.lit("  - function "), call, inside, _note("description"))))
    owners = free.select("file_id", "id", top(1).alias("place"))
    lines.append(depending(owners.withColumnRenamed("id", "owner"), "     "))
    # classes whose parent is a function of the same file
    nested = classes.select(F.col("parent_id").alias("of"), "file_id", F.col("id").alias("owner"), "name", "description").join(owners.withColumnRenamed("id", "of"), ["of", "file_id"])
    lines.append(row(nested.select("file_id", "place").distinct(), F.concat("place", F.array(part(2, nothing, nothing))), F.lit("     contains:")))
    nested = nested.withColumn("place", F.concat("place", F.array(part(3, name, F.col("owner")))))
    lines.append(row(nested, F.col("place"), F.concat(F.lit("       - class "), name, _note("description"), F.lit(":"))))
    lines.append(row(nested, F.concat("place", F.array(part(0, nothing, nothing))), F.lit("           members:")))
    lines += members(nested, "             ")
    once = Window.partitionBy("file_id", "name").orderBy("id")
    single = variables.filter("parent_id is null").withColumn("_n", F.row_number().over(once)).filter("_n = 1").join(path, "file_id")
    lines.append(row(single, top(2), F.concat(F.lit("  - variable "), name, kind(F.col("field_type")), inside, _note("description"))))
    lines.append(row(deps.filter("dependency_type = 'import'").join(path, "file_id"), top(3), F.concat(F.lit("  - imported "), name, inside)))
    lines.append(row(namespaces.join(path, "file_id"), top(4), F.concat(F.lit("  - namespace "), name, inside)))
    outer = classes.filter("parent_id is null").join(path, "file_id")
    lines.append(row(outer, top(5), F.concat(F.lit("  - class "), name, inside, _note("description"), _note("namespace", "namespace: "), F.lit(":"))))
    heads = outer.select("file_id", F.col("id").alias("owner"), top(5).alias("place"))
    lines.append(row(heads, F.concat("place", F.array(part(0, nothing, nothing))), F.lit("      members:")))
    lines += members(heads, "        ")
    # the path comes along with the first line: a report is too long to be moved or sorted for a join
    first = path.select("file_id", F.struct("path").alias("of"), F.array(part(0, nothing, nothing)).alias("place"), F.concat(F.lit('file "'), "path", F.lit('":')).alias("text"))
    lines = [first, *(t.withColumn("of", F.lit(None).cast(first.schema["of"].dataType)) for t in lines)]
    return reduce(DataFrame.unionByName, lines)


def structures(files: DataFrame, graphs: DataFrame, functions: DataFrame, classes: DataFrame) -> DataFrame:
    """(file_id, path, report): the graphs with the source of each file's top-level functions and classes behind them, by name.

    files need id and content; functions and classes also start_line and end_line.
    """
    content = files.select(F.col("id").alias("file_id"), "content")

    def bodies(table: DataFrame, title: str) -> DataFrame:
        rows = table.filter("parent_id is null").join(content, "file_id").select("file_id", "name", "id", F.concat(F.lit("\n### "), _body()).alias("text"))
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "id", "text"))), lambda x: x["text"]), "")
        return rows.groupBy("file_id").agg(F.concat(F.lit(f"\n## {title} Bodies"), joined).alias(title))

    # bodies are short beside a report, which isn't sorted for them
    both = graphs.join(bodies(functions, "Function").hint("shuffle_hash"), "file_id", "left").join(bodies(classes, "Class").hint("shuffle_hash"), "file_id", "left")
    behind = F.concat(F.coalesce("Function", F.lit("")), F.coalesce("Class", F.lit("")))
    return both.select("file_id", "path", F.concat("report", F.when(behind != "", F.lit("\n")).otherwise(""), behind).alias("report"))
