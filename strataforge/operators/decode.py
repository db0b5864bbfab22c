"""Stored JSON as typed columns: what can't be read is set apart, unknown keys are dropped, defaults are filled in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where a symbol stands. The first four are required, bytes may be missing.
PLACE = ("start_line", "start_column", "end_line", "end_column")
BYTES = ("start_byte", "end_byte")
LOCATION = "struct<" + ",".join(f"{k}:int" for k in (*PLACE, *BYTES)) + ">"
#: What a list of JSON holds, by the column it is stored in.
LISTS = {"parameters": "array<struct<name:string,type:string>>", "base_classes": "array<string>", "tool_calls": "array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>"}


def location(text: Column) -> Column:
    """A location from JSON; null where the text isn't an object with whole numbers in all of PLACE. Other keys than PLACE and BYTES are dropped."""
    value = F.try_parse_json(text)
    read = F.struct(*(F.try_variant_get(value, f"$.{k}", "int").alias(k) for k in (*PLACE, *BYTES))).cast(LOCATION)
    complete = F.lit(True)
    for k in PLACE:
        complete = complete & read[k].isNotNull()
    return F.when(F.coalesce(complete, F.lit(False)), read)


def strings(text: Column) -> Column:
    """An array of strings from JSON; null where it is no array."""
    return F.try_variant_get(F.try_parse_json(text), "$", "array<string>")


def parameters(text: Column) -> Column:
    """An array of (name, type) from JSON whose items are objects, or texts that are names; null where it is no array."""
    items = F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")
    one = lambda v: F.struct(F.coalesce(F.try_variant_get(v, "$.name", "string"), F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")), F.lit("")).alias("name"), F.try_variant_get(v, "$.type", "string").alias("type"))
    return F.transform(items, one)


def symbols(rows: DataFrame, files: DataFrame, lists: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(typed, unread) from stored symbols (location and lists as JSON) and files (id, path).

    typed has location as a struct, lists as arrays, file_path, and branch_count 0 where it is null; unread
    has the rows as stored, with reason: the first column that couldn't be read. A symbol of a missing file is
    in neither, as in a lookup that joins files.
    """
    read = {"location": location(F.col("location"))} | {c: parameters(F.col(c)) if c == "parameters" else strings(F.col(c)) for c in lists}
    named = rows.join(files.select(F.col("id").alias("file_id"), F.col("path").alias("file_path")), "file_id")
    both = named.withColumns({f"_{c}": value for c, value in read.items()})
    reason = F.coalesce(*(F.when(F.col(f"_{c}").isNull(), F.lit(c)) for c in read))
    typed = both.filter(reason.isNull()).withColumns({c: F.col(f"_{c}") for c in read}).drop(*(f"_{c}" for c in read))
    if "branch_count" in rows.columns:
        typed = typed.withColumn("branch_count", F.coalesce("branch_count", F.lit(0)))
    return typed, both.filter(reason.isNotNull()).select(*rows.columns, reason.alias("reason"))


def dependencies(rows: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(typed, unread) of stored dependencies: location may be missing, is_external is a number that is told as a truth value, true where it is null."""
    place = F.when(F.coalesce("location", F.lit("")) != "", location(F.col("location")))
    named = rows.join(files.select(F.col("id").alias("file_id"), F.col("path").alias("file_path")), "file_id").withColumn("_location", place)
    bad = F.col("_location").isNull() & (F.coalesce("location", F.lit("")) != "")
    typed = named.filter(~bad).withColumns({"location": F.col("_location"), "is_external": F.coalesce(F.col("is_external") != 0, F.lit(True))}).drop("_location")
    return typed, named.filter(bad).select(*rows.columns, F.lit("location").alias("reason"))


def messages(rows: DataFrame) -> DataFrame:
    """Stored messages (content, tool_calls) with calls (an array of structs, null where tool_calls isn't an array of calls) and is_json: whether content is a JSON object or array, which is then told parsed; else it is text."""
    value = F.try_parse_json(F.col("content"))
    kind = F.schema_of_variant(value)
    calls = F.try_variant_get(F.try_parse_json("tool_calls"), "$", LISTS["tool_calls"])
    return rows.withColumns({"calls": calls, "is_json": F.coalesce(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.lit(False))})
