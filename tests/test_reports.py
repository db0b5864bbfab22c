"""Reports, decoded JSON, edits and searches with what stands around, by hand."""

import json

import pytest

from strataforge.operators import decode, reports, symbols, text


def test_report_of_a_file(spark):
    files = spark.createDataFrame([(1, "a.py", "l1\nl2\nl3\nl4"), (2, "b.py", "x")], "id long, path string, content string")
    p = lambda *x: [{"name": n, "type": t} for n, t in x]
    functions = spark.createDataFrame(
        [(1, 1, "zed", None, None, p(("a", "int"), ("b", None)), "does it", 1, 2), (2, 1, "alone", None, None, [], "", 3, 3), (3, 1, "meth", 10, "class", p(("self", None)), None, 2, 2), (4, 2, "far", None, None, [], None, 1, 1), (5, 1, "deep", 12, "class", [], None, 1, 1)],
        "id long, file_id long, name string, parent_id long, parent_type string, parameters array<struct<name:string,type:string>>, description string, start_line int, end_line int",
    )
    classes = spark.createDataFrame([(10, 1, "C", None, "ns", "a class", 2, 3), (11, 1, "Empty", None, None, None, 4, 4), (12, 1, "In", 1, None, None, 1, 1)], "id long, file_id long, name string, parent_id long, namespace string, description string, start_line int, end_line int")
    variables = spark.createDataFrame([(1, 1, "v", None, None, "int", None), (2, 1, "v", None, None, None, None), (3, 1, "w", 10, "class", None, "kept")], "id long, file_id long, name string, parent_id long, parent_type string, field_type string, description string")
    deps = spark.createDataFrame(
        [(1, 1, "function_call", "far", 1), (2, 1, "function_call", "far", 1), (3, 1, "method_call", "self.meth", 1), (4, 1, "function_call", "nowhere", 1), (5, 1, "function_call", "'text'", 1), (6, 1, "class_reference", "C", 3), (7, 1, "import", "import os", None), (8, 1, "variable_reference", "v", 3)],
        "id long, file_id long, dependency_type string, name string, source_function_id long",
    )
    namespaces = spark.createDataFrame([(1, 1, "N")], "id long, file_id long, name string")
    graphs = reports.dependency_graphs(files, functions, classes, variables, deps, namespaces)
    got = {r["path"]: r["report"] for r in graphs.collect()}
    assert got["a.py"].split("\n") == [
        'file "a.py":',
        '  - function alone() in file "a.py"', "     depending on:", "       NONE",
        '  - function zed(a: int, b) in file "a.py"  # does it', "     depending on:", '       - function far() in file "b.py"', '       - method self.meth() in file "a.py"',
        "     contains:", "       - class In:", "           members:", "             - method deep():", "                  depending on:", "                    NONE",
        '  - variable v : int in file "a.py"',
        '  - imported import os in file "a.py"',
        '  - namespace N in file "a.py"',
        '  - class C in file "a.py"  # a class  # namespace: ns:', "      members:", "        - method meth(self):", "             depending on:", '               - class C in file "a.py"', '               - variable v in file "a.py"', "        - variable w  # kept",
        '  - class Empty in file "a.py":', "      members:", "          NONE",
    ]
    assert got["b.py"].split("\n") == ['file "b.py":', '  - function far() in file "b.py"', "     depending on:", "       NONE"]
    whole = {r["path"]: r["report"] for r in reports.structures(files, graphs, functions, classes).collect()}
    assert whole["a.py"] == got["a.py"] + "\n\n## Function Bodies\n### alone\nl3\n### zed\n# Description: does it\n\nl1\nl2\n## Class Bodies\n### C\n# Description: a class\n\nl2\nl3\n### Empty\nl4"
    assert whole["b.py"] == got["b.py"] + "\n\n## Function Bodies\n### far\nx"


def test_decoded_json(spark):
    place = {"start_line": 1, "start_column": 2, "end_line": 3, "end_column": 4}
    rows = [
        (1, json.dumps(place | {"extra": 1}), '["a"]', None), (2, json.dumps(place | {"start_byte": 9}), '[{"name": "x", "type": "int"}, {"type": "y"}, {"name": "z", "type": null}]', 5), (3, '{"start_line": 1', "[]", 1), (4, json.dumps({"start_line": 1}), "[]", 1),
        (5, json.dumps(place), "{}", 1), (6, json.dumps(place | {"end_line": "x"}), "[]", 1), (7, None, "[]", 1), (8, json.dumps(place), None, 1), (9, "[]", "[]", 1),
    ]
    stored = spark.createDataFrame([(i, 7 if i != 10 else 8, *r) for i, *r in rows], "id long, file_id long, location string, parameters string, branch_count int")
    files = spark.createDataFrame([(7, "a.py")], "id long, path string")
    typed, unread = decode.symbols(stored, files, ("parameters",))
    got = {r["id"]: r for r in typed.collect()}
    assert set(got) == {1, 2} and got[1]["location"].asDict() == place | {"start_byte": None, "end_byte": None} and got[2]["location"]["start_byte"] == 9
    assert [tuple(x) for x in got[2]["parameters"]] == [("x", "int"), ("", "y"), ("z", None)] and got[1]["branch_count"] == 0 and got[1]["file_path"] == "a.py"
    assert {r["id"]: r["reason"] for r in unread.collect()} == {3: "location", 4: "location", 5: "parameters", 6: "location", 7: "location", 8: "parameters", 9: "location"}
    shown = typed.select("id", symbols.format_parameters(typed.parameters).alias("p")).collect()
    assert {r["id"]: r["p"] for r in shown}[1] == "a"
    sent = spark.createDataFrame([(1, "plain", None), (2, '{"a": 1}', '[{"id": "c1", "type": "function", "function": {"name": "f", "arguments": "{}"}}]'), (3, "[1]", "no"), (4, "12", None), (5, None, None)], "id long, content string, tool_calls string")
    got = {r["id"]: (r["is_json"], r["calls"]) for r in decode.messages(sent).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: False, 2: True, 3: True, 4: False, 5: False} and got[2][1][0]["function"]["name"] == "f" and got[3][1] is None


def test_edits_with_context(spark):
    files = spark.createDataFrame([(1, "a.py", "\n".join(f"l{k}" for k in range(1, 10)))], "id long, path string, content string")
    place = lambda a, b: spark.createDataFrame([(1, a, b)], "file_id long, start_line int, end_line int")
    one = text.edit_symbol(files, place(4, 5), "x\ny\nz", 2).first()
    assert one["content"] == "l1\nl2\nl3\nx\ny\nz\nl6\nl7\nl8\nl9"
    assert one["report"].split("\n") == ["@@ a.py:4-5 (2 lines -> 3 lines) @@", "    l2", "    l3", "  - l4", "  - l5", "  + x", "  + y", "  + z", "    l6", "    l7"]
    edge = text.edit_symbol(files, place(1, 9), "q", 5).first()
    assert edge["content"] == "q" and edge["report"].split("\n")[-1] == "  + q" and edge["report"].count("\n") == 10


def test_windows_that_meet_are_one(spark):
    lines = ["x" if k in (1, 4, 10, 20) else f"l{k}" for k in range(1, 21)]
    files = spark.createDataFrame([("a", "\n".join(lines)), ("b", "none")], "path string, content string")
    got = sorted((r["first"], r["last"], r["text"]) for r in text.grep_context(files, "^x$", 2).collect())
    want = [(1, 6), (8, 12), (18, 20)]
    assert got == [(a, b, "\n".join(lines[a - 1 : b])) for a, b in want]


def test_a_files_texts_are_no_more_than_its_symbols(spark, monkeypatch):
    """What one function depends on is one text before the file's texts come together."""
    files = spark.createDataFrame([(1, "a.py")], "id long, path string")
    functions = spark.range(1, 101).selectExpr("id", "1L AS file_id", "concat('f', id) AS name", "CAST(NULL AS BIGINT) AS parent_id", "CAST(NULL AS STRING) AS parent_type", "CAST(array() AS array<struct<name:string,type:string>>) AS parameters", "CAST(NULL AS STRING) AS description")
    classes = functions.filter("false").selectExpr("id", "file_id", "name", "parent_id", "'' AS namespace", "description")
    variables = functions.filter("false").selectExpr("id", "file_id", "name", "parent_id", "parent_type", "'' AS field_type", "description")
    deps = functions.crossJoin(spark.range(1, 31).withColumnRenamed("id", "k")).selectExpr("id * 100 + k AS id", "file_id", "'function_call' AS dependency_type", "concat('f', k) AS name", "id AS source_function_id")
    seen, keep = {}, reports.keep

    def counted(df, name):
        out = keep(df, name)
        seen[name] = out.count()
        return out

    monkeypatch.setattr(reports, "keep", counted)
    graphs = reports.dependency_graphs(files, functions, classes, variables, deps, functions.filter("false").select("id", "file_id", "name"))
    assert seen["dependencies"] == 100
    report = graphs.first()["report"].split("\n")
    assert len(report) == 1 + 100 * 32 and report[1:4] == ['  - function f1() in file "a.py"', "     depending on:", '       - function f1() in file "a.py"']
    assert "SortMergeJoin" not in graphs._jdf.queryExecution().executedPlan().toString().split("ObjectHashAggregate")[0]


def _above_the_aggregate(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0].split("ObjectHashAggregate")[0]


def test_a_report_is_in_one_row_only(spark):
    """Where a filter or join stood behind the aggregate, a long report was copied for it."""
    from strataforge.plans import catalogue

    data = "/root/testdata/sf0.001"
    graphs = catalogue.queries()["dependency_graphs"](spark, data)
    assert not [x for x in ("Filter", "Project", "Join") if x in _above_the_aggregate(graphs)]
    digests = catalogue.queries()["explore_structures"](spark, data)
    assert not [x for x in ("Filter", "Join") if x in _above_the_aggregate(digests)]


@pytest.mark.parametrize("long", [32_000_000, 40])
def test_sources_as_lines_equal_sources_joined(spark, monkeypatch, long):
    monkeypatch.setattr(reports, "LONG", long)
    files = spark.createDataFrame([(1, "a.py", "l1\nl2\nl3"), (2, "b.py", None), (3, "c.py", "x"), (4, "d.py", "y")], "id long, path string, content string")
    functions = spark.createDataFrame(
        [(9, 1, "f", None, None, "", 1, 1), (10, 1, "f", None, None, "d", 2, 3), (-5, 1, "f", None, None, None, 3, 3), (11, 2, "g", None, None, None, 1, 1), (12, 1, "m", 1, "class", None, 1, 1)],
        "id long, file_id long, name string, parent_id long, parent_type string, description string, start_line int, end_line int",
    ).selectExpr("*", "CAST(array() AS array<struct<name:string,type:string>>) AS parameters")
    classes = spark.createDataFrame([(1, 1, "C", None, None, "c", 1, 2), (2, 3, "D", None, "n", None, 1, 1)], "id long, file_id long, name string, parent_id long, namespace string, description string, start_line int, end_line int")
    none = functions.filter("false")
    variables = none.selectExpr("id", "file_id", "name", "parent_id", "parent_type", "'' AS field_type", "description")
    tables = files, functions, classes, variables, none.selectExpr("id", "file_id", "'' AS dependency_type", "name", "id AS source_function_id"), none.select("id", "file_id", "name")
    told = lambda df: {r["file_id"]: (r["path"], r["report"]) for r in df.collect()}
    got = told(reports.explored(*tables))
    assert len(got) == 4 and got == told(reports.structures(files, reports.dependency_graphs(*tables), functions, classes))
    assert got[1][1].index("### f\nl3") < got[1][1].index("### f\nl1") < got[1][1].index("### f\n# Description: d")
