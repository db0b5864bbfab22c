"""Symbols and dependencies of Python files, read with the standard parser in Spark tasks."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.schemas import PARSED

_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith, ast.IfExp, ast.Match)


def _place(node: ast.AST) -> dict:
    return {"start_line": node.lineno, "start_column": node.col_offset, "end_line": node.end_lineno, "end_column": node.end_col_offset}


class _Reader(ast.NodeVisitor):
    def __init__(self) -> None:
        self.functions: list[dict] = []
        self.classes: list[dict] = []
        self.variables: list[dict] = []
        self.dependencies: list[dict] = []
        self.class_ord: int | None = None
        self.function_ord: int | None = None

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.classes.append({"ord": len(self.classes), "parent_ord": self.class_ord, "name": node.name, "location": _place(node), "base_classes": [ast.unparse(b) for b in node.bases], "docstring": ast.get_docstring(node)})
        before, self.class_ord = self.class_ord, len(self.classes) - 1
        self.generic_visit(node)
        self.class_ord = before

    def _function(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        a = node.args
        every = [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]
        branches = sum(isinstance(x, _BRANCHES) for x in ast.walk(node))
        self.functions.append({
            "ord": len(self.functions), "class_ord": self.class_ord, "name": node.name, "type": "function" if self.class_ord is None else "method", "location": _place(node),
            "parameters": [{"name": x.arg, "type": ast.unparse(x.annotation) if x.annotation else None} for x in every],
            "return_type": ast.unparse(node.returns) if node.returns else None, "docstring": ast.get_docstring(node), "branch_count": branches,
        })
        before = self.function_ord, self.class_ord
        self.function_ord, self.class_ord = len(self.functions) - 1, None
        self.generic_visit(node)
        self.function_ord, self.class_ord = before

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def _assigned(self, node: ast.AST, targets: list[ast.expr]) -> None:
        if self.function_ord is None:
            for t in targets:
                if isinstance(t, ast.Name):
                    self.variables.append({"class_ord": self.class_ord, "name": t.id, "type": "variable" if self.class_ord is None else "attribute", "location": _place(node)})
        self.generic_visit(node)

    def visit_Assign(self, node: ast.Assign) -> None:
        self._assigned(node, node.targets)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        self._assigned(node, [node.target])

    def _depends(self, kind: str, name: str, node: ast.AST) -> None:
        self.dependencies.append({"dependency_type": kind, "name": name, "function_ord": self.function_ord, "location": _place(node)})

    def visit_Import(self, node: ast.Import | ast.ImportFrom) -> None:
        self._depends("import", ast.unparse(node), node)

    visit_ImportFrom = visit_Import

    def visit_Call(self, node: ast.Call) -> None:
        if self.function_ord is not None:
            name = ast.unparse(node.func)
            self._depends("method_call" if isinstance(node.func, ast.Attribute) else "function_call", name, node)
            if isinstance(node.func, ast.Name) and name[:1].isupper():
                self._depends("class_reference", name, node)
        self.generic_visit(node)


def parse(path: str, content: bytes) -> dict:
    """One row of PARSED; a file that isn't Python gives an error instead of failing the task."""
    reader, error = _Reader(), None
    try:
        reader.visit(ast.parse(content.decode("utf-8", "ignore")))
    except (SyntaxError, ValueError, RecursionError) as e:
        reader, error = _Reader(), f"{type(e).__name__}: {e}"
    return {"path": path, "error": error, "functions": reader.functions, "classes": reader.classes, "variables": reader.variables, "dependencies": reader.dependencies}


def parse_files(files: DataFrame) -> DataFrame:
    """PARSED rows of (path, content, language); files in other languages are skipped, as without a grammar."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([parse(p, c) for p, c in zip(batch["path"], batch["content"])], columns=["path", "error", "functions", "classes", "variables", "dependencies"])

    return files.filter(F.col("language") == "python").select("path", "content").mapInPandas(run, PARSED)


def index(files: DataFrame, parsed: DataFrame) -> dict[str, DataFrame]:
    """The index's tables: files, functions, classes, variables, dependencies.

    Ids are hashes of a path, a kind and the place in the file, so they are the same on every run.
    """
    path_id = F.xxhash64("path")
    table = files.select(path_id.alias("id"), "path", "language", "content_hash", "mtime")
    key = lambda kind, n: F.when(n.isNotNull(), F.xxhash64("path", F.lit(kind), n))
    each = lambda name: parsed.select("path", F.explode(name).alias("x")).select("path", "x.*")
    functions = each("functions").select(key("function", F.col("ord")).alias("id"), path_id.alias("file_id"), key("class", F.col("class_ord")).alias("parent_id"), F.when(F.col("class_ord").isNotNull(), "class").alias("parent_type"), "name", "type", "location.start_line", "location.end_line", "parameters", "return_type", "docstring", F.lit(None).cast("string").alias("description"), "branch_count")
    classes = each("classes").select(key("class", F.col("ord")).alias("id"), path_id.alias("file_id"), key("class", F.col("parent_ord")).alias("parent_id"), "name", "location.start_line", "location.end_line", "base_classes", "docstring", F.lit(None).cast("string").alias("description"))
    variables = each("variables").select(F.xxhash64("path", F.lit("variable"), "name", "location").alias("id"), path_id.alias("file_id"), key("class", F.col("class_ord")).alias("parent_id"), F.when(F.col("class_ord").isNotNull(), "class").alias("parent_type"), "name", "type", F.lit(None).cast("string").alias("description"))
    deps = each("dependencies").select(F.xxhash64("path", "dependency_type", "name", "location").alias("id"), path_id.alias("file_id"), "dependency_type", "name", key("function", F.col("function_ord")).alias("source_function_id"))
    return {"files": table, "functions": functions, "classes": classes, "variables": variables, "dependencies": deps}
