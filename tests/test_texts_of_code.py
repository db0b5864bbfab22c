"""Imports against a tree, and symbols from what lines look like, by hand."""

from strataforge.operators import imports, nesting

TREE = ["pkg/mod.py", "lone.py", "web/a.ts", "com/acme/X.java", "org/Y.kt", "lib/my_app/foo_bar.ex", "App/Models/m.cs", "inc/x.php", "ui/p.dart", "z.zig", "tool/main.go"]
EXTERNAL = [
    ("python", "import pkg.mod", False), ("python", "from pkg import x", False), ("python", "import lone", True), ("python", "import os.path", True), ("python", "import", True), ("python", "from .near import x", True),
    ("go", '"./near"', False), ("go", '"github.com/u/tool"', False), ("go", '"fmt"', True), ("go", "./near", False),
    ("javascript", 'import { a } from "./b";', False), ("javascript", "import x from '../c'", False), ("typescript", 'import "web/a"', False), ("typescript", 'import "@web/a"', True), ("tsx", "import a from 'react';", True), ("typescript", 'import ".hidden"', True),
    ("rust", "use crate::a", False), ("rust", "super::b", False), ("rust", "use std::io", True), ("cpp", '#include "a.h"', False), ("c", "#include <a.h>", True),
    ("csharp", "using System.Text;", True), ("csharp", "using App.Models;", False), ("csharp", "using Other;", True), ("csharp", "global using X;", True),
    ("php", 'include "./x.php";', False), ("php", "require 'inc/x.php';", False), ("php", "require('x');", True), ("php", "use Symfony\\A;", True), ("php", "use App\\Models;", False), ("php", "use Gone;", True),
    ("dart", "import 'dart:io';", True), ("dart", "import 'ui/p.dart';", False), ("dart", "import '../q.dart';", False), ("dart", "import x;", True), ("java", "import com.acme.X;", False), ("java", "import com.acme;", False), ("java", "import java.util.List;", True),
    ("kotlin", "import org.Y", False), ("kotlin", "import kotlin.x", True), ("zig", '@import("std")', True), ("zig", '@import("z.zig")', False), ("zig", '@import("no.zig")', True),
    ("elixir", "MyApp.FooBar", False), ("elixir", "Plug.Conn", True), ("cobol", "COPY pkg", True),
]


def test_imports_by_language(spark):
    rows = spark.createDataFrame([(k, lang, text) for k, (lang, text, _) in enumerate(EXTERNAL)], "id long, language string, name string")
    places = imports.tree(spark.createDataFrame([(p,) for p in TREE], "path string"))
    got = {r["id"]: r for r in imports.resolved(rows, places).collect()}
    assert [(*EXTERNAL[k][:2], got[k]["external"]) for k in range(len(EXTERNAL))] == EXTERNAL
    assert got[0]["places"] == ["pkg"] and got[[x[1] for x in EXTERNAL].index("import com.acme.X;")]["places"] == ["com/acme/X.java"]
    assert imports.resolved(rows.limit(0), places).count() == 0 and all(r["external"] for r in imports.resolved(rows.filter("language = 'java'"), places.limit(0)).collect())


BRACES = """// class Not {
namespace Outer {
  public class A {
    int x = "{";
    pub fn one(a) { return a; }
    static async function two()
    {
      if (x) {
        for (;;) { y(); }
      } else {
      }
      struct In { }
    }
  }
  enum E { P, Q }
}
func last() {
  while (a) {"""
INDENT = """class A:
    x = 1

    def one(self): return 1
    async def two(self):
        if self:
            for y in x:
                pass
        # if not
        class In:
            pass
        def deep():
            with x: pass

    y = "def no(): if"
def last():
    pass
"""


def told(spark, text, indented):
    files = spark.createDataFrame([("a", text), ("b", ""), ("c", None)], "path string, content string")
    return sorted((r["first"], r["last"], r["kind"], r["name"], r["owner"], r["branches"]) for r in nesting.nested(files, indented).collect())


def test_symbols_between_braces(spark):
    assert told(spark, BRACES, False) == [
        (2, 16, "namespace", "Outer", None, 2), (3, 14, "class", "A", "Outer", 2), (5, 5, "function", "one", "A", 0), (6, 13, "function", "two", "A", 2), (12, 12, "struct", "In", "two", 0), (15, 15, "enum", "E", "Outer", 0), (17, 18, "function", "last", None, 1),
    ]


def test_symbols_by_indent(spark):
    assert told(spark, INDENT, True) == [
        (1, 15, "class", "A", None, 3), (4, 4, "function", "one", "A", 0), (5, 13, "function", "two", "A", 3), (10, 11, "class", "In", "two", 0), (12, 13, "function", "deep", "two", 1), (16, 17, "function", "last", None, 0),
    ]
