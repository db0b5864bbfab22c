import random

from pyspark.sql import functions as F

from strataforge.operators import graph, sessions, snapshots, symbols, text
from strataforge.operators.components import components
from strataforge.sources import files, python_source


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_fuzzy_scores(spark):
    score = lambda q, t: one(spark, text.fuzzy_score(q, F.lit(t)))
    assert score("abc", "abcdef.py") == 106
    assert abs(score("mn", "main.py") - 16.3) < 1e-9
    assert abs(score("ab", "a_b") - 26.7) < 1e-9
    assert score("zz", "main.py") is None and score("", "x") == 0


def test_blob_id_title_and_dashes(spark):
    assert one(spark, snapshots.blob_id(F.lit("hello"))) == "b6fc4c620b67d95f953a5c1c1230aaab5db5a1b0"
    assert [one(spark, sessions.title(F.lit(s))) for s in ("", "x" * 50, "x" * 51, "   ")] == ["Untitled", "x" * 50, "x" * 50 + "...", ""]
    assert one(spark, text.without_em_dashes(F.lit("a — b—c"))) == "a, b, c"


def test_truncation_and_snippet(spark):
    lines = F.split(F.lit("\n".join(map(str, range(10)))), "\n")
    assert one(spark, snapshots.truncated(lines, 4)) == ["0", "1", "... (6 lines truncated) ...", "8", "9"]
    code = "def f():\n    # c\n    x = 1"
    assert one(spark, symbols.snippet(F.lit(code), F.lit(1))) == "x = 1"
    assert one(spark, symbols.snippet(F.lit("def f():\n\n    x = 1"), F.lit(1))) == ""


def test_ordered_insert(spark):
    tasks = spark.createDataFrame([(1, k, f"t{k}") for k in range(3)], "list_id long, order_index int, goal string")
    for after, at in ((0, 0), (1, 1), (3, 3), (None, 3)):
        got = {r["order_index"]: r["goal"] for r in sessions.ordered_insert(tasks, 1, "new", after).collect()}
        want = [f"t{k}" for k in range(3)]
        want.insert(at, "new")
        assert [got[k] for k in range(4)] == want


def test_call_tree_cycle(spark):
    edges = spark.createDataFrame([("A", "B", "p"), ("A", "C", "p"), ("B", "C", "p"), ("C", "A", "p")], "source string, target string, path string")
    roots = spark.createDataFrame([("A",)], "node string")
    got = {r["node"]: (r["depth"], r["cycle"]) for r in graph.call_tree(edges, roots, 5).collect()}
    assert got == {"A": (0, True), "B": (1, False), "C": (1, False)}


def test_chain_ends_with_circle(spark):
    pointers = spark.createDataFrame([(1, 2), (2, 3), (3, None), (4, 5), (5, 4), (6, 5)], "id long, next long")
    got = {r["id"]: r["last"] for r in graph.chain_ends(pointers).collect()}
    assert {k: got[k] for k in (1, 2, 3)} == {1: 3, 2: 3, 3: 3} and got[4] == got[5] == 4


def test_components_on_random_graphs(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 140)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_html_and_replace(spark):
    shown = {
        "<p>a</p><script>x</script><p>b</p>": "a\n\nb", "": "", "<b>a</b> <b>b</b>": "ab", "a<br>b<hr/>c": "a\nb\nc", "<main>x \t y</main><figure>z</figure><figcaption>w</figcaption>": "x y\n\nz\n\nw",
        "<head><title>t</title></head>k": "k", "<svg><svg>1</svg>2</svg>3": "3", "</svg>x": "x", "a &amp; b &lt;i&gt;": "a & b <i>", "<p title='a>b'>x": "x", "a<!-- <p> -->b": "ab", "1 < 2": "1 < 2", "<style>p{}</style>z": "z",
        "<div><div><div>a</div></div></div><div></div><div></div>b": "a\n\nb", "a<script>never ends": "a",
    }
    assert {page: text.visible_text(page) for page in shown} == shown
    assert text.visible_text(None) == ""
    table = spark.createDataFrame([("p", "a-a")], "path string, content string")
    assert text.replace_literal(table, "a", "b").first()["error"] == "not unique"
    assert text.replace_literal(table, "a", "b", every=True).first()["content"] == "b-b"
    assert text.replace_regex(table, "(a)-", r"<\1>").first()["content"] == "<a>a"


def test_diff_of_added_deleted_modified_and_binary_files(spark):
    old = spark.createDataFrame([("a", b"1\n2\n3"), ("b", b"gone\n"), ("c", b"same"), ("d", b"\xff\xfe"), ("f", b"x")], "path string, content binary")
    new = spark.createDataFrame([("a", b"1\nx\n3"), ("c", b"same"), ("d", b"\xff"), ("e", b"\xff\x00\x01"), ("g", "\n".join(map(str, range(10))).encode())], "path string, content binary")
    got = {r["path"]: (r["change_type"], r["content"]) for r in snapshots.diff(old, new, 4).collect()}
    assert got["b"] == ("deleted", "gone\n") and got["e"] == ("added", "[binary file, 3 bytes]") and got["f"] == ("deleted", "x")
    assert got["d"] == ("modified", "[binary file, old: 2 bytes, new: 1 bytes]")
    assert got["g"] == ("added", "0\n1\n... (6 lines truncated) ...\n8\n9") and "c" not in got
    assert snapshots.diff(old, new, contains="a").collect()[0]["content"] == "--- a/a\n+++ b/a\n@@ -1,3 +1,3 @@\n 1\n-2\n+x\n 3"


def test_diffs_of_a_table_apply(spark):
    """Each unified diff, applied in plain Python to the old text, gives the new one."""
    from strataforge.plans.standins import standin

    old, new = ({r["path"]: r["content"] for r in standin(spark, "/root/testdata/sf0.001", name).collect()} for name in ("snapshot", "working"))
    found = snapshots.diff(standin(spark, "/root/testdata/sf0.001", "snapshot"), standin(spark, "/root/testdata/sf0.001", "working"), 1 << 20).filter("change_type = 'modified'").collect()
    assert {r["path"] for r in found} == {p for p in old.keys() & new.keys() if old[p] != new[p]}
    for r in found:
        lines, out, at = old[r["path"]].splitlines(), [], 0
        for line in r["content"].split("\n")[2:]:
            if line.startswith("@@"):
                start = int(line.split("-")[1].split(" ")[0].split(",")[0])
                count = line.split("-")[1].split(" ")[0].split(",")
                start = start - 1 if len(count) == 1 or count[1] != "0" else start
                out, at = out + lines[at:start], start
            elif line.startswith("-"):
                assert lines[at] == line[1:]
                at += 1
            elif line.startswith("+"):
                out.append(line[1:])
            else:
                assert lines[at] == line[1:]
                out.append(lines[at])
                at += 1
        assert out + lines[at:] == new[r["path"]].splitlines()


def test_chain_members_of_long_chains_and_circles(spark):
    pointers = {k: k + 1 for k in range(300)} | {400: 401, 401: 402, 402: 400, 403: 401} | {500: None}
    table = spark.createDataFrame(list(pointers.items()), "id long, next long")
    want = set()
    for start in (0, 7, 299, 400, 403, 500):
        at, hop, seen = start, 0, set()
        while at is not None and at not in seen and hop <= 250:
            seen.add(at)
            want.add((start, at, hop))
            at, hop = pointers.get(at), hop + 1
    starts = spark.createDataFrame([(k,) for k in (0, 7, 299, 400, 403, 500)], "id long")
    assert {tuple(r) for r in graph.chain_members(table, starts, 250).collect()} == want


def test_snippet_rules(spark):
    lines = lambda *x: F.lit("\n".join(("def f():", *x)))
    got = [one(spark, symbols.snippet(t, F.lit(1))) for t in (lines("  * x"), lines("  )", "y"), lines("};", "y"), lines("   ", "y"), lines("", "y"), lines("@d", "class C", "// c", "z" * 200), lines(*["#"] * 60, "y"))]
    assert got == ["* x", ")", "y", "y", "", "z" * 120, ""]


def test_shared_folder_is_required_off_local_masters():
    from types import SimpleNamespace

    import pytest

    from strataforge.storage import shared_dir

    session = lambda master, folder: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder), sparkContext=SimpleNamespace(master=master))
    assert shared_dir(session("spark://x", "hdfs://y")) == "hdfs://y" and shared_dir(session("local[8]", None)).startswith("file://")
    for master in ("spark://x", "yarn", "local-cluster[1,1,1]"):
        with pytest.raises(ValueError):
            shared_dir(session(master, None))


def test_like_wildcards(spark):
    table = spark.createDataFrame([("getXuser",), ("get\\user",), ("other",)], "name string")
    assert [r["name"] for r in table.filter(symbols.like("name", "get_user")).collect()] == ["getXuser", "get\\user"]


def test_index_of_a_tree(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "tests").mkdir()
    (tmp_path / ".aiignore").write_text("skip*.py\n!skip_not.py\n")
    (tmp_path / "pkg" / "a.py").write_text("import os\nX = 1\n\nclass C(Base):\n    y = 2\n    def run(self, n: int) -> str:\n        if n:\n            helper()\n        return self.run(0)\n\ndef helper():\n    '''Doc.'''\n    return C()\n")
    (tmp_path / "pkg" / "bad.py").write_text("def (:\n")
    (tmp_path / "pkg" / "b.h").write_text("int x;")
    (tmp_path / "skip_me.py").write_text("z = 1\n")
    (tmp_path / "skip_not.py").write_text("z = 1\n")
    (tmp_path / "tests" / "t.py").write_text("z = 1\n")
    tree = files.with_hash(files.scan(spark, str(tmp_path)))
    assert {r["path"]: r["language"] for r in tree.collect()} == {"pkg/a.py": "python", "pkg/bad.py": "python", "pkg/b.h": "cpp", "skip_not.py": "python"}
    parsed = python_source.parse_files(tree)
    assert [r["path"] for r in parsed.filter("error is not null").collect()] == ["pkg/bad.py"]
    t = python_source.index(tree, parsed)
    assert {(r["name"], r["type"], r["branch_count"]) for r in t["functions"].collect()} == {("run", "method", 1), ("helper", "function", 0)}
    links = symbols.resolve(t["dependencies"], t["functions"], t["classes"], t["variables"])
    assert {(r["dependency_type"], r["name"], r["target_kind"]) for r in links.collect()} == {("import", "import os", None), ("function_call", "helper", "function"), ("method_call", "self.run", "function"), ("function_call", "C", "class"), ("class_reference", "C", "class")}


def test_change_detection(spark):
    s = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x"), ("c", 2, "y"), ("d", 1, "z")], "path string, mtime long, content_hash string")
    k = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("c", 1, "x"), ("e", 1, "q")], "path string, mtime long, content_hash string")
    got = {r["path"]: r["change"] for r in files.changes(s, k).collect()}
    assert got == {"a": "same", "b": "touched", "c": "changed", "d": "new", "e": "deleted"}


def test_stream_parses_each_version_once(spark, tmp_path):
    from strataforge.streaming.incremental import follow, latest

    schema = "path string, content binary, language string, content_hash string"
    source = str(tmp_path / "in")
    for body in (b"def f(): pass\n", b"def f(): pass\n", b"def g(): pass\n"):
        spark.createDataFrame([("a.py", bytearray(body), "python", str(hash(body)))], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        follow(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 2 and latest(out).select(F.col("functions")[0]["name"]).first()[0] == "g"


def test_what_chains_did_moves_only_their_members(spark):
    """Members move once, to their start; sessions' rows come to them, and operations are told in order whatever their number."""
    members = spark.createDataFrame([(s, m, h) for s in range(30) for h, m in enumerate(range(s, 30))], "start long, id long, hop int")
    for kinds in (3, 70):
        done = [(s, f"f{(s + k) % 4}", f"op{k:02}" if k else None) for s in range(5, 40) for k in range(kinds)]
        found = sessions.files_of_chain(members, spark.createDataFrame(done * 2, "session_id long, file_path string, operation string"))
        want = {}
        for s in range(30):
            for at, path, operation in done:
                if s <= at < 30:
                    want.setdefault((s, path), set()).update([operation] if operation else [])
        assert {(r["start"], r["file_path"]): r["operations"] for r in found.collect()} == {k: ",".join(sorted(v)) for k, v in want.items()}
        assert found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0].count("Exchange hashpartitioning(") == 1
    sums = sessions.by_chain(members, spark.range(50).selectExpr("id AS session_id", "1 AS n")).groupBy("start").agg({"n": "sum"})
    assert {r[0]: r[1] for r in sums.collect()} == {s: 30 - s for s in range(30)}
    assert sums._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0].count("Exchange hashpartitioning(") == 1
