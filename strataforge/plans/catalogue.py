"""The registered queries of the code, session, snapshot and text operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataforge.operators import decode, graph, history, imports, nesting, reports, sessions, snapshots, store, symbols, text
from strataforge.sources import files
from strataforge.plans.standins import SELECTS, standin, with_standins
from strataforge.storage import folder, keep, table
from strataforge.streaming import reindex

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, tuple[Query, str | None]] = {}


def _add(name: str, build: Callable[..., DataFrame], tables: str, sql: str | None) -> None:
    """A query over stand-ins or tables, by name, and its SQL over the same names."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(*(standin(spark, sf_dir, t) if t in SELECTS else table(spark, sf_dir, t) for t in tables.split()))

    _FOUND[name] = (run, with_standins(sql) if sql else None)


SYMBOL = "id, file_id, name"
KINDS = ("function", "class", "variable")
UNION = (
    "SELECT 0 AS kind_ord, 'function' AS kind, id, file_id, name, description FROM functions UNION ALL SELECT 1, 'class', id, file_id, name, description FROM classes "
    "UNION ALL SELECT 2, 'variable', id, file_id, name, description FROM variables"
)


def _kinds(f: DataFrame, c: DataFrame, v: DataFrame) -> dict[str, DataFrame]:
    return dict(zip(KINDS, (f, c, v)))


def _pick(df: DataFrame) -> DataFrame:
    return df.select("id", "file_id", "name")


# lookups
_add("files_by_language", lambda f: symbols.files_by_language(f, "de").select("id", "path"), "files", "SELECT id, path FROM files WHERE language = 'de'")
_add("file_by_path", lambda f: symbols.file_by_path(f, "./src7/7.en").unionByName(symbols.file_by_path(f, "src3/3.en")).select("id", "path"), "files", "SELECT id, path FROM files WHERE path IN ('src7/7.en', 'src3/3.en')")
_add("symbol_by_id", lambda f: _pick(symbols.by_id(f, 42)), "functions", f"SELECT {SYMBOL} FROM functions WHERE id = 42")
_add("symbol_by_name", lambda f: _pick(symbols.by_name(f, "blue anvil")), "functions", f"SELECT {SYMBOL} FROM functions WHERE name = 'blue anvil'")
_add("symbol_by_name_in_file", lambda f: _pick(symbols.by_name(f, "blue anvil", 81)), "functions", f"SELECT {SYMBOL} FROM functions WHERE name = 'blue anvil' AND file_id = 81")
_add("functions_top_level", lambda f: _pick(symbols.top_level(f)), "functions", f"SELECT {SYMBOL} FROM functions WHERE parent_id IS NULL")
_add("classes_top_level", lambda f: _pick(symbols.top_level(f)), "classes", f"SELECT {SYMBOL} FROM classes WHERE parent_id IS NULL")
_add("variables_top_level", lambda f: _pick(symbols.top_level(f, 8)), "variables", f"SELECT {SYMBOL} FROM variables WHERE parent_id IS NULL AND file_id = 8")
_add("class_methods", lambda f: _pick(symbols.members(f, 4)), "functions", f"SELECT {SYMBOL} FROM functions WHERE parent_id = 4 AND parent_type = 'class'")
_add("class_variables", lambda v: _pick(symbols.members(v, 4)), "variables", f"SELECT {SYMBOL} FROM variables WHERE parent_id = 4 AND parent_type = 'class'")
_add("nested_classes", lambda c: _pick(symbols.nested_classes(c, 1)), "classes", f"SELECT {SYMBOL} FROM classes WHERE parent_id = 1")
_add("symbols_with_path", lambda f, files: symbols.with_path(f, files).select("id", "name", "file_path"), "functions files", "SELECT f.id, f.name, g.path AS file_path FROM functions f JOIN files g ON f.file_id = g.id")
_add("first_definition", lambda f: symbols.first_definition(f), "functions", "SELECT name, id, file_id FROM functions QUALIFY row_number() OVER (PARTITION BY name ORDER BY id) = 1")
_add("first_method_definition", lambda f: symbols.first_definition(f, prefer_methods=True), "functions", "SELECT name, id, file_id FROM functions QUALIFY row_number() OVER (PARTITION BY name ORDER BY CASE WHEN parent_type = 'class' THEN 0 ELSE 1 END, id) = 1")
# searches
for _kind, _table in (("functions", "functions"), ("classes", "classes"), ("variables", "variables")):
    _add(f"search_{_kind}", lambda t: _pick(symbols.search(t, "a_v" if "branch_count" in t.columns else "r#00")), _table, f"SELECT {SYMBOL} FROM {_table} WHERE name ILIKE '{'%a_v%' if _kind == 'functions' else '%r#00%'}'")
_add("search_all", lambda f, c, v: symbols.union_kinds(_kinds(f, c, v)).filter(symbols.like("name", "er")).groupBy("kind").agg(F.count("*").alias("n")), "functions classes variables", f"SELECT kind, count(*) AS n FROM ({UNION}) WHERE name ILIKE '%er%' GROUP BY kind")
_add(
    "search_symbols", lambda f, c, v: symbols.search_symbols(_kinds(f, c, v), "blue anvil", 10), "functions classes variables",
    f"SELECT rank, kind, id, name, description FROM (SELECT *, row_number() OVER (PARTITION BY rank, kind ORDER BY id) AS n FROM (SELECT *, CASE WHEN name = 'blue anvil' THEN 0 WHEN name ILIKE '%blue anvil%' THEN 1 WHEN description ILIKE '%blue anvil%' THEN 2 END AS rank FROM ({UNION})) WHERE rank IS NOT NULL) WHERE n <= 10 ORDER BY rank, name, kind_ord, id LIMIT 10",
)
_add(
    "search_descriptions", lambda f, c, v: symbols.search_descriptions(_kinds(f, c, v), "brand#2", 20).select("kind", "id", "name"), "functions classes variables",
    f"SELECT kind, id, name FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY id) AS n FROM ({UNION}) WHERE description ILIKE '%brand#2%') WHERE n <= 20 ORDER BY kind_ord, id LIMIT 20",
)
_add("undocumented_symbols", lambda f, c, v: symbols.undocumented(_kinds(f, c, v)), "functions classes variables", f"SELECT kind, name, count(*) AS n FROM ({UNION}) WHERE coalesce(description, '') = '' GROUP BY kind, name")
_add(
    "describe_by_name", lambda f: symbols.describe(f, symbols.description_rows(f, "function", "blue anvil", "first", 1).unionByName(symbols.description_rows(f, "function", "blue anvil", "second", 2, 3)), "function").select("id", "description"), "functions",
    "SELECT id, CASE WHEN name = 'blue anvil' THEN CASE WHEN file_id = 3 THEN 'second' ELSE 'first' END ELSE description END AS description FROM functions",
)
# complexity
_LOC = "end_line - start_line + 1"
_OUT = "SELECT id, CAST(branch_count AS BIGINT) AS branch_count FROM functions WHERE "
_slim = lambda df: df.select("id", F.col("branch_count").cast("long").alias("branch_count"))
_add("complexity_and", lambda f: _slim(symbols.by_complexity(f, min_branches=5, min_lines=20, max_lines=40)), "functions", _OUT + f"parent_id IS NULL AND branch_count >= 5 AND {_LOC} >= 20 AND {_LOC} <= 40")
_add("complexity_or_raw", lambda f: _slim(symbols.by_complexity(f, min_branches=5, min_lines=30, match_any=True)), "functions", _OUT + f"(parent_id IS NULL AND branch_count >= 5) OR {_LOC} >= 30")
_add("complexity_or_grouped", lambda f: _slim(symbols.by_complexity(f, min_branches=5, min_lines=30, match_any=True, grouped=True)), "functions", _OUT + f"parent_id IS NULL AND (branch_count >= 5 OR {_LOC} >= 30)")
_add("complexity_methods", lambda f: _slim(symbols.by_complexity(f, min_branches=5, class_id=4)), "functions", _OUT + "parent_id = 4 AND parent_type = 'class' AND branch_count >= 5")
# statistics
_add(
    "statistics", lambda a, f, c, v: symbols.statistics(a, f, c, v), "files functions classes variables",
    "SELECT 'files' AS metric, count(*) AS value FROM files UNION ALL SELECT 'functions', count(*) FROM functions WHERE parent_id IS NULL UNION ALL SELECT 'methods', count(*) FROM functions WHERE parent_id IS NOT NULL UNION ALL SELECT 'classes', count(*) FROM classes WHERE parent_id IS NULL UNION ALL SELECT 'variables', count(*) FROM variables WHERE parent_id IS NULL",
)
_add("language_statistics", symbols.language_statistics, "files", 'SELECT language, count(*) AS "count" FROM files GROUP BY language')
# dependencies
_DEP = "SELECT id, name FROM deps WHERE "
_two = lambda df: df.select("id", "name")
_add("deps_of_file", lambda d: _two(symbols.dependencies(d, file_id=5)), "deps", _DEP + "file_id = 5")
_add("imports_external", lambda d: _two(symbols.dependencies(d, kind="import", external=True)), "deps", _DEP + "dependency_type = 'import' AND is_external")
_add("imports_internal", lambda d: _two(symbols.dependencies(d, kind="import", external=False)), "deps", _DEP + "dependency_type = 'import' AND NOT is_external")
_add("function_calls", lambda d: _two(symbols.dependencies(d, source=12, kind="function_call")), "deps", _DEP + "source_function_id = 12 AND dependency_type = 'function_call'")
_add("deps_by_function_name", lambda f, d: _two(symbols.dependencies_by_name(f, d, "blue anvil")), "functions deps", _DEP + "source_function_id = (SELECT min(id) FROM functions WHERE name = 'blue anvil')")
_add(
    "deps_grouped", lambda d: symbols.dependencies_grouped(d, 12).select("dependency_type", F.array_join("names", ",").alias("names")), "deps",
    "SELECT k.dependency_type, coalesce(string_agg(d.name, ',' ORDER BY d.name), '') AS names FROM (VALUES ('import'), ('function_call'), ('method_call'), ('class_reference'), ('variable_reference'), ('module_reference')) AS k(dependency_type) LEFT JOIN deps d ON d.dependency_type = k.dependency_type AND d.source_function_id = 12 GROUP BY 1",
)
_add("blast_radius", lambda d, f, c: symbols.blast_radius(d, f, c, 7), "deps functions classes", "SELECT DISTINCT file_id FROM deps WHERE target_function_id IN (SELECT id FROM functions WHERE file_id = 7) OR target_class_id IN (SELECT id FROM classes WHERE file_id = 7)")
_WANTED = "(SELECT *, CASE WHEN dependency_type = 'method_call' THEN regexp_replace(name, '^.*\\.', '') ELSE name END AS wanted FROM deps)"
_add(
    "call_targets", lambda d, f, c, v: symbols.resolve(d, f, c, v).select("id", "target_kind", "target_id", "unresolved"), "deps functions classes variables",
    f"SELECT d.id, t.kind AS target_kind, t.sid AS target_id, t.sid IS NULL AS unresolved FROM {_WANTED} d LEFT JOIN (SELECT 0 AS o, 'function' AS kind, id AS sid, file_id, name, parent_type FROM functions UNION ALL SELECT 1, 'class', id, file_id, name, NULL FROM classes UNION ALL SELECT 2, 'variable', id, file_id, name, NULL FROM variables) t ON t.name = d.wanted AND "
    "((d.dependency_type = 'function_call' AND t.o < 2) OR (d.dependency_type = 'method_call' AND (t.o = 1 OR (t.o = 0 AND t.parent_type = 'class'))) OR (d.dependency_type = 'class_reference' AND t.o = 1) OR (d.dependency_type = 'variable_reference' AND t.o = 2)) "
    "QUALIFY row_number() OVER (PARTITION BY d.id ORDER BY t.o NULLS LAST, CASE WHEN t.file_id = d.file_id THEN 0 ELSE 1 END, t.sid) = 1",
)
_LITERAL = (
    """(contains(name, '"') OR contains(name, '''') OR contains(name, ' ') OR contains(name, '.format(') OR (contains(name, '(') AND len(string_split(name, '%')) > 2) OR """
    "len(list_filter(['+', '-', '*', '/', '=', '==', '!=', '<', '>', '<=', '>='], lambda x: contains(name, x))) >= 2)"
)
_add("literal_filter", lambda d: d.filter(~symbols.is_likely_literal(F.col("name"))).select("id", "name"), "names", f"SELECT id, name FROM names WHERE NOT {_LITERAL}")
# reports
_add(
    "file_summary", lambda a, f, c, v: symbols.nested(a.select("id", "path"), {"functions": f, "classes": c, "variables": v}, "file_id").select("id", "path", *(F.array_join(x, ",").alias(x) for x in ("functions", "classes", "variables"))), "files functions classes variables",
    "SELECT g.id, g.path, " + ", ".join(f"coalesce((SELECT string_agg(name, ',' ORDER BY name) FROM {t} x WHERE x.file_id = g.id), '') AS {t}" for t in ("functions", "classes", "variables")) + " FROM files g",
)
_add(
    "class_summary", lambda c, f, v: symbols.nested(c.select("id", "name"), {"methods": f.filter("parent_type = 'class'"), "variables": v.filter("parent_type = 'class'")}, "parent_id").select("id", "name", F.array_join("methods", ",").alias("methods"), F.array_join("variables", ",").alias("variables")), "classes functions variables",
    "SELECT c.id, c.name, coalesce((SELECT string_agg(x.name, ',' ORDER BY x.name) FROM functions x WHERE x.parent_id = c.id AND x.parent_type = 'class'), '') AS methods, coalesce((SELECT string_agg(x.name, ',' ORDER BY x.name) FROM variables x WHERE x.parent_id = c.id AND x.parent_type = 'class'), '') AS variables FROM classes c",
)
_SECTION = "SELECT file_id, {k} AS section, '{label}:' || chr(10) || '  - ' || string_agg(DISTINCT name, chr(10) || '  - ' ORDER BY name) AS text FROM {t} WHERE {w} GROUP BY file_id"
_add(
    "dependency_report", symbols.dependency_report, "files functions variables deps classes",
    "SELECT g.path, string_agg(s.text, chr(10) ORDER BY s.section) AS report FROM files g JOIN (" + " UNION ALL ".join(_SECTION.format(k=k, label=label, t=t, w=w) for k, label, t, w in ((0, "functions", "functions", "parent_id IS NULL"), (1, "variables", "variables", "parent_id IS NULL"), (2, "imports", "deps", "dependency_type = 'import'"), (3, "classes", "classes", "true"))) + ") s ON s.file_id = g.id GROUP BY g.path",
)
_add("source_slice", lambda a: a.select("id", symbols.source_lines(F.col("content"), F.lit(2), F.lit(4)).alias("lines")), "files", "SELECT id, array_to_string(string_split(content, chr(10))[2:4], chr(10)) AS lines FROM files")
# graph
_ROOTS = "SELECT id AS node FROM functions WHERE name = 'blue anvil'"
# every path on which no node comes twice is walked, and a callee is told before it is asked whether it is walked on from
_WALK = (
    "WITH w AS (SELECT node AS root, node, 0 AS depth, [node] AS way, false AS back FROM ({roots}) UNION ALL SELECT w.root, e.target, w.depth + 1, list_append(w.way, e.target), list_contains(w.way, e.target) FROM w JOIN {edges} e ON e.source = w.node WHERE NOT w.back AND w.depth < {depth} AND {where}), "
    "t AS (SELECT root, node, CAST(min(depth) AS BIGINT) AS depth, bool_or(back) AS cycle FROM w GROUP BY root, node) "
)
for _name, _exclude, _where in (("call_tree", (), "true"), ("call_tree_exclude", ("src1",), "NOT starts_with(e.path, 'src1')")):
    _add(
        _name, lambda e, f, x=_exclude: graph.call_tree(e, symbols.by_name(f, "blue anvil").select(F.col("id").alias("node")), 3, x).select("root", "node", F.col("depth").cast("long").alias("depth"), "cycle"), "edges functions",
        _WALK.format(roots=_ROOTS, edges="edges", depth=3, where=_where) + "SELECT root, node, depth, cycle FROM t",
    )
_FIRST = "(SELECT min(f.id) FROM code_functions f WHERE {})"
_METHOD = "f.parent_type = 'class' AND f.name = regexp_replace(d.name, '^.*[.]', '')"
_CALLS = (
    "(SELECT DISTINCT source, c.name, target, g.path FROM (SELECT source_function_id AS source, name, CASE dependency_type WHEN 'function_call' THEN coalesce(" + _FIRST.format("f.name = d.name AND f.file_id = d.file_id") + ", " + _FIRST.format("f.name = d.name") + ") "
    "WHEN 'method_call' THEN coalesce(" + _FIRST.format(_METHOD + " AND f.file_id = d.file_id") + ", " + _FIRST.format(_METHOD) + ") ELSE "
    + _FIRST.format("f.name = '__init__' AND f.parent_type = 'class' AND f.parent_id = coalesce(d.target_class_id, (SELECT min(c.id) FROM classes c WHERE c.name = d.name AND c.file_id = d.file_id), (SELECT min(c.id) FROM classes c WHERE c.name = d.name))")
    + f" END AS target FROM code_deps d WHERE NOT {_LITERAL}) c LEFT JOIN code_functions f ON f.id = c.target LEFT JOIN files g ON g.id = f.file_id)"
)
_SYMBOLS = ("blue_anvil", "Supplier#000000003", "Supplier#000000004.small_widget")


def _walked(d: DataFrame, f: DataFrame, c: DataFrame, v: DataFrame, a: DataFrame) -> DataFrame:
    roots = graph.root_functions(f, c, _SYMBOLS[0]).unionByName(graph.root_functions(f, c, _SYMBOLS[1])).unionByName(graph.root_functions(f, c, _SYMBOLS[2])).distinct()
    walked = graph.walk_calls(graph.call_edges(d, f, c, v, a), roots, f, 3, True, ("src1/",))
    return walked.select("root", "id", "name", "kind", F.col("depth").cast("long").alias("depth"), "cycle", F.array_join("callees", ",").alias("callees"))


_IN_CLASS = "SELECT {} FROM code_functions WHERE parent_type = 'class' AND parent_id = (SELECT min(id) FROM classes WHERE name = '{}')"
_add(
    "walk_calls", _walked, "code_deps code_functions classes variables files",
    _WALK.replace("WITH w", f"WITH calls AS MATERIALIZED {_CALLS}, w").format(
        roots=f"SELECT arg_min(id, CASE WHEN parent_type = 'class' THEN id ELSE id + 1000000000 END) AS node FROM code_functions WHERE name = '{_SYMBOLS[0]}' UNION {_IN_CLASS.format('id', _SYMBOLS[1])} UNION {_IN_CLASS.format('min(id)', 'Supplier#000000004')} AND name = 'small_widget' HAVING min(id) IS NOT NULL",
        edges="calls", depth=3, where="e.target IS NOT NULL AND (e.path IS NULL OR NOT starts_with(e.path, 'src1/'))",
    )
    + ", o AS (SELECT DISTINCT root, t.depth, c.source, coalesce('f:' || c.target, 'ext:' || c.name) AS callee, c.name FROM t JOIN calls c ON c.source = t.node WHERE t.depth < 3 AND (c.target IS NULL OR c.path IS NULL OR NOT starts_with(c.path, 'src1/'))), "
    "l AS (SELECT root, source, string_agg(DISTINCT callee, ',' ORDER BY callee) AS callees FROM o GROUP BY root, source) "
    "SELECT t.root, 'f:' || t.node AS id, f.name, CASE WHEN f.parent_type = 'class' THEN 'method' ELSE 'function' END AS kind, t.depth, t.cycle, coalesce(l.callees, '') AS callees FROM t JOIN code_functions f ON f.id = t.node LEFT JOIN l ON l.root = t.root AND l.source = t.node "
    "UNION ALL SELECT root, callee, name, 'external', min(depth) + 1, false, '' FROM o WHERE starts_with(callee, 'ext:') GROUP BY root, callee, name",
)
_add("redirect_chain", lambda p: graph.chain_ends(p).select("id", "last", "hops"), "pointers", "SELECT id, last_value(id) OVER w AS last, count(*) OVER w - 1 AS hops FROM pointers WINDOW w AS (PARTITION BY o_custkey ORDER BY id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")
_add(
    "changes_by_chain", lambda p, c: sessions.by_chain(graph.chain_members(p, p).withColumn("id", F.col("id") % 150), c.groupBy("session_id").agg(F.count("*").alias("n"), F.min("id").alias("first"))).groupBy("start").agg(F.sum("n").alias("n"), F.min("first").alias("first")), "pointers changes",
    "WITH m AS (SELECT id AS start, id, 0 AS hop FROM pointers UNION ALL SELECT m.start, p.next, m.hop + 1 FROM m JOIN pointers p ON p.id = m.id WHERE p.next IS NOT NULL) SELECT m.start, count(*) AS n, min(c.id) AS first FROM m JOIN changes c ON c.session_id = m.id % 150 GROUP BY m.start",
)
# sessions
_add("list_chats", sessions.chats_with_user, "messages", "SELECT DISTINCT session_id FROM messages WHERE role = 'user'")
_add("purged_chats", lambda m: sessions.chats_without_user(m.select("session_id").distinct(), m), "half_messages", "SELECT session_id FROM half_messages GROUP BY session_id HAVING count(*) FILTER (role = 'user') = 0")
_add("chat_title", lambda m: m.select("session_id", "turn", sessions.title(F.col("text")).alias("title")), "messages", r"SELECT session_id, turn, CASE WHEN text = '' THEN 'Untitled' WHEN length(t) > 50 THEN t[1:50] || '...' ELSE t END AS title FROM (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM messages)")
_add(
    "session_finished", sessions.session_finished, "turns redirects",
    "WITH w AS (SELECT id AS asked, id, 0 AS hop FROM redirects UNION ALL SELECT w.asked, r.next, hop + 1 FROM w JOIN redirects r ON r.id = w.id WHERE r.next IS NOT NULL), a AS (SELECT asked, arg_max(id, hop) AS id FROM w GROUP BY asked), "
    "m AS (SELECT session_id, arg_max(role, turn) = 'assistant' AND arg_max(n_calls, turn) = 0 AS finished FROM turns GROUP BY session_id) SELECT asked AS session_id, coalesce(finished, false) AS finished FROM a LEFT JOIN m ON m.session_id = a.id",
)
_add("handover_flags", lambda m: sessions.handover_flags(m, 51_000, 50_000).select("session_id", "turn", "tokens", "handover"), "messages", "SELECT session_id, turn, CAST(s // 4 AS BIGINT) AS tokens, 51000 - s // 4 < 50000 AS handover FROM (SELECT *, sum(length(text)) OVER (PARTITION BY session_id ORDER BY turn) AS s FROM messages)")
_add(
    "pending_toolcalls", lambda m: sessions.pending_calls(m.select("session_id", "turn", "role", F.when(F.col("role") == "assistant", F.array(F.concat(F.lit("a"), F.col("turn")), F.concat(F.lit("b"), F.col("turn")))).alias("calls"), F.when(F.col("role") == "user", F.concat(F.lit("a"), (F.col("turn") - 1).cast("string"))).alias("answers"))), "messages",
    "SELECT l.session_id, c.call FROM (SELECT session_id, max(turn) AS turn FROM messages WHERE role = 'assistant' GROUP BY session_id) l, LATERAL (SELECT unnest(['a' || l.turn, 'b' || l.turn]) AS call) c WHERE NOT EXISTS (SELECT 1 FROM messages m WHERE m.session_id = l.session_id AND m.role = 'user' AND m.turn > l.turn AND 'a' || (m.turn - 1) = c.call)",
)
_add("next_task", lambda t: sessions.next_task(t).select("list_id", "id", "status"), "tasks", "SELECT list_id, id, status FROM tasks WHERE status <> 'completed' QUALIFY row_number() OVER (PARTITION BY list_id ORDER BY CASE WHEN status = 'in_progress' THEN 0 ELSE 1 END, order_index, id) = 1")
_add("all_done_lists", sessions.all_done, "lists tasks", "SELECT l.list_id, coalesce(bool_and(t.status = 'completed'), true) AS done FROM lists l LEFT JOIN tasks t USING (list_id) GROUP BY l.list_id")
_add("ordered_insert", lambda t: sessions.ordered_insert(t, 7, "new", 2).select("list_id", F.col("order_index").cast("long").alias("order_index"), "goal"), "tasks", "SELECT list_id, CAST(CASE WHEN order_index >= 2 THEN order_index + 1 ELSE order_index END AS BIGINT) AS order_index, goal FROM tasks WHERE list_id = 7 UNION ALL SELECT 7, least(2, coalesce(max(order_index) + 1, 0)), 'new' FROM tasks WHERE list_id = 7")
_add("active_todo_list", sessions.active_list, "lists", "SELECT session_id, id, status FROM lists WHERE status IN ('pending', 'in_progress', 'rejected') QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY id DESC) = 1")
_add("depth_allowed", lambda f: f.select("id", sessions.depth_allowed(F.col("branch_count"), F.col("end_line") - 10).alias("allowed")), "functions", "SELECT id, coalesce(end_line - 10 < CASE branch_count WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 4 WHEN 4 THEN 8 WHEN 99 THEN 16 END, true) AS allowed FROM functions")
_add("changes_page", lambda c: sessions.page(c, 50, 20).select("id", "change_type"), "changes", "SELECT id, change_type FROM changes ORDER BY timestamp DESC, id DESC LIMIT 50 OFFSET 20")
_add("changes_by_role", lambda c: sessions.page(c.filter("change_type = 'click'"), 30).select("id", "session_id"), "changes", "SELECT id, session_id FROM changes WHERE change_type = 'click' ORDER BY timestamp DESC, id DESC LIMIT 30")
_add("event_props", lambda c: c.select("id", F.get_json_object("props", "$.k").cast("long").alias("k")), "changes", "SELECT id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM changes")
_add("skill_upsert", lambda m: sessions.upsert(m.select("session_id", "role", "turn", "text"), ["session_id", "role"], "turn"), "messages", "SELECT session_id, role, arg_max(text, turn) AS text FROM messages GROUP BY session_id, role")
_add("skill_summaries", lambda m: m.select("session_id", "turn", sessions.skill_summary(F.col("text")).alias("summary")), "messages", r"SELECT session_id, turn, split_part(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10), 1)[1:200] AS summary FROM messages")
# snapshots
_BLOB = "sha1(('blob ' || octet_length(encode(content)))::BLOB || '\\x00'::BLOB || encode(content))"
_ids = lambda t: t.select("path", snapshots.blob_id(F.col("content")).alias("blob_id"))
_STATUS = f"(SELECT coalesce(w.path, s.path) AS path, CASE WHEN s.path IS NULL THEN 'added' WHEN w.path IS NULL THEN 'deleted' WHEN w.content = s.content THEN 'unchanged' ELSE 'modified' END AS status FROM working w FULL JOIN snapshot s ON w.path = s.path)"
_add("blob_ids", _ids, "working", f"SELECT path, {_BLOB} AS blob_id FROM working")
_add("status", lambda w, s: snapshots.status(_ids(w), _ids(s)), "working snapshot", f"SELECT path, status FROM {_STATUS}")
_add("status_capped", lambda w, s: snapshots.status_capped(snapshots.status(_ids(w), _ids(s))), "working snapshot", f"SELECT status, string_agg(path, ',' ORDER BY path) FILTER (n <= 50) AS paths, count(*) FILTER (n > 50) AS more FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY path) AS n FROM {_STATUS}) GROUP BY status")
# the content of modified files is tested in plain Python; SQL has the rest
_add("diff_text", lambda w, s: snapshots.diff(s, w), "working snapshot", None)
_add(
    "diff_added_deleted", lambda w, s: snapshots.diff(s, w).filter("change_type != 'modified'"), "working snapshot",
    "SELECT path, t AS change_type, CASE WHEN len(l) <= 500 THEN c ELSE array_to_string(l[1:250], chr(10)) || chr(10) || '... (' || (len(l) - 500) || ' lines truncated) ...' || chr(10) || array_to_string(l[len(l)-249:len(l)], chr(10)) END AS content FROM "
    "(SELECT *, string_split(c, chr(10)) AS l FROM (SELECT w.path, 'added' AS t, w.content AS c FROM working w ANTI JOIN snapshot s ON w.path = s.path UNION ALL SELECT s.path, 'deleted', s.content FROM snapshot s ANTI JOIN working w ON w.path = s.path))",
)
_add(
    "tree_ids", lambda w: snapshots.tree_ids(_ids(w)), "working",
    f"WITH b AS (SELECT path, string_split(path, '/') AS p, {_BLOB} AS id FROM working), "
    "d AS (SELECT p[1] || '/' || p[2] AS directory, p[1] AS up, p[2] AS leaf, sha1(('tree ' || octet_length(unhex(x)))::BLOB || '\\x00'::BLOB || unhex(x)) AS tree_id FROM (SELECT p[1:2] AS p, string_agg(hex('100644 ' || p[3]) || '00' || upper(id), '' ORDER BY p[3]) AS x FROM b WHERE len(p) = 3 GROUP BY p[1:2])), "
    "s AS (SELECT up AS directory, sha1(('tree ' || octet_length(unhex(x)))::BLOB || '\\x00'::BLOB || unhex(x)) AS tree_id FROM (SELECT up, string_agg(line, '' ORDER BY k) AS x FROM (SELECT p[1] AS up, p[2] AS k, hex('100644 ' || p[2]) || '00' || upper(id) AS line FROM b WHERE len(p) = 2 UNION ALL SELECT up, leaf || '/', hex('40000 ' || leaf) || '00' || upper(tree_id) FROM d) GROUP BY up)) "
    "SELECT directory, tree_id FROM d UNION ALL SELECT directory, tree_id FROM s UNION ALL SELECT '', sha1(('tree ' || octet_length(unhex(x)))::BLOB || '\\x00'::BLOB || unhex(x)) FROM (SELECT string_agg(hex('40000 ' || directory) || '00' || upper(tree_id), '' ORDER BY directory || '/') AS x FROM s)",
)
_add("restore", lambda s, w: snapshots.restore(_ids(s), w.select(snapshots.blob_id(F.col("content")).alias("blob_id"), "content").dropDuplicates(["blob_id"])), "snapshot working", "SELECT path, content FROM snapshot WHERE content IN (SELECT content FROM working)")
_add("truncate_lines", lambda w: w.select("path", F.array_join(snapshots.truncated(F.split("content", "\n"), 4), "\n").alias("cut")), "working", "SELECT path, CASE WHEN len(l) <= 4 THEN array_to_string(l, chr(10)) ELSE array_to_string(l[1:2], chr(10)) || chr(10) || '... (' || (len(l) - 4) || ' lines truncated) ...' || chr(10) || array_to_string(l[len(l)-1:len(l)], chr(10)) END AS cut FROM (SELECT path, string_split(content, chr(10)) AS l FROM working)")
_add("dir_tree_counts", snapshots.directories, "working", "SELECT directory, count(*) AS n_files FROM (SELECT split_part(path, '/', 1) AS directory FROM working UNION ALL SELECT regexp_replace(path, '/[^/]*$', '') FROM working WHERE path LIKE '%/%/%') GROUP BY 1")
# text
_add("grep_lines", lambda w: text.grep(w, "[Tt]he [a-z]+ing").select("path", F.col("line_number").cast("long").alias("line_number"), "line"), "working", "SELECT path, CAST(i AS BIGINT) AS line_number, line FROM (SELECT path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM working) WHERE regexp_matches(line, '[Tt]he [a-z]+ing')")
_add("replace_literal", lambda w: text.replace_literal(w, "the ", "THE ", every=True).select("path", "n", "content"), "working", "SELECT path, CAST((length(content) - length(replace(content, 'the ', ''))) // 4 AS BIGINT) AS n, replace(content, 'the ', 'THE ') AS content FROM working")
_add("replace_unique_check", lambda w: text.replace_literal(w, "ing.", "ED.").select("path", "error"), "working", "SELECT path, CASE WHEN n = 0 THEN 'not found' WHEN n > 1 THEN 'not unique' END AS error FROM (SELECT path, (length(content) - length(replace(content, 'ing.', ''))) // 4 AS n FROM working)")
_add("replace_regex", lambda w: text.replace_regex(w, "([a-z]+)ing ", r"\1ED ").select("path", F.col("n").cast("long").alias("n"), "content", "error"), "working", r"SELECT path, CASE WHEN len(regexp_extract_all(content, '([a-z]+)ing ')) = 0 THEN 'not found' END AS error, CAST(len(regexp_extract_all(content, '([a-z]+)ing ')) AS BIGINT) AS n, regexp_replace(content, '([a-z]+)ing ', '\1ED ', 'g') AS content FROM working")
_add("em_dash_normalise", lambda w: w.select("path", text.without_em_dashes(F.replace("content", F.lit(". "), F.lit(" — "))).alias("content")), "working", "SELECT path, replace(replace(replace(content, '. ', ' — '), ' — ', ', '), '—', ', ') AS content FROM working")
_add("fuzzy_files", lambda w: text.fuzzy_files(w.withColumn("path", F.concat("path", F.lit("_doc.py"))), "1dp", 20), "working", None)
_add("fetch_truncate", lambda p: p.select("page_id", text.fetched(F.col("html")).alias("shown")), "pages", "SELECT page_id, html[1:20000] AS shown FROM pages")
_add("html_text", text.html_text, "pages", None)
_add("list_dir", lambda w: text.listing(w, 2), "working", "SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS entry, CASE WHEN path LIKE '%/%/%' THEN 'directory' ELSE 'file' END AS kind FROM working")

# more of the index
_add("find_location", lambda f, c: symbols.find_location(f, c, "blue anvil").select("kind", "id", "file_id"), "functions classes", "SELECT 'function' AS kind, id, file_id FROM functions WHERE name = 'blue anvil' ORDER BY CASE WHEN parent_type = 'class' THEN 0 ELSE 1 END, id LIMIT 1")
_add(
    "implementation", lambda f, c, a, v: symbols.implementation(f, c, a, symbols.search_symbols(_kinds(f, c, v), "anvil"), "blue anvil").unionByName(symbols.implementation(f, c, a, symbols.search_symbols(_kinds(f, c, v), "zzz"), "zzz")), "functions classes files variables",
    "SELECT 'function' AS kind, array_to_string(string_split(g.content, chr(10))[f.start_line:f.end_line], chr(10)) AS text FROM (SELECT * FROM functions WHERE name = 'blue anvil' ORDER BY CASE WHEN parent_type = 'class' THEN 0 ELSE 1 END, id LIMIT 1) f JOIN files g ON g.id = f.file_id UNION ALL SELECT 'suggestions', ''",
)
_NAMES = "coalesce((SELECT list(x.name ORDER BY x.name) FROM {t} x WHERE x.{k} = {o}.id AND {w}), [])"
_OWN = _NAMES.format(t="functions", k="parent_id", o="c", w="x.parent_type = 'class'"), _NAMES.format(t="variables", k="parent_id", o="c", w="x.parent_type = 'class'")
_add(
    "export_json", symbols.export_json, "files functions classes variables",
    "WITH k AS (SELECT c.file_id, struct_pack(name := c.name, methods := " + _OWN[0] + ", variables := " + _OWN[1] + ") AS c FROM classes c), g AS (SELECT file_id, list_sort(list(c)) AS classes FROM k GROUP BY file_id) "
    "SELECT f.path, CAST(to_json(struct_pack(path := f.path, language := f.language, functions := " + _NAMES.format(t="functions", k="file_id", o="f", w="x.parent_id IS NULL") + ", classes := coalesce(g.classes, []), variables := " + _NAMES.format(t="variables", k="file_id", o="f", w="x.parent_id IS NULL") + ")) AS VARCHAR) AS document FROM files f LEFT JOIN g ON g.file_id = f.id",
)
_add(
    "call_tree_lines", lambda e, f: graph.tree_lines(e, f.select(F.col("id").alias("node")), f, 2).select("root", F.size("lines").cast("long").alias("n_lines"), F.md5(F.concat_ws("\n", F.sort_array("lines"))).alias("lines_md5")), "edges functions",
    _WALK.format(roots="SELECT id AS node FROM functions", edges="edges", depth=2, where="true")
    + ", l AS (SELECT t.root, t.node, list(DISTINCT c.name ORDER BY c.name) AS calls FROM t JOIN edges e ON e.source = t.node JOIN functions c ON c.id = e.target WHERE t.depth < 2 GROUP BY t.root, t.node) "
    "SELECT root, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY line)) AS lines_md5 FROM (SELECT t.root, CAST(json_object('name', f.name, 'depth', t.depth, 'cycle', t.cycle, 'calls', coalesce(l.calls, CAST([] AS VARCHAR[]))) AS VARCHAR) AS line FROM t JOIN functions f ON f.id = t.node LEFT JOIN l ON l.root = t.root AND l.node = t.node) GROUP BY root",
)
_add("method_calls", lambda d: _two(symbols.dependencies(d, source=12, kind="method_call")), "deps", _DEP + "source_function_id = 12 AND dependency_type = 'method_call'")
_add("class_references", lambda d: _two(symbols.dependencies(d, source=12, kind="class_reference")), "deps", _DEP + "source_function_id = 12 AND dependency_type = 'class_reference'")
_add("variable_references", lambda d: _two(symbols.dependencies(d, source=12, kind="variable_reference")), "deps", _DEP + "source_function_id = 12 AND dependency_type = 'variable_reference'")
_add("change_detection", lambda s, k: files.changes(s, k), "scanned known", "SELECT coalesce(s.path, k.path) AS path, CASE WHEN k.path IS NULL THEN 'new' WHEN s.path IS NULL THEN 'deleted' WHEN s.mtime = k.mtime THEN 'same' WHEN s.content_hash = k.content_hash THEN 'touched' ELSE 'changed' END AS change FROM scanned s FULL JOIN known k ON s.path = k.path")
_add("deleted_files", lambda s, k: files.changes(s, k).filter("change = 'deleted'").select("path"), "scanned known", "SELECT path FROM known WHERE path NOT IN (SELECT path FROM scanned)")
# more of sessions and snapshots
_add("load_messages", lambda m: sessions.load_messages(m.select("session_id", F.col("turn").alias("id"), F.col("turn").alias("timestamp"), F.col("text").alias("content"), F.lit(None).cast("string").alias("tool_calls"), F.lit(None).cast("string").alias("tool_call_id")), 3).select("id", "content"), "messages", "SELECT turn AS id, text AS content FROM messages WHERE session_id = 3 AND text <> ''")
_add("latest_session", sessions.latest_root, "sessions", "SELECT chat_id, max(id) AS id FROM sessions WHERE parent_session_id IS NULL GROUP BY chat_id")
_add("old_sessions", sessions.old_roots, "sessions", "SELECT chat_id, id FROM sessions s WHERE parent_session_id IS NULL AND id < (SELECT max(id) FROM sessions t WHERE t.chat_id = s.chat_id AND t.parent_session_id IS NULL)")
_add("child_sessions", lambda s: sessions.children(s, 8).select("id", "chat_id"), "sessions", "SELECT id, chat_id FROM sessions WHERE parent_session_id = 8")
_add(
    "root_session", lambda s: graph.chain_ends(s.select("id", F.col("parent_session_id").alias("next"))).select("id", F.col("last").alias("root"), F.col("hops").alias("depth")), "sessions",
    "WITH w AS (SELECT id, id AS root, parent_session_id AS up, 0 AS depth FROM sessions UNION ALL SELECT w.id, s.id, s.parent_session_id, w.depth + 1 FROM w JOIN sessions s ON s.id = w.up) SELECT id, root, CAST(depth AS BIGINT) AS depth FROM w WHERE up IS NULL",
)
_add("todo_text", sessions.render_list, "tasks", "SELECT list_id, string_agg((order_index + 1) || '. [' || status || '] ' || goal, chr(10) ORDER BY order_index, id, status, goal) AS text FROM tasks GROUP BY list_id")
_add("migrated_lists", lambda t: sessions.migrated(t, 7, 8).groupBy("session_id").agg(F.count("*").alias("n")), "lists", "SELECT CASE WHEN session_id = 7 THEN 8 ELSE session_id END AS session_id, count(*) AS n FROM lists GROUP BY 1")
_add("changes_by_session", lambda c: c.filter("session_id = 5").orderBy("timestamp", "id").select("id", "change_type"), "changes", "SELECT id, change_type FROM changes WHERE session_id = 5")
_add(
    "commit_log", lambda c: graph.chain_members(c.select("id", F.col("parent").alias("next")), c.select("id")).select("start", "id", F.col("hop").cast("long").alias("hop")), "commits",
    "WITH w AS (SELECT id AS start, id, parent, 0 AS hop FROM commits UNION ALL SELECT w.start, c.id, c.parent, w.hop + 1 FROM w JOIN commits c ON c.id = w.parent) SELECT start, id, CAST(hop AS BIGINT) AS hop FROM w",
)
_add("undo_heads", lambda c: snapshots.moved_head(c, c.groupBy(F.col("o_custkey").alias("id")).agg(F.max("id").alias("head"))), "commits", "SELECT o_custkey AS id, coalesce(arg_max(parent, id), max(id)) AS head FROM commits GROUP BY o_custkey")
_add("new_blobs", lambda w, s: snapshots.new_blobs(w, _ids(s)).select("blob_id"), "working snapshot", f"SELECT DISTINCT {_BLOB} AS blob_id FROM working WHERE content NOT IN (SELECT content FROM snapshot)")

# an index that follows versions, in batches whose order isn't that of the versions
def _reindexed(versions: DataFrame) -> DataFrame:
    index = reindex.Index(versions.sparkSession, folder(versions.sparkSession, "index"))
    for k in range(4):
        index.apply(versions.filter(F.pmod(F.xxhash64("seq"), F.lit(4)) == k), k)
    return index.resolved()


_add(
    "reindexed_calls", _reindexed, "file_versions",
    "WITH f AS (SELECT * FROM (SELECT * FROM file_versions QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1) WHERE NOT deleted), d AS (SELECT DISTINCT path, unnest(definitions) AS name FROM f), c AS (SELECT DISTINCT path, unnest(calls) AS name FROM f), b AS (SELECT name, min(path) AS anywhere FROM d GROUP BY name) "
    "SELECT c.path, c.name, CASE WHEN d.path IS NOT NULL THEN c.path ELSE b.anywhere END AS target FROM c LEFT JOIN d ON d.path = c.path AND d.name = c.name LEFT JOIN b ON b.name = c.name",
)
# commits, undos and redos as a log
_REPLAY = (
    "WITH o AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY seq) AS n FROM log_operations), w AS (SELECT repo, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS seq, false AS done, CAST([] AS BIGINT[]) AS log, CAST([] AS BIGINT[]) AS stack FROM (SELECT DISTINCT repo FROM o) UNION ALL "
    "SELECT o.repo, o.n, o.seq, kind = 'commit' OR (kind = 'undo' AND len(log) > 1) OR (kind = 'redo' AND len(stack) > 0), "
    "CASE WHEN kind = 'commit' THEN list_append(log, o.seq) WHEN kind = 'undo' AND len(log) > 1 THEN log[1:len(log) - 1] WHEN kind = 'redo' AND len(stack) > 0 THEN list_append(log, stack[len(stack)]) ELSE log END, "
    "CASE WHEN kind = 'commit' THEN CAST([] AS BIGINT[]) WHEN kind = 'undo' AND len(log) > 1 THEN list_append(stack, log[len(log)]) WHEN kind = 'redo' AND len(stack) > 0 THEN stack[1:len(stack) - 1] ELSE stack END FROM w JOIN o ON o.repo = w.repo AND o.n = w.n + 1) "
)
_add("heads_after", lambda o: snapshots.heads(o).select("repo", "seq", "done", "depth", "undone", "head"), "log_operations", _REPLAY + "SELECT repo, seq, done, CAST(len(log) AS BIGINT) AS depth, CAST(len(stack) AS BIGINT) AS undone, log[len(log)] AS head FROM w WHERE n > 0")
_add(
    "log_and_redo_stack", snapshots.lineage, "log_operations",
    _REPLAY + ", e AS (SELECT repo, arg_max(log, n) AS log, arg_max(stack, n) AS stack FROM w GROUP BY repo), a AS (SELECT repo, len(log) AS depth, list_concat(log, list_reverse(stack)) AS every FROM e) SELECT repo, position, every[position] AS commit, position > depth AS undone FROM (SELECT *, unnest(range(1, CAST(len(every) + 1 AS BIGINT))) AS position FROM a)",
)
# sessions cut again and again where few tokens are left
_add(
    "handover_parts", lambda n: sessions.handovers(n, 60_000), "notes",
    "WITH o AS (SELECT session_id, turn, coalesce(length(text), 0) AS chars, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS n FROM notes), w AS (SELECT session_id, turn, n, CAST(0 AS BIGINT) AS part, CAST(chars AS BIGINT) AS chars, (60000 - chars // 4) < 50000 AS cut FROM o WHERE n = 1 UNION ALL "
    "SELECT o.session_id, o.turn, o.n, w.part + CASE WHEN w.cut THEN 1 ELSE 0 END, CASE WHEN w.cut THEN 0 ELSE w.chars END + o.chars, (60000 - (CASE WHEN w.cut THEN 0 ELSE w.chars END + o.chars) // 4) < 50000 FROM w JOIN o ON o.session_id = w.session_id AND o.n = w.n + 1) SELECT session_id, turn, part, CAST(chars // 4 AS BIGINT) AS tokens, cut FROM w",
)
_add(
    "edited_lists", sessions.edited_lists, "first_tasks list_edits",
    "WITH o AS (SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY seq) AS n FROM list_edits), h AS (SELECT list_id, list(CAST(order_index AS BIGINT) ORDER BY order_index) AS i, list(goal ORDER BY order_index) AS g FROM first_tasks GROUP BY list_id), "
    "w AS (SELECT coalesce(h.list_id, e.list_id) AS list_id, CAST(0 AS BIGINT) AS n, coalesce(i, CAST([] AS BIGINT[])) AS i, coalesce(g, CAST([] AS VARCHAR[])) AS g FROM h FULL JOIN (SELECT DISTINCT list_id FROM o) e ON e.list_id = h.list_id UNION ALL "
    "SELECT list_id, n, CASE WHEN op = 'insert' THEN CASE WHEN after IS NULL OR a >= len(i) THEN list_append(i, coalesce(i[len(i)] + 1, 0)) WHEN a = 0 THEN list_concat([i[1]], list_transform(i, lambda x: x + 1)) ELSE list_concat(i[1:a], [i[a] + 1], list_transform(i[a + 1:], lambda x: x + 1)) END WHEN op = 'cancel' AND after BETWEEN 1 AND len(i) THEN list_concat(i[1:a - 1], i[a + 1:]) ELSE i END, "
    "CASE WHEN op = 'insert' THEN CASE WHEN after IS NULL OR a >= len(i) THEN list_append(g, goal) ELSE list_concat(g[1:a], [goal], g[a + 1:]) END WHEN op = 'cancel' AND after BETWEEN 1 AND len(i) THEN list_concat(g[1:a - 1], g[a + 1:]) ELSE g END FROM (SELECT o.list_id, o.n, op, goal, after, greatest(after, 0) AS a, i, g FROM w JOIN o ON o.list_id = w.list_id AND o.n = w.n + 1)) "
    "SELECT list_id, unnest(i) AS order_index, unnest(g) AS goal FROM (SELECT list_id, arg_max(i, n) AS i, arg_max(g, n) AS g FROM w GROUP BY list_id)",
)
# the store as it was
_held = lambda log, gone: history.cascaded(history.intervals(log, "id"), "chat_id", gone)
_moments = lambda log: log.agg(F.max("seq").alias("m")).select(F.explode(F.array(F.floor(F.col("m") / 4), F.floor(F.col("m") / 2), F.col("m"))).alias("moment"))
_STATE = "SELECT m.moment, l.* FROM (SELECT unnest([max(seq) // 4, max(seq) // 2, max(seq)]) AS moment FROM session_log) m JOIN session_log l ON l.seq <= m.moment QUALIFY row_number() OVER (PARTITION BY m.moment, l.id ORDER BY l.seq DESC) = 1"
_HOLDS = f"SELECT s.* FROM ({_STATE}) s WHERE NOT deleted AND NOT EXISTS (SELECT 1 FROM chat_deletions d WHERE d.chat_id = s.chat_id AND d.seq > s.seq AND d.seq <= s.moment)"
_add("store_at_moments", lambda log, gone: history.at_moments(_held(log, gone), _moments(log)).select("moment", "id", "chat_id", "redirect", "title"), "session_log chat_deletions", f"SELECT moment, id, chat_id, redirect, title FROM ({_HOLDS})")
_add(
    "validity_intervals", lambda log, gone: _held(log, gone).select("id", "title", "valid_from", "valid_to"), "session_log chat_deletions",
    "SELECT id, title, seq AS valid_from, least(until, coalesce((SELECT min(d.seq) FROM chat_deletions d WHERE d.chat_id = l.chat_id AND d.seq > l.seq), 9223372036854775807)) AS valid_to FROM (SELECT *, coalesce(lead(seq) OVER (PARTITION BY id ORDER BY seq), 9223372036854775807) AS until FROM session_log) l WHERE NOT deleted",
)
_add(
    "redirects_as_of", lambda log, gone: history.redirected(_held(log, gone), log.agg(F.floor(F.max("seq") / 2)).first()[0] or 0), "session_log chat_deletions",
    f"WITH s AS MATERIALIZED (SELECT * FROM ({_HOLDS}) WHERE moment = (SELECT max(seq) // 2 FROM session_log)), w AS (SELECT id AS asked, id, 0 AS hop FROM s UNION ALL SELECT w.asked, s.redirect, hop + 1 FROM w JOIN s ON s.id = w.id WHERE s.redirect IS NOT NULL) SELECT asked AS id, arg_max(id, hop) AS active FROM w GROUP BY asked",
)

# reports on whole files
_with_parameters = lambda f: f.withColumn("parameters", F.array(F.struct(F.col("argument").alias("name"), F.col("argument_type").alias("type"))))
_graphs = lambda a, f, c, v, d, n: reports.dependency_graphs(a, _with_parameters(f), c, v, d, n)
_AT = "{{'s': {}, 'n': {}, 'i': {}}}"
_at = lambda section, name="''", ident="''": _AT.format(section, name, f"CAST({ident} AS VARCHAR)")
_described = lambda x, label="": f"CASE WHEN coalesce({x}, '') <> '' THEN '  # {label}' || {x} ELSE '' END"
_typed = lambda x: f"CASE WHEN coalesce({x}, '') <> '' THEN ' : ' || {x} ELSE '' END"
_CALL = "name || '(' || argument || coalesce(': ' || argument_type, '') || ')'"
_HERE = """ || ' in file "' || path || '"'"""
_SOME = "(SELECT arg_min(g.path, t.id) FROM {} t JOIN files g ON g.id = t.file_id WHERE {})"
_TOLD = (
    "told AS MATERIALIZED (SELECT * FROM (SELECT function_id, kind, name, CASE kind WHEN 0 THEN '- function ' || name || '()' WHEN 1 THEN '- method ' || name || '()' WHEN 2 THEN '- class ' || name ELSE '- variable ' || name END || ' in file \"' || p || '\"' AS text, p FROM (SELECT *, CASE kind "
    "WHEN 0 THEN " + _SOME.format("report_functions", "t.name = d.name") + " WHEN 1 THEN " + _SOME.format("report_functions", "t.parent_type = 'class' AND t.name = regexp_replace(d.name, '^.*[.]', '')")
    + " WHEN 2 THEN " + _SOME.format("report_classes", "t.name = d.name") + " ELSE " + _SOME.format("report_variables", "t.name = d.name")
    + " END AS p FROM (SELECT DISTINCT source_function_id AS function_id, CASE dependency_type WHEN 'function_call' THEN 0 WHEN 'method_call' THEN 1 WHEN 'class_reference' THEN 2 WHEN 'variable_reference' THEN 3 END AS kind, name FROM report_deps WHERE dependency_type <> 'import' AND source_function_id IS NOT NULL AND NOT " + _LITERAL + ") d)) WHERE p IS NOT NULL)"
)


def _depending(owners: str, indent: str) -> str:
    return (
        f"SELECT file_id, list_append(place, {_at(0)}), '{indent}depending on:' FROM {owners} UNION ALL SELECT file_id, list_append(place, {_at(1, "CAST(kind AS VARCHAR) || ' ' || t.name")}), '{indent}  ' || t.text FROM {owners} o JOIN told t ON t.function_id = o.owner "
        f"UNION ALL SELECT file_id, list_append(place, {_at(1)}), '{indent}  NONE' FROM {owners} o WHERE owner NOT IN (SELECT function_id FROM told)"
    )


def _members(owners: str, own: str, indent: str) -> str:
    return (
        f"SELECT file_id, place, '{indent}- method ' || {_CALL} || {_described('description')} || ':' FROM {own} UNION ALL {_depending(own, indent + '     ')} "
        f"UNION ALL SELECT o.file_id, list_append(o.place, {_at(2, 'v.name', 'v.id')}), '{indent}- variable ' || v.name || {_typed('v.field_type')} || {_described('v.description')} FROM {owners} o JOIN report_variables v ON v.parent_type = 'class' AND v.parent_id = o.owner "
        f"UNION ALL SELECT file_id, list_append(place, {_at(1)}), '{indent}  NONE' FROM {owners} WHERE owner NOT IN (SELECT parent_id FROM report_functions WHERE parent_type = 'class' UNION SELECT parent_id FROM report_variables WHERE parent_type = 'class')"
    )


_methods_of = lambda owners: f"SELECT o.file_id, f.id AS owner, list_append(o.place, {_at(1, 'f.name', 'f.id')}) AS place, f.name, f.argument, f.argument_type, f.description FROM {owners} o JOIN report_functions f ON f.parent_type = 'class' AND f.parent_id = o.owner"
_GRAPH = (
    f"WITH {_TOLD}, p AS (SELECT id AS file_id, path FROM files), fn AS (SELECT f.*, p.path, f.id AS owner, [{_at(1, 'name', 'f.id')}] AS place FROM report_functions f JOIN p USING (file_id) WHERE parent_id IS NULL), "
    f"inner_class AS (SELECT c.file_id, c.id AS owner, c.name, c.description, list_append(fn.place, {_at(3, 'c.name', 'c.id')}) AS place, fn.place AS above FROM report_classes c JOIN fn ON fn.id = c.parent_id AND fn.file_id = c.file_id), "
    f"outer_class AS (SELECT c.*, p.path, c.id AS owner, [{_at(5, 'name', 'c.id')}] AS place FROM report_classes c JOIN p USING (file_id) WHERE parent_id IS NULL), inner_method AS ({_methods_of('inner_class')}), outer_method AS ({_methods_of('outer_class')}), "
    f"""lines(file_id, place, text) AS (SELECT file_id, [{_at(0)}], 'file "' || path || '":' FROM p UNION ALL SELECT file_id, place, '  - function ' || {_CALL}{_HERE} || {_described('description')} FROM fn UNION ALL {_depending('fn', '     ')} """
    f"UNION ALL SELECT DISTINCT file_id, list_append(above, {_at(2)}), '     contains:' FROM inner_class UNION ALL SELECT file_id, place, '       - class ' || name || {_described('description')} || ':' FROM inner_class UNION ALL SELECT file_id, list_append(place, {_at(0)}), '           members:' FROM inner_class UNION ALL {_members('inner_class', 'inner_method', '             ')} "
    f"UNION ALL SELECT v.file_id, [{_at(2, 'name', 'id')}], '  - variable ' || name || {_typed('field_type')}{_HERE} || {_described('description')} FROM (SELECT * FROM report_variables WHERE parent_id IS NULL QUALIFY row_number() OVER (PARTITION BY file_id, name ORDER BY id) = 1) v JOIN p USING (file_id) "
    f"UNION ALL SELECT d.file_id, [{_at(3, 'name', 'id')}], '  - imported ' || name{_HERE} FROM report_deps d JOIN p USING (file_id) WHERE dependency_type = 'import' UNION ALL SELECT n.file_id, [{_at(4, 'name', 'id')}], '  - namespace ' || name{_HERE} FROM namespaces n JOIN p USING (file_id) "
    f"UNION ALL SELECT file_id, place, '  - class ' || name{_HERE} || {_described('description')} || {_described('namespace', 'namespace: ')} || ':' FROM outer_class UNION ALL SELECT file_id, list_append(place, {_at(0)}), '      members:' FROM outer_class UNION ALL {_members('outer_class', 'outer_method', '        ')}), "
    "graphs AS (SELECT p.file_id, p.path, string_agg(text, chr(10) ORDER BY place) AS report FROM lines JOIN p USING (file_id) GROUP BY p.file_id, p.path) "
)
_add("dependency_graphs", lambda *t: _graphs(*t).select("path", "report"), "files report_functions report_classes report_variables report_deps namespaces", _GRAPH + "SELECT path, report FROM graphs")
_bodies = lambda table, title: f"(SELECT t.file_id, chr(10) || '## {title} Bodies' || string_agg(chr(10) || '### ' || t.name || chr(10) || CASE WHEN coalesce(t.description, '') <> '' THEN '# Description: ' || t.description || chr(10) || chr(10) ELSE '' END || array_to_string(string_split(g.content, chr(10))[t.start_line:t.end_line], chr(10)), '' ORDER BY t.name, t.id) AS text FROM {table} t JOIN files g ON g.id = t.file_id WHERE t.parent_id IS NULL GROUP BY t.file_id)"
_add(
    "explore_structures", lambda a, f, c, v, d, n: reports.explored(a, _with_parameters(f), c, v, d, n).select("path", F.length("report").cast("long").alias("n_chars"), F.md5("report").alias("report_md5")), "files report_functions report_classes report_variables report_deps namespaces",
    _GRAPH + f"SELECT path, CAST(length(r) AS BIGINT) AS n_chars, md5(r) AS report_md5 FROM (SELECT path, report || CASE WHEN f.text IS NOT NULL OR c.text IS NOT NULL THEN chr(10) ELSE '' END || coalesce(f.text, '') || coalesce(c.text, '') AS r FROM graphs LEFT JOIN {_bodies('report_functions', 'Function')} f USING (file_id) LEFT JOIN {_bodies('report_classes', 'Class')} c USING (file_id))",
)
# stored JSON
_VALID = "(json_type({0}) = 'OBJECT' AND " + " AND ".join("json_extract_string({0}, '$." + k + "') IS NOT NULL" for k in decode.PLACE) + ")"
_LOC = lambda x: ", ".join(f"CAST(json_extract_string({x}, '$.{k}') AS INTEGER) AS {k}" for k in (*decode.PLACE, *decode.BYTES))
_READ = (
    f"SELECT s.*, g.path AS file_path, coalesce({_VALID.format('v')}, false) AS there, coalesce(json_type(w) = 'ARRAY', false) AS listed FROM "
    "(SELECT *, CASE WHEN json_valid(location) THEN location END AS v, CASE WHEN json_valid(parameters) THEN parameters END AS w FROM stored_functions) s JOIN files g ON g.id = s.file_id"
)
_place = lambda c: [F.col(f"location.{k}").alias(k) for k in (*decode.PLACE, *decode.BYTES)]
_add(
    "typed_functions", lambda s, a: decode.symbols(s, a, ("parameters",))[0].select("id", "file_path", *_place("location"), symbols.format_parameters(F.col("parameters")).alias("parameters"), F.col("branch_count").cast("long").alias("branch_count")), "stored_functions files",
    f"SELECT id, file_path, {_LOC('v')}, coalesce((SELECT string_agg(CASE WHEN json_type(x) = 'VARCHAR' THEN json_extract_string(x, '$') ELSE json_extract_string(x, '$.name') || coalesce(': ' || json_extract_string(x, '$.type'), '') END, ', ' ORDER BY n) FROM (SELECT unnest(CAST(w AS JSON[])) AS x, generate_subscripts(CAST(w AS JSON[]), 1) AS n)), '') AS parameters, CAST(coalesce(branch_count, 0) AS BIGINT) AS branch_count "
    f"FROM (SELECT * FROM ({_READ}) WHERE there AND listed)",
)
_add("unread_functions", lambda s, a: decode.symbols(s, a, ("parameters",))[1].select("id", "location", "reason"), "stored_functions files", f"SELECT id, location, CASE WHEN NOT there THEN 'location' ELSE 'parameters' END AS reason FROM ({_READ}) WHERE NOT there OR NOT listed")
_add(
    "typed_dependencies", lambda d, a: decode.dependencies(d, a)[0].select("id", "file_path", *_place("location"), "is_external"), "stored_deps files",
    f"SELECT d.id, g.path AS file_path, {_LOC('v')}, coalesce(is_external <> 0, true) AS is_external FROM (SELECT *, CASE WHEN json_valid(location) THEN location END AS v FROM stored_deps) d JOIN files g ON g.id = d.file_id WHERE coalesce(location, '') = '' OR coalesce({_VALID.format('v')}, false)",
)
# edits and searches with what stands around
_add(
    "edit_symbol", lambda a, f, c: text.edit_symbol(a, symbols.find_location(f, c, "blue anvil").withColumns({"start_line": F.lit(2), "end_line": F.lit(3)}), "new\nlines\nhere"), "files functions classes",
    "SELECT path, array_to_string(list_concat(l[1:1], ['new', 'lines', 'here'], l[4:]), chr(10)) AS content, array_to_string(list_concat(['@@ ' || path || ':2-3 (' || len(l[2:3]) || ' lines -> 3 lines) @@', '    ' || l[1]], list_transform(l[2:3], lambda x: '  - ' || x), ['  + new', '  + lines', '  + here'], list_transform(l[4:8], lambda x: '    ' || x)), chr(10)) AS report "
    "FROM (SELECT path, string_split(content, chr(10)) AS l FROM files WHERE id = (SELECT arg_min(file_id, CASE WHEN parent_type = 'class' THEN id ELSE id + 1000000000 END) FROM functions WHERE name = 'blue anvil'))",
)
_add(
    "grep_context", lambda a: text.grep_context(a, "!!", 2).select("path", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "text"), "files",
    "WITH l AS (SELECT path, string_split(content, chr(10)) AS l FROM files), h AS (SELECT path, l, unnest(range(1, CAST(len(l) + 1 AS BIGINT))) AS n FROM l), m AS (SELECT path, l, n, CASE WHEN n - lag(n) OVER (PARTITION BY path ORDER BY n) <= 5 THEN 0 ELSE 1 END AS apart FROM h WHERE contains(l[n], '!!')), "
    "i AS (SELECT path, any_value(l) AS l, greatest(min(n) - 2, 1) AS first, least(max(n) + 2, any_value(len(l))) AS last FROM (SELECT *, sum(apart) OVER (PARTITION BY path ORDER BY n) AS island FROM m) GROUP BY path, island) SELECT path, first, last, array_to_string(l[first:last], chr(10)) AS text FROM i",
)

# imports against the tree
_hit = lambda *paths: "(" + " OR ".join(f"EXISTS (SELECT 1 FROM every e WHERE e.place = {p})" for p in paths) + ")"
_part = lambda pattern: f"regexp_extract(name, '{pattern}', 1)"
_slashed = lambda pattern: f"replace({_part(pattern)}, '.', '/')"
_INSIDE = _part('"(.*)"')
_INTERNAL = (
    f"CASE language WHEN 'python' THEN EXISTS (SELECT 1 FROM every e WHERE e.is_dir AND e.place = {_part('^(?:from|import) ([^. ]+)')}) "
    f"""WHEN 'go' THEN starts_with(name, '.') OR {_hit(_part('([^/"]+)"?$'))} WHEN 'typescript' THEN contains(name, '"./') OR {_hit(_INSIDE, _INSIDE + " || '.ts'")} WHEN 'javascript' THEN false """
    f"""WHEN 'rust' THEN contains(name, 'crate::') WHEN 'cpp' THEN contains(name, '"') WHEN 'csharp' THEN NOT starts_with(name, 'using System') AND {_hit(_slashed('^using (.*);'))} """
    f"""WHEN 'php' THEN CASE WHEN starts_with(name, 'use ') THEN NOT starts_with(name, 'use Symfony') AND {_hit(_part('^use (.*);'))} ELSE contains(name, '"./') OR {_hit(_INSIDE)} END """
    f"""WHEN 'dart' THEN NOT contains(name, 'package:') AND {_hit(_INSIDE)} WHEN 'java' THEN {_hit(_slashed('^import (.*);') + " || '.java'")} WHEN 'kotlin' THEN {_hit(_slashed('^import (.*)$') + " || '.kt'")} """
    f"""WHEN 'zig' THEN NOT contains(name, '"std') AND {_hit(_INSIDE)} WHEN 'elixir' THEN {_hit("'lib/my_app/' || lower(" + _part('^MyApp.(.*)$') + ") || '.ex'")} ELSE false END"""
)
_add(
    "resolved_imports", lambda i, f: imports.resolved(i, imports.tree(f)).select("id", "language", "name", "external"), "import_rows tree_files",
    f"WITH every AS MATERIALIZED (SELECT DISTINCT path AS place, false AS is_dir FROM tree_files UNION SELECT array_to_string(list_slice(p, 1, n), '/'), true FROM (SELECT p, unnest(range(1, len(p))) AS n FROM (SELECT string_split(path, '/') AS p FROM tree_files))) SELECT id, language, name, NOT ({_INTERNAL}) AS external FROM import_rows",
)


# symbols from the text of files that are made of parts: what comes back are the parts
def _made(part: DataFrame, indented: bool) -> DataFrame:
    """(path, content): a file for each 200th part, with a class that has a function for each of its parts."""
    body, stop = (":", "") if indented else (" {", "\n  }")
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_partkey").cast("string"))
    branches = F.repeat(F.lit("\n    if x: y('}')  # for" if indented else '\n    if (x) { y("}"); } // while {'), (F.col("p_size") % 3).cast("int"))
    inner = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("\n    class " if indented else "\n    struct "), F.lit("In_"), name, F.lit(f"{body}\n      pass" if indented else f"{body}\n    }}"))).otherwise("")
    text = F.concat(F.lit("  def " if indented else "  func "), name, F.lit(f"(a){body}"), branches, inner, F.lit("\n    pass" if indented else ""), F.lit(stop))
    each = part.groupBy((F.col("p_partkey") % 200).alias("f")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", text.alias("t")))), lambda x: x["t"]), "\n").alias("t"))
    head = F.concat(F.lit("# class No:\nclass C" if indented else "// class No {\nclass C"), F.col("f").cast("string"), F.lit(f"{body}\n"))
    return each.select(F.concat(F.lit("src/"), F.col("f").cast("string")).alias("path"), F.concat(head, "t", F.lit("" if indented else "\n}")).alias("content"))


_NESTED = (
    "WITH p AS (SELECT p_partkey % 200 AS f, replace(p_name, ' ', '_') || '_' || p_partkey AS name, p_size % 3 AS b, p_size % 5 = 0 AS deep, 2 + p_size % 3 + CASE WHEN p_size % 5 = 0 THEN 2 ELSE 0 END AS size, p_partkey FROM part), "
    "q AS (SELECT *, 3 + coalesce(sum(size) OVER (PARTITION BY f ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM p) "
    "SELECT 'src/' || f AS path, 'function' AS kind, name, CAST(first AS BIGINT) AS first, CAST(first + size - 1 AS BIGINT) AS last, 'C' || f AS owner, 'class' AS owner_kind, CAST(b AS BIGINT) AS branches FROM q "
    "UNION ALL SELECT 'src/' || f, '{inner}', 'In_' || name, CAST(first + 1 + b AS BIGINT), CAST(first + 2 + b AS BIGINT), name, 'function', 0 FROM q WHERE deep UNION ALL SELECT 'src/' || f, 'class', 'C' || f, 2, CAST(max(first + size - 1) + {end} AS BIGINT), NULL, NULL, CAST(sum(b) AS BIGINT) FROM q GROUP BY f"
)
_whole_numbers = lambda t: t.select("path", "kind", "name", *(F.col(c).cast("long").alias(c) for c in ("first", "last")), "owner", "owner_kind", F.col("branches").cast("long").alias("branches"))
_add("nested_in_braces", lambda p: _whole_numbers(nesting.nested(_made(p, False), False)), "part", _NESTED.format(inner="struct", end=1))
_add("nested_by_indent", lambda p: _whole_numbers(nesting.nested(_made(p, True), True)), "part", _NESTED.format(inner="class", end=0))

# the store's tables from its log
def _logged(t: DataFrame) -> DataFrame:
    said = {"role": "role", "title": "title", "redirect_session_id": "redirect", "effort": "effort", "tool_calls": "tool_calls"}
    fields = F.map_filter(F.create_map(*(x for k, c in said.items() for x in (F.lit(k), F.col(c)))), lambda k, v: v.isNotNull())
    return t.select("seq", "op", "entity", "id", "parent", fields.alias("fields"))


_half = lambda t: t.agg(F.floor(F.max("seq") / 2)).first()[0] or 0
_ALIVE = (
    "l AS (SELECT * FROM store_operations WHERE seq <= (SELECT max(seq) // 2 FROM store_operations)), made AS (SELECT entity, id, parent, seq FROM l WHERE op = 'create'), gone AS (SELECT entity, id FROM l JOIN made m USING (entity, id) WHERE op = 'delete' AND l.seq > m.seq), "
    "c AS (SELECT * FROM made WHERE entity = 'chats' AND id NOT IN (SELECT id FROM gone WHERE entity = 'chats')), s AS (SELECT * FROM made WHERE entity = 'sessions' AND id NOT IN (SELECT id FROM gone WHERE entity = 'sessions') AND parent IN (SELECT id FROM c)), m AS (SELECT * FROM made WHERE entity = 'messages' AND parent IN (SELECT id FROM s)) "
)
_said = lambda f: f"arg_max(l.{f}, l.seq) FILTER (l.{f} IS NOT NULL) AS {f}"
_ROWS = "(SELECT x.id, x.parent, x.seq, max(l.seq) AS last, {} FROM {} x JOIN l ON l.entity = x.entity AND l.id = x.id AND l.op <> 'delete' AND l.seq >= x.seq GROUP BY ALL)"
_add(
    "store_chats", lambda t: store.table(_logged(t), "chats", _half(t)).select("id", "role", "title", "created_at", "updated_at"), "store_operations",
    f"WITH {_ALIVE} SELECT r.id, role, coalesce(title, role) AS title, r.seq AS created_at, greatest(last, coalesce((SELECT max(k.seq) FROM made k JOIN made z ON z.entity = 'sessions' AND z.id = k.parent WHERE k.entity = 'messages' AND z.parent = r.id AND NOT EXISTS (SELECT 1 FROM l d WHERE d.op = 'delete' AND d.entity = 'sessions' AND d.id = z.id AND d.seq BETWEEN z.seq AND k.seq)), 0)) AS updated_at FROM {_ROWS.format(_said('role') + ', ' + _said('title'), 'c')} r",
)
_add(
    "store_sessions", lambda t: store.table(_logged(t), "sessions", _half(t)).select("id", "parent", F.col("redirect_session_id").alias("redirect"), "effort", "depth", "created_at", "updated_at"), "store_operations",
    f"WITH {_ALIVE} SELECT r.id, r.parent, redirect, effort, '0' AS depth, r.seq AS created_at, greatest(last, coalesce((SELECT max(k.seq) FROM made k WHERE k.entity = 'messages' AND k.parent = r.id), 0)) AS updated_at FROM {_ROWS.format(_said('redirect') + ', ' + _said('effort'), 's')} r",
)
_add("store_messages", lambda t: store.table(_logged(t), "messages", _half(t)).select("id", "parent", "role", "tool_calls", "updated_at"), "store_operations", f"WITH {_ALIVE} SELECT r.id, r.parent, role, tool_calls, last AS updated_at FROM {_ROWS.format(_said('role') + ', ' + _said('tool_calls'), 'm')} r")
_add(
    "store_dangling", lambda t: store.dangling(store.table(_logged(t), "messages", _half(t))), "store_operations",
    f"WITH {_ALIVE} SELECT session_id, role = 'tool' OR (role = 'assistant' AND calls) AS dangling FROM (SELECT r.parent AS session_id, arg_max(role, r.id) AS role, arg_max(tool_calls IS NOT NULL, r.id) AS calls FROM {_ROWS.format(_said('role') + ', ' + _said('tool_calls'), 'm')} r GROUP BY r.parent)",
)
_add(
    "store_active_sessions", lambda t: store.active_sessions(_logged(t), _half(t)), "store_operations",
    f"WITH {_ALIVE}, r AS MATERIALIZED {_ROWS.format(_said('redirect'), 's')}, w AS (SELECT parent AS chat_id, max(id) AS id, 0 AS hop FROM r GROUP BY parent UNION ALL SELECT w.chat_id, CAST(r.redirect AS BIGINT), hop + 1 FROM w JOIN r ON r.id = w.id WHERE r.redirect IS NOT NULL) SELECT chat_id, arg_max(id, hop) AS session_id FROM w GROUP BY chat_id",
)

# the other kinds of symbols
for _kind in ("type_aliases", "structs", "interfaces", "enums", "namespaces"):
    _letter = "a" if _kind == "type_aliases" else "r"
    _add(f"{_kind}_by_name", lambda t, x=_letter: _pick(symbols.search(t, x)), _kind, f"SELECT {SYMBOL} FROM {_kind} WHERE name ILIKE '%{_letter}%'")
    _add(f"{_kind}_by_id", lambda t: _pick(symbols.by_id(t, 3)), _kind, f"SELECT {SYMBOL} FROM {_kind} WHERE id = 3")
    _add(f"{_kind}_with_path", lambda t, a: symbols.with_path(t, a).select("id", "name", "file_path"), f"{_kind} files", f"SELECT t.id, t.name, g.path AS file_path FROM {_kind} t JOIN files g ON g.id = t.file_id")
    _add(
        f"{_kind}_described", lambda t, k=_kind: symbols.describe(t, t.select(F.lit(k).alias("kind"), F.col("id").alias("symbol_id"), F.concat(F.lit("a "), "name").alias("description"), F.col("id").cast("long").alias("seq")).filter("symbol_id % 2 = 0"), k).select("id", "description"), _kind,
        f"SELECT id, CASE WHEN id % 2 = 0 THEN 'a ' || name ELSE description END AS description FROM {_kind}",
    )
_add("undocumented_kinds", lambda *t: symbols.undocumented(dict(zip(("type_alias", "struct", "interface", "enum", "namespace"), t))), "type_aliases structs interfaces enums namespaces", " UNION ALL ".join(f"SELECT '{k}' AS kind, name, count(*) AS n FROM {t} WHERE coalesce(description, '') = '' GROUP BY name" for k, t in (("type_alias", "type_aliases"), ("struct", "structs"), ("interface", "interfaces"), ("enum", "enums"), ("namespace", "namespaces"))))
# calls that run a class's init method; deleted files
_add(
    "call_functions", lambda d, f, c, v: symbols.call_functions(symbols.resolve(d, f, c, v), f, "blue anvil"), "deps functions classes variables",
    "SELECT t.id, t.dependency_type, CASE t.kind WHEN 'function' THEN t.sid WHEN 'class' THEN (SELECT min(f.id) FROM functions f WHERE f.name = 'blue anvil' AND f.parent_type = 'class' AND f.parent_id = t.sid) END AS function_id FROM (SELECT d.id, d.dependency_type, t.kind, t.sid FROM " + _WANTED + " d LEFT JOIN (SELECT 0 AS o, 'function' AS kind, id AS sid, file_id, name, parent_type FROM functions UNION ALL SELECT 1, 'class', id, file_id, name, NULL FROM classes) t ON t.name = d.wanted AND "
    "((d.dependency_type = 'function_call' AND t.o < 2) OR (d.dependency_type = 'method_call' AND (t.o = 1 OR (t.o = 0 AND t.parent_type = 'class'))) OR (d.dependency_type = 'class_reference' AND t.o = 1)) "
    "WHERE d.dependency_type IN ('function_call', 'method_call', 'class_reference') QUALIFY row_number() OVER (PARTITION BY d.id ORDER BY t.o NULLS LAST, CASE WHEN t.file_id = d.file_id THEN 0 ELSE 1 END, t.sid) = 1) t",
)
_GONE = "(SELECT id FROM files WHERE language = 'fr')"
_add(
    "removed_files", lambda a, d, f, c: symbols.remove_files({"files": a, "deps": d, "functions": f, "classes": c}, a.filter("language = 'fr'").select(F.col("id").alias("file_id")))["deps"].select("id", "target_function_id", "target_class_id"), "files deps functions classes",
    f"SELECT d.id, CASE WHEN f.file_id IN {_GONE} THEN NULL ELSE d.target_function_id END AS target_function_id, CASE WHEN c.file_id IN {_GONE} THEN NULL ELSE d.target_class_id END AS target_class_id FROM deps d LEFT JOIN functions f ON f.id = d.target_function_id LEFT JOIN classes c ON c.id = d.target_class_id WHERE d.file_id NOT IN {_GONE}",
)
_add("removed_files_left", lambda a, d, f, c: symbols.remove_files({"files": a, "deps": d, "functions": f, "classes": c}, a.filter("language = 'fr'").select(F.col("id").alias("file_id")))["functions"].select("id", "file_id"), "files deps functions classes", f"SELECT id, file_id FROM functions WHERE file_id NOT IN {_GONE}")
# the store of conversations
_chats = lambda s: s.select(F.col("chat_id").alias("id"), F.when(F.col("chat_id") % 2 == 0, "coder").otherwise("reader").alias("role")).distinct()
_add("deleted_chats", lambda s, m: sessions.without_chats(_chats(s), s, m, _chats(s).filter("role = 'coder'"))[1].select("id", "chat_id"), "sessions messages", "SELECT id, chat_id FROM sessions WHERE chat_id % 2 <> 0")
_add("deleted_messages", lambda s, m: sessions.without_chats(_chats(s), s, m, _chats(s).filter("role = 'coder'"))[2].select("session_id", "turn"), "sessions messages", "SELECT session_id, turn FROM messages WHERE session_id NOT IN (SELECT id FROM sessions WHERE chat_id % 2 = 0)")
_add("session_info", lambda s: sessions.session_info(s, _chats(s)), "sessions", "SELECT id, CASE WHEN chat_id % 2 = 0 THEN 'coder' ELSE 'reader' END AS role, parent_session_id IS NOT NULL AS is_subagent FROM sessions")
_add(
    "chain_files", lambda p, o: sessions.files_of_chain(graph.chain_members(p, p).withColumn("id", F.col("id") % 150), o), "pointers operations",
    "WITH m AS (SELECT id AS start, id FROM pointers UNION ALL SELECT m.start, p.next FROM m JOIN pointers p ON p.id = m.id WHERE p.next IS NOT NULL), u AS (SELECT DISTINCT start, id % 150 AS sid FROM m), x AS (SELECT DISTINCT session_id, file_path, operation FROM operations) "
    "SELECT start, file_path, string_agg(DISTINCT operation, ',' ORDER BY operation) AS operations FROM u JOIN x ON x.session_id = u.sid GROUP BY start, file_path",
)
_add("latest_handover", lambda c: sessions.latest_handover(c.select("session_id", "id", (F.col("id") + 1).alias("new_session_id"))), "changes", "SELECT session_id, max(id) AS id, max(id) + 1 AS new_session_id FROM changes GROUP BY session_id")
_add("update_status", lambda t: sessions.update_status(t.select(F.col("list_id").alias("id"), "status"), t.select(F.col("list_id").alias("id"), F.concat(F.lit("done by "), F.col("order_index").cast("string")).alias("status"), "order_index").groupBy("id").agg(F.max_by("status", "order_index").alias("status"), F.max("order_index").alias("seq"))).distinct(), "tasks", "SELECT list_id AS id, 'done by ' || max(order_index) AS status FROM tasks GROUP BY list_id")
_add("redo_heads", lambda c: snapshots.redone(c.groupBy(F.col("o_custkey").alias("id")).agg(F.min("id").alias("head")), c.groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list("id")).alias("stack"))).select("id", "head", F.array_join(F.col("rest").cast("array<string>"), ",").alias("rest")), "commits", "SELECT o_custkey AS id, max(id) AS head, array_to_string(list_sort(list(id))[1:count(*) - 1], ',') AS rest FROM commits GROUP BY o_custkey")
_add("edit_lines", lambda a, f: text.edit_lines(a, f.filter("name = 'blue anvil'"), "edited"), "files functions", "SELECT path, CASE WHEN e IS NULL THEN content ELSE array_to_string(list_concat(l[1:9], ['edited'], l[e + 1:]), chr(10)) END AS content FROM (SELECT g.path, g.content, string_split(g.content, chr(10)) AS l, x.e FROM files g LEFT JOIN (SELECT file_id, min(end_line) AS e FROM functions WHERE name = 'blue anvil' GROUP BY file_id) x ON x.file_id = g.id)")
_add(
    "snippet_first_line", lambda a: a.select("id", symbols.snippet(F.col("content"), F.lit(1)).alias("snippet")), "files",
    r"SELECT id, coalesce(list_filter(list_transform(CASE WHEN list_position(l, '') > 0 THEN l[1:list_position(l, '') - 1] ELSE l END, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: NOT (x IN ('', '{', '}', '};') OR regexp_matches(x, '^(#|//|/\*|\x22{3}|\x27{3}|@|def |class |print\()')))[1], '')[1:120] AS snippet FROM (SELECT id, string_split(content, chr(10))[2:51] AS l FROM files)",
)


def queries() -> dict[str, Query]:
    return {name: run for name, (run, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _FOUND.items() if sql}
