"""Tables of the engine's shapes made from the driver's tables; the same SELECTs serve Spark and the SQL check."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from strataforge.storage import table

SELECTS = {
    "files": "SELECT doc_id AS id, source || '/' || CAST(doc_id AS STRING) || '.' || lang AS path, lang AS language, text AS content FROM {documents}",
    "functions": (
        "SELECT p_partkey AS id, p_partkey % 200 AS file_id, p_name AS name, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey % 10 + 1 END AS parent_id, "
        "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'class' END AS parent_type, CASE WHEN p_type = 'PROMO' THEN NULL WHEN p_type = 'SMALL' THEN '' ELSE p_type || ' ' || p_brand END AS description, "
        "p_size % 12 AS branch_count, 10 AS start_line, 10 + p_size AS end_line FROM {part}"
    ),
    "classes": "SELECT s_suppkey AS id, s_suppkey % 200 AS file_id, s_name AS name, CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey % 7 + 1 ELSE NULL END AS parent_id, CASE WHEN s_acctbal < 0 THEN NULL ELSE 'supplier of ' || s_name END AS description FROM {supplier}",
    "variables": "SELECT c_custkey AS id, c_custkey % 200 AS file_id, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_custkey % 10 + 1 END AS parent_id, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE 'class' END AS parent_type, c_mktsegment AS description FROM {customer}",
    "deps": (
        "SELECT o_orderkey AS id, o_custkey % 200 AS file_id, CASE o_orderkey % 5 WHEN 0 THEN 'import' WHEN 1 THEN 'function_call' WHEN 2 THEN 'method_call' WHEN 3 THEN 'class_reference' ELSE 'variable_reference' END AS dependency_type, "
        "CASE o_orderkey % 5 WHEN 2 THEN 'self.' || p_name WHEN 3 THEN 'Supplier#' || CAST(o_custkey % 10 AS STRING) ELSE p_name END AS name, o_custkey % 150 + 1 AS source_function_id, "
        "CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 190 + 1 ELSE NULL END AS target_function_id, CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey % 10 + 1 ELSE NULL END AS target_class_id, o_orderkey % 4 = 0 AS is_external "
        "FROM {orders} JOIN {part} ON p_partkey = o_orderkey % 200 + 1"
    ),
    "edges": (
        "SELECT DISTINCT source, target, 'src' || CAST(target % 20 AS STRING) || '/' AS path FROM (SELECT l_partkey AS source, LEAD(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS target FROM {lineitem}) AS e WHERE target IS NOT NULL"
    ),
    # code whose names have no blanks, with init methods, names that nothing defines and classes found while indexing
    "code_functions": (
        "SELECT p_partkey AS id, p_partkey % 200 AS file_id, CASE WHEN p_size % 10 = 0 THEN '__init__' ELSE replace(p_name, ' ', '_') END AS name, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey % 10 + 1 END AS parent_id, "
        "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'class' END AS parent_type FROM {part}"
    ),
    "code_deps": (
        "SELECT DISTINCT CAST(l_partkey AS STRING) || ':' || kind || ':' || name || ':' || coalesce(CAST(target_class_id AS STRING), '') AS id, l_partkey AS source_function_id, l_partkey % 200 AS file_id, kind AS dependency_type, name, target_class_id FROM ("
        "SELECT l_partkey, CASE l_returnflag WHEN 'A' THEN 'function_call' WHEN 'N' THEN 'method_call' ELSE 'class_reference' END AS kind, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN l_suppkey % 12 + 1 ELSE NULL END AS target_class_id, "
        "CASE WHEN l_linenumber = 3 THEN 'lib.' || l_linestatus WHEN l_linenumber = 5 AND l_linestatus = 'F' THEN 'a<=b' WHEN l_returnflag = 'A' THEN replace(p_name, ' ', '_') WHEN l_returnflag = 'N' THEN 'self.x.' || replace(p_name, ' ', '_') ELSE s_name END AS name "
        "FROM {lineitem} JOIN {part} ON p_partkey = l_suppkey % 200 + 1 JOIN {supplier} ON s_suppkey = l_suppkey % 10 + 1) AS c"
    ),
    "names": "SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_partkey % 12 WHEN 0 THEN 'a&&b||c' WHEN 1 THEN 'fmt(%s,%d)' WHEN 2 THEN 'fmt(%s)' WHEN 3 THEN 'x<=y' WHEN 4 THEN 'x++' WHEN 5 THEN 'i-j/k' WHEN 6 THEN '%a%b' WHEN 7 THEN 'it''s' WHEN 8 THEN 't.format(x)' WHEN 9 THEN 'echo ls' WHEN 10 THEN 'a==b' ELSE 'call' || CAST(l_suppkey AS STRING) END AS name FROM {lineitem}",
    "file_versions": (
        "SELECT 'src' || CAST(o_custkey % 20 AS STRING) || '/' || CAST(o_custkey AS STRING) AS path, o_orderkey AS seq, o_orderstatus = 'P' AS deleted, split('fn' || CAST(o_orderkey % 97 AS STRING) || ',fn' || CAST(o_custkey % 89 AS STRING), ',') AS definitions, "
        "split('fn' || CAST(o_orderkey * 7 % 131 AS STRING) || ',fn' || CAST(o_orderkey * 11 % 97 AS STRING) || ',fn' || CAST(o_custkey % 89 AS STRING) || ',lib' || CAST(o_custkey % 5 AS STRING), ',') AS calls FROM {orders}"
    ),
    "log_operations": "SELECT user_id AS repo, event_id AS seq, CASE event_type WHEN 'click' THEN 'commit' WHEN 'error' THEN 'undo' WHEN 'purchase' THEN 'undo' WHEN 'signup' THEN 'redo' ELSE CASE WHEN event_id % 3 = 0 THEN 'commit' ELSE 'redo' END END AS kind FROM {events}",
    "notes": "SELECT source AS session_id, doc_id AS turn, text FROM {documents}",
    "first_tasks": "SELECT o_custkey % 500 AS list_id, 2 * row_number() OVER (PARTITION BY o_custkey % 500 ORDER BY o_orderkey) AS order_index, 'goal ' || CAST(o_orderkey AS STRING) AS goal FROM {orders}",
    "list_edits": "SELECT user_id AS list_id, event_id AS seq, CASE event_type WHEN 'error' THEN 'cancel' WHEN 'view' THEN 'open' ELSE 'insert' END AS op, 'event ' || CAST(event_id AS STRING) AS goal, CASE WHEN event_type = 'signup' THEN NULL ELSE event_id * 7 % 45 - 1 END AS after FROM {events}",
    "session_log": "SELECT event_id AS seq, user_id AS id, event_type = 'error' AS deleted, user_id % 20 AS chat_id, CASE WHEN event_type = 'signup' THEN user_id + 1 + event_id % 5 ELSE NULL END AS redirect, props AS title FROM {events}",
    "chat_deletions": "SELECT user_id % 20 AS chat_id, event_id AS seq FROM {events} WHERE event_type = 'purchase' AND value > 100",
    "half_messages": "SELECT conv_id AS session_id, turn, CASE WHEN conv_id % 9 = 4 AND role = 'user' THEN 'system' ELSE role END AS role, text FROM {conversations}",
    "turns": "SELECT conv_id AS session_id, turn, role, CASE WHEN role = 'assistant' AND length(text) % 3 = 0 THEN 2 ELSE 0 END AS n_calls FROM {conversations}",
    "redirects": "SELECT conv_id AS id, CASE WHEN conv_id % 4 = 1 THEN conv_id + 1 WHEN conv_id % 7 = 2 THEN conv_id + 5 ELSE NULL END AS next FROM {conversations} GROUP BY conv_id",
    "messages": "SELECT conv_id AS session_id, turn, role, text FROM {conversations}",
    "pointers": "SELECT o_orderkey AS id, LEAD(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next, o_custkey FROM {orders}",
    "lists": "SELECT o_orderkey AS list_id, o_orderkey AS id, o_custkey AS session_id, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'pending' ELSE 'rejected' END AS status FROM {orders}",
    "tasks": (
        "SELECT l_orderkey AS list_id, l_linenumber AS order_index, l_partkey * 1000 + l_suppkey AS id, CASE l_returnflag WHEN 'R' THEN 'in_progress' WHEN 'N' THEN 'pending' ELSE 'completed' END AS status, CAST(l_partkey AS STRING) AS goal FROM {lineitem}"
    ),
    "changes": "SELECT event_id AS id, ts AS timestamp, user_id AS session_id, event_type AS change_type, props FROM {events}",
    "sessions": "SELECT o_orderkey AS id, o_custkey AS chat_id, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE LAG(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) END AS parent_session_id FROM {orders}",
    "commits": "SELECT o_orderkey AS id, LAG(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS parent, o_custkey FROM {orders}",
    # whole tables: what is new, gone or moved has another path on one side, and no row is left out
    "scanned": "SELECT CASE WHEN doc_id % 7 = 0 THEN -doc_id - 1 ELSE doc_id END AS path, n_chars % 3 AS mtime, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE lang END AS content_hash FROM {documents}",
    "known": "SELECT CASE WHEN doc_id % 11 = 0 THEN -doc_id - 1000000000 ELSE doc_id END AS path, CASE WHEN doc_id % 2 = 0 THEN n_chars % 3 ELSE 9 END AS mtime, lang AS content_hash FROM {documents}",
    "working": "SELECT source || CASE WHEN doc_id % 7 = 0 THEN '/moved/' ELSE '/' END || CAST(doc_id AS STRING) AS path, CASE WHEN doc_id % 5 = 0 THEN text || 'x' ELSE text END AS content FROM {documents}",
    "snapshot": "SELECT source || CASE WHEN doc_id % 11 = 0 THEN '/old/' ELSE '/' END || CAST(doc_id AS STRING) AS path, text AS content FROM {documents}",
    "type_aliases": "SELECT n_nationkey AS id, n_regionkey AS file_id, n_name AS name, 'region ' || n_regionkey AS description FROM {nation}",
    "structs": "SELECT s_suppkey AS id, s_suppkey % 200 AS file_id, s_name AS name, CASE WHEN s_acctbal < 0 THEN NULL ELSE 'struct of ' || s_name END AS description FROM {supplier}",
    "interfaces": "SELECT c_custkey AS id, c_custkey % 200 AS file_id, c_name AS name, c_mktsegment AS description FROM {customer}",
    "enums": "SELECT p_partkey AS id, p_partkey % 200 AS file_id, p_type || ' ' || p_brand AS name, NULLIF(p_type, 'PROMO') AS description FROM {part}",
    "namespaces": "SELECT r_regionkey AS id, r_regionkey % 200 AS file_id, r_name AS name, CAST(NULL AS STRING) AS description FROM {region}",
    "operations": "SELECT event_id AS id, user_id AS session_id, 'file' || event_id % 40 AS file_path, event_type AS operation FROM {events}",
}

# what reports on files need
SELECTS["report_functions"] = SELECTS["code_functions"].replace(" FROM {part}", ", CASE WHEN p_type = 'PROMO' THEN NULL WHEN p_type = 'SMALL' THEN '' ELSE p_brand END AS description, p_type AS argument, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE NULL END AS argument_type, 2 AS start_line, 2 + p_size % 4 AS end_line FROM {part}")
SELECTS["report_classes"] = (
    "SELECT s_suppkey AS id, s_suppkey % 200 AS file_id, s_name AS name, CASE WHEN s_suppkey % 6 = 0 THEN s_suppkey ELSE NULL END AS parent_id, CASE WHEN s_suppkey % 4 = 0 THEN 'ns' || CAST(s_nationkey AS STRING) ELSE NULL END AS namespace, "
    "CASE WHEN s_acctbal < 5000 THEN NULL ELSE 'supplier of ' || s_name END AS description, 1 AS start_line, 3 AS end_line FROM {supplier}"
)
SELECTS["report_variables"] = (
    "SELECT c_custkey AS id, c_custkey % 200 AS file_id, 'v' || CAST(c_custkey % 300 AS STRING) AS name, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_custkey % 12 + 1 END AS parent_id, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE 'class' END AS parent_type, "
    "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS field_type, CASE WHEN c_custkey % 5 = 0 THEN c_name ELSE NULL END AS description FROM {customer}"
)
SELECTS["report_deps"] = (
    "SELECT id, source_function_id, file_id, dependency_type, name FROM (" + SELECTS["code_deps"] + ") AS d UNION ALL SELECT DISTINCT 'import:' || CAST(o_custkey % 200 AS STRING) || ':' || CAST(o_orderkey % 40 AS STRING), CAST(NULL AS BIGINT), o_custkey % 200, 'import', 'import mod' || CAST(o_orderkey % 40 AS STRING) FROM {orders} "
    "UNION ALL SELECT DISTINCT CAST(l_partkey AS STRING) || ':v' || CAST(l_suppkey % 320 AS STRING), l_partkey, l_partkey % 200, 'variable_reference', 'v' || CAST(l_suppkey % 320 AS STRING) FROM {lineitem}"
)
# import statements in all languages, of things that are in the tree and of others
SELECTS["tree_files"] = (
    "SELECT DISTINCT CASE p_partkey % 8 WHEN 0 THEN 'pkg' || CAST(p_size AS STRING) || '/mod.py' WHEN 1 THEN 'mod' || CAST(p_size AS STRING) || '.py' WHEN 2 THEN 'web/' || replace(p_name, ' ', '_') || '.ts' WHEN 3 THEN 'com/acme/' || replace(p_name, ' ', '_') || '.java' "
    "WHEN 4 THEN 'lib/my_app/' || replace(p_name, ' ', '_') || '.ex' WHEN 5 THEN 'App/Models/' || replace(p_name, ' ', '_') || '/x.cs' WHEN 6 THEN 'org/' || replace(p_name, ' ', '_') || '.kt' ELSE replace(p_name, ' ', '_') || '/file.go' END AS path FROM {part}"
)
SELECTS["import_rows"] = (
    "SELECT DISTINCT CAST(id AS STRING) || ':' || language || ':' || name AS id, language, name FROM (SELECT id, CASE k WHEN 0 THEN 'python' WHEN 1 THEN 'python' WHEN 2 THEN 'go' WHEN 3 THEN 'go' WHEN 4 THEN 'typescript' WHEN 5 THEN 'javascript' WHEN 6 THEN 'rust' WHEN 7 THEN 'cpp' WHEN 8 THEN 'csharp' WHEN 9 THEN 'php' WHEN 10 THEN 'php' WHEN 11 THEN 'dart' WHEN 12 THEN 'java' WHEN 13 THEN 'kotlin' WHEN 14 THEN 'zig' WHEN 15 THEN 'elixir' ELSE 'cobol' END AS language, "
    """CASE k WHEN 0 THEN 'from pkg' || n || '.mod import x' WHEN 1 THEN 'import mod' || n WHEN 2 THEN '"github.com/a/' || w || '"' WHEN 3 THEN './' || w WHEN 4 THEN CASE WHEN z THEN 'import {{ x }} from "./' || w || '";' ELSE 'import {{ x }} from "web/' || w || '";' END WHEN 5 THEN 'import "@' || w || '"' """
    """WHEN 6 THEN CASE WHEN z THEN 'use crate::' || w ELSE 'use ' || w END WHEN 7 THEN CASE WHEN z THEN '#include "' || w || '.h"' ELSE '#include <' || w || '>' END WHEN 8 THEN CASE WHEN z THEN 'using System.' || w || ';' ELSE 'using App.Models.' || w || ';' END WHEN 9 THEN CASE WHEN z THEN 'require "./' || w || '";' ELSE 'include "' || w || '/file.go";' END """
    """WHEN 10 THEN CASE WHEN z THEN 'use Symfony' || w || ';' ELSE 'use App;' END WHEN 11 THEN CASE WHEN z THEN 'import "package:' || w || '";' ELSE 'import "web/' || w || '.ts";' END WHEN 12 THEN 'import com.acme.' || w || ';' WHEN 13 THEN 'import org.' || w WHEN 14 THEN CASE WHEN z THEN '@import("std")' ELSE '@import("mod' || n || '.py")' END """
    "WHEN 15 THEN 'MyApp.' || upper(substring(w, 1, 1)) || substring(w, 2) ELSE 'COPY ' || w END AS name FROM (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey % 17 AS k, CAST(p_size AS STRING) AS n, CASE WHEN l_suppkey % 7 = 0 THEN 'absent' ELSE replace(p_name, ' ', '_') END AS w, l_suppkey % 2 = 0 AS z FROM {lineitem} JOIN {part} ON p_partkey = l_suppkey % 199 + 1) AS r) AS s"
)
# what was written to the store: chats, sessions below them and messages below these
SELECTS["store_operations"] = (
    "SELECT seq, CASE WHEN k < 6 THEN 'create' WHEN k = 8 THEN 'delete' ELSE 'update' END AS op, CASE WHEN k = 0 OR k = 6 OR (k = 8 AND event_type = 'error') THEN 'chats' WHEN k BETWEEN 3 AND 5 THEN 'messages' ELSE 'sessions' END AS entity, "
    "CASE WHEN k < 6 THEN seq WHEN k = 6 THEN tens - 10 * (user_id % 7) WHEN k = 8 AND event_type = 'error' THEN tens - 10 * (user_id % 9) WHEN k = 8 THEN tens - 10 * (user_id % 8) + 2 ELSE tens - 10 * (user_id % 6) + 1 + user_id % 2 END AS id, "
    "CASE WHEN k IN (1, 2) THEN tens - 10 * (user_id % 5) WHEN k BETWEEN 3 AND 5 THEN tens - 10 * (user_id % 4) + 1 + seq % 2 ELSE NULL END AS parent, "
    "CASE k WHEN 0 THEN event_type WHEN 3 THEN 'user' WHEN 4 THEN 'assistant' WHEN 5 THEN CASE WHEN user_id % 3 = 0 THEN 'tool' ELSE 'assistant' END ELSE NULL END AS role, CASE WHEN k = 6 THEN props ELSE NULL END AS title, "
    "CASE WHEN k = 7 AND user_id % 3 > 0 THEN CAST(tens - 10 * (user_id % 6) + 1 + user_id % 2 + 10 * (user_id % 3) AS STRING) ELSE NULL END AS redirect, CASE WHEN k = 9 OR k = 2 THEN CAST(user_id % 5 AS STRING) ELSE NULL END AS effort, "
    "CASE WHEN k = 5 AND user_id % 4 = 0 THEN props ELSE NULL END AS tool_calls FROM (SELECT event_id AS seq, event_id % 10 AS k, event_id - event_id % 10 AS tens, user_id, event_type, props FROM {events}) AS e"
)
# stored JSON, some of it cut off, without a required key or with others beside
SELECTS["stored_functions"] = (
    """SELECT p_partkey AS id, p_partkey % 200 AS file_id, p_name AS name, CASE p_partkey % 9 WHEN 0 THEN '{{"start_line": 1, "start_col' WHEN 1 THEN '{{"start_line": 1}}' WHEN 2 THEN NULL WHEN 3 THEN '{{"start_line": ' || CAST(p_size AS STRING) || ', "start_column": 0, "end_line": 9, "end_column": 2, "start_byte": 7, "end_byte": 8, "extra": [1]}}' """
    """WHEN 4 THEN '[1]' ELSE '{{"start_line": ' || CAST(p_size AS STRING) || ', "start_column": 4, "end_line": ' || CAST(p_size + 3 AS STRING) || ', "end_column": 1}}' END AS location, """
    """CASE p_partkey % 7 WHEN 0 THEN '[]' WHEN 1 THEN '["self", "x"]' WHEN 2 THEN '[{{"name": "a", "type": null}}, {{"name": "b", "type": "int", "more": 1}}]' WHEN 3 THEN '{{"name": "a"}}' WHEN 4 THEN 'nothing' ELSE '[{{"name": "' || p_brand || '", "type": "' || p_type || '"}}]' END AS parameters, """
    """CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size END AS branch_count FROM {part}"""
)
SELECTS["stored_deps"] = """SELECT o_orderkey AS id, o_custkey % 200 AS file_id, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '{{"start_line": 3, "start_column": 1, "end_line": 3, "end_column": 9}}' WHEN 3 THEN '{{"start_line"' ELSE '{{"start_line": 4, "start_column": 1, "end_line": 4, "end_column": 9, "end_byte": 77}}' END AS location, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 1 ELSE 0 END AS is_external FROM {orders}"""


def _tables(name: str) -> set[str]:
    return set(re.findall(r"\{(\w+)\}", SELECTS[name]))


def standin(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    names = _tables(name)
    return spark.sql(SELECTS[name], **{t: table(spark, sf_dir, t) for t in names})


def with_standins(body: str) -> str:
    """body with a WITH clause of the stand-ins that it names."""
    used = [name for name in SELECTS if re.search(rf"\b{name}\b", body)]
    clauses = ", ".join(f"{name} AS ({SELECTS[name].format(**{t: t for t in _tables(name)})})" for name in used)
    return (f"WITH RECURSIVE {clauses}, " + body[5:].lstrip() if body.startswith("WITH ") else f"WITH {clauses} {body}") if used else body
