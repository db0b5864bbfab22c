"""DuckDB SQL for the queries that SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str, gap: str) -> str:
    return f"list_filter(string_split_regex(coalesce({text}, ''), '{gap}'), lambda w: w <> '')"


_SPACE = r"[\x20\x09-\x0D]+"
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWERED = f"translate(text, '{_UPPER}', '{_LOWER}')"

NEAR_DEDUP = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_words(_LOWERED, _SPACE)} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(3, len(w)) - 1), ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY 1, 2) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT m.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""

CONTAMINATION = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_words(_LOWERED, _NO_WORD)} AS w FROM documents),
b AS (SELECT item_id, {_words(_LOWERED, _NO_WORD)} AS w FROM benchmark),
win AS MATERIALIZED (SELECT DISTINCT item_id, n, list_slice(w, i, i + n - 1) AS k FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS k FROM (SELECT doc_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS MATERIALIZED (SELECT p.doc_id, p.i, p.n, item_id FROM p JOIN win USING (n, k)),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, CAST(i + n AS BIGINT))) AS j FROM hit) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

REPEATS = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_words('text', _SPACE)} AS w FROM documents),
p AS MATERIALIZED (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 34), ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, CAST(len(w) - 33 AS BIGINT))) AS i FROM d WHERE len(w) >= 35)),
twice AS (SELECT k FROM p GROUP BY k HAVING count(*) > 1),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 35)) AS j FROM p WHERE k IN (SELECT k FROM twice))),
every AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, CAST(len(w) + 1 AS BIGINT))) AS j FROM d),
kept AS (SELECT e.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS t FROM every e ANTI JOIN gone USING (doc_id, j) GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

_KEPT = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_WHOLE = "list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE)))"
# whole numbers in doubles, below 2**53
_SQUARE = "(list_inner_product(a.w, a.w) - 2 * list_inner_product(a.w, b.w) + list_inner_product(b.w, b.w))"


def _rounds(rounds: int) -> str:
    """From x (row, part, w) and b0 (part, entry, w): a0 .. a{rounds} (row, part, entry, square) and the tables that rounds make of b0."""
    out = []
    for k in range(rounds + 1):
        out.append(f"a{k} AS MATERIALIZED (SELECT row, part, m.entry AS entry, m.square AS square FROM (SELECT a.row, a.part, min(struct_pack(square := CAST({_SQUARE} AS BIGINT), entry := b.entry)) AS m FROM x a JOIN b{k} b ON a.part = b.part GROUP BY a.row, a.part))")
        if k < rounds:
            mean = "CAST((s - ((s % n) + n) % n) // n AS DOUBLE)"
            sums = f"SELECT part, entry, place, sum(CAST(c AS BIGINT)) AS s, count(*) AS n FROM (SELECT part, entry, unnest(w) AS c, unnest(range(1, CAST(len(w) + 1 AS BIGINT))) AS place FROM x JOIN a{k} USING (row, part)) GROUP BY ALL"
            out.append(f"b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.w, b.w) AS w FROM b{k} b LEFT JOIN (SELECT part, entry, list({mean} ORDER BY place) AS w FROM ({sums}) GROUP BY part, entry) m ON m.part = b.part AND m.entry = b.entry)")
    return ",\n".join(out)


_DIGITS = "string_agg(CAST(CAST({} AS BIGINT) AS VARCHAR), ',' ORDER BY {})"

VECTOR_CODES = f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, {_WHOLE} AS v FROM embeddings WHERE {_KEPT}),
x AS MATERIALIZED (SELECT row, part, list_slice(v, part * len(v) // 4 + 1, (part + 1) * len(v) // 4) AS w FROM k, (SELECT unnest(range(4)) AS part)),
b0 AS MATERIALIZED (SELECT part, row - 1 AS entry, w FROM x WHERE row <= 256),
{_rounds(4)},
h AS (SELECT sha256({_DIGITS.format("c", "part, entry, place")}) AS codebooks_sha256 FROM (SELECT part, entry, unnest(w) AS c, unnest(range(1, CAST(len(w) + 1 AS BIGINT))) AS place FROM b4)),
e AS MATERIALIZED (SELECT row, string_agg(lower(format('{{:02x}}', entry)), '' ORDER BY part) AS code, CAST(sum(square) AS BIGINT) AS error FROM a4 GROUP BY row)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN e USING (row), h
"""

CENTROIDS = f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)), vec_id) AS row, vec_id, {_WHOLE} AS v FROM embeddings WHERE {_KEPT} AND len(embedding) = 64),
x AS MATERIALIZED (SELECT row, 0 AS part, v AS w FROM k),
b0 AS MATERIALIZED (SELECT part, row - 1 AS entry, w FROM x WHERE row <= 8),
{_rounds(10)},
h AS (SELECT entry, sha256({_DIGITS.format("c", "place")}) AS centroid_sha256 FROM (SELECT entry, unnest(w) AS c, unnest(range(1, CAST(len(w) + 1 AS BIGINT))) AS place FROM b10) GROUP BY entry)
SELECT vec_id, CAST(entry AS INTEGER) AS cluster, square AS distance, CAST(sum(square) OVER (PARTITION BY entry) AS BIGINT) AS cluster_inertia, CAST(sum(square) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM k JOIN a10 USING (row) JOIN h USING (entry)
"""

SQL = {"op1_near_dedup": NEAR_DEDUP, "op5_contamination": CONTAMINATION, "op9_repeats": REPEATS, "op11_vector_codes": VECTOR_CODES, "op12_centroids": CENTROIDS}
