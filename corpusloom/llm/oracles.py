"""DuckDB SQL for the rows of the queries that SQL can express."""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS id, a AS reach FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reach),
c AS (SELECT id, min(reach) AS component_id FROM r GROUP BY id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id, coalesce(c.component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.id = w.doc_id
"""

OP3 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
t AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
g AS (SELECT DISTINCT item, least(10, len(ws)) AS n, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS s FROM (SELECT item, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM t WHERE len(ws) > 0)),
h AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, ws, k.n, unnest(range(1, len(ws) - k.n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) k WHERE len(ws) >= k.n)),
m AS (SELECT doc_id, h.n, i, item FROM h JOIN g ON g.n = h.n AND g.s = h.s),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN i ON i.doc_id = d.doc_id
"""



def _lloyd(k: int = 40, rounds: int = 5) -> str:
    """Rounds written out one after the other; every distance is computed."""
    parts = [
        "kept AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x AS c FROM (SELECT sha256('2:' || CAST(vec_id AS VARCHAR)) AS h, x FROM kept ORDER BY h, x LIMIT {k}))",
    ]
    nearest = "SELECT row, any_value(vec_id) AS vec_id, min(struct_pack(d := d, k := k)) AS m FROM (SELECT row, vec_id, k, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM n, c{at}) GROUP BY row"
    parts.append("n AS (SELECT row_number() OVER () AS row, vec_id, x FROM kept)")
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED ({nearest.format(at=r)})")
        if r < rounds:
            sums = f"SELECT m.k AS k, i, CAST(floor(sum(v) / count(*)) AS BIGINT) AS v FROM (SELECT m, unnest(x) AS v, unnest(range(1, 65)) AS i FROM a{r} JOIN n USING (row)) GROUP BY m.k, i"
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.k AS k, coalesce(s.c, c{r}.c) AS c FROM c{r} LEFT JOIN (SELECT k, list(v ORDER BY i) AS c FROM ({sums}) GROUP BY k) s ON s.k = c{r}.k)")
    last = f"a{rounds}"
    return f"""
WITH {", ".join(parts)}
SELECT vec_id, CAST(m.k AS INTEGER) AS cluster, CAST(m.d AS BIGINT) AS distance, CAST(sum(m.d) OVER (PARTITION BY m.k) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM {last} JOIN c{rounds} ON c{rounds}.k = m.k
"""


ORACLES: dict[str, str] = {"op1_odd_sketch_dedup": OP1, "op3_suffix_automaton": OP3, "op12_dual_tree_lloyd": _lloyd()}
