"""SQL for another engine, where the definitions can be said in SQL and run over whole tables."""

#: words w of each sample, and its distinct triples
TRIPLES = r"""w AS (SELECT sample_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM samples WHERE text IS NOT NULL),
    t AS (SELECT sample_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS t FROM w WHERE len(w) >= 12),
    x AS (SELECT sample_id, len(t) AS n, unnest(t) AS k FROM t),
    j AS (SELECT a.sample_id AS a, b.sample_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS s FROM x a JOIN x b ON a.k = b.k AND a.sample_id <> b.sample_id GROUP BY 1, 2)"""
SPLIT = r"lower(trim(regexp_replace(split, '\[[^\]]*\]', '', 'g')))"
SIDES = f"""q AS (SELECT request_id, max(split) AS split FROM analyze_requests GROUP BY 1),
    v AS (SELECT sample_id, coalesce(samples.split, q.split, 'train') AS split FROM samples LEFT JOIN q USING (request_id)),
    z AS (SELECT sample_id, CASE WHEN {SPLIT} IN ('test', 'validation', 'valid', 'val', 'dev', 'eval') THEN 0 WHEN {SPLIT} IN ('train', 'training') THEN 1 END AS side FROM v)"""


def _groups(least: str) -> str:
    return f"""e AS (SELECT a, b FROM j WHERE {least}), r(node, root) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON r.node = e.a),
    g AS (SELECT node, min(root) AS root FROM r GROUP BY 1), c AS (SELECT root, count(*) AS n FROM g GROUP BY 1)"""


SQL = {
    "p1_found": f"""WITH {TRIPLES}, {SIDES} SELECT least(a, b) AS sample_id_a, greatest(a, b) AS sample_id_b
        FROM j JOIN z e ON e.sample_id = a AND e.side = 0 JOIN z t ON t.sample_id = b AND t.side = 1 WHERE 10 * s >= 7 * na""",
    "p1_report": f"""WITH {TRIPLES}, {SIDES}, f AS (SELECT DISTINCT a FROM j JOIN z e ON e.sample_id = a AND e.side = 0 JOIN z t ON t.sample_id = b AND t.side = 1 WHERE 10 * s >= 7 * na)
        SELECT {SPLIT.replace('split', 'v.split', 1)} AS split, source, count(*) AS records, count(f.a) AS overlapping FROM samples JOIN v USING (sample_id) JOIN z USING (sample_id) LEFT JOIN f ON f.a = sample_id WHERE side = 0 GROUP BY 1, 2""",
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p4_found": f"WITH {TRIPLES} SELECT a AS sample_id_a, b AS sample_id_b FROM j WHERE a < b AND 2 * s >= na + nb - s",
    "p4_groups": f"""WITH RECURSIVE {TRIPLES}, {_groups('2 * s >= na + nb - s')}, h AS (SELECT sample_id, hash(list_sort(t)) AS h FROM t),
        l AS (SELECT e.a, count(DISTINCT y.h) FILTER (x.h <> y.h) AS links FROM e JOIN h x ON x.sample_id = e.a JOIN h y ON y.sample_id = e.b GROUP BY 1)
        SELECT node AS sample_id, root AS group_id, n AS group_size, links FROM g JOIN c USING (root) JOIN l ON l.a = node""",
    "p5_found": f"""WITH RECURSIVE {TRIPLES}, {_groups('6 * s >= na + nb')} SELECT root AS first_id, node AS sample_id FROM g JOIN c USING (root) WHERE n >= 10 AND node <> root""",
}
