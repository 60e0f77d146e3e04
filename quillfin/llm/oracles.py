"""DuckDB SQL for the queries that SQL can express."""

from quillfin.llm.secret_scan import BASE, RULES

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP9 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
rep AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, i + k AS i FROM (SELECT r, i, unnest(range(0, 35)) AS k FROM win WHERE s IN (SELECT s FROM rep))),
one AS (SELECT r, i, w[i] AS x FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
kept AS (SELECT o.r, string_agg(x, ' ' ORDER BY o.i) AS t, count(*) AS n FROM one o ANTI JOIN gone g ON o.r = g.r AND o.i = g.i GROUP BY o.r)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.r = kept.r
"""



def _secret_sql() -> str:
    """Matches by regexp_extract_all, their places from the gaps between them. What must not stand in front is written as one other character, which is no part of the match, as DuckDB's expressions can't look behind."""
    quoted = lambda r: "'" + (f"(?:^|[^{r.before}])({r.pattern})" if r.before else r.pattern).replace("'", "''") + "'"
    parts = []
    for i, r in enumerate(RULES):
        found = f"regexp_extract_all(t, {quoted(r)})"
        gaps = f"regexp_split_to_array(t, {quoted(r)})"
        least = f"WHERE length(regexp_extract(x.m, {quoted(r)}, {r.group})) >= {r.least_chars}"
        ahead = f" + length(x.m) - length(regexp_extract(x.m, {quoted(r)}, 1))" if r.before else ""
        parts.append(
            f"""SELECT r, {i} AS o, '{r.kind}' AS kind, x.a{ahead} AS a, x.a + length(x.m) AS b FROM (SELECT r, unnest(list_transform(m, lambda v, i: {{'a': list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0), 'm': v}})) AS x
            FROM (SELECT r, {found} AS m, {gaps} AS g FROM d)) {least}"""
        )
    one = "kind || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT)"
    count = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in RULES[:BASE])
    zero = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in RULES[:BASE])
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(parts)}),
g AS (SELECT r, {count}, string_agg({one}, ',' ORDER BY a, o, b) FILTER (o < {BASE}) AS base, string_agg({one}, ',' ORDER BY a, o, b) AS spans FROM s GROUP BY r)
SELECT doc_id, {zero}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)"""


#: Classes of probability Jaccard >= 0.8 on five-word shingles. Pairs whose shared shingles weigh under 0.8 of either text cannot reach it.
OP2 = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT r, array_to_string(w[i:i + 4], ' ') AS s, count(*) AS n FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0) GROUP BY 1, 2),
tot AS (SELECT r, sum(n) AS t FROM sh GROUP BY 1),
cand AS (SELECT a, b FROM (SELECT x.r AS a, y.r AS b, sum(x.n) AS sa, sum(y.n) AS sb FROM sh x JOIN sh y ON x.s = y.s AND x.r < y.r GROUP BY 1, 2) JOIN tot p ON p.r = a JOIN tot q ON q.r = b WHERE sa >= 0.8 * p.t AND sb >= 0.8 * q.t),
u AS (SELECT a, b, s, max(CASE WHEN r = a THEN n ELSE 0 END) AS x, max(CASE WHEN r = b THEN n ELSE 0 END) AS y FROM cand JOIN sh ON r = a OR r = b GROUP BY 1, 2, 3),
jp AS (SELECT a, b, sum(z) AS j FROM (SELECT i.a, i.b, 1 / sum(greatest(k.x / i.x::DOUBLE, k.y / i.y::DOUBLE)) AS z FROM u i JOIN u k ON i.a = k.a AND i.b = k.b WHERE i.x > 0 AND i.y > 0 GROUP BY i.a, i.b, i.s) GROUP BY 1, 2),
e AS (SELECT a, b FROM jp WHERE j >= 0.8::DOUBLE - 1e-9 UNION SELECT b, a FROM jp WHERE j >= 0.8::DOUBLE - 1e-9),
reach AS (SELECT r, r AS o FROM d UNION SELECT reach.r, e.b FROM reach JOIN e ON e.a = reach.o)
SELECT d.doc_id, min(o.doc_id) AS class_id, count(*) AS class_size FROM d JOIN reach ON reach.r = d.r JOIN d o ON o.r = reach.o GROUP BY d.r, d.doc_id
"""

_UNITS = "list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE))"
_GOOD = "vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_PRODUCT = "CAST(list_inner_product(a.u, b.u) AS BIGINT)"

OP11 = f"""
WITH v AS (SELECT vec_id, {_UNITS} AS u FROM embeddings WHERE {_GOOD}),
s AS (SELECT a.vec_id AS query_id, b.vec_id, {_PRODUCT} AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 5
"""

OP12 = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_UNITS} AS u FROM embeddings WHERE label IS NOT NULL AND {_GOOD}),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, {_PRODUCT} AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10
"""

ORACLES = {"op2_minhash_near_dedup": OP2, "op5_secret_scan": _secret_sql(), "op9_substring_dedup": OP9, "op11_exact_top_k": OP11, "op12_hard_negatives": OP12}
