"""The same results in SQL for DuckDB, where SQL can express them."""

_LINES = """
WITH rows AS (SELECT DISTINCT point_id, text,
    lower(trim(coalesce(CASE WHEN trim(base_url) <> '' THEN base_url END, regexp_replace(url, '#.*$', '')))) AS u FROM chunks),
 keyed AS (SELECT point_id, text, regexp_replace(regexp_replace(u, '^([a-z][a-z0-9+.\\-]*:)?//', ''), '^www\\.|/+$', '', 'g') AS page FROM rows WHERE u IS NOT NULL AND text IS NOT NULL),
 cutup AS (SELECT point_id, page, regexp_replace(regexp_extract(page, '^([^/?#]*)', 1), '^.*@|:\\d*$', '', 'g') AS site,
    string_split(text, chr(10)) AS ls FROM keyed WHERE page <> ''),
 lines AS (SELECT point_id, page, site, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS line FROM cutup),
 norm AS (SELECT point_id, page, site, CAST(line_no AS INTEGER) AS line_no, lower(regexp_replace(line, '[^\\p{L}]+', '', 'g')) AS k FROM lines),
 freq AS (SELECT site, k FROM norm WHERE k <> '' GROUP BY site, k HAVING count(DISTINCT page) >= 5)
"""

_WORDS = "regexp_extract_all(lower(strip_accents(coalesce(text, ''))), '[\\p{L}\\p{N}]+')"
_GRAMS = "list_distinct(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' ')))"

_TOKENS = "len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\r\\n]+'))"
_PLAN = f"""
WITH d AS (SELECT lower(regexp_replace(source, '^\\s+|\\s+$', '', 'g')) AS k, CAST({_TOKENS} AS BIGINT) AS n FROM documents),
 t AS (SELECT source, target_share, max_repeats, CAST(coalesce((SELECT sum(n) FROM d WHERE d.k = lower(m.source)), 0) AS BIGINT) AS tokens,
    (SELECT count(*) FROM d WHERE d.k = lower(m.source)) AS documents FROM mix_targets m),
 w AS (SELECT *, target_share * 0.6 * (SELECT sum(tokens) FROM t) AS wanted, tokens * max_repeats AS most FROM t),
 p AS (SELECT *, least(wanted, most) AS planned FROM w)
"""

SQL = {
    "p2_found": _LINES + "SELECT DISTINCT point_id, line_no FROM norm JOIN freq USING (site, k)",
    "p3_found": """
WITH latest AS (SELECT point_id, lower(trim(embedding_model)) AS m, vector FROM points
    QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY updated_at DESC NULLS LAST) = 1),
 good AS (SELECT l.* FROM latest l JOIN (SELECT DISTINCT lower(trim(embedding_model)) AS m, dim FROM collections) c USING (m)
    WHERE len(vector) = dim AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
 pairs AS (SELECT a.point_id, b.point_id AS neighbour_id, round(list_cosine_similarity(a.vector::DOUBLE[], b.vector::DOUBLE[]), 10) AS c
    FROM good a JOIN good b ON a.m = b.m AND a.point_id <> b.point_id)
SELECT point_id, neighbour_id FROM pairs QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY c DESC, neighbour_id) <= 8""",
    "p4_found": "SELECT DISTINCT request_id FROM embedding_requests WHERE length(content) // 4 > 500",
    "p5_found": f"""
WITH w AS (SELECT point_id, any_value(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS w FROM chunks WHERE text IS NOT NULL GROUP BY point_id),
 s AS (SELECT point_id, {_GRAMS.format(n=3)} AS g FROM w WHERE len(w) >= 3),
 n AS (SELECT point_id, len(g) AS n FROM s),
 f AS (SELECT point_id, unnest(g) AS g FROM s),
 c AS (SELECT a.point_id AS point_id_a, b.point_id AS point_id_b, count(*) AS common FROM f a JOIN f b ON a.g = b.g AND a.point_id < b.point_id GROUP BY 1, 2)
SELECT point_id_a, point_id_b FROM c JOIN n x ON x.point_id = point_id_a JOIN n y ON y.point_id = point_id_b WHERE common >= 0.5 * (x.n + y.n - common)""",
    "p6_found": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), e AS (SELECT item_id, {_WORDS} AS w FROM eval_items),
 dg AS (SELECT doc_id, unnest({_GRAMS.format(n=12)}) AS g FROM d WHERE len(w) >= 12),
 eg AS (SELECT item_id, unnest({_GRAMS.format(n=12)}) AS g FROM e WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g)""",
    "p7_found": _PLAN + "SELECT source FROM p WHERE most < wanted",
    "p7_plan": _PLAN + "SELECT source, target_share, max_repeats, tokens, documents, wanted, planned, CASE WHEN tokens > 0 THEN planned / tokens ELSE 0.0 END AS repeats, planned / (SELECT sum(planned) FROM p) AS actual_share, most < wanted AS short FROM p",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
