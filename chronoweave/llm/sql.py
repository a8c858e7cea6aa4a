"""SQL of the training-data queries that SQL can express."""

_SESSIONS = r"""
WITH l AS (
  SELECT DISTINCT ON (src_session, line_offset) * FROM session_lines WHERE rec_type IN ('user', 'assistant') AND is_sidechain IS NOT TRUE
  ORDER BY src_session, line_offset, ingested_at, line_id
),
p AS (
  SELECT src_session, line_offset, line_id, rec_type, message IS NOT NULL AND json_valid(message) AS good,
    CASE WHEN regexp_matches(rec_timestamp, '^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$') THEN TRY_CAST(rec_timestamp AS TIMESTAMPTZ) END AS t,
    CASE WHEN json_valid(message) THEN CAST(message AS JSON) END AS m
  FROM l
),
c AS (
  SELECT *, CASE json_type(m, '$.content')
      WHEN 'VARCHAR' THEN regexp_matches(m->>'$.content', '\S')
      WHEN 'ARRAY' THEN len(list_filter(CAST(m->'$.content' AS JSON[]), lambda x: x->>'$.type' IN ('tool_use', 'tool_result') OR (x->>'$.type' = 'text' AND coalesce(regexp_matches(x->>'$.text', '\S'), false)))) > 0
      ELSE false END AS said
  FROM p
),
o AS (SELECT *, lag(rec_type) OVER w AS before, row_number() OVER w AS rn, count(*) OVER (PARTITION BY src_session) AS n FROM c WHERE good AND t IS NOT NULL AND said WINDOW w AS (PARTITION BY src_session ORDER BY t, line_offset)),
s AS (SELECT DISTINCT src_session FROM session_lines WHERE src_session IS NOT NULL)
SELECT src_session FROM s
WHERE src_session IN (SELECT src_session FROM c WHERE NOT good OR t IS NULL)
   OR src_session NOT IN (SELECT src_session FROM o)
   OR src_session IN (SELECT src_session FROM o WHERE (rn = 1 AND rec_type <> 'user') OR (rn = n AND rec_type = 'user') OR (rec_type = 'user' AND before = 'user'))
"""

#: Pairs of one table that are among each other's ten most similar, by all cosines.
_PAIRS = """
SELECT '{t}' AS vec_table, a AS fact_id_a, b AS fact_id_b FROM (
  WITH d AS (SELECT len(vec) AS d FROM {t} WHERE vec IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1),
  v AS (SELECT DISTINCT ON (fact_id) fact_id, CAST(vec AS DOUBLE[]) AS vec FROM {t} WHERE len(vec) = (SELECT d FROM d) AND list_max(list_transform(vec, lambda x: abs(x))) > 0),
  p AS (SELECT x.fact_id AS a, y.fact_id AS b, list_cosine_similarity(x.vec, y.vec) AS s FROM v x JOIN v y ON x.fact_id <> y.fact_id),
  r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS rn FROM p) WHERE rn <= 10 AND s >= 0.9)
  SELECT least(a, b) AS a, greatest(a, b) AS b FROM r GROUP BY 1, 2 HAVING count(*) = 2)"""

#: Reply links by comparing every turn with all before it that the score lets win.
_LINKS = _SESSIONS[: _SESSIONS.index("s AS (SELECT DISTINCT src_session")].rstrip().rstrip(",") + r""",
i AS (SELECT src_session, line_id, unnest(CASE WHEN json_type(m, '$.content') = 'ARRAY' THEN CAST(m->'$.content' AS JSON[]) END) AS x, generate_subscripts(CASE WHEN json_type(m, '$.content') = 'ARRAY' THEN CAST(m->'$.content' AS JSON[]) END, 1) AS k FROM o),
it AS (SELECT line_id, string_agg(CASE x->>'$.type' WHEN 'text' THEN CASE WHEN json_type(x, '$.text') = 'VARCHAR' THEN x->>'$.text' END WHEN 'tool_result' THEN CASE json_type(x, '$.content') WHEN 'VARCHAR' THEN x->>'$.content' WHEN 'ARRAY' THEN array_to_string(list_transform(CAST(x->'$.content' AS JSON[]), lambda y: y->>'$.text'), chr(10)) END END, chr(10) ORDER BY k) AS text FROM i GROUP BY 1),
tx AS (SELECT o.src_session, o.line_id, o.rn, o.rec_type, epoch_us(o.t) AS us, lower(coalesce(CASE WHEN json_type(m, '$.content') = 'VARCHAR' THEN m->>'$.content' ELSE it.text END, '')) AS text FROM o LEFT JOIN it USING (line_id)),
tk AS (SELECT *, list_distinct(regexp_extract_all(text, '[\p{L}\p{N}]{3,}')) AS w, list_distinct(regexp_extract_all(text, '[a-z][a-z0-9_]*(?:[-./][a-z0-9_]+)+')) AS q FROM tx),
pr AS (SELECT a.line_id, b.line_id AS parent, a.rn - b.rn AS back, round(CASE WHEN a.rec_type <> b.rec_type THEN 1e0 ELSE 0e0 END + exp(-(a.us - b.us) / 6e8) - 0.05e0 * (a.rn - b.rn)
    + CASE WHEN len(a.q) > 0 AND len(b.q) > 0 THEN 1.5e0 * len(list_intersect(a.q, b.q)) / least(len(a.q), len(b.q)) ELSE 0e0 END + 2e0 * len(list_intersect(a.w, b.w)) / greatest(1e0, sqrt(len(a.w) * len(b.w))), 9) AS score
  FROM tk a JOIN tk b ON a.src_session = b.src_session AND b.rn < a.rn AND a.rn - b.rn <= 92)
SELECT tk.line_id, tk.rn AS turn_no, p.parent AS parent_line FROM tk LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY score DESC, back) AS n FROM pr WHERE score >= 0.9) p ON p.line_id = tk.line_id AND p.n = 1"""

SQL = {
    "p4_links": _LINKS,
    "p6_found": " UNION ALL ".join(_PAIRS.replace("{t}", t) for t in ("fact_vecs", "fact_vecs_local")),
    "p4_found": _SESSIONS,
    "p7_joined": "SELECT chunk_id, md5(text) AS hash, true AS fits FROM chunks WHERE length(text) > 0",
    "p7_found": "SELECT chunk_id FROM chunks WHERE octet_length(encode(text)) > 6000",
}
