"""DuckDB SQL for the operators' queries that SQL can express, over the same tables."""

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(c: str) -> str:
    return f"translate({c}, '{_UP}', '{_LOW}')"


URL_FILTER = f"""
WITH rules(rule, host, path, verdict) AS (VALUES
  ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'), ('net/de/', 'net', '/de/', 'block'),
  ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
host AS (SELECT page_id, r, regexp_extract(r, '^[^/?#]*') AS h FROM rest),
parts AS (SELECT page_id, {_lower("h")} AS host, regexp_extract(substr(r, length(h) + 1), '^[^?#]*') AS path FROM host),
fits AS (
  SELECT p.page_id, arg_max(u.rule, length(u.rule)) AS rule, arg_max(u.verdict, length(u.rule)) AS verdict
  FROM parts p JOIN rules u ON (p.host = u.host OR ends_with(p.host, '.' || u.host)) AND starts_with(p.path, u.path) GROUP BY p.page_id)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM parts p LEFT JOIN fits f USING (page_id)
"""

NEAR_DUP = rf"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all({_lower("text")}, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS sh FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM comp LEFT JOIN n USING (doc_id)
"""

TOP_K = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""

_WORDS = rf"coalesce(regexp_extract_all({_lower('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
DECONTAMINATE = f"""
WITH i AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, len(ws[k:k + 9]) AS m, array_to_string(ws[k:k + 9], ' ') AS w
  FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 9))) AS k FROM i WHERE len(ws) > 0)),
d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
sizes AS (SELECT DISTINCT m FROM windows),
places AS (
  SELECT doc_id, m, k, array_to_string(ws[k:k + m - 1], ' ') AS w
  FROM (SELECT doc_id, ws, m, unnest(generate_series(1, len(ws) - m + 1)) AS k FROM d, sizes WHERE len(ws) >= m)),
found AS (SELECT p.doc_id, p.k, p.m, w.item_id FROM places p JOIN windows w ON p.m = w.m AND p.w = w.w),
hits AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(k, k + m - 1)) AS pos FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM found GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

TOOL_CALLS = """
WITH RECURSIVE asked AS (
  SELECT conv_id, turn, text, turn::VARCHAR AS call_id, CASE role WHEN 'user' THEN 'reply' ELSE 'configure' END AS name FROM conversations WHERE role IN ('user', 'system')),
c AS (SELECT *, row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn, name, text) AS nth FROM asked),
r AS (
  SELECT conv_id, (turn - 1)::VARCHAR AS call_id, turn, text, row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) AS nth FROM conversations WHERE role = 'assistant'),
first AS (SELECT conv_id, turn FROM c WHERE nth = 1),
near AS (
  SELECT a.conv_id, a.turn, arg_min(b.turn, abs(b.turn - a.turn)) AS dep FROM first a JOIN first b ON a.conv_id = b.conv_id
  WHERE CASE WHEN a.turn % 6 = 0 THEN b.turn - a.turn IN (1, 2) WHEN a.turn % 6 IN (1, 2) THEN false ELSE a.turn - b.turn IN (1, 2) END GROUP BY ALL),
path(conv_id, turn, dep, depth) AS (
  SELECT conv_id, turn, dep, 1 FROM near UNION ALL SELECT p.conv_id, p.turn, n.dep, p.depth + 1 FROM path p JOIN near n ON p.conv_id = n.conv_id AND p.dep = n.turn),
layer AS (SELECT f.conv_id, f.turn, coalesce(max(depth), 0) AS layer FROM first f LEFT JOIN path USING (conv_id, turn) GROUP BY ALL),
placed AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY layer, turn) - 1 AS position FROM layer),
j AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, coalesce(c.turn, r.turn) AS turn, c.name, c.text AS asked, r.text AS content,
    CASE WHEN coalesce(c.nth, r.nth) > 1 THEN 'duplicate' WHEN c.turn IS NULL THEN 'orphan' WHEN r.turn IS NULL THEN 'unanswered' ELSE 'linked' END AS status, CASE WHEN c.nth = 1 THEN p.position END AS position
  FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.call_id = r.call_id AND c.nth = 1 AND r.nth = 1 LEFT JOIN placed p ON c.conv_id = p.conv_id AND c.turn = p.turn),
w AS (
  SELECT *, CASE name WHEN 'reply' THEN '{"prompt":' || to_json(asked) || ',"turn":' || turn || '}' WHEN 'configure' THEN '{"instructions":' || to_json(asked) || '}' ELSE 'null' END AS arguments FROM j)
SELECT conv_id, call_id, turn, name, status, position,
  (CASE WHEN length(asked) < 1 OR name = 'reply' AND length(asked) > 2000 THEN 1 ELSE 0 END)::BIGINT AS n_problems,
  sha256('{"arguments":' || arguments || ',"conv_id":"' || conv_id || '","id":"' || call_id || '","name":' || coalesce('"' || name || '"', 'null') || ',"result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}') AS record_sha256
FROM w
"""

LINE_DEDUP = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
w AS (
  SELECT doc_id, k, array_to_string(lines[k:k + 2], chr(10)) AS body
  FROM (SELECT doc_id, lines, unnest(generate_series(1, len(lines) - 2)) AS k FROM d WHERE len(lines) >= 3) WHERE trim(array_to_string(lines[k:k + 2], '')) <> ''),
later AS (SELECT doc_id, k FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, k) AS nth FROM w) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, unnest([k, k + 1, k + 2]) AS pos FROM later),
numbered AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
kept AS (
  SELECT n.doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY n.pos) AS text FROM numbered n ANTI JOIN gone g ON n.doc_id = g.doc_id AND n.pos = g.pos GROUP BY n.doc_id)
SELECT d.doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, (coalesce(len(lines), 0) - coalesce(kept.n, 0))::BIGINT AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE sha256(coalesce(kept.text, '')) END AS text_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

ORACLES = {
    "op1_url_filter": URL_FILTER, "op3_near_dup": NEAR_DUP, "op4_top_k": TOP_K, "op5_decontaminate": DECONTAMINATE, "op6_tool_calls": TOOL_CALLS, "op8_line_dedup": LINE_DEDUP,
}
