"""Oracle SQL (DuckDB) of the queries that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op4_decontaminate"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS win
       FROM i, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS u(p) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT doc_id, p, k, array_to_string(w[p:p + k - 1], ' ') AS win
       FROM d, ks, unnest(range(1, greatest(len(w) - k + 2, 1))) AS u(p)),
m AS (SELECT DISTINCT dw.doc_id, dw.p, dw.k, iw.item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.win = iw.win),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM m) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(t, ',' ORDER BY t)) AS sha FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id)
"""

_JACCARD_BASE = r"""
d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(p) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
q AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM q JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l)"""

ORACLES["op5_jaccard_join"] = f"""
WITH RECURSIVE {_JACCARD_BASE},
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.other)
SELECT documents.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(k.k, 0) AS BIGINT) AS n_similar, m.m AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, count(*) AS k FROM e GROUP BY x) k USING (doc_id)
JOIN (SELECT doc_id, min(other) AS m FROM r GROUP BY doc_id) m USING (doc_id)
"""

ORACLES["op1_preference_format"] = """
WITH a AS (SELECT conv_id, turn, role, text, role = 'assistant' AND turn = max(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS is_last FROM conversations),
s AS (SELECT CASE WHEN conv_id % 2 = 0 THEN conv_id + 1 ELSE conv_id - 1 END AS conv_id, text AS swap FROM a WHERE is_last),
b AS (SELECT a.conv_id, turn, role, CASE WHEN is_last THEN coalesce(swap, '') ELSE text END AS text FROM a LEFT JOIN s USING (conv_id)),
f AS (SELECT a.conv_id, min(a.turn) AS fork FROM a JOIN b USING (conv_id, turn) WHERE a.text IS DISTINCT FROM b.text GROUP BY a.conv_id),
p AS (SELECT a.conv_id, CASE WHEN fork IS NULL OR turn < fork THEN 'prompt' ELSE 'chosen' END AS part, turn, role, text FROM a LEFT JOIN f USING (conv_id)
      UNION ALL SELECT b.conv_id, 'rejected', turn, role, text FROM b JOIN f USING (conv_id) WHERE turn >= fork)
SELECT conv_id, part, turn, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered, part <> 'prompt' AND role = 'assistant' AS train FROM p
"""

ORACLES["op7_line_runs"] = r"""
WITH l AS (SELECT doc_id, j, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
           FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS j, unnest(s) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))),
n AS (SELECT doc_id, j, line, words, row_number() OVER w AS i, sum(words) OVER w AS upto FROM l WHERE words > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY j)),
p AS (SELECT a.doc_id, a.i AS s, min(b.i) AS e FROM n a JOIN n b ON a.doc_id = b.doc_id AND a.i <= b.i AND b.upto - a.upto + a.words >= 30 GROUP BY ALL
      UNION SELECT b.doc_id, max(a.i), b.i FROM n a JOIN n b ON a.doc_id = b.doc_id AND a.i <= b.i AND b.upto - a.upto + a.words >= 30 GROUP BY b.doc_id, b.i),
t AS (SELECT p.doc_id, s, e, string_agg(line, chr(10) ORDER BY i) AS run FROM p JOIN n ON n.doc_id = p.doc_id AND i BETWEEN s AND e GROUP BY ALL),
late AS (SELECT doc_id, s, e FROM (SELECT doc_id, s, e, row_number() OVER (PARTITION BY run ORDER BY doc_id, s) AS o FROM t) WHERE o > 1),
gone AS (SELECT DISTINCT late.doc_id, i FROM late JOIN n ON n.doc_id = late.doc_id AND i BETWEEN s AND e),
r AS (SELECT doc_id, count(*) AS n_runs, max(k) AS longest FROM (SELECT doc_id, count(*) AS k FROM (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM gone) GROUP BY doc_id, island) GROUP BY doc_id),
m AS (SELECT l.doc_id, l.j, l.line, n.i IS NOT NULL AS filled, gone.i IS NOT NULL AS gone FROM l LEFT JOIN n USING (doc_id, j) LEFT JOIN gone ON gone.doc_id = n.doc_id AND gone.i = n.i)
SELECT doc_id, CAST(count(*) FILTER (filled) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_deleted, coalesce(any_value(n_runs), 0) AS n_runs, coalesce(any_value(longest), 0) AS longest_run,
       coalesce(string_agg(line, chr(10) ORDER BY j) FILTER (NOT gone), '') AS text FROM m LEFT JOIN r USING (doc_id) GROUP BY doc_id
"""

ORACLES["op8_html_extract"] = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') AS s FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(s, '[ \t\n\r\f\v]+', ' ', 'g'), '</?(?:h1|p|br)>', chr(10), 'g'), '<[^>]*>', '', 'g') AS s FROM a),
c AS (SELECT page_id, url, replace(replace(replace(replace(replace(s, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS s FROM b),
d AS (SELECT page_id, url, array_to_string(list_filter(list_transform(string_split(s, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS text FROM c)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d
"""
