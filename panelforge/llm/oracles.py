"""DuckDB SQL for the text queries that SQL can express."""

from __future__ import annotations

OP3_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT) FOR e IN embedding] AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([e FOR e IN embedding IF e IS NULL OR NOT isfinite(e)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP11_SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i))
), d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS w FROM documents
), c AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS k, w, count(*) AS n FROM d GROUP BY ALL),
hexed AS (SELECT w, n, hex(encode(k || ':' || w)) AS x FROM c),
crc AS (
  SELECT w, n, xor(list_reduce([CAST(4294967295 AS BIGINT)] || [CAST('0x' || x[2 * i + 1 : 2 * i + 2] AS BIGINT) FOR i IN range(length(x) // 2)], lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM hexed, tab
), slipped AS (SELECT CASE WHEN h % 97 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM crc),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS c FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
pairs AS (
  SELECT x.word AS a, y.word AS b, y.n AS m FROM cut x JOIN cut y ON x.c = y.c AND x.i = y.i AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM cut x JOIN v y ON x.c = y.word
  UNION SELECT y.word, x.word, x.n FROM cut x JOIN v y ON x.c = y.word
), best AS (SELECT a, count(*) AS n_near, min({'m': -m, 'b': b}) AS f FROM pairs GROUP BY a),
r AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -f.m >= 2 * n THEN f.b END AS form, CASE WHEN -f.m >= 2 * n THEN -f.m END AS form_n FROM v LEFT JOIN best ON a = word),
way(word, top) AS (SELECT word, word FROM r UNION SELECT way.word, r.form FROM way JOIN r ON r.word = way.top WHERE r.form IS NOT NULL)
SELECT r.word, r.form, way.top AS root, r.n, CAST(r.n_near AS BIGINT) AS n_near, CAST(r.form_n AS BIGINT) AS form_n
FROM r JOIN way ON way.word = r.word JOIN r l ON l.word = way.top AND l.form IS NULL
"""

OP12_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
  [CAST('0x' || h[8 * i + 1 : 8 * i + 8] AS BIGINT) FOR i IN range(4)] AS h FROM t),
f AS (SELECT *, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS lo, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS hi,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(u[1 : lo], '') AS a, array_to_string(u[lo + 1 : hi], '') AS b, array_to_string(u[hi + 1 :], '') AS c FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(b) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""

OP13_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, r, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM w
), g AS (SELECT r, len(s) AS n, unnest(s) AS g FROM s), pair AS (
  SELECT x.r AS a, y.r AS b FROM g x JOIN g y ON x.g = y.g AND x.r < y.r GROUP BY x.r, y.r, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), e AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair),
reach(r, other) AS (SELECT r, r FROM s UNION SELECT reach.r, e.b FROM reach JOIN e ON e.a = reach.other)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
FROM s JOIN reach ON reach.r = s.r JOIN s o ON o.r = reach.other GROUP BY s.r, s.doc_id, s.s
"""

ORACLES = {"op3_threshold_top_k": OP3_SQL, "op11_spelling_variants": OP11_SQL, "op12_fill_in_middle": OP12_SQL, "op13_ngram_jaccard_join": OP13_SQL}
