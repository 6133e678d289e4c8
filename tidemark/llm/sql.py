"""DuckDB SQL that the queries must agree with, where SQL can express them."""

from __future__ import annotations

LINE_SPREAD = r"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL),
bad AS (
  SELECT trim(line) AS line, min(doc_id) AS keeper FROM l WHERE trim(line) <> ''
  GROUP BY trim(line) HAVING count(DISTINCT source) >= 10),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(bad.line) FILTER (WHERE l.doc_id <> bad.keeper) AS n_removed,
         string_agg(l.line, chr(10) ORDER BY pos) FILTER (WHERE bad.line IS NULL OR l.doc_id = bad.keeper) AS text
  FROM l LEFT JOIN bad ON trim(l.line) = bad.line GROUP BY l.doc_id)
SELECT d.doc_id, d.source, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text,
       coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id)
"""

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS ord FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1)::BIGINT AS w FROM sized GROUP BY source),
f AS (
  SELECT *, (SELECT sum(source_size) FROM s)::HUGEINT
            - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words_left,
         sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left,
         row_number() OVER o AS k
  FROM s WINDOW o AS (ORDER BY source_size / w, source NULLS LAST)),
free AS (
  SELECT words_left, w_left FROM f WHERE 3 * source_size::HUGEINT * w_left > w * words_left ORDER BY k LIMIT 1),
t AS (
  SELECT s.source, source_size,
         CASE WHEN free.w_left IS NULL OR 3 * source_size::HUGEINT * free.w_left <= w * free.words_left
              THEN (3 * source_size)::DOUBLE ELSE (w * free.words_left)::DOUBLE / free.w_left::DOUBLE END AS target
  FROM s LEFT JOIN free ON true),
g AS (
  SELECT *, goal // greatest(source_size, 1) AS whole, goal % greatest(source_size, 1) AS rest
  FROM (SELECT *, least(floor(target + 0.5)::BIGINT, 3 * source_size) AS goal FROM t)),
d AS (
  SELECT z.*, g.source_size, g.target, g.whole, g.rest,
         coalesce(sum(size) OVER (PARTITION BY z.source ORDER BY ord, z.doc_id, size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized z JOIN g ON z.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, source, size, source_size, target,
       (whole * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM d
"""

WARC = r"""
WITH p AS (
  SELECT page_id, url, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (
  SELECT payload_digest, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, url,
       CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to
FROM p LEFT JOIN k USING (payload_digest)
"""

TRIE = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS donor, count(*) AS own, xor(4294967295, list_reduce(
           flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x), -1, -1, -1, -1, -1, -1, -1, -1])),
           lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, 4294967295::BIGINT)) % 6 AS h
  FROM t GROUP BY conv_id),
m AS (SELECT c.*, least(c.h, coalesce(g.own, 0)) AS taken FROM c LEFT JOIN c g ON g.conv_id = c.donor),
r AS (
  SELECT m.conv_id, t.p AS depth, role, text FROM m JOIN t ON t.conv_id = m.donor AND t.p <= m.taken
  UNION ALL SELECT m.conv_id, t.p - m.h + m.taken, role, text FROM m JOIN t ON t.conv_id = m.conv_id AND t.p > m.h),
paths AS (
  SELECT conv_id, depth, length(text) AS chars, list([role, text]) OVER w AS key,
         list([role, text]) OVER w [:depth - 1] AS above, depth = max(depth) OVER (PARTITION BY conv_id) AS last
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY depth)
  UNION ALL SELECT conv_id, 0, 0, CAST([] AS VARCHAR[][]), NULL, NOT EXISTS (SELECT 1 FROM r WHERE r.conv_id = m.conv_id) FROM m),
nodes AS (
  SELECT depth, key, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends
  FROM paths GROUP BY depth, key),
kids AS (SELECT above AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
own AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (key)),
under AS (SELECT key[:d] AS key, sum((n_children = 0)::INT) AS leaves, sum(saved) AS saved FROM (SELECT *, unnest(range(depth + 1)) AS d FROM own) GROUP BY 1)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children::BIGINT AS n_children,
       u.leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM own n LEFT JOIN nodes p ON p.key = n.above AND n.depth > 0 JOIN under u ON u.key = n.key
"""

RANKED = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
c AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM t GROUP BY 1, 2),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM c GROUP BY 1),
g AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM d),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM c, g GROUP BY term, docs),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (
  SELECT q.item_id, c.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN c USING (term) JOIN d USING (doc_id), g GROUP BY 1, 2)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""

SQL: dict[str, str] = {
    "op2_line_spread": LINE_SPREAD,
    "op4_water_filling": MIXING,
    "op5_warc_transactions": WARC,
    "op11_tree_contraction": TRIE,
    "op12_bit_slices": RANKED,
}
