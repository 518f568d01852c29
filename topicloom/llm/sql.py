"""DuckDB SQL of the numbered queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"

JACCARD_CLASSES = rf"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents
),
shingle AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) = 0 THEN []
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
  FROM split
),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
),
link AS (
  SELECT a, b FROM shared JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
  WHERE 100 * shared.n >= 90 * (x.n + y.n - shared.n)
),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON reach.other = link.a
)
SELECT reach.doc_id, coalesce(any_value(size.n), 0) AS n_shingles, min(other) AS component_id
FROM reach LEFT JOIN size ON size.doc_id = reach.doc_id GROUP BY reach.doc_id
"""

REPEATED_PASSAGES = rf"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
spot AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM split)
),
least AS (SELECT g, min(doc_id) AS m FROM spot GROUP BY g),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS place FROM spot JOIN least USING (g) WHERE m < doc_id
),
cut AS (SELECT doc_id, list(place) AS places FROM gone GROUP BY doc_id)
SELECT split.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(cut.places), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN cut.places IS NULL THEN w
    ELSE list_filter(w, lambda x, i: NOT list_contains(cut.places, i)) END, ' '), '')) AS kept_sha256
FROM split LEFT JOIN cut ON cut.doc_id = split.doc_id
"""

REPEATED_LINES = r"""
WITH line AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i
  FROM documents
),
hashed AS (SELECT *, CAST('0x' || md5(l)[1:8] AS BIGINT) AS h FROM line),
rolled AS (
  SELECT doc_id, i, i = 0 OR i = max(i) OVER (PARTITION BY doc_id)
    OR ((lag(h) OVER (PARTITION BY doc_id ORDER BY i) * 1000003 + h) >> 13) % 4 <> 0 AS ends FROM hashed
),
span AS (
  SELECT doc_id, greatest(i - 1, 0) AS start, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS last FROM rolled WHERE ends
),
chunk AS (
  SELECT s.doc_id, start, last, string_agg(l, chr(10) ORDER BY i) AS t
  FROM span s JOIN line ON line.doc_id = s.doc_id AND i BETWEEN start AND last GROUP BY ALL
),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(start, last + 1)) AS i FROM (
    SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, start) AS r FROM chunk
    WHERE regexp_matches(t, '[^\x20\x09-\x0D][^\n]*\n[\x20\x09-\x0D]*[^\x20\x09-\x0D]'))
  WHERE r > 1
)
SELECT d.doc_id, coalesce(any_value(k.n_removed), 0)::BIGINT AS lines_removed,
  any_value(CASE WHEN k.n_removed > 0 THEN sha256(coalesce(k.t, '')) ELSE sha256(d.text) END) AS kept_sha256
FROM documents d LEFT JOIN (
  SELECT n.doc_id, count(*) FILTER (g.i IS NOT NULL) AS n_removed,
    string_agg(l, chr(10) ORDER BY n.i) FILTER (g.i IS NULL) AS t
  FROM line n LEFT JOIN gone g ON g.doc_id = n.doc_id AND g.i = n.i GROUP BY n.doc_id) k ON k.doc_id = d.doc_id
GROUP BY d.doc_id
"""

#: The table of crc32 and the checksum of a text of ASCII characters.
CRC_TABLE = """
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
      lambda c, z: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)) AS c
    FROM range(256) r(i))
"""


def crc32(text: str) -> str:
    """SQL for the unsigned crc32 of an ASCII text, given the table of ``CRC_TABLE`` as ``crc.t``."""
    return f"""xor(4294967295::UBIGINT, list_reduce(
      list_prepend(4294967295::UBIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::UBIGINT)),
      lambda c, b: xor(c >> 8, crc.t[((xor(c, b) & 255) + 1)::BIGINT])))"""


PREFIX_TRIE = f"""
WITH crc AS ({CRC_TABLE}),
own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i,
    md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS k, length(coalesce(text, '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL
),
conv AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {crc32("conv_id::VARCHAR")} % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM own), crc),
turn AS (
  SELECT c.conv_id, i, k, n FROM conv c JOIN own o ON o.conv_id = c.base AND o.i <= c.h
  UNION ALL SELECT c.conv_id, 1000000 + i, k, n FROM conv c JOIN own o ON o.conv_id = c.conv_id AND o.i > c.h
),
placed AS (SELECT conv_id, k, n, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS d FROM turn),
path AS (
  SELECT conv_id, d, n, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY d) AS p FROM placed
  UNION ALL SELECT conv_id, 0, 0, '' FROM conv
),
last AS (SELECT conv_id, max(d) AS d FROM path GROUP BY conv_id),
node AS (
  SELECT p, path.d, min(path.conv_id) AS conv_id, count(*) AS n_convs, any_value(n) AS n,
    sha256(coalesce(string_agg(path.conv_id::VARCHAR, ',' ORDER BY path.conv_id) FILTER (last.d = path.d), '')) AS ends_sha256
  FROM path JOIN last ON last.conv_id = path.conv_id GROUP BY p, path.d
),
inner_node AS (
  SELECT a.p, count(*) AS n_children, any_value(b.d) AS d FROM node a JOIN node b ON b.d = a.d + 1 AND left(b.p, 32 * a.d) = a.p GROUP BY a.p
),
valued AS (
  SELECT node.p, node.d, node.conv_id, (n_convs - 1) * n AS saved, (i.p IS NULL)::INT AS leaf
  FROM node LEFT JOIN inner_node i ON i.p = node.p
),
below AS (
  SELECT path.p, sum(saved) AS saved_tokens, sum(leaf) AS n_leaves
  FROM valued v JOIN path ON path.conv_id = v.conv_id AND path.d <= v.d GROUP BY path.p
)
SELECT node.conv_id, node.d::BIGINT AS depth, up.conv_id AS parent_conv_id, node.n_convs,
  coalesce(i.n_children, 0)::BIGINT AS n_children, b.n_leaves::BIGINT AS n_leaves, b.saved_tokens::BIGINT AS saved_tokens,
  node.ends_sha256
FROM node JOIN below b ON b.p = node.p LEFT JOIN inner_node i ON i.p = node.p
  LEFT JOIN node up ON up.d = node.d - 1 AND up.p = left(node.p, 32 * (node.d - 1))
"""

STRUCTURE_REPAIR = f"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
original AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32("concat(conv_id, ':', coalesce(turn::VARCHAR, ' '))")} % 20 AS e
  FROM (SELECT * FROM conversations WHERE conv_id IS NOT NULL), crc
),
damaged AS (
  SELECT conv_id, turn, CASE WHEN e = 4 THEN 'user' ELSE role END AS role,
    CASE e WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN e = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM original WHERE e > 0
),
placed AS (
  SELECT *, left(role, 1) AS initial,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat(length(role), ':', role, text)), copy) AS i
  FROM damaged
),
marked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair,
    right(rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 1) AS ending
  FROM placed
),
turn AS (
  SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN seen THEN 'duplicate' WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' END AS fault
  FROM marked
),
inserted AS (
  SELECT * FROM (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 3, 'I', chr(10) || 'user:'),
    (0, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 2, 3, 'I', chr(10) || 'user:'),
    (1, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (2, 3, 3, 'I', chr(10) || 'assistant:'),
    (3, 2, 3, 'I', chr(10) || 'user:')) v(before, after, cost, edits, lines)
),
kept AS (SELECT * FROM (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)) v(initial, before, after)),
wanted AS (SELECT * FROM (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')) v(before, after, role)),
edit AS (
  SELECT conv_id, i, before, before AS after, 4 AS cost, 'D' AS edits, '' AS lines FROM turn, range(4) s(before)
  UNION ALL SELECT conv_id, i, before, after, CASE WHEN fault IS NULL THEN 0 ELSE 3 END, 'K', chr(10) || role || ':' || text
  FROM turn JOIN kept ON kept.initial = turn.initial WHERE fault IS NULL OR fault = 'truncated'
  UNION ALL SELECT conv_id, i, before, after, CASE WHEN fault IS NULL THEN 3 ELSE 6 END, 'R', chr(10) || wanted.role || ':' || text
  FROM turn, wanted WHERE fault IS NULL OR fault = 'truncated'
),
step AS (
  SELECT conv_id, i, n.before, e.after, n.cost + e.cost AS cost, n.edits || e.edits AS edits, n.lines || e.lines AS lines
  FROM edit e JOIN inserted n ON n.after = e.before
),
conv AS (SELECT DISTINCT conv_id FROM original),
best AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS state, {{'cost': 0, 'edits': '', 'lines': ''}} AS b FROM conv
  UNION ALL
  SELECT best.conv_id, best.i + 1, step.after,
    min({{'cost': b.cost + step.cost, 'edits': b.edits || step.edits, 'lines': b.lines || step.lines}})
  FROM best JOIN step ON step.conv_id = best.conv_id AND step.i = best.i + 1 AND step.before = best.state
  GROUP BY best.conv_id, best.i + 1, step.after
),
size AS (
  SELECT conv.conv_id, count(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM conv LEFT JOIN turn ON turn.conv_id = conv.conv_id GROUP BY conv.conv_id
),
final AS (
  SELECT best.conv_id, min({{'cost': b.cost + n.cost, 'edits': b.edits || n.edits, 'lines': b.lines || n.lines}}) AS b
  FROM best JOIN size ON size.conv_id = best.conv_id AND size.n = best.i JOIN inserted n ON n.before = best.state
  WHERE n.after IN (0, 3) GROUP BY best.conv_id
)
SELECT size.conv_id, gaps, blank, duplicate, truncated, illegal, b.cost::BIGINT AS cost, b.edits AS audit,
  sha256(substr(b.lines, 2)) AS repaired_sha256
FROM size JOIN final ON final.conv_id = size.conv_id
"""
