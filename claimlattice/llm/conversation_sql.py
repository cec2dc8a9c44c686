"""DuckDB SQL for the results of the conversation operators."""

#: DuckDB has no crc32: its table of bytes, by the rule of the polynomial EDB88320.
CRC_TABLE = """SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_table"""


def crc(text: str) -> str:
    """crc32 of an ASCII text, where ``crc_table`` is at hand."""
    codes = f"list_transform(string_split({text}, ''), lambda c: ord(c)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295], {codes}), lambda c, x: xor(c >> 8, crc_table[(xor(c, x) & 255) + 1])), 4294967295)"


OP11_SQL = rf"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
fated AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS fate
  FROM conversations, crc
), damaged AS (
  SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM fated, range(2) c(k) WHERE fate <> 0 AND (k = 0 OR fate = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said, left(role, 1) AS initial
  FROM damaged
), counted_out AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM placed
), marked AS (
  SELECT *, said = '' AS blank, said <> '' AND seen > 1 AS duplicate, said <> '' AND seen = 1 AND right(said, 1) NOT IN ('.', '!', '?') AS cut,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS illegal
  FROM counted_out
), steps(a, role, b) AS (VALUES ('-', 's', 's'), ('-', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')),
inserts AS (
  SELECT DISTINCT a, a AS b, 0 AS cost, '' AS audit FROM steps
  UNION ALL SELECT a, b, 3, 'I' FROM steps WHERE role <> 's'
  UNION ALL SELECT x.a, y.b, 6, 'II' FROM steps x JOIN steps y ON y.a = x.b WHERE x.role <> 's'
), edits AS (
  SELECT a, i.initial, g.gone, c.cut, a AS b, 4 AS cost, 'D' AS letter
  FROM (SELECT DISTINCT a FROM steps), (SELECT DISTINCT initial FROM marked) i, (VALUES (true), (false)) g(gone), (VALUES (true), (false)) c(cut)
  UNION ALL SELECT a, role, false, c.cut, b, 3 * c.cut::INT, 'K' FROM steps, (VALUES (true), (false)) c(cut)
  UNION ALL SELECT a, i.initial, false, c.cut, b, 3 + 3 * c.cut::INT, 'R'
  FROM steps, (SELECT DISTINCT initial FROM marked) i, (VALUES (true), (false)) c(cut) WHERE role <> 's'
), walk AS (
  SELECT c.conv_id, 0::BIGINT AS i, n.b AS state, {{'cost': n.cost::BIGINT, 'audit': n.audit}} AS best
  FROM (SELECT DISTINCT conv_id FROM marked) c, inserts n WHERE n.a = '-'
  UNION ALL
  SELECT w.conv_id, any_value(m.i), n.b, min({{'cost': w.best.cost + e.cost + n.cost, 'audit': w.best.audit || e.letter || n.audit}})
  FROM walk w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1
  JOIN edits e ON e.a = w.state AND e.initial = m.initial AND e.gone = (m.blank OR m.duplicate) AND e.cut = m.cut
  JOIN inserts n ON n.a = e.b
  GROUP BY w.conv_id, n.b
), counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (cut) AS truncated, count(*) FILTER (illegal) AS illegal
  FROM marked GROUP BY conv_id
), best AS (
  SELECT c.*, b.best.cost AS cost, b.best.audit AS audit
  FROM counted c JOIN (SELECT conv_id, i, min(best) AS best FROM walk WHERE state IN ('-', 'a') GROUP BY ALL) b
    ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.i = c.n
), letters AS (
  SELECT conv_id, p, letter, sum((letter <> 'I')::INT) OVER w AS i, sum((letter <> 'D')::INT) OVER w AS q
  FROM (SELECT conv_id, unnest(range(1, length(audit) + 1)) AS p, unnest(string_split(audit, '')) AS letter FROM best WHERE audit <> '')
  WINDOW w AS (PARTITION BY conv_id ORDER BY p ROWS UNBOUNDED PRECEDING)
), put AS (
  SELECT l.*, m.role AS own, CASE WHEN l.letter = 'I' THEN '' ELSE m.text END AS text,
    max((l.letter = 'K' AND m.initial = 's' AND l.q = 1)::INT) OVER (PARTITION BY l.conv_id) AS led
  FROM letters l LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM l.conv_id AND m.i = l.i WHERE l.letter <> 'D'
), mended AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN own WHEN (q - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p)) AS digest
  FROM put GROUP BY conv_id
)
SELECT o.conv_id, coalesce(b.gaps, 0)::BIGINT AS gaps, coalesce(b.blank, 0)::BIGINT AS blank, coalesce(b.duplicate, 0)::BIGINT AS duplicate,
  coalesce(b.truncated, 0)::BIGINT AS truncated, coalesce(b.illegal, 0)::BIGINT AS illegal, coalesce(b.cost, 0)::BIGINT AS cost,
  coalesce(b.audit, '') AS audit, coalesce(m.digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN mended m ON m.conv_id IS NOT DISTINCT FROM o.conv_id
"""

OP13_SQL = rf"""
WITH crc AS ({CRC_TABLE}),
everyone AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, {crc("conv_id::VARCHAR")} % 9 AS shared
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), crc
), turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), mixed AS (
  SELECT e.conv_id, 0 AS own, t.place, t.role, t.text FROM everyone e JOIN turns t ON t.conv_id = e.base AND t.place <= e.shared
  UNION ALL SELECT e.conv_id, 1, t.place, t.role, t.text FROM everyone e JOIN turns t ON t.conv_id = e.conv_id AND t.place > e.shared
), paths AS (
  SELECT e.conv_id, coalesce(list({{'role': m.role, 'text': m.text}} ORDER BY own, place) FILTER (m.conv_id IS NOT NULL), []) AS path
  FROM everyone e LEFT JOIN mixed m ON m.conv_id = e.conv_id GROUP BY e.conv_id
), nodes AS (
  SELECT path[1:d] AS path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(path) = d), '')) AS ends_sha256
  FROM (SELECT conv_id, path, unnest(range(len(path) + 1)) AS d FROM paths) GROUP BY ALL
), children AS (
  SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), known AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(n.path[depth].text) END AS saved
  FROM nodes n LEFT JOIN children c USING (path)
), sums AS (
  SELECT path[1:d] AS path, sum((n_children = 0)::INT) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT path, n_children, saved, unnest(range(depth + 1)) AS d FROM known) GROUP BY 1
)
SELECT k.conv_id, k.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves::BIGINT AS n_leaves,
  s.saved_tokens::BIGINT AS saved_tokens, k.ends_sha256
FROM known k JOIN sums s USING (path) LEFT JOIN known p ON p.depth = k.depth - 1 AND p.path = k.path[1:k.depth - 1]
"""
