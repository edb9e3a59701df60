"""SQL of the two conversation operators."""

from __future__ import annotations


def checksum(text: str) -> str:
    """CRC-32 of an ASCII string, bit by bit."""
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    turn = "xor(v >> 1, CASE WHEN v & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE CAST(0 AS BIGINT) END)"
    byte = f"list_reduce([xor(c, b)] || [CAST(z AS BIGINT) FOR z IN range(8)], lambda v, z: {turn})"
    return f"xor(list_reduce([CAST(4294967295 AS BIGINT)] || {codes}, lambda c, b: {byte}), CAST(4294967295 AS BIGINT))"


def _edit(path: str, cost: str, edit: str) -> str:
    """A path is its cost in eight digits and its audit, so that the least string is the cheapest, then the ASCII-least."""
    return f"(printf('%08d', CAST(left({path}, 8) AS INTEGER) + {cost}) || substr({path}, 9) || '{edit}')"


_INTO_USER = "least(s0, s1, s3)"
OP12 = f"""
WITH RECURSIVE base AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {checksum("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations),
hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM base WHERE kind <> 0),
placed AS (SELECT conv_id, turn, role, text, left(role, 1) AS initial, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS seen,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM hurt),
f AS (SELECT *, CASE WHEN seen = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN right(seen, 1) IN ('.', '!', '?') THEN '-' ELSE 't' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY n) AS prior FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS nth FROM placed)),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
         count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (prior || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS rows_left FROM f GROUP BY conv_id),
d(conv_id, n, s0, s1, s2, s3) AS (
  SELECT conv_id, CAST(0 AS BIGINT), '00000000', CAST(NULL AS VARCHAR), '00000002I', '00000004II' FROM facts
  UNION ALL
  SELECT conv_id, n, t0, t1, u2, least(t3, {_edit("u2", "2", "I")}) FROM (
    SELECT *, least(t2, {_edit("t0", "2", "I")}, {_edit("t1", "2", "I")}, {_edit("t3", "2", "I")}) AS u2 FROM (
      SELECT d.conv_id, f.n, {_edit("s0", "3", "D")} AS t0,
             least({_edit("s1", "3", "D")}, CASE WHEN live AND initial = 's' THEN {_edit("s0", "late", "K")} END) AS t1,
             least({_edit("s2", "3", "D")}, CASE WHEN live AND initial = 'u' THEN {_edit(_INTO_USER, "late", "K")} END,
                   CASE WHEN live THEN {_edit(_INTO_USER, "2 + late", "R")} END) AS t2,
             least({_edit("s3", "3", "D")}, CASE WHEN live AND initial = 'a' THEN {_edit("s2", "late", "K")} END,
                   CASE WHEN live THEN {_edit("s2", "2 + late", "R")} END) AS t3
      FROM d JOIN (SELECT conv_id, n, initial, fault NOT IN ('b', 'd') AS live, CASE WHEN fault = 't' THEN 1 ELSE 0 END AS late FROM f) f
        ON f.conv_id = d.conv_id AND f.n = d.n + 1))),
best AS (SELECT facts.*, CAST(left(least(s0, s3), 8) AS BIGINT) AS cost, substr(least(s0, s3), 9) AS audit
         FROM facts JOIN d ON d.conv_id = facts.conv_id AND d.n = facts.rows_left),
e AS (SELECT conv_id, unnest(string_split(audit, '')) AS edit, generate_subscripts(string_split(audit, ''), 1) AS k FROM best WHERE audit <> ''),
p AS (SELECT *, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv_id ORDER BY k) AS n,
         count(*) FILTER (edit <> 'D') OVER (PARTITION BY conv_id ORDER BY k) AS place FROM e),
r AS (SELECT p.*, f.role, f.text, max(CASE WHEN p.place = 1 AND p.edit = 'K' AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv_id) AS system
      FROM p JOIN f ON f.conv_id = p.conv_id AND f.n = greatest(p.n, 1)),
lines AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
         CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY place) AS whole FROM r WHERE edit <> 'D' GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN best ON best.conv_id = c.conv_id LEFT JOIN lines ON lines.conv_id = c.conv_id"""

OP13 = f"""
WITH t AS (SELECT conv_id, md5(coalesce(role, '')) || md5(coalesce(text, '')) AS step, length(coalesce(text, '')) AS chars,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {checksum("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
lent AS (SELECT c.conv_id, t.k AS depth, t.step, t.chars FROM c JOIN t ON t.conv_id = c.base AND t.k <= c.h),
n AS (SELECT c.conv_id, c.h, count(lent.depth) AS lent FROM c LEFT JOIN lent ON lent.conv_id = c.conv_id GROUP BY ALL),
s AS (SELECT * FROM lent UNION ALL SELECT t.conv_id, t.k - n.h + n.lent, t.step, t.chars FROM t JOIN n ON n.conv_id = t.conv_id AND t.k > n.h),
v AS (SELECT conv_id, depth, chars, md5(string_agg(step, ',') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM s
      UNION ALL SELECT conv_id, 0, 0, '' FROM c),
up AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, lead(node) OVER (PARTITION BY conv_id ORDER BY depth) AS next FROM v),
nodes AS (SELECT node, min(conv_id) AS conv_id, min(depth) AS depth, min(parent) AS parent, count(*) AS n_convs, min(chars) AS chars,
                 count(DISTINCT next) AS n_children, sha256(coalesce(string_agg(CASE WHEN next IS NULL THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
          FROM up GROUP BY node),
under AS (SELECT DISTINCT a.node, b.node AS other FROM v a JOIN v b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
sums AS (SELECT under.node, count(*) FILTER (o.n_children = 0) AS n_leaves, CAST(sum((o.n_convs - 1) * o.chars) AS BIGINT) AS saved_tokens
         FROM under JOIN nodes o ON o.node = under.other GROUP BY under.node)
SELECT x.conv_id, CAST(x.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, x.n_convs, x.n_children, n_leaves, saved_tokens, x.ends_sha256
FROM nodes x JOIN sums ON sums.node = x.node LEFT JOIN nodes p ON p.node = x.parent"""
