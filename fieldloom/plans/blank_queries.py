"""Queries of blanks that words tell of, on pages made of order lines."""

from __future__ import annotations

from ..operators import blanks, pages
from .registry import query, view

_ID = "l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey AS id"
_LED = f"""SELECT l_orderkey AS page, l_linenumber % 2 AS line, {_ID}, CAST(l_linenumber * 140 + l_suppkey % 3 AS DOUBLE) AS x, CAST(l_linenumber % 2 * 40 + l_partkey % 4 AS DOUBLE) AS y, CAST(60 + l_partkey % 90 AS DOUBLE) AS width, CAST(8 + l_partkey % 15 AS DOUBLE) AS height,
CASE WHEN l_orderkey % 5 = 0 THEN CASE l_partkey % 4 WHEN 0 THEN 'نام:.......' WHEN 1 THEN 'تاریخ' WHEN 2 THEN '.........' ELSE 'پتہ' END ELSE
CASE l_partkey % 13 WHEN 0 THEN concat(p_brand, ':........') WHEN 1 THEN '(preferably).....' WHEN 2 THEN '............' WHEN 3 THEN 'of' WHEN 4 THEN '......(name' WHEN 5 THEN 'child)' WHEN 6 THEN '.......(guardian)' WHEN 7 THEN 'Date....of.........birth'
WHEN 8 THEN '(minor' WHEN 9 THEN 'ab' WHEN 10 THEN '.....____.....' WHEN 11 THEN concat(p_type, '…………') ELSE p_name END END AS text FROM <lineitem> JOIN <part> ON l_partkey = p_partkey"""
_TIDY = "array_to_string(list_filter(list_filter(string_split(trim(regexp_replace({0}, '\\s+', ' ', 'g')), ' '), lambda t: t <> ''), lambda t, i: i = 1 OR t <> list_filter(string_split(trim(regexp_replace({0}, '\\s+', ' ', 'g')), ' '), lambda u: u <> '')[i - 1]), ' ')"
_BARE = "trim(regexp_replace(rtrim(regexp_replace(trim({0}), '[.…·•_⋯‥]+$', '')), '[:：]+$', ''))"
_SHORT = "length({0}) <= 80 AND len(list_filter(string_split(trim({0}), ' '), lambda t: t <> '')) <= 12"


@query(
    f"""WITH RECURSIVE w AS (SELECT *, row_number() OVER (PARTITION BY page, line ORDER BY x, id) AS n FROM ({_LED})),
r AS (SELECT *, (SELECT run FROM (SELECT unnest(regexp_extract_all(w.text, '[.…·•_⋯‥]{{3,}}')) AS run, generate_subscripts(regexp_extract_all(w.text, '[.…·•_⋯‥]{{3,}}'), 1) AS k) ORDER BY length(run) DESC, k LIMIT 1) AS run FROM w),
p AS (SELECT *, instr(text, run) - 1 AS start, rtrim(text[:instr(text, run) - 1]) AS prefix, text[instr(text, run) + length(run):] AS suffix FROM r),
f AS (SELECT p.page, p.line, p.n, o.n AS upto, trim(concat(trim(p.suffix), ' ', string_agg(o.text, ' ' ORDER BY o.n) OVER (PARTITION BY p.page, p.line, p.n ORDER BY o.n))) AS said FROM p JOIN p o ON o.page = p.page AND o.line = p.line AND o.n > p.n WHERE p.run IS NOT NULL),
g AS (SELECT *, regexp_matches(said, '\\([^)]*\\)') AS closed, coalesce(max(CASE WHEN length(said) > 80 THEN 1 ELSE 0 END) OVER (PARTITION BY page, line, n ORDER BY upto ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lost FROM f),
h AS (SELECT page, line, n, {_BARE.format("arg_min(regexp_extract(said, '\\(([^)]*)\\)', 1), upto)")} AS hint FROM g WHERE closed AND lost = 0 GROUP BY page, line, n),
q AS (SELECT p.*, CASE WHEN length(hint) >= 3 AND {_SHORT.format("hint")} THEN hint END AS hint FROM p LEFT JOIN h USING (page, line, n)),
s AS (SELECT page, line, 0::BIGINT AS n, []::VARCHAR[] AS waiting, false AS closing, NULL::VARCHAR AS caption, NULL::DOUBLE AS bx, NULL::DOUBLE AS bw FROM q WHERE n = 1 UNION ALL
SELECT page, line, n, CASE WHEN was THEN waiting WHEN run IS NULL THEN list_append(waiting, text) ELSE [] END, CASE WHEN was THEN NOT contains(text, ')') ELSE coalesce(ok AND hint IS NOT NULL AND NOT contains(suffix, ')'), false) END, CASE WHEN ok AND NOT was THEN cap END, CASE WHEN ok AND NOT was THEN pos END, CASE WHEN ok AND NOT was THEN wide END FROM (
SELECT *, cap IS NOT NULL AND {_SHORT.format("cap")} AND NOT (length(cap) > 42 AND len(list_filter(string_split(trim(cap), ' '), lambda t: t <> '')) >= 4) AND wide >= 40 AS ok FROM (
SELECT *, coalesce(hint, CASE WHEN length(before) >= 3 AND lower(before) NOT IN ('a', 'an', 'and', 'as', 'at', 'by', 'for', 'in', 'of', 'on', 'or', 'the', 'to', 'with') THEN before END) AS cap, CASE WHEN span < 40 THEN x + width - pos ELSE span END AS wide FROM (
SELECT q.*, s.waiting, s.closing AS was, {_BARE.format(_TIDY.format("array_to_string(CASE WHEN q.prefix = '' OR starts_with(q.prefix, '(') OR q.prefix IS NULL THEN s.waiting ELSE list_append(s.waiting, q.prefix) END, ' ')"))} AS before, q.x + trunc(q.width * q.start / length(q.text)) AS pos, trunc(q.width * length(q.run) / length(q.text)) AS span
FROM s JOIN q ON q.page = s.page AND q.line = s.line AND q.n = s.n + 1)))),
b AS (SELECT page, line, min(y) AS top, max(y + height) - min(y) AS deep FROM w GROUP BY page, line)
SELECT page, line, CAST(row_number() OVER (PARTITION BY page, line ORDER BY n) - 1 AS INTEGER) AS n, caption, bx AS x, top - 2 AS y, bw AS width, greatest(16.0, deep + 6)::DOUBLE AS height FROM s JOIN b USING (page, line) WHERE caption IS NOT NULL"""
)
def leader_blanks(spark, sf_dir):
    """Blanks of dotted leaders, named by what stands before them or in parentheses behind."""
    return blanks.leader_blanks(view(spark, sf_dir, _LED), ["page"])


_STACKED = f"""SELECT l_orderkey AS page, l_suppkey % 2 AS cell, {_ID}, CAST(10 + l_partkey % 3 * 50 AS DOUBLE) AS x, CAST(l_linenumber * 30 AS DOUBLE) AS y, CAST(40 + l_partkey % 7 * 25 AS DOUBLE) AS width, CAST(14 + l_partkey % 5 AS DOUBLE) AS height, CAST(NULL AS INT) AS reading_index,
CASE l_partkey % 9 WHEN 0 THEN 'Name of elector:' WHEN 1 THEN 'assembly constituency' WHEN 2 THEN ': father' WHEN 3 THEN 'photo' WHEN 4 THEN 'paste here' WHEN 5 THEN concat(p_name, ' . . .....') WHEN 6 THEN concat(p_name, ':') WHEN 7 THEN ' ' ELSE 'one two three four five six seven eight nine ten eleven twelve thirteen:' END AS text FROM <lineitem> JOIN <part> ON l_partkey = p_partkey"""
_GRID = f"SELECT DISTINCT page, cell, CAST(5 AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS y, CAST(260 + page % 3 * 60 AS DOUBLE) AS width, CAST(240 AS DOUBLE) AS height, page % 4 = 0 AS rtl FROM ({_STACKED}) AS w"
_ASK = "nullif(trim(CASE WHEN regexp_matches({0}, '[:：]$') THEN regexp_replace({0}, '[:：]$', '') WHEN regexp_matches({0}, '^[:：]') THEN regexp_replace({0}, '^[:：]', '') END), '')"
_TEXT_BARE = "rtrim(regexp_replace(trim({0}), '[.…·•_⋯‥]+$', ''))"


def _asks(text: str) -> str:
    return _ASK.format(_TEXT_BARE.format(text))


@query(
    f"""WITH y AS (SELECT page, cell, y, string_agg(text, ' ' ORDER BY x, id) AS raw, min(x) AS l, max(x + width) AS r, max(y + height) AS b FROM ({_STACKED}) GROUP BY page, cell, y), t AS (SELECT *, {_TIDY.format("raw")} AS said FROM y),
l AS (SELECT page, cell, said AS text, l, r, y AS t, b, row_number() OVER (PARTITION BY page, cell ORDER BY y) AS n FROM t WHERE trim(said) <> ''),
a AS (SELECT *, {_asks("text")} IS NOT NULL AS asks FROM l),
c AS (SELECT *, NOT asks AND coalesce(lead(asks) OVER (PARTITION BY page, cell ORDER BY n), false) AS wraps FROM a),
m AS (SELECT c.page, c.cell, c.n, CASE WHEN p.wraps THEN concat_ws(' ', trim(p.text), trim(c.text)) ELSE c.text END AS text, CASE WHEN p.wraps THEN least(p.l, c.l) ELSE c.l END AS l, CASE WHEN p.wraps THEN greatest(p.r, c.r) ELSE c.r END AS r, CASE WHEN p.wraps THEN least(p.t, c.t) ELSE c.t END AS t, CASE WHEN p.wraps THEN greatest(p.b, c.b) ELSE c.b END AS b
FROM c LEFT JOIN c p ON p.page = c.page AND p.cell = c.cell AND p.n = c.n - 1 WHERE NOT c.wraps),
g AS (SELECT * FROM ({_GRID})),
k AS (SELECT m.*, g.x AS gx, g.y AS gy, g.width AS gw, g.rtl, {_asks("m.text")} AS ask, trim(regexp_replace(regexp_replace(trim(m.text), '^[:：]+', ''), '[:：]+$', '')) AS bare FROM m JOIN g USING (page, cell)),
o AS (SELECT *, bool_and(ask IS NULL) OVER (PARTITION BY page, cell) AS silent, (SELECT count(*) FROM l WHERE l.page = k.page AND l.cell = k.cell) AS n_lines, coalesce(ask, CASE WHEN bare <> '' AND r - l <= gw * 0.72 THEN bare END) AS caption FROM k),
q AS (SELECT *, len(list_filter(string_split(trim(caption), ' '), lambda t: t <> '')) AS nw, row_number() OVER (PARTITION BY page, cell ORDER BY n) - 1 AS pos, count(*) OVER (PARTITION BY page, cell) AS many FROM o WHERE caption IS NOT NULL AND {_SHORT.format("caption")} AND n_lines >= 2),
v AS (SELECT *, many = 2 AND silent AND max(CASE WHEN pos = 0 THEN nw END) OVER (PARTITION BY page, cell) <= 3 AND max(CASE WHEN pos = 1 THEN nw END) OVER (PARTITION BY page, cell) <= 2 AS photo, CASE WHEN rtl THEN l - gx ELSE gx + gw - r END AS free FROM q)
SELECT page, cell, CAST(pos AS INTEGER) AS n, caption, CASE WHEN rtl THEN gx + 2 ELSE r + 6 END AS x, greatest(gy, t - 2) AS y, free - 8 AS width, greatest(16.0, b - t)::DOUBLE AS height FROM v WHERE many >= 2 AND NOT photo AND free >= 40"""
)
def stacked_blanks(spark, sf_dir):
    """A blank for each of several captions in a cell."""
    return blanks.stacked_blanks(view(spark, sf_dir, _STACKED), view(spark, sf_dir, _GRID), ["page"])


_NEAR = f"""SELECT l_orderkey AS page, {_ID}, l_linenumber AS part, CAST(0.1 + l_partkey % 8 * 0.1 AS DOUBLE) AS x, CAST(0.05 + l_suppkey % 6 * 0.03 AS DOUBLE) AS y, CAST(0.05 + l_partkey % 3 * 0.02 AS DOUBLE) AS width, CAST(0.02 AS DOUBLE) AS height, l_orderkey % 4 = 0 AS rtl, CAST(l_suppkey % 6 AS INT) AS line,
CASE l_partkey % 7 WHEN 0 THEN '| |' WHEN 1 THEN '12 34' WHEN 2 THEN 'Date:' WHEN 3 THEN '__ __ __' WHEN 4 THEN '- a.' ELSE p_brand END AS text, CASE WHEN l_suppkey % 7 = 0 THEN 'named' WHEN l_suppkey % 7 = 1 THEN ' ' END AS label, CASE WHEN l_partkey % 9 = 0 THEN 'head' END AS column_header, CASE WHEN l_partkey % 10 = 0 THEN 'sub' ELSE '' END AS sub_header FROM <lineitem> JOIN <part> ON l_partkey = p_partkey"""
_PLAUSIBLE = r"""length(label) BETWEEN 3 AND 60 AND NOT contains(label, '|') AND length(label) - length(replace(label, '_', '')) <= 2 AND len(list_filter(regexp_extract_all(lower(label), '[a-z0-9]+'), lambda t: length(t) >= 2)) > 0
AND NOT regexp_matches(regexp_replace(label, '[^\p{L}]', ' ', 'g'), '(^| )[A-Za-z]{16,}( |$)') AND len(regexp_extract_all(label, '[\p{L}\p{M}]')) / greatest(len(regexp_extract_all(label, '[^\s]')), 1) >= 0.7"""


@query(
    f"""WITH a AS (SELECT * FROM ({_NEAR})), f AS (SELECT * FROM a WHERE part % 2 = 0 AND coalesce(trim(label), '') = '' AND coalesce(trim(sub_header), '') = '' AND coalesce(trim(column_header), '') = ''),
g AS (SELECT page, id, rtl, least(1.0, x + width) AS edge, greatest(height * 0.6, 0.012) AS pad, greatest(0.0, x - 0.42) AS start, x, y, width, height FROM f),
r AS (SELECT page, id, rtl, 0 AS region, CASE WHEN rtl THEN edge ELSE start END AS rx, greatest(0.0, y - pad) AS ry, CASE WHEN rtl THEN least(0.42, 1.0 - edge) ELSE x - start END AS rw, height + 2 * pad AS rh FROM g UNION ALL
SELECT page, id, rtl, 1, CASE WHEN rtl THEN greatest(0.0, edge - 0.6) ELSE x END, greatest(0.0, y - 0.045), CASE WHEN rtl THEN edge - greatest(0.0, edge - 0.6) ELSE least(width, 0.6) END, 0.042 FROM g),
w AS (SELECT page, id AS word, text, line, x, x + width / 2 AS cx, y + height / 2 AS cy FROM a WHERE part % 2 = 1),
i AS (SELECT r.page, r.id, region, word, text, line, CASE WHEN rtl THEN -w.x ELSE w.x END AS pos FROM r JOIN w ON w.page = r.page AND cx BETWEEN rx AND rx + rw AND cy BETWEEN ry AND ry + rh WHERE rw > 0 AND rh > 0),
s AS (SELECT page, id, region, 0 AS way, string_agg(text, ' ' ORDER BY pos, word) AS label FROM i GROUP BY page, id, region UNION ALL SELECT page, id, region, 1, string_agg(text, ' ' ORDER BY line, pos, word) FROM i GROUP BY page, id, region),
c AS (SELECT page, id, region, way, regexp_replace(regexp_replace(label, '^[ :.\\-۔।]+', ''), '[ :.\\-۔।]+$', '') AS label FROM s)
SELECT page, id, arg_min(label, (region, way)) AS label, 'latin' AS script, arg_min(region, (region, way)) AS region FROM c WHERE {_PLAUSIBLE} GROUP BY page, id"""
)
def recovered_labels(spark, sf_dir):
    """Labels read again beside or above fields that have neither label nor heading."""
    every = view(spark, sf_dir, _NEAR)
    return blanks.recovered_labels(every.where("part % 2 = 0").drop("text", "line", "part"), every.where("part % 2 = 1").select("page", "id", *pages.BOX, "text", "line"), ["page"])
