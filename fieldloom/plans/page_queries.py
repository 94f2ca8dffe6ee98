"""Queries of words, cells, lines, marks and blanks on pages, made of order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields, geometry
from ..operators import layout, pages, tables
from .registry import query, view

_ID = "l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey AS id"
_WORDS = f"""SELECT l_orderkey AS page, {_ID}, CAST(l_partkey % 50 * 12 AS DOUBLE) AS x, CAST(l_suppkey % 20 * 9 AS DOUBLE) AS y, CAST(length(p_name) * 11 AS DOUBLE) AS width, CAST(10 + l_partkey % 15 AS DOUBLE) AS height,
CASE l_partkey % 5 WHEN 0 THEN concat(p_name, ':') WHEN 1 THEN concat(p_name, ' .....') WHEN 2 THEN 'signature of applicant' WHEN 3 THEN 'Office Use' ELSE p_name END AS text, CASE WHEN l_orderkey % 2 = 0 THEN l_partkey % 7 * 100 + l_linenumber END AS reading_index, l_quantity AS conf FROM <lineitem> JOIN <part> ON l_partkey = p_partkey"""
_ROWS = """WITH RECURSIVE w AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y, x, id) AS n FROM ({0})), s AS (SELECT page, n, id, [y] AS ys, [height] AS hs, 0 AS line FROM w WHERE n = 1 UNION ALL
SELECT page, n, id, CASE WHEN p IS NULL THEN list_append(ys, y) ELSE ys END, CASE WHEN p IS NULL THEN list_append(hs, height) ELSE hs END, CAST(coalesce(p - 1, len(ys)) AS INTEGER)
FROM (SELECT w.page, w.n, w.id, w.y, w.height, s.ys, s.hs, (list_filter(range(1, len(s.ys) + 1), lambda i: least(w.y + w.height, s.ys[i] + s.hs[i]) - greatest(w.y, s.ys[i]) > {1} * least(w.height, s.hs[i])))[1] AS p FROM s JOIN w ON w.page = s.page AND w.n = s.n + 1))"""


def _words(spark, sf_dir):
    return view(spark, sf_dir, _WORDS)


@query(
    f"""{_ROWS.format(_WORDS, 0.45)}, t AS (SELECT page, line, CASE WHEN count(reading_index) = count(*) THEN list(text ORDER BY reading_index, id) ELSE list(text ORDER BY x, id) END AS t FROM (SELECT page, n, line FROM s) JOIN w USING (page, n) GROUP BY page, line),
u AS (SELECT page, line, list_filter(string_split(trim(regexp_replace(array_to_string(t, ' '), '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS u FROM t)
SELECT page, line, array_to_string(list_filter(u, lambda x, i: i = 1 OR x <> u[i - 1]), ' ') AS text FROM u"""
)
def line_reading(spark, sf_dir):
    """Visual lines of words and what they read."""
    return pages.line_texts(pages.visual_lines(_words(spark, sf_dir), ["page"]), ["page"])


_CELLS = f"""SELECT page, id, x, y, width + 150 AS width, height, CASE WHEN id % 3 = 0 THEN '' ELSE text END AS text, id % 3 = 0 AS is_blank, page % 4 = 0 AS rtl, CASE WHEN id % 3 > 0 THEN x + 4 END AS text_left, CASE WHEN id % 3 > 0 THEN x + width - 4 END AS text_right FROM ({_WORDS}) AS w"""
_QUESTION = "(text LIKE '%:' OR text LIKE ':%')"
_PLACED = f"""{_ROWS.format(_CELLS, 0.5)}, c AS (SELECT w.*, line AS row FROM s JOIN w USING (page, n)),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY page, row ORDER BY CASE WHEN rtl THEN -x ELSE x END, CASE WHEN rtl THEN 0 ELSE y END, id) - 1 AS INTEGER) AS "column", row = 0 AND count(*) OVER (PARTITION BY page, row) >= 2 AND count(*) FILTER (is_blank OR {_QUESTION}) OVER (PARTITION BY page, row) = 0 AS header FROM c)"""


@query(f'{_PLACED} SELECT page, id, row, "column", header FROM t')
def table_rows(spark, sf_dir):
    """Row and column of cells, and heading rows."""
    return pages.table_cells(view(spark, sf_dir, _CELLS), ["page"]).select("page", "id", "row", "column", "header")


_FREE = "(CASE WHEN rtl THEN text_left - x ELSE x + width - text_right END)"
_CAPTION = "trim(CASE WHEN text LIKE '%:' THEN text[:-2] END)"
_IS_BLANK = f"coalesce(CASE WHEN {_FREE} < 40 THEN false WHEN {_CAPTION} IS NOT NULL THEN true WHEN {_FREE} >= 0.35 * width THEN true ELSE length(trim(text)) >= 24 AND {_FREE} >= 100 END, false)"


@query(
    f"""{_PLACED}, f AS (SELECT *, {_IS_BLANK} AS inline FROM t), b AS (SELECT * FROM f WHERE is_blank), o AS (SELECT b.page, b.id, c.row AS c_row, c."column" AS c_column, c.x AS c_x, c.id AS c_id, c.y AS c_y, c.width AS c_width, c.text AS c_text, c.is_blank AS c_blank, c.header AS c_header, c.inline AS c_inline, b.row, b.rtl, b.x, b.width,
 c.x - 4 <= b.x + b.width / 2 AND b.x + b.width / 2 <= c.x + c.width + 4 AND c.text <> '' AS over, bool_or(c.is_blank) OVER (PARTITION BY b.page, b.id, c.row) AS bare FROM b JOIN f c ON c.page = b.page),
h AS (SELECT page, id, arg_max(c_text, (c_row, c_column)) AS column_header FROM o WHERE c_header AND over GROUP BY ALL),
n AS (SELECT page, id, CASE WHEN rtl THEN c_x >= x + width - 6 ELSE c_x + c_width <= x + 6 END AS before, c_text, c_x, c_column, rtl FROM o WHERE c_row = row AND NOT c_blank),
r AS (SELECT page, id, coalesce(arg_max(c_text, (CASE WHEN rtl THEN -c_x ELSE c_x END, -c_column)) FILTER (before), CASE WHEN count(*) FILTER (c_text <> '') = 1 THEN max(c_text) FILTER (c_text <> '') END) AS row_caption FROM n GROUP BY page, id),
a AS (SELECT *, max(c_row) OVER (PARTITION BY page, id) AS near FROM o WHERE c_row < row AND NOT bare), s2 AS (SELECT page, id, CASE WHEN bool_or(c_inline OR c_header) THEN '' ELSE arg_min(c_text, c_column) FILTER (over) END AS sub_header FROM a WHERE c_row = near GROUP BY page, id)
SELECT page, id, coalesce(column_header, '') AS column_header, coalesce(row_caption, '') AS row_caption, coalesce(sub_header, '') AS sub_header FROM b LEFT JOIN h USING (page, id) LEFT JOIN r USING (page, id) LEFT JOIN s2 USING (page, id)"""
)
def table_context(spark, sf_dir):
    """What names each blank cell: the heading of its column, the caption of its row, the strip above."""
    return pages.cell_context(pages.table_cells(view(spark, sf_dir, _CELLS), ["page"]), ["page"])


@query(
    f"""SELECT page, id, CASE WHEN rtl THEN x + 2 ELSE text_right + 6 END AS blank_x, y + 2 AS blank_y, {_FREE} - 8 AS blank_width, height - 4 AS blank_height FROM ({_CELLS}) WHERE {_IS_BLANK}"""
)
def inline_blanks(spark, sf_dir):
    return pages.inline_blanks(view(spark, sf_dir, _CELLS)).select("page", "id", *[f"blank_{c}" for c in pages.BOX])


_RTL = f"SELECT page, id, x, y, width, height, text, page % 4 = 0 AS rtl FROM ({_WORDS}) AS w"
_BLANK = "CASE WHEN rtl THEN 63.0 ELSE x + width + 8 END"
_ROOM = "(CASE WHEN rtl THEN x - 63 ELSE 837 - (x + width) END)"


@query(
    f"""WITH l AS ({_RTL}), b AS (SELECT page, id, trim(text[:-2]) AS caption, CAST({_BLANK} AS DOUBLE) AS x, y - 2 AS y, CAST({_ROOM} - 8 AS DOUBLE) AS width, CAST(greatest(16, height + 6) AS DOUBLE) AS height FROM l WHERE text LIKE '%:' AND width <= 540 AND {_ROOM} >= 40)
SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM l o WHERE o.page = b.page AND o.id <> b.id AND least(b.x + b.width, o.x + o.width) > greatest(b.x, o.x) AND least(b.y + b.height, o.y + o.height) > greatest(b.y, o.y))"""
)
def line_blanks(spark, sf_dir):
    """Room behind captions that end in a colon, on pages 900 wide."""
    return pages.line_blanks(view(spark, sf_dir, _RTL), ["page"], F.lit(900), 60.0)


@query(
    f"""WITH l AS (SELECT *, coalesce(lead(y) OVER (PARTITION BY page ORDER BY y, x, id), 400) - (y + height) AS gap FROM ({_RTL})) SELECT page, id, text AS caption, gap, x AS blank_x, y + height + 4 AS blank_y, greatest(40.0, width)::DOUBLE AS blank_width, greatest(16, least(trunc(gap)::INTEGER - 6, 90)) AS blank_height
FROM l WHERE text LIKE 'signature%' AND gap >= greatest(height * 0.8, 16)"""
)
def space_below(spark, sf_dir):
    """Room to sign below short captions."""
    return pages.space_below(view(spark, sf_dir, _RTL), ["page"], 400.0, ["y", "x", "id"]).select("page", "id", "caption", "gap", "blank_x", "blank_y", "blank_width", "blank_height")


_IOU = "greatest(least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y), 0)"
_SX = "(least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x))"
_SY = "(least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y))"


@query(
    f"""WITH w AS (SELECT page, id, x, y, width, height FROM ({_WORDS})), p AS (SELECT a.page, a.id AS a_id, b.id AS b_id, {_IOU} / (a.width * a.height + b.width * b.height - {_IOU}) AS iou, {_SX} / greatest(least(a.width, b.width), 1) AS sx, {_SY} / greatest(least(a.height, b.height), 1) AS sy FROM w a JOIN w b ON a.page = b.page AND a.id < b.id WHERE {_IOU} > 0)
SELECT page, a_id, b_id, iou >= 0.3 OR (sx >= 0.5 AND sy >= 0.5) AS same_target, iou >= 0.45 OR (sx >= 0.55 AND sy >= 0.5) AS same_region FROM p"""
)
def same_places(spark, sf_dir):
    """Overlapping boxes that stand for one place."""
    w = _words(spark, sf_dir)
    met = layout.overlapping(w, w, ["page"], 60.0).where("a_id < b_id")
    boxes = geometry.box("a_"), geometry.box("b_")
    return met.select("page", "a_id", "b_id", geometry.same_target(*boxes).alias("same_target"), geometry.same_region(*boxes).alias("same_region"))


@query(
    f"""WITH w AS (SELECT page, id, least(greatest((x - 30) / 600, 0), 1) AS nx, least(greatest(y / 120, 0), 1) AS ny, width, height, id % 8 AS m FROM ({_WORDS})), n AS (SELECT *, least(greatest(width / 600, 0), 1 - nx) AS nw, least(greatest(height / 120, 0), 1 - ny) AS nh FROM w)
SELECT page, id, round(nx, 9) AS nx, round(ny, 9) AS ny, round(nw, 9) AS nw, round(nh, 9) AS nh, greatest(trunc(nw * 1240)::INTEGER, 1) AS pixels, CASE m WHEN 0 THEN width BETWEEN 10 AND 36 AND height BETWEEN 10 AND 36 ELSE width >= 80 AND height >= 16 AND height <= 26 END AS usable, greatest(0, (width - 100) / 2) AS left_of, 100 > width OR 20 > height AS overflows FROM n"""
)
def box_rules(spark, sf_dir):
    """Boxes as shares of a page of 600 by 120 and back in pixels, which of them can be answered in, and text of 100 by 20 in their middle."""
    w = _words(spark, sf_dir)
    n = geometry.normalised((F.col("x") - 30, F.col("y"), F.col("width"), F.col("height")), F.lit(600), F.lit(120))
    kind = F.when(F.col("id") % 8 == 0, "checkbox").otherwise("text")
    left, _, over = geometry.centred(geometry.box(), F.lit(100.0), F.lit(20.0))
    usable = fields.plausible_size(kind, F.col("width"), F.col("height"), F.lit(600), F.lit(120))
    return w.select("page", "id", *[F.round(c, 9).alias(name) for c, name in zip(n, ["nx", "ny", "nw", "nh"], strict=True)], geometry.to_pixels(n, F.lit(1240), F.lit(1754))[2].alias("pixels"), usable.alias("usable"), (left - F.col("x")).alias("left_of"), over.alias("overflows"))


@query(
    f"""WITH w AS ({_WORDS}), p AS (SELECT page, id, y + height / 2 AS mid, greatest(height, 20) AS reach FROM w WHERE id % 3 = 0) SELECT p.page, p.id, substr(string_agg(w.text, ' ' ORDER BY w.x, w.id), 1, 60) AS nearby FROM p JOIN w ON w.page = p.page AND abs(w.y + w.height / 2 - mid) <= reach GROUP BY p.page, p.id"""
)
def nearby_text(spark, sf_dir):
    w = _words(spark, sf_dir)
    return pages.nearby_text(w.where("id % 3 = 0"), w, ["page"], 25.0, 60)


_MARKS = f"SELECT page, id, x, y, 10.0 + id % 11 AS width, height FROM ({_WORDS}) AS w WHERE id % 2 = 0"


@query(
    f"""WITH m AS (SELECT * FROM ({_MARKS})) SELECT a.page, a.id, count(*) AS near FROM m a JOIN m b ON b.page = a.page AND abs(b.y + b.height / 2 - a.y - a.height / 2) <= greatest(a.height, 10) AND abs(b.x - a.x) <= 300 GROUP BY a.page, a.id HAVING count(*) > 1"""
)
def crowded_marks(spark, sf_dir):
    return pages.crowded(view(spark, sf_dir, _MARKS.replace("10.0 +", "10.0D +")), ["page"], 25.0, most=1, reach=300.0)


@query(
    f"""WITH w AS ({_WORDS}), k AS (SELECT * FROM w WHERE id % 2 = 1), m AS (SELECT *, x + width / 2 AS cx, y + height / 2 AS cy FROM ({_MARKS}) WHERE width / height BETWEEN 0.65 AND 1.55), b AS (SELECT * FROM w WHERE id % 7 = 1),
g AS (SELECT m.* FROM m WHERE NOT EXISTS (SELECT 1 FROM (SELECT * FROM k UNION ALL SELECT * FROM b) o WHERE o.page = m.page AND cx BETWEEN o.x AND o.x + o.width AND cy BETWEEN o.y AND o.y + o.height)
 AND NOT EXISTS (SELECT 1 FROM k WHERE k.page = m.page AND abs(k.y + k.height / 2 - cy) <= greatest(m.height, 14) AND (k.width > 180 OR length(k.text) > 48 OR len(string_split(trim(k.text), ' ')) > 8))
 AND EXISTS (SELECT 1 FROM k WHERE k.page = m.page AND abs(k.y + k.height / 2 - cy) <= greatest(m.height, 14) AND (abs(k.x - (m.x + m.width)) <= 260 OR abs(m.x - (k.x + k.width)) <= 260)))
SELECT page, id FROM g QUALIFY count(*) OVER (PARTITION BY page) <= 1"""
)
def plausible_marks(spark, sf_dir):
    """Tick boxes clear of text, beside a short line, on pages with no more than one."""
    w = _words(spark, sf_dir)
    k = w.where("id % 2 = 1")
    return pages.plausible_marks(view(spark, sf_dir, _MARKS.replace("10.0 +", "10.0D +")), k, w.where("id % 7 = 1"), k, ["page"], 300.0, 25.0, most=1).select("page", "id")


_FOUND = f"SELECT page, id, x - 40 AS x, y - 20 AS y, width + 200 AS width, height + 60 AS height, CASE id % 4 WHEN 0 THEN 'multiline' WHEN 1 THEN 'checkbox' ELSE 'text' END AS field_type FROM ({_WORDS}) AS w WHERE id % 5 < 3 UNION ALL SELECT page, -id, x + 3, y + 2, 6.0, 5.0, 'radio' FROM ({_WORDS}) AS w WHERE id % 5 = 4"


@query(
    f"""WITH w AS ({_WORDS}), f AS ({_FOUND}) SELECT page, id, field_type FROM f WHERE NOT (field_type IN ('checkbox', 'radio') AND EXISTS (SELECT 1 FROM w WHERE w.page = f.page AND f.x >= w.x - 0.004 AND f.y >= w.y - 0.004 AND f.x + f.width <= w.x + w.width + 0.004 AND f.y + f.height <= w.y + w.height + 0.004 AND f.width * f.height <= 0.85 * w.width * w.height))
AND NOT EXISTS (SELECT 1 FROM w WHERE w.page = f.page AND w.text = 'Office Use' AND w.x >= f.x AND w.y >= f.y AND w.x + w.width <= f.x + f.width AND w.y + w.height <= f.y + f.height)
AND (field_type = 'multiline' OR (SELECT count(*) FROM w WHERE w.page = f.page AND w.x >= f.x AND w.y >= f.y AND w.x + w.width <= f.x + f.width AND w.y + w.height <= f.y + f.height) < 4)"""
)
def kept_fields(spark, sf_dir):
    """Fields that hold no office note, not too much text, and are no part of a word."""
    found = view(spark, sf_dir, _FOUND.replace("6.0, 5.0", "6.0D, 5.0D"))
    return pages.kept_fields(found, _words(spark, sf_dir), ["page"], 60.0).select("page", "id", "field_type")


@query(f"SELECT page, id FROM ({_WORDS}) QUALIFY count(*) FILTER (text LIKE '%:' OR text LIKE '%.....') OVER (PARTITION BY page) < 3 OR text = 'Office Use'")
def unnamed_dropped(spark, sf_dir):
    """Shapes on pages where the text itself names three blanks or more go, but for some."""
    named = F.col("text").rlike(r":$|\.{5}$")
    return pages.without_unnamed(_words(spark, sf_dir), ["page"], named, F.col("text") == "Office Use").select("page", "id")


@query(
    f"""WITH RECURSIVE l AS (SELECT page, id, x, y, width, height, conf + least(length(text), 40) * 0.15 AS score, row_number() OVER (PARTITION BY page ORDER BY y, x, id) AS n FROM ({_WORDS})),
s AS (SELECT page, n, [{{'id': id, 'x': x, 'y': y, 'w': width, 'h': height, 'score': score}}] AS kept FROM l WHERE n = 1 UNION ALL
SELECT page, n, CASE WHEN hit IS NULL THEN list_append(kept, own) WHEN own.score > kept[hit].score THEN kept[:hit - 1] || [own] || kept[hit + 1:] ELSE kept END FROM (
SELECT l.page, l.n, s.kept, {{'id': l.id, 'x': l.x, 'y': l.y, 'w': l.width, 'h': l.height, 'score': l.score}} AS own, (list_filter(range(1, len(s.kept) + 1), lambda k: least(l.y + l.height, s.kept[k].y + s.kept[k].h) - greatest(l.y, s.kept[k].y) > 0.55 * least(l.height, s.kept[k].h)
AND least(l.x + l.width, s.kept[k].x + s.kept[k].w) - greatest(l.x, s.kept[k].x) > 0.5 * least(l.width, s.kept[k].w)))[1] AS hit FROM s JOIN l ON l.page = s.page AND l.n = s.n + 1))
SELECT page, unnest(list_transform(kept, lambda k: k.id)) AS id FROM s QUALIFY n = max(n) OVER (PARTITION BY page)"""
)
def single_readings(spark, sf_dir):
    """Of lines read twice the better reading."""
    score = F.col("conf") + F.least(F.length("text"), F.lit(40)) * 0.15
    return pages.single_readings(_words(spark, sf_dir), ["page"], score, ["y", "x", "id"]).select("page", "id")


_SHARES = f"SELECT page, id, x / 600 AS x, y / 1800 AS y, width / 2000 AS width, height / 900 AS height, text, id % 4 AS part, page % 4 = 0 AS rtl FROM ({_WORDS}) AS w"


@query()
def nearest_labels(spark, sf_dir):
    """The printed label of each field, beside or above it, each word for one field."""
    w = view(spark, sf_dir, _SHARES)
    return pages.nearest_labels(w.where("part = 0").select("page", "id", *pages.BOX, "rtl"), w.where("part > 0"), ["page"], ["y", "x", "id"])


@query(
    f"""WITH w AS ({_SHARES}), m AS (SELECT page, id, x + width AS edge, y + height / 2 AS mid, greatest(height, 0.012) AS reach FROM w WHERE part = 0), a AS (SELECT m.page, m.id, m.edge, w.x, w.width, w.text, row_number() OVER (PARTITION BY m.page, m.id ORDER BY w.x, w.id) AS n FROM m JOIN w ON w.page = m.page AND part > 0 AND abs(w.y + w.height / 2 - mid) <= reach AND w.x >= edge - 0.004),
g AS (SELECT *, x - CASE WHEN n = 1 THEN edge ELSE lag(x + width) OVER (PARTITION BY page, id ORDER BY n) END > CASE WHEN n = 1 THEN 0.03 ELSE 0.02 END AS far FROM a), c AS (SELECT *, bool_or(far) OVER (PARTITION BY page, id ORDER BY n) AS ended FROM g)
SELECT page, id, coalesce(string_agg(text, ' ' ORDER BY n) FILTER (NOT ended), '') AS option FROM c GROUP BY page, id"""
)
def option_texts(spark, sf_dir):
    w = view(spark, sf_dir, _SHARES)
    return pages.option_texts(w.where("part = 0"), w.where("part > 0"), ["page"], 0.1)


_FORM = f"SELECT page AS doc, id, CAST(id % 2 AS INT) AS page, x / 600 AS x, y / 180 AS y, width / 2000 AS width, height / 900 AS height, text AS label, CASE page % 3 WHEN 0 THEN 'hi' WHEN 1 THEN 'kn' END AS form_language FROM ({_WORDS}) AS w"
_SLOTS = """SELECT form_language, CAST(slot AS INT) AS slot, CAST(page AS INT) AS page, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(width AS DOUBLE) AS width, CAST(height AS DOUBLE) AS height, label, insert FROM (VALUES ('hi', 0, 0, 0.1, 0.25, 0.3, 0.02, 'name', true),
('hi', 1, 1, 0.4, 0.5, 0.3, 0.02, 'place', false), ('hi', 2, 0, 0.2, 0.255, 0.5, 0.02, 'date', true), ('kn', 0, 0, 0.1, 0.4, 0.6, 0.02, 'other', false)) AS t(form_language, slot, page, x, y, width, height, label, insert)"""


@query(
    f"""WITH RECURSIVE f AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page, y, x, id) AS n FROM ({_FORM})), t AS (SELECT *, row_number() OVER (PARTITION BY form_language ORDER BY slot) AS m FROM ({_SLOTS})),
d AS (SELECT DISTINCT doc, form_language FROM f JOIN t USING (form_language)), p AS (SELECT f.doc, t.m, f.n, abs(f.x + f.width / 2 - t.x - t.width / 2) AS far FROM f JOIN t ON t.form_language = f.form_language AND t.page = f.page AND abs(f.y - t.y) <= 0.016 AND least(t.x + t.width, f.x + f.width) - greatest(t.x, f.x) > 0),
c AS (SELECT doc, m, list(n ORDER BY far, n) AS near FROM p WHERE far < 1 GROUP BY doc, m), q AS (SELECT d.doc, t.m, t.label, t.insert, c.near FROM d JOIN t USING (form_language) LEFT JOIN c ON c.doc = d.doc AND c.m = t.m),
s AS (SELECT doc, 0::BIGINT AS m, []::BIGINT[] AS taken, NULL::BIGINT AS n FROM d UNION ALL SELECT doc, m, CASE WHEN own IS NULL THEN taken ELSE list_append(taken, own) END, own FROM (SELECT q.doc, q.m, s.taken, (list_filter(q.near, lambda x: NOT list_contains(s.taken, x)))[1] AS own FROM s JOIN q ON q.doc = s.doc AND q.m = s.m + 1))
SELECT f.doc, f.id, coalesce(q.label, f.label) AS label, false AS inserted FROM f LEFT JOIN s ON s.doc = f.doc AND s.n = f.n LEFT JOIN q ON q.doc = s.doc AND q.m = s.m UNION ALL SELECT q.doc, NULL, q.label, true FROM s JOIN q ON q.doc = s.doc AND q.m = s.m WHERE s.n IS NULL AND q.insert"""
)
def template_labels(spark, sf_dir):
    """Fields of a known form named by its template."""
    return pages.template_labels(view(spark, sf_dir, _FORM), view(spark, sf_dir, _SLOTS), ["doc"])


_TRUTH = f"SELECT page, id, x + 5 AS x, y, width, height FROM ({_WORDS}) AS w WHERE id % 2 = 0"
_PREDICTED = f"SELECT page, id, x, y + 3 AS y, width, height FROM ({_WORDS}) AS w WHERE id % 3 > 0"


@query(
    f"""WITH a AS ({_TRUTH}), b AS ({_PREDICTED}), m AS (SELECT a.page, a.id, EXISTS (SELECT 1 FROM b WHERE b.page = a.page AND {_IOU} > 0 AND {_IOU} >= 0.3 * (a.width * a.height + b.width * b.height - {_IOU})) AS hit FROM a), p AS (SELECT page, avg(hit::INTEGER) AS recall FROM m GROUP BY page)
SELECT page % 4 AS variant, round(avg(round(recall, 3)), 3) AS recall, count(*) AS n FROM p GROUP BY page % 4"""
)
def truth_match(spark, sf_dir):
    """Mean share of true fields that some predicted field matches, by variant."""
    a, b = view(spark, sf_dir, _TRUTH), view(spark, sf_dir, _PREDICTED)
    missed = layout.without_overlaps(a, b, ["page"], 0.3, 60.0).select("page", "id", F.lit(1).alias("missed"))
    by_page = a.join(missed, ["page", "id"], "left").groupBy("page").agg(F.round(F.avg(F.when(F.col("missed").isNull(), 1).otherwise(0)), 3).alias("recall"))
    return by_page.groupBy((F.col("page") % 4).alias("variant")).agg(F.round(F.avg("recall"), 3).alias("recall"), F.count(F.lit(1)).alias("n"))


@query(f"SELECT page, min(x) AS x, min(y) AS y, greatest(max(x + width) - min(x), 0.01) AS width, greatest(max(y + height) - min(y), 0.01) AS height FROM ({_RTL}) WHERE rtl GROUP BY page")
def union_of_lines(spark, sf_dir):
    return tables.box_union(view(spark, sf_dir, _RTL).where("rtl"), ["page"])
