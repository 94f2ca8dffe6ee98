"""Queries of records, gates and look-ups, over orders as documents and order lines as what stands on their pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields, text
from ..operators import records, replies
from .registry import query, view

_RECORDS = "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'processing' WHEN 2 THEN 'ready' END AS status, CASE WHEN o_orderkey % 4 = 2 THEN 'ready' ELSE 'reading_text' END AS stage, o_orderpriority AS category, CAST(o_custkey % 4 AS INT) AS n_pages, CASE o_orderkey % 8 WHEN 0 THEN 'broken file' WHEN 1 THEN ' ' END AS error_message FROM <orders>"


@query(f"SELECT id, status, stage, category, n_pages AS page_count, error_message, list_transform(range(0, n_pages), lambda i: concat('/api/documents/', id, '/pages/', i)) AS page_urls FROM ({_RECORDS}) WHERE status = 'ready'")
def record_responses(spark, sf_dir):
    """What is told of documents that are ready."""
    return records.responses(records.ready(view(spark, sf_dir, _RECORDS)), "/api")


@query(f"SELECT id, coalesce(nullif(trim(error_message), ''), 'The form is still being prepared.') AS message FROM ({_RECORDS}) WHERE status IS NULL OR status <> 'ready'")
def refused_records(spark, sf_dir):
    return records.refused(view(spark, sf_dir, _RECORDS))


_FOUND = "SELECT p_partkey AS id, concat('k', p_partkey % 7) AS known_id, CASE WHEN p_partkey % 3 > 0 THEN concat('s', p_partkey % 5) ELSE ' ' END AS semantic_id FROM <part>"
_CLASSED = "SELECT ps.p_partkey AS id, p_size AS size, p_brand AS concept FROM <part> ps WHERE p_partkey % 2 = 0"
_PAGED = "SELECT p_partkey AS id, p_type AS what FROM <part> WHERE p_partkey % 5 = 0"


@query(
    f"""SELECT f.id, c.concept, i.what, CASE WHEN known_id IN ('k1', 'k4') THEN known_id WHEN semantic_id IN ('s2', 's3') THEN semantic_id END AS value_key FROM ({_FOUND}) f LEFT JOIN ({_CLASSED}) c USING (id) LEFT JOIN ({_PAGED}) i USING (id)"""
)
def looked_up_fields(spark, sf_dir):
    """Fields with what was read of them, and the key of the value that fits each."""
    found = records.with_readings(view(spark, sf_dir, _FOUND), {"classified": view(spark, sf_dir, _CLASSED), "interpreted": view(spark, sf_dir, _PAGED)}, ["id"])
    values = F.create_map(*[F.lit(x) for k in ("k1", "k4", "s2", "s3") for x in (k, "v")])
    return found.select("id", "classified.concept", "interpreted.what", records.field_key(values, F.col("known_id"), F.col("semantic_id")).alias("value_key"))


@query(f"SELECT id, known_id FROM ({_FOUND}) WHERE id IN (3, 5, 8, 1000000)")
def selected_fields(spark, sf_dir):
    return records.selected(view(spark, sf_dir, _FOUND).select("id", "known_id"), [3, 5, 8, 1_000_000])


_SCRIPTED = "SELECT l_orderkey AS doc, CASE l_partkey % 5 WHEN 0 THEN 'latin' WHEN 1 THEN 'devanagari' WHEN 2 THEN 'unknown' WHEN 3 THEN 'arabic' END AS script FROM <lineitem>"


@query(f"SELECT doc, coalesce(list_sort(list(DISTINCT script) FILTER (script <> 'unknown')), []) AS scripts FROM ({_SCRIPTED}) GROUP BY doc")
def script_sets(spark, sf_dir):
    return records.script_sets(view(spark, sf_dir, _SCRIPTED), ["doc"], "script")


_PAGE_LINES = "SELECT l_suppkey * 10 + l_linenumber AS page, l_orderkey * 10 + l_partkey % 10 AS ord, CASE WHEN l_orderkey % 211 = 0 THEN 'Name:' WHEN l_orderkey % 307 = 0 THEN 'Place ......' ELSE l_comment END AS text, CAST(CASE WHEN l_suppkey % 3 = 0 THEN 300 + l_partkey % 200 ELSE 20 + l_partkey % 470 END AS DOUBLE) AS width, l_suppkey % 17 = 0 AS in_table FROM (SELECT *, concat(l_returnflag, ' ', l_linestatus) AS l_comment FROM <lineitem>) AS l"


@query(
    f"""WITH l AS (SELECT *, max(width) OVER (PARTITION BY page) AS widest FROM ({_PAGE_LINES})), s AS (SELECT page, count(*) AS n, list_sort(list(width)) AS w, count(*) FILTER (regexp_matches(text, '[.]{{3,}}') OR (text LIKE '%:' AND width < 0.45 * widest)) AS asks, bool_or(in_table) AS t, count(*) FILTER (width >= 0.42 * 1000) AS long FROM l GROUP BY page)
SELECT page, CAST(n AS INTEGER) AS n_lines, n >= 8 AND NOT t AND asks < 2 AND (w[n // 2 + 1] / w[n] >= 0.6 OR long >= 4) AS prose FROM s"""
)
def prose_gate(spark, sf_dir):
    """Which pages read as instructions."""
    return records.prose(view(spark, sf_dir, _PAGE_LINES), ["page"], F.lit(1000.0), F.col("in_table"))


_ABOVE = "SELECT l_suppkey AS page, l_orderkey * 10 + l_linenumber AS id, CAST(l_orderkey % 900 AS DOUBLE) AS y, CAST(10 AS DOUBLE) AS height, CASE WHEN l_orderkey % 3 = 0 THEN CAST(l_partkey % 500 AS DOUBLE) END AS table_y, concat(l_returnflag, l_orderkey) AS text, l_orderkey * 10 + l_linenumber AS ord, l_linenumber AS part FROM <lineitem>"


@query(
    f"""WITH a AS (SELECT DISTINCT ON (page, id) * FROM ({_ABOVE}) ORDER BY page, id, table_y, text), b AS (SELECT * FROM a WHERE part = 1), l AS (SELECT page, y + height AS bottom, min(ord) AS ord, arg_min(text, ord) AS text FROM a WHERE part = 2 GROUP BY page, y + height)
SELECT b.page, b.id, coalesce(l.text, '') AS section FROM (SELECT page, id, coalesce(table_y, y) + 4 AS ceiling FROM b) b ASOF LEFT JOIN l ON l.page = b.page AND l.bottom <= b.ceiling"""
)
def sections_above(spark, sf_dir):
    """The line above each blank or its table."""
    rows = view(spark, sf_dir, _ABOVE)
    one = rows.groupBy("page", "id").agg(F.min(F.struct(F.coalesce("table_y", F.lit(1e9)), "table_y", "text", "y", "height", "ord", "part")).alias("r")).select("page", "id", "r.*")
    return records.sections_above(one.where("part = 1"), one.where("part = 2"), ["page"])


_SHARED = "SELECT l_orderkey AS page, l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey AS id, CAST(l_partkey % 40 AS DOUBLE) / 40 AS x, CAST(l_suppkey % 16 AS DOUBLE) / 16 AS y, l_returnflag AS text, l_linenumber AS part FROM <lineitem>"


@query(
    f"""WITH a AS ({_SHARED}), m AS (SELECT p.page, p.id, w.text, row_number() OVER (PARTITION BY p.page, p.id ORDER BY w.y, w.x, w.id) AS n FROM a p JOIN a w ON w.page = p.page AND p.part = 1 AND abs(w.y - p.y) < 0.08)
SELECT page, id, string_agg(text, ' ' ORDER BY n)[:400] AS nearby FROM m WHERE n <= 40 GROUP BY page, id"""
)
def guidance_nearby(spark, sf_dir):
    """The words near a field that a model is shown."""
    rows = view(spark, sf_dir, _SHARED).drop("part")
    return records.nearby_words(view(spark, sf_dir, _SHARED).where("part = 1"), rows, ["page"])


_GRID = "SELECT l_orderkey AS page, l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey AS id, CAST(l_partkey % 30 * 10 AS DOUBLE) AS x, CAST(l_suppkey % 30 * 10 AS DOUBLE) AS y, CAST(20 + l_partkey % 200 AS DOUBLE) AS width, CAST(20 + l_suppkey % 100 AS DOUBLE) AS height, l_linenumber % 3 AS part FROM <lineitem>"


@query(
    f"""WITH g AS ({_GRID}), w AS (SELECT page, id, x + width / 2 AS cx, y + height / 2 AS cy FROM g WHERE part = 0), t AS (SELECT w.page, w.id, w.cx, w.cy, min(g.id) AS table_id FROM w JOIN g ON g.page = w.page AND g.part = 1 AND cx BETWEEN g.x AND g.x + g.width AND cy BETWEEN g.y AND g.y + g.height GROUP BY ALL),
c AS (SELECT t.page, t.id, t.table_id, min(g.id) AS cell_id FROM t JOIN g ON g.page = t.page AND g.part = 2 AND (g.id % 2 = t.table_id % 2) AND cx BETWEEN g.x AND g.x + g.width AND cy BETWEEN g.y AND g.y + g.height GROUP BY ALL) SELECT page, id AS word_id, table_id, cell_id FROM c"""
)
def table_words(spark, sf_dir):
    """Each word's table and the cell of it that the word stands in; a cell is of all tables of its page whose ids are even as its own, or odd."""
    g = view(spark, sf_dir, _GRID)
    tabs = g.where("part = 1").select("page", F.col("id").alias("table_id"), "x", "y", "width", "height", F.col("id").alias("ord"))
    cells = g.where("part = 2").select("page", F.col("id").alias("cell_id"), "x", "y", "width", "height", F.col("id").alias("ord"))
    of = cells.join(tabs.select("page", "table_id"), "page").where(F.col("cell_id") % 2 == F.col("table_id") % 2)
    return records.words_in_tables(g.where("part = 0").withColumnRenamed("id", "word_id"), tabs, of, ["page"], 40.0)


_RAW = "SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN concat('ﬁ', p_name) WHEN 1 THEN concat(' ', p_name, '​ ') WHEN 2 THEN '....' WHEN 3 THEN '12-34' WHEN 4 THEN '①:' END AS raw FROM <part>"


@query(
    f"""WITH c AS (SELECT id, trim(replace(replace(replace(replace(raw, 'ﬁ', 'fi'), '​', ''), ' ', ' '), '①', '1')) AS word FROM ({_RAW}))
SELECT id, word, coalesce(regexp_matches(word, '[a-zA-Z:]') OR len(regexp_extract_all(word, '[.]')) >= 3, false) AS kept FROM c"""
)
def pdf_words(spark, sf_dir):
    """Words of a PDF as they are read, and which of them count."""
    rows = view(spark, sf_dir, _RAW).withColumn("word", text.pdf_word(F.col("raw")))
    return rows.select("id", "word", text.keep_pdf_word(F.col("word")).alias("kept"))


@query(f"SELECT page, string_agg(trim(text)[:5], chr(10) ORDER BY n) AS context FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY ord, text, width) AS n FROM ({_PAGE_LINES}) WHERE trim(text) <> '') WHERE n <= 60 GROUP BY page")
def context_lines(spark, sf_dir):
    return records.context_lines(view(spark, sf_dir, _PAGE_LINES), ["page"], ["ord", "text", "width"], signs=5)


_TYPED = "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'Signature of applicant' WHEN 1 THEN 'Date of birth' WHEN 2 THEN 'Permanent address' ELSE p_name END AS label, CASE p_size % 3 WHEN 0 THEN 'checkbox' ELSE 'text' END AS detected, CAST(p_size AS DOUBLE) / 500 AS height, CASE p_partkey % 4 WHEN 0 THEN 'date' WHEN 1 THEN 'table' WHEN 2 THEN 'radio' END AS entry_type, p_size % 2 = 0 AS confident FROM <part>"


@query(
    f"""SELECT id, CASE WHEN confident AND entry_type IS NOT NULL THEN CASE WHEN detected = 'checkbox' OR entry_type = 'radio' THEN detected WHEN entry_type = 'table' THEN 'table_cell' ELSE entry_type END
WHEN label LIKE 'Signature%' THEN 'signature' WHEN label LIKE 'Date of%' THEN 'date' WHEN detected <> 'checkbox' AND (label LIKE '%address%' OR height > 0.06) THEN 'multiline' ELSE detected END AS field_type FROM ({_TYPED})"""
)
def typed_fields(spark, sf_dir):
    return view(spark, sf_dir, _TYPED).select("id", records.typed(F.col("label"), F.col("detected"), F.col("height"), F.col("entry_type"), F.col("confident")).alias("field_type"))


_FILES = "SELECT l_orderkey AS doc, l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey AS file, CASE WHEN l_partkey % 4 = 0 THEN 'empty' END AS error FROM <lineitem>"


@query(f"SELECT doc, file, CASE WHEN error IS NULL AND count(*) FILTER (error IS NULL) OVER (PARTITION BY doc ORDER BY file ROWS UNBOUNDED PRECEDING) > 3 THEN 'too_many' ELSE error END AS error FROM ({_FILES})")
def supporting_files(spark, sf_dir):
    return records.supporting(view(spark, sf_dir, _FILES), "doc", ["file"])


_MAPS = "SELECT p_partkey AS id, p_name, p_size, p_brand, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS hi, CASE p_partkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN p_name END AS en, p_partkey % 4 = 0 AS bare FROM <part>"


@query(
    f"""SELECT id, coalesce(hi, nullif(trim(en), ''), '') AS said, concat('en=', coalesce(nullif(trim(en), ''), ''), ';hi=', coalesce(hi, nullif(trim(en), ''), ''), ';kn=', coalesce(nullif(trim(en), ''), '')) AS filled,
CASE WHEN hi IS NOT NULL THEN concat('brand=', p_brand, ';size=', p_size, ';types=', hi, ', ', p_brand) ELSE concat('brand=', p_brand, ';size=', p_size, ';types=', p_brand) END AS metadata, sha256(concat('{{"p0":"{{\\"v\\":\\"', p_name, '\\"}}","p1":"{{\\"v\\":', p_size, '}}"}}')) AS request_key FROM ({_MAPS})"""
)
def text_maps(spark, sf_dir):
    """A text in one language, in all, metadata without structure, and the key of a request."""
    rows = view(spark, sf_dir, _MAPS)
    texts = F.map_filter(F.create_map(F.lit("hi"), "hi", F.lit("en"), "en"), lambda _, v: v.isNotNull())
    flat = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    meta = replies.flat_metadata({"size": F.col("p_size"), "brand": F.col("p_brand")}, {"types": F.array("hi", "p_brand")})
    return rows.select("id", replies.local_text(texts, F.lit("hi")).alias("said"), flat(replies.filled_languages(texts, ["en", "hi", "kn"])).alias("filled"), flat(meta).alias("metadata"), replies.cache_key(F.col("p_name"), F.col("p_size")).alias("request_key"))


_BESIDE = "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'I hereby declare that what I say is true and whole' WHEN 1 THEN 'short' END AS section, CASE p_partkey % 4 WHEN 0 THEN 'x' WHEN 1 THEN concat(p_name, ' ', p_type, ' and more words than a tick box is ever shown beside') WHEN 2 THEN p_name END AS nearby FROM <part>"


@query(
    f"""SELECT id, (length(coalesce(section, '')) > 40 AND len(string_split(trim(coalesce(section, '')), ' ')) >= 6 AND length(trim(coalesce(nearby, ''))) < 2) OR length(trim(coalesce(nearby, ''))) > 48 OR len(list_filter(string_split(trim(coalesce(nearby, '')), ' '), lambda w: w <> '')) > 8 AS declaration FROM ({_BESIDE})"""
)
def declaration_marks(spark, sf_dir):
    """Marks that stand under a declaration and ask nothing."""
    return view(spark, sf_dir, _BESIDE).select("id", fields.declaration_mark(F.col("section"), F.col("nearby")).alias("declaration"))


_PRINTED = "SELECT l_orderkey AS doc, CASE WHEN l_partkey % 9 > 0 THEN 6 + CAST(l_partkey % 30 AS DOUBLE) / 2 END AS size FROM <lineitem>"


@query(f"SELECT doc, count(*) AS n_texts, min(size) AS smallest FROM ({_PRINTED}) GROUP BY doc HAVING count(size) = count(*)")
def printable_documents(spark, sf_dir):
    """Documents all of whose answers fit their boxes."""
    return records.printable(view(spark, sf_dir, _PRINTED), ["doc"], "size")


_ENTRIES = "SELECT p_partkey AS id, p_name, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS brand, p_partkey % 4 = 0 AS bare FROM <part>"


@query(f"SELECT count(*) AS entries, CAST(sum(CASE WHEN bare THEN 0 ELSE 1 + CASE WHEN brand IS NULL THEN 1 ELSE 2 END END) AS BIGINT) AS wordings FROM ({_ENTRIES})")
def alias_totals(spark, sf_dir):
    """How many wordings a dictionary has in all languages."""
    one, two = F.array("p_name"), F.array_compact(F.array("p_name", "brand"))
    aliases = F.when(F.col("bare"), F.create_map().cast("map<string,array<string>>")).otherwise(F.create_map(F.lit("en"), one, F.lit("hi"), two))
    return records.alias_total(view(spark, sf_dir, _ENTRIES).select("id", aliases.alias("aliases")))
