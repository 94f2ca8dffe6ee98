"""Queries by name: a function of (spark, sf_dir), and the same in DuckDB's SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import layout, resolve, retrieval, tables
from . import samples
from .registry import query, table

def seconds_of(column: str) -> Column:
    """Seconds of a time stamp since 1970, taken as UTC, to the microsecond."""
    return F.unix_micros(F.col(column).cast("timestamp")) / 1e6


def literal(spark: SparkSession, values: str, names: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM ({values}) AS t({names})")


# The token class in RE2's syntax is that of Java.
_TOKENS = f"regexp_extract_all(lower(coalesce(text, '')), '{text.TOKEN}')"
_BOXES = "l_orderkey AS page, l_linenumber * 100000000000 + l_partkey * 100000 + l_suppkey AS id, CAST(l_partkey % 50 AS DOUBLE) AS x, CAST(l_suppkey % 40 AS DOUBLE) AS y, 5 + l_quantity AS width, 5 + l_discount * 200 AS height"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes on pages, made of order lines."""
    return table(spark, sf_dir, "lineitem").selectExpr(*_BOXES.split(", "))


@query(
    f"""WITH q AS (SELECT item_id AS query, list_distinct({_TOKENS}) AS t FROM benchmark), d AS (SELECT doc_id AS doc, list_distinct({_TOKENS}) AS t FROM documents),
l AS (SELECT query, len(t) AS nq, unnest(t) AS k FROM q), r AS (SELECT doc, len(t) AS nd, unnest(t) AS k FROM d),
s AS (SELECT query, doc, round(count(*) / (nq + nd - count(*)), 6) AS score FROM l JOIN r USING (k) GROUP BY query, doc, nq, nd)
SELECT query, doc, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INTEGER) AS rank FROM s QUALIFY rank <= 5"""
)
def lexical_topk(spark, sf_dir):
    return retrieval.lexical_topk(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "doc_id")


@query(
    r"""WITH w AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS word FROM benchmark), h AS (SELECT item_id, sha256(word) AS d FROM w),
s AS (SELECT item_id, CAST(('0x' || d[1:2]) AS INTEGER) AS bucket, CASE WHEN CAST(('0x' || d[9:10]) AS INTEGER) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS s FROM h),
g AS (SELECT item_id, bucket, sum(s) AS w FROM s GROUP BY ALL HAVING sum(s) <> 0)
SELECT item_id, bucket, round(w / sqrt(sum(w * w) OVER (PARTITION BY item_id)), 6) AS weight FROM g"""
)
def hash_embedding_buckets(spark, sf_dir):
    return retrieval.hash_embedding(table(spark, sf_dir, "benchmark"), "item_id", "text")


@query(
    """WITH p AS (SELECT q.vec_id AS query, v.vec_id AS vector, round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))), 6) AS distance
FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0)
SELECT query, vector, distance, greatest(0.0::DOUBLE, 1 - distance) AS score, CAST(row_number() OVER (PARTITION BY query ORDER BY distance, vector) AS INTEGER) AS rank FROM p QUALIFY rank <= 5"""
)
def vector_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return retrieval.vector_topk(rows.where("vec_id % 50 = 0"), rows, "vec_id", "embedding")


def _script_sql(of: str) -> str:
    return ", ".join(f"CAST(len(regexp_extract_all(coalesce({of}, ''), '[{text.SCRIPTS.get(s, text.LATIN)}]')) AS INTEGER) AS {s}" for s in [*text.SCRIPTS, "latin"])


_SCRIPTED = f"SELECT id, label FROM ({samples.LABELS}) AS t(id, label) UNION ALL SELECT CAST(1000 + doc_id AS INTEGER), text FROM documents"


@query(f"SELECT id, {_script_sql('label')} FROM ({_SCRIPTED})")
def script_counts(spark, sf_dir):
    return _labels(spark, sf_dir).select("id", *[text.script_count(F.col("label"), s).alias(s) for s in [*text.SCRIPTS, "latin"]])


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select((F.col("doc_id") + 1000).cast("int").alias("id"), F.col("text").alias("label"))
    return literal(spark, samples.LABELS, "id, label").unionByName(documents)


_DOMINANT = "CASE " + " ".join(f"WHEN {s} > 0 AND {s} = greatest({', '.join(text.SCRIPTS)}) THEN '{s}'" for s in text.SCRIPTS) + " WHEN latin > 0 THEN 'latin' ELSE 'unknown' END"
_LANGUAGE = "CASE script " + " ".join(f"WHEN '{s}' THEN '{lang}'" for s, lang in text.LANGUAGES.items()) + " END"


@query(f"SELECT id, script, {_LANGUAGE} AS language FROM (SELECT id, {_DOMINANT} AS script FROM (SELECT id, {_script_sql('label')} FROM ({_SCRIPTED})))")
def dominant_script(spark, sf_dir):
    found = _labels(spark, sf_dir).select("id", text.dominant_script(F.col("label")).alias("script"))
    return found.select("id", "script", text.language(F.col("script")).alias("language"))


@query(
    """WITH v AS (SELECT source, lang, count(*) AS votes, min(doc_id) AS first FROM documents GROUP BY ALL)
SELECT source, lang, votes FROM v QUALIFY row_number() OVER (PARTITION BY source ORDER BY lang = 'en', votes DESC, first) = 1"""
)
def language_vote(spark, sf_dir):
    """The language most documents of a source are in; any other goes before English."""
    return tables.voted(table(spark, sf_dir, "documents"), ["source"], "lang", "doc_id", "en")


@query(
    r"""WITH p AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda t: t <> '') AS p FROM documents)
SELECT doc_id, array_to_string(list_filter(p, lambda t, i: i = 1 OR t <> p[i - 1]), ' ') AS caption FROM p"""
)
def dup_token_collapse(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.tidy_caption(F.col("text")).alias("caption"))


@query(
    r"""SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+')), lambda t: regexp_full_match(t, '[A-Z]{2,6}') AND t NOT IN ('THE', 'AND', 'FOR', 'NOT'))), ',') AS terms FROM documents"""
)
def initialisms(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(text.initialisms(F.col("text"))), ",").alias("terms"))


@query(
    r"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 200 THEN t ELSE regexp_replace(t[1:200], ' [^ ]*$', '') END AS cut FROM t"""
)
def text_cut(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.cut_at_word(F.col("text"), 200).alias("cut"))


@query(
    r"""WITH l AS (SELECT doc_id, list_sort(list_transform(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> ''), lambda x: length(x))) AS w FROM documents),
n AS (SELECT doc_id, w, len(list_filter(w, lambda x: x >= 0.42 * 240)) AS long FROM l)
SELECT doc_id, CAST(len(w) AS INTEGER) AS n_lines, len(w) >= 8 AND (w[(len(w) // 2) + 1] / w[len(w)] >= 0.6 OR long >= 4) AS prose FROM n"""
)
def prose_pages(spark, sf_dir):
    """Whether most lines of a page run close to its widest one; the upper median of widths is taken, here in characters."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.array_sort(F.transform(lines, F.length)).alias("w"))
    n = F.size("w")
    middle = F.get("w", F.floor(n / 2).cast("int"))
    long = F.size(F.filter("w", lambda x: x >= 0.42 * 240))
    prose = (n >= 8) & ((middle / F.get("w", n - 1) >= 0.6) | (long >= 4))
    return rows.select("doc_id", n.alias("n_lines"), F.coalesce(prose, F.lit(False)).alias("prose"))


@query(
    f"""WITH b AS (SELECT {_BOXES} FROM lineitem), p AS (SELECT a.page, a.id AS a_id, b.id AS b_id, a.width * a.height + b.width * b.height AS total,
greatest(least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y), 0) AS shared FROM b a JOIN b ON a.page = b.page AND a.id < b.id)
SELECT page, a_id, b_id, round(shared / (total - shared), 6) AS iou FROM p WHERE shared > 0"""
)
def iou_pairs(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return layout.pairs_of(b, b, ["page"], 20.0).where("a_id < b_id")


@query(f"SELECT page, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height FROM (SELECT {_BOXES} FROM lineitem) GROUP BY page")
def box_union(spark, sf_dir):
    return tables.box_union(boxes(spark, sf_dir), ["page"])


@query(
    f"""WITH b AS (SELECT {_BOXES} FROM lineitem)
SELECT w.page, w.id AS word_id, min_by(c.id, c.id) AS cell_id FROM b w JOIN b c ON w.page = c.page AND w.id >= 400000000000 AND c.id < 400000000000
AND w.x + w.width / 8 BETWEEN c.x AND c.x + c.width AND w.y + w.height / 8 BETWEEN c.y AND c.y + c.height GROUP BY w.page, w.id"""
)
def words_in_cells(spark, sf_dir):
    b = boxes(spark, sf_dir)
    words = b.where("id >= 400000000000").select("page", F.col("id").alias("word_id"), "x", "y", (F.col("width") / 4).alias("width"), (F.col("height") / 4).alias("height"))
    return layout.words_in_cells(words, b.where("id < 400000000000").withColumnRenamed("id", "cell_id").withColumn("ord", F.col("cell_id")), ["page"], 20.0)


@query(
    """SELECT p.event_id, p.user_id, p.value, v.event_id AS viewed, v.value AS viewed_value FROM events p LEFT JOIN LATERAL
(SELECT event_id, value FROM events v WHERE v.user_id = p.user_id AND v.event_type = 'view' AND v.ts <= p.ts ORDER BY ts DESC, event_id DESC LIMIT 1) v ON true WHERE p.event_type = 'purchase'"""
)
def section_above(spark, sf_dir):
    """As-of join: the view that each purchase follows."""
    e = table(spark, sf_dir, "events")
    rows = e.where("event_type = 'purchase'").select("event_id", "user_id", "value", "ts")
    views = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("viewed"), F.col("value").alias("viewed_value"))
    return layout.latest_before(rows, views, ["user_id"], "ts", ["viewed", "viewed_value"], "viewed").drop("ts")


_IOU = "greatest(least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y), 0)"


@query(
    f"""WITH b AS (SELECT {_BOXES} FROM lineitem)
SELECT page, id FROM b a WHERE id >= 300000000000 AND NOT EXISTS (SELECT 1 FROM b WHERE b.page = a.page AND b.id < 300000000000 AND {_IOU} > 0 AND {_IOU} >= 0.3 * (a.width * a.height + b.width * b.height - {_IOU}))"""
)
def overlap_antijoin(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return layout.without_overlaps(b.where("id >= 300000000000"), b.where("id < 300000000000"), ["page"], 0.3, 20.0).select("page", "id")


@query(
    f"""WITH b AS (SELECT {_BOXES} FROM lineitem)
SELECT page, id FROM b a WHERE EXISTS (SELECT 1 FROM b WHERE b.page = a.page AND b.id <> a.id AND a.x >= b.x AND a.y >= b.y AND a.x + a.width <= b.x + b.width AND a.y + a.height <= b.y + b.height)"""
)
def contained_semijoin(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return layout.contained(b, b, ["page"], 20.0).select("page", "id")


_FORMS = ", ".join(f"({o}, '{f}', '{c}', {t}, {a})" for o, f, c, t, a in samples.FORMS)


@query(
    f"""WITH f AS (SELECT * FROM (VALUES {_FORMS}) AS t(ord, form_id, category, terms, aliases)),
s AS (SELECT doc_id, ord, form_id, round(least(1.0::DOUBLE, 0.55::DOUBLE * (len(list_filter(terms, lambda t: contains(lower(text), t)))::DOUBLE / len(terms))
+ 0.4::DOUBLE * (len(list_filter([lower(lang), lower(source)], lambda x: len(list_filter(aliases, lambda a: contains(x, a) OR contains(a, x))) > 0))::DOUBLE / len(aliases))
+ CASE WHEN category = 'banking' THEN 0.12::DOUBLE ELSE 0.0::DOUBLE END), 3) AS score FROM documents, f)
SELECT doc_id, max(score) AS form_score, CASE WHEN max(score) >= 0.42 THEN arg_max(form_id, score * 1000 - ord / 10.0) END AS form_id FROM s GROUP BY doc_id"""
)
def form_match(spark, sf_dir):
    forms = spark.createDataFrame(samples.FORMS, "ord int, form_id string, category string, terms array<string>, aliases array<string>")
    docs = table(spark, sf_dir, "documents")
    return retrieval.match_form(docs, forms, F.col("text"), F.array("lang", "source"), F.lit("banking")).select("doc_id", "form_score", "form_id")


@query(
    """SELECT coalesce(status, 'total') AS status, n FROM (SELECT CASE o_orderstatus WHEN 'O' THEN 'processing' WHEN 'F' THEN 'ready' WHEN 'P' THEN 'failed' ELSE 'unreadable' END AS status, count(*) AS n FROM orders GROUP BY ROLLUP (1))"""
)
def status_counters(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", "processing").when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "P", "failed")
    return tables.counters(table(spark, sf_dir, "orders"), status, ["processing", "ready", "failed"])


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest(spark, sf_dir):
    """The record of each key as the last write left it."""
    return tables.latest(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("SELECT source, doc_id, CAST((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 10 AS INTEGER) AS batch FROM documents")
def batches(spark, sf_dir):
    return tables.batches(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], ["doc_id"])


@query(
    """WITH g AS (SELECT user_id, event_id, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) > 3600 THEN 1 ELSE 0 END AS far FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, CAST(sum(far) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM g"""
)
def gap_clusters(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return layout.gap_clusters(e, ["user_id"], seconds_of("ts"), ["ts", "event_id"], 3600.0).select("user_id", "event_id", "cluster")


@query("SELECT conv_id, string_agg(role || ':' || length(text), ' ' ORDER BY turn) AS read, string_agg(role, ' ' ORDER BY turn DESC) AS reversed FROM conversations GROUP BY conv_id")
def reading_order(spark, sf_dir):
    """Words of a line in reading order, and reversed as for scripts from right to left."""
    words = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(":"), F.length("text").cast("string")).alias("word"), "role")))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(words.alias("w"))
    return rows.select("conv_id", F.array_join("w.word", " ").alias("read"), F.array_join(F.reverse(F.col("w.role")), " ").alias("reversed"))


@query("SELECT user_id, event_id, epoch(lead(ts) OVER w) - epoch(ts) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def next_line_gap(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = seconds_of("ts")
    return table(spark, sf_dir, "events").select("user_id", "event_id", (F.lead(seconds).over(w) - seconds).alias("gap"))


@query(
    r"""WITH p AS (SELECT d.lang, l.quality = 0 AS truth, regexp_matches(text, '[$&%*#!]{2,}') AS found FROM documents d JOIN labels l USING (doc_id)),
c AS (SELECT lang, sum(CAST(found AND truth AS DOUBLE)) AS hit, sum(CAST(found AS DOUBLE)) AS n, sum(CAST(truth AS DOUBLE)) AS t FROM p GROUP BY lang),
r AS (SELECT lang, hit / greatest(n, 1) AS p, hit / greatest(t, 1) AS r FROM c)
SELECT lang, round(p, 3) AS precision, round(r, 3) AS recall, round(2 * p * r / greatest(p + r, 1e-9), 3) AS f1 FROM r"""
)
def precision_recall(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return tables.quality(rows, ["lang"], F.col("text").rlike("[$&%*#!]{2,}"), F.col("quality") == 0)


@query(
    f"""WITH m AS (SELECT * FROM ({samples.MESSAGES}) AS t(key, language, message)), e AS (SELECT event_id, event_type AS key, CASE event_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' ELSE 'de' END AS language FROM events)
SELECT event_id, e.key, e.language, coalesce(nullif(o.message, ''), nullif(f.message, ''), '') AS message FROM e LEFT JOIN m o ON o.key = e.key AND o.language = e.language LEFT JOIN m f ON f.key = e.key AND f.language = 'en'"""
)
def message_fallback(spark, sf_dir):
    lang = F.when(F.col("event_id") % 3 == 0, "en").when(F.col("event_id") % 3 == 1, "fr").otherwise("de")
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("key"), lang.alias("language"))
    return resolve.with_message(rows, literal(spark, samples.MESSAGES, "key, language, message"), "key", "language").select("event_id", "key", "language", "message")
