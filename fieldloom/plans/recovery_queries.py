"""Queries of requests that are asked again, over order lines as blanks and events as requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import recovery, tables
from .registry import query, table, view

_BLANKS = "SELECT l_suppkey AS page, l_orderkey * 10 + l_linenumber AS id FROM <lineitem>"
_SIZE = 10


def _ask(frontier):
    """A stand-in for a model: some ids spoil their batch, some are left out of its answer, and some circuits are open from the second round on."""
    n = F.size("ids")
    spoilt = (F.exists("ids", lambda i: i % 23 == 0) & (n > 1)) | ((n == 1) & F.exists("ids", lambda i: i % 46 == 0))
    answered = F.filter("ids", lambda i: (i + n) % 7 != 0)
    return frontier.withColumn("answered", F.when(~spoilt, answered)).withColumn("open", (F.col("page") % 10 == 0) & F.col("path").contains("."))


_TREE = f"""WITH RECURSIVE b AS (SELECT page, id, row_number() OVER (PARTITION BY page ORDER BY id) - 1 AS pos FROM ({_BLANKS})), f AS (SELECT page, CAST(pos // {_SIZE} AS VARCHAR) AS path, list(id ORDER BY pos) AS ids, 1 AS round FROM b GROUP BY page, pos // {_SIZE} UNION ALL
SELECT page, c.path, c.ids, round + 1 FROM (SELECT page, round, unnest(CASE WHEN good THEN [{{'path': concat(path, '.M'), 'ids': rest}}] ELSE [{{'path': concat(path, '.L'), 'ids': ids[:n // 2]}}, {{'path': concat(path, '.R'), 'ids': ids[n // 2 + 1:]}}] END) AS c FROM (<step>) WHERE len(rest) > 0 AND n > 1 AND NOT open))"""
_STEP = """SELECT *, CASE WHEN good THEN list_filter(ids, lambda i: (i + n) % 7 = 0) ELSE ids END AS rest FROM (SELECT *, NOT spoilt AND len(list_filter(ids, lambda i: (i + n) % 7 <> 0)) > 0 AS good FROM (SELECT *, len(ids) AS n,
CASE WHEN len(ids) > 1 THEN len(list_filter(ids, lambda i: i % 23 = 0)) > 0 ELSE ids[1] % 46 = 0 END AS spoilt, page % 10 = 0 AND contains(path, '.') AS open FROM f))"""
_TREE = _TREE.replace("<step>", _STEP)


def _bisected(spark, sf_dir):
    batches = recovery.first_batches(view(spark, sf_dir, _BLANKS), ["page"], ["id"], "id", _SIZE)
    return recovery.bisected(batches, _ask, ["page"])


@query(f"{_TREE} SELECT page, unnest(list_filter(ids, lambda i: NOT list_contains(rest, i))) AS id, path, round FROM ({_STEP}) WHERE good")
def bisected_batches(spark, sf_dir):
    """Blanks that get an answer, when failed batches are halved and partial ones asked again."""
    return _bisected(spark, sf_dir)[0]


@query(
    f"""{_TREE} SELECT page, round, count(*) AS asked, count(*) FILTER (NOT good) AS failed, CAST(sum(n - len(rest)) AS BIGINT) AS answered, CAST(sum(CASE WHEN NOT (len(rest) > 0 AND n > 1 AND NOT open) THEN len(rest) ELSE 0 END) AS BIGINT) AS lost FROM ({_STEP}) GROUP BY page, round"""
)
def bisected_rounds(spark, sf_dir):
    """Requests, failures, answers and losses of each round."""
    return _bisected(spark, sf_dir)[1]


_OUTCOME = "CASE ({0}) % 12 WHEN 0 THEN 'missing' WHEN 1 THEN 'rate' WHEN 2 THEN 'rate' WHEN 3 THEN 'server' WHEN 4 THEN 'empty' WHEN 5 THEN 'timeout' WHEN 6 THEN 'rate' WHEN 7 THEN 'server' WHEN 8 THEN 'missing' ELSE 'ok' END"
_ATTEMPTS = f"""SELECT user_id AS client, event_id, CAST(m AS INT) AS model, CAST(k AS INT) AS key, {_OUTCOME.format("event_id * 7 + user_id + m * 5 + k * 3")} AS outcome, CAST(5 + (event_id + k) % 4 * 12 AS DOUBLE) AS seconds, {_OUTCOME.format("event_id * 5 + m + k * 7")} AS plain, CAST(event_id % 3 * 9 AS DOUBLE) AS plain_seconds
FROM <events> CROSS JOIN (VALUES (0), (1)) AS a(m) CROSS JOIN (VALUES (0), (1)) AS b(k) WHERE (event_id + m + k) % 17 > 0"""


@query(
    f"""WITH RECURSIVE a AS ({_ATTEMPTS}), r AS (SELECT user_id AS client, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM <events>),
s AS (SELECT client, 1::BIGINT AS n, 0 AS m, 0 AS k, 0 AS m0, 0 AS k0, 0.0::DOUBLE AS spent, 0 AS tried, false AS limited, NULL::VARCHAR AS outcome, NULL::INTEGER AS sm, NULL::INTEGER AS sk FROM r WHERE n = 1 UNION ALL
SELECT client, n, CASE WHEN said = 'missing' OR k = 1 THEN m + 1 ELSE m END, CASE WHEN said = 'missing' OR k = 1 THEN 0 ELSE k + 1 END, m0, k0, spent, tried, limited OR said = 'rate',
CASE WHEN late THEN 'deadline' WHEN said = 'ok' THEN 'answered' WHEN said = 'empty' THEN 'empty' WHEN said NOT IN ('missing', 'rate') AND NOT (said = 'server' AND k = 0) THEN 'failed' WHEN m = 1 AND (said = 'missing' OR k = 1) THEN CASE WHEN limited OR said = 'rate' THEN 'rate_limited' ELSE 'unavailable' END END,
CASE WHEN said IN ('ok', 'empty') AND NOT late THEN (m0 + m) % 2 END, CASE WHEN said IN ('ok', 'empty') AND NOT late THEN (k0 + k) % 2 END FROM (
SELECT c.client, c.n, c.m, c.k, c.m0, c.k0, c.limited, c.spent >= 75 AS late, CASE WHEN c.spent >= 75 THEN c.tried ELSE c.tried + 1 END AS tried, CASE WHEN c.spent >= 75 THEN '' WHEN a.outcome IS NULL THEN 'refused' WHEN a.outcome IN ('ok', 'missing', 'rate') THEN a.outcome ELSE a.plain END AS said,
c.spent + coalesce(a.seconds + CASE WHEN a.outcome IN ('ok', 'missing', 'rate') THEN 0 ELSE a.plain_seconds END, 0) AS spent
FROM (SELECT s.client, CASE WHEN outcome IS NULL THEN s.n ELSE s.n + 1 END AS n, CASE WHEN outcome IS NULL THEN m ELSE 0 END AS m, CASE WHEN outcome IS NULL THEN k ELSE 0 END AS k, CASE WHEN outcome IS NULL THEN m0 ELSE coalesce(sm, m0) END AS m0, CASE WHEN outcome IS NULL THEN k0 ELSE coalesce(sk, k0) END AS k0,
CASE WHEN outcome IS NULL THEN spent ELSE 0 END AS spent, CASE WHEN outcome IS NULL THEN tried ELSE 0 END AS tried, CASE WHEN outcome IS NULL THEN limited ELSE false END AS limited FROM s) c
JOIN r ON r.client = c.client AND r.n = c.n LEFT JOIN a ON a.client = c.client AND a.event_id = r.event_id AND a.model = (c.m0 + c.m) % 2 AND a.key = (c.k0 + c.k) % 2))
SELECT client, r.event_id, outcome, coalesce(sm, -1) AS served_model, coalesce(sk, -1) AS served_key, tried FROM s JOIN r USING (client, n) WHERE outcome IS NOT NULL"""
)
def failover(spark, sf_dir):
    """Which model and key serve each request (-1: none), and how it ends."""
    attempts = view(spark, sf_dir, _ATTEMPTS).groupBy("client", "event_id").agg(F.collect_list(F.struct("model", "key", "outcome", "seconds", "plain", "plain_seconds")).alias("attempts"))
    requests = view(spark, sf_dir, "SELECT user_id AS client, event_id FROM <events>").join(attempts, ["client", "event_id"], "left")
    return recovery.failover(requests, "client", ["event_id"]).select("client", "event_id", "outcome", F.coalesce("served_model", F.lit(-1)).alias("served_model"), F.coalesce("served_key", F.lit(-1)).alias("served_key"), "tried")


_UPDATES = "SELECT user_id AS doc, event_id, epoch_us(ts) / 1e6 AS seconds, CASE event_id % 9 WHEN 0 THEN 'validating' WHEN 1 THEN 'preparing_pages' WHEN 2 THEN 'reading_text' WHEN 3 THEN 'detecting_fields' WHEN 4 THEN 'matching_form' WHEN 5 THEN 'ready' WHEN 6 THEN 'failed' WHEN 7 THEN 'paused' END AS stage FROM events"
_KNOWN = "stage IN ('validating', 'preparing_pages', 'reading_text', 'detecting_fields', 'matching_form', 'ready', 'failed')"


def _updates(spark, sf_dir):
    stage = F.element_at(F.array(*map(F.lit, [*tables.STAGES, "paused"])), F.least(F.col("event_id") % 9 + 1, F.lit(8)).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("seconds"), F.when(F.col("event_id") % 9 < 8, stage).alias("stage"))


@query(
    f"""WITH u AS (SELECT *, CASE WHEN {_KNOWN} THEN stage END AS s, CASE WHEN {_KNOWN} THEN seconds END AS t FROM ({_UPDATES}))
SELECT doc, event_id, stage, last_value(s IGNORE NULLS) OVER w AS before, round(t - last_value(t IGNORE NULLS) OVER w, 3) AS waited, CASE WHEN s IN ('ready', 'failed') THEN s WHEN s IS NOT NULL THEN 'processing' END AS status
FROM u WINDOW w AS (PARTITION BY doc ORDER BY seconds, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
)
def stage_machine(spark, sf_dir):
    """Every update of a document's stage with the stage before, the status it gives and the seconds waited."""
    updates = _updates(spark, sf_dir)
    found = tables.staged(updates, ["doc"], ["seconds", "event_id"], "stage", "seconds")
    return found.select("doc", "event_id", "stage", "before", F.round("waited", 3).alias("waited"), "status")


@query(
    f"SELECT doc, arg_max(stage, (seconds, event_id)) AS stage, CASE WHEN arg_max(stage, (seconds, event_id)) IN ('ready', 'failed') THEN arg_max(stage, (seconds, event_id)) ELSE 'processing' END AS status FROM ({_UPDATES}) WHERE {_KNOWN} GROUP BY doc"
)
def latest_stages(spark, sf_dir):
    """Where each document stands."""
    updates = _updates(spark, sf_dir)
    return tables.latest_stage(updates, ["doc"], ["seconds", "event_id"], "stage")
