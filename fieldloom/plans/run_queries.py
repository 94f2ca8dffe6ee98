"""Queries of a run: counters, evaluation means, and the vector index."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, vector_index, work
from ..sources import evaluation
from .registry import query, table, view

_CALLS = "SELECT user_id, CASE event_id % 7 WHEN 0 THEN 'cache_hit' WHEN 1 THEN 'cache_miss' WHEN 2 THEN 'open_skip' ELSE 'request' END AS kind, event_type = 'error' AS failed, CAST(event_id % 50 AS DOUBLE) / 4 AS seconds FROM <events>"


@query(
    f"""SELECT user_id, count(*) FILTER (kind = 'request') AS requests, count(*) FILTER (kind = 'request' AND failed) AS failures, count(*) FILTER (kind = 'cache_hit') AS cache_hits, count(*) FILTER (kind = 'cache_miss') AS cache_misses, count(*) FILTER (kind = 'open_skip') AS breaker_open_skips,
CASE WHEN count(*) FILTER (kind = 'request') > 0 THEN round(sum(seconds) FILTER (kind = 'request') / count(*) FILTER (kind = 'request'), 2) ELSE 0.0 END AS average_seconds FROM ({_CALLS}) GROUP BY user_id"""
)
def run_counters(spark, sf_dir):
    """What each client's calls came to."""
    counters = metrics.interpretation_counters(F.col("kind"), F.col("failed"), F.col("seconds"))
    return metrics.counted(view(spark, sf_dir, _CALLS), ["user_id"], counters)


_RESULTS = "SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'clean' ELSE 'noisy' END AS variant, CAST(l_partkey % 101 AS DOUBLE) / 128 AS box_recall, CAST(l_suppkey % 5 AS DOUBLE) / 4 AS label_rate, CASE WHEN l_linenumber = 3 THEN NULL ELSE CAST(l_linenumber AS DOUBLE) / 8 END AS semantic_recall, l_partkey % 3 AS gaps, l_suppkey % 2 AS wrong_script FROM <lineitem>"


@query(f"SELECT coalesce(variant, 'all') AS variant, count(*) AS n, round(avg(box_recall), 3) AS box_recall, round(avg(label_rate), 3) AS label_rate, round(avg(semantic_recall), 3) AS semantic_recall, CAST(sum(gaps) AS BIGINT) AS gaps, CAST(sum(wrong_script) AS BIGINT) AS wrong_script FROM ({_RESULTS}) GROUP BY ROLLUP (variant)")
def evaluation_means(spark, sf_dir):
    """Mean rates of clean and noisy samples, and of all, with totals."""
    return evaluation.evaluation_means(view(spark, sf_dir, _RESULTS), "variant", ["box_recall", "label_rate", "semantic_recall"], ["gaps", "wrong_script"])


_NEAREST = """WITH p AS (SELECT q.vec_id AS query, v.vec_id AS vector, round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))), 6) AS distance
FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0{0}) SELECT query, vector, distance, greatest(0.0::DOUBLE, 1 - distance) AS score, CAST(row_number() OVER (PARTITION BY query ORDER BY distance, vector) AS INTEGER) AS rank FROM p QUALIFY rank <= 5"""


def _indexed(spark, sf_dir, **how):
    path, rows = work.new_path(spark, "vector-index"), table(spark, sf_dir, "embeddings")
    vector_index.build(rows, path, "vec_id", "embedding", ["label"])
    return vector_index.search(rows.where("vec_id % 50 = 0"), path, "vec_id", "embedding", **how)


@query(_NEAREST.format(""))
def indexed_topk(spark, sf_dir):
    """The nearest vectors of every fiftieth, through the index, exactly."""
    return _indexed(spark, sf_dir, exact=True)


@query(_NEAREST.format(" AND v.label = 3"))
def indexed_topk_filtered(spark, sf_dir):
    """The same among the vectors of one label."""
    return _indexed(spark, sf_dir, exact=True, equal={"label": 3})


@query()
def probed_topk(spark, sf_dir):
    """The same of the nearest cells alone: its recall is measured in the tests."""
    return _indexed(spark, sf_dir)
