"""Keyed tables, censuses and sets over any table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .layout import numbered


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The record of each key as the last write left it: all columns of its greatest row by ``order``."""
    rest = [c for c in rows.columns if c not in keys]
    last = F.max(F.struct(*order, *[F.col(c).alias(f"_{c}") for c in rest])).alias("x")
    return rows.groupBy(*keys).agg(last).select(*keys, *[F.col(f"x._{c}").alias(c) for c in rest])


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not deleted; as a cascade, once for each table that has the keys."""
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def counters(rows: DataFrame, status: Column, known: list[str]) -> DataFrame:
    """status, n: rows of each status, of unknown ones as unreadable, and in total."""
    named = F.when(status.isin(*known), status).otherwise("unreadable")
    return rows.select(named.alias("status")).rollup("status").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("status", F.lit("total")).alias("status"), "n")


def batches(rows: DataFrame, keys: list[str], order: list[str], size: int = 10, bucket: Column | None = None) -> DataFrame:
    """``rows`` with the number of the slice of ``size`` rows that each is in; ``bucket`` as in ``layout.numbered``."""
    return numbered(rows, keys, order, "batch", bucket).withColumn("batch", F.floor(F.col("batch") / size).cast("int"))


def voted(rows: DataFrame, keys: list[str], vote: str, order: str, last: str) -> DataFrame:
    """keys, vote, votes: what most rows of a key say, first seen of equal ones; ``last`` wins only alone. Nulls don't vote."""
    votes = rows.where(F.col(vote).isNotNull()).groupBy(*keys, vote).agg(F.count(F.lit(1)).alias("votes"), F.min(order).alias("first"))
    w = Window.partitionBy(*keys).orderBy(F.col(vote) == last, F.desc("votes"), "first")
    return votes.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*keys, vote, "votes")


def voted_with_fallback(rows: DataFrame, other: DataFrame, keys: list[str], vote: str, order: str, last: str) -> DataFrame:
    """As :func:`voted`; keys without any vote are decided by the rows of ``other``."""
    first = voted(rows, keys, vote, order, last)
    return first.unionByName(voted(other, keys, vote, order, last).join(first, keys, "left_anti"))


def box_union(boxes: DataFrame, keys: list[str], least: float = 0.01) -> DataFrame:
    """keys and the box around all boxes, ``least`` wide and high at least."""
    side = lambda at, size: F.greatest(F.max(F.col(at) + F.col(size)) - F.min(at), F.lit(least)).alias(size)
    return boxes.groupBy(*keys).agg(F.min("x").alias("x"), F.min("y").alias("y"), side("x", "width"), side("y", "height"))


def quality(rows: DataFrame, keys: list[str], found: Column, truth: Column) -> DataFrame:
    """keys, precision, recall, f1 of found against true rows, to three places; nothing found or true counts as 0."""
    total = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("double"))
    c = rows.groupBy(*keys).agg(total(found & truth).alias("hit"), total(found).alias("n"), total(truth).alias("t"))
    r = c.select(*keys, (F.col("hit") / F.greatest("n", F.lit(1.0))).alias("p"), (F.col("hit") / F.greatest("t", F.lit(1.0))).alias("r"))
    return r.select(*keys, F.round("p", 3).alias("precision"), F.round("r", 3).alias("recall"), F.round(2 * F.col("p") * F.col("r") / F.greatest(F.col("p") + F.col("r"), F.lit(1e-9)), 3).alias("f1"))


def gaps(rows: DataFrame, key: str, value: str, every: DataFrame) -> DataFrame:
    """key, missing: values of the one column of ``every`` that a key has no row with, joined in order; keys without gaps are left out."""
    wanted = every.toDF(value).distinct().agg(F.array_sort(F.collect_set(value)).alias("every"))
    have = rows.groupBy(key).agg(F.collect_set(value).alias("have"))
    # one row, the list of values, goes with each key
    out = have.crossJoin(F.broadcast(wanted)).select(key, F.array_except("every", "have").alias("gap")).where(F.size("gap") > 0)
    return out.select(key, F.array_join("gap", ",").alias("missing"))


def unanswered(required: DataFrame, answers: DataFrame, keys: list[str], answer: str) -> DataFrame:
    """Required rows without an answer that is not blank."""
    given = answers.where(F.trim(F.coalesce(F.col(answer), F.lit(""))) != "").select(*keys).distinct()
    return required.join(given, keys, "left_anti")


def duplicated(entries: DataFrame, key: str) -> DataFrame:
    return entries.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def ordered_union(rows: DataFrame, keys: list[str], order: list[str], lists: str, confidence: str) -> DataFrame:
    """keys, reasons, confidence: of rows that merge, all reasons once, as they first come, and the greatest confidence."""
    held = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(lists).alias("_l")))), lambda x: x["_l"])
    return rows.groupBy(*keys).agg(F.array_distinct(F.flatten(F.filter(held, lambda x: x.isNotNull()))).alias("reasons"), F.max(confidence).alias("confidence"))


def distinct_folded(texts: Column) -> Column:
    """Texts once each, the first spelling of those that differ by case and blanks at the ends only."""
    fold = lambda t: F.lower(F.trim(t))
    return F.filter(texts, lambda t, i: ~F.exists(F.slice(texts, 1, i), lambda u: fold(u) == fold(t)))


def mean_confidence(rows: DataFrame, keys: list[str], confidence: str, text: str) -> DataFrame:
    """keys, average (of confidences above 0, to two places, else 0), score (of words that are not blank, less below 12 words) and useful (8 signs and 2 words)."""
    word = (F.trim(F.coalesce(F.col(text), F.lit(""))) != "") & (F.col(confidence) >= 0)
    n = F.count(F.when(word, 1))
    signs = F.sum(F.length(F.trim(F.coalesce(F.col(text), F.lit(""))))) + F.greatest(F.count(F.when(F.trim(F.col(text)) != "", 1)) - 1, F.lit(0))
    words = F.count(F.when(F.trim(F.col(text)) != "", 1))
    return rows.groupBy(*keys).agg(
        F.round(F.coalesce(F.avg(F.when(F.col(confidence) > 0, F.col(confidence))), F.lit(0.0)), 2).alias("average"),
        F.round(F.coalesce(F.avg(F.when(word, F.col(confidence))), F.lit(0.0)) * F.least(F.lit(1.0), n / 12), 6).alias("score"),
        ((signs >= 8) & (words >= 2)).alias("useful"),
    )


def voices(languages: DataFrame, installed: DataFrame) -> DataFrame:
    """language, voice: of the voices for the first prefix of a language's preferences that has any, a local one before others, then by name.

    ``languages``: language, rank, prefix. ``installed``: voice, tag, local.
    """
    met = languages.join(installed.withColumn("prefix", F.lower(F.substring_index("tag", "-", 1))), "prefix")
    best = F.min(F.struct("rank", (~F.col("local")).alias("remote"), "voice")).alias("x")
    return met.groupBy("language").agg(best).select("language", "x.voice")


# The stages of a document; the last two end it.
STAGES = ["validating", "preparing_pages", "reading_text", "detecting_fields", "matching_form", "ready", "failed"]


def stage_status(stage: str) -> str:
    return stage if stage in STAGES[-2:] else "processing"


def staged(updates: DataFrame, keys: list[str], order: list[str], stage: str, seconds: str) -> DataFrame:
    """``updates`` with before (the document's stage until now), status (ready, failed or processing) and waited (seconds in the stage before); unknown stages change nothing and have no status."""
    known = F.col(stage).isin(*STAGES)
    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c: F.last(F.when(known, F.col(c)), ignorenulls=True).over(so_far)
    status = F.when(F.col(stage).isin(*STAGES[-2:]), F.col(stage)).when(known, "processing")
    return updates.withColumn("before", last(stage)).withColumn("waited", F.when(known, F.col(seconds) - last(seconds))).withColumn("status", status)


def latest_stage(updates: DataFrame, keys: list[str], order: list[str], stage: str) -> DataFrame:
    """keys, stage, status: what each document's last update of a known stage says."""
    known = updates.where(F.col(stage).isin(*STAGES))
    last = known.groupBy(*keys).agg(F.max_by(stage, F.struct(*order)).alias("stage"))
    return last.withColumn("status", F.when(F.col("stage").isin(*STAGES[-2:]), F.col("stage")).otherwise("processing"))
