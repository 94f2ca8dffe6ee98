"""Joins and folds of positioned boxes: containment, nearest above, overlaps, suppression."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry


def banded(df: DataFrame, low: Column, high: Column, band: float) -> DataFrame:
    """One row for each band of height ``band`` that the range touches, in column ``band``."""
    at = lambda x: F.floor(x / band)
    return df.withColumn("band", F.explode(F.sequence(at(low), at(high))))


def words_in_cells(words: DataFrame, cells: DataFrame, keys: list[str], band: float = 50.0) -> DataFrame:
    """keys, word_id, cell_id: each word's first cell (by ord) that holds its centre.

    A range join as an equi-join on page and band: a word's centre lies in one band, a cell in those it touches.
    """
    w = words.select(*keys, "word_id", (F.col("x") + F.col("width") / 2).alias("cx"), (F.col("y") + F.col("height") / 2).alias("cy")).withColumn("band", F.floor(F.col("cy") / band))
    c = banded(cells.select(*keys, "cell_id", "ord", "x", "y", "width", "height"), F.col("y"), F.col("y") + F.col("height"), band)
    inside = w.join(c, [*keys, "band"]).where("cx BETWEEN x AND x + width AND cy BETWEEN y AND y + height")
    return inside.groupBy(*keys, "word_id").agg(F.min_by("cell_id", "ord").alias("cell_id"))


def latest_before(rows: DataFrame, events: DataFrame, keys: list[str], at: str, columns: list[str], order: str, bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """As-of join: each row with the columns of the last event of its keys at or before its place.

    One shuffle of both sides by key and a running last value; no pairs are made. Of events at one place the last by ``order`` counts. With ``bucket``, a
    function of the place that never falls, keys are cut there: tasks take a bucket each, and what the buckets before it end with is carried into it.
    """
    names = rows.columns
    left = rows.select(F.struct(*names).alias("row"), *keys, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(events.schema[order].dataType).alias("_order"), F.lit(None).cast(events.select(F.struct(*columns)).schema[0].dataType).alias("_event"))
    right = events.select(F.lit(None).cast(left.schema["row"].dataType).alias("row"), *keys, F.col(at).alias("_at"), F.lit(0).alias("_side"), F.col(order).alias("_order"), F.struct(*columns).alias("_event"))
    both = left.unionByName(right).withColumn("_bucket", F.lit(0) if bucket is None else bucket(F.col("_at")))
    running = Window.partitionBy(*keys, "_bucket").orderBy("_at", "_side", "_order").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_last", F.last("_event", ignorenulls=True).over(running)).where("_side = 1")
    if bucket is not None:
        ends = both.groupBy(*keys, "_bucket").agg(F.max_by("_event", F.when(F.col("_side") == 0, F.struct("_at", "_order"))).alias("_end"))
        found = _carried(found, ends, keys, F.last("_end", ignorenulls=True)).withColumn("_last", F.coalesce("_last", "_carry"))
    return found.select("row.*", *[F.col(f"_last.{c}").alias(c) for c in columns])


def _carried(rows: DataFrame, ends: DataFrame, keys: list[str], what: Column) -> DataFrame:
    """``rows`` with ``_carry``: ``what``, taken over the buckets before a row's own. ``ends`` has a row for each bucket of a key."""
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"), what.over(before).alias("_carry"))
    same = F.col("_bucket").eqNullSafe(F.col("_b"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(carry, same, "left").drop("_b", *[f"_k{i}" for i in range(len(keys))])


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], band: float) -> DataFrame:
    """Overlapping boxes of two tables (id, x, y, width, height) as keys and columns a_* and b_*; each pair once."""
    left = banded(a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in ("id", "x", "y", "width", "height")]), F.col("a_y"), F.col("a_y") + F.col("a_height"), band)
    right = banded(b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in ("id", "x", "y", "width", "height")]), F.col("b_y"), F.col("b_y") + F.col("b_height"), band)
    met = left.join(right, [*keys, "band"]).where(geometry.overlap(geometry.box("a_"), geometry.box("b_")) > 0)
    # the pair is reported in the first band that both touch
    return met.where(F.col("band") == F.floor(F.greatest("a_y", "b_y") / band)).drop("band")


def pairs_of(a: DataFrame, b: DataFrame, keys: list[str], band: float) -> DataFrame:
    """Overlapping boxes of two tables (id, x, y, width, height): a_id, b_id, iou; each pair once."""
    return overlapping(a, b, keys, band).select(*keys, "a_id", "b_id", F.round(geometry.iou(geometry.box("a_"), geometry.box("b_")), 6).alias("iou"))


def contained(inner: DataFrame, outer: DataFrame, keys: list[str], band: float, slack: float = 0.0, most: float | None = None) -> DataFrame:
    """Rows of ``inner`` that lie in a box of ``outer`` with another id, up to ``slack`` and, with ``most``, of no more than that share of its area.

    A box in another touches the band that its own middle is in, so the two meet there.
    """
    a = inner.select(*keys, "id", "x", "y", "width", "height").withColumn("band", F.floor((F.col("y") + F.col("height") / 2) / band))
    b = outer.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("id", "x", "y", "width", "height")])
    b = banded(b, F.col("_y") - slack, F.col("_y") + F.col("_height") + slack, band)
    met = a.join(b, [*keys, "band"]).where((F.col("id") != F.col("_id")) & geometry.contains(geometry.box("_"), geometry.box(), slack, most))
    return inner.join(met.select(*keys, "id").distinct(), [*keys, "id"], "left_semi")


def without_overlaps(rows: DataFrame, accepted: DataFrame, keys: list[str], least: float, band: float) -> DataFrame:
    """Rows that overlap no accepted box by ``least`` IoU."""
    hit = pairs_of(rows, accepted, keys, band).where(F.col("iou") >= least).select(*keys, F.col("a_id").alias("id")).distinct()
    return rows.join(hit, [*keys, "id"], "left_anti")


def _suppress(keys: list[str], least: float):
    def suppress(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come ordered by page, then rank; of a page only the boxes kept so far are held."""
        page, kept = None, []
        for frame in frames:
            out = []
            for i, row in enumerate(zip(*(frame[c] for c in (*keys, "x", "y", "width", "height")), strict=True)):
                own, (x, y, w, h) = row[: len(keys)], row[len(keys) :]
                if own != page:
                    page, kept = own, []
                ok = True
                for a, b, c, d in kept:
                    wide, high = min(x + w, a + c) - max(x, a), min(y + h, b + d) - max(y, b)
                    if wide > 0 and high > 0 and wide * high >= least * (w * h + c * d - wide * high):
                        ok = False
                        break
                if ok:
                    kept.append((x, y, w, h))
                    out.append(i)
            yield frame.iloc[out]

    return suppress


def suppressed(boxes: DataFrame, keys: list[str], rank: list[Column], least: float = 0.3) -> DataFrame:
    """Greedy suppression: in order of rank, a box stays unless it overlaps one that stayed."""
    dealt = boxes.repartition(*keys).sortWithinPartitions(*keys, *rank)
    return dealt.mapInPandas(_suppress(keys, least), boxes.schema)


def gap_clusters(rows: DataFrame, keys: list[str], at: Column, order: list[str], gap: float, bucket: Column | None = None) -> DataFrame:
    """Islands of rows whose distance to the row before is at most ``gap``: column cluster, from 0.

    With ``bucket``, a column that never falls in this order, keys are cut there: tasks take a bucket each, and the last place and the number of islands of the buckets before are carried into it.
    """
    cut = rows.withColumn("_place", at).withColumn("_bucket", F.lit(0) if bucket is None else bucket)
    w = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    if bucket is not None:
        ends = cut.groupBy(*keys, "_bucket").agg(F.max_by("_place", F.struct(*order)).alias("_end"))
        cut = _carried(cut, ends, keys, F.last("_end"))
        cut = cut.withColumn("_before", F.coalesce(F.lag("_place").over(w), "_carry")).drop("_carry")
    else:
        cut = cut.withColumn("_before", F.lag("_place").over(w))
    cut = cut.withColumn("_far", F.coalesce((F.col("_place") - F.col("_before")) > gap, F.lit(False)).cast("int"))
    out = cut.withColumn("cluster", F.sum("_far").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if bucket is not None:
        out = _carried(out, cut.groupBy(*keys, "_bucket").agg(F.sum("_far").alias("_n")), keys, F.sum("_n"))
        out = out.withColumn("cluster", F.col("cluster") + F.coalesce("_carry", F.lit(0))).drop("_carry")
    return out.drop("_far", "_place", "_bucket", "_before")


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str, bucket: Column | None = None) -> DataFrame:
    """``rows`` with their number among those of their keys, from 0. With ``bucket``, a column that never falls in this order, tasks take a bucket each."""
    cut = rows.withColumn("_bucket", F.lit(0) if bucket is None else bucket)
    out = cut.withColumn(name, F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)) - 1)
    if bucket is not None:
        out = _carried(out, cut.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n")), keys, F.sum("_n"))
        out = out.withColumn(name, F.col(name) + F.coalesce("_carry", F.lit(0))).drop("_carry")
    return out.drop("_bucket")
