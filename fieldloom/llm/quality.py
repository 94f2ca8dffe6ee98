"""Quality classifier by importance resampling over hashed n-grams.

Two generative models of hashed word 1- and 2-grams are counted: of the raw text, over all
documents, and of target text, documents labelled good. A document's weight is the mean log
ratio of target to raw probability over its n-grams. The cut between good and bad is fitted on
labelled rows that the target model did not count (one in ``CUT_FOLDS``); of all documents, as many as
pass it are sampled without replacement by Gumbel top-k: the k largest of ``SHARPNESS * weight + Gumbel
noise``. So a document is drawn by the importance weight of a run of ``SHARPNESS`` n-grams of it, however
long it is; by the ratio of whole texts, length alone would decide between two good documents. The
noise comes from a hash of the text, so runs agree and copies stay together up to the last place.

Two scans read the texts: one counts both models, one weighs. Neither moves a text: labels, bounded
in number, are sent to the tasks.

The k-th largest key is found by counting in ever finer intervals, so no more than ``CELLS`` counts
reach the driver.

Defined results: a null or empty text has no n-grams, weight 0 and is rejected; without labels of
both kinds nothing is rejected but empty texts; labels of unknown ids are ignored, and an id
labelled twice counts as its smallest quality; a null quality is no label. Repeated rows
count each time in the models; for the cut, rows that share an id count once, by their mean weight. Only id, text and label columns are read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import filters, shared
from .words import SPACED, Words, mix

#: Buckets of hashed n-grams, and the pseudo-count of each.
BUCKETS = 1 << 16
SMOOTHING = 1.0
#: Labelled ids that the target model and the cut are fitted on, at most; one in CUT_FOLDS is for the cut.
LABELLED_BOUND = 200_000
CUT_FOLDS = 2
#: Weight against noise in the sampling keys.
SHARPNESS = 60.0
CELLS = 1024
PIECE_BYTES = 1 << 20

_MARKS = np.zeros(256, np.uint8)
_MARKS[48:58] = 1
_MARKS[97:123] = 2
_MARKS[65:91] = 3
_MARKS[128:] = 4
_MARKS[[33, *range(35, 39), 42, 64, 94, 95, 124, 126]] = 5
_MARKS[[34, 39, 40, 41, 44, 45, 46, 58, 59, 63]] = 6


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each document's n-grams, and where each document's begin.

    N-grams are: the lower-cased word, the pair of it and the next, the word's shape (its kinds of
    characters in order, runs once) with the shape of the next, and whether the word repeats the one before.
    """
    words = Words(data, bounds, SPACED)
    n = len(words.start)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    shape = _shapes(data, words)
    last = np.zeros(n, bool)
    last[words.first[1:][np.diff(words.first) > 0] - 1] = True
    following = np.append(words.hash[1:], np.uint64(0))
    following[last] = np.uint64(1)
    after = np.append(shape[1:], np.uint64(0))
    after[last] = np.uint64(1)
    same = (following == words.hash).astype(np.uint64)
    grams = np.stack([words.hash, mix(words.hash * np.uint64(3) + following), mix(shape * np.uint64(5) + after + np.uint64(7)), mix(same + np.uint64(11))], axis=1)
    return (grams.reshape(-1) >> np.uint64(48)).astype(np.int64), words.first * 4


def _shapes(data: np.ndarray, words: Words) -> np.ndarray:
    kind = _MARKS[data].astype(np.uint64)
    changed = np.ones(len(data), bool)
    changed[1:] = kind[1:] != kind[:-1]
    changed[words.start] = True
    place = np.cumsum(changed)
    begins = np.zeros(len(data), bool)
    begins[words.start] = True
    within = np.minimum(place - np.maximum.accumulate(np.where(begins, place, 0)), 15)
    value = np.where(changed, kind << (within.astype(np.uint64) * np.uint64(4)), np.uint64(0))
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    return mix(run[words.end] - run[words.start])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of rows (text, target), of all texts and of those that are target text."""
    total = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        data, bounds = shared.text_buffer(batch.column(0))
        target = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for a, b in shared.pieces(bounds, PIECE_BYTES):
            grams, first = features(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
            total[0] += np.bincount(grams, minlength=BUCKETS)
            if target[a:b].any():
                total[1] += np.bincount(grams[np.repeat(target[a:b], np.diff(first))], minlength=BUCKETS)
    held = np.flatnonzero(total[0])
    yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[0][held]), pa.array(total[1][held])], names=["bucket", "raw", "target"])


def ratio(texts: DataFrame) -> np.ndarray:
    """Log ratio of target to raw probability of all buckets, over rows (text, target); a fixed number of sums reaches the driver."""
    total = np.full((2, BUCKETS), SMOOTHING)
    counts = texts.mapInArrow(shared.returning(_count), "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    for row, name in zip(total, ("raw", "target"), strict=True):
        row[counts["bucket"].to_numpy(np.int64)] += counts[name].to_numpy(np.float64)
    raw, target = np.log(total / total.sum(1, keepdims=True))
    return target - raw


def _weigh(ratio_sent):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = ratio_sent.value
        for batch in batches:
            data, bounds = shared.text_buffer(batch.column(1))
            for a, b in shared.pieces(bounds, PIECE_BYTES):
                own, at = data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
                grams, first = features(own, at)
                n = np.diff(first)
                weight = shared.sums(ratio[grams], first) / np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(n, pa.int64()), pa.array(weight), pa.array(_noise(own, at))], names=["id", "n_grams", "weight", "gumbel"])

    return weigh


def _noise(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Standard Gumbel noise from a hash of each text."""
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix((data.astype(np.uint64) << np.uint64(32)) + np.arange(len(data), dtype=np.uint64) - np.repeat(bounds[:-1], np.diff(bounds)).astype(np.uint64)), dtype=np.uint64)])
    uniform = ((mix(run[bounds[1:]] - run[bounds[:-1]]) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    return -np.log(-np.log(uniform))


def best_cut(weight: np.ndarray, good: np.ndarray) -> float:
    """Cut that keeps most good rows and loses most bad ones, a good row lost counting three times; it lies between neighbours, nearer to the bad one by that ratio."""
    order = np.argsort(weight, kind="stable")
    weight, good = weight[order], good[order].astype(bool)
    if not good.any() or good.all():
        return -np.inf
    kept = 1 - np.concatenate([[0], np.cumsum(good)]) / good.sum()
    gone = np.concatenate([[0], np.cumsum(~good)]) / (~good).sum()
    ok = np.concatenate([[True], weight[1:] > weight[:-1], [True]])
    k = int(np.argmax(np.where(ok, 3 * kept + gone, -1)))
    if k == 0:
        return -np.inf
    return float(weight[k - 1] + 0.25 * (weight[k] - weight[k - 1])) if k < len(weight) else float(weight[-1])


def kth_largest(values: DataFrame, name: str, k: int) -> float:
    """The k-th largest number of a column (1 at least), exactly, from counts of ever finer intervals."""
    low, high, n = values.agg(F.min(name), F.max(name), F.count(name)).first()
    if low is None or k >= n:
        return -np.inf if low is None else low
    above = 0
    while low < high:
        width = (high - low) / CELLS
        if low + width <= low or high - width >= high:
            break
        cell = F.least(F.floor((F.col(name) - F.lit(low)) / F.lit(width)), F.lit(CELLS - 1))
        cells = values.where(F.col(name).between(low, high)).groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min(name).alias("low"), F.max(name).alias("high")).collect()
        for _, n, a, b in sorted(cells, reverse=True):
            if above + n >= k:
                low, high = a, b
                break
            above += n
    return high


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row for each document: id_col, n_grams, weight (mean log ratio), key (of the sampling), accepted."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("good"))
    known = known.orderBy(F.xxhash64("id")).limit(LABELLED_BOUND).withColumn("cut", F.pmod(F.xxhash64("id", F.lit("cut")), F.lit(CUT_FOLDS)) == 0)
    known = F.broadcast(shared.written(known.coalesce(1), "quality-labels"))
    target = F.coalesce((F.col("good") == 1) & ~F.col("cut"), F.lit(False))
    sent = spark.sparkContext.broadcast(ratio(texts.join(known, "id", "left").select("text", target.alias("target"))))
    kinds = f"id {docs.schema[id_col].dataType.simpleString()}, n_grams long, weight double, gumbel double"
    weighed = texts.mapInArrow(shared.returning(_weigh(sent)), kinds).withColumn("key", F.when(F.col("n_grams") > 0, SHARPNESS * F.col("weight") + F.col("gumbel")))
    weighed = shared.written(weighed, "quality-weighed")
    fitted = weighed.where("n_grams > 0").join(known.where("cut"), "id").groupBy("id").agg(F.avg("weight").alias("weight"), F.first("good").alias("good")).toPandas()
    cut = best_cut(fitted["weight"].to_numpy(), fitted["good"].to_numpy() == 1)
    k = weighed.where((F.col("n_grams") > 0) & (F.col("weight") >= F.lit(cut))).count()
    least = kth_largest(weighed.where("key IS NOT NULL").select("key"), "key", k) if k else np.inf
    accepted = F.coalesce(F.col("key") >= F.lit(float(least)), F.lit(False))
    return weighed.select(F.col("id").alias(id_col), "n_grams", "weight", "key", accepted.alias("accepted"))


def accepted_only(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose document is accepted, with all columns. Rows that share an id go together."""
    decided = quality(docs, labels, id_col, text_col).groupBy(F.col(id_col).alias("id")).agg(F.max("accepted").alias("accepted"))
    return filters.without_keys(docs, id_col, shared.written(decided.where("NOT accepted").select("id"), "quality-rejected"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
