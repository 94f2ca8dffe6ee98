"""Toxicity scores by a counterfactual-regularised logistic classifier.

A text's features are the hashed distinct words in it. The classifier is fitted on a bounded sample of
labelled rows with an L1 penalty, so that most words weigh nothing, and a counterfactual penalty:
for labelled sentences that name identity terms, each term is swapped for others of its group, and the
square of the change in score is penalised; the same for sentences that get a term they
did not have. So mentions of groups do not move a score by themselves.

Only texts are inputs of a score. Defined results: a null or empty text has the score of no words;
repeated words count once; ids labelled twice count with their highest label, rows that share a labelled id are learned from once; null labels and labels of
unknown ids are left out; without labels of both kinds all scores are the share of toxic labels
(0.5 without any). An empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .words import ALNUM, Words, hash_words

BUCKETS = 1 << 20
#: Labelled rows that the model is fitted on, at most; they are chosen by a hash of the id.
LABELLED_BOUND = 20_000
#: Words of fewer labelled texts are not used.
LEAST_TEXTS = 4
L1 = 1.0
COUNTERFACTUAL = 50.0
ROUNDS = 400
PIECE_BYTES = 1 << 20
# Identity terms by group.
IDENTITY = {
    "religion": "muslim christian jewish hindu buddhist atheist".split(),
    "gender": "women men woman man girls boys transgender".split(),
    "origin": "immigrants refugees african asian mexican european arab chinese".split(),
    "colour": "black white brown".split(),
    "orientation": "gay straight lesbian bisexual".split(),
    "age": "elderly young old".split(),
    "ability": "disabled deaf blind autistic".split(),
}


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of each document, and where each document's begin."""
    words = Words(data, bounds, ALNUM)
    pairs = np.unique(words.doc().astype(np.int64) * BUCKETS + (words.hash >> np.uint64(44)).astype(np.int64))
    return pairs % BUCKETS, np.searchsorted(pairs // BUCKETS, np.arange(len(bounds)))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, bounds = shared.text_buffer(batch.column(1))
        for a, b in shared.pieces(bounds, PIECE_BYTES):
            buckets, first = features(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(buckets, pa.int32()))], names=["id", "buckets"])


def _swaps(rows: list[np.ndarray], rng: np.random.Generator) -> list[tuple[int, int]]:
    """Pairs of buckets (without, with) of counterfactual sentences; -1: no word taken out."""
    groups = [np.unique((hash_words(v) >> np.uint64(44)).astype(np.int64)) for v in IDENTITY.values()]
    out = []
    for own in rows:
        for group in groups:
            here = np.intersect1d(own, group)
            others = np.setdiff1d(group, own)
            out += [(int(a), int(b)) for a in here for b in others]
        absent = np.setdiff1d(groups[int(rng.integers(len(groups)))], own)
        if len(absent):
            out.append((-1, int(rng.choice(absent))))
    return out


class Model:
    """Weights of buckets and the score without words."""

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray):
        self.weight = np.zeros(BUCKETS)
        share = (labels.sum() + 0.5) / (len(labels) + 1) if len(labels) else 0.5
        self.bias = float(np.log(share / (1 - share)))
        if not len(labels) or labels.min() == labels.max():
            return
        used, count = np.unique(np.concatenate(rows), return_counts=True)
        pairs = _swaps(rows, np.random.default_rng(11))
        terms = np.array(sorted({x for p in pairs for x in p if x >= 0}), np.int64)
        used = np.union1d(used[count >= LEAST_TEXTS], terms)
        flat = np.concatenate(rows)
        row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
        at = np.minimum(np.searchsorted(used, flat), len(used) - 1)
        held = used[at] == flat
        row, at = row[held], at[held]
        frequency = np.bincount(at, minlength=len(used))
        place = np.array([[np.searchsorted(used, x) if x >= 0 else len(used) for x in p] for p in pairs])
        weight, velocity = np.zeros(len(used)), np.zeros(len(used))
        # a toxic row counts as much as all rows of its kind balance, up to 4
        balance = np.where(labels == 1, min(4.0, (labels == 0).sum() / labels.sum()), 1.0)
        touched = np.bincount(place.ravel(), minlength=len(used) + 1)[:-1]
        scale = 1.0 / (0.25 * balance.max() * frequency * 4 + 2 * COUNTERFACTUAL * touched + 1.0)
        bias = 0.0
        for step in range(ROUNDS):
            ahead = weight + velocity * (step / (step + 3))
            score = np.bincount(row, ahead[at], len(rows)) + bias
            error = balance * (1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels)
            gradient = np.bincount(at, error[row], len(used))
            wide = np.append(ahead, 0.0)
            change = COUNTERFACTUAL * (wide[place[:, 1]] - wide[place[:, 0]])
            gradient += (np.bincount(place[:, 1], change, len(used) + 1) - np.bincount(place[:, 0], change, len(used) + 1))[:-1]
            moved = ahead - scale * gradient
            new = np.sign(moved) * np.maximum(np.abs(moved) - scale * L1, 0)
            velocity, weight = new - weight, new
            bias -= error.sum() / (0.25 * balance.sum())
        self.bias = float(bias)
        self.weight[used] = weight


def _score(model_sent):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, weight, bias = model_sent.value
        full = np.zeros(BUCKETS)
        full[buckets] = weight
        for batch in batches:
            data, bounds = shared.text_buffer(batch.column(1))
            for a, b in shared.pieces(bounds, PIECE_BYTES):
                own, first = features(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
                logit = bias + shared.sums(full[own], first)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(1 / (1 + np.exp(-np.clip(logit, -500, 500))))], names=["id", "score"])

    return score


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on labelled rows that satisfy ``usable``, ``LABELLED_BOUND`` of them at most."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & usable).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    known = F.broadcast(shared.written(known.orderBy(F.xxhash64("id")).limit(LABELLED_BOUND).coalesce(1), "toxic-labels"))
    kind = docs.schema[id_col].dataType.simpleString()
    # the ids travel to the texts; of rows that share an id, one of the fewest words counts, so that the rows are bounded, too
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(known, "id", "left_semi").mapInArrow(_featured, f"id {kind}, buckets array<int>")
    one = F.min(F.struct(F.size("buckets").alias("n"), "buckets")).alias("x")
    found = rows.groupBy("id").agg(one).join(known, "id").select("x.buckets", "label").orderBy(F.xxhash64("id")).toArrow()
    lists = found.column("buckets").combine_chunks()
    bounds = lists.offsets.to_numpy()
    flat = lists.values.to_numpy().astype(np.int64)
    return Model([flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], found.column("label").to_numpy().astype(np.float64))


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id_col, score."""
    buckets = np.flatnonzero(model.weight)
    sent = docs.sparkSession.sparkContext.broadcast((buckets, model.weight[buckets], model.bias))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_score(sent), f"id {docs.schema[id_col].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    found = scores(docs, fit(docs, labels, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
