"""License scan by a positional index of rare licence words.

Licence texts and notices are indexed by word and position. Document frequencies of all their words are
counted over the whole corpus; the ``ANCHORS`` rarest words of each stretch of ``STRETCH`` words are its
anchors. A file's anchor words are looked up and their postings intersected by relative position, up to ``SLACK`` words
of insertions or gaps. Where enough anchors of a template agree, it is aligned: the part of it that is present is the run of
its words that gains most inverse document frequency, words out of place counting against it, and the score is the share of the run's words
that stand at their places. A template counts from ``LEAST_SCORE`` on, if of each group of its
mandatory key phrases one stands in the aligned range. "All rights reserved" counts only where no other licence stands within ``NEAR`` words.
Base phrases are found wherever their words stand consecutively.

Defined results: null and empty texts have no words and no labels; a license named twice is one
label and two places; words count from 0. Repeated rows each have a result. Only id and text are
read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .license_texts import TEMPLATES
from .words import ALNUM, Words, hash_words

# Base phrases and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Anchors of each stretch of so many words, and the share of idf that must stand in place.
ANCHORS, STRETCH = 4, 12
LEAST_SCORE = 0.7
#: Words by which a template's words may be shifted; what a word out of place costs against one in place; words of a part at least.
SLACK = 12
MISSED = 1.5
LEAST_WORDS = 7
NEAR = 100
PIECE_BYTES = 1 << 20

_CUT = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_TEMPLATES = [(label, _CUT.findall(text.lower()), keys) for label, text, keys in TEMPLATES]
_WORDS = sorted({w for _, words, groups in _TEMPLATES for w in [*words, *(w for g in groups for k in g for w in k.split())]} | {w for x in BASE for w in x.split()})
_HASHES = hash_words(_WORDS)
_ORDER = np.argsort(_HASHES)
_NUMBER = {w: i for i, w in enumerate(_WORDS)}


def _symbols(words: Words) -> np.ndarray:
    """The vocabulary number of each word, -1 for others."""
    at = np.minimum(np.searchsorted(_HASHES[_ORDER], words.hash), len(_WORDS) - 1)
    return np.where(_HASHES[_ORDER][at] == words.hash, _ORDER[at], -1)


def _phrase(symbols: np.ndarray, ends: np.ndarray, phrase: str) -> np.ndarray:
    """Places where the words of a phrase stand consecutively in one document; ``ends``: where each word's document ends."""
    own = [_NUMBER[w] for w in phrase.split()]
    at = np.flatnonzero(symbols == own[0])
    at = at[at + len(own) <= ends[at]]
    for k, symbol in enumerate(own[1:], 1):
        at = at[symbols[at + k] == symbol]
    return at


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, docs = np.zeros(len(_WORDS), np.int64), 0
    for batch in batches:
        data, bounds = shared.text_buffer(batch.column(0))
        for a, b in shared.pieces(bounds, PIECE_BYTES):
            words = Words(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], ALNUM)
            symbols, doc_of = _symbols(words), words.doc()
            held = symbols >= 0
            pairs = np.unique(doc_of[held] * len(_WORDS) + symbols[held])
            total += np.bincount(pairs % len(_WORDS), minlength=len(_WORDS))
            docs += b - a
    yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(_WORDS))], pa.int32()), pa.array([docs, *total.tolist()], pa.int64())], names=["word", "n"])


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """idf of each template word over all rows of a one-column table."""
    n = {r.word: r.n for r in texts.mapInArrow(_frequencies, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return np.array([np.log((n.get(-1, 0) + 1) / (n.get(i, 0) + 0.5)) + 1 for i in range(len(_WORDS))])


class Index:
    """Anchor postings of all templates."""

    def __init__(self, idf: np.ndarray):
        self.idf = idf
        self.templates = [np.array([_NUMBER[w] for w in words]) for _, words, _ in _TEMPLATES]
        posts, self.needed = [], []
        for t, symbols in enumerate(self.templates):
            for a in range(0, len(symbols), STRETCH):
                part = symbols[a : a + STRETCH].tolist()
                rare = sorted(set(part), key=lambda s: (-idf[s], s))[:ANCHORS]
                posts += [(s, t, a + i) for i, s in enumerate(part) if s in rare]
            self.needed.append(min(3, len(set(symbols.tolist()))))
        posts.sort()
        self.word, self.template, self.place = map(np.array, zip(*posts, strict=True))
        self.first = np.searchsorted(self.word, np.arange(len(_WORDS) + 1))
        self.needed = np.array(self.needed)

    def _candidates(self, symbols: np.ndarray, begins: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, start it would have, first word of its document) where enough anchors agree, starts in steps of SLACK."""
        at = np.flatnonzero(symbols >= 0)
        count = (self.first[1:] - self.first[:-1])[symbols[at]]
        post = np.repeat(self.first[symbols[at]] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
        where = np.repeat(at, count)
        template, begin = self.template[post], begins[where]
        # starts are taken relative to the document; they may lie before it
        step = (where - begin - self.place[post] + 4096) // SLACK
        rows = np.stack([begin, template, step, self.place[post]], axis=1)
        # a hit counts for its own step and the one before, so that shifts by up to SLACK meet
        rows = np.unique(np.concatenate([rows, rows - np.array([0, 0, 1, 0])]), axis=0)
        if not len(rows):
            return []
        cell = np.flatnonzero(np.concatenate([[True], np.any(rows[1:, :3] != rows[:-1, :3], axis=1)]))
        votes = np.diff(np.append(cell, len(rows)))
        good = cell[votes >= self.needed[rows[cell, 1]]]
        return [(t, b + step * SLACK - 4096, b) for b, t, step, _ in rows[good].tolist()]

    def matches(self, symbols: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(first word, end, template, score) of each aligned template whose key phrases stand in it; of overlapping ones of a label the best."""
        keys: dict[str, np.ndarray] = {}
        found = []
        for t, start, begin in self._candidates(symbols, begins):
            words, end = self.templates[t], int(ends[begin])
            wide = len(words) + 4 * SLACK
            own = np.full(wide, -1)
            low, high = max(start - SLACK, begin), min(start + len(words) + 3 * SLACK, end)
            if high <= low:
                continue
            own[low - start + SLACK : high - start + SLACK] = symbols[low:high]
            same = np.stack([own[d : d + len(words)] == words for d in range(4 * SLACK)])
            there, shift = same.any(0), same.argmax(0)
            value = self.idf[words]
            gain = np.cumsum(np.where(there, value, -MISSED * value))
            lowest = np.minimum.accumulate(np.concatenate([[0.0], gain[:-1]]))
            last = int(np.argmax(gain - lowest))
            first = int(np.argmin(np.concatenate([[0.0], gain[:-1]])[: last + 1]))
            part = slice(first, last + 1)
            if last + 1 - first < min(LEAST_WORDS, len(words)):
                continue
            score = float(value[part][there[part]].sum() / value[part].sum())
            if score < LEAST_SCORE:
                continue
            held = (np.arange(len(words)) + shift + start - SLACK)[part][there[part]]
            a, b = int(held.min()), int(held.max()) + 1
            near = lambda key: self._stands(keys, symbols, ends, key, max(a - SLACK, begin), min(b + SLACK, end))
            if all(any(near(k) for k in group) for group in _TEMPLATES[t][2]):
                found.append((a, b, t, score))
        found.sort(key=lambda x: (-x[3] * (x[1] - x[0]), x))
        kept: list[tuple[int, int, int, float]] = []
        for m in found:
            if not any(_TEMPLATES[m[2]][0] == _TEMPLATES[k[2]][0] and m[0] < k[1] and k[0] < m[1] for k in kept):
                kept.append(m)
        return sorted(kept)

    @staticmethod
    def _stands(keys: dict[str, np.ndarray], symbols: np.ndarray, ends: np.ndarray, key: str, low: int, high: int) -> bool:
        if key not in keys:
            keys[key] = _phrase(symbols, ends, key)
        k = np.searchsorted(keys[key], low)
        return bool(k < len(keys[key]) and keys[key][k] + len(key.split()) <= high)


def _named(matches: list[dict], base: list) -> list[dict]:
    """Matches without "all rights reserved" beside another licence."""
    others = [m["first_word"] for m in matches if m["label"] != "proprietary"] + [at for at, _ in base]
    return [m for m in matches if m["label"] != "proprietary" or not any(abs(m["first_word"] - at) <= NEAR for at in others)]


_MATCH = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("score", pa.float64())]))


def _scan(idf_sent):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(idf_sent.value)
        for batch in batches:
            data, bounds = shared.text_buffer(batch.column(1))
            for a, b in shared.pieces(bounds, PIECE_BYTES):
                words = Words(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], ALNUM)
                symbols, sizes = _symbols(words), np.diff(words.first)
                begins, ends, doc_of = np.repeat(words.first[:-1], sizes), np.repeat(words.first[1:], sizes), words.doc()
                base: list[list] = [[] for _ in range(b - a)]
                found: list[list] = [[] for _ in range(b - a)]
                for phrase, label in BASE.items():
                    for at in _phrase(symbols, ends, phrase).tolist():
                        i = int(doc_of[at])
                        base[i].append((at - int(words.first[i]), label))
                for s, end, t, score in index.matches(symbols, begins, ends):
                    i = int(doc_of[s])
                    found[i].append({"label": _TEMPLATES[t][0], "first_word": s - int(words.first[i]), "end_word": end - int(words.first[i]), "score": score})
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[a:b],
                        pa.array(sizes, pa.int64()),
                        pa.array([len(x) for x in base], pa.int64()),
                        pa.array([min(x)[0] if x else None for x in base], pa.int64()),
                        pa.array([max(x)[0] if x else None for x in base], pa.int64()),
                        pa.array([sorted({y[1] for y in x}) for x in base], pa.list_(pa.string())),
                        pa.array([_named(m, own) for m, own in zip(found, base, strict=True)], _MATCH),
                    ],
                    names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "matches"],
                )

    return scan


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id_col, n_words, n_base, first_word, last_word, base_labels, matches, labels, score.

    ``matches`` are aligned templates (label, first_word, end_word, score); ``labels`` are those of
    base phrases and matches; ``score`` is 1 with a base phrase, else the best match's, else 0.
    """
    idf = docs.sparkSession.sparkContext.broadcast(inverse_frequencies(docs.select(text_col)))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = f"id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, matches array<struct<label: string, first_word: long, end_word: long, score: double>>"
    found = rows.mapInArrow(_scan(idf), kinds)
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.col("matches.label"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.least(F.lit(1.0), F.coalesce(F.array_max(F.col("matches.score")), F.lit(0.0))))
    return found.select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "matches", labels.alias("labels"), score.alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda c: F.array_join(c, ",").alias(c)
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined("base_labels"), joined("labels"), "score")
