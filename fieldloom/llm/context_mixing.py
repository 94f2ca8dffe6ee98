"""Language-model scores by logistic context mixing of bit predictors.

A text is its class, then its lower-cased words, each followed by a blank, and one end mark. Classes
are found without labels, by fitting a mixture of word models: a first guess by the main directions in which the words of all training texts vary, then ``CLASS_PASSES``
rounds over all training texts, which add up words by class in the tasks; they mostly
follow languages. The bit predictors' contexts never cross the start of a word, so what they say of a word is the same
wherever it stands in texts of a class, and each word is spelled once per class; the word before it enters as a source of its own:

* ``_shards`` turns each few megabytes of texts into one row: word numbers and the shard's vocabulary;
* the shards' vocabularies are merged by ranges, one row each, into a table of words with their counts in training texts. A shard sends a
  range one row, and gets one back with its words' counts and scores. Words of a range share beginnings, whose bits are made once;
* hashed tables count, for each predictor, which bit followed a context and the bits of the byte so far.
  Contexts are the last bytes or the word so far, in texts of the class or in all;
* a mixer learns online, over batches of training words: the predictors' stretched probabilities are
  combined by the weights of the gate (evidence for the word so far). A word's own occurrence is
  taken out of its counts, so weights are learned as if it were new. Each range's words teach a mixer of their own; they are averaged by the tokens seen;
* the mixed probability is refined by an adaptive table over gate and probability, learned likewise;
* a word's probability from its bits is mixed, by weights that each class learns online, with its share of the class's
  and of all training tokens. These counts are exact and grow with the corpus, so that words whose slots collide in the tables keep theirs;
* pairs of a word and the one before it are counted likewise: each shard sends its distinct pairs by ranges of their hashes, of which there
  are as many as shards, and gets the sums back;
* words' scores and pairs' counts meet their shard, and each token's probability is mixed from both, by a weight for each grade of
  evidence for the word before. These weights are fitted to all training tokens, each pair less its own occurrence, from counts of a fixed number of cells.

Shuffle files go as soon as their query ends, and what is sent is packed.

Hashed tables, weights and the refinement are bounded, as every task holds them; words with their counts,
and pairs of words, which grow with the corpus, stay in Spark tables.

Defined results: a null or empty text has only the end mark; rows without id are not held out and
repeated rows count each. Without training texts all counts are 0. Words are told apart by 64-bit
hashes. Only id and text are read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .token_files import canonical_codes, code_lengths
from .words import LOWER, SPACED, Words, hash_spans, hash_words, mix

#: Bytes of context (WHOLE: the word so far), whether it is that of the class alone, and log2 of the table's slots at most.
WHOLE = 1 << 30
PREDICTORS = [(2, True, 18), (3, True, 19), (4, True, 19), (6, True, 20), (WHOLE, True, 20), (3, False, 18), (5, False, 19), (WHOLE, False, 20)]
WHOLE_CLASS, WHOLE_ANY = 4, 7
#: Slots that a task sends as one value.
CHUNK = 1 << 15
SHARD_BYTES = 12 << 20
#: Shards of a row group of a table: a task that reads one holds a whole group, and writes none before it is full.
GROUP_SHARDS = {"parquet.block.row.count.limit": "2"}
PIECE_BYTES = 2 << 20
#: Bits and words of a training batch; bytes of words whose bits are made at once; words that one task counts.
BATCH_BITS = 1 << 14
BATCH = 512
PART_BYTES = 1 << 19
TASK_WORDS = 1_000_000
#: First bytes of a word that it shares with the one before it, at most.
SHARED = 64
#: Ranges of the vocabulary are dealt by the hash of a word's first bytes, and beyond so many bits by that of the word, so that words of a range share beginnings.
PREFIX = 4
PREFIX_BITS = 4
#: Groups in which the ranges' mixers are summed before the driver sums these.
MIXER_GROUPS = 64
RATE = 0.03
#: Classes of texts (even) and rounds over all texts after the first guess; hashed words, and those of the guess with the steps of their shares of a text.
CLASSES = 6
CLASS_PASSES = 2
CLASS_BITS = 14
MOMENT_BITS = 8
SHARE_STEPS = 1024
MOMENT_TEXTS = 4096
#: Gates: grades of evidence for the word so far, in the class and at all, and early or late bits; cells of the refinement.
GRADES = 6
GATES = GRADES * GRADES * 2
CELLS = 33
#: Of the refined and the mixed probability, the share of the refined.
REFINED = 0.5
#: A word's probabilities, from its bits, its class and all tokens, and the tokens that each counts for before learning.
SOURCES = 3
SOURCE_PRIOR = 10.0
#: Grades of the count of the word before (its bits), and cells of the log ratio of a token's two probabilities: width, and how many, the first for pairs not seen.
BEFORE = 64
RATIO_WIDTH = 0.25
RATIOS = 242
FITS = 200
END = b"\n"
END_HASH = int(hash_words(["\n"])[0])


def stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def grade(n: np.ndarray) -> np.ndarray:
    """0 for no evidence, 1 to 5 for ever more."""
    return (n > 0).astype(np.int64) + (n > 2) + (n > 8) + (n > 40) + (n > 400)


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -14, 14)))


def table_bits(distinct: int) -> list[int]:
    """log2 of each predictor's slots: four times the words, between 4096 and the predictor's bound."""
    return [min(b, max(12, (4 * distinct).bit_length())) for _, _, b in PREDICTORS]


def table_starts(sizes: list[int]) -> list[int]:
    return [0, *np.cumsum([1 << b for b in sizes]).tolist()]


class Bits:
    """All bits of some words, each in a class, and for each predictor the table slot it reads.

    A byte's bits are those of a prefix code, so that frequent bytes take few: ``code`` has its lengths and
    codes. ``bit``, ``word``, ``depth``: of each bit its value, its word's number and its place in the
    byte's code; ``slot``: (predictors, bits).

    With ``once``, the first bytes that a word has in common with the word before it in its class are left out: their bits, contexts and
    slots are the same. :meth:`spread` and :meth:`gathered` carry words' counts to bits and bits' values to words.
    """

    def __init__(self, words: list[bytes], classes: np.ndarray, sizes: list[int], code: tuple[np.ndarray, np.ndarray], once: bool = False):
        ended = [w if w == END else w + b" " for w in words]
        size = np.array([len(w) for w in ended], np.int64)
        data = np.frombuffer(b"".join(ended), np.uint8)
        begin = np.cumsum(size) - size
        word = np.repeat(np.arange(len(words)), size)
        here = np.arange(len(data))
        self.skip = np.zeros(len(words), np.int64)
        if once:
            self.skip = _common(data, begin, size, classes)
            here = np.flatnonzero(here - begin[word] >= self.skip[word])
            word = word[here]
        self.byte_word, self.first_byte = word, np.cumsum(size - self.skip) - (size - self.skip)
        first, byte = begin[word], data[here]
        n = code[0][byte]
        owner = np.repeat(np.arange(len(here), dtype=np.int32), n)
        self.byte = owner
        self.depth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        self.word = word[owner]
        rest = code[1][byte][owner] >> (n[owner] - 1 - self.depth)
        self.bit = (rest & 1).astype(np.uint8)
        # the bits of the byte so far, under a leading one
        node = ((1 << self.depth) | (rest >> 1)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        of_class = classes.astype(np.uint64)[word] + np.uint64(2)
        known: dict[int, np.ndarray] = {}
        self.slot = np.empty((len(PREDICTORS), len(owner)), np.int32)
        for k, ((order, by_class, _), size_bits, start_slot) in enumerate(zip(PREDICTORS, sizes, table_starts(sizes), strict=False)):
            if order not in known:
                start = np.maximum(first, here - order)
                known[order] = hash_spans(data, start, here) + (here - start == here - first)
            context = mix(known[order] * np.uint64(31) + (of_class if by_class else np.uint64(1)))
            self.slot[k] = ((context[owner] + node) >> np.uint64(64 - size_bits)).astype(np.int32) + start_slot

    def _left_out(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words and the bytes, of words before them, that stand for bytes left out of them."""
        every = np.arange(len(self.skip))
        for d in range(int(self.skip.max(initial=0))):
            words = np.flatnonzero(self.skip > d)
            owner = np.maximum.accumulate(np.where(self.skip <= d, every, 0))[words]
            yield words, self.first_byte[owner] + d - self.skip[owner]

    def spread(self, count: np.ndarray) -> np.ndarray:
        """For each bit, the sum of the counts of all words that it stands for."""
        total = count[self.byte_word].astype(np.float64)
        for words, byte in self._left_out():
            total += np.bincount(byte, count[words], len(total))
        return total[self.byte]

    def gathered(self, values: np.ndarray) -> np.ndarray:
        """For each word, the sum of the values of all its bits."""
        by_byte = np.bincount(self.byte, values, len(self.byte_word))
        total = np.bincount(self.byte_word, by_byte, len(self.skip))
        for words, byte in self._left_out():
            total[words] += by_byte[byte]
        return total


def _common(data: np.ndarray, begin: np.ndarray, size: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """How many first bytes each word has in common with the one before it in its class, ``SHARED`` at most."""
    out = np.zeros(len(begin), np.int64)
    alive = np.flatnonzero(classes[1:] == classes[:-1]) + 1
    for d in range(SHARED):
        alive = alive[np.minimum(size[alive], size[alive - 1]) > d]
        alive = alive[data[begin[alive] + d] == data[begin[alive - 1] + d]]
        if not len(alive):
            break
        out[alive] = d + 1
    return out


def _words(text: bytes, counts: bytes, trained: bool) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a range of the vocabulary: words, classes, training counts and the row of each pair of word and class, by class and then by word; and each row's count."""
    both = _unplanes(counts).astype(np.int64).reshape(CLASSES, -1)
    of_class, row = np.nonzero(both > trained)
    words = text.split(b" ")
    count = np.maximum(both - 1, 0)
    return [words[i] for i in row.tolist()], of_class, count[of_class, row], row, count.sum(0)


def _parts(words: list[bytes]) -> Iterator[tuple[int, int]]:
    return shared.pieces(np.cumsum([0, *map(len, words)]), PART_BYTES)


def _tables(sizes: list[int], code: tuple[np.ndarray, np.ndarray]):
    """Counts of zeros and ones by slot, over ranges of the vocabulary (words, counts)."""

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = table_starts(sizes)[-1]
        total = np.zeros((slots, 2), np.int64)
        flat = total.reshape(-1)
        for x in _rows(batches):
            words, of_class, count, *_ = _words(x["words"].as_py(), x["counts"].as_py(), True)
            for a, b in _parts(words):
                bits = Bits(words[a:b], of_class[a:b], sizes, code, once=True)
                weight = bits.spread(count[a:b]).astype(np.int64)
                for slot in bits.slot:
                    np.add.at(flat, slot * 2 + bits.bit, weight)
        chunks = [c for c in range(0, slots, CHUNK) if total[c : c + CHUNK].any()]
        yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int32()), pa.array([_narrow(total[c : c + CHUNK]) for c in chunks], pa.binary())], names=["chunk", "counts"])

    return tables


def _narrow(counts: np.ndarray) -> bytes:
    """As 32-bit numbers, the largest standing for all above, by planes of their bytes."""
    return np.ascontiguousarray(np.minimum(counts, 2**32 - 1).astype(np.uint32).reshape(-1, 1).view(np.uint8).T).tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view(np.uint32).reshape(-1, 2)


def _sum_tables(table: pa.Table) -> pa.Table:
    total = sum(_wide(x).astype(np.int64) for x in table.column("counts").to_pylist())
    return pa.table({"chunk": table.column("chunk")[:1], "counts": pa.array([_narrow(total)], pa.binary())})


class Mixer:
    """Weights by gate and the refinement's counts, with what their learning rate needs."""

    def __init__(self):
        self.weight = np.full((GATES, len(PREDICTORS) + 1), 0.25)
        self.squares = np.full((GATES, len(PREDICTORS) + 1), 1e-3)
        cells = squash(np.linspace(-8, 8, CELLS))
        self.cells = np.stack([np.tile(4 * (1 - cells), (GATES, 1)), np.tile(4 * cells, (GATES, 1))]).reshape(2, -1)
        self.sources = np.full((CLASSES, SOURCES), SOURCE_PRIOR)

    @staticmethod
    def gate(of_class: np.ndarray, of_all: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The gate of each bit, from the grades of evidence of the whole-word predictors."""
        return (of_class.astype(np.int64) * GRADES + of_all) * 2 + (depth >= 2)

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return squash((x * self.weight.astype(np.float32).T[:, gate]).sum(0))

    def cell(self, p: np.ndarray, gate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lower of the two cells that a probability lies between, and its distance from it."""
        y = (np.clip(stretch(p), -7.999, 7.999) + 8) * (CELLS - 1) / 16
        low = y.astype(np.int64)
        return gate * CELLS + low, y - low

    def refined(self, p: np.ndarray, gate: np.ndarray) -> np.ndarray:
        low, part = self.cell(p, gate)
        rate = self.cells[1] / self.cells.sum(0)
        return (1 - REFINED) * p + REFINED * ((1 - part) * rate[low] + part * rate[low + 1])

    def _parts(self, spelled: np.ndarray, shares: np.ndarray, of_class: np.ndarray) -> np.ndarray:
        """(SOURCES, words) logarithms of each source's weight and probability together."""
        weight = (self.sources / self.sources.sum(1, keepdims=True))[of_class].T
        with np.errstate(divide="ignore"):
            return np.log(weight) + np.concatenate([spelled[None], np.log(shares)])

    def words(self, spelled: np.ndarray, shares: np.ndarray, of_class: np.ndarray) -> np.ndarray:
        """Logarithms of words' probabilities, from those by their bits and (2, words) shares of the class's and of all tokens."""
        return np.logaddexp.reduce(self._parts(spelled, shares, of_class))

    def learn_words(self, spelled: np.ndarray, shares: np.ndarray, of_class: np.ndarray, weight: np.ndarray) -> None:
        parts = self._parts(spelled, shares, of_class)
        owed = np.exp(parts - np.logaddexp.reduce(parts)) * weight
        for k in range(SOURCES):
            self.sources[:, k] += np.bincount(of_class, owed[k], CLASSES)

    def learn(self, x: np.ndarray, gate: np.ndarray, bit: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Learn from some bits; returns the probabilities of a one that stood before."""
        p = self.mixed(x, gate)
        low, part = self.cell(p, gate)
        for v in (0, 1):
            held = np.where(bit == v, weight, 0.0)
            self.cells[v] += np.bincount(low, held * (1 - part), GATES * CELLS) + np.bincount(low + 1, held * part, GATES * CELLS)
        error = ((bit - p) * weight).astype(np.float32)
        total = np.bincount(gate, weight, GATES)
        for k in range(len(PREDICTORS) + 1):
            gradient = np.bincount(gate, error * x[k], GATES) / np.maximum(total, 1e-9)
            self.squares[:, k] += gradient**2
            self.weight[:, k] += RATE * gradient / np.sqrt(self.squares[:, k])
        return p


def predictions(counts: np.ndarray) -> np.ndarray:
    """Stretched probabilities of a one, from counts of zeros and ones on the last axis."""
    return np.log((counts[..., 1] + np.float32(0.2)) / (counts[..., 0] + np.float32(0.2)))


def _train(tables_sent, totals: np.ndarray, sizes: list[int], code: tuple[np.ndarray, np.ndarray]):
    """Of each range of the vocabulary, what a mixer learns from its words: weights times tokens seen, and what is added to its counts."""

    def learned(words: list[bytes], of_class: np.ndarray, count: np.ndarray, shares: np.ndarray, both: np.ndarray) -> tuple[Mixer, float]:
        mixer, seen, parts = Mixer(), 0.0, -(-sum(map(len, words)) // PART_BYTES)
        # each part and each batch has words from all over the range
        for part in range(parts):
            own = [x[part::parts] for x in (of_class, count)]
            bits = Bits(words[part::parts], own[0], sizes, code, once=True)
            weights, p = bits.spread(own[1]), np.empty(len(bits.bit))
            batches = -(-len(bits.bit) // BATCH_BITS)
            for j in range(batches):
                bit, weight = bits.bit[j::batches], weights[j::batches]
                counts = both[bits.slot[:, j::batches]].view(np.float32).reshape(len(PREDICTORS), -1, 2)
                # less the word's own occurrence
                counts[:, np.arange(len(bit)), bit] -= 1
                np.maximum(counts, 0, out=counts)
                x = np.concatenate([predictions(counts), np.full((1, len(bit)), 0.3, np.float32)])
                gate = Mixer.gate(*(grade(counts[k].sum(-1)) for k in (WHOLE_CLASS, WHOLE_ANY)), bits.depth[j::batches])
                p[j::batches] = mixer.learn(x, gate, bit.astype(np.float64), weight)
            spelled, shared_out = bits.gathered(np.log(np.where(bits.bit == 1, p, 1 - p))), shares[:, part::parts]
            batches = -(-len(spelled) // BATCH)
            for j in range(batches):
                mixer.learn_words(spelled[j::batches], shared_out[:, j::batches], own[0][j::batches], own[1][j::batches])
            seen += weights.sum()
        return mixer, seen

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tables_sent.value.view(np.uint64).reshape(-1)  # a slot's two counts, as 32-bit floats
        for x in _rows(batches):
            words, of_class, count, row, every = _words(x["words"].as_py(), x["counts"].as_py(), True)
            if words:
                # shares of the other occurrences
                shares = (np.stack([count, every[row]]) - 1) / np.maximum(np.stack([totals[of_class], np.full(len(row), totals[-1])]) - 1, 1)
                mixer, seen = learned(words, of_class, count, shares, both)
                sums = [mixer.weight * seen, mixer.cells - Mixer().cells, mixer.sources - SOURCE_PRIOR]
                yield pa.RecordBatch.from_arrays([pa.array([x["part"].as_py()], pa.int64()), pa.array([seen]), *(pa.array([v.tobytes()], pa.binary()) for v in sums)], names=LEARNED)

    return train


LEARNED = ["part", "seen", "weight", "cells", "sources"]


def _sum_learned(table: pa.Table) -> pa.Table:
    """The sums of what the mixers of some ranges learned, in their order."""
    table = table.sort_by("part")
    sums = [sum(np.frombuffer(x) for x in table.column(c).to_pylist()) for c in LEARNED[2:]]
    return pa.table({"part": table.column("part")[:1], "seen": pa.array([sum(table.column("seen").to_pylist())]), **{c: pa.array([v.tobytes()], pa.binary()) for c, v in zip(LEARNED[2:], sums, strict=True)}})


def _score(sent, mixer: Mixer, totals: np.ndarray, sizes: list[int], code: tuple[np.ndarray, np.ndarray]):
    """Of each range of the vocabulary, a row for each shard that has words of it: their counts and the logarithms of their probabilities, in the shard's order."""

    def scores(words: list[bytes], of_class: np.ndarray, shares: np.ndarray, predicted: np.ndarray, grades: np.ndarray) -> np.ndarray:
        out = [np.zeros(0)]
        for a, b in _parts(words):
            bits = Bits(words[a:b], of_class[a:b], sizes, code, once=True)
            logs = np.empty(len(bits.bit))
            for i in range(0, len(logs), BATCH_BITS):
                slot, bit = bits.slot[:, i : i + BATCH_BITS], bits.bit[i : i + BATCH_BITS]
                x = np.concatenate([predicted[slot], np.full((1, len(bit)), 0.3, np.float32)])
                gate = Mixer.gate(grades[slot[WHOLE_CLASS]], grades[slot[WHOLE_ANY]], bits.depth[i : i + BATCH_BITS])
                p = mixer.refined(mixer.mixed(x, gate), gate)
                logs[i : i + BATCH_BITS] = np.log(np.where(bit == 1, p, 1 - p))
            out.append(mixer.words(bits.gathered(logs), shares[:, a:b], of_class[a:b]) / np.log(10))
        return np.concatenate(out)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predicted, grades = sent.value
        predicted = predicted.astype(np.float32)
        for x in _rows(batches):
            words, of_class, count, row, every = _words(x["words"].as_py(), x["counts"].as_py(), False)
            shares = np.stack([count, every[row]]) / np.maximum(np.stack([totals[of_class], np.full(len(row), totals[-1])]), 1)
            score = scores(words, of_class, shares, predicted, grades).astype(np.float32)
            shards, places = x["shards"].as_py(), [_unplanes(v).astype(np.int64) for v in x["places"].as_py()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shards, pa.int64()), pa.array([x["part"].as_py()] * len(shards), pa.int64()), pa.array([_planes(every[row[v]]) for v in places], pa.binary()), pa.array([score[v].tobytes() for v in places], pa.binary())],
                names=["shard", "place", "counts", "scores"],
            )

    return score


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CLASS_BITS)).astype(np.int64)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over texts (cell, n) of the products of two hashed words' shares in whole steps; the last word stands for 1. Whole numbers, so their order does not matter."""
    size = 1 << MOMENT_BITS
    total = np.zeros((size + 1, size + 1))
    for batch in batches:
        data, bounds = shared.text_buffer(batch.column(0))
        for a, b in shared.pieces(bounds, PIECE_BYTES):
            words = Words(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], SPACED)
            buckets = _buckets(words.hash) >> (CLASS_BITS - MOMENT_BITS)
            for i in range(0, b - a, MOMENT_TEXTS):
                first = words.first[i : i + MOMENT_TEXTS + 1]
                n = np.diff(first)
                owner = np.repeat(np.arange(len(n)), n)
                count = np.bincount(owner * size + buckets[first[0] : first[-1]], minlength=len(n) * size).reshape(-1, size)[n > 0]
                x = np.ones((len(count), size + 1))
                x[:, :size] = SHARE_STEPS * count // n[n > 0, None]
                total += x.T @ x
    cell = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(total.reshape(-1)[cell].astype(np.int64))], names=["cell", "n"])


def moments(training: DataFrame) -> np.ndarray:
    """The sums of :func:`_moments` over all rows of a one-column table; a fixed number of them reaches the driver."""
    size = (1 << MOMENT_BITS) + 1
    found = training.mapInArrow(shared.returning(_moments), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(size * size)
    total[found["cell"].to_numpy(np.int64)] = found["n"].to_numpy(np.float64)
    return total.reshape(size, size)


def first_models(total: np.ndarray) -> np.ndarray:
    """(CLASSES, buckets + 1) weights of hashed words and, last, of the class: both ends of each main direction of the texts' shares around their mean."""
    models = np.zeros((CLASSES, (1 << CLASS_BITS) + 1))
    mean = total[-1, :-1] / max(total[-1, -1], 1)
    if not mean.any():
        return models
    values, vectors = np.linalg.eigh(total[:-1, :-1] / total[-1, -1] - np.outer(mean, mean))
    ends = (vectors / np.sqrt(np.maximum(values, 1e-9)))[:, ::-1][:, : CLASSES // 2].T
    ends *= np.sign(ends[np.arange(len(ends)), np.abs(ends).argmax(1)])[:, None]
    # the mean text weighs nothing
    ends = ends - (ends @ mean / mean.sum())[:, None]
    models[:, :-1] = np.repeat(np.concatenate([ends, -ends]), 1 << (CLASS_BITS - MOMENT_BITS), axis=1)
    return models


def _classed(models_sent):
    """Counts (class, bucket, n) of words in texts of the best class by the models so far; bucket 2**CLASS_BITS counts texts."""

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, size = models_sent.value, 1 << CLASS_BITS
        total = np.zeros((CLASSES, size + 1), np.int64)
        for batch in batches:
            data, bounds = shared.text_buffer(batch.column(0))
            for a, b in shared.pieces(bounds, PIECE_BYTES):
                words = Words(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], SPACED)
                buckets = _buckets(words.hash)
                own = _best_class(models, buckets, words.first)
                n = np.diff(words.first)
                total[:, :size] += np.bincount(np.repeat(own, n) * size + buckets, minlength=CLASSES * size).reshape(CLASSES, size)
                total[:, size] += np.bincount(own[n > 0], minlength=CLASSES)
        of_class, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(of_class, pa.int32()), pa.array(bucket, pa.int32()), pa.array(total[of_class, bucket])], names=["class", "bucket", "n"])

    return classed


def _best_class(models: np.ndarray, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.stack([shared.sums(m[buckets], first) + m[-1] for m in models]).argmax(0)


def refitted(training: DataFrame, models: np.ndarray) -> np.ndarray:
    """Word models of the classes, counted over all rows of a one-column table; a fixed number of sums reaches the driver."""
    for _ in range(CLASS_PASSES):
        sent = training.sparkSession.sparkContext.broadcast(models)
        found = training.mapInArrow(shared.returning(_classed(sent)), "class int, bucket int, n long").groupBy("class", "bucket").agg(F.sum("n").alias("n")).toPandas()
        total = np.zeros(models.shape)
        total[found["class"].to_numpy(np.int64), found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(np.float64)
        counts, prior = total[:, :-1] + 0.1, total[:, -1] + 0.5
        models = np.concatenate([np.log(counts / counts.sum(1, keepdims=True)), np.log(prior / prior.sum())[:, None]], axis=1)
        sent.destroy()
    return models


def _shards(models_sent):
    """Rows of about SHARD_BYTES of text: ids, held, size and class of each document, words as local numbers, and the vocabulary of words in classes with training counts."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, models = 0, models_sent.value
        for batch in batches:
            data, bounds = shared.text_buffer(batch.column(1))
            learn = batch.column(2).to_numpy(zero_copy_only=False)
            for a, b in shared.pieces(bounds, PIECE_BYTES):
                held.append(_local(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], learn[a:b], batch.column(0)[a:b], models))
                size += int(bounds[b] - bounds[a])
                if size >= SHARD_BYTES:
                    yield _shard(held)
                    held, size = [], 0
        if held:
            yield _shard(held)

    return shards


def _local(data: np.ndarray, bounds: np.ndarray, learn: np.ndarray, ids: pa.Array, models: np.ndarray) -> tuple:
    words = Words(data, bounds, SPACED)
    buckets, n = _buckets(words.hash), len(bounds) - 1
    own = _best_class(models, buckets, words.first)
    hashes = np.insert(words.hash, words.first[1:], np.uint64(END_HASH))
    first = words.first + np.arange(n + 1)
    sizes = np.diff(first)
    keys = mix(hashes) + np.repeat(own, sizes).astype(np.uint64)
    _, where, code = np.unique(keys, return_index=True, return_inverse=True)
    start = np.insert(words.start, words.first[1:], -1)[where]
    end = np.insert(words.end, words.first[1:], -1)[where]
    raw = LOWER[data].tobytes()
    texts = [raw[i:j] if i >= 0 else END for i, j in zip(start.tolist(), end.tolist(), strict=True)]
    count = np.bincount(code, np.repeat(learn, sizes), len(where)).astype(np.int64)
    spelled = np.insert(words.end - words.start + 1, words.first[1:], 1)
    length = np.bincount(np.repeat(np.arange(n), sizes), spelled, n).astype(np.int64)
    return ids, learn, sizes, own, code, keys[where], hashes[where], np.repeat(own, sizes)[where], texts, count, length


def _shard(held: list[tuple]) -> pa.RecordBatch:
    every = np.concatenate([x[5] for x in held])
    keys, where, inverse = np.unique(every, return_index=True, return_inverse=True)
    texts = [t for x in held for t in x[8]]
    count = np.bincount(inverse, np.concatenate([x[9] for x in held]), len(keys)).astype(np.int64)
    starts = np.cumsum([0, *(len(x[5]) for x in held)])
    code = np.concatenate([inverse[a + x[4]] for a, x in zip(starts[:-1].tolist(), held, strict=True)])
    # numbers by frequency, so that most are small
    order = np.argsort(-np.bincount(code, minlength=len(keys)), kind="stable")
    number = np.empty(len(keys), np.int32)
    number[order] = np.arange(len(keys))
    code, keys, where, count = number[code], keys[order], where[order], count[order]
    words = [texts[i] for i in where.tolist()]
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    joined = lambda i: np.concatenate([x[i] for x in held])
    content = np.concatenate([keys, code.astype(np.uint64) + mix(np.arange(len(code), dtype=np.uint64))])
    key = int(mix(mix(content).sum(keepdims=True))[0].view(np.int64))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([key], pa.int64()),
            one(pa.concat_arrays([x[0] for x in held])),
            one(pa.array(joined(1), pa.bool_())),
            one(pa.array(joined(2), pa.int64())),
            one(pa.array(joined(3), pa.int32())),
            one(pa.array(joined(10))),
            pa.array([_planes(code)], pa.binary()),
            one(pa.array(joined(6)[where].view(np.int64))),
            one(pa.array(joined(7)[where], pa.int32())),
            pa.array([b" ".join(words)], pa.binary()),
            pa.array([_planes(count)], pa.binary()),
            pa.array([_prefixes(words).tobytes()], pa.binary()),
        ],
        names=["shard", "ids", "learn", "sizes", "own", "bytes", "codes", "hashes", "classes", "words", "counts", "prefixes"],
    )


def _prefixes(words: list[bytes]) -> np.ndarray:
    """``PREFIX_BITS`` bits of the hashes of words' first bytes."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size)
    start = end - size
    return (hash_spans(np.frombuffer(b"".join(words), np.uint8), start, np.minimum(end, start + PREFIX)) >> np.uint64(64 - PREFIX_BITS)).astype(np.uint8)


def _planes(values: np.ndarray) -> bytes:
    """Numbers from 0 by planes of those of their 8 bytes that are used, compressed."""
    if not len(values):
        return b""
    wide = np.ascontiguousarray(values, np.uint64)
    k = max(1, (int(wide.max()).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(wide.view(np.uint8).reshape(-1, 8)[:, :k].T)
    return np.array([len(values), k]).tobytes() + pa.compress(planes, "zstd", asbytes=True)


def _unplanes(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.uint64)
    n, k = np.frombuffer(raw, np.int64, 2).tolist()
    out = np.zeros((n, 8), np.uint8)
    out[:, :k] = np.frombuffer(pa.decompress(memoryview(raw)[16:], n * k, "zstd"), np.uint8).reshape(k, n).T
    return out.view(np.uint64).reshape(-1)


def _codes(raw: bytes) -> np.ndarray:
    return _unplanes(raw).astype(np.int32)


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order and each key's place among them, in less memory than ``np.unique`` takes."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    rank = np.cumsum(new, dtype=np.int32)
    rank -= 1
    where = np.empty(len(keys), np.int32)
    where[order] = rank
    return ordered[new], where


def _before(code: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The local number of the word before each token; before the first stands the end mark."""
    out = np.empty_like(code)
    out[1:] = code[:-1]
    out[(np.cumsum(sizes) - sizes)[sizes > 0]] = np.flatnonzero(hashes == END_HASH)[0] if len(hashes) else 0
    return out


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + word)


def _keys(code: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return pair_keys(hashes[_before(code, sizes, hashes)], hashes[code])


def _local_order(prefixes: bytes, hashes: np.ndarray, classes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which a shard's words, each in a class, go to the ranges of the vocabulary, and the range of each."""
    first = min(bits, PREFIX_BITS)
    part = np.frombuffer(prefixes, np.uint8).astype(np.int64) >> (PREFIX_BITS - first)
    if bits > first:
        part = part << (bits - first) | (hashes >> np.uint64(64 - bits + first)).astype(np.int64)
    return np.lexsort((classes, hashes, part)), part


def _vocabulary_rows(bits: int):
    """Of each shard, a row for each range of word hashes that occurs: its words in classes, in order, and their training counts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _rows(batches):
            hashes, classes, shard = x["hashes"].values.to_numpy().view(np.uint64), x["classes"].values.to_numpy(), x["shard"].as_py()
            order, part = _local_order(x["prefixes"].as_py(), hashes, classes, bits)
            words, count = x["words"].as_py().split(b" "), _unplanes(x["counts"].as_py())[order]
            hashes, classes, words = hashes[order], classes[order], [words[i] for i in order.tolist()]
            parts, first = np.unique(part[order], return_index=True)
            cuts = list(zip(first.tolist(), [*first[1:].tolist(), len(hashes)], strict=True))
            made = ([_planes(hashes[a:b]), classes[a:b].astype(np.uint8).tobytes(), b" ".join(words[a:b]), _planes(count[a:b])] for a, b in cuts)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([shard] * len(parts), pa.int64()), *(pa.array(v, pa.binary()) for v in zip(*made, strict=True))], names=["part", "shard", "hashes", "classes", "words", "counts"])

    return rows


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each range of word hashes: its words in order, their counts in each class (and one more, where the word occurs in it), the place of each shard's words among all, and sums."""
    held: dict[int, list[dict]] = {}
    for x in _rows(batches):
        held.setdefault(x["part"].as_py(), []).append({c: v.as_py() for c, v in x.items()})
    for part, rows in held.items():
        hashes = [_unplanes(x["hashes"]) for x in rows]
        every, where, inverse = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        texts = b" ".join([x["words"] for x in rows]).split(b" ")
        words = [texts[i] for i in where.tolist()]
        order = pa.compute.sort_indices(pa.array(words, pa.binary())).to_numpy()
        rank = np.empty(len(every), np.int64)
        rank[order] = np.arange(len(every))
        cell = np.frombuffer(b"".join(x["classes"] for x in rows), np.uint8).astype(np.int64) * len(every) + rank[inverse]
        occurs = np.bincount(cell, minlength=CLASSES * len(every)) > 0
        counts = np.bincount(cell, np.concatenate([_unplanes(x["counts"]) for x in rows]), CLASSES * len(every)).astype(np.int64)
        number = np.cumsum(occurs) - 1
        cuts = np.cumsum([0, *map(len, hashes)]).tolist()
        words = [words[i] for i in order.tolist()]
        by_class = counts.reshape(CLASSES, -1)
        of_word = by_class.sum(0)
        data = np.frombuffer(b"".join(words), np.uint8)
        of_byte = np.bincount(data, np.repeat(of_word, [len(w) for w in words]), 256).astype(np.int64)
        of_byte[32] += of_word.sum()
        sums = np.concatenate([[(of_word > 0).sum()], by_class.sum(1), [of_word.sum()], of_byte])
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([part], pa.int32()),
                pa.array([b" ".join(words)], pa.binary()),
                pa.array([_planes(counts + occurs)], pa.binary()),
                one(pa.array([x["shard"] for x in rows], pa.int64())),
                one(pa.array([_planes(number[cell[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())),
                one(pa.array(sums)),
            ],
            names=["part", "words", "counts", "shards", "places", "sums"],
        )


def _pair_rows(bits: int):
    """Of each shard, a row for each range of pair hashes that occurs: its distinct pairs in order and their training counts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, learn, sizes, codes, hashes = (batch.column(c)[i] for c in range(5))
                sizes, hashes = sizes.values.to_numpy(), hashes.values.to_numpy().view(np.uint64)
                keys, where = _ranked(_keys(_codes(codes.as_py()), sizes, hashes))
                count = np.bincount(where, np.repeat(learn.values.to_numpy(zero_copy_only=False), sizes), len(keys)).astype(np.int64)
                part = (keys >> np.uint64(64 - bits)).astype(np.int64)
                parts, first = np.unique(part, return_index=True)
                cuts = list(zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(parts, pa.int32()), pa.array([shard.as_py()] * len(parts), pa.int64()), pa.array([_planes(keys[a:b]) for a, b in cuts], pa.binary()), pa.array([_planes(count[a:b]) for a, b in cuts], pa.binary())],
                    names=["part", "shard", "keys", "counts"],
                )

    return rows


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each range, each shard's pairs with their counts in all shards."""
    held: dict[int, list[dict]] = {}
    for x in _rows(batches):
        held.setdefault(x["part"].as_py(), []).append({c: v.as_py() for c, v in x.items()})
    for part, rows in held.items():
        keys = [_unplanes(x["keys"]) for x in rows]
        count = np.concatenate([_unplanes(x["counts"]) for x in rows]).astype(np.float64)
        where = _ranked(np.concatenate(keys))[1]
        total = np.split(np.bincount(where, count)[where].astype(np.int64), np.cumsum([len(k) for k in keys])[:-1])
        yield pa.RecordBatch.from_arrays([pa.array([x["shard"] for x in rows], pa.int64()), pa.array([part] * len(rows), pa.int64()), pa.array([_planes(t) for t in total], pa.binary())], names=["shard", "place", "totals"])


def _met(bits: int):
    def met(found: pa.Table, shards: pa.Table) -> pa.Table:
        try:
            return _meeting(found, shards, bits)
        finally:
            shared.hand_back()

    return met


def _meeting(found: pa.Table, shards: pa.Table, bits: int) -> pa.Table:
    """A shard with its words' counts and scores and its tokens' pair counts. It can stand several times, where rows repeat."""
    of_pairs = found.column("totals").is_valid()
    pairs, words = found.filter(of_pairs), found.filter(pa.compute.invert(of_pairs))
    joined = lambda table, c, read: np.concatenate([read(b""), *(read(x) for x in table.column(c).take(pa.array(np.unique(table.column("place").to_numpy(), return_index=True)[1])).to_pylist())])
    totals = joined(pairs, "totals", _unplanes)
    in_order = joined(words, "counts", _unplanes).astype(np.int64), joined(words, "scores", lambda raw: np.frombuffer(raw, np.float32))
    many = []
    for i in range(shards.num_rows):
        code, sizes, hashes = _codes(shards.column("codes")[i].as_py()), shards.column("sizes")[i].values.to_numpy(), shards.column("hashes")[i].values.to_numpy().view(np.uint64)
        where = _ranked(_keys(code, sizes, hashes))[1]
        order = _local_order(shards.column("prefixes")[i].as_py(), hashes, shards.column("classes")[i].values.to_numpy(), bits)[0]
        count, score = (np.empty_like(v) for v in in_order)
        count[order], score[order] = in_order
        many.append((_planes(totals[where]), _planes(count), score.tobytes(), np.flatnonzero(hashes == END_HASH)[0]))
    kept = shards.select(["ids", "learn", "sizes", "own", "bytes", "codes"])
    for name, kind, values in zip(("pairs", "counts", "scores", "last"), (pa.binary(), pa.binary(), pa.binary(), pa.int64()), zip(*many, strict=True), strict=True):
        kept = kept.append_column(name, pa.array(values, kind))
    return kept


class Tokens:
    """One shard's tokens: word numbers, counts of words and of the words before, logarithms of words' probabilities, pair counts."""

    def __init__(self, row: dict):
        self.sizes, self.learn = row["sizes"].values.to_numpy(), row["learn"].values.to_numpy(zero_copy_only=False)
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        code, count = _codes(row["codes"].as_py()), _unplanes(row["counts"].as_py()).astype(np.int64)
        self.count, self.spelled = count[code], np.frombuffer(row["scores"].as_py(), np.float32)[code] * np.log(10)
        before = np.empty_like(self.count)
        before[1:] = self.count[:-1]
        before[(np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]] = count[row["last"].as_py()]
        self.before, self.pairs = before, _unplanes(row["pairs"].as_py()).astype(np.int64)
        self.grade = np.frexp(before.astype(np.float64))[1]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(j)[i] for j, c in enumerate(batch.schema.names)}


def _ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training tokens by grade and by the ratio of what the pair, less its own occurrence, and the word say."""
    total = np.zeros(BEFORE * RATIOS, np.int64)
    for row in _rows(batches):
        t = Tokens(row)
        use = np.flatnonzero(t.learn[t.owner])
        grade, pairs, before = t.grade[use], t.pairs[use] - 1, t.before[use] - 1
        cell = np.zeros(len(use), np.int64)
        seen = np.flatnonzero(pairs > 0)
        ratio = np.log(pairs[seen] / before[seen]) - t.spelled[use][seen]
        cell[seen] = np.clip(np.rint(ratio / RATIO_WIDTH) + RATIOS // 2, 1, RATIOS - 1).astype(np.int64)
        total += np.bincount(grade * RATIOS + cell, minlength=BEFORE * RATIOS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["cell", "n"])


def pair_weights(total: np.ndarray) -> np.ndarray:
    """The weight of pairs in each grade, from (BEFORE, RATIOS) counts of tokens: that of the greatest likelihood, with one token more of a pair not seen."""
    ratio = np.exp((np.arange(RATIOS) - RATIOS // 2) * RATIO_WIDTH)
    ratio[0] = 0
    weight = np.full((BEFORE, 1), 0.5)
    for _ in range(FITS):
        weight = (total * (weight * ratio / (weight * ratio + 1 - weight))).sum(1, keepdims=True) / (total.sum(1, keepdims=True) + 1)
    return weight[:, 0]


def _documents(n: int, rest: float, prior: np.ndarray, weight: np.ndarray):
    """One row a document from the shards with their counts: sums over its tokens."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            t = Tokens(row)
            with np.errstate(divide="ignore"):
                by_pair = np.log(weight[t.grade]) + np.log(t.pairs / np.maximum(t.before, 1))
                mixed = np.logaddexp(np.log1p(-weight[t.grade]) + t.spelled, by_pair) / np.log(10)
            known, based, scored = (np.bincount(t.owner, v, len(t.sizes)) for v in (t.count > 0, np.log10((t.count + 0.1) / rest), mixed))
            scored += prior[row["own"].values.to_numpy()]
            long = lambda x: pa.array(x.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [row["ids"].values, row["learn"].values, long(t.sizes), long(known), long(np.full(len(t.sizes), n)), pa.array(based), pa.array(scored), row["bytes"].values],
                names=["id", "learn", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bytes"],
            )

    return documents


def scored(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    The model learns from the rows for which ``held_out`` (of the columns of ``docs``) is not true.
    """
    with shared.shuffles_dropped(docs.sparkSession):
        return _scored(docs, held_out, id_col, text_col)


def _scored(docs: DataFrame, held_out: Column, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    send, back = spark.sparkContext.broadcast, shared.returning
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (~F.coalesce(held_out, F.lit(False))).alias("learn"))
    training = rows.where("learn")
    models = refitted(training.select("text"), first_models(moments(training.select("text"))))
    layout = f"shard long, ids array<{kind}>, learn array<boolean>, sizes array<long>, own array<int>, bytes array<long>, codes binary, hashes array<long>, classes array<int>, words binary, counts binary, prefixes binary"
    shards = shared.written(rows.mapInArrow(back(_shards(send(models))), layout), "lm-shards", compression="zstd", **GROUP_SHARDS)
    ranges = max(1, shards.count().bit_length())
    own = shards.select("shard", "hashes", "classes", "words", "counts", "prefixes").mapInArrow(back(_vocabulary_rows(ranges)), "part int, shard long, hashes binary, classes binary, words binary, counts binary")
    merged = own.repartitionById(1 << ranges, "part").mapInArrow(back(_merged), "part int, words binary, counts binary, shards array<long>, places array<binary>, sums array<long>")
    vocabulary = shared.written(merged, "lm-words", compression="zstd", **GROUP_SHARDS)
    sums = np.zeros(2 + CLASSES + 256, np.int64)
    for at, value in vocabulary.select(F.posexplode("sums").alias("at", "value")).groupBy("at").agg(F.sum("value")).collect():
        sums[at] = value
    distinct, totals, n = int(sums[0]), sums[1 : 2 + CLASSES], int(sums[1 + CLASSES])
    lengths = code_lengths(sums[2 + CLASSES :] + 1, 15)
    code = (lengths.astype(np.int64), canonical_codes(lengths).astype(np.int64))
    known = vocabulary.select("part", "words", "counts")
    sizes = table_bits(distinct)
    tables = np.zeros((table_starts(sizes)[-1], 2), np.uint32)
    counted = known.coalesce(max(1, -(-distinct // TASK_WORDS))).mapInArrow(back(_tables(sizes, code)), "chunk int, counts binary").groupBy("chunk").applyInArrow(_sum_tables, "chunk int, counts binary")
    for chunk, counts in counted.collect():
        part = _wide(counts)
        tables[chunk : chunk + len(part)] = part
    mixer, sent = Mixer(), send(tables.astype(np.float32))
    layout = "part long, seen double, weight binary, cells binary, sources binary"
    learned = known.mapInArrow(back(_train(sent, totals, sizes, code)), layout).groupBy(F.col("part") % MIXER_GROUPS).applyInArrow(_sum_learned, layout).collect()
    if learned:
        learned.sort()
        total = sum(x.seen for x in learned)
        mixer.weight = sum(np.frombuffer(x.weight) for x in learned).reshape(GATES, -1) / total
        mixer.cells = mixer.cells + sum(np.frombuffer(x.cells) for x in learned).reshape(2, -1)
        mixer.sources = mixer.sources + sum(np.frombuffer(x.sources) for x in learned).reshape(CLASSES, -1)
    sent.destroy()
    sent = send((predictions(tables.astype(np.float32)).astype(np.float16), grade(tables.sum(-1, dtype=np.int64)).astype(np.uint8)))
    words = vocabulary.select("part", "words", "counts", "shards", "places").mapInArrow(back(_score(sent, mixer, totals, sizes, code)), "shard long, place long, counts binary, scores binary")
    rows = shards.select("shard", "learn", "sizes", "codes", "hashes").mapInArrow(back(_pair_rows(ranges)), "part int, shard long, keys binary, counts binary")
    pairs = shared.written(rows.repartitionById(1 << ranges, "part").mapInArrow(back(_pair_sums), "shard long, place long, totals binary"), "lm-pairs", compression="zstd")
    found = words.withColumn("totals", F.lit(None).cast("binary")).unionByName(pairs, allowMissingColumns=True)
    whole = shards.select(F.col("shard").alias("key"), "ids", "learn", "sizes", "own", "bytes", "codes", "hashes", "classes", "prefixes")
    layout = f"ids array<{kind}>, learn array<boolean>, sizes array<long>, own array<int>, bytes array<long>, codes binary, pairs binary, counts binary, scores binary, last long"
    met = shared.written(found.groupBy("shard").cogroup(whole.groupBy("key")).applyInArrow(_met(ranges), layout), "lm-tokens", compression="zstd", **GROUP_SHARDS)
    for table in (vocabulary, pairs):
        shared.drop_table(table)
    ratios = met.mapInArrow(back(_ratios), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(BEFORE * RATIOS)
    total[ratios["cell"].to_numpy(np.int64)] = ratios["n"].to_numpy(np.float64)
    kinds = f"id {kind}, learn boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bytes long"
    out = met.mapInArrow(back(_documents(n, n + 0.1 * (distinct + 1), models[:, -1] / np.log(10), pair_weights(total.reshape(BEFORE, RATIOS)))), kinds)
    bits = F.when(F.col("bytes") > 0, -F.col("score") * float(np.log2(10)) / F.col("bytes"))
    return out.select(F.col("id").alias(id_col), (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", bits.alias("bits_per_byte"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.crc32(F.col("doc_id").cast("string")) % 10 == 0)
