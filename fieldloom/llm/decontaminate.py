"""Benchmark decontamination with an FM-index for each shard of training text.

A task cuts its documents into shards of whole documents. Words become symbols of the benchmark's
own vocabulary; all other words, and the bounds between documents, are symbol 0, of which runs are
stored once, since no phrase crosses them. Over these symbols stand a suffix order, its
Burrows-Wheeler transform in a wavelet matrix, and positions sampled at every ``SAMPLE``-th symbol.
All phrases are searched backwards at the same time through wavelet ranks; occurrences are located
by steps to the nearest sampled position, and overlapping ones merge into spans.

Phrases are the windows of ``window`` consecutive words of each item; an item of fewer words, but
not none, is one phrase. Phrases are taken in blocks, so memory is bounded by shard and block. A benchmark of more than
``PART_BYTES`` is searched in passes: a pass sends one part to the tasks and writes what it found, the next adds to it.

Defined results: null and empty texts have no words and no spans; items without words match
nothing; repeated items and repeated rows each count; an empty benchmark leaves all clean. Only the
id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .words import ALNUM, Words

WINDOW = 10
SHARD_BYTES = 2 << 20
SAMPLE = 8
BLOCK = 1 << 16


class FMIndex:
    """Counts and places of phrases in one sequence of small non-negative integers; 0 is in no phrase."""

    def __init__(self, symbols: np.ndarray, size: int):
        text = np.append(symbols + 1, 0).astype(np.int64)  # 0 ends the text and is unique
        size += 1
        self.n = len(text)
        order = suffix_order(text)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        current = text[order - 1]
        self.levels = max(1, int(size - 1).bit_length())
        self.zeros, self.ones_at = [], []
        for level in reversed(range(self.levels)):
            bit = (current >> level) & 1
            zeros = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit == 0, out=zeros[1:])
            self.zeros.append(zeros)
            self.ones_at.append(int(zeros[-1]))
            current = np.concatenate([current[bit == 0], current[bit == 1]])
        sampled = order % SAMPLE == 0
        self.sampled = sampled
        self.sample_rank = np.concatenate([[0], np.cumsum(sampled)])
        self.places = order[sampled]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in the transform before each position."""
        low, high = np.zeros(len(at), np.int64), at
        for zeros, ones_at, level in zip(self.zeros, self.ones_at, reversed(range(self.levels)), strict=True):
            one = ((symbol >> level) & 1).astype(bool)
            a, b = zeros[low].astype(np.int64), zeros[high].astype(np.int64)
            low, high = np.where(one, low - a + ones_at, a), np.where(one, high - b + ones_at, b)
        return high - low

    def step(self, at: np.ndarray) -> np.ndarray:
        """From each suffix to the one that begins a symbol earlier."""
        symbol, low, high = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), at
        for zeros, ones_at in zip(self.zeros, self.ones_at, strict=True):
            one = zeros[high] == zeros[high + 1]
            symbol = symbol * 2 + one
            a, b = zeros[low].astype(np.int64), zeros[high].astype(np.int64)
            low, high = np.where(one, low - a + ones_at, a), np.where(one, high - b + ones_at, b)
        return self.before[symbol] + high - low

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each phrase (rows, left-aligned)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for back in range(1, phrases.shape[1] + 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            if not len(live):
                break
            symbol = phrases[live, lengths[live] - back] + 1
            low[live] = self.before[symbol] + self.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, at: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by steps to a sampled one."""
        out, moved = np.zeros(len(at), np.int64), 0
        left = np.arange(len(at))
        while len(left):
            here = self.sampled[at]
            out[left[here]] = self.places[self.sample_rank[at[here]]] + moved
            left, at = left[~here], at[~here]
            if len(at):
                at = self.step(at)
            moved += 1
        return out


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order, by doubling; each round sorts only what is still tied."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    ordered = text[order]
    head = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    width = 1
    while True:
        alone = head & np.append(head[1:], True)
        tied = np.flatnonzero(~alone)
        if not len(tied):
            return order
        suffix = order[tied]
        after = suffix + width
        key = rank[suffix] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key)
        key, suffix = key[by], suffix[by]
        order[tied] = suffix
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        head[tied] |= fresh
        rank[suffix] = np.maximum.accumulate(np.where(fresh, tied, 0))
        width *= 2


class Phrases:
    """Distinct windows of all items, as symbols of their vocabulary."""

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        raw = [(text or "").encode() for _, text in items]
        bounds = np.cumsum([0, *map(len, raw)])
        found = Words(np.frombuffer(b"".join(raw), np.uint8), bounds, ALNUM)
        self.vocabulary = np.unique(found.hash)
        symbols = np.searchsorted(self.vocabulary, found.hash) + 1
        rows: dict[tuple[int, ...], list[int]] = {}
        for i in range(len(items)):
            own = symbols[found.first[i] : found.first[i + 1]].tolist()
            for at in range(max(len(own) - window, 0) + 1) if own else ():
                held = rows.setdefault(tuple(own[at : at + window]), [])
                if not held or held[-1] != i:
                    held.append(i)
        self.lengths = np.array([len(k) for k in rows], np.int64)
        self.symbols = np.zeros((len(rows), window), np.int64)
        for i, k in enumerate(rows):
            self.symbols[i, : len(k)] = k
        self.item_first = np.cumsum([0, *(len(v) for v in rows.values())])
        self.items = np.array([x for v in rows.values() for x in v], np.int64)
        self.names = [name for name, _ in items]


def occurrences(words: Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Phrase number and first word of every occurrence in the documents of ``words``."""
    none = np.zeros(0, np.int64)
    if not len(phrases.lengths) or not len(words.hash):
        return none, none
    at = np.searchsorted(phrases.vocabulary, words.hash)
    at[at == len(phrases.vocabulary)] = 0
    symbols = np.where(phrases.vocabulary[at] == words.hash, at + 1, 0)
    starts = words.first[:-1][np.diff(words.first) > 0]
    wide = np.insert(symbols, starts, 0)
    word_of = np.insert(np.arange(len(symbols)), starts, -1)
    keep = (wide != 0) | np.concatenate([[True], wide[:-1] != 0])
    wide, word_of = wide[keep], word_of[keep]
    if len(wide) <= 1:
        return none, none
    index = FMIndex(wide, len(phrases.vocabulary) + 1)
    which, places = [], []
    for a in range(0, len(phrases.lengths), BLOCK):
        low, high = index.search(phrases.symbols[a : a + BLOCK], phrases.lengths[a : a + BLOCK])
        count = high - low
        hit = np.flatnonzero(count)
        number = np.repeat(hit, count[hit])
        row = np.repeat(low[hit] - np.concatenate([[0], np.cumsum(count[hit])[:-1]]), count[hit]) + np.arange(len(number))
        which.append(number + a)
        places.append(word_of[index.locate(row)])
    return np.concatenate(which), np.concatenate(places)


#: What a pass hands to the next: words hit (ranges) and items found.
CARRIED = "hit_start array<long>, hit_end array<long>, item_ids array<string>"


def _scan(part, window: int, carry: bool = False):
    """Task function over rows (id, text), or with what an earlier pass carried; ``part``: broadcast list of (item id as text, text).

    With ``carry`` the text and the words hit are handed on.
    """

    def scan(batches: Iterator[pa.RecordBatch], phrases: Phrases | None = None) -> Iterator[pa.RecordBatch]:
        phrases = phrases or Phrases(part.value, window)
        for batch in batches:
            data, bounds = shared.text_buffer(batch.column(1))
            for a, b in shared.pieces(bounds, SHARD_BYTES):
                words = Words(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], ALNUM)
                before = [batch.column(i)[a:b] for i in range(2, 5)] if batch.num_columns == 5 else None
                found = _hits(words, phrases, *occurrences(words, phrases), bounds[a : b + 1] - bounds[a], before)
                if carry:
                    yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], found[5], found[6], found[2]], names=["id", "text", "hit_start", "hit_end", "item_ids"])
                else:
                    yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *found[:5]], names=["id", "n_words", "n_hit", "item_ids", "span_start", "span_end"])

    return scan


def _lists(values: pa.Array, owner: np.ndarray, n: int) -> pa.Array:
    """Lists of values by owner; owners ascend."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), values)


def _hits(words: Words, phrases: Phrases, which: np.ndarray, place: np.ndarray, bounds: np.ndarray, before: list[pa.Array] | None) -> list[pa.Array]:
    """n_words, n_hit, item_ids, byte spans and word ranges of each document, from occurrences and what an earlier pass found."""
    docs, n = len(bounds) - 1, len(words.start)
    cover = np.zeros(n + 1, np.int64)
    doc_of = words.doc()
    np.add.at(cover, place, 1)
    np.subtract.at(cover, place + phrases.lengths[which], 1)
    earlier = [[] for _ in range(docs)]
    if before is not None:
        at = np.repeat(words.first[:-1], pa.compute.list_value_length(before[0]).to_numpy())
        np.add.at(cover, at + before[0].flatten().to_numpy(), 1)
        np.subtract.at(cover, at + before[1].flatten().to_numpy(), 1)
        earlier = before[2].to_pylist()
    names = sorted({x for own in earlier for x in own} | set(phrases.names))
    order = np.searchsorted(names, phrases.names)
    count = np.diff(phrases.item_first)[which]
    at = np.repeat(phrases.item_first[which] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
    pairs = [np.repeat(doc_of[place], count) * np.int64(len(names)) + order[phrases.items[at]], np.array([i * len(names) + int(np.searchsorted(names, x)) for i, own in enumerate(earlier) for x in own], np.int64)]
    pairs = np.unique(np.concatenate(pairs))
    owner, item = pairs // max(len(names), 1), pairs % max(len(names), 1)
    hit = np.cumsum(cover)[:n] > 0
    begins = np.zeros(n + 1, bool)
    begins[words.first] = True
    first = np.flatnonzero(hit & (begins[:n] | ~np.concatenate([[False], hit[:-1]])[:n]))
    last = np.flatnonzero(hit & (begins[1:] | ~np.append(hit[1:], False)[:n]))
    listed = lambda values: _lists(pa.array(values, pa.int64()), doc_of[first], docs)
    return [
        pa.array(np.diff(words.first), pa.int64()),
        pa.array(np.bincount(doc_of[hit], minlength=docs), pa.int64()),
        _lists(pa.array([names[i] for i in item.tolist()], pa.string()), owner, docs),
        listed(words.start[first] - bounds[doc_of[first]]),
        listed(words.end[last] - bounds[doc_of[last]]),
        listed(first - words.first[doc_of[first]]),
        listed(last + 1 - words.first[doc_of[last]]),
    ]


#: A part of the benchmark that a task searches at once, in bytes of text.
PART_BYTES = 32 << 20


def benchmark_parts(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[str, str | None]]]:
    """Items in parts of at most ``PART_BYTES``, streamed: the driver holds one part at a time. An item without id is named null."""
    part, held = [], 0
    for name, text in benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")), F.col(text_col)).toLocalIterator():
        part.append((name, text))
        held += len(text or "")
        if held > PART_BYTES:
            yield part
            part, held = [], 0
    yield part


def _passes(rows: DataFrame, benchmark: DataFrame, item_col: str, text_col: str, window: int) -> tuple[DataFrame, object]:
    """Rows (id, text), with what all parts of the benchmark but the last have found, and the last part, sent to the tasks."""
    context, kind = rows.sparkSession.sparkContext, rows.schema["id"].dataType.simpleString()
    parts = benchmark_parts(benchmark, item_col, text_col)
    part = next(parts)
    for more in parts:
        sent = context.broadcast(part)
        rows = shared.written(rows.mapInArrow(shared.returning(_scan(sent, window, True)), f"id {kind}, text string, {CARRIED}"), "benchmark-pass")
        sent.destroy()
        part = more
    return rows, context.broadcast(part)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row a document: id_col, n_words, n_hit, item_ids (strings, distinct, sorted), spans.

    Spans are structs (start, end): byte ranges of the UTF-8 text, from the first to the last word
    of merged occurrences.
    """
    rows, part = _passes(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), benchmark, item_col, item_text_col, window)
    kinds = f"id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_hit long, item_ids array<string>, span_start array<long>, span_end array<long>"
    spans = F.arrays_zip(F.col("span_start").alias("start"), F.col("span_end").alias("end"))
    return rows.mapInArrow(shared.returning(_scan(part, window)), kinds).select(F.col("id").alias(id_col), "n_words", "n_hit", "item_ids", spans.alias("spans"))


def _cut(part, window: int, drop_share: float, carried: bool):
    hits = _scan(part, window)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(part.value, window)
        for whole in batches:
            at = whole.schema.get_field_index("text")
            for a, b in shared.pieces(shared.text_buffer(whole.column(at))[1], SHARD_BYTES):
                yield shard(whole.slice(a, b - a), at, phrases)

    def shard(batch: pa.RecordBatch, at: int, phrases: Phrases) -> pa.RecordBatch:
        text = batch.column(at)
        earlier = [batch.column(i) for i in range(batch.num_columns - 3, batch.num_columns)] if carried else []
        numbered = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), text, *earlier], names=["id", "text", "hit_start", "hit_end", "item_ids"][: 2 + len(earlier)])
        batch = batch.select(range(batch.num_columns - len(earlier)))
        keep, new = np.ones(batch.num_rows, bool), {}
        for found in hits([numbered], phrases):
            for row in found.filter(pa.compute.greater(found.column(2), 0)).to_pylist():
                raw, i, to = text[row["id"]].as_py().encode(), row["id"], 0
                rest = []
                for start, end in zip(row["span_start"], row["span_end"], strict=True):
                    rest.append(raw[to:start])
                    to = end
                keep[i] = row["n_hit"] < drop_share * row["n_words"]
                new[i] = b"".join([*rest, raw[to:]]).decode()
        if not new:
            return batch
        texts = text.to_pylist()
        for i, value in new.items():
            texts[i] = value
        columns = batch.columns
        columns[at] = pa.array(texts, text.type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep))

    return cut


def without_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, drop_share: float = 0.5) -> DataFrame:
    """The documents with the spans cut out of their texts, all columns kept.

    A document goes if at least ``drop_share`` of its words are in spans; texts without spans stay as they are.
    """
    named = docs.toDF(*["text" if c == text_col else f"c{i}" for i, c in enumerate(docs.columns)])
    packed = named.select(F.struct(*[c for c in named.columns if c != "text"]).alias("id") if len(named.columns) > 1 else F.lit(0).alias("id"), "text")
    rows, part = _passes(packed, benchmark, item_col, item_text_col, window)
    carried = len(rows.columns) > 2
    out = rows.select(*["text" if c == "text" else F.col(f"id.{c}").alias(c) for c in named.columns], *(["hit_start", "hit_end", "item_ids"] if carried else []))
    return out.mapInArrow(shared.returning(_cut(part, window, drop_share, carried)), named.schema).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS phrase
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)),
found AS (SELECT doc_id, i, p.n, item_id FROM places p JOIN windows USING (n, phrase)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
