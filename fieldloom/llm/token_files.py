"""Token ids in Huffman-coded files, and their reader.

Texts are encoded with a public byte-level BPE tokenizer; each document's ids end with id 0.
Global counts of all ids give one canonical code whose lengths are limited to ``LIMIT`` bits (by
package-merge), so a decoder needs the lengths alone and decodes by one table look-up per id.

A file is a Parquet file of blocks in ascending document order; a block is decoded by itself. Its row
holds: ``part`` and ``block``, the number of ids before it in its part, the documents' ids and sizes, the bits as bytes (most significant
first, in 32-bit big-endian words), and the bit offset of every ``EVERY``-th id as little-endian 32-bit
checkpoints, from which the ids between checkpoints are decoded side by side. ``code`` holds the
lengths of all codes by id.

Defined results: a null or empty text has the end id alone; documents without id come first, those of equal id in the order
of their token ids' bytes. A vocabulary of more than 65,536 ids is an error. Repeated rows are written each. Only id and text are read; an empty
table gives no blocks. The tokenizer's path is a parameter, and executors read it.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared
from .words import hash_spans

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END = 0
LIMIT = 18
EVERY = 256
#: Ids of a block at which it closes after the document at hand.
BLOCK_IDS = 1 << 18
#: Coded bytes of a file, about; the number of files grows with the input.
FILE_BYTES = 32 << 20
PIECE_BYTES = 2 << 20
#: Distinct chunks of text whose ids a worker holds.
HELD = 3_000_000
#: White space beyond ASCII, where texts can't be cut by bytes.
_WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Bytes by kind: 1 white space, 2 marks that a chunk may begin with, 3 ASCII letters and digits.
_KIND = np.zeros(256, np.uint8)
_KIND[[32, *range(9, 14)]] = 1
_KIND[[*b'.,;:!?"()-']] = 2
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 3


def _wide_spaced(data: np.ndarray, bounds: np.ndarray, texts: pa.Array) -> np.ndarray:
    """Documents with white space beyond ASCII; by their first bytes few are looked at."""
    maybe = (data >= 0xE1) & (data <= 0xE3)
    maybe[:-1] |= (data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))
    docs = np.unique(np.searchsorted(bounds, np.flatnonzero(maybe), "right") - 1)
    return np.array([i for i in docs.tolist() if _WIDE_SPACE.search(texts[i].as_py())], np.int64)


class ChunkEncoder:
    """Ids of texts by way of distinct chunks.

    A chunk is a run of ASCII white space and the run of other characters after it, or what stands from
    a punctuation mark after an ASCII letter or digit on. The tokenizer's own first cut never
    joins what stands on both sides of such a bound, so the ids of the chunks in turn are those of the
    text. Texts with other white space are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.mark_id, self.mark = next(((i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items()), (None, None))
        self._clear()

    def _clear(self) -> None:
        self.known, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.first, self.flat = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def _ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the chunks and the number of each's; chunks go to the tokenizer joined by its special token."""
        if self.mark is None or any(self.mark in c for c in chunks):
            found = [x.ids for x in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
            return np.fromiter((i for x in found for i in x), np.int32), np.array([len(x) for x in found], np.int64)
        ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join(chunks) + self.mark], add_special_tokens=False)[0].ids, np.int32)
        ends = np.flatnonzero(ids == self.mark_id)
        return ids[ids != self.mark_id], np.diff(ends, prepend=-1) - 1

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the documents, each with its end, and where each document's begin."""
        kind = _KIND[data]
        begins = np.zeros(len(data) + 1, bool)
        begins[1:-1] = ((kind[1:] == 1) & (kind[:-1] != 1)) | ((kind[1:] == 2) & (kind[:-1] == 3))
        begins[bounds] = True
        start = np.flatnonzero(begins[:-1])
        end = np.append(start[1:], len(data))
        distinct, where, inverse = np.unique(hash_spans(data, start, end), return_index=True, return_inverse=True)
        if len(self.known) > HELD:
            self._clear()
        at = np.searchsorted(self.known, distinct)
        hit = np.zeros(len(distinct), bool)
        inside = at < len(self.known)
        hit[inside] = self.known[at[inside]] == distinct[inside]
        number = np.empty(len(distinct), np.int32)
        number[hit] = self.number[at[hit]]
        new = np.flatnonzero(~hit)
        if len(new):
            raw = data.tobytes()
            chunks = [raw[i:j].decode() for i, j in zip(start[where[new]].tolist(), end[where[new]].tolist(), strict=True)]
            parts = [self._ids(chunks[i : i + 1000]) for i in range(0, len(chunks), 1000)]
            number[new] = len(self.first) - 1 + np.arange(len(new))
            self.flat = np.concatenate([self.flat, *(x for x, _ in parts)])
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.concatenate([n for _, n in parts]))])
            self.known, self.number = np.insert(self.known, at[new], distinct[new]), np.insert(self.number, at[new], number[new])
        number = number[inverse]
        size = np.diff(self.first)[number]
        total = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        ids = self.flat[np.repeat(self.first[:-1][number] - total[:-1], size) + np.arange(total[-1])]
        ends = total[np.searchsorted(start, bounds[1:])]
        return np.insert(ids, ends, END), np.append(0, ends + np.arange(1, len(ends) + 1))


@cache
def _encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def _encode(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            data, bounds = shared.text_buffer(batch.column(1))
            wide = _wide_spaced(data, bounds, batch.column(1))
            for a, b in shared.pieces(bounds, PIECE_BYTES):
                ids, first = encoder.encode(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
                each = [ids[i:j].astype("<u2") for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                for i in wide[(wide >= a) & (wide < b)].tolist():
                    each[i - a] = np.append(encoder.tokenizer.encode(batch.column(1)[i].as_py(), add_special_tokens=False).ids, END).astype("<u2")
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([len(x) for x in each], pa.int64()), pa.array([x.tobytes() for x in each], pa.binary())], names=["id", "n_tokens", "ids"])

    return encode


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """One row a document: id, n_tokens, ids (little-endian 16-bit)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_encode(tokenizer), f"id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids binary")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        data, _ = shared.text_buffer(batch.column(0))
        total += np.bincount(data.view("<u2"), minlength=len(total))
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], names=["token", "n"])


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits (package-merge); 0 for symbols without count."""
    out = np.zeros(len(counts), np.uint8)
    symbols = np.flatnonzero(counts)
    if len(symbols) < 2:
        out[symbols] = 1
        return out
    symbols = symbols[np.argsort(counts[symbols], kind="stable")]
    weight = counts[symbols].astype(np.float64)
    if len(symbols) > 1 << limit:
        raise ValueError("more symbols than codes of this length")
    leaf, row = [np.ones(len(weight), bool)], weight
    for _ in range(limit - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weight, pairs])
        order = np.argsort(both, kind="stable")
        row = both[order]
        leaf.append(order < len(weight))
    length, take = np.zeros(len(weight), np.int64), 2 * len(weight) - 2
    for mine in reversed(leaf):
        leaves = int(mine[:take].sum())
        length[:leaves] += 1
        take = 2 * (take - leaves)
    out[symbols] = length
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then symbol."""
    codes = np.zeros(len(lengths), np.uint32)
    symbols = np.flatnonzero(lengths)
    symbols = symbols[np.argsort(lengths[symbols], kind="stable")]
    n = lengths[symbols].astype(np.int64)
    if len(n):
        widest = int(n.max())
        step = np.int64(1) << (widest - n)
        codes[symbols] = (np.concatenate([[0], np.cumsum(step)[:-1]]) >> (widest - n)).astype(np.uint32)
    return codes


def decoding_table(lengths: np.ndarray) -> np.ndarray:
    """For each ``LIMIT``-bit window, the symbol times 32 plus its length."""
    symbols = np.flatnonzero(lengths)
    symbols = symbols[np.argsort(lengths[symbols], kind="stable")]
    n = lengths[symbols].astype(np.int64)
    table = np.repeat(symbols * 32 + n, np.int64(1) << (LIMIT - n)).astype(np.uint32)
    return np.concatenate([table, np.full((1 << LIMIT) - len(table), 1, np.uint32)])


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bits of the ids, and the bit offset of every ``EVERY``-th."""
    n = lengths[ids].astype(np.int64)
    end = np.cumsum(n)
    start = end - n
    word = start >> 5
    shifted = codes[ids].astype(np.uint64) << (64 - n - (start & 31)).astype(np.uint64)
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out = np.zeros(int(word[-1]) + 2, np.uint64)
    # each word of 32 bits has a code that begins in it, as codes are shorter
    out[:-1] = np.add.reduceat(shifted >> np.uint64(32), first)
    out[1:] += np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), first)
    return out.astype(">u4").tobytes(), start[::EVERY].astype("<u4")


def unpack(bits: bytes, checkpoints: np.ndarray, n: int, table: np.ndarray) -> np.ndarray:
    """The n ids, decoded from all checkpoints side by side."""
    words = np.concatenate([np.frombuffer(bits, ">u4").astype(np.uint64), np.zeros(2, np.uint64)])
    wide = (words[:-1] << np.uint64(32)) | words[1:]
    at = checkpoints.astype(np.int64)
    out = np.zeros((EVERY, len(at)), np.uint16)
    top = len(wide) - 1
    for k in range(min(EVERY, n)):
        window = (wide[np.minimum(at >> 5, top)] << (at & 31).astype(np.uint64)) >> np.uint64(64 - LIMIT)
        found = table[window.astype(np.int64)]
        out[k] = found >> 5
        at += found & 31
    return out.T.reshape(-1)[:n]


def _blocks(code_sent):
    """Blocks of the documents of one part, which come in order."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = np.frombuffer(code_sent.value, np.uint8)
        codes = canonical_codes(lengths)
        part = TaskContext.get().partitionId()
        held, size, block, before = [], 0, 0, 0

        def closed() -> pa.RecordBatch:
            ids = np.concatenate([np.frombuffer(x.as_buffer(), "<u2") for _, x in held])
            bits, checkpoints = pack(ids, codes, lengths)
            sizes = pa.array([len(x.as_buffer()) // 2 for _, x in held], pa.int64())
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            names = pa.array([k.as_py() for k, _ in held], held[0][0].type)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int64()), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()), one(names), one(sizes), pa.array([bits], pa.binary()), pa.array([checkpoints.tobytes()], pa.binary())], names=["part", "block", "before", "n_ids", "ids", "sizes", "bits", "checkpoints"])

        for batch in batches:
            for key, ids in zip(batch.column(0), batch.column(1), strict=True):
                if size >= BLOCK_IDS:
                    yield closed()
                    held, size, block, before = [], 0, block + 1, before + size
                held.append((key, ids))
                size += len(ids.as_buffer()) // 2
        if held:
            yield closed()

    return blocks


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, file_bytes: int = FILE_BYTES) -> None:
    """Write ``path``/blocks and ``path``/code."""
    spark = docs.sparkSession
    size = _encoder(tokenizer).tokenizer.get_vocab_size()
    if size > 1 << 16:
        raise ValueError(f"ids of a vocabulary of {size} don't fit into 16 bits")
    ids = shared.written(encoded(docs, id_col, text_col, tokenizer), "token-ids", compression="zstd")
    counts = np.zeros(1 << 16, np.int64)
    for token, n in ids.select("ids").mapInArrow(_count, "token int, n long").groupBy("token").agg(F.sum("n")).collect():
        counts[token] = n
    lengths = code_lengths(counts)
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/code")
    parts = max(1, int((counts * lengths).sum() // 8 // file_bytes))
    # rows of one id are dealt on by the beginning of their bytes, in whose order they stand
    by_id = F.col("id").asc_nulls_first()
    placed = ids.repartitionByRange(parts, by_id, F.substring("ids", 1, 16)).sortWithinPartitions(by_id, "ids")
    code = spark.sparkContext.broadcast(lengths.tobytes())
    kind = docs.schema[id_col].dataType.simpleString()
    layout = f"part int, block long, before long, n_ids long, ids array<{kind}>, sizes array<long>, bits binary, checkpoints binary"
    placed.select("id", "ids").mapInArrow(_blocks(code), layout).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    shared.drop_table(ids)


def _decode(code_sent, digest: bool):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoding_table(np.frombuffer(code_sent.value, np.uint8))
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                ids = unpack(row["bits"].as_py(), np.frombuffer(row["checkpoints"].as_py(), "<u4"), row["n_ids"].as_py(), table)
                sizes = row["sizes"].values.to_numpy()
                first = np.concatenate([[0], np.cumsum(sizes)])
                ranges = zip(first[:-1].tolist(), first[1:].tolist(), strict=True)
                if digest:
                    wide = ids.astype("<u4")
                    last = pa.array([zlib.crc32(wide[a:b]) for a, b in ranges], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([row["ids"].values, pa.array(first[:-1] + row["start"].as_py()), pa.array(sizes), last], names=["id", "start", "n_tokens", "last"])

    return decode


def read(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """One row a document: id, start, n_tokens, and ids (array<int>) or, with ``digest``, ids_crc32 of them as little-endian 32-bit.

    A block tells the ids before it in its part; what its part begins with is summed over the parts, one row for each file.
    """
    blocks = spark.read.parquet(f"{path}/blocks")
    code = spark.sparkContext.broadcast(bytes(spark.read.parquet(f"{path}/code").first().lengths))
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    offsets = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    last = "ids_crc32 long" if digest else "ids array<int>"
    start = (F.col("offset") + F.col("before")).alias("start")
    found = blocks.join(F.broadcast(offsets), "part").select("n_ids", "ids", "sizes", "bits", "checkpoints", start)
    return found.mapInArrow(_decode(code, digest), f"id {kind}, start long, n_tokens long, last {last.split()[1]}").withColumnRenamed("last", last.split()[0])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.new_table(spark, "token-files")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read(spark, path, digest=True).withColumnRenamed("id", "doc_id")
