"""Tokens of two tokenizers aligned by the bytes they stand for, with counts of linked ids over the corpus.

Tokenizer A is a byte-level BPE, B a SentencePiece BPE with byte fallback; both encode a space and the text, special tokens
being plain text. A batch's documents are concatenated, with their byte offsets. The ends of A's and of B's tokens are counted
at each byte once (``bincount``); groups are cut where both end, and each stretch between neighbouring ends of any kind
links one A token with one B token. Running sums of the ends number the tokens and groups, and their differences at the documents'
offsets give each document's results.

Counts of linked ids take two steps, as no task can hold all pairs. Each chunk of about ``CHUNK_BYTES`` is written with its distinct pairs, their number,
and its links as places in these pairs. Spark adds the pairs' numbers over all chunks, finds each B id's largest (a row for each id of
the vocabulary, sent to all tasks), and sends each chunk the counts of its own pairs.

Texts are encoded by distinct chunks of text, as neither tokenizer joins what stands on both sides of the cuts: for A
as in ``token_files``, for B before each run of spaces, since none of its pieces goes on past a word into a space.

Defined results: a text that is null or empty, or whose joined token bytes of A or B differ from space + text (it holds U+2581, which B
takes for a space), has no tokens: zeros and an empty digest. Repeated rows are counted and returned each; rows without id too. Only id and text are read; an empty
table gives an empty result. A very long document is a chunk of its own. The tokenizers' paths are parameters, and executors read them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .token_files import ChunkEncoder, _wide_spaced
from .words import hash_spans

TOKENIZER_A = public_tokenizers.path("byte_bpe_50k.json")
MODEL_B = public_tokenizers.path("piece_bpe_32k.model")
#: Bytes of text of a chunk, about: its links and pairs are one row.
CHUNK_BYTES = 1 << 20
#: Distinct stretches of text whose ids a worker holds.
HELD = 1_000_000
#: An id pair is one number: A's id times this, plus B's.
SIDE = 1 << 20
BLANK = "▁"


class ByteTable:
    """The bytes of each id."""

    def __init__(self, tokens: list[bytes]):
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.first = np.cumsum(self.size) - self.size

    def ends(self, ids: np.ndarray) -> np.ndarray:
        return np.cumsum(self.size[ids])

    def joined(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids in turn."""
        n = self.size[ids]
        start = np.cumsum(n) - n
        return self.flat[np.repeat(self.first[ids] - start, n) + np.arange(n.sum())].tobytes()


class PlainEncoder(ChunkEncoder):
    """Ids of A, special tokens' strings being plain text; documents have no end id."""

    def __init__(self, path: str):
        super().__init__(path)
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        self.table = ByteTable(_byte_level(self.plain))

    def _ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.mark is None or any("<|" in c for c in chunks):
            found = [x.ids for x in self.plain.encode_batch_fast(chunks, add_special_tokens=False)]
            return np.fromiter((i for x in found for i in x), np.int32), np.array([len(x) for x in found], np.int64)
        return super()._ids(chunks)

    def tokens(self, data: np.ndarray, bounds: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and where each document's begin; ``data`` has the space before each text."""
        ids, first = self.encode(data, bounds)
        ids, first = np.delete(ids, first[1:] - 1), first - np.arange(len(first))
        wide = _wide_spaced(data, bounds, texts)
        if not len(wide):
            return ids, first
        each = [ids[i:j] for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        for i in wide.tolist():
            each[i] = np.array(self.plain.encode(texts[i].as_py(), add_special_tokens=False).ids, np.int32)
        return np.concatenate(each), np.cumsum([0, *map(len, each)])


def _byte_level(tokenizer) -> list[bytes]:
    """The bytes of each id: byte-level vocabularies write printable bytes as themselves and the others as the characters from U+0100 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    out = []
    for i in range(tokenizer.get_vocab_size()):
        token = tokenizer.id_to_token(i)
        out.append(bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode())
    return out


class PieceEncoder:
    """Ids of B by way of distinct stretches: a run of spaces and what follows up to the next one."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        if any(BLANK in p.lstrip(BLANK) for p in pieces) or self.model.encode("a  b ", out_type=str) != self.model.encode("a", out_type=str) + [p for x in (" b", "") for p in self.model.encode(x, out_type=str) or [BLANK]]:
            raise ValueError("texts can't be cut before spaces for this model")
        self.blank = self.model.piece_to_id(BLANK)
        self.table = ByteTable([bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)])
        self._clear()

    def _clear(self) -> None:
        self.known, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.first, self.flat = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def tokens(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and where each document's begin; ``data`` has the space before each text."""
        begins = np.zeros(len(data) + 1, bool)
        begins[1:-1] = (data[1:] == 32) & (data[:-1] != 32)
        begins[bounds] = True
        start = np.flatnonzero(begins[:-1])
        end = np.append(start[1:], len(data))
        code, distinct = pd.factorize(hash_spans(data, start, end))
        if len(self.known) > HELD:
            self._clear()
        order = np.argsort(distinct)
        at = np.searchsorted(self.known, distinct[order])
        inside = at < len(self.known)
        hit = np.zeros(len(order), bool)
        hit[inside] = self.known[at[inside]] == distinct[order][inside]
        number = np.empty(len(distinct), np.int32)
        number[order[hit]] = self.number[at[hit]]
        new = order[~hit]
        if len(new):
            where = np.zeros(len(distinct), np.int64)
            where[code[::-1]] = np.arange(len(code))[::-1]
            raw = data.tobytes()
            # the model adds the first space itself, but not to nothing
            found = self.model.encode([raw[i + 1 : j].decode() for i, j in zip(start[where[new]].tolist(), end[where[new]].tolist(), strict=True)], num_threads=1)
            found = [x or [self.blank] for x in found]
            number[new] = len(self.first) - 1 + np.arange(len(new))
            self.known, self.number = np.insert(self.known, at[~hit], distinct[new]), np.insert(self.number, at[~hit], number[new])
            self.flat = np.concatenate([self.flat, np.fromiter((i for x in found for i in x), np.int32)])
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum([len(x) for x in found])])
        number = number[code]
        size = np.diff(self.first)[number]
        total = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        ids = self.flat[np.repeat(self.first[:-1][number] - total[:-1], size) + np.arange(total[-1])]
        return ids, total[np.searchsorted(start, bounds)] if len(start) else np.zeros(len(bounds), np.int64)


@cache
def _encoders(a: str, b: str) -> tuple[PlainEncoder, PieceEncoder]:
    return PlainEncoder(a), PieceEncoder(b)


def _same(raw: bytes, bounds: np.ndarray, joined: bytes, end: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Documents whose tokens' bytes are their own."""
    cut = np.concatenate([[0], end])[first]
    return np.array([raw[a:b] == joined[c:d] for a, b, c, d in zip(bounds[:-1].tolist(), bounds[1:].tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True)], bool)


def _kept(ids: np.ndarray, first: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(first)
    return ids[np.repeat(good, n)], np.concatenate([[0], np.cumsum(n[good])])


_DIGITS = np.array([list(f"{i:<7}".encode()) for i in range(100_000)], np.uint8)
_DIGITS_N = np.array([len(str(i)) for i in range(100_000)], np.int64)


def _written(ids: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decimal ids, each with the sign after it, and where each begins."""
    if len(ids) and int(ids.max()) >= len(_DIGITS):
        raise ValueError("ids of six digits and more aren't written")
    n = _DIGITS_N[ids]
    signs = _DIGITS[ids]
    signs[np.arange(len(ids)), n] = mark
    return signs[np.arange(signs.shape[1]) <= n[:, None]], np.concatenate([[0], np.cumsum(n + 1)])


class Aligned:
    """Alignment of documents whose token bytes are those of ``bounds``.

    ``n_a``, ``n_b``, ``n_groups`` and ``n_links`` by document; ``link_a`` and ``link_b`` the ids of every link, in order.
    """

    def __init__(self, bounds: np.ndarray, a: np.ndarray, end_a: np.ndarray, b: np.ndarray, end_b: np.ndarray):
        total = int(bounds[-1])
        ends_a, ends_b = np.bincount(end_a, minlength=total + 1), np.bincount(end_b, minlength=total + 1)
        both = (ends_a > 0) & (ends_b > 0)
        self.a, self.b, self.end_a, self.end_b = a, b, end_a, end_b
        any_end = np.flatnonzero(ends_a + ends_b)
        through_a, through_b, through = np.cumsum(ends_a), np.cumsum(ends_b), np.cumsum(both)
        self.first_a, self.first_b, self.first_group = through_a[bounds], through_b[bounds], through[bounds]
        self.first_link = np.searchsorted(any_end, bounds, "right")
        self.n_a, self.n_b, self.n_groups, self.n_links = (np.diff(x) for x in (self.first_a, self.first_b, self.first_group, self.first_link))
        # the token that a stretch is of: as many tokens end before the stretch's own end
        self.link_a = a[through_a[any_end] - ends_a[any_end]]
        self.link_b = b[through_b[any_end] - ends_b[any_end]]
        self._cut, self._through = both, through

    def group_digests(self) -> list[str]:
        """SHA-256 of each document's groups, ``a1,a2|b1;a3|b2,b3``."""
        comma, bar, semicolon = b",|;"
        cut_a, cut_b = self._cut[self.end_a], self._cut[self.end_b]
        # a group's A ids come before its B ids: two places for each group
        place_a, place_b = 2 * (self._through[self.end_a] - cut_a), 2 * (self._through[self.end_b] - cut_b) + 1
        order = np.argsort(np.concatenate([place_a, place_b]), kind="stable")
        ids = np.concatenate([self.a, self.b])[order]
        mark = np.concatenate([np.where(cut_a, bar, comma), np.where(cut_b, semicolon, comma)]).astype(np.uint8)[order]
        signs, first = _written(ids, mark)
        raw = signs.tobytes()
        at = first[self.first_a + self.first_b].tolist()
        return [hashlib.sha256(raw[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(at[:-1], at[1:], strict=True)]


def _planes(x: np.ndarray) -> bytes:
    """Bytes of 32-bit numbers, all lowest first: they compress well."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def align(texts: pa.Array, a: str = TOKENIZER_A, b: str = MODEL_B) -> tuple[np.ndarray, Aligned]:
    """Which texts have tokens, and their alignment."""
    encode_a, encode_b = _encoders(a, b)
    data, bounds = shared.text_buffer(texts)
    full = np.diff(bounds) > 0
    texts = texts.filter(pa.array(full))
    data, bounds = np.insert(data, bounds[:-1][full], 32), np.concatenate([[0], np.cumsum(np.diff(bounds)[full] + 1)])
    spaced = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)]).cast(pa.large_string())
    raw, good = data.tobytes(), np.ones(len(texts), bool)
    found = []
    for encoder, (ids, first) in ((encode_a, encode_a.tokens(data, bounds, spaced)), (encode_b, encode_b.tokens(data, bounds))):
        good &= _same(raw, bounds, encoder.table.joined(ids), encoder.table.ends(ids), first)
        found.append((ids, first))
    n = np.diff(bounds)[good]
    (ids_a, first_a), (ids_b, first_b) = ((x if good.all() else _kept(*x, good)) for x in found)
    full[full] = good
    return full, Aligned(np.concatenate([[0], np.cumsum(n)]), ids_a, encode_a.table.ends(ids_a), ids_b, encode_b.table.ends(ids_b))


def _chunks(a: str, b: str):
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            _, bounds = shared.text_buffer(batch.column(1))
            for i, j in shared.pieces(bounds, CHUNK_BYTES):
                full, found = align(batch.column(1)[i:j], a, b)
                code, pairs = pd.factorize(found.link_a.astype(np.int64) * SIDE + found.link_b)
                order = np.argsort(pairs)
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                links = rank[code]
                columns = {}
                for name in ("n_a", "n_b", "n_groups", "n_links"):
                    columns[name] = np.zeros(j - i, np.int64)
                    columns[name][full] = getattr(found, name)
                digests = np.full(j - i, "", object)
                digests[full] = found.group_digests()
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                lists = [batch.column(0)[i:j], *map(pa.array, columns.values()), pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(task << 32) + made]), *[one(x) for x in lists], one(pa.array(pairs[order], pa.int64())), one(pa.array(np.bincount(links, minlength=len(pairs)), pa.int64())), pa.array([_planes(links)], pa.binary())],
                    names=["chunk", "ids", *columns, "groups_sha256", "pairs", "counts", "links"],
                )
                made += 1

    return chunks


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            held = {c: batch.column(c)[row] for c in batch.schema.names}
            links = _from_planes(held["links"].as_py())
            n_links = held["n_links"].values.to_numpy()
            first = np.concatenate([[0], np.cumsum(n_links)])
            told = held["told"].values
            sums = []
            for c in ("best", "total"):
                through = np.concatenate([[0], np.cumsum(told.field(c).to_numpy()[links] if len(links) else np.zeros(0, np.int64))])
                sums.append(pa.array(np.diff(through[first]).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([held["ids"].values, *[held[c].values for c in ("n_a", "n_b", "n_groups", "n_links")], *sums, held["groups_sha256"].values], names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str = TOKENIZER_A, b: str = MODEL_B) -> DataFrame:
    """One row a chunk of documents: their alignments, distinct pairs with counts, and links as places in the pairs. Written in the shared folder."""
    kind = docs.schema[id_col].dataType.simpleString()
    layout = f"chunk long, ids array<{kind}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, pairs array<long>, counts array<long>, links binary"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_chunks(a, b), layout)
    return shared.written(rows, "alignments", **{"compression": "zstd", "parquet.block.size": str(32 << 20)})


def pair_counts(chunks: DataFrame) -> DataFrame:
    """pair, total, best: how many links hold each id pair, and whether it is (1) or isn't (0) the most frequent of its B id; ties are all. Written in the shared folder."""
    each = chunks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select("p.pairs", "p.counts")
    totals = shared.written(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("counts").alias("total")), "pair-counts", compression="zstd")
    side = (F.col("pair") % SIDE).alias("b")
    most = totals.groupBy(side).agg(F.max("total").alias("most"))  # a row for each id of a vocabulary
    return totals.withColumn("b", F.col("pair") % SIDE).join(F.broadcast(most), "b").select("pair", "total", (F.col("total") == F.col("most")).cast("long").alias("best"))


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str = TOKENIZER_A, b: str = MODEL_B) -> DataFrame:
    """One row a document: id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    kind = docs.schema[id_col].dataType.simpleString()
    chunks = chunked(docs, id_col, text_col, a, b)
    each = chunks.select("chunk", F.explode("pairs").alias("pair")).join(pair_counts(chunks), "pair")
    told = each.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("pair", "total", "best"))).alias("told"))
    known = chunks.drop("pairs", "counts").join(told, "chunk", "left").withColumn("told", F.coalesce("told", F.array().cast(told.schema["told"].dataType)))
    layout = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return known.mapInArrow(_scores, layout).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
