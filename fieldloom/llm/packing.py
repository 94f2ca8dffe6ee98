"""Documents packed into sequences of a fixed number of tokens, by best fit and a local search.

Each document's ids end with id 0; longer ones than a sequence are cut into pieces, whose last may be shorter. A piece of full length is a
sequence of its own. The other pieces are dealt by a hash into groups of about ``GROUP``, and each group is packed by itself: best fit of the
longest first, then a search that empties the least full bins. A step gives one document of such a bin away, or exchanges one of its documents, or two,
for a smaller one of a fuller bin; only steps that increase the sum of squared fills are taken, the one of the largest gain first,
until no step is left or the bins can't become fewer. Underfull bins of all groups then meet in fewer groups, level by
level, where the search goes on from the bins as they are; it ends with one group, or where the underfull pieces don't
become fewer by a quarter. So no task holds more than about ``GROUP`` pieces, and full bins move once.

Defined results: a null or empty text is one piece with the end id alone. Repeated rows, and rows without id, are packed each. The same files give the same
sequences; other files of the same rows may give others of about the same number. Only id and text are read; an empty table gives an empty result. The tokenizer's path is a
parameter, and executors read it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared, token_files

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
LENGTH = 2048
#: Pieces of a group, about.
GROUP = 4096


def _cut(tokenizer: str, length: int):
    encode = token_files._encode(tokenizer)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in encode(batches):
            data, bounds = shared.text_buffer(batch.column(2))
            n = np.diff(bounds) // 2
            count = -(-n // length)
            doc = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * length
            size = np.minimum(length, n[doc] - start)
            ends = np.concatenate([[0], np.cumsum(4 * size)]).astype(np.int64)
            ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(ends), pa.py_buffer(data.view("<u2").astype("<u4"))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(number + np.arange(len(doc))), pa.array(piece, pa.int32()), pa.array(start), pa.array(size), ids], names=["id", "number", "piece", "start", "length", "ids"])
            number += len(doc)

    return cut


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, length: int = LENGTH) -> DataFrame:
    """One row a piece: id, number (unique), piece, start, length, ids (little-endian 32-bit)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_cut(tokenizer, length), f"id {docs.schema[id_col].dataType.simpleString()}, number long, piece int, start long, length long, ids binary")


def best_fit(lengths: np.ndarray, limit: int) -> np.ndarray:
    """The bin of each piece: the longest first, each into the fullest bin that has room."""
    bins, n_bins = np.zeros(len(lengths), np.int64), 0
    by_room: list[list[int]] = [[] for _ in range(limit + 1)]
    rooms = 0  # bit r: some bin has room r
    for i, n in zip(order := np.argsort(-lengths, kind="stable").tolist(), lengths[order].tolist(), strict=True):
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            at, room, n_bins = n_bins, limit, n_bins + 1
        bins[i] = at
        by_room[room - n].append(at)
        if room > n:
            rooms |= 1 << (room - n)
    return bins


def _step(lengths: np.ndarray, bins: np.ndarray, fill: np.ndarray, movable: np.ndarray, donor: int, limit: int) -> tuple[int, list[int], int, int] | None:
    """The step of the donor that increases the squared fill most: gain, its pieces, the receiver and the piece that comes back (or -1)."""
    own = np.flatnonzero(bins == donor)
    ones = np.sort(lengths[own])
    by_length = own[np.argsort(lengths[own], kind="stable")]
    i, j = np.triu_indices(len(own), 1)
    # every sum of two stands for its first pair
    sums, first = np.unique(ones[i] + ones[j], return_index=True)
    best = None
    other = movable[bins[movable] != donor]
    receivers = np.unique(bins[other])
    for kind, amounts, back, at in (("one", ones, np.zeros(len(receivers), np.int64), receivers), ("one", ones, lengths[other], bins[other]), ("two", sums, lengths[other], bins[other])):
        if not len(amounts) or not len(at):
            continue
        most = np.searchsorted(amounts, back + limit - fill[at], "right") - 1
        more = np.where(most >= 0, amounts[most] - back, 0)
        gain = np.where(more > 0, 2 * more * (fill[at] - fill[donor] + more), 0)
        k = int(gain.argmax())
        if gain[k] > 0 and (best is None or gain[k] > best[0]):
            m = int(most[k])
            mine = [int(by_length[m])] if kind == "one" else [int(by_length[i[first[m]]]), int(by_length[j[first[m]]])]
            best = (int(gain[k]), mine, int(at[k]), -1 if at is receivers else int(other[k]))
    return best


def improved(lengths: np.ndarray, bins: np.ndarray, limit: int) -> np.ndarray:
    """Bins after the local search, numbered anew."""
    bins = np.unique(bins, return_inverse=True)[1]
    fill = np.bincount(bins, lengths).astype(np.int64)
    going = True
    while going and limit * int((fill > 0).sum()) - int(fill.sum()) >= limit:
        going = False
        for donor in np.argsort(fill, kind="stable").tolist():
            if not 0 < fill[donor] < limit:
                continue
            movable = np.flatnonzero(fill[bins] < limit)
            while fill[donor] and (step := _step(lengths, bins, fill, movable, donor, limit)):
                _, mine, receiver, back = step
                bins[mine] = receiver
                moved = int(lengths[mine].sum())
                if back >= 0:
                    bins[back] = donor
                    moved -= int(lengths[back])
                fill[receiver] += moved
                fill[donor] -= moved
                movable = movable[fill[bins[movable]] < limit]
                going = True
            if limit * int((fill > 0).sum()) - int(fill.sum()) < limit:
                break
    return np.unique(bins, return_inverse=True)[1]


def _packed(level: int, limit: int):
    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by("number")
        lengths = table["length"].to_numpy()
        held = table["sequence_id"]
        bins = best_fit(lengths, limit) if held.null_count else held.to_numpy()
        bins = improved(lengths, bins, limit)
        order = np.argsort(bins, kind="stable")
        through = np.cumsum(lengths[order]) - lengths[order]
        fill = np.bincount(bins, lengths).astype(np.int64)
        offset = through - (np.cumsum(fill) - fill)[bins[order]]
        table = table.take(pa.array(order))
        number = (level << 58) + (table["part"][0].as_py() << 20) + bins[order]
        columns = [table[c] for c in ("id", "number", "piece", "start", "length", "ids")]
        return pa.Table.from_arrays([*columns, pa.array(number), pa.array(offset), pa.array(fill[bins[order]] < limit)], names=["id", "number", "piece", "start", "length", "ids", "sequence_id", "offset", "open"])

    return packed


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """One row a piece: id_col, piece, start, length, ids (little-endian 32-bit), sequence_id, offset."""
    kind = docs.schema[id_col].dataType.simpleString()
    cut = shared.written(pieces(docs, id_col, text_col, tokenizer, length), "pieces", compression="zstd")
    layout = f"id {kind}, number long, piece int, start long, length long, ids binary, sequence_id long, offset long, open boolean"
    whole = cut.where(F.col("length") == length)
    done = [whole.select("*", (-1 - F.col("number")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    rows, dealt = cut.where(F.col("length") < length).withColumn("sequence_id", F.lit(None).cast("long")), F.col("number")
    groups, level = max(1, -(-rows.count() // group)), 0
    while True:
        parts = rows.withColumn("part", F.pmod(F.xxhash64(dealt), F.lit(groups)))
        found = shared.written(parts.groupBy("part").applyInArrow(_packed(level, length), layout), "packed", compression="zstd")
        fewer = -(-found.where("open").count() // group)
        if groups == 1 or 4 * fewer > 3 * groups:
            done.append(found.drop("open"))
            break
        done.append(found.where("NOT open").drop("open"))
        rows, dealt, groups, level = found.where("open").drop("offset", "open"), F.col("sequence_id"), max(1, fewer), level + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.drop("number").withColumnRenamed("id", id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """One row a sequence of :func:`pack`: sequence_id, n_tokens, ids (little-endian 32-bit) of its pieces in turn."""
    turn = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])
    joined = F.aggregate(turn, F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
