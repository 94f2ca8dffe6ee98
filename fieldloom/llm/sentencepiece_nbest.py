"""SentencePiece encoding and decoding with N-best segmentation over the piece lattice.

A text gets a leading space; blanks stand as U+2581 in pieces. As no piece of the model goes on
past a word into a blank, the lattice of a text has a cut before each run of blanks, and the best
segmentation is that of its chunks in turn. New chunks of one length are segmented side by side: a forward
Viterbi pass gives the best score up to every position, a backward one the best from there on, and both
together the cost of the best segmentation through each piece, hence a chunk's second choice. Chunks of more
than ``LONG`` bytes (texts without blanks) are first cut wherever no piece spans a position, which all
segmentations share.

A text's N best combine those of its chunks: only the N - 1 chunks whose second choice costs least can differ
(of equal ones, those whose second choice comes first by ids). For these a backward A* search from the end
takes the forward scores as exact heuristics, so segmentations come out in order of their score; they are held
with the chunk. The same search runs over the chunks' choices for the text's own N best.

A character that no piece covers is written as its UTF-8 bytes. So is U+2581 itself, hence
decoding gives back any text exactly.

Defined results: a null text has no ids and decodes to the empty text, as the empty text does;
equal scores are ordered by the ids. Repeated rows are encoded each. Only id and text are read. An
empty table gives an empty result. The model's path is a parameter, and executors read it.
"""

from __future__ import annotations

import bisect
import heapq
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .words import hash_spans

MODEL = public_tokenizers.path("piece_bpe_32k.model")
N_BEST = 4
#: Chunks whose segmentations a task holds at once.
HELD = 1_000_000
#: Bytes from which a chunk is cut at the positions that no piece spans, and searched by itself.
LONG = 64
#: Bytes of text taken at once; cells of the lattices that are filled side by side.
PIECE_BYTES = 1 << 20
CELLS = 1 << 20
#: Documents of a result batch.
BATCH = 256
BLANK = "▁"
_NONE = -1e300
#: Bytes of the character that each byte begins; 0 for those inside one.
_WIDTH = np.repeat(np.array([1, 0, 2, 3, 4], np.int64), [128, 64, 32, 16, 16])
_MARK = np.random.Generator(np.random.PCG64(5)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The model's pieces with their scores."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.byte, self.score, self.raw = {}, {}, [b""] * n
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[1:-1], 16)] = i
                self.raw[i] = bytes([int(piece[1:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.score[piece] = (model.get_score(i), (i,))
                self.raw[i] = piece.replace(BLANK, " ").encode()
        if any(BLANK in piece.lstrip(BLANK) for piece in self.score):
            raise ValueError("a piece goes on past a word into a blank, so texts can't be cut there")
        #: Each prefix of a piece, with False where it is no piece itself.
        self.prefix = {piece[:k]: False for piece in self.score for k in range(1, len(piece))} | self.score
        self.fallback = min(s for s, _ in self.score.values() if s > -1e8) - 10.0
        spelled = [p.replace(BLANK, " ").encode() for p in self.score]
        self.longest = max(map(len, spelled))
        keys = np.array([_key(p) for p in spelled], np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.key_score = np.array([v[0] for v in self.score.values()])[order]
        self.key_id = np.array([v[1][0] for v in self.score.values()], np.int32)[order]
        #: Whether any key has these leading bits.
        self.some = np.zeros(1 << 20, bool)
        self.some[(keys >> np.uint64(44)).astype(np.int64)] = True
        self.byte_id = np.array([self.byte.get(b, 0) for b in range(256)], np.int32)
        self.raw_first = np.cumsum([0, *map(len, self.raw)])
        self.raw_data = np.frombuffer(b"".join(self.raw), np.uint8)

    def lattice(self, chunk: str) -> tuple[list[list[tuple[int, float, tuple[int, ...]]]], list[float]]:
        """Edges into each position as (from, score, ids), and the best score up to each."""
        n, prefix = len(chunk), self.prefix.get
        into: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(n + 1)]
        best = [0.0] + [-1e300] * n
        text = chunk.replace(BLANK, "\0").replace(" ", BLANK)
        for i in range(n):
            here = best[i]
            for j in range(i + 1, n + 1):
                got = prefix(text[i:j])
                if got is None:
                    break
                if got:
                    score = got[0]
                    into[j].append((i, score, got[1]))
                    if here + score > best[j]:
                        best[j] = here + score
            if not into[i + 1] or into[i + 1][-1][0] != i:
                ids = tuple(self.byte[b] for b in chunk[i].encode())
                score = self.fallback * len(ids)
                into[i + 1].append((i, score, ids))
                best[i + 1] = max(best[i + 1], here + score)
        return into, best

    def parts(self, chunk: str) -> list[str]:
        """The chunk cut at all positions that no piece spans."""
        n, prefix = len(chunk), self.prefix.get
        text = chunk.replace(BLANK, "\0").replace(" ", BLANK)
        out, first, reach = [], 0, 1
        for i in range(n):
            if i >= reach:
                out.append(chunk[first:i])
                first = i
            for j in range(i + 1, n + 1):
                got = prefix(text[i:j])
                if got is None:
                    break
                if got and j > reach:
                    reach = j
        return [*out, chunk[first:]]


def best_paths(into: list[list[tuple]], best: list[float], n: int) -> list[tuple[float, tuple]]:
    """Up to n paths as (score, labels), best first: backward A* whose heuristics are the forward scores.

    Each entry points back to the one it extends. Of equal costs, later positions come first, so all that can reach
    a position is there before it is expanded, in order of labels; its first n expansions are those of its n best ends.
    Heuristics are exact: entries of the heap stand for different paths of just their costs, so none beyond the n-th cost is needed.
    """
    out, end = [], len(best) - 1
    done = [0] * (end + 1)
    heap = [(-best[end], -end, (), 0, 0.0, None)]
    # kept for long lattices only: in short ones it costs more than it saves
    costs, bound = [-best[end]] if end > LONG else None, math.inf
    while heap and len(out) < n:
        cost, at, own, _, behind, ahead = heapq.heappop(heap)
        rank = done[-at]
        if rank == n:
            continue
        done[-at] = rank + 1
        node = (own, ahead)
        if at == 0:
            labels = []
            while node:
                labels += node[0]
                node = node[1]
            out.append((behind, tuple(labels)))
            continue
        if costs and cost in costs:
            costs.remove(cost)
        for start, score, label in into[-at]:
            g = behind + score
            f = -(best[start] + g)
            if f <= bound and done[start] < n:
                heapq.heappush(heap, (f, -start, label, rank, g, node))
                if costs is not None:
                    bisect.insort(costs, f)
                    if len(costs) >= n:
                        del costs[n:]
                        bound = min(bound, costs[-1] + 1e-9 * (1 + abs(costs[-1])))
    return out


def _key(piece: bytes) -> int:
    key = 0
    for byte in piece:
        key = (key * int(_STEP) + int(_MARK[byte])) % 2**64
    return key


def segment(pieces: Pieces, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of one length as rows of bytes: ids at the bytes where they begin (-1 elsewhere), best scores, and costs of the second choices.

    Of equal scores the smallest ids are taken, from the first on.
    """
    rows, n = chunks.shape
    wide = min(n, pieces.longest)
    score = np.full((rows, n, max(wide, 4)), _NONE)
    label = np.full(score.shape, 2**30, np.int32)
    marks, key = _MARK[chunks], np.zeros((rows, n), np.uint64)
    for w in range(wide):
        key = key[:, : n - w] * _STEP + marks[:, w:]
        row, at = np.nonzero(pieces.some[(key >> np.uint64(44)).astype(np.int64)])
        here = key[row, at]
        found = np.minimum(np.searchsorted(pieces.keys, here), len(pieces.keys) - 1)
        same = pieces.keys[found] == here
        row, at, found = row[same], at[same], found[same]
        score[row, at, w], label[row, at, w] = pieces.key_score[found], pieces.key_id[found]
    width = _WIDTH[chunks]
    row, at = np.nonzero(width)
    w = width[row, at] - 1
    bare = label[row, at, w] == 2**30
    row, at, w = row[bare], at[bare], w[bare]
    score[row, at, w], label[row, at, w] = pieces.fallback * (w + 1), pieces.byte_id[chunks[row, at]]
    wide = score.shape[2]
    ahead, behind = np.full((rows, n + wide), _NONE), np.full((rows, n + wide), _NONE)
    ahead[:, 0], behind[:, n] = 0.0, 0.0
    for i in range(n):
        into = ahead[:, i + 1 : i + 1 + wide]
        np.maximum(into, ahead[:, i, None] + score[:, i, : into.shape[1]], out=into)
    for i in reversed(range(n)):
        out = behind[:, i + 1 : i + 1 + wide]
        behind[:, i] = (score[:, i, : out.shape[1]] + out).max(1)
    ids, place, second = np.full((rows, n), -1, np.int32), np.zeros(rows, np.int64), np.full(rows, -np.inf)
    for i in range(n):
        out = behind[:, i + 1 : i + 1 + wide]
        total = score[:, i, : out.shape[1]] + out
        here = np.flatnonzero(place == i)
        w = np.where(total[here] == behind[here, i, None], label[here, i, : out.shape[1]], 2**31 - 1).argmin(1)
        ids[here, i] = label[here, i, w]
        place[here] = i + 1 + w
        total[here, w] = _NONE
        np.maximum(second, ahead[:, i] + total.max(1), out=second)
    # a character without piece: the ids of all its bytes
    row, at = row[ids[row, at] == label[row, at, width[row, at] - 1]], at[ids[row, at] == label[row, at, width[row, at] - 1]]
    for d in range(1, 4):
        more = width[row, at] > d
        ids[row[more], at[more] + d] = pieces.byte_id[chunks[row[more], at[more] + d]]
    best = behind[:, 0]
    return ids, best, np.where(second > -1e200, np.maximum(best - second, 0.0), np.inf)


class Encoder:
    """Segmentations of chunks, held while there are at most ``HELD`` of them."""

    def __init__(self, pieces: Pieces, n_best: int):
        self.pieces, self.n_best = pieces, n_best
        self._clear()

    def _clear(self) -> None:
        self.known, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.first, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)
        self.score, self.gap = np.zeros(0), np.zeros(0)
        self.paths: dict[int, list[tuple[float, tuple[int, ...]]]] = {}

    def _cut(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of all chunks; each document that is not empty begins with a blank."""
        blank = data == 32
        begins = blank.copy()
        begins[1:] &= ~blank[:-1]
        begins[bounds[:-1][bounds[1:] > bounds[:-1]]] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(data))
        for i in np.flatnonzero(end - start > LONG).tolist():
            at = int(start[i])
            for part in self.pieces.parts(data[start[i] : end[i]].tobytes().decode()):
                begins[at] = True
                at += len(part.encode())
        start = np.flatnonzero(begins)
        return start, np.append(start[1:], len(data))

    def _numbers(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chunks of the documents as numbers of held ones, and where each document's begin."""
        start, end = self._cut(data, bounds)
        distinct, where, inverse = np.unique(hash_spans(data, start, end), return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        hit = np.zeros(len(distinct), bool)
        inside = at < len(self.known)
        hit[inside] = self.known[at[inside]] == distinct[inside]
        number = np.empty(len(distinct), np.int32)
        number[hit] = self.number[at[hit]]
        new = np.flatnonzero(~hit)
        if len(new):
            number[new] = self._add(data, start[where[new]], end[where[new]])
            self.known, self.number = np.insert(self.known, at[new], distinct[new]), np.insert(self.number, at[new], number[new])
        return number[inverse], np.searchsorted(start, bounds)

    def _add(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Segment new chunks and hold them; their numbers."""
        size = end - start
        order = np.argsort(size, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(size[order])) + 1)
        ids, counts, scores, gaps = [], [], [], []
        for group in groups:
            n = int(size[group[0]])
            if n > LONG:
                for i in group.tolist():
                    found = best_paths(*self.pieces.lattice(data[start[i] : end[i]].tobytes().decode()), min(self.n_best, 2))
                    ids.append(np.array(found[0][1], np.int32))
                    counts.append([len(found[0][1])])
                    scores.append([found[0][0]])
                    gaps.append([found[0][0] - found[1][0] if len(found) > 1 else np.inf])
                continue
            most = max(1, CELLS // (n * max(4, min(n, self.pieces.longest))))
            for a in range(0, len(group), most):
                own, best, gap = segment(self.pieces, data[start[group[a : a + most], None] + np.arange(n)])
                held = own >= 0
                ids.append(own[held])
                counts.append(held.sum(1))
                scores.append(best)
                gaps.append(gap)
        number = np.empty(len(start), np.int32)
        number[order] = len(self.score) + np.arange(len(start), dtype=np.int32)
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.concatenate(counts))])
        self.ids = np.concatenate([self.ids, *ids])
        self.score, self.gap = np.concatenate([self.score, *scores]), np.concatenate([self.gap, *gaps])
        return number

    def _paths(self, number: int, spelled) -> list[tuple[float, tuple[int, ...]]]:
        """The N best of a chunk, held once found; ``spelled`` gives its text."""
        found = self.paths.get(number)
        if found is None:
            found = self.paths[number] = best_paths(*self.pieces.lattice(spelled()), self.n_best)
        return found

    def _text(self, number: int) -> str:
        return b"".join(self.pieces.raw[i] for i in self.ids[self.first[number] : self.first[number + 1]].tolist()).decode()

    def encode_batch(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
        """Flat ids of the documents, where each one's begin, scores, and for the N best from the second on: score and replaced runs (start, length, ids)."""
        if len(self.known) > HELD:
            self._clear()
        full = bounds[1:] > bounds[:-1]
        data = np.insert(data, bounds[:-1][full], 32)
        bounds = bounds + np.concatenate([[0], np.cumsum(full)])
        if len(bounds) == 2 and len(data) > 4 * PIECE_BYTES:
            # one long text: in runs that end before blanks
            cuts = np.flatnonzero((data[1:] == 32) & (data[:-1] != 32)) + 1
            cuts = np.unique(cuts[np.searchsorted(cuts, np.arange(PIECE_BYTES, len(data), PIECE_BYTES)).clip(max=len(cuts) - 1)]) if len(cuts) else cuts
            edges = [0, *cuts.tolist(), len(data)]
            number = np.concatenate([self._numbers(data[a:b], np.array([0, b - a]))[0] for a, b in zip(edges[:-1], edges[1:], strict=True)])
            first = np.array([0, len(number)])
        else:
            number, first = self._numbers(data, bounds)
        size = np.diff(self.first)[number]
        total = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        flat = self.ids[np.repeat(self.first[:-1][number] - total[:-1], size) + np.arange(total[-1])]
        run = np.concatenate([[0.0], np.cumsum(self.score[number])])
        score = run[first[1:]] - run[first[:-1]]
        gap, others = self.gap[number], []
        for a, b, s in zip(first[:-1].tolist(), first[1:].tolist(), score.tolist(), strict=True):
            others.append(self._others(number[a:b], gap[a:b], total[a : b + 1] - total[a], s) if self.n_best > 1 and b > a else [])
        return flat, total[first], score, others

    def encode(self, text: str) -> tuple[list[int], float, list[tuple[float, list[tuple[int, int, list[int]]]]]]:
        """Ids, score and the next best of one text."""
        raw = np.frombuffer((text or "").encode(), np.uint8)
        flat, _, score, others = self.encode_batch(raw, np.array([0, len(raw)]))
        return flat.tolist(), float(score[0]), others[0]

    def _nearest(self, number: np.ndarray, gap: np.ndarray) -> list[int]:
        """The N - 1 chunks whose second choice makes the next best texts: by cost, then by the ids of the text that results."""
        n = self.n_best - 1
        if len(gap) <= n:
            return np.flatnonzero(gap < np.inf).tolist()
        cut = np.partition(gap, n - 1)[n - 1]
        sure, tied = np.flatnonzero(gap < cut), np.flatnonzero(gap == cut)
        if cut == np.inf:
            return sure.tolist()
        more = n - len(sure)
        if len(tied) > more:
            kinds = np.unique(number[tied])
            found = [self._paths(k, lambda k=k: self._text(k)) for k in kinds.tolist()]
            lower = np.array([p[1][1] < p[0][1] for p in found])[np.searchsorted(kinds, number[tied])]
            tied = np.concatenate([tied[lower], tied[~lower][::-1]])[:more]
        return sorted([*sure.tolist(), *tied.tolist()])

    def _others(self, number: np.ndarray, gap: np.ndarray, starts: np.ndarray, score: float) -> list:
        into, best = [[]], [0.0]
        chosen = {}
        for k, i in enumerate(self._nearest(number, gap)):
            own = int(number[i])
            found = self._paths(own, lambda own=own: self._text(own))
            chosen[i] = found[0][1]
            into.append([(k, s - found[0][0], ((i, ids),)) for s, ids in found])
            best.append(0.0)
        out = []
        for s, labels in best_paths(into, best, self.n_best)[1:]:
            out.append((score + s, [(int(starts[i]), int(starts[i + 1] - starts[i]), list(ids)) for i, ids in labels if ids != chosen[i]]))
        return out


@cache
def _pieces(path: str) -> Pieces:
    return Pieces(path)


_NBEST = pa.list_(pa.struct([("score", pa.float64()), ("edits", pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))


def _encode(path: str, n_best: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(_pieces(path), n_best)
        for whole in batches:
            data, bounds = shared.text_buffer(whole.column(1))
            for a, b in shared.pieces(bounds, PIECE_BYTES):
                ids, first, score, others = encoder.encode_batch(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
                for c in range(0, b - a, BATCH):
                    d = min(c + BATCH, b - a)
                    lists = pa.ListArray.from_arrays(pa.array(first[c : d + 1] - first[c], pa.int32()), pa.array(ids[first[c] : first[d]]))
                    next_best = pa.array([[{"score": s, "edits": [{"start": i, "length": n, "ids": own} for i, n, own in edits]} for s, edits in x] for x in others[c:d]], _NBEST)
                    yield pa.RecordBatch.from_arrays([whole.column(0)[a + c : a + d], lists, pa.array(score[c:d]), next_best], names=["id", "ids", "score", "others"])

    return encode


def _decode(path: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        size = np.diff(pieces.raw_first)
        for whole in batches:
            for a in range(0, whole.num_rows, BATCH):
                batch = whole.slice(a, BATCH)
                lists = batch.column(1)
                ids = lists.flatten().to_numpy()
                first = np.concatenate([[0], np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy())])
                n = size[ids]
                end = np.concatenate([[0], np.cumsum(n)])
                data = pieces.raw_data[np.repeat(pieces.raw_first[ids] - end[:-1], n) + np.arange(end[-1])].tobytes()
                texts = [data[i + 1 : j].decode() if j > i else "" for i, j in zip(end[first[:-1]].tolist(), end[first[1:]].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *batch.columns[2:]], names=["id", "text", *batch.schema.names[2:]])

    return decode


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_best: int = N_BEST, model: str = MODEL) -> DataFrame:
    """One row a document: id_col, ids, score, others.

    ``others`` are the second to N-th best segmentations: score and edits (start, length, ids), the
    runs of the best ids that they replace.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(shared.returning(_encode(model, n_best)), f"id {kind}, ids array<int>, score double, others array<struct<score: double, edits: array<struct<start: int, length: int, ids: array<int>>>>>")
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ids: id_col, text and the columns ``keep``, which go along with their row."""
    held = [f"kept{i}" for i in range(len(keep))]
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"), *[F.col(c).alias(h) for c, h in zip(keep, held, strict=True)])
    kinds = ", ".join([f"id {encoded.schema[id_col].dataType.simpleString()}", "text string", *(f"{h} {encoded.schema[c].dataType.simpleString()}" for c, h in zip(keep, held, strict=True))])
    return rows.mapInArrow(shared.returning(_decode(model)), kinds).toDF(id_col, "text", *keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids as text of their digest, scores of the N best, and the digest of the text that decoding gives back."""
    encoded = shared.written(encode(spark.read.parquet(f"{sf_dir}/documents.parquet")), "pieces", compression="zstd")
    kept = ("n_ids", "ids_sha256", "score", "other_scores")
    digest = encoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), F.sha2(F.array_join(F.col("ids"), ","), 256).alias("ids_sha256"), "score", F.col("others.score").alias("other_scores"))
    return decode(digest, keep=kept).select("doc_id", *kept, F.sha2("text", 256).alias("text_sha256"), F.length("text").cast("long").alias("n_chars"))
