"""Near-duplicate classes of documents by min-max hashing.

A document's set holds the hashes of its distinct word shingles. Under each of ``HASHES``
permutations both the smallest and the largest hash are kept, so one evaluation gives two
signature values, each equal between two sets with a probability of their Jaccard similarity.
``ROWS`` values form a band. Documents that share a band are candidates; every link is confirmed
on the full sets.

Work on groups stays linear where links hold: documents of one set collapse first; each bucket
elects a hub and its members are compared with the hub only, so linked members meet in one
component. What a bucket still holds in several components is then compared in blocks, each member outside the bucket's largest component with all others of it. So no pair that shares a band is
lost, at any group size. A pair at the threshold shares no band with a probability near 1e-5.

Defined results: null and empty texts, and texts without words, have empty sets and stay alone;
shorter texts have their whole word sequence as one shingle; rows of equal texts are one class; a
row without id has no component and stays; rows that share an id count as one document. Only the id and text columns are
read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import filters, shared
from .components import connected_components
from .words import SPACED, Words, mix, shingles

PIECE_BYTES = 1 << 20
#: Documents of one side of a comparison task, about, and shingles of all of them: long documents are fewer to a task.
BLOCK = 256
BLOCK_SHINGLES = 400_000
#: After a group of more shingles a worker hands the memory that it freed back to the system.
TRIMMED_SHINGLES = 100_000

_RANDOM = np.random.Generator(np.random.PCG64(97))
_FACTOR = _RANDOM.integers(0, 2**63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RANDOM.integers(0, 2**63, 512, dtype=np.uint64)


def signatures(values: np.ndarray, first: np.ndarray, hashes: int) -> np.ndarray:
    """(sets, 2 * hashes): minimum and maximum of each permutation over each non-empty set."""
    out = np.empty((len(first) - 1, 2 * hashes), np.uint64)
    for j in range(hashes):
        x = values * _FACTOR[j]
        x += _SHIFT[j]
        out[:, 2 * j] = np.minimum.reduceat(x, first[:-1])
        out[:, 2 * j + 1] = np.maximum.reduceat(x, first[:-1])
    return out


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """(sets, bands): a 64-bit key of the values in each band and of the band's number."""
    rows = signature.shape[1] // bands
    parts = signature.reshape(len(signature), bands, rows)
    keys = (mix(parts + _SHIFT[:rows]) * _FACTOR[:rows]).sum(2, dtype=np.uint64)
    return mix(keys + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def distinct(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's values sorted and without repeats."""
    sets = [np.unique(values[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
    return (np.concatenate(sets) if sets else values), np.cumsum([0, *map(len, sets)])


def _sets(data: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    words = Words(data, bounds, SPACED)
    return distinct(*shingles(words.hash, words.first, width))


def _sign(width: int, rows: int, bands: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = shared.text_buffer(batch.column(1))
            for a, b in shared.pieces(bounds, PIECE_BYTES):
                values, first = _sets(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], width)
                size = np.diff(first)
                live = size > 0
                keys = np.zeros((b - a, bands), np.uint64)
                marks = np.zeros((2, b - a), np.uint64)
                if live.any():
                    full = np.append(first[:-1][live], first[-1])
                    keys[live] = band_keys(signatures(values, full, rows * bands // 2), bands)
                    marks[0, live] = np.add.reduceat(mix(values + _SHIFT[0]), full[:-1])
                    marks[1, live] = np.add.reduceat(mix(values + _SHIFT[1]), full[:-1])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * bands, pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(size, pa.int64()), pa.array(marks[0].view(np.int64)), pa.array(marks[1].view(np.int64)), lists], names=["id", "n_shingles", "mark1", "mark2", "bands"])

    return sign


def _full_sets(width: int):
    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = shared.text_buffer(batch.column(1))
            for a, b in shared.pieces(bounds, PIECE_BYTES):
                values, first = _sets(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], width)
                raw = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((first * 8).astype(np.int32)), pa.py_buffer(values)])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], raw], names=["id", "set"])

    return full


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between two lists of sets, by products of 0/1 matrices over common values."""
    values = [np.concatenate(x) for x in (left, right)]
    owner = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    common = np.intersect1d(*map(np.unique, values), assume_unique=True)
    out = np.zeros((len(left), len(right)))
    for a in range(0, len(common), 4096):
        part, sides = common[a : a + 4096], []
        for v, o, n in zip(values, owner, (len(left), len(right)), strict=True):
            at = np.minimum(np.searchsorted(part, v), len(part) - 1)
            held = part[at] == v
            m = np.zeros((n, len(part)), np.float32)
            m[o[held], at[held]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def _compare(percent: int):
    """For a group: links between its sides, of those to one component the first."""

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        side = [rows[rows["side"] == k] for k in (0, 1)]
        sets = [[np.frombuffer(x, np.uint64) for x in s["set"]] for s in side]
        if not sets[0] or not sets[1]:
            return pd.DataFrame({"a": rows["id"].iloc[:0], "b": rows["id"].iloc[:0]})
        both = intersections(*sets)
        total = np.array([[len(x)] for x in sets[0]]) + np.array([len(x) for x in sets[1]]) - both
        comp = [s["component"].to_numpy() for s in side]
        x, y = np.nonzero((100 * both >= percent * total) & (comp[0][:, None] != comp[1][None, :]))
        out = pd.DataFrame({"a": side[0]["id"].to_numpy()[x], "b": side[1]["id"].to_numpy()[y], "to": comp[1][y]})
        if sum(len(s) for own in sets for s in own) > TRIMMED_SHINGLES:
            del sets, both, total
            shared.hand_back()
        return out.drop_duplicates(["a", "to"])[["a", "b"]]

    return compare


def _links(tasks: DataFrame, sets: DataFrame, percent: int, id_type: str) -> DataFrame:
    """tasks: group, side, id, component."""
    rows = tasks.join(sets, "id").select("group", "side", "id", "component", "set")
    return rows.groupBy("group").applyInPandas(_compare(percent), f"a {id_type}, b {id_type}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, rows: int = 5, bands: int = 30) -> DataFrame:
    """One row for each input row: id_col, n_shingles, component_id (smallest linked id), kept.

    Sets of ``width``-word shingles are linked from ``percent`` Jaccard similarity on; signatures have
    ``bands`` of ``rows`` values (their product even).
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = shared.written(texts.mapInArrow(shared.returning(_sign(width, rows, bands)), f"id {id_type}, n_shingles long, mark1 long, mark2 long, bands array<long>"), "near-signed")
    named = signed.where("n_shingles > 0 AND id IS NOT NULL")
    # documents of one set: the smallest id stands for all
    same = shared.written(named.groupBy("mark1", "mark2", "n_shingles").agg(F.min("id").alias("rep")), "near-same")
    reps = named.join(same, ["mark1", "mark2", "n_shingles"]).where("id = rep").select("id", "n_shingles", F.explode("bands").alias("key")).groupBy("id", "key").agg(F.max("n_shingles").alias("n_shingles"))
    reps = shared.written(reps, "near-reps")
    blocks = lambda n, weight: F.greatest(F.ceil(n / BLOCK), F.ceil(weight / BLOCK_SHINGLES))
    buckets = reps.groupBy("key").agg(F.min_by("id", F.xxhash64("id")).alias("hub"), F.count(F.lit(1)).alias("size"), F.sum("n_shingles").alias("weight")).where("size > 1")
    buckets = shared.written(buckets, "near-buckets")
    members = shared.written(reps.join(buckets, "key").select("key", "id", "hub", "n_shingles", "size", "weight"), "near-members")
    shared.drop_table(reps)
    shared.drop_table(buckets)
    # texts stay where they are: a filter finds those of members, and few others, whose sets meet no task
    asked = filters.marked(texts, F.col("id"), members.select("id").distinct(), "_asked").where("_asked").select("id", "text")
    sets = shared.written(asked.mapInArrow(shared.returning(_full_sets(width)), f"id {id_type}, set binary"), "near-sets")
    # every member against its hub
    spread = F.pmod(F.xxhash64("id"), blocks(F.col("size"), F.col("weight")))
    pairs = members.where("id <> hub").select("hub", spread.alias("block"), "id").distinct()
    group = F.concat_ws(":", F.col("hub").cast("string"), F.col("block").cast("string")).alias("group")
    tasks = pairs.select(group, F.lit(1).alias("side"), "id", F.col("id").alias("component")).unionByName(
        pairs.select("hub", "block").distinct().select(group, F.lit(0).alias("side"), F.col("hub").alias("id"), F.col("hub").alias("component"))
    )
    links = shared.written(_links(tasks, sets, percent, id_type), "near-links")
    found = connected_components(links, "a", "b")
    # buckets that still hold several components: what is not of the largest one against all others
    placed = members.join(found, members["id"] == found["vertex"], "left").select("key", "id", "n_shingles", F.coalesce("component", "id").alias("component"))
    placed = shared.written(placed, "near-placed")
    shared.drop_table(members)
    parts = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w"))
    most = parts.groupBy("key").agg(F.max(F.struct("n", "component", "w")).alias("top"), F.sum("n").alias("size"), F.sum("w").alias("weight")).where("top.n < size")
    most = most.select("key", F.col("top.component").alias("largest"), blocks(F.col("size") - F.col("top.n"), F.col("weight") - F.col("top.w")).cast("int").alias("of_out"), blocks(F.col("size"), F.col("weight")).cast("int").alias("of_all"))
    most = shared.written(most, "near-split")
    rest = placed.join(most, "key").select("key", "id", "component", (F.col("component") != F.col("largest")).alias("out"), "of_out", "of_all")
    at = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    grid = F.concat_ws(":", *[F.col(c).cast("string") for c in ("key", "i", "j")]).alias("group")
    outside = rest.where("out").select("key", "id", "component", at("of_out").alias("i"), F.explode(F.sequence(F.lit(0), F.col("of_all") - 1)).alias("j"))
    against = rest.select("key", "id", "component", F.explode(F.sequence(F.lit(0), F.col("of_out") - 1)).alias("i"), at("of_all").alias("j"))
    tasks = outside.select(grid, F.lit(0).alias("side"), "id", "component").unionByName(against.select(grid, F.lit(1).alias("side"), "id", "component"))
    more = shared.written(_links(tasks, sets, percent, id_type), "near-more")
    for done in (placed, most, sets):
        shared.drop_table(done)
    found = connected_components(links.unionByName(more), "a", "b")
    classes = same.join(found, same["rep"] == found["vertex"], "left").select("mark1", "mark2", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    classes = shared.written(classes, "near-classes")
    out = signed.select("id", "n_shingles", "mark1", "mark2").join(classes, ["mark1", "mark2", "n_shingles"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """The rows of ``docs`` whose document stays for its class, with all columns."""
    dropped = near_duplicates(docs, id_col, text_col, **options).where("NOT kept").select(F.col(id_col).alias("id")).distinct()
    return filters.without_keys(docs, id_col, shared.written(dropped, "near-dropped"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, percent=85, rows=6, bands=24)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 2], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, b AS r FROM edges UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON reach.r = edges.a),
c AS (SELECT doc_id, min(r) AS low FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(low, w.doc_id)) AS component_id, w.doc_id <= coalesce(low, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
