"""Clusters of quantised vectors by Lloyd's rounds over distinct vectors with multiplicities.

Vectors become integers, ``floor(scale * x)``. Identical ones are grouped first, with their number as weight, so a round
reads each distinct vector once; tasks add weighted integer sums for each centroid, and Spark adds those of the tasks. Every
sum and distance is an exact integer, so results don't depend on partitioning. The driver holds ``k`` centroids and no vector.
At the end each distinct vector's assignment is joined back to the ids: vectors of more than ``1 / HOT`` of all
rows, fewer than ``HOT`` in number, are sent to the tasks, the others meet their rows in a shuffle.

Defined results: vectors that are null, of another length, or with components that are null, NaN or infinite are left out. Quantised
components beyond ``MOST`` in size count as ``MOST``, so that distances fit 64 bits; an inertia beyond 64 bits is null. Of equal draws (repeated ids) the smaller
vector comes first; vectors without id are drawn last and clustered like others. Fewer vectors than ``k`` make fewer centroids, which may be equal: ties go to
the smaller number, and a centroid without vectors stays. Repeated rows are counted and returned each. Only id and vector are read; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

DIMS = 64
SCALE = 256
K = 40
ROUNDS = 5
SEED = 2
MOST = 1 << 27
#: Below this size of components, distances are exact in doubles.
EXACT = 1 << 21
HOT = 256


def quantised(vectors: DataFrame, id_col: str, vector_col: str, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """id, vector (array<int>) of the vectors that are whole."""
    whole = F.forall("raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("raw")).where((F.size("raw") == dims) & whole)
    clamped = lambda x: F.greatest(F.least(x * scale, F.lit(float(MOST))), F.lit(float(-MOST)))
    return kept.select("id", F.transform("raw", lambda x: F.floor(clamped(x)).cast("int")).alias("vector"))


def drawn(kept: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The first centroids: the vectors of the ``k`` smallest SHA-256 of ``seed:id``."""
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = kept.select(draw.alias("draw"), "vector").orderBy(F.asc_nulls_last("draw"), "vector").limit(k).collect()
    return np.array([x.vector for x in first], np.int64)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(-1, dims)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, the smaller number of equal ones, and the squared distance."""
    if max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT:
        a, c = vectors.astype(np.float64), centroids.astype(np.float64)
        far = (a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)[None]
    else:
        far = np.stack([((vectors - c) ** 2).sum(1) for c in centroids], 1)
    cluster = far.argmin(1)
    return cluster, far[np.arange(len(far)), cluster].astype(np.int64)


def _sums(centroids: np.ndarray):
    k, dims = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            vectors, n = _matrix(batch.column(0), dims), batch.column(1).to_numpy()
            if not len(n):
                continue
            cluster, _ = nearest(vectors, centroids)
            order = np.argsort(cluster, kind="stable")
            found, first = np.unique(cluster[order], return_index=True)
            total[found] += np.add.reduceat((vectors * n[:, None])[order], first)
            count[found] += np.add.reduceat(n[order], first)
        # slot dims of a centroid holds its number of vectors
        slots = np.concatenate([total, count[:, None]], 1).ravel()
        held = np.flatnonzero(slots)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(slots[held])], names=["slot", "part"])

    return sums


def moved(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: the floor of each one's mean."""
    k, dims = centroids.shape
    parts = distinct.select("vector", "n").mapInArrow(_sums(centroids), "slot long, part long")
    slots = np.zeros(k * (dims + 1), np.int64)
    for slot, total in parts.groupBy("slot").agg(F.sum("part")).collect():
        slots[slot] = total
    slots = slots.reshape(k, dims + 1)
    n = slots[:, dims:]
    return np.where(n > 0, slots[:, :dims] // np.maximum(n, 1), centroids)


def _assign(centroids: np.ndarray):
    dims = centroids.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = nearest(_matrix(batch.column(0), dims), centroids)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster, pa.int32()), pa.array(distance)], names=[*batch.schema.names, "cluster", "distance"])

    return assign


@dataclass(frozen=True)
class Clusters:
    """What :func:`cluster` returns."""

    #: vector, n, cluster, distance: one row a distinct vector.
    distinct: DataFrame
    #: id, vector, cluster, distance: one row a kept vector.
    members: DataFrame
    #: One row a centroid.
    centroids: np.ndarray


def _with_ids(kept: DataFrame, assigned: DataFrame, total: int) -> DataFrame:
    found = ["cluster", "distance"]
    hot = assigned.where(F.col("n") > total // HOT)
    sent = F.broadcast(hot.select("vector", *[F.col(c).alias(f"hot_{c}") for c in found]))
    rows = kept.join(sent, "vector", "left")
    known = rows.where("hot_cluster IS NOT NULL").select("id", "vector", *[F.col(f"hot_{c}").alias(c) for c in found])
    rest = rows.where("hot_cluster IS NULL").select("id", "vector").join(assigned.where(F.col("n") <= total // HOT).drop("n"), "vector")
    return known.unionByName(rest.select("id", "vector", *found))


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, scale: int = SCALE, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> Clusters:
    """Lloyd's rounds over the distinct quantised vectors, and every kept vector's cluster."""
    kept = quantised(vectors, id_col, vector_col, dims, scale)
    distinct = shared.written(kept.groupBy("vector").agg(F.count(F.lit(1)).alias("n")), "vectors", compression="zstd")
    centroids = drawn(kept, k, seed).reshape(-1, dims)
    if not len(centroids):
        empty = distinct.select("vector", "n", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return Clusters(empty, kept.join(empty.drop("n"), "vector").select("id", "vector", "cluster", "distance"), centroids)
    for _ in range(rounds):
        centroids = moved(distinct, centroids)
    assigned = shared.written(distinct.mapInArrow(_assign(centroids), "vector array<int>, n long, cluster int, distance long"), "assigned", compression="zstd")
    shared.drop_table(distinct)
    total = assigned.agg(F.sum("n")).first()[0]
    return Clusters(assigned, _with_ids(kept, assigned, total), centroids)


def inertia(distinct: DataFrame) -> DataFrame:
    """cluster, cluster_inertia, inertia: weighted sums of the distances; one row for each centroid that has vectors."""
    weighted = F.sum(F.col("distance").cast("decimal(20,0)") * F.col("n").cast("decimal(18,0)"))
    each = distinct.groupBy("cluster").agg(weighted.alias("own"))
    every = F.sum("own").over(Window.partitionBy())  # over k rows
    return each.select("cluster", F.col("own").try_cast("long").alias("cluster_inertia"), every.try_cast("long").alias("inertia"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(found.centroids.tolist())]
    named = spark.createDataFrame(digests, "cluster int, centroid_sha256 string").join(inertia(found.distinct), "cluster")
    return found.members.select(F.col("id").alias("vec_id"), "cluster", "distance").join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    far = "list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for i in range(ROUNDS + 1):
        steps.append(f"""a{i} AS (SELECT v.vec_id, v.q, unnest(arg_min([c.c, {far}], ({far}, c.c), 1)) AS best FROM kept v, c{i} c GROUP BY v.vec_id, v.q)""")
        if i < ROUNDS:
            steps.append(f"""s{i} AS (SELECT best[1] AS c, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{i}),
m{i} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM s{i} GROUP BY c, i),
f{i} AS (SELECT c, list((s - ((s % n + n) % n)) // n ORDER BY i) AS q FROM m{i} GROUP BY c),
c{i + 1} AS (SELECT c, coalesce(f.q, o.q) AS q FROM c{i} o LEFT JOIN f{i} f USING (c))""")
    return f"""WITH kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS c, q FROM kept QUALIFY row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) <= {K}),
{", ".join(steps)}
SELECT vec_id, CAST(best[1] AS INTEGER) AS cluster, CAST(best[2] AS BIGINT) AS distance, CAST(sum(best[2]) OVER (PARTITION BY best[1]) AS BIGINT) AS cluster_inertia,
CAST(sum(best[2]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.c = a.best[1]"""


ORACLE = _oracle()
