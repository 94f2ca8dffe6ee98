"""An index of vectors in cells, searched by a few cells or exactly.

Cells are those of k-means over a sample of ``SAMPLE`` vectors, about as many as the square root of all vectors; every vector is in the cell of its nearest
centroid, and large cells are cut into blocks of about ``BLOCK`` vectors. The index is two tables: ``cells`` (partitioned by cell: block, id, v and the columns
kept for filters) and ``centroids`` (cell, v, n, radius). A search sends each query to its nearest cells' blocks, where one product ranks candidates
whose distances are then taken exactly. Equality filters go to the scan of ``cells``. Exact searches visit more cells: all whose nearest point,
by the triangle inequality, may be nearer than the k-th found so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .retrieval import TOP, _matrix, _nearest
from .work import computed

SAMPLE = 20_000
MOST_CELLS = 4096
ROUNDS = 8
BLOCK = 4096
PROBES = 12


def _kmeans(points: np.ndarray, k: int) -> np.ndarray:
    rng = np.random.default_rng(7)
    centres = points[rng.choice(len(points), k, replace=False)]
    for _ in range(ROUNDS):
        own = ((points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)[None]).argmin(1)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _cells(sent, probes: int):
    """Each vector with its nearest cells, nearest first, and the distances."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = sent.value
        for batch in batches:
            v = _matrix(pa.chunked_array([batch.column("v")])) if batch.num_rows else np.zeros((0, centres.shape[1]))
            far = np.sqrt(np.maximum((v**2).sum(1)[:, None] - 2 * v @ centres.T + (centres**2).sum(1)[None], 0))
            near = np.argsort(far, axis=1, kind="stable")[:, :probes]
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * near.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists(near.astype(np.int32)), lists(np.take_along_axis(far, near, 1))], names=[*batch.schema.names, "near", "far"])

    return cells


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def build(vectors: DataFrame, path: str, id_col: str, vector_col: str, keep: list[str] | None = None, cells: int | None = None) -> None:
    """Write the index of all vectors that aren't null. ``keep``: columns for equality filters."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), *(keep or [])).where("v IS NOT NULL")
    n = rows.count()
    sample = rows.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    points = _matrix(sample.column("v")) if n else np.zeros((1, 1))
    centres = _kmeans(points, max(1, min(cells or int(n**0.5), MOST_CELLS, len(points))))
    sent = spark.sparkContext.broadcast(centres)
    placed = rows.mapInArrow(_cells(sent, 1), f"{_ddl(rows)}, near array<int>, far array<double>").withColumn("cell", F.col("near")[0]).withColumn("far", F.col("far")[0])
    placed = computed(placed.drop("near"))
    # a cell of any size is many tasks' work: its vectors are dealt to blocks by a hash
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))  # a row for each of MOST_CELLS cells at most
    dealt = placed.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK))).drop("n")
    out = dealt.repartition("cell", "block").write
    (out.partitionBy("cell") if n else out).parquet(f"{path}/cells")
    held = spark.read.parquet(f"{path}/cells").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"), F.collect_set("block").alias("blocks"))
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, v array<double>")
    table.join(held, "cell", "left").select("cell", "v", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("radius", F.lit(0.0)).alias("radius"), F.coalesce("blocks", F.array().cast("array<long>")).alias("blocks")).coalesce(1).write.parquet(f"{path}/centroids")


def _best(spark: SparkSession, path: str, asked: DataFrame, k: int, equal: dict | None) -> DataFrame:
    """query, vector, distance: the k nearest of the cells that each query (id, v, cell) is sent to, block by block."""
    cells = spark.read.parquet(f"{path}/cells")
    for column, value in (equal or {}).items():
        cells = cells.where(F.col(column) == F.lit(value))
    blocks = F.broadcast(spark.read.parquet(f"{path}/centroids").select("cell", F.explode("blocks").alias("block")))
    left, right = asked.join(blocks, "cell").select("cell", "block", "id", "v"), cells.select("cell", "block", "id", "v")
    return left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInArrow(_nearest(k), "query long, vector long, distance double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy("distance", "vector")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(queries: DataFrame, path: str, id_col: str, vector_col: str, k: int = TOP, probes: int = PROBES, exact: bool = False, equal: dict | None = None) -> DataFrame:
    """query, vector, distance (squared Euclidean), score = max(0, 1 - distance), rank: the k nearest vectors of the index among those whose kept columns have the values ``equal``.

    Without ``exact``, of the ``probes`` nearest cells alone. With it, the result is that of all vectors. Null query vectors have none, nor has an empty index.
    """
    spark = queries.sparkSession
    table = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
    centres = np.array([x.v for x in table])
    sent = spark.sparkContext.broadcast(centres)
    rows = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("v IS NOT NULL")
    ways = rows.mapInArrow(_cells(sent, len(centres) if exact else min(probes, len(centres))), f"{_ddl(rows)}, near array<int>, far array<double>")
    asked = ways.select("id", "v", F.posexplode("near").alias("turn", "cell"))
    found = _ranked(_best(spark, path, asked.where(F.col("turn") < probes), k, equal), k)
    if exact:
        reach = found.groupBy(F.col("query").alias("id")).agg(F.max("distance").alias("reach"), F.count(F.lit(1)).alias("held"))
        radius = F.broadcast(spark.createDataFrame([(x.cell, float(x.radius)) for x in table], "cell int, radius double"))
        later = ways.select("id", "v", F.explode(F.slice(F.arrays_zip("near", "far"), probes + 1, F.greatest(F.size("near") - probes, F.lit(0)))).alias("w")).select("id", "v", F.col("w.near").alias("cell"), F.col("w.far").alias("far"))
        # a vector of the cell is at least this near to the query
        least = F.greatest(F.col("far") - F.col("radius"), F.lit(0.0)) * (1 - 1e-9) - 1e-6
        more = later.join(radius, "cell").join(reach, "id", "left").where(F.col("reach").isNull() | (F.col("held") < k) | (least * F.abs(least) <= F.col("reach")))
        found = _ranked(found.drop("rank").unionByName(_best(spark, path, more.select("id", "v", "cell"), k, equal)), k)
    return found.select("query", "vector", "distance", F.greatest(F.lit(0.0), 1 - F.col("distance")).alias("score"), "rank")
