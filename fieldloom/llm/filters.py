"""Bit-set filters over keys, built and probed by DataFrame operations, so that rows which can't match need not move."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each key, rounded up to a power of two; and at most, which bounds a filter that is sent to all tasks to 64 MB.
BITS = 24
MOST_BITS = 1 << 29
#: Bits of one row of a filter: what Spark's bitmap aggregate holds.
ROW_BITS = 1 << 15


def bits_for(keys: int) -> int:
    return min(MOST_BITS, max(ROW_BITS, 1 << (BITS * keys).bit_length()))


def bit_set(keys: DataFrame, key: Column, bits: int) -> DataFrame:
    """Rows (bucket, members): the set bits of all keys."""
    place = keys.select(F.pmod(F.xxhash64(key), F.lit(bits)).alias("p"))
    return place.groupBy(F.shiftright("p", 15).alias("bucket")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit(ROW_BITS - 1))).alias("members"))


def probed(rows: DataFrame, key: Column, members: DataFrame, bits: int, name: str, small: bool = False) -> DataFrame:
    """``rows`` with a boolean column: true for every row whose key is in the filter, and for few others. ``small``: send the filter to all tasks."""
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    kept = members.select(F.col("bucket").alias("_bucket"), F.col("members").alias("_members"))
    found = rows.withColumn("_place", place).join(F.broadcast(kept) if small else kept, F.shiftright("_place", 15) == F.col("_bucket"), "left")
    within = F.col("_place").bitwiseAND(F.lit(ROW_BITS - 1)).cast("int")
    byte = F.conv(F.hex(F.substr("_members", F.shiftright(within, 3) + 1, F.lit(1))), 16, 10).cast("long")
    bit = F.coalesce(F.getbit(byte, within.bitwiseAND(F.lit(7))) == 1, F.lit(False))
    return found.withColumn(name, bit).drop("_place", "_bucket", "_members")


def marked(rows: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """``rows`` with a boolean column: true where ``key`` is among the values of the one column of ``keys``, and for few others; no row moves.

    The filter has ``BITS`` bits for each key and never more than ``MOST_BITS``; with more keys than these hold, more rows are marked in vain.
    """
    bits = bits_for(keys.count())
    return probed(rows, key, bit_set(keys, F.col(keys.columns[0]), bits), bits, name, small=True)


def without_keys(docs: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows whose ``column`` is not among the values of the one column of ``keys``, null like any value; only rows that the filter marks are joined."""
    names = docs.columns
    at = f"c{names.index(column)}"
    rows = marked(docs.toDF(*[f"c{i}" for i in range(len(names))]), F.col(at), keys, "_marked")
    gone = keys.toDF("_gone").distinct()
    exact = rows.where("_marked").join(gone, F.col(at).eqNullSafe(F.col("_gone")), "left_anti")
    return rows.where("NOT _marked").unionByName(exact).drop("_marked").toDF(*names)
