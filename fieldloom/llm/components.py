"""Connected components of a link table, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """vertex, component: the smallest vertex that each linked vertex reaches.

    Every round takes the smallest label among neighbours and then the label of that label, so
    long chains shrink fast; each round's table is written in the shared folder. Vertices without
    links are absent. Links may repeat, in either direction, and a vertex may link with itself.
    """
    both = links.select(F.col(a).alias("vertex"), F.col(b).alias("other")).unionByName(links.select(F.col(b).alias("vertex"), F.col(a).alias("other")))
    both = shared.written(both.distinct(), "links")
    labels = shared.written(both.groupBy("vertex").agg(F.least(F.min("other"), F.col("vertex")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("vertex", "other"), "other").groupBy("vertex").agg(F.min("component").alias("low"))
        stepped = labels.join(near, "vertex").select("vertex", F.col("component").alias("before"), F.least("component", "low").alias("component"))
        jump = labels.select(F.col("vertex").alias("component"), F.col("component").alias("root"))
        after = shared.written(stepped.join(jump, "component", "left").select("vertex", "before", F.least("component", F.coalesce("root", "component")).alias("component")), "labels")
        if after.where("component <> before").isEmpty():
            return after.select("vertex", "component")
        labels = after.select("vertex", "component")
