"""The registry of queries, and relations that both engines build from one piece of SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with the same in DuckDB's SQL where SQL can say it."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = plain(sql)
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A relation of SQL that both engines read, over tables named as <name>."""
    names = set(re.findall(r"<(\w+)>", sql))
    escaped = sql.replace("{", "{{").replace("}", "}}") if names else sql
    return spark.sql(re.sub(r"<(\w+)>", r"{\1}", escaped), **{n: table(spark, sf_dir, n) for n in names})


def plain(sql: str) -> str:
    return re.sub(r"<(region|nation|customer|supplier|part|orders|lineitem|events|documents|embeddings|pages|benchmark|labels|conversations)>", r"\1", sql)
