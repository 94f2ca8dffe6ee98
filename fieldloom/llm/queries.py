"""Queries of this subpackage and their SQL.

An operator's module is imported when its query runs, so that a package which one of them lacks leaves the others.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exact_dedup, near_dedup, vector_clusters

_MODULES = {
    "op1_sentencepiece": "sentencepiece_nbest",
    "op2_context_mixing": "context_mixing",
    "op3_toxicity": "toxicity",
    "op4_token_files": "token_files",
    "op5_decontaminate": "decontaminate",
    "op6_exact_dedup": "exact_dedup",
    "op7_surrogates": "surrogates",
    "op8_near_dedup": "near_dedup",
    "op9_quality": "quality",
    "op10_licenses": "licenses",
    "op11_packing": "packing",
    "op12_token_alignment": "token_alignment",
    "op13_vector_clusters": "vector_clusters",
}


def _query(module: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return import_module(f"{__package__}.{module}").query(spark, sf_dir)

    return query


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _query(module) for name, module in _MODULES.items()}

ORACLE_SQL: dict[str, str] = {
    "op5_decontaminate": decontaminate.ORACLE,
    "op6_exact_dedup": exact_dedup.ORACLE,
    "op8_near_dedup": near_dedup.ORACLE,
    "op13_vector_clusters": vector_clusters.ORACLE,
}
