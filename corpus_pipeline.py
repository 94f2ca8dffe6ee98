"""Corpus pipeline: stages that each work on all that the stage before kept.

``run`` writes each stage's rows as Parquet in the shared folder and reads them again as the next
stage's documents. The stages: the quality classifier drops what it rejects; exact
deduplication keeps one row of each text; near-deduplication (five-word shingles, 80 % similarity) keeps one document of each class; benchmark
passages are cut out of the texts; the last stage gives the ids of the texts that are left.

All stages but the last return the columns of ``documents``, further ones too. Where a stage cuts
a text, ``n_chars``, if there, is counted again. Null texts count as empty: the classifier rejects them.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import decontaminate, exact_dedup, near_dedup, quality, sentencepiece_nbest, shared


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted_only(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.without_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = decontaminate.without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, score of the best segmentation, and the scores of the next ones."""
    return sentencepiece_nbest.encode(docs).select("doc_id", "ids", "score", F.col("others.score").alias("other_scores"))


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontaminate", benchmark_stage),
    ("sentencepiece", pieces_stage),
]

#: Models, signatures and piece lattices are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = shared.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
