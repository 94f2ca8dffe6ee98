"""Files of an evaluation: true fields as JSON, results and a review sheet, and what the results say in the mean."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIXEL = "struct<x: double, y: double, width: double, height: double, image_width: int, image_height: int>"
TRUTH = f"form_id string, image string, language string, rtl boolean, fields array<struct<field_id: string, label: string, type: string, pixel: {PIXEL}, options: array<string>>>, _corrupt string"
REVIEW = ["sample", "language", "guidance_correct", "unsupported_claim", "completion_minutes", "corrections", "sus_score", "notes"]


def truth_files(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: file (its name without ending) and the columns of ``TRUTH``. A file that is no such JSON has its text in _corrupt and else nulls."""
    read = spark.read.schema(TRUTH).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return read.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("file"), "*")


def true_fields(files: DataFrame) -> DataFrame:
    """One row a true field: file, form_id, language, field_id, label, type and its box as shares of the page; corrupt files and fields without pixels have none."""
    each = files.where(F.col("_corrupt").isNull()).select("file", "form_id", "language", F.explode("fields").alias("f")).where("f.pixel IS NOT NULL")
    share = lambda a, of: F.least(F.greatest(F.col(f"f.pixel.{a}") / F.greatest(F.col(f"f.pixel.image_{of}"), F.lit(1)), F.lit(0.0)), F.lit(1.0)).alias(a)
    return each.select("file", "form_id", "language", "f.field_id", "f.label", "f.type", share("x", "width"), share("y", "height"), share("width", "width"), share("height", "height"))


def write_results(results: DataFrame, path: str, by: list[str], kind: str = "json") -> None:
    """Write results by partition as JSON or CSV; partitions that are written again are replaced, the others stay."""
    out = results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by)
    out.option("header", True).csv(path) if kind == "csv" else out.option("ignoreNullFields", False).json(path)


def review_sheet(samples: DataFrame, path: str) -> None:
    """Write a sheet for reviewers, a row for each sample and language and empty columns to fill in; one that exists stays as it is."""
    empty = [F.lit(None).cast("string").alias(c) for c in REVIEW[2:]]
    samples.select(*REVIEW[:2], *empty).write.mode("ignore").option("header", True).csv(path)


def evaluation_means(results: DataFrame, by: str, rates: list[str], totals: list[str]) -> DataFrame:
    """``by``, n, the mean of each rate to three places and the sum of each total; and the same of all results, under ``all``."""
    rolled = results.rollup(by).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 3).alias(c) for c in rates], *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in totals], F.grouping(by).alias("_all"))
    return rolled.select(F.when(F.col("_all") == 1, "all").otherwise(F.col(by)).alias(by), "n", *rates, *totals)
