"""Readers of uploads, known forms and dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import match_fold, match_tokens

#: Bytes of an upload at most (a fixed value), and first bytes of each type as hex.
MOST_BYTES = 10 * 1024 * 1024
MAGIC = {"application/pdf": "^25504446", "image/png": "^89504E470D0A1A0A", "image/jpeg": "^FFD8FF", "image/webp": "^52494646.{8}57454250"}

FORM = "form_id string, display_name string, category string, version string, fingerprint_terms array<string>, fields array<struct<field_id: string, aliases: array<string>, type: string, what_to_enter: map<string,string>, why_needed: map<string,string>>>"
ENTRY = "id string, type string, priority double, aliases map<string,array<string>>, keywords map<string,array<string>>, texts map<string,string>"


def mime(content: Column) -> Column:
    """Type by the first bytes, whatever name and header say; null for types that are not read."""
    head, out = F.hex(F.substring(content, 1, 12)), F.lit(None).cast("string")
    for name, pattern in MAGIC.items():
        out = F.when(head.rlike(pattern), name).otherwise(out)
    return out


def admitted(files: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """``files`` (content) with mime, and error: empty, too_large, unknown_type, or null for those that are admitted."""
    n = F.length("content")
    error = F.when(n.isNull() | (n == 0), "empty").when(n > most, "too_large").when(F.col("mime").isNull(), "unknown_type")
    return files.withColumn("mime", mime(F.col("content"))).withColumn("error", error)


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder as rows (path, content, mime, error); Spark's reader passes empty files over."""
    return admitted(spark.read.format("binaryFile").load(path).select("path", "content"))


def known_forms(spark: SparkSession, path: str) -> DataFrame:
    """Forms, one JSON file each; of files with one form_id the last by name counts. Unreadable files have no form."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", FORM).alias("form")).where("form.form_id IS NOT NULL")
    last = F.max_by("form", "file").alias("form")
    return files.groupBy(F.col("form.form_id").alias("_id")).agg(last).select("form.*")


def form_fields(forms: DataFrame) -> DataFrame:
    """form_id, ord, field_id, aliases, type of each form's fields."""
    return forms.select("form_id", F.posexplode("fields").alias("ord", "f")).select("form_id", "ord", "f.field_id", "f.aliases", "f.type")


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Entries of JSON-lines files; an absent folder is an empty dictionary."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found):
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).json(path)


def alias_rows(entries: DataFrame, column: str = "aliases", languages: Column | None = None) -> DataFrame:
    """entry_id, language, alias, folded, length, pos: an entry's wordings, those of most tokens first, else as they come (by language, then place)."""
    order = languages if languages is not None else F.array_sort(F.map_keys(column))
    each = entries.select(F.col("id").alias("entry_id"), F.posexplode(F.flatten(F.transform(order, lambda lang: F.transform(F.element_at(column, lang), lambda a: F.struct(lang.alias("language"), a.alias("alias")))))).alias("at", "x"))
    rows = each.select("entry_id", "x.language", "x.alias", "at").withColumn("folded", match_fold(F.col("alias"))).withColumn("length", F.size(match_tokens(F.col("alias"))))
    w = Window.partitionBy("entry_id").orderBy(F.desc("length"), "at")
    return rows.withColumn("pos", F.row_number().over(w) - 1).drop("at")


def audit(entries: DataFrame, languages: list[str]) -> DataFrame:
    """entry_id, problem: entries given twice, and languages without wording or text."""
    twice = entries.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias("entry_id"), F.lit("duplicate").alias("problem"))
    lacks = lambda column, name: entries.select(F.col("id").alias("entry_id"), F.explode(F.array(*map(F.lit, languages))).alias("lang"), column).where(F.coalesce(F.element_at(column, F.col("lang")).cast("string"), F.lit("")).isin("", "[]")).select("entry_id", F.concat(F.lit(f"{name}:"), "lang").alias("problem"))
    return twice.unionByName(lacks("aliases", "aliases")).unionByName(lacks("texts", "text")).distinct()


def chunks(entries: DataFrame) -> DataFrame:
    """chunk, language, form_id, text: an entry's wording and text in each language that it has a text in."""
    each = entries.select("id", F.explode("texts").alias("language", "what"), "aliases")
    text = F.concat_ws(" ", "id", F.array_join(F.element_at("aliases", F.col("language")), " "), "what")
    return each.select(F.concat_ws(":", F.lit("common"), "id", "language").alias("chunk"), "language", F.lit(None).cast("string").alias("form_id"), text.alias("text"))


def replace_index(rows: DataFrame, path: str, vector: str = "embedding") -> None:
    """Write an index anew, of vectors of one width only."""
    low, high = rows.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    if low != high:
        raise ValueError(f"vectors of {low} to {high} numbers can't be one index")
    rows.write.mode("overwrite").parquet(path)
