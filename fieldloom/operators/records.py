"""Records of documents and what is looked up, gated and shown of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fields
from ..functions.text import blank_to_null
from .layout import banded, latest_before, words_in_cells

# Limits of what is shown to a model, files beside a document, and how prose is told from a form.
CONTEXT_LINES, DOCUMENT_LINES, SHORT_LINES, LINE_SIGNS = 60, 140, 55, 160
SUPPORTING = 3
WAITING = "The form is still being prepared."
PROSE_LINES, PROSE_CAPTIONS, PROSE_MEDIAN, LONG_LINE, LONG_LINES = 8, 2, 0.6, 0.42, 4


def ready(records: DataFrame) -> DataFrame:
    """Records that can be asked about."""
    return records.where(F.col("status") == "ready")


def refused(records: DataFrame) -> DataFrame:
    """id, message of the records that can't be asked about yet, or at all."""
    return records.where(~F.coalesce(F.col("status") == "ready", F.lit(False))).select("id", F.coalesce(blank_to_null(F.col("error_message")), F.lit(WAITING)).alias("message"))


def responses(records: DataFrame, base: str) -> DataFrame:
    """What is told of a record: its public columns, page_count, and the address of each page's image. ``records``: id, status, stage, category, n_pages, error_message."""
    at = lambda i: F.concat(F.lit(f"{base}/documents/"), F.col("id").cast("string"), F.lit("/pages/"), i.cast("string"))
    pages = F.when(F.col("n_pages") > 0, F.transform(F.sequence(F.lit(0), F.col("n_pages").cast("int") - 1), at)).otherwise(F.array().cast("array<string>"))
    return records.select("id", "status", "stage", "category", F.coalesce(F.col("n_pages"), F.lit(0)).cast("int").alias("page_count"), "error_message", pages.alias("page_urls"))


def selected(rows: DataFrame, wanted: list | None, ident: str = "id") -> DataFrame:
    """All rows where nothing is asked for by name, else those of the ids ``wanted``."""
    return rows if wanted is None else rows.where(F.col(ident).isin(*wanted))


def with_readings(rows: DataFrame, readings: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """``rows`` with one struct column for each table of ``readings``, its row of the same keys or null; of repeated keys the smallest row."""
    out = rows
    for name, found in readings.items():
        others = [c for c in found.columns if c not in keys]
        one = found.groupBy(*keys).agg(F.min(F.struct(*others)).alias(name))
        out = out.join(one, keys, "left")
    return out


def field_key(values: Column, *candidates: Column) -> Column:
    """The first of the candidate ids that a map of values has; null without any."""
    return F.coalesce(*[F.when(blank_to_null(c).isNotNull() & F.coalesce(F.map_contains_key(values, F.coalesce(c, F.lit(""))), F.lit(False)), c) for c in candidates])


def script_sets(pages: DataFrame, keys: list[str], script: str) -> DataFrame:
    """keys, scripts: the scripts of a document's pages but unknown ones, in order."""
    return pages.groupBy(*keys).agg(F.array_sort(F.collect_set(F.when(F.col(script) != "unknown", F.col(script)))).alias("scripts"))


def prose(lines: DataFrame, keys: list[str], page_width: Column, in_tables: Column | None = None) -> DataFrame:
    """keys, n_lines, prose: whether pages of lines (text, width) are running text, not forms.

    They have eight lines or more, no table and no two lines that invite an answer; and the upper median of their widths is 0.6 of the widest, or four lines take 0.42 of the page.
    """
    table = F.lit(False) if in_tables is None else in_tables
    marked = lines.withColumn("_widest", F.max("width").over(Window.partitionBy(*keys))).withColumn("_asks", fields.short_caption(F.col("text"), F.col("width"), F.col("_widest")))
    sums = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("width")).alias("w"), F.count(F.when(F.col("_asks"), 1)).alias("asks"), F.max(table).alias("table"), F.count(F.when(F.col("width") >= LONG_LINE * page_width, 1)).alias("long"))
    widest, middle = F.get("w", F.size("w") - 1), F.get("w", F.floor(F.size("w") / 2).cast("int"))
    dense = (middle / F.nullif(widest, F.lit(0)) >= PROSE_MEDIAN) | (F.col("long") >= LONG_LINES)
    return sums.select(*keys, F.col("n").cast("int").alias("n_lines"), F.coalesce((F.col("n") >= PROSE_LINES) & ~F.col("table") & (F.col("asks") < PROSE_CAPTIONS) & (widest > 0) & dense, F.lit(False)).alias("prose"))


def gated(blanks: DataFrame, pages: DataFrame, keys: list[str], origin: str = "origin") -> DataFrame:
    """Blanks that stand on a page: of prose (:func:`prose`) only those of tables and leaders."""
    running = pages.where("prose").select(*keys, F.lit(True).alias("_prose"))
    return blanks.join(running, keys, "left").where(F.col("_prose").isNull() | F.col(origin).isin("table_cell", "inline_cell", "dot_leader")).drop("_prose")


def sections_above(blanks: DataFrame, lines: DataFrame, keys: list[str], ident: str = "id", slack: float = 4.0) -> DataFrame:
    """keys, ident, section: the text of the lowest line that ends above the blank's table, or the blank itself (table_y null), up to ``slack``; the first line (by ord) of equal ones, empty without any."""
    at = F.coalesce("table_y", "y") + slack
    bottoms = lines.select(*keys, (F.col("y") + F.col("height")).alias("_ceiling"), (-F.col("ord")).alias("_order"), F.col("text").alias("section"))
    found = latest_before(blanks.select(*keys, ident, at.alias("_ceiling")), bottoms, keys, "_ceiling", ["section"], "_order")
    return found.select(*keys, ident, F.coalesce("section", F.lit("")).alias("section"))


def nearby_words(places: DataFrame, words: DataFrame, keys: list[str], reach: float = 0.08, most: int = 40, signs: int = 400, ident: str = "id") -> DataFrame:
    """keys, ident, nearby: the first ``most`` words, by y then x, whose top lies within ``reach`` of the place's, cut to ``signs`` signs; places without any are absent. Boxes are shares of the page."""
    p = banded(places.select(*keys, F.col(ident).alias("_place"), F.col("y").alias("_top")), F.col("_top") - reach, F.col("_top") + reach, reach)
    w = words.select(*keys, F.col(ident).alias("_word"), "x", "y", "text").withColumn("band", F.floor(F.col("y") / reach))
    near = p.join(w, [*keys, "band"]).where(F.abs(F.col("y") - F.col("_top")) < reach)
    first = near.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_place").orderBy("y", "x", "_word"))).where(F.col("_n") <= most)
    read = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "text"))), lambda x: x["text"]), " ")
    return first.groupBy(*keys, F.col("_place").alias(ident)).agg(F.substring(read, 1, signs).alias("nearby"))


def words_in_tables(words: DataFrame, tables: DataFrame, cells: DataFrame, keys: list[str], band: float = 50.0) -> DataFrame:
    """keys, word_id, table_id, cell_id: the first table (by ord) that holds a word's centre, and its first cell that does; words that their table has no cell for are left out."""
    first = words_in_cells(words, tables.withColumnRenamed("table_id", "cell_id"), keys, band).withColumnRenamed("cell_id", "table_id")
    placed = words.join(first, [*keys, "word_id"])
    return words_in_cells(placed, cells, [*keys, "table_id"], band).select(*keys, "word_id", "table_id", "cell_id")


def context_lines(lines: DataFrame, keys: list[str], order: list[str], most: int = CONTEXT_LINES, signs: int = LINE_SIGNS) -> DataFrame:
    """keys, context: the first ``most`` lines of a page or document that aren't blank, each cut to ``signs`` signs, one below the other."""
    full = lines.where(blank_to_null(F.col("text")).isNotNull())
    first = full.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= most)
    read = F.transform(F.array_sort(F.collect_list(F.struct("_n", F.substring(F.trim("text"), 1, signs).alias("t")))), lambda x: x["t"])
    return first.groupBy(*keys).agg(F.array_join(read, "\n").alias("context"))


def typed(label: Column, detected: Column, height: Column, entry_type: Column, confident: Column) -> Column:
    """The type of a field: the dictionary's where its entry is sure, else by the wording and the height."""
    return F.when(F.coalesce(confident, F.lit(False)) & entry_type.isNotNull(), fields.field_type_for(entry_type, detected)).otherwise(fields.refined_type(label, detected, height))


def supporting(files: DataFrame, key: str, order: list[str], most: int = SUPPORTING) -> DataFrame:
    """``files`` beside documents (with error, from ``readers.admitted``): those beyond the first ``most`` admitted ones of a document get the error too_many."""
    n = F.count(F.when(F.col("error").isNull(), 1)).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return files.withColumn("_n", n).withColumn("error", F.when(F.col("error").isNull() & (F.col("_n") > most), "too_many").otherwise(F.col("error"))).drop("_n")


def printable(texts: DataFrame, keys: list[str], size: str) -> DataFrame:
    """keys, n_texts, smallest: the documents that are written, with the smallest type size of their texts. A document with any text that fits its box at no size (null) is not."""
    sums = texts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_texts"), F.min(size).alias("smallest"), F.count(size).alias("_fit"))
    return sums.where(F.col("_fit") == F.col("n_texts")).drop("_fit")


def alias_total(entries: DataFrame, column: str = "aliases") -> DataFrame:
    """entries, wordings: how many entries a dictionary has, and wordings in all languages."""
    return entries.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum(F.size(F.flatten(F.map_values(column)))), F.lit(0)).alias("wordings"))
