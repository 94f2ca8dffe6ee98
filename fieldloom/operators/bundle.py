"""Guidance on each field in all languages at once: the text chain of each source as rows of a rule table.

A chain says, for a source and a part of the answer, which texts are tried in turn: those of an origin, in the reader's language, in English or
without language, as they are or only in the script of the reader's language. Fields are dealt to languages, joined with the
rules of their source (a table of fixed size, sent to all tasks) and with the texts by field, origin, part and language; the first step that has a text wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, bound, in_script
from . import resolve

# Sources whose answers are guesses, and thresholds of retrieved texts for known and unknown forms.
INFERRED = ["classified", "model", "pattern"]
LEAST, LEAST_UNKNOWN = 0.35, 0.62
PARTS = ["simple_label", "what_to_enter", "why_needed", "example", "format_hint", "source_reference", "notice", "note"]

#: source, part, step, origin, of (part, message, literal or column of the field), language (own, en, or empty), checked (only in the reader's script), reader (en, other, or empty: all).
CHAINS = [
    ("known", "what_to_enter", 0, "kb", "what_to_enter", "own", True, ""),
    ("known", "what_to_enter", 1, "entry", "what_to_enter", "own", True, ""),
    ("known", "what_to_enter", 2, "kb", "what_to_enter", "own", False, ""),
    ("known", "what_to_enter", 3, "kb", "what_to_enter", "en", False, ""),
    ("known", "what_to_enter", 4, "message", "unavailable", "own", False, ""),
    ("known", "why_needed", 0, "kb", "why_needed", "own", True, ""),
    ("known", "why_needed", 1, "entry", "why_needed", "own", True, ""),
    ("known", "why_needed", 2, "kb", "why_needed", "own", False, ""),
    ("known", "why_needed", 3, "kb", "why_needed", "en", False, ""),
    ("known", "simple_label", 0, "kb", "simple_label", "own", True, ""),
    ("known", "simple_label", 1, "entry", "simple_label", "own", True, ""),
    ("known", "simple_label", 2, "kb", "simple_label", "own", False, ""),
    ("known", "simple_label", 3, "field", "label", "", False, ""),
    ("known", "simple_label", 4, "field", "concept", "", False, ""),
    ("known", "example", 0, "kb", "example", "", True, ""),
    ("known", "example", 1, "entry", "example", "own", False, "en"),
    ("known", "example", 2, "entry", "example", "own", True, "other"),
    ("known", "example", 3, "entry", "example", "", False, "en"),
    ("known", "example", 4, "entry", "example", "", True, "other"),
    ("known", "example", 5, "kb", "example", "", False, ""),
    ("known", "format_hint", 0, "kb", "format", "", False, ""),
    ("known", "source_reference", 0, "kb", "source_reference", "", False, ""),
    ("interpreted", "what_to_enter", 0, "page", "what_to_enter", "own", False, ""),
    ("interpreted", "simple_label", 0, "page", "simple_label", "own", False, ""),
    ("interpreted", "simple_label", 1, "field", "display_label", "", False, ""),
    ("interpreted", "simple_label", 2, "field", "label", "", False, ""),
    ("interpreted", "simple_label", 3, "literal", "Field", "", False, ""),
    ("interpreted", "why_needed", 0, "page", "why_needed", "own", False, ""),
    ("interpreted", "example", 0, "page", "example", "own", False, ""),
    ("interpreted", "example", 1, "page", "example", "en", False, ""),
    ("interpreted", "format_hint", 0, "page", "format_hint", "own", False, ""),
    ("interpreted", "source_reference", 0, "literal", "page_interpretation", "", False, ""),
    ("classified", "what_to_enter", 0, "read", "what_to_enter", "", False, "en"),
    ("classified", "what_to_enter", 1, "pattern", "what_to_enter", "own", False, "other"),
    ("classified", "what_to_enter", 2, "pattern", "what_to_enter", "en", False, "other"),
    ("classified", "what_to_enter", 3, "message", "unavailable", "own", False, ""),
    ("classified", "simple_label", 0, "read", "simple_label", "", False, "en"),
    ("classified", "simple_label", 1, "field", "display_label", "", False, ""),
    ("classified", "simple_label", 2, "field", "label", "", False, ""),
    ("classified", "simple_label", 3, "literal", "Field", "", False, ""),
    ("classified", "source_reference", 0, "literal", "page_interpretation", "", False, ""),
    *[
        row
        for source in ("concept", "dictionary")
        for row in [
            (source, "simple_label", 0, "entry", "simple_label", "own", False, ""),
            (source, "simple_label", 1, "entry", "simple_label", "en", False, ""),
            (source, "simple_label", 2, "field", "label", "", False, ""),
            (source, "simple_label", 3, "field", "concept", "", False, ""),
            (source, "what_to_enter", 0, "entry", "what_to_enter", "own", False, ""),
            (source, "what_to_enter", 1, "entry", "what_to_enter", "en", False, ""),
            (source, "what_to_enter", 2, "message", "unavailable", "own", False, ""),
            (source, "why_needed", 0, "entry", "why_needed", "own", False, ""),
            (source, "why_needed", 1, "entry", "why_needed", "en", False, ""),
            (source, "example", 0, "entry", "example", "own", False, ""),
            (source, "example", 1, "entry", "example", "", False, ""),
            (source, "format_hint", 0, "entry", "format_hint", "own", False, ""),
            (source, "format_hint", 1, "entry", "format_hint", "en", False, ""),
            (source, "format_hint", 2, "entry", "format", "", False, ""),
            (source, "source_reference", 0, "entry", "source_reference", "", False, ""),
            (source, "source_reference", 1, "field", "concept", "", False, ""),
        ]
    ],
    ("retrieved", "simple_label", 0, "hit", "simple_label", "own", False, ""),
    ("retrieved", "simple_label", 1, "field", "label", "", False, ""),
    ("retrieved", "simple_label", 2, "field", "concept", "", False, ""),
    ("retrieved", "simple_label", 3, "literal", "Field", "", False, ""),
    ("retrieved", "what_to_enter", 0, "hit", "what_to_enter", "own", False, ""),
    ("retrieved", "what_to_enter", 1, "message", "unavailable", "own", False, ""),
    ("retrieved", "why_needed", 0, "hit", "why_needed", "own", False, ""),
    ("retrieved", "example", 0, "hit", "example", "own", False, ""),
    ("retrieved", "source_reference", 0, "hit", "source_reference", "own", False, ""),
    ("model", "what_to_enter", 0, "ai", "what_to_enter", "own", False, ""),
    ("model", "simple_label", 0, "ai", "simple_label", "own", False, ""),
    ("model", "simple_label", 1, "field", "label", "", False, ""),
    ("model", "why_needed", 0, "ai", "why_needed", "own", False, ""),
    ("model", "example", 0, "ai", "example", "own", False, ""),
    ("model", "format_hint", 0, "ai", "format_hint", "own", False, ""),
    ("model", "source_reference", 0, "literal", "groq", "", False, ""),
    ("pattern", "what_to_enter", 0, "pattern", "what_to_enter", "own", False, ""),
    ("pattern", "what_to_enter", 1, "pattern", "what_to_enter", "en", False, ""),
    ("pattern", "what_to_enter", 2, "message", "unavailable", "own", False, ""),
    ("pattern", "note", 0, "message", "note", "own", False, ""),
    ("pattern", "simple_label", 0, "field", "label", "", False, ""),
    ("pattern", "simple_label", 1, "pattern", "id", "", False, ""),
    ("pattern", "format_hint", 0, "pattern", "format_hint", "own", False, ""),
    ("pattern", "format_hint", 1, "pattern", "format_hint", "en", False, ""),
    ("pattern", "source_reference", 0, "pattern", "source_reference", "", False, ""),
    ("unavailable", "what_to_enter", 0, "message", "unavailable", "own", False, ""),
    ("unlabelled", "what_to_enter", 0, "message", "unlabelled", "own", False, ""),
    *[(source, "simple_label", step, origin, of, "", False, "") for source in ("unavailable", "unlabelled") for step, origin, of in ((0, "field", "label"), (1, "literal", "Field"))],
    *[(source, "notice", 0, "message", "verify_notice", "own", False, "") for source in ("interpreted", "classified", "concept", "dictionary", "retrieved", "model", "pattern")],
]
_KIND = "source string, part string, step int, origin string, of string, tongue string, checked boolean, reader string"


def best_per_language(hits: DataFrame, key: str, languages: list[str], known: Column) -> DataFrame:
    """key, language, of, chunk, score: each language's best hit (columns language, chunk, score), that of the first language with one for languages without, and the best score of all.

    Only scores of ``LEAST`` for known forms and ``LEAST_UNKNOWN`` for unknown ones count, and only a language's best hit is looked at; ties go to the smaller chunk. Keys without any are absent.
    """
    order = F.array(*map(F.lit, languages))
    asked = hits.where(F.col("language").isin(*languages)).withColumn("_r", F.row_number().over(Window.partitionBy(key, "language").orderBy(F.desc_nulls_last("score"), "chunk")))
    best = asked.where((F.col("_r") == 1) & (F.col("score") >= F.when(known, LEAST).otherwise(max(LEAST, LEAST_UNKNOWN))))
    held = F.array_sort(F.collect_list(F.struct(F.array_position(order, F.col("language")).alias("at"), F.col("language").alias("of"), "chunk", "score")))
    fields = best.groupBy(key).agg(held.alias("held"), F.max("score").alias("score"))
    own = lambda lang: F.coalesce(F.get(F.filter("held", lambda h: h["of"] == lang), F.lit(0)), F.get("held", F.lit(0)))
    each = fields.select(key, "score", "held", F.explode(order).alias("language"))
    return each.withColumn("_h", own(F.col("language"))).select(key, "language", "_h.of", "_h.chunk", "score")


def bundle(resolved: DataFrame, texts: DataFrame, messages: DataFrame, languages: list[str], key: str = "field") -> DataFrame:
    """One row for each field and language: key, language, source, the parts of the answer, confidence, verify, inferred, bundle_source.

    ``resolved``: key, source, score, label, display_label, concept: one row a field. ``texts``: key, origin, part, language (empty: of none), text. ``messages``: key, language, message. A model's or page's
    answer that is missing in a language is unavailable there, not shown in another; a field without label and source is unlabelled. Parts without any text are null. Blank texts are none; of
    repeated texts the smallest counts. Fields and texts meet by field; the rules and messages are sent to the tasks.
    """
    spark = resolved.sparkSession
    full = texts.where(blank_to_null(F.col("text")).isNotNull()).select(key, F.col("origin").alias("_origin"), F.col("part").alias("_of"), F.coalesce("language", F.lit("")).alias("_tongue"), F.trim("text").alias("_text"))
    # texts that no chain asks for go before any are moved
    asked = spark.createDataFrame(sorted({(row[3], row[4], t) for row in CHAINS for t in (languages if row[5] == "own" else [row[5]])}), "_origin string, _of string, _tongue string")
    full = full.join(F.broadcast(asked), ["_origin", "_of", "_tongue"], "left_semi")
    # dealt before they are grouped: a scan's task, whose few bytes can stand for many texts, keeps no groups
    full = full.repartition(key).groupBy(key, "_origin", "_of", "_tongue").agg(F.min("_text").alias("_text"))
    spoken = full.where((F.col("_of") == "what_to_enter") & F.col("_origin").isin("page", "ai")).select(key, F.col("_tongue").alias("language"), F.when(F.col("_origin") == "page", "interpreted").otherwise("model").alias("source"), F.lit(True).alias("_spoken"))
    wanted = resolved.select(key, F.col("source").alias("bundle_source"), "source", "score", "label", "display_label", "concept", F.explode(F.array(*map(F.lit, languages))).alias("language"))
    wanted = wanted.join(spoken, [key, "language", "source"], "left")
    wanted = wanted.withColumn("_silent", F.col("source").isin("interpreted", "model") & F.col("_spoken").isNull())
    wanted = wanted.withColumn("source", F.when(F.col("_silent"), "unavailable").otherwise(F.col("source")))
    unlabelled = (F.col("source") == "unavailable") & ~F.col("_silent") & blank_to_null(F.col("label")).isNull()
    wanted = wanted.withColumn("_chain", F.when(unlabelled, "unlabelled").otherwise(F.col("source")))
    rules = F.broadcast(spark.createDataFrame(CHAINS, _KIND).withColumnRenamed("source", "_chain"))
    steps = wanted.join(rules, "_chain").where((F.col("reader") == "") | ((F.col("reader") == "en") == (F.col("language") == "en")))
    steps = steps.withColumn("tongue", F.when(F.col("tongue") == "own", F.col("language")).otherwise(F.col("tongue")))
    own = F.when(F.col("_of") == "label", F.col("label")).when(F.col("_of") == "display_label", F.col("display_label")).otherwise(F.col("concept").cast("string"))
    free = F.when(F.col("_origin") == "literal", F.col("_of")).when(F.col("_origin") == "field", own)
    told = messages.where(blank_to_null(F.col("message")).isNotNull()).groupBy(F.col("key").alias("_of")).agg(F.map_from_entries(F.collect_set(F.struct("language", "message"))).alias("_said"))
    steps = steps.withColumnsRenamed({"origin": "_origin", "of": "_of", "tongue": "_tongue"})
    found = steps.join(full, [key, "_origin", "_of", "_tongue"], "left").join(F.broadcast(told), "_of", "left")
    said = F.coalesce(F.col("_said")[F.col("language")], F.col("_said")["en"])
    text = F.coalesce(free, F.when(F.col("_origin") == "message", said), F.col("_text"))
    fits = lambda t: F.when((t != "") & (~F.col("checked") | in_script(t, F.col("language"))), t)
    # a filter on this column would compute it again: steps without a usable text have no place instead
    usable = found.withColumn("_said_text", bound(F.trim(text), fits))
    part = lambda p: F.min_by("_said_text", F.when((F.col("part") == p) & F.col("_said_text").isNotNull(), F.col("step"))).alias(p)
    parts = usable.groupBy(key, "language").agg(*map(part, PARTS))
    out = wanted.join(parts, [key, "language"], "left").withColumn("what_to_enter", F.trim(F.concat_ws(" ", "what_to_enter", "note")))
    return out.select(key, "language", "source", *PARTS[:-1], resolve.confidence(F.col("source"), F.col("score")).alias("confidence"), resolve.verify(F.col("source"), F.col("score")).alias("verify"), F.col("source").isin(*INFERRED).alias("inferred"), "bundle_source")


def bundle_totals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, languages, score (the best confidence), llm_used (whether a model's answer is shown in any language) and unavailable (languages without answer) of the rows of :func:`bundle`."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("languages"), F.max("confidence").alias("score"), F.max(F.col("bundle_source") == "model").alias("llm_used"), F.count(F.when(F.col("source") == "unavailable", 1)).alias("unavailable"))
