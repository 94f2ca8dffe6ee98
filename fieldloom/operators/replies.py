"""Replies of language models as a table: parsing, checking against what was asked, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LANGUAGES, blank_to_null, dominant_script

# Kinds of answers a reply may name, who may fill a field, words that mean no concept, and scripts that languages share.
KINDS = ["text", "multiline", "person_name", "date", "integer", "decimal", "amount", "year", "mobile_in", "phone", "pincode_in", "aadhaar_in", "pan_in", "ifsc_in", "bank_account", "email", "alphanumeric", "choice", "signature", "attachment", "office_use"]
FILLED_BY = ["applicant", "office", "either"]
NO_CONCEPT = ["", "null", "none", "unknown"]
SCRIPT_OF = {lang: script for script, lang in LANGUAGES.items()} | {"mr": "devanagari", "as": "bengali"}

FIELD = "id string, is_field boolean, concept string, fill_by string, needs_detail boolean, label string, what_to_enter map<string,string>, validation string, confidence string"


def json_part(raw: Column) -> Column:
    """From the first brace to the last; the whole text where there is none."""
    part = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    return F.when(part != "", part).otherwise(raw)


def bounded(confidence: Column) -> Column:
    """Between 0 and 1; what is no number counts as one half."""
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence.try_cast("double"))), F.lit(0.5))


def parsed(replies: DataFrame, asked: DataFrame, concepts: DataFrame, batch: str = "batch") -> DataFrame:
    """batch, id, concept, fill_by, validation, confidence, label, texts: the fields of readable replies that were asked for.

    ``replies``: batch, raw. ``asked``: batch, id. ``concepts``: entry_id. Unknown kinds become text, unknown fillers the applicant, unknown concepts null;
    fields that the reply calls none are left out, and of a field's texts those in a wrong script.
    """
    body = F.from_json(json_part(F.col("raw")), f"fields array<struct<{', '.join(c.strip().replace(' ', ':', 1) for c in _columns(FIELD))}>>")
    rows = replies.select(batch, F.explode(body["fields"]).alias("f")).select(batch, "f.*").where(F.coalesce("is_field", F.lit(True)))
    rows = rows.join(asked.select(batch, "id").distinct(), [batch, "id"], "left_semi")
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    named = F.when(~low(F.col("concept")).isin(*NO_CONCEPT), F.col("concept"))
    known = concepts.select(F.col("entry_id").alias("_concept")).distinct()
    rows = rows.withColumn("_named", named).join(known, F.col("_named") == F.col("_concept"), "left")
    fill = F.when(low(F.col("fill_by")).isin(*FILLED_BY), low(F.col("fill_by"))).otherwise("applicant")
    kind = F.when(low(F.col("validation")).isin(*KINDS), low(F.col("validation"))).otherwise("text")
    return rows.select(batch, "id", F.col("_concept").alias("concept"), fill.alias("fill_by"), kind.alias("validation"), bounded(F.col("confidence")).alias("confidence"), "label", native(F.col("what_to_enter")).alias("texts"))


def _columns(ddl: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[start:i])
            start = i + 1
    return out


def native(texts: Column) -> Column:
    """Of a map from language to text the entries written in the language's script; null where none is left."""
    scripts = F.create_map(*[F.lit(x) for pair in SCRIPT_OF.items() for x in pair])
    kept = F.map_filter(texts, lambda lang, t: blank_to_null(t).isNotNull() & F.coalesce(dominant_script(t) == F.element_at(scripts, lang), F.lit(False)))
    kept = F.transform_values(kept, lambda _, t: F.trim(t))
    return F.when(F.size(kept) > 0, kept)


def restricted(texts: Column, to: Column) -> Column:
    """Entries of a map whose keys another one has, too."""
    return F.map_filter(texts, lambda lang, _: F.map_contains_key(to, lang))


def glossary(raw: Column) -> Column:
    """A glossary given as JSON object or as a list of objects (term and meaning, or other names of these), as a map."""
    of = F.from_json(raw, "map<string,string>")
    listed = F.from_json(raw, "array<map<string,string>>")
    first = lambda m, names: F.coalesce(*[blank_to_null(F.element_at(m, n)) for n in names])
    pairs = F.transform(listed, lambda m: F.struct(first(m, ["term", "abbreviation", "name"]).alias("term"), first(m, ["meaning", "expansion", "definition"]).alias("meaning")))
    good = F.filter(pairs, lambda p: p["term"].isNotNull() & p["meaning"].isNotNull())
    # of terms given twice the last counts
    last = F.filter(good, lambda p, i: ~F.exists(F.slice(good, i + 2, 1 << 30), lambda q: q["term"] == p["term"]))
    return F.when(F.trim(raw).startswith("["), F.map_from_entries(last)).when(F.trim(raw).startswith("{"), of)


def merged_glossary(paper: Column, web: Column) -> Column:
    """Terms of both; the paper's meaning stands."""
    empty = F.create_map().cast("map<string,string>")
    paper, web = F.coalesce(paper, empty), F.coalesce(web, empty)
    return F.map_concat(paper, F.map_filter(web, lambda k, _: ~F.map_contains_key(paper, k)))


def briefing(title: Column, authority: Column, purpose: Column, terms: Column, notes: Column) -> Column:
    """Lines that sum a form up: what is known of it, its first 20 terms in their order and its first 6 notes."""
    line = lambda head, c: F.when(blank_to_null(c).isNotNull(), F.concat(F.lit(head), c))
    listed = F.array_join(F.transform(F.slice(terms, 1, 20), lambda t: F.concat(t["term"], F.lit(" = "), t["meaning"])), "; ")
    parts = F.concat(F.array(line("Form: ", title), line("Issued by: ", authority), line("Purpose: ", purpose), line("Abbreviations used on this form: ", listed)), F.transform(F.slice(notes, 1, 6), lambda n: line("Instruction: ", n)))
    return F.array_join(F.filter(parts, lambda p: p.isNotNull()), "\n")


def cache_key(*parts: Column) -> Column:
    """Digest of a request: equal parts in equal order give an equal key; null is told from the empty text."""
    return F.sha2(F.to_json(F.struct(*[F.coalesce(F.to_json(F.struct(p.alias("v"))), F.lit("null")).alias(f"p{i}") for i, p in enumerate(parts)])), 256)


def flat_metadata(fields: dict[str, Column], lists: dict[str, Column]) -> Column:
    """Map of scalars as text and lists joined by commas; nulls are left out."""
    pairs = [(k, c.cast("string")) for k, c in fields.items()] + [(k, F.array_join(c, ", ")) for k, c in lists.items()]
    return F.map_filter(F.create_map(*[x for k, c in pairs for x in (F.lit(k), c)]), lambda _, v: v.isNotNull())


def filled_languages(texts: Column, languages: list[str], fallback: str = "en") -> Column:
    """A map with all languages: missing and blank ones get the fallback's text, or the empty one."""
    other = F.coalesce(blank_to_null(F.element_at(texts, fallback)), F.lit(""))
    return F.create_map(*[x for lang in languages for x in (F.lit(lang), F.coalesce(blank_to_null(F.element_at(texts, lang)), other))])


def local_text(texts: Column, lang: Column, fallback: str = "en") -> Column:
    return F.coalesce(blank_to_null(F.element_at(texts, lang)), blank_to_null(F.element_at(texts, fallback)), F.lit(""))
