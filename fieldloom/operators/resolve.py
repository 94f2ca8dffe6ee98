"""Labels to dictionary entries, ladders of sources, messages with fallback."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.facts import OTHER_PERSONS, age
from ..functions.fields import field_type_for
from ..functions.text import blank_to_null, match_tokens
from .work import computed

CONFIDENT = 0.74
LEAST = 0.52


@F.pandas_udf(DoubleType())
def token_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib ratio of two tokens. A helper for pairs that blocking has made few."""
    return pd.Series([1.0 if x == y else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def similar_tokens(labels: DataFrame, known: DataFrame, least: float, most_off: int) -> DataFrame:
    """a, b, r: distinct tokens of ``labels`` (a) and of a dictionary (b) whose ratio is ``least`` or more; their lengths differ by ``most_off`` at most.

    They meet on length; the ratio can't reach ``least`` where too many letters of one are not in the other, so such pairs are not compared.
    """
    left = labels.select("a").distinct().withColumn("n", F.explode(F.sequence(F.length("a") - most_off, F.length("a") + most_off)))
    met = left.join(known.select("b").distinct().withColumn("n", F.length("b")), "n")
    chars = lambda c: F.array_distinct(F.split(c, ""))
    shared = F.least(F.length("a") - F.size(F.array_except(chars("a"), chars("b"))), F.length("b") - F.size(F.array_except(chars("b"), chars("a"))))
    met = met.where(2 * shared >= least * (F.length("a") + F.length("b")))
    return met.select("a", "b", token_similarity("a", "b").alias("r")).where(F.col("r") >= least)


def _padded(tokens: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))


def _worded(own: DataFrame, known: DataFrame, fuzzy: bool) -> DataFrame:
    """id, ..., base, how: each label's tokens (lt) against each alias (at) by wording, the first layer that holds: equal, inside, around, alike."""
    sides = ["id", "lt", *known.columns]
    word = own.select("id", "lt", F.explode(F.array_distinct("lt")).alias("k"))
    first = known.withColumn("k", F.get("at", F.lit(0)))
    share = F.least(F.size("at") / F.size("lt"), F.lit(1.0))
    equal = own.withColumn("k", _padded(F.col("lt"))).join(known.withColumn("k", _padded(F.col("at"))), "k").select(*sides, F.lit(1.0).alias("base"), F.lit("exact").alias("how"))
    inside = word.join(first, "k").where((F.col("lt") != F.col("at")) & _padded(F.col("lt")).contains(_padded(F.col("at"))))
    weak = (F.size("at") == 1) & (F.size("lt") >= 2)
    inside = inside.select(*sides, F.when(weak, 0.5).otherwise(F.least(F.lit(0.95), 0.58 + 0.37 * share)).alias("base"), F.when(weak, "weak_token").otherwise("contains").alias("how"))
    around = own.where(F.size("lt") >= 2).withColumn("k", F.get("lt", F.lit(0))).join(known.withColumn("k", F.explode(F.array_distinct("at"))), "k")
    around = around.where((F.col("lt") != F.col("at")) & _padded(F.col("at")).contains(_padded(F.col("lt"))))
    out = equal.unionByName(inside).unionByName(around.select(*sides, F.lit(0.74).alias("base"), F.lit("contained_by").alias("how")))
    if fuzzy:
        lt, at = own.select("id", F.posexplode("lt").alias("p", "a")), known.select("entry_id", "pos", F.size("at").alias("m"), F.posexplode("at").alias("i", "b"))
        near = similar_tokens(lt, at, 0.72, 1).where((F.least(F.length("a"), F.length("b")) > 2) | (F.col("a") == F.col("b")))
        # a window of the label begins where the alias's first token would stand
        windows = lt.join(near, "a").join(at, "b").groupBy("id", "entry_id", "pos", "m", (F.col("p") - F.col("i")).alias("w")).agg(F.count(F.lit(1)).alias("held"), F.avg("r").alias("r"))
        best = windows.where("held = m AND r >= 0.8").groupBy("id", "entry_id", "pos").agg(F.max("r").alias("r"))
        alike = best.join(own, "id").join(known, ["entry_id", "pos"]).join(out.select("id", "entry_id", "pos").distinct(), ["id", "entry_id", "pos"], "left_anti")
        out = out.unionByName(alike.select(*sides, (0.58 + 0.14 * (F.col("r") - 0.8) / 0.2 + 0.04 * share).alias("base"), F.lit("fuzzy_tokens").alias("how")))
    return out


def _keyworded(own: DataFrame, keywords: DataFrame, fuzzy: bool) -> DataFrame:
    """id, entry_id, alias, at, base, how: each entry's first keyword whose tokens all stand in the label or, of one token, that resembles one of it."""
    known = keywords.select("entry_id", "pos", F.col("keyword").alias("alias"), match_tokens(F.col("keyword")).alias("at")).where(F.size("at") > 0)
    word = own.select("id", F.explode(F.array_distinct("lt")).alias("k"))
    parts = known.select("entry_id", "pos", "alias", "at", F.explode(F.array_distinct("at")).alias("k"))
    whole = word.join(parts, "k").groupBy("id", "entry_id", "pos", "alias", "at").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == F.size(F.array_distinct("at")))
    found = whole.select("id", "entry_id", "pos", "alias", "at", F.lit(0.56).alias("base"), F.lit("keyword").alias("how"))
    if fuzzy:
        one = parts.where(F.size("at") == 1)
        near = similar_tokens(word.select(F.col("k").alias("a")), one.select(F.col("k").alias("b")), 0.9, 8).where("a <> b")
        close = word.withColumnRenamed("k", "a").join(near, "a").join(one.withColumnRenamed("k", "b"), "b")
        found = found.unionByName(close.select("id", "entry_id", "pos", "alias", "at", F.lit(0.53).alias("base"), F.lit("keyword_fuzzy").alias("how")))
    first = F.min(F.struct("pos", (-F.col("base")).alias("less"), "alias", "at", "base", "how")).alias("x")
    return found.groupBy("id", "entry_id").agg(first).select("id", "entry_id", "x.alias", "x.at", "x.base", "x.how")


def resolve(labels: DataFrame, aliases: DataFrame, keywords: DataFrame | None = None, fuzzy: bool = True) -> DataFrame:
    """label, field_type, entry_id, alias, score, how, confident: the dictionary entry of each distinct label and type, none below ``LEAST``.

    ``labels``: label, field_type (null: unknown). ``aliases``: entry_id, ord (of entries), pos (of an entry's aliases), alias, priority, entry_type;
    ``keywords``: entry_id, pos, keyword. An alias scores by its wording: equal, inside the label, around it, or all its tokens alike one window of the
    label's (difflib 0.72 each, 0.8 on average). An entry scores by its best alias or else by its first keyword, times its priority, more or less by the type. Entries
    compete in their order: a score better by 0.02 wins, of nearer ones the alias of more tokens. A lone general word names no entry.
    Pairs come from joins on tokens and lengths, never from all labels with all aliases.
    """
    own = labels.select("label", "field_type").distinct().withColumn("lt", match_tokens(F.col("label"))).where(F.size("lt") > 0)
    # folded once: every layer below reads them, and each fold holds Python workers of its own
    own = computed(own.select(F.xxhash64("label", "field_type").alias("id"), "label", "field_type", "lt"))
    known = computed(aliases.select("entry_id", "pos", "alias", match_tokens(F.col("alias")).alias("at")).where(F.size("at") > 0))
    scored = _worded(own.select("id", "lt"), known, fuzzy)
    best = computed(scored.groupBy("id", "entry_id").agg(F.min(F.struct((-F.col("base")).alias("less"), "pos", "alias", "at", "base", "how")).alias("x")).select("id", "entry_id", "x.alias", "x.at", "x.base", "x.how"))
    if keywords is not None:
        more = _keyworded(own.select("id", "lt"), keywords, fuzzy)
        best = best.unionByName(more.join(best.select("id", "entry_id"), ["id", "entry_id"], "left_anti"))
    entries = aliases.groupBy("entry_id").agg(F.min("ord").alias("ord"), F.first("priority").alias("priority"), F.first("entry_type").alias("entry_type"))
    every = best.join(own.select("id", "label", "field_type"), "id").join(entries, "entry_id")
    every = every.withColumn("score", F.round(agreed(F.least(F.lit(1.0), F.col("base") * F.col("priority")), F.col("entry_type"), F.col("field_type")), 4))
    packed = F.array_sort(F.collect_list(F.struct("ord", "entry_id", "score", F.size("at").alias("n"), "alias", "how")))
    better = lambda held, c: F.when(F.abs(c["score"] - held["score"]) > 0.02, F.when(c["score"] > held["score"], c).otherwise(held)).when(c["n"] > held["n"], c).otherwise(held)
    won = every.groupBy("label", "field_type").agg(packed.alias("all")).withColumn("x", F.aggregate(F.slice("all", 2, 1 << 30), F.get("all", F.lit(0)), better)).select("label", "field_type", "x.entry_id", "x.alias", "x.score", "x.how")
    return won.where((F.col("score") >= LEAST) & (F.col("how") != "weak_token")).withColumn("confident", F.col("score") >= CONFIDENT)


def agreed(score: Column, entry_type: Column, field_type: Column) -> Column:
    """A score, more where the entry's type is the field's and less by how far they differ; an unknown type leaves it."""
    marks, written = ("checkbox", "radio"), ("text", "multiline", "date")
    entry = F.coalesce(entry_type, F.lit("text"))
    return (
        F.when(field_type.isNull(), score)
        .when(entry == field_type, F.least(F.lit(1.0), score + 0.04))
        .when(field_type.isin(*marks) != entry.isin(*marks), score - 0.08)
        .when(field_type.isin(*written) & entry.isin(*written), score - 0.01)
        .otherwise(score - 0.04)
    )


def match_pattern(labels: DataFrame, markers: DataFrame, fuzzy: bool = True) -> DataFrame:
    """label, pattern_id, marker, score: the kind of answer that a label's wording shows; ``markers``: pattern_id, ord, marker, weight. The first of the best wins."""
    own = labels.select("label").distinct().withColumn("lt", match_tokens(F.col("label"))).where(F.size("lt") > 0).select(F.xxhash64("label").alias("id"), "label", "lt")
    known = markers.select(F.col("pattern_id").alias("entry_id"), F.col("ord").alias("pos"), F.col("marker").alias("alias"), match_tokens(F.col("marker")).alias("at")).where(F.size("at") > 0)
    found = _worded(own.select("id", "lt"), known, False).where("how <> 'contained_by'")
    hit = F.when(F.col("how") == "exact", 0.72).otherwise(0.6 + 0.08 * F.least(F.size("at") / F.size("lt"), F.lit(1.0)))
    found = found.select("id", "entry_id", "pos", "alias", hit.alias("hit"))
    if fuzzy:
        word = own.select("id", F.explode(F.array_distinct("lt")).alias("a"))
        one = known.where(F.size("at") == 1).select("entry_id", "pos", "alias", F.get("at", F.lit(0)).alias("b"))
        close = word.join(similar_tokens(word, one, 0.9, 8).where("a <> b"), "a").join(one, "b").select("id", "entry_id", "pos", "alias", F.lit(0.52).alias("hit"))
        found = found.unionByName(close.join(found.select("id", "pos"), ["id", "pos"], "left_anti"))
    scored = found.join(markers.select(F.col("ord").alias("pos"), "weight"), "pos").withColumn("score", F.least(F.lit(0.9), F.col("hit") * F.col("weight")))
    first = scored.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("less"), "pos", "entry_id", "alias", "score")).alias("x"))
    return first.join(own, "id").select("label", F.col("x.entry_id").alias("pattern_id"), F.col("x.alias").alias("marker"), F.round("x.score", 4).alias("score"))


def with_semantics(found: DataFrame, resolved: DataFrame, patterns: DataFrame) -> DataFrame:
    """Fields (label, field_type) with semantic_id, pattern_id, semantic_score and semantic_source: those of the entry, else of the pattern."""
    r = resolved.select("label", F.col("field_type").alias("_type"), F.col("entry_id").alias("semantic_id"), F.col("score").alias("_rs"), "how")
    p = patterns.select("label", F.col("pattern_id").alias("_pattern"), F.col("score").alias("_ps"))
    out = found.join(r.withColumnRenamed("label", "_label"), (F.col("label") == F.col("_label")) & F.col("field_type").eqNullSafe(F.col("_type")), "left").drop("_label", "_type").join(p, "label", "left")
    known = F.col("semantic_id").isNotNull()
    return out.select(*found.columns, "semantic_id", F.when(~known, F.col("_pattern")).alias("pattern_id"), F.when(known, F.col("_rs")).otherwise(F.col("_ps")).alias("semantic_score"), F.when(known, F.col("how")).when(F.col("_pattern").isNotNull(), "label_pattern").alias("semantic_source"))


def classified(found: DataFrame, readings: DataFrame, entries: DataFrame, ident: str) -> DataFrame:
    """Fields as a reading of the page has them: its concept replaces theirs, or withdraws it where it has none; a concept that the dictionary lacks counts as none.

    ``found``: ident, label, field_type, semantic_id, pattern_id, kind. ``readings``: ident, label, fill_by, concept, confidence, validation. ``entries``: entry_id, entry_type, entry_kind.
    """
    r = readings.select(F.col(ident), F.col("label").alias("_label"), "fill_by", "concept", "confidence", "validation", F.lit(True).alias("_read"))
    out = found.join(r, ident, "left").join(entries.select(F.col("entry_id").alias("concept"), "entry_type", "entry_kind"), "concept", "left")
    read = F.coalesce(F.col("_read"), F.lit(False))
    concept = F.when(F.col("entry_type").isNotNull(), F.col("concept"))
    kind = F.when(F.col("validation") != "text", F.col("validation")).otherwise(F.coalesce("entry_kind", "kind"))
    return out.select(
        ident,
        F.when(read, F.coalesce(blank_to_null(F.col("_label")), "label")).otherwise(F.col("label")).alias("display_label"),
        F.when(read, F.coalesce("fill_by", F.lit("applicant"))).alias("filled_by"),
        F.when(read, concept).otherwise(F.col("semantic_id")).alias("semantic_id"),
        F.when(~read | concept.isNotNull(), F.col("pattern_id")).alias("pattern_id"),
        F.when(read & concept.isNotNull(), field_type_for(F.col("entry_type"), F.col("field_type"))).otherwise(F.col("field_type")).alias("field_type"),
        F.when(read, kind).otherwise(F.col("kind")).alias("kind"),
    )


def known_field(names: DataFrame, form_fields: DataFrame) -> DataFrame:
    """query, form_id, field_id, hits: the field of the form that shares most distinct names with the query, of equal ones the first.

    ``names``: query, form_id, name. ``form_fields``: form_id, field_id, ord, aliases; the field's id is a name too. Case doesn't count.
    """
    asked = names.select("query", "form_id", F.lower(F.trim("name")).alias("name")).where("name <> ''").distinct()
    own = form_fields.select("form_id", "field_id", "ord", F.explode(F.concat(F.array("field_id"), F.coalesce("aliases", F.array()))).alias("name")).select("form_id", "field_id", "ord", F.lower(F.trim("name")).alias("name")).distinct()
    hits = asked.join(own, ["form_id", "name"]).groupBy("query", "form_id", "field_id", "ord").agg(F.count(F.lit(1)).alias("hits"))
    best = F.min(F.struct((-F.col("hits")).alias("less"), "ord", "field_id", "hits")).alias("x")
    return hits.groupBy("query", "form_id").agg(best).select("query", "form_id", "x.field_id", "x.hits")


def placed_facts(facts: DataFrame, found: DataFrame, keys: list[str], order: list[str], ident: str, today: Column) -> DataFrame:
    """keys, ident, fact, value: each fact on the first field that means it, in order; the age follows from the date of birth.

    ``facts``: keys, fact, value. ``found``: keys, ident, known_id, semantic_id, label, field_type, filled_by. Office fields, marks and signatures take none, and a full name none
    that is another person's; a field so skipped leaves the fact for the next.
    """
    birth = facts.where("fact = 'date_of_birth'").select(*keys, F.lit("age").alias("fact"), age(F.col("value"), today).cast("string").alias("value"))
    have = facts.where("fact = 'age'").select(*keys, "fact")
    values = facts.select(*keys, "fact", "value").unionByName(birth.join(have, [*keys, "fact"], "left_anti").where("value IS NOT NULL"))
    usable = found.where(F.col("field_type").isin("text", "multiline", "date", "table_cell") & ~F.coalesce(F.col("filled_by") == "office", F.lit(False)))
    ids = F.filter(F.array("known_id", "semantic_id"), lambda x: x.isNotNull())
    offered = usable.select(*keys, ident, *order, F.lower(F.coalesce("label", F.lit(""))).alias("_label"), F.posexplode(ids).alias("_rank", "fact"))
    met = offered.join(values, [*keys, "fact"])
    # a field means the first of its ids that there is a fact for
    own = met.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, ident).orderBy("_rank"))).where("_r = 1")
    other = F.exists(F.array(*map(F.lit, OTHER_PERSONS)), lambda w: F.col("_label").contains(w))
    own = own.where(~((F.col("fact") == "full_name") & other))
    first = own.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "fact").orderBy(*order, ident))).where("_r = 1")
    return first.select(*keys, ident, "fact", "value")


def with_message(rows: DataFrame, messages: DataFrame, key: str, language: str, fallback: str = "en") -> DataFrame:
    """``rows`` with column message: that of the key in the row's language, else in ``fallback``, else empty."""
    own = messages.select(F.col("key").alias(key), F.col("language").alias(language), F.col("message").alias("_own"))
    other = messages.where(F.col("language") == fallback).select(F.col("key").alias(key), F.col("message").alias("_other"))
    found = rows.join(own, [key, language], "left").join(other, key, "left")
    return found.withColumn("message", F.coalesce(blank_to_null(F.col("_own")), blank_to_null(F.col("_other")), F.lit(""))).drop("_own", "_other")


def confidence(source: Column, score: Column) -> Column:
    """Confidence in an answer by its source; a score of 0 or none counts as one half."""
    c = F.when(score.isNull() | (score == 0), 0.5).otherwise(score)
    return F.round(
        F.when(source == "known", 0.93)
        .when(source == "interpreted", F.least(F.lit(0.88), 0.45 + 0.45 * c))
        .when(source == "concept", F.least(F.lit(0.9), 0.5 + 0.4 * c))
        .when(source == "classified", F.least(F.lit(0.8), 0.4 + 0.4 * c))
        .when(source == "dictionary", F.least(F.lit(0.92), 0.55 + 0.37 * c))
        .when(source == "retrieved", F.least(F.lit(0.84), 0.5 + c / 2))
        .when(source == "model", 0.58)
        .when(source == "pattern", F.least(F.lit(0.6), 0.35 + 0.3 * c))
        .otherwise(0.2),
        3,
    )


#: Sources of guidance, the first that has an answer wins.
LADDER = ["known", "interpreted", "concept", "classified", "dictionary", "retrieved", "model", "pattern"]


def verify(source: Column, score: Column) -> Column:
    """Whether an answer is shown with the advice to check it: never of known forms, of concepts below 0.8, of dictionary entries below ``CONFIDENT``, always of the rest."""
    c = F.when(score.isNull() | (score == 0), 0.5).otherwise(score)
    return F.when(source == "known", False).when(source == "concept", confidence(source, score) < 0.8).when(source == "dictionary", c < CONFIDENT).otherwise(True)


def ladder(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """keys, source, text, confidence, verify: of each key's candidates (source, score, text) the one of the highest rung with a text; without any: unavailable.

    Where the page was read without finding a concept (a candidate ``no_concept``), wordings of the dictionary, retrieval and models don't count.
    """
    rung = F.array_position(F.array(*map(F.lit, LADDER)), F.col("source"))
    usable = blank_to_null(F.col("text")).isNotNull() & (rung > 0)
    ranked = F.struct(rung.alias("rung"), (-F.coalesce("score", F.lit(0.0))).alias("less"), "source", "score", "text")
    lexical = F.col("source").isin("dictionary", "retrieved", "model")
    best = candidates.groupBy(*keys).agg(F.min(F.when(usable, ranked)).alias("any"), F.min(F.when(usable & ~lexical, ranked)).alias("read"), F.max(F.col("source") == "no_concept").alias("blocked"))
    best = best.withColumn("b", F.when(F.col("blocked"), F.col("read")).otherwise(F.col("any")))
    source = F.coalesce("b.source", F.lit("unavailable"))
    return best.select(*keys, source.alias("source"), F.col("b.text").alias("text"), confidence(source, F.col("b.score")).alias("confidence"), verify(source, F.col("b.score")).alias("verify"))


def rendered(answers: DataFrame, texts: DataFrame, key: str, language: str, scripts: Column) -> DataFrame:
    """``answers`` with text: that of the key in the language if it is written in the language's script, else any in that script, else English, else any.

    ``texts``: key, language, rank (of sources, best first), text. ``scripts``: whether a text (column text) is in the script of the answer's language.
    """
    pairs = answers.select(key, language).distinct().join(texts.select(key, F.col("language").alias("_language"), "rank", "text"), key)
    pairs = pairs.where(blank_to_null(F.col("text")).isNotNull())
    own = (F.col("_language") == F.col(language)) & scripts
    level = F.when(own, 0).when(scripts, 1).when(F.col("_language") == "en", 2).otherwise(3)
    best = pairs.groupBy(key, language).agg(F.min(F.struct(level.alias("level"), "rank", F.col("_language").alias("of"), "text")).alias("x"))
    return answers.join(best.select(key, language, F.col("x.text").alias("text"), F.col("x.of").alias("text_language")), [key, language], "left")
