"""Queries of guidance in all languages, over parts as fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bundle
from .registry import query, view

_LANGUAGES = ["en", "hi", "kn"]
_FIELDS = """SELECT p_partkey AS field, CASE p_partkey % 9 WHEN 0 THEN 'known' WHEN 1 THEN 'interpreted' WHEN 2 THEN 'concept' WHEN 3 THEN 'classified' WHEN 4 THEN 'dictionary' WHEN 5 THEN 'retrieved' WHEN 6 THEN 'model' WHEN 7 THEN 'pattern' ELSE 'unavailable' END AS source, CAST(p_size AS DOUBLE) / 50 AS score,
CASE p_partkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN p_name ELSE p_brand END AS label, CASE WHEN p_partkey % 5 = 0 THEN p_type END AS display_label, CASE WHEN p_partkey % 3 > 0 THEN concat('c', p_partkey) END AS concept FROM <part>"""
_TEXTS = """SELECT p_partkey AS field, origin, part, language, CASE (p_partkey * 7 + length(origin) * 5 + length(part) * 3 + length(language) * 11 + CASE language WHEN 'hi' THEN 1 WHEN 'kn' THEN 2 ELSE 0 END) % 7 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN 'पूरा नाम लिखें' WHEN 3 THEN 'ಹೆಸರು ಬರೆಯಿರಿ' WHEN 4 THEN concat('write ', p_name) ELSE concat(CASE language WHEN 'hi' THEN 'नाम ' WHEN 'kn' THEN 'ಹೆಸರು ' ELSE 'name ' END, part) END AS text
FROM <part> CROSS JOIN (VALUES ('kb'), ('entry'), ('page'), ('read'), ('pattern'), ('hit'), ('ai')) AS o(origin) CROSS JOIN (VALUES ('simple_label'), ('what_to_enter'), ('why_needed'), ('example'), ('format_hint'), ('format'), ('source_reference'), ('id')) AS q(part) CROSS JOIN (VALUES ('en'), ('hi'), ('kn'), ('')) AS l(language)"""
_MESSAGES = "SELECT key, language, message FROM (VALUES ('unavailable', 'en', 'No guidance'), ('unavailable', 'hi', 'मार्गदर्शन नहीं'), ('unlabelled', 'en', 'No label was read'), ('verify_notice', 'en', 'Please check'), ('verify_notice', 'kn', 'ಪರಿಶೀಲಿಸಿ'), ('verify_notice', 'hi', ' '), ('note', 'en', 'This is a guess'), ('note', 'hi', 'यह अनुमान है')) AS m(key, language, message)"""


def _text(origin: str, part: str, language: str, checked: bool = False) -> str:
    place = {"own": "lang", "en": "'en'", "": "''"}[language]
    found = f"t['{origin}|{part}|' || {place}]"
    return f"CASE WHEN regexp_matches({found}, letters) AND ({found} <> '') THEN {found} END" if checked else found


def _first(*steps: str) -> str:
    return "coalesce(" + ", ".join(steps) + ", NULL)"


_LABEL, _DISPLAY, _CONCEPT = "nullif(trim(label), '')", "nullif(trim(display_label), '')", "concept"
_NONE, _BARE, _NOTICE, _NOTE = (f"coalesce(m['{k}|' || lang], m['{k}|en'])" for k in ("unavailable", "unlabelled", "verify_notice", "note"))


def _entry(part: str) -> list[str]:
    return [_text("entry", part, "own"), _text("entry", part, "en")]


_ENTRY = {
    "simple_label": _first(*_entry("simple_label"), _LABEL, _CONCEPT),
    "what_to_enter": _first(*_entry("what_to_enter"), _NONE),
    "why_needed": _first(*_entry("why_needed")),
    "example": _first(_text("entry", "example", "own"), _text("entry", "example", "")),
    "format_hint": _first(*_entry("format_hint"), _text("entry", "format", "")),
    "source_reference": _first(_text("entry", "source_reference", ""), _CONCEPT),
    "notice": _NOTICE,
}


def _known(part: str, *rest: str) -> str:
    return _first(_text("kb", part, "own", True), _text("entry", part, "own", True), _text("kb", part, "own"), *rest)


_SAYS = {
    "known": {
        "simple_label": _known("simple_label", _LABEL, _CONCEPT), "what_to_enter": _known("what_to_enter", _text("kb", "what_to_enter", "en"), _NONE), "why_needed": _known("why_needed", _text("kb", "why_needed", "en")),
        "example": f"""coalesce({_text("kb", "example", "", True)}, CASE WHEN lang = 'en' THEN coalesce({_text("entry", "example", "own")}, {_text("entry", "example", "")}) ELSE coalesce({_text("entry", "example", "own", True)}, {_text("entry", "example", "", True)}) END, {_text("kb", "example", "")})""",
        "format_hint": _text("kb", "format", ""), "source_reference": _text("kb", "source_reference", ""), "notice": "NULL",
    },
    "interpreted": {"simple_label": _first(_text("page", "simple_label", "own"), _DISPLAY, _LABEL, "'Field'"), "what_to_enter": _text("page", "what_to_enter", "own"), "why_needed": _text("page", "why_needed", "own"), "example": _first(_text("page", "example", "own"), _text("page", "example", "en")), "format_hint": _text("page", "format_hint", "own"), "source_reference": "'page_interpretation'", "notice": _NOTICE},
    "concept": _ENTRY,
    "dictionary": _ENTRY,
    "classified": {
        "simple_label": f"coalesce(CASE WHEN lang = 'en' THEN {_text('read', 'simple_label', '')} END, {_DISPLAY}, {_LABEL}, 'Field')",
        "what_to_enter": f"coalesce(CASE WHEN lang = 'en' THEN {_text('read', 'what_to_enter', '')} ELSE coalesce({_text('pattern', 'what_to_enter', 'own')}, {_text('pattern', 'what_to_enter', 'en')}) END, {_NONE})",
        "why_needed": "NULL", "example": "NULL", "format_hint": "NULL", "source_reference": "'page_interpretation'", "notice": _NOTICE,
    },
    "retrieved": {"simple_label": _first(_text("hit", "simple_label", "own"), _LABEL, _CONCEPT, "'Field'"), "what_to_enter": _first(_text("hit", "what_to_enter", "own"), _NONE), "why_needed": _text("hit", "why_needed", "own"), "example": _text("hit", "example", "own"), "format_hint": "NULL", "source_reference": _text("hit", "source_reference", "own"), "notice": _NOTICE},
    "model": {"simple_label": _first(_text("ai", "simple_label", "own"), _LABEL), "what_to_enter": _text("ai", "what_to_enter", "own"), "why_needed": _text("ai", "why_needed", "own"), "example": _text("ai", "example", "own"), "format_hint": _text("ai", "format_hint", "own"), "source_reference": "'groq'", "notice": _NOTICE},
    "pattern": {
        "simple_label": _first(_LABEL, _text("pattern", "id", "")), "what_to_enter": f"concat_ws(' ', coalesce({_text('pattern', 'what_to_enter', 'own')}, {_text('pattern', 'what_to_enter', 'en')}, {_NONE}), {_NOTE})",
        "why_needed": "NULL", "example": "NULL", "format_hint": _first(_text("pattern", "format_hint", "own"), _text("pattern", "format_hint", "en")), "source_reference": _text("pattern", "source_reference", ""), "notice": _NOTICE,
    },
    "unavailable": {"simple_label": _first(_LABEL, "'Field'"), "what_to_enter": f"CASE WHEN silent OR {_LABEL} IS NOT NULL THEN {_NONE} ELSE {_BARE} END", "why_needed": "NULL", "example": "NULL", "format_hint": "NULL", "source_reference": "NULL", "notice": "NULL"},
}


def _part(part: str) -> str:
    return "CASE source " + " ".join(f"WHEN '{s}' THEN {says[part]}" for s, says in _SAYS.items()) + f" END AS {part}"


_C = "CASE WHEN score = 0 THEN 0.5 ELSE score END"
_ROWS_SQL = f"""WITH t AS (SELECT field, map(list(k ORDER BY k), list(x ORDER BY k)) AS t FROM (SELECT field, concat(origin, '|', part, '|', language) AS k, min(trim(text)) AS x FROM ({_TEXTS}) WHERE trim(text) <> '' GROUP BY field, k) GROUP BY field),
m AS (SELECT map(list(concat(key, '|', language) ORDER BY key, language), list(message ORDER BY key, language)) AS m FROM ({_MESSAGES}) WHERE trim(message) <> ''),
f AS (SELECT f.*, lang, t, m, CASE lang WHEN 'en' THEN '[A-Za-z]' WHEN 'hi' THEN '[ऀ-ॿ]' ELSE '[ಀ-೿]' END AS letters, source AS bundle_source FROM ({_FIELDS}) f CROSS JOIN (VALUES ('en'), ('hi'), ('kn')) AS l(lang) CROSS JOIN m LEFT JOIN t USING (field)),
s AS (SELECT * EXCLUDE (source), CASE source WHEN 'interpreted' THEN t['page|what_to_enter|' || lang] IS NULL WHEN 'model' THEN t['ai|what_to_enter|' || lang] IS NULL ELSE false END AS silent, CASE WHEN silent THEN 'unavailable' ELSE source END AS source FROM f),
r AS (SELECT field, lang AS language, source, {", ".join(map(_part, bundle.PARTS[:-1]))}, CAST(round(CASE source WHEN 'known' THEN 0.93 WHEN 'interpreted' THEN least(0.88, 0.45 + 0.45 * {_C}) WHEN 'concept' THEN least(0.9, 0.5 + 0.4 * {_C}) WHEN 'classified' THEN least(0.8, 0.4 + 0.4 * {_C}) WHEN 'dictionary' THEN least(0.92, 0.55 + 0.37 * {_C}) WHEN 'retrieved' THEN least(0.84, 0.5 + {_C} / 2)
WHEN 'model' THEN 0.58 WHEN 'pattern' THEN least(0.6, 0.35 + 0.3 * {_C}) ELSE 0.2 END, 3) AS DOUBLE) AS confidence, CASE source WHEN 'known' THEN false WHEN 'concept' THEN round(least(0.9, 0.5 + 0.4 * {_C}), 3) < 0.8 WHEN 'dictionary' THEN {_C} < <confident> ELSE true END AS verify, source IN ('classified', 'model', 'pattern') AS inferred, bundle_source FROM s)"""
_ROWS_SQL = _ROWS_SQL.replace("<confident>", str(bundle.resolve.CONFIDENT))


def _bundle(spark, sf_dir):
    return bundle.bundle(view(spark, sf_dir, _FIELDS), view(spark, sf_dir, _TEXTS), view(spark, sf_dir, _MESSAGES), _LANGUAGES)


@query(f"{_ROWS_SQL} SELECT * FROM r")
def guidance_bundle(spark, sf_dir):
    """Each field's answer in three languages, by the chain of its source."""
    return _bundle(spark, sf_dir)


@query(f"{_ROWS_SQL} SELECT field, count(*) AS languages, max(confidence) AS score, bool_or(bundle_source = 'model') AS llm_used, count(*) FILTER (source = 'unavailable') AS unavailable FROM r GROUP BY field")
def bundle_totals(spark, sf_dir):
    return bundle.bundle_totals(_bundle(spark, sf_dir), ["field"])


_HITS = "SELECT p_partkey % 300 AS field, CASE p_partkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'hi' WHEN 2 THEN 'kn' ELSE 'fr' END AS language, p_partkey AS chunk, CAST(p_size AS DOUBLE) / 50 AS score, p_partkey % 300 % 2 = 0 AS known FROM <part>"


@query(
    f"""WITH b AS (SELECT * FROM ({_HITS}) WHERE language <> 'fr' QUALIFY row_number() OVER (PARTITION BY field, language ORDER BY score DESC, chunk) = 1), k AS (SELECT * FROM b WHERE score >= CASE WHEN known THEN 0.35 ELSE 0.62 END),
a AS (SELECT field, max(score) AS score, arg_min(language, list_position(['en', 'hi', 'kn'], language)) AS first FROM k GROUP BY field)
SELECT a.field, l.language, k.language AS of, k.chunk, a.score FROM a CROSS JOIN (VALUES ('en'), ('hi'), ('kn')) AS l(language) JOIN k ON k.field = a.field AND k.language = CASE WHEN EXISTS (SELECT 1 FROM k o WHERE o.field = a.field AND o.language = l.language) THEN l.language ELSE a.first END"""
)
def retrieved_languages(spark, sf_dir):
    """Each language's best retrieved text that is good enough, or the first language's."""
    return bundle.best_per_language(view(spark, sf_dir, _HITS), "field", _LANGUAGES, F.col("known"))
