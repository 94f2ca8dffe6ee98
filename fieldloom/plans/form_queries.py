"""Queries of fields, answers, wordings, facts, replies and keyed state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import facts, fields, text, validation
from ..operators import layout, replies, resolve, retrieval, tables
from ..sources import readers
from ..streaming import limits
from . import samples
from .registry import query, table, view

# ---- answers -----------------------------------------------------------------------------------

_FOLD = f"translate(trim(v), '{text.DIGITS}', '{'0123456789' * 4}')"
_DIGITS = f"regexp_replace({_FOLD}, '[^0-9]', '', 'g')"
_NUMBER = r"'(?i)[+-]?(nan|inf|infinity|([0-9]+(_[0-9]+)*(\.([0-9]+(_[0-9]+)*)?)?|\.[0-9]+(_[0-9]+)*)(e[+-]?[0-9]+(_[0-9]+)*)?)'"


def _number(value: str) -> str:
    return f"CASE WHEN regexp_full_match(trim({value}), {_NUMBER}) THEN try_cast(replace(trim({value}), '_', '') AS DOUBLE) END"


_MONEY = f"replace(replace(replace(replace({_FOLD}, ',', ''), '₹', ''), 'Rs.', ''), 'Rs', '')"
_RULES = {
    "date": "CASE " + " ".join(f"WHEN regexp_full_match({_FOLD}, '{shape}') THEN try_strptime({_FOLD}, '{form}') IS NOT NULL" for shape, form in [(r"\d{1,2}/\d{1,2}/\d{4}", "%d/%m/%Y"), (r"\d{1,2}-\d{1,2}-\d{4}", "%d-%m-%Y"), (r"\d{1,2}\.\d{1,2}\.\d{4}", "%d.%m.%Y"), (r"\d{4}-\d{1,2}-\d{1,2}", "%Y-%m-%d"), (r"\d{1,2}/\d{1,2}/\d{2}", "%d/%m/%y")]) + " ELSE false END",
    "integer": rf"regexp_full_match({_FOLD}, '\d+')",
    "decimal": f"({_number(f'replace({_FOLD}, {chr(39)},{chr(39)}, {chr(39)*2})')}) IS NOT NULL",
    "amount": f"coalesce(({_number(_MONEY)}) >= 0, false)",
    "year": rf"regexp_full_match({_FOLD}, '\d{{4}}')",
    "mobile_in": f"regexp_full_match(CASE WHEN length({_DIGITS}) = 12 AND {_DIGITS} LIKE '91%' THEN {_DIGITS}[3:] ELSE {_DIGITS} END, '[6-9][0-9]{{9}}')",
    "phone": f"length({_DIGITS}) BETWEEN 6 AND 15",
    "pincode_in": f"regexp_full_match({_DIGITS}, '[1-9][0-9]{{5}}')",
    "aadhaar_in": f"regexp_full_match({_DIGITS}, '[2-9][0-9]{{11}}')",
    "pan_in": "regexp_full_match(upper(replace(v, ' ', '')), '[A-Z]{5}[0-9]{4}[A-Z]')",
    "ifsc_in": "regexp_full_match(upper(replace(v, ' ', '')), '[A-Z]{4}0[A-Z0-9]{6}')",
    "bank_account": f"length({_DIGITS}) BETWEEN 8 AND 20",
    "email": r"regexp_full_match(trim(v), '[^@\s]+@[^@\s.]+\.[^@\s]{2,}')",
    "blood_group": "lower(replace(v, ' ', '')) IN ('a+', 'a-', 'b+', 'b-', 'ab+', 'ab-', 'o+', 'o-')",
    "alphanumeric": r"regexp_full_match(trim(v), '[A-Za-z0-9]([A-Za-z0-9/\s]|-)*')",
    "person_name": r"NOT regexp_matches(v, '[\p{Nd}@#$%^&*_=+<>{}|\\\[\]]') AND trim(v) <> ''",
}
_OK = f"coalesce(CASE kind {' '.join(f'''WHEN '{k}' THEN {r}''' for k, r in _RULES.items())} ELSE v IS NOT NULL END, false)"
_ANSWERS = f"""SELECT 'part' AS origin, 'person_name' AS kind, p_name AS v FROM part UNION ALL SELECT 'order', 'date', strftime(o_orderdate, '%d/%m/%Y') FROM orders
UNION ALL SELECT 'order', 'amount', CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) FROM orders UNION ALL SELECT 'sample', kind, v FROM ({samples.ANSWERS}) AS t(kind, v, low, high)"""


@query(f"SELECT origin, kind, v AS value, {_OK} AS ok FROM ({_ANSWERS})")
def validate_answers(spark, sf_dir):
    one = lambda t, origin, kind, v: table(spark, sf_dir, t).select(F.lit(origin).alias("origin"), F.lit(kind).alias("kind"), v.alias("value"))
    rows = one("part", "part", "person_name", F.col("p_name"))
    rows = rows.unionByName(one("orders", "order", "date", F.date_format("o_orderdate", "dd/MM/yyyy"))).unionByName(one("orders", "order", "amount", F.rint("o_totalprice").cast("long").cast("string")))
    rows = rows.unionByName(view(spark, sf_dir, f"SELECT 'sample' AS origin, kind, v AS value FROM ({samples.ANSWERS}) AS t(kind, v, low, high)"))
    return rows.select("origin", "kind", "value", (validation.valid(F.col("kind"), F.col("value")) & F.col("value").isNotNull()).alias("ok"))


_REPLIED = f"SELECT CAST(k AS INTEGER) AS k, kind, v, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high FROM ({samples.ANSWERS}) AS t(kind, v, low, high) CROSS JOIN (VALUES (0), (1), (2)) AS n(k)"


@query(
    f"""WITH a AS (SELECT *, coalesce(trim(v), '') = '' AND k < 2 AS blank, {_OK} AS valid, CASE kind WHEN 'integer' THEN {_number(_FOLD)} WHEN 'decimal' THEN {_number(f"replace({_FOLD}, ',', '')")} END AS n FROM ({_REPLIED}))
SELECT k, kind, v, CASE WHEN kind = 'signature' THEN true WHEN blank AND k = 0 THEN false WHEN blank OR kind IN ('choice', 'office_use') THEN true WHEN coalesce(length(v) > 12, false) THEN false WHEN kind = 'attachment' THEN true
WHEN NOT valid THEN false ELSE NOT coalesce(n < low, false) AND NOT coalesce(n > high, false) END AS ok,
CASE WHEN kind = 'signature' THEN 'sign_by_hand' WHEN blank AND k = 0 THEN 'required' WHEN blank OR kind = 'choice' THEN NULL WHEN kind = 'office_use' THEN 'office_use' WHEN coalesce(length(v) > 12, false) THEN 'too_long' WHEN kind = 'attachment' THEN 'attachment'
WHEN NOT valid THEN 'bad_' || kind WHEN coalesce(n < low, false) OR coalesce(n > high, false) THEN 'out_of_range' END AS code FROM a"""
)
def answer_verdicts(spark, sf_dir):
    """Answers as required (k 0), optional (1), and with an option chosen (2)."""
    rows = view(spark, sf_dir, _REPLIED)
    got = validation.verdict(F.col("kind"), F.col("v"), F.when(F.col("k") == 2, 1).otherwise(0), F.col("k") == 0, F.col("k") == 1, F.lit(12), F.col("low"), F.col("high"))
    return rows.select("k", "kind", "v", got["ok"].alias("ok"), got["code"].alias("code"))


# ---- fields ------------------------------------------------------------------------------------

_FIELDS = """SELECT l_orderkey AS doc, l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey AS id, CASE l_partkey % 7 WHEN 0 THEN 'text' WHEN 1 THEN 'multiline' WHEN 2 THEN 'date' WHEN 3 THEN 'checkbox' WHEN 4 THEN 'radio' WHEN 5 THEN 'signature' ELSE 'table_cell' END AS field_type,
CASE l_suppkey % 3 WHEN 0 THEN 'office' WHEN 1 THEN 'applicant' END AS filled_by, CASE l_partkey % 5 WHEN 0 THEN true WHEN 1 THEN false END AS optional, CASE l_suppkey % 11 WHEN 0 THEN 'office_use' ELSE 'text' END AS kind, CASE l_linenumber % 4 WHEN 0 THEN true WHEN 1 THEN false END AS given,
CASE l_partkey % 6 WHEN 0 THEN concat(p_name, ' *') WHEN 1 THEN concat(p_name, ' (Mandatory)') WHEN 2 THEN 'address of the ' || p_name WHEN 3 THEN 'date ' || p_name ELSE p_name END AS label, CASE l_suppkey % 4 WHEN 0 THEN 'must  fill' WHEN 1 THEN 'mandatoryish' END AS caption, l_discount AS tall,
CASE l_suppkey % 5 WHEN 0 THEN 'table' WHEN 1 THEN 'radio' WHEN 2 THEN 'date' WHEN 3 THEN 'unknown' ELSE 'multiline' END AS entry_type FROM <lineitem> JOIN <part> ON l_partkey = p_partkey"""
_MARKED = r"'(?i)[*＊✱⁎⋆★☆]|\b(required|mandatory|compulsory|must\s+fill|must\s+enter)\b'"
_APPLICANT = "(field_type <> 'signature' AND coalesce(filled_by, '') <> 'office' AND NOT coalesce(optional, false) AND kind <> 'office_use')"


@query(
    f"""WITH f AS ({_FIELDS}), e AS (SELECT *, {_APPLICANT} AS applicant, CASE WHEN entry_type = 'table' THEN 'table_cell' WHEN entry_type = 'unknown' THEN 'text' ELSE entry_type END AS entry FROM f)
SELECT doc, id, applicant, applicant AND CASE WHEN given OR regexp_matches(label, {_MARKED}) OR coalesce(regexp_matches(caption, {_MARKED}), false) THEN true ELSE coalesce(given, true) END AS required,
optional IS NULL OR coalesce(given, false) OR coalesce(filled_by <> 'applicant', false) AS describe, CASE WHEN field_type IN ('checkbox', 'radio') OR entry IN ('checkbox', 'radio') THEN field_type ELSE entry END AS chosen,
CASE WHEN regexp_matches(label, '\\bdate') THEN 'date' WHEN (contains(label, 'address') OR tall > 0.06) AND field_type NOT IN ('checkbox', 'radio', 'signature') THEN 'multiline' ELSE field_type END AS refined,
CASE field_type WHEN 'date' THEN 'date' WHEN 'multiline' THEN 'multiline' WHEN 'checkbox' THEN 'choice' WHEN 'radio' THEN 'choice' WHEN 'signature' THEN 'signature' ELSE 'text' END AS default_kind FROM e"""
)
def field_rules(spark, sf_dir):
    f = view(spark, sf_dir, _FIELDS)
    c = F.col
    applicant = fields.is_applicant_blank(c("field_type"), c("filled_by"), c("optional"), c("kind"))
    return f.select(
        "doc",
        "id",
        applicant.alias("applicant"),
        fields.required(applicant, c("given"), c("label"), c("caption")).alias("required"),
        fields.needs_description(F.lit(True), c("optional").cast("string"), c("given"), c("filled_by")).alias("describe"),
        fields.field_type_for(c("entry_type"), c("field_type")).alias("chosen"),
        fields.refined_type(c("label"), c("field_type"), c("tall")).alias("refined"),
        validation.default_kind(c("field_type")).alias("default_kind"),
    )


@query(
    f"""WITH f AS ({_FIELDS}), a AS (SELECT l_orderkey AS doc, l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey AS id, CASE WHEN l_returnflag = 'R' THEN ' ' ELSE l_returnflag END AS value FROM lineitem)
SELECT DISTINCT doc, id FROM f WHERE {_APPLICANT} AND NOT EXISTS (SELECT 1 FROM a WHERE a.doc = f.doc AND a.id = f.id AND trim(value) <> '')"""
)
def missing_required(spark, sf_dir):
    """Applicants' fields without an answer that is not blank."""
    f = view(spark, sf_dir, _FIELDS)
    answers = view(spark, sf_dir, "SELECT l_orderkey AS doc, l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey AS id, CASE WHEN l_returnflag = 'R' THEN ' ' ELSE l_returnflag END AS value FROM <lineitem>")
    c = F.col
    wanted = f.where(fields.is_applicant_blank(c("field_type"), c("filled_by"), c("optional"), c("kind"))).select("doc", "id").distinct()
    return tables.unanswered(wanted, answers, ["doc", "id"], "value")


_LINES = r"""SELECT doc_id AS id, substr(coalesce(text, ''), 1, 20 + doc_id % 60) AS label FROM <documents> UNION ALL SELECT 1000000 + p_partkey, CASE p_partkey % 6 WHEN 0 THEN concat(p_name, ':') WHEN 1 THEN concat(p_name, ' ......') WHEN 2 THEN concat(': ', p_name) WHEN 3 THEN concat(p_name, '|__') WHEN 4 THEN concat('..... ... (', p_name, ') of') ELSE p_type END FROM <part>"""
_BARE = "rtrim(regexp_replace(trim(label), '[.…·•_⋯‥]+$', ''))"


@query(
    rf"""WITH l AS (SELECT id, label, {_BARE} AS bare FROM ({_LINES})), r AS (SELECT *, regexp_extract_all(label, '[.…·•_⋯‥]{{3,}}') AS runs, regexp_extract_all(lower(label), '[a-z0-9]+') AS t,
nullif(rtrim(regexp_replace(rtrim(regexp_replace(trim(regexp_extract(label, '^[^(]{{0,80}}\(([^)]*)\)', 1)), '[.…·•_⋯‥]+$', '')), '[\s:：]+$', '')), '') AS hint FROM l)
SELECT id, nullif(trim(CASE WHEN bare LIKE '%:' THEN bare[:-2] WHEN bare LIKE ':%' THEN bare[2:] END), '') AS caption, (list_sort(list_filter(runs, lambda x: length(x) = list_max(list_transform(runs, lambda y: length(y))))))[1] AS leader,
CASE WHEN length(hint) BETWEEN 3 AND 80 AND len(list_filter(regexp_split_to_array(hint, '\s+'), lambda x: x <> '')) <= 12 THEN hint END AS hint
FROM r"""
)
def captions(spark, sf_dir):
    """What a line asks: caption with a colon, leader, and what stands in parentheses behind it."""
    label = F.col("label")
    return view(spark, sf_dir, _LINES).select("id", text.question_caption(label).alias("caption"), text.leader_run(label).alias("leader"), text.parenthetical_hint(label).alias("hint"))


@query(
    rf"""WITH l AS ({_LINES}) SELECT id, length(label) BETWEEN 3 AND 60 AND NOT contains(label, '|') AND length(label) - length(replace(label, '_', '')) <= 2
AND len(list_filter(regexp_extract_all(lower(strip_accents(label)), '[a-z0-9]+'), lambda t: length(t) >= 2)) > 0 AND NOT regexp_matches(regexp_replace(label, '[^\p{{L}}]', ' ', 'g'), '(^| )[A-Za-z]{{16,}}( |$)')
AND len(regexp_extract_all(label, '[\p{{L}}\p{{M}}]')) / greatest(len(regexp_extract_all(label, '[^\s]')), 1) >= 0.7 AS plausible FROM l"""
)
def plausible_labels(spark, sf_dir):
    return view(spark, sf_dir, _LINES).select("id", fields.plausible_label(F.col("label")).alias("plausible"))


_ASKED = "SELECT conv_id AS id, turn, text FROM <conversations> UNION ALL SELECT CAST(-k AS BIGINT), CAST(0 AS BIGINT), t FROM (VALUES (1, 'Where is the box?'), (2, 'Please FILL THIS in'), (3, 'मेरा नाम भर दो'), (4, 'ಎಲ್ಲಿ?'), (5, 'What does it mean?'), (6, NULL), (7, 'Electoral roll: EPIC of the Applicant'), (8, 'मतदाता आवेदक')) AS v(k, t)"
_HAS = lambda words: " OR ".join(f"contains(lower(coalesce(text, '')), '{w}')" for w in words)


@query(
    f"""SELECT id, turn, CASE WHEN {_HAS(fields.WHERE)} THEN 'region' WHEN {_HAS(fields.FILL_FOR_ME)} THEN 'refusal' ELSE 'guidance' END AS intent,
CASE WHEN contains(text, 'आवेदक') AND contains(text, 'मतदाता') THEN 'hi' WHEN contains(lower(text), 'epic') AND contains(lower(text), 'applicant') AND contains(lower(text), 'electoral') THEN 'en' END AS form,
coalesce(contains(lower(text), 'the'), false) AS leaks FROM ({_ASKED})"""
)
def question_intent(spark, sf_dir):
    t = F.col("text")
    leaks = F.coalesce(fields.holds_answer(t, F.array(F.lit("The"), F.lit("an"), F.lit(" x "))), F.lit(False))
    return view(spark, sf_dir, _ASKED).select("id", "turn", fields.intent(t).alias("intent"), fields.form_language(t).alias("form"), leaks.alias("leaks"))


@query(
    """WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS w FROM benchmark)
SELECT item_id, CASE WHEN len(w) = 0 THEN '' ELSE list_reduce(w, lambda a, x: a || CASE WHEN length(regexp_extract(a, '[^\\n]*$')) + 1 + length(x) <= 40 THEN ' ' ELSE chr(10) END || x) END AS lines FROM w"""
)
def wrapped_text(spark, sf_dir):
    """Words wrapped to lines of 40 signs, as text in a box."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(text.wrapped(F.col("text"), F.lit(20.0)), "\n").alias("lines"))


@query(
    r"""WITH RECURSIVE z AS (SELECT item_id, 22 - k / 2 AS size, greatest(1, CAST(floor(400 / (0.5 * (22 - k / 2))) AS INTEGER)) AS most, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '') AS w FROM benchmark CROSS JOIN range(0, 33) AS r(k)),
s AS (SELECT item_id, size, most, w, 0 AS n, 0 AS lines, 0 AS own, 0 AS widest FROM z UNION ALL
SELECT item_id, size, most, w, n + 1, CASE WHEN fits THEN lines ELSE lines + 1 END, here, greatest(widest, here) FROM (
SELECT *, CASE WHEN fits THEN own + 1 + long ELSE long END AS here FROM (SELECT *, CAST(length(w[n + 1]) AS INTEGER) AS long, lines > 0 AND own + 1 + length(w[n + 1]) <= most AS fits FROM s WHERE n < len(w))))
SELECT item_id, max(CASE WHEN lines * size * 1.2 <= 120 AND widest * size * 0.5 <= 400 THEN size END) AS size FROM s WHERE n = len(w) GROUP BY item_id"""
)
def fitted_text(spark, sf_dir):
    """The type size at which each item fits a box."""
    rows = table(spark, sf_dir, "benchmark")
    return rows.select("item_id", text.fitting_size(F.col("text"), F.lit(400.0), F.lit(120.0)).alias("size"))


@query(
    """SELECT p_partkey, replace(replace('{name} is at most {limit}, of {low}', '{name}', p_name), '{limit}', CAST(p_size AS VARCHAR)) AS message, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_brand END AS answer,
CASE WHEN p_partkey % 3 = 0 THEN 'पूरा नाम' ELSE p_name || ' ' || p_type END AS spoken FROM part"""
)
def messages_filled(spark, sf_dir):
    """Templates filled in, suggestions where there is no answer, and the parts that are read aloud."""
    c = F.col
    lang = F.when(c("p_partkey") % 3 == 0, "hi").otherwise("en")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        text.message(F.lit("{name} is at most {limit}, of {low}"), {"name": c("p_name"), "limit": c("p_size"), "low": F.lit(None).cast("string")}).alias("message"),
        fields.suggested(F.when(c("p_partkey") % 2 == 0, " ").otherwise(c("p_brand")), c("p_type")).alias("answer"),
        text.speech_parts(F.array(c("p_name"), F.lit("पूरा नाम"), F.lit(" "), c("p_type")), lang).alias("spoken"),
    )


# ---- facts -------------------------------------------------------------------------------------

_CARDS = f"SELECT CAST(card_id AS BIGINT) AS card_id, text FROM ({samples.CARDS}) AS t(card_id, text) UNION ALL SELECT doc_id + 1000, text FROM <documents>"
_WORDS = r"len(list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> ''))"
_HEADING = facts.HEADING.removeprefix("(?i)")
_FITS = rf"(x <> '' AND NOT regexp_matches(x, ':$|\p{{Nd}}') AND NOT regexp_matches(lower(x), '{_HEADING}') AND {_WORDS} BETWEEN 1 AND 6)"
_LOW = "trim(regexp_replace(lower(x), ':+$', ''))"
_IN = lambda labels: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in labels) + "]"
_AADHAAR = r"(?:^|[^0-9])([2-9][0-9]{3})[ -]?([0-9]{4})[ -]?([0-9]{4})(?:[^0-9]|$)"
_PIN = r"(?:^|[^0-9])([1-9][0-9]{5})(?:[^0-9]|$)"
_DATE = r"\b([0-9]{2})[/.-]([0-9]{2})[/.-]([0-9]{4})\b"


def _labelled(labels: list[str]) -> str:
    later = f"(list_filter(l[i + 1:], lambda x: {_FITS} OR x LIKE '%:'))[1]"
    rest = "trim(regexp_replace(x, '^[^:]*:', ''))"
    hit = f"CASE WHEN list_contains({_IN(labels)}, {_LOW}) THEN {{'v': CASE WHEN {later} NOT LIKE '%:' THEN {later} END}} WHEN len(list_filter({_IN([x + ':' for x in labels])}, lambda p: starts_with({_LOW}, p))) > 0 AND {_fits(rest)} THEN {{'v': {rest}}} END"
    return f"((list_filter(list_transform(l, lambda x, i: {hit}), lambda h: h IS NOT NULL))[1]).v"


def _fits(of: str) -> str:
    return rf"({of} <> '' AND NOT regexp_matches({of}, ':$|\p{{Nd}}') AND NOT regexp_matches(lower({of}), '{_HEADING}') AND len(list_filter(regexp_split_to_array({of}, '\s+'), lambda w: w <> '')) BETWEEN 1 AND 6)"


_DATED = f"CASE WHEN regexp_matches(x, '{_DATE}') THEN regexp_replace(regexp_extract(x, '{_DATE}'), '[.-]', '/', 'g') END"
_CARE = r"^(?:s/o|d/o|c/o|son of|daughter of)"
_IS_ADDRESS = f"(list_contains({_IN(facts.ADDRESS_LABELS)}, {_LOW}) OR starts_with({_LOW}, 'address'))"
_FACTS = rf"""WITH c AS ({_CARDS}), r AS (SELECT card_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\r\x0b\x0c]'), lambda x: regexp_replace(regexp_replace(x, '\s+', ' ', 'g'), '^[ |]+|[ |]+$', '', 'g')), lambda x: x <> '') AS l FROM c),
b AS (SELECT card_id, l, array_to_string(l, chr(10)) AS blob, lower(array_to_string(l, chr(10))) AS low, array_to_string(l, ' ') AS flat, (list_filter(list_transform(l, lambda x, i: CASE WHEN {_IS_ADDRESS} THEN i END), lambda i: i IS NOT NULL))[1] AS a FROM r),
k AS (SELECT *, CASE WHEN regexp_matches(low, 'aadhaar|aadhar|uidai|unique identification') THEN 'Aadhaar' WHEN regexp_matches(low, 'permanent account|\bpan\b') THEN 'PAN' WHEN regexp_matches(low, 'election commission|elector|epic') THEN 'voter card' ELSE 'supporting document' END AS kind,
 l[a + 1:] AS rest FROM b),
s AS (SELECT *, (list_filter(list_transform(rest, lambda x, i: CASE WHEN regexp_matches(x, '{_AADHAAR}') OR regexp_matches(upper(x), '\b[A-Z]{{5}}[0-9]{{4}}[A-Z]\b') OR regexp_matches(x, '{_PIN}') THEN i END), lambda i: i IS NOT NULL))[1] AS stop FROM k),
p AS (SELECT *, rest[stop] AS last, CASE WHEN a IS NOT NULL AND NOT (regexp_matches(rest[stop], '{_AADHAAR}') OR regexp_matches(upper(rest[stop]), '\b[A-Z]{{5}}[0-9]{{4}}[A-Z]\b')) THEN nullif(regexp_extract(rest[stop], '{_PIN}', 1), '') END AS pin FROM s),
f AS (SELECT *, {_labelled(facts.NAME_LABELS)} AS named, (list_filter(l[:coalesce(a - 1, len(l))], lambda x: NOT regexp_matches(lower(x), '{_CARE}\b') AND {_FITS} AND {_WORDS} >= 2 AND NOT list_contains({_IN(facts.NAME_LABELS)}, regexp_replace(lower(x), ':+$', ''))))[1] AS person,
 {_labelled(facts.FATHER_LABELS)} AS father, (list_filter(list_transform(l, lambda x: trim(regexp_extract(x, '(?i){_CARE}\s*[:-]?\s*(.+)$', 1))), lambda x: {_FITS}))[1] AS care,
 (list_filter(list_transform(l, lambda x, i: CASE WHEN len(list_filter({_IN(facts.BIRTH_LABELS)}, lambda w: contains(lower(x), w))) > 0 THEN coalesce({_DATED}, (list_filter(list_transform(l[i + 1:i + 2], lambda x: {_DATED}), lambda d: d IS NOT NULL))[1]) END), lambda d: d IS NOT NULL))[1] AS labelled_birth,
 flatten(list_transform(l, lambda x: regexp_extract_all(x, '{_DATE}'))) AS dates,
 list_concat([CASE WHEN contains(l[a], ':') THEN trim(regexp_replace(l[a], '^[^:]*:', '')) END], list_filter(rest[:coalesce(stop - 1, len(rest))], lambda x: {_FITS} OR regexp_matches(x, '\p{{Nd}}')), [CASE WHEN pin IS NOT NULL THEN regexp_replace(last[:position(pin IN last) - 1], '^[ ,-]+|[ ,-]+$', '', 'g') END]) AS parts FROM p)
SELECT card_id, kind, CASE WHEN NOT regexp_matches(lower(coalesce(named, person)), '{_HEADING}') THEN coalesce(named, person) END AS full_name, CASE WHEN NOT regexp_matches(lower(coalesce(father, care)), '{_HEADING}') THEN coalesce(father, care) END AS father_name,
CASE WHEN regexp_matches(low, '\bfemale\b|महिला|स्त्री') THEN 'Female' WHEN regexp_matches(low, '\bmale\b|पुरुष') THEN 'Male' END AS gender, coalesce(labelled_birth, CASE WHEN len(dates) = 1 THEN regexp_replace(dates[1], '[.-]', '/', 'g') END) AS date_of_birth,
CASE WHEN kind IN ('Aadhaar', 'supporting document') AND regexp_matches(flat, '{_AADHAAR}') THEN concat_ws(' ', regexp_extract(flat, '{_AADHAAR}', 1), regexp_extract(flat, '{_AADHAAR}', 2), regexp_extract(flat, '{_AADHAAR}', 3)) END AS aadhaar_number,
CASE WHEN kind = 'PAN' OR regexp_matches(low, '\bpan\b|permanent account') THEN nullif(regexp_extract(upper(blob), '\b([A-Z]{{5}}[0-9]{{4}}[A-Z])\b', 1), '') END AS pan_number, CASE WHEN kind = 'voter card' THEN nullif(regexp_extract(upper(blob), '\b([A-Z]{{3}}[0-9]{{7}})\b', 1), '') END AS voter_id,
CASE WHEN a IS NOT NULL THEN nullif(array_to_string(list_filter(parts, lambda x: x IS NOT NULL AND x <> ''), ', '), '') END AS address, pin AS pincode FROM f"""
_AGED = f"SELECT *, CASE WHEN date_of_birth IS NOT NULL THEN try_strptime(date_of_birth, '%d/%m/%Y') END AS born FROM ({_FACTS})"


@query(f"SELECT * EXCLUDE (born), CAST(CASE WHEN born <= TIMESTAMP '2026-11-05' AND date_diff('year', born, TIMESTAMP '2026-11-05') - CASE WHEN strftime(born, '%m%d') > '1105' THEN 1 ELSE 0 END <= 120 THEN date_diff('year', born, TIMESTAMP '2026-11-05') - CASE WHEN strftime(born, '%m%d') > '1105' THEN 1 ELSE 0 END END AS INTEGER) AS age FROM ({_AGED})")
def extract_facts(spark, sf_dir):
    return facts.with_facts(view(spark, sf_dir, _CARDS), "text", "card_id").withColumn("age", facts.age(F.col("date_of_birth"), F.to_date(F.lit("2026-11-05"))))


_CLAIMS = """SELECT l_orderkey AS doc, l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey AS id, l_linenumber AS ord, CASE l_partkey % 4 WHEN 0 THEN 'full_name' WHEN 1 THEN 'other' END AS known_id, CASE l_suppkey % 4 WHEN 0 THEN 'age' WHEN 1 THEN 'full_name' WHEN 2 THEN 'date_of_birth' END AS semantic_id,
CASE l_partkey % 3 WHEN 0 THEN 'Name of Father' ELSE 'Name' END AS label, CASE l_linenumber % 5 WHEN 4 THEN 'signature' ELSE 'text' END AS field_type, CASE l_suppkey % 7 WHEN 0 THEN 'office' END AS filled_by FROM <lineitem>"""
_HAVE = """SELECT o_orderkey AS doc, 'full_name' AS fact, o_orderpriority AS value FROM <orders> UNION ALL SELECT o_orderkey, 'date_of_birth', CASE o_orderkey % 3 WHEN 0 THEN '09/04/1971' WHEN 1 THEN '31/02/1990' ELSE '05/11/2026' END FROM <orders>"""


@query(
    f"""WITH h AS (SELECT * FROM ({_HAVE}) UNION ALL SELECT o_orderkey, 'age', CASE o_orderkey % 3 WHEN 0 THEN '55' ELSE '0' END FROM orders WHERE o_orderkey % 3 <> 1),
m AS (SELECT f.*, h.fact, h.value FROM ({_CLAIMS}) f JOIN h ON h.doc = f.doc AND h.fact IN (f.known_id, f.semantic_id) WHERE field_type <> 'signature' AND coalesce(filled_by, '') <> 'office' QUALIFY row_number() OVER (PARTITION BY f.doc, f.id, f.ord ORDER BY coalesce(h.fact = f.known_id, false) DESC) = 1)
SELECT doc, id, fact, value FROM m WHERE NOT (fact = 'full_name' AND contains(lower(label), 'father')) QUALIFY row_number() OVER (PARTITION BY doc, fact ORDER BY ord, id) = 1"""
)
def facts_to_fields(spark, sf_dir):
    return resolve.placed_facts(view(spark, sf_dir, _HAVE), view(spark, sf_dir, _CLAIMS), ["doc"], ["ord"], "id", F.to_date(F.lit("2026-11-05")))


# ---- wordings ----------------------------------------------------------------------------------

_WORDINGS = f"SELECT label, field_type FROM ({samples.WORDINGS}) AS t(label, field_type) UNION SELECT p_name, CASE p_partkey % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'checkbox' END FROM <part>"
_ALIASES = f"SELECT entry_id, ord, pos, alias, CAST(priority AS DOUBLE) AS priority, entry_type FROM ({samples.ALIASES}) AS t(entry_id, ord, pos, alias, priority, entry_type)"
_KEYWORDS = f"SELECT * FROM ({samples.KEYWORDS}) AS t(entry_id, pos, keyword)"
_MARKERS = f"SELECT pattern_id, ord, marker, CAST(weight AS DOUBLE) AS weight FROM ({samples.MARKERS}) AS t(pattern_id, ord, marker, weight)"
# vowel signs that do not count, in the one Hindi wording
_TOKENS = r"regexp_extract_all(regexp_replace(lower(coalesce({}, '')), '[\x{{093A}}-\x{{094F}}]', '', 'g'), '[a-z0-9\x{{0900}}-\x{{097F}}]+')"
_INSIDE = "contains(' ' || array_to_string({0}, ' ') || ' ', ' ' || array_to_string({1}, ' ') || ' ')"


@query(
    f"""WITH l AS (SELECT DISTINCT label, field_type, {_TOKENS.format('label')} AS lt FROM ({_WORDINGS})), k AS (SELECT *, {_TOKENS.format('alias')} AS att FROM ({_ALIASES})),
s AS (SELECT label, field_type, lt, entry_id, ord, pos, alias, att, priority, entry_type, CASE WHEN lt = att THEN 1.0::DOUBLE WHEN {_INSIDE.format('lt', 'att')} THEN CASE WHEN len(att) = 1 AND len(lt) >= 2 THEN 0.5::DOUBLE ELSE least(0.95::DOUBLE, 0.58::DOUBLE + 0.37::DOUBLE * least(len(att)::DOUBLE / len(lt), 1.0::DOUBLE)) END
 WHEN len(lt) >= 2 AND {_INSIDE.format('att', 'lt')} THEN 0.74::DOUBLE END AS base, CASE WHEN lt = att THEN 'exact' WHEN {_INSIDE.format('lt', 'att')} THEN CASE WHEN len(att) = 1 AND len(lt) >= 2 THEN 'weak_token' ELSE 'contains' END ELSE 'contained_by' END AS how FROM l, k WHERE len(lt) > 0),
e AS (SELECT * FROM s WHERE base IS NOT NULL QUALIFY row_number() OVER (PARTITION BY label, field_type, entry_id ORDER BY base DESC, pos) = 1),
w AS (SELECT DISTINCT l.label, l.field_type, l.lt, k.entry_id, k.ord, q.pos, q.keyword AS alias, {_TOKENS.format('q.keyword')} AS att, k.priority, k.entry_type, 0.56::DOUBLE AS base, 'keyword' AS how FROM l, ({_KEYWORDS}) q JOIN k USING (entry_id) WHERE list_has_all(l.lt, {_TOKENS.format('q.keyword')})
 AND NOT EXISTS (SELECT 1 FROM e WHERE e.label = l.label AND e.field_type IS NOT DISTINCT FROM l.field_type AND e.entry_id = k.entry_id) QUALIFY row_number() OVER (PARTITION BY l.label, l.field_type, k.entry_id ORDER BY q.pos) = 1),
a AS (SELECT *, least(1.0::DOUBLE, base * priority) AS raw FROM (SELECT * FROM e UNION ALL SELECT * FROM w)),
g AS (SELECT *, round(CASE WHEN field_type IS NULL THEN raw WHEN field_type = entry_type THEN least(1.0::DOUBLE, raw + 0.04::DOUBLE) WHEN (field_type IN ('checkbox', 'radio')) <> (entry_type IN ('checkbox', 'radio')) THEN raw - 0.08::DOUBLE WHEN field_type IN ('text', 'multiline', 'date') AND entry_type IN ('text', 'multiline', 'date') THEN raw - 0.01::DOUBLE ELSE raw - 0.04::DOUBLE END, 4) AS score FROM a),
f AS (SELECT label, field_type, list_reduce(list({{'entry_id': entry_id, 'score': score, 'n': len(att), 'alias': alias, 'how': how}} ORDER BY ord), lambda h, c: CASE WHEN abs(c.score - h.score) > 0.02 THEN CASE WHEN c.score > h.score THEN c ELSE h END WHEN c.n > h.n THEN c ELSE h END) AS x FROM g GROUP BY label, field_type)
SELECT label, field_type, x.entry_id AS entry_id, x.alias AS alias, x.score AS score, x.how AS how, x.score >= 0.74 AS confident FROM f WHERE x.score >= 0.52 AND x.how <> 'weak_token'"""
)
def resolve_label(spark, sf_dir):
    """Labels to dictionary entries by their wording; the layer of similar tokens is in resolve_noisy."""
    return resolve.resolve(view(spark, sf_dir, _WORDINGS), view(spark, sf_dir, _ALIASES), view(spark, sf_dir, _KEYWORDS), fuzzy=False)


@query()
def resolve_noisy(spark, sf_dir):
    """Labels with a letter misread, through all layers."""
    noisy = view(spark, sf_dir, "SELECT regexp_replace(p_name, '^(.)(.)', '$2$1') AS label, CAST(NULL AS STRING) AS field_type FROM <part> UNION SELECT regexp_replace(p_name, 'd', 'o'), 'text' FROM <part>")
    return resolve.resolve(noisy, view(spark, sf_dir, _ALIASES), view(spark, sf_dir, _KEYWORDS))


_PATTERN_SQL = f"""WITH l AS (SELECT DISTINCT label, {_TOKENS.format('label')} AS lt FROM ({_WORDINGS})), k AS (SELECT *, {_TOKENS.format('marker')} AS mt FROM ({_MARKERS})),
s AS (SELECT label, pattern_id, ord, marker, least(0.9::DOUBLE, weight * CASE WHEN lt = mt THEN 0.72::DOUBLE ELSE 0.6::DOUBLE + 0.08::DOUBLE * least(len(mt)::DOUBLE / len(lt), 1.0::DOUBLE) END) AS score FROM l, k WHERE len(lt) > 0 AND {_INSIDE.format('lt', 'mt')})
SELECT label, pattern_id, marker, round(score, 4) AS score FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, ord) = 1"""


@query(_PATTERN_SQL)
def label_patterns(spark, sf_dir):
    return resolve.match_pattern(view(spark, sf_dir, _WORDINGS), view(spark, sf_dir, _MARKERS), fuzzy=False)


@query(
    f"""WITH f AS (SELECT DISTINCT label, field_type FROM ({_WORDINGS})), r AS (SELECT 'name' AS entry_id, 'Full Name' AS label, NULL AS field_type, 0.9::DOUBLE AS score UNION ALL SELECT 'widget', 'cold widget', 'text', 1.0::DOUBLE), p AS ({_PATTERN_SQL})
SELECT f.label, f.field_type, r.entry_id AS semantic_id, CASE WHEN r.entry_id IS NULL THEN p.pattern_id END AS pattern_id, CASE WHEN r.entry_id IS NULL THEN p.score ELSE r.score END AS semantic_score, CASE WHEN r.entry_id IS NOT NULL THEN 'exact' WHEN p.pattern_id IS NOT NULL THEN 'label_pattern' END AS semantic_source
FROM f LEFT JOIN r ON r.label = f.label AND r.field_type IS NOT DISTINCT FROM f.field_type LEFT JOIN p ON p.label = f.label"""
)
def field_semantics(spark, sf_dir):
    """Fields with their entry or else their pattern."""
    found = view(spark, sf_dir, f"SELECT DISTINCT label, field_type FROM ({_WORDINGS})")
    known = view(spark, sf_dir, "SELECT 'Full Name' AS label, CAST(NULL AS STRING) AS field_type, 'name' AS entry_id, 0.9D AS score, 'exact' AS how UNION ALL SELECT 'cold widget', 'text', 'widget', 1.0D, 'exact'")
    return resolve.with_semantics(found, known, resolve.match_pattern(found, view(spark, sf_dir, _MARKERS), fuzzy=False))


_READ = """SELECT l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey AS id, l_shipdate AS at, 'printed' AS label, CASE l_linenumber % 3 WHEN 0 THEN 'checkbox' ELSE 'text' END AS field_type, 'old' AS semantic_id, 'shape' AS pattern_id, 'text' AS kind FROM <lineitem>"""
_READINGS = """SELECT DISTINCT l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey AS id, CASE l_partkey % 3 WHEN 0 THEN 'read' ELSE '' END AS label, CASE l_partkey % 4 WHEN 0 THEN 'office' END AS fill_by, CASE l_partkey % 5 WHEN 0 THEN 'birth' WHEN 1 THEN 'invented' END AS concept, 0.8 AS confidence, CASE l_partkey % 7 WHEN 0 THEN 'date' ELSE 'text' END AS validation FROM <lineitem> WHERE l_suppkey % 2 = 0"""


@query(
    f"""SELECT f.id, CASE WHEN r.id IS NULL OR r.label = '' THEN f.label ELSE r.label END AS display_label, CASE WHEN r.id IS NOT NULL THEN coalesce(fill_by, 'applicant') END AS filled_by, CASE WHEN r.id IS NULL THEN 'old' WHEN concept = 'birth' THEN 'birth' END AS semantic_id,
CASE WHEN r.id IS NULL OR concept = 'birth' THEN 'shape' END AS pattern_id, CASE WHEN concept = 'birth' AND field_type <> 'checkbox' THEN 'date' ELSE field_type END AS field_type, CASE WHEN validation <> 'text' THEN validation WHEN concept = 'birth' THEN 'date' ELSE kind END AS kind FROM ({_READ}) f LEFT JOIN ({_READINGS}) r ON r.id = f.id"""
)
def classified_fields(spark, sf_dir):
    entries = view(spark, sf_dir, "SELECT 'birth' AS entry_id, 'date' AS entry_type, 'date' AS entry_kind")
    return resolve.classified(view(spark, sf_dir, _READ).drop("at"), view(spark, sf_dir, _READINGS), entries, "id")


_ASKS = "SELECT o_orderkey AS query, CASE o_custkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'none' END AS form_id, o_orderpriority AS name FROM <orders> UNION ALL SELECT o_orderkey, CASE o_custkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'none' END, o_orderstatus FROM <orders>"
_FORM_FIELDS = "VALUES ('a', 'f', 0, '1-urgent|o'), ('a', 'two', 1, '2-HIGH |F'), ('a', 'three', 2, '1-Urgent|f'), ('b', 'O', 0, '5-LOW'), ('b', 'rest', 1, '5-low|P')"


@query(
    f"""WITH f AS (SELECT form_id, field_id, ord, lower(trim(unnest(list_append(string_split(names, '|'), field_id)))) AS name FROM ({_FORM_FIELDS}) AS t(form_id, field_id, ord, names)), q AS (SELECT DISTINCT query, form_id, lower(trim(name)) AS name FROM ({_ASKS})),
h AS (SELECT query, form_id, field_id, ord, count(DISTINCT name) AS hits FROM q JOIN f USING (form_id, name) GROUP BY ALL) SELECT query, form_id, field_id, hits FROM h QUALIFY row_number() OVER (PARTITION BY query, form_id ORDER BY hits DESC, ord) = 1"""
)
def known_field(spark, sf_dir):
    known = view(spark, sf_dir, f"SELECT form_id, field_id, ord, split(names, '[|]') AS aliases FROM ({_FORM_FIELDS}) AS t(form_id, field_id, ord, names)")
    return resolve.known_field(view(spark, sf_dir, _ASKS), known)


_CHUNKS = "SELECT doc_id AS chunk, lang AS language, CASE doc_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS form_id, text FROM <documents>"
_QUESTIONS = "SELECT item_id AS query, CASE item_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE 'es' END AS language, CASE item_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'z' END AS form_id, text FROM <benchmark>"
_BAG = lambda c: f"list_distinct(regexp_extract_all(lower(coalesce({c}, '')), '{text.TOKEN}'))"


@query(
    f"""WITH qb AS MATERIALIZED (SELECT query, language, form_id, {_BAG('text')} AS b FROM ({_QUESTIONS})), cb AS MATERIALIZED (SELECT chunk, language, form_id, {_BAG('text')} AS b FROM ({_CHUNKS})),
q AS (SELECT query, language, form_id, unnest(b) AS k, len(b) AS nq FROM qb), c AS (SELECT chunk, language, form_id, unnest(b) AS k, len(b) AS nc FROM cb),
s AS (SELECT query, q.form_id AS form, chunk, coalesce(q.form_id = c.form_id, false) AS own, round(count(*) / (nq + nc - count(*)), 6) AS score FROM q JOIN c USING (language, k) GROUP BY query, q.form_id, chunk, c.form_id, nq, nc),
h AS (SELECT *, max(own) OVER (PARTITION BY query) AS hit FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk) AS rank FROM h WHERE form IS NULL OR own OR NOT hit)
SELECT query, chunk, score, CAST(rank AS INTEGER) AS rank, form IS NOT NULL AND NOT hit AS widened FROM r WHERE rank <= 5 AND score >= CASE WHEN form IS NULL THEN 0.1 ELSE 0.05 END"""
)
def retrieved_chunks(spark, sf_dir):
    """Chunks of the query's language and form, or of its language where the form has none."""
    return retrieval.retrieved(view(spark, sf_dir, _QUESTIONS), view(spark, sf_dir, _CHUNKS), least=0.05, least_unknown=0.1)


_CANDIDATES = """SELECT o_custkey AS field, CASE o_orderkey % 6 WHEN 0 THEN 'known' WHEN 1 THEN 'concept' WHEN 2 THEN 'dictionary' WHEN 3 THEN 'retrieved' WHEN 4 THEN 'no_concept' ELSE 'pattern' END AS source,
round(o_totalprice / 1000 % 1, 3) AS score, CASE WHEN o_orderkey % 7 = 0 THEN ' ' ELSE o_orderpriority END AS text FROM <orders>"""
_RUNG = "list_position(['" + "', '".join(resolve.LADDER) + "'], source)"
_CONFIDENCE = "round(CASE source WHEN 'known' THEN 0.93 WHEN 'concept' THEN least(0.9, 0.5 + 0.4 * c) WHEN 'dictionary' THEN least(0.92, 0.55 + 0.37 * c) WHEN 'retrieved' THEN least(0.84, 0.5 + c / 2) WHEN 'pattern' THEN least(0.6, 0.35 + 0.3 * c) ELSE 0.2 END::DOUBLE, 3)"


@query(
    f"""WITH c AS (SELECT *, {_RUNG} AS rung, nullif(trim(text), '') IS NOT NULL AND {_RUNG} > 0 AS usable, max(source = 'no_concept') OVER (PARTITION BY field) AS blocked FROM ({_CANDIDATES})), k AS (SELECT DISTINCT field FROM c),
b AS (SELECT field, source, score, text FROM c WHERE usable AND NOT (blocked AND source IN ('dictionary', 'retrieved')) QUALIFY row_number() OVER (PARTITION BY field ORDER BY rung, score DESC, text) = 1),
r AS (SELECT k.field, coalesce(source, 'unavailable') AS source, text, CASE WHEN score IS NULL OR score = 0 THEN 0.5::DOUBLE ELSE score END AS c FROM k LEFT JOIN b USING (field))
SELECT field, source, text, {_CONFIDENCE} AS confidence, CASE source WHEN 'known' THEN false WHEN 'concept' THEN {_CONFIDENCE} < 0.8 WHEN 'dictionary' THEN c < 0.74 ELSE true END AS verify FROM r"""
)
def guidance_ladder(spark, sf_dir):
    """Each field's answer from the best source that has one."""
    return resolve.ladder(view(spark, sf_dir, _CANDIDATES), ["field"])


_TEXTS = "SELECT p_partkey % 40 AS k, CASE p_partkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'hi' ELSE 'fr' END AS language, p_size AS rank, CASE WHEN p_partkey % 5 = 0 THEN 'पूरा नाम' WHEN p_partkey % 7 = 0 THEN ' ' ELSE p_name END AS text FROM <part>"
_ANSWERED = "SELECT DISTINCT p_partkey % 50 AS k, CASE p_partkey % 2 WHEN 0 THEN 'en' ELSE 'hi' END AS language FROM <part>"
_OWN = "regexp_matches(t.text, CASE a.language WHEN 'hi' THEN '[ऀ-ॿ]' ELSE '[a-z]' END)"


@query(
    f"""SELECT k, language, x.text AS text, x.of AS text_language FROM ({_ANSWERED}) LEFT JOIN (SELECT a.k, a.language, arg_min({{'of': t.language, 'text': t.text}}, {{'l': CASE WHEN t.language = a.language AND {_OWN} THEN 0 WHEN {_OWN} THEN 1 WHEN t.language = 'en' THEN 2 ELSE 3 END, 'r': rank, 'g': t.language, 't': t.text}}) AS x
FROM ({_ANSWERED}) a JOIN ({_TEXTS}) t ON t.k = a.k WHERE trim(t.text) <> '' GROUP BY a.k, a.language) USING (k, language)"""
)
def rendered_guidance(spark, sf_dir):
    return resolve.rendered(view(spark, sf_dir, _ANSWERED), view(spark, sf_dir, _TEXTS), "k", "language", text.in_script(F.col("text"), F.col("language")))


# ---- replies -----------------------------------------------------------------------------------

_REPLIES = """SELECT o_orderkey AS batch, CASE o_orderkey % 5 WHEN 0 THEN 'no answer' WHEN 1 THEN '{"fields": [}' ELSE concat('Here: {"fields": [{"id": "f', o_custkey % 3, '", "concept": "', CASE o_custkey % 4 WHEN 0 THEN 'None' WHEN 1 THEN 'birth' WHEN 2 THEN 'invented' ELSE ' ' END, '", "fill_by": "', CASE o_custkey % 2 WHEN 0 THEN ' Office' ELSE 'me' END,
'", "validation": "', CASE o_orderkey % 3 WHEN 0 THEN 'DATE ' ELSE 'magic' END, '", "confidence": ', CASE o_orderkey % 4 WHEN 0 THEN '1.7' WHEN 1 THEN '"high"' ELSE '0.4' END, ', "label": "l", "what_to_enter": {"en": "enter it", "hi": "enter it"}}, {"id": "f9", "is_field": true}]} thanks') END AS raw FROM <orders>"""
_WANTED = "SELECT o_orderkey AS batch, id FROM <orders> CROSS JOIN (VALUES ('f0'), ('f1')) AS t(id)"


@query(
    f"""WITH r AS (SELECT batch, CASE WHEN regexp_matches(raw, '\\{{.*\\}}') THEN regexp_extract(raw, '\\{{.*\\}}') ELSE raw END AS j FROM ({_REPLIES})), f AS (SELECT batch, unnest(from_json(json_extract(j, '$.fields'), '["JSON"]')) AS f FROM r WHERE json_valid(j)),
v AS (SELECT batch, f->>'id' AS id, trim(f->>'concept') AS concept, lower(trim(f->>'fill_by')) AS fill, lower(trim(f->>'validation')) AS kind, try_cast(f->>'confidence' AS DOUBLE) AS c, f->>'label' AS label FROM f)
SELECT batch, id, CASE WHEN concept = 'birth' THEN concept END AS concept, CASE WHEN fill = 'office' THEN fill ELSE 'applicant' END AS fill_by, CASE WHEN kind = 'date' THEN kind ELSE 'text' END AS validation, coalesce(greatest(0.0, least(1.0, c)), 0.5)::DOUBLE AS confidence, label, 'en=enter it' AS texts FROM v WHERE id IN ('f0', 'f1')"""
)
def parsed_replies(spark, sf_dir):
    found = replies.parsed(view(spark, sf_dir, _REPLIES), view(spark, sf_dir, _WANTED), view(spark, sf_dir, "SELECT 'birth' AS entry_id"))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("texts")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return found.withColumn("texts", shown)


_GLOSSARIES = """SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN concat('[{"term": "AC", "meaning": "', p_name, '"}, {"abbreviation": "PN", "expansion": "part"}, {"term": "AC", "definition": "last"}, {"name": ""}]') WHEN 1 THEN concat('{"AC": "', p_type, '"}') ELSE 'none' END AS paper, concat('{"AC": "web", "WEB": "', p_brand, '"}') AS web FROM <part>"""


@query(f"SELECT id, CASE id % 3 WHEN 0 THEN 'AC=last,PN=part,WEB=' WHEN 1 THEN 'AC=' || p_type || ',WEB=' ELSE 'AC=web,WEB=' END || p_brand AS terms FROM ({_GLOSSARIES}) JOIN part ON id = p_partkey")
def merged_glossaries(spark, sf_dir):
    """Terms of the paper and of a search; the paper's meaning stands."""
    rows = view(spark, sf_dir, _GLOSSARIES)
    both = F.map_entries(replies.merged_glossary(replies.glossary(F.col("paper")), replies.glossary(F.col("web"))))
    return rows.select("id", F.array_join(F.transform(F.array_sort(both), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("terms"))


@query(
    """WITH t AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}_]+'), lambda t: regexp_full_match(t, '[A-Z]{2,6}'))) AS u FROM documents)
SELECT doc_id, 'Form: ' || source || CASE WHEN trim(lang) <> '' THEN chr(10) || 'Issued by: ' || lang ELSE '' END || CASE WHEN len(regexp_extract_all(coalesce(text, ''), '[^\\n]+')) > 0 THEN chr(10) || array_to_string(list_transform(list_filter(regexp_extract_all(text, '[^\\n]+'), lambda x: trim(x) <> '')[:6], lambda x: 'Instruction: ' || x), chr(10)) ELSE '' END AS briefing,
sha256('[' || source || '|' || lang || ']') AS key FROM documents JOIN t USING (doc_id)"""
)
def briefings(spark, sf_dir):
    """What a request is told of a form: title, issuer and the first six notes, here a document's lines."""
    notes = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    none = F.array().cast("array<struct<term: string, meaning: string>>")
    return table(spark, sf_dir, "documents").select("doc_id", replies.briefing(F.col("source"), F.col("lang"), F.lit(None).cast("string"), none, notes).alias("briefing"), F.sha2(F.concat(F.lit("["), "source", F.lit("|"), "lang", F.lit("]")), 256).alias("key"))


# ---- keyed tables and sets ---------------------------------------------------------------------


@query("SELECT s_suppkey AS user_id, string_agg(t, ',' ORDER BY t) AS missing FROM (SELECT user_id AS s_suppkey, t FROM (SELECT DISTINCT user_id FROM events), (SELECT DISTINCT event_type AS t FROM events UNION SELECT 'refund') EXCEPT SELECT user_id, event_type FROM events) GROUP BY 1")
def coverage_gaps(spark, sf_dir):
    """Kinds of events that a user has none of, of those there are and refunds."""
    e = table(spark, sf_dir, "events")
    every = e.select("event_type").unionByName(spark.createDataFrame([("refund",)], "event_type string"))
    return tables.gaps(e, "user_id", "event_type", every)


@query("SELECT lang, doc_id AS id, 'documents' AS origin FROM documents UNION ALL SELECT 'xx', item_id, 'benchmark' FROM benchmark")
def chunk_union(spark, sf_dir):
    """Chunks of two sources as one table."""
    one = lambda t, lang, ident: table(spark, sf_dir, t).select(lang.alias("lang"), F.col(ident).alias("id"), F.lit(t).alias("origin"))
    return one("documents", F.col("lang"), "doc_id").unionByName(one("benchmark", F.lit("xx"), "item_id"))


_FILES = """SELECT doc_id AS id, CASE doc_id % 7 WHEN 0 THEN '25504446' WHEN 1 THEN '89504E470D0A1A0A' WHEN 2 THEN 'FFD8FFE0' WHEN 3 THEN '52494646' || '00000000' || '57454250' WHEN 4 THEN '' WHEN 5 THEN '524946460000000057415645' ELSE '3C21444F43' END AS head FROM <documents>"""


@query(
    f"""SELECT id, CASE id % 7 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/jpeg' WHEN 3 THEN 'image/webp' END AS mime, CASE WHEN head = '' THEN 'empty' WHEN length(head) // 2 > 11 THEN 'too_large' WHEN id % 7 > 3 THEN 'unknown_type' END AS error FROM ({_FILES})"""
)
def sniff_kind(spark, sf_dir):
    """Types by first bytes, with what is not admitted (here beyond 11 bytes)."""
    return readers.admitted(view(spark, sf_dir, _FILES).select("id", F.unhex("head").alias("content")), 11).select("id", "mime", "error")


_ENTRIES = """SELECT concat('e', p_partkey % 300) AS id, p_name AS en, CASE WHEN p_partkey % 7 > 0 THEN concat(p_type, ' ', p_brand) END AS fr, CASE WHEN p_partkey % 11 > 0 THEN p_brand END AS what FROM <part>"""


def _entries(spark, sf_dir):
    rows = view(spark, sf_dir, _ENTRIES)
    aliases = F.map_filter(F.create_map(F.lit("en"), F.array("en", F.lit("x y z")), F.lit("fr"), F.when(F.col("fr").isNotNull(), F.array("fr"))), lambda _, v: v.isNotNull())
    return rows.select("id", aliases.alias("aliases"), F.map_filter(F.create_map(F.lit("en"), "what", F.lit("fr"), "en"), lambda _, v: v.isNotNull()).alias("texts"))


@query(
    f"""WITH e AS ({_ENTRIES}) SELECT DISTINCT entry_id, problem FROM (SELECT id AS entry_id, 'duplicate' AS problem FROM e GROUP BY id HAVING count(*) > 1 UNION ALL SELECT id, 'aliases:fr' FROM e WHERE fr IS NULL UNION ALL SELECT id, 'text:en' FROM e WHERE what IS NULL)"""
)
def dictionary_audit(spark, sf_dir):
    return readers.audit(_entries(spark, sf_dir), ["en", "fr"])


@query(
    f"""WITH e AS (SELECT *, row_number() OVER () AS n FROM ({_ENTRIES})), a AS (SELECT n, id, 'en' AS language, en AS alias, 0 AS at FROM e UNION ALL SELECT n, id, 'en', 'x y z', 1 FROM e UNION ALL SELECT n, id, 'fr', fr, 2 FROM e WHERE fr IS NOT NULL),
t AS (SELECT id AS entry_id, language, alias, array_to_string(regexp_extract_all(lower(alias), '[a-z0-9]+'), ' ') AS folded, len(regexp_extract_all(lower(alias), '[a-z0-9]+')) AS length FROM a) SELECT entry_id, language, folded, CAST(length AS INTEGER) AS length, count(*) AS n FROM t GROUP BY ALL"""
)
def dictionary_aliases(spark, sf_dir):
    """Wordings of entries, folded, by their number of tokens."""
    return readers.alias_rows(_entries(spark, sf_dir)).groupBy("entry_id", "language", "folded", "length").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH e AS ({_ENTRIES}) SELECT 'common:' || id || ':en' AS chunk, 'en' AS language, id || ' ' || en || ' x y z ' || what AS text FROM e WHERE what IS NOT NULL UNION ALL SELECT 'common:' || id || ':fr', 'fr', id || ' ' || coalesce(fr || ' ', '') || en FROM e"""
)
def dictionary_chunks(spark, sf_dir):
    return readers.chunks(_entries(spark, sf_dir)).select("chunk", "language", "text")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def cascade_delete(spark, sf_dir):
    """Orders left when some customers are deleted."""
    gone = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return tables.without(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), gone, ["o_custkey"])


@query(
    """WITH r AS (SELECT o_custkey, o_orderkey, [o_orderstatus, o_orderpriority] AS reasons, round(o_totalprice % 1, 4) AS confidence FROM orders), u AS (SELECT o_custkey, o_orderkey, confidence, unnest(reasons) AS reason, unnest([1, 2]) AS i FROM r),
f AS (SELECT o_custkey, reason, min((o_orderkey, i)) AS first FROM u GROUP BY ALL) SELECT o_custkey, string_agg(reason, ',' ORDER BY first) AS reasons, c AS confidence FROM f JOIN (SELECT o_custkey, max(confidence) AS c FROM r GROUP BY 1) USING (o_custkey) GROUP BY o_custkey, c"""
)
def merged_reasons(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.array("o_orderstatus", "o_orderpriority").alias("reasons"), F.round(F.col("o_totalprice") % 1, 4).alias("confidence"))
    return tables.ordered_union(rows, ["o_custkey"], ["o_orderkey"], "reasons", "confidence").withColumn("reasons", F.array_join("reasons", ","))


@query(
    """WITH s AS (SELECT o_custkey AS k, list_distinct(list(lower(trim(o_orderpriority)))) AS a FROM orders GROUP BY 1), e AS (SELECT k, a, ['1-urgent', '2-high', '5-low'] AS wanted FROM s)
SELECT k, array_to_string(list_sort(list_intersect(wanted, a)), ',') AS found, array_to_string(list_filter(wanted, lambda x: NOT list_contains(a, x)), ',') AS missing, list_has_all(wanted, a) AS within, CAST(len(a) AS INTEGER) AS spellings FROM e"""
)
def expected_sets(spark, sf_dir):
    """What of an expected set is found, what is missing, and whether all found was expected."""
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("x"))
    once = tables.distinct_folded(F.transform("x", lambda x: F.concat(F.lit(" "), x["o_orderpriority"])))
    wanted, found = F.array(*map(F.lit, ["1-urgent", "2-high", "5-low"])), F.transform(once, lambda t: F.lower(F.trim(t)))
    return rows.select("k", F.array_join(F.array_sort(F.array_intersect(wanted, found)), ",").alias("found"), F.array_join(F.array_except(wanted, found), ",").alias("missing"), (F.size(F.array_except(found, wanted)) == 0).alias("within"), F.size(once).alias("spellings"))


@query(
    """WITH w AS (SELECT l_orderkey AS page, CASE WHEN l_partkey % 9 = 0 THEN ' ' ELSE l_returnflag || l_linestatus END AS text, CASE WHEN l_suppkey % 5 = 0 THEN -1.0 ELSE l_quantity END AS conf FROM lineitem)
SELECT page, round(coalesce(avg(conf) FILTER (conf > 0), 0), 2) AS average, round(coalesce(avg(conf) FILTER (conf >= 0 AND trim(text) <> ''), 0) * least(1.0::DOUBLE, (count(*) FILTER (conf >= 0 AND trim(text) <> ''))::DOUBLE / 12), 6) AS score,
coalesce(length(string_agg(trim(text), ' ') FILTER (trim(text) <> '')), 0) >= 8 AND count(*) FILTER (trim(text) <> '') >= 2 AS useful FROM w GROUP BY page"""
)
def reading_scores(spark, sf_dir):
    """Quality of each page's reading."""
    rows = view(spark, sf_dir, "SELECT l_orderkey AS page, CASE WHEN l_partkey % 9 = 0 THEN ' ' ELSE l_returnflag || l_linestatus END AS text, CASE WHEN l_suppkey % 5 = 0 THEN -1.0D ELSE l_quantity END AS conf FROM <lineitem>")
    return tables.mean_confidence(rows, ["page"], "conf", "text")


_VOICES = "SELECT c_name AS voice, concat(CASE c_nationkey % 5 WHEN 0 THEN 'HI' WHEN 1 THEN 'en' WHEN 2 THEN 'bn' WHEN 3 THEN 'kn' ELSE 'xx' END, '-IN') AS tag, c_acctbal > 5000 AS local FROM <customer>"
_PREFERRED = "SELECT language, CAST(rank AS INTEGER) AS rank, prefix FROM (VALUES ('hi', 0, 'hi'), ('mr', 0, 'mr'), ('mr', 1, 'hi'), ('ur', 0, 'ur'), ('as', 0, 'as'), ('as', 1, 'bn'), ('en', 0, 'en')) AS t(language, rank, prefix)"


@query(f"SELECT language, voice FROM ({_PREFERRED}) p JOIN ({_VOICES}) v ON lower(split_part(tag, '-', 1)) = prefix QUALIFY row_number() OVER (PARTITION BY language ORDER BY rank, local DESC, voice) = 1")
def voice_ladder(spark, sf_dir):
    return tables.voices(view(spark, sf_dir, _PREFERRED), view(spark, sf_dir, _VOICES))


# ---- state in order ----------------------------------------------------------------------------

_TIMED = "SELECT user_id, event_id, event_type, epoch_us(ts) / 1e6 AS seconds, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events"


def _timed(spark, sf_dir):
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", seconds.alias("seconds"), (F.col("event_type") == "error").alias("failed"))


@query(
    f"""WITH RECURSIVE e AS ({_TIMED}), s AS (SELECT user_id, event_id, n, [seconds] AS hits, true AS allowed, 0 AS retry_after FROM e WHERE n = 1 UNION ALL
SELECT user_id, event_id, n, CASE WHEN len(h) < 3 THEN list_append(h, seconds) ELSE h END, len(h) < 3, CASE WHEN len(h) < 3 THEN 0 ELSE CAST(floor(86400 - (seconds - h[1])) AS INTEGER) + 1 END
FROM (SELECT e.user_id, e.event_id, e.n, e.seconds, list_filter(s.hits, lambda h: e.seconds - h <= 86400) AS h FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)) SELECT event_id, user_id, allowed, retry_after FROM s"""
)
def rate_limit(spark, sf_dir):
    found = limits.rate_limited(_timed(spark, sf_dir), "user_id", "seconds", ["seconds", "event_id"], limit=3, window=86400.0)
    return found.select("event_id", "user_id", "allowed", "retry_after")


_STEP = "CASE WHEN NOT through THEN f WHEN failed THEN least(f, 2) + 1 ELSE 0 END"


@query(
    f"""WITH RECURSIVE e AS ({_TIMED}), s AS (SELECT user_id, event_id, n, CASE WHEN failed THEN 1 ELSE 0 END AS f, 0.0::DOUBLE AS opened, true AS allowed FROM e WHERE n = 1 UNION ALL
SELECT user_id, event_id, n, {_STEP}, CASE WHEN through AND failed AND {_STEP} >= 3 THEN seconds ELSE opened END, through
FROM (SELECT e.user_id, e.event_id, e.n, e.seconds, e.failed, s.f, s.opened, s.f < 3 OR e.seconds - s.opened >= 86400 AS through FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)) SELECT event_id, user_id, allowed FROM s"""
)
def circuit_breaker(spark, sf_dir):
    found = limits.guarded(_timed(spark, sf_dir), "user_id", "seconds", "failed", ["seconds", "event_id"], cooldown=86400.0)
    return found.select("event_id", "user_id", "allowed")


@query(
    f"""WITH RECURSIVE e AS ({_TIMED}), s AS (SELECT user_id, event_id, n, [event_type] AS k, [event_id] AS v, false AS hit, event_id AS served FROM e WHERE n = 1 UNION ALL
SELECT user_id, event_id, n, CASE WHEN p > 0 THEN k ELSE list_append(k, event_type)[-3:] END, CASE WHEN p > 0 THEN v ELSE list_append(v, event_id)[-3:] END, p > 0, CASE WHEN p > 0 THEN v[p] ELSE event_id END
FROM (SELECT e.user_id, e.event_id, e.n, e.event_type, s.k, s.v, coalesce(list_position(s.k, e.event_type), 0) AS p FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)) SELECT event_id, user_id, hit, served FROM s"""
)
def fifo_cache(spark, sf_dir):
    """What a cache of three keys for each user serves."""
    found = limits.cached(_timed(spark, sf_dir), "user_id", "event_type", "event_id", ["seconds", "event_id"], capacity=3)
    return found.select("event_id", "user_id", "hit", "served")


_BOXES = "SELECT l_orderkey AS page, l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey AS id, CAST(l_partkey % 50 AS DOUBLE) AS x, CAST(l_suppkey % 40 AS DOUBLE) AS y, 5 + l_quantity AS width, 5 + l_discount * 200 AS height FROM <lineitem>"
_SHARED = "greatest(least(e.x + e.width, o.x + o.width) - greatest(e.x, o.x), 0) * greatest(least(e.y + e.height, o.y + o.height) - greatest(e.y, o.y), 0)"


@query(
    f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY width DESC, id, x, y, height) AS n FROM ({_BOXES})), s AS (SELECT page, n, [{{'x': x, 'y': y, 'width': width, 'height': height}}] AS kept, id, true AS stays FROM e WHERE n = 1 UNION ALL
SELECT page, n, CASE WHEN clash = 0 THEN list_append(kept, {{'x': x, 'y': y, 'width': width, 'height': height}}) ELSE kept END, id, clash = 0 FROM (SELECT e.page, e.n, e.id, e.x, e.y, e.width, e.height, s.kept,
len(list_filter(s.kept, lambda o: {_SHARED} > 0 AND {_SHARED} >= 0.3 * (e.width * e.height + o.width * o.height - {_SHARED}))) AS clash FROM s JOIN e ON e.page = s.page AND e.n = s.n + 1)) SELECT page, id FROM s WHERE stays"""
)
def nms_greedy(spark, sf_dir):
    return layout.suppressed(view(spark, sf_dir, _BOXES), ["page"], [F.desc("width"), F.col("id"), F.col("x"), F.col("y"), F.col("height")], 0.3).select("page", "id")
