from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import facts, fields, geometry, text, validation

#: kind, an answer that stands, one that does not.
ANSWERS = [("mobile_in", "91 8123456701", "4123456701"), ("pincode_in", "೪೧೧೦೪೫", "41104"), ("aadhaar_in", "۳۱۴۱ ۵۹۲۶ ۵۳۵۸", "0141 5926 5358"), ("pan_in", "qwert6071z", "QWE16071Z"), ("ifsc_in", "ABCD0999999", "ABC00999999"), ("email", "x@y.org", "x@.org"), ("year", "१९८७", "19877"), ("blood_group", "b +", "+b"), ("date", "29/2/2024", "29/2/2023"), ("amount", "Rs 3", "3 4"), ("person_name", "Ina", "@@##"), ("alphanumeric", "7-K", "-7"), ("decimal", "1e3", "1e"), ("integer", "007", "7.0")]


def column(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(f(F.col("t"))).first()[0]


def test_answers(spark):
    rows = [(k, v, i == 0) for k, *pair in ANSWERS for i, v in enumerate(pair)] + [("email", None, False)]
    got = spark.createDataFrame(rows, "kind string, value string, ok boolean").withColumn("got", validation.valid(F.col("kind"), F.col("value"))).collect()
    assert [r for r in got if r.got != r.ok] == []


def test_every_kind_is_tried():
    assert {k for k, *_ in ANSWERS} | {"phone", "bank_account"} == set(validation.KINDS)


@pytest.mark.parametrize(("value", "tokens", "script"), [("पूरा नाम", ["पूरा", "नाम"], "devanagari"), ("Full Name / पूरा नाम", ["full", "name", "पूरा", "नाम"], "devanagari"), ("Größe 12", ["gr", "e", "12"], "latin"), ("12 !", ["12"], "unknown"), (None, [], "unknown"), ("ಅಆ अ", ["ಅಆ", "अ"], "kannada"), ("ಅ अ", ["ಅ", "अ"], "devanagari")])
def test_tokens_and_scripts(spark, value, tokens, script):
    row = spark.createDataFrame([(value,)], "t string").select(text.tokens(F.col("t")).alias("a"), text.dominant_script(F.col("t")).alias("b")).first()
    assert (row.a, row.b) == (tokens, script)


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (text.tidy_caption, "حصہ حصہ cou EPIC", "حصہ EPIC"),
        (text.tidy_caption, "the the of the", "the of the"),
        (text.question_caption, "Name of applicant: ........", "Name of applicant"),
        (text.question_caption, "：وارڈ", "وارڈ"),
        (text.question_caption, "No colon", None),
        (text.question_caption, ":", None),
        (text.leader_run, "a.. b.... c____ d", "...."),
        (text.leader_run, "a.. b", None),
        (text.parenthetical_hint, " of (name of the child......) and", "name of the child"),
        (text.parenthetical_hint, "(ab)", None),
        (lambda c: text.cut_at_word(c, 9), "one  two three", "one two"),
        (lambda c: F.array_join(text.initialisms(c), ","), "the IFSC, PAN AND PAN ÉPIC Tab", "IFSC,PAN"),
        (lambda c: F.array_join(text.wrapped(c, F.lit(5.0)), "|"), "a bcd efghijklmnop qr s", "a bcd|efghijklmnop|qr s"),
        (lambda c: text.fitting_size(c, F.lit(50.0), F.lit(30.0)), "ab cd", 20.0),
        (lambda c: text.fitting_size(c, F.lit(5.0), F.lit(30.0)), "abcdefgh", None),
        (text.match_fold, "ÉCOLE  No. ५", "ecole no ५"),
        (text.match_fold, "آدھار ـكتاب", "ادھار کتاب"),
        (text.match_fold, None, ""),
    ],
)
def test_captions(spark, f, value, want):
    assert column(spark, value, f) == want


def test_vowel_signs_do_not_count(spark):
    assert column(spark, "पूरा नाम", text.match_fold) == column(spark, "परा नम", text.match_fold)


CARD = "UIDAI\nname: Lotte Brandvold |\nDate of Birth\n\n09-04-1971\nFemale\n3141-5926 5358\nAddress: House 9\nOld Quarter 5\nNashik, 422001\nlast"


def read(spark, value):
    return spark.createDataFrame([(value,)], "t string").select(*[c.alias(k) for k, c in facts.facts(F.col("t")).items()]).first().asDict()


def test_facts_of_a_card(spark):
    assert read(spark, CARD) == {"kind": "Aadhaar", "full_name": "Lotte Brandvold", "father_name": None, "gender": "Female", "date_of_birth": "09/04/1971", "aadhaar_number": "3141 5926 5358", "pan_number": None, "voter_id": None, "address": "House 9, Old Quarter 5, Nashik", "pincode": "422001"}


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("Permanent Account\nTomas Eklund\nFather's Name:\nPer Eklund\nqwert6071z", {"kind": "PAN", "full_name": "Tomas Eklund", "father_name": "Per Eklund", "pan_number": "QWERT6071Z"}),
        ("Elector\nD/O - Sam Okafor\nRuth Okafor\nxyz7654321 पुरुष", {"kind": "voter card", "full_name": "Ruth Okafor", "father_name": "Sam Okafor", "voter_id": "XYZ7654321", "gender": "Male"}),
        # a label without a value before the next question names nobody; the address ends the search for a person
        ("name\nPlace:\naddress\nKarl Lind", {"full_name": None, "address": "Karl Lind"}),
        ("dob\na\nb\n01/02/1990", {"date_of_birth": "01/02/1990"}),
        ("dob\na\nb\n01/02/1990 03/04/1991", {"date_of_birth": None}),
        (None, {"kind": "supporting document", "full_name": None, "address": None}),
        ("", {"kind": "supporting document"}),
    ],
)
def test_facts_by_place(spark, value, want):
    got = read(spark, value)
    assert {k: got[k] for k in want} == want


def test_ages(spark):
    ages = spark.createDataFrame([("09/04/1971",), ("31/02/2020",), ("6/11/2000",), ("1/1/2030",), ("1/1/1900",), (None,)], "d string").select(facts.age(F.col("d"), F.lit("2026-11-05").cast("date"))).collect()
    assert [r[0] for r in ages] == [55, None, 25, None, None, None]


def test_marks_and_sizes(spark):
    size = lambda kind, w, h: fields.plausible_size(F.lit(kind), F.lit(w), F.lit(h), F.lit(1000), F.lit(500))
    row = spark.range(1).select(size("radio", 10, 36), size("radio", 37, 20), size("text", 119, 20), size("text", 120, 111), size("text", 120, 110)).first()
    assert list(row) == [True, False, False, False, True]


def test_declaration_marks(spark):
    rows = [("I declare that all I said is true and mine", "", True), ("short", "", False), (None, None, False), ("x", "one two three four five six seven eight nine", True)]
    got = spark.createDataFrame(rows, "s string, n string, want boolean").select(fields.declaration_mark(F.col("s"), F.col("n")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_same_places(spark):
    b = lambda *v: tuple(map(F.lit, v))
    tall, below = b(0.0, 0.0, 10.0, 100.0), b(0.0, 100.0, 10.0, 10.0)
    row = spark.range(1).select(geometry.same_target(tall, below), geometry.same_target(tall, b(0.0, 95.0, 10.0, 10.0)), geometry.same_region(tall, b(5.0, 0.0, 10.0, 100.0)), geometry.contains(tall, b(0.0, 0.0, 10.0, 90.0), 0.0, 0.85)).first()
    assert list(row) == [False, True, False, False]


def test_the_ratio_bound_loses_no_pair(spark):
    from fieldloom.operators.resolve import similar_tokens

    words = ["nane", "name", "mother", "brother", "birlh", "birth", "annua1", "annual", "aabbcc", "abcabc", "aaaa", "aaab", "b"]
    df = spark.createDataFrame([(w,) for w in words], "a string")
    got = {(r.a, r.b): round(r.r, 9) for r in similar_tokens(df, df.withColumnRenamed("a", "b"), 0.72, 1).collect()}
    ratio = lambda a, b: SequenceMatcher(None, a, b).ratio()
    assert got == {(a, b): round(ratio(a, b), 9) for a in words for b in words if abs(len(a) - len(b)) <= 1 and ratio(a, b) >= 0.72}


def test_facts_find_the_lines_of_a_text_once(spark):
    cards = spark.createDataFrame([(1, "Name: Ina Rey\ndob 01.02.1990\nAddress: 3 Hill Road\nPune 411045"), (2, None)], "card int, t string")
    found = facts.with_facts(cards, "t", "card")
    rows = {r.card: r.asDict() for r in found.collect()}
    assert rows[1]["full_name"] == "Ina Rey" and rows[1]["date_of_birth"] == "01/02/1990" and rows[1]["address"] == "3 Hill Road, Pune" and rows[1]["pincode"] == "411045"
    assert rows[2] == {"card": 2, "kind": "supporting document"} | {k: None for k in facts.FACTS if k != "kind"}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
