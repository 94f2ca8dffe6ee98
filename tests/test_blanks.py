from pyspark.sql import functions as F

from fieldloom.operators import blanks

WORD = "page int, line int, id int, x double, y double, width double, height double, text string"


def line(*texts, page=0, number=0):
    """Words of 100 by 10, side by side."""
    return [(page, number, i, 110.0 * i, 5.0, 100.0, 10.0, t) for i, t in enumerate(texts)]


def led(spark, *lines):
    rows = [w for n, texts in enumerate(lines) for w in line(*texts, number=n)]
    return {(r.line, r.n): (r.caption, r.x, r.y, r.width, r.height) for r in blanks.leader_blanks(spark.createDataFrame(rows, WORD), ["page"]).collect()}


def test_leaders_name_their_blanks(spark):
    found = led(
        spark,
        ["Date", "of", "Birth:......", "Place:....", None],
        ["of", "......(name", "of", "minor", "child)", "Sex:......"],
        ["Father", "(pref)......", "of", "......"],
        ["نام:......"],
        ["no", "leader.."],
        ["Name......", "(x)"],
        ["A" * 81 + "......"],
        ["......(guardian)"],
    )
    assert found[0, 0] == ("Date of Birth", 220.0 + 50, 3.0, 50.0, 16.0)
    assert found[0, 1] == ("Place", 330.0 + 60, 3.0, 40.0, 16.0)
    assert found[1, 0][0] == "name of minor child" and found[1, 1][0] == "Sex"
    assert found[2, 0][0] == "Father" and (2, 1) not in found
    assert found[3, 0][0] == "نام"
    assert found[5, 0][0] == "Name"  # the parentheses hold too little
    assert {k[0] for k in found} == {0, 1, 2, 3, 5}  # nothing follows the last line's hint


def test_narrow_leaders_take_the_rest_of_their_word(spark):
    rows = [(0, 0, 0, 0.0, 0.0, 60.0, 30.0, "Nam...y"), (0, 1, 0, 0.0, 0.0, 60.0, 30.0, "Name......" + "y" * 10)]
    found = blanks.leader_blanks(spark.createDataFrame(rows, WORD), ["page"]).collect()
    assert [(r.line, r.x, r.width, r.height) for r in found] == [(1, 12.0, 48.0, 36.0)]


CELL = "page int, cell int, x double, y double, width double, height double, rtl boolean"
IN_CELL = "page int, cell int, id int, x double, y double, width double, height double, text string, reading_index int"


def stacked(spark, *texts, width=400.0, rtl=False, wide=100.0):
    rows = [(0, 0, i, 200.0 if rtl else 10.0, 20.0 * i, wide, 10.0, t, None) for i, t in enumerate(texts)]
    cell = spark.createDataFrame([(0, 0, 0.0, 0.0, width, 200.0, rtl)], CELL)
    return [(r.n, r.caption, r.x, r.width, r.height) for r in blanks.stacked_blanks(spark.createDataFrame(rows, IN_CELL), cell, ["page"]).orderBy("n").collect()]


def test_stacked_captions(spark):
    assert stacked(spark, "Name:", "constituency", "of elector:") == [(0, "Name", 116.0, 282.0, 16.0), (1, "constituency of elector", 116.0, 282.0, 30.0)]
    assert stacked(spark, "Name:") == [] and stacked(spark, "new photo", "paste here") == []
    assert [q[1] for q in stacked(spark, "one", "two", "three")] == ["one", "two", "three"]
    assert stacked(spark, "Name:", "Age:", rtl=True)[0][2:4] == (2.0, 192.0)
    assert stacked(spark, "Name:", "Age:", wide=370.0) == []  # no room
    assert [q[1] for q in stacked(spark, "Name:", "a sentence that fills its cell", "Age:", wide=300.0)] == ["Name", "a sentence that fills its cell Age"]


def test_labels_are_read_again(spark):
    kind = "page int, id int, x double, y double, width double, height double, label string, sub_header string, column_header string, rtl boolean"
    rows = [(0, i, 0.5, 0.2 * (i + 1), 0.2, 0.02, label, sub, None, rtl) for i, (label, sub, rtl) in enumerate([(None, "", False), ("named", None, False), (" ", "head", False), (None, None, True)])]
    words = [(0, 0, 10, 0.2, 0.2, 0.1, 0.02, "Date", 0), (0, 0, 11, 0.35, 0.2, 0.05, 0.02, "of:", 0), (0, 0, 12, 0.05, 0.2, 0.02, 0.02, "far", 0), (0, 0, 13, 0.75, 0.8, 0.1, 0.02, "| |", 3), (0, 0, 14, 0.6, 0.77, 0.1, 0.02, "above", 3), (0, 0, 15, 0.5, 0.77, 0.05, 0.02, "it", 3)]
    words = spark.createDataFrame([(p, i, x, y, w, h, t, n) for p, _, i, x, y, w, h, t, n in words], "page int, id int, x double, y double, width double, height double, text string, line int")
    found = {r.id: (r.label, r.script, r.region) for r in blanks.recovered_labels(spark.createDataFrame(rows, kind), words, ["page"]).collect()}
    assert found == {0: ("Date of", "latin", 0), 3: ("above it", "latin", 1)}


def test_empty_tables(spark):
    assert blanks.leader_blanks(spark.createDataFrame([], WORD), ["page"]).count() == 0
    assert blanks.stacked_blanks(spark.createDataFrame([], IN_CELL), spark.createDataFrame([], CELL), ["page"]).count() == 0


def test_hint_needs_a_closing_sign_in_time(spark):
    rows = [(1, "(a b c", ["d)"]), (2, "", ["(" + "x" * 80, "y)"]), (3, "(ab)", ["next"]), (4, "(name)", []), (5, None, ["(the :)", "z"])]
    df = spark.createDataFrame(rows, "id int, s string, f array<string>")
    assert {r.id: r.h for r in df.select("id", blanks.hint_behind(F.col("s"), F.col("f")).alias("h")).collect()} == {1: "a b c d", 2: None, 3: None, 4: None, 5: "the"}


def test_captions_are_computed_once(spark):
    """No window numbers the blanks, no filter computes captions again, and the fold over words runs once."""
    words = spark.createDataFrame([(0, 0, 0, 0.0, 0.0, 60.0, 30.0, "Name......")], WORD)
    plan = blanks.leader_blanks(words, ["page"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("[posexplode") + plan.count("posexplode(") == 1
    cell = spark.createDataFrame([(0, 0, 0.0, 0.0, 400.0, 200.0, False)], CELL)
    held = spark.createDataFrame([(0, 0, 0, 0.0, 0.0, 60.0, 30.0, "Name:", None)], IN_CELL)
    plan = blanks.stacked_blanks(held, cell, ["page"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") + plan.count("MapInPandas") == 1
