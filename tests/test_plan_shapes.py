"""Plans whose shape bounds a task's memory or the work on a large table."""

from fieldloom.operators import bundle, pages


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_dealt_before_they_are_grouped(spark):
    fields = spark.createDataFrame([(1, "model", 0.5, "Label", None, None)], "field int, source string, score double, label string, display_label string, concept string")
    texts = spark.createDataFrame([(1, "ai", "what_to_enter", "en", "Your name"), (1, "ai", "what_to_enter", "en", "A name")], "field int, origin string, part string, language string, text string")
    messages = spark.createDataFrame([("unavailable", "en", "None")], "key string, language string, message string")
    rows = bundle.bundle(fields, texts, messages, ["en", "hi"])
    totals = bundle.bundle_totals(rows, ["field"])
    for df in (rows, totals):
        text = plan(df)[1].split("REPARTITION_BY_COL")
        assert len(text) > 1
        # below the exchange of the texts nothing is aggregated up to their scan
        assert all("Aggregate" not in x.split("Scan ExistingRDD")[0] for x in text[1:])
    assert [tuple(r) for r in totals.collect()] == [(1, 2, 0.58, True, 1)]


def test_fields_of_a_union_are_judged_once(spark):
    box = "page int, id int, field_type string, x double, y double, width double, height double"
    a = [(1, 1, "text", 0.0, 0.0, 100.0, 100.0), (1, 2, "multiline", 200.0, 0.0, 100.0, 100.0), (2, 3, "text", 0.0, 0.0, 50.0, 50.0), (3, 6, "text", None, 0.0, 9.0, 9.0)]
    b = [(2, 4, "radio", 61.0, 61.0, 4.0, 4.0), (2, 5, "text", 61.0, 61.0, 4.0, 4.0), (None, 7, "text", 0.0, 0.0, 9.0, 9.0)]
    found = spark.createDataFrame(a, box).unionByName(spark.createDataFrame(b, box))
    words = [(1, 10, "For", 10.0, 10.0, 5.0, 5.0), (1, 11, "Office", 20.0, 10.0, 5.0, 5.0), *[(1, 20 + i, "w", 210.0 + 9 * i, 10.0, 5.0, 5.0) for i in range(5)], (2, 30, "word", 60.0, 60.0, 10.0, 10.0), *[(2, 40 + i, "w", 1.0 + 9 * i, 10.0, 5.0, 5.0) for i in range(4)]]
    words = spark.createDataFrame(words, "page int, id int, text string, x double, y double, width double, height double")
    kept = pages.kept_fields(found, words, ["page"], 30.0)
    assert kept.columns == found.columns
    # 1 holds a note of the office in two words, 3 four words, 4 is a mark in a word
    assert sorted(r.id for r in kept.collect()) == [2, 5, 6, 7]
    # words meet fields, and fields what goes of them
    assert plan(kept)[0].count("Join ") == 2
