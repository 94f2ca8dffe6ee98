import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import bundle, metrics, retrieval, vector_index
from fieldloom.sources import evaluation


def test_counters_of_one_action_equal_counts(spark):
    rows = [(i, ["request", "cache_hit", "cache_miss", "open_skip"][i % 4], i % 3 == 0, float(i)) for i in range(100)]
    calls = spark.createDataFrame(rows, "i int, kind string, failed boolean, seconds double")
    run = metrics.Run()
    counters = metrics.interpretation_counters(F.col("kind"), F.col("failed"), F.col("seconds"))
    seen = run.stage(run.stage(calls, "calls", **counters).where("NOT failed"), "good", n=F.count(F.lit(1)))
    seen.write.format("noop").mode("overwrite").save()
    found = run.snapshot()
    assert found["good"] == {"n": 66}
    counted = metrics.counted(calls, [], counters).first().asDict()
    assert metrics.averaged(found["calls"]) == counted
    assert counted["requests"] == 25 and counted["failures"] == 9 and counted["average_seconds"] == 48.0
    assert metrics.averaged({"requests": 0, "total_seconds": 0.0}) == {"requests": 0, "average_seconds": 0.0}
    with pytest.raises(ValueError):
        run.stage(calls, "calls", n=F.count(F.lit(1)))


def test_counters_of_a_stream(spark, tmp_path):
    for part in range(3):
        spark.range(part * 10, part * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    listener = metrics.StreamCounters()
    spark.streams.addListener(listener)
    try:
        rows = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).observe("rows", F.count(F.lit(1)).alias("n"), F.sum("id").alias("sum"))
        rows.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination(60)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    finally:
        spark.streams.removeListener(listener)
    assert listener.totals["rows"] == {"n": 30, "sum": 435} and listener.batches >= 3


def test_truth_files_and_sinks(spark, tmp_path):
    pixel = {"x": 100, "y": 50, "width": 200, "height": 10, "image_width": 1000, "image_height": 500}
    (tmp_path / "gt").mkdir()
    (tmp_path / "gt/a.json").write_text(json.dumps({"form_id": "f1", "language": "en", "fields": [{"field_id": "name", "label": "Name", "type": "text", "pixel": pixel}, {"field_id": "bare", "label": "B", "type": "text"}]}, indent=1))
    (tmp_path / "gt/b.json").write_text("{ no json")
    files = evaluation.truth_files(spark, str(tmp_path / "gt"))
    assert {r.file: r._corrupt is not None for r in files.collect()} == {"a": False, "b": True}
    assert [tuple(r) for r in evaluation.true_fields(files).collect()] == [("a", "f1", "en", "name", "Name", "text", 0.1, 0.1, 0.2, 0.02)]
    first = spark.createDataFrame([("s1", "clean", 0.5), ("s2", "noisy", None)], "sample string, variant string, recall double")
    for kind in ("json", "csv"):
        out = str(tmp_path / kind)
        evaluation.write_results(first, out, ["variant"], kind)
        evaluation.write_results(first.where("variant = 'clean'").withColumn("recall", F.lit(0.75)), out, ["variant"], kind)
        back = spark.read.schema("sample string, recall double, variant string")
        rows = back.json(out) if kind == "json" else back.option("header", True).csv(out)
        assert {(r.sample, r.variant, r.recall) for r in rows.collect()} == {("s1", "clean", 0.75), ("s2", "noisy", None)}
    sheet = str(tmp_path / "sheet")
    for samples in ([("s1", "en")], [("s9", "hi")]):
        evaluation.review_sheet(spark.createDataFrame(samples, "sample string, language string"), sheet)
    assert [r.sample for r in spark.read.option("header", True).csv(sheet).collect()] == ["s1"]


def test_index_finds_what_the_whole_search_finds(spark, tmp_path):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16)) * 3
    vectors = [(i, (centres[rng.integers(20)] + rng.normal(size=16)).tolist(), i % 3) for i in range(3000)] + [(9000 + i, [0.0] * 16, 0) for i in range(40)] + [(9999, None, 0)]
    rows = spark.createDataFrame(vectors, "id long, v array<double>, kind int")
    vector_index.build(rows, str(tmp_path / "index"), "id", "v", ["kind"])
    asked = rows.where("id % 50 = 0")
    pairs = lambda df: {(r.query, r.vector, r["rank"]) for r in df.collect()}
    whole = pairs(retrieval.vector_topk(asked, rows, "id", "v"))
    assert pairs(vector_index.search(asked, str(tmp_path / "index"), "id", "v", probes=2, exact=True)) == whole
    near = pairs(vector_index.search(asked, str(tmp_path / "index"), "id", "v"))
    assert len({p[:2] for p in near} & {p[:2] for p in whole}) >= 0.95 * len(whole)
    of_kind = pairs(retrieval.vector_topk(asked, rows.where("kind = 2"), "id", "v"))
    assert pairs(vector_index.search(asked, str(tmp_path / "index"), "id", "v", probes=1, exact=True, equal={"kind": 2})) == of_kind
    plan = vector_index.search(asked, str(tmp_path / "index"), "id", "v", equal={"kind": 2})._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(kind,2)" in plan


def test_empty_index(spark, tmp_path):
    none = spark.createDataFrame([], "id long, v array<double>, kind int")
    vector_index.build(none, str(tmp_path / "index"), "id", "v", ["kind"])
    assert vector_index.search(none, str(tmp_path / "index"), "id", "v").count() == 0


def test_chains_are_whole():
    # each source says what to enter, in an order of steps without gaps
    chains = {}
    for source, part, step, *_ in bundle.CHAINS:
        chains.setdefault((source, part), []).append(step)
    assert all(steps == list(range(len(steps))) for steps in chains.values())
    assert {s for s, p in chains if p == "what_to_enter"} == {"known", "interpreted", "classified", "concept", "dictionary", "retrieved", "model", "pattern", "unavailable", "unlabelled"}
    assert not {s for s, p in chains if p == "notice"} & {"known", "unavailable", "unlabelled"}


def test_bundle_keeps_languages_apart(spark):
    fields = spark.createDataFrame([(1, "model", 0.5, "Label", None, None), (2, "unavailable", None, " ", None, None), (3, "known", None, None, None, "dob")], "field int, source string, score double, label string, display_label string, concept string")
    texts = [(1, "ai", "what_to_enter", "en", "Your name"), (3, "kb", "what_to_enter", "hi", "janm tithi"), (3, "entry", "what_to_enter", "hi", "जन्म तिथि"), (3, "kb", "what_to_enter", "en", "Birth"), (3, "kb", "example", "", "1990")]
    messages = spark.createDataFrame([("unavailable", "en", "None"), ("unlabelled", "en", "No label"), ("verify_notice", "hi", "जाँचें"), ("verify_notice", "en", "Check")], "key string, language string, message string")
    rows = {(r.field, r.language): r for r in bundle.bundle(fields, spark.createDataFrame(texts, "field int, origin string, part string, language string, text string"), messages, ["en", "hi"]).collect()}
    assert (rows[1, "en"].source, rows[1, "en"].what_to_enter, rows[1, "en"].notice, rows[1, "en"].simple_label) == ("model", "Your name", "Check", "Label")
    assert (rows[1, "hi"].source, rows[1, "hi"].what_to_enter, rows[1, "hi"].notice, rows[1, "hi"].confidence) == ("unavailable", "None", None, 0.2)
    assert rows[2, "hi"].what_to_enter == "No label" and rows[2, "en"].simple_label == "Field"
    assert rows[3, "hi"].what_to_enter == "जन्म तिथि" and rows[3, "en"].what_to_enter == "Birth" and rows[3, "en"].simple_label == "dob" and rows[3, "en"].example == "1990"
