import importlib.util

import corpus_pipeline
from fieldloom.llm import decontaminate, exact_dedup, near_dedup, quality


def test_stages_on_a_small_corpus(spark, tmp_path):
    assert importlib.util.find_spec("corpus_pipeline")
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    good = [" ".join(f"word{(i * 7 + k) % 50} of" for k in range(25 + i % 5)) for i in range(40)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(good)]
    rows += [(100, good[3] + "  ", "en", "s", 9), (101, good[4] + " more", "en", "s", 9), (102, good[5] + ". " + item, "en", "s", 9), (103, None, None, None, None), (104, "", "", "", 0)]
    rows += [(200 + i, "$$$ !!! BUY " * (9 + i), "en", "s", 1) for i in range(20)]
    rows += [rows[0], rows[0]]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(0, 40, 2)] + [(200 + i, 0) for i in range(0, 20, 2)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs = spark.createDataFrame(docs.collect(), kinds)
        seen.append({r.doc_id for r in docs.collect()})
        assert docs.count() == len(seen[-1]) or name == "quality"
    assert seen[0] == {*range(40), 100, 101, 102}
    assert seen[1] == seen[0] - {3}  # the copy with more code points stays
    assert {i for i in range(40) if i not in (3, 4)} - seen[2] == set() or len(seen[2]) < len(seen[1])
    texts = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
    assert not any("beta gamma" in t for t, _ in texts.values())
    assert all(len(t) == n for i, (t, n) in texts.items() if i == 102)
    final = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert final == seen[-1]


def test_empty_documents(spark, tmp_path):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], kinds).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert all(m.__doc__ for m in (decontaminate, exact_dedup, near_dedup, quality))
