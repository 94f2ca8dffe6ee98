import math
import random

import numpy as np
from pyspark.sql import functions as F

from fieldloom.llm import quality as Q


def sample(n=400):
    rnd = random.Random(2)
    good = lambda: " ".join(rnd.choice(["the", "reader", "opens", "a", "book", "of", "old", "maps"]) for _ in range(rnd.randint(5, 60)))
    bad = lambda: " ".join(rnd.choice(["buy!!", "CLICK", "$$$", "the"]) for _ in range(rnd.randint(5, 60)))
    docs = [(i, good() if i % 4 else bad()) for i in range(n)]
    return [*docs, (n, None), (n + 1, ""), (n + 2, "map " * 20_000)], [(i, int(i % 4 > 0)) for i in range(0, n, 2)] + [(1, None), (10**6, 1), (4, 1)]


def frames(spark):
    docs, labels = sample()
    return spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, weight double"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy(spark):
    docs, labels = frames(spark)
    rows = {r.doc_id: r for r in Q.quality(docs, labels).collect()}
    assert all(rows[i].accepted == (i % 4 > 0) for i in range(400))
    assert not rows[400].accepted and not rows[401].accepted and rows[400].n_grams == 0
    assert len(rows) == 403


def test_weights_against_brute_force(spark):
    docs, labels = frames(spark)
    texts = dict(sample()[0])
    grams = {i: Q.features(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))[0] for i, t in texts.items()}
    fold = {r.id for r in spark.createDataFrame([(i,) for i in texts], "id long").where(F.pmod(F.xxhash64("id", F.lit("cut")), F.lit(Q.CUT_FOLDS)) == 0).collect()}
    assert 0.3 < len(fold) / len(texts) < 0.7
    good = [i for i, q in sample()[1] if q == 1 and i in texts and i != 4 and i not in fold]
    count = lambda ids: np.bincount(np.concatenate([grams[i] for i in ids]), minlength=Q.BUCKETS) + Q.SMOOTHING
    target, raw = count(good), count(texts)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    for r in Q.quality(docs, labels).collect():
        assert math.isclose(r.weight, ratio[grams[r.doc_id]].mean() if len(grams[r.doc_id]) else 0, abs_tol=1e-9)


def test_accepts_exactly_k(spark):
    values = [random.Random(1).choice([0.5, -3.0, 7.25, 1e9]) + i % 7 for i in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 2, 17, 150, 299, 300, 400):
        assert Q.kth_largest(df, "x", k) == sorted(values, reverse=True)[min(k, 300) - 1]


def test_stage_and_empty(spark):
    docs, labels = frames(spark)
    kept = Q.accepted_only(docs, labels)
    accepted = {r.doc_id for r in Q.quality(docs, labels).where("accepted").collect()}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == accepted >= {i for i in range(400) if i % 4}
    assert Q.quality(docs.limit(0), labels).count() == 0
    assert Q.quality(docs, labels.limit(0)).where("accepted").count() == 401


def test_repeated_rows_count_each_time(spark):
    docs, labels = frames(spark)
    twice = docs.unionByName(docs.where("doc_id < 8"))
    rows = Q.quality(twice, labels).where("doc_id < 8").collect()
    assert len(rows) == 16 and len({(r.doc_id, r.weight, r.key, r.accepted) for r in rows}) == 8


def test_texts_are_not_shuffled(spark):
    """Labels travel to the texts, so the plan of the counting scan has no exchange below the texts' side."""
    docs, labels = frames(spark)
    known = F.broadcast(labels.selectExpr("doc_id AS id", "quality AS good").limit(10))
    plan = docs.selectExpr("doc_id AS id", "text").join(known, "id", "left")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_equal_texts_have_equal_weights_under_any_partitioning(spark):
    docs, labels = frames(spark)
    copies = docs.where("doc_id < 40").select((F.col("doc_id") + 5000).alias("doc_id"), "text", "weight")
    runs = []
    for parts in (1, 5, 37):
        rows = {r.doc_id: (r.weight, r.key, r.accepted) for r in Q.quality(docs.unionByName(copies).repartition(parts), labels).collect()}
        assert all(rows[i] == rows[i + 5000] for i in range(40))
        runs.append(rows)
    assert runs[0] == runs[1] == runs[2]
