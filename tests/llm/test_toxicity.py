import numpy as np
from pyspark.sql import functions as F

from fieldloom.llm import toxicity as tx

SCHEMA = "doc_id long, text string, id string, score int"


def corpus():
    rng = np.random.default_rng(2)
    plain, bad, terms = [f"w{i}" for i in range(300)], ["idiot", "scum", "moron"], [t for v in tx.IDENTITY.values() for t in v]
    docs, labels = [], []
    for i in range(600):
        words = rng.choice(plain, 30).tolist()
        toxic = i % 4 == 0
        if toxic:
            words[int(rng.integers(30))] = str(rng.choice(bad))
        if rng.random() < (0.8 if toxic else 0.1):
            words.append(str(rng.choice(terms)))  # mentions go with toxic labels, but aren't their cause
        docs.append((i, " ".join(words), "x", 1))
        labels.append((i, int(toxic), "y"))
    return docs, labels


def test_held_out_and_neutral_mentions(spark):
    docs, labels = corpus()
    table, known = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([*labels, (3, None, ""), (9999, 1, ""), (None, 1, "")], "doc_id long, toxic int, text string")
    model = tx.fit(table, known, F.col("doc_id") % 5 != 0)
    score = {r.doc_id: r.score for r in tx.scores(table, model).collect()}
    held = [i for i in range(0, 600, 5)]
    assert np.mean([(score[i] >= 0.5) == (i % 4 == 0) for i in held]) > 0.97
    probe = spark.createDataFrame([(i, t, "", 0) for i, t in enumerate(["w1 w2 w3", "w1 w2 w3 muslim", "w1 w2 w3 women gay", "w1 w2 w3 idiot", None, ""])], SCHEMA)
    p = [r.score for r in tx.scores(probe, model).orderBy("doc_id").collect()]
    assert max(p[:3]) < 0.5 < p[3] and max(p[:3]) - min(p[:3]) < 0.1 and p[4] == p[5] < 0.5


def test_degenerate(spark):
    table = spark.createDataFrame([(1, "a", "", 0), (1, "a", "", 0), (None, None, None, None)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = tx.fit(table, none, F.lit(True))
    assert [r.score for r in tx.scores(table, model).collect()] == [0.5] * 3
    assert tx.scores(spark.createDataFrame([], SCHEMA), model).count() == 0


def test_long_texts_ties_and_repeated_labelled_rows(spark):
    docs = [(i, "bad words here" if i % 2 else "fine words here") for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    more = [(200, "fine " * 50_000), (201, None), (202, ""), (203, "bad " * 50_000)]
    once = spark.createDataFrame(docs + more, "doc_id long, text string")
    model = tx.fit(once, labels, F.lit(True))
    got = {r.doc_id: r.score for r in tx.scores(once, model).collect()}
    assert got[201] == got[202] and got[200] < 0.5 < got[203] and len(got) == 84
    again = tx.fit(once.unionByName(once.where("doc_id < 40")), labels, F.lit(True))
    assert (again.weight == model.weight).all() and again.bias == model.bias


def test_equal_texts_have_equal_scores_under_any_partitioning(spark):
    docs, labels = corpus()
    model = tx.fit(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int, text string"), F.col("doc_id") % 5 != 0)
    table = spark.createDataFrame([*docs, *((i + 5000, *rest) for i, *rest in docs[:60])], SCHEMA)
    runs = [{r.doc_id: r.score for r in tx.scores(table.repartition(parts), model).collect()} for parts in (1, 5, 37)]
    assert all(runs[0][i] == runs[0][i + 5000] for i in range(60))
    assert runs[0] == runs[1] == runs[2]


def test_fit_against_the_objective_in_plain_loops():
    docs, labels = corpus()
    raw = [t.encode() for _, t, *_ in docs[:160]]
    y = np.array([v for _, v, _ in labels[:160]], float)
    flat, first = tx.features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    rows = [flat[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    model = tx.Model(rows, y)
    pairs = tx._swaps(rows, np.random.default_rng(11))
    toxic = min(4.0, (y == 0).sum() / y.sum())
    used = np.flatnonzero(model.weight)

    def objective(change):
        total = 0.0
        w = lambda i: 0.0 if i < 0 else model.weight[i] + change.get(i, 0.0)
        for own, label in zip(rows, y, strict=True):
            score = model.bias + change.get("bias", 0.0) + sum(w(i) for i in own)
            total += (toxic if label else 1.0) * (np.log1p(np.exp(score)) - label * score)
        return total + tx.COUNTERFACTUAL / 2 * sum((w(b) - w(a)) ** 2 for a, b in pairs) + tx.L1 * sum(abs(w(i)) for i in {*used.tolist(), *(k for k in change if k != "bias")})

    best = objective({})
    assert best < objective({i: -model.weight[i] for i in used.tolist()})
    for i in [*used[:25].tolist(), "bias", int(pairs[0][1])]:
        for step in (-0.05, 0.05):
            assert objective({i: step}) > best - 1e-3 * best
