import random
import re

import numpy as np
from fieldloom.llm import near_dedup as N
from fieldloom.llm.components import connected_components


def brute(docs, width, percent):
    sets = {}
    for i, text in docs:
        words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(words[k : k + width]) for k in range(max(len(words) - width, 0) + 1)} if words else set()
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    names = sorted(sets)
    for i in names:
        for j in names:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i: (len(sets[i]), top(i), top(i) == i) for i in names}


def sample(seed, n=150):
    rnd = random.Random(seed)
    words = lambda k: [rnd.choice("abcdefghij") + str(rnd.randint(0, 40)) for _ in range(k)]
    base, docs = [words(rnd.randint(30, 150)) for _ in range(12)], []
    for i in range(n):
        own = list(rnd.choice(base[: rnd.randint(1, 12)]))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5, 9])):
            own[rnd.randrange(len(own))] = rnd.choice("xyz") + str(i)
        docs.append((i, " ".join(own)))
    return [*docs, (n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "one two"), (n + 6, "w " * 4000), (n + 7, "w " * 9000)]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 16)
    for seed, width, percent, rows, bands in ((1, 3, 85, 6, 24), (2, 5, 80, 5, 30)):
        docs = sample(seed)
        d = spark.createDataFrame([(*x, 1, "t") for x in docs], "doc_id long, text string, id int, set string").repartition(5)
        got = N.near_duplicates(d, width=width, percent=percent, rows=rows, bands=bands).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(docs, width, percent)
        assert len(got) == len(docs)


def test_estimates_are_unbiased():
    rnd = np.random.default_rng(5)
    errors = []
    for _ in range(60):
        pool = rnd.integers(0, 2**63, 300, dtype=np.uint64)
        x, y = np.unique(pool[:200]), np.unique(pool[100:])
        s = N.signatures(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), 64)
        errors.append((s[0] == s[1]).mean() - 100 / 300)
    assert abs(np.mean(errors)) < 0.02


def test_stage_and_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(3, text, "a"), (5, text + " more", "b"), (5, text + " more", "b"), (None, text, "c"), (9, None, "d"), (10, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    assert sorted((r.doc_id or 0, r.kept) for r in N.one_of_each(d).select("doc_id", "kept").collect() if r.kept) == [(0, "c"), (3, "a"), (9, "d")]
    assert N.one_of_each(d).columns == d.columns
    assert N.near_duplicates(d.limit(0)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 140)] + [(1, 1), (7, 3), (3, 7), (3, 9)]
    got = {r.vertex: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()}
    assert got == {**dict.fromkeys(range(100, 141), 100), 1: 1, 3: 3, 7: 3, 9: 3}


def test_texts_stay_where_they_are(spark, monkeypatch):
    plans, written = {}, N.shared.written

    def seen(df, name, **options):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return written(df, name, **options)

    monkeypatch.setattr(N.shared, "written", seen)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = sample(3)
        got = N.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), width=3, percent=85, rows=6, bands=24).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(docs, 3, 85)
    # the texts of sets meet their filter without a shuffle
    assert "SortMergeJoin" not in plans["near-sets"] and "ShuffledHashJoin" not in plans["near-sets"]
