import random
import re

import numpy as np
from fieldloom.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(docs, items, window=10):
    out = {}
    for doc, text in docs:
        words, hit, names = WORD.findall(lower(text)), set(), set()
        for name, item in items:
            own = WORD.findall(lower(item))
            for at in range(max(len(own) - window, 0) + 1) if own else ():
                phrase = own[at : at + window]
                for i in range(len(words) - len(phrase) + 1):
                    if words[i : i + len(phrase)] == phrase:
                        hit |= set(range(i, i + len(phrase)))
                        names.add(str(name))
        out[doc] = (len(words), len(hit), sorted(names))
    return out


def sample(seed):
    rnd = random.Random(seed)
    vocabulary = ["a", "B", "c", "dé", "e1", "ß", "x"]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, text(rnd.randint(0, 16))) for i in range(8)] + [(8, None), (9, "..."), (10, "a")]
    docs = [(i, rnd.choice(["", ". ", "\n"]).join([text(rnd.randint(0, 30)), rnd.choice(items)[1] or "", text(rnd.randint(0, 9))])) for i in range(60)]
    return [*docs, (60, None), (61, ""), (62, "long " * 3000 + (items[0][1] or "")), (63, docs[0][1])], items


def test_index_counts_and_places():
    rnd = np.random.default_rng(3)
    text = rnd.integers(0, 4, 500)
    text[100:300] = text[300:500]
    index = D.FMIndex(text, 4)
    phrases = np.array([[a, b, c] for a in (1, 2, 3) for b in (1, 2, 3) for c in (1, 2, 3)])
    low, high = index.search(phrases, np.full(len(phrases), 3))
    for phrase, a, b in zip(phrases, low, high, strict=True):
        want = [i for i in range(len(text) - 2) if (text[i : i + 3] == phrase).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_against_brute_force(spark):
    for seed in (1, 2):
        docs, items = sample(seed)
        d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS n_hit")
        b = spark.createDataFrame(items, "item_id long, text string")
        got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in D.contaminated(d, b, window=5).collect()}
        assert got == brute(docs, items, 5)


def test_parts_of_the_benchmark(spark, monkeypatch):
    docs, items = sample(4)
    monkeypatch.setattr(D, "PART_BYTES", 20)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in D.contaminated(d, b, window=5).collect()}
    assert got == brute(docs, items, 5)


def test_cutting(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(1, "Keep this sentence and all of these words here, also those: ONE two, three four five six seven eight nine ten eleven. The end is here and stays for good."), (2, item), (3, None), (4, "clean")]
    d = spark.createDataFrame([(*x, "n") for x in docs], "doc_id long, text string, id string")
    got = {r.doc_id: r.text for r in D.without_benchmark(d, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert got == {1: "Keep this sentence and all of these words here, also those: . The end is here and stays for good.", 3: None, 4: "clean"}


def test_empty_tables(spark):
    docs, items = sample(5)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert D.contaminated(d.limit(0), b).count() == 0
    assert D.contaminated(d, b.limit(0)).where("n_hit > 0").count() == 0


def test_a_benchmark_in_passes_gives_the_same(spark, monkeypatch):
    words = [f"w{i}" for i in range(40)]
    items = [(f"i{k}", " ".join(words[k : k + 12])) for k in range(0, 25, 5)] + [("short", "w1 w2"), ("none", None)]
    docs = [(i, " ".join(words[i : i + 20]) + " end") for i in range(15)] + [(99, None), (3, "w1 w2")]
    d, b = spark.createDataFrame([(*x, 1.5) for x in docs], "doc_id long, text string, n double"), spark.createDataFrame(items, "item_id string, text string")
    whole = sorted(map(tuple, D.contaminated(d, b).collect()), key=repr)
    cut = sorted(map(tuple, D.without_benchmark(d, b, drop_share=0.9).collect()), key=repr)
    monkeypatch.setattr(D, "PART_BYTES", 60)
    assert sorted(map(tuple, D.contaminated(d, b).collect()), key=repr) == whole
    assert sorted(map(tuple, D.without_benchmark(d, b, drop_share=0.9).collect()), key=repr) == cut
