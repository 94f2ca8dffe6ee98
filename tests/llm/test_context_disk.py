import time

import numpy as np
from pyspark.sql import functions as F

from fieldloom.llm import context_mixing as cm
from fieldloom.llm import shared


def docs(spark, n=60):
    return spark.createDataFrame([(i, f"word{i % 7} and other words ending in {i} " * 5) for i in range(n)], "doc_id long, text string").repartition(3)


def test_shuffle_files_go_when_their_query_ends(spark):
    def shuffles():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = shuffles(), spark.conf.get(name)
    frame = docs(spark)
    cm.scored(frame, F.col("doc_id") % 10 == 0)
    until = time.time() + 20
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - before
    assert spark.conf.get(name) == was


def test_words_and_pairs_are_sent_by_range(spark, monkeypatch):
    """No row for each word of a shard: each shuffle has a row for each shard and range at most."""
    plans, written = {}, shared.written

    def kept(df, name, **options):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return written(df, name, **options)

    monkeypatch.setattr(cm.shared, "written", kept)
    assert cm.scored(docs(spark), F.col("doc_id") % 10 == 0).count() == 60
    assert {"lm-words", "lm-pairs", "lm-tokens"} <= set(plans)
    assert not any(x in plan for plan in plans.values() for x in ("Generate", "Join", "HashAggregate"))


def test_common_beginnings_are_spelled_once():
    rng = np.random.default_rng(7)
    words = sorted({b"".join(rng.choice([b"a", b"b", b"th", b"er"], rng.integers(1, 9))) for _ in range(300)} | {b"x" * 200, b"x" * 199 + b"y", b"\xc3\xa9", cm.END})
    classes = np.repeat([0, 3], len(words))
    words, count = words + words, rng.integers(0, 9, 2 * len(words))
    lengths = cm.code_lengths(np.arange(1, 257), 15)
    code = (lengths.astype(np.int64), cm.canonical_codes(lengths).astype(np.int64))
    whole, once = (cm.Bits(words, classes, cm.table_bits(1000), code, once=x) for x in (False, True))
    assert len(once.bit) < 0.6 * len(whole.bit)
    for k in range(len(cm.PREDICTORS)):
        value = lambda bits: (bits.slot[k] * 3 + bits.bit + bits.depth) % 101  # noqa: B023, E731
        assert (once.gathered(value(once)) == np.bincount(whole.word, value(whole), len(words))).all()
        size = 2 * cm.table_starts(cm.table_bits(1000))[-1]
        assert (np.bincount(once.slot[k] * 2 + once.bit, once.spread(count), size) == np.bincount(whole.slot[k] * 2 + whole.bit, count[whole.word], size)).all()


def test_planes_and_ranks():
    rng = np.random.default_rng(8)
    for values in (np.zeros(0, np.uint64), np.zeros(3, np.uint64), rng.integers(0, 300, 1000).astype(np.uint64), rng.integers(0, 2**64, 1000, np.uint64)):
        assert (cm._unplanes(cm._planes(values)) == values).all()
        got, want = cm._ranked(values), np.unique(values, return_inverse=True)
        assert all((a == b).all() for a, b in zip(got, want, strict=True))


def test_ranges_of_words_cover_all_once():
    """At every number of ranges, a word has one range, the order is by range, and equal words of any shard have the same one."""
    words = [f"{a}{b}".encode() for a in ("pre", "prefix", "x") for b in range(300)]
    hashes = cm.hash_words([w.decode() for w in words])
    for bits in (1, 3, 4, 7):
        order, part = cm._local_order(cm._prefixes(words).tobytes(), hashes, np.zeros(len(words), np.int64), bits)
        assert (np.diff(part[order]) >= 0).all() and part.min() >= 0 and part.max() < 1 << bits
        some = np.arange(0, len(words), 7)
        again = cm._local_order(cm._prefixes([words[i] for i in some]).tobytes(), hashes[some], np.zeros(len(some), np.int64), bits)[1]
        assert (again == part[some]).all()
