import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from fieldloom.llm import context_mixing as cm

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, score string, shard int"
HELD = "crc32(cast(doc_id as string)) % 10 = 0"


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), "\n"]


def texts():
    words = [a + b for a in ("the", "ing", "sta", "on", "re") for b in ("n", "th", "er", "al", "")]
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(words, rng.integers(1, 80))), "x", i) for i in range(200)]
    return rows + [(200, None, None, None), (201, "", "", 0), (202, "W" * 3000 + " é ü\n\tThe", "", 1), (None, "the the", "", 1), (3, rows[3][1], "", 2), (3, rows[3][1], "", 2)]


def test_base_and_score(spark):
    rows = texts()
    out = cm.scored(spark.createDataFrame(rows, SCHEMA), F.expr(HELD)).collect()
    assert len(out) == len(rows)
    learn = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 != 0
    count = Counter(w for i, t, *_ in rows if learn(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    want = sorted((str(i), not learn(i), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n, round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 6)) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    assert all(r.score < 0 and np.isfinite(r.score) and r.bits_per_byte > 0 for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > 1.3 * sum(r.base_score for r in held)


def test_bits_sum_to_one():
    """After any context, the probabilities of all bytes add up to one."""
    mixer, sizes = cm.Mixer(), cm.table_bits(1000)
    lengths = cm.code_lengths(np.arange(1, 257) ** 3, 15)
    code = (lengths.astype(np.int64), cm.canonical_codes(lengths).astype(np.int64))
    tables = np.random.default_rng(1).integers(0, 40, (cm.table_starts(sizes)[-1], 2))
    bits = cm.Bits([b"th" + bytes([b]) for b in range(256)], np.zeros(256, np.int64), sizes, code)
    counts = tables[bits.slot].astype(np.float32)
    x = np.concatenate([cm.predictions(counts), np.full((1, len(bits.bit)), 0.3, np.float32)])
    gate = cm.Mixer.gate(*(cm.grade(counts[k].sum(-1)) for k in (cm.WHOLE_CLASS, cm.WHOLE_ANY)), bits.depth)
    p = mixer.refined(mixer.mixed(x, gate), gate)
    p = np.where(bits.bit == 1, p, 1 - p)
    before, own = int(lengths[116]) + int(lengths[104]), np.concatenate([[0], np.cumsum(np.bincount(bits.word))])
    total = sum(p[own[b] + before : own[b] + before + lengths[b]].prod() for b in range(256))
    assert abs(total - 1) < 1e-5


def test_words_of_a_class_sum_to_one():
    """With any weights, the words of a vocabulary have all probability that their spellings have."""
    rng, mixer = np.random.default_rng(2), cm.Mixer()
    spelled, count = rng.dirichlet(np.ones(50)), rng.integers(0, 3, (2, 50))
    shares = count / count.sum(1, keepdims=True)
    of_class = np.full(50, 3)
    before = mixer.sources[3].copy()
    mixer.learn_words(np.log(spelled), shares, of_class, count[0])
    assert abs((mixer.sources[3] - before).sum() - count[0].sum()) < 1e-9
    weight = mixer.sources[3] / mixer.sources[3].sum()
    got = np.exp(mixer.words(np.log(spelled), shares, of_class))
    assert abs(got.sum() - 1) < 1e-9 and np.allclose(got, weight @ np.stack([spelled, *shares]))
    # a word too long for a double's range
    assert np.isfinite(mixer.words(np.array([-5000.0]), np.zeros((2, 1)), of_class[:1])).all()


def test_overloaded_tables_keep_word_counts(spark, monkeypatch):
    """Where all contexts share few slots, scores of known words still come from their own counts."""
    monkeypatch.setattr(cm, "table_bits", lambda distinct: [4] * len(cm.PREDICTORS))
    held = [r for r in cm.scored(spark.createDataFrame(texts()[:200], SCHEMA), F.expr(HELD)).collect() if r.held_out]
    assert sum(r.score for r in held) > 1.1 * sum(r.base_score for r in held)


def test_pairs_against_brute_force(spark, monkeypatch):
    """With pairs alone, training texts score as counted in plain Python, but for their class; shards that stand twice count twice."""
    monkeypatch.setattr(cm, "pair_weights", lambda total: np.ones(cm.BEFORE))
    rows = texts()
    frame = spark.createDataFrame(rows, SCHEMA)
    out = cm.scored(frame.unionAll(frame), F.lit(False)).collect()
    assert len(out) == 2 * len(rows)
    pairs, before, want = Counter(), Counter(), {}
    for _, t, *_ in rows:
        w = tokens(t)
        pairs.update(zip(["\n", *w[:-1]], w, strict=True))
        before.update(["\n", *w[:-1]])
    for i, t, *_ in rows:
        w = tokens(t)
        want[i] = sum(math.log10(pairs[p, x] / before[p]) for p, x in zip(["\n", *w[:-1]], w, strict=True))
    rest = {round(r.score - want[r.doc_id], 6) for r in out}
    assert len(rest) <= cm.CLASSES and max(rest) <= 0


def test_pairs_help_held_out_texts(spark, monkeypatch):
    """Texts whose words follow each other by rule score better with the pairs than without."""
    rng, step = np.random.default_rng(3), np.random.default_rng(4).permutation(60)
    rows = []
    for i in range(150):
        w = [int(rng.integers(60))]
        while len(w) < 40:
            w.append(int(step[w[-1]]) if rng.random() < 0.8 else int(rng.integers(60)))
        rows.append((i, " ".join(f"w{x}" for x in w), "x", i))
    frame = spark.createDataFrame(rows, SCHEMA)
    total = lambda: cm.scored(frame, F.expr(HELD)).where("held_out").agg(F.sum("score")).first()[0]
    mixed = total()
    monkeypatch.setattr(cm, "pair_weights", lambda total: np.zeros(cm.BEFORE))
    assert mixed > 0.7 * total()


def test_pair_weights_are_of_greatest_likelihood():
    total = np.zeros((cm.BEFORE, cm.RATIOS))
    total[5, [0, 100, 130, 150]] = [400, 300, 200, 100]
    got = cm.pair_weights(total)
    ratio = np.exp((np.arange(cm.RATIOS) - cm.RATIOS // 2) * cm.RATIO_WIDTH)
    ratio[0] = 0
    grid = np.linspace(0.001, 0.999, 999)
    best = grid[np.argmax([(total[5] * np.log(g * ratio + 1 - g)).sum() for g in grid])]
    assert abs(got[5] - best) < 0.01 and got[6] < 1e-9


def test_without_rows_or_training(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert cm.scored(empty, F.expr(HELD)).count() == 0
    alone = cm.scored(spark.createDataFrame([(1, "a b", "", 0)], SCHEMA), F.lit(True)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in alone] == [(3, 0, 0)]


def test_row_groups_hold_few_shards(spark, monkeypatch):
    from fieldloom.llm import shared

    made, written = {}, shared.written

    def kept(df, name, **options):
        made[name] = written(df, name, **options)
        return made[name]

    monkeypatch.setattr(cm, "SHARD_BYTES", 100)
    monkeypatch.setattr(cm, "PIECE_BYTES", 100)
    monkeypatch.setattr(cm.shared, "written", kept)
    docs = spark.createDataFrame([(i, f"word{i % 7} and other words " * 5) for i in range(40)], "doc_id long, text string").coalesce(1)
    assert cm.scored(docs, F.col("doc_id") % 10 == 0).count() == 40
    for name in ("lm-shards", "lm-tokens"):
        files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in made[name].inputFiles()]
        assert sum(m.num_rows for m in files) > 10
        assert all(m.row_group(i).num_rows <= 2 for m in files for i in range(m.num_row_groups))
