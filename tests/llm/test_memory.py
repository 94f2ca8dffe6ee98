import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from fieldloom.llm import decontaminate, words


def peak(work):
    """MB that NumPy and Python hold at most during the second call, beyond what they hold at its begin."""
    work()
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_hashes_hold_a_stretch_at_a_time():
    data = np.random.default_rng(1).integers(97, 123, 2 << 20).astype(np.uint8)
    data[::7] = 32
    bounds = np.array([0, 1 << 20, 2 << 20])
    start = np.flatnonzero(data == 32)[:-1] + 1
    assert peak(lambda: words.hash_spans(data, start, start + 6)) < 40
    assert sum(x.nbytes for x in words._powers) < 16 << 20
    found = words.Words(data, bounds, words.SPACED)
    some = np.arange(0, len(found.start), 997)
    assert (words.hash_words([data[a:b].tobytes().decode() for a, b in zip(found.start[some], found.end[some], strict=True)]) == found.hash[some]).all()


def test_hashes_across_stretches(monkeypatch):
    """Whatever the stretch: ranges longer than it, empty, overlapping or in no order have the hash of their bytes."""
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 3000).astype(np.uint8)
    start = np.sort(rng.integers(0, 2900, 200))
    for begin, end in ((start, np.minimum(np.maximum.accumulate(start + rng.integers(0, 300, 200)), 3000)), (start[::-1], start[::-1] + 9)):
        want = [int(words.hash_spans(data[a:b], np.array([0]), np.array([b - a]))[0]) for a, b in zip(begin, end, strict=True)]
        for stretch in (1, 50, 1000, 1 << 18):
            monkeypatch.setattr(words, "STRETCH", stretch)
            assert words.hash_spans(data, begin, end).tolist() == want


def test_a_batch_is_cut_shard_by_shard(monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 20_000)
    item = "one two three four five six seven eight nine ten eleven"
    texts = [f"text {i} " + "and more of it " * 60 + (item if i % 3 == 0 else "") for i in range(500)] + [None, "", item]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["c0", "text"])
    out = list(decontaminate._cut(SimpleNamespace(value=[("i", item)]), 10, 0.5, False)(iter([batch])))
    assert max(b.get_total_buffer_size() if b.num_rows == len(texts) else b.nbytes for b in out) < 40_000
    rows = [x for b in out for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    assert rows == [(i, t and t.replace(item, "")) for i, t in enumerate(texts) if t != item]
