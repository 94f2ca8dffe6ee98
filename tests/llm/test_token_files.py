import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from fieldloom.llm import shared
from fieldloom.llm import token_files as tf

SCHEMA = "doc_id long, text string, start string, ids int"


def test_round_trip(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), " ".join(rng.choice(["the", "Größe,", "x1", "it's", "\n\n", "  a", "日本", "<|endoftext|>"], rng.integers(0, 300))), "", 0) for i in rng.permutation(300)]
    rows += [(900, None, "", 0), (901, "", None, None), (902, "a  \t\n b　 c\xa0  d ", "", 0), (903, "\n", "", 0), (904, "z" * 20000, "", 0), (5, rows[0][1], "", 0)]
    path = shared.new_table(spark, "tokens-test")
    tf.write(spark.createDataFrame(rows, SCHEMA).repartition(5), path, file_bytes=20_000)
    found = tf.read(spark, path).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(tf.TOKENIZER)
    want = sorted((i, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u2").tobytes()) for i, t, *_ in rows)
    assert [(r.id, np.array(r.ids, "<u2").tobytes()) for r in found] == want
    sizes = [len(x) // 2 for _, x in want]
    assert [r.start for r in found] == np.concatenate([[0], np.cumsum(sizes)[:-1]]).tolist()
    assert [r.n_tokens for r in found] == sizes
    assert spark.read.parquet(f"{path}/blocks").select("part").distinct().count() > 1
    digests = tf.read(spark, path, digest=True).orderBy("start").collect()
    assert [r.ids_crc32 for r in digests] == [zlib.crc32(np.frombuffer(x, "<u2").astype("<u4").tobytes()) for _, x in want]


def test_empty_table(spark):
    path = shared.new_table(spark, "tokens-empty")
    tf.write(spark.createDataFrame([], SCHEMA), path)
    assert tf.read(spark, path).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_code_and_blocks(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(1 << 16, np.int64)
    n = int(rng.integers(1, 5000))
    counts[rng.choice(1 << 16, n, replace=False)] = (2.0 ** rng.integers(0, 40, n)).astype(np.int64)
    lengths = tf.code_lengths(counts)
    used = lengths[counts > 0].astype(np.int64)
    assert used.max() <= tf.LIMIT and used.min() > 0 and not lengths[counts == 0].any()
    assert (0.5**used).sum() == 1 or n == 1
    order = np.argsort(counts[counts > 0], kind="stable")
    assert (np.diff(used[order]) <= 0).all()
    ids = rng.choice(np.flatnonzero(counts), int(rng.integers(1, 3000)))
    bits, checkpoints = tf.pack(ids, tf.canonical_codes(lengths), lengths)
    assert (tf.unpack(bits, checkpoints, len(ids), tf.decoding_table(lengths)) == ids).all()


def test_lengths_are_optimal_without_limit():
    """Against Huffman's cost where the limit does not bind."""
    import heapq

    counts = np.random.default_rng(9).integers(1, 1000, 300)
    heap = counts.tolist()
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    assert (counts * tf.code_lengths(counts)).sum() == cost


def test_ids_of_any_type_and_null_stay_in_order(spark):
    rows = [(k, f"text {i} " * 30) for i, k in enumerate(["d15", "d2", None, "15", "d2", "", None, "z"] * 30)]
    path = shared.new_table(spark, "tokens-text-ids")
    tf.write(spark.createDataFrame(rows, "doc_id string, text string").repartition(4), path, file_bytes=1_500)
    found = [r.id for r in tf.read(spark, path).orderBy("start").collect()]
    assert found == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or ""))
    assert spark.read.parquet(f"{path}/blocks").select("part").distinct().count() > 2


def test_one_id_of_all_rows_is_dealt_to_several_parts(spark):
    path = shared.new_table(spark, "tokens-one-id")
    tf.write(spark.createDataFrame([(7, f"{i} of one id " * 20) for i in range(300)], "doc_id long, text string").repartition(4), path, file_bytes=4_000)
    assert spark.read.parquet(f"{path}/blocks").select("part").distinct().count() > 2 and tf.read(spark, path).count() == 300
