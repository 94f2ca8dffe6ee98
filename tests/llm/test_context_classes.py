import numpy as np
from fieldloom.llm import context_mixing as cm
from fieldloom.llm.words import hash_words


def test_first_guess_is_of_all_texts(spark):
    rng = np.random.default_rng(3)
    kinds = [[f"{k}{i}" for i in range(30)] for k in "abcd"]
    texts = [" ".join(rng.choice(kinds[i % 4], rng.integers(5, 60))) for i in range(1600)] + [None, "", " "]
    total = cm.moments(spark.createDataFrame([(t,) for t in texts], "text string").repartition(7))
    size, drop = 1 << cm.MOMENT_BITS, np.uint64(64 - cm.MOMENT_BITS)
    want = np.zeros_like(total)
    for t in texts:
        words = (t or "").split()
        if words:
            count = np.bincount((hash_words(words) >> drop).astype(np.int64), minlength=size)
            x = np.append(cm.SHARE_STEPS * count // len(words), 1)
            want += np.outer(x, x)
    assert total[-1, -1] == 1600 and (total == want).all()
    # the classes that grow from it keep kinds of texts apart
    models = cm.refitted(spark.createDataFrame([(t,) for t in texts], "text string"), cm.first_models(total))
    buckets = [cm._buckets(hash_words(t.split())) for t in texts[:1600]]
    own = cm._best_class(models, np.concatenate(buckets), np.cumsum([0, *map(len, buckets)]))
    assert all(len(set((np.arange(1600) % 4)[own == c])) <= 1 for c in range(cm.CLASSES))


def test_first_guess_without_texts():
    assert not cm.first_models(np.zeros(((1 << cm.MOMENT_BITS) + 1,) * 2)).any()
