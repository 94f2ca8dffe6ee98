import hashlib
import math

import numpy as np
import pytest

from fieldloom.llm import vector_clusters as vc


def brute(rows, dims, k, rounds):
    kept = [(i, [max(-vc.MOST, min(vc.MOST, math.floor(vc.SCALE * x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    draw = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{vc.SEED}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in draw[:k]]
    far = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids))  # noqa: E731, B905
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(far(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[i]) for x in zip(*groups[i])] if i in groups else c for i, c in enumerate(centroids)]  # noqa: B905
    return sorted(((i, v, far(v)[1], far(v)[0]) for i, v in kept), key=repr), centroids


def table(spark, rows, parts):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string, vector int, n int, cluster int").repartition(parts)


def rows_of(seed):
    rng = np.random.default_rng(seed)
    base = [rng.integers(-3, 4, 4).astype(float).tolist() for _ in range(30)]
    rows = [(i, base[int(j)]) for i, j in enumerate(rng.integers(0, 30, 150))]
    rows += [(1000 + i, base[0]) for i in range(100)]  # a third of all rows are one vector
    rows += [(7, base[1]), (7, base[1]), (7, base[2]), (None, base[3]), (None, [0.5, 0.25, -0.001, -1.0])]
    return rows + [(2000, None), (2001, []), (2002, [1.0]), (2003, [1.0, None, 0.0, 0.0]), (2004, [float("nan"), 0.0, 0.0, 0.0]), (2005, [float("-inf"), 0.0, 0.0, 0.0])]


@pytest.mark.parametrize("parts", [1, 7])
def test_rounds_against_brute_force(spark, parts):
    rows = rows_of(parts)
    found = vc.cluster(table(spark, [(i, v, "x", 1, 2, 3) for i, v in rows], parts), dims=4, k=9)
    expected, centroids = brute(rows, 4, 9, vc.ROUNDS)
    assert found.centroids.tolist() == centroids
    assert sorted(((r.id, r.vector, r.cluster, r.distance) for r in found.members.collect()), key=repr) == expected
    sums = {}
    for _, _, c, d in expected:
        sums[c] = sums.get(c, 0) + d
    inertia = {r.cluster: (r.cluster_inertia, r.inertia) for r in vc.inertia(found.distinct).collect()}
    assert inertia == {c: (s, sum(sums.values())) for c, s in sums.items()}
    assert found.distinct.count() == len({str(v) for _, v, _, _ in expected})


def test_large_components_stay_exact(spark):
    rows = [(i, [x, -x, 1.0, 0.0]) for i, x in enumerate([1e30, -1e30, 5e5, 1e4, 12345.678, 0.0])]
    found = vc.cluster(table(spark, [(i, v, "", 0, 0, 0) for i, v in rows], 2), dims=4, k=2)
    expected, centroids = brute(rows, 4, 2, vc.ROUNDS)
    assert found.centroids.tolist() == centroids
    assert sorted(((r.id, r.vector, r.cluster, r.distance) for r in found.members.collect()), key=repr) == expected


def test_empty_and_few(spark):
    assert vc.cluster(table(spark, [], 1), dims=4).members.count() == 0
    assert vc.cluster(table(spark, [(1, None, "", 0, 0, 0)], 1), dims=4).members.count() == 0
    found = vc.cluster(table(spark, [(1, [1.0, 2.0, 3.0, 4.0], "", 0, 0, 0)], 1), dims=4)
    assert [(r.id, r.cluster, r.distance) for r in found.members.collect()] == [(1, 0, 0)]
