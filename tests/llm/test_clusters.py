"""Sort-means against plain k-means."""

import hashlib
import math

import numpy as np
import pytest

from rulespark.llm import sortmeans


def lloyd(rows, k, rounds, scale, dim):
    kept = [(i, [math.floor(scale * v) for v in x]) for i, x in rows if x is not None and len(x) == dim and all(v is not None and math.isfinite(v) for v in x)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    now = [x for _, x in order[:k]]
    nearest = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(now))
    for _ in range(rounds):
        where = [nearest(x)[1] for _, x in kept]
        now = [[sum(v) // len(v) for v in zip(*(x for (_, x), w in zip(kept, where) if w == j))] if j in where else c for j, c in enumerate(now)]
    out = [(i, *nearest(x)[::-1]) for i, x in kept]
    inertia = {j: sum(d for _, c, d in out if c == j) for j in range(len(now))}
    fits = lambda v: v if v < 1 << 63 else None
    return [(i, c, fits(d), fits(inertia[c]), fits(sum(inertia.values())), hashlib.sha256(",".join(map(str, now[c])).encode()).hexdigest()) for i, c, d in out]


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string")


def key(r):
    return tuple((v is None, v or 0) if not isinstance(v, str) else v for v in r)


@pytest.mark.parametrize("k, rounds, block", [(3, 1, 5), (5, 4, 7), (8, 10, 1000)])
def test_equals_plain_k_means(spark, k, rounds, block):
    rng = np.random.default_rng(k)
    rows = [(i, [float(v) for v in rng.integers(-3, 4, 3) / 4]) for i in range(120)]
    rows += [(5, rows[5][1]), (None, [0.25, 0.5, -0.25]), (7, rows[9][1]), (500, None), (501, [1.0]), (502, [1.0, None, 0.0]), (503, [float("nan"), 0.0, 0.0]), (504, [0.0, float("inf"), 0.0]), (505, [])]
    got = sortmeans.cluster(table(spark, [(*r, "x") for r in rows]), k=k, rounds=rounds, scale=8, dim=3, block=block)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(lloyd(rows, k, rounds, 8, 3), key=key)


def test_ties_empty_clusters_and_few_vectors(spark):
    rows = [(i, [1.0, 1.0]) for i in range(5)]
    got = sortmeans.cluster(table(spark, [(*r, "x") for r in rows]), k=8, rounds=3, dim=2)
    assert {tuple(r)[1:5] for r in got.collect()} == {(0, 0, 0, 0)}
    assert sortmeans.cluster(table(spark, []), dim=2).collect() == []


def test_numbers_of_any_size_stay_exact(spark):
    rows = [(1, [1e300, -1e300]), (2, [1e300, -1e299]), (3, [5.0, 5.0]), (4, [6.5e9, 1.0]), (5, [6.5e9, 2.0]), (6, [3e6, -2.0]), (7, [-3e6, -2.0])]
    got = sortmeans.cluster(table(spark, [(*r, "x") for r in rows]), k=3, rounds=4, dim=2)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(lloyd(rows, 3, 4, 1024, 2), key=key)


def test_scan_stops_only_strictly_beyond_twice_the_distance():
    # from centroid 1 the tie with centroid 0 lies at exactly twice the distance
    near, dist, work = sortmeans.sort_means(np.array([[5.0]]), [[0], [10], [31]], np.array([1]))
    assert (near[0], dist[0], work) == (0, 25, 2)


def test_scan_skips_distances():
    rng = np.random.default_rng(1)
    centres = [[int(v) for v in rng.integers(-1000, 1000, 16)] for _ in range(8)]
    x = np.array(centres, dtype=float)[rng.integers(0, 8, 500)] + rng.integers(-20, 20, (500, 16))
    plain = ((x[:, None] - np.array(centres, dtype=float)) ** 2).sum(2)
    near, dist, _ = sortmeans.sort_means(x, centres, np.zeros(500, np.int64))
    assert (near == plain.argmin(1)).all() and (dist == plain.min(1)).all()
    assert sortmeans.sort_means(x, centres, near)[2] < 600


def test_limbs_add_up():
    for v in (0, 1, -1, -(1 << 32), 1 << 64, -(1 << 64) - 5, 10**40, -(10**40)):
        assert sum(p << 32 * i for i, p in sortmeans.limbs(v)) == v
