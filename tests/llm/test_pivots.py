"""Whole-number k-means against plain Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from tabscope.llm import pivots

SCHEMA = "vec_id bigint, embedding array<double>, cluster int, distance string, label int"


def floor(x):
    a, b = x.as_integer_ratio()
    return 1024 * a // b


def brute(rows, k=8, rounds=10):
    kept = [(i, [floor(x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centres))
    for _ in range(rounds):
        label = [near(v)[1] for _, v in kept]
        for c in range(len(centres)):
            own = [v for (_, v), n in zip(kept, label) if n == c]
            if own:
                centres[c] = [sum(x) // len(own) for x in zip(*own)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    total = sum(d for _, _, d in found)
    inertia = {c: sum(d for _, n, d in found if n == c) for c in range(len(centres))}
    fits = lambda x: x if x < 1 << 63 else None
    return sorted(((i, c, fits(d), fits(inertia[c]), fits(total), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, c, d in found), key=str)


def run(spark, rows):
    return sorted(map(tuple, pivots.cluster(spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA)).collect()), key=str)


def vectors(n, spread=0.3, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, 64))
    return [(int(i), (centres[i % 6] + spread * rng.standard_normal(64)).tolist()) for i in range(n)]


def test_equals_plain_integers_with_odd_rows(spark):
    rows = vectors(300)
    rows += [(1000 + i, rows[5][1]) for i in range(120)]  # one very common vector: ties and empty clusters
    rows += [(5, rows[9][1]), (5, rows[9][1]), (None, rows[1][1]), (None, rows[2][1])]
    rows += [(2000, None), (2001, [0.0] * 63), (2002, [float("nan")] * 64), (2003, [None] + [1.0] * 63), (2004, [math.inf] * 64), (2005, []), (2006, [0.0] * 64), (2007, [5e-324] * 64), (2008, [-5e-324] * 64)]
    assert run(spark, rows) == brute(rows)


def test_ties_go_to_the_smaller_number(spark):
    rng = random.Random(4)
    rows = [(i, [float(rng.choice((-1, 1)))] * 2 + [0.0] * 62) for i in range(200)]
    assert run(spark, rows) == brute(rows)


def test_very_large_components_are_compared_exactly(spark):
    rows = vectors(60)
    rows += [(100 + i, [s * 1e30] * 3 + v[3:]) for i, ((_, v), s) in enumerate(zip(rows[:12], (1, -1) * 6))]
    rows += [(200, [1.7e308] * 64), (201, [-1.7e308] * 64), (202, [float(1 << 17)] * 64), (203, [-float(1 << 17)] * 64), (204, [float((1 << 17) - 1)] * 64)]
    assert run(spark, rows) == brute(rows)


def test_only_very_large_vectors(spark):
    rows = [(i, [1e20 * (-1) ** i + i * 1e5] * 64) for i in range(7)]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_fewer_vectors_than_centroids(spark, n):
    rows = vectors(n)
    assert run(spark, rows) == brute(rows)


def test_bounds_spare_distances_and_hold():
    rng = np.random.default_rng(2)
    base = rng.integers(-4000, 4000, (8, 64))
    rows = (base[rng.integers(0, 8, 500)] + rng.integers(-300, 300, (500, 64))).astype(np.int64)
    known = base.tolist()
    d = np.array([[sum((int(a) - b) ** 2 for a, b in zip(r, p)) for p in known] for r in rows])
    now = pivots.Centroids((base + 7).tolist(), known)
    label, best, computed = now.nearest(rows, d)
    every = np.stack([now.exact(rows, c) for c in range(8)], axis=1)
    assert (label == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
    assert (now.bounds(d) <= np.sqrt(every)).all() and computed < 2 * len(rows)
