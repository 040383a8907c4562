import hashlib
import math

import numpy as np

from mnemark.llm import centroids as C
from mnemark.llm import common

SCHEMA = "vec_id long, embedding array<float>, cluster string, n string, q string"


def brute(rows, k=16, rounds=3):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(64 * float(np.float32(x))) for x in v]
            if max(map(abs, q)) < C.TOO_LARGE:
                kept.append((i, q))
    cents = [q for _, q in sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)[:k]]

    def near(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        groups = {}
        for _, q in kept:
            groups.setdefault(near(q)[1], []).append(q)
        cents = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(cents)]
    out = [(i, near(q)[1], near(q)[0]) for i, q in kept]
    total = sum(d for *_, d in out)
    return sorted(((i, j, d, sum(e for _, c, e in out if c == j), total) for i, j, d in out), key=repr), cents


def fixture(n=260):
    rng = np.random.default_rng(7)
    hot = rng.normal(size=64).tolist()
    rows = [(i, hot if i % 3 == 0 else (rng.normal(size=64) * (3 if i % 2 else 0.2)).tolist()) for i in range(n)]
    rows += [(5, rows[5][1]), (5, rows[7][1]), (None, rows[8][1]), (None, [0.0] * 64), (-4, [0.0] * 64), (1000, None), (1001, []), (1002, [1.0] * 63)]
    rows += [(1003, [float("nan")] * 64), (1004, [float("inf")] + [0.0] * 63), (1005, [None] + [1.0] * 63), (1006, [1e30] + [0.0] * 63), (1007, [2.0**20] * 64), (1008, [-(2.0**20)] * 64)]
    return rows


def run(spark, rows, **settings):
    frame = spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], SCHEMA)
    got, cents = C.cluster(frame, **settings)
    return sorted(map(tuple, got.collect()), key=repr), cents.tolist()


def test_clusters_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", 5)  # the third of all rows that are alike is hot
    rows = fixture()
    assert run(spark, rows) == brute(rows)


def test_few_rows_and_none(spark):
    rows = fixture()[:5]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == ([], [])
    assert run(spark, [(None, [1.0] * 64)]) == ([], [])
    assert run(spark, [(k, [0.5] * 64) for k in range(40)]) == brute([(k, [0.5] * 64) for k in range(40)])


def test_sums_stay_exact_beyond_64_bits():
    q = np.array([[C.TOO_LARGE - 1] * 3, [-5, 0, 7]], np.int64)
    n = np.array([1 << 62, 3], np.int64)
    assert C.weighted_sums(q, n, np.array([0, 1]), 3) == [[(C.TOO_LARGE - 1) << 62] * 3, [-15, 0, 21], [0, 0, 0]]
    far = np.array([[C.TOO_LARGE - 1] * 64], np.int64)
    best, distance = C.nearest_centroids(far, np.array([[1 - C.TOO_LARGE] * 64, [0] * 64], np.int64))
    assert (best[0], distance[0]) == (1, 64 * (C.TOO_LARGE - 1) ** 2)
