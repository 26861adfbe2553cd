"""Clustering against a model in Python's integers."""

import hashlib
import math

import numpy as np
import pytest

from quillon.llm import clusters

SCHEMA = "vec_id bigint, embedding array<double>, cluster string, distance string, ids string, width string"
DIMS = 4


def model(rows, k, rounds):
    kept = [(i, [math.floor(256 * x) if abs(x) < 1e300 else int(x) * 256 for x in v]) for i, v in rows if v is not None and len(v) == DIMS and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centers = [list(v) for _, v in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    give = lambda: [min((far(v, c), n) for n, c in enumerate(centers)) for _, v in kept]
    for _ in range(rounds):
        to = give()
        for n in range(len(centers)):
            own = [v for (_, v), (_, m) in zip(kept, to) if m == n]
            if own:
                centers[n] = [sum(x) // len(own) for x in zip(*own)]
    fit = lambda x: x if x < 2**63 else None
    to = give()
    each = [sum(d for d, m in to if m == n) for n in range(len(centers))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, n, fit(d), fit(each[n]), fit(sum(each)), digest[n]) for (i, _), (d, n) in zip(kept, to)), key=repr)


def check(spark, rows, k=5, rounds=3):
    df = spark.createDataFrame([(i, v, "x", "x", "x", "x") for i, v in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in clusters.report(clusters.cluster(df, k, rounds, dims=DIMS, scale=256, seed="2")).collect()]
    assert sorted(got, key=repr) == model(rows, k, rounds)


def test_plain(spark):
    rng = np.random.default_rng(1)
    check(spark, [(i, (rng.normal(size=DIMS) + i % 7).tolist()) for i in range(400)])


def test_bad_vectors_ties_and_repeats(spark):
    rows = [(1, [0.0] * 4), (2, [1.0] * 4), (3, [0.5] * 4), (3, [0.5] * 4), (None, [0.25, 0.0, 0.0, -0.001]), (None, [9.0] * 4), (4, None), (5, []), (6, [1.0] * 5), (7, [1.0, None, 1.0, 1.0])]
    check(spark, [*rows, (8, [float("nan")] * 4), (9, [float("inf"), 0.0, 0.0, 0.0]), *[(10 + i, [0.5] * 4) for i in range(20)]], k=3)


@pytest.mark.parametrize("size", [1e5, 1e7, 1e12, 1e17, 1e306])
def test_large_numbers(spark, size):
    """Beyond 2^53 the products go to 64-bit integers, then to Python's."""
    rng = np.random.default_rng(2)
    check(spark, [(i, (rng.normal(size=DIMS) * (size if i % 3 else 1)).tolist()) for i in range(60)], k=4)


def test_hot_and_few(spark):
    check(spark, [(i, [3.25, -1.0, 0.0, 7.0]) for i in range(300)] + [(300, [1.0] * 4)], k=4)
    check(spark, [(1, [1.0] * 4)], k=4)
    check(spark, [], k=4)
