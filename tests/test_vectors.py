"""Span pooling and the inverted file of anchors against plain versions."""

import math
import random

import numpy as np
import pytest

from quillon.operators import chunks


@pytest.mark.parametrize("batch", [10000, 3])
def test_spans(spark, batch):
    rng = random.Random(1)
    vectors = [(d, p, [rng.uniform(-1, 1) for _ in range(3)]) for d in ("a", "b", None) for p in rng.sample(range(40), 25)]
    vectors += [("a", 3, None), ("a", 4, [1.0]), ("b", 5, [float("nan"), 1.0, 1.0]), ("b", 7, [1.0, None, 1.0]), ("b", 9, [2.0, 2.0, 2.0]), ("c", 1, [1.0, 2.0, 3.0])]
    spans = [(d, s, s + n, f"{d}{s}") for d in ("a", "b", "c", "none") for s in range(-3, 42, 4) for n in (0, 1, 9, 50)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(vectors, "doc_id string, pos int, embedding array<double>").repartition(3)
        got = {(r.name, r.end): (r.n, r["mean"]) for r in chunks.pool_spans(df, spark.createDataFrame(spans, "doc_id string, start int, end int, name string"), 3).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len({(x[3], x[2]) for x in spans})
    for d, s, e, name in spans:
        own = [v for dd, p, v in vectors if dd == d and s <= p < e and v and len(v) == 3 and all(x is not None and not math.isnan(x) for x in v)]
        n, mean = got[name, e]
        assert n == len(own) and (mean is None) == (not own)
        if own:
            assert np.allclose(mean, np.mean(own, axis=0), atol=1e-12)


def test_windows_merge(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 2.0]), (1, 0, [3.0, 6.0]), (1, 1, [5.0, 5.0]), (1, 2, None)], "doc_id int, pos int, embedding array<double>")
    assert {r.pos: r.embedding for r in chunks.merge_windows(df).collect()} == {0: [2.0, 4.0], 1: [5.0, 5.0]}


def neighbours(vectors, anchors, k):
    """For each vector its k nearest anchors' ids by all pairs."""
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    return np.argsort(-(unit(vectors) @ unit(anchors).T), axis=1, kind="stable")[:, :k]


def test_inverted_file(spark):
    """Exact equals all pairs; without the second look at least nine in ten votes are the same, on clustered vectors."""
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(30, 16))
    points = middle[rng.integers(0, 30, 1500)] + 0.35 * rng.normal(size=(1500, 16))
    labels = [f"L{i % 40}" for i in range(1500)]
    df = spark.createDataFrame([(i, p.tolist(), lab) for i, (p, lab) in enumerate(zip(points, labels))], "vec_id int, embedding array<double>, label string")
    anchors = df.where("vec_id % 2 = 0").withColumnRenamed("vec_id", "anchor_id")
    near = neighbours(points, points[::2], 1)[:, 0] * 2
    want = {i: labels[int(n)] for i, n in enumerate(near)}
    got = {r.vec_id: r.label for r in chunks.nearest_anchors(df, anchors, 1, block=50).collect()}
    assert got == want
    some = {r.vec_id: r.label for r in chunks.nearest_anchors(df, anchors, 1, exact=False).collect()}
    assert len(some) == 1500 and sum(some[i] == want[i] for i in want) >= 0.9 * 1500


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [-1.0, 0.1]), (6, [-1.0, 0.1])]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    anchors = spark.createDataFrame([(1, [2.0, 0.0], "x"), (2, [0.0, 0.0], "y"), (3, None, "y"), (4, [0.0, 3.0], "z")], "anchor_id int, embedding array<double>, label string")
    got = {r.vec_id: (r.label, r.score) for r in chunks.nearest_anchors(df, anchors, 1, unknown_below=0.5).collect()}
    assert got[1] == ("x", 1.0) and all(got[i] == ("UNKNOWN", None) for i in (2, 3, 4, 5)) and got[6][0] == "UNKNOWN"
    assert {r.label for r in chunks.nearest_anchors(df, anchors.where("anchor_id > 9"), 1).collect()} == {None}


def test_equal_vectors_take_the_lowest_ids(spark, monkeypatch):
    """Blocks of both sides meet in tasks of their own; copies have equal scores in all of them, and no list of centers is fitted."""
    monkeypatch.setattr(chunks, "MEETING", 16)
    monkeypatch.setattr(chunks, "_centers", None)
    rng = np.random.default_rng(7)
    points = rng.normal(size=(6, 33))[np.arange(120) % 6]
    df = spark.createDataFrame([(i, p.tolist(), f"L{i // 6}") for i, p in enumerate(points)], "vec_id int, embedding array<double>, label string")
    got = {r.vec_id: r.label for r in chunks.nearest_anchors(df, df.withColumnRenamed("vec_id", "anchor_id"), 1, block=7).collect()}
    assert got == {i: "L0" for i in range(120)}
