"""Repeated windows against a dictionary of all windows."""

import collections
import random

import numpy as np
import pytest

from quillon.llm import repeats

W = 50


def model(rows, window=W):
    first: dict[bytes, int] = {}
    order = lambda i: 2**63 - 1 if i is None else i
    bodies = [(i, (t or "").encode()) for i, t in rows]
    for i, b in bodies:
        for p in range(len(b) - window + 1):
            s = b[p : p + window]
            first[s] = min(first.get(s, 2**63), order(i))
    out = []
    for i, b in bodies:
        gone = bytearray(len(b) + 1)
        for p in range(len(b) - window + 1):
            if first[b[p : p + window]] < order(i):
                gone[p : p + window] = b"\1" * window
        spans, at = [], 0
        while (s := gone.find(1, at)) >= 0:
            at = gone.index(0, s)
            spans.append((s, at))
        out.append((i, len(b), tuple(spans), bytes(c for c, g in zip(b, gone) if not g)))
    return collections.Counter(out)


def check(spark, rows, parts=3, **settings):
    df = spark.createDataFrame([(i, t, 1, "x", "x") for i, t in rows], "doc_id bigint, text string, k int, body string, own string").repartition(parts)
    got = [(r["doc_id"], r["n_bytes"], tuple(tuple(s) for s in r["spans"]), bytes(r["kept"])) for r in repeats.remove_repeats(df, W, **settings).collect()]
    assert collections.Counter(got) == model(rows)


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "é", "한글", "x", "longer-word", "\n", "42"]) + str(rng.randrange(30)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    shared = [prose(rng, n) for n in (9, 12, 30, 80)]
    rows = []
    for i in range(90):
        parts = [prose(rng, rng.randrange(1, 40)) for _ in range(rng.randrange(1, 4))] + rng.sample(shared, rng.randrange(3))
        rng.shuffle(parts)
        rows.append((i, "".join(parts)))
    rows += [(200 + i, rows[i][1]) for i in range(20)]  # copies
    rows += [(300 + i, rows[i][1][:40] + "!" + rows[i][1][41:]) for i in range(20)]  # near copies
    return rows


def test_corpus(spark, corpus):
    check(spark, corpus)


def test_crowded_groups_and_segments(spark, corpus, monkeypatch):
    monkeypatch.setattr(repeats, "CROWD", 1)
    check(spark, corpus, segment=300)


def test_odd_texts(spark):
    unit = "exactly fifty bytes are in this very line of text."
    assert len(unit) == W
    rows = [
        (5, unit), (6, unit), (7, unit[1:]), (8, unit + unit), (9, "a" * 200), (10, "a" * 49), (11, "a" * 50), (12, "b" + "a" * 120 + "c"), (4, None), (13, ""), (14, "ab" * 90), (15, "ba" * 25), (None, unit), (None, "z" * 60), (None, "z" * 60),
        (16, "y" * 60), (16, "y" * 60 + unit), (16, "q" + "y" * 60), (-3, "minus three " * 9), (17, "x minus three " + "minus three " * 8), (18, "é" * 40), (19, "x" + "é" * 25), (2**62, unit + "é" * 30),
    ]
    check(spark, rows)
    check(spark, rows, segment=64)


def test_hot_line(spark):
    """A line that most documents share, and a tail of their own."""
    line = "this line of more than fifty bytes stands in most of the documents of the table, "
    check(spark, [(i, line + f"tail {i * 7919 % 1000} of document number {i}" if i % 4 else f"nothing shared in {i}") for i in range(400)], parts=7)


def test_empty(spark):
    check(spark, [])


def test_one_long_text(spark):
    rng = np.random.default_rng(4)
    long = "".join(map(chr, rng.integers(97, 123, 60_000)))
    check(spark, [(1, long[20_000:20_500]), (2, long), (3, long[:100] + long[50_000:])], segment=7_000)
