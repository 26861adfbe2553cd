"""Medians by selection against a sort."""

import random
import statistics

from quillon.operators import runs


def check(spark, rows):
    df = spark.createDataFrame(rows, "tool string, x double")
    want = {}
    for k in {k for k, _ in rows}:
        own = [x for kk, x in rows if kk == k and x is not None and x == x]
        if own:
            want[k] = statistics.median(own)
    got = {r.tool: r["median"] for r in runs.medians(df, ("tool",), "x").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1e-12 * abs(want[k]) or got[k] == want[k] for k in want)


def test_medians(spark):
    rng = random.Random(1)
    rows = [("a", rng.gauss(0, 1)) for _ in range(3001)] + [("b", rng.choice([1.0, 2.0])) for _ in range(500)] + [("c", 10.0 ** rng.uniform(-30, 30)) for _ in range(400)]
    rows += [(None, float(i)) for i in range(6)] + [("d", 1.0), ("d", 2.0), ("e", None), ("f", float("nan")), ("f", 3.0), ("g", None)]
    rows += [("h", -1.0), ("h", float("inf")), ("h", float("-inf")), ("i", float("inf")), ("i", 5.0), ("i", float("inf")), ("j", 1.0), ("j", 1.5e308), ("j", -1.5e308)]
    check(spark, rows)


def test_nothing(spark):
    check(spark, [])
