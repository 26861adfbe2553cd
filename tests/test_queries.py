"""Every registered query of the core runs; those with SQL give its rows."""

import math
import os

import duckdb
import pytest

from quillon.plans.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name not in ORACLES:
        return
    r = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(r.columns)
    columns = sorted(df.columns)
    want = [tuple(plain(x[r.columns.index(c)]) for c in columns) for x in r.fetchall()]
    assert sorted((tuple(plain(x[c]) for c in columns) for x in got), key=repr) == sorted(want, key=repr)
