"""Edit distance and block differences against plain versions."""

import difflib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import distance as d
from quillon.operators import compare


def table(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def edited(rng, text, n):
    t = list(text)
    for _ in range(n):
        at = rng.randrange(len(t) + 1)
        kind = rng.randrange(3)
        if kind == 0 or at == len(t):
            t.insert(at, rng.choice("abc한😀"))
        elif kind == 1:
            del t[at]
        else:
            t[at] = rng.choice("abc한😀")
    return "".join(t)


def test_all_ways_agree():
    rng = random.Random(1)
    for n in range(400):
        a = "".join(rng.choice("ab한😀"[: 2 + n % 3]) for _ in range(rng.randrange(0, 60)))
        b = edited(rng, a, rng.randrange(0, 12)) if n % 2 else "".join(rng.choice("ab한") for _ in range(rng.randrange(0, 60)))
        want = table(a, b)
        assert d.distance(a, b) == want
        if a and b:
            x, y = d._points(a), d._points(b)
            assert d.by_rows(x, y) == d.by_diagonals(x, y, 200) == want
            assert d.by_diagonals(x, y, want - 1) is None if want else True


def test_long_texts():
    """Two texts of 1 MB with a hundred edits take seconds, and so do texts of 20,000 characters with nothing in common."""
    rng = random.Random(2)
    a = "".join(map(chr, np.random.default_rng(2).integers(97, 123, 1_000_000)))
    b = edited(rng, a, 100)
    began = time.monotonic()
    found = d.distance(a, b)
    assert found <= 100 and found == d.distance(b, a) and time.monotonic() - began < 60
    began = time.monotonic()
    x, y = ("".join(map(chr, np.random.default_rng(s).integers(97, 123, 20_000))) for s in (3, 4))
    assert 10_000 < d.distance(x, y) < 20_000 and time.monotonic() - began < 60


def test_repeats_and_one_letter():
    assert d.distance("a" * 50_000, "a" * 40_000) == 10_000
    assert d.distance("ab" * 3000, "ba" * 3000) == 2
    assert d.distance("x" * 2000, "y" * 3000) == 3000


def opcodes(a, b):
    return [o for o in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if o[0] != "equal"]


@pytest.mark.parametrize("pairs", [4_000_000, 3])
def test_list_edits(pairs, monkeypatch):
    monkeypatch.setattr(compare, "PAIRS", pairs)
    rng = random.Random(4)
    for n in range(400):
        letters = "abcdefgh"[: 1 + n % 8]
        a, b = ([rng.choice(letters) for _ in range(rng.randrange(0, 30))] for _ in range(2))
        if n % 3 == 0:
            b = a[: len(a) // 2] + b[:3] + a[len(a) // 2 :]
        assert compare.list_edits(a, b) == opcodes(a, b)


def test_block_diff_of_documents(spark):
    """Lines of neighbouring documents, as the query has them."""
    from quillon.plans.queries import QUERIES, neighbours

    sf = "/root/testdata/sf0.001"
    texts = {r.r_number: (r.l_text.split("\n"), r.r_text.split("\n")) for r in neighbours(spark, sf).collect()}
    rows = QUERIES["block_diff"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = opcodes(*texts[r.doc_id])
        size = lambda kind, lo, hi: sum(o[hi] - o[lo] for o in want if o[0] == kind)
        assert (r.added, r.deleted, r.replaced_left, r.replaced_right) == (size("insert", 3, 4), size("delete", 1, 2), size("replace", 1, 2), size("replace", 3, 4))


def test_neighbours(spark, tmp_path):
    from quillon.plans import queries

    rows = [(5, "a", "x"), (5, "b", "x"), (9000, "c", "x"), (None, "n", "x"), (20000, None, "x"), (1, "q", None), (2, "r", None), (3, "s", "y"), (-4, "t", "")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.source or "-", r.l_number, r.l_text, r.r_number, r.r_text) for r in queries.neighbours(spark, str(tmp_path)).collect())
    assert got == [("-", 1, "q", 2, "r"), ("x", 5, "a", 9000, "c"), ("x", 9000, "c", 20000, "")]


def test_column(spark):
    rng = random.Random(6)
    a = "".join(rng.choice("abcd ") for _ in range(3000))
    rows = [(a, edited(rng, a, 25)), (a, None), ("", a), (a, a), (a[:900], edited(rng, a[:900], 5))]
    df = spark.createDataFrame(rows, "x string, y string").select(d.edit_distance(F.col("x"), F.col("y")).alias("n"), "x", "y")
    for r in df.collect():
        assert r.n == (None if r.y is None else table(r.x, r.y) if len(r.x) < 1000 else d.by_rows(d._points(r.x), d._points(r.y)) if r.x != r.y else 0)


def test_texts_of_other_pieces_go_to_the_table_at_once(monkeypatch):
    """The bound never exceeds the distance, and diagonals are left out where it rules them out."""
    rng = random.Random(11)
    for _ in range(100):
        x, y = ("".join(rng.choice("abcd") for _ in range(rng.randrange(40))) for _ in range(2))
        assert d.at_least(d._points(x), d._points(y)) <= d.distance(x, y)
    x, y = ("".join(chr(rng.randrange(lo, lo + 26)) for _ in range(2000)) for lo in (97, 1000))
    monkeypatch.setattr(d, "by_diagonals", None)
    assert d.distance(x, y) == 2000
