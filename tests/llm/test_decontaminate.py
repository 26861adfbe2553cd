import random
import re

import numpy as np
import pytest

from quillon.llm import decontaminate as D

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return W.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, n=10):
    windows = {}
    for item, t in items:
        w = words(t)
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(str(item) if item is not None else "null")
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for g, ids in windows.items():
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    found |= ids
        out.append((d, len(w), len(hit), len(found), D.sha(list(found)), bool(hit)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(3)
    v = ["ab", "C", "ü", "x1", "日本", "z"]
    docs = [(i, " ".join(rng.choice(v) for _ in range(rng.randint(0, 60))), "s") for i in range(60)]
    items = [(i, " ".join(rng.choice(v) for _ in range(rng.choice([0, 1, 3, 5, 12])))) for i in range(12)]
    items += [(3, docs[5][1]), (None, docs[7][1]), (99, None), (98, "...")]
    docs += [(None, docs[7][1], None), (5, docs[5][1], "s"), (500, None, "s"), (501, "", "s"), (502, "!!", "s"), (503, "ab," * 50_000 + docs[5][1], "t")]
    return docs, items


def test_matches_brute_force(spark, make, cases):
    docs, items = cases
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = D.report(D.find_contamination(make(docs), b, n=4)).collect()
    short = [(d, t) for d, t, _ in docs]
    assert sorted(map(tuple, got), key=repr) == brute(short, items, 4)


def test_slices_agree(spark, make, cases):
    docs, items = cases
    b = spark.createDataFrame(items, "item_id bigint, text string")
    rows = lambda bound: sorted(map(repr, D.find_contamination(make(docs), b, n=4, broadcast_bytes=bound).collect()))
    assert rows(256_000_000) == rows(20_000)  # an item is cut, too
    texts = lambda bound, mode: sorted(map(repr, D.decontaminate(make(docs), b, n=4, mode=mode, broadcast_bytes=bound).collect()))
    for mode in ("spans", "documents"):
        assert texts(256_000_000, mode) == texts(20_000, mode)


def test_cuts_come_from_the_original_text(spark, make):
    whole = "w1 w2 w3 w4 w5 w6 w7 w8 w9"
    b = spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6"), (2, "w4 w5 w6 w7 w8 w9"), (3, "x2 y1 y2 q"), (4, "x1 x2 y1 y2")], "item_id bigint, text string")
    d = make([(1, f"q {whole} z", "s"), (2, "x1 x2 w1 w2 w3 w4 y1 y2", "s"), (2, "x1 x2 w1 w2 w3 w4 y1 y2", "s")])
    for bound in (256_000_000, 400, 1):
        got = D.decontaminate(d, b, n=4, mode="spans", broadcast_bytes=bound).collect()
        assert sorted(r.text for r in got) == ["q z", "x1 x2 y1 y2", "x1 x2 y1 y2"]


def test_sets_are_bounded(spark):
    rng = random.Random(5)
    items = [(i, " ".join(f"v{rng.randrange(5000)}" for _ in range(rng.choice([5, 50, 9000])))) for i in range(60)]
    b = spark.createDataFrame(items, "item_id bigint, text string")
    slices = list(D._slices(b, 10, "item_id", "text", 1_000_000))
    assert len(slices) > 3 and all(D.NgramSet(s).nbytes <= 1_000_000 for s in slices)
    windows = lambda parts: {(i, tuple(w[k : k + n])) for i, w, n in parts for k in range(len(w) - n + 1)}
    assert set().union(*map(windows, slices)) == windows([(str(i), D.words(t), min(10, len(D.words(t)))) for i, t in items])


def test_clashing_hashes(monkeypatch):
    """All windows share one hash: words alone decide."""
    monkeypatch.setattr(D, "_rolling", lambda ids, size: np.zeros(len(ids) - size + 1, dtype=np.uint64))
    grams = D.NgramSet([("a", b"p q r s".split(), 2), ("b", b"q r t".split(), 2)])
    ((count, spans, items),) = grams.scan(["x p q r t x"])
    assert (count, spans, {grams.ids[i] for i in items}) == (6, [(1, 5)], {"a", "b"})


def test_removal(spark, make):
    b = spark.createDataFrame([(1, "one two three four")], "item_id bigint, text string")
    d = make([(1, "x One, two three FOUR y", "s"), (2, "one two three", "s"), (3, None, "s")])
    spans = {r.doc_id: r.text for r in D.decontaminate(d, b, mode="spans").collect()}
    assert spans == {1: "x y", 2: "one two three", 3: None}
    kept = D.decontaminate(d, b)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {2, 3}
    with pytest.raises(ValueError):
        D.decontaminate(d, b, mode="other")


def test_empty_tables(spark, make):
    b = spark.createDataFrame([], "item_id bigint, text string")
    assert D.report(D.find_contamination(make([]), b)).count() == 0
    assert D.report(D.find_contamination(make([(1, "a", "s")]), b)).first().contaminated is False


def test_repeated_rows_stay_with_several_slices(make, spark):
    passage = "one two three four five six seven eight nine ten"
    benchmark = spark.createDataFrame([("a", passage), ("b", passage.replace("one", "zero"))], "item_id string, text string")
    docs = make([(1, f"x {passage}", "s")] * 3 + [(1, "other", "s"), (None, passage, "s"), (None, passage, "s"), (2, None, "s"), (2, None, "s")])
    rows = lambda bound: sorted((r for r in map(repr, D.find_contamination(docs, benchmark, broadcast_bytes=bound).collect())))
    assert len(rows(1)) == 8 and rows(1) == rows(256_000_000)
