import random
import re

import numpy as np

from quillon.llm import quality


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, at = {}, set()
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            at |= {p + k for p in places for k in range(8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(at)


def test_statistics_match_brute_force():
    rng = random.Random(1)
    texts = [None, "", " \n\x0b", "a\x1cb\x85c", "x\ny\nx\n \n", "a " * 40, "a b c d e f g h " * 3 + "a", "😀 é\r\n" * 9]
    texts += ["".join(rng.choice("ab #*\n\t é") for _ in range(rng.randint(0, 200))) for _ in range(400)]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(8, 60))) for _ in range(300)]
    for t in texts:
        assert quality.statistics(t)[:5] == brute(t)


def test_forest_isolates():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (2000, 3))
    f = quality.IsolationForest(x)
    s = f.score(np.array([[0.0, 0, 0], [9, 9, 9], [0, 7, 0]]))
    assert s[1] > s[2] > s[0] and (f.score(x) == quality.IsolationForest(x).score(x)).all()


def corpus(spark):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(1200):
        good = i % 8 != 0
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(60, 200))]
        if not good:
            words = [w + rng.choice(["%%%", "$$$", "|"]) for w in words] if i % 16 else [w.upper() + "!!" for w in words]
        docs.append((i, " ".join(words), "s"))
        if i % 3:
            labels.append((i, int(good), 0))
    return docs, spark.createDataFrame(labels + [(5000, None, None), (None, 1, 0)], "doc_id bigint, quality int, toxic int")


def test_held_out_accuracy(spark, make):
    docs, labels = corpus(spark)
    docs += [(9000, None, "s"), (9001, "", "s"), (9002, "w " * 19, "s"), (9003, "a b c d e f g h " * 9, "s"), (None, docs[1][1], "s")]
    rows = quality.judge(make(docs), labels).collect()
    kept = {r.doc_id: r.kept for r in rows}
    held = [i for i in range(1200) if i % 3 == 0]
    good, bad = [kept[i] for i in held if i % 8], [kept[i] for i in held if i % 8 == 0]
    assert sum(good) / len(good) >= 0.98 and sum(bad) / len(bad) <= 0.1
    assert len(rows) == len(docs) and not any(kept[i] for i in range(9000, 9004)) and kept[None]
    d = make(docs)
    left = quality.filter_quality(d, labels)
    assert left.columns == d.columns and {r.doc_id for r in left.collect()} == {i for i, k in kept.items() if k}


def test_no_labels_and_empty(spark, make):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    rows = quality.judge(make([(1, "w " * 30 + "x", "s"), (2, " ".join(map(str, range(30))), "s")]), none).collect()
    assert {r.doc_id: r.kept for r in rows} == {1: False, 2: True}
    assert quality.judge(make([]), none).count() == 0
