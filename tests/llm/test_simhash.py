import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quillon.llm import simhash
from quillon.llm.components import connected_components


def reference_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(ids, linked):
    root = {i: i for i in ids}

    def up(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = up(a), up(b)
        root[max(a, b)] = min(a, b)
    return {i: up(i) for i in ids}


def make_docs():
    rng = random.Random(4)
    v = ["a", "b", "Cc", "dé", "日"]
    docs = [(i, " ".join(rng.choice(v) for _ in range(rng.randint(0, 12))), "s") for i in range(150)]
    base = [rng.choice(v + [f"w{k}" for k in range(50)]) for _ in range(400)]
    for i in range(60):
        t = list(base)
        t[rng.randrange(400)] = f"x{i}"
        docs.append((1000 + i, " ".join(t), "s"))
    return docs + [(5000, None, "s"), (5001, " \n", "s"), (5002, "a\x1cb", "s")]


def test_classes_match_brute_force(make):
    docs = make_docs()
    fps = {i: reference_fingerprint(t) for i, t, _ in docs}
    ids = sorted(fps)
    links = [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
    want = classes(ids, links)
    for rows in (2048, 4):  # small shards: every pair of sub-shards meets
        got = {r.doc_id: (int.from_bytes(r.fp, "big"), r.component_id) for r in simhash.near_duplicates(make(docs), shard_rows=rows).collect()}
        assert {i: g[0] for i, g in got.items()} == fps
        assert {i: g[1] for i, g in got.items()} == want


def test_null_ids_and_repeated_rows(make):
    docs = [(None, "x y z", "s"), (4, "x y z", "s"), (4, "x y z", "s"), (None, "q", "s")]
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(make(docs)).collect()), key=repr)
    assert got == sorted([(None, 4), (4, 4), (4, 4), (None, None)], key=repr)
    assert simhash.near_duplicates(make([])).count() == 0


def test_forest_finds_all():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    words = np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 4, dtype=np.uint64)) for _ in range(30)]])[:, None]
    words = np.unique(words, axis=0)
    shard = np.arange(len(words)) % 3
    forest = simhash.BKForest(words, shard)
    for radius in (0, 1, 2, 5, 64):
        found = {(a, b) for q, n in forest.search(words, shard, radius, frontier=50) for a, b in zip(q.tolist(), n.tolist())}
        want = {(a, b) for a in range(len(words)) for b in range(len(words)) if shard[a] == shard[b] and int(words[a, 0] ^ words[b, 0]).bit_count() <= radius}
        assert found == want


def test_near_copies_go(make):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    docs, near = [], set()
    for i in range(40):
        t = [word() for _ in range(300)]
        docs.append((10 * i, " ".join(t), "s"))
        for k in (1, 2):
            c = list(t)
            for _ in range(k):
                c[rng.randrange(300)] = word()
            docs.append((10 * i + k, " ".join(c), "s"))
            near.add(10 * i + k)
    d = make(docs + [(None, docs[0][1], "s")])
    kept = simhash.drop_near_duplicates(d)
    assert kept.columns == d.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {10 * i for i in range(40)} <= ids and len(ids & near) <= 1 and None in ids


def test_pairs_at_the_threshold(make):
    """450 shingles of which ten words change 50 have similarity 0.8; 445 have 0.798."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    docs = []
    for i in range(400):
        t = [word() for _ in range(454 if i < 200 else 449)]
        c = list(t)
        for k in range(10):
            c[20 + 40 * k] = word()
        a, b = (set(simhash.shingles(" ".join(x), 5)) for x in (t, c))
        assert (len(a & b) / len(a | b) >= 0.8) == (i < 200)
        docs += [(2 * i, " ".join(t), "s"), (2 * i + 1, " ".join(c), "s")]
    gone = set(range(800)) - {r.doc_id for r in simhash.drop_near_duplicates(make(docs)).collect()}
    assert gone == set(range(1, 400, 2))


def test_alike_matches_brute_force(make):
    rng = random.Random(7)
    docs = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 14))), "s") for i in range(120)] + [(500, None, "s")]
    sets = {i: {hash(x) for x in simhash.shingles(t, 5)} for i, t, _ in docs}
    near = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    want = classes(sets, [(a, b) for a in sets for b in sets if a < b and near(sets[a], sets[b])])
    ids = sorted(sets)
    root = simhash.alike([np.array(sorted(sets[i]), dtype=np.int64) for i in ids], 0.8)
    assert {i: ids[r] for i, r in zip(ids, root.tolist())} == want
    # One group, dealt to sub-groups that all meet.
    d = make(docs)
    copies = [F.xxhash64("text").alias("copy"), F.xxhash64(F.lit(1), "text").alias("copy2")]
    items = d.groupBy(*copies).agg(F.min("doc_id").alias("least")).withColumn("group", F.lit(1).cast("bigint")).withColumn("item", F.col("least") + 1000)
    links = [(r.a, r.b) for r in simhash.exact_links(d, items, similarity=0.8, shingle=5, shard_rows=20).collect()]
    least = {r.least for r in items.collect()}
    got = classes(least, [(a - 1000, b - 1000) for a, b in links])
    assert got == {i: want[i] for i in got}


def test_search_plan():
    assert simhash.search_plan(200_000, 0.8) == (1536, 96)
    for n in (0, 10, 10**6, 10**8, 10**10):
        width, blocks = simhash.search_plan(n, 0.8)
        bits = width // blocks
        assert 1 - (1 - (1 - simhash._flips(0.8)) ** bits) ** blocks >= 0.998 and n / 2**bits <= 4


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100, 102: 100}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
