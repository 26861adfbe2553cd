import random

from pyspark.sql import functions as F

from quillon.llm import mixing


def water(sizes, weights=(5, 2, 1), budget=1.5, cap=2.0):
    """Targets by refilling until none is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    goal, full = budget * sum(sizes.values()), set()
    while True:
        left, open_ = goal - sum(cap * sizes[s] for s in full), [s for s in names if s not in full]
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_} if open_ else {}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in full else share[s] for s in names}
        full |= over


def test_words(spark):
    d = spark.createDataFrame([(None,), ("",), (" \x0b\t",), ("a\x1cb\xa0c d\n e",)], "t string")
    assert [r[0] for r in d.select(mixing.count_words(F.col("t"))).collect()] == [0, 0, 0, 3]


def test_targets_and_taken(spark, make):
    rng = random.Random(5)
    docs = [(i, "w " * rng.randint(0, 80), rng.choice(["b", "a", "é", "c", None, "z"])) for i in range(300)]
    docs += [(1000 + i, "w " * 5000, "hot") for i in range(2)] + [(7, "w w", "a"), (7, "w w", "a"), (None, "w", "b"), (2000, None, "b"), (2001, "", "empty")]
    got = mixing.mixed_sizes(make(docs), block=64)
    rows = got.collect()
    assert len(rows) == len(docs)
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = water(sizes)
    taken = {}
    for r in rows:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mixing.mixed_sizes(make(docs), block=64).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_tree_holds_quotas(spark):
    q = spark.createDataFrame([(1, 37), (2, 5), (3, 90), (4, 1)], "source_no bigint, quota bigint")
    runs = mixing.split_quotas(q, 8).collect()
    for s, n in ((1, 37), (2, 5), (3, 90), (4, 1)):
        own = sorted((r.first, r.quota) for r in runs if r.source_no == s)
        assert sum(k for _, k in own) == n and all(a + k == b for (a, k), (b, _) in zip(own, own[1:])) and own[0][0] == 0
    shards = {}
    for r in runs:
        shards[r.shard] = shards.get(r.shard, 0) + r.quota
    assert max(shards.values()) - min(shards.values()) <= 1 and len(shards) == 8


def unsigned(x):
    return x % (1 << 64)


def model(spark, docs, block, shards, seed=17):
    """What the mix takes, step by step in Python; Spark gives the hashes alone.  (doc_id, text) -> [(epoch, shard, words)]."""
    sizes, plans, hashed = {}, [], lambda rows, schema, *c: {tuple(r)[:-1]: unsigned(r[-1]) for r in spark.createDataFrame(rows, schema).select("*", F.xxhash64(*c).alias("h")).collect()}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    goals = water(sizes)
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    order = {tuple(r)[:2]: unsigned(r.h) for r in spark.createDataFrame([(d, t) for d, t, _ in docs], "d bigint, t string").select("*", F.xxhash64("d", F.xxhash64("t"), F.lit(seed)).alias("h")).collect()}
    laid, length = {}, {}
    for no, s in enumerate(names, 1):
        at = 0
        for d, t, _ in sorted((x for x in docs if x[2] == s), key=lambda x: order[x[:2]]):
            if n := len(t.split()):
                laid[d, t] = (no, at // block, at, n)
                start, total = length.get((no, at // block), (at, 0))
                length[no, at // block] = (start, total + n)
                at += n
    draws = {}
    for no, s in enumerate(names, 1):
        if not sizes[s]:
            continue
        goal = round(goals[s])
        own = [b for n, b in length if n == no]
        key = hashed([(no, e, b, seed + 1) for e in range(3) for b in own], "s bigint, e bigint, b bigint, q int", "s", "e", "b", "q")
        for e in range(-(-goal // sizes[s])):
            left = min(sizes[s], goal - e * sizes[s])
            for b in sorted(own, key=lambda b: key[no, e, b, seed + 1]):
                if left > 0:
                    draws.setdefault(no, []).append((e, b, min(left, length[no, b][1])))
                    left -= length[no, b][1]
    key = hashed([(no, i, seed) for no, x in draws.items() for i in range(len(x))], "s bigint, u bigint, q int", "s", "u", "q")

    def split(run, first, many):  # a node halves its run; a leaf counts its units by source
        if many == 1:
            return {first: run}
        return split(run[: len(run) // 2], first, many // 2) | split(run[len(run) // 2 :], first + many // 2, many // 2)

    out = {}
    used = dict.fromkeys(draws, 0)
    for shard, run in split([no for no, _, _ in sorted(key, key=key.get)], 0, shards).items():
        for no in sorted(set(run)):
            for e, b, words in draws[no][used[no] : used[no] + run.count(no)]:
                for k, (n, at_block, at, size) in laid.items():
                    if (n, at_block) == (no, b) and (take := min(size, length[no, b][0] + words - at)) > 0:
                        out.setdefault(k, []).append((e, shard, take))
            used[no] += run.count(no)
    return {k: sorted(v) for k, v in out.items()}


def test_matches_model(spark, make):
    rng = random.Random(9)
    docs = [(i, f"w{i} " * rng.choice([0, 1, 5, 40, 90]), rng.choice(["b", "hot", "hot", None, "z"])) for i in range(160)]
    found = {}
    for shards in (1, 8):
        want = model(spark, docs, 64, shards)
        got = {r.doc_id: r for r in mixing.mixed_sizes(make(docs), block=64, shards=shards).collect()}
        for d, t, _ in docs:
            own = want.get((d, t), [])
            assert got[d].taken == sum(x[2] for x in own)
            assert got[d].shards == ",".join(f"{s}:{n}" for _, s, n in own)
        found[shards] = {i: r.shards for i, r in got.items()}
        if shards == 1:
            continue
        whole = {d: sorted(s for _, s, n in want.get((d, t), []) if 2 * n >= len(t.split())) for d, t, _ in docs}
        rows = mixing.mixed_documents(make(docs), block=64, shards=shards, shard="to").select("doc_id", "to").collect()
        assert [r.to for r in rows] == sorted(r.to for r in rows)  # by shard
        assert sorted((r.doc_id, r.to) for r in rows) == sorted((d, s) for d, x in whole.items() for s in x)
        # Local shuffle: a shard's documents are in no order of sources or ids.
        first = [r.doc_id for r in rows if r.to == 0]
        assert first != sorted(first)
    assert found[1] != found[8]


def test_equal_rows_share(make):
    docs = [(1, "a b c d", "s")] * 5 + [(i, f"x{i} y z", "t") for i in range(30)] + [(None, "q r", None)] * 3
    rows = mixing.mixed_documents(make(docs), block=8).collect()
    count = {}
    for r in rows:
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    want = {}
    for r in mixing.mixed_sizes(make(docs), block=8).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken / max(1, r.size)
    assert all(abs(count.get(d, 0) - n) <= 1 for d, n in want.items()) and count[1] > 5


def test_whole_documents(spark, make):
    docs = [(i, f"w{i} " * (1 + i % 9), f"s{i % 4}") for i in range(200)] + [(5, "w5 " * 6, "s1")]
    d = make(docs)
    out = mixing.mixed_documents(d, block=16)
    assert out.columns == d.columns
    texts = {(r.doc_id, r.text) for r in out.collect()}
    assert texts <= {(i, t) for i, t, _ in docs}
    words = {r[0]: r[1] for r in out.groupBy("source").agg(F.sum(mixing.count_words(F.col("text")))).collect()}
    want = {r.source: r.target for r in mixing.mixed_sizes(d, block=16).collect()}
    assert all(abs(words.get(s, 0) - t) <= 6 for s, t in want.items())


def test_empty(spark, make):
    assert mixing.mixed_sizes(make([])).count() == 0
    assert [r.taken for r in mixing.mixed_sizes(make([(1, None, None), (2, " ", "a")])).collect()] == [0, 0]
    assert mixing.mixed_documents(make([(1, None, None)])).count() == 0


def test_clashing_columns(make):
    """Columns with names like the helpers', dots and backticks come through, for single rows and for equal ones."""
    names = ["__d", "__s", "__c", "__rows", "__row", "__i", "__g", "__key", "__n", "__m", "__shard", "__place", "__start", "__range_0", "__in_x", "__base_n", "a.b", "c`d"]
    for docs in ([(1, "a b c", "x"), (2, "d e", None)], [(1, "a b c", "x")] * 2 + [(2, "d e", None)]):
        d = make(docs, extra=False)
        for n in names:
            d = d.withColumn(n, F.concat(F.lit(n), F.col("doc_id").cast("string")))
        rows = mixing.mixed_documents(d, block=8, shard="to")
        assert rows.columns == [*d.columns, "to"]
        got = rows.collect()
        assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in mixing.mixed_documents(make(docs, extra=False), block=8).collect()) and got
        assert all(r[n] == f"{n}{r.doc_id}" for r in got for n in names)
