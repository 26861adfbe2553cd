import random

from quillon.llm import licenses

T = {n: t for n, _, t in licenses.TEMPLATES}


def found(make, docs, **options):
    rows = licenses.find_licenses(make([(i, t, "s") for i, t in enumerate(docs)]), **options).collect()
    return {r.doc_id: {m.name: (m.first_word, m.last_word, m.containment) for m in r.matches} for r in rows}


def filler(rng, n):
    return " ".join("".join(rng.choice("klmnop") for _ in range(5)) for _ in range(n))


def test_whole_templates_anywhere(make):
    rng = random.Random(1)
    docs, want = [], []
    for name in T:
        for before in (0, 1, 7, 33, 500):
            docs.append(f"{filler(rng, before)} {T[name].upper()}\n{filler(rng, 40)}")
            want.append((name, before))
    got = found(make, docs)
    for i, (name, before) in enumerate(want):
        assert got[i][name][0] == before and got[i][name][2] == 1.0


def test_edited_and_partial(make):
    rng = random.Random(2)
    docs, keep = [], []
    for name, t in T.items():
        w = t.split()
        if len(w) > 60:
            for _ in range(8):
                e = list(w)
                e[rng.randrange(len(e))] = "edited"
                docs.append(filler(rng, rng.randint(0, 99)) + " " + " ".join(e))
                keep.append(name)
            docs.append(" ".join(w[: len(w) // 2]))
            keep.append(None)
    got = found(make, docs)
    for i, name in enumerate(keep):
        assert (name in got[i]) if name else not {n for n in got[i] if len(T[n].split()) > 60}


def test_defined_cases(make):
    got = found(make, [None, "", "a b c d", "All rights reserved.", "released UNDER the mit license", T["mit-notice"] * 2, "word " * 200_000])
    assert {i: sorted(m) for i, m in got.items()} == {0: [], 1: [], 2: [], 3: [], 4: ["mit"], 5: ["mit-notice"], 6: []}
    assert licenses.find_licenses(make([])).count() == 0
    r = licenses.report(licenses.find_licenses(make([(1, T["cc-by-nc-4.0"], "s"), (1, T["mit"], "s"), (None, "x", None)]))).collect()
    assert sorted((x.verdict for x in r)) == ["allowed", "denied", "none"]


def test_many_templates(make):
    """More values than a pass takes: the same matches from several passes, and each of a long list's texts is found."""
    rng = random.Random(4)
    docs = [f"{filler(rng, 9)} {t} {filler(rng, 9)}" for t in T.values()] + ["plain", None]
    assert found(make, docs, most_values=400) == found(make, docs)
    listed = [(f"t{i:03d}", True, filler(rng, 400)) for i in range(40)]
    got = found(make, [f"{filler(rng, 5)} {t}" for _, _, t in listed], templates=listed, most_values=12_000)
    assert all(got[i][f"t{i:03d}"] == (5, 405, 1.0) and len(got[i]) == 1 for i in range(40))
    assert licenses.find_licenses(make([(1, "x", "s")]), []).first().matches == []
