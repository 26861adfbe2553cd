import hashlib
import random
import re

from pyspark.sql import functions as F

from quillon.llm import pii

P = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v // 10 + v % 10
    return total % 10 == 0


def brute(t):
    out = []
    for o, (k, p) in enumerate(P.items()):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if k == "email" or k == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or k == "card" and 14 <= len(d) <= 19 and luhn(d) or k == "phone" and 10 <= len(d) <= 15:
                out.append((m.start(), o, k, m.end()))
    return sorted(out)


def digest(found):
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in found)


def test_base_matches_brute_force(make):
    rng = random.Random(6)
    texts = [None, "", "a@b.c_d@e.f.g x@y aaa@b aa@b.c@d.e +1 (366) 555-9807 1.2.3.4.5.6.7.8 300.1.1.1 4539 1488 0343 6467 é😀 q@w.er 1.1.1.0255", "..@x.y--@z.w.@q.r-@.a@b..c a@b.c.", "ab@cd.ef " * 500]
    texts += ["".join(rng.choice("ab1@.+- ()é4") for _ in range(rng.randint(0, 60))) for _ in range(600)]
    texts += ["".join(rng.choice("0123456789") + rng.choice(["", "", " ", "-"]) for _ in range(rng.randint(10, 24))) for _ in range(300)]
    rows = {r.doc_id: r for r in pii.report(pii.find_personal_data(make([(i, t, "s") for i, t in enumerate(texts)]))).collect()}
    for i, t in enumerate(texts):
        b, r = brute(t), rows[i]
        assert r.base_sha256 == hashlib.sha256(digest(b).encode()).hexdigest(), t
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[2] == k for x in b) for k in P]


def test_long_texts(make):
    docs = [(1, "1 2" * 100_000, "s"), (2, "a" * 200_000, "s"), (3, "1" * 200_000 + ".1.1.1", "s"), (4, "a." * 100_000 + "@b.c", "s"), (5, "é a@b.cd" * 60_000, "s")]
    rows = {r.doc_id: r.n_email + r.n_ip + r.n_card + r.n_phone for r in pii.report(pii.find_personal_data(make(docs))).collect()}
    assert rows == {1: 0, 2: 0, 3: 0, 4: 1, 5: 60_000}


def test_clean_texts(spark):
    """Spans that overlap, touch and number more than are taken at a time, against plain slicing."""
    rng = random.Random(9)
    data = []
    for i in range(30):
        text = "".join(rng.choice("abé😀 ") for _ in range(rng.randint(0, 40) if i else 9000))
        places = [(a, a + rng.randint(1, 5)) for a in (rng.randrange(max(1, len(text))) for _ in range(rng.randint(0, 8) if i else 2500))]
        data.append((i, text, [("ip", a, min(b, len(text)), "") for a, b in places]))
    df = spark.createDataFrame(data, "doc_id int, text string, spans array<struct<kind:string,start:bigint,end:bigint,value:string>>")
    got = {r.doc_id: r.clean for r in pii.sanitise(df).collect()}
    for i, text, spans in data:
        out, at = "", 0
        for a, b in sorted(((a, b) for _, a, b, _ in spans), key=lambda x: (x[0], -x[1])):
            if a >= at:
                out += text[at:a] + "[IP]"
            at = max(at, b)
        assert got[i] == out + text[at:]


def associated():
    rng = random.Random(3)
    common = ["water", "stone", "river", "green", "table", "north"]
    fill = lambda n: " ".join(rng.choice(common) for _ in range(n))
    docs = [(i, f"{fill(12)} Zebulon writes from zeb@ex.org {fill(9)}. {fill(20)} zebulon", "s") for i in range(6)]
    docs += [(100 + i, f"{fill(60)} writes from", "s") for i in range(200)]
    return docs + [(400, "Zebulon was here", "s"), (None, docs[0][1], "s"), (0, docs[0][1], "s")]


def test_terms_that_tell(make):
    """Against the same counts in Python."""
    docs = associated()
    found = pii.find_personal_data(make(docs))
    rows = found.select("doc_id", "spans", "text").collect()
    assert len(rows) == len(docs)
    for r in rows:
        terms = sorted({s.value.lower() for s in r.spans if s.kind == "term"})
        assert terms == (["zebulon"] if r.doc_id is None or r.doc_id < 100 else [])
        for s in r.spans:
            assert r.text[s.start : s.end] == s.value
    clean = {r.doc_id: r.clean for r in pii.sanitise(found).collect()}
    assert "zeb" not in clean[1].lower() and clean[1].count("[TERM]") == 2 and "[EMAIL]" in clean[1] and clean[100] is None
    gone = {r.doc_id: r.clean for r in pii.sanitise(found, mode="remove").collect()}
    assert "[" not in gone[1] and "zeb" not in gone[1].lower()


def test_terms_far_away_and_short(make):
    """Names of one to three letters, 200 characters and more from the mention."""
    rng = random.Random(11)
    fill = lambda n: " ".join(rng.choice(["water", "stone", "river", "green"]) for _ in range(n))
    docs = [(i, f"Li 金 kim: {fill(50)} zeb@ex.org {fill(3)}", "s") for i in range(6)] + [(100 + i, fill(60), "s") for i in range(200)]
    docs += [(300, f"lone {fill(50)} one@ex.org", "s"), (301, f"lone {fill(50)} one@ex.org", "s")]  # two texts prove nothing
    for r in pii.find_personal_data(make(docs)).collect():
        assert {s.value.lower() for s in r.spans if s.kind == "term"} == ({"li", "金", "kim"} if r.doc_id < 100 else set())


def test_empty(make):
    assert pii.report(pii.find_personal_data(make([]))).count() == 0
    assert pii.find_personal_data(make([(1, "plain", "s")])).select(F.size("spans")).first()[0] == 0
