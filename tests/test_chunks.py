"""Budget chunks and section chunks against plain loops."""

import random

import pytest

from quillon.operators import chunks


def greedy(tokens, limit, overlap):
    """[(chunk, index, context)] of one stretch."""
    out, chunk, used, start = [], -1, None, 0
    for i, n in enumerate(tokens):
        if used is None or used + n > limit:
            before, start = start, i
            room, j = min(overlap, limit - n), i
            while j > before and used is not None and sum(tokens[j - 1 : i]) <= room:
                j -= 1
            while j < i and not tokens[j]:
                j += 1
            chunk, used = chunk + 1, sum(tokens[j:i])
            out += [(chunk, k, True) for k in range(j, i)]
        used += n
        out.append((chunk, i, False))
    return out, chunk + 1


def rows(rng, documents, longest, most):
    out = []
    for d in range(documents):
        section = 0
        for i in range(rng.randrange(1, longest)):
            section += rng.random() < 0.1
            out.append((d or None, i, " ".join(["w"] * rng.randrange(most)), section))
    return out


@pytest.mark.parametrize("limit,overlap,batch", [(8, 0, 10000), (8, 3, 7), (8, 7, 1), (20, 6, 13), (40, 6, 2), (30, 12, 3), (1, 0, 3)])
def test_against_loop(spark, limit, overlap, batch):
    data = rows(random.Random(limit + overlap), 40, 60, 12)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)  # chunks go on from batch to batch
    try:
        blocks = spark.createDataFrame(data, "doc_id int, seq int, text string, section int").repartition(3)
        made = chunks.chunk_by_tokens(blocks, limit, section="section", overlap=overlap)
        got = sorted((r.doc_id or 0, r.chunk, r.seq, r.context) for r in made.collect())
        checked = chunks.chunk_problems(blocks.where("doc_id is not null"), made.where("doc_id is not null"), limit=limit, overlap=overlap, section="section").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for d in {r[0] for r in data}:
        first = 0
        for s in sorted({r[3] for r in data if r[0] == d}):
            own = [r for r in data if r[0] == d and r[3] == s]
            out, n = greedy([len(r[2].split()) for r in own], limit, overlap)
            want += [(d or 0, first + c, own[i][1], context) for c, i, context in out]
            first += n
    assert got == sorted(want)
    assert {x for r in checked for x in tuple(r)[1:]} == {0}


def test_case_of_the_limit(spark):
    """60, 60 and 8 tokens under a limit of 64 are three chunks, not a chunk of 68."""
    blocks = spark.createDataFrame([(1, i, "w " * n) for i, n in enumerate((60, 60, 8))], "doc_id int, seq int, text string")
    assert [r.chunk for r in chunks.chunk_by_tokens(blocks, 64).orderBy("seq").collect()] == [0, 1, 2]


def test_problems_are_found(spark):
    blocks = spark.createDataFrame([(1, i, "w " * 5, "a" if i < 3 else "b") for i in range(6)], "doc_id int, seq int, text string, section string")
    wrong = spark.createDataFrame([(1, 0, 0, False, "a"), (1, 0, 1, False, "a"), (1, 0, 3, False, "b"), (1, 1, 4, False, "b"), (1, 1, 4, False, "b"), (1, 1, 0, True, "a")], "doc_id int, chunk int, seq int, context boolean, section string").selectExpr("*", "5L as tokens")
    r = chunks.chunk_problems(blocks, wrong, limit=12, overlap=5, section="section").first()
    assert (r.lost, r.repeated, r.over_limit, r.gaps, r.mixed, r.bad_context) == (2, 1, 2, 2, 2, 1)


def test_nothing(spark):
    none = spark.createDataFrame([], "doc_id int, seq int, text string")
    assert chunks.chunk_by_tokens(none, 5, overlap=2).count() == 0
    odd = spark.createDataFrame([(1, 0, None), (1, 1, ""), (1, 1, "a b")], "doc_id int, seq int, text string")
    assert {(r.seq, r.tokens, r.chunk) for r in chunks.chunk_by_tokens(odd, 5).collect()} == {(0, 0, 0), (1, 0, 0), (1, 2, 0)}


def sections(items, captions):
    """Chunks by a stack of headings."""
    out, stack, before = [], [], None
    owned = {}
    for ref, caption in captions:
        owned.setdefault(ref, []).append(caption)
    hidden = {c for _, c in captions}
    for seq, ref, label, level, text in items:
        if ref in hidden:
            continue
        if label in ("title", "section_header"):
            rank = 0 if label == "title" else max(1, level or 1)
            stack = [h for h in stack if h[0] < rank] + [(rank, ref, text)]
        elif label == "list_item" and before == "list_item":
            out[-1]["text"] += "\n" + (text or "")
            out[-1]["body"].append(ref)
            out[-1]["captions"] += sorted(set(owned.get(ref, [])))
        else:
            out.append({"text": text or "", "headings": [h[2] for h in stack], "body": [ref], "context": [h[1] for h in stack], "captions": sorted(set(owned.get(ref, [])))})
        before = label
    return [(c["text"], c["headings"], c["body"], c["context"] + c["captions"]) for c in out]


def test_sections(spark):
    rng = random.Random(9)
    data, captions, want = [], [], {}
    for d in range(25):
        items = [(i, f"#/texts/{i}", rng.choice(["title", "section_header", "section_header", "text", "text", "list_item", "list_item", "table", None]), rng.choice([None, 1, 2, 3, 4]), rng.choice(["x", f"t{i}", "", None])) for i in range(rng.randrange(0, 25))]
        own = [(f"#/texts/{i}", f"#/texts/{j}") for i, j in (rng.sample(range(25), 2) for _ in range(2))]
        data += [(d, *x) for x in items]
        captions += [(d, *x) for x in own]
        want[d] = sections(items, own)
    got = {d: [] for d in want}
    made = chunks.section_chunks(spark.createDataFrame(data, "doc_id int, seq int, ref string, label string, level int, text string"), spark.createDataFrame(captions, "doc_id int, ref string, caption string"))
    for r in made.orderBy("doc_id", "chunk").collect():
        assert r.chunk == len(got[r.doc_id])
        got[r.doc_id].append((r.text, r.headings, r.body_refs, r.context_refs))
    assert got == want


def test_hybrid_keeps_sections_apart(spark):
    items = [(0, "section_header", "A"), (1, "text", "w " * 3), (2, "text", "w " * 3), (3, "text", "w " * 3), (4, "section_header", "B"), (5, "text", "w")]
    df = spark.createDataFrame([(1, i, f"r{i}", label, 1, t) for i, label, t in items], "doc_id int, seq int, ref string, label string, level int, text string")
    got = [(r.chunk, r.ref, r.context, [h.text for h in r.headings]) for r in chunks.hybrid_chunks(df, 7, 3).orderBy("chunk", "seq").collect()]
    assert got == [(0, "r1", False, ["A"]), (0, "r2", False, ["A"]), (1, "r2", True, ["A"]), (1, "r3", False, ["A"]), (2, "r5", False, ["B"])]


def test_line_heads():
    text = "intro\n| a | b |\n|---|---|\n| 1 | 2 |\n\n- x\n  more\n  - y\n    z\n- w"
    heads = [h for _, h in chunks.line_heads(text)]
    assert heads == [None, None, None, "| a | b |\n|---|---|", None, None, "- x", "- x", "- x\n  - y", None]


def test_lines_carry_heads(spark):
    rows = "".join(f"| r{i} | {'w ' * (i % 4)}|\n" for i in range(20))
    texts = [(1, f"| a | b |\n|---|---|\n{rows}"), (2, "- head of item\n" + "".join(f"  line {i} of it\n" for i in range(12))), (3, None), (4, ""), (5, "w " * 50 + "\nx")]
    got = chunks.line_chunks(spark.createDataFrame(texts, "doc_id int, text string"), 16).orderBy("doc_id", "chunk").collect()
    for d, text in texts:
        own = [r for r in got if r.doc_id == d]
        assert "\n".join(r.text if r.head is None else r.text[len(r.head) + 1 :] for r in own) == (text or "")
        assert all(len(r.text.split()) <= 16 or r.first == r.last for r in own)
    assert all(r.head == "| a | b |\n|---|---|" for r in got if r.doc_id == 1 and 0 < r.chunk and r.first < 22)
    assert {r.head for r in got if r.doc_id == 2 and r.chunk and r.first < 13} == {"- head of item"}
