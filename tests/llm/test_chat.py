import hashlib
import random

import pytest

from quillon.llm import chat


def digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_round_trip(spark):
    rng = random.Random(1)
    pieces = ["\\", "#", "<", "[", "### assistant:\n", "</turn>\n", "[image:0]", "a", "é😀", "\n", "</turn", "\\#"]
    rows = {}
    for c in range(120):
        rows[c] = [(rng.choice(["user", "assistant", "system", "### x"]), "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))) for _ in range(rng.randint(1, 6))]
    data = [(c, i, r, t) for c, ts in rows.items() for i, (r, t) in enumerate(ts)]
    data += [(None, 1, None, None), (None, 0, "assistant", "n"), (500, None, "user", "first"), (500, 0, "assistant", "b"), (500, 0, "assistant", "a"), (501, 0, "assistant", "x" * 300_000)]
    rng.shuffle(data)
    d = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 as parts", "'x' as formatted", "2 as loss")
    rows |= {None: [("assistant", "n"), ("", "")], 500: [("user", "first"), ("assistant", "a"), ("assistant", "b")], 501: [("assistant", "x" * 300_000)]}
    f = chat.format_conversations(d)
    got = {r.conv_id: r for r in chat.report(f).collect()}
    assert got.keys() == rows.keys()
    for c, turns in rows.items():
        said = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), digest(turns))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def test_parts(spark):
    parts = [{"type": "text", "text": "see [image:9]"}, {"type": "image", "ref": "a.png", "size": 392}, {"type": "audio", "ref": "b", "size": 1}, {"type": "document", "ref": None, "size": None}, {"type": "text", "text": None}]
    formatted, loss, attached = chat.format_turns([("user", parts), ("assistant", [{"type": "image", "ref": "c", "size": 0}, {"type": "text", "text": "ok"}])])
    assert chat.read_turns(formatted) == [("user", [("text", "see [image:9]"), ("image", "0"), ("audio", "1"), ("document", "2")]), ("assistant", [("image", "3"), ("text", "ok")])]
    assert [(a["number"], a["type"], a["ref"], a["tokens"]) for a in attached] == [(0, "image", "a.png", 2), (1, "audio", "b", 1), (2, "document", None, 1), (3, "image", "c", 1)]
    assert formatted[loss[0][0] : loss[0][1]] == "[image:3]ok"
    with pytest.raises(ValueError):
        chat.format_turns([("user", [{"type": "video"}])])
    d = spark.createDataFrame([(1, 0, "user", [("image", None, "r", 196)])], f"conv_id bigint, turn bigint, role string, p {chat.PARTS}")
    r = chat.format_conversations(d, parts="p").first()
    assert r.formatted == "### user:\n[image:0]</turn>\n" and r.attachments[0].tokens == 1


def test_empty(spark):
    assert chat.report(chat.format_conversations(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"))).count() == 0
