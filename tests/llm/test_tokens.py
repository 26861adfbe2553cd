import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import tokens
from quillon.llm.common import new_folder
from quillon.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_pack_round_trip():
    rng = np.random.default_rng(1)
    for bits in (1, 3, 7, 8, 13, 16, 17, 24, 32):
        ids = rng.integers(0, 1 << bits, 1001, dtype=np.uint64).astype(np.uint32)
        data = tokens.pack(ids, bits)
        assert len(data) == -(-1001 * bits // 8) and (tokens.unpack(data, 1001, bits) == ids).all()
    assert [tokens.bits_for(n) for n in (1, 2, 3, 65_536, 65_537)] == [1, 1, 2, 16, 17]


def _split(ids, count):
    ends = np.cumsum(count).tolist()
    return [ids[x:y].tolist() for x, y in zip([0, *ends], ends)]


def test_encoder_equals_library(library):
    rng = random.Random(2)
    texts = ["<|endoftext|> hi <|ENDOFTEXT|> A", "a\x1cb\x85c\xa0d", "don't can't IT'S we'll", "İstanbul ΣΣ ΟΔΟΣ", "你好 world, 😀! ok.", "a,. b.,c ..", "²x ª ½ µ ß ÿ", "\n\t\r\x0b a", "ſ ŉ ǰ", None, "", "é à.", "x', y'. ×, ÷. «x».", "3, 3.5!! café### Ça$$ 'll, ü", "&&& ###a b###c"]
    texts += ["".join(rng.choice("aAéÉßµª .,!?'s\n\t́​1²<|endoftext|>-İıΣ#") for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    texts += [" ".join(rng.choice(("The", "naïve", "Straße,", "don't", "x###", "42!!", "ÀÉ?", "a.b.")) for _ in range(40)) for _ in range(300)]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for room in (64_000_000, 30_000):
        e = tokens.Encoder(tokenizer_path(), room)
        assert e.by_word
        got = [x for i in range(0, len(texts), 100) for x in _split(*e.encode(pa.array(texts[i : i + 100])))]
        assert got == want
        assert _split(*e.encode(pa.array(texts).slice(7, 5))) == want[7:12]


def test_other_tokenizer_gets_whole_texts():
    import public_tokenizers

    e = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not e.by_word
    texts = ["Hello  World, don't", "", "a\nb"]
    assert _split(*e.encode(pa.array(texts))) == [e.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_store_is_bounded():
    store = tokens.WordStore(100_000)
    held = lambda: sum(store.cost(w, x) for w, x in store.known.items())
    for turn in range(6):
        words = [f"w{i}" for i in range(turn * 500, turn * 500 + 1000)]  # half of them for the second time
        store.offer(words, [b"12345678"] * 1000)
        assert store.size == held() <= 100_000
    assert store.known and "w0" not in store.known and "w2999" in store.known
    store.offer(["x" * 5000] * 2, [b"1"] * 2)
    assert "x" * 5000 not in store.known


def test_files(spark, make, library):
    docs = [(3, "b c", "s"), (-1, "A b, c.", "s"), (None, "n", "s"), (7, None, "s"), (8, "", "s"), (3, "a", "t"), (9, "long word " * 30_000, "s")]
    files = tokens.write_tokens(make(docs), tokenizer_path(), 1, new_folder(spark, "t"), block=64)
    rows = tokens.read_tokens(files, with_ids=True).orderBy("start").collect()
    want = {}
    for d, t, _ in docs:
        want.setdefault(d, []).append(library.encode(t or "", add_special_tokens=False).ids + [1])
    assert [r.doc_id for r in rows] == [None, -1, 3, 3, 7, 8, 9]
    at = 0
    for r in rows:
        assert r.start == at and r.ids in want[r.doc_id] and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        at += r.n_tokens
    f = tokens.TokenFile(files.orderBy("part").first().file)
    whole = f.ids(0, f.n_tokens)
    assert all((f.ids(a, b) == whole[a:b]).all() for a, b in ((0, 1), (5, 5), (f.n_tokens - 1, f.n_tokens), (0, min(130, f.n_tokens))))


def test_empty(spark, make):
    assert tokens.token_output(make([]), tokenizer_path()).count() == 0
