"""Alignment against whole texts encoded one by one, with counts in dictionaries."""

import collections
import hashlib

import public_tokenizers
import pyarrow.parquet as pq
import pytest

from quillon.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def one(a, b, text):
    """Groups and links of a text."""
    import re

    if not text:
        return [], []
    want = (" " + text).encode()
    back = alignment.byte_characters()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids_b)]
    if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
        return [], []
    owner = lambda parts: [n for n, p in enumerate(parts) for _ in p]
    links = sorted(set(zip(owner(bytes_a), owner(bytes_b))))
    ends = [[sum(map(len, parts[: n + 1])) for n in range(len(parts))] for parts in (bytes_a, bytes_b)]
    common = sorted(set(ends[0]) & set(ends[1]))
    groups = [tuple([i for i, e in zip(ids, side) if low < e <= high] for ids, side in zip((ids_a, ids_b), ends)) for low, high in zip([0, *common], common)]
    return groups, [(ids_a[x], ids_b[y]) for x, y in links]


def model(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    each = [(i, *one(a, b, t)) for i, t in rows]
    count = collections.Counter(p for _, _, links in each for p in set(links))
    best = collections.defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    said = lambda groups: ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
    out = [(i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(ls), sum(count[p] == best[p[0]] for p in ls), sum(count[p] for p in ls), hashlib.sha256(said(g).encode()).hexdigest() if g else "") for i, g, ls in each]
    return sorted(out, key=repr), {(x, y, n, n == best[x]) for (x, y), n in count.items()}


def check(spark, rows, parts=2, **settings):
    df = spark.createDataFrame([(i, t, "x", 1, "x") for i, t in rows], "doc_id bigint, text string, stripe string, part int, doc string").repartition(parts)
    found = alignment.align(df, A, B, **settings)
    documents, pairs = model(rows)
    assert sorted((tuple(r) for r in found.documents.collect()), key=repr) == documents
    assert {tuple(r) for r in found.pairs().collect()} == pairs


ODD = [
    "", None, " ", "  ", "a", " a", "a ", "a  b", "a   b  ", "\n", "a\nb", "a \nb", "a\n b", "a\n\n b c", "tab\there \t x", "nbsp x  y", "　wide 　space　 z", "\x1c a \x85 b\x85c", "don't we'll I'M 's", "<|endoftext|> <s> </s> <unk> <0x41>",
    "▁ under ▁▁x", "한글 가나다 😀😀 é é ﬁ", "x" * 3000, "ab " * 2000, "​ ﻿ \x00 \x01", "A" * 50 + " " * 60 + "B",
]


def test_odd_texts_nulls_and_repeats(spark):
    check(spark, [*enumerate(ODD), (3, "a  b"), (None, "a"), (None, "null id"), (None, "null id")])


def test_documents(spark):
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"])
    check(spark, list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist())), parts=3)


def test_many_parts_and_hot_words(spark, monkeypatch):
    """Stripes cut to parts by a small bound, blocks of few documents."""
    monkeypatch.setattr(alignment, "PART_BYTES", 500)
    check(spark, [(i, f"the same words of all, then word{i % 13} and the {'the ' * (i % 5)}end") for i in range(120)], text_bytes=200)


def test_empty(spark):
    check(spark, [])


@pytest.mark.parametrize("text", [t for t in ODD if t])
def test_pieces_join(text):
    assert " ".join(alignment.pieces_of(text)) == text
