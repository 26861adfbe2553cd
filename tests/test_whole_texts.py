"""Queries over whole texts, against brute force."""

import pytest

from quillon.plans.queries import QUERIES


@pytest.fixture
def folder(spark, tmp_path):
    def put(rows):
        spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return put


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_distances_of_long_and_other_texts(spark, folder):
    long = "".join(chr(97 + i * i % 23) for i in range(1200))
    texts = {1: long, 2: long[5:600] + "\u00e9\ud55c\U0001f600" + long[640:], 3: "\ud55c\uae00 \U0001f600", 4: "\ud55c\uad74", 5: ""}
    rows = [(i, t, "ko", "a") for i, t in texts.items()] + [(9, "alone", "en", "b")]
    got = {(r.l_number, r.r_number): r.edit_distance for r in QUERIES["text_distance_whole"](spark, folder(rows)).collect()}
    assert got == {(i, i + 1): levenshtein(texts[i], texts[i + 1]) for i in range(1, 5)}


def test_escape_reaches_the_end(spark, folder):
    whole = "a" * 70 + "*_x\n\ud55c\U0001f600|" * 50
    escaped = "".join(f"&#{ord(c)};" if c in "&<>\\`*_{}[]()#+-.!|~" else " " if c in "\r\n" else c for c in whole)
    assert QUERIES["markdown_escape"](spark, folder([(1, whole, "en", "a")])).first().escaped == escaped


def test_excerpts_keep_long_texts(spark, folder):
    long = "x" * 20_001
    rows = QUERIES["excerpt_documents"](spark, folder([(1, long + "\nshort", "en", "a")])).where("category = 'classification'").collect()
    assert {r.source: r.text for r in rows} == {"#/texts/0": long, "#/texts/1": "short"}


def test_traversal_nests_and_defers(spark, folder):
    """Children at once, a caption behind the whole body, the rest unattached."""
    rows = QUERIES["ref_traversal_full"](spark, folder([(1, "\n".join("abcdefgh"), "en", "a")])).orderBy("seq").collect()
    assert [(int(r.ref[8:]), r.layer, r.depth) for r in rows] == [(0, "body", 0), (1, "body", 1), (2, "body", 0), (4, "body", 0), (5, "body", 1), (6, "body", 0), (3, "body", 1), (7, "unattached", 0)]
