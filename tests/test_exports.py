"""Exports and settings."""

import json

import pytest
from pyspark.sql import functions as F

from quillon.operators import exports


def ref(*names):
    return [{"$ref": f"#/{n}"} for n in names]


def test_markdown(spark):
    cell = lambda t, r, c, rr=None, cc=None: {"text": t, "start_row_offset_idx": r, "end_row_offset_idx": rr or r + 1, "start_col_offset_idx": c, "end_col_offset_idx": cc or c + 1}
    doc = {
        "body": {"children": ref("texts/0", "texts/1", "groups/0", "tables/0", "pictures/0", "texts/5", "texts/6", "texts/7")},
        "texts": [{"label": "title", "text": "T"}, {"label": "section_header", "level": 2, "text": "H", "children": ref("texts/2")}, {"label": "text", "text": "under"}, {"label": "list_item", "text": "a"}, {"label": "list_item", "enumerated": True, "marker": "2.", "text": "b"}, {"label": "code", "text": "x = 1"}, {"label": "text", "text": ""}, {"label": "caption", "text": "C"}],
        "groups": [{"children": ref("texts/3", "texts/4")}],
        "tables": [{"captions": ref("texts/7"), "data": {"num_rows": 2, "num_cols": 3, "table_cells": [cell("p|q", 0, 0, cc=2), cell("r\ns", 0, 2, rr=2), cell("t", 1, 0)]}}, {"data": {}}],
        "pictures": [{"label": "picture"}],
    }
    raw = spark.createDataFrame([(1, json.dumps({"document": doc})), (2, "{"), (3, "[1]"), (4, None), (5, "{}")], "doc_id bigint, raw string")
    got = {r.doc_id: (r.content, r.problem) for r in exports.export_document(raw, "markdown").collect()}
    want = "# T\n\n### H\n\nunder\n\n- a\n2. b\n\nC\n\n| p\\|q | p\\|q | r s |\n|---|---|---|\n| t |  | r s |\n\n<!-- image -->\n\n```\nx = 1\n```"
    assert got == {1: (want, None), 2: (None, "no JSON"), 3: (None, "no object"), 4: (None, "no JSON"), 5: ("", None)}
    assert json.loads(exports.export_document(raw, "json").where("doc_id = 1").first().content) == doc
    with pytest.raises(ValueError):
        exports.export_document(raw, "html")


def test_result(spark):
    raw = spark.createDataFrame([(1, '{"status": "ok", "n": null, "document": {"a": [1]}}'), (2, '{"status": "ok"}'), (3, "[]"), (4, "x"), (5, '{"document": 3}')], "doc_id bigint, raw string")
    got = {r.doc_id: (r.metadata and json.loads(r.metadata), r.document and json.loads(r.document), r.problem) for r in exports.export_result(raw).collect()}
    assert got[1] == ({"status": "ok", "n": None}, {"a": [1]}, None)
    assert {i: x[2] for i, x in got.items() if i > 1} == {2: "result has no document", 3: "result is no object", 4: "no JSON", 5: "result has no document"}


def test_settings(spark):
    config = {"x": 1, "parsers": [{"default": {}}, {exports.OCR_PARSER: {"language": "kor", "skipOcr": False}, "y": 2}, {exports.OCR_PARSER: {}}]}
    df = spark.createDataFrame([("a", json.dumps(config)), ("b", '{"parsers": []}'), ("c", "no"), ("d", None)], "name string, config string")
    rows = exports.derive_configs(df).collect()
    got = {(r["name"], r.kind): (r.derived and json.loads(r.derived), r.problem) for r in rows}
    office = json.loads(json.dumps(config))
    office["parsers"][1][exports.OCR_PARSER]["skipOcr"] = True
    assert got["a", "pdf"] == (config, None) and got["a", "office"] == (office, None)
    assert {got[n, k][1] for n in "b" for k in ("pdf", "office")} == {f"no entry for {exports.OCR_PARSER}"} and got["c", "pdf"][1] == got["d", "office"][1] == "no JSON object"
    derived = exports.derive_configs(df.where("name = 'a'")).select("kind", F.col("derived").alias("config"))
    saved = spark.createDataFrame([("pdf", json.dumps(config, indent=1)), ("office", json.dumps(config))], "kind string, config string")
    assert [r.kind for r in exports.changed_configs(saved, derived).collect()] == ["office"]
    assert exports.changed_configs(saved.where("kind = 'x'"), derived).count() == 2


def test_columns(spark):
    d = spark.createDataFrame([("a.PDF", "image/PNG "), ("b.docx", "x/y"), (None, None)], "name string, mime string")
    assert [tuple(r) for r in d.select(exports.config_kind(F.col("name")), exports.image_extension(F.col("mime"))).collect()] == [("pdf", ".png"), ("office", ".img"), ("office", ".img")]
    o = spark.createDataFrame([("json", ".pdf", True, False, None), ("semantic-json", ".docx", True, False, None), ("semantic-rules", ".pdf", False, True, False), ("json", ".docx", False, None, True), ("json", ".PDF", None, True, True)], "o string, s string, a boolean, b boolean, c boolean")
    assert [r[0] is None for r in o.select(exports.option_problem(*map(F.col, "osabc"))).collect()] == [False, True, False, False, True]
