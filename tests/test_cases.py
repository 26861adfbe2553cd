"""Small cases of the operators, worked out by hand: a query over a few rows and the rows that it gives."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from quillon.functions import canonical, distance, text
from quillon.operators import cards, chunks, compare, evidence, inventory, markup, outline, references, runs
from quillon.plans import comparison
from quillon.plans.queries import _BUNDLES, _PROBLEMS

CASES: dict = {}


def case(sql=None, big=""):
    """``big`` names columns that are BIGINT in the query's result."""

    def add(f):
        whole = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in big.split())}) FROM ({sql})" if big else sql
        CASES[f.__name__] = (f, whole)
        return f

    return add


def rows(spark, schema, values):
    return spark.createDataFrame(values, schema)


_ERRORS = [(1, [("disk", None), ("", "late"), (None, "")]), (2, []), (3, [(None, "only")])]


@case("SELECT * FROM (VALUES (1, 'disk; late'), (2, ''), (3, 'only')) t(id, details)")
def error_details(spark):
    d = rows(spark, "id int, e array<struct<error_message:string,message:string>>", _ERRORS)
    return d.select("id", runs.error_details(F.col("e")).alias("details"))


_META = [(1, '{"tk:exception:warn": "x"}'), (2, '{"tk:Exception": false, "limit-reached": ""}'), (3, '{"WRITE-LIMIT-REACHED": true}'), (4, '{"a": 1}'), (5, '{"x-exception": [], "exception": 0, "e-exception": null}'), (6, '{"exception": {}}')]


@case("SELECT * FROM (VALUES (1, true), (2, false), (3, true), (4, false), (5, false), (6, true)) t(id, partial)")
def partial_detector(spark):
    d = rows(spark, "id int, j string", _META)
    return d.select("id", runs.reports_partial(F.expr("try_variant_get(try_parse_json(j), '$', 'map<string,variant>')")).alias("partial"))


@case("SELECT * FROM (VALUES (1, 1.5e0, 1.234e0), (2, NULL, NULL)) t(id, of_times, of_millis)")
def internal_seconds(spark):
    d = rows(spark, "id int, t array<double>, m bigint", [(1, [1.0, 0.5], 1234), (2, [], None)])
    return d.select("id", runs.internal_seconds_of_times(F.col("t")).alias("of_times"), runs.internal_seconds_of_millis(F.col("m")).alias("of_millis"))


@case("""WITH e(name, v) AS (VALUES ('code', 'a1'), ('jar', 'b2'), ('model', 'c3')), a(name, v) AS (VALUES ('code', 'a1'), ('jar', 'b9'), ('extra', 'z'))
SELECT name, e.v AS expected, a.v AS actual FROM e FULL JOIN a USING (name) WHERE e.v IS DISTINCT FROM a.v""")
def resume_guard(spark):
    s = "name string, value string"
    return runs.resume_mismatches(rows(spark, s, [("code", "a1"), ("jar", "b2"), ("model", "c3")]), rows(spark, s, [("code", "a1"), ("jar", "b9"), ("extra", "z")]))


@case("SELECT * FROM (VALUES (1, true), (2, false), (3, false)) t(id, same)")
def ocr_settings(spark):
    d = rows(spark, "id int, l1 string, l2 string, m1 string, m2 int, skip boolean", [(1, "kor+eng", "eng+kor", "3", 3, False), (2, "kor", "eng", "3", 3, False), (3, "kor", "kor", "3", 3, None)])
    side = lambda n: {"command": F.lit("t"), "path": F.lit("/d"), "language": F.col(f"l{n}"), "mode": F.col(f"m{n}"), "skip": F.col("skip")}
    return d.select("id", runs.same_ocr(side(1), side(2)).alias("same"))


@case("SELECT * FROM (VALUES (1, 3), (2, 1), (3, 0), (4, 2), (5, 5)) t(id, d)", big="d")
def text_distance_unicode(spark):
    d = rows(spark, "id int, a string, b string", [(1, "kitten", "sitting"), (2, "한글", "한굴"), (3, "", ""), (4, "😀a", "b"), (5, "", "abcde")])
    return d.select("id", distance.edit_distance(F.col("a"), F.col("b")).alias("d"))


_NUMBERS = [(1, '{"a": 1, "b": [1, 2, 3], "c": "x"}', '{"a": 1.5, "b": [1, 4], "d": 0}'), (2, "[true, 2]", "[false, 2]"), (3, '{"s": "a"}', '{"s": "b"}'), (4, "[1, null]", "[1, null]")]


@case("SELECT * FROM (VALUES (1, 2, 2e0, 3), (2, 1, 1e0, 0), (3, 0, 0e0, 1), (4, 0, 0e0, 0)) t(id, changed_values, max_abs_delta, other_changes)", big="changed_values other_changes")
def numeric_delta(spark):
    d = rows(spark, "id int, a string, b string", _NUMBERS)
    return d.select("id", compare.numeric_delta("a", "b").alias("d")).select("id", "d.*")


_FLAT_A = [(1, "x", "1"), (1, "y", "2.5"), (1, "z", "a"), (2, "x", "1"), (2, "w", "true")]


_FLAT_B = [(1, "x", "4"), (1, "y", "2.5"), (1, "z", "b"), (2, "x", "1"), (2, "v", "7")]


@case("SELECT * FROM (VALUES (1, 1, 3e0, 1), (2, 0, 0e0, 2)) t(doc_id, changed_values, max_abs_delta, other_changes)", big="changed_values other_changes")
def numeric_delta_flat(spark):
    s = "doc_id int, path string, value string"
    return compare.flat_numeric_delta(rows(spark, s, _FLAT_A), rows(spark, s, _FLAT_B), ("doc_id",))


def _geometry_doc(shift: float) -> dict:
    box = lambda x: [{"page_no": 1, "bbox": {"l": x, "t": 2.0}, "charspan": [0, 1]}]
    return {"body": {"children": [{"$ref": f"#/texts/{i}"} for i in (1, 0, 2)]}, "texts": [{"label": "text", "text": t, "prov": box(1.0 + shift * (t == "A"))} for t in ("A", "B", "B")]}


@case("SELECT * FROM (VALUES (1, 1, 2, 2, 1, 0.25e0, 0)) t(doc_id, matched, left_over_left, left_over_right, changed_values, max_abs_delta, other_changes)", big="doc_id matched left_over_left left_over_right changed_values other_changes")
def geometry_match(spark):
    snap = lambda shift: compare.geometry(references.snapshots(rows(spark, "doc_id bigint, raw string", [(1, json.dumps(_geometry_doc(shift)))])))
    return compare.geometry_delta(snap(0.0), snap(0.25))


@case("SELECT * FROM (VALUES (1, 2, false, 1, 0, 0, 1, 1), (2, 3, true, 0, 0, 0, 0, 0)) t(l_number, r_number, content_equal, edit_distance, added, deleted, replaced_left, replaced_right)", big="edit_distance added deleted replaced_left replaced_right")
def snapshot_pairs(spark):
    s = lambda t: json.dumps({"text": t, "blocks": [{"text": x} for x in t.split("\n")]})
    a = rows(spark, "l_number int, r_number int, l_snapshot string, r_snapshot string", [(1, 2, s("A\nB\nC"), s("A\nB\nD")), (2, 3, s("가\nB"), s("가\nB"))])
    out = compare.compare_snapshots(a)
    return out.select("l_number", "r_number", "content_equal", "edit_distance", "changes.added", "changes.deleted", "changes.replaced_left", "changes.replaced_right")


_TEXTS = [(1, "1. 모집개요", True), (2, "1. 모집개요", False), (3, "가. 모집대상 : 청년", False), (4, "나. 참여조건", True), (5, "１２. 전각", True), (6, "(1) 항목", False), (7, "① 항목", False), (8, "‧ 항목", False), (9, "plain", True)]


@case("SELECT * FROM (VALUES (1, 1, '1', '모집개요', NULL), (2, NULL, NULL, NULL, NULL), (3, 2, '가', '모집대상', '청년'), (4, 2, '나', '참여조건', NULL), (5, 1, '１２', '전각', NULL), (6, NULL, NULL, NULL, NULL), (7, NULL, NULL, NULL, NULL), (8, NULL, NULL, NULL, NULL), (9, NULL, NULL, NULL, NULL)) t(id, level, marker, title, lead)")
def heading_match(spark):
    d = rows(spark, "id int, t string, b boolean", _TEXTS).withColumn("level", text.heading_level(F.col("t"), F.col("b")))
    h = d.withColumn("h", text.heading_parts(F.col("t"), F.col("level")))
    return h.select("id", "level", "h.marker", "h.title", "h.lead")


@case("SELECT * FROM (VALUES (6, 'ordered', '1', '항목'), (7, 'ordered', '①', '항목'), (8, 'bullet', '‧', '항목')) t(id, kind, marker, text)")
def list_item_kind(spark):
    d = rows(spark, "id int, t string, b boolean", _TEXTS).withColumn("l", text.list_item(F.col("t"))).where("l is not null")
    return d.select("id", "l.kind", "l.marker", "l.text")


def notice() -> dict:
    bold = {"formatting": {"bold": True}}
    ref = lambda *r: [{"$ref": f"#/{x}"} for x in r]
    return {
        "body": {"children": ref("texts/0", "groups/0", "texts/3", "texts/4", "tables/0", "texts/5")},
        "texts": [{"text": "1. 모집개요", **bold}, {"text": "가. 모집대상 :", **bold}, {"text": " 누구나 "}, {"text": "나. 참여조건"}, {"text": "(1) 만 18세"}, {"text": "2. 지원내용", **bold}],
        "groups": [{"children": ref("texts/1", "texts/2")}],
        "tables": [{"data": {"num_rows": 1, "num_cols": 1, "table_cells": [{"text": "x"}]}}],
    }


def _raw(spark, *docs):
    return rows(spark, "doc_id bigint, raw string", [(i, json.dumps(d, ensure_ascii=False)) for i, d in enumerate(docs, 1)])


@case("SELECT * FROM (VALUES (1, 0, NULL, 'section', 1, '1', '모집개요', NULL), (1, 1, 0, 'section', 2, '가', '모집대상', '누구나'), (1, 2, 0, 'section', 2, '나', '참여조건', NULL), (1, 3, 2, 'list_item', NULL, '1', NULL, '만 18세'), (1, 4, 2, 'table', NULL, NULL, NULL, NULL), (1, 5, NULL, 'section', 1, '2', '지원내용', NULL)) t(doc_id, seq, parent_seq, type, level, marker, title, text)", big="doc_id seq parent_seq")
def notice_outline(spark):
    return outline.outline(outline.body_blocks(_raw(spark, notice()))).select("doc_id", "seq", "parent_seq", "type", "level", "marker", "title", "text")


@case()
def notice_tree(spark):
    return outline.nested(outline.outline(outline.body_blocks(_raw(spark, notice()))))


_EDGES = [(1, "g0", 0, "t1"), (1, "g0", 1, "g1"), (1, "g1", 0, "t2"), (1, "g0", 2, "t3"), (2, "a", 0, "b"), (2, "b", 0, "a"), (3, "x", 0, "y"), (3, "x", 1, "z"), (3, "z", 0, "y")]


_ROOTS = [(1, 0, "g0"), (1, 1, "t1"), (2, 0, "a"), (3, 0, "x"), (3, 1, "z")]


_SQL_EDGES = f"roots(doc_id, pos, child) AS (VALUES {', '.join(map(str, _ROOTS))}), edges(doc_id, parent, pos, child) AS (VALUES {', '.join(map(str, _EDGES))})"


@case(f"""WITH RECURSIVE {_SQL_EDGES},
w AS (SELECT doc_id, child AS ref, [pos] AS path, [child] AS seen, false AS cyclic FROM roots
  UNION ALL SELECT e.doc_id, e.child, list_append(w.path, e.pos), list_append(w.seen, e.child), list_contains(w.seen, e.child) FROM w JOIN edges e ON e.doc_id = w.doc_id AND e.parent = w.ref WHERE NOT w.cyclic),
f AS (SELECT doc_id, ref, min(path) AS path FROM w WHERE NOT cyclic GROUP BY ALL), l AS (SELECT DISTINCT doc_id, ref FROM w WHERE cyclic)
SELECT f.doc_id, f.ref, array_to_string(path, '.') AS path, len(path) - 1 AS depth, l.ref IS NOT NULL AS cyclic FROM f LEFT JOIN l ON f.doc_id = l.doc_id AND f.ref = l.ref""")
def ref_traversal(spark):
    o = references.reading_order(rows(spark, "doc_id int, pos int, child string", _ROOTS), rows(spark, "doc_id int, parent string, pos int, child string", _EDGES))
    return o.select("doc_id", "ref", F.array_join(F.transform("path", lambda x: x.cast("string")), ".").alias("path"), F.col("depth").cast("bigint").alias("depth"), "cyclic")


@case("SELECT * FROM (VALUES (1, 'g0', 'A C', 'g0,t1,g1,t2,t3', true)) t(doc_id, ref, text, refs, bold)")
def group_flatten(spark):
    edges = rows(spark, "doc_id int, parent string, pos int, child string", _EDGES).where("doc_id = 1")
    texts = rows(spark, "doc_id int, ref string, text string, bold boolean", [(1, "t1", "A", True), (1, "t2", "", False), (1, "t3", "C", False)])
    g = references.group_text(rows(spark, "doc_id int, ref string", [(1, "g0")]), edges, texts)
    return g.select("doc_id", "ref", "text", F.array_join("source_refs", ",").alias("refs"), "bold")


def linked() -> list[dict]:
    ref = lambda *r: [{"$ref": f"#/{x}"} for x in r]
    return [
        {"body": {"children": ref("pictures/0", "pictures/0")}, "pictures": [{"label": "picture", "captions": ref("texts/0", "texts/0")}], "texts": [{"text": "cap", "footnotes": ref("texts/1")}, {"text": "note"}, {"text": "x"}, {"text": "y"}]},
        {"body": {"children": ref("texts/0")}, "texts": [{"text": "loop", "children": ref("texts/0")}]},
        {"document": {"body": {"children": ref("texts/1", "texts/0")}, "texts": [{"text": "A"}, {"text": "B"}]}},
    ]


@case("SELECT * FROM (VALUES (1, 0, '#/pictures/0', 'body', 0), (1, 1, '#/texts/0', 'body', 1), (1, 2, '#/texts/1', 'body', 2), (1, 3, '#/texts/2', 'unattached', 0), (1, 4, '#/texts/3', 'unattached', 0), (3, 0, '#/texts/1', 'body', 0), (3, 1, '#/texts/0', 'body', 0)) t(doc_id, seq, ref, layer, depth)", big="doc_id seq depth")
def ref_traversal_full(spark):
    return references.snapshot_blocks(references.snapshots(_raw(spark, *linked()))).select("doc_id", "seq", "ref", "layer", "depth")


@case("SELECT * FROM (VALUES (1, 5, 5), (2, 0, 0)) t(doc_id, n_blocks, cyclic) WHERE false UNION ALL SELECT * FROM (VALUES (1, 5, 0), (2, NULL, 1), (3, 2, 0)) t(doc_id, n_blocks, cyclic)", big="doc_id n_blocks")
def snapshot_problems(spark):
    s = references.snapshots(_raw(spark, *linked()))
    return s.select("doc_id", "n_blocks", F.coalesce(F.col("problem").contains("Cyclic"), F.lit(False)).cast("int").alias("cyclic"))


_REFS = ["#/texts/0", "#/texts/-1", "#/texts/9", "texts/0", "#/pages/1", "#/texts/0/x", "#/texts/00"]


@case("SELECT * FROM (VALUES ('#/texts/0', NULL), ('#/texts/-1', 'reference does not exist'), ('#/texts/9', 'reference does not exist'), ('texts/0', 'unsupported reference'), ('#/pages/1', 'unsupported item type'), ('#/texts/0/x', 'unsupported reference'), ('#/texts/00', NULL)) t(child, problem)")
def reference_check(spark):
    its = references.items(references.documents(_raw(spark, {"texts": [{"text": "a"}]})))
    return references.dereference(rows(spark, "doc_id bigint, child string", [(1, r) for r in _REFS]), its).select("child", "problem")


@case("SELECT * FROM (VALUES (1, 4, 2)) t(doc_id, refs, resolved)", big="doc_id refs resolved")
def reference_resolution(spark):
    ref = lambda r: {"$ref": r}
    doc = {"texts": [{"self_ref": "#/texts/0", "parent": ref("#/body")}, {"self_ref": "#/texts/1", "children": [ref("#/texts/0"), ref("#/x")]}, {"self_ref": "dup"}, {"self_ref": "dup", "captions": [ref("#/texts/1")]}]}
    return references.resolution_summary(references.items(references.documents(_raw(spark, doc))))


_IMAGES = [(1, "image/png", "data:image/png;base64,QUJD"), (2, "text/plain", "data:image/png;base64,QUJD"), (3, "image/png", None), (4, "image/png", "http://x"), (5, "image/png", "data:image/gif;base64,QUJD"), (6, "image/png", "data:image/png;base64,QUJ"), (7, "image/PNG", "data:image/png;base64,QUJD")]


@case("SELECT * FROM (VALUES (1, NULL), (2, 'not an image type'), (3, 'no uri'), (4, 'not an image data uri'), (5, 'types differ'), (6, 'bad base64'), (7, NULL)) t(id, problem)")
def image_uri_check(spark):
    d = rows(spark, "id int, m string, u string", _IMAGES)
    return d.select("id", text.data_uri_problem(F.col("m"), F.col("u")).alias("problem"))


MARKDOWN = "# 제목\n\n문단 **굵게**\n이어짐\n\n- 하나\n- 둘\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```py\n**아님**\n```\n\nSetext\n---\n"


@case("SELECT * FROM (VALUES (1, 'markdown', '{\"heading\": 2, \"list\": 2, \"table\": 1}', '{\"1\": 1, \"2\": 1}', '{\"strong\": 1}', '{\"bullets\": 1}', 1), (2, 'html', '{\"heading\": 1, \"table\": 1}', '{\"2\": 1}', '{\"u\": 1}', '{}', 1)) t(doc_id, format, kinds, levels, emphasis, containers, n)", big="doc_id n")
def markup_details(spark):
    html = '<div><h2>T</h2><u>k</u><table><tr><td colspan="2">1</td></tr></table><script><b>x</b></script></div>'
    return markup.markup_inventory(rows(spark, "doc_id bigint, text string", [(1, MARKDOWN), (2, html)])).drop("examples")


@case("SELECT * FROM (VALUES (0, 'section_header', 1, '제목'), (1, 'unknown', NULL, '문단 **굵게**' || chr(10) || '이어짐'), (2, 'list_item', NULL, '하나'), (3, 'list_item', NULL, '둘'), (4, 'table', NULL, 'a' || chr(10) || 'b' || chr(10) || '1' || chr(10) || '2'), (5, 'code', NULL, '**아님**' || chr(10)), (6, 'section_header', 2, 'Setext')) t(seq, label, level, text)", big="seq level")
def markdown_blocks(spark):
    return markup.markup_blocks(rows(spark, "doc_id bigint, text string", [(1, MARKDOWN)])).select("seq", "label", "level", "text")


@case("SELECT * FROM (VALUES ('heading', 1, 1), ('formatting', 3, NULL), ('list', 6, NULL), ('list', 7, NULL), ('table', 10, 2), ('heading', 17, 2)) t(signal, line, level)", big="line level")
def markdown_signals(spark):
    return markup.markdown_signals(rows(spark, "doc_id bigint, text string", [(1, MARKDOWN)])).select("signal", "line", "level")


@case("SELECT * FROM (VALUES (1, 'a'), (2, 'b c'), (3, '')) t(id, s)")
def unicode_strip(spark):
    return rows(spark, "id int, t string", [(1, "　a "), (2, "\x1cb c\n"), (3, " \t")]).select("id", text.strip(F.col("t")).alias("s"))


@case("""SELECT * FROM (VALUES (1, sha256('{"a": "가", "b": [1.5, 10000000000.0, null]}')), (2, sha256('{"a": "가", "b": [1.5, 10000000000.0, null]}'))) t(id, h)""")
def canonical_hash(spark):
    d = rows(spark, "id int, j string", [(1, '{"b": [1.50, 1e10, NaN], "a": "가"}'), (2, '{"a":"가","b":[1.5,10000000000.0,Infinity]}')])
    return d.select("id", canonical.content_hash(F.col("j")).alias("h"))


_STATES = ['{}', '{"f": null}', '{"f": false}', '{"f": true}', '{"f": []}', '{"f": {}}', '{"f": ""}', '{"f": 0}', '{"f": "x"}', '{"f": {"g": 1}}']


@case("SELECT * FROM (VALUES ('필드 없음', 1), ('null', 1), ('false', 1), ('true', 1), ('빈 배열', 1), ('빈 객체', 1), ('빈 문자열', 1), ('값 있음', 3)) t(state, n)", big="n")
def eight_states(spark):
    d = rows(spark, "ref string, j string", [(str(i), j) for i, j in enumerate(_STATES)]).withColumn("v", F.parse_json("j"))
    return inventory.field_states(inventory.observe(d, ("f",)), ()).select("state", "n")


def featured() -> dict:
    return {
        "name": "n", "origin": {"filename": "f.pdf"}, "body": {"children": []}, "groups": [],
        "texts": [{"self_ref": "#/texts/0", "label": "section_header", "level": 1, "text": "A", "prov": []}, {"self_ref": "#/texts/1", "label": "section_header", "level": 1, "text": "B", "formatting": {"bold": True, "italic": None}, "prov": [{"page_no": 1, "bbox": {"l": 1}}]}, {"label": "text", "text": "c"}],
        "tables": [{"self_ref": "#/tables/0", "label": "table", "data": {"num_rows": 1, "num_cols": 2, "table_cells": [{"text": "x", "col_span": 2}]}}],
        "pictures": [{"self_ref": "#/pictures/0", "label": "picture", "image": {"mimetype": "image/png", "uri": "data:x"}}],
    }


@case("SELECT * FROM (VALUES (1, 'classification', true), (1, 'headings', true), (1, 'hierarchy', true), (1, 'formatting', true), (1, 'tables', true), (1, 'location', true), (1, 'metadata', true), (1, 'resources', true)) t(doc_id, category, provided)", big="doc_id")
def tree_features(spark):
    f = inventory.tree_features(_raw(spark, featured()))
    return inventory.provided(f.where("decides"), ("doc_id", "category"))


@case("""SELECT * FROM (VALUES ('headings', 'level', 2, '값 있음=2', '1=2'), ('tables', 'col_span', 1, '값 있음=1', '2=1'), ('formatting', 'formatting.bold', 3, 'true=1,필드 없음=2', 'true=1'), ('location', 'page_no', 1, '값 있음=1', '1=1')) t(category, field, targets, states, value_counts)""", big="targets")
def feature_inventory(spark):
    f = inventory.tree_features(_raw(spark, featured()))
    inv = inventory.field_inventory(f, ("doc_id", "category", "field")).where("(category, field) in (('headings', 'level'), ('tables', 'col_span'), ('formatting', 'formatting.bold'), ('location', 'page_no'))")
    pairs = lambda c, k, n: F.array_join(F.transform(c, lambda x: F.concat(x[k], F.lit("="), x[n].cast("string"))), ",")
    return inv.select("category", "field", F.col("targets").cast("bigint").alias("targets"), pairs(F.map_entries("states"), "key", "value").alias("states"), pairs(F.col("value_counts"), "value", "n").alias("value_counts"))


def recursive_result() -> list[dict]:
    return [{"tk:content": "본문", "xmpTPg:NPages": 3, "author": "a", "dotted.key": False}, {"X-TIKA:content": "# image3.jpeg\n\n**굵게**\n\n| a | b |\n|---|---|\n| 1 | 2 |\n", "tk:resource-name": "image3.jpeg", "tk:embedded-depth": 1}]


@case("SELECT * FROM (VALUES (1, 'classification', true), (1, 'headings', true), (1, 'tables', true), (1, 'hierarchy', true), (1, 'resources', true), (1, 'metadata', true)) t(doc_id, category, provided)", big="doc_id")
def resource_features(spark):
    res = inventory.resources(_raw(spark, recursive_result()))
    f = inventory.resource_features(res, markup.markup_blocks(res, "doc_id", "content"), markup.html_tags(res, "doc_id", "content"))
    return f.where("provided")


@case("SELECT * FROM (VALUES (0, 'xmpTPg:NPages', '3', true), (0, 'author', '\"a\"', false), (0, 'dotted.key', 'false', false), (1, 'tk:resource-name', '\"image3.jpeg\"', false), (1, 'tk:embedded-depth', '1', false)) t(idx, key, value, about_pages)")
def resource_metadata(spark):
    return inventory.resource_metadata(inventory.resources(_raw(spark, recursive_result()))).select("idx", "key", "value", "about_pages")


@case("SELECT * FROM (VALUES (1, 2, '본문' || chr(10) || '# image3.jpeg', '3')) t(doc_id, n_blocks, head, pages)", big="doc_id n_blocks")
def resource_snapshot(spark):
    return references.snapshots(_raw(spark, recursive_result())).select("doc_id", "n_blocks", F.substring_index("text", "\n", 2).alias("head"), "pages")


@case("SELECT * FROM (VALUES (1, 'classification', 4), (1, 'headings', 2), (1, 'hierarchy', 1), (1, 'formatting', 1), (1, 'tables', 1), (1, 'location', 2), (1, 'metadata', 1), (1, 'resources', 1), (2, 'headings', 1), (2, 'tables', 1), (2, 'metadata', 1), (2, 'location', 1), (2, 'resources', 1)) t(doc_id, category, n) WHERE category NOT IN ('classification')", big="doc_id n")
def excerpt_counts(spark):
    e = evidence.excerpts(_raw(spark, featured(), recursive_result()))
    return e.where("category <> 'classification' and not (doc_id = 2 and category in ('formatting', 'hierarchy'))").groupBy("doc_id", "category").agg(F.count("*").alias("n"))


@case()
def excerpts(spark):
    return evidence.excerpts(_raw(spark, featured(), recursive_result()))


@case("SELECT * FROM (VALUES " + ", ".join(f"({i}, " + ("NULL" if p is None else f"'{p}'") + ")" for i, p in enumerate(_PROBLEMS)) + ") t(bundle, problem)")
def card_validation(spark):
    b = rows(spark, "bundle int, text string", [(i, json.dumps(x)) for i, x in enumerate(_BUNDLES)])
    d = rows(spark, "id string, sha256 string, runs_tree array<int>, runs_recursive array<int>", [("d1", "s1", [1, 2], [1])])
    return cards.validate(b, d, ("tree", "recursive")).select("bundle", "problem")


@case("SELECT * FROM (VALUES ('a', '{}'), ('b', '{}'), ('c', '{}')) t(id, json)")
def card_merge(spark):
    s = "id string, json string"
    return cards.merge(rows(spark, s, [("a", "{}"), ("b", "{}")]), rows(spark, s, [("c", "{}")]))


@case("SELECT * FROM (VALUES ('a', 0.5e0, 0.5e0, 0.5e0, 0.5e0, 0.583333e0, 0.25e0), ('b', 1e0, 0.5e0, 0.666667e0, 0.5e0, 0.583333e0, 0.25e0)) t(label, \"precision\", recall, f1, accuracy, macro_f1, unknown_rate)")
def label_metrics(spark):
    d = rows(spark, "truth string, guess string", [("a", "a"), ("a", "UNKNOWN"), ("b", "b"), ("b", "a")])
    m = chunks.label_metrics(d)
    return m.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy", "macro_f1", "unknown_rate")])


@case("SELECT * FROM (VALUES (1, 'a', 1, 1, 0, 1, 1, 1, '2 valid identical (planned 3), includes partial', 1.0e0, 0), (1, 'b', 1, 0, 1, 1, 0, 0, 'not comparable (1 valid)', 4.0e0, 2)) t(doc_id, tool, success, partial, failure, not_run, pairs, equal_pairs, label, median, worst)", big="doc_id success partial failure not_run pairs equal_pairs worst")
def comparison_report(spark):
    """The report's tables over two tools' runs, joined to one row a tool."""
    r = rows(spark, "doc_id bigint, tool string, number int, status string, total_seconds double, internal_seconds double", [(1, "a", 1, "success", 1.0, 0.5), (1, "a", 2, "partial_success", 9.0, None), (1, "b", 1, "success", 4.0, None), (1, "b", 2, "failure", None, None)])
    shot = lambda t: json.dumps({"text": t, "blocks": [{"text": t}]})
    snaps = rows(spark, "doc_id bigint, tool string, number int, snapshot string", [(1, "a", 1, shot("abc")), (1, "a", 2, shot("abc")), (1, "b", 1, shot("xbcd")), (1, "b", 2, shot("?"))])
    t = comparison.comparison(r, snaps, 3, ("a", "b"))
    worst = t["repeat_distances"].select("doc_id", "tool", F.col("edit_distance").alias("d")).unionByName(t["cross_tool_distances"].select("doc_id", F.lit("b").alias("tool"), F.col("edit_distance").alias("d"))).groupBy("doc_id", "tool").agg(F.max("d").alias("worst"))
    out = t["repeats"].join(t["total_seconds"].select("doc_id", "tool", "median"), ["doc_id", "tool"]).join(worst, ["doc_id", "tool"])
    return out.select("doc_id", "tool", "success", "partial", "failure", F.col("not_run").cast("bigint").alias("not_run"), F.col("pairs").cast("bigint").alias("pairs"), F.col("equal_pairs").cast("bigint").alias("equal_pairs"), "label", "median", "worst")


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(spark, name):
    f, sql = CASES[name]
    df = f(spark)
    got = df.collect()
    if sql is None:
        assert got
        return
    r = duckdb.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(r.columns)
    want = [tuple(plain(x[r.columns.index(c)]) for c in columns) for x in r.fetchall()]
    assert sorted((tuple(plain(x[c]) for c in columns) for x in got), key=repr) == sorted(want, key=repr)


def test_trees_hold_the_outline(spark):
    """The nested form of every document, walked again, has the nodes of its outline in their order, each under its parent."""
    from quillon.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    want: dict = {}
    for r in sorted(QUERIES["notice_outline"](spark, sf).collect(), key=lambda r: (r["doc_id"], r["seq"])):
        want.setdefault(r["doc_id"], []).append(r)
    trees = {r["doc_id"]: json.loads(r["tree"]) for r in QUERIES["notice_tree"](spark, sf).collect()}
    assert trees.keys() == want.keys()
    for doc, tree in trees.items():
        at, nodes = {None: tree}, iter(tree["children"])
        left = {None: nodes}
        for r in want[doc]:
            node = next(left[r["parent_seq"]])
            assert (node["type"], node.get("level"), node.get("marker"), node.get("title")) == (r["type"], r["level"], r["marker"], r["title"])
            at[r["seq"]], left[r["seq"]] = node, iter(node.get("children", []))
            if r["type"] == "section" and r["text"]:
                lead = next(left[r["seq"]])
                assert (lead["type"], lead["text"]) == ("paragraph", r["text"])
            elif r["type"] != "section":
                assert node["text"] == r["text"]
        assert all(next(x, None) is None for x in left.values())
