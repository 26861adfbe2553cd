"""How often what is costly to make is made, told from plans."""

import json
import re

import pandas as pd

from quillon.operators import compare, exports, inventory, outline, references
from quillon.plans import comparison
from quillon.sources import staging


def saved(spark, folder):
    raw = {"body": {"children": [{"$ref": "#/texts/0"}, {"$ref": "#/groups/0"}]}, "texts": [{"text": "1. a"}, {"text": "b"}], "groups": [{"children": [{"$ref": "#/texts/1"}]}]}
    spark.createDataFrame([(1, json.dumps(raw))], "doc_id bigint, raw string").write.parquet(f"{folder}/raw")
    return spark.read.parquet(f"{folder}/raw")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_an_outline_reads_results_once(spark, tmp_path):
    """Besides the pass over the groups, which is written."""
    nodes = outline.outline(outline.body_blocks(saved(spark, tmp_path)))
    assert len(re.findall(r"raw#\d+\] parquet", plan(nodes))) == 1
    assert [(r.seq, r.text) for r in nodes.orderBy("seq").collect()] == [(0, "1. a"), (1, "b")]


def test_a_side_of_geometry_is_made_once(spark, tmp_path):
    side = lambda: compare.geometry(references.snapshots(saved(spark, tmp_path / "x")))
    one = side()
    assert len(re.findall(r"raw#\d+\] parquet", plan(compare.geometry_delta(one, one)))) == 2
    assert compare.geometry_delta(one, one).first().asDict() == {"doc_id": 1, "matched": 3, "left_over_left": 0, "left_over_right": 0, "changed_values": 0, "max_abs_delta": 0.0, "other_changes": 0}


def test_snapshots_leave_in_small_frames():
    raw = pd.DataFrame({"doc_id": range(120), "raw": [json.dumps({"body": {"children": [{"$ref": "#/texts/0"}]}, "texts": [{"text": str(i)}]}) for i in range(120)]})
    frames = list(references._snapshot_frames(iter([raw])))
    assert len(frames) == 3 and [t for f in frames for t in f["text"]] == [str(i) for i in range(120)]


def test_an_inventory_reads_results_once(spark, tmp_path):
    """All fields of all categories, their states and their values; examples are a second pass."""
    features = inventory.tree_features(saved(spark, tmp_path))
    keys = ("doc_id", "category", "field")
    assert [len(re.findall(r"raw#\d+\] parquet", plan(inventory.field_inventory(features, keys, examples=x)))) for x in (False, True)] == [1, 2]


def test_best_values_meet_from_all_parts(spark):
    """Of forty values in two keys, the most frequent, first seen first among equals."""
    seen = [(k, i, f"v{i % 40}" if i % 3 else None) for k in "ab" for i in range(400)]
    rows = spark.createDataFrame(seen, "field string, seq int, x string").selectExpr("field", "seq", "cast(seq as string) ref", "to_variant_object(struct(x as x)) v")
    observed = inventory.observe(rows.drop("field"), ("x",)).join(rows.select("seq").distinct(), "seq")
    got = inventory.field_inventory(observed, ("field",)).first()
    values = [x for _, _, x in seen if x]
    want = sorted(set(values), key=lambda x: (-values.count(x), values.index(x)))[: inventory.MOST_VALUES]
    assert [x["value"] for x in got.value_counts] == [json.dumps(x) for x in want]
    assert got.targets == 800 and sum(got.states.values()) == 800 and len(got.examples) == 3


def test_snapshots_meet_where_their_pair_is(spark):
    """One call a pair: no join brings distances back.  Texts with few and with many edits, equal ones, and a side that is not there."""
    shot = lambda t: t and json.dumps({"text": t, "blocks": [{"text": x} for x in t.split("\n")]})
    long = "\n".join(f"line {i * i % 97}" for i in range(300))
    texts = [(long, "x\n" + long), (long, long[::-1]), (long, long), ("a", "b"), (long, None), (None, None)]
    pairs = spark.createDataFrame([(i, shot(a), shot(b)) for i, (a, b) in enumerate(texts)], "n int, l_snapshot string, r_snapshot string")
    out = compare.compare_snapshots(pairs).select("n", "content_equal", "text_equal", "edit_distance", "text_difference_pct", "changes.added", "changes.deleted", "changes.spans")
    assert "Join" not in plan(out) and plan(out).count("ArrowEvalPython") == 1
    got = {r.n: r for r in out.collect()}
    d = {i: spark.createDataFrame([x], "a string, b string").selectExpr("levenshtein(a, b)").first()[0] for i, x in enumerate(texts[:4])}
    assert [got[i].edit_distance for i in range(4)] == list(d.values()) and [got[i].text_equal for i in range(4)] == [False, False, True, False]
    assert got[0][4] == 2 / (len(long) + 2) * 100 and (got[0].added, got[0].deleted, got[0].content_equal) == (1, 0, False)
    assert (got[2].content_equal, got[2].spans, got[2].added) == (True, "[]", 0)
    assert [(got[i].content_equal, got[i].added, got[i].edit_distance) for i in (4, 5)] == [(None, None, 0)] * 2


def test_a_report_measures_classes_of_texts(spark):
    """Sixty runs with three texts: a row for each pair of texts, with the runs' pairs that it stands for."""
    all_runs = spark.range(120).selectExpr("1L doc_id", "if(id % 2 = 0, 'a', 'b') tool", "cast(id div 2 as int) number", "'success' status", "cast(id as double) total_seconds", "cast(id as double) internal_seconds")
    snaps = all_runs.selectExpr("doc_id", "tool", "number", """to_json(struct(repeat('x', number % 3) as text, array(struct(repeat('x', number % 3) as text)) as blocks)) snapshot""")
    t = comparison.comparison(all_runs, snaps, 60, ("a", "b"))
    rows = lambda name: sorted((r.tool if "tool" in r else "", r.l_number, r.r_number, r.pairs, r.edit_distance) for r in t[name].collect())
    within = [(0, 0, 190, 0), (0, 1, 400, 1), (0, 2, 400, 2), (1, 1, 190, 0), (1, 2, 400, 1), (2, 2, 190, 0)]
    assert rows("repeat_distances") == [(tool, *x) for tool in "ab" for x in within] and sum(x[2] for x in within) == 60 * 59 // 2
    assert rows("cross_tool_distances") == [("", i, j, 400, abs(i - j)) for i in range(3) for j in range(3)]
    assert len({r.text_sha256 for r in t["texts"].collect()}) == 3 and t["texts"].count() == 120
    assert [(r.pairs, r.equal_pairs) for r in t["repeats"].collect()] == [(1770, 570)] * 2


def test_markdown_reads_results_once(spark, tmp_path, monkeypatch):
    """What all steps need of the results is written in one pass; links are followed in one round where the last level finds nothing."""
    written = []
    add = staging.Rounds.add
    monkeypatch.setattr(staging.Rounds, "add", lambda self, df: written.append((self.folder.rpartition("/")[2].split("-")[0], len(re.findall(r"raw#\d+\] parquet", plan(df))))) or add(self, df))
    out = exports.export_document(saved(spark, tmp_path), "markdown")
    assert written == [("markdown", 1), ("links", 0), ("paths", 0), ("paths", 0)] and not re.findall(r"raw#\d+\] parquet", plan(out))
    assert out.first().asDict() == {"doc_id": 1, "content": "1. a\n\nb", "problem": None}


def test_markdown_of_deep_and_shared_items(spark):
    """A chain longer than the levels of two rounds, whose end is a child of the body, too; captions stand before their owner alone."""
    n = 11
    ref = lambda *x: [{"$ref": f"#/texts/{i}"} for i in x]
    texts = [{"text": f"t{i}", "children": ref(i + 1) if i < n - 1 else ref(0)} for i in range(n)] + [{"text": "cap"}, {"label": "list_item", "text": "x"}, {"label": "list_item", "text": "y", "captions": ref(n)}]
    raw = {"body": {"children": ref(n + 1, n + 2, n, n - 1, 0)}, "texts": texts}
    rows = spark.createDataFrame([(1, json.dumps(raw)), (2, None)], "doc_id bigint, raw string")
    got = {r.doc_id: (r.content, r.problem) for r in exports.export_document(rows, "markdown").collect()}
    want = "- x\ncap\n\n- y\n\n" + "\n\n".join(f"t{i}" for i in (n - 1, *range(n - 1)))
    assert got == {1: (want, None), 2: (None, "no JSON")}
