"""Section outlines from ordered blocks, with window functions in place of a stack.

A section of level 1 hangs on the root, one of level 2 on the last of level 1, any other block on the later of the two.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SUB_HEADING, TOP_HEADING, heading_level, heading_parts, list_item, strip
from ..sources.staging import Rounds
from .references import KINDS, documents, group_text, reference_problem

NODE = "doc_id bigint, seq bigint, parent_seq bigint, type string, level int, marker string, kind string, title string, text string, source_refs array<string>"


#: Collections whose items have data and no text.
_WITH_DATA = ("tables", "pictures", "form_items", "key_value_items")


def _index(kind: str, ref):
    """The number in a reference to an item of a collection, null in any other."""
    n = ref.substr(F.lit(len(kind) + 4), F.lit(12)).try_cast("int")
    return F.when(ref.startswith(f"#/{kind}/"), F.when(F.concat(F.lit(f"#/{kind}/"), n.cast("string")) == ref, n))


def _at(kind: str, ref):
    """What a reference leads to in the array column of its collection."""
    return F.get(kind, _index(kind, ref))


def _has(kind: str, ref):
    n = _index(kind, ref)
    return F.coalesce((n >= 0) & (n < F.size(kind)), F.lit(False))


def body_blocks(raw: DataFrame, doc_id: str = "doc_id", text: str = "raw", max_depth: int = 64) -> DataFrame:
    """(doc_id, seq, type, text, bold, data, source_refs, problem): the body's items in order, groups joined, empty texts gone.

    A reference that does not resolve, a group that holds itself or goes too deep, a group's child that is neither text nor group
    and a table without data are rows, too, with what is wrong as ``problem``; other documents are not touched by them.  Documents are parsed
    twice, for their groups and for their body, and travel once, whole, to what is known of their groups."""
    docs = documents(raw, doc_id, text)
    listed = lambda v, path: F.expr(f"try_variant_get({v}, '{path}', 'array<variant>')")
    plain = lambda x: F.struct(strip(F.coalesce(F.try_variant_get(x, "$.text", "string"), F.lit(""))).alias("text"), F.coalesce(F.try_variant_get(x, "$.formatting.bold", "boolean"), F.lit(False)).alias("bold"))
    data = lambda kind: lambda x: F.to_json(F.try_variant_get(x, "$.data", "variant") if kind == "tables" else x)
    refs = F.transform(listed("v", "$.body.children"), lambda x: F.try_variant_get(x, '$["$ref"]', "string"))
    found = {k: F.variant_get("v", f"$.{k}", "array<variant>") for k in KINDS}
    texts = F.transform(found["texts"], plain).alias("texts")

    # Groups' links with the texts that they lead to are few and written once.
    below = lambda x: F.coalesce(F.try_variant_get(x, "$.children", "array<variant>"), F.array(F.try_variant_get(x, "$.children", "variant")))
    named = lambda i: F.concat(F.lit("#/groups/"), i.cast("string"))
    said = lambda c: F.when(_at("texts", c).isNotNull(), plain(_at("texts", c)))
    member = lambda c: F.struct(c.alias("child"), said(c)["text"].alias("text"), said(c)["bold"].alias("bold"))
    held = lambda x, i: F.struct(named(i).alias("parent"), F.array_contains(F.coalesce("body", F.array().cast("array<string>")), named(i)).alias("top"), F.transform(F.transform(below(x), lambda c: F.try_variant_get(c, '$["$ref"]', "string")), member).alias("children"))
    groups = docs.select("doc_id", found["texts"].alias("texts"), refs.alias("body"), found["groups"].alias("groups")).select("doc_id", F.explode(F.transform("groups", held)).alias("g"))
    edges = Rounds(raw.sparkSession, "groups").add(groups.select("doc_id", "g.parent", "g.top", F.posexplode("g.children").alias("pos", "c")).select("doc_id", "parent", "top", "pos", "c.*").where("child is not null"))
    tops = edges.where("top")
    grouped = group_text(tops.select("doc_id", F.col("parent").alias("ref")).distinct(), edges, edges.where("text is not null").select("doc_id", F.col("child").alias("ref"), "text", "bold").distinct(), max_depth)
    odd = tops.groupBy("doc_id", F.col("parent").alias("ref")).agg(F.max(F.when(~F.col("child").rlike("^#/(texts|groups)/"), "a group's child is neither text nor group")).alias("odd"))
    of_groups = odd.join(grouped, ["doc_id", "ref"], "left").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("ref", F.struct("text", "bold", "source_refs", "problem", "odd")))).alias("grouped"))

    # What the body points at is looked up in the document's row.
    lists = docs.select("doc_id", refs.alias("body"), texts, F.size(found["groups"]).alias("n_groups"), *[F.transform(found[k], data(k)).alias(k) for k in _WITH_DATA])
    none = F.lit(None).cast("string")
    item = lambda type_, text, bold, data, refs, problem: F.struct(type_.alias("type"), text.alias("text"), bold.alias("bold"), data.alias("data"), refs.alias("source_refs"), problem.alias("problem"))

    def look(ref, i):
        group = F.element_at("grouped", ref)
        said = group["text"].isNotNull()
        n = _index("groups", ref)
        one = F.when(_at("texts", ref)["text"] != "", item(F.lit("text"), _at("texts", ref)["text"], _at("texts", ref)["bold"], none, F.array(ref), none))
        one = one.when(said, item(F.lit("text"), group["text"], group["bold"], none, group["source_refs"], F.coalesce(group["odd"], group["problem"])))
        one = one.when(group["odd"].isNotNull(), item(none, none, F.lit(False), none, F.array(ref), group["odd"]))
        known = F.coalesce(_at("texts", ref).isNotNull() | ((n >= 0) & (n < F.col("n_groups"))), F.lit(False))
        for k in _WITH_DATA:
            has = _has(k, ref)
            lacks = F.when(_at(k, ref).isNull(), "table without data") if k == "tables" else none
            one = one.when(has, item(F.lit(k.removesuffix("s")), F.lit(""), F.lit(False), _at(k, ref), F.array(ref), lacks))
            known = known | has
        return F.struct(i.alias("seq"), ref.alias("ref"), one.alias("item"), known.alias("known"))

    rows = lists.join(of_groups, "doc_id", "left").select("doc_id", F.explode(F.transform("body", look)).alias("r")).select("doc_id", "r.seq", "r.ref", "r.item.*", "r.known")
    rows = rows.withColumn("problem", F.coalesce(reference_problem(F.col("ref"), F.col("known")), "problem"))
    rows = rows.where("type is not null or problem is not null").withColumn("type", F.coalesce("type", F.lit("unresolved")))
    return rows.select("doc_id", "seq", "type", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("bold", F.lit(False)).alias("bold"), "data", F.coalesce("source_refs", F.array("ref")).alias("source_refs"), "problem")


def _rules(gathered):
    """Whether a bold numbered heading and a lettered heading are both there; ``gathered`` makes one value of a document's."""
    text = F.col("type") == "text"
    return gathered(F.bool_or(text & F.col("bold") & F.col("text").rlike(TOP_HEADING))) & gathered(F.bool_or(text & F.col("text").rlike(SUB_HEADING)))


def matches_rules(blocks: DataFrame) -> DataFrame:
    """(doc_id, matched): a bold numbered heading and a lettered heading are both there."""
    return blocks.groupBy("doc_id").agg(_rules(lambda x: x).alias("matched"))


def parents(rows: DataFrame, group: str = "doc_id", seq: str = "seq", level: str = "level") -> DataFrame:
    """``rows`` with parent_seq: what a stack of sections gives, from two running values."""
    before = Window.partitionBy(group).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    last = lambda n: F.last(F.when(F.col(level) == n, F.col(seq)), ignorenulls=True).over(before)
    rows = rows.withColumn("__h1", last(1)).withColumn("__h2", last(2))
    inner = F.when(F.col("__h2") > F.coalesce(F.col("__h1"), F.lit(-1)), F.col("__h2")).otherwise(F.col("__h1"))
    return rows.withColumn("parent_seq", F.when(F.col(level) == 1, F.lit(None)).when(F.col(level) == 2, F.col("__h1")).otherwise(inner)).drop("__h1", "__h2")


def outline(blocks: DataFrame) -> DataFrame:
    """Nodes of the outline: type (section, paragraph, list_item or the block's), level, marker, title, text, lead, parent_seq.

    Headings and lists are only read as such in documents that match the rules.  Windows over a document's blocks,
    which are made once."""
    rows = blocks.withColumn("matched", _rules(lambda x: x.over(Window.partitionBy("doc_id"))))
    is_text = F.col("matched") & (F.col("type") == "text")
    rows = rows.withColumn("level", F.when(is_text, heading_level(F.col("text"), F.col("bold"))))
    rows = parents(rows).withColumn("h", heading_parts(F.col("text"), F.col("level"))).withColumn("l", F.when(is_text & F.col("level").isNull(), list_item(F.col("text"))))
    kind = F.when(F.col("level").isNotNull(), "section").when(F.col("l").isNotNull(), "list_item").when(F.col("type") == "text", "paragraph").otherwise(F.col("type"))
    return rows.select("doc_id", F.col("seq").cast("bigint").alias("seq"), F.col("parent_seq").cast("bigint").alias("parent_seq"), kind.alias("type"), "level", F.coalesce("h.marker", "l.marker").alias("marker"), F.col("l.kind").alias("kind"), F.col("h.title").alias("title"), F.when(F.col("level").isNotNull(), F.col("h.lead")).otherwise(F.coalesce("l.text", F.when(F.col("type") == "text", F.col("text")))).alias("text"), "data", "source_refs", "matched")


def nested(nodes: DataFrame, schema_name: str = "quillon.outline") -> DataFrame:
    """(doc_id, tree): the nodes nested as JSON; two levels of sections, so three aggregates at most a document."""

    fields = ("seq", "parent_seq", "type", "level", "marker", "kind", "title", "text", "data", "source_refs")
    out = pa.schema([("doc_id", pa.int64()), ("tree", pa.string())])

    def tree(matched: bool, rows: list[dict]) -> str:
        root = {"schema_name": schema_name, "version": "1.1.0", "semantic_rules_matched": matched, "children": []}
        at = {}
        for r in rows:
            refs = r["source_refs"]
            if r["type"] == "section":
                node = {"type": "section", "level": r["level"], "marker": r["marker"], "title": r["title"], "source_refs": refs, "children": []}
                if r["text"]:
                    node["children"].append({"type": "paragraph", "text": r["text"], "source_refs": refs})
                at[r["seq"]] = node
            elif r["type"] == "list_item":
                node = {"type": r["type"], "kind": r["kind"], "marker": r["marker"], "text": r["text"], "source_refs": refs}
            elif r["type"] == "paragraph":
                node = {"type": r["type"], "text": r["text"], "source_refs": refs}
            else:
                node = {"type": r["type"], "source_refs": refs, "data": json.loads(r["data"]) if r["data"] else None}
            (root if r["parent_seq"] is None else at[r["parent_seq"]])["children"].append(node)
        return json.dumps(root, ensure_ascii=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            trees = [tree(matched.as_py(), rows.as_py()) for matched, rows in zip(b.column("matched"), b.column("rows"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(trees, pa.string())], schema=out)

    gathered = nodes.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.bool_or("matched").alias("matched"), F.array_sort(F.collect_list(F.struct(*fields))).alias("rows"))
    return gathered.mapInArrow(run, "doc_id bigint, tree string")
