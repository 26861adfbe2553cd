"""Field inventories: which fields are missing, null, empty or set, over nested JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .references import CONTENT_KEYS, KINDS, documents

# The eight states of a field.
MISSING, NULL, FALSE, TRUE, EMPTY_ARRAY, EMPTY_OBJECT, EMPTY_TEXT, SET = "필드 없음", "null", "false", "true", "빈 배열", "빈 객체", "빈 문자열", "값 있음"
MOST_VALUES = 8
MOST_EXAMPLES = 3

# The fields of each category of a tree-shaped document.
CATEGORIES = {
    "classification": ("elements", ("label",)),
    "headings": ("headings", ("label", "level")),
    "hierarchy": ("document", ("groups", "body.children")),
    "formatting": ("texts", ("formatting", "formatting.bold", "formatting.italic", "formatting.underline")),
    "tables": ("tables", ("data.num_rows", "data.num_cols")),
    "location": ("elements", ("prov",)),
    "metadata": ("document", ("origin", "name")),
    "resources": ("resources", ("self_ref", "label", "captions", "references", "image.mimetype")),
}
#: Fields that are listed with a category but do not decide whether it is there.
MORE = {
    "hierarchy": ("groups_and_elements", ("parent", "children")),
    "tables": ("cells", ("text", "start_row_offset_idx", "end_row_offset_idx", "start_col_offset_idx", "end_col_offset_idx", "row_span", "col_span", "column_header", "row_header")),
    "location": ("provenance", ("page_no", "bbox", "charspan")),
}
#: Collections whose items are elements, in their order.
ELEMENTS = ("texts", "tables", "pictures", "key_value_items", "form_items")
RESOURCE_FIELDS = ("tk:resource-name", "resourceName", "Content-Type", "tk:embedded-depth", "X-TIKA:embedded_depth", "tk:content", "X-TIKA:content")
RESOURCE_LINKS = ("tk:embedded-depth", "tk:embedded-resource-path", "X-TIKA:embedded_depth", "X-TIKA:embedded_resource_path")


def field(v: str, path: str, literal: bool = False) -> Column:
    """A variant column's field.  A dotted path goes down step by step; a literal one is one key."""
    steps = [path] if literal else path.split(".")
    quoted = "".join('["' + s.replace("\\", "\\\\").replace('"', '\\"').replace("'", "\\'") + '"]' for s in steps)
    return F.expr(f"try_variant_get({v}, '${quoted}', 'variant')")


def state(x: Column) -> Column:
    """The state of a variant value; null means that the field is missing."""
    kind = F.schema_of_variant(x)
    text = F.to_json(x)
    return (
        F.when(x.isNull(), MISSING)
        .when(F.is_variant_null(x), NULL)
        .when((kind == "BOOLEAN") & (text == "false"), FALSE)
        .when((kind == "BOOLEAN") & (text == "true"), TRUE)
        .when(text == "[]", EMPTY_ARRAY)
        .when(text == "{}", EMPTY_OBJECT)
        .when(text == '""', EMPTY_TEXT)
        .otherwise(SET)
    )


def observe(targets: DataFrame, fields: tuple[str, ...], v: str = "v", order: tuple[str, ...] = ("ref",), literal: bool = False) -> DataFrame:
    """``targets`` exploded to a row for each field: field, value (JSON, null if missing), state, countable."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), field(v, f, literal).alias("x")) for f in fields])
    rows = targets.withColumn("__f", F.explode(each)).withColumn("field", F.col("__f.field")).withColumn("__x", F.col("__f.x"))
    return _observed(rows.drop("__f"), "__x")


def _observed(rows: DataFrame, x: str) -> DataFrame:
    """``rows`` with state, value and countable in place of the variant column ``x``."""
    kind = F.schema_of_variant(F.col(x))
    return rows.withColumn("state", state(F.col(x))).withColumn("value", F.to_json(x)).withColumn("countable", F.coalesce(kind.isin("STRING", "BIGINT", "BOOLEAN"), F.lit(False))).drop(x)


def field_states(observed: DataFrame, keys: tuple[str, ...] = ("doc_id", "field")) -> DataFrame:
    """Rows keys, state, n: combined before the shuffle."""
    return observed.groupBy(*keys, "state").agg(F.count("*").alias("n"))


#: Parts that a key's values are ranked in before the best of all parts meet.
PARTS = 16


def field_inventory(observed: DataFrame, keys: tuple[str, ...] = ("doc_id", "field"), order: str = "seq", examples: bool = True) -> DataFrame:
    """keys, targets, states (map), value_counts (the most frequent values, first seen first among equals), examples if asked for.

    States and values come from one pass: values are counted, combined before the shuffle, and ranked in PARTS parts of each key, whose best meet.
    Examples are a second pass, as they need the order of the rows."""
    value = F.when(F.col("countable"), F.col("value"))
    counted = observed.groupBy(*keys, "state", "countable", value.alias("value")).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    best = Window.partitionBy(*keys, "__part").orderBy(F.desc("countable"), F.desc("n"), "first", "value")
    ranked = counted.withColumn("__part", F.pmod(F.xxhash64("value"), F.lit(PARTS))).withColumn("r", F.row_number().over(best))
    of_state = {s: f"__n{i}" for i, s in enumerate(sorted((MISSING, NULL, FALSE, TRUE, EMPTY_ARRAY, EMPTY_OBJECT, EMPTY_TEXT, SET)))}
    held = F.when(F.col("countable") & (F.col("r") <= MOST_VALUES), F.struct((-F.col("n")).alias("rank"), "first", "value", "n"))
    parts = ranked.groupBy(*keys, "__part").agg(*[F.sum(F.when(F.col("state") == s, F.col("n"))).alias(c) for s, c in of_state.items()], F.collect_list(held).alias("best"))
    whole = parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in of_state.values()], F.flatten(F.collect_list("best")).alias("best"))
    states = F.filter(F.array(*[F.struct(F.lit(s).alias("state"), F.col(c).alias("n")) for s, c in of_state.items()]), lambda x: x["n"].isNotNull())
    values = F.transform(F.slice(F.array_sort("best"), 1, MOST_VALUES), lambda x: F.struct(x["value"], x["n"]))
    out = whole.select(*keys, F.aggregate(states, F.lit(0).cast("bigint"), lambda a, x: a + x["n"]).alias("targets"), F.map_from_entries(states).alias("states"), F.when(F.size("best") > 0, values).alias("value_counts"))
    if not examples:
        return out
    turn = Window.partitionBy(*keys).orderBy(order)
    shown = observed.where(F.col("state") != MISSING).withColumn("r", F.row_number().over(turn)).where(F.col("r") <= MOST_EXAMPLES).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", F.col("ref"), "value"))), lambda x: F.struct(x["ref"], x["value"])).alias("examples"))
    return out.join(shown, list(keys), "left")


def provided(observed: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, provided: whether any field is there in any target."""
    return observed.groupBy(*keys).agg(F.bool_or(F.col("state") != MISSING).alias("provided"))


#: What a target is, and of which collections.
TARGETS = {
    "document": ("document", ("document",)),
    "elements": ("item", ELEMENTS),
    "groups_and_elements": ("item", ("groups", *ELEMENTS)),
    "texts": ("item", ("texts",)),
    "headings": ("item", ("texts",)),
    "tables": ("item", ("tables",)),
    "resources": ("item", ("pictures", "tables")),
    "cells": ("cell", ("tables",)),
    "provenance": ("prov", ELEMENTS),
}


def _targets(docs: DataFrame) -> DataFrame:
    """(doc_id, sort, kind, idx, ref, seq, v): documents, their items, and the cells and places in items, from one pass."""
    lists = F.array(F.struct(F.lit("document").alias("kind"), F.array("v").alias("xs")), *[F.struct(F.lit(k).alias("kind"), F.variant_get("v", f"$.{k}", "array<variant>").alias("xs")) for k in KINDS])
    its = docs.select("doc_id", F.explode(lists).alias("c")).select("doc_id", F.col("c.kind").alias("kind"), F.posexplode("c.xs").alias("idx", "v"))
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, ELEMENTS)), F.col("kind")), F.lit(0)).cast("int")
    ref = F.when(F.col("kind") == "document", "#").otherwise(F.concat(F.lit("#/"), "kind", F.lit("/"), F.col("idx").cast("string")))
    inside = lambda path, sort, name: F.transform(F.expr(f"try_variant_get(v, '$.{path}', 'array<variant>')"), lambda x, i: F.struct(F.lit(sort).alias("sort"), i.alias("i"), F.concat(F.lit(f"/{name}/"), i.cast("string")).alias("more"), x.alias("x")))
    own = F.array(F.struct(F.when(F.col("kind") == "document", "document").otherwise("item").alias("sort"), F.lit(0).alias("i"), F.lit("").alias("more"), F.col("v").alias("x")))
    none = F.array().cast("array<struct<sort:string,i:int,more:string,x:variant>>")
    cells = F.when(F.col("kind") == "tables", inside("data.table_cells", "cell", "data/table_cells"))
    places = F.when(F.col("kind").isin(*ELEMENTS), inside("prov", "prov", "prov"))
    each = its.select("doc_id", "kind", "idx", rank.alias("rank"), ref.alias("ref"), F.explode(F.concat(own, F.coalesce(cells, none), F.coalesce(places, none))).alias("t"))
    return each.select("doc_id", "t.sort", "kind", "idx", F.concat("ref", "t.more").alias("ref"), F.struct(F.col("rank").alias("c0"), F.col("idx").alias("c1"), F.col("t.i").alias("c2")).alias("seq"), F.col("t.x").alias("v"))


def tree_features(raw: DataFrame, doc_id: str = "doc_id", text: str = "raw") -> DataFrame:
    """(doc_id, category, decides, kind, idx, ref, seq, field, state, value, countable): every field of every category, observed in one pass.

    field_inventory() with the keys (doc_id, category, field) and provided() with (doc_id, category) where ``decides`` sum it up."""
    targets = _targets(documents(raw, doc_id, text))
    heading = F.expr("coalesce(try_variant_get(v, '$.label', 'string') in ('title', 'section_header'), false)")
    each = []
    for listed, decides in ((CATEGORIES, True), (MORE, False)):
        for category, (name, fields) in listed.items():
            sort, kinds = TARGETS[name]
            is_one = (F.col("sort") == sort) & F.col("kind").isin(*kinds)
            one = lambda f: F.struct(F.lit(category).alias("category"), F.lit(decides).alias("decides"), F.lit(f).alias("field"), field("v", f).alias("x"))
            each.append(F.when(is_one & heading if name == "headings" else is_one, F.array(*map(one, fields))))
    none = F.array().cast("array<struct<category:string,decides:boolean,field:string,x:variant>>")
    rows = targets.select("doc_id", "kind", "idx", "ref", "seq", F.explode(F.concat(*[F.coalesce(x, none) for x in each])).alias("f")).select("doc_id", "f.category", "f.decides", "kind", "idx", "ref", "seq", "f.field", "f.x")
    return _observed(rows, "x")


def resources(raw: DataFrame, doc_id: str = "doc_id", text: str = "raw") -> DataFrame:
    """(doc_id, idx, v, content): the resources of recursive results; idx 0 is the root.  Literal keys may hold dots."""
    rows = raw.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.expr(f"try_variant_get(try_parse_json({text}), '$', 'array<variant>')")).alias("idx", "v"))
    content = F.coalesce(*[F.expr(f"try_variant_get(v, '$[\"{k}\"]', 'string')") for k in CONTENT_KEYS], F.lit(""))
    return rows.withColumn("content", content).withColumn("ref", F.concat(F.lit("resource-"), F.col("idx").cast("string")))


def resource_metadata(res: DataFrame) -> DataFrame:
    """(doc_id, idx, key, value, about_pages): all keys but those of the content."""
    pairs = F.expr("try_variant_get(v, '$', 'map<string,variant>')")
    rows = res.select("doc_id", "idx", F.explode(pairs).alias("key", "x"))
    return rows.where(~F.col("key").isin(*CONTENT_KEYS)).select("doc_id", "idx", "key", F.to_json("x").alias("value"), F.lower("key").contains("page").alias("about_pages"))


def resource_features(res: DataFrame, blocks: DataFrame, tags: DataFrame) -> DataFrame:
    """(doc_id, category, provided) of recursive results: a category is there if any resource has it.

    ``blocks`` and ``tags`` are markup_blocks() and html_tags() of the contents, with the id of the document."""
    has = lambda rows, category, cond: rows.groupBy("doc_id").agg(F.bool_or(cond).alias("provided")).withColumn("category", F.lit(category))
    kind, tag = F.col("kind"), F.col("tag")
    out = has(blocks, "classification", kind != "unknown").unionByName(has(blocks, "headings", kind == "heading")).unionByName(has(blocks, "tables", kind == "table"))
    out = out.unionByName(has(tags, "formatting", tag.isin("strong", "b", "em", "i", "u"))).unionByName(has(tags, "hierarchy", tag.isin("ul", "ol", "blockquote")))
    inner = observe(res.where("idx > 0"), RESOURCE_LINKS, literal=True)
    out = out.unionByName(has(inner.withColumn("kind", F.lit("")), "hierarchy", F.col("state") != MISSING))
    inner = observe(res.where("idx > 0"), RESOURCE_FIELDS, literal=True)
    out = out.unionByName(has(inner, "resources", F.col("state") != MISSING))
    meta = resource_metadata(res).where("idx = 0")
    out = out.unionByName(has(meta, "metadata", F.lit(True)))
    return out.groupBy("doc_id", "category").agg(F.bool_or("provided").alias("provided"))


def readable(results: DataFrame, raw: str = "raw", markdown: str = "markdown") -> tuple[DataFrame, DataFrame]:
    """Results whose raw JSON parses, and the others with ``warning`` where their Markdown stands in: its inventory is what is
    known of them, and no field of theirs counts as missing."""
    parsed = F.try_parse_json(F.col(raw)).isNotNull()
    warning = F.when(F.col(raw).isNull(), "raw JSON is not there").otherwise("raw JSON cannot be read")
    rest = results.where(~F.coalesce(parsed, F.lit(False))).withColumn("warning", F.concat(warning, F.when(F.col(markdown).isNull(), "; no Markdown either").otherwise("; shown from Markdown")))
    return results.where(parsed), rest
