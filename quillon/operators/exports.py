"""Documents and conversion results as JSON and Markdown, and the settings that tools are run with."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import Rounds
from .references import KINDS, documents, least_paths, unwrap

#: How an image's place is marked, and the parser whose recognition of text is left out for office files.
IMAGE_MARK = "<!-- image -->"
OCR_PARSER = "tesseract-ocr-parser"

FORMATS = ("json", "markdown")


def export_document(raw: DataFrame, output_format: str, doc_id: str = "doc_id", text: str = "raw") -> DataFrame:
    """(doc_id, content, problem): each saved document as JSON with its own fields, or as Markdown; another format is an error."""
    if output_format not in FORMATS:
        raise ValueError(f"Unsupported output format: {output_format}")
    docs = documents(raw, doc_id, text).withColumn("problem", F.when(F.col("v").isNull(), "no JSON").when(~F.schema_of_variant("v").like("OBJECT%"), "no object"))
    if output_format == "json":
        return docs.select("doc_id", F.when(F.col("problem").isNull(), F.to_json("v")).alias("content"), "problem")
    return markdown_of(docs)


def export_result(raw: DataFrame, doc_id: str = "doc_id", text: str = "raw") -> DataFrame:
    """(doc_id, metadata, document, problem): a conversion result's own fields, as JSON without the document, and the document."""
    v = F.try_parse_json(F.col(text))
    rows = raw.select(F.col(doc_id).alias("doc_id"), v.alias("v"))
    fields = F.expr("try_variant_get(v, '$', 'map<string,variant>')")
    problem = F.when(F.col("v").isNull(), "no JSON").when(fields.isNull(), "result is no object").when(~F.coalesce(F.schema_of_variant(F.expr("try_variant_get(v, '$.document', 'variant')")).like("OBJECT%"), F.lit(False)), "result has no document")
    rows = rows.withColumn("problem", problem)
    good = F.col("problem").isNull()
    return rows.select("doc_id", F.when(good, F.to_json(F.map_filter(fields, lambda k, _: k != "document"))).alias("metadata"), F.when(good, F.to_json(unwrap(F.col("v")))).alias("document"), "problem")


_CELL = "array<struct<text:string,start_row_offset_idx:int,end_row_offset_idx:int,start_col_offset_idx:int,end_col_offset_idx:int>>"


def table_markdown(tables: DataFrame) -> DataFrame:
    """(doc_id, ref, text): pipe tables of items (doc_id, ref, v), the first row as head; a cell that spans rows or columns stands in each.

    Cells are rows, so a table of any size is grouped by its lines."""
    get = lambda path, kind: F.expr(f"try_variant_get(v, '$.data.{path}', '{kind}')")
    shape = tables.select("doc_id", "ref", get("num_rows", "int").alias("n_rows"), get("num_cols", "int").alias("n_cols"), get("table_cells", _CELL).alias("cells")).where("n_rows > 0 and n_cols > 0")
    grid = shape.select("doc_id", "ref", "n_rows", "n_cols", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("r")).select("doc_id", "ref", "n_rows", "n_cols", "r", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)).alias("c"))
    span = lambda a, b: F.sequence(F.col(f"x.{a}"), F.greatest(F.col(f"x.{a}"), F.coalesce(F.col(f"x.{b}"), F.col(f"x.{a}") + 1) - 1))
    held = shape.select("doc_id", "ref", F.posexplode("cells").alias("at", "x")).where("x.start_row_offset_idx >= 0 and x.start_col_offset_idx >= 0")
    held = held.select("doc_id", "ref", "at", "x", F.explode(span("start_row_offset_idx", "end_row_offset_idx")).alias("r")).select("doc_id", "ref", "at", "x", "r", F.explode(span("start_col_offset_idx", "end_col_offset_idx")).alias("c"))
    inner = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce("x.text", F.lit(""))), r"\|", r"\\|"), r"[\r\n]+", " ")
    one = held.groupBy("doc_id", "ref", "r", "c").agg(F.min_by(inner, "at").alias("text"))
    lines = grid.join(one, ["doc_id", "ref", "r", "c"], "left").groupBy("doc_id", "ref", "r", "n_cols").agg(F.array_sort(F.collect_list(F.struct("c", F.coalesce("text", F.lit("")).alias("text")))).alias("cells"))
    line = F.concat(F.lit("| "), F.array_join(F.transform("cells", lambda x: x["text"]), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.expr("repeat('---|', n_cols)"))
    lines = lines.select("doc_id", "ref", "r", F.when(F.col("r") == 0, F.concat(line, F.lit("\n"), rule)).otherwise(line).alias("line"))
    return lines.groupBy("doc_id", "ref").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))), lambda x: x["line"]), "\n").alias("text"))


def _parts(docs: DataFrame) -> DataFrame:
    """(doc_id, problem, kind, idx, ref, children, captions, head, tail, text, item, v) of documents and their items from one pass: references, the
    Markdown around a text, and ``v`` of tables alone.  A document is a row, too (kind "document"), with its body's children."""
    lists = F.array(F.struct(F.lit("document").alias("kind"), F.array("v").alias("xs")), *[F.struct(F.lit(k).alias("kind"), F.variant_get("v", f"$.{k}", "array<variant>").alias("xs")) for k in KINDS])
    its = docs.select("doc_id", "problem", F.explode(lists).alias("c")).select("doc_id", "problem", F.col("c.kind").alias("kind"), F.posexplode("c.xs").alias("idx", "v"))
    get = lambda path, kind: F.expr(f"try_variant_get(v, '$.{path}', '{kind}')")
    refs = lambda path, one: F.transform(F.coalesce(get(path, "array<variant>"), F.array(get(path, "variant"))) if one else get(path, "array<variant>"), lambda x: F.try_variant_get(x, '$["$ref"]', "string"))
    whole = F.col("kind") == "document"
    text, label = F.coalesce(get("text", "string"), F.lit("")), F.coalesce(get("label", "string"), F.col("kind"))
    mark = F.when(F.coalesce(get("enumerated", "boolean"), F.lit(False)), F.coalesce(F.nullif(get("marker", "string"), F.lit("")), F.lit("1."))).otherwise("-")
    plain = F.col("kind").isin("tables", "pictures") | whole
    head = (
        F.when(plain, "").when(label == "title", "# ").when(label == "section_header", F.concat(F.repeat(F.lit("#"), F.least(F.greatest(F.coalesce(get("level", "int"), F.lit(1)), F.lit(1)), F.lit(5)) + 1), F.lit(" ")))
        .when(label == "list_item", F.concat(mark, F.lit(" "))).when(label == "code", "```\n").otherwise("")
    )
    return its.select(
        "doc_id", "problem", "kind", "idx", F.when(whole, "#").otherwise(F.concat(F.lit("#/"), "kind", F.lit("/"), F.col("idx").cast("string"))).alias("ref"),
        F.when(whole, refs("body.children", False)).otherwise(refs("children", True)).alias("children"), F.when(~whole, refs("captions", True)).alias("captions"),
        head.alias("head"), F.when(~plain & (label == "code"), "\n```").otherwise("").alias("tail"), F.when(~whole, text).alias("text"), (label == "list_item").alias("item"), F.when(F.col("kind") == "tables", F.col("v")).alias("v"),
    )


def markdown_of(docs: DataFrame) -> DataFrame:
    """(doc_id, content, problem): the bodies of ``docs`` (doc_id, v, problem) in reading order as Markdown, null where there is a problem.

    Titles and headings get marks by level, items their marker or a dash, code a fence, tables pipes, pictures a comment; captions come before what
    they belong to, and not where they stand themselves.  Texts are given as they are.  Items of a list follow each other line by line, all else is
    apart by an empty line.  Items without a text are left out; unreached ones are not in the body.

    Results are read once: what all steps need of them is written, references apart from texts."""
    parts = Rounds(docs.sparkSession, "markdown").add(_parts(docs))
    its = parts.where("kind <> 'document'")
    each = lambda rows, name: rows.where(F.size(name) > 0).select("doc_id", F.col("ref").alias("parent"), F.posexplode(name).alias("pos", "child")).where("child is not null")
    roots = each(parts.where("kind = 'document'"), "children")
    order, _ = least_paths(roots.select("doc_id", F.col("child").alias("ref"), F.array(F.col("pos").cast("int")).alias("path")), each(its, "children"))
    captions = each(its, "captions").select("doc_id", F.col("parent").alias("owner"), "pos", F.col("child").alias("ref"))
    caption_texts = captions.join(its.select("doc_id", "ref", "text"), ["doc_id", "ref"]).where("text <> ''")
    said = caption_texts.groupBy("doc_id", F.col("owner").alias("ref")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n\n").alias("caption"))
    # What is known of an item's place, its captions and its table, by its reference, before it meets the texts.
    empty = lambda name: F.lit(None).cast("string").alias(name)
    around = order.select("doc_id", "ref", "path", F.lit(False).alias("is_caption"), empty("caption"), empty("table"))
    around = around.unionByName(captions.select("doc_id", "ref", F.lit(True).alias("is_caption")), True).unionByName(said, True).unionByName(table_markdown(its.where("kind = 'tables'")).withColumnRenamed("text", "table"), True)
    placed = around.groupBy("doc_id", "ref").agg(F.min("path").alias("path"), F.bool_or("is_caption").alias("is_caption"), F.max("caption").alias("caption"), F.max("table").alias("table")).where("path is not null and not coalesce(is_caption, false)")
    rows = its.select("doc_id", "ref", "kind", "head", "tail", "text", "item").join(placed, ["doc_id", "ref"])
    shown = F.when(F.col("kind") == "tables", F.col("table")).when(F.col("kind") == "pictures", F.lit(IMAGE_MARK)).when(F.col("text") != "", F.concat("head", "text", "tail"))
    rows = rows.select("doc_id", "path", "item", F.concat_ws("\n\n", "caption", shown).alias("text")).where("text <> ''")
    inside = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("path", "item", "text"))).alias("xs"))
    gap = lambda x, i: F.when(i == 0, "").when(x["item"] & F.get("xs", i - 1)["item"], "\n").otherwise("\n\n")
    inside = inside.select("doc_id", F.array_join(F.transform("xs", lambda x, i: F.concat(gap(x, i), x["text"])), "").alias("content"))
    return parts.where("kind = 'document'").select("doc_id", "problem").join(inside, "doc_id", "left").select("doc_id", F.when(F.col("problem").isNull(), F.coalesce("content", F.lit(""))).alias("content"), "problem")


# --- settings of tools -----------------------------------------------------------------------------


def config_kind(name: Column) -> Column:
    """Which settings a file is read with: those for PDF, or those for office files."""
    return F.when(F.lower(name).endswith(".pdf"), "pdf").otherwise("office")


def derive_configs(configs: DataFrame, config: str = "config") -> DataFrame:
    """The rows of ``configs`` once for each kind, with kind, derived (JSON) and problem: PDF keeps the settings, for office files the first parser
    entry named OCR_PARSER does not recognise text in images.  Settings without such an entry, or that are no JSON object, have a problem."""
    v = F.try_parse_json(F.col(config))
    rows = configs.withColumn("__all", F.try_variant_get(v, "$", "map<string,variant>")).withColumn("__parsers", F.try_variant_get(v, "$.parsers", "array<map<string,variant>>"))
    yes = F.parse_json(F.lit("true"))
    has = lambda x: F.map_contains_key(x, OCR_PARSER)
    inner = lambda x: F.coalesce(F.try_variant_get(F.element_at(x, OCR_PARSER), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    off = lambda x: F.parse_json(F.to_json(F.map_concat(F.map_filter(inner(x), lambda k, _: k != "skipOcr"), F.create_map(F.lit("skipOcr"), yes))))
    changed = lambda x: F.map_concat(F.map_filter(x, lambda k, _: k != OCR_PARSER), F.create_map(F.lit(OCR_PARSER), off(x)))
    first = F.coalesce(F.array_position(F.transform("__parsers", has), F.lit(True)), F.lit(0))
    parsers = F.transform("__parsers", lambda x, i: F.when(i + 1 == first, changed(x)).otherwise(x))
    office = F.to_json(F.map_concat(F.map_filter("__all", lambda k, _: k != "parsers"), F.create_map(F.lit("parsers"), F.parse_json(F.to_json(parsers)))))
    problem = F.when(F.col("__all").isNull(), "no JSON object").when(first == 0, f"no entry for {OCR_PARSER}")
    rows = rows.withColumn("problem", problem).withColumn("kind", F.explode(F.array(F.lit("pdf"), F.lit("office"))))
    derived = F.when(F.col("problem").isNull(), F.when(F.col("kind") == "pdf", F.to_json("__all")).otherwise(office))
    return rows.withColumn("derived", derived).drop("__all", "__parsers")


def changed_configs(saved: DataFrame, derived: DataFrame) -> DataFrame:
    """(kind, saved, derived) where settings of an earlier run are missing or others, so that it may not be resumed.  Both have kind and config (JSON)."""
    plain = lambda df, name: df.select("kind", F.coalesce(F.to_json(F.try_parse_json("config")), "config").alias(name))
    return plain(derived, "derived").join(plain(saved, "saved"), "kind", "left").where(~F.col("derived").eqNullSafe(F.col("saved"))).select("kind", "saved", "derived")


def option_problem(output: Column, suffix: Column, ocr_pictures: Column, picture_classifier: Column, picture_description: Column) -> Column:
    """What forbids a request's options, null if nothing does."""
    yes, semantic = (lambda c: F.coalesce(c, F.lit(False))), output.isin("semantic-json", "semantic-rules")
    pictures = yes(picture_classifier) | yes(picture_description)
    return F.when(yes(ocr_pictures) & ~output.eqNullSafe(F.lit("semantic-json")), "recognition of text in pictures goes with semantic-json alone").when(pictures & (yes(semantic) | ~F.lower(suffix).eqNullSafe(F.lit(".pdf"))), "classes and descriptions of pictures need PDF and a plain output")


def image_extension(mime: Column) -> Column:
    """The file name extension of an image's type as the standard library knows it, .img otherwise."""
    known = sorted({t for t in mimetypes.types_map.values() if t.startswith("image/")})
    pairs = [F.lit(x) for t in known for x in (t, mimetypes.guess_extension(t))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(F.trim(mime))), F.lit(".img"))
