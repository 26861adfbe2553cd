"""Card bundles: validation as one boolean for each rule, and merging.

A bundle is one JSON text.  It is rejected as a whole by the first rule that one of its cards breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

# Bounds and names of the card format.
KINDS = ("headings", "lists", "formatting", "tables", "pictures", "furniture", "location", "other")
TEXT_FIELDS = ("id", "document_id", "document_sha256", "title", "kind", "reason", "source_location", "note")
FORMATS = ("json", "markdown", "text")
COLLECTIONS = ("texts", "groups", "tables", "pictures", "key_value_items", "form_items", "items")
MOST_CARDS = 200
MOST_BYTES = 20 * 1024 * 1024
MOST_CHARS = 2_000_000


def _get(v: str, path: str) -> str:
    return f"try_variant_get({v}, '$.{path}', 'variant')"


def _is(x: str, kind: str) -> str:
    return f"coalesce(schema_of_variant({x}) like '{kind}%', false)"


def bundles(raw: DataFrame, bundle: str = "bundle", text: str = "text", schema: str = "quillon.cards") -> DataFrame:
    """(bundle, v, problem): what is wrong with a bundle apart from its cards."""
    v = raw.select(F.col(bundle).alias("bundle"), F.col(text).alias("text"), F.try_parse_json(F.col(text)).alias("v"))
    cards = _get("v", "cards")
    problem = (
        F.when(F.octet_length("text") > MOST_BYTES, "too large")
        .when(F.col("v").isNull() | ~F.expr(_is("v", "OBJECT")), "not an object")
        .when(F.coalesce(F.expr("try_variant_get(v, '$.schema', 'string')"), F.lit("")) != schema, "schema")
        .when(~F.expr(_is(_get("v", "version"), "BIGINT")) | (F.expr("to_json(try_variant_get(v, '$.version', 'variant'))") != "1"), "version")
        .when(~F.expr(_is(cards, "ARRAY")), "no array of cards")
        .when(F.expr("size(try_variant_get(v, '$.cards', 'array<variant>'))") > MOST_CARDS, "too many cards")
    )
    return v.select("bundle", "v", problem.alias("problem"))


def cards(good: DataFrame) -> DataFrame:
    """(bundle, pos, c, id, document_id, document_sha256, kind) of bundles' cards."""
    rows = good.select("bundle", F.posexplode(F.expr("try_variant_get(v, '$.cards', 'array<variant>')")).alias("pos", "c"))
    return rows.select("bundle", "pos", "c", *[F.expr(f"try_variant_get(c, '$.{n}', 'string')").alias(n) for n in ("id", "document_id", "document_sha256", "kind")])


def _evidence_problem(tool: str, recursive: bool) -> Column:
    e = _get("c", tool)
    content = f"try_variant_get(c, '$.{tool}.content', 'string')"
    # In brackets, so that what follows the value breaks it; one value exactly.
    listed = f"try_variant_get(try_parse_json(concat('[', {content}, ']')), '$', 'array<variant>')"
    parsed = f"if(size({listed}) = 1, get({listed}, 0), null)"
    refs = f"try_variant_get(c, '$.{tool}.source_refs', 'array<variant>')"
    given = F.expr(f"{e} is not null and not is_variant_null({e})")
    objects = lambda x: f"({_is(x, 'ARRAY')} and forall(coalesce(try_variant_get({x}, '$', 'array<variant>'), array()), i -> {_is('i', 'OBJECT')}))"
    if recursive:
        texts = " and ".join(f"(try_variant_get(i, '$[\"{k}\"]', 'variant') is null or {_is(f'try_variant_get(i, {chr(39)}$[{chr(34)}{k}{chr(34)}]{chr(39)}, {chr(39)}variant{chr(39)})', 'STRING')})" for k in ("tk:content", "X-TIKA:content"))
        shape = f"({_is(parsed, 'OBJECT')} or {objects(parsed)}) and forall(coalesce(if({_is(parsed, 'ARRAY')}, try_variant_get({parsed}, '$', 'array<variant>'), array({parsed})), array()), i -> {texts})"
    else:
        doc = f"coalesce(if({_is(parsed, 'OBJECT')}, {_get(parsed, 'document')}, null), {parsed})"
        lists = " and ".join(f"({_get(doc, k)} is null or {objects(_get(doc, k))})" for k in COLLECTIONS)
        shape = f"(({_is(doc, 'OBJECT')} and {lists}) or {objects(doc)})"
    run = _get("c", f"{tool}.run")
    known = f"exists(coalesce(runs_{tool}, array()), r -> cast(r as string) = to_json({run}))"
    return F.when(given, (
        F.when(~F.expr(_is(e, "OBJECT")) | ~F.coalesce(F.expr(f"{_is(_get('c', tool + '.format'), 'STRING')} and try_variant_get(c, '$.{tool}.format', 'string') in {FORMATS}"), F.lit(False)), f"{tool} format")
        .when(~F.expr(_is(_get("c", f"{tool}.content"), "STRING")) | (strip(F.expr(content)) == "") | (F.length(F.expr(content)) > MOST_CHARS), f"{tool} content")
        .when(~F.expr(_is(_get("c", f"{tool}.source_file"), "STRING")) | ~F.expr(f"coalesce(forall({refs}, r -> {_is('r', 'STRING')}), false)"), f"{tool} source")
        .when(F.expr(f"{run} is not null and not is_variant_null({run}) and (not {_is(run, 'BIGINT')} or not {known})"), f"{tool} run")
        .when(F.expr(f"try_variant_get(c, '$.{tool}.format', 'string') = 'json' and ({parsed} is null or not ({shape}))"), f"{tool} json")
    ))


def validate(raw: DataFrame, documents: DataFrame, tools: tuple[str, str], *, bundle: str = "bundle", text: str = "text", schema: str = "quillon.cards") -> DataFrame:
    """(bundle, n_cards, problem): problem is null for a bundle that is accepted.

    ``documents`` (id, sha256, runs_<tool> array<int> for both tools); the first tool's JSON is tree-shaped, the second's
    recursive.  The problem is that of the first card in order that has one."""
    found = bundles(raw, bundle, text, schema)
    rows = cards(found.where("problem is null")).join(documents.select(F.col("id").alias("__id"), F.col("sha256").alias("__sha"), *[f"runs_{t}" for t in tools]), F.col("document_id") == F.col("__id"), "left")
    again = F.row_number().over(Window.partitionBy("bundle", "id").orderBy("pos")) > 1
    rows = rows.withColumn("again", again)
    checked = F.expr(_get("c", "original_checked"))
    none = " and ".join(f"({_get('c', t)} is null or is_variant_null({_get('c', t)}))" for t in tools)
    problem = (
        F.when(~F.expr(_is("c", "OBJECT")), "not an object")
        .when(F.expr(" or ".join(f"not {_is(_get('c', n), 'STRING')}" for n in TEXT_FIELDS)), "a text field is missing")
        .when((strip(F.col("id")) == "") | (strip(F.expr("try_variant_get(c, '$.title', 'string')")) == "") | ~F.col("kind").isin(*KINDS), "id, title or kind")
        .when(F.col("again"), "repeated id")
        .when(F.col("__id").isNull() | (F.col("document_sha256") != F.coalesce("__sha", F.lit(""))), "unknown document")
        .when(checked.isNotNull() & ~F.is_variant_null(checked) & ~F.expr(_is(_get("c", "original_checked"), "BOOLEAN")), "original_checked")
        .when(F.expr(none), "no evidence")
    )
    problem = F.coalesce(problem, _evidence_problem(tools[0], False), _evidence_problem(tools[1], True))
    first = rows.select("bundle", "pos", problem.alias("p")).groupBy("bundle").agg(F.count("*").alias("n_cards"), F.min(F.when(F.col("p").isNotNull(), F.struct("pos", "p")))["p"].alias("p"))
    return found.join(first, "bundle", "left").select("bundle", F.coalesce("n_cards", F.lit(0)).cast("bigint").alias("n_cards"), F.coalesce("problem", "p").alias("problem"))


def merge(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """``existing`` with ``incoming`` (id, json), or an error: no more than MOST_CARDS, no id twice, no more than MOST_BYTES.  The
    checks are one aggregate; nothing is merged in part."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    shared = existing.select("id").intersect(incoming.select("id"))
    facts = both.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("json")), F.lit(0)).alias("bytes")).crossJoin(shared.agg(F.count("*").alias("shared"))).first()
    for bad, why in ((facts["n"] > MOST_CARDS, f"more than {MOST_CARDS} cards"), (facts["shared"], "an id is there already"), (facts["bytes"] > MOST_BYTES, "too large")):
        if bad:
            raise ValueError(why)
    return both.drop("__new")
