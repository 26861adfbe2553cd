"""Personal data: base patterns, then information-theoretic sanitisation.

With DataFrame and SQL functions alone.  Base entities are e-mail addresses, IPv4 addresses, card numbers
and phone numbers.  A term (a word of letters) discloses an entity as far as seeing it tells that
the entity is there too: over documents, PMI(e; t) = ln(n(e,t) n / (n(e) n(t))), at most the entity's own
information IC(e) = ln(n / n(e)).  Candidates are all words of the documents that hold the entity, outside of
base entities, in ``min_texts`` different texts, so that copies of one text prove nothing.  Terms with PMI >= ``threshold`` x IC
are spans too, wherever they stand in a document that holds the entity: they are generalised to
``[TERM]`` or removed with the base entities.  In documents without it they stay: there most of them stand by chance, and
their number grows with nearly the square of the corpus.

Counts cover all documents.  Words are combined before the shuffle; per-entity aggregates are too, and what is joined on an
entity are ids, never texts or their words, so an entity of a third of all rows is no hot task.  Texts are read twice (spans, then
term counts); only documents with an entity are written between.

Defined cases: null texts are empty; repeated rows give one row each; a text of digits only or of one
endless word costs linear time (possessive patterns, no start inside a run that failed).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = "A-Za-z0-9._%+-"
#: Linear-time forms of the base patterns; what follows the last match may start a new one (\G).
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


#: A span: code points, end exclusive; the words around it.
SPANS = "array<struct<kind:string,start:bigint,end:bigint,value:string,context:string>>"


def _located(text: str, pattern: str, kind: str, holds: str = "true", near: int = 0) -> str:
    """SQL for array<SPAN> of a pattern's matches for which ``holds``; positions in code points.

    Matches and the gaps between them alternate; a fold adds up their lengths.  It goes over 1,000 at a time, as each step
    copies the array that it adds to.  ``context`` is up to ``near`` characters of the gaps on both sides, in whole words."""
    before = f"if(length(x.g) > {near}, regexp_replace(substring(x.g, -{near}, {near}), r'^\\S*', ''), x.g)"
    after = f"if(length(x.n) > {near}, regexp_replace(substring(x.n, 1, {near}), r'\\S*$', ''), x.n)"
    context = f"lower(concat({before}, ' ', {after}))" if near else "''"
    pairs = f"element_at(transform(array(split({text}, {pattern}, -1)), p -> transform(regexp_extract_all({text}, {pattern}, 0), (m, i) -> named_struct('m', m, 'g', get(p, i), 'n', get(p, i + 1)))), 1)"
    chunks = f"element_at(transform(array({pairs}), z -> if(size(z) = 0, array(z), transform(sequence(0, (size(z) - 1) div 1000), c -> slice(z, c * 1000 + 1, 1000)))), 1)"
    span = f"named_struct('kind', '{kind}', 'start', s.at + length(x.g), 'end', s.at + length(x.g) + length(x.m), 'value', x.m, 'context', {context})"
    step = f"(s, x) -> named_struct('at', s.at + length(x.g) + length(x.m), 'out', if({holds}, concat(s.out, array({span})), s.out))"
    inner = f"aggregate(chunk, named_struct('at', t.at, 'out', cast(array() as {SPANS})), {step})"
    return f"""aggregate({chunks}, named_struct('at', 0L, 'outs', cast(array() as array<{SPANS}>)),
        (t, chunk) -> element_at(transform(array({inner}), r -> named_struct('at', r.at, 'outs', concat(t.outs, array(r.out)))), 1),
        t -> flatten(t.outs))"""


def _literal(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\'") + "'"


def base_spans(text: str = "text", near: int = 60) -> F.Column:
    """array<SPAN> of the base entities, in the order of KINDS."""
    digits = "regexp_replace(x.m, '[^0-9]', '')"
    doubled = "array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9)"
    luhn = f"""aggregate(sequence(1, length({digits})), 0, (n, i) -> n + element_at(if(i % 2 = 1, array(0, 1, 2, 3, 4, 5, 6, 7, 8, 9), {doubled}), cast(substring(reverse({digits}), i, 1) as int) + 1)) % 10 = 0"""
    holds = {
        "email": "true",
        "ip": rf"x.m rlike r'^{_OCTET}(?:\.{_OCTET}){{3}}$'",
        "card": f"case when length({digits}) between 14 and 19 then {luhn} else false end",
        "phone": f"length({digits}) between 10 and 15",
    }
    parts = []
    for k in KINDS[:4]:
        # One pass with a plain search first: most texts hold none.
        needs = f"contains({text}, '{_NEEDS[k]}') and " if _NEEDS[k] else ""
        least = {"email": "@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?+[0-9]){13}", "phone": r"\+[0-9]"}[k]
        parts.append(f"if({needs}{text} rlike {_literal(least)}, {_located(text, _literal(PATTERNS[k]), k, holds[k], near)}, cast(array() as {SPANS}))")
    return F.expr(f"concat({', '.join(parts)})")


def _joined(spans: str, kinds: tuple[str, ...]) -> str:
    """kind:start:end by start, then kind as listed; comma-joined."""
    order = " ".join(f"when '{k}' then {i}" for i, k in enumerate(kinds))
    rows = f"array_sort(transform(filter({spans}, x -> x.kind in ({', '.join(repr(k) for k in kinds)})), x -> named_struct('start', x.start, 'o', case x.kind {order} end, 'kind', x.kind, 'end', x.end)))"
    return f"array_join(transform({rows}, x -> concat(x.kind, ':', cast(x.start as string), ':', cast(x.end as string))), ',')"


def find_personal_data(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_texts: int = 3, threshold: float = 0.8) -> DataFrame:
    """doc_id, text (null where there is no span), spans (array of kind, start, end, value): a row for
    each row of ``docs``."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = rows.withColumn("spans", base_spans("text", 0))
    found = materialize(found.select("doc_id", F.xxhash64("text").alias("copy"), F.when(F.size("spans") > 0, F.col("text")).alias("text"), "spans"), "personal")
    holders = found.where("text is not null")
    entities = F.array_distinct(F.transform("spans", lambda s: F.concat(s["kind"], F.lit(":"), F.lower(s["value"]))))
    words = lambda c: F.array_distinct(F.split(F.lower(c), r"[^\p{L}]+"))
    held = holders.select("doc_id", "copy", F.explode(entities).alias("entity"))
    # An entity of fewer texts has no candidate.
    n_entity = held.groupBy("entity", "copy").agg(F.count("*").alias("n")).groupBy("entity").agg(F.sum("n").alias("n_e"), F.count("*").alias("texts"))
    n_entity = materialize(n_entity.where(F.col("texts") >= min_texts).select("entity", "n_e"), "entities")
    # Documents with both: words count wherever they stand, and are candidates where one stands outside of base entities.
    # Ids alone meet the entities; a document gets the list of those that count.
    lists = held.join(n_entity.select("entity"), "entity", "left_semi").groupBy("doc_id", "copy").agg(F.collect_set("entity").alias("entities"))
    lists = lists.select(F.col("doc_id").alias("d"), F.col("copy").alias("c"), "entities")
    own = _replaced(holders, "' '").select("doc_id", "copy", words("text").alias("w"), words("clean").alias("free"))
    marked = F.expr("concat(transform(w, x -> named_struct('term', x, 'here', 1)), transform(free, x -> named_struct('term', x, 'here', 0)))")
    both = own.join(lists, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("copy") == F.col("c"))).select("copy", marked.alias("m"), F.explode("entities").alias("entity"))
    both = both.select("entity", "copy", F.explode("m").alias("m")).select("entity", "copy", "m.term", "m.here").where("term <> ''")
    both = both.groupBy("entity", "term", "copy").agg(F.sum("here").alias("n"), F.min("here").alias("least")).groupBy("entity", "term")
    pairs = both.agg(F.sum("n").alias("n_et"), F.sum(1 - F.col("least")).alias("texts")).where(F.col("texts") >= min_texts)
    pairs = materialize(pairs.select("entity", "term", "n_et"), "pairs")
    n = float(max(rows.count(), 1))
    ic = F.log(F.lit(n) / F.col("n_e"))
    # Documents with an entity alone give a lower bound of n(t): terms too common by that need no count.
    count = lambda each, name: each.groupBy("term").agg(F.count("*").alias(name))  # words are counted before they meet any list
    terms_here = count(own.select(F.explode("w").alias("term")), "n_h").join(pairs.select("term").distinct(), "term")
    likely = pairs.join(n_entity, "entity").join(terms_here, "term").where((ic > 0) & (F.log(F.col("n_et") * n / (F.col("n_e") * F.col("n_h"))) >= threshold * ic))
    likely = materialize(likely.select("entity", "term", "n_et", "n_e"), "likely-terms")
    n_term = count(rows.select(F.explode(words("text")).alias("term")), "n_t").join(likely.select("term").distinct(), "term")
    pmi = F.log(F.col("n_et") * n / (F.col("n_e") * F.col("n_t")))
    telling = likely.join(n_term, "term").where(pmi >= threshold * ic).groupBy("entity").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    per_row = held.join(telling, "entity").groupBy("doc_id", "copy").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("terms")))).alias("terms"))
    per_row = per_row.select(F.col("doc_id").alias("d"), F.col("copy").alias("c"), "terms")
    joined = holders.join(per_row, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("copy") == F.col("c")), "left")
    pattern = "concat(r'(?iu)(?<!\\p{L})(?:', array_join(terms, '|'), r')(?!\\p{L})')"
    terms = f"if(terms is null, spans, concat(spans, {_located('text', pattern, 'term')}))"
    with_terms = joined.select("doc_id", "text", F.expr(terms).alias("spans"))
    out = with_terms.unionByName(found.where("text is null").drop("copy"))
    return out.withColumn("spans", F.transform("spans", lambda s: F.struct(*[s[c].alias(c) for c in ("kind", "start", "end", "value")])))


def report(found: DataFrame) -> DataFrame:
    """Counts and places of what find_personal_data() has found."""
    counts = [F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts[:4], F.sha2(F.expr(_joined("spans", KINDS[:4])), 256).alias("base_sha256"), F.expr(_joined("spans", KINDS)).alias("spans"), counts[4])


def sanitise(found: DataFrame, *, mode: str = "generalise") -> DataFrame:
    """``found`` with the column ``clean``: each span gives way to its kind in brackets or, with
    ``mode="remove"``, to nothing; a span inside an earlier one goes with it.

    Spans are taken 1,000 at a time, each time from what is left of the text, so that long texts are not walked through
    from their start for every span."""
    return _replaced(found, "concat('[', upper(x.kind), ']')" if mode == "generalise" else "''")


def _replaced(found: DataFrame, label: str) -> DataFrame:
    ordered = "array_sort(transform(spans, x -> named_struct('start', x.start, 'minus_end', -x.end, 'kind', x.kind)))"
    chunks = f"element_at(transform(array({ordered}), z -> if(size(z) = 0, array(z), transform(sequence(0, (size(z) - 1) div 1000), c -> slice(z, c * 1000 + 1, 1000)))), 1)"
    end = "greatest(t.at, coalesce(array_max(transform(chunk, x -> -x.minus_end)), t.at))"
    inner = f"""aggregate(chunk, named_struct('at', t.at, 'out', ''),
        (s, x) -> if(x.start < s.at, named_struct('at', greatest(s.at, -x.minus_end), 'out', s.out),
            named_struct('at', -x.minus_end, 'out', concat(s.out, substring(part, int(s.at - t.at) + 1, int(x.start - s.at)), {label}))),
        s -> s.out)"""
    fold = f"""aggregate({chunks}, named_struct('at', 0L, 'rest', text, 'outs', cast(array() as array<string>)),
        (t, chunk) -> element_at(transform(array({end}), e -> named_struct('at', e, 'rest', substring(t.rest, int(e - t.at) + 1),
            'outs', concat(t.outs, transform(array(substring(t.rest, 1, int(e - t.at))), part -> {inner})))), 1),
        t -> concat(array_join(t.outs, ''), t.rest))"""
    return found.withColumn("clean", F.when(F.col("text").isNotNull(), F.expr(fold)))
