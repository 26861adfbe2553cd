"""The engine's operators as queries over the driver's tables, each with equivalent SQL where SQL expresses it.

The tables hold no extraction results, so views stand in: ``events`` are runs, ``documents`` of one source are repeated results,
``conversations`` are ordered blocks with levels, ``pages`` are markup, ``events.props`` is nested JSON.  Results with references, notices,
cards and recursive results are made of their rows by column expressions, a result a row, so that every query grows with the tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import canonical, distance, text
from ..operators import cards, chunks, compare, evidence, exports, inventory, markup, outline, references, runs
from . import comparison

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- runs --------------------------------------------------------------------------------------------------

REPEAT = 5


def runs_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    tool = F.when(F.col("event_id") % 2 == 0, "tree").otherwise("recursive")
    status = F.when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "view", "partial_success").otherwise("success")
    order = Window.partitionBy("user_id", tool).orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("doc_id"), tool.alias("tool"), F.row_number().over(order).alias("number"), status.alias("status"), F.col("value").alias("total_seconds"), (F.col("value") / 2).alias("internal_seconds"))


RUNS = """WITH r AS (SELECT user_id AS doc_id, CASE WHEN event_id % 2 = 0 THEN 'tree' ELSE 'recursive' END AS tool,
  CASE event_type WHEN 'error' THEN 'failure' WHEN 'view' THEN 'partial_success' ELSE 'success' END AS status, value AS total_seconds, ts, event_id FROM events),
runs AS (SELECT doc_id, tool, status, total_seconds, row_number() OVER (PARTITION BY doc_id, tool ORDER BY ts, event_id) AS number FROM r)
"""


@query(RUNS + """SELECT tool, round(median(total_seconds), 6) AS median, round(min(total_seconds), 6) AS least, round(max(total_seconds), 6) AS most, count(total_seconds) AS n
FROM runs WHERE status = 'success' GROUP BY tool""")
def run_time_stats(spark, sf_dir):
    s = runs.time_statistics(runs_view(spark, sf_dir), "total_seconds")
    return s.select("tool", *[F.round(c, 6).alias(c) for c in ("median", "least", "most")], "n")


@query(RUNS + f"""SELECT doc_id, tool, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'partial_success') AS partial,
count(*) FILTER (status = 'failure') AS failure, {REPEAT} - count(*) AS not_run FROM runs GROUP BY doc_id, tool""")
def run_status_counts(spark, sf_dir):
    return runs.status_counts(runs_view(spark, sf_dir), REPEAT)


@query(RUNS + f"""SELECT doc_id, tool, CASE WHEN v < 2 THEN 'not comparable (' || v || ' valid)' WHEN k = 1 AND v = {REPEAT} THEN 'all {REPEAT} identical'
WHEN k = 1 THEN v || ' valid identical (planned {REPEAT})' ELSE v || ' valid differ (' || k || ' kinds)' END || CASE WHEN p > 0 THEN ', includes partial' ELSE '' END AS label
FROM (SELECT doc_id, tool, count(*) AS v, count(DISTINCT CAST(floor(total_seconds / 50) AS INT)) AS k, count(*) FILTER (status = 'partial_success') AS p FROM runs WHERE status <> 'failure' GROUP BY doc_id, tool)""")
def run_repeat_labels(spark, sf_dir):
    valid = runs_view(spark, sf_dir).where(F.col("status").isin(*runs.VALID))
    s = valid.groupBy("doc_id", "tool").agg(F.count("*").alias("v"), F.count_distinct(F.floor(F.col("total_seconds") / 50)).alias("k"), F.count_if(F.col("status") == "partial_success").alias("p"))
    return s.select("doc_id", "tool", runs.repeat_label(F.col("v"), F.col("k"), F.col("p"), REPEAT).alias("label"))


@query(RUNS + """SELECT doc_id, tool, number, status FROM runs WHERE status <> 'failure'
QUALIFY row_number() OVER (PARTITION BY doc_id, tool ORDER BY CASE WHEN status = 'success' THEN 0 ELSE 1 END, number) = 1""")
def representative_run(spark, sf_dir):
    return runs.representative(runs_view(spark, sf_dir)).select("doc_id", "tool", F.col("number").cast("bigint").alias("number"), "status")


@query(RUNS + """SELECT doc_id, tool, number, status FROM runs WHERE status <> 'failure' AND number % 2 = 0
QUALIFY row_number() OVER (PARTITION BY doc_id, tool ORDER BY CASE WHEN status = 'success' THEN 0 ELSE 1 END, number) = 1""")
def display_run(spark, sf_dir):
    """Runs of an even number have a snapshot here."""
    all_ = runs_view(spark, sf_dir)
    return runs.display(all_, all_.where("number % 2 = 0")).select("doc_id", "tool", F.col("number").cast("bigint").alias("number"), "status")


_PLAN = f"""d AS (SELECT DISTINCT user_id AS doc_id FROM events), n AS (SELECT doc_id, unnest(range(1, {REPEAT + 1})) AS number FROM d),
plan AS (SELECT doc_id, number, tool, (number - 1) * 2 + CASE WHEN (number % 2 = 1) = (tool = 'recursive') THEN 1 ELSE 2 END AS position FROM n, (VALUES ('recursive'), ('tree')) t(tool))"""


def _plan(spark, sf_dir):
    docs = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id")).distinct()
    return runs.schedule(docs, ("recursive", "tree"), REPEAT)


@query(f"WITH {_PLAN} SELECT doc_id, CAST(number AS BIGINT) AS number, tool, CAST(position AS BIGINT) AS position FROM plan")
def schedule_order(spark, sf_dir):
    return _plan(spark, sf_dir).select("doc_id", F.col("number").cast("bigint").alias("number"), "tool", F.col("position").cast("bigint").alias("position"))


@query(RUNS + f", {_PLAN} SELECT doc_id, tool, CAST(number AS BIGINT) AS number FROM plan p WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = p.doc_id AND r.tool = p.tool AND r.number = p.number AND r.status <> 'failure')")
def pending_runs(spark, sf_dir):
    """Failed runs are due again."""
    return runs.pending(_plan(spark, sf_dir), runs_view(spark, sf_dir).where(F.col("status").isin(*runs.VALID))).select("doc_id", "tool", F.col("number").cast("bigint").alias("number"))


@query(RUNS + "SELECT CAST(max(CASE WHEN status <> 'success' THEN 1 ELSE 0 END) AS INT) AS exit_code FROM runs")
def exit_code(spark, sf_dir):
    return runs.any_failed(runs_view(spark, sf_dir))


@query("""WITH e AS (SELECT event_id, event_type, value FROM events)
SELECT event_id, CASE WHEN value > 90 OR event_id % 7 = 0 THEN 'failure' ELSE lower(event_type) END AS status FROM e""")
def run_status(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", runs.status(F.upper("event_type"), F.col("value") > 90, F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)).alias("status"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type || '; late' WHEN 1 THEN 'late' WHEN 2 THEN event_type ELSE '' END AS details FROM events")
def error_details(spark, sf_dir):
    """Two errors an event: with a message, with another field's where that is empty, or with none."""
    k, said = F.col("event_id") % 4, lambda m, o: F.struct(m.alias("error_message"), o.alias("message"))
    first = said(F.when(k == 0, F.col("event_type")).when(k < 3, ""), F.when(k == 2, F.col("event_type")))
    return table(spark, sf_dir, "events").select("event_id", runs.error_details(F.array(first, said(F.when(k > 1, ""), F.when(k < 2, "late")))).alias("details"))


#: The first five do not say that something happened, the last three do.
_SAID = ["false", "0", "[]", '""', "null", "true", '"x"', "{}"]


@query("SELECT event_id, event_id % 3 < 2 AND (event_id // 3) % 8 >= 5 AS partial FROM events")
def partial_detector(spark, sf_dir):
    k = F.col("event_id")
    key = F.when(k % 3 == 0, F.concat(F.lit("tk:Exception:"), "event_type")).when(k % 3 == 1, "WRITE-LIMIT-REACHED").otherwise("a")
    j = F.concat(F.lit('{"k": 1, "'), key, F.lit('": '), F.get(F.array(*map(F.lit, _SAID)), F.expr("int((event_id div 3) % 8)")), F.lit("}"))
    e = table(spark, sf_dir, "events").select("event_id", F.try_parse_json(j).alias("v"))
    return e.select("event_id", runs.reports_partial(F.expr("try_variant_get(v, '$', 'map<string,variant>')")).alias("partial"))


@query("SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN round(value + value / 2, 6) END AS of_times, CAST(event_id * 37 AS DOUBLE) / 1000 AS of_millis FROM events")
def internal_seconds(spark, sf_dir):
    times = F.when(F.col("event_id") % 5 != 0, F.array(F.col("value"), F.col("value") / 2)).otherwise(F.array().cast("array<double>"))
    return table(spark, sf_dir, "events").select("event_id", F.round(runs.internal_seconds_of_times(times), 6).alias("of_times"), runs.internal_seconds_of_millis(F.col("event_id") * 37).alias("of_millis"))


@query("""WITH e AS (SELECT CAST(doc_id AS VARCHAR) AS name, sha256(text) AS v FROM documents WHERE doc_id % 7 <> 0), a AS (SELECT CAST(doc_id AS VARCHAR) AS name, sha256(text || CASE WHEN doc_id % 11 = 0 THEN 'x' ELSE '' END) AS v FROM documents WHERE doc_id % 5 <> 0)
SELECT name, e.v AS expected, a.v AS actual FROM e FULL JOIN a USING (name) WHERE e.v IS DISTINCT FROM a.v""")
def resume_guard(spark, sf_dir):
    """Fingerprints of documents: some there on one side alone, some changed."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("name"), "text")
    value = lambda t: F.sha2(t, 256).alias("value")
    changed = F.concat("text", F.when(F.col("doc_id") % 11 == 0, "x").otherwise(""))
    return runs.resume_mismatches(d.where("doc_id % 7 <> 0").select("name", value(F.col("text"))), d.where("doc_id % 5 <> 0").select("name", value(changed)))


@query("SELECT event_id, event_id % 4 = 2 AND event_id % 5 <> 0 AS same FROM events")
def ocr_settings(spark, sf_dir):
    """The second languages are the first ones turned round at even ids; every fifth mode differs; skipped or not told at others."""
    k, kind = F.col("event_id"), F.col("event_type")
    side = lambda language, mode: {"command": F.lit("t"), "path": F.lit("/d"), "language": language, "mode": mode, "skip": F.when(k % 4 == 1, True).when(k % 4 > 1, False)}
    first = side(F.concat(kind, F.lit("+kor")), (k % 3).cast("string"))
    second = side(F.when(k % 2 == 0, F.concat(F.lit("kor+"), kind)).otherwise(F.concat(kind, F.lit("+eng"))), F.when(k % 5 == 0, 9).otherwise((k % 3).cast("int")))
    return table(spark, sf_dir, "events").select("event_id", runs.same_ocr(first, second).alias("same"))


# --- comparison ----------------------------------------------------------------------------------------------

def snapshots_view(spark, sf_dir, *more):
    return table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("number"), "text", *more)


@query("SELECT source, count(*) AS n, count(DISTINCT sha256(text)) AS unique_content, CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS pairs, (SELECT count(*) FROM documents a JOIN documents b ON a.source = b.source AND a.doc_id < b.doc_id AND a.text = b.text WHERE a.source = d.source) AS equal_pairs FROM documents d GROUP BY source")
def content_stability(spark, sf_dir):
    hashed = snapshots_view(spark, sf_dir).select("source", F.sha2("text", 256).alias("content"))
    return compare.stability(hashed, "content", ("source",))


@query("SELECT sha256(text) AS content, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def content_hash_groups(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("content")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


#: Documents of so many neighbouring ids stand for one document's repeated results.
SET = 5


def sets_view(spark, sf_dir, *more):
    return table(spark, sf_dir, "documents").select(F.expr(f"doc_id div {SET}").alias("repeat_set"), F.col("doc_id").alias("number"), *more)


@query(f"""WITH d AS (SELECT doc_id // {SET} AS repeat_set, doc_id, text FROM documents)
SELECT a.repeat_set, a.doc_id AS l_number, b.doc_id AS r_number, sha256(a.text) = sha256(b.text) AS content_equal FROM d a JOIN d b ON a.repeat_set = b.repeat_set AND a.doc_id < b.doc_id""")
def pair_equality(spark, sf_dir):
    p = compare.run_pairs(sets_view(spark, sf_dir, F.sha2("text", 256).alias("h")), ("repeat_set",))
    return p.select("repeat_set", "l_number", "r_number", (F.col("l_h") == F.col("r_h")).alias("content_equal"))


#: Ids that one task puts in order.
RANGE = 4096


def neighbours(spark, sf_dir) -> DataFrame:
    """(source, l_number, l_text, r_number, r_text): each document with the one before it in its source.

    Ids are put in order in ranges of RANGE; the first of a range follows the last of the nearest range before it, which is found among the
    ranges alone.  Of rows with the same source and id the least text stands for all; documents without an id have no neighbour, null sources are one."""
    d = table(spark, sf_dir, "documents").where("doc_id is not null").select(F.coalesce("source", F.lit("")).alias("source"), F.col("source").isNull().alias("none"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    one = d.groupBy("source", "none", "doc_id").agg(F.min("text").alias("text"))
    ids = d.select("source", "none", "doc_id").distinct().withColumn("range", F.expr(f"doc_id div {RANGE}"))
    by_source = Window.partitionBy("source", "none").orderBy("range")
    ranges = ids.groupBy("source", "none", "range").agg(F.max("doc_id").alias("last")).withColumn("before", F.lag("last").over(by_source))
    inside = Window.partitionBy("source", "none", "range").orderBy("doc_id")
    pairs = ids.withColumn("prev", F.lag("doc_id").over(inside)).join(ranges, ["source", "none", "range"]).select("source", "none", F.col("doc_id").alias("r_number"), F.coalesce("prev", "before").alias("l_number")).where("l_number is not null")
    side = lambda p: one.select("source", "none", F.col("doc_id").alias(f"{p}_number"), F.col("text").alias(f"{p}_text"))
    return pairs.join(side("l"), ["source", "none", "l_number"]).join(side("r"), ["source", "none", "r_number"]).withColumn("source", F.when(~F.col("none"), F.col("source"))).drop("none")


@query()
def text_distance_whole(spark, sf_dir):
    """Whole texts of all documents; neighbouring documents of a source stand for repeated results."""
    left, right = F.col("l_text"), F.col("r_text")
    p = neighbours(spark, sf_dir).select("source", "l_number", "r_number", distance.edit_distance(left, right).alias("edit_distance"), F.greatest(F.length(left), F.length(right), F.lit(1)).alias("longest"))
    return p.select("source", "l_number", "r_number", "edit_distance", F.round(F.col("edit_distance") / F.col("longest") * 100, 6).alias("pct"))


@query("SELECT p_partkey AS id, CAST(levenshtein(p_name, lower(p_type) || p_brand) AS BIGINT) AS d FROM part")
def text_distance_unicode(spark, sf_dir):
    """Letters are written as characters outside of the basic plane, which leaves the distance as it is."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    far = lambda c: F.translate(c, letters, "".join(chr(0x1F600 + i) for i in range(len(letters))))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), distance.edit_distance(far(F.col("p_name")), far(F.concat(F.lower("p_type"), "p_brand"))).cast("bigint").alias("d"))


def lines_view(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("seq", "text"))
    return d.where("text <> ''")


_LINES = "l AS (SELECT doc_id, source, i - 1 AS seq, t[i] AS text FROM (SELECT doc_id, source, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, source, string_split(text, chr(10)) AS t FROM documents)) WHERE t[i] <> '')"


@query(f"WITH {_LINES} SELECT doc_id, count(*) AS n_blocks, CAST(sum(length(text)) AS BIGINT) AS chars FROM l GROUP BY doc_id")
def block_counts(spark, sf_dir):
    return lines_view(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.sum(F.length("text")).cast("bigint").alias("chars"))


@query(f"""WITH {_LINES}, a AS (SELECT source, text, count(*) n FROM l WHERE doc_id % 2 = 0 GROUP BY ALL), b AS (SELECT source, text, count(*) n FROM l WHERE doc_id % 2 = 1 GROUP BY ALL),
m AS (SELECT a.source, count(*) AS m FROM a JOIN b ON a.source = b.source AND a.text = b.text AND a.n = 1 AND b.n = 1 GROUP BY 1),
t AS (SELECT source, count(*) FILTER (doc_id % 2 = 0) AS x, count(*) FILTER (doc_id % 2 = 1) AS y FROM l GROUP BY 1)
SELECT source, coalesce(m, 0) AS matched, x - coalesce(m, 0) AS left_over_left, y - coalesce(m, 0) AS left_over_right FROM t LEFT JOIN m USING (source)""")
def block_unique_match(spark, sf_dir):
    """Lines of even and of odd documents of a source stand for two results' blocks."""
    v = lines_view(spark, sf_dir)
    return compare.unique_matches(v.where("doc_id % 2 = 0"), v.where("doc_id % 2 = 1"), ("source",), "text", "seq")[1]


@query(f"WITH {_LINES} SELECT text, count(*) AS n, count(DISTINCT doc_id) AS documents FROM l WHERE trim(text) <> '' GROUP BY text HAVING count(DISTINCT doc_id) >= 2")
def repeated_lines(spark, sf_dir):
    return chunks.repeated_lines(lines_view(spark, sf_dir))


@query()
def block_diff(spark, sf_dir):
    """Neighbouring documents of a source stand for repeated results; lines are blocks."""
    pairs = neighbours(spark, sf_dir).select(F.col("r_number").alias("doc_id"), F.split("l_text", "\n").alias("before"), F.split("r_text", "\n").alias("after"))
    return pairs.select("doc_id", compare.block_diff("before", "after").alias("d")).select("doc_id", "d.*")


@query("""SELECT event_id, CAST(event_id % 3 > 0 AS BIGINT) + CAST(event_id % 2 > 0 AS BIGINT) AS changed_values, CAST(greatest(event_id % 3, 2 * (event_id % 2)) AS DOUBLE) AS max_abs_delta,
CAST(event_id % 7 = 0 AS BIGINT) + CAST(event_id % 5 = 0 AS BIGINT) AS other_changes FROM events""")
def numeric_delta(spark, sf_dir):
    """Numbers move at odd ids and at two in three; texts change at every seventh id, the shape at every fifth."""
    k, s = F.col("event_id"), lambda c: c.cast("string")
    made = lambda x, y, t, more: F.concat(F.lit('{"w": {"z": true}, "v": ['), s(x), F.lit(", "), s(y), F.lit('], "t": "'), t, F.lit('"'), more, F.lit("}"))
    a = made(k, 3 * k, F.col("event_type"), F.lit(""))
    b = made(k + k % 3, 3 * k - 2 * (k % 2), F.concat("event_type", F.when(k % 7 == 0, "?").otherwise("")), F.when(k % 5 == 0, ', "u": 0').otherwise(""))
    e = table(spark, sf_dir, "events").select("event_id", a.alias("a"), b.alias("b"))
    return e.select("event_id", compare.numeric_delta("a", "b").alias("d")).select("event_id", "d.*")


@query("""WITH e AS (SELECT user_id, event_id AS k, event_id % 6 <> 0 AS l, event_id % 5 <> 0 AS r, event_id % 9 = 0 AS word FROM events WHERE event_id % 30 <> 0)
SELECT user_id, count(*) FILTER (l AND r AND NOT word AND k % 4 > 0) AS changed_values, CAST(coalesce(max(k % 4) FILTER (l AND r AND NOT word), 0) AS DOUBLE) AS max_abs_delta, count(*) FILTER (l <> r OR (l AND r AND word)) AS other_changes FROM e GROUP BY user_id""")
def numeric_delta_flat(spark, sf_dir):
    """A user's events are the values of one result; some are words, some are on one side alone."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("k"), F.col("event_id").cast("string").alias("path"), "event_type")
    value = lambda n, w: F.when(F.col("k") % 9 == 0, F.concat("event_type", F.lit(w))).otherwise(n.cast("string")).alias("value")
    a = e.where("k % 6 <> 0").select("user_id", "path", value(F.col("k"), ""))
    b = e.where("k % 5 <> 0").select("user_id", "path", value(F.col("k") + F.col("k") % 4, "!"))
    return compare.flat_numeric_delta(a, b, ("user_id",))


_ITEMS = "i AS (SELECT doc_id, i - 1 AS n, t[i] AS text, CASE WHEN length(t[i]) < 40 THEN 'section_header' ELSE 'text' END AS label FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents)))"


def _ref(i):
    return F.struct(F.concat(F.lit("#/texts/"), i.cast("string")).alias("$ref"))


def _trees(spark, sf_dir, item, children=None, **more) -> DataFrame:
    """(doc_id, raw): each document as a tree-shaped result, whose texts are ``item(line, number)``; ``children(lines)`` are the body's."""
    lines = F.split("text", "\n")
    every = F.transform(F.sequence(F.lit(0), F.size(lines) - 1), _ref) if children is None else children(lines)
    made = F.struct(F.struct(every.alias("children")).alias("body"), F.transform(lines, item).alias("texts"), *[c.alias(n) for n, c in more.items()])
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.to_json(made).alias("raw"))


@query(f"""WITH {_ITEMS}, u AS (SELECT doc_id, text, count(*) AS n, min(n) AS place FROM i GROUP BY ALL), m AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS lines, count(*) FILTER (n = 1) AS matched, count(*) FILTER (n = 1 AND place % 3 = 0) AS moved FROM u GROUP BY doc_id)
SELECT doc_id, matched, lines - matched AS left_over_left, lines - matched AS left_over_right, CASE WHEN matched > 0 THEN moved END AS changed_values, CASE WHEN matched > 0 THEN CASE WHEN moved > 0 THEN 0.25e0 ELSE 0e0 END END AS max_abs_delta, CAST(CASE WHEN matched > 0 THEN 0 END AS BIGINT) AS other_changes FROM m""")
def geometry_match(spark, sf_dir):
    """Every third line has another place on the right; lines that a document repeats cannot be matched."""

    def side(shift: float) -> DataFrame:
        box = lambda i: F.struct(F.lit(1).alias("page_no"), F.struct((i + F.when(i % 3 == 0, shift).otherwise(0.0)).alias("l"), F.lit(2.0).alias("t")).alias("bbox"), F.array(F.lit(0), F.lit(1)).alias("charspan"))
        return compare.geometry(references.snapshots(_trees(spark, sf_dir, lambda t, i: F.struct(F.lit("text").alias("label"), t.alias("text"), F.array(box(i)).alias("prov")))))

    return compare.geometry_delta(side(0.0), side(0.25))


@query("""SELECT doc_id, doc_id % 3 = 0 AS content_equal, CAST(CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 6 END AS BIGINT) AS edit_distance, CAST(CASE WHEN doc_id % 3 = 1 THEN 2 ELSE 0 END AS BIGINT) AS added, CAST(CASE WHEN doc_id % 3 = 2 THEN 2 ELSE 0 END AS BIGINT) AS deleted,
CAST(0 AS BIGINT) AS replaced_left, CAST(0 AS BIGINT) AS replaced_right FROM documents WHERE text IS NOT NULL""")
def snapshot_pairs(spark, sf_dir):
    """Each document against itself, or one side with a line before and one behind it that no document has."""
    k, longer = F.col("doc_id") % 3, F.concat(F.lit("☃a\n"), "text", F.lit("\n☃b"))
    shot = lambda t: F.to_json(F.struct(t.alias("text"), F.transform(F.split(t, "\n"), lambda x: F.struct(x.alias("text"))).alias("blocks")))
    d = table(spark, sf_dir, "documents").where("text is not null")
    d = d.select("doc_id", shot(F.when(k == 2, longer).otherwise(F.col("text"))).alias("l_snapshot"), shot(F.when(k == 1, longer).otherwise(F.col("text"))).alias("r_snapshot"))
    return compare.compare_snapshots(d).select("doc_id", "content_equal", "edit_distance", "changes.added", "changes.deleted", "changes.replaced_left", "changes.replaced_right")


@query(f"""WITH d AS (SELECT doc_id // {2 * SET} AS repeat_set, doc_id, text FROM documents)
SELECT a.repeat_set, a.doc_id AS l_number, b.doc_id AS r_number, a.text = b.text AS equal FROM d a JOIN d b ON a.repeat_set = b.repeat_set AND a.doc_id % 2 = 0 AND b.doc_id % 2 <> 0""")
def cross_tool_pairs(spark, sf_dir):
    """Even and odd ids of a set of neighbours stand for two tools' results."""
    d = table(spark, sf_dir, "documents").select(F.expr(f"doc_id div {2 * SET}").alias("repeat_set"), F.col("doc_id").alias("number"), F.sha2("text", 256).alias("h"))
    p = compare.cross_pairs(d.where("number % 2 = 0"), d.where("number % 2 <> 0"), "repeat_set")
    return p.select("repeat_set", "l_number", "r_number", (F.col("l_h") == F.col("r_h")).alias("equal"))


# --- results that stand for documents ----------------------------------------------------------------------------


def results_view(spark, sf_dir) -> DataFrame:
    """(doc_id, raw): each document as a tree-shaped result.  Lines are texts, those with an even number the body's children, last
    first, each with the line behind it as its child; short lines are headings."""
    lines = F.split("text", "\n")
    ref = lambda i: F.struct(F.concat(F.lit("#/texts/"), i.cast("string")).alias("$ref"))
    none = F.array().cast("array<struct<`$ref`:string>>")
    item = lambda t, i: F.struct(F.concat(F.lit("#/texts/"), i.cast("string")).alias("self_ref"), F.when(F.length(t) < 40, "section_header").otherwise("text").alias("label"), t.alias("text"), F.when((i % 2 == 0) & (i + 1 < F.size(lines)), F.array(ref(i + 1))).otherwise(none).alias("children"))
    even = F.filter(F.sequence(F.size(lines) - 1, F.lit(0), F.lit(-1)), lambda i: i % 2 == 0)
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.to_json(F.struct(F.struct(F.transform(even, ref).alias("children")).alias("body"), F.transform(lines, item).alias("texts"))).alias("raw"))


@query(f"WITH {_ITEMS} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n // 2 DESC, n) - 1 AS seq, '#/texts/' || n AS ref, label AS kind, 'body' AS layer, n % 2 AS depth, text FROM i")
def snapshot_documents(spark, sf_dir):
    return references.snapshot_blocks(references.snapshots(results_view(spark, sf_dir)))


@query(f"WITH {_ITEMS} SELECT doc_id, CAST(count(*) // 2 AS BIGINT) AS refs, CAST(count(*) // 2 AS BIGINT) AS resolved FROM i GROUP BY doc_id HAVING count(*) > 1")
def resolution_documents(spark, sf_dir):
    return references.resolution_summary(references.items(references.documents(results_view(spark, sf_dir))))


@query(f"""WITH {_ITEMS}, m AS (SELECT doc_id, string_agg(CASE WHEN label = 'section_header' THEN '## ' ELSE '' END || text, chr(10) || chr(10) ORDER BY n // 2 DESC, n) AS content FROM i WHERE text <> '' GROUP BY doc_id)
SELECT doc_id, coalesce(content, '') AS content, CAST(NULL AS VARCHAR) AS problem FROM documents LEFT JOIN m USING (doc_id) WHERE text IS NOT NULL""")
def markdown_export(spark, sf_dir):
    return exports.export_document(results_view(spark, sf_dir), "markdown")


@query(f"""WITH {_ITEMS} SELECT doc_id, count(*) AS n_texts, coalesce(sum(length(text)), 0)::BIGINT AS n_chars, '{{"errors":[],"status":"success"}}' AS metadata FROM i GROUP BY doc_id""")
def result_export(spark, sf_dir):
    """Each document's result in an envelope, and from its two parts what they hold."""
    whole = results_view(spark, sf_dir).select("doc_id", F.concat(F.lit('{"status": "success", "errors": [], "document": '), "raw", F.lit("}")).alias("raw"))
    e = exports.export_result(whole).where("problem is null")
    texts = F.from_json("document", "texts array<struct<text:string>>")["texts"]
    return e.select("doc_id", F.size(texts).cast("bigint").alias("n_texts"), F.aggregate(texts, F.lit(0).cast("bigint"), lambda n, t: n + F.length(t["text"])).alias("n_chars"), "metadata")


def notices_view(spark, sf_dir) -> DataFrame:
    """(doc_id, raw): lines as texts, numbered and lettered by their place and each third one bold; a group holds the first two, and in each third document a picture."""
    ref = lambda kind, i: F.struct(F.concat(F.lit(f"#/{kind}/"), i.cast("string")).alias("$ref"))
    item = lambda t, i: F.struct(F.concat(F.when(i % 5 == 0, "1. ").when(i % 7 == 0, "가. ").otherwise(""), t).alias("text"), F.struct((i % 3 == 0).alias("bold")).alias("formatting"))
    lines = F.split("text", "\n")
    rest = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: (i >= 2) & (i < F.size(lines)))
    inside = F.concat(F.transform(F.filter(F.array(F.lit(0), F.lit(1)), lambda i: i < F.size(lines)), lambda i: ref("texts", i)), F.when(F.col("doc_id") % 3 == 0, F.array(ref("pictures", F.lit(0)))).otherwise(F.array().cast("array<struct<`$ref`:string>>")))
    body = F.struct(F.concat(F.array(ref("groups", F.lit(0))), F.transform(rest, lambda i: ref("texts", i))).alias("children"))
    made = F.struct(body.alias("body"), F.transform(lines, item).alias("texts"), F.array(F.struct(inside.alias("children"))).alias("groups"), F.array(F.struct(F.lit("picture").alias("label"))).alias("pictures"))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.to_json(made).alias("raw"))


_NOTICE = "l AS (SELECT doc_id, i - 1 AS i, t[i] AS x FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents)))"


@query(f"""WITH {_NOTICE}, g AS (SELECT doc_id, trim(string_agg(trim(CASE WHEN i = 0 THEN '1. ' ELSE '' END || x), ' ' ORDER BY i) FILTER (trim(CASE WHEN i = 0 THEN '1. ' ELSE '' END || x) <> '')) AS t FROM l WHERE i < 2 GROUP BY doc_id)
SELECT l.doc_id, bool_or(CASE WHEN i = 0 THEN regexp_matches(g.t, '^1\\.\\s+.+$') ELSE i > 1 AND i % 15 = 0 AND trim(x) <> '' END) AND coalesce(bool_or(i > 1 AND i % 5 <> 0 AND i % 7 = 0 AND trim(x) <> ''), false) AS matched FROM l JOIN g USING (doc_id) GROUP BY l.doc_id""")
def rule_gate(spark, sf_dir):
    """The group of the first two lines is bold as its first text is."""
    return outline.matches_rules(outline.body_blocks(notices_view(spark, sf_dir)))


@query("SELECT doc_id, CAST(0 AS BIGINT) AS seq, 'a group''s child is neither text nor group' AS problem FROM documents WHERE text IS NOT NULL AND doc_id % 3 = 0")
def group_children(spark, sf_dir):
    return outline.body_blocks(notices_view(spark, sf_dir)).where("problem is not null").select("doc_id", F.col("seq").cast("bigint").alias("seq"), "problem")


@query(f"""WITH {_ITEMS}, f AS (SELECT doc_id, 'classification' AS category, n, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS seq FROM (SELECT doc_id, label, min(n) AS n FROM i GROUP BY ALL)
  UNION ALL SELECT doc_id, 'headings', n, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 FROM i WHERE label = 'section_header')
SELECT doc_id, category, CAST(seq AS INT) AS seq, '#/texts/' || f.n AS source, i.text FROM f JOIN i USING (doc_id, n) WHERE seq < 3
UNION ALL SELECT doc_id, 'hierarchy', 0, '#/body', NULL FROM documents WHERE text IS NOT NULL""")
def excerpt_documents(spark, sf_dir):
    """Texts of any length are whole here."""
    e = evidence.excerpts(results_view(spark, sf_dir), longest=None)
    return e.select("doc_id", "category", "seq", "source", F.get_json_object("content", "$.text").alias("text"))


# --- outlines and references -----------------------------------------------------------------------------------

@query("""WITH s AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 END AS level FROM conversations),
w AS (SELECT *, last_value(CASE WHEN level = 1 THEN turn END IGNORE NULLS) OVER p AS h1, last_value(CASE WHEN level = 2 THEN turn END IGNORE NULLS) OVER p AS h2 FROM s
WINDOW p AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, turn, level, CASE WHEN level = 1 THEN NULL WHEN level = 2 THEN h1 WHEN h2 > coalesce(h1, -1) THEN h2 ELSE h1 END AS parent_seq FROM w""")
def outline_sections(spark, sf_dir):
    level = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2)
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", level.alias("level"))
    return outline.parents(c, "conv_id", "turn").select("conv_id", "turn", "level", "parent_seq")


_MARKED = "x AS (SELECT doc_id, CAST(seq AS BIGINT) AS seq, trim(translate(text, ':' || chr(9), '')) AS x FROM l WHERE trim(translate(text, ':' || chr(9), '')) <> '')"


def marked_lines(spark, sf_dir) -> DataFrame:
    """(doc_id, seq, text, bold): lines marked by their place as headings or list items of the notice format."""
    x, k = F.trim(F.translate("text", ":\t", "")), F.col("seq") % 7
    marked = F.when(k == 0, F.concat(F.col("seq").cast("string"), F.lit(". "), "x")).when(k == 1, F.concat(F.lit("가. "), "x", F.lit(" : 청년"))).when(k == 2, F.concat(F.lit("나."), "x"))
    marked = marked.when(k == 3, F.concat(F.lit("("), F.col("seq").cast("string"), F.lit(") "), "x")).when(k == 4, F.concat(F.lit("① "), "x")).when(k == 5, F.concat(F.lit("‧"), "x")).otherwise(F.concat(F.lit("plain "), "x"))
    return lines_view(spark, sf_dir).withColumn("x", x).where("x <> ''").select("doc_id", F.col("seq").cast("bigint").alias("seq"), marked.alias("text"), (F.col("seq") % 2 == 0).alias("bold"))


@query(f"""WITH {_LINES}, {_MARKED}, v AS (SELECT *, CASE WHEN seq % 7 = 0 AND seq % 2 = 0 THEN 1 WHEN seq % 7 IN (1, 2) THEN 2 END AS level FROM x)
SELECT doc_id, seq, CAST(level AS INT) AS level, CASE WHEN level = 1 THEN CAST(seq AS VARCHAR) WHEN level = 2 THEN CASE seq % 7 WHEN 1 THEN '가' ELSE '나' END END AS marker, CASE WHEN level IS NOT NULL THEN x END AS title, CASE WHEN seq % 7 = 1 THEN '청년' END AS lead FROM v""")
def heading_match(spark, sf_dir):
    d = marked_lines(spark, sf_dir).withColumn("level", text.heading_level(F.col("text"), F.col("bold")))
    return d.withColumn("h", text.heading_parts(F.col("text"), F.col("level"))).select("doc_id", "seq", "level", "h.marker", "h.title", "h.lead")


@query(f"""WITH {_LINES}, {_MARKED}
SELECT doc_id, seq, CASE WHEN seq % 7 = 5 THEN 'bullet' ELSE 'ordered' END AS kind, CASE seq % 7 WHEN 3 THEN CAST(seq AS VARCHAR) WHEN 4 THEN '①' ELSE '‧' END AS marker, x AS text FROM x WHERE seq % 7 IN (3, 4, 5)""")
def list_item_kind(spark, sf_dir):
    d = marked_lines(spark, sf_dir).withColumn("l", text.list_item(F.col("text"))).where("l is not null")
    return d.select("doc_id", "seq", "l.kind", "l.marker", "l.text")


_TOP, _SUB, _LIST = r"'^(\d+)\.\s+(.+)$'", r"'^([가나다라마바사아자차카타파하])\.\s*([^:]+?)(?:\s*:\s*(.+))?$'", r"'^(?:\((\d+)\)|([①-⑳])|([‧•]))\s*(.+)$'"


@query(f"""WITH {_NOTICE},
t AS (SELECT doc_id, i, trim(CASE WHEN i % 5 = 0 THEN '1. ' WHEN i % 7 = 0 THEN '가. ' ELSE '' END || x) AS t FROM l),
b AS (SELECT doc_id, 0 AS seq, string_agg(t, ' ' ORDER BY i) AS t, true AS bold FROM t WHERE i < 2 AND t <> '' GROUP BY doc_id UNION ALL SELECT doc_id, i - 1, t, i % 3 = 0 FROM t WHERE i >= 2 AND t <> ''),
m AS (SELECT doc_id, bool_or(bold AND regexp_matches(t, {_TOP})) AND bool_or(regexp_matches(t, {_SUB})) AS matched FROM b GROUP BY doc_id),
v AS (SELECT *, CASE WHEN NOT matched THEN NULL WHEN bold AND regexp_matches(t, {_TOP}) THEN 1 WHEN regexp_matches(t, {_SUB}) THEN 2 END AS level FROM b JOIN m USING (doc_id)),
k AS (SELECT *, matched AND level IS NULL AND regexp_matches(t, {_LIST}) AS item FROM v),
p AS (SELECT *, last_value(CASE WHEN level = 1 THEN seq END IGNORE NULLS) OVER w AS h1, last_value(CASE WHEN level = 2 THEN seq END IGNORE NULLS) OVER w AS h2 FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id, CAST(seq AS BIGINT) AS seq, CAST(CASE WHEN level = 1 THEN NULL WHEN level = 2 THEN h1 WHEN h2 > coalesce(h1, -1) THEN h2 ELSE h1 END AS BIGINT) AS parent_seq, CASE WHEN level IS NOT NULL THEN 'section' WHEN item THEN 'list_item' ELSE 'paragraph' END AS type, CAST(level AS INT) AS level,
  CASE WHEN level = 1 THEN regexp_extract(t, {_TOP}, 1) WHEN level = 2 THEN regexp_extract(t, {_SUB}, 1) WHEN item THEN regexp_extract(t, {_LIST}, 1) || regexp_extract(t, {_LIST}, 2) || regexp_extract(t, {_LIST}, 3) END AS marker,
  CASE WHEN level = 1 THEN trim(regexp_extract(t, {_TOP}, 2)) WHEN level = 2 THEN trim(regexp_extract(t, {_SUB}, 2)) END AS title,
  CASE WHEN level = 1 THEN NULL WHEN level = 2 THEN nullif(trim(regexp_extract(t, {_SUB}, 3)), '') WHEN item THEN regexp_extract(t, {_LIST}, 4) ELSE t END AS text FROM p""")
def notice_outline(spark, sf_dir):
    return outline.outline(outline.body_blocks(notices_view(spark, sf_dir))).select("doc_id", "seq", "parent_seq", "type", "level", "marker", "title", "text")


@query()
def notice_tree(spark, sf_dir):
    return outline.nested(outline.outline(outline.body_blocks(notices_view(spark, sf_dir))))


@query("""WITH RECURSIVE t AS (SELECT conv_id, turn, 't' || turn AS ref, lead('t' || turn) OVER o AS next, min(turn) OVER p AS first, max(turn) OVER p AS last FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL) WINDOW o AS (PARTITION BY conv_id ORDER BY turn), p AS (PARTITION BY conv_id)),
roots AS (SELECT conv_id AS doc_id, 0 AS pos, ref AS child FROM t WHERE turn = first),
edges AS (SELECT conv_id AS doc_id, ref AS parent, 1 AS pos, next AS child FROM t WHERE next IS NOT NULL UNION ALL SELECT conv_id, ref, 0, 't' || last FROM t WHERE conv_id % 3 = 1 AND turn < last UNION ALL SELECT conv_id, ref, 2, 't' || first FROM t WHERE conv_id % 3 = 0 AND turn = last),
w AS (SELECT doc_id, child AS ref, [pos] AS path, [child] AS seen, false AS cyclic FROM roots
  UNION ALL SELECT e.doc_id, e.child, list_append(w.path, e.pos), list_append(w.seen, e.child), list_contains(w.seen, e.child) FROM w JOIN edges e ON e.doc_id = w.doc_id AND e.parent = w.ref WHERE NOT w.cyclic),
f AS (SELECT doc_id, ref, min(path) AS path FROM w WHERE NOT cyclic GROUP BY ALL), l AS (SELECT DISTINCT doc_id, ref FROM w WHERE cyclic)
SELECT f.doc_id, f.ref, array_to_string(path, '.') AS path, len(path) - 1 AS depth, l.ref IS NOT NULL AS cyclic FROM f LEFT JOIN l ON f.doc_id = l.doc_id AND f.ref = l.ref""")
def ref_traversal(spark, sf_dir):
    """Turns hold the next one; in a third of the conversations each holds the last one as well, in a third the last holds the first."""
    all_ = Window.partitionBy("conv_id")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn").where("conv_id is not null and turn is not null").distinct()
    t = c.select(F.col("conv_id").alias("doc_id"), "turn", F.lead("turn").over(all_.orderBy("turn")).alias("next"), F.min("turn").over(all_).alias("first"), F.max("turn").over(all_).alias("last"))
    name = lambda c: F.concat(F.lit("t"), F.col(c).cast("string"))
    k = F.col("doc_id") % 3
    link = lambda pos, child: F.struct(F.lit(pos).alias("pos"), child.alias("child"))
    to = F.array(link(1, name("next")), link(0, F.when((k == 1) & (F.col("turn") < F.col("last")), name("last"))), link(2, F.when((k == 0) & (F.col("turn") == F.col("last")), name("first"))))
    edges = t.select("doc_id", name("turn").alias("parent"), F.explode(to).alias("to")).select("doc_id", "parent", "to.*").where("child is not null")
    o = references.reading_order(t.where("turn = first").select("doc_id", F.lit(0).alias("pos"), name("turn").alias("child")), edges)
    return o.select("doc_id", "ref", F.array_join(F.transform("path", lambda x: x.cast("string")), ".").alias("path"), F.col("depth").cast("bigint").alias("depth"), "cyclic")


_SHARED = "l AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL)"


@query(f"""WITH RECURSIVE {_SHARED},
e AS (SELECT doc_id, i, pos, 2 * i + 1 + pos AS child FROM l, (SELECT unnest(range(0, 1000000)) AS i) x, (VALUES (0), (1), (2)) p(pos) WHERE i < n AND 2 * i + 1 + pos < n),
w AS (SELECT doc_id, 0 AS node, [0] AS path FROM l UNION ALL SELECT w.doc_id, e.child, list_append(path, e.pos) FROM w JOIN e ON w.doc_id = e.doc_id AND w.node = e.i)
SELECT doc_id, CAST(node AS BIGINT) AS node, array_to_string(min(path), '.') AS path, CAST(len(min(path)) - 1 AS BIGINT) AS depth, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY min(path)) AS BIGINT) AS seq FROM w GROUP BY doc_id, node""")
def reading_order_documents(spark, sf_dir):
    """A document's lines as nodes, where line i holds the lines 2i+1, 2i+2 and 2i+3, the last of which the next line holds, too: the
    number of paths grows with a power of the lines, that of rows does not."""
    n = F.size(F.split("text", "\n"))
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", n.alias("n"))
    each = d.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")).select("doc_id", "n", "i", F.explode(F.array(*map(F.lit, range(3)))).alias("pos"))
    name = lambda c: c.cast("string")
    edges = each.withColumn("child", 2 * F.col("i") + 1 + F.col("pos")).where("child < n").select("doc_id", name(F.col("i")).alias("parent"), "pos", name(F.col("child")).alias("child"))
    o = references.reading_order(d.select("doc_id", F.lit(0).alias("pos"), F.lit("0").alias("child")), edges, max_depth=None)
    order = Window.partitionBy("doc_id").orderBy("path")
    return o.select("doc_id", F.col("ref").cast("bigint").alias("node"), F.array_join(F.transform("path", lambda x: x.cast("string")), ".").alias("path"), F.col("depth").cast("bigint").alias("depth"), F.row_number().over(order).cast("bigint").alias("seq"))


@query("""WITH c AS (SELECT conv_id AS doc_id, 't' || turn AS ref, text, CASE WHEN turn % 2 = 0 THEN turn ELSE 1 END AS x, CASE WHEN turn % 2 = 0 THEN -1 ELSE turn END AS y FROM conversations),
n AS (SELECT * FROM c UNION ALL SELECT DISTINCT doc_id, 'g', NULL, -1, -1 FROM c UNION ALL SELECT DISTINCT doc_id, 'h', NULL, 1, -1 FROM c WHERE y >= 0)
SELECT doc_id, 'g' AS ref, coalesce(string_agg(text, ' ' ORDER BY x, y) FILTER (text <> ''), '') AS text, string_agg(ref, ',' ORDER BY x, y) AS refs, doc_id % 2 = 0 AS bold FROM n GROUP BY doc_id HAVING count(*) FILTER (text <> '') > 0""")
def group_flatten(spark, sf_dir):
    """A conversation is a group of its even turns, with a group of the odd ones in the second place."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.concat(F.lit("t"), F.col("turn").cast("string")).alias("ref"), "text")
    child = lambda some, parent, pos, name: c.where(some).select("doc_id", F.lit(parent).alias("parent"), pos.cast("int").alias("pos"), name.alias("child"))
    edges = child("turn % 2 = 0", "g", F.col("turn"), F.col("ref")).unionByName(child("turn % 2 = 1", "h", F.col("turn"), F.col("ref"))).unionByName(child("turn % 2 = 1", "g", F.lit(1), F.lit("h")).distinct())
    g = references.group_text(c.select("doc_id", F.lit("g").alias("ref")).distinct(), edges, c.select("doc_id", "ref", "text", (F.col("doc_id") % 2 == 0).alias("bold")))
    return g.select("doc_id", "ref", "text", F.array_join("source_refs", ",").alias("refs"), "bold")


@query(f"""WITH {_ITEMS} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY CASE n % 8 WHEN 3 THEN 1 WHEN 7 THEN 2 ELSE 0 END, n) - 1 AS seq, '#/texts/' || n AS ref,
CASE WHEN n % 8 = 7 THEN 'unattached' ELSE 'body' END AS layer, CAST(CASE WHEN n % 8 IN (1, 3, 5) THEN 1 ELSE 0 END AS BIGINT) AS depth FROM i""")
def ref_traversal_full(spark, sf_dir):
    """The body holds each even line twice; of the odd ones, those behind every fourth line are its children, half of the others are captions of the
    line before, which come when the body is through, and nothing holds the rest."""
    size = F.size(F.split("text", "\n"))
    even = lambda lines: F.transform(F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: i % 2 == 0), _ref)
    behind = lambda some, i: F.when(some & (i + 1 < size), F.array(_ref(i + 1)))
    item = lambda t, i: F.struct(F.lit("text").alias("label"), t.alias("text"), behind(i % 4 == 0, i).alias("children"), behind(i % 8 == 2, i).alias("captions"))
    t = _trees(spark, sf_dir, item, lambda lines: F.concat(even(lines), even(lines)))
    return references.snapshot_blocks(references.snapshots(t)).select("doc_id", "seq", "ref", "layer", F.col("depth").cast("bigint").alias("depth"))


@query(f"WITH {_ITEMS} SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN NULL ELSE count(*) END AS n_blocks, CAST(doc_id % 4 = 1 AS INT) AS cyclic FROM i GROUP BY doc_id")
def snapshot_problems(spark, sf_dir):
    """In a quarter of the documents the last line holds the first one and the first the last."""
    last = F.size(F.split("text", "\n")) - 1
    other = lambda i: F.when((F.col("doc_id") % 4 == 1) & ((i == 0) | (i == last)), F.array(_ref(last - i)))
    s = references.snapshots(_trees(spark, sf_dir, lambda t, i: F.struct(F.lit("text").alias("label"), t.alias("text"), other(i).alias("children"))))
    return s.select("doc_id", F.col("n_blocks").cast("bigint").alias("n_blocks"), F.coalesce(F.col("problem").contains("Cyclic"), F.lit(False)).cast("int").alias("cyclic"))


@query(f"""WITH {_ITEMS}, n AS (SELECT doc_id, count(*) AS n FROM i GROUP BY doc_id)
SELECT doc_id, unnest(['#/texts/' || (n - 1), '#/texts/0' || (n - 1), '#/texts/-1', '#/texts/' || n, 'texts/0', '#/pages/' || doc_id, '#/texts/0/x']) AS child,
       unnest([NULL, NULL, 'reference does not exist', 'reference does not exist', 'unsupported reference', 'unsupported item type', 'unsupported reference']) AS problem FROM n""")
def reference_check(spark, sf_dir):
    t = _trees(spark, sf_dir, lambda t, i: F.struct(t.alias("text")))
    n = F.size(F.split("text", "\n"))
    at = lambda before, x: F.concat(F.lit(before), x.cast("string"))
    refs = F.array(at("#/texts/", n - 1), at("#/texts/0", n - 1), F.lit("#/texts/-1"), at("#/texts/", n), F.lit("texts/0"), at("#/pages/", F.col("doc_id")), F.lit("#/texts/0/x"))
    asked = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.explode(refs).alias("child"))
    return references.dereference(asked, references.items(references.documents(t))).select("doc_id", "child", "problem")


@query(f"""WITH {_ITEMS}
SELECT doc_id, count(*) FILTER (n % 2 = 0) + count(*) FILTER (n % 3 = 0 AND n > 0) + count(*) FILTER (n % 5 = 0) AS refs, count(*) FILTER (n % 3 = 0 AND n > 0 AND n % 4 <> 0) + CASE WHEN count(*) FILTER (n % 4 = 3) = 1 THEN count(*) FILTER (n % 5 = 0) ELSE 0 END AS resolved FROM i GROUP BY doc_id""")
def reference_resolution(spark, sf_dir):
    """Every fourth line has the same self_ref, which resolves where one line alone has it."""
    item = lambda t, i: F.struct(
        F.when(i % 4 == 3, "twin").otherwise(F.concat(F.lit("#/texts/"), i.cast("string"))).alias("self_ref"),
        F.when(i % 2 == 0, F.struct(F.lit("#/body").alias("$ref"))).alias("parent"),
        F.when((i % 3 == 0) & (i > 0), F.array(_ref(i - 1))).alias("children"),
        F.when(i % 5 == 0, F.array(F.struct(F.lit("twin").alias("$ref")))).alias("captions"),
    )
    return references.resolution_summary(references.items(references.documents(_trees(spark, sf_dir, item))))


@query("SELECT page_id, CASE page_id % 7 WHEN 1 THEN 'not an image type' WHEN 2 THEN 'no uri' WHEN 3 THEN 'not an image data uri' WHEN 4 THEN 'types differ' WHEN 5 THEN 'bad base64' END AS problem FROM pages")
def image_uri_check(spark, sf_dir):
    """Pages stand for images."""
    k, body = F.col("page_id") % 7, F.translate(F.base64(F.encode("html", "UTF-8")), "\r\n", "")
    uri = F.when(k == 3, F.col("url")).when(k == 4, F.concat(F.lit("data:image/gif;base64,"), body)).when(k == 5, F.concat(F.lit("data:image/png;base64,"), body, F.lit("A"))).when(k != 2, F.concat(F.lit("data:image/png;base64,"), body))
    mime = F.when(k == 1, "text/plain").when(k == 6, "image/PNG").otherwise("image/png")
    return table(spark, sf_dir, "pages").select("page_id", text.data_uri_problem(mime, uri).alias("problem"))


# --- markup -------------------------------------------------------------------------------------------------------

@query(r"SELECT page_id, regexp_matches(html, '(?i)^\s*(<!doctype\s+html[^>]*>\s*)?<(html|body|div|p|h[1-6]|table)(\s|>)') AS is_html FROM pages")
def html_sniff(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.is_html(F.col("html")).alias("is_html"))


_BARE = r"regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<(script|style)[^>]*>.*?</(script|style)>', '', 'gsi')"


@query(rf"SELECT lower(tag) AS tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all({_BARE}, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag FROM pages) GROUP BY 1")
def html_tag_counts(spark, sf_dir):
    return markup.html_tags(table(spark, sf_dir, "pages"), "page_id", "html").groupBy("tag").agg(F.sum("n").cast("bigint").alias("n"))


@query()
def html_blocks(spark, sf_dir):
    return markup.markup_blocks(table(spark, sf_dir, "pages"), "page_id", "html")


@query()
def markup_inventory(spark, sf_dir):
    b = markup.block_counts(markup.markup_blocks(table(spark, sf_dir, "pages"), "page_id", "html"))
    return b.select("doc_id", F.to_json("counts").alias("counts"), F.to_json("headings").alias("headings"))


@query(rf"SELECT page_id AS doc_id, len(regexp_extract_all({_BARE}, '<h1[ >]')) AS n FROM pages WHERE len(regexp_extract_all({_BARE}, '<h1[ >]')) > 0")
def html_headings(spark, sf_dir):
    b = markup.markup_blocks(table(spark, sf_dir, "pages"), "page_id", "html")
    return b.where("kind = 'heading' and level = 1").groupBy("doc_id").agg(F.count("*").alias("n"))


@query()
def markup_excerpts(spark, sf_dir):
    return markup.markup_excerpts(table(spark, sf_dir, "pages"), "page_id", "html")


#: Marks that are left out of lines before they are made Markdown.
_PLAIN = "*_`|\\<>#[]+-=~.):&\t"


_PLAIN_SQL = "trim(translate(t[i], '" + _PLAIN.replace("\t", "") + "' || chr(9), ''))"


def markdown_view(spark, sf_dir) -> DataFrame:
    """(doc_id, text): lines with blank ones between them: short ones are headings, of the others one in four is an item, one strong, one in a fence."""
    x = lambda t: F.trim(F.translate(t, _PLAIN, ""))
    made = lambda t, i: F.when(t == "", "").when(F.length(t) < 40, F.concat(F.repeat(F.lit("#"), 1 + F.length(t) % 6), F.lit(" "), t)).when(i % 4 == 1, F.concat(F.lit("- "), t)).when(i % 4 == 2, F.concat(F.lit("**"), t, F.lit("**"))).when(i % 4 == 3, F.concat(F.lit("```\n"), t, F.lit("\n```"))).otherwise(t)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), lambda t, i: made(x(t), i)), "\n\n").alias("text"))


@query(f"""WITH l AS (SELECT doc_id, i - 1 AS i, {_PLAIN_SQL} AS x FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents)))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS BIGINT) AS seq, CASE WHEN length(x) < 40 THEN 'section_header' WHEN i % 4 = 1 THEN 'list_item' WHEN i % 4 = 3 THEN 'code' ELSE 'unknown' END AS label,
CASE WHEN length(x) < 40 THEN CAST(1 + length(x) % 6 AS BIGINT) END AS level, CASE WHEN length(x) >= 40 AND i % 4 = 2 THEN '**' || x || '**' WHEN length(x) >= 40 AND i % 4 = 3 THEN x || chr(10) ELSE x END AS text FROM l WHERE x <> ''""")
def markdown_blocks(spark, sf_dir):
    return markup.markup_blocks(markdown_view(spark, sf_dir)).select("doc_id", "seq", "label", F.col("level").cast("bigint").alias("level"), "text")


@query(f"""WITH l AS (SELECT conv_id, turn, i, {_PLAIN_SQL} AS x FROM (SELECT conv_id, turn, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT conv_id, turn, string_split(coalesce(text, ''), chr(10)) AS t FROM conversations)))
SELECT conv_id * 1000 + turn AS doc_id, 'list' AS signal, CAST(i + 2 AS BIGINT) AS line, CAST(NULL AS BIGINT) AS level FROM l WHERE x <> '' UNION ALL SELECT conv_id * 1000 + turn, 'heading', 1, 2 FROM conversations""")
def markdown_signals(spark, sf_dir):
    """Each turn has its role as a heading and its lines as list items."""
    x = lambda t: F.trim(F.translate(t, _PLAIN, ""))
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda t: F.when(x(t) != "", F.concat(F.lit("- "), x(t))).otherwise(""))
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.concat(F.lit("## "), "role", F.lit("\n\n"), F.array_join(lines, "\n")).alias("text"))
    return markup.markdown_signals(c).select("doc_id", "signal", F.col("line").cast("bigint").alias("line"), F.col("level").cast("bigint").alias("level"))


_SORTS = f"""l AS (SELECT doc_id, i - 1 AS i, {_PLAIN_SQL} AS x FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents WHERE text IS NOT NULL))),
s AS (SELECT doc_id, i, length(x) AS size, CASE WHEN length(x) < 40 THEN 'heading' WHEN i % 4 = 1 THEN 'list' WHEN i % 4 = 2 THEN 'strong' END AS sort FROM l WHERE x <> ''), o AS (SELECT *, lag(sort) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM s)"""
_ENTRY = lambda name, cond: f"CASE WHEN count(*) FILTER ({cond}) > 0 THEN '\"{name}\": ' || count(*) FILTER ({cond}) END"
_MAP = lambda *entries: "'{' || concat_ws(', ', " + ", ".join(entries) + ") || '}'"
_LEVEL = lambda n: _ENTRY(str(n), f"sort = 'heading' AND 1 + size % 6 = {n}")
_BULLETS = _ENTRY("bullets", "sort = 'list' AND before IS DISTINCT FROM 'list'")


@query(f"""WITH {_SORTS} SELECT d.doc_id, 'markdown' AS format, {_MAP(_ENTRY('heading', "sort = 'heading'"), _ENTRY('list', "sort = 'list'"))} AS kinds, {_MAP(*[_LEVEL(n) for n in range(1, 7)])} AS levels,
{_MAP(_ENTRY('strong', "sort = 'strong'"))} AS emphasis, {_MAP(_BULLETS)} AS containers, CAST(0 AS BIGINT) AS n FROM documents d LEFT JOIN o USING (doc_id) WHERE text IS NOT NULL GROUP BY d.doc_id""")
def markup_details(spark, sf_dir):
    return markup.markup_inventory(markdown_view(spark, sf_dir).where("text is not null")).drop("examples")


@query(RUNS + f""", v AS (SELECT *, status || '-' || CAST(CAST(floor(total_seconds / 50) AS BIGINT) AS VARCHAR) AS c FROM runs WHERE status <> 'failure'),
a AS (SELECT doc_id, tool, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'partial_success') AS partial, count(*) FILTER (status = 'failure') AS failure, {REPEAT} - count(*) AS not_run, median(total_seconds) FILTER (status = 'success') AS median FROM runs GROUP BY doc_id, tool),
k AS (SELECT doc_id, tool, CAST(sum(n) AS BIGINT) AS v, count(*) AS k, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS equal_pairs FROM (SELECT doc_id, tool, c, count(*) AS n FROM v GROUP BY ALL) GROUP BY doc_id, tool),
w AS (SELECT doc_id, tool, max(d) AS worst FROM (SELECT l.doc_id, l.tool, levenshtein(l.c, r.c) AS d FROM v l JOIN v r ON l.doc_id = r.doc_id AND l.tool = r.tool AND l.number < r.number UNION ALL SELECT l.doc_id, r.tool, levenshtein(l.c, r.c) FROM v l JOIN v r ON l.doc_id = r.doc_id AND l.tool = 'recursive' AND r.tool = 'tree') GROUP BY doc_id, tool)
SELECT doc_id, tool, success, partial, failure, not_run, v * (v - 1) // 2 AS pairs, equal_pairs, CASE WHEN v < 2 THEN 'not comparable (' || v || ' valid)' WHEN k = 1 AND v = {REPEAT} THEN 'all {REPEAT} identical' WHEN k = 1 THEN v || ' valid identical (planned {REPEAT})' ELSE v || ' valid differ (' || k || ' kinds)' END || CASE WHEN partial > 0 THEN ', includes partial' ELSE '' END AS label,
round(median, 6) AS median, CAST(worst AS BIGINT) AS worst FROM a JOIN k USING (doc_id, tool) JOIN w USING (doc_id, tool) WHERE median IS NOT NULL""")
def comparison_report(spark, sf_dir):
    """The report's tables over two tools' runs, joined to one row a tool; what a run gave is told by its status and time."""
    r = runs_view(spark, sf_dir)
    said = F.concat("status", F.lit("-"), F.floor(F.col("total_seconds") / 50).cast("string"))
    snaps = r.select("doc_id", "tool", "number", F.to_json(F.struct(said.alias("text"), F.array(F.struct(said.alias("text"))).alias("blocks"))).alias("snapshot"))
    t = comparison.comparison(r, snaps, REPEAT, ("recursive", "tree"))
    worst = t["repeat_distances"].select("doc_id", "tool", F.col("edit_distance").alias("d")).unionByName(t["cross_tool_distances"].select("doc_id", F.lit("tree").alias("tool"), F.col("edit_distance").alias("d"))).groupBy("doc_id", "tool").agg(F.max("d").cast("bigint").alias("worst"))
    out = t["repeats"].join(t["total_seconds"].select("doc_id", "tool", "median"), ["doc_id", "tool"]).join(worst, ["doc_id", "tool"]).where("median is not null")
    whole = lambda *names: [F.col(n).cast("bigint").alias(n) for n in names]
    return out.select("doc_id", "tool", "success", "partial", "failure", *whole("not_run", "pairs", "equal_pairs"), "label", F.round("median", 6).alias("median"), "worst")


@query(r"""WITH l AS (SELECT doc_id, i - 1 AS i, trim(translate(t[i], '*_`|\<>#[]+-=~.):' || chr(9), '')) AS x FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents)))
SELECT doc_id, CASE WHEN length(x) < 40 THEN 'heading' WHEN i % 4 = 1 THEN 'list' ELSE 'formatting' END AS signal, CAST(i + 1 AS BIGINT) AS line, CASE WHEN length(x) < 40 THEN CAST(1 + length(x) % 6 AS BIGINT) END AS level
FROM l WHERE x <> '' AND (length(x) < 40 OR i % 4 = 1 OR i % 4 = 2)""")
def markdown_signals_documents(spark, sf_dir):
    """Whole documents made Markdown, marks of their own left out: short lines are headings, of the others the second in four is an item and the third is strong."""
    x = lambda t: F.trim(F.translate(t, "*_`|\\<>#[]+-=~.):\t", ""))
    made = lambda t, i: F.when(t == "", "").when(F.length(t) < 40, F.concat(F.repeat(F.lit("#"), 1 + F.length(t) % 6), F.lit(" "), t)).when(i % 4 == 1, F.concat(F.lit("- "), t)).when(i % 4 == 2, F.concat(F.lit("**"), t, F.lit("**"))).otherwise(t)
    d = table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), lambda t, i: made(x(t), i)), "\n").alias("text"))
    return markup.markdown_signals(d).select("doc_id", "signal", "line", "level")


@query(r"""SELECT doc_id, array_to_string(list_transform(string_split(text, ''), lambda c: CASE WHEN c <> '' AND contains('&<>\`*_{}[]()#+-.!|~', c) THEN '&#' || ascii(c) || ';' WHEN c IN (chr(10), chr(13)) THEN ' ' ELSE c END), '') AS escaped FROM documents""")
def markdown_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.markdown_escape(F.col("text")).alias("escaped"))


@query("""WITH p AS (SELECT page_id, html || repeat('`', CAST(page_id % 6 AS INT)) AS t FROM pages), f AS (SELECT *, repeat('`', CAST(greatest(3, 1 + coalesce(list_max(list_transform(regexp_extract_all(t, '`+'), lambda x: length(x))), 0)) AS INT)) AS fence FROM p)
SELECT page_id, sha256(fence || chr(10) || t || chr(10) || fence) AS fenced, sha256(replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;')) AS html FROM f""")
def escaping(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.concat("html", F.expr("repeat('`', int(page_id % 6))")).alias("t"))
    return p.select("page_id", F.sha2(text.code_fence(F.col("t")), 256).alias("fenced"), F.sha2(text.html_escape(F.col("t")), 256).alias("html"))


_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query(rf"SELECT doc_id, sha256(regexp_replace(text, '^{_SPACE}|{_SPACE}$', '', 'g')) AS stripped FROM documents")
def unicode_strip(spark, sf_dir):
    """White space of several kinds is put around each text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.strip(F.concat(F.lit("　  "), "text", F.lit("\x1c\n\x85\t"))), 256).alias("stripped"))


@query("SELECT doc_id, sha256(nfc_normalize(replace(replace(text || chr(13) || 'e' || chr(769) || chr(13) || chr(10), chr(13) || chr(10), chr(10)), chr(13), chr(10)))) AS h FROM documents")
def normalisation(spark, sf_dir):
    """The texts hold neither carriage returns nor combining marks, so some are put behind them."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.normalized(F.concat("text", F.lit("\re\u0301\r\n"))), 256).alias("h"))


@query("""SELECT event_id, sha256('{"a": "가' || event_type || '", "b": [1.5, 10000000000.0, null], "id": ' || event_id || '}') AS h FROM events""")
def canonical_hash(spark, sf_dir):
    """Two spellings of the same result, by turns."""
    one, other = F.lit('{"b": [1.50, 1e10, NaN], "id": '), F.lit('{"b":[1.5,10000000000.0,-Infinity],"id":')
    j = F.concat(F.when(F.col("event_id") % 2 == 0, one).otherwise(other), F.col("event_id").cast("string"), F.lit(',"a":  "가'), "event_type", F.lit('"}'))
    return table(spark, sf_dir, "events").select("event_id", canonical.content_hash(j).alias("h"))


# --- inventories and evidence ----------------------------------------------------------------------------------------

@query("""WITH p AS (SELECT 'k' AS field, json_extract(props, '$.k') AS x, json_type(props, '$.k') AS t FROM events UNION ALL SELECT 'missing', json_extract(props, '$.missing'), json_type(props, '$.missing') FROM events)
SELECT field, CASE WHEN t IS NULL THEN '필드 없음' WHEN t = 'NULL' THEN 'null' WHEN CAST(x AS VARCHAR) = 'true' THEN 'true' WHEN CAST(x AS VARCHAR) = 'false' THEN 'false' WHEN CAST(x AS VARCHAR) = '[]' THEN '빈 배열'
WHEN CAST(x AS VARCHAR) = '{}' THEN '빈 객체' WHEN CAST(x AS VARCHAR) = '""' THEN '빈 문자열' ELSE '값 있음' END AS state, count(*) AS n FROM p GROUP BY 1, 2""")
def field_states(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("ref"), F.try_parse_json("props").alias("v"))
    return inventory.field_states(inventory.observe(e, ("k", "missing")), ("field",))


_STATES = ['{}', '{"f": null}', '{"f": false}', '{"f": true}', '{"f": []}', '{"f": {}}', '{"f": ""}', '{"f": 0}', '{"f": "x"}', '{"f": {"g": 1}}']


@query("SELECT event_type, ['필드 없음', 'null', 'false', 'true', '빈 배열', '빈 객체', '빈 문자열', '값 있음', '값 있음', '값 있음'][event_id % 10 + 1] AS state, count(*) AS n FROM events GROUP BY ALL")
def eight_states(spark, sf_dir):
    j = F.get(F.array(*map(F.lit, _STATES)), (F.col("event_id") % 10).cast("int"))
    e = table(spark, sf_dir, "events").select("event_type", F.col("event_id").cast("string").alias("ref"), F.try_parse_json(j).alias("v"))
    return inventory.field_states(inventory.observe(e, ("f",)), ("event_type",)).select("event_type", "state", "n")


@query("""WITH v AS (SELECT CAST(json_extract(props, '$.k') AS VARCHAR) AS value, event_id FROM events), c AS (SELECT value, count(*) AS n, min(event_id) AS first FROM v WHERE value IS NOT NULL GROUP BY 1)
SELECT value, n FROM c QUALIFY row_number() OVER (ORDER BY n DESC, first, value) <= 8""")
def top_values(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("ref"), F.col("event_id").alias("seq"), F.try_parse_json("props").alias("v"))
    inv = inventory.field_inventory(inventory.observe(e, ("k",)), ("field",), examples=False)
    return inv.select(F.explode("value_counts").alias("x")).select("x.value", "x.n")


def featured_view(spark, sf_dir) -> DataFrame:
    """(doc_id, raw): results of documents with levels, formatting and places on some lines, tables, pictures and names in some documents."""
    d, n = F.col("doc_id"), F.size(F.split("text", "\n"))
    short = lambda t: F.length(t) < 40
    item = lambda t, i: F.struct(
        F.when(short(t), "section_header").otherwise("text").alias("label"), F.when(short(t), 1 + F.length(t) % 3).alias("level"), t.alias("text"),
        F.when(i % 4 == 1, F.struct((i % 8 == 1).alias("bold"))).alias("formatting"), F.when(i % 3 == 1, F.array(F.struct(i.alias("page_no")))).alias("prov"),
    )
    one = lambda some, *fields: F.when(some, F.array(F.struct(*fields)))
    cells = F.array(F.struct(F.lit("x").alias("text"), n.alias("col_span")))
    return _trees(
        spark, sf_dir, item, name=F.when(d % 2 == 0, F.concat(F.lit("n"), d.cast("string"))),
        tables=one(d % 3 == 0, F.lit("#/tables/0").alias("self_ref"), F.lit("table").alias("label"), F.struct(F.lit(1).alias("num_rows"), F.lit(1).alias("num_cols"), cells.alias("table_cells")).alias("data")),
        pictures=one(d % 5 == 0, F.lit("#/pictures/0").alias("self_ref"), F.lit("picture").alias("label")),
    )


@query(f"""WITH {_ITEMS}, d AS (SELECT doc_id, count(*) AS n, count(*) FILTER (label = 'section_header') AS heads FROM i GROUP BY doc_id)
SELECT doc_id, unnest(['classification', 'hierarchy', 'formatting', 'location', 'metadata']) AS category, unnest([true, true, n > 1, n > 1, doc_id % 2 = 0]) AS provided FROM d UNION ALL SELECT doc_id, 'headings', true FROM d WHERE heads > 0
UNION ALL SELECT doc_id, 'tables', true FROM d WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'resources', true FROM d WHERE doc_id % 3 = 0 OR doc_id % 5 = 0""")
def tree_features(spark, sf_dir):
    f = inventory.tree_features(featured_view(spark, sf_dir))
    return inventory.provided(f.where("decides"), ("doc_id", "category"))


@query(f"""WITH {_ITEMS}, o AS (SELECT doc_id, n, 'headings' AS category, 'level' AS field, CAST(1 + length(text) % 3 AS VARCHAR) AS v FROM i WHERE label = 'section_header'
  UNION ALL SELECT doc_id, n, 'formatting', 'formatting.bold', CASE WHEN n % 8 = 1 THEN 'true' WHEN n % 4 = 1 THEN 'false' END FROM i UNION ALL SELECT doc_id, n, 'location', 'page_no', CAST(n AS VARCHAR) FROM i WHERE n % 3 = 1
  UNION ALL SELECT doc_id, 0, 'tables', 'col_span', CAST(count(*) AS VARCHAR) FROM i WHERE doc_id % 3 = 0 GROUP BY doc_id),
s AS (SELECT doc_id, category, field, CAST(sum(n) AS BIGINT) AS targets, string_agg(state || '=' || n, ',' ORDER BY state) AS states FROM (SELECT doc_id, category, field, CASE WHEN v IS NULL THEN '필드 없음' WHEN v IN ('true', 'false') THEN v ELSE '값 있음' END AS state, count(*) AS n FROM o GROUP BY ALL) GROUP BY ALL),
v AS (SELECT doc_id, category, field, string_agg(v || '=' || n, ',' ORDER BY r) AS value_counts FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, category, field ORDER BY n DESC, first) AS r FROM (SELECT doc_id, category, field, v, count(*) AS n, min(n) AS first FROM o WHERE v IS NOT NULL GROUP BY ALL)) WHERE r <= 8 GROUP BY ALL)
SELECT doc_id, category, field, targets, states, value_counts FROM s LEFT JOIN v USING (doc_id, category, field)""")
def feature_inventory(spark, sf_dir):
    f = inventory.tree_features(featured_view(spark, sf_dir))
    inv = inventory.field_inventory(f, ("doc_id", "category", "field"), examples=False).where("(category, field) in (('headings', 'level'), ('tables', 'col_span'), ('formatting', 'formatting.bold'), ('location', 'page_no'))")
    pairs = lambda c, k, n: F.array_join(F.transform(c, lambda x: F.concat(x[k], F.lit("="), x[n].cast("string"))), ",")
    return inv.select("doc_id", "category", "field", F.col("targets").cast("bigint").alias("targets"), pairs(F.map_entries("states"), "key", "value").alias("states"), pairs(F.col("value_counts"), "value", "n").alias("value_counts"))


@query(rf"""WITH p AS (SELECT page_id AS doc_id, page_id % 2 = 0 AS inner_, {_BARE} AS b FROM pages WHERE html IS NOT NULL)
SELECT doc_id, category, true AS provided FROM (SELECT doc_id, unnest(['classification', 'headings', 'tables', 'formatting', 'hierarchy', 'resources', 'metadata']) AS category,
unnest([inner_ OR regexp_matches(b, '(?i)<(h[1-6]|li|table|pre)[ >]'), inner_ OR regexp_matches(b, '(?i)<h[1-6][ >]'), regexp_matches(b, '(?i)<table[ >]'), inner_ OR regexp_matches(b, '(?i)<(strong|b|em|i|u)[ >]'), inner_ OR regexp_matches(b, '(?i)<(ul|ol|blockquote)[ >]'), inner_, true]) AS provided FROM p) WHERE provided""")
def resource_features(spark, sf_dir):
    res = inventory.resources(recursive_view(spark, sf_dir))
    f = inventory.resource_features(res, markup.markup_blocks(res, "doc_id", "content"), markup.html_tags(res, "doc_id", "content"))
    return f.where("provided")


def recursive_view(spark, sf_dir) -> DataFrame:
    """(doc_id, raw): pages as recursive results; those with an even id hold an image's text."""
    content = F.concat(F.lit("# image"), F.col("page_id").cast("string"), F.lit(".png\n\n**bold**\n"))
    field = lambda key, value: F.concat(F.to_json(F.array(F.lit(key))).substr(F.lit(2), F.length(F.to_json(F.array(F.lit(key)))) - 2), F.lit(": "), value)
    said = lambda c: F.expr(f"substr(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
    root = F.concat_ws(", ", field("tk:content", said("html")), field("url", said("url")), field("xmpTPg:NPages", (F.col("page_id") % 9).cast("string")), field("dotted.key", F.lit("false")))
    inner = F.concat(F.lit(', {"tk:resource-name": "image.png", "tk:embedded-depth": 1, "X-TIKA:content": '), F.to_json(F.array(content)).substr(F.lit(2), F.length(F.to_json(F.array(content))) - 2), F.lit("}"))
    return table(spark, sf_dir, "pages").where("html is not null").select(F.col("page_id").alias("doc_id"), F.concat(F.lit("[{"), root, F.lit("}"), F.when(F.col("page_id") % 2 == 0, inner).otherwise(""), F.lit("]")).alias("raw"))


@query("""SELECT page_id AS doc_id, unnest([0, 0, 0]) AS idx, unnest(['url', 'xmpTPg:NPages', 'dotted.key']) AS key, unnest(['"' || url || '"', CAST(page_id % 9 AS VARCHAR), 'false']) AS value, unnest([false, true, false]) AS about_pages FROM pages WHERE html IS NOT NULL
UNION ALL SELECT page_id, unnest([1, 1]), unnest(['tk:resource-name', 'tk:embedded-depth']), unnest(['"image.png"', '1']), false FROM pages WHERE html IS NOT NULL AND page_id % 2 = 0""")
def resource_metadata(spark, sf_dir):
    return inventory.resource_metadata(inventory.resources(recursive_view(spark, sf_dir)))


@query("""SELECT page_id AS doc_id, CAST(CASE WHEN page_id % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n_blocks, sha256(html || CASE WHEN page_id % 2 = 0 THEN chr(10) || '# image' || page_id || '.png' || chr(10) || chr(10) || '**bold**' || chr(10) ELSE '' END) AS content, CAST(page_id % 9 AS VARCHAR) AS pages FROM pages WHERE html IS NOT NULL""")
def resource_snapshot(spark, sf_dir):
    s = references.snapshots(recursive_view(spark, sf_dir))
    return s.select("doc_id", F.col("n_blocks").cast("bigint").alias("n_blocks"), F.sha2("text", 256).alias("content"), "pages")


@query(f"""WITH {_ITEMS}, d AS (SELECT doc_id, count(*) AS n, count(*) FILTER (label = 'section_header') AS heads, count(DISTINCT label) AS kinds FROM i GROUP BY doc_id),
c AS (SELECT doc_id, unnest(['classification', 'headings', 'hierarchy', 'formatting', 'tables', 'location', 'metadata', 'resources']) AS category,
  unnest([least(3, kinds + CAST(doc_id % 3 = 0 AS INT) + CAST(doc_id % 5 = 0 AS INT)), least(3, heads), 1, least(3, (n + 2) // 4), CAST(doc_id % 3 = 0 AS INT), least(3, (n + 1) // 3), CAST(doc_id % 2 = 0 AS INT), CAST(doc_id % 5 = 0 AS INT)]) AS n FROM d)
SELECT doc_id, category, CAST(n AS BIGINT) AS n FROM c WHERE n > 0""")
def excerpt_counts(spark, sf_dir):
    return evidence.excerpts(featured_view(spark, sf_dir)).groupBy("doc_id", "category").agg(F.count("*").alias("n"))


@query(f"""WITH {_ITEMS}, f AS (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n % 8 <> 1, n) - 1 AS seq FROM i WHERE n % 4 = 1), o AS (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS seq FROM i WHERE n % 3 = 1)
SELECT doc_id, 'formatting' AS category, CAST(seq AS INT) AS seq, '#/texts/' || n AS source, CASE WHEN n % 8 = 1 THEN '{{"bold":true}}' ELSE '{{"bold":false}}' END AS shown FROM f WHERE seq < 3
UNION ALL SELECT doc_id, 'location', CAST(seq AS INT), '#/texts/' || n, '[{{"page_no":' || n || '}}]' FROM o WHERE seq < 3
UNION ALL SELECT doc_id, 'metadata', 0, '#', 'n' || doc_id FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 0
UNION ALL SELECT doc_id, 'resources', 0, '#/pictures/0', 'picture' FROM documents WHERE text IS NOT NULL AND doc_id % 5 = 0""")
def excerpts(spark, sf_dir):
    """Of each excerpt what it is there for; formatted texts that set something come first."""
    e = evidence.excerpts(featured_view(spark, sf_dir)).where("category in ('formatting', 'location', 'metadata', 'resources')")
    part = lambda category, path: F.when(F.col("category") == category, F.get_json_object("content", path))
    return e.select("doc_id", "category", "seq", "source", F.coalesce(part("formatting", "$.formatting"), part("location", "$.prov"), part("metadata", "$.name"), part("resources", "$.label")).alias("shown"))


# --- cards ---------------------------------------------------------------------------------------------------------

def card_bundle(**change) -> dict:
    card = {"id": "c1", "document_id": "d1", "document_sha256": "s1", "kind": "tables", "title": "t", "reason": "", "source_location": "", "note": "", "original_checked": None}
    card |= {"tree": {"format": "json", "content": '{"texts": [{"text": "x"}]}', "run": 1, "source_file": "f", "source_refs": ["#/texts/0"]}, "recursive": None}
    extra = change.pop("again", 0)
    card |= change.pop("card", {})
    card["tree"] = card["tree"] | change.pop("tree", {}) if isinstance(card["tree"], dict) else card["tree"]
    return {"schema": "quillon.cards", "version": 1, "cards": [card] * (1 + extra)} | change


_BUNDLES = [card_bundle(), card_bundle(version=True), card_bundle(card={"document_sha256": "no"}), card_bundle(card={"kind": "odd"}), card_bundle(card={"title": " "}), card_bundle(card={"original_checked": "yes"}), card_bundle(card={"tree": None}), card_bundle(again=1), card_bundle(tree={"run": 9}), card_bundle(tree={"format": "xml"}), card_bundle(tree={"content": "{} x"}), card_bundle(tree={"content": "3"}), card_bundle(tree={"content": "[NaN]"}), card_bundle(tree={"content": '{"texts": null}'}), card_bundle(tree={"source_refs": [1]}), card_bundle(schema="other"), card_bundle(again=200), card_bundle(card={"reason": 3}), card_bundle(tree={"content": '{"document": false}'}), card_bundle(card={"recursive": {"format": "json", "content": '[{"tk:content": 1}]', "source_file": "", "source_refs": []}})]
_PROBLEMS = [None, "version", "unknown document", "id, title or kind", "id, title or kind", "original_checked", "no evidence", "repeated id", "tree run", "tree format", "tree json", "tree json", "tree json", "tree json", "tree source", "schema", "too many cards", "a text field is missing", "tree json", "recursive json"]


@query("SELECT doc_id AS bundle, [" + ", ".join("NULL" if p is None else f"'{p}'" for p in _PROBLEMS) + f"][doc_id % {len(_PROBLEMS)} + 1] AS problem FROM documents WHERE text IS NOT NULL")
def card_validation(spark, sf_dir):
    """A bundle for each document, right or wrong in one of twenty ways."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.sha2("text", 256).alias("sha256"))
    made = F.get(F.array(*[F.lit(json.dumps(x)) for x in _BUNDLES]), (F.col("doc_id") % len(_BUNDLES)).cast("int"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    b = d.select(F.col("doc_id").alias("bundle"), F.replace(F.replace(made, F.lit('"d1"'), quoted("id")), F.lit('"s1"'), quoted("sha256")).alias("text"))
    known = d.select("id", "sha256", F.array(F.lit(1), F.lit(2)).alias("runs_tree"), F.array(F.lit(1)).alias("runs_recursive"))
    return cards.validate(b, known, ("tree", "recursive")).select("bundle", "problem")


@query("SELECT 'n' || n_nationkey AS id, '{\"title\": \"' || n_name || '\"}' AS json FROM nation")
def card_merge(spark, sf_dir):
    """Nations stand for cards, of which a bundle holds few."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit('{"title": "'), "n_name", F.lit('"}')).alias("json"))
    return cards.merge(n.where("n_nationkey % 2 = 0").drop("n_nationkey"), n.where("n_nationkey % 2 = 1").drop("n_nationkey"))


# --- chunks and vectors ----------------------------------------------------------------------------------------------

#: Tokens of a chunk, and of what it repeats from the one before.
LIMIT, OVERLAP = 64, 16

_TOKENS = f"{_LINES}, t AS (SELECT doc_id, seq, CASE WHEN trim(text) = '' THEN 0 ELSE len(regexp_split_to_array(trim(text), '\\s+')) END AS tokens FROM l)"


@query(f"""WITH RECURSIVE {_TOKENS},
d AS (SELECT doc_id, list(seq ORDER BY seq) AS q, list(tokens ORDER BY seq) AS t, list(p ORDER BY seq) AS p FROM (SELECT *, CAST(sum(tokens) OVER (PARTITION BY doc_id ORDER BY seq) AS BIGINT) AS p FROM t) GROUP BY doc_id),
c AS (
  SELECT doc_id, q, t, p, 0 AS chunk, 1 AS x, 1 AS s, greatest(1, len(list_filter(p, lambda y: y <= {LIMIT}))) AS e FROM d
  UNION ALL
  SELECT doc_id, q, t, p, chunk + 1, x, s, list_max(list_filter(range(s, len(t) + 1), lambda j: j = s OR p[j] - p[x] + t[x] <= {LIMIT})) FROM (
    SELECT doc_id, q, t, p, chunk, e + 1 AS s, coalesce(list_min(list_filter(range(s, e + 1), lambda j: t[j] > 0 AND p[e] - p[j] + t[j] <= least({OVERLAP}, {LIMIT} - t[e + 1]))), e + 1) AS x
    FROM c WHERE e < len(t)))
SELECT doc_id, CAST(q[i] AS BIGINT) AS seq, CAST(t[i] AS BIGINT) AS tokens, CAST(chunk AS BIGINT) AS chunk, t[i] > {LIMIT} AS over, i < s AS context FROM (SELECT *, unnest(range(x, e + 1)) AS i FROM c)""")
def chunk_blocks(spark, sf_dir):
    c = chunks.chunk_by_tokens(lines_view(spark, sf_dir), LIMIT, overlap=OVERLAP)
    return c.select("doc_id", F.col("seq").cast("bigint").alias("seq"), "tokens", "chunk", "over", "context")


@query(f"WITH {_LINES} SELECT doc_id, {', '.join(f'CAST(0 AS BIGINT) AS {c}' for c in ('lost', 'repeated', 'over_limit', 'gaps', 'mixed', 'bad_context'))} FROM l GROUP BY doc_id")
def chunk_invariants(spark, sf_dir):
    v = lines_view(spark, sf_dir)
    return chunks.chunk_problems(v, chunks.chunk_by_tokens(v, LIMIT, overlap=OVERLAP), limit=LIMIT, overlap=OVERLAP)


#: Tokens of the head "| line | text |" and "|---|---|" of a table.
HEAD = 6


@query(f"""WITH RECURSIVE r AS (SELECT doc_id, [5, 1] || list_transform(t, lambda x: 4 + len(list_filter(string_split(translate(x, '\\|`' || chr(9), ''), ' '), lambda w: w <> ''))) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents WHERE text IS NOT NULL)),
d AS (SELECT doc_id, t, list_transform(range(1, len(t) + 1), lambda j: list_sum(t[1:j])) AS p FROM r),
c AS (
  SELECT doc_id, t, p, 0 AS chunk, 1 AS s, 0 AS h, greatest(1, len(list_filter(p, lambda y: y <= {LIMIT}))) AS e FROM d
  UNION ALL
  SELECT doc_id, t, p, chunk + 1, s, h, list_max(list_filter(range(s, len(t) + 1), lambda j: j = s OR h + p[j] - p[s] + t[s] <= {LIMIT})) FROM (SELECT doc_id, t, p, chunk, e + 1 AS s, CASE WHEN e >= 2 AND {HEAD} + t[e + 1] <= {LIMIT} THEN {HEAD} ELSE 0 END AS h FROM c WHERE e < len(t)))
SELECT doc_id, CAST(chunk AS BIGINT) AS chunk, CAST(s - 1 AS BIGINT) AS first, CAST(e - 1 AS BIGINT) AS last, h > 0 AS has_head, CAST(h + p[e] - p[s] + t[s] AS BIGINT) AS tokens FROM c""")
def line_chunk_tables(spark, sf_dir):
    """Each document as a Markdown table with a row for each line."""
    rows = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("| "), i.cast("string"), F.lit(" | "), F.trim(F.translate(x, "\\|`\t", "")), F.lit(" |")))
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("| line | text |\n|---|---|\n"), F.array_join(rows, "\n")).alias("text"))
    c = chunks.line_chunks(d, LIMIT)
    return c.select("doc_id", "chunk", "first", "last", F.col("head").isNotNull().alias("has_head"), chunks.count_tokens(F.col("text")).alias("tokens"))


def items_view(spark, sf_dir) -> DataFrame:
    """Lines as items: short ones are headings of level 1 to 3, of the others each fifth length is a list item's."""
    n = F.length("text")
    label = F.when(n < 40, "section_header").when(n % 5 == 0, "list_item").otherwise("text")
    return lines_view(spark, sf_dir).select("doc_id", "seq", F.concat(F.lit("#/texts/"), F.col("seq").cast("string")).alias("ref"), label.alias("label"), F.when(n < 40, 1 + n % 3).alias("level"), "text")


@query(f"""WITH {_LINES},
i AS (SELECT doc_id, seq, text, CASE WHEN length(text) < 40 THEN 'section_header' WHEN length(text) % 5 = 0 THEN 'list_item' ELSE 'text' END AS label, CASE WHEN length(text) < 40 THEN 1 + length(text) % 3 END AS level FROM l),
h AS (SELECT doc_id, seq, text, level FROM i WHERE level IS NOT NULL),
over_ AS (SELECT h.doc_id, h.seq AS pos, h.text, h.level, coalesce(min(n.seq), 1000000000) AS until FROM h LEFT JOIN h n ON n.doc_id = h.doc_id AND n.seq > h.seq AND n.level <= h.level GROUP BY ALL),
g AS (SELECT *, seq - row_number() OVER (PARTITION BY doc_id, label = 'list_item' ORDER BY seq) AS run FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS place, seq AS pos, text, label, level, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS seq FROM i)),
b AS (SELECT doc_id, min(pos) AS first, any_value(label) AS label, string_agg(text, chr(10) ORDER BY pos) AS text, string_agg('#/texts/' || pos, ',' ORDER BY pos) AS body FROM g WHERE level IS NULL GROUP BY doc_id, CASE WHEN label = 'list_item' THEN run ELSE -place END, label)
SELECT b.doc_id, CAST(row_number() OVER (PARTITION BY b.doc_id ORDER BY first) - 1 AS BIGINT) AS chunk, b.label, b.text,
       coalesce(string_agg(o.text, ' > ' ORDER BY o.level), '') AS headings, body AS body_refs, coalesce(string_agg('#/texts/' || o.pos, ',' ORDER BY o.level), '') AS context_refs
FROM b LEFT JOIN over_ o ON o.doc_id = b.doc_id AND o.pos < b.first AND b.first < o.until GROUP BY b.doc_id, first, b.label, b.text, body""")
def section_chunk_documents(spark, sf_dir):
    c = chunks.section_chunks(items_view(spark, sf_dir), levels=3)
    return c.select("doc_id", "chunk", "label", "text", F.array_join("headings", " > ").alias("headings"), F.array_join("body_refs", ",").alias("body_refs"), F.array_join("context_refs", ",").alias("context_refs"))


@query("SELECT label AS chunk, CAST(d - 1 AS INT) AS dim, round(avg(CAST(embedding[d] AS DOUBLE)), 6) AS mean FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS d FROM embeddings) GROUP BY 1, 2")
def span_mean_pool(spark, sf_dir):
    p = chunks.pool_vectors(table(spark, sf_dir, "embeddings"), "label")
    return p.select(F.col("label").alias("chunk"), "dim", F.round("mean", 6).alias("mean"))


_RUN = "e AS (SELECT vec_id // 100 AS doc, vec_id % 100 AS pos, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


@query(f"""WITH {_RUN}, n AS (SELECT doc, max(pos) + 1 AS n FROM e GROUP BY doc),
w AS (SELECT doc, s, least(s + 32, n) AS t FROM n, (SELECT unnest(range(0, 100, 24)) AS s) WHERE s < greatest(n - 8, 1))
SELECT w.doc, s AS w_start, t AS w_end, i - 1 AS dim, count(*) AS n, round(avg(v[i]), 6) AS mean FROM w JOIN e ON e.doc = w.doc AND pos >= s AND pos < t, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL""")
def span_pool(spark, sf_dir):
    """A hundred vectors are a document's tokens; spans are windows of 32 that overlap by 8."""
    e = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 100").alias("doc"), (F.col("vec_id") % 100).alias("pos"), "embedding")
    spans = e.groupBy("doc").agg((F.max("pos") + 1).cast("int").alias("n")).select("doc", F.explode(chunks.macro_windows(F.col("n"), 32, 8)).alias("w")).select("doc", "w.*")
    p = chunks.pool_spans(e, spans, 64, "doc")
    return p.select("doc", F.col("start").alias("w_start"), F.col("end").alias("w_end"), "n", F.posexplode("mean").alias("dim", "mean")).select("doc", "w_start", "w_end", F.col("dim").cast("bigint").alias("dim"), "n", F.round("mean", 6).alias("mean"))


@query("""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT v.vec_id, a.vec_id AS anchor, a.label, list_cosine_similarity(v.e, a.e) AS score FROM v JOIN v a ON a.vec_id % 10 = 0),
k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, anchor) <= 5),
g AS (SELECT vec_id, label, count(*) AS n, sum(score) AS s, max(score) AS best FROM k GROUP BY 1, 2)
SELECT vec_id, CAST(label AS VARCHAR) AS label, round(best, 6) AS score FROM g QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, s DESC, CAST(label AS VARCHAR) DESC) = 1""")
def knn_label(spark, sf_dir):
    """Anchors are the vectors whose id is divisible by 10."""
    v = table(spark, sf_dir, "embeddings")
    k = chunks.nearest_anchors(v, v.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "anchor_id"), 5)
    return k.select("vec_id", "label", F.round("score", 6).alias("score"))


@query("""SELECT conv_id, turn, CASE WHEN role = 'user' AND lag(role) OVER w = lead(role) OVER w AND lag(role) OVER w <> 'user' THEN lag(role) OVER w ELSE role END AS resolved
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def context_resolution(spark, sf_dir):
    """A user's turn is the unknown label here."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return chunks.fill_between(c, "conv_id", "turn", "role", "user").select("conv_id", "turn", "resolved")


@query("""WITH r AS (SELECT lang AS t, CASE WHEN doc_id % 7 = 0 THEN 'UNKNOWN' WHEN doc_id % 5 = 0 THEN 'en' ELSE lang END AS g FROM documents),
k AS (SELECT t AS label FROM r UNION SELECT g FROM r), c AS (SELECT label, (SELECT count(*) FROM r WHERE t = label AND g = label) AS hit, (SELECT count(*) FROM r WHERE t = label) AS is_, (SELECT count(*) FROM r WHERE g = label) AS said FROM k WHERE label <> 'UNKNOWN'),
p AS (SELECT label, is_, CASE WHEN said > 0 THEN hit / said ELSE 0 END AS p, CASE WHEN is_ > 0 THEN hit / is_ ELSE 0 END AS r FROM c), f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM p)
SELECT label, round(p, 6) AS "precision", round(r, 6) AS recall, round(f1, 6) AS f1, round((SELECT avg(CASE WHEN t = g THEN 1e0 ELSE 0e0 END) FROM r), 6) AS accuracy, round((SELECT avg(f1) FROM f WHERE is_ > 0), 6) AS macro_f1, round((SELECT avg(CASE WHEN g = 'UNKNOWN' THEN 1e0 ELSE 0e0 END) FROM r), 6) AS unknown_rate FROM f""")
def label_metrics(spark, sf_dir):
    """A document's language, said wrong or not known for some."""
    k = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("truth"), F.when(k % 7 == 0, "UNKNOWN").when(k % 5 == 0, "en").otherwise(F.col("lang")).alias("guess"))
    m = chunks.label_metrics(d)
    return m.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy", "macro_f1", "unknown_rate")])


@query("""WITH a AS (SELECT doc_id, 1 AS rank, lang AS value FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 2, source FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id, 3, CASE WHEN doc_id % 2 = 0 THEN source ELSE lang END FROM documents)
SELECT doc_id, min_by(value, rank) AS value, CASE WHEN min(rank) = 1 THEN 'confirmed' WHEN count(DISTINCT value) = 1 THEN 'candidate' ELSE 'unresolved' END AS state FROM a GROUP BY doc_id""")
def annotation_policies(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    said = lambda policy, value, some: d.where(some).select("doc_id", F.lit(policy).alias("policy"), F.expr(value).alias("value"))
    a = said("native", "lang", "doc_id % 3 = 0").unionByName(said("numbering", "source", "doc_id % 5 <> 0")).unionByName(said("style", "if(doc_id % 2 = 0, source, lang)", "true"))
    return chunks.resolve_annotations(a, keys=("doc_id",))


@query("SELECT doc_id, s AS w_start, least(s + 512, n_chars) AS w_end FROM (SELECT doc_id, n_chars, unnest(range(0, greatest(0, n_chars - 64 - 1) + 1, 448)) AS s FROM documents)")
def macro_windows(spark, sf_dir):
    """Characters stand for tokens."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(chunks.macro_windows(F.col("n_chars"), 512, 64)).alias("w"))
    return d.select("doc_id", F.col("w.start").cast("bigint").alias("w_start"), F.col("w.end").cast("bigint").alias("w_end"))
