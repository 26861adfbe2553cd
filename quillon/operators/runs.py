"""Runs of extraction tools: schedule, status, selection and timing.

A run is (doc_id, tool, number, status, total_seconds, internal_seconds, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.staging import Rounds

VALID = ("success", "partial_success")


def schedule(docs: DataFrame, tools: tuple[str, str], repeat: int, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, number, tool, position): odd runs take the tools in order, even ones in reverse; the rows of a document."""
    plan = docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.sequence(F.lit(1), F.lit(repeat))).alias("number"))
    order = F.when(F.col("number") % 2 == 1, F.array(*map(F.lit, tools))).otherwise(F.array(*map(F.lit, reversed(tools))))
    plan = plan.select("doc_id", "number", F.posexplode(order).alias("i", "tool"))
    return plan.select("doc_id", "number", "tool", ((F.col("number") - 1) * len(tools) + F.col("i") + 1).alias("position"))


def pending(plan: DataFrame, recorded: DataFrame) -> DataFrame:
    """What of the plan is not recorded yet."""
    return plan.join(recorded.select("doc_id", "tool", "number"), ["doc_id", "tool", "number"], "left_anti")


def status(reported: Column, timeout: Column, exit_code: Column) -> Column:
    """A timeout or a non-zero exit is a failure whatever was reported; else that, in lower case."""
    return F.when(F.coalesce(timeout, F.lit(False)) | (F.coalesce(exit_code, F.lit(0)) != 0), "failure").otherwise(F.lower(F.coalesce(reported, F.lit("unknown"))))


def error_details(errors: Column) -> Column:
    """Messages of an array of struct<error_message, message>, joined by "; "; empty ones are left out."""
    texts = F.transform(errors, lambda e: F.coalesce(F.nullif(e["error_message"], F.lit("")), F.nullif(e["message"], F.lit("")), F.lit("")))
    return F.array_join(F.filter(texts, lambda t: t != ""), "; ")


def reports_partial(root: Column) -> Column:
    """Whether a map<string, variant> of metadata tells of an exception or a limit reached, with a value that says so."""
    said = F.filter(F.map_entries(root), lambda e: F.lower(e["key"]).rlike("exception|limit-reached") & ~F.coalesce(F.to_json(e["value"]), F.lit("null")).isin("false", '"false"', "[]", '""', "null", "0", "0.0"))
    return F.coalesce(F.size(said) > 0, F.lit(False))


def internal_seconds_of_times(times: Column) -> Column:
    """Sum of an array of seconds, null for none."""
    return F.when(F.size(times) > 0, F.aggregate(times, F.lit(0.0), lambda a, x: a + x))


def internal_seconds_of_millis(root_millis: Column) -> Column:
    """The root's milliseconds in seconds; those of embedded resources are in it already."""
    return root_millis.cast("double") / 1000


def representative(runs: DataFrame, keys: tuple[str, ...] = ("doc_id", "tool")) -> DataFrame:
    """The run that stands for a document and tool: the first success, else the first partial success."""
    order = Window.partitionBy(*keys).orderBy(F.col("status") != "success", "number")
    return runs.where(F.col("status").isin(*VALID)).withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def display(runs: DataFrame, snapshots: DataFrame, keys: tuple[str, ...] = ("doc_id", "tool")) -> DataFrame:
    """The same among runs that have a snapshot."""
    return representative(runs.join(snapshots.select(*keys, "number"), [*keys, "number"], "left_semi"), keys)


#: Ranges that a round of medians() counts a key's values in.
RANGES = 1024


def medians(values: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """keys, median: the exact median of the numbers of each key, the mean of the middle two of an even number.

    By selection: each round counts a key's values in RANGES equal ranges, combined before the shuffle, and goes on in the range in which the middle
    one lies, until that has a single value.  So a key's values are never gathered, however few keys there are; a round passes over the
    table and its result is written.  Nulls and NaN are left out; a key without numbers has no row."""
    rows = values.select(*keys, F.col(value).cast("double").alias("x")).where("x is not null and not isnan(x)")
    finite = F.when(F.abs("x") < float("inf"), F.col("x"))
    rounds = Rounds(values.sparkSession, "medians")
    ends = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(finite).alias("low"), F.max(finite).alias("high"))
    middle = F.array(F.floor((F.col("n") + 1) / 2).cast("bigint"), F.floor(F.col("n") / 2 + 1).cast("bigint"))
    todo = rounds.add(ends.select(*keys, F.posexplode(middle).alias("which", "rank"), F.coalesce("low", F.lit(0.0)).alias("low"), F.coalesce("high", F.lit(0.0)).alias("high"), F.lit(0).cast("bigint").alias("below"), F.lit(False).alias("found")))
    while not todo.where("not found").isEmpty():
        open_ = todo.where("not found").select(*[F.col(k).alias(f"__{k}") for k in keys], "which", "rank", "low", "high", "below")
        met = rows.join(open_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
        inside = (F.col("x") >= F.col("low")) & (F.col("x") <= F.col("high"))
        share = F.coalesce(F.try_divide(F.col("x") / 2 - F.col("low") / 2, F.col("high") / 2 - F.col("low") / 2), F.lit(0.0))
        first = F.col("below") == 0  # infinite numbers lie outside of the first round's ends
        at = F.when(inside, F.least(F.floor(share * RANGES), F.lit(RANGES - 1))).when(first & (F.col("x") == -float("inf")), -1).when(F.col("x") == float("inf"), RANGES)
        counted = met.withColumn("at", at.cast("int")).where("at is not null").groupBy(*keys, "which", "rank", "below", "at").agg(F.count("*").alias("c"), F.min("x").alias("low"), F.max("x").alias("high"))
        so_far = Window.partitionBy(*keys, "which").orderBy("at")
        upto = counted.withColumn("upto", F.col("below") + F.sum("c").over(so_far))
        todo = rounds.add(upto.where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("c") < F.col("rank"))).select(*keys, "which", "rank", "low", "high", (F.col("upto") - F.col("c")).alias("below"), (F.col("low") == F.col("high")).alias("found")))
    return rounds.all().where("found").groupBy(*keys).agg((F.sum(F.col("low") / 2)).alias("median"))


def time_statistics(runs: DataFrame, field: str, keys: tuple[str, ...] = ("tool",), decimals: int | None = None) -> DataFrame:
    """keys, median, least, most, n and a text over full successes with a number; every key has a row."""
    decimals = decimals if decimals is not None else 2 if field == "total_seconds" else 3
    value = F.when((F.col("status") == "success") & ~F.isnan(F.col(field).cast("double")), F.col(field).cast("double"))
    valued = runs.select(*keys, value.alias("__x"))
    out = valued.groupBy(*keys).agg(F.min("__x").alias("least"), F.max("__x").alias("most"), F.count("__x").alias("n"))
    middle = medians(valued, keys, "__x").select(*[F.col(k).alias(f"__{k}") for k in keys], "median")
    out = out.join(middle, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left").select(*keys, "median", "least", "most", "n")
    f = f"%.{decimals}f"
    said = F.format_string(f"median {f}s, range {f}-{f}s, n=%d", "median", "least", "most", "n")
    return out.withColumn("text", F.when(F.col("n") > 0, said).otherwise("no complete success"))


def status_counts(runs: DataFrame, repeat: int, keys: tuple[str, ...] = ("doc_id", "tool")) -> DataFrame:
    """keys, success, partial, failure, not_run."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    return runs.groupBy(*keys).agg(is_("success").alias("success"), is_("partial_success").alias("partial"), is_("failure").alias("failure"), (F.lit(repeat) - F.count("*")).alias("not_run"))


def repeat_label(valid: Column, kinds: Column, partial: Column, repeat: int) -> Column:
    """What repeated runs show: too few, all identical, some identical, different."""
    n = valid.cast("string")
    said = (
        F.when(valid < 2, F.concat(F.lit("not comparable ("), n, F.lit(" valid)")))
        .when((kinds == 1) & (valid == repeat), F.lit(f"all {repeat} identical"))
        .when(kinds == 1, F.concat(n, F.lit(f" valid identical (planned {repeat})")))
        .otherwise(F.concat(n, F.lit(" valid differ ("), kinds.cast("string"), F.lit(" kinds)")))
    )
    return F.concat(said, F.when(partial > 0, ", includes partial").otherwise(""))


def any_failed(runs: DataFrame) -> DataFrame:
    """One row: exit_code 1 if any run is not a full success."""
    return runs.agg(F.coalesce(F.bool_or(F.col("status") != "success"), F.lit(False)).cast("int").alias("exit_code"))


def resume_mismatches(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(name, expected, actual) of fingerprints that forbid a resume: other values, or there on one side alone."""
    e, a = expected.select("name", F.col("value").alias("expected")), actual.select("name", F.col("value").alias("actual"))
    return e.join(a, "name", "full").where(~F.col("expected").eqNullSafe(F.col("actual")))


def same_ocr(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether two OCR settings mean the same: command, data path, languages in any order, mode as text, and not skipped."""
    languages = lambda c: F.array_sort(F.array_distinct(F.split(c, r"\+")))
    return (a["command"].eqNullSafe(b["command"])) & a["path"].eqNullSafe(b["path"]) & (languages(a["language"]) == languages(b["language"])) & (a["mode"].cast("string") == b["mode"].cast("string")) & (F.coalesce(b["skip"], F.lit(True)) == F.lit(False))


def record(spark: SparkSession, runs: DataFrame, path: str) -> None:
    """Appends runs to the table at ``path``; what it has already is not written again."""
    try:
        known = spark.read.parquet(path).select("doc_id", "tool", "number")
        runs = runs.join(known, ["doc_id", "tool", "number"], "left_anti")
    except Exception as e:  # noqa: BLE001 - the first append finds no table
        if "PATH_NOT_FOUND" not in str(e):
            raise
    runs.write.mode("append").parquet(path)
