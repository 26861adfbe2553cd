"""The comparison report as tables: from runs and their snapshots to statistics, stability and distances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import content_hash
from ..operators import compare, runs
from ..sources.staging import Rounds


def comparison(all_runs: DataFrame, snapshots: DataFrame, repeat: int, tools: tuple[str, str]) -> dict[str, DataFrame]:
    """``all_runs`` (doc_id, tool, number, status, total_seconds, internal_seconds), ``snapshots`` (doc_id, tool, number, snapshot).

    Only valid runs are compared.  Content is the hash of a snapshot's blocks, so stability comes from counts.  Equal texts of a document and tool
    are a class, written once; distances have a row for each pair of classes, with how many pairs of runs (``pairs``) it stands for, and ``texts``
    (doc_id, tool, text_sha256, number) tells which run is in which."""
    valid = all_runs.where(F.col("status").isin(*runs.VALID))
    shown = snapshots.join(valid.select("doc_id", "tool", "number"), ["doc_id", "tool", "number"], "left_semi")
    blocks = F.to_json(F.expr("try_variant_get(try_parse_json(snapshot), '$.blocks', 'variant')"))
    text = F.expr("try_variant_get(try_parse_json(snapshot), '$.text', 'string')")
    read = shown.select("doc_id", "tool", "number", content_hash(blocks).alias("content"), text.alias("text")).withColumn("text_sha256", F.sha2("text", 256))
    # Runs of equal snapshots are counted before they travel; what Python read is written, as several tables come from it.
    kinds = Rounds(all_runs.sparkSession, "comparison").add(read.groupBy("doc_id", "tool", "content", "text_sha256").agg(F.count("*").alias("n"), F.min("number").alias("number"), F.collect_list("number").alias("numbers"), F.any_value("text").alias("text")))
    stability = compare.stability(kinds, "content", count="n")
    classes = kinds.groupBy("doc_id", "tool", "text_sha256").agg(F.sum("n").alias("n"), F.min("number").alias("number"), F.any_value("text").alias("text"))
    status = runs.status_counts(all_runs, repeat)
    labels = status.join(stability, ["doc_id", "tool"], "left").select("doc_id", "tool", "success", "partial", "failure", "not_run", F.coalesce("pairs", F.lit(0)).alias("pairs"), F.coalesce("equal_pairs", F.lit(0)).alias("equal_pairs"), runs.repeat_label(F.coalesce("n", F.lit(0)), F.coalesce("unique_content", F.lit(0)), F.col("partial"), repeat).alias("label"))
    side = lambda tool: classes.where(F.col("tool") == tool).drop("tool")
    met = compare.cross_pairs(side(tools[0]), side(tools[1])).withColumn("pairs", F.col("l_n") * F.col("r_n"))
    distances = lambda pairs: compare.text_distances(pairs, "l_text", "r_text").drop("l_text", "r_text", "l_n", "r_n")
    return {
        "repeats": labels,
        "total_seconds": runs.time_statistics(all_runs, "total_seconds", ("doc_id", "tool")),
        "internal_seconds": runs.time_statistics(all_runs, "internal_seconds", ("doc_id", "tool")),
        "representative": runs.representative(all_runs).select("doc_id", "tool", "number", "status"),
        "texts": kinds.select("doc_id", "tool", "text_sha256", F.explode("numbers").alias("number")),
        "repeat_distances": distances(compare.class_pairs(classes)),
        "cross_tool_distances": distances(met),
    }
