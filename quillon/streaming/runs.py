"""Incremental recording of runs with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = "doc_id bigint, tool string, number int, status string, total_seconds double, finished timestamp"


def read_runs(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Runs of JSON-line files as they arrive."""
    return spark.readStream.schema(RUN).option("maxFilesPerTrigger", files_per_batch).json(folder)


def record_runs(stream: DataFrame, table: str, checkpoint: str):
    """A query that appends new runs to ``table``.  Runs are keyed (doc_id, tool, number): one that comes twice within the
    watermark is dropped by the stream's state, a batch that is run again overwrites its own folder."""
    once = stream.withWatermark("finished", "1 day").dropDuplicatesWithinWatermark(["doc_id", "tool", "number"])

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_times(stream: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window, tool, n, mean seconds) over full successes, tolerant of late runs."""
    return stream.where("status = 'success'").withWatermark("finished", late).groupBy(F.window("finished", size), "tool").agg(F.count("*").alias("n"), F.avg("total_seconds").alias("mean_seconds"))
