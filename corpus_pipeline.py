"""A corpus pipeline: quality rules, near-duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.  All but the last
return the columns of ``docs``; the last writes the token files and returns what it reads back from them:
doc_id, start, n_tokens, ids_crc32 for each document, one taken twice having two rows.

Between stages rows are written as Parquet to the shared folder and read again, so a lost executor
costs a stage's tasks at most.  Null and empty texts fail the quality rules; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon import prepare
from quillon.llm import decontaminate, mixing, quality, simhash, tokens
from quillon.llm.common import materialize, table
from quillon.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the isolation forest keep."""
    prepare(spark)
    return quality.filter_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8)."""
    prepare(spark)
    return simhash.drop_near_duplicates(docs, similarity=0.8, shingle=5)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a 10-word passage of a benchmark item."""
    prepare(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), mode="documents", n=10)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each 0 to 2 times, so that sources come near their targets."""
    prepare(spark)
    return mixing.mixed_documents(docs, weights=(5, 2, 1), budget=1.5, cap=2.0)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in doc_id order, read back."""
    prepare(spark)
    return tokens.token_output(docs, tokenizer_path(), end_id=1)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", benchmark_decontamination),
    ("mixing", source_mixing),
    ("token output", token_output),
]

#: The near-duplicate, forest and token stages have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
