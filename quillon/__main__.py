"""``python -m quillon MODE PATH [--out FOLDER] [--max-bytes N]``: saved results in, JSON lines out.

Modes over tree-shaped JSON: ``outline`` (section trees), ``rules`` (does a document match the outline rules); over either
shape: ``snapshot``, ``excerpts``; over tree-shaped JSON: ``features``; over source files: ``profile``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import prepare
from .operators import evidence, inventory, outline, references
from .sources import readers, writers


def table_of(spark: SparkSession, mode: str, path: str, max_bytes: int | None = None) -> DataFrame:
    """The rows of a mode; documents are named by a hash of their path, which ``path`` gives back."""
    if mode == "profile":
        return readers.source_profiles(readers.discover(spark, path, with_content=True))
    rows = readers.read_json(spark, path, max_bytes).withColumn("doc_id", F.xxhash64("path"))
    if mode in ("outline", "rules", "features"):
        rows = readers.require_objects(rows)
    found = {
        "outline": lambda: outline.nested(outline.outline(outline.body_blocks(rows))),
        "rules": lambda: outline.matches_rules(outline.body_blocks(rows)),
        "snapshot": lambda: references.snapshots(rows),
        "excerpts": lambda: evidence.excerpts(rows),
        "features": lambda: inventory.provided(inventory.tree_features(rows).where("decides"), ("doc_id", "category")),
    }[mode]()
    return found.join(rows.select("doc_id", "path"), "doc_id").drop("doc_id")


def main(arguments: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="quillon", description=__doc__)
    p.add_argument("mode", choices=("outline", "rules", "snapshot", "excerpts", "features", "profile"))
    p.add_argument("path")
    p.add_argument("--out")
    p.add_argument("--max-bytes", type=int)
    a = p.parse_args(arguments)
    if a.out and a.out.rstrip("/") == a.path.rstrip("/"):
        p.error("the output is the source")
    spark = SparkSession.builder.getOrCreate()
    prepare(spark)
    df = table_of(spark, a.mode, a.path, a.max_bytes)
    if a.out:
        writers.write_json(df, a.out)
    else:
        for row in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator():
            print(row.j)


if __name__ == "__main__":
    main()
