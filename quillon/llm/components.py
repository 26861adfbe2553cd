"""Connected components of a link table, with joins and aggregates alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_folder, materialize


def connected_components(links: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """``links`` (a bigint, b bigint), direction without meaning.  Returns (node, root): for each
    node that has a link to another one, the smallest node that it reaches.

    Alternates large-star (a node's larger neighbours link to the least neighbour) and small-star
    (its smaller ones do) until nothing changes; the number of rounds grows with the logarithm of
    the table.  Each round is written to the shared folder.  A node with very many links is one
    aggregate (min, combined before the shuffle) and one join side that Spark can split.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, "links")
    state = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b"), F.col("m"), F.col("a"))
        step = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b"))).distinct()
        before, edges = edges, materialize(step, "links")
        drop_folder(before.written_to)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).union(edges.select("b", "b").distinct())
        state = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
