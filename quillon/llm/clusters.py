"""Centroid clustering of integer vectors, exact at every step.

Vectors with ``dims`` finite components become integers floor(scale * x) and are written in blocks, a row each.  In a round each block
is held against the centroids by |x|^2 - 2 x.c + |c|^2, one matrix product a block, in float64 where bounds on the magnitudes
keep every term below 2^53 (so that it is exact in any order), else in 64-bit integers, else in Python's; ``treeAggregate`` adds
the blocks' sums and counts, and a centroid becomes the exact floor of sum / count.

What travels to and from the driver is k x dims integers a round, which are parameters and do not grow with the table.  A round is
a job over the written blocks, so a lost executor costs its tasks of one round.

Defined cases: vectors that are null, of another length, or with a null, NaN or infinite component are left out; a null id is
kept and hashes as "null"; repeated rows are vectors of their own, ordered by their components where ids are equal; fewer vectors
than k give as many centroids; an empty table gives no rows; sums that 64 bits do not hold are null in the result.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, trimmed

#: Rows of a matrix product.
ROWS = 4096
FLOAT_EXACT, LONG_EXACT = 2**53, 2**63 - 1


@dataclass
class Clusters:
    #: Integer components of each centroid.
    centroids: list[list[int]]
    #: Squared distances to each centroid, summed.
    inertia: list[int]
    #: (vec_id, cluster, distance)
    assigned: DataFrame


def whole(x: float, scale: int) -> int:
    """floor(scale * x) of a finite number, whatever its size."""
    return math.floor(x * scale) if abs(x) < 2.0**900 else int(x) * scale


def _integers(values: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have all their integers below 2^53, and those rows."""
    with np.errstate(over="ignore"):
        found = np.floor(values * scale)
    small = (np.abs(found) < FLOAT_EXACT).all(axis=1)
    return small, found[small].astype(np.int64)


def usable(vectors: DataFrame, dims: int, vec_id: str, vector: str) -> DataFrame:
    """(i, v): ids and the vectors that are clustered, as doubles."""
    v = F.col("v")
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return vectors.select(F.col(vec_id).cast("bigint").alias("i"), F.col(vector).cast("array<double>").alias("v")).where((F.size(v) == dims) & ~F.exists(v, bad))


def blocks(kept: DataFrame, dims: int, scale: int) -> DataFrame:
    """(ids, width, data): vectors in blocks, their integers row by row in ``width`` bytes each, or as JSON with width 0
    where they reach 2^53."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            values = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            small, held = _integers(values, scale)
            rows = []
            if len(held):
                width = 4 if _most(held) < 2**31 else 8
                rows.append((b.column(0).filter(pa.array(small)), width, held.astype(f"<i{width}").tobytes()))
            if not small.all():
                large = [[whole(x, scale) for x in v] for v in values[~small].tolist()]
                rows.append((b.column(0).filter(pa.array(~small)), 0, json.dumps(large).encode()))
            ids, widths, data = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array([x.to_pylist() for x in ids], pa.list_(pa.int64())), pa.array(widths, pa.int32()), pa.array(data, pa.binary())], ["ids", "width", "data"])

    return kept.mapInArrow(trimmed(run), "ids array<bigint>, width int, data binary")


def matrix(width: int, data: bytes, dims: int) -> np.ndarray:
    if not width:
        return np.array(json.loads(data), dtype=object).reshape(-1, dims)
    return np.frombuffer(data, dtype=f"<i{width}").reshape(-1, dims).astype(np.int64)


def _most(m: np.ndarray) -> int:
    return max(abs(int(m.max())), abs(int(m.min())))


def nearest(points: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each point's nearest center, the smaller of equal ones, and the squared distance; exact."""
    reach = points.shape[1] * (_most(points) + _most(centers)) ** 2
    kind = np.float64 if reach < FLOAT_EXACT else np.int64 if reach < LONG_EXACT else object
    c = centers.astype(kind)
    across, own = c.T.copy(), (c * c).sum(axis=1)
    numbers, far = [], []
    for i in range(0, len(points), ROWS):
        p = points[i : i + ROWS].astype(kind)
        d = (p * p).sum(axis=1)[:, None] - 2 * np.dot(p, across) + own
        n = np.argmin(d, axis=1)
        numbers.append(n)
        far.append(d[np.arange(len(n)), n])
    far = np.concatenate(far)
    return np.concatenate(numbers), far.astype(np.int64) if kind is not object else far


def _sums(points: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The centers that have points, the sums of these, and how many they are."""
    order = np.argsort(numbers, kind="stable")
    which, start = np.unique(numbers[order], return_index=True)
    held = points[order]
    if held.dtype != object and _most(held) * len(held) >= LONG_EXACT:
        held = held.astype(object)
    return which, np.add.reduceat(held, start, axis=0), np.diff(np.append(start, len(order)))


def _totals(table: DataFrame, centroids: list[list[int]], dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums, counts and distances of the vectors nearest to each centroid, in Python's integers."""
    k = len(centroids)

    def zero():
        return tuple(np.zeros(shape, dtype=object) for shape in ((k, dims), k, k))

    def add(total, row):
        sums, counts, far = total if total is not None else zero()
        points = matrix(row["width"], row["data"], dims)
        numbers, d = nearest(points, np.array(centroids, dtype=object))
        which, s, n = _sums(points, numbers)
        sums[which] += s.astype(object)
        counts[which] += n.astype(object)
        _, f, _ = _sums(d[:, None], numbers)
        far[which] += f[:, 0].astype(object)
        return sums, counts, far

    def join(a, b):
        return b if a is None else a if b is None else tuple(x + y for x, y in zip(a, b))

    return table.select("width", "data").rdd.treeAggregate(None, add, join) or zero()


def cluster(vectors: DataFrame, k: int, rounds: int, *, dims: int, scale: int, seed: str, vec_id: str = "vec_id", vector: str = "embedding") -> Clusters:
    """Lloyd's rounds from the k vectors whose sha256 of "seed:id" is smallest.

    Each round gives every vector to its nearest centroid, the smaller number on ties, and moves each centroid that has vectors to their
    componentwise floor(sum / count); at the end vectors are given out once more."""
    spark = vectors.sparkSession
    kept = usable(vectors, dims, vec_id, vector)
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("i").cast("string"), F.lit("null"))), 256)
    first = kept.select(hashed.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    centroids = [[whole(x, scale) for x in r["v"]] for r in first]
    if not centroids:
        return Clusters([], [], spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint"))
    table = materialize(blocks(kept, dims, scale), "vectors")
    for _ in range(rounds):
        sums, counts, _ = _totals(table, centroids, dims)
        centroids = [[int(x) // int(n) for x in s] if n else c for c, s, n in zip(centroids, sums, counts)]
    inertia = [int(x) for x in _totals(table, centroids, dims)[2]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, width, data in zip(*(c.to_pylist() for c in b.columns)):
                numbers, d = nearest(matrix(width, data, dims), np.array(centroids, dtype=object))
                far = pa.array([x if x <= LONG_EXACT else None for x in d.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), far], ["vec_id", "cluster", "distance"])

    return Clusters(centroids, inertia, table.mapInArrow(trimmed(run), "vec_id bigint, cluster int, distance bigint"))


def report(found: Clusters) -> DataFrame:
    """A row a vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.  The table joined has a row a centroid."""
    fit = lambda x: x if x <= LONG_EXACT else None
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    rows = [(i, fit(n), fit(sum(found.inertia)), digest(c)) for i, (c, n) in enumerate(zip(found.centroids, found.inertia))]
    about = found.assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.assigned.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
