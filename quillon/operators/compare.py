"""Comparison of repeated results: pairs, distances, block and number differences, stability."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import canonical_text, clean
from ..functions.distance import difference_percent, distance, edit_distance


def run_pairs(rows: DataFrame, group: tuple[str, ...] = ("doc_id", "tool"), number: str = "number") -> DataFrame:
    """Pairs of a group's rows, the lower number first; columns with l_ and r_.  Pairs are what is asked for, so
    their number grows with the square of a group: for repeats of a run, a handful."""
    side = lambda p: rows.select(*[F.col(c) if c in group else F.col(c).alias(f"{p}_{c}") for c in rows.columns])
    return side("l").join(side("r"), list(group)).where(F.col(f"l_{number}") < F.col(f"r_{number}"))


def class_pairs(classes: DataFrame, by: tuple[str, ...] = ("doc_id", "tool"), number: str = "number") -> DataFrame:
    """``classes`` are by, n, number and more: equal results of a group as one row, how many they are and the least number.  Pairs of a group's
    classes, and each class of two rows or more with itself; ``pairs`` is how many pairs of rows a row stands for."""
    side = lambda p: classes.select(*[F.col(c) if c in by else F.col(c).alias(f"{p}_{c}") for c in classes.columns])
    met = side("l").join(side("r"), list(by)).where(F.col(f"l_{number}") < F.col(f"r_{number}")).withColumn("pairs", F.col("l_n") * F.col("r_n"))
    own = classes.where("n > 1").select(*by, *[F.col(c).alias(f"{p}_{c}") for p in "lr" for c in classes.columns if c not in by], F.expr("n * (n - 1) div 2").alias("pairs"))
    return met.unionByName(own)


def stability(rows: DataFrame, content: str, group: tuple[str, ...] = ("doc_id", "tool"), count: str | None = None) -> DataFrame:
    """group, n, unique_content, pairs, equal_pairs.  Equal pairs come from the counts of each content, without the pairs.  ``count`` names how
    many results a row stands for."""
    each = rows.groupBy(*group, content).agg((F.count("*") if count is None else F.sum(count)).alias("k"))
    n, two = F.sum("k"), lambda c: (c * (c - 1) / 2).cast("bigint")
    return each.groupBy(*group).agg(n.alias("n"), F.count(content).alias("unique_content"), two(n).alias("pairs"), F.sum(two(F.col("k"))).alias("equal_pairs"))


def text_distances(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """``pairs`` with edit_distance and text_difference_pct, where the pairs are: texts do not travel for it.  Pairs of classes of equal texts
    (class_pairs()) hold each pair of different texts once."""
    out = pairs.withColumn("edit_distance", F.coalesce(edit_distance(F.col(left), F.col(right)), F.lit(0).cast("bigint")))
    return out.withColumn("text_difference_pct", difference_percent(F.col("edit_distance"), F.col(left), F.col(right)))


#: Pairs of equal positions that are listed at once; beyond, diagonals are gone through one by one.
PAIRS = 4_000_000


def _stretches(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All longest runs of equal neighbours of two lists of numbers: where in ``a``, where in ``b``, how long."""
    order_a, order_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    low, high = (np.searchsorted(b[order_b], a[order_a], side=side) for side in ("left", "right"))
    many = high - low
    if many.sum() <= PAIRS:
        i = np.repeat(order_a, many)
        j = order_b[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        order = np.lexsort((i, j - i))
        i, j = i[order], j[order]
        start = np.flatnonzero(np.append(True, (np.diff(j - i) != 0) | (np.diff(i) != 1))) if len(i) else np.zeros(0, np.int64)
        return i[start], j[start], np.diff(np.append(start, len(i)))
    found = []
    for d in range(1 - len(a), len(b)):
        x, y = max(0, -d), max(0, d)
        n = min(len(a) - x, len(b) - y)
        edge = np.diff((a[x : x + n] == b[y : y + n]).astype(np.int8), prepend=0, append=0)
        start = np.flatnonzero(edge == 1)
        found.append((x + start, y + start, np.flatnonzero(edge == -1) - start))
    return tuple(np.concatenate(z) for z in zip(*found))


def matching_blocks(left: list, right: list) -> list[tuple[int, int, int]]:
    """(where in left, where in right, how many): the longest equal run, of equally long ones the first in left, then in right; and so on
    before and after it.

    All runs are found once, as an index of equal positions.  In a part of both lists each counts as far as it lies in it."""
    number: dict = {}
    a, b = (np.array([number.setdefault(x, len(number)) for x in side], dtype=np.int64) for side in (left, right))
    if not len(a) or not len(b):
        return []
    out, parts = [], [(0, len(a), 0, len(b), *_stretches(a, b))]
    while parts:
        a0, a1, b0, b1, i, j, n = parts.pop()
        skip = np.maximum(0, np.maximum(a0 - i, b0 - j))
        size = np.minimum(n, np.minimum(a1 - i, b1 - j)) - skip
        inside = size > 0
        if not inside.any():
            continue
        i, j, n, skip, size = (x[inside] for x in (i, j, n, skip, size))
        best = np.lexsort((j + skip, i + skip, -size))[0]
        x, y, k = int(i[best] + skip[best]), int(j[best] + skip[best]), int(size[best])
        out.append((x, y, k))
        parts += [(a0, x, b0, y, i, j, n), (x + k, a1, y + k, b1, i, j, n)]
    return sorted(out)


def list_edits(left: list, right: list) -> list[tuple[str, int, int, int, int]]:
    """What turns one list into another around its matching blocks: operation, range in left, range in right."""
    out, x, y = [], 0, 0
    for i, j, n in [*matching_blocks(left, right), (len(left), len(right), 0)]:
        if x < i or y < j:
            out.append(("replace" if x < i and y < j else "delete" if x < i else "insert", x, i, y, j))
        x, y = i + n, j + n
    return out


_EDIT = T.StructType([T.StructField("operation", T.StringType()), *(T.StructField(n, T.IntegerType()) for n in "abcd")])


@F.pandas_udf(T.ArrayType(_EDIT))
def _edits(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """list_edits() of two columns of string arrays; null if either is."""
    for left, right in parts:
        yield pd.Series([None if x is None or y is None else [dict(zip(("operation", "a", "b", "c", "d"), e)) for e in list_edits(list(x), list(y))] for x, y in zip(left, right)], dtype=object)


def _changes(edits: Column) -> Column:
    total = lambda e, operation, size: F.aggregate(F.filter(e, lambda x: x["operation"] == operation), F.lit(0).cast("bigint"), lambda n, x: n + size(x))
    of_left, of_right = lambda x: x["b"] - x["a"], lambda x: x["d"] - x["c"]
    span = lambda x: F.struct(x["operation"].alias("operation"), F.array(x["a"], x["b"]).alias("left_range"), F.array(x["c"], x["d"]).alias("right_range"))
    made = lambda e: F.struct(total(e, "insert", of_right).alias("added"), total(e, "delete", of_left).alias("deleted"), total(e, "replace", of_left).alias("replaced_left"), total(e, "replace", of_right).alias("replaced_right"), F.to_json(F.transform(e, span)).alias("spans"))
    # The list of edits is named once, so that Python runs once.
    return F.element_at(F.transform(F.array(edits), made), 1)


def block_diff(left: str, right: str) -> Column:
    """Differences of two columns of string arrays as a struct: added, deleted, replaced_left, replaced_right and the changed
    spans as JSON; all null where a side is."""
    return _changes(_edits(F.col(left), F.col(right)))


def json_nodes(value) -> dict[tuple, tuple[str, object]]:
    """All nodes of nested JSON by path: kind ("map", "list", "number" or "other") and, of scalars, the value.  Steps of a path
    tell keys from indices."""
    found: dict[tuple, tuple[str, object]] = {}
    todo = [((), value)]
    while todo:
        path, x = todo.pop()
        if isinstance(x, dict):
            found[path] = ("map", None)
            todo += [((*path, ("key", k)), y) for k, y in x.items()]
        elif isinstance(x, list):
            found[path] = ("list", None)
            todo += [((*path, ("at", i)), y) for i, y in enumerate(x)]
        else:
            found[path] = ("number" if isinstance(x, int | float) else "other", x)
    return found


def number_changes(left, right) -> tuple[int, float, int]:
    """Changed numbers, largest change, and changes of shape or of other values, of two nested values: both as tables of
    nodes, joined on the path.  A node that one side lacks counts if the other side has what it hangs on."""
    a, b = json_nodes(left), json_nodes(right)
    both = a.keys() & b.keys()
    inner = {p for p in both if a[p][0] == b[p][0] in ("map", "list")}
    numbers = {p for p in both if a[p][0] == b[p][0] == "number"}
    changes = [abs(a[p][1] - b[p][1]) for p in numbers if a[p][1] != b[p][1]]
    other = sum(p[:-1] in inner for p in a.keys() ^ b.keys()) + sum(a[p] != b[p] for p in both - inner - numbers)
    return len(changes), max(changes, default=0), other


_DELTA = T.StructType([T.StructField("changed_values", T.LongType()), T.StructField("max_abs_delta", T.DoubleType()), T.StructField("other_changes", T.LongType())])


@F.pandas_udf(_DELTA)
def numeric_delta(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """number_changes() of two JSON columns; null if either is null or no JSON."""

    def one(a, b):
        try:
            return number_changes(json.loads(a), json.loads(b))
        except (TypeError, ValueError, RecursionError):
            return None, None, None

    for left, right in parts:
        yield pd.DataFrame([one(a, b) for a, b in zip(left, right)], columns=_DELTA.names).astype({"changed_values": "Int64", "max_abs_delta": "Float64", "other_changes": "Int64"})


def flat_numeric_delta(left: DataFrame, right: DataFrame, keys: tuple[str, ...], path: str = "path", value: str = "value") -> DataFrame:
    """The same over flattened values, distributed: ``left`` and ``right`` have keys, a path and a JSON scalar.  A path on one
    side alone changes the shape."""
    a = left.select(*keys, path, F.col(value).alias("a"), F.lit(True).alias("in_a"))
    b = right.select(*keys, path, F.col(value).alias("b"), F.lit(True).alias("in_b"))
    j = a.join(b, [*keys, path], "full")
    number = lambda c: F.coalesce(F.when(c == "true", 1.0).when(c == "false", 0.0), c.try_cast("double"))
    x, y = number(F.col("a")), number(F.col("b"))
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    numbers = both & x.isNotNull() & y.isNotNull()
    changed = numbers & (x != y)
    other = ~both | (both & ~numbers & ~F.col("a").eqNullSafe(F.col("b")))
    return j.groupBy(*keys).agg(F.count_if(changed).alias("changed_values"), F.coalesce(F.max(F.when(changed, F.abs(x - y))), F.lit(0.0)).alias("max_abs_delta"), F.count_if(other).alias("other_changes"))


def unique_matches(left: DataFrame, right: DataFrame, group: tuple[str, ...], key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Matches of keys that occur once on each side (group, key, l, r), and per group: matched, and how many are left on each side."""
    keys = [*group, key]
    one = lambda d, p: d.groupBy(*keys).agg(F.count("*").alias(f"{p}_n"), F.min(value).alias(p))
    matched = one(left, "l").where("l_n = 1").join(one(right, "r").where("r_n = 1"), keys).select(*keys, "l", "r")
    sides = left.select(*group, F.lit(1).alias("x"), F.lit(0).alias("y")).unionAll(right.select(*group, F.lit(0).alias("x"), F.lit(1).alias("y")))
    totals = sides.groupBy(*group).agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    counts = totals.join(matched.groupBy(*group).agg(F.count("*").alias("m")), list(group), "left").withColumn("m", F.coalesce("m", F.lit(0)))
    return matched, counts.select(*group, F.col("m").alias("matched"), (F.col("x") - F.col("m")).alias("left_over_left"), (F.col("y") - F.col("m")).alias("left_over_right"))


def geometry(snapshots: DataFrame) -> DataFrame:
    """(doc_id, key, value) of a snapshot's geometry; the key is its canonical JSON."""

    def run(parts):
        for p in parts:
            rows = [(i, canonical_text(g["key"]), json.dumps(g["values"])) for i, s in zip(p["doc_id"], p["snapshot"]) if s is not None for g in json.loads(s)["geometry"] or []]
            yield pd.DataFrame(rows, columns=["doc_id", "key", "value"])

    return snapshots.select("doc_id", "snapshot").mapInPandas(run, "doc_id bigint, key string, value string")


def geometry_delta(left: DataFrame, right: DataFrame, group: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """group, matched, left over on each side, changed_values, max_abs_delta, other_changes of two geometry() tables."""
    side = lambda d, own: d.select(*group, F.unhex(F.sha2("key", 256)).alias("key"), *[(F.col("value") if p == own else F.lit(None).cast("string")).alias(p) for p in "lr"], F.lit(own == "l").alias("of_l"))
    # Both sides are made once and meet by their keys' hashes.
    keys = side(left, "l").unionAll(side(right, "r")).groupBy(*group, "key").agg(F.count_if("of_l").alias("l_n"), F.count_if(~F.col("of_l")).alias("r_n"), F.min("l").alias("l"), F.min("r").alias("r"))
    one = (F.col("l_n") == 1) & (F.col("r_n") == 1)
    each = keys.select(*group, "l_n", "r_n", one.alias("one"), F.when(one, F.col("l")).alias("l"), F.when(one, F.col("r")).alias("r")).withColumn("d", numeric_delta("l", "r"))
    total = lambda n: F.sum(F.col(n) - F.col("one").cast("int"))
    return each.groupBy(*group).agg(
        F.count_if("one").alias("matched"), total("l_n").alias("left_over_left"), total("r_n").alias("left_over_right"), F.sum("d.changed_values").alias("changed_values"), F.max("d.max_abs_delta").alias("max_abs_delta"), F.sum("d.other_changes").alias("other_changes")
    )


_MET = T.StructType([T.StructField("content_equal", T.BooleanType()), T.StructField("text_equal", T.BooleanType()), T.StructField("edit_distance", T.LongType()), T.StructField("longest", T.LongType()), T.StructField("edits", T.ArrayType(_EDIT))])


def _meet(left: str | None, right: str | None) -> tuple:
    """Whether contents and texts of two snapshots (JSON) are equal, the distance of their texts, the longer one's length, and the edits of the blocks."""
    found = [None if x is None else json.loads(x) for x in (left, right)]
    if found[0] is None or found[1] is None:
        return None, None, 0, max((len(clean(x["text"])) for x in found if x), default=0), None
    a, b = (clean(x["text"]) for x in found)
    blocks = [[canonical_text(y) for y in x["blocks"]] for x in (found[:1] if left == right else found)]
    edits = [dict(zip(_EDIT.names, e)) for e in list_edits(blocks[0], blocks[-1])] if blocks[0] != blocks[-1] else []
    return blocks[0] == blocks[-1], a == b, 0 if a == b else distance(a, b), max(len(a), len(b)), edits


@F.pandas_udf(_MET)
def _met(chunks: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for left, right in chunks:
        yield pd.DataFrame([_meet(x, y) for x, y in zip(left, right)], columns=_MET.names).astype({"content_equal": object, "text_equal": object})


def compare_snapshots(pairs: DataFrame, left: str = "l_snapshot", right: str = "r_snapshot") -> DataFrame:
    """``pairs`` of snapshots (JSON) with content_equal, text_equal, edit_distance, text_difference_pct and the block differences.

    One call a pair, no shuffle: two snapshots are read where their row is."""
    rows = pairs.withColumn("__m", _met(F.col(left), F.col(right))).withColumn("edit_distance", F.col("__m.edit_distance"))
    rows = rows.withColumn("text_difference_pct", F.col("edit_distance") / F.greatest("__m.longest", F.lit(1)) * 100).withColumn("changes", _changes(F.col("__m.edits")))
    return rows.withColumn("content_equal", F.col("__m.content_equal")).withColumn("text_equal", F.col("__m.text_equal")).drop("__m")


def cross_pairs(left: DataFrame, right: DataFrame, on: str = "doc_id") -> DataFrame:
    """Valid results of two tools for one document, each with each: an equi-join on the document."""
    side = lambda d, p: d.select(on, *[F.col(c).alias(f"{p}_{c}") for c in d.columns if c != on])
    return side(left, "l").join(side(right, "r"), on)

