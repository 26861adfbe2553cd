"""Exact edit distance over code points.

Short pairs use Spark's built-in function.  Long ones go to a pandas UDF, which cuts off common ends and then looks for the distance itself:
for 0, 1, 2 and so on edits it keeps how far each diagonal of the table gets (Ukkonen; Landau and Vishkin), all diagonals in one numpy step, so the
cost follows the number of edits and not the lengths.  Where the texts turn out to differ so much that the whole table is cheaper, it goes
through the table a row at a time with a column in each bit of a Python integer (Myers; Hyyro)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Products of lengths up to this stay in the JVM.
NATIVE_CELLS = 1_000_000
#: Characters compared at once on all diagonals.
STEP = 16
#: Measured seconds: a numpy step and each diagonal in it; a row of the table and each column in it.
EDIT_S, DIAGONAL_S, ROW_S, COLUMN_S = 6e-5, 1.2e-7, 2e-6, 1e-9


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _same(a: np.ndarray, b: np.ndarray) -> int:
    """How many first characters agree."""
    n, at, width = min(len(a), len(b)), 0, 64
    while at < n:
        apart = a[at : min(n, at + width)] != b[at : min(n, at + width)]
        if apart.any():
            return at + int(apart.argmax())
        at, width = at + width, width * 2
    return n


def by_diagonals(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """The distance if it is ``most`` or less."""
    goal = len(b) - len(a)
    if abs(goal) > most:
        return None
    # Ends that agree with nothing, so that comparisons stop there.
    pad = lambda x, end: sliding_window_view(np.append(x.astype(np.int64), np.full(STEP, end)), STEP)
    wide_a, wide_b = pad(a, -1), pad(b, -2)
    first, far = 0, np.array([_same(a, b)])  # diagonals b - a from ``first`` on, and how far in a each gets
    for edits in range(most + 1):
        if first <= goal < first + len(far) and far[goal - first] >= len(a):
            return edits
        low, high = max(first - 1, -len(a)), min(first + len(far), len(b))
        # From the same diagonal by a replacement, from below by an insertion, from above by a deletion.
        wide = np.full(len(far) + 4, -2, dtype=np.int64)
        wide[2:-2] = far
        at = np.maximum(np.maximum(wide[1:-1] + 1, wide[:-2]), wide[2:] + 1)[low - (first - 1) : high - (first - 1) + 1]
        diagonal = np.arange(low, high + 1)
        at = np.minimum(at, np.minimum(len(a), len(b) - diagonal))
        going, rounds = np.flatnonzero((at >= 0) & (at < len(a)) & (at + diagonal < len(b)) & (at + diagonal >= 0)), 0
        while len(going) and rounds < 4:
            same = wide_a[at[going]] == wide_b[(at + diagonal)[going]]
            whole = same.all(axis=1)
            at[going] += np.where(whole, STEP, same.argmin(axis=1))
            going, rounds = going[whole], rounds + 1
        for i in going.tolist():
            at[i] += _same(a[at[i] :], b[at[i] + diagonal[i] :])
        first, far = low, at
    return None


#: Edits that are tried before pieces are counted, where so many characters from the middle of one text stand in the other.
FEW, ALIKE = 16, 64
#: Lengths of the pieces that are counted for a bound.
PIECES = (2, 4, 6)


def at_least(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the distance: an edit changes at most n pieces of n characters on each side."""
    bound = abs(len(a) - len(b))
    for n in PIECES:
        if len(a) < n or len(b) < n:
            break
        # Equal pieces have equal sums; unequal ones with equal sums only lower the bound.
        sums = [sum(x[i : len(x) - n + 1 + i].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 * (2 * i + 1) ** 5 % 2**64) for i in range(n)) for x in (a, b)]
        _, place = np.unique(np.concatenate(sums), return_inverse=True)
        many = np.bincount(place[: len(sums[0])], minlength=place.max() + 1) - np.bincount(place[len(sums[0]) :], minlength=place.max() + 1)
        bound = max(bound, -(-int(np.maximum(many, 0).sum()) // n), -(-int(np.maximum(-many, 0).sum()) // n))
    return bound


def by_rows(a: np.ndarray, b: np.ndarray) -> int:
    """The distance from the whole table: for each character of ``b``, which columns of ``a`` are one more or one less than their left
    neighbours, a bit each."""
    where: dict[int, int] = {}
    values, groups = np.unique(a, return_inverse=True)
    for n, value in enumerate(values.tolist()):
        where[value] = int.from_bytes(np.packbits(groups == n, bitorder="little").tobytes(), "little")
    everything, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    more, less, found = everything, 0, len(a)
    for char in b.tolist():
        equal = where.get(char, 0)
        # The sum's carry beyond the last column falls to the mask.
        same = (((equal & more) + more) ^ more) | equal | less
        down_more = (less | ((same | more) ^ everything)) & everything
        down_less = same & more
        found += (1 if down_more & last else 0) - (1 if down_less & last else 0)
        down_more, down_less = (down_more << 1) | 1, down_less << 1
        more = (down_less | ((same | down_more) ^ everything)) & everything
        less = same & down_more & everything
    return found


def distance(left: str, right: str) -> int:
    """Least number of insertions, deletions and replacements between two texts."""
    a, b = _points(left), _points(right)
    for _ in range(2):  # the common head, then the common tail
        cut = _same(a, b)
        a, b = a[cut:][::-1], b[cut:][::-1]
    if len(a) < len(b):
        a, b = b, a
    if not len(b):
        return len(a)
    table = len(b) * (ROW_S + COLUMN_S * len(a))
    # So many edits by diagonals cost as much as the table.
    most = int((-EDIT_S + (EDIT_S**2 + 4 * DIAGONAL_S * table) ** 0.5) / (2 * DIAGONAL_S))
    a, b = np.ascontiguousarray(a), np.ascontiguousarray(b)
    middle = b[len(b) // 2 :][:ALIKE]
    found = by_diagonals(a, b, FEW) if most > FEW and len(middle) == ALIKE and middle.tobytes() in a.tobytes() else None
    if found is None and at_least(a, b) <= most:
        found = by_diagonals(a, b, most)
    return by_rows(a, b) if found is None else found


@F.pandas_udf(T.LongType())
def _long_distance(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in parts:
        yield pd.Series([None if x is None or y is None else distance(x, y) for x, y in zip(left, right)], dtype="Int64")


def edit_distance(left: Column, right: Column) -> Column:
    """Distance for texts of any length.  Equal texts cost nothing."""
    small = F.length(left).cast("bigint") * F.length(right) <= NATIVE_CELLS
    # Python functions run for all rows of a batch; short pairs pass it null.
    slow = _long_distance(F.when(~small & (left != right), left), F.when(~small & (left != right), right))
    return F.when(left == right, F.lit(0).cast("bigint")).when(small, F.levenshtein(left, right).cast("bigint")).otherwise(slow)


def difference_percent(distance_: Column, left: Column, right: Column) -> Column:
    return distance_ / F.greatest(F.length(left), F.length(right), F.lit(1)) * 100
