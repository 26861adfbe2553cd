"""Quality rules: an isolation forest on rule statistics.

Rule statistics are counted over whole texts.  The forest is fitted on half of a bounded sample of
labelled documents (``sample`` rows, those whose salted hash of the doc_id is least): ``trees`` trees, each
on ``per_tree`` of them, split at random in a random statistic.  A document's anomaly score is
2 ** -(mean path length / expected path length).  The threshold is calibrated on the good rows of the
other half: at most ``false_rejects`` of them score above it.

Defined cases: null and empty texts have no words and fail the base rule; documents without labels are
scored like all others; without labelled good rows only the base rule decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, trimmed

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct", "longest")
#: Words of a typical text that are taken to come before each text.
PRIOR = 100


def repeated_words(words: list, window: int = 8) -> int:
    """Words in windows of ``window`` words that occur twice or more."""
    last = len(words) - window + 1
    if last < 2:
        return 0
    numbers: dict = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.uint64, count=len(words))
    if len(numbers) == len(words):
        return 0
    total = np.zeros(last, dtype=np.uint64)
    for k in range(window):
        total = total * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + last]
    order = np.sort(total)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    groups: dict[bytes, list[int]] = {}
    for i in np.flatnonzero(np.isin(total, twice)).tolist():
        groups.setdefault(ids[i : i + window].tobytes(), []).append(i)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for at in groups.values():
        if len(at) > 1:
            np.add.at(edge, at, 1)
            np.add.at(edge, np.array(at) + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def statistics(text: str | None) -> tuple[int, ...]:
    """The values of COLUMNS for a text."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    chars = len(text) - sum(map(text.count, SPACES))
    upper = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(data) - len(data.translate(None, b"0123456789"))
    marks = len(data) - len(data.translate(None, b".,;:!?'\"()-"))
    return (len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines), upper, digits, marks, len(set(words)), max(map(len, words), default=0))


def _counted(texts: pa.Array) -> np.ndarray:
    rows = [statistics(t.as_py()) for t in texts]
    return np.array(rows, dtype=np.int64).reshape(len(rows), len(COLUMNS))


def rule_statistics(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and COLUMNS for each row; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            values = _counted(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(values[:, i]) for i in range(len(COLUMNS)))], names=["doc_id", *COLUMNS])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(trimmed(run), "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COLUMNS))


def features(rows: dict[str, np.ndarray], typical: np.ndarray) -> np.ndarray:
    """What the forest sees: few statistics, as each further one that does not tell documents apart takes splits from
    those that do.  Rates are drawn towards the ``typical`` ones as if PRIOR words of a typical text came first, so
    that chance in short texts is no anomaly; rates near zero are told apart by their logarithm."""
    words = rows["n_words"].astype(float)
    rates = (_amounts(rows) + PRIOR * typical) / (words + PRIOR)[:, None]
    rates[:, 2:] = np.log(rates[:, 2:] + 0.01)
    return rates


def _amounts(rows: dict[str, np.ndarray]) -> np.ndarray:
    words = rows["n_words"].astype(float)
    variety = rows["n_distinct"] / np.maximum(words, 1) ** 0.8 * words
    return np.stack([rows["word_chars"], variety, rows["n_symbols"], rows["n_upper"], rows["n_marks"]], 1).astype(float)


def _expected(n: float) -> float:
    """Mean path length of an unsuccessful search among n values."""
    return 0.0 if n <= 1 else 1.0 if n <= 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class IsolationForest:
    """Trees as arrays: feature (-1 in a leaf), cut, left child, path length at a leaf."""

    def __init__(self, x: np.ndarray, trees: int = 200, per_tree: int = 128, seed: int = 7):
        rng = np.random.default_rng(seed)
        per_tree = min(per_tree, len(x))
        depth = max(1, int(np.ceil(np.log2(max(per_tree, 2)))))
        self.normal = max(_expected(per_tree), 1e-9)
        self.trees = []
        for _ in range(trees):
            feature, cut, left, path = [], [], [], []
            todo = [(x[rng.choice(len(x), per_tree, replace=False)], 0, 0)]
            feature.append(-1), cut.append(0.0), left.append(0), path.append(0.0)
            while todo:
                rows, level, at = todo.pop()
                low, high = rows.min(0), rows.max(0)
                open_ = np.flatnonzero(high > low)
                if level >= depth or len(rows) <= 1 or not len(open_):
                    path[at] = level + _expected(len(rows))
                    continue
                f = int(rng.choice(open_))
                c = rng.uniform(low[f], high[f])
                below = rows[:, f] < c
                feature[at], cut[at], left[at] = f, c, len(feature)
                for side in (below, ~below):
                    todo.append((rows[side], level + 1, len(feature))) if side.any() else None
                    feature.append(-1), cut.append(0.0), left.append(0), path.append(level + 1.0)
            self.trees.append((np.array(feature), np.array(cut), np.array(left), np.array(path)))
        self.depth = depth

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, left, path in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(f, 0)] >= cut[at]
                at = np.where(inner, left[at] + right, at)
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / self.normal)


class Judge:
    """The base rule and, where there are labelled good rows, the forest with its threshold."""

    def __init__(self, min_words: int, max_repeat_percent: int):
        self.min_words, self.max_repeat_percent = min_words, max_repeat_percent
        self.forest: IsolationForest | None = None
        self.limit = np.inf

    def failed(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        return (rows["n_words"] < self.min_words) | (100 * rows["n_repeat_words"] > self.max_repeat_percent * rows["n_words"])

    def fit(self, rows: dict[str, np.ndarray], good: np.ndarray, trees: int, per_tree: int, false_rejects: float) -> None:
        if not good.any():
            return
        sums = _amounts({c: v[good] for c, v in rows.items()}).sum(0)
        self.typical = sums / max(1, rows["n_words"][good].sum())
        x = features(rows, self.typical)
        first = np.arange(len(x)) < max(1, len(x) // 2)
        self.forest = IsolationForest(x[first], trees, per_tree)
        held = x[good & ~first] if (good & ~first).any() else x[good]
        self.limit = float(np.quantile(self.forest.score(held), 1 - false_rejects, method="higher"))

    def __call__(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score, base_failed and kept of rows of COLUMNS."""
        rows = dict(zip(COLUMNS, values.T))
        failed = self.failed(rows)
        score = self.forest.score(features(rows, self.typical)) if self.forest is not None and len(values) else np.zeros(len(values))
        return score, failed, ~failed & (score <= self.limit)


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = 20_000, false_rejects: float = 0.002, trees: int = 200, per_tree: int = 128, min_words: int = 20, max_repeat_percent: int = 30, doc_id: str = "doc_id", text: str = "text", quality: str = "quality") -> Judge:
    """A Judge fitted on labelled documents that the base rule lets pass, ``sample`` labels at most: those with the least
    salted hashes, of which Spark takes the least of each partition first.  The labels taken have a bounded size and are
    broadcast; only their documents are counted."""
    judge_ = Judge(min_words, max_repeat_percent)
    known = labels.where(F.col(quality).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("bigint").alias("doc_id")).agg(F.min(quality).alias("quality"))
    taken = known.orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id").limit(sample).select(F.col("doc_id").alias("__d"), F.col("quality").alias("__q"))
    labelled = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(taken), F.col("doc_id") == F.col("__d"))
    stats = rule_statistics(labelled.select(F.col("doc_id"), "text")).join(F.broadcast(taken), F.col("doc_id") == F.col("__d"))
    # Rows repeated under one id could be more than the labels.
    rows = stats.orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id", *COLUMNS).limit(sample).drop("__d", "doc_id").toPandas()
    values = {c: rows[c].to_numpy(dtype=np.int64) for c in COLUMNS}
    passed = ~judge_.failed(values)
    judge_.fit({c: v[passed] for c, v in values.items()}, (rows["__q"].to_numpy() == 1)[passed], trees, per_tree, false_rejects)
    return judge_


def judge(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **fitting) -> DataFrame:
    """doc_id, COLUMNS, score, base_failed and kept for each row of ``docs``; after the fit one pass, no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, doc_id=doc_id, text=text, **fitting))

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            values = _counted(b.column(1))
            verdict = held.value(values)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(values[:, i]) for i in range(len(COLUMNS))), *map(pa.array, verdict)], names=["doc_id", *COLUMNS, "score", "base_failed", "kept"])

    schema = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COLUMNS) + ", score double, base_failed boolean, kept boolean"
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(trimmed(run), schema)


def filter_quality(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **fitting) -> DataFrame:
    """``docs`` without the rejected documents; all columns stay, each row is judged by its own text, nothing is shuffled."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, doc_id=doc_id, text=text, **fitting))
    where = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            yield b.filter(pa.array(held.value(_counted(b.column(where)))[2], pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)
