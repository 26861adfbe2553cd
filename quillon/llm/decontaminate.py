"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Benchmark texts and documents are lower-cased (A-Z) and cut into words: runs of 0-9, a-z and
non-ASCII characters.  A window is ``n`` consecutive words of an item; an item of fewer words,
but not none, is one window.  Each executor slides a rolling 64-bit hash over the word numbers of
its documents, looks the values up in the broadcast set, and verifies each hit word by word.

Size: a set takes at most about ``broadcast_bytes``.  A larger benchmark is cut into more sets, long items by
their windows; each set has a pass over the documents, one set at a time.  Every pass looks at the original text and
adds its hits to the row's, which travel with it in a table between passes; spans are merged and cut after
the last one, so rows and results are the same for any number of sets.  Documents are never shuffled.

Defined cases: a null text has no words; an item without words has no window; a null item_id is
reported as the item ``null``; repeated item_ids count once; repeated documents give one row each.
"""

from __future__ import annotations

import hashlib
import itertools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, trimmed

#: Everything but 0-9, a-z and bytes from 0x80 becomes a space; A-Z becomes a-z.
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32) for b in range(256))
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22


def words(text: str | None) -> list[bytes]:
    """Normalised words of a text, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


#: Estimated bytes of a window (hash, place, item, offset) and of a distinct word besides its letters.
WINDOW_BYTES, WORD_BYTES = 28, 150
#: Words of an item (bytes, number of the words of its windows).
Part = tuple[str, list[bytes], int]


class _Windows:
    """Distinct windows of one size, by hash: an example's place in ``words``, and the items that have it."""

    def __init__(self, words: np.ndarray, places: np.ndarray, items: np.ndarray, size: int):
        self.words, self.size = words, size
        hashes = _rolling(words, size)[places]
        order = np.lexsort((items, hashes))
        hashes, places, items = hashes[order], places[order], items[order]
        head = np.concatenate([[True], hashes[1:] != hashes[:-1]])
        group = np.cumsum(head) - 1
        lead = places[head][group]
        same = np.ones(len(places), dtype=bool)
        for k in range(size):
            same &= words[places + k] == words[lead + k]
        # Other words with the same hash make a table of their own.
        self.rest = None if same.all() else _Windows(words, places[~same], items[~same], size)
        group, items = group[same], items[same]
        once = np.concatenate([[True], (group[1:] != group[:-1]) | (items[1:] != items[:-1])])
        group, self.items = group[once], items[once]
        self.keys, self.places = hashes[head], places[head]
        self.first = np.searchsorted(group, np.arange(len(self.keys) + 1))
        self.bits = np.zeros(1 << _BITS, dtype=bool)
        self.bits[self.keys >> np.uint64(64 - _BITS)] = True

    def find(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place, document and window of each hit; ``ends`` is where each document's words end."""
        if len(ids) < self.size:
            return (np.zeros(0, dtype=np.int64),) * 3
        hashes = _rolling(ids, self.size)
        at = np.flatnonzero(self.bits[hashes >> np.uint64(64 - _BITS)])
        window = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        doc = np.searchsorted(ends, at, side="right")
        hit = (self.keys[window] == hashes[at]) & (at + self.size <= ends[doc])
        at, window, doc = at[hit], window[hit], doc[hit]
        hit = np.ones(len(at), dtype=bool)
        for k in range(self.size):
            hit &= self.words[self.places[window] + k] == ids[at + k]
        return at[hit], doc[hit], window[hit]

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.keys, self.places, self.first, self.items))


class NgramSet:
    """Windows of benchmark items by size, with a bit table in front of exact lookups."""

    def __init__(self, parts: list[Part]):
        self.ids: list[str] = []
        self.number: dict[bytes, int] = {}
        known: dict[str, int] = {}
        by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item_id, part, size in parts:
            if item_id not in known:
                known[item_id] = len(self.ids)
                self.ids.append(item_id)
            row = np.array([self.number.setdefault(x, len(self.number) + 1) for x in part], dtype=np.uint32)
            by_size.setdefault(size, []).append((known[item_id], row))
        self.tables: list[_Windows] = []
        for size, rows in by_size.items():
            starts = np.cumsum([0, *(len(r) for _, r in rows)])
            many = [len(r) - size + 1 for _, r in rows]
            places = np.concatenate([np.arange(m) + s for m, s in zip(many, starts)]).astype(np.uint32)
            items = np.repeat(np.array([i for i, _ in rows], dtype=np.uint32), many)
            table = _Windows(np.concatenate([r for _, r in rows]), places, items, size)
            while table is not None:
                self.tables.append(table)
                table = table.rest

    @property
    def nbytes(self) -> int:
        """Without the bit tables, which are of a fixed size."""
        words = sum(t.words.nbytes for t in {id(t.words): t for t in self.tables}.values())
        return sum(t.nbytes for t in self.tables) + words + sys.getsizeof(self.number) + sum(sys.getsizeof(w) + 32 for w in self.number)

    def scan(self, texts: list[str | None]) -> Iterator[tuple[int, list[tuple[int, int]], set[int]]]:
        """For each text: number of words, hit spans (first word, end word) in order, items hit."""
        get = self.number.get
        split = [words(t) for t in texts]
        counts = np.array([len(w) for w in split], dtype=np.int64)
        ends = np.cumsum(counts)
        ids = np.fromiter((get(x, 0) for w in split for x in w), dtype=np.uint32, count=int(counts.sum()))
        spans: dict[int, list[tuple[int, int]]] = {}
        found: dict[int, set[int]] = {}
        for table in self.tables:
            at, doc, window = table.find(ids, ends)
            for d, a in zip(doc.tolist(), (at - (ends[doc] - counts[doc])).tolist()):
                spans.setdefault(d, []).append((a, a + table.size))
            for d, w in set(zip(doc.tolist(), window.tolist())):
                found.setdefault(d, set()).update(table.items[table.first[w] : table.first[w + 1]].tolist())
        for d, count in enumerate(counts.tolist()):
            yield count, merged(spans.get(d, [])), found.get(d, set())


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _rolling(ids: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` numbers."""
    last = len(ids) - size + 1
    ids = ids.astype(np.uint64)
    total = np.zeros(last, dtype=np.uint64)
    for k in range(size):
        total *= _PRIME
        total += ids[k : k + last]
    total ^= total >> np.uint64(29)
    total *= _PRIME
    return total


def _chunks(texts: list[str | None], chars: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``chars`` characters: bounds what one scan holds."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _slices(benchmark: DataFrame, n: int, item_id: str, text: str, broadcast_bytes: int) -> Iterator[list[Part]]:
    """Items in parts that make sets of bounded size; an iterator, so the driver holds one set's at a time."""
    parts: list[Part] = []
    known: set[bytes] = set()
    size = 0
    most = max(1, broadcast_bytes // (2 * (WINDOW_BYTES + WORD_BYTES)))  # windows of a part: two parts fit at least
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("i"), F.col(text).alias("t"))
    for item, t in rows.toLocalIterator():
        w = words(t)
        k = min(n, len(w))
        for at in range(0, len(w) - k + 1 if w else 0, most):
            part = w[at : at + most + k - 1]
            cost = lambda: WINDOW_BYTES * len(part) + sum(WORD_BYTES + len(x) for x in set(part) - known)
            if parts and size + cost() > broadcast_bytes:
                yield parts
                parts, known, size = [], set(), 0
            size += cost()
            known.update(part)
            parts.append((item, part, k))
    yield parts


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _passes(rows: DataFrame, text: str, slices: Iterator[list[Part]], schema: str | T.StructType, finish) -> DataFrame:
    """One pass for each slice.  ``finish(batch, texts, hits)`` makes the last pass's rows of a batch of ``rows``, hits being
    (number of words, spans, items) of each."""
    context = rows.sparkSession.sparkContext
    where, width = rows.columns.index(text), len(rows.columns)
    free = (f"hits_{i}" for i in itertools.count())
    names = [next(x for x in free if x not in rows.columns) for _ in range(2)]
    wide = T.StructType([*rows.schema, T.StructField(names[0], T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))), T.StructField(names[1], T.ArrayType(T.StringType()))])
    out, current, begun = rows, next(slices), False
    while True:
        following = next(slices, None)
        held = context.broadcast(NgramSet(current))

        def scan(batches, held=held, begun=begun, last=following is None):
            grams = held.value
            for b in batches:
                texts = b.column(where).to_pylist()
                before = zip(b.column(width).to_pylist(), b.column(width + 1).to_pylist()) if begun else itertools.repeat(((), ()))
                hits = []
                for start, end in _chunks(texts):
                    for (count, spans, items), (more, also) in zip(grams.scan(texts[start:end]), before):
                        if more:
                            spans = merged([*spans, *((x["first"], x["last"]) for x in more)])
                        hits.append((count, spans, sorted({*(grams.ids[i] for i in items), *also})))
                b = b.select(range(width))
                if last:
                    yield finish(b, texts, hits)
                else:
                    yield pa.RecordBatch.from_arrays([*b.columns, _spans_of(hits), pa.array([x[2] for x in hits], pa.list_(pa.string()))], names=wide.names)

        if following is None:
            return out.mapInArrow(trimmed(scan), schema)
        out = materialize(out.mapInArrow(trimmed(scan), wide), "hits")
        held.destroy()
        current, begun = following, True


def _spans_of(hits) -> pa.Array:
    return pa.array([[{"first": x, "last": y} for x, y in h[1]] for h in hits], _SPANS)


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, n: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_bytes: int = 256_000_000) -> DataFrame:
    """Columns doc_id, n_words, spans (array of first word, end word), items (array of strings): one row for each row of ``docs``."""

    def finish(b, texts, hits):
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([h[0] for h in hits], pa.int64()), _spans_of(hits), pa.array([h[2] for h in hits], pa.list_(pa.string()))], names=["doc_id", "n_words", "spans", "items"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return _passes(rows, "text", _slices(benchmark, n, item_id, item_text, broadcast_bytes), "doc_id bigint, n_words bigint, spans array<struct<first:bigint,last:bigint>>, items array<string>", finish)


def report(hits: DataFrame) -> DataFrame:
    """Per document: how many words are hit, by how many items and which."""
    n_hit = F.expr("aggregate(spans, 0L, (a, s) -> a + s.last - s.first)")
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, mode: str = "documents", n: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_bytes: int = 256_000_000) -> DataFrame:
    """``docs`` without contaminated documents (``mode="documents"``) or, with ``mode="spans"``, with
    the hit spans cut out of the texts (white space around a cut becomes one space).

    All columns are kept, a null text stays null.  Spans are those of the original texts, whatever the number of sets;
    nothing is shuffled.
    """
    if mode not in ("documents", "spans"):
        raise ValueError("mode is 'documents' or 'spans'")
    where = docs.columns.index(text)

    def finish(b, texts, hits):
        if mode == "documents":
            return b.filter(pa.array([not h[1] for h in hits], pa.bool_()))
        cut = [_without(t, h[1]) if h[1] else t for t, h in zip(texts, hits)]
        return b.set_column(where, b.schema.field(where), pa.array(cut, b.schema.field(where).type))

    return _passes(docs, text, _slices(benchmark, n, item_id, item_text, broadcast_bytes), docs.schema, finish)


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans."""
    import re

    places = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    parts, at = [], 0
    for first, last in spans:
        parts.append(text[at : places[first][0]].rstrip())
        at = places[last - 1][1]
    parts.append(text[at:].lstrip())
    return " ".join(p for p in parts if p)


def sha(items: list[str]) -> str:
    """What report() gives as items_sha256."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
