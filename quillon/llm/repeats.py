"""Repeated windows of bytes across documents, by a radix sort of suffixes that stops at the window's length.

A suffix is looked at through its first ``window`` bytes alone, and sorted by most-significant-digit passes; a group that lies in one
document is dropped after each, and the groups that are left at full depth are exactly the repeated windows.

1. The first digit of a suffix is the least hash of the GRAM-byte strings in its window.  Equal windows have equal digits, and
   neighbouring suffixes mostly share theirs, so a run of them travels as one row: digit, hash of the run's bytes, document.  Rows
   are dealt by the digit.
2. The second digit is the whole run (its 64-bit hash; with the first digit 128 bits): a run that a smaller document also has is repeated in all
   its windows.  Of each kind of run, the smallest document's is left, if its group has others: mostly the ends of shared passages.
3. The bytes of these are fetched and sorted in numpy through the window's bytes, eight at a time, group by group of the first digit.  A group
   with more than CROWD kinds of runs is dealt by whole windows instead, combined before the shuffle, so no group is held whole.

Bytes of a window that also starts in a document with a smaller doc_id are removed.  Documents are read as UTF-8 and windows do not
cross them.  Defined cases: null and empty texts have no bytes; texts shorter than the window keep all; rows with the same doc_id remove
nothing from each other; null ids come after all others and remove nothing from each other; an empty table gives no rows.  Long texts
go through memory in segments of ``segment`` bytes that overlap by a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, trimmed

#: Bytes of the strings that are hashed for the first digit.
GRAM = 16
#: Bytes of text that are worked on at a time.
SEGMENT = 300_000
#: Kinds of runs in a group that are sorted in one place.
CROWD = 50_000
#: Runs of documents read together that are combined before the shuffle.
COMBINE = 400_000
#: Rows that are sorted at a time, a group at least.
SORT_ROWS = 20_000
_LAST = (1 << 63) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits (multiply and shift, a bijection)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as a number."""
    x = data.astype(np.uint64)
    for shift in (1, 2, 4):
        x = x[:-shift] | (x[shift:] << np.uint64(8 * shift))
    return x


def _hashes(words: np.ndarray, at, length: int) -> np.ndarray:
    """A hash of the ``length`` bytes from each of the positions (a slice of neighbours or an array) on."""
    look = (lambda o: words[at.start + o : at.stop + o]) if isinstance(at, slice) else (lambda o: words[at + o])
    x = _mix(look(0) + np.uint64(length))
    for o in [*range(8, length - 8, 8), length - 8]:
        x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + look(o))
    return x


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step :]) if step < width else x


def find_runs(data: np.ndarray, bounds: list[int], window: int):
    """Runs of neighbouring windows with the same digit: start, number of windows (``window`` at most, so that the first and the last have all
    the run's bytes), digit, hash.  ``bounds``: where each text starts and the last ends."""
    n = len(data) - window + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 4
    words = _words(data)
    digit = _least(_hashes(words, slice(0, len(data) - GRAM + 1), GRAM), window - GRAM + 1)
    inside = np.ones(n + 1, dtype=bool)
    inside[n] = False
    for b in bounds[1:-1]:
        inside[max(0, b - window + 1) : b] = False
    same = np.zeros(n + 1, dtype=bool)
    same[1:n] = (digit[1:] == digit[:-1]) & inside[: n - 1]
    starts = np.flatnonzero(inside & ~same)
    stops = np.flatnonzero(inside[:n] & ~(same[1:] & inside[1:])) + 1
    length = stops - starts
    pieces = -(-length // window)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = np.repeat(starts, pieces) + nth * window
    length = np.minimum(window, np.repeat(stops, pieces) - starts)
    own = _mix(_hashes(words, starts, window) * np.uint64(3) + _mix(_hashes(words, starts + length - 1, window) + length.astype(np.uint64)))
    return starts, length, digit[starts].view(np.int64), own.view(np.int64)


def segments(bodies: list[bytes], window: int, segment: int) -> Iterator[tuple[np.ndarray, list[int], list[int], list[int]]]:
    """Bytes of some texts, or of a part of a long one: data, bounds, which text, where in it."""
    held, which, at, size = [], [], [], 0

    def packed():
        return np.frombuffer(b"".join(held), dtype=np.uint8), np.cumsum([0, *map(len, held)]).tolist(), which, at

    for i, body in enumerate(bodies):
        for start in range(0, max(1, len(body) - window + 1), segment):
            part = body[start : start + segment + window - 1]
            if held and size + len(part) > segment:
                yield packed()
                held, which, at, size = [], [], [], 0
            held.append(part)
            which.append(i)
            at.append(start)
            size += len(part)
    if held:
        yield packed()


def _runs(bodies: list[bytes], window: int, segment: int):
    """For each segment: data, runs' starts in it, numbers of windows, digits, hashes, the texts and the places in these."""
    for data, bounds, which, at in segments(bodies, window, segment):
        starts, length, digit, own = find_runs(data, bounds, window)
        s = np.searchsorted(bounds, starts, side="right") - 1
        yield data, starts, length, digit, own, np.array(which, np.int64)[s], starts - np.array(bounds, np.int64)[s] + np.array(at, np.int64)[s]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, the order of documents, the key under which a document's runs are found, and its bytes."""
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)).alias("d"), F.col("doc_id").isNotNull().alias("named"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64(text)).alias("k"), F.coalesce(text.cast("binary"), F.lit(b"")).alias("body"),
    )


_NAMED, _KNOWN = 1, 2


def _scan(keyed: DataFrame, window: int, segment: int) -> DataFrame:
    """(g, own, k, flags): a run once for each document; of documents read together those after the first that has it
    are known to repeat it, and are dealt by document."""

    def combined(digit, own, d, named, k) -> pa.RecordBatch:
        order = np.lexsort((k, d, own))
        digit, own, d, named, k = (x[order] for x in (digit, own, d, named, k))
        first = np.append(True, own[1:] != own[:-1])
        again = ~first & np.append(False, (k[1:] == k[:-1]) & (named[1:] == named[:-1]))
        known = d > d[np.flatnonzero(first)][np.cumsum(first) - 1]
        g = np.where(known, _mix(k.view(np.uint64)).view(np.int64), digit)
        flags = (named * _NAMED + known * _KNOWN).astype(np.int8)
        return pa.RecordBatch.from_arrays([pa.array(x[~again]) for x in (g, own, k, flags)], ["g", "own", "k", "flags"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            d, named, k = (np.array(b.column(c).to_pylist()) for c in ("d", "named", "k"))
            held = []
            for _, _, _, digit, own, doc, _ in _runs(b.column("body").to_pylist(), window, segment):
                held.append((digit, own, d[doc], named[doc], k[doc]))
                if sum(len(x[0]) for x in held) > COMBINE:
                    yield combined(*map(np.concatenate, zip(*held)))
                    held = []
            if sum(len(x[0]) for x in held):
                yield combined(*map(np.concatenate, zip(*held)))

    return keyed.select("d", "named", "k", "body").mapInArrow(trimmed(run), "g bigint, own bigint, k bigint, flags tinyint")


def _first_two_digits(runs: DataFrame) -> DataFrame:
    """(named, k, done, ask, crowded): hashes of a document's runs that are repeated throughout, of those whose bytes are needed, and
    of those of crowded groups.  One shuffle; groups are sorted and streamed, and spill."""
    flag = lambda bit: F.col("flags").bitwiseAND(bit) > 0
    named, known = F.col("named"), F.col("known")
    # The digit comes first in the windows, as Spark sorts by the first column's bits.
    group, kind = Window.partitionBy("g", "known"), Window.partitionBy("g", "known", "own")
    rows = runs.repartition("g").select("g", "own", "k", flag(_NAMED).alias("named"), flag(_KNOWN).alias("known"))
    rows = rows.select("*", F.when(named, F.col("k")).otherwise(F.lit(_LAST)).alias("d"))
    rows = rows.select("*", F.min("d").over(group).alias("least"), F.max("d").over(group).alias("most")).where(known | (F.col("least") < F.col("most")))
    rows = rows.select("*", F.min("d").over(kind).alias("first")).select("*", (F.col("d") == F.col("first")).alias("is_first"))
    rows = rows.select("*", (F.min("own").over(group) != F.max("own").over(group)).alias("other"), F.count_if("is_first").over(group).alias("kinds"))
    done = known | (F.col("d") > F.col("first"))
    open_ = ~done & F.col("other")
    rows = rows.select(named.alias("named"), "k", "own", done.alias("is_done"), open_.alias("is_open"), "kinds").where("is_done or is_open")
    pick = lambda c: F.collect_set(F.when(c, F.col("own")))
    few = F.col("kinds") <= CROWD
    return rows.groupBy("named", "k").agg(pick(F.col("is_done")).alias("done"), pick(F.col("is_open") & few).alias("ask"), pick(F.col("is_open") & ~few).alias("crowded"))


_PIECE = "g bigint, body binary, at int, own bigint, d bigint, named boolean, k bigint, crowded boolean"


def _fetch(keyed: DataFrame, marks: DataFrame, window: int, segment: int) -> DataFrame:
    """The bytes that the last passes need: a run's, or in a crowded group those of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, named, k, bodies = (b.column(c).to_pylist() for c in ("d", "named", "k", "body"))
            wanted = [np.array(x + y, dtype=np.int64) for x, y in zip(b.column("ask").to_pylist(), b.column("crowded").to_pylist())]
            dense = [set(x) for x in b.column("crowded").to_pylist()]
            owners = np.repeat(np.arange(len(wanted)), [len(x) for x in wanted])
            pairs = set(zip(owners.tolist(), np.concatenate(wanted).tolist())) if len(owners) else set()
            for data, starts, length, digit, own, doc, _ in _runs(bodies, window, segment):
                rows, raw = [], data.tobytes()
                candidates = np.flatnonzero(np.isin(own, np.concatenate(wanted)))
                for i in candidates.tolist():
                    p, h = int(doc[i]), int(own[i])
                    if (p, h) not in pairs:
                        continue
                    s, n = int(starts[i]), int(length[i])
                    about = (h, d[p], named[p], k[p])
                    if h in dense[p]:
                        rows += [(0, raw[s + j : s + j + window], j, *about, True) for j in range(n)]
                    else:
                        rows.append((int(digit[i]), raw[s : s + n + window - 1], 0, *about, False))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _PIECE_TYPES)], _PIECE_NAMES)

    asked = marks.where((F.size("ask") > 0) | (F.size("crowded") > 0)).select("named", "k", "ask", "crowded")
    return keyed.select("d", "named", "k", "body").join(asked, ["named", "k"]).select("d", "named", "k", "body", "ask", "crowded").mapInArrow(trimmed(run), _PIECE)


_PIECE_NAMES = [c.split()[0] for c in _PIECE.split(", ")]
_PIECE_TYPES = [{"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}[c.split()[1]] for c in _PIECE.split(", ")]


def radix(group: np.ndarray, bodies: list[bytes], d: np.ndarray, window: int) -> np.ndarray:
    """For each run of bytes the windows, as bits, that a smaller document of its group has too: a radix sort by eight bytes a pass,
    in which groups of a single document drop out."""
    size = np.fromiter(map(len, bodies), np.int64, len(bodies))
    words = _words(np.frombuffer(b"".join(bodies) + b"\0" * 8, dtype=np.uint8)).byteswap()
    n = size - window + 1
    piece = np.repeat(np.arange(len(bodies)), n)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = (np.cumsum(size) - size)[piece] + nth
    rank = group[piece]
    for offset in [None, *range(0, window - 8, 8), window - 8]:
        if offset is None:
            order = np.argsort(rank, kind="stable")
            change = rank[order][1:] != rank[order][:-1]
        else:
            digit = words[at + offset]
            order = np.lexsort((digit, rank))
            change = (rank[order][1:] != rank[order][:-1]) | (digit[order][1:] != digit[order][:-1])
        if not len(order):
            break
        piece, nth, at = piece[order], nth[order], at[order]
        start = np.flatnonzero(np.append(True, change))
        rank = np.cumsum(np.append(False, change))
        own = d[piece]
        least, most = np.minimum.reduceat(own, start), np.maximum.reduceat(own, start)
        kept = (least < most)[rank]
        piece, nth, at, rank, first = piece[kept], nth[kept], at[kept], rank[kept], least[rank[kept]]
    found = np.zeros(len(bodies), dtype=np.int64)
    if len(piece):
        hit = d[piece] > first
        np.bitwise_or.at(found, piece[hit], np.int64(1) << nth[hit])
    return found


_MARK = "named boolean, k bigint, own bigint, bits bigint"


def _sort_groups(pieces: DataFrame, window: int) -> DataFrame:
    """Runs with repeated windows, from the groups that are not crowded; some whole groups are in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(rows: pa.Table) -> pa.RecordBatch:
            column = lambda c: rows.column(c).to_numpy()
            bits = radix(column("g"), rows.column("body").to_pylist(), column("d"), window)
            hit = np.flatnonzero(bits)
            return pa.RecordBatch.from_arrays([*(rows.column(c).take(pa.array(hit)).combine_chunks() for c in ("named", "k", "own")), pa.array(bits[hit])], ["named", "k", "own", "bits"])

        for b in batches:
            held.append(b)
            if sum(map(len, held)) >= SORT_ROWS:
                rows = pa.Table.from_batches(held)
                g = rows.column("g").to_numpy()
                cut = int(np.searchsorted(g, g[-1]))  # the last group may go on
                if cut:
                    yield done(rows.slice(0, cut))
                    held = rows.slice(cut).to_batches()
        if held:
            yield done(pa.Table.from_batches(held))

    dealt = pieces.where("not crowded").select("g", "body", "own", "d", "named", "k").repartition("g").sortWithinPartitions("g")
    return dealt.mapInArrow(trimmed(run), _MARK)


def _sort_windows(pieces: DataFrame) -> DataFrame:
    """The same for crowded groups: the smallest document of each window by an aggregate, combined before the shuffle."""
    single = pieces.where("crowded").select("body", "at", "own", "d", "named", "k")
    first = single.groupBy("body").agg(F.min("d").alias("first"))
    hit = single.join(first, "body").where("d > first")
    return hit.groupBy("named", "k", "own").agg(F.expr("bit_or(shiftleft(1L, at))").alias("bits"))


_RESULT = "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"


def _remove(keyed: DataFrame, marks: DataFrame, window: int, segment: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, bodies, done, some = (b.column(c).to_pylist() for c in ("doc_id", "body", "done", "some"))
            marked = [i for i in range(len(ids)) if done[i] or some[i]]
            cover = {i: np.zeros(len(bodies[i]) + 1, dtype=np.int32) for i in marked}
            full = {i: np.array(sorted(done[i] or []), dtype=np.int64) for i in marked}
            bits = {i: {x["own"]: x["bits"] for x in some[i] or []} for i in marked}
            for _, _, length, _, own, doc, place in _runs([bodies[i] for i in marked], window, segment):
                bound = np.append(np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else [], len(doc)).astype(int).tolist()
                for s, e in zip(bound, bound[1:]):
                    i = marked[int(doc[s])]
                    all_ = np.isin(own[s:e], full[i])
                    np.add.at(cover[i], place[s:e][all_], 1)
                    np.add.at(cover[i], (place[s:e] + length[s:e])[all_] + window - 1, -1)
                    if bits[i]:
                        for j in np.flatnonzero(np.isin(own[s:e], np.array(list(bits[i])))).tolist():
                            b_ = bits[i][int(own[s + j])]
                            w = int(place[s + j]) + np.flatnonzero([b_ >> x & 1 for x in range(int(length[s + j]))])
                            np.add.at(cover[i], w, 1)
                            np.add.at(cover[i], w + window, -1)
            spans, kept = [[] for _ in ids], list(bodies)
            for i in marked:
                gone = np.diff((np.cumsum(cover[i]) > 0).astype(np.int8), prepend=0)
                spans[i] = [{"start": s, "end": e} for s, e in zip(np.flatnonzero(gone == 1).tolist(), np.flatnonzero(gone == -1).tolist())]
                stays = zip([0, *(x["end"] for x in spans[i])], [*(x["start"] for x in spans[i]), len(bodies[i])])
                kept[i] = b"".join(bodies[i][s:e] for s, e in stays)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(len, bodies), pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return keyed.select("doc_id", "named", "k", "body").join(marks, ["named", "k"], "left").select("doc_id", "body", "done", "some").mapInArrow(trimmed(run), _RESULT)


def remove_repeats(docs: DataFrame, window: int = 50, segment: int = SEGMENT) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): the maximal removed runs of bytes of each text of ``docs`` (doc_id, text), and the bytes that stay."""
    if not 2 * GRAM <= window <= 62:
        raise ValueError(f"a window has {2 * GRAM} to 62 bytes")
    keyed = _keyed(docs)
    marks = materialize(_first_two_digits(_scan(keyed, window, segment)), "runs")
    pieces = materialize(_fetch(keyed, marks, window, segment), "pieces")
    parts = _sort_groups(pieces, window).unionByName(_sort_windows(pieces))
    some = parts.groupBy("named", "k").agg(F.collect_list(F.struct("own", "bits")).alias("some"))
    found = materialize(marks.select("named", "k", "done").join(some, ["named", "k"], "full"), "repeats")
    return _remove(keyed, found, window, segment)


def report(found: DataFrame) -> DataFrame:
    size = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", size.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
