"""Cross-tokenizer alignment: which ids of two tokenizers stand for the same bytes, over a whole corpus.

A text is encoded by both.  A token of A and one of B are linked where their byte ranges overlap; byte offsets where tokens of both
end cut them into groups.  The count of a pair of ids is the number of documents that hold it linked.

Counts are dense matrices in stripes by A's id: stripe a % STRIPES has a row for each of its ids and a column for each id of B.  A scan
writes, for some documents at a time and for each stripe, the distinct pairs in order with the documents that hold them.  These blocks
are dealt by stripe; ``np.add.at`` adds their counts up, the row maxima give each id's best partners, and the same blocks, dealt
again by lane (LANES sets of stripes) together with their stripes' counts, are scored against them.  A lane with more than PART_BYTES of
blocks is dealt to as many parts by document, each with the lane's counts, so a common id makes more tasks and not longer ones.  A task
holds one stripe at a time, and passes a document's sums on once for all stripes of its lane.

Both tokenizers are asked for each distinct piece between single spaces once, where their files show that no token crosses them (the
first by its splitting pattern, the second as no piece has a space behind another character); whole texts otherwise.

Defined cases: null and empty texts, and those whose tokens do not give their bytes back (as after normalisation), have no tokens:
zeros and ''.  Repeated rows count as documents of their own; null ids are kept; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, trimmed

STRIPES = 256
#: Stripe by stripe, a task scores all stripes of a lane for some of the documents.
LANES = 16
#: Documents and bytes of text that make a block.
DOCS, TEXT_BYTES = 4096, 4_000_000
#: Bytes of a lane's blocks that are dealt to one task.
PART_BYTES = 64_000_000
#: Pieces that a worker remembers, and the longest that it does.
PIECES, PIECE_LENGTH = 60_000, 40

#: Fixed value: how the byte-level pre-tokeniser must read for texts to be cut at single spaces.
SPACE_SPLITTER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_NEAR_SPACE = re.compile(r" \s|\s ")
#: The same for RE2, or a space at an end, with all that Unicode or Python calls a space.
_SPACE_NEAR_SPACE = r"^S| S|S | $".replace("S", r"[\p{Z}\t-\r\x1c-\x1f\x{85}]")


#: After an id: the next of the same side, the other side, the next group, the next piece.
_MARKS = np.array([",", "|", ";", "\n"], dtype=object)


def byte_characters() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes in turn for those from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in printable)
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def pieces_of(text: str) -> list[str]:
    """The text cut at each space that stands alone between characters that are no space; these spaces are left out."""
    parts = text.split(" ")
    if not text[:1].isspace() and not text.endswith(" ") and not _NEAR_SPACE.search(text):
        return parts
    out = parts[:1]
    for i, part in enumerate(parts[1:]):
        before = parts[i]
        if before and part and not before[-1].isspace() and not part[0].isspace():
            out.append(part)
        else:
            out[-1] += " " + part
    return out


def join_bytes(table: list[bytes], ids: np.ndarray) -> bytes:
    return b"".join(map(table.__getitem__, ids.tolist()))


class Pair:
    """Two tokenizers, and what they make of the pieces met last: (A's tokens, B's tokens, groups, groups as text, linked pairs),
    None for a piece that either does not give back."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        size, back = self.a.get_vocab_size(with_added_tokens=True), byte_characters()
        entries = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * size
        for entry, i in entries.items():
            self.a_bytes[i] = bytes(back[c] for c in entry) if all(c in back for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes = [np.array([len(x) for x in table], dtype=np.int64) for table in (self.a_bytes, self.b_bytes)]
        with open(path_a, encoding="utf-8") as f:
            file = json.load(f)
        alone = file["normalizer"] is None and file["pre_tokenizer"] == SPACE_SPLITTER and file["model"]["type"] == "BPE" and not file["model"].get("dropout")
        apart = not any(re.search("[^▁]▁", p) for p in pieces) and self.b.encode("a  b") != self.b.encode("a b")
        self.by_piece = bool(alone and apart)
        self.width = len(pieces)
        self.names = np.array([str(i) for i in range(max(size, len(pieces)))], dtype=object)
        self.rows = -(-size // STRIPES)
        self.known: dict[str, tuple | None] = {}

    def place(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where a pair is counted: stripe, row and column as one number."""
        return ((a % STRIPES) * self.rows + a // STRIPES) * self.width + b

    def ids(self, pieces: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], list[bytes]]:
        """For ``pieces``, each with a space before it: both tokenizers' ids in one array each, how many of them each piece has, and the bytes.

        A gets pieces without a space at either end as one text, if texts may be cut there; ids are then dealt to pieces by their bytes."""
        texts = [b" " + p.encode() for p in pieces]
        flat_of = lambda x: (np.fromiter(itertools.chain.from_iterable(x), np.int64), np.fromiter(map(len, x), np.int64, len(x)))
        b, nb = flat_of(self.b.encode(pieces, num_threads=1))
        if self.by_piece and not any(p[:1].isspace() or p[-1:].isspace() for p in pieces):
            a = np.array(self.a.encode_batch_fast([" " + " ".join(pieces)], add_special_tokens=False)[0].ids, dtype=np.int64)
            ends, piece_ends = np.cumsum(self.sizes[0][a]), np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
            stops = np.searchsorted(ends, piece_ends)
            if len(ends) and ends[-1] == piece_ends[-1] and (ends[stops] == piece_ends).all():
                return [a, b], [np.diff(stops + 1, prepend=0), nb], texts
        a, na = flat_of([e.ids for e in self.a.encode_batch_fast([" " + p for p in pieces], add_special_tokens=False)])
        return [a, b], [na, nb], texts

    def encode(self, pieces: list[str]) -> list[tuple | None]:
        """What align() says of each piece; None where a tokenizer does not give its bytes back."""
        flat, numbers, texts = self.ids(pieces)
        tables, whole = (self.a_bytes, self.b_bytes), b"".join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        given = np.ones(len(pieces), dtype=bool)
        if not all(join_bytes(t, x) == whole for t, x in zip(tables, flat)):
            for t, x, n in zip(tables, flat, numbers):
                stops = np.cumsum(n)
                given &= [join_bytes(t, x[j - k : j]) == text for j, k, text in zip(stops.tolist(), n.tolist(), texts)]
        if given.all():
            return self.align(flat, np.cumsum(sizes), numbers)
        good = iter(self.encode([p for p, ok in zip(pieces, given) if ok]) if given.any() else [])
        return [next(good) if ok else None for ok in given]

    def align(self, flat: list[np.ndarray], piece_ends: np.ndarray, numbers: list[np.ndarray]) -> list[tuple]:
        ends = [np.cumsum(size[x]) for size, x in zip(self.sizes, flat)]
        both = np.sort(np.concatenate(ends), kind="stable")
        twice = np.append(both[1:] == both[:-1], False)
        cuts, common = both[~twice], both[twice]
        # Each stretch between two neighbouring ends lies in one token of either side, and no other has the same two.
        linked = self.place(*(x[np.searchsorted(e, cuts)] for x, e in zip(flat, ends)))
        link_stops = np.searchsorted(cuts, piece_ends, side="right")
        groups = np.diff(np.searchsorted(common, piece_ends, side="right"), prepend=0)
        side_of_group = np.concatenate([2 * np.searchsorted(common, e) + i for i, e in enumerate(ends)])
        order = np.argsort(side_of_group, kind="stable")
        at = side_of_group[order]
        last = np.append(at[1:] != at[:-1], True)
        closes = np.zeros(len(common), dtype=bool)
        closes[np.searchsorted(common, piece_ends)] = True
        mark = np.where(~last, 0, np.where(at % 2 == 0, 1, np.where(closes[at // 2], 3, 2)))
        said = "".join(itertools.chain.from_iterable(zip(self.names[np.concatenate(flat)[order]].tolist(), _MARKS[mark].tolist()))).split("\n")
        starts, held = np.append(0, link_stops[:-1]).tolist(), linked.tobytes()
        return [(na, nb, ng, s, held[8 * i : 8 * j]) for na, nb, ng, s, i, j in zip(*(n.tolist() for n in numbers), groups.tolist(), said, starts, link_stops.tolist())]

    def lookup(self, pieces: list[str]) -> list[tuple | None]:
        known = self.known
        new = [p for p in pieces if p not in known]
        found = dict(zip(new, self.encode(new))) if new else {}
        out = [found[p] if p in found else known[p] for p in pieces]
        if len(known) + len(found) > PIECES:
            known.clear()
        known.update((p, x) for p, x in found.items() if len(p) <= PIECE_LENGTH)
        return out


@functools.lru_cache(maxsize=1)
def _pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def _pieces(pair: Pair, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct pieces of a block, and each piece's document and number; a document's pieces lie together and in order."""
    given = pa.array([t or None for t in texts], pa.large_string())
    single = pc.fill_null(pc.invert(pc.match_substring_regex(given, _SPACE_NEAR_SPACE)), False) if pair.by_piece else pa.array([False] * len(texts))
    cut = pc.split_pattern(pc.if_else(single, given, None), " ")
    own = [(k, pieces_of(t) if pair.by_piece else [t]) for k, (t, done) in enumerate(zip(texts, single.to_pylist())) if t and not done]
    flat = pa.concat_arrays([cut.flatten(), pa.array([p for _, x in own for p in x], pa.large_string())]).dictionary_encode()
    many = pc.fill_null(pc.list_value_length(cut), 0).to_numpy()
    docs = np.concatenate([np.repeat(np.arange(len(texts)), many), np.repeat(np.array([k for k, _ in own], np.int64), [len(x) for _, x in own])])
    return flat.dictionary.to_pylist(), docs, flat.indices.to_numpy().astype(np.int64)


def _block(pair: Pair, texts: list[str | None]) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
    """What the documents of a block have (n_a, n_b, n_groups, n_links, groups_sha256), and their distinct links: place, document
    in the block, how often; in order."""
    pieces, docs, at = _pieces(pair, texts)
    found = pair.lookup(pieces)
    lost = np.array([x is None for x in found], dtype=bool)
    if lost.any():
        odd = np.unique(docs[lost[at]])
        whole = pair.encode([texts[k] for k in odd.tolist()]) if pair.by_piece else []  # such texts are tried as a whole
        kept = ~np.isin(docs, odd)
        again = [(k, x) for k, x in zip(odd.tolist(), whole) if x is not None]
        docs, at = np.append(docs[kept], [k for k, _ in again]).astype(np.int64), np.append(at[kept], len(found) + np.arange(len(again)))
        found = [(0, 0, 0, "", b"") if x is None else x for x in found] + [x for _, x in again]
    said = np.array([x[3] for x in found], dtype=object)
    flat = np.frombuffer(b"".join(x[4] for x in found), dtype=np.int64)
    sizes = np.array([(*x[:3], len(x[4]) // 8) for x in found], dtype=np.int64).reshape(-1, 4)
    many, starts = sizes[at, 3], (np.cumsum(sizes[:, 3]) - sizes[:, 3])[at]
    sums = np.zeros((len(texts), 4), dtype=np.int64)
    np.add.at(sums, docs, sizes[at])
    made = [(*n, "") for n in sums.tolist()]
    for i, n in zip(*_cut(docs)):
        k = int(docs[i])
        made[k] = (*made[k][:4], hashlib.sha256(";".join(said[at[i : i + n]].tolist()).encode()).hexdigest())
    # Links of a piece lie side by side: its start, repeated, plus 0, 1, 2 and so on.
    places = flat[np.repeat(starts - (np.cumsum(many) - many), many) + np.arange(many.sum())]
    distinct, times = np.unique(places * DOCS + np.repeat(docs, many), return_counts=True)
    return made, distinct // DOCS, distinct % DOCS, times


def _cut(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal numbers start, and how long they are."""
    start = np.flatnonzero(np.append(True, n[1:] != n[:-1])) if len(n) else np.zeros(0, np.int64)
    return start, np.diff(np.append(start, len(n)))


_SCAN = "doc bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, stripe int, block bigint, places binary, holders binary, docs binary, times binary"


def _pack(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x), codec="zstd", asbytes=True) if len(x) else b""


def _unpack(data: bytes, n: int, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(data, decompressed_size=n * size, codec="zstd", asbytes=True), dtype=kind, count=n) if n else np.zeros(0, kind)


def _ints(x: np.ndarray) -> bytes:
    """Numbers that are not negative, as their count, their width and their bytes."""
    kind = next(k for k in ("u1", "u2", "u4", "u8") if not len(x) or int(x.max()) < 1 << (8 * int(k[1])))
    return np.array([len(x), int(kind[1])], dtype="<u4").tobytes() + _pack(x.astype("<" + kind))


def _read(data: bytes) -> np.ndarray:
    n, width = np.frombuffer(data, dtype="<u4", count=2).tolist()
    return _unpack(data[8:], n, f"<u{width}").astype(np.int64)


def scan(docs: DataFrame, path_a: str, path_b: str, text_bytes: int) -> DataFrame:
    """Rows of two kinds: a document's (stripe null), and those of a block and stripe: distinct places as gaps, how many documents hold
    each, these, and how often each does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pair, block = _pair(path_a, path_b), TaskContext.get().partitionId() << 24
        for batch in batches:
            ids, texts = (c.to_pylist() for c in batch.columns)
            i = 0
            while i < len(texts):
                j = i + 1
                size = len(texts[i] or "")
                while j < min(i + DOCS, len(texts)) and size < text_bytes:
                    size += len(texts[j] or "")
                    j += 1
                made, places, who, times = _block(pair, texts[i:j])
                rows = [(block * DOCS + k, doc_id, *d, None, None, None, None, None, None) for k, (doc_id, d) in enumerate(zip(ids[i:j], made))]
                stripes = places // (pair.rows * pair.width)
                for s, n in zip(*_cut(stripes)):
                    own = places[s : s + n]
                    first, many = _cut(own)
                    local = own[first] - stripes[s] * pair.rows * pair.width
                    rows.append((*[None] * 7, int(stripes[s]), block, _ints(np.diff(local, prepend=0)), _ints(many), _ints(who[s : s + n]), _ints(times[s : s + n])))
                yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, r)) for r in rows], schema=_ARROW)
                block, i = block + 1, j

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(trimmed(run), _SCAN)


_NAMES = [c.split()[0] for c in _SCAN.split(", ")]
_ARROW = pa.schema([(n, {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in _SCAN.split(", "))])


def _sum_counts(table: DataFrame, cells: int, keys: list[str]) -> DataFrame:
    """(stripe, places, holders): the counts of all rows of a key added up in a stripe's matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, now = np.zeros(cells, dtype=np.int64), None
        touched: list[np.ndarray] = []  # while they are few beside the matrix

        def done() -> pa.RecordBatch:
            at = np.unique(np.concatenate(touched)) if touched else np.flatnonzero(matrix)
            touched.clear()
            out = pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([_ints(np.diff(at, prepend=0))], pa.binary()), pa.array([_ints(matrix[at])], pa.binary())], ["stripe", "places", "holders"])
            matrix[at] = 0
            return out

        for b in batches:
            for key, places, holders in zip(zip(*(b.column(k).to_pylist() for k in keys)), b.column("places").to_pylist(), b.column("holders").to_pylist()):
                if now is not None and key != now:
                    yield done()
                places, few = np.cumsum(_read(places)), now != key or bool(touched)
                now = key
                if few:
                    touched.append(places)
                    if sum(map(len, touched)) > cells // 16:
                        touched.clear()
                np.add.at(matrix, places, _read(holders))
        if now is not None:
            yield done()

    dealt = table.select(*keys, "places", "holders").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(trimmed(run), "stripe int, places binary, holders binary")


#: Documents whose scores a task adds up before it passes them on.
HELD_DOCS = 4_000_000


def _score(links: DataFrame, counts: DataFrame, rows: int, width: int) -> DataFrame:
    """(doc, n_best, count_sum) of each document and lane.  ``links`` and ``counts`` are dealt by lane and part; a stripe's counts come
    before its links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, best, filled = np.zeros(rows * width, dtype=np.int64), np.zeros(rows, dtype=np.int64), np.zeros(0, np.int64)
        total: dict[int, np.ndarray] = {}
        size = 0

        def passed_on() -> Iterator[pa.RecordBatch]:
            for block, t in total.items():
                some = np.flatnonzero(t[1])
                yield pa.RecordBatch.from_arrays([pa.array(block * DOCS + some), pa.array(t[0, some]), pa.array(t[1, some])], ["doc", "n_best", "count_sum"])
            total.clear()

        for b in batches:
            for block, places, holders, who, times in zip(*(b.column(c).to_pylist() for c in ("block", "places", "holders", "docs", "times"))):
                places, holders = np.cumsum(_read(places)), _read(holders)
                if who is None:  # a stripe's counts
                    matrix[filled] = 0
                    matrix[places], filled = holders, places
                    best[:] = 0
                    np.maximum.at(best, places // width, holders)
                    continue
                count = matrix[places]
                is_best = count == best[places // width]
                who, times = _read(who), _read(times)
                if not len(who):
                    continue
                held, last = total.get(block), int(who.max()) + 1
                if held is None or held.shape[1] < last:
                    if size >= HELD_DOCS:
                        yield from passed_on()
                        size, held = 0, None
                    more = last if held is None else last - held.shape[1]
                    total[block] = np.zeros((2, last), dtype=np.int64) if held is None else np.pad(held, ((0, 0), (0, more)))
                    size += more
                np.add.at(total[block][0], who, times * np.repeat(is_best, holders))
                np.add.at(total[block][1], who, times * np.repeat(count, holders))
        yield from passed_on()

    names = ["lane", "part", "stripe", "block", "places", "holders", "docs", "times"]
    both = links.select(*names).unionByName(counts.select(*names))
    dealt = both.repartition("lane", "part").sortWithinPartitions("lane", "part", "stripe", F.col("block").asc_nulls_first())
    return dealt.mapInArrow(trimmed(run), "doc bigint, n_best bigint, count_sum bigint")


@dataclass
class Alignment:
    #: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256
    documents: DataFrame
    #: (stripe, places, holders), packed
    counts: DataFrame
    rows: int
    width: int

    def pairs(self) -> DataFrame:
        """(a, b, count, best): each linked pair of ids, in how many documents it stands, and whether no other of its A id stands in more."""
        rows, width = self.rows, self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for stripe, places, holders in zip(*(c.to_pylist() for c in batch.columns)):
                    at, n = np.cumsum(_read(places)), _read(holders)
                    most = np.zeros(rows, dtype=np.int64)
                    np.maximum.at(most, at // width, n)
                    yield pa.RecordBatch.from_arrays([pa.array(at // width * STRIPES + stripe), pa.array(at % width), pa.array(n), pa.array(n == most[at // width])], ["a", "b", "count", "best"])

        return self.counts.select("stripe", "places", "holders").mapInArrow(run, "a bigint, b bigint, count bigint, best boolean")


def align(docs: DataFrame, path_a: str, path_b: str, text_bytes: int = TEXT_BYTES) -> Alignment:
    """Aligns ``docs`` (doc_id, text) under a byte-level BPE file of the tokenizers library and a sentencepiece model.  The scan is written once."""
    pair = _pair(path_a, path_b)
    rows, width = pair.rows, pair.width
    table = materialize(scan(docs, path_a, path_b, text_bytes), "links")
    links, own = table.where("stripe is not null"), table.where("stripe is null")
    # LANES rows: into how many parts each lane goes.
    size = F.octet_length("places") + F.octet_length("holders") + F.octet_length("docs") + F.octet_length("times")
    lane = F.pmod(F.col("stripe"), F.lit(LANES)).alias("lane")
    parts = {r["lane"]: -(-r["n"] // PART_BYTES) for r in links.groupBy(lane).agg(F.sum(size).alias("n")).collect()}
    many = F.element_at(F.array(*[F.lit(parts.get(n, 1)).cast("int") for n in range(LANES)]), F.col("lane") + 1)
    dealt = links.withColumn("lane", lane).withColumn("part", F.pmod(F.xxhash64("block"), many).cast("int"))
    partial = _sum_counts(dealt, rows * width, ["stripe", "part"])
    counts = materialize(_sum_counts(partial, rows * width, ["stripe"]), "counts")
    to_parts = counts.withColumn("lane", lane).select("lane", F.explode(F.sequence(F.lit(0), many - 1)).alias("part"), "stripe", F.lit(None).cast("bigint").alias("block"), "places", "holders", F.lit(None).cast("binary").alias("docs"), F.lit(None).cast("binary").alias("times"))
    scored = _score(dealt, to_parts, rows, width).groupBy("doc").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    documents = own.select("doc", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(scored, "doc", "left")
    return Alignment(documents.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"), counts, rows, width)
