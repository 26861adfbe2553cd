"""Token-ID output: fixed-width bit packing with block offsets.

File format (little-endian), one file for each range of doc_ids, ``part-NNNNN-attempt.qtok``:

    magic "QTOK0001"
    blocks      each ``block`` ids, ``bits`` bits an id, low bit first, padded to whole bytes
    doc_ids     int64[n_docs]; has_id uint8[n_docs]; n_tokens int64[n_docs]
    offsets     int64[n_blocks + 1]: where each block begins, and the end of the last
    trailer     int64 x 6: n_docs, n_tokens, n_blocks, block, bits, start of doc_ids; then the magic

``bits`` is the least that holds the vocabulary.  All blocks but the last have as many ids, so id i
is in block i // block and blocks unpack with numpy on their own.  Each attempt of a task has a file of
its own, and the list of files names that of the attempt which Spark committed.
Files go through pyarrow's file systems, so any store with a URI that it knows can hold them.

Defined cases: null texts are empty and have the end id alone; null doc_ids sort first; rows with
the same doc_id are ordered by a hash of the text; an empty table writes no tokens and reads as no rows.
"""

from __future__ import annotations

import itertools
import json
import os
import threading
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_system, materialize, new_folder, trim, trimmed

MAGIC = b"QTOK0001"
#: Bytes that a worker's store of words and ids may take.
STORE_BYTES = 64_000_000
#: Bytes of text that are encoded at a time, a document at least.
SLICE_BYTES = 2_000_000

#: The normaliser and pre-tokeniser for which texts may be encoded word by word, and marks that end a word.
WORD_NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_SPLITTER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}
#: All ASCII marks but the apostrophe, with which some words end.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as ``bits`` bits each, low bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    """The first ``count`` ids of a block, as unsigned 32-bit integers."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=count).astype("<u4")
    planes = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return (planes.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(1).astype("<u4")


class WordStore:
    """Ids of words that a worker has met at least twice, in ``limit`` bytes at most.

    A word enters when it comes a second time (a table of hashes tells; a clash lets one in early).  When the
    store is full, the half that has been there longest goes."""

    #: What a word costs besides its letters and ids: two objects and their place in the table.
    EACH = 200

    def __init__(self, limit: int):
        self.limit, self.size = limit, 0
        self.known: dict[str, bytes] = {}
        self.seen = np.zeros(1 << 21, dtype=bool)

    def get(self, words: list[str]) -> list[bytes | None]:
        return list(map(self.known.get, words))

    def cost(self, word: str, ids: bytes) -> int:
        return self.EACH + 4 * len(word) + len(ids)

    def offer(self, words: list[str], ids: list[bytes]) -> None:
        places = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)) & (len(self.seen) - 1)
        for i in np.flatnonzero(self.seen[places]).tolist():
            cost = self.cost(words[i], ids[i])
            if self.size + cost > self.limit:
                for old in list(itertools.islice(self.known, (len(self.known) + 1) // 2)):
                    self.size -= self.cost(old, self.known.pop(old))
            if cost <= self.limit // 100 and words[i] not in self.known:
                self.known[words[i]] = ids[i]
                self.size += cost
        self.seen[places] = True
        if np.count_nonzero(self.seen) * 2 > len(self.seen):
            self.seen[:] = False


class Encoder:
    """A tokenizer of the tokenizers library, asked for each word once as far as may be.

    With WORD_NORMALISER and WORD_SPLITTER (the tokenizer's own file tells) and a vocabulary whose tokens at the end
    of a word carry a suffix, the ids of a text are those of its space-separated pieces in turn.  Texts of
    Latin-1 characters are composed and lower-cased one by one, so their pieces are lower-cased first, and a
    run of marks behind a letter or digit is a piece of its own, as it is to the splitter.  A batch is cut and numbered by Arrow;
    each distinct piece is looked up in the store or goes to the library (runs of letters many at a time, their ids cut
    behind the tokens that end a word), and numpy lays the ids of all pieces out.  Any other tokenizer, and any
    text with a special token in it, gets whole texts.
    """

    def __init__(self, path: str, store_bytes: int = STORE_BYTES):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        # A task has one core; the library's own threads would wait for work on all of them.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.store = WordStore(store_bytes)
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, end = file["model"], file["model"].get("end_of_word_suffix")
        plain = not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        same = file["normalizer"] == WORD_NORMALISER and file["pre_tokenizer"] == WORD_SPLITTER
        self.by_word = bool(same and plain and end and model["type"] == "BPE" and not any(file[x] for x in ("truncation", "padding")))
        if self.by_word:
            self.ends = np.zeros(self.vocabulary, dtype=bool)
            for token, i in self.library.get_vocab(with_added_tokens=False).items():
                self.ends[i] = token.endswith(end)
            # For runs of lower-case Latin-1 letters: of all steps only the one to byte-level characters changes them.
            self.letters = Tokenizer.from_file(path)
            self.letters.normalizer, self.letters.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()

    def _each(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]

    def _runs(self, words: list[str]) -> list[bytes]:
        """Ids of runs of lower-case Latin-1 letters."""
        out: list[bytes] = []
        for i in range(0, len(words), 10_000):
            groups = [words[j : j + 500] for j in range(i, min(i + 10_000, len(words)), 500)]
            joined = [" ".join(g) for g in groups]
            joined = [x if x.isascii() else x.encode().decode("latin-1").translate(_BYTE_LEVEL) for x in joined]
            for group, e in zip(groups, self.letters.encode_batch_fast(joined, add_special_tokens=False)):
                ids = np.array(e.ids, dtype="<u4")
                cuts = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
                if len(cuts) != len(group):
                    out += self._each(group)
                    continue
                data = ids.tobytes()
                out += [data[x:y] for x, y in zip([0, *cuts], cuts)]
        return out

    def _distinct(self, pieces: pa.Array) -> list[bytes]:
        """Ids of distinct pieces."""
        words = _strings(pieces)
        found = self.store.get(words)
        new = np.fromiter((ids is None for ids in found), dtype=bool, count=len(found))
        run = pc.match_substring_regex(pieces, "^[a-zß-öø-ÿ]+$").to_numpy(zero_copy_only=False)
        for places, encode in ((np.flatnonzero(new & run).tolist(), self._runs), (np.flatnonzero(new & ~run).tolist(), self._each)):
            if places:
                names = [words[i] for i in places]
                ids = encode(names)
                self.store.offer(names, ids)
                for i, x in zip(places, ids):
                    found[i] = x
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (strings or null), one text behind the other, and how many each has."""
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            return self._whole(texts)
        low = pc.utf8_lower(texts)
        whole = pa.array(np.zeros(len(texts), dtype=bool))
        for token in self.special:
            whole = pc.or_(whole, pc.match_substring(low, token.lower()))
        if not pc.any(whole).as_py():
            return self._by_word(texts, low)
        # Texts between those with a special token, and these, in turn.
        borders = np.flatnonzero(np.diff(whole.to_numpy(zero_copy_only=False), prepend=True, append=True) != 0)
        borders = sorted({0, len(texts), *borders.tolist()})
        parts = [self._whole(texts.slice(a, b - a)) if whole[a].as_py() else self._by_word(texts.slice(a, b - a), low.slice(a, b - a)) for a, b in zip(borders, borders[1:])]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array(e.ids, dtype="<u4") for e in self.library.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        return np.concatenate([np.zeros(0, dtype="<u4"), *ids]), np.array([len(x) for x in ids], dtype=np.int64)

    def _by_word(self, texts: pa.Array, low: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)
        # In UTF-8 a byte from 0xC4 on begins a character beyond Latin-1.
        at, data = _bytes_of(texts)
        beyond = np.flatnonzero(data >= 0xC4)
        latin = pa.array(np.searchsorted(beyond, at[1:]) == np.searchsorted(beyond, at[:-1]))
        pieces = pc.split_pattern(pc.if_else(latin, pc.replace_substring(low, "\n", " "), texts), " ")
        coded = pieces.flatten().dictionary_encode()
        words, index = coded.dictionary, coded.indices.to_numpy()
        base = pc.utf8_rtrim(words, characters=MARKS)
        (ends, data), size = _bytes_of(base), pc.binary_length(words).to_numpy()
        data = np.concatenate([np.zeros(2, dtype=np.uint8), data])  # so that any word has a last byte but one
        last, before = data[ends[1:] + 1], data[ends[1:]]
        letter = _ALNUM[last] | ((before == 0xC3) & (last >= 0x80) & (last <= 0xBF) & (last != 0x97) & (last != 0xB7))
        kept = np.diff(ends)
        marked = letter & (kept > 0) & (kept < size)
        chosen = pa.array(marked)
        tails = [w[n:] for w, n in zip(_strings(words.filter(chosen)), pc.utf8_length(base.filter(chosen)).to_numpy().tolist())]
        base = pc.if_else(chosen, base, words)
        tail = np.zeros(len(words), dtype=np.int32)
        both = pa.concat_arrays([base, pa.array(tails, pa.string())]).dictionary_encode()
        values = [b"", *self._distinct(both.dictionary)]
        number = both.indices.to_numpy().astype(np.int32) + 1
        tail[marked] = number[len(words) :]
        parts = np.stack([number[: len(words)], tail], 1)[index].ravel()
        count = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // 4
        first, flat = np.cumsum(count) - count, np.frombuffer(b"".join(values), dtype="<u4")
        many = count[parts]
        before = np.cumsum(many) - many
        ids = flat[np.repeat(first[parts] - before, many) + np.arange(int(many.sum()))]
        offsets = pieces.offsets.to_numpy()
        return ids, np.add.reduceat(many, 2 * (offsets[:-1] - offsets[0]).astype(np.int64))


_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", dtype=np.uint8)] = True
#: Characters that stand for the bytes 0x80 to 0xBF of a letter in a byte-level vocabulary: printable ones for themselves,
#: the other 33, in order, for U+0122 on (after the 34 below 0x80).
_BYTE_LEVEL = {b: b for b in range(256)} | {b: 0x122 + i for i, b in enumerate([*range(0x80, 0xA1), 0xAD])}


def _strings(strings: pa.Array) -> list[str]:
    return strings.to_numpy(zero_copy_only=False).tolist()


def _bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each string begins, and the end of the last, in the bytes of all."""
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, dtype=np.int32, count=len(strings) + 1, offset=4 * strings.offset).astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return at - at[0], data[at[0] : at[-1]]


def _slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Runs of texts of about ``size`` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield texts.slice(at, to - at)
        at = to


_encoders: dict[str, Encoder] = {}
_idle: list[threading.Timer] = []
#: A worker process lives on after its tasks; so long after the last one it gives up vocabulary and words.
IDLE_SECONDS = 5.0


def encoder_for(path: str) -> Encoder:
    """One for each worker process, so that its tasks load the vocabulary once and share the words."""
    while _idle:
        _idle.pop().cancel()
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def release_encoders() -> None:
    """Gives the encoders up unless a task asks for one soon; one that runs has its own reference."""

    def give_up():
        _encoders.clear()
        trim()

    timer = threading.Timer(IDLE_SECONDS, give_up)
    timer.daemon = True
    _idle.append(timer)
    timer.start()


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, folder: str, *, doc_id: str = "doc_id", text: str = "text", block: int = 65_536) -> DataFrame:
    """Encodes every text, appends ``end_id`` and writes the files.  Returns a row for each file:
    part, file, n_docs, n_tokens.  Documents are range-partitioned by doc_id and sorted in each
    part; a worker holds one block of ids and the index of its file."""

    def write(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        encoder = encoder_for(tokenizer)
        bits = bits_for(encoder.vocabulary)
        fs, path = file_system(folder)
        fs.create_dir(path, recursive=True)
        name = f"part-{part:05d}-{attempt}.qtok"
        offsets, doc_ids, present, lengths = [len(MAGIC)], [], [], []
        with fs.open_output_stream(f"{path}/{name}", compression=None) as out:
            out.write(MAGIC)
            rest = np.zeros(0, dtype="<u4")

            def put(ids: np.ndarray) -> None:
                packed = pack(ids, bits)
                out.write(packed)
                offsets.append(offsets[-1] + len(packed))

            for b in batches:
                doc_ids.append(pc.fill_null(b.column(0), 0).to_numpy())
                present.append(b.column(0).is_valid().to_numpy(zero_copy_only=False))
                for texts in _slices(b.column(1)):
                    ids, count = encoder.encode(texts)
                    rest = np.concatenate([rest, np.insert(ids, np.cumsum(count), end_id)])
                    lengths.append(count + 1)
                    full = len(rest) // block * block
                    for at in range(0, full, block):
                        put(rest[at : at + block])
                    rest = rest[full:]
            if len(rest):
                put(rest)
            release_encoders()
            n_tokens, n_docs = int(sum(x.sum() for x in lengths)), sum(map(len, doc_ids))
            for parts, kind in ((doc_ids, "<i8"), (present, np.uint8), (lengths, "<i8")):
                out.write(b"".join(x.astype(kind).tobytes() for x in parts))
            out.write(np.array(offsets, dtype="<i8").tobytes())
            out.write(np.array([n_docs, n_tokens, len(offsets) - 1, block, bits, offsets[-1]], dtype="<i8").tobytes() + MAGIC)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([n_docs], pa.int64()), pa.array([n_tokens], pa.int64())], names=["part", "file", "n_docs", "n_tokens"])

    ordered = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return materialize(ordered.mapInArrow(trimmed(write), "part int, file string, n_docs bigint, n_tokens bigint"), "token-files")


class TokenFile:
    """Random access to one file."""

    def __init__(self, uri: str):
        fs, path = file_system(uri)
        self.stream = fs.open_input_file(path)
        size = self.stream.size()
        tail = self.stream.read_at(56, size - 56)
        if tail[-8:] != MAGIC or self.stream.read_at(8, 0) != MAGIC:
            raise ValueError(f"{uri} is not a complete token file")
        self.n_docs, self.n_tokens, self.n_blocks, self.block, self.bits, at = np.frombuffer(tail[:48], dtype="<i8").tolist()
        index = self.stream.read_at(size - 56 - at, at)
        n = self.n_docs
        self.doc_ids, self.has_id = np.frombuffer(index, "<i8", n), np.frombuffer(index, np.uint8, n, 8 * n).astype(bool)
        self.lengths = np.frombuffer(index, "<i8", n, 9 * n)
        self.offsets = np.frombuffer(index, "<i8", self.n_blocks + 1, 17 * n)

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids from number ``first`` up to ``last`` of the file; reads only the blocks they are in."""
        if last <= first:
            return np.zeros(0, dtype="<u4")
        a, b = first // self.block, (last - 1) // self.block
        data = self.stream.read_at(int(self.offsets[b + 1] - self.offsets[a]), int(self.offsets[a]))
        parts = [unpack(data[self.offsets[k] - self.offsets[a] : self.offsets[k + 1] - self.offsets[a]], min(self.block, self.n_tokens - k * self.block), self.bits) for k in range(a, b + 1)]
        return np.concatenate(parts)[first - a * self.block : last - a * self.block]


def read_tokens(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """Reads the files back: doc_id, start, n_tokens, ids_crc32 and, on request, ids.

    ``files`` is what write_tokens() returns.  It has a row for each file, of bounded size; where each
    file's ids start is a running sum over it.  One task reads one file, some blocks at a time."""
    spark = files.sparkSession
    listed = sorted(tuple(r) for r in files.select("part", "file", "n_tokens").collect())
    starts = np.concatenate([[0], np.cumsum([x[2] for x in listed])]).astype(int).tolist()
    plan = [(uri, start) for (_, uri, n), start in zip(listed, starts) if n]

    def read(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for k in b.column(0).to_pylist():
                uri, start = plan[k]
                f = TokenFile(uri)
                ends = np.cumsum(f.lengths)
                at = 0
                while at < f.n_docs:  # about 1M ids at a time, a document at least
                    begin = int(ends[at] - f.lengths[at])
                    to = max(at + 1, int(np.searchsorted(ends, begin + (1 << 20))))
                    ids = f.ids(begin, int(ends[to - 1]))
                    cuts = (ends[at:to] - f.lengths[at:to] - begin).tolist() + [len(ids)]
                    parts = [ids[x:y] for x, y in zip(cuts, cuts[1:])]
                    columns = [pa.array(f.doc_ids[at:to], pa.int64(), mask=~f.has_id[at:to]), pa.array(start + begin + np.array(cuts[:-1]), pa.int64()), pa.array(f.lengths[at:to], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in parts], pa.int64())]
                    if with_ids:
                        columns.append(pa.array([x.tolist() for x in parts], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])
                    at = to

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    if not plan:
        return spark.createDataFrame([], schema)
    return spark.range(0, len(plan), 1, len(plan)).mapInArrow(trimmed(read), schema)


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 1, folder: str | None = None) -> DataFrame:
    """Writes the token files to ``folder`` (a new shared one by default) and reads them back."""
    return read_tokens(write_tokens(docs, tokenizer, end_id, folder or new_folder(docs.sparkSession, "tokens")))
