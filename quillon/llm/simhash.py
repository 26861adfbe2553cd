"""SimHash near-duplicates with BK-trees.

A fingerprint has a bit set where over half the hashes of a text's word shingles have it.  Equal
fingerprints are one node; nodes link when they differ in at most ``radius`` bits.

Candidate search: the bits are cut into blocks, and fingerprints that agree on a block share a shard.
With ``radius`` + 1 blocks no link is lost (pigeonhole).  For each shard a BK-tree is built (children
keyed by their integer Hamming distance to the parent) and each member of the shard follows only
the edges within the radius.  The trees travel to the tasks of their shards, not through the driver:
a tree holds at most about ``shard_rows`` fingerprints.  A block value with more is dealt to k
sub-shards, and every pair of sub-shards meets in a task of its own, so the search stays exact and no
task grows with the group.  A task passes on a spanning set of the links that it finds, never all pairs.

With a ``similarity``, the groups that such links make are candidates alone: the texts of each group meet,
and those count as linked whose sets of shingles have at least that Jaccard similarity.  Texts are told apart by two
64-bit hashes there; fingerprints of more than 64 bits have one for a name, which may but add candidates.

Defined cases: a text without words (or null) has the fingerprint zero, linked like any other (two of them are
alike, one and a text with words are not); null
doc_ids take part but never name a component (null if no document of it has an id).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_ASCII, materialize, trimmed
from .components import connected_components

#: Parts to which the rows of a group are dealt when they are joined with what is known of it.
SPREAD = 16
#: Blocks that are searched before the others.
FIRST_BLOCKS = 8
_LANES = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(text: str | None, k: int) -> list[bytes]:
    """Shingles of ``k`` words of the lower-cased (A-Z) text, repeats included; with fewer words
    the whole sequence."""
    w = text.encode("utf-8", "surrogatepass").translate(LOWER_ASCII).split() if text else []
    if not w:
        return []
    return [b" ".join(w)] if len(w) < k else list(map(b" ".join, zip(*(w[i:] for i in range(k)))))


def fingerprint(text: str | None, k: int, width: int = 64, seed: int = 42, distinct: bool = False) -> bytes:
    """``width`` bits (a multiple of 64), most significant first.  The first 64 come from the
    shingles' XXH64 as it is; further ones from that value remixed."""
    from xxhash import xxh64_intdigest

    found = shingles(text, k)
    if not found:
        return bytes(width // 8)
    hashes = np.fromiter((xxh64_intdigest(s, seed) for s in (set(found) if distinct else found)), dtype=np.uint64)
    lanes = width // 64
    counts = np.zeros(width, dtype=np.int64)
    for at in range(0, len(hashes), 255 * 16):
        h = hashes[at : at + 255 * 16]
        wide = np.empty((len(h), lanes), dtype=">u8")
        wide[:, 0] = h
        for j in range(1, lanes):
            x = (h ^ (h >> np.uint64(31))) * _LANES[j]
            x ^= x >> np.uint64(29)
            wide[:, j] = x * np.uint64(0xBF58476D1CE4E5B9)
        bits = np.unpackbits(wide.view(np.uint8).reshape(len(h), -1), axis=1)
        for i in range(0, len(h), 255):  # sums of up to 255 rows fit a byte
            counts += bits[i : i + 255].sum(0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, *, shingle: int = 3, width: int = 64, seed: int = 42, distinct: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns doc_id, copy and copy2 (hashes of the text), fp (binary): one row for each row of ``docs``; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            fps = [fingerprint(t.as_py(), shingle, width, seed, distinct) for t in b.column(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(fps, pa.binary())], names=["doc_id", "copy", "copy2", "fp"])

    return _texts(docs, doc_id, text).mapInArrow(trimmed(run), "doc_id bigint, copy bigint, copy2 bigint, fp binary")


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text)).alias("copy"), F.xxhash64(F.lit(1), F.col(text)).alias("copy2"), F.col(text).alias("text"))


class BKForest:
    """A BK-tree for each shard, built and searched for all shards of a batch at once.

    ``words`` are the fingerprints as rows of 64-bit words, ``shard`` numbers their shards.  All
    members of a shard start at its root; in each round the first of those that stand at the same
    node with the same distance becomes the child under that key and the rest move on to it.
    """

    def __init__(self, words: np.ndarray, shard: np.ndarray):
        n = len(words)
        self.words = words
        _, first = np.unique(shard, return_index=True)
        self.roots = dict(zip(shard[first].tolist(), first.tolist()))
        root = np.full(int(shard.max()) + 1 if n else 1, -1, dtype=np.int64)
        root[shard[first]] = first
        self.root = root
        rest = np.setdiff1d(np.arange(n), first, assume_unique=True)
        at = root[shard[rest]]
        keys, children = [], []
        while len(rest):
            key = at * 65_536 + self.distance(rest, at)
            edge, begin, inverse = np.unique(key, return_index=True, return_inverse=True)
            child = rest[begin]
            keys.append(edge)
            children.append(child)
            moved = child[inverse]
            stay = moved != rest
            rest, at = rest[stay], moved[stay]
        self.keys = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)
        order = np.argsort(self.keys)
        self.keys = self.keys[order]
        self.children = (np.concatenate(children) if children else np.zeros(0, dtype=np.int64))[order]

    def distance(self, a: np.ndarray, b: np.ndarray, queries: np.ndarray | None = None) -> np.ndarray:
        left = self.words if queries is None else queries
        total = np.zeros(len(a), dtype=np.int64)
        for j in range(self.words.shape[1]):
            total += np.bitwise_count(left[a, j] ^ self.words[b, j])
        return total

    def search(self, queries: np.ndarray, shard: np.ndarray, radius: int, frontier: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, tree member) within the radius.  ``frontier`` bounds the pairs held."""
        todo = [(np.arange(len(queries)), self.root[shard])]
        while todo:
            q, node = todo.pop()
            if len(q) > frontier:
                half = len(q) // 2
                todo += [(q[half:], node[half:]), (q[:half], node[:half])]
                continue
            d = self.distance(q, node, queries)
            if (hit := d <= radius).any():
                yield q[hit], node[hit]
            low = np.searchsorted(self.keys, node * 65_536 + np.maximum(d - radius, 0))
            many = np.searchsorted(self.keys, node * 65_536 + np.minimum(d + radius, 65_535), side="right") - low
            total = int(many.sum())
            if total:
                step = np.repeat(low - np.cumsum(many) + many, many) + np.arange(total)
                todo.append((np.repeat(q, many), self.children[step]))


def _spanning(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n items the least item it is linked to, through others too."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            x, y = root[a], root[b]
            if not (apart := x != y).any():
                break
            a, b = a[apart], b[apart]
            low, high = np.minimum(x[apart], y[apart]), np.maximum(x[apart], y[apart])
            np.minimum.at(root, high, low)
            while ((up := root[root]) != root).any():
                root = up
    return root


def _whole_tasks(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], least: int) -> Iterator[pa.Table]:
    """Sorted rows in tables of about ``least``, rows of the same ``names`` never apart."""
    held: list[pa.RecordBatch] = []

    def key(b: pa.Table, i: int):
        return tuple(b.column(c)[i].as_py() for c in names)

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if sum(b.num_rows for b in held) < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = key(table, table.num_rows - 1)
        lo, hi = 0, table.num_rows - 1
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if key(table, mid) == last else (mid + 1, hi)
        if lo:
            held = table.slice(lo).to_batches()
            yield table.slice(0, lo)
    if held:
        yield pa.Table.from_batches(held)


#: Sub-shard p meets q >= p in task (p, q): its members build the tree there, those of q search.
_MEETS = "transform(sequence(0, k - 1), o -> named_struct('p', least(o, part), 'q', greatest(o, part)))"


def link_nodes(nodes: DataFrame, *, width: int, radius: int, blocks: int, compare: int | None = None, shard_rows: int = 2048, take: range | None = None) -> DataFrame:
    """``nodes`` (node bigint, label bigint, fp binary, distinct).  Returns links (a, b) of labels that join any two nodes
    of a block's shard that are within the radius, directly or through other such nodes.  Blocks are
    of all bits; the radius is that of the first ``compare`` bits (all), and just these are shuffled.  ``take`` numbers the
    blocks looked at (all)."""
    edges = [round(i * width / blocks) for i in range(blocks + 1)]
    compare = compare or width
    words, block_bits = compare // 64, list(enumerate(zip(edges, edges[1:])))[slice(take.start, take.stop) if take else slice(None)]
    schema = "block int, value bigint, node bigint, label bigint, fp binary"

    def cut(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            raw = np.frombuffer(b"".join(b.column(2).to_pylist()), dtype=np.uint8).reshape(n, -1)
            bits = np.unpackbits(raw, axis=1)
            fps = pa.array([x[: compare // 8] for x in b.column(2).to_pylist()], pa.binary())
            for k, (x, y) in block_bits:
                value = bits[:, x:y].astype(np.int64) @ (np.int64(1) << np.arange(y - x - 1, -1, -1, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k), pa.int32()), pa.array(value), b.column(0), b.column(1), fps], names=["block", "value", "node", "label", "fp"])

    placed = nodes.select("node", "label", "fp").mapInArrow(trimmed(cut), schema)
    # Shards of more than shard_rows members are few (one for so many rows at most); the list is written first, so that
    # Spark knows its size and need not shuffle the fingerprints to look them up in it.
    crowded = placed.groupBy("block", "value").agg(F.count("*").alias("n")).where(F.col("n") > shard_rows)
    crowded = materialize(crowded.select(F.col("block").alias("b"), F.col("value").alias("v"), F.ceil(F.col("n") / shard_rows).cast("int").alias("many")), "crowded")
    dealt = placed.join(crowded, (F.col("block") == F.col("b")) & (F.col("value") == F.col("v")), "left").withColumn("k", F.coalesce("many", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    tasks = dealt.select("block", "value", "part", "label", "fp", F.explode(F.expr(_MEETS)).alias("m")).select("block", "value", "m.p", "m.q", "part", "label", "fp")
    # In the order of the labels, so that the shards of a group link to the same few least ones and their links fall together.
    tasks = tasks.repartition("block", "value", "p", "q").sortWithinPartitions("block", "value", "p", "q", "label")

    def search(batches: Iterator[pa.RecordBatch]):
        def run(rows: pa.Table):
            keys = np.stack([rows.column(c).to_numpy() for c in ("block", "value", "p", "q")], 1)
            shard = np.concatenate([[0], np.cumsum((keys[1:] != keys[:-1]).any(1))])
            part, label = rows.column("part").to_numpy(), rows.column("label").to_numpy()
            fps = np.frombuffer(b"".join(rows.column("fp").to_pylist()), dtype=">u8").reshape(-1, words).astype(np.uint64)
            own = np.flatnonzero(part == keys[:, 2])
            ask = np.flatnonzero(part == keys[:, 3])
            if not len(own):
                return None
            # A task whose sub-shard p is empty has nothing to search in.
            ask = ask[np.isin(shard[ask], shard[own])]
            forest = BKForest(fps[own], shard[own])
            root = _spanning(len(label), ((ask[a], own[b]) for a, b in forest.search(fps[ask], shard[ask], radius)))
            linked = np.flatnonzero(label != label[root])
            if len(linked):
                pairs = np.unique(np.stack([label[linked], label[root[linked]]], 1), axis=0)
                return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for table in _whole_tasks(batches, ("block", "value", "p", "q"), 20_000):
            if (out := run(table)) is not None:
                yield out

    return tasks.mapInArrow(trimmed(search), "a bigint, b bigint")


def node_roots(nodes: DataFrame, *, blocks: int, **search) -> DataFrame:
    """(node, root): for each of ``nodes`` (node, fp) that has a link the least node that it reaches.

    Of more than FIRST_BLOCKS blocks these come first; the rest then link the groups found, not their nodes, so that a large group
    has its links a few times and not once for each block."""
    own = nodes.select("node", F.col("node").alias("label"), "fp")
    first = connected_components(link_nodes(own, blocks=blocks, take=range(0, min(blocks, FIRST_BLOCKS)), **search))
    if blocks <= FIRST_BLOCKS:
        return first
    labelled = materialize(nodes.join(first, "node", "left").select("node", F.coalesce("root", "node").alias("label"), "fp"), "labels")
    more = connected_components(link_nodes(labelled, blocks=blocks, take=range(FIRST_BLOCKS, blocks), **search)).withColumnRenamed("node", "label")
    moved = spread_join(labelled.select("node", "label"), more, "label", "node").select("node", "root")
    stay = labelled.where("node <> label").select("node", F.col("label").alias("root")).join(more.select(F.col("label").alias("root")), "root", "left_anti").select("node", "root")
    apart = materialize(moved.unionByName(stay).where("node <> root"), "group-roots")
    return apart.unionByName(apart.select(F.col("root").alias("node"), "root").distinct())


def alike(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set (of distinct numbers) the least one that it reaches by Jaccard similarities of ``similarity`` or more.

    Sets are held against all others one by one, those with most in common first; what ends in the
    largest component need not be, as all outside it has been held against it."""
    n = len(sets)
    size = np.array([len(x) for x in sets], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(n), size)
    found, number = np.unique(np.concatenate(sets) if n else np.zeros(0, dtype=np.int64), return_inverse=True)
    posted = owner[np.argsort(number, kind="stable")]
    many = np.bincount(number, minlength=len(found))
    low = np.cumsum(many) - many
    order = np.argsort(-np.bincount(owner, weights=many[number], minlength=n), kind="stable")
    component, asked = np.arange(n), np.zeros(n, dtype=bool)
    while True:
        largest = np.bincount(component).argmax() if asked.any() else -1
        left = ~asked[order] & (component[order] != largest)
        if not left.any():
            return component
        i = order[left.argmax()]
        asked[i] = True
        mine = number[first[i] : first[i + 1]]
        step = np.repeat(low[mine] - np.cumsum(many[mine]) + many[mine], many[mine]) + np.arange(int(many[mine].sum()))
        common = np.bincount(posted[step], minlength=n)
        hit = common >= similarity * (size[i] + size - common) - 1e-9
        labels = np.unique(component[hit])
        component[np.isin(component, labels)] = labels[0]


def exact_links(docs: DataFrame, items: DataFrame, *, similarity: float, shingle: int, shard_rows: int = 1024, shard_shingles: int = 2_000_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``items`` (item, copy, copy2, least: the smallest doc_id with that text, group).  Links (a, b) of items of the
    same group that join any two whose sets of shingles are alike, directly or through others.

    Texts of groups of more than one item alone are looked up, one row of each.  A group of more than
    ``shard_rows`` texts or ``shard_shingles`` shingles is dealt to sub-groups, each pair of which meets."""
    several = items.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group")
    need = spread_join(items, several, "group", "item").select("item", "group", F.col("copy").alias("c"), F.col("copy2").alias("c2"), F.col("least").alias("d"))
    texts = _texts(docs, doc_id, text)
    texts = texts.join(need, (texts["copy"] == need["c"]) & (texts["copy2"] == need["c2"]) & texts["doc_id"].eqNullSafe(need["d"])).select("group", "item", "text")

    def cut(batches: Iterator[pa.RecordBatch]):
        from xxhash import xxh64_intdigest

        for b in batches:
            hashes = [np.unique(np.fromiter((xxh64_intdigest(x, 42) for x in set(shingles(t.as_py(), shingle))), dtype=np.uint64)).view(np.int64) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hashes, pa.list_(pa.int64()))], names=["group", "item", "hashes"])

    sets = materialize(texts.mapInArrow(trimmed(cut), "group bigint, item bigint, hashes array<bigint>"), "shingle-sets")
    shards = F.ceil(F.greatest(F.count("*") / shard_rows, F.sum(F.size("hashes")) / shard_shingles)).cast("int")
    crowded = materialize(sets.groupBy("group").agg(shards.alias("many")).where("many > 1").withColumnRenamed("group", "g"), "crowded")
    dealt = sets.join(crowded, F.col("group") == F.col("g"), "left").withColumn("k", F.coalesce("many", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("item"), F.col("k")).cast("int"))
    tasks = dealt.select("group", "item", "hashes", F.explode(F.expr(_MEETS)).alias("m")).select("group", "m.p", "m.q", "item", "hashes")
    tasks = tasks.repartition("group", "p", "q").sortWithinPartitions("group", "p", "q", "item")

    def verify(batches: Iterator[pa.RecordBatch]):
        for table in _whole_tasks(batches, ("group", "p", "q"), 1000):
            table = table.combine_chunks()
            keys = np.stack([table.column(c).to_numpy() for c in ("group", "p", "q")], 1)
            starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            copies, column = table.column("item").to_numpy(), table.column("hashes").combine_chunks()
            flat, at = column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
            a, b = [], []
            for x, y in zip(starts, starts[1:]):
                root = alike([flat[at[i] : at[i + 1]] for i in range(x, y)], similarity)
                linked = np.flatnonzero(root != np.arange(y - x))
                a.append(copies[x + linked])
                b.append(copies[x + root[linked]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return tasks.mapInArrow(trimmed(verify), "a bigint, b bigint")


def spread_join(rows: DataFrame, few: DataFrame, key: str, deal: str) -> DataFrame:
    """Equi-join of ``rows``, a third of which may have one key, and ``few``, a row a key: each of these is there SPREAD times,
    and a key's rows are dealt to them by ``deal``."""
    few = few.withColumn("__turn", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return rows.withColumn("__turn", F.pmod(F.xxhash64(deal), F.lit(SPREAD)).cast("int")).join(few, [key, "__turn"]).drop("__turn")


def near_duplicates(docs: DataFrame, *, shingle: int = 3, width: int = 64, radius: int = 2, blocks: int | None = None, compare: int | None = None, similarity: float | None = None, distinct: bool = False, shard_rows: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns doc_id, fp (binary), component_id (the smallest doc_id reachable): one row for each
    row of ``docs``.

    Fingerprints are written once, so texts are read once.  ``blocks`` defaults to radius + 1, with
    which the search is exact; more radius than that makes it a probabilistic one (see
    similar_documents()).  With ``similarity`` the groups found are candidates, whose texts are read a
    second time and linked by the exact similarity of their shingle sets.
    """
    marked = materialize(fingerprints(docs, shingle=shingle, width=width, distinct=distinct, doc_id=doc_id, text=text), "fingerprints")
    node = F.conv(F.hex("fp"), 16, -10).cast("bigint") if width == 64 else F.xxhash64("fp")
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")).select(node.alias("node"), "fp", "least"), "nodes")
    roots = node_roots(nodes, width=width, radius=radius, blocks=blocks or radius + 1, compare=compare, shard_rows=shard_rows)
    key = ["fp"]
    if similarity is not None:
        key = ["copy", "copy2"]
        items = marked.groupBy(*key).agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp")).withColumn("node", F.xxhash64("fp"))
        items = items.join(roots, "node", "left").select(F.monotonically_increasing_id().alias("item"), *key, "least", F.coalesce("root", "node").alias("group"))
        items = materialize(items, "items")  # from here on the numbers are fixed
        roots = connected_components(exact_links(docs, items, similarity=similarity, shingle=shingle, doc_id=doc_id, text=text))
        nodes = items.withColumnRenamed("item", "node")
    joined = materialize(nodes.join(roots, "node", "left").select(*key, "node", "least", "root"), "roots")
    linked = joined.where("root is not null")
    classes = linked.groupBy("root").agg(F.min("least").alias("class"))
    labels = spread_join(linked, classes, "root", "node")
    labels = labels.select(*key, F.col("class").alias("component_id")).unionByName(joined.where("root is null").select(*key, F.col("least").alias("component_id")))
    return marked.join(labels, key).select("doc_id", "fp", "component_id")


def search_plan(n: int, similarity: float, missed: float = 0.001) -> tuple[int, int]:
    """Width of fingerprints and number of blocks with which a pair of the similarity among ``n`` documents shares a block but
    for a share of ``missed``.  Blocks have two bits fewer than n, 16 at least, so that unlike documents are a handful in a shard at any n."""
    bits = max(16, math.ceil(math.log2(max(n, 1))) - 2)
    found = (1 - _flips(similarity)) ** bits
    width = 64 * math.ceil(bits * math.log(missed) / math.log(1 - found) / 64)
    return width, width // bits


def _flips(similarity: float) -> float:
    """Share of bits in which the SimHashes of two sets of one size and this Jaccard similarity differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def similar_documents(docs: DataFrame, *, similarity: float = 0.8, shingle: int = 5, compare: int = 256, shard_rows: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """near_duplicates() for a Jaccard similarity of shingle sets; links are exact, SimHash finds their candidates.

    Two sets of similarity s have the cosine 2s / (1 + s) for sets of one size (more for others), and each bit
    of their SimHashes differs with the probability acos(cosine) / pi.  The radius is that share of ``compare``
    plus four standard deviations; search_plan() gives the blocks.  By the binomial distribution a pair of similarity 0.8 meets in
    one of the blocks (96 of 16 bits up to 262,144 documents) with a probability of 0.999 at least, is within the radius with 0.9999
    and so is found with 0.999;
    groups of more than two copies have more such chances.  Sets of four and five shingles differ in more bits (0.1875 of
    them); such a pair is found with 0.96.
    """
    width, blocks = search_plan(docs.count(), similarity)
    width, share = max(width, compare), _flips(similarity)
    radius = round(compare * share + 4 * math.sqrt(compare * share * (1 - share)))
    return near_duplicates(docs, shingle=shingle, width=width, radius=radius, blocks=blocks, compare=compare, similarity=similarity, distinct=True, shard_rows=shard_rows, doc_id=doc_id, text=text)


def drop_near_duplicates(docs: DataFrame, *, similarity: float = 0.8, shingle: int = 5, doc_id: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """``docs`` with one document of each group of near copies: the one with the smallest doc_id.
    All columns stay.  Rows with a null doc_id stay, as nothing names them; rows repeated under one
    doc_id count as one document and stay or go together."""
    found = similar_documents(docs, similarity=similarity, shingle=shingle, doc_id=doc_id, text=text, **more)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[doc_id].cast("bigint") == gone["__gone"], "left_anti")
