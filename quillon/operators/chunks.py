"""Chunks of ordered blocks, repeated lines, and vectors of chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from ..sources.staging import Rounds
from .markdown import markdown_blocks

#: Labels of headings and of list items.
TITLE, HEADING, LIST_ITEM = "title", "section_header", "list_item"


def count_tokens(text: Column) -> Column:
    """White-space tokens."""
    return F.when(F.trim(text) == "", 0).otherwise(F.size(F.split(F.trim(text), r"\s+"))).cast("bigint")


class _Budget:
    """Deals blocks to chunks as they come, a stretch of one document and section at a time; it holds on to numbers of the chunk it is at."""

    def __init__(self, limit: int, overlap: int):
        self.limit, self.overlap = limit, overlap
        self.reset(True)

    def reset(self, new_document: bool) -> None:
        """The next block starts a chunk that has nothing to do with those before it."""
        self.chunk = -1 if new_document else self.chunk
        self.used, self.own = None, []  # tokens of the chunk so far, None before the first block; its blocks that may be repeated

    def reach(self, so_far: np.ndarray, at: int, end: int) -> int:
        """The first block from which to ``end`` there are at most ``overlap`` tokens."""
        return int(np.searchsorted(so_far, int(so_far[end - 1]) - self.overlap)) + 1 if self.overlap and so_far[end - 1] > self.overlap else at if self.overlap else end

    def keep(self, more: list[tuple[int, int]]) -> None:
        """The chunk's last blocks, while they have at most ``overlap`` tokens."""
        total, kept = 0, []
        for back, n in reversed(self.own + more):
            total += n
            if total > self.overlap or not self.overlap:
                break
            kept.append((back, n))
        self.own = kept[::-1]

    def deal(self, tokens: np.ndarray, heads: np.ndarray | None = None) -> list[tuple[int, list[tuple[int, int]], int, int, bool]]:
        """For blocks in order: (chunk, blocks repeated from the chunk before as (how far back from the stretch's start, tokens), first, end, whether the
        first one's head, of so many tokens, is carried)."""
        out, at, so_far = [], 0, np.cumsum(tokens)
        while at < len(tokens):
            before = int(so_far[at - 1]) if at else 0
            repeated: list[tuple[int, int]] = []
            carried = False
            fits = int(np.searchsorted(so_far, before + self.limit - self.used, side="right")) if self.used is not None else at
            if fits <= at:  # a new chunk, which the block opens whatever its length
                room, total = min(self.overlap, self.limit - int(tokens[at])), 0
                for back, n in reversed(self.own):
                    if total + n > room:
                        break
                    total += n
                    repeated.insert(0, (back, n))
                while repeated and not repeated[0][1]:
                    total -= repeated.pop(0)[1]
                carried = heads is not None and self.used is not None and 0 < heads[at] <= self.limit - tokens[at]
                total += int(heads[at]) if carried else 0
                self.chunk, self.used, self.own = self.chunk + 1, total, []
                fits = max(at + 1, int(np.searchsorted(so_far, before + self.limit - self.used, side="right")))
            out.append((self.chunk, repeated, at, fits, carried))
            self.used += int(so_far[fits - 1]) - before
            start = max(at, self.reach(so_far, at, fits))
            if start > at:  # what the chunk had before is too far back
                self.own = []
            self.keep([(i, int(tokens[i])) for i in range(start, fits)])
            at = fits
        self.own = [(i - len(tokens), n) for i, n in self.own]
        return out


def chunk_by_tokens(blocks: DataFrame, limit: int, doc_id: str = "doc_id", seq: str = "seq", text: str = "text", section: str | None = None, overlap: int = 0, head: str | None = None) -> DataFrame:
    """``blocks`` with tokens, chunk, over and context: blocks in order are dealt to chunks of at most ``limit`` white-space tokens.

    Greedy: a block goes to the chunk at hand if it fits, else it opens the next.  Blocks stay whole; one that is longer than the limit has a
    chunk of its own, ``over``.  No chunk crosses a change of section.  With ``overlap`` a chunk that a full one precedes starts with the longest
    run of that one's last blocks that has at most so many tokens and leaves room for its first block, without leading blocks of no tokens; these rows are
    ``context``, and each block is a row without it exactly once.

    ``head`` names a column of texts that a block needs before it, as a table's head: where a chunk begins with such a block inside of a section and
    there is room for both, ``carried`` is set and the head's tokens count.  It does not go with an overlap.

    One shuffle by document and a sort; documents then stream through a running sum, which jumps from chunk to chunk.  Blocks of equal
    order are ordered by their text; null documents count as one."""
    if limit < 1 or not 0 <= overlap < limit or (head and overlap):
        raise ValueError("needs 0 <= overlap < limit, and no overlap with heads")
    rows = blocks.withColumn("tokens", F.coalesce(count_tokens(F.col(text)), F.lit(0).cast("bigint")))
    if head:
        rows = rows.withColumn("__head", F.coalesce(count_tokens(F.col(head)), F.lit(0).cast("bigint")))
    schema = to_arrow_schema(rows.schema)
    out_schema = schema.append(pa.field("chunk", pa.int64())).append(pa.field("over", pa.bool_())).append(pa.field("context", pa.bool_())).append(pa.field("carried", pa.bool_()))
    keys = [doc_id, section] if section else [doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        budget, last, kept = _Budget(limit, overlap), None, None
        for b in batches:
            if not len(b):
                continue
            names = [b.column(b.schema.get_field_index(k)).to_pylist() for k in keys]
            tokens = b.column(b.schema.get_field_index("tokens")).to_numpy()
            heads = b.column(b.schema.get_field_index("__head")).to_numpy() if head else None
            marks = list(zip(*names))
            starts = [i for i in range(len(b)) if (marks[i] != marks[i - 1] if i else marks[0] != last)]
            cuts = sorted({0, *starts, len(b)})
            # Rows of former batches that may be repeated come before this one's.
            pool = pa.concat_batches([kept, b]) if kept is not None else b
            shift = len(pool) - len(b)
            take, chunk, context, carried = [], [], [], []
            for i, j in zip(cuts, cuts[1:]):
                if i in starts:
                    before = marks[i - 1] if i else last
                    budget.reset(before is None or before[0] != marks[i][0])
                for number, repeated, s, e, with_head in budget.deal(tokens[i:j], heads[i:j] if head else None):
                    take += [*(shift + i + back for back, _ in repeated), *range(shift + i + s, shift + i + e)]
                    chunk += [number] * (len(repeated) + e - s)
                    context += [True] * len(repeated) + [False] * (e - s)
                    carried += [False] * len(repeated) + [with_head] + [False] * (e - s - 1)
            last = marks[-1]
            back = max((-at for at, _ in budget.own), default=0)
            kept = pool.slice(len(pool) - back) if back else None
            rows_out = pool.take(pa.array(take, pa.int64()))
            over = pc.greater(rows_out.column(rows_out.schema.get_field_index("tokens")), limit)
            yield pa.RecordBatch.from_arrays([*rows_out.columns, pa.array(chunk, pa.int64()), over, pa.array(context, pa.bool_()), pa.array(carried, pa.bool_())], schema=out_schema)

    dealt = rows.repartition(doc_id).sortWithinPartitions(doc_id, seq, text)
    made = dealt.mapInArrow(run, from_arrow_schema(out_schema))
    return made.drop("__head") if head else made.drop("carried")


def line_heads(text: str) -> list[tuple[str, str | None]]:
    """Lines of a Markdown text, each with what it needs before it: rows of a table its head, lines of a list the first lines of the items that
    they stand in."""
    lines = re.split(r"\r\n|\n|\r", text)
    heads: list[list[int]] = [[] for _ in lines]
    for b in markdown_blocks(lines):
        if b["type"] == "table":
            for n in range(b["begin"] + 2, b["end"]):
                heads[n] += [b["begin"], b["begin"] + 1]
        for n, after in zip(b.get("items", []), [*b.get("items", [])[1:], b["end"]]):
            for inner in range(n + 1, after):
                heads[inner].append(n)
    return [(line, "\n".join(lines[n] for n in own) if own else None) for line, own in zip(lines, heads)]


def line_chunks(texts: DataFrame, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, chunk, first, last, head, text): Markdown texts cut between lines to chunks of at most ``limit`` tokens.

    A chunk that begins within a table or an item has their head, which counts, before its lines; one without room for it has none.  A line that is longer
    alone is a chunk of its own.  Null texts have no lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, n, *line) for i, t in zip(*(c.to_pylist() for c in b.columns)) for n, line in enumerate(line_heads(t))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], ["doc_id", "seq", "line", "head"])

    given = texts.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    kinds = [to_arrow_schema(given.select("doc_id").schema)[0].type, pa.int64(), pa.string(), pa.string()]
    lines = given.mapInArrow(run, from_arrow_schema(pa.schema(list(zip(["doc_id", "seq", "line", "head"], kinds)))))
    rows = chunk_by_tokens(lines, limit, text="line", head="head")
    parts = rows.groupBy("doc_id", "chunk").agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.max(F.when(F.col("carried"), F.col("head"))).alias("head"), F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("lines"))
    return parts.select(F.col("doc_id").alias(doc_id), "chunk", "first", "last", "head", F.concat_ws("\n", "head", F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("text"))


def chunk_problems(blocks: DataFrame, chunks: DataFrame, doc_id: str = "doc_id", seq: str = "seq", limit: int | None = None, overlap: int = 0, section: str | None = None) -> DataFrame:
    """(doc_id, lost, repeated): blocks that no chunk has, and those that more than one has as its own.

    With a ``limit`` also the chunks that break what chunk_by_tokens() promises: over_limit (more than it, and of more than one block), gaps (blocks between
    the first and the last are missing), mixed (two sections) and bad_context (longer than ``overlap``, or not right before the chunk)."""
    context = F.col("context") if "context" in chunks.columns else F.lit(False)
    n = chunks.where(~context).groupBy(doc_id, seq).agg(F.count("*").alias("n"))
    j = blocks.select(doc_id, seq).join(n, [doc_id, seq], "left")
    whole = j.groupBy(doc_id).agg(F.count_if(F.col("n").isNull()).alias("lost"), F.count_if(F.col("n") > 1).alias("repeated"))
    if limit is None:
        return whole
    place = blocks.select(doc_id, seq, F.row_number().over(Window.partitionBy(doc_id).orderBy(seq)).alias("__place"))
    held = chunks.withColumn("__context", context).join(place, [doc_id, seq])
    own, other = F.when(~F.col("__context"), F.col("__place")), F.when(F.col("__context"), F.col("__place"))
    each = held.groupBy(doc_id, "chunk").agg(
        F.sum("tokens").alias("tokens"), F.count("*").alias("rows"), F.max(own).alias("last"), F.min(own).alias("first"), F.count(own).alias("owns"), F.count(other).alias("others"), F.min(other).alias("from"), F.max(other).alias("to"),
        F.coalesce(F.sum(F.when(F.col("__context"), F.col("tokens"))), F.lit(0)).alias("repeats"), (F.count_distinct(section) if section else F.lit(1)).alias("sections"),
    )
    near = (F.col("others") == 0) | ((F.col("to") == F.col("first") - 1) & (F.col("to") - F.col("from") + 1 == F.col("others")) & (F.col("repeats") <= overlap))
    broken = each.groupBy(doc_id).agg(
        F.count_if((F.col("tokens") > limit) & (F.col("rows") > 1)).alias("over_limit"), F.count_if(F.col("last") - F.col("first") + 1 != F.col("owns")).alias("gaps"), F.count_if(F.col("sections") > 1).alias("mixed"), F.count_if(~near).alias("bad_context")
    )
    return whole.join(broken, doc_id, "left").select(doc_id, "lost", "repeated", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("over_limit", "gaps", "mixed", "bad_context")])


def section_paths(items: DataFrame, levels: int = 9, doc_id: str = "doc_id", seq: str = "seq") -> DataFrame:
    """``items`` (doc_id, seq, ref, label, level, text) with headings, an array of (level, ref, text): those that an item stands under, the highest first.

    A title has level 0 and a heading without a level 1; those below ``levels`` count as of that one.  A heading stands under those above it.  For
    each level the last heading so far is carried along in one window; it holds if none of a higher rank came after it."""
    rank = F.when(F.col("label") == TITLE, 0).when(F.col("label") == HEADING, F.least(F.greatest(F.coalesce(F.col("level").cast("int"), F.lit(1)), F.lit(1)), F.lit(levels)))
    before = Window.partitionBy(doc_id).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    at = lambda n: F.last(F.when(F.col("__rank") == n, F.struct(F.col(seq).alias("at"), F.lit(n).alias("level"), "ref", "text")), ignorenulls=True).over(before)
    rows = items.withColumn("__rank", rank).select("*", F.array(*[at(n) for n in range(levels + 1)]).alias("__last"))
    holds = lambda h, i: h.isNotNull() & (F.col("__rank").isNull() | (h["level"] < F.col("__rank"))) & ~F.exists(F.slice("__last", 1, i), lambda g: F.coalesce(g["at"] > h["at"], F.lit(False)))
    path = F.transform(F.filter("__last", holds), lambda h: F.struct(h["level"].alias("level"), h["ref"].alias("ref"), h["text"].alias("text")))
    return rows.withColumn("headings", path).drop("__rank", "__last")


def section_chunks(items: DataFrame, captions: DataFrame | None = None, levels: int = 9, doc_id: str = "doc_id", seq: str = "seq") -> DataFrame:
    """(doc_id, chunk, label, text, headings, body_refs, context_refs): a chunk for each leaf, and one for each unbroken run of list items of a section.

    ``items`` as for section_paths(), ``captions`` (doc_id, ref, caption).  Headings are context of what they stand over, captions of what they belong
    to, after the headings; every other item is in the body of exactly one chunk.  Empty texts are bodies, too."""
    if captions is not None:
        owned = captions.groupBy(doc_id, "ref").agg(F.array_sort(F.collect_set("caption")).alias("captions"))
        rows = items.join(captions.select(doc_id, F.col("caption").alias("ref")).distinct(), [doc_id, "ref"], "left_anti").join(owned, [doc_id, "ref"], "left")
    else:
        rows = items.withColumn("captions", F.lit(None).cast("array<string>"))
    rows = section_paths(rows, levels, doc_id, seq)
    order = Window.partitionBy(doc_id).orderBy(seq)
    heading = F.coalesce(F.col("label").isin(TITLE, HEADING), F.lit(False))
    goes_on = F.coalesce((F.col("label") == LIST_ITEM) & (F.lag("label").over(order) == LIST_ITEM), F.lit(False))
    numbered = rows.withColumn("__new", F.when(heading | goes_on, 0).otherwise(1)).withColumn("chunk", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).where(~heading)
    part = F.struct(F.col(seq).alias("at"), "ref", F.coalesce("text", F.lit("")).alias("text"), "label", "headings", F.coalesce("captions", F.array().cast("array<string>")).alias("captions"))
    parts = numbered.groupBy(doc_id, "chunk").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    first = F.get("parts", F.lit(0))
    refs = F.concat(F.transform(first["headings"], lambda h: h["ref"]), F.flatten(F.transform("parts", lambda p: p["captions"])))
    return parts.select(
        doc_id, F.col("chunk").cast("bigint").alias("chunk"), first["label"].alias("label"), F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"), F.transform(first["headings"], lambda h: h["text"]).alias("headings"),
        F.transform("parts", lambda p: p["ref"]).alias("body_refs"), refs.alias("context_refs"),
    )


def hybrid_chunks(items: DataFrame, limit: int, overlap: int = 0, levels: int = 9, doc_id: str = "doc_id", seq: str = "seq") -> DataFrame:
    """The leaves of ``items``, as for section_paths(), dealt by chunk_by_tokens() to chunks that do not cross a section: section is the number of headings so far."""
    heading = F.coalesce(F.col("label").isin(TITLE, HEADING), F.lit(False))
    order = Window.partitionBy(doc_id).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    rows = section_paths(items, levels, doc_id, seq).withColumn("section", F.count_if(heading).over(order)).where(~heading)
    return chunk_by_tokens(rows, limit, doc_id, seq, "text", "section", overlap)


def resolve_annotations(annotations: DataFrame, ranks: tuple[str, ...] = ("native", "numbering", "style"), keys: tuple[str, ...] = ("doc_id", "seq")) -> DataFrame:
    """keys, value, state: the best policy's value; confirmed if the first policy says it, candidate if others agree, else unresolved."""
    rank = F.array_position(F.array(*map(F.lit, ranks)), F.col("policy"))
    best = annotations.where(rank > 0).groupBy(*keys).agg(F.min(F.struct(rank.alias("rank"), "value")).alias("b"), F.count_distinct("value").alias("n"))
    return best.select(*keys, F.col("b.value").alias("value"), F.when(F.col("b.rank") == 1, "confirmed").when(F.col("n") == 1, "candidate").otherwise("unresolved").alias("state"))


def repeated_lines(lines: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 2) -> DataFrame:
    """(text, n, documents): lines that stand in ``least`` documents or more; marked, never deleted.  Grouped by a hash first, so a very
    common line is one partial sum a task."""
    rows = lines.where(F.trim(F.col(text)) != "")
    return rows.groupBy(F.col(text).alias("text")).agg(F.count("*").alias("n"), F.count_distinct(doc_id).alias("documents")).where(F.col("documents") >= least)


def pool_vectors(vectors: DataFrame, chunk: str = "chunk", vector: str = "embedding") -> DataFrame:
    """(chunk, dim, mean): mean of each component over a chunk's vectors."""
    each = vectors.select(chunk, F.posexplode(vector).alias("dim", "x"))
    return each.groupBy(chunk, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def macro_windows(n_tokens, size: int, overlap: int):
    """array<struct<start,end>> of windows of ``size`` tokens that overlap."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), n_tokens - overlap - 1), F.lit(step))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + size, n_tokens).alias("end")))


def merge_windows(vectors: DataFrame, doc_id: str = "doc_id", pos: str = "pos", vector: str = "embedding") -> DataFrame:
    """(doc_id, pos, embedding): one vector a token from those of overlapping windows, their mean by component.

    Sums are combined before the shuffle, a row a component."""
    each = vectors.where(F.col(vector).isNotNull()).select(doc_id, pos, F.posexplode(vector).alias("dim", "x"))
    means = each.groupBy(doc_id, pos, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(doc_id, pos).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda c: c["x"]).alias(vector))


def pool_spans(vectors: DataFrame, spans: DataFrame, dims: int, doc_id: str = "doc_id", pos: str = "pos", vector: str = "embedding") -> DataFrame:
    """``spans`` (doc_id, start, end, ...) with n, how many vectors of ``vectors`` (doc_id, pos, embedding) lie in [start, end), and mean, by component.

    Each document's vectors are sorted once together with the places where spans begin and end, and a running sum is noted at these;
    a span is the difference of two, so any number of spans that overlap cost no more than their ends.  Vectors that are null, of another length
    or not finite are left out; a span without vectors has the mean null.  Sums are doubles: a mean is good to about
    1e-15 times the document's sum."""
    good = F.col(vector).isNotNull() & (F.size(vector) == dims) & ~F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    held = vectors.where(good).select(F.col(doc_id).alias("d"), F.col(pos).cast("bigint").alias("at"), F.col(vector).cast("array<double>").alias("v"))
    ends = spans.select(F.col(doc_id).alias("d"), F.explode(F.array(F.col("start").cast("bigint"), F.col("end").cast("bigint"))).alias("at")).distinct()
    both = held.unionByName(ends.withColumn("v", F.lit(None).cast("array<double>")))
    kind = to_arrow_schema(both.select("d").schema)[0].type
    schema = pa.schema([("d", kind), ("at", pa.int64()), ("n", pa.int64()), ("total", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        document, n, total = object(), 0, np.zeros(dims)
        for b in batches:
            if not len(b):
                continue
            ids, mark = b.column(0).to_pylist(), np.array(b.column(2).is_null())
            rows = np.zeros((len(b), dims))
            rows[~mark] = b.column(2).drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            cuts = [i for i in range(len(ids)) if ids[i] != (ids[i - 1] if i else document)]
            for s, e in zip([0, *cuts], [*cuts, len(ids)]):
                if s in cuts or ids[s] != document:
                    n, total = 0, np.zeros(dims)
                if s == e:
                    continue
                rows[s:e] = np.cumsum(rows[s:e], axis=0) + total
                count = np.cumsum(~mark[s:e]) + n
                n, total, document = int(count[-1]), rows[e - 1].copy(), ids[s]
                own = np.flatnonzero(mark[s:e])
                sums = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * dims, pa.int32()), pa.array(rows[s + own].ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(s + own)), b.column(1).take(pa.array(s + own)), pa.array(count[own]), sums], schema=schema)

    sums = both.repartition("d").sortWithinPartitions("d", "at", F.col("v").isNotNull()).mapInArrow(run, from_arrow_schema(schema))
    side = lambda p, at: sums.select(F.col("d").alias(doc_id), F.col("at").alias(at), F.col("n").alias(f"__n_{p}"), F.col("total").alias(f"__{p}"))
    rows = spans.withColumn("start", F.col("start").cast("bigint")).withColumn("end", F.col("end").cast("bigint")).join(side("a", "start"), [doc_id, "start"]).join(side("b", "end"), [doc_id, "end"])
    n = F.greatest(F.col("__n_b") - F.col("__n_a"), F.lit(0)).cast("bigint")
    mean = F.when(n > 0, F.zip_with("__a", "__b", lambda x, y: (y - x) / n))
    return rows.withColumn("n", n).withColumn("mean", mean).select(*spans.columns, "n", "mean")


#: Anchors that the lists' centers are fitted on, at most, and how many centers there are, at most.
FIT_ANCHORS, MOST_LISTS = 8192, 256


def _unit(c: str) -> Column:
    """The vector at length 1; null if it has no direction or is not finite."""
    v = F.transform(F.col(c), lambda x: x.cast("double"))
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when((size > 0) & (size < float("inf")) & ~F.isnan(size), F.transform(v, lambda x: F.try_divide(x, size)))


def _centers(anchors: DataFrame) -> np.ndarray:
    """Unit vectors that a few rounds of averaging give for a sample of anchors, bounded by FIT_ANCHORS; their number is its square root."""
    sample = np.array([r["e"] for r in anchors.orderBy(F.xxhash64("anchor_id")).select("e").limit(FIT_ANCHORS).collect()], dtype=np.float64)
    if not len(sample):
        return sample
    k = min(MOST_LISTS, int(np.ceil(len(sample) ** 0.5)))
    centers = sample[:k].copy()
    for _ in range(5):
        to = (sample @ centers.T).argmax(axis=1)
        for c in range(k):
            if (to == c).any():
                centers[c] = sample[to == c].sum(axis=0)
        centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-300)
    return centers


def _probe(rows: DataFrame, centers: np.ndarray, first: int, lists: int) -> DataFrame:
    """``rows`` (id, e) once for each list that they are to be held against: the ``first`` to ``lists`` nearest centers."""
    schema = to_arrow_schema(rows.select("id").schema)
    out = pa.schema([pa.field("id", schema[0].type), ("list", pa.int32()), ("e", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            e = b.column("e").flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
            order = np.argsort(-(e @ centers.T), axis=1, kind="stable")[:, first:lists]
            picked = b.take(pa.array(np.repeat(np.arange(len(b)), order.shape[1])))
            yield pa.RecordBatch.from_arrays([picked.column("id"), pa.array(order.ravel(), pa.int32()), picked.column("e")], schema=out)

    return rows.mapInArrow(run, from_arrow_schema(out))


#: Vectors and anchors that meet in one task, at most, and how near to the k-th best a product must be to be looked at again: far more than products of
#: unit vectors are rounded by; products that are held at once.
MEETING, NEAR, PRODUCTS = 16_384, 1e-9, 8_000_000


def _exact_nearest(usable: DataFrame, held: DataFrame, k: int, block: int) -> DataFrame:
    """(id, near): the ``k`` nearest of all anchors, by products of blocks of vectors with blocks of anchors.

    Each block of one side meets each of the other in a task, ``block`` vectors at a time, and passes on its k best.  The products of a matrix
    choose what may be among them; these are multiplied again element by element, in order, so that equal vectors have equal scores wherever
    they are.  Of equal anchors the k lowest ids alone can be among the best."""
    spark = usable.sparkSession
    first = held.groupBy("e").agg(F.slice(F.array_sort(F.collect_list(F.struct("anchor_id", "label"))), 1, k).alias("a"))
    rounds = Rounds(spark, "anchors")
    anchors = rounds.add(first.select(F.explode("a").alias("a"), "e").select("a.anchor_id", "a.label", "e"))
    vectors = Rounds(spark, "vectors").add(usable)
    parts = lambda df: max(1, -(-df.count() // MEETING))
    of_v, of_a = parts(vectors), parts(anchors)
    dealt = lambda df, key, own, mine, other, others: df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(mine)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
    tasks = of_v * of_a
    left = dealt(vectors, "id", "g", of_v, "h", of_a).repartition(tasks, "g", "h")
    right = dealt(anchors, "anchor_id", "h", of_a, "g", of_v).repartition(tasks, "g", "h")
    near = T.ArrayType(T.StructType([T.StructField("far", T.DoubleType()), T.StructField("anchor_id", anchors.schema["anchor_id"].dataType), T.StructField("label", anchors.schema["label"].dataType)]))
    schema = T.StructType([T.StructField("id", vectors.schema["id"].dataType), T.StructField("near", near)])
    out = to_arrow_schema(schema)

    def meet(v: pa.Table, a: pa.Table) -> pa.Table:
        if not len(v) or not len(a):
            return out.empty_table()
        a = a.sort_by("anchor_id")
        matrix = lambda t: t.column("e").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)
        x, y = matrix(v), matrix(a)
        best, n = [], min(k, len(a))
        some = max(1, min(block, PRODUCTS // len(a)))
        for at in range(0, len(v), some):
            part = x[at : at + some]
            score = part @ y.T
            worst = np.partition(score, len(a) - n, axis=1)[:, len(a) - n]
            row, to = np.nonzero(score >= worst[:, None] - NEAR)
            again = np.zeros(len(row))
            for d in range(x.shape[1]):
                again += part[row, d] * y[to, d]
            order = np.lexsort((to, -again, row))
            row, to, again = row[order], to[order], again[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            best.append((to[place < n], -again[place < n]))
        to, far = (np.concatenate(c) for c in zip(*best))
        chosen = a.take(pa.array(to))
        columns = [pa.array(far), chosen.column("anchor_id").combine_chunks(), chosen.column("label").combine_chunks()]
        inner = out.field("near").type.value_type
        pairs = pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(columns, inner)], fields=list(inner))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(to) + 1, n), pa.int32()), pairs)
        return pa.Table.from_arrays([v.column("id").combine_chunks(), lists.cast(out.field("near").type)], schema=out)

    return left.groupBy("g", "h").cogroup(right.groupBy("g", "h")).applyInArrow(meet, schema)


def _probed(usable: DataFrame, held: DataFrame, k: int, block: int, probes: int) -> DataFrame:
    """(id, near): the ``k`` nearest anchors in each of the lists of the ``probes`` nearest centers."""
    centers = _centers(held)
    if not len(centers):
        return usable.select("id", F.array().alias("near")).where("false")
    dealt = _probe(held.select(F.struct("anchor_id", "label").alias("id"), "e"), centers, 0, 1)
    lists = Rounds(usable.sparkSession, "anchors").add(dealt.select("id.*", "list", "e"))
    about = {r["list"]: r["n"] for r in lists.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row a center
    many = F.element_at(F.array(*[F.lit(max(1, -(-about.get(i, 0) // block))) for i in range(len(centers))]), F.col("list") + 1)
    blocks = lists.withColumn("block", F.pmod(F.xxhash64("anchor_id"), many)).groupBy("list", "block").agg(F.collect_list(F.struct("anchor_id", "label", "e")).alias("held"))
    dot = lambda a: F.aggregate(F.zip_with("e", a["e"], lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    ranked = F.array_sort(F.transform("held", lambda a: F.struct((-dot(a)).alias("far"), a["anchor_id"].alias("anchor_id"), a["label"].alias("label"))))
    return _probe(usable, centers, 0, probes).join(blocks, "list").select("id", F.slice(ranked, 1, k).alias("near"))


def nearest_anchors(vectors: DataFrame, anchors: DataFrame, k: int, unknown_below: float | None = None, block: int = 1024, probes: int = 4, exact: bool = True) -> DataFrame:
    """(vec_id, label, score): the label that most of the ``k`` nearest anchors have, the nearer in sum winning ties; UNKNOWN below a score.

    ``vectors`` (vec_id, embedding), ``anchors`` (anchor_id, embedding, label): all are used, and compared by cosine.  With ``exact`` every
    vector meets every anchor, in products of blocks of them, ``block`` vectors at a time.  Without, an inverted file: anchors are dealt to lists by their
    nearest center, and a vector meets those of its ``probes`` nearest centers, list by list and in blocks of about ``block``; the k best stay in
    its row, and neighbours in other lists can be missed.

    Vectors without a direction (null, empty, zero or not finite) have no neighbours: their label and score are null, or UNKNOWN if ``unknown_below`` is given.
    Such anchors are left out.  All vectors must be of one length."""
    held = anchors.select("anchor_id", "label", _unit("embedding").alias("e")).where("e is not null and size(e) > 0")
    usable = vectors.select(F.col("vec_id").alias("id"), _unit("embedding").alias("e")).where("e is not null and size(e) > 0").distinct()
    none = F.lit(None).cast("string") if unknown_below is None else F.lit("UNKNOWN")
    best = lambda rows: rows.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    near = best(_exact_nearest(usable, held, k, block) if exact else _probed(usable, held, k, block, probes))
    votes = near.select(F.col("id").alias("vec_id"), F.explode("near").alias("a")).select("vec_id", "a.label", (-F.col("a.far")).alias("score")).groupBy("vec_id", "label").agg(F.count("*").alias("n"), F.sum("score").alias("s"), F.max("score").alias("best"))
    win = votes.groupBy("vec_id").agg(F.max(F.struct("n", "s", F.col("label").cast("string").alias("label"), "best")).alias("w"))
    label = F.col("w.label") if unknown_below is None else F.when(F.col("w.best") >= unknown_below, F.col("w.label")).otherwise("UNKNOWN")
    return vectors.select("vec_id").distinct().join(win, "vec_id", "left").select("vec_id", label.alias("label"), F.col("w.best").alias("score"))


def fill_between(labels: DataFrame, doc_id: str = "doc_id", seq: str = "seq", label: str = "label", unknown: str = "UNKNOWN") -> DataFrame:
    """``labels`` with ``resolved``: an unknown one between two equal ones is theirs."""
    w = Window.partitionBy(doc_id).orderBy(seq)
    before, after = F.lag(label).over(w), F.lead(label).over(w)
    return labels.withColumn("resolved", F.when((F.col(label) == unknown) & (before == after) & (before != unknown), before).otherwise(F.col(label)))


def label_metrics(rows: DataFrame, truth: str = "truth", guess: str = "guess", unknown: str = "UNKNOWN") -> DataFrame:
    """(label, precision, recall, f1, accuracy, macro_f1, unknown_rate) from the counts of each pair of labels."""
    cells = rows.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count("*").alias("n"))
    both = cells.select(F.col("t").alias("label"), F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0).alias("hit"), F.col("n").alias("is"), F.lit(0).alias("said")).unionAll(cells.select("g", F.lit(0), F.lit(0), "n"))
    per = both.groupBy("label").agg(F.sum("hit").alias("hit"), F.sum("is").alias("is_"), F.sum("said").alias("said")).where(F.col("label") != unknown)
    p, r = F.try_divide("hit", "said"), F.try_divide("hit", "is_")
    per = per.select("label", F.coalesce(p, F.lit(0.0)).alias("precision"), F.coalesce(r, F.lit(0.0)).alias("recall"), "is_")
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    per = per.withColumn("f1", f1)
    whole = cells.agg((F.sum(F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"), (F.sum(F.when(F.col("g") == unknown, F.col("n")).otherwise(0)) / F.sum("n")).alias("unknown_rate"))
    macro = per.where("is_ > 0").agg(F.avg("f1").alias("macro_f1"))
    return per.crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(macro)).drop("is_")
