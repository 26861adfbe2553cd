"""Mixing sources to target weights, with DataFrame and SQL functions alone.

1. Words are counted, and each source's share is computed by water-filling: sources share ``budget``
   times all words by weight, none beyond ``cap`` times its own words.
2. A source's documents in the order of a salted hash are one run of words, cut into blocks: a document
   belongs to the block of ``block`` words in which it starts.  Whole epochs take every block; a last
   partial epoch takes permuted blocks up to the exact quota.  Only the document at which the quota ends is
   cut, one for each source.
3. A multivariate-hypergeometric splitting tree divides the block quotas of all sources among the output
   shards: each node gives its left half a draw without replacement of exactly half its blocks, and the
   rest goes right.  Leaves hold the quota of a shard by source.
4. Each shard takes the next disjoint run of each source's permuted blocks and shuffles them locally: the mix
   comes out by shard and, in a shard, in the order of a hash of its blocks.

Block size: the least power of two, ``block`` at least, with which all sources together have words for at most
``max_blocks``; each source may add one block that is not full, and epochs repeat them.  Running sums over a source, an
epoch or the tree go in two steps (within ranges of a hash, then over the ranges), so a source with most of the
rows is spread like any other, and no row or task holds all blocks.

Defined cases: null texts have no words and are taken 0 times; a null source is a source of its own, last
in order; equal documents are told apart by their id, else they are one row of words; without words
nothing is taken; reruns give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

#: Running sums go over 2 ** RANGE_BITS ranges of a hash; those of blocks, which are bounded, over 2 ** BLOCK_BITS.
RANGE_BITS, BLOCK_BITS = 10, 6


def count_words(text) -> F.Column:
    """Words of a text, none for null.  Each run of word characters becomes one letter first: no array."""
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(text, WORD, "x"), r"[\x20\x09-\x0D]", "")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``sizes`` (source, source_size) with each source's weight and target (words, double).

    Weights repeat over the sources in code point order, null last.  Sources fill in the order of
    limit / weight: those whose share of what is left would pass their limit get the limit."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy(F.col("top") / F.col("weight"), F.col("source").asc_nulls_last())
    w = F.array(*[F.lit(float(x)) for x in weights])
    s = sizes.withColumn("weight", F.element_at(w, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int") + 1)).withColumn("top", F.col("source_size") * F.lit(float(cap)))
    whole = Window.partitionBy()
    s = s.withColumn("all", F.sum("source_size").over(whole) * F.lit(float(budget))).withColumn("sum_weight", F.sum("weight").over(whole))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("left", F.col("all") - F.coalesce(F.sum("top").over(before), F.lit(0.0))).withColumn("left_weight", F.col("sum_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # The level at a source if all before it are full; the first source that it does not fill sets it for the rest.
    s = s.withColumn("open", F.col("weight") * F.col("left") <= F.col("top") * F.col("left_weight"))
    level = F.min(F.when(F.col("open"), F.struct(F.col("top") / F.col("weight"), F.col("source").isNull().alias("n"), F.col("source"), (F.col("left") / F.col("left_weight")).alias("level")))).over(whole)["level"]
    target = F.least("top", F.coalesce(level * F.col("weight"), F.col("top")))
    return s.withColumn("target", target).select("source", "source_size", "weight", "target")


def running(rows: DataFrame, group: list[str], order: str, ties: list[str], values: dict[str, str], bits: int = BLOCK_BITS) -> DataFrame:
    """``rows`` with sums over the group's earlier rows: name -> SQL of the value.  The order is that of the unsigned hash
    ``order``, then ``ties``; ``group`` has no nulls.  First sums of ranges of the hash, then in each range."""
    rows = rows.withColumn("__range", F.shiftrightunsigned(order, 64 - bits).cast("int"))
    sums = rows.groupBy(*group, "__range").agg(*[F.sum(F.expr(v)).alias(f"__{n}") for n, v in values.items()])
    over = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*group, "__range", *[F.coalesce(F.sum(f"__{n}").over(over), F.lit(0)).alias(f"__base_{n}") for n in values])
    inside = Window.partitionBy(*group, "__range").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", *[F.coalesce(F.sum(F.expr(v)).over(inside), F.lit(0)).alias(f"__in_{n}") for n, v in values.items()])
    rows = rows.join(base, [*group, "__range"])
    kept = [c for c in rows.columns if not c.startswith(("__range", "__in_", "__base_"))]
    return rows.select(*kept, *[(F.col(f"__base_{n}") + F.col(f"__in_{n}")).cast("bigint").alias(n) for n in values])


def split_quotas(quotas: DataFrame, shards: int, seed: int = 17) -> DataFrame:
    """``quotas`` (source_no, quota) among ``shards`` shards (a power of two) of equal totals.

    Returns shard, source_no, first, quota: the shard takes the draws first .. first + quota - 1 of the
    source.  A node of the tree has a run of the units of all quotas in the order of a hash; its left half is the first half of
    the run, a draw without replacement by source, and so down to the leaves.  The run's bounds are halved in each row, so
    the tree costs one running count over all units."""
    units = quotas.where("quota > 0").select("source_no", F.explode(F.expr("sequence(0L, quota - 1)")).alias("unit"))
    units = units.withColumn("__key", F.xxhash64("source_no", "unit", F.lit(seed)))
    ranked = running(units, [], "__key", ["source_no", "unit"], {"place": "1"})
    halve = """aggregate(sequence(1, {depth}), named_struct('shard', 0L, 'place', place, 'size', {total}L),
        (n, level) -> if(n.place < n.size div 2,
            named_struct('shard', n.shard * 2, 'place', n.place, 'size', n.size div 2),
            named_struct('shard', n.shard * 2 + 1, 'place', n.place - n.size div 2, 'size', n.size - n.size div 2)),
        n -> n.shard)"""
    depth = (shards - 1).bit_length()
    total = quotas.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    leaf = ranked.withColumn("shard", F.expr(halve.format(depth=depth, total=total)) if depth else F.lit(0).cast("bigint"))
    leaf = leaf.groupBy("source_no", "shard").agg(F.count("*").alias("quota"))
    before = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return leaf.select("shard", "source_no", F.coalesce(F.sum("quota").over(before), F.lit(0)).cast("bigint").alias("first"), "quota")


def mix(docs: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), budget: float = 1.5, cap: float = 2.0, block: int = 4096, max_blocks: int = 1 << 17, shards: int = 16, seed: int = 17, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """Two tables.  ``documents``: a row for each row of ``docs`` with doc_id, source, copy (a hash of the
    text), size, source_size, target.  ``pieces``: what the mix takes: doc_id, source, copy, size, epoch,
    words (its first words, all but for one document of a source), shard, place (of its block in the shard's order)."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(source).cast("string").alias("source"), F.xxhash64(F.col(text)).alias("copy"), count_words(F.col(text)).alias("size"))
    rows = materialize(rows.withColumn("order", F.xxhash64("doc_id", "copy", F.lit(seed))), "sizes")
    sizes = materialize(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    targets = source_targets(sizes, weights=weights, budget=budget, cap=cap).withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("bigint"))
    total = sizes.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    while total > block * max_blocks:
        block *= 2
    plan = targets.withColumn("goal", F.round("target").cast("bigint"))
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("goal div source_size")).otherwise(0).cast("bigint"))
    plan = materialize(plan.withColumn("rest", F.col("goal") - F.col("epochs") * F.col("source_size")), "plan")
    # Where each document's words lie in its source, and the block they start in.
    named = plan.select(F.col("source").alias("__s"), "source_no", "source_size", "target")
    laid = rows.join(named, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    laid = running(laid, ["source_no"], "order", ["doc_id", "copy"], {"start": "size"}, RANGE_BITS).withColumn("block", F.expr(f"start div {block}"))
    documents = materialize(laid.select("doc_id", "source", "copy", "size", "source_size", "target", "source_no", "start", "block"), "documents")
    # Blocks of each source in the order of a hash, for each epoch, and how many words of each are taken.
    blocks = documents.where("size > 0").groupBy("source_no", "block").agg(F.sum("size").alias("length"), F.min("start").alias("first_word"))
    blocks = materialize(blocks, "blocks")
    n_blocks = blocks.groupBy("source_no").agg(F.count("*").alias("n_blocks"))
    epochs = plan.where("source_size > 0").select("source_no", "epochs", "rest", F.explode(F.expr("sequence(0L, epochs)")).alias("epoch")).where("epoch < epochs or rest > 0")
    drawn = blocks.join(epochs, "source_no").withColumn("__key", F.xxhash64("source_no", "epoch", "block", F.lit(seed + 1)))
    drawn = running(drawn, ["source_no", "epoch"], "__key", ["block"], {"before": "length", "rank": "1"})
    drawn = drawn.withColumn("words", F.when(F.col("epoch") < F.col("epochs"), F.col("length")).otherwise(F.least("length", F.col("rest") - F.col("before")))).where("words > 0")
    # Whole epochs take all blocks, a partial one the first in order, so draws are numbered without a gap.
    drawn = drawn.join(n_blocks, "source_no").select("source_no", "epoch", "block", "first_word", "words", (F.col("epoch") * F.col("n_blocks") + F.col("rank")).alias("draw"))
    drawn = materialize(drawn, "draws")
    quotas = materialize(drawn.groupBy("source_no").agg(F.count("*").alias("quota")), "quotas")
    runs = split_quotas(quotas, shards, seed).select("shard", "source_no", F.explode(F.expr("sequence(first, first + quota - 1)")).alias("draw"))
    placed = drawn.join(runs, ["source_no", "draw"]).withColumn("place", F.xxhash64("shard", "source_no", "draw", F.lit(seed + 2)))
    pieces = documents.where("size > 0").join(placed, ["source_no", "block"]).withColumn("words", F.least("size", F.col("first_word") + F.col("words") - F.col("start"))).where("words > 0")
    return documents, pieces.select("doc_id", "source", "copy", "size", "epoch", "words", "shard", "place", "source_no", "start")


def mixed_sizes(docs: DataFrame, **options) -> DataFrame:
    """For each document: doc_id, source, size, source_size, target, taken (words, repeats counted), shards (where its words
    went: shard:words by epoch, comma-joined)."""
    documents, pieces = mix(docs, **options)
    went = F.array_sort(F.collect_list(F.struct("epoch", "shard", "words")))
    went = F.array_join(F.transform(went, lambda x: F.concat(x["shard"].cast("string"), F.lit(":"), x["words"].cast("string"))), ",")
    taken = pieces.groupBy("source_no", "start").agg(F.sum("words").alias("taken"), went.alias("shards"))
    # Documents with words have a place of their own in their source; those without take none.
    some = documents.where("size > 0").join(taken, ["source_no", "start"], "left")
    none = documents.where("size = 0").withColumn("taken", F.lit(0).cast("bigint")).withColumn("shards", F.lit(""))
    both = some.unionByName(none, allowMissingColumns=True)
    return both.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), F.coalesce("shards", F.lit("")).alias("shards"))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def mixed_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", shard: str | None = None, **options) -> DataFrame:
    """``docs`` as mixed: each row as often as it is taken, texts whole: a document at which a source's
    quota ends counts if at least half its words do.  All columns stay; equal rows (same id, source
    and text) share what they are taken.

    Rows come in the order of the shards, in a shard in that of its shuffled blocks, in ranges that Spark keeps when it
    writes them; ``shard`` names a further column for the shard's number."""
    documents, pieces = mix(docs, doc_id=doc_id, text=text, source=source, **options)
    keys = ["doc_id", "source", "copy"]
    counts = documents.where("size > 0").groupBy(*keys).agg(F.count("*").alias("rows"))
    equal = materialize(counts.where("rows > 1"), "equal-rows")
    taken = pieces.where("2 * words >= size").select(*keys, "epoch", "shard", "place", "start")
    own = [F.col(doc_id).cast("bigint").alias("__d"), F.col(source).cast("string").alias("__s"), F.xxhash64(F.col(text)).alias("__c")]
    # The rows' columns travel in one, so that no name of theirs meets one of ours.
    rows = docs.select(F.struct(*[F.col(_quoted(c)) for c in docs.columns]).alias("__row"), *own)
    same = lambda x, y: F.col(x[0]).eqNullSafe(F.col(y[0])) & F.col(x[1]).eqNullSafe(F.col(y[1])) & (F.col(x[2]) == F.col(y[2]))
    theirs, mine = ["doc_id", "source", "copy"], ["__d", "__s", "__c"]
    renamed = lambda df, more: df.select(*[F.col(a).alias(f"__{a}") for a in [*theirs, *more]])
    their = [f"__{a}" for a in theirs]
    places = ["epoch", "shard", "place", "start"]
    if equal.isEmpty():
        out = rows.join(renamed(taken, places), same(mine, their))
    else:
        # Of n equal rows the i-th takes every n-th piece from the i-th on.  Both are numbered from written tables.
        few = renamed(equal, ["rows"])
        several = materialize(rows.join(few, same(mine, their)).withColumn("__i", F.monotonically_increasing_id()), "several")
        several = several.withColumn("__g", F.xxhash64(*mine)).withColumn("__key", F.xxhash64("__i"))
        several = running(several, ["__g"], "__key", ["__i"], {"__n": "1"}, RANGE_BITS).drop("__g", "__key", "__i", *their, "__rows")
        dealt = renamed(taken, places).join(few.select(*[F.col(c).alias(f"{c}_2") for c in their], "__rows"), same(their, [f"{c}_2" for c in their])).drop(*[f"{c}_2" for c in their])
        dealt = dealt.withColumn("__g", F.xxhash64(*their)).withColumn("__key", F.xxhash64("__start", "__epoch"))
        dealt = running(dealt, ["__g"], "__key", ["__start", "__epoch"], {"__m": "1"}, RANGE_BITS).withColumn("__m", F.expr("__m % __rows")).drop("__g", "__key", "__rows")
        alone = renamed(taken, places).join(few.select(*[F.col(c).alias(f"{c}_2") for c in their]), same(their, [f"{c}_2" for c in their]), "left_anti")
        out = rows.join(alone, same(mine, their)).unionByName(several.join(dealt, same(mine, their) & (F.col("__n") == F.col("__m"))).drop("__n", "__m"))
    order = ["__shard", "__place", "__start"]
    out = out.repartitionByRange(*order).sortWithinPartitions(*order)
    return out.select(*[F.col(f"__row.{_quoted(c)}") for c in docs.columns], *([F.col("__shard").alias(shard)] if shard else []))
