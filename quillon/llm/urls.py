"""URL filters: host and path rules, then a blocked Bloom filter of listed canonical URLs.

With DataFrame and SQL functions alone.  Each listed URL sets ``probes`` bits in one block of 512
bits; the filter is a table with a row for each block.  A URL whose bits are all set is a possible hit
and goes on to an exact hash join with the list, which removes false positives; all other URLs are
done without a shuffle.  The filter is broadcast if its bytes (known from the number of blocks) are
at most ``broadcast_bytes``; beyond that it is joined by block like any table.

Defined cases: a null URL or one without "://" has an empty host and path, fits no rule and is never
listed; repeated pages give one row each; an empty list blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UPPER

#: Words of a block: 8 x 64 bits.
WORDS = 8


def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host: after the first "://" up to /, ?, # or the end, A-Z lower-cased.  Path: then up to ? or #."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, UPPER.lower())
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical(url: F.Column) -> F.Column:
    """Host without "www." or a default port, path without a trailing slash or ".html", query parameters
    sorted without tracking ones; no scheme, no fragment.  Null without "://"."""
    host, path = host_and_path(url)
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(path, r"/+$", ""), r"\.html?$", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[a-z]+|ref|fbclid|gclid)=")))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(F.instr(url, "://") > 0, F.concat(host, path, query))


def rule_of(host: F.Column, path: F.Column, rules: list[tuple[str, str, str]]) -> tuple[F.Column, F.Column]:
    """The longest rule (verdict, host, path) that fits, as text, and its verdict; null if none does.
    Rules of one length go by their text."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def _hashes(key: F.Column, n_blocks: int) -> tuple[F.Column, F.Column]:
    """The block of a key, and a second hash whose bits choose its places."""
    return F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("bigint"), F.xxhash64(key, F.lit(1))


def _places(h: F.Column, probes: int) -> F.Column:
    """A mask for each of the block's words, 9 bits of the hash for each probe: 3 for the word and 6 for the bit."""
    steps = [F.shiftrightunsigned(h, 9 * i).bitwiseAND(F.lit(511)) for i in range(probes)]
    one = F.lit(1).cast("bigint")
    masks = []
    for w in range(WORDS):
        mask = F.lit(0).cast("bigint")
        for s in steps:
            bit = F.call_function("shiftleft", one, s.bitwiseAND(F.lit(63)).cast("int"))
            mask = mask.bitwiseOR(F.when(F.shiftright(s.cast("int"), 6) == w, bit).otherwise(F.lit(0).cast("bigint")))
        masks.append(mask.alias(f"w{w}"))
    return masks


def bloom_table(keys: DataFrame, key: str, n_blocks: int, probes: int = 6) -> DataFrame:
    """block, w0 .. w7: the filter; combined before the shuffle, a row for each block with a key."""
    block, h = _hashes(F.col(key), n_blocks)
    masked = keys.select(block.alias("block"), *_places(h, probes))
    return masked.groupBy("block").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(WORDS)])


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame, *, page_id: str = "page_id", url: str = "url", listed_url: str = "url", bits_per_url: int = 16, probes: int = 6, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """page_id, host, path, rule, verdict, listed for each row of ``pages``.

    A rule decides where one fits; else a listed URL is blocked and any other allowed."""
    keys = listed.select(canonical(F.col(listed_url)).alias("key")).where("key is not null").distinct()
    n_blocks = max(1, -(-keys.count() * bits_per_url // (64 * WORDS)))
    bloom = bloom_table(keys, "key", n_blocks, probes)
    if n_blocks * (WORDS + 1) * 8 <= broadcast_bytes:
        bloom = F.broadcast(bloom)
    host, path = host_and_path(F.col(url))
    seen = pages.select(F.col(page_id).cast("bigint").alias("page_id"), host.alias("host"), path.alias("path"), canonical(F.col(url)).alias("key"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    block, h = _hashes(F.coalesce(F.col("key"), F.lit("")), n_blocks)
    seen = seen.withColumn("rule", rule).withColumn("said", verdict).withColumn("__block", block)
    tested = seen.join(bloom, F.col("__block") == F.col("block"), "left")
    all_set = F.lit(True)
    for w, mask in enumerate(_places(h, probes)):
        all_set = all_set & (F.coalesce(F.col(f"w{w}"), F.lit(0).cast("bigint")).bitwiseAND(mask) == mask)
    tested = tested.withColumn("maybe", F.col("key").isNotNull() & all_set).select("page_id", "host", "path", "key", "rule", "said", "maybe")
    exact = tested.where("maybe").join(keys.select(F.col("key").alias("k")), F.col("key") == F.col("k"), "left").withColumn("listed", F.col("k").isNotNull()).drop("k")
    out = tested.where("not maybe").withColumn("listed", F.lit(False)).unionByName(exact)
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "listed")
