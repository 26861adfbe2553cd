from pyspark.sql import functions as F

from quillon.llm import urls
from quillon.llm.queries import URL_RULES


def test_rules_and_parts(spark):
    pages = [(1, "http://A.Example.ORG/es/x?q#f"), (2, "https://example.org/en/12"), (3, "x.com/fr/"), (4, None), (5, "ftp://u.com"), (6, "http://b.com/de/?a://c"), (7, "http://notexample.org/es/"), (8, "http://example.org:80/es/"), (9, "http://É.org#/x"), (10, "http://org?/"), (11, "://com/fr/a\nb"), (12, "")]
    d = spark.createDataFrame(pages, "page_id bigint, url string").withColumn("key", F.lit("x")).withColumn("block", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(d, URL_RULES, d.where("false")).collect()}
    assert got == {
        1: ("a.example.org", "/es/x", "example.org/es/", "block"), 2: ("example.org", "/en/12", "example.org/en/1", "block"), 3: ("", "", None, "allow"), 4: ("", "", None, "allow"),
        5: ("u.com", "", None, "allow"), 6: ("b.com", "/de/", "com/de/", "block"), 7: ("notexample.org", "/es/", "org/", "allow"), 8: ("example.org:80", "/es/", None, "allow"),
        9: ("É.org", "", None, "allow"), 10: ("org", "", None, "allow"), 11: ("com", "/fr/a\nb", "com/fr/", "allow"), 12: ("", "", None, "allow"),
    }


def test_listed_exactly(spark):
    pages = spark.createDataFrame([(i, f"http://www.h{i % 7}.net/p{i}/?utm_source=x&b=2&a=1#t") for i in range(3000)] + [(i, "http://hot.net/") for i in range(5000, 5600)], "page_id bigint, url string")
    listed = spark.createDataFrame([(f"https://h{i % 7}.net/p{i}?a=1&b=2",) for i in range(0, 3000, 3)] + [("http://hot.net",), (None,), ("none",)], "url string")
    for size in (32 << 20, 0):  # broadcast and joined
        got = urls.judge_urls(pages, [], listed, broadcast_bytes=size)
        assert {r.page_id for r in got.where("verdict = 'block'").collect()} == set(range(0, 3000, 3)) | set(range(5000, 5600))
        assert got.count() == 3600


def test_filter_passes_few(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    n_blocks = -(-5000 * 16 // 512)
    bloom = urls.bloom_table(keys, "key", n_blocks)
    asked = spark.range(5000, 25000).select(F.concat(F.lit("k"), "id").alias("key")).union(keys)
    block, h = urls._hashes(F.col("key"), n_blocks)
    hit = F.lit(True)
    for w, mask in enumerate(urls._places(h, 6)):
        hit = hit & (F.col(f"w{w}").bitwiseAND(mask) == mask)
    rows = asked.withColumn("b", block).join(bloom, F.col("b") == F.col("block")).where(hit)
    n = rows.count()
    assert rows.join(keys, "key").count() == 5000 and n < 5000 + 20000 * 0.01
