import base64
import gzip
import hashlib

from pyspark.sql import functions as F

from quillon.llm import warc
from quillon.llm.common import file_system, new_folder


def expect(pages):
    groups = {}
    for i, _, h in pages:
        groups.setdefault((h or "").encode(), []).append(i)
    out = []
    for data, ids in groups.items():
        top = max(ids, key=lambda x: (x is not None, x))
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        left = list(ids)
        left.remove(top)
        out += [(top, len(data), digest, "response", None)] + [(i, len(data), digest, "revisit", top) for i in left]
    return sorted(out, key=repr)


PAGES = [(1, "http://a/é\r\nX: y", "<p>é</p>"), (2, "http://b", "<p>é</p>"), (3, None, None), (4, "c", ""), (5, "d", "x" * 3_000_000), (6, "e", "\r\n\r\nWARC/1.1\r\n"), (2, "http://b", "<p>é</p>"), (2, "http://b2", "<p>é</p>"), (None, "f", "only"), (9, "g", "only")]


def test_round_trip(spark):
    d = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").selectExpr("*", "1 as offset", "'x' as sha1", "2 as payload", "'f' as file")
    rows = warc.round_trip(d).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=repr) == expect(PAGES)
    texts = {h or "" for _, _, h in PAGES}
    assert {bytes(r.payload).decode() for r in rows if r.record_type == "response"} == texts


def test_selected_records_and_members(spark):
    d = spark.createDataFrame([(i, f"u{i}", f"<p>{i % 50}</p>" * 99) for i in range(400)], "page_id bigint, url string, html string")
    index = warc.write_warc(d, new_folder(spark, "w"), least_bytes=0)
    some = warc.read_warc(index.where("page_id % 7 = 0"), gap=100, most=4096)
    assert {r.page_id for r in some.collect()} == set(range(0, 400, 7))
    r = index.where("record_type = 'response'").first()
    fs, path = file_system(r.file)
    with fs.open_input_file(path) as f:
        record = warc.parse_record(gzip.decompress(f.read_at(r.length, r.offset)))
    assert record["X-Page-ID"] == str(r.page_id) and record["WARC-Type"] == "response"
    assert index.agg(F.count_if(F.col("record_type") == "response")).first()[0] == 50


def test_small_payloads_stay(spark):
    d = spark.createDataFrame([(1, "a", "xy"), (2, "b", "xy"), (3, "c", "long one"), (4, "d", "long one")], "page_id bigint, url string, html string")
    got = {r.page_id: r.record_type for r in warc.round_trip(d, least_bytes=3).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    assert warc.round_trip(d.where("false")).count() == 0
