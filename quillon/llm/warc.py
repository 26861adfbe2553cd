"""WARC files, index first.

Writing gives an index: file, offset, length, URL and digest of each record (a gzip member of its own).  Reading
goes by the index: the selected records are sorted by file and offset, neighbouring byte ranges are coalesced, each
range is read at once and its records are parsed and checked against their digests.

Of records with equal payloads of ``least_bytes`` or more, that with the largest page_id is a response and the others
are revisit records without payload, which name it; of rows with the same page_id, payload and URL hash order decides.

Files are written through pyarrow's file systems.  Each attempt of a task has a file of its own, and the index names
that of the attempt which Spark committed: a task that is run again or twice at once breaks nothing.  Payloads are shuffled once, to the rows' decisions; digests and ids alone are grouped.

Defined cases: null html is an empty payload, null URLs are empty; repeated rows each have a record; an empty table
writes nothing.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_system, materialize, new_folder, trimmed

INDEX = "file string, offset bigint, length bigint, page_id bigint, url string, digest string, record_type string"
_DATE = "2026-01-01T00:00:00Z"


def _urn(page_id: int | None, digest: str, extra: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}{extra}')}>"


def make_record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, kind: str) -> bytes:
    """A response or revisit record with its header and HTTP head."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    # A line break in a URL would end its header line.
    clean = url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if any(c in url for c in "\r\n") else url
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id, digest, kind)}", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-ID: {'' if page_id is None else page_id}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to, digest, 'response')}", f"X-Refers-To-Page: {'' if refers_to is None else refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers and payload of a record; raises if a length or digest does not hold."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    if headers["WARC-Type"] == "response":
        if len(payload) != size or "sha1:" + digest_of(payload) != headers["WARC-Payload-Digest"]:
            raise ValueError("a payload does not match its header")
    return headers | {"payload": payload, "payload_bytes": size}


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_digests(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, payload (binary), sha1 (hex): built-in functions alone."""
    return pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload")).withColumn("sha1", F.sha1("payload"))


def write_warc(pages: DataFrame, folder: str, *, least_bytes: int = 0, level: int = 3, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes the archives and returns the index: a row for each record."""
    rows = with_digests(pages, page_id=page_id, url=url, html=html)
    # Which row of each payload is the response; combined before the shuffle.
    rank = F.struct(F.col("page_id"), F.xxhash64("url").alias("u"))
    groups = rows.where(F.octet_length("payload") >= least_bytes).groupBy("sha1").agg(F.max(rank).alias("top"), F.count("*").alias("n")).where("n > 1").select(F.col("sha1").alias("s"), "top")
    decided = rows.join(groups, F.col("sha1") == F.col("s"), "left").withColumn("own", F.struct(F.col("page_id"), F.xxhash64("url").alias("u")))
    decided = decided.select("page_id", "url", "payload", "sha1", (F.col("s").isNull() | (F.col("own").eqNullSafe(F.col("top")))).alias("first"), F.col("top")["page_id"].alias("refers_to"), F.col("s").isNotNull().alias("shared"))
    several = decided.where("shared and first").groupBy("page_id", "sha1", F.xxhash64("url")).count().where("count > 1").limit(1).count()

    def write(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz"
        fs, path = file_system(folder)
        fs.create_dir(path, recursive=True)
        out, offset, index = None, 0, []
        for b in batches:
            for at in range(0, b.num_rows, 200):
                for r in b.slice(at, 200).to_pylist():
                    if out is None:
                        out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    digest = base64.b32encode(bytes.fromhex(r["sha1"])).decode()
                    kind = "response" if r["first"] else "revisit"
                    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
                    data = make_record(r["page_id"], r["url"], r["payload"], digest, r["refers_to"], kind)
                    data = squeeze.compress(data) + squeeze.flush()
                    out.write(data)
                    index.append((f"{folder}/{name}", offset, len(data), r["page_id"], r["url"], digest, kind))
                    offset += len(data)
        if out is not None:
            out.close()
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*index), kinds)], names=[x.split()[0] for x in INDEX.split(", ")])

    if several:
        # Rows that are alike to the last column: all but one of them revisit it.
        from pyspark.sql import Window

        alike = Window.partitionBy("page_id", "sha1", F.xxhash64("url")).orderBy(F.lit(1))
        top = decided.where("shared and first").withColumn("first", F.row_number().over(alike) == 1)
        decided = decided.where("not (shared and first)").unionByName(top)
    return materialize(decided.drop("shared").mapInArrow(trimmed(write), INDEX), "warc-index")


def read_warc(index: DataFrame, *, gap: int = 64 << 10, most: int = 8 << 20) -> DataFrame:
    """The records that ``index`` selects: page_id, url, payload_bytes, payload_digest, record_type, refers_to,
    payload (null for revisits).

    Rows are dealt by file and region of ``most`` bytes and sorted by offset; ranges at most ``gap`` bytes apart are read
    together, up to ``most`` bytes or one record."""
    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
    sorted_ = index.select("file", "offset", "length", "url").withColumn("region", F.expr(f"offset div {most}")).repartition("file", "region").sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pa.RecordBatch]):
        stream, name = None, None
        waiting: list[tuple[int, int, str]] = []

        def fetch():
            first, end = waiting[0][0], max(o + n for o, n, _ in waiting)
            data = stream.read_at(end - first, first)
            rows = []
            size = 0
            for o, n, url in waiting:
                r = parse_record(zlib.decompress(data[o - first : o - first + n], 31))
                to = r.get("X-Refers-To-Page")
                kind = r["WARC-Type"]
                rows.append((int(r["X-Page-ID"]) if r["X-Page-ID"] else None, url, r["payload_bytes"], r["WARC-Payload-Digest"][5:], kind, int(to) if to else None, r["payload"] if kind == "response" else None))
                size += r["payload_bytes"]
                if size > 16 << 20:
                    yield _records(rows)
                    rows, size = [], 0
            waiting.clear()
            if rows:
                yield _records(rows)

        for b in batches:
            for file, offset, length, url in zip(*(b.column(i).to_pylist() for i in range(4))):
                if waiting and (file != name or offset - waiting[-1][0] - waiting[-1][1] > gap or offset + length - waiting[0][0] > most):
                    yield from fetch()
                if file != name:
                    fs, path = file_system(file)
                    stream, name = fs.open_input_file(path), file
                waiting.append((offset, length, url))
        if waiting:
            yield from fetch()

    return sorted_.mapInArrow(trimmed(read), schema)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=list(names))


def round_trip(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Writes the archives to ``folder`` (a new shared one by default) and reads them all back."""
    return read_warc(write_warc(pages, folder or new_folder(pages.sparkSession, "warc"), **options))
