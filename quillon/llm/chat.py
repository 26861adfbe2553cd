"""Chat formatting with typed content parts.

A turn's content is an array of parts (type, text, ref, size).  A visitor flattens them in order: text
is escaped and kept, an image, audio or document part becomes a placeholder that names its number among
the conversation's attachments; the attachment's reference and expanded token count are recorded.

Template, one turn:  ``### <role>:`` newline, content, ``</turn>`` newline.  In roles and texts ``\\``, ``#``,
``<`` and ``[`` get a ``\\`` before them, so no text can hold a mark of the template or a placeholder
(``[image:3]``), and unescaping gives the text back exactly.  The loss mask covers the content of assistant
turns: spans of the formatted string, in code points.

Conversations are grouped by sorting: rows are dealt by a hash of conv_id, sorted by turn in their partition
and read as a stream; a worker holds one conversation at a time, which is what a formatted string needs.

Defined cases: null texts and roles are empty; turns of one number go by role, then text; null turns come
first; rows with a null conv_id form one conversation; unknown part types raise an error.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trimmed

PARTS = "array<struct<type:string,text:string,ref:string,size:bigint>>"
_SPECIAL = re.compile(r"[\\#<\[]")
_TURN = re.compile(r"### ((?:[^\\]|\\.)*?):\n((?:[^\\<]|\\.)*)</turn>\n", re.S)
_PLACE = re.compile(r"\[(image|audio|document):(\d+)\]")


def escape(text: str) -> str:
    return _SPECIAL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


class Visitor:
    """Flattens parts into content and records the attachments.

    Expanded tokens: an image of ``size`` pixels takes one for each ``image_patch`` ** 2 of them, audio of ``size``
    milliseconds one for each ``audio_ms``, a document of ``size`` bytes one for each ``document_bytes``; rounded up, one at
    least.  A placeholder stands for that many tokens."""

    def __init__(self, image_patch: int = 14, audio_ms: int = 40, document_bytes: int = 4):
        self.unit = {"image": image_patch**2, "audio": audio_ms, "document": document_bytes}
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> str:
        kind = part.get("type") or "text"
        return getattr(self, f"visit_{kind}", self.unknown)(part)

    def visit_text(self, part: dict) -> str:
        return escape(part.get("text") or "")

    def _attach(self, part: dict) -> str:
        kind, size = part["type"], part.get("size") or 0
        number = len(self.attachments)
        self.attachments.append({"number": number, "type": kind, "ref": part.get("ref"), "tokens": max(1, -(-size // self.unit[kind]))})
        return f"[{kind}:{number}]"

    visit_image = visit_audio = visit_document = _attach

    def unknown(self, part: dict) -> str:
        raise ValueError(f"unknown content part type {part.get('type')!r}")


def format_turns(turns: list[tuple[str | None, list[dict]]], **units) -> tuple[str, list[tuple[int, int]], list[dict]]:
    """Formatted string, loss spans and attachments of a conversation."""
    visitor, out, spans, at = Visitor(**units), [], [], 0
    for role, parts in turns:
        head = f"### {escape(role or '')}:\n"
        content = "".join(map(visitor.visit, parts or []))
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(content)))
        out += (head, content, "</turn>\n")
        at += len(head) + len(content) + 8
    return "".join(out), spans, visitor.attachments


def read_turns(formatted: str) -> list[tuple[str, list[tuple[str, str]]]]:
    """Role and content of each turn: pieces (type, text or attachment number)."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"not a turn at {at}")
        turns.append((unescape(m[1]), list(_pieces(m[2]))))
        at = m.end()
    return turns


def _pieces(content: str) -> Iterator[tuple[str, str]]:
    last = 0
    for m in re.finditer(r"\\.|\[(image|audio|document):(\d+)\]", content, re.S):
        if m[1]:
            if m.start() > last:
                yield "text", unescape(content[last : m.start()])
            yield m[1], m[2]
            last = m.end()
    if last < len(content):
        yield "text", unescape(content[last:])


def format_conversations(rows: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", parts: str | None = None, **units) -> DataFrame:
    """conv_id, formatted, loss (array of start, end), attachments (array of number, type, ref, tokens): a row for
    each conversation.  With ``parts`` that column has each turn's parts; else the text is its one part."""
    content = F.col(parts).cast(PARTS) if parts else F.array(F.struct(F.lit("text").alias("type"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("size")))
    turns = rows.select(F.col(conv_id).cast("bigint").alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), content.alias("parts"))
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "parts")

    def run(batches: Iterator[pa.RecordBatch]):
        nobody = object()
        now, held = nobody, []
        done: list[tuple] = []
        size = 0

        def emit():
            nonlocal done, size
            ids, formatted, spans, attached = zip(*done)
            done, size = [], 0
            loss = pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            files = pa.array(attached, pa.list_(pa.struct([("number", pa.int64()), ("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(formatted, pa.string()), loss, files], names=["conv_id", "formatted", "loss", "attachments"])

        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                for c, r, p in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist()):
                    if c != now or now is nobody:
                        if held:
                            done.append((now, *format_turns(held, **units)))
                            size += len(done[-1][1])
                            if size > 4_000_000:
                                yield emit()
                        now, held = c, []
                    held.append((r, p))
        if held:
            done.append((now, *format_turns(held, **units)))
        if done:
            yield emit()

    return dealt.mapInArrow(trimmed(run), "conv_id bigint, formatted string, loss array<struct<start:bigint,end:bigint>>, attachments array<struct<number:bigint,type:string,ref:string,tokens:bigint>>")


def report(formatted: DataFrame) -> DataFrame:
    """Digests read back from the formatted strings and their loss masks."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            rows = []
            for c, f, loss in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                turns = read_turns(f)
                said = hashlib.sha256()
                for role, pieces in turns:
                    said.update((role + "\n" + "".join(t for k, t in pieces if k == "text") + "\n").encode("utf-8", "surrogatepass"))
                under = "".join(unescape(f[x["start"] : x["end"]]) for x in loss)
                rows.append((c, len(turns), said.hexdigest(), len(under), hashlib.sha256(under.encode("utf-8", "surrogatepass")).hexdigest(), len(f)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "loss").mapInArrow(trimmed(run), "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
