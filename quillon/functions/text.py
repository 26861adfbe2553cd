"""Text functions on columns; built-in expressions, so they stay inside generated code.

Java patterns carry ``(?Ud)``: Unicode classes, and ``.`` stops at a line feed alone.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Outline patterns of the notice format.
TOP_HEADING = r"(?Ud)^(\d+)\.\s+(.+)$"
SUB_HEADING = r"(?Ud)^([가나다라마바사아자차카타파하])\.\s*([^:]+?)(?:\s*:\s*(.+))?$"
NUMBERED_ITEM = r"(?Ud)^\((\d+)\)\s*(.+)$"
CIRCLED_ITEM = r"(?Ud)^([①-⑳])\s*(.+)$"
BULLET_ITEM = r"(?Ud)^([‧•])\s*(.+)$"

# Tags that make a text HTML, by the use of the answer.
BLOCK_TAGS = "html|body|div|p|h[1-6]|table"
EXCERPT_TAGS = BLOCK_TAGS + "|ul|ol|blockquote|strong|b|em|i|u"
SIGNAL_TAGS = BLOCK_TAGS + "|ul|ol"

#: Fixed value: characters that Markdown may give a meaning.
MARKDOWN_SPECIAL = "&<>\\`*_{}[]()#+-.!|~"


def strip(c: Column) -> Column:
    """Without white space at the ends: all that Python's str.strip() takes."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f\x85]+|[\s\x1c-\x1f\x85]+$", "")


def newlines(c: Column) -> Column:
    """CR LF and CR become LF."""
    return F.regexp_replace(c, r"\r\n?", "\n")


@F.pandas_udf(T.StringType())
def nfc(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode NFC; Spark has no function for it."""
    for s in parts:
        yield s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def normalized(c: Column) -> Column:
    """Newlines and NFC; plain ASCII and null values need no Python, but share its column."""
    return nfc(newlines(c))


def html_escape(c: Column) -> Column:
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(escaped))
    return c


def markdown_escape(c: Column) -> Column:
    """Special characters as numeric references, line breaks as spaces; one character at a time, so
    nothing is escaped twice."""
    special = F.lit(MARKDOWN_SPECIAL)
    one = lambda x: F.when((x != "") & F.contains(special, x), F.concat(F.lit("&#"), F.ascii(x).cast("string"), F.lit(";"))).when(x.isin("\r", "\n"), F.lit(" ")).otherwise(x)
    return F.array_join(F.transform(F.split(c, ""), one), "")


def code_fence(c: Column, language: str = "") -> Column:
    """The text in a fence longer than any run of backticks in it, three at least."""
    runs = F.transform(F.regexp_extract_all(c, F.lit("`+"), F.lit(0)), lambda r: F.length(r) + 1)
    size = F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(3)))
    fence = F.repeat(F.lit("`"), size)
    return F.concat(fence, F.lit(f"{language}\n"), c, F.lit("\n"), fence)


def markdown_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[markdown_escape(c) for c in cells]), F.lit(" |"))


def is_html(c: Column, tags: str = BLOCK_TAGS, bare_doctype: bool = False) -> Column:
    """Whether a text starts with one of the tags, a doctype before it allowed.  With ``bare_doctype`` a
    doctype alone is enough."""
    if bare_doctype:
        return c.rlike(rf"(?i)^\s*(?:<!doctype|<(?:{tags})(?:\s|>))")
    return c.rlike(rf"(?i)^\s*(?:<!doctype\s+html[^>]*>\s*)?<(?:{tags})(?:\s|>)")


def heading_level(text: Column, bold: Column) -> Column:
    """1 for a bold numbered heading, 2 for a lettered one, else null."""
    return F.when(F.coalesce(bold, F.lit(False)) & text.rlike(TOP_HEADING), 1).when(text.rlike(SUB_HEADING), 2)


def heading_parts(text: Column, level: Column) -> Column:
    """struct<marker, title, lead> of a heading of a known level."""
    part = lambda n: F.when(level == 1, F.regexp_extract(text, TOP_HEADING, n) if n < 3 else F.lit("")).when(level == 2, F.regexp_extract(text, SUB_HEADING, n))
    return F.struct(part(1).alias("marker"), strip(part(2)).alias("title"), F.nullif(strip(part(3)), F.lit("")).alias("lead"))


def list_item(text: Column) -> Column:
    """struct<kind, marker, text> of a list item, null for other texts; the first pattern that matches."""
    found = F.lit(None)
    for kind, pattern in (("bullet", BULLET_ITEM), ("ordered", CIRCLED_ITEM), ("ordered", NUMBERED_ITEM)):
        item = F.struct(F.lit(kind).alias("kind"), F.regexp_extract(text, pattern, 1).alias("marker"), F.regexp_extract(text, pattern, 2).alias("text"))
        found = F.when(text.rlike(pattern), item).otherwise(found)
    return found


def data_uri_problem(mimetype: Column, uri: Column) -> Column:
    """What is wrong with an embedded image, null if nothing is."""
    said = F.regexp_extract(uri, r"^data:(image/[A-Za-z0-9.+-]+);base64,", 1)
    body = F.substring_index(uri, ",", -1)
    return (
        F.when(mimetype.isNull() | ~mimetype.startswith("image/"), "not an image type")
        .when(uri.isNull() | (uri == ""), "no uri")
        .when(said == "", "not an image data uri")
        .when(F.lower(said) != F.lower(mimetype), "types differ")
        .when((~body.rlike(r"^[A-Za-z0-9+/]*={0,2}$") | (F.length(body) % 4 != 0) | F.try_to_binary(body, F.lit("base64")).isNull()), "bad base64")
    )


def ocr_languages(c: Column) -> Column:
    """Languages of an OCR setting such as ``kor+eng``, order-free."""
    return F.array_sort(F.array_distinct(F.split(c, r"\+")))
