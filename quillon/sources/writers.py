"""Results as files: JSON lines by Spark's committer, small reports by the driver."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import clean


def json_safe(value):
    """Numbers that JSON lacks become null."""
    return clean(value)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A JSON line for each row; the commit is Spark's, so readers see all or nothing.  NaN and infinities become null."""
    finite = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c)).alias(c)
    df.select(*[finite(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def write_file(path: str, value, refuse: str | None = None) -> None:
    """One value, pretty-printed, whole or not at all; never over the file that it was made of."""
    if refuse is not None and os.path.abspath(path) == os.path.abspath(refuse):
        raise ValueError("the output is the source")
    folder = os.path.dirname(os.path.abspath(path))
    fd, name = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(value if isinstance(value, str) else json.dumps(json_safe(value), ensure_ascii=False, indent=2) + "\n")
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise


MOST_REPORT_ROWS = 10_000


def report(title: str, tables: dict[str, DataFrame]) -> dict[str, str]:
    """{"report.md": ..., "index.html": ..., "analysis.json": ...} of small result tables; raises at tables of more than MOST_REPORT_ROWS rows."""
    from html import escape

    special = frozenset("&<>\\`*_{}[]()#+-.!|~")
    plain = lambda x: "".join(f"&#{ord(c)};" if c in special else " " if c in "\r\n" else c for c in str(x))
    md, html, data = [f"# {plain(title)}"], [f"<!doctype html><meta charset=\"utf-8\"><title>{escape(title)}</title><h1>{escape(title)}</h1>"], {"schema_version": 4, "tables": {}}
    for name, df in tables.items():
        rows = df.limit(MOST_REPORT_ROWS + 1).collect()
        if len(rows) > MOST_REPORT_ROWS:
            raise ValueError(f"{name} is too long for a report")
        cells = [[str(x) if x is not None else "" for x in r] for r in rows]
        md += [f"## {plain(name)}", "\n".join("| " + " | ".join(r) + " |" for r in ([plain(c) for c in df.columns], ["---"] * len(df.columns), *([plain(x) for x in r] for r in cells)))]
        line = lambda tag, r: "<tr>" + "".join(f"<{tag}>{escape(x)}</{tag}>" for x in r) + "</tr>"
        html.append(f"<h2>{escape(name)}</h2><table>{line('th', df.columns)}{''.join(line('td', r) for r in cells)}</table>")
        data["tables"][name] = [r.asDict(recursive=True) for r in rows]
    return {"report.md": "\n\n".join(md) + "\n", "index.html": "\n".join(html) + "\n", "analysis.json": json.dumps(json_safe(json.loads(json.dumps(data, default=str))), ensure_ascii=False, indent=2)}


def standalone(html: str) -> str:
    """Without links to other files: their text stays."""
    import re

    return re.sub(r"<a\s+[^>]*href=\"(?!#)[^\"]*\"[^>]*>(.*?)</a>", r"\1", html, flags=re.S)
