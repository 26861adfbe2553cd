"""Blocks of Markdown, line by line.

Open containers (quotes, lists, items) are a stack.  Of each line, first those that go on take their marks off its front; then marks that open
something new are looked for in what is left; then the rest goes to the open leaf, to a paragraph in containers that the line does not
continue (lazily), or to a new leaf.  A block knows its lines in the source, whatever it stands in."""

from __future__ import annotations

import re

_FENCE = re.compile(r"(`{3,}(?=[^`]*$)|~{3,})")
_ATX = re.compile(r"(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r"(=+|-+)[ \t]*$")
_RULE = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_MARK = re.compile(r"([-+*]|\d{1,9}[.)])(?=[ \t]|$)")
_DELIMITER = re.compile(r"\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
#: [label]: target "title", as far as it goes on the joined lines of a paragraph.
_DEFINITION = re.compile(r"""\[(?=[^\]\\]*[^\s\]])(?:[^\[\]\\]|\\.){1,999}\]:[ \t]*\n?[ \t]*(?:<[^<>\n]*>|[^\s<]\S*)(?:(?:[ \t]+|[ \t]*\n[ \t]*)(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?[ \t]*(?:\n|$)""")
_DEFINITION_ALONE = re.compile(r"\[(?=[^\]\\]*[^\s\]])(?:[^\[\]\\]|\\.){1,999}\]:[ \t]*\n?[ \t]*(?:<[^<>\n]*>|[^\s<]\S*)[ \t]*(?:\n|$)")

#: Names of tags that open an HTML block up to a blank line.
BLOCK_TAGS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu"
    " menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul"
)
_ATTRIBUTE = r"""\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?"""
#: What opens an HTML block, and what ends it on its own or a later line; None for a blank line.
_HTML = [
    (re.compile(r"(?i)<(?:script|pre|style|textarea)(?:\s|>|$)"), re.compile(r"(?i)</(?:script|pre|style|textarea)>")),
    (re.compile("<!--"), re.compile("-->")),
    (re.compile(r"<\?"), re.compile(r"\?>")),
    (re.compile("<![A-Za-z]"), re.compile(">")),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf"(?i)</?(?:{'|'.join(BLOCK_TAGS.split())})(?:\s|/?>|$)"), None),
]
_ONE_TAG = re.compile(rf"(?:<[A-Za-z][A-Za-z0-9-]*(?:{_ATTRIBUTE})*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)\s*$")


def cells(line: str) -> list[str]:
    """Cells of a table row."""
    inner = line.strip()
    inner = inner[1:] if inner.startswith("|") else inner
    inner = inner[:-1] if inner.endswith("|") and not inner.endswith("\\|") else inner
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", inner)]


class _Line:
    """What is left of a line; leading tabs reach to the next column that is a multiple of four."""

    def __init__(self, text: str):
        self.text, self.column = text, 0
        self._measure()

    def _measure(self) -> None:
        column, n = self.column, 0
        for c in self.text:
            if c == " ":
                column += 1
            elif c == "\t":
                column += 4 - column % 4
            else:
                break
            n += 1
        self.indent, self.body = column - self.column, self.text[n:]
        self.blank = not self.body.strip()

    def skip(self, columns: int) -> None:
        """Takes that much indentation off, or less if there is less."""
        columns = min(columns, self.indent)
        self.text = " " * (self.indent - columns) + self.body
        self.column += columns
        self._measure()

    def mark(self, length: int) -> None:
        """Takes the indentation and a mark of some characters off."""
        self.column += self.indent + length
        self.text = self.body[length:]
        self._measure()


class _Parser:
    def __init__(self):
        self.out: list[dict] = []
        self.open: list[dict] = []  # containers
        self.leaf: dict | None = None

    # containers ------------------------------------------------------------------------------------

    def goes_on(self, box: dict, line: _Line, at: int) -> bool:
        if box["type"] == "quote":
            if line.indent > 3 or not line.body.startswith(">"):
                return False
            line.mark(1)
            line.skip(1)
            return True
        if box["type"] == "item":
            if line.blank:
                return box["filled"] or at == box["begin"]
            if line.indent < box["width"]:
                return False
            line.skip(box["width"])
        return True

    def close(self, depth: int) -> None:
        """Closes the leaf and the containers from ``depth`` on."""
        self.end_leaf()
        del self.open[depth:]

    def touch(self, at: int) -> None:
        """Open containers reach to this line."""
        for box in self.open:
            box["end"] = at + 1
            box["filled"] = True

    def add(self, **block) -> dict:
        self.out.append(block)
        return block

    def item(self, line: _Line, at: int, depth: int) -> bool:
        """Opens an item, and a list if it does not belong to the one at hand."""
        m = _MARK.match(line.body)
        if not m or line.indent > 3 or _RULE.match(line.body):
            return False
        rest = line.body[m.end() :]
        if self.leaf and self.leaf["type"] == "paragraph" and depth == len(self.open) and not (depth and self.open[-1]["type"] == "list"):
            if not rest.strip() or not (m[1] in "-+*" or m[1][:-1] == "1"):
                return False  # such an item does not break a paragraph
        self.close(depth)
        kind, indent = m[1][-1], line.indent
        if not (self.open and self.open[-1]["type"] == "list" and self.open[-1]["mark"] == kind):
            if self.open and self.open[-1]["type"] == "list":
                self.open.pop()
            shown = self.add(type="numbers" if kind in ".)" else "bullets", begin=at, end=at + 1, items=[])
            self.open.append({"type": "list", "mark": kind, "shown": shown, "end": at + 1, "filled": True})
        line.mark(m.end())
        pad = line.indent if 1 <= line.indent <= 4 and not line.blank else 1
        width = indent + m.end() + pad
        line.skip(pad)
        if not line.blank:
            self.open[-1]["shown"]["items"].append(at)
        self.open.append({"type": "item", "width": width, "begin": at, "end": at + 1, "filled": not line.blank})
        return True

    # leaves ----------------------------------------------------------------------------------------

    def in_list(self) -> bool:
        return any(box["type"] == "item" for box in self.open)

    def end_leaf(self) -> None:
        leaf, self.leaf = self.leaf, None
        if leaf is None:
            return
        if leaf["type"] == "code" and leaf.pop("indented", False):
            while leaf["lines"] and not leaf["lines"][-1].strip():
                leaf["lines"].pop()
            leaf["end"] = leaf["begin"] + len(leaf["lines"])
        if leaf["type"] == "paragraph":
            self.definitions(leaf)
        if leaf["type"] == "code":
            leaf["text"] = "".join(x + "\n" for x in leaf["lines"])
        elif leaf["type"] == "table":
            leaf["text"] = "\n".join(c for r in leaf["rows"] for c in r)
        elif leaf["type"] in ("paragraph", "html"):
            leaf["text"] = "\n".join(leaf["lines"])

    def definitions(self, leaf: dict) -> None:
        """Link definitions at a paragraph's start are no text; they become blocks of their own."""
        text, found = "\n".join(leaf["lines"]), []
        while m := _DEFINITION.match(text) or _DEFINITION_ALONE.match(text):
            found.append(m[0].rstrip("\n"))
            text = text[m.end() :]
        if not found:
            return
        where = self.out.index(leaf)
        for x in found:
            n = x.count("\n") + 1
            self.out.insert(where, {"type": "definition", "begin": leaf["begin"], "end": leaf["begin"] + n, "text": x})
            leaf["begin"], leaf["lines"], where = leaf["begin"] + n, leaf["lines"][n:], where + 1
        if not leaf["lines"]:
            self.out.remove(leaf)
            leaf["type"] = "gone"

    def html(self, line: _Line, paragraph: dict | None) -> tuple[re.Pattern | None] | None:
        """What ends the HTML block that the line opens, if it does; a single other tag does not break a paragraph."""
        for begin, end in _HTML:
            if begin.match(line.body):
                return (end,)
        return (None,) if paragraph is None and _ONE_TAG.match(line.body) else None

    def starts(self, line: _Line, at: int, depth: int) -> bool:
        """Opens a leaf that a mark at the front asks for."""
        whole = depth == len(self.open)
        paragraph = self.leaf if self.leaf and self.leaf["type"] == "paragraph" else None
        if m := _ATX.match(line.body):
            self.close(depth)
            self.add(type="heading", begin=at, end=at + 1, level=len(m[1]), text=(m[2] or "").strip())
        elif m := _FENCE.match(line.body):
            self.close(depth)
            close = re.compile(rf"{re.escape(m[1][0])}{{{len(m[1])},}}[ \t]*$")
            self.leaf = self.add(type="code", begin=at, end=at + 1, lines=[], close=close, indent=line.indent)
        elif html := self.html(line, paragraph):
            self.close(depth)
            self.leaf = self.add(type="html", begin=at, end=at + 1, lines=[line.text], close=html[0])
            if html[0] is not None and html[0].search(line.body):
                self.end_leaf()
        elif paragraph and whole and (m := _SETEXT.match(line.body)):
            self.end_leaf()
            if paragraph["type"] != "paragraph":  # all of it were definitions
                return False
            paragraph |= {"type": "heading", "end": at + 1, "level": 1 if m[1][0] == "=" else 2}
        elif _RULE.match(line.body):
            self.close(depth)
        else:
            return False
        return True

    def text(self, line: _Line, at: int, depth: int) -> None:
        """The rest of a line that opens nothing."""
        leaf, body = self.leaf, line.body.strip()
        if leaf and leaf["type"] == "paragraph":  # it goes on, if need be lazily
            head = leaf["lines"][-1]
            if depth == len(self.open) and "|" in head and _DELIMITER.match(body) and len(cells(head)) == len(cells(body)):
                leaf["lines"].pop()
                if leaf["lines"]:
                    leaf["end"] = at - 1
                else:
                    self.out.remove(leaf)
                    self.leaf = None
                self.end_leaf()
                self.leaf = self.add(type="table", begin=at - 1, end=at + 1, rows=[cells(head)])
            else:
                leaf["lines"].append(body)
                leaf["end"] = at + 1
        elif leaf and leaf["type"] == "table" and depth == len(self.open):
            n = len(leaf["rows"][0])
            leaf["rows"].append((cells(body) + [""] * n)[:n])
            leaf["end"] = at + 1
        else:
            self.close(depth)
            self.leaf = self.add(type="paragraph", begin=at, end=at + 1, lines=[body], in_list=self.in_list())

    # lines -----------------------------------------------------------------------------------------

    def at_list(self, depth: int) -> bool:
        """Whether the first container that a line does not continue is a list, which a new item of it would."""
        return depth < len(self.open) and self.open[depth]["type"] == "list"

    def feed(self, text: str, at: int) -> None:
        line, depth = _Line(text), 0
        while depth < len(self.open) and self.goes_on(self.open[depth], line, at):
            depth += 1
        if depth and self.open[depth - 1]["type"] == "list":  # a list goes on with its item, or with a new one
            depth -= 1
        leaf = self.leaf
        if depth == len(self.open) and leaf and leaf["type"] in ("code", "html"):
            if self.verbatim(line, at):
                return
        while True:
            if line.indent > 3:
                if not line.blank and not (self.leaf and self.leaf["type"] == "paragraph"):
                    self.close(depth)
                    line.skip(4)
                    self.leaf = self.add(type="code", begin=at, end=at + 1, lines=[line.text], indented=True)
                    self.touch(at)
                    return
                break
            if line.body.startswith(">"):
                self.close(depth)
                self.open.append({"type": "quote", "end": at + 1, "filled": True, "shown": self.add(type="quote", begin=at, end=at + 1)})
                line.mark(1)
                line.skip(1)
            elif self.item(line, at, depth + self.at_list(depth)):
                pass
            elif not line.blank and self.starts(line, at, depth):
                self.touch(at)
                return
            else:
                break
            depth = len(self.open)
        if line.blank:
            self.close(depth + self.at_list(depth))  # a list stays open behind its item
            for box in self.open:
                if box["type"] == "quote":
                    box["end"] = at + 1
        else:
            self.text(line, at, depth)
            self.touch(at)

    def verbatim(self, line: _Line, at: int) -> bool:
        """A line of open code or HTML; False if it is not one."""
        leaf = self.leaf
        if leaf.get("indented"):
            if line.indent < 4 and not line.blank:
                return False
            line.skip(4)
            leaf["lines"].append(line.text)
        elif leaf["type"] == "code":
            if line.indent <= 3 and leaf["close"].match(line.body):
                leaf["end"] = at + 1
                self.end_leaf()
            else:
                line.skip(leaf["indent"])
                leaf["lines"].append(line.text)
                leaf["end"] = at + 1
        elif leaf["close"] is None and line.blank:
            return False
        else:
            leaf["lines"].append(line.text)
            leaf["end"] = at + 1
            if leaf["close"] is not None and leaf["close"].search(line.text):
                self.end_leaf()
        if not line.blank:
            self.touch(at)
        return True

    def show(self) -> None:
        for box in self.open:
            if "shown" in box:
                box["shown"]["end"] = box["end"]


def markdown_blocks(lines: list[str]) -> list[dict]:
    """Blocks in the order of the source: dicts with type (quote, bullets, numbers, heading, paragraph, code, table, html or definition), begin
    and end line, and text, level, rows or, of a list, the lines of its items that are not empty.

    Containers come before what they hold; rules are left out."""
    parser = _Parser()
    for at, line in enumerate(lines):
        parser.feed(line, at)
        parser.show()
    parser.close(0)
    return parser.out
