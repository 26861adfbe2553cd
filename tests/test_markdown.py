"""Blocks of Markdown and the lines that they stand on."""

import pytest

from quillon.operators import markup
from quillon.operators.markdown import markdown_blocks


def shown(source):
    return [(b["type"], b["begin"], b["end"], b.get("text")) for b in markdown_blocks(source.split("\n"))]


CASES = {
    # headings and rules
    "# a #\n##\n####### no": [("heading", 0, 1, "a"), ("heading", 1, 2, ""), ("paragraph", 2, 3, "####### no")],
    "two\nlines\n===\nx\n---\n---": [("heading", 0, 3, "two\nlines"), ("heading", 3, 5, "x")],
    # code
    "    a\n\n     b\n\nc\n    d": [("code", 0, 3, "a\n\n b\n"), ("paragraph", 4, 6, "c\nd")],
    "  ~~~x\n  a\n b\n   ~~~~\nc": [("code", 0, 4, "a\nb\n"), ("paragraph", 4, 5, "c")],
    "```\nopen": [("code", 0, 2, "open\n")],
    "``` a`b\nx": [("paragraph", 0, 2, "``` a`b\nx")],
    # quotes and lazy continuation
    "> a\nb\n> c\n\nd": [("quote", 0, 3, None), ("paragraph", 0, 3, "a\nb\nc"), ("paragraph", 4, 5, "d")],
    "> a\n---": [("quote", 0, 1, None), ("paragraph", 0, 1, "a")],
    "> ```\n> x\ny": [("quote", 0, 2, None), ("code", 0, 2, "x\n"), ("paragraph", 2, 3, "y")],
    "> > a\nb": [("quote", 0, 2, None), ("quote", 0, 2, None), ("paragraph", 0, 2, "a\nb")],
    ">\ta": [("quote", 0, 1, None), ("paragraph", 0, 1, "a")],
    ">\t\ta": [("quote", 0, 1, None), ("code", 0, 1, "  a\n")],
    # lists
    "- a\n\n  b\n- c\nd\n\ne": [("bullets", 0, 5, None), ("paragraph", 0, 1, "a"), ("paragraph", 2, 3, "b"), ("paragraph", 3, 5, "c\nd"), ("paragraph", 6, 7, "e")],
    "- a\n  - b\n    - c\n- d": [("bullets", 0, 4, None), ("paragraph", 0, 1, "a"), ("bullets", 1, 3, None), ("paragraph", 1, 2, "b"), ("bullets", 2, 3, None), ("paragraph", 2, 3, "c"), ("paragraph", 3, 4, "d")],
    "- a\n+ b": [("bullets", 0, 1, None), ("paragraph", 0, 1, "a"), ("bullets", 1, 2, None), ("paragraph", 1, 2, "b")],
    "x\n2. y\n1. z": [("paragraph", 0, 2, "x\n2. y"), ("numbers", 2, 3, None), ("paragraph", 2, 3, "z")],
    "-\n\n  a": [("bullets", 0, 1, None), ("paragraph", 2, 3, "a")],
    "-\n  a": [("bullets", 0, 2, None), ("paragraph", 1, 2, "a")],
    "1.     code\n\n   x": [("numbers", 0, 3, None), ("code", 0, 1, "code\n"), ("paragraph", 2, 3, "x")],
    "- a\n> b": [("bullets", 0, 1, None), ("paragraph", 0, 1, "a"), ("quote", 1, 2, None), ("paragraph", 1, 2, "b")],
    "- > a\n  b\nc": [("bullets", 0, 3, None), ("quote", 0, 3, None), ("paragraph", 0, 3, "a\nb\nc")],
    "-\ta\n\n\tb": [("bullets", 0, 3, None), ("paragraph", 0, 1, "a"), ("paragraph", 2, 3, "b")],
    "- ***\n- x": [("bullets", 0, 2, None), ("paragraph", 1, 2, "x")],
    # tables
    "t\n| a | b |\n|:-|-:|\n| 1 |\n\nx": [("paragraph", 0, 1, "t"), ("table", 1, 4, "a\nb\n1\n"), ("paragraph", 5, 6, "x")],
    "> a | b\n> :- | -\n> 1 | 2 | 3\n4 | 5": [("quote", 0, 3, None), ("table", 0, 3, "a\nb\n1\n2"), ("paragraph", 3, 4, "4 | 5")],
    # link definitions
    "[a]: /x 'title'\n[b]:\n  <y z>\ntext": [("definition", 0, 1, "[a]: /x 'title'"), ("definition", 1, 3, "[b]:\n<y z>"), ("paragraph", 3, 4, "text")],
    "[a]: /x\n\ny": [("definition", 0, 1, "[a]: /x"), ("paragraph", 2, 3, "y")],
    "x\n[a]: /x": [("paragraph", 0, 2, "x\n[a]: /x")],
    "[a]: /x bad title": [("paragraph", 0, 1, "[a]: /x bad title")],
    "> [a]: /x\n===": [("quote", 0, 2, None), ("definition", 0, 1, "[a]: /x"), ("paragraph", 1, 2, "===")],
    # HTML blocks
    "<div>\n*a*\n\n*b*": [("html", 0, 2, "<div>\n*a*"), ("paragraph", 3, 4, "*b*")],
    "<!-- a\n\nb -->\nc": [("html", 0, 3, "<!-- a\n\nb -->"), ("paragraph", 3, 4, "c")],
    "<script>\n\n# x\n</script> y\nz": [("html", 0, 4, "<script>\n\n# x\n</script> y"), ("paragraph", 4, 5, "z")],
    "<a href='x'>\n*b*\n\nc": [("html", 0, 2, "<a href='x'>\n*b*"), ("paragraph", 3, 4, "c")],
    "t\n<a>\n<p>": [("paragraph", 0, 2, "t\n<a>"), ("html", 2, 3, "<p>")],
    "> <div>\nx": [("quote", 0, 1, None), ("html", 0, 1, "<div>"), ("paragraph", 1, 2, "x")],
    "": [],
    "\n \n\t": [],
}


@pytest.mark.parametrize("source", CASES)
def test_blocks(source):
    assert shown(source) == CASES[source]


def test_depth_and_length():
    """Nothing recurses, and long texts take linear time."""
    deep = markdown_blocks([">" * 2000 + " x"])
    assert len(deep) == 2001 and deep[-1]["text"] == "x"
    assert len(markdown_blocks(["- a", "b", ""] * 20_000)) == 20_001


def test_signals_come_from_blocks():
    source = "> # in *a* quote\n\n1. **one**\n2.\n3. `**code**`\n\n| **a** | b |\n|---|---|\n| c | __d__ |\n\n    # code\n\n<div>\n# html\n</div>\n\nTwo\nlines\n=====\n"
    assert [x[:3] for x in markup.signals_of(source)] == [("heading", 1, 1), ("list", 3, None), ("formatting", 3, None), ("list", 5, None), ("formatting", 7, None), ("table", 8, 2), ("formatting", 9, None), ("heading", 17, 1)]
