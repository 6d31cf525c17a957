"""HTML extraction by layout-aware rendering.

A forgiving tree builder closes what HTML lets authors leave open, visibility rules take out
what a browser would not show, and a renderer lays out the rest: blocks on lines of their own,
paragraphs and headings between blank lines, list markers with indentation, preformatted text
as it is, table cells in aligned columns. All visible text of a page comes out.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Generator, Iterator
from dataclasses import dataclass, field
from html import unescape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anbar.llm.common import per_text, table

# --- fixed values of HTML ----------------------------------------------------
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style iframe noembed noframes xmp".split())
RAW_ESCAPED = {"textarea", "title"}
HIDDEN = set(
    "head script style template noscript iframe noembed noframes object audio video canvas "
    "datalist rp svg math title meta link base select".split()
)
PARAGRAPHS = set("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure fieldset hr".split())
BLOCKS = PARAGRAPHS | set(
    "html body div section article aside header footer nav main address form li dt dd figcaption "
    "details summary legend center dir menu search caption hgroup tr td th thead tbody tfoot".split()
)
#: A start tag of the key closes an open element of the value, unless a border stands between.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th", "caption", "colgroup"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"},
    "thead": {"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"},
    "tfoot": {"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"},
    "option": {"option"}, "optgroup": {"option", "optgroup"}, "body": {"head"},
}
BORDERS = {
    "li": {"ul", "ol", "menu", "dir", "table"}, "dt": {"dl", "table"}, "dd": {"dl", "table"},
    "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tbody": {"table"},
    "thead": {"table"}, "tfoot": {"table"}, "option": {"select"}, "optgroup": {"select"}, "body": set(),
}
CLOSES_P = (BLOCKS | {"hr"}) - set("html body li dt dd tr td th thead tbody tfoot caption summary legend".split())
IN_HEAD = set("base link meta title style script noscript template head".split())
#: An end tag does not reach past these.
WALLS = {"table", "td", "th", "caption"}
#: An end tag of these reaches past walls.
TABLE_TAGS = set("table tr tbody thead tfoot".split())
#: Nested lists and quotes are not set in further than this many columns.
MAX_INDENT = 320

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|"
    r"<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACES = re.compile(r"[ \t\n\r\f]+")
CONCEALED = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)


@dataclass(slots=True)
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), unescape(double or single or bare))
    return found


class _Builder:
    """The open elements, and the places of each tag among them, so no step walks the stack."""

    def __init__(self) -> None:
        self.root = Node("html")
        self.open = [self.root]
        self.at: dict[str, list[int]] = {"html": [0]}

    def text(self, text: str) -> None:
        if not text:
            return
        if self.open[-1].tag == "head" and not text.isspace():
            self._close_from(len(self.open) - 1)  # the body begins without its tag
        self.open[-1].children.append(text)

    def _close_from(self, i: int) -> None:
        while len(self.open) > max(i, 1):
            self.at[self.open.pop().tag].pop()

    def _last(self, tags: set[str]) -> int:
        """The place of the innermost open element of these tags, 0 if there is none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def start(self, tag: str, attrs: dict[str, str], empty: bool) -> Node | None:
        if tag in ("html", "body") and self.at.get(tag):
            self.open[self.at[tag][0]].attrs |= attrs
            return None
        if self.open[-1].tag == "head" and tag not in IN_HEAD:
            self._close_from(len(self.open) - 1)
        if tag in CLOSES_P:
            p = self._last({"p"})
            if p > self._last(WALLS | {"button"}):
                self._close_from(p)
        if tag in CLOSES:
            border = self._last(BORDERS[tag])
            reach = []
            for t in CLOSES[tag]:
                places = self.at.get(t, [])
                reach += places[(k := bisect_right(places, border)) : k + 1]
            if reach:
                self._close_from(min(reach))
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        if tag not in VOID and not empty:
            self.at.setdefault(tag, []).append(len(self.open))
            self.open.append(node)
        return node

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", {}, False)
            return
        i = self._last({tag})
        if i and (tag in TABLE_TAGS or i >= self._last(WALLS)):
            self._close_from(i)
        elif tag == "p":  # an end without a start is an empty paragraph
            self.start("p", {}, True)


def parse(html: str) -> Node:
    """The tree of a page; never fails."""
    builder, at = _Builder(), 0
    while True:
        m = TOKEN.search(html, at)
        if m is None:
            builder.text(html[at:])
            return builder.root
        if m.start() > at:
            builder.text(html[at : m.start()])
        at = m.end()
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            builder.end(tag)
            continue
        attrs = _attributes(m["attrs"]) if m["attrs"].strip(" /\n") else {}
        in_foreign = m["attrs"].endswith("/") and tag in ("svg", "math", "path")
        node = builder.start(tag, attrs, in_foreign)
        if tag in RAW or tag in RAW_ESCAPED:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
            stop, after = (close.start(), close.end()) if close else (len(html), len(html))
            if node is not None:
                node.children.append(html[at:stop])
                builder.end(tag)
            at = after


def visible(node: Node) -> bool:
    attrs = node.attrs
    if node.tag in HIDDEN or (attrs and "hidden" in attrs and attrs["hidden"] != "until-found"):
        return False
    if attrs and "style" in attrs and CONCEALED.search(attrs["style"]):
        return False
    if node.tag == "dialog" and "open" not in attrs:
        return False
    return not (node.tag == "input")


class _Flow:
    """Lines under construction: collapsed spaces, pending blank lines, pending markers."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.blank = False
        self.indent = 0
        self.marker = ""

    def inline(self, text: str) -> None:
        parts = SPACES.split(text)
        for i, part in enumerate(parts):
            if i and self.line:
                self.space = True
            if part:
                if self.space:
                    self.line.append(" ")
                    self.space = False
                self.line.append(part)

    def preformatted(self, text: str) -> None:
        first, *rest = text.replace("\r\n", "\n").split("\n")
        self.line.append(first)
        for part in rest:
            self.newline(True)
            self.line.append(part)

    def newline(self, keep_empty: bool = False) -> None:
        text = "".join(self.line).rstrip()
        self.line, self.space = [], False
        if text or keep_empty:
            self._put(text)

    def _put(self, text: str) -> None:
        if self.blank and self.lines and self.lines[-1]:
            self.lines.append("")
        self.blank = False
        lead = " " * self.indent
        if self.marker and text:
            lead = " " * (self.indent - len(self.marker)) + self.marker
            self.marker = ""
        self.lines.append((lead + text).rstrip())

    def block(self, paragraph: bool) -> None:
        self.newline()
        self.blank = self.blank or paragraph

    def whole_lines(self, lines: list[str]) -> None:
        self.newline()
        for line in lines:
            self._put(line)

    def done(self) -> list[str]:
        self.newline()
        lines = self.lines
        while lines and not lines[-1]:
            lines.pop()
        while lines and not lines[0]:
            lines.pop(0)
        return lines


def _whole(text: str | None, default: int) -> int:
    try:
        return int(text or "")
    except ValueError:
        return default


def _rows(node: Node) -> Iterator[Node]:
    for child in node.children:
        if isinstance(child, Node) and visible(child):
            if child.tag == "tr":
                yield child
            elif child.tag in ("thead", "tbody", "tfoot"):
                yield from _rows(child)


#: A renderer gives the renderers of its elements; ``_run`` holds them, so depth costs no recursion.
Steps = Generator["Steps", None, None]


def _run(step: Steps) -> None:
    waiting = [step]
    while waiting:
        inner = next(waiting[-1], None)
        if inner is None:
            waiting.pop()
        else:
            waiting.append(inner)


def _each(nodes: list[Node | str], flow: _Flow, pre: bool) -> Steps:
    for x in nodes:
        if isinstance(x, str):
            (flow.preformatted if pre else flow.inline)(unescape(x))
        elif visible(x):
            yield _render(x, flow, pre)


def _table(node: Node, flow: _Flow) -> Steps:
    for child in node.children:  # what stands outside of rows comes first
        if isinstance(child, str):
            flow.inline(unescape(child))
        elif child.tag not in ("tr", "thead", "tbody", "tfoot", "colgroup", "col"):
            yield from _each([child], flow, False)
    for part in node.children:
        if isinstance(part, Node) and part.tag in ("thead", "tbody", "tfoot") and visible(part):
            for child in part.children:
                if isinstance(child, str):
                    flow.inline(unescape(child))
                elif child.tag != "tr":
                    yield from _each([child], flow, False)
    grid: list[list[tuple[list[str], int]]] = []
    for row in _rows(node):
        cells: list[tuple[list[str], int]] = []
        for child in row.children:
            if isinstance(child, Node) and not visible(child):
                continue
            inner = _Flow()
            if isinstance(child, str):
                inner.inline(unescape(child))
            else:
                yield from _each(child.children if child.tag in ("td", "th") else [child], inner, False)
            lines = inner.done()
            if isinstance(child, Node) and child.tag in ("td", "th"):
                cells.append((lines, max(1, min(1000, _whole(child.attrs.get("colspan"), 1)))))
            elif lines:
                cells.append((lines, 1))
        grid.append(cells)
    widths: dict[int, int] = {}
    for cells in grid:
        at = 0
        for lines, span in cells:
            if span == 1:
                widths[at] = max(widths.get(at, 0), max(map(len, lines), default=0))
            at += span
    flow.block(True)
    for cells in grid:
        height = max((len(lines) for lines, _ in cells), default=0)
        out = [""] * height
        at, place = 0, 0
        for lines, span in cells:
            for i, line in enumerate(lines):
                out[i] = out[i].ljust(place) + line
            wide = sum(widths.get(at + k, 0) for k in range(span)) + 2 * (span - 1)
            place += max(wide, max(map(len, lines), default=0)) + 2
            at += span
        flow.whole_lines(out)
    flow.block(True)


def _list(node: Node, flow: _Flow) -> Steps:
    number = _whole(node.attrs.get("start"), 1)
    inner_list = flow.indent > 0
    flow.block(not inner_list)
    for child in node.children:
        if isinstance(child, Node) and child.tag == "li":
            if not visible(child):
                continue
            number = _whole(child.attrs.get("value"), number)
            marker = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            flow.newline()
            before, held = flow.indent, flow.marker
            flow.indent, flow.marker = min(before + len(marker), MAX_INDENT), marker
            yield from _each(child.children, flow, False)
            flow.newline()
            flow.indent = before
            flow.marker = held if held and flow.marker else ""
        else:
            yield from _each([child], flow, False)
    flow.block(not inner_list)


def _render(node: Node, flow: _Flow, pre: bool) -> Steps:
    """Lays out a visible element."""
    tag = node.tag
    if tag == "br":
        flow.newline(True)
    elif tag == "table":
        flow.block(True)
        yield from _table(node, flow)
    elif tag in ("ul", "ol", "menu", "dir"):
        yield from _list(node, flow)
    elif tag == "details" and "open" not in node.attrs:
        flow.block(False)
        yield from _each([x for x in node.children if isinstance(x, Node) and x.tag == "summary"], flow, pre)
        flow.block(False)
    elif tag in ("pre", "textarea", "xmp"):
        flow.block(True)
        first, rest = node.children[:1], node.children[1:]
        if first and isinstance(first[0], str):
            first = [first[0].removeprefix("\n")]
        yield from _each(first + rest, flow, True)
        flow.block(True)
    elif tag in BLOCKS:
        indent = flow.indent
        flow.block(tag in PARAGRAPHS)
        if tag in ("blockquote", "dd"):
            flow.indent = min(indent + 2, MAX_INDENT)
        yield from _each(node.children, flow, pre)
        flow.block(tag in PARAGRAPHS)
        flow.indent = indent
    else:
        yield from _each(node.children, flow, pre)


def render(html: str) -> str:
    """The visible text of a page, laid out."""
    flow = _Flow()
    _run(_each(parse(html).children, flow, False))
    return "\n".join(flow.done())


def extract(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per page: the key, ``text`` (null for null), ``n_words`` and ``n_lines``.

    Pages are rendered one at a time, whole; memory is bounded by a batch and a page. Broken
    markup, unclosed tags and any depth of nesting give text, never an error.
    """

    def rendered(texts: list[str | None]) -> Iterator[tuple]:
        for value in texts:
            text = None if value is None else render(value)
            yield text, len((text or "").split()), sum(1 for x in (text or "").split("\n") if x)

    return per_text(pages, key, html, "text string, n_words long, n_lines long", rendered)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract(table(spark, sf_dir, "pages"))
    return pages.withColumn("text_md5", F.md5("text"))
