"""Visible text of HTML pages, laid out as a text browser would.

A tree builder reads tags, closes what the markup leaves open (paragraphs,
list items, table parts, options) and ignores end tags without a start.  The
renderer walks the tree without recursion: hidden elements are skipped, white
space collapses outside ``pre``, blocks start on lines of their own with blank
lines where browsers leave a margin, list items carry bullets or numbers and
indentation, and table cells are padded to columns.

Pages are independent rows: one scan, no shuffle, one page in memory at a time.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
HIDDEN = frozenset(
    "head script style template noscript iframe noembed noframes title meta link base datalist "
    "audio video canvas object svg math param source track select textarea".split()
)
PARAGRAPH_ENDS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dir dl blockquote figure pre table hr fieldset".split())
BLOCK = PARAGRAPH_ENDS | frozenset("html body li dt dd tr caption option legend optgroup".split())
# a start tag of the key ends an open element of the values, unless one of the barriers is in between
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "tr": (("tr", "td", "th", "caption", "colgroup"), ("table",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "thead": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "body": (("head",), ()),
}
PARTS = frozenset("td th tr thead tbody tfoot caption".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|[^<]+|<", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_NOT_SHOWN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)
MAX_SPAN = 1000
MAX_COLUMN = 120
"""Cells wider than this keep their whole text but do not widen their column."""


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def parse(html: str) -> Node:
    """Tree of a page; text is kept as strings, character references resolved."""
    root = Node("#root", {})
    stack = [root]
    at, end = 0, len(html)
    while at < end:
        token = _TOKEN.match(html, at)
        at = token.end()
        tag = token.group(2)
        if tag is None:
            text = token.group()
            if not text.startswith(("<!", "<?")):
                stack[-1].children.append(unescape(text) if "&" in text else text)
            continue
        tag = tag.lower()
        if token.group(1):
            _close(stack, tag)
            continue
        attrs = {}
        if token.group(3).strip():
            for m in _ATTRIBUTE.finditer(token.group(3)):
                value = next((g for g in m.groups()[1:] if g is not None), "")
                attrs.setdefault(m.group(1).lower(), unescape(value))
        _imply(stack, tag)
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I).search(html, at)
            node.children.append(html[at : close.start()])
            at = max(at, close.end())
            continue
        stack.append(node)
    return root


def _close(stack: list[Node], tag: str) -> None:
    for depth in range(len(stack) - 1, 0, -1):
        if stack[depth].tag == tag:
            del stack[depth:]
            return
        if stack[depth].tag == "table" or stack[depth].tag in ("td", "th", "caption") and tag not in PARTS | {"table"}:
            return


def _imply(stack: list[Node], tag: str) -> None:
    if tag in PARAGRAPH_ENDS:
        _end(stack, ("p",), ("td", "th", "caption", "button", "table"))
    if tag in IMPLIED:
        _end(stack, *IMPLIED[tag])


def _end(stack: list[Node], ends: tuple[str, ...], barriers: tuple[str, ...]) -> None:
    """Close the outermost open element of ``ends`` above the nearest barrier."""
    cut = None
    for depth in range(len(stack) - 1, 0, -1):
        if stack[depth].tag in barriers:
            break
        if stack[depth].tag in ends:
            cut = depth
            if len(ends) == 1:
                break
    if cut is not None:
        del stack[cut:]


def hidden(node: Node) -> bool:
    attrs = node.attrs
    if node.tag in HIDDEN or "hidden" in attrs or node.tag == "dialog" and "open" not in attrs:
        return True
    return "style" in attrs and bool(_NOT_SHOWN.search(attrs["style"]))


def width(text: str) -> int:
    """Columns that a line takes: two for wide characters, none for combining ones."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Page:
    """Lines of one block container (the page, or a table cell)."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = False  # white space waits for the next word
        self.gap = 0  # 1: a line break is due, 2: a blank line
        self.indents: list[str] = []
        self.mark = ""  # list mark of the next line

    def words(self, text: str) -> None:
        inner = _SPACE.sub(" ", text)
        if inner == " " or not inner:
            self.space = self.space or bool(inner)
            return
        if inner[0] == " ":
            self.space, inner = True, inner[1:]
        tail = inner[-1] == " "
        if tail:
            inner = inner[:-1]
        self._start()
        self.parts.append((" " if self.space and self.parts else "") + inner)
        self.space = tail

    def _start(self) -> None:
        if not self.parts and self.gap:
            if self.gap == 2 and self.lines and self.lines[-1]:
                self.lines.append("")
            self.gap = 0

    def line(self, text: str) -> None:
        """A line as it is, in the current indentation."""
        self._start()
        self.parts = [text]
        self.flush()

    def flush(self) -> None:
        if self.parts:
            indent = "".join(self.indents)
            if self.mark:
                indent = indent[: max(0, len(indent) - len(self.mark))] + self.mark
                self.mark = ""
            self.lines.append((indent + "".join(self.parts)).rstrip(" "))
            self.parts = []
        self.space = False

    def newline(self) -> None:
        if self.parts:
            self.flush()
        else:
            self._start()
            if self.lines:
                self.lines.append("")

    def block(self, gap: int) -> None:
        self.flush()
        self.gap = max(self.gap, gap)

    def text(self) -> str:
        self.flush()
        lines = self.lines
        while lines and not lines[-1]:
            lines.pop()
        start = next((i for i, line in enumerate(lines) if line), 0)
        return "\n".join(lines[start:])


def _table(rows: list[list[tuple[int, str]]]) -> list[str]:
    """Rows of (span, text) cells as lines; columns are as wide as their widest single cell, two blanks apart."""
    widths: list[int] = []
    wide = []
    for row in rows:
        at = 0
        for span, text in row:
            need = max(map(width, text.split("\n")), default=0)
            widths.extend([0] * (at + span - len(widths)))
            if span == 1:
                widths[at] = max(widths[at], min(need, MAX_COLUMN))
            else:
                wide.append((at, span, min(need, MAX_COLUMN)))
            at += span
    for at, span, need in wide:
        short = need - sum(widths[at : at + span]) - 2 * (span - 1)
        if short > 0:
            widths[at + span - 1] += short
    out = []
    for row in rows:
        cells = [(span, text.split("\n")) for span, text in row]
        for i in range(max((len(lines) for _, lines in cells), default=0)):
            line, at, due = [], 0, 0
            for span, lines in cells:
                text = lines[i] if i < len(lines) else ""
                line.append(" " * due + text)
                due = max(0, sum(widths[at : at + span]) + 2 * (span - 1) - width(text)) + 2
                at += span
            out.append("".join(line).rstrip(" "))
    return out


def render(root: Node) -> str:
    """All visible text of a tree."""
    page = Page()
    pages, tables, lists, pre = [page], [], [], 0
    todo: list[tuple] = [(root, False)]
    while todo:
        node, leaving = todo.pop()
        page = pages[-1]
        if isinstance(node, str):
            if pre:
                first, *rest = node.replace("\r\n", "\n").split("\n")
                for i, text in enumerate([first, *rest]):
                    if i:
                        page.newline()
                    if text:
                        page._start()
                        page.parts.append(text.expandtabs(8))
            elif tables and tables[-1]["cell"] is None and pages[-1] is tables[-1]["page"]:
                if node.strip(" \t\n\r\f"):
                    page.words(node)
            else:
                page.words(node)
            continue
        tag = node.tag
        if leaving:
            if tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
                page.block(2 if not lists else 1)
                continue
            if tag in ("li", "blockquote", "dd"):
                page.flush()
                if tag == "li" and page.mark:
                    page.line("")
                page.indents.pop()
                page.block(2 if tag == "blockquote" else 1)
            elif tag in ("td", "th", "caption") and tables and tables[-1]["cell"] is node:
                own = pages.pop()
                table = tables[-1]
                table["cell"] = None
                if tag == "caption":
                    table["caption"] = own.text()
                else:
                    if not table["rows"]:
                        table["rows"].append([])
                    table["rows"][-1].append((_span(node), own.text()))
            elif tag == "table":
                table = tables.pop()
                for line in table["caption"].split("\n") if table["caption"] else []:
                    page.line(line)
                    page.block(1)
                for line in _table([r for r in table["rows"] if any(t for _, t in r)]):
                    page.line(line)
                    page.block(1)
                page.block(2)
            elif tag == "pre":
                page.flush()
                pre -= 1
                page.block(2)
            elif tag in BLOCK:
                page.block(2 if tag in MARGIN else 1)
            continue

        if hidden(node):
            continue
        children = node.children
        if tag == "br":
            page.newline()
            continue
        if tag == "hr":
            page.block(2)
            continue
        if tag == "img":
            if node.attrs.get("alt", "").strip():
                page.words(node.attrs["alt"])
            continue
        if tag == "wbr" or tag in VOID:
            continue
        if tag == "details" and "open" not in node.attrs:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
        if tag in ("ul", "ol", "menu", "dir"):
            page.block(1 if lists else 2)
            start = node.attrs.get("start", "")
            count = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
            lists.append([tag == "ol", count])
        elif tag == "li":
            page.block(1)
            mark = "- "
            if lists and lists[-1][0]:
                mark = f"{lists[-1][1]}. "
                lists[-1][1] += 1
            page.indents.append(" " * len(mark))
            page.mark = mark
        elif tag == "blockquote":
            page.block(2)
            page.indents.append("  ")
        elif tag == "dd":
            page.block(1)
            page.indents.append("  ")
        elif tag == "table":
            page.block(2)
            tables.append({"rows": [], "caption": "", "cell": None, "page": page})
        elif tag == "tr" and tables and tables[-1]["cell"] is None:
            tables[-1]["rows"].append([])
        elif tag in ("td", "th", "caption") and tables and tables[-1]["cell"] is None:
            tables[-1]["cell"] = node
            pages.append(Page())
        elif tag == "pre":
            page.block(2)
            pre += 1
            if children and isinstance(children[0], str):
                children = [children[0].removeprefix("\r").removeprefix("\n"), *children[1:]]
        elif tag in BLOCK:
            page.block(2 if tag in MARGIN else 1)
        todo.append((node, True))
        todo.extend((c, False) for c in reversed(children))
    return pages[0].text()


def _span(node: Node) -> int:
    span = node.attrs.get("colspan", "1")
    return min(MAX_SPAN, int(span)) if re.fullmatch(r"[1-9]\d{0,8}", span) else 1


def visible_text(html: str | None) -> str | None:
    """Laid-out text of a page; null for null, empty where nothing is visible."""
    return None if html is None else render(parse(html))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, text) of every row.

    A null page has a null text, an empty one an empty text; broken markup is
    read as far as it goes.  Repeated rows and null ids come out as they go
    in; an empty table gives an empty table; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [visible_text(h.as_py()) for h in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["page_id", "text"])

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(
        run, "page_id bigint, text string"
    )
