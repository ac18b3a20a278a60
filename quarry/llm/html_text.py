"""HTML extraction: a page's visible text, laid out.

A page becomes a tree, with the end tags that HTML lets authors omit put in, and the
tree becomes lines: blocks are set apart, list items have bullets or numbers and are
indented by depth, the cells of a table are padded to common column widths,
preformatted text keeps its blanks, and everything else is collapsed as a browser
would.  Invisible parts are left out: scripts, styles, heads, templates, comments,
elements with ``hidden`` or a style of display:none, and the metadata and definitions of
inline SVG and MathML, whose text shows otherwise.  Visibility is inherited: what an element with
visibility:hidden holds is left out, but for descendants with visibility:visible.

Each page is rendered by itself in its task; nothing is shuffled.  Time, tree and text
grow in proportion to the page (with the depth of nested tables: each level lays out its cells again), and no step recurses.
For that, indentation ends at 200 columns, cells are padded up to 200, and a cell spans up to 100 columns or rows.

Defined cases: null or empty pages give empty text.  Unclosed, stray and misnested tags
are tolerated, and a page without tags is one block of text.  Where a tag or a quote within one is never closed, tags end
at the next > from there on, and what no > follows is text.  Repeated rows are rendered as often
as they come.  Null page_ids are kept.  Other columns are not read.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .words import text_slices

# Element names and rules of the HTML standard.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "noembed", "noframes", "xmp"}
UNSEEN = {"head", "script", "style", "title", "noscript", "template", "iframe", "noembed", "noframes", "datalist", "object", "audio", "video", "canvas"}
#: Not shown inside svg and math.
FOREIGN_UNSEEN = {"annotation", "annotation-xml", "desc", "defs", "metadata", "symbol", "clippath", "mask", "marker", "pattern"}
TIGHT = {"div", "li", "dt", "dd", "tr", "option", "legend", "summary", "figcaption", "caption", "address", "center", "optgroup"}
#: Blocks inside svg and math.
FOREIGN_TIGHT = {"text", "foreignobject", "mtr"}
LOOSE = {
    "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "table", "pre", "blockquote", "section", "article", "header", "footer",
    "nav", "aside", "main", "form", "fieldset", "figure", "details", "hr", "body", "html", "menu", "dir", "xmp",
}
CLOSES_P = (LOOSE - {"body", "html"}) | {"div", "li", "dt", "dd", "address", "center"}
#: What a start tag ends, up to which elements.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "thead": ({"tbody", "caption"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
SCOPE = {"table", "td", "th", "caption", "html", "object", "button", "template"}

_OPENS = re.compile(r"<(!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_STOPS = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_HIDING = re.compile(r"display\s*:\s*none")
_VISIBILITY = re.compile(r"(?<![-\w])visibility\s*:\s*(hidden|collapse|visible|initial)")
_BLANKS = re.compile(r"[ \t\n\r\f]+")


#: Bounds of the layout, so that a hostile page's text stays in proportion to the page: columns of indentation, of padding, and of a span.
MOST_INDENT, MOST_PADDING, MOST_SPAN = 200, 200, 100


class Node:
    __slots__ = ("tag", "attributes", "children", "foreign")

    def __init__(self, tag: str, attributes: str = "", parent: Node | None = None):
        self.tag, self.attributes, self.children = tag, attributes, []
        #: whether the element is svg or math or lies in one
        self.foreign = tag in ("svg", "math") or (tag != "foreignobject" and parent is not None and parent.foreign)

    def attribute(self, name: str) -> str | None:
        for m in _ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() == name:
                return html.unescape(m[2] or m[3] or m[4] or "")
        return None

    def hidden(self) -> bool:
        if self.tag in UNSEEN or (self.tag in FOREIGN_UNSEEN and self.foreign):
            return True
        a = self.attributes.lower()
        if "hidden" in a or "none" in a:
            if self.attribute("hidden") is not None or bool(_HIDING.search((self.attribute("style") or "").lower())) or (self.tag == "input" and self.attribute("type") == "hidden"):
                return True
            return self.attribute("display") == "none" and self.foreign
        return False

    def visible(self, inherited: bool) -> bool:
        if self.tag == "mphantom":
            return False
        if "visibility" in self.attributes.lower():
            found = _VISIBILITY.findall((self.attribute("style") or "").lower())
            if not found and self.attribute("visibility") and self.foreign:
                found = [v for v in [self.attribute("visibility").lower()] if v in ("hidden", "collapse", "visible")]
            return found[-1] in ("visible", "initial") if found else inherited
        return inherited


class _Open:
    """The open elements from the root on, and for each tag the depths at which it is open."""

    def __init__(self, root: Node):
        self.path = [root]
        self.depths: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.depths.setdefault(node.tag, []).append(len(self.path))
        self.path.append(node)

    def close(self, names: set[str], until: set[str]) -> None:
        """Ends the outermost element of ``names`` inside the innermost one of ``until``."""
        edge = max((d[-1] for t in until if (d := self.depths.get(t))), default=0)
        inside = [d[i] for t in names if (d := self.depths.get(t)) and (i := bisect_right(d, edge)) < len(d)]
        if inside:
            for _ in range(len(self.path) - min(inside)):
                self.depths[self.path.pop().tag].pop()


class _Tags:
    """Finds the ends of tags.  Where a quote or a tag is never closed, quotes hide nothing from there on, so each page is read a few times at most."""

    def __init__(self, page: str):
        self.page, self.quotes = page, True

    def end(self, at: int) -> int:
        """The place of the > that ends the tag, or -1."""
        place = at
        while self.quotes:
            m = _STOPS.search(self.page, place)
            if m and m[0] == ">":
                return m.start()
            place = self.page.find(m[0], m.end()) + 1 if m else 0
            self.quotes = place > 0
        return self.page.find(">", at)


def parse(page: str) -> Node:
    """The page's tree; text is kept in the children as strings."""
    root = Node("#root")
    open_, tags = _Open(root), _Tags(page)
    at = begin = 0  # text that waits begins at ``begin``
    while m := _OPENS.search(page, at):
        if m[1] == "!--":
            stop = page.find("-->", m.end())
            stop = len(page) if stop < 0 else stop + 3
        elif m[3] is None:
            stop = page.find(">", m.end()) + 1
        else:
            stop = tags.end(m.end()) + 1
        if not stop:  # no tag ends from here on
            break
        if m.start() > begin:
            open_.path[-1].children.append(html.unescape(page[begin : m.start()]))
        at = begin = stop
        if m[3] is None:
            continue
        tag, attributes = m[3].lower(), page[m.end() : stop - 1]
        if m[2]:
            if tag == "br":
                open_.path[-1].children.append(Node("br", "", open_.path[-1]))
            elif tag not in VOID:
                open_.close({tag}, set() if tag in SCOPE else SCOPE - {tag})
            continue
        if tag in ENDS:
            open_.close(*ENDS[tag])
        if tag in CLOSES_P:
            open_.close({"p"}, SCOPE)
        node = Node(tag, attributes, open_.path[-1])
        open_.path[-1].children.append(node)
        if tag in RAW and not (attributes.endswith("/") and node.foreign):
            end = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
            body = page[at : end.start() if end else len(page)]
            at = begin = (page.find(">", end.end()) + 1 or len(page)) if end else len(page)
            if tag not in UNSEEN:
                node.children.append(html.unescape(body) if tag == "textarea" else body)
        elif tag not in VOID and not (attributes.endswith("/") and node.foreign):
            open_.push(node)  # HTML has no self-closing elements, SVG and MathML have
    if begin < len(page):
        open_.path[-1].children.append(html.unescape(page[begin:]))
    return root


class Lines:
    """Lines in the making: blocks ask for line breaks or blank lines, text fills the current line."""

    def __init__(self):
        self.done: list[str] = []
        self.parts: list[str] = []  # of the current line
        self.filled = False  # whether it holds more than blanks
        self.gap = 0  # 1: a new line is due, 2: a blank line first
        self.mark = ""

    def text(self, s: str, pre: bool, indent: int) -> None:
        if pre:
            first, *rest = s.split("\n")
            self.add(first, indent)
            for r in rest:
                self.flush()
                self.put(" " * indent + r)
            return
        s = _BLANKS.sub(" ", s)
        if self.gap or not self.filled or self.parts[-1].endswith(" "):
            s = s.lstrip(" ")
        if s:
            self.add(s, indent)

    def put(self, s: str) -> None:
        if s:
            self.parts.append(s)
            self.filled = self.filled or not s.isspace()

    def add(self, s: str, indent: int) -> None:
        if self.gap:
            self.flush()
            if self.gap == 2 and self.done and self.done[-1]:
                self.done.append("")
            self.gap = 0
        if not self.parts:
            self.put(" " * max(0, indent - len(self.mark)) + self.mark)
            self.mark = ""
        self.put(s)

    def flush(self) -> None:
        if self.filled:
            self.done.append("".join(self.parts).rstrip())
        elif self.done and not self.parts and self.gap == 0:
            self.done.append("")
        self.parts, self.filled = [], False

    def need(self, gap: int) -> None:
        if self.done or self.filled:
            if self.filled:
                self.flush()
            self.parts = []
            self.gap = max(self.gap, gap)

    def finish(self) -> str:
        if self.filled:
            self.done.append("".join(self.parts).rstrip())
        while self.done and not self.done[-1]:
            self.done.pop()
        return "\n".join(self.done)


def aligned(rows: list[list[tuple[str, int, int]]]) -> str:
    """Rows of cells (text, columns, rows) with columns of common widths; a cell of several lines takes several lines.

    A cell that spans columns or rows stands in its first one and leaves the others empty.
    """
    grid: list[list[list[str]]] = []
    taken: dict[int, int] = {}  # by column: the last row of the cell that reaches down into it
    for k, row in enumerate(rows):
        line: list[list[str]] = []
        for text, wide, high in row:
            while taken.get(len(line), -1) >= k:
                line.append([""])
            for i in range(wide):
                if high > 1:
                    taken[len(line)] = k + high - 1
                line.append([""] if i else text.split("\n"))
        grid.append(line)
    columns = max((len(r) for r in grid), default=0)
    grid = [r + [[""]] * min(columns - len(r), MOST_SPAN) for r in grid]
    widths = [0] * columns
    for r in grid:
        for i, c in enumerate(r):
            widths[i] = max(widths[i], *map(len, c))
    widths = [min(w, MOST_PADDING) for w in widths]
    out = []
    for r in grid:
        for k in range(max((len(c) for c in r), default=0)):
            out.append(" | ".join((c[k] if k < len(c) else "").ljust(w) for c, w in zip(r, widths)).rstrip(" "))
    return "\n".join(out)


def _span(node: Node, name: str) -> int:
    value = (node.attribute(name) or "").strip()
    return min(max(int(value), 1), MOST_SPAN) if value.isascii() and value.isdigit() and len(value) < 9 else 1


def render(root: Node) -> str:
    """The tree's visible text, by an explicit walk: frames hold the lines of the page, of cells and of tables."""
    lines, frames, rows_of = Lines(), [], []
    stack: list[tuple] = [("in", root, 0, False, True)]
    counters: list[int | None] = []
    while stack:
        what, node, indent, pre, seen = stack.pop()
        if what == "in":
            if isinstance(node, str):
                if seen:
                    lines.text(node, pre, indent)
                continue
            if node.hidden():
                continue
            tag, seen = node.tag, node.visible(seen)
            if tag == "br":
                if lines.filled:
                    lines.need(1)
                else:
                    lines.need(2)
                continue
            if tag == "img":
                if seen and (alt := node.attribute("alt")):
                    lines.text(alt, False, indent)
                continue
            in_list = indent
            if tag == "mtd" and seen and node.foreign:
                lines.text(" ", False, indent)
            if tag in LOOSE:
                lines.need(1 if tag in ("ul", "ol", "menu", "dir") and counters else 2)
            elif tag in TIGHT or (tag in FOREIGN_TIGHT and node.foreign):
                lines.need(1)
            if tag in ("ul", "ol", "menu", "dir"):
                start = node.attribute("start") if tag == "ol" else None
                counters.append(int(start) - 1 if start and start.isascii() and start.isdigit() and len(start) < 10 else 0 if tag == "ol" else None)
            elif tag == "li":
                if counters and counters[-1] is not None:
                    counters[-1] += 1
                mark = f"{counters[-1]}. " if counters and counters[-1] is not None else "- "
                lines.mark = mark if seen else ""
                in_list = indent + len(mark)
            elif tag in ("blockquote", "dd"):
                in_list = indent + 2
            elif tag == "table":
                frames.append(lines)
                rows_of.append([])
                lines = Lines()
            elif tag == "tr" and rows_of:
                rows_of[-1].append([])
            elif tag in ("td", "th") and rows_of:
                frames.append(lines)
                lines = Lines()
                in_list = 0
            in_list = min(in_list, MOST_INDENT)
            stack.append(("out", node, indent, pre, seen))
            inner = pre or tag in ("pre", "xmp", "textarea")
            stack.extend(("in", child, in_list, inner, seen) for child in reversed(node.children))
            continue
        tag = node.tag
        if tag in ("ul", "ol", "menu", "dir") and counters:
            counters.pop()
            lines.need(1 if counters else 2)
        elif tag in ("td", "th") and rows_of:
            text, lines = lines.finish(), frames.pop()
            if not rows_of[-1]:
                rows_of[-1].append([])
            rows_of[-1][-1].append((text, _span(node, "colspan"), _span(node, "rowspan")))
        elif tag == "table":
            around, lines = lines.finish(), frames.pop()  # captions, and text that stands outside cells
            body = aligned([r for r in rows_of.pop() if r])
            for part in (around, body):
                if part:
                    lines.need(2)
                    lines.text(part, True, indent)
            lines.need(2)
        elif tag in LOOSE:
            lines.need(2)
        elif tag == "tr" and rows_of and not seen and rows_of[-1] and not any(c[0] for c in rows_of[-1][-1]):
            rows_of[-1].pop()  # nothing in it shows
        elif tag in TIGHT or (tag in FOREIGN_TIGHT and node.foreign):
            lines.need(1)
            lines.mark = "" if tag == "li" else lines.mark
    return lines.finish()


def visible_text(page: str | None) -> str:
    return render(parse(page)) if page else ""


def extract_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """One row per page: page_id and text."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([visible_text(t) for t in texts], pa.string())], names=["page_id", "text"])

    return pages.select("page_id", column).mapInArrow(extract, "page_id long, text string")
