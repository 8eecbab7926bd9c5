"""Layout-aware HTML rendering.

A tree builder reads tags, closes what a start tag implies closed (paragraphs, items, cells, rows, options) and
opens what it implies open (rows and row groups); stray text of a table is moved before it. Visibility rules
then decide what shows: elements that never do, the ``hidden`` attribute, ``display`` and ``visibility`` from style
attributes and from simple selectors of the page's own style sheets, closed ``details`` and dialogs. What shows is
laid out as text: collapsed white space, lines for blocks and blank lines around paragraphs, numbered or marked
and indented list items, preformatted text as it stands, and tables with their cells aligned in columns over
row and column spans.

Alignment and indentation reach as far as ``width`` characters from the left: a cell whose column starts further right
follows two spaces after the one before it, and deeper items aren't indented more. So the padding of a line is
bounded whatever a page's columns and nesting.

Defined results: null or empty html gives an empty text; html and tables of any nesting are read and laid out
without recursion; spans are as wide and high as the page says; a number of more than 18 digits counts as none;
repeated rows each keep a row; other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Generator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import arrow_map, column_texts, named

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER_SHOWN = frozenset("head script style template title noscript iframe noembed noframes datalist audio video canvas object meta link base param source track area rp".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul xmp caption select".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote dl ol ul menu dir pre xmp table figure fieldset hr".split())
CLOSE_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul xmp li dd dt".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag closes these when they are open, unless one of the borders stands between.
IMPLIED_END: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir table td th".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset("dl table td th".split())),
    "dd": (frozenset(["dt", "dd"]), frozenset("dl table td th".split())),
    "option": (frozenset(["option"]), frozenset("select datalist optgroup".split())),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset("select datalist".split())),
    "tr": (frozenset("tr td th caption colgroup".split()), frozenset(["table"])),
    "td": (frozenset("td th caption colgroup".split()), frozenset("table tr".split())),
    "th": (frozenset("td th caption colgroup".split()), frozenset("table tr".split())),
    "thead": (frozenset("thead tbody tfoot tr td th caption colgroup".split()), frozenset(["table"])),
    "tbody": (frozenset("thead tbody tfoot tr td th caption colgroup".split()), frozenset(["table"])),
    "tfoot": (frozenset("thead tbody tfoot tr td th caption colgroup".split()), frozenset(["table"])),
    "caption": (frozenset("thead tbody tfoot tr td th caption colgroup".split()), frozenset(["table"])),
    "rt": (frozenset(["rt", "rp"]), frozenset(["ruby"])),
    "rp": (frozenset(["rt", "rp"]), frozenset(["ruby"])),
}
#: An end tag doesn't reach beyond these, unless it is one of them.
SCOPE = frozenset("table td th caption html template object".split())
TABLE_PARTS = frozenset("table thead tbody tfoot tr".split())

_TAG = re.compile(
    r"""<!--(?:>|->|(?s:.*?)(?:--!?>|\Z))|<(?:!|\?)[^>]*+(?:>|\Z)|</([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)|<([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<([a-zA-Z][^\s/>]*+)([^>]*+)>"""
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_RULE = re.compile(r"([^{}]*+)\{([^{}]*+)\}")
_SELECTOR = re.compile(r"([a-zA-Z][\w-]*+)?(?:([.#])([\w-]++))?\Z")


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), entities.unescape(a or b or c))
    return out


class Builder:
    """Reads a page into a tree."""

    def __init__(self) -> None:
        self.root = Node("html")
        self.stack = [self.root]
        self.open: dict[str, int] = {}
        self.sheets: list[str] = []

    def _push(self, node: Node) -> None:
        self.stack[-1].children.append(node)
        self.stack.append(node)
        self.open[node.tag] = self.open.get(node.tag, 0) + 1

    def _pop_to(self, depth: int) -> None:
        for node in self.stack[depth:]:
            self.open[node.tag] -= 1
        del self.stack[depth:]

    def _close(self, tags: frozenset[str], borders: frozenset[str]) -> None:
        """Closes up to the outermost open element of ``tags`` within the borders."""
        if not any(self.open.get(t) for t in tags):
            return
        depth = None
        for k in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[k].tag
            if tag in tags:
                depth = k
            elif tag in borders:
                break
        if depth is not None:
            self._pop_to(depth)

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in ("html", "body"):
            if "style" in attrs or "hidden" in attrs or "class" in attrs:
                self.root.attrs = attrs | self.root.attrs
            if tag == "body":
                self._close(frozenset(["head"]), frozenset())
            return
        if self.open.get("head") and tag in BLOCKS:
            self._close(frozenset(["head"]), frozenset())
        if tag in CLOSE_P and self.open.get("p"):
            self._close(frozenset(["p"]), SCOPE | {"button"})
        if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self._pop_to(len(self.stack) - 1)
        if tag in IMPLIED_END:
            self._close(*IMPLIED_END[tag])
        top = self.stack[-1].tag
        if tag in ("td", "th", "tr") and top == "table":
            self._push(Node("tbody"))
            top = "tbody"
        if tag in ("td", "th") and top in ("thead", "tbody", "tfoot"):
            self._push(Node("tr"))
        elif tag == "a" and self.open.get("a"):
            self._close(frozenset(["a"]), SCOPE)
        node = Node(tag, attrs)
        if tag in VOID:
            self.stack[-1].children.append(node)
        else:
            self._push(node)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.stack[-1].children.append(Node("br"))
            return
        if tag in ("html", "body") or not self.open.get(tag):
            if tag == "p":
                self.stack[-1].children.append(Node("p"))
            return
        borders = frozenset(["table"]) if tag in TABLE_PARTS or tag in ("td", "th", "caption") else SCOPE
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                self._pop_to(k)
                return
            if self.stack[k].tag in borders:
                return

    def text(self, data: str) -> None:
        top = self.stack[-1]
        if top.tag in TABLE_PARTS:
            if data.strip(" \t\n\r\f"):  # stray text of a table goes before it
                at = max(k for k, n in enumerate(self.stack) if n.tag == "table")
                above = self.stack[at - 1].children
                above.insert(next(k for k in range(len(above) - 1, -1, -1) if above[k] is self.stack[at]), data)
            return
        top.children.append(data)

    def feed(self, page: str) -> Node:
        at, low = 0, None
        while at < len(page):
            less = page.find("<", at)
            m = _TAG.match(page, less) if less >= 0 else None
            end = less if m else (less + 1 if less >= 0 else len(page))
            if end > at:
                self.text(entities.unescape(page[at:end]))
            if not m:
                at = end
                continue
            at = m.end()
            if m[1]:
                self.end(m[1].lower())
                continue
            name = m[2] or m[4]
            if not name:
                continue
            tag, attrs = name.lower(), _attributes(m[3] or m[5] or "")
            self.start(tag, attrs)
            if tag in RAW and self.stack[-1].tag == tag:
                low = page.lower() if low is None else low
                # lower() may change the length of a few letters: search by pattern then
                stop = low.find(f"</{tag}", at) if len(low) == len(page) else next((x.start() for x in [re.compile(f"</{tag}", re.I).search(page, at)] if x), -1)
                stop = len(page) if stop < 0 else stop
                content = page[at:stop]
                if tag == "style":
                    self.sheets.append(content)
                elif tag != "script":
                    self.stack[-1].children.append(entities.unescape(content) if tag in ("textarea", "title") else content)
                self._pop_to(len(self.stack) - 1)
                close = page.find(">", stop)
                at = len(page) if close < 0 else close + 1
            elif tag == "plaintext":
                self.text(page[at:])
                break
        return self.root


#: Braces, with the query of an @media block; and a query that holds on any screen.
_BRACE = re.compile(r"@media\b([^{};]*+)\{|[{}]", re.I)
_SCREEN = re.compile(r"(?:(?:only\s+)?(?:all|screen))?\Z", re.I)


def _on_screen(sheet: str) -> str:
    """A style sheet without the @media blocks that need more than a screen."""
    out: list[str] = []
    open_blocks: list[bool | None] = []  # whether an @media block is read; None for other blocks
    at = skipped = 0
    for m in _BRACE.finditer(sheet):
        if m[1] is None and m.group() == "{":
            open_blocks.append(None)
            continue
        shown = any(_SCREEN.match(q.strip()) for q in m[1].split(",")) if m[1] is not None else open_blocks.pop() if open_blocks else None
        if shown is None:
            continue
        if not skipped:
            out.append(sheet[at : m.start()])
        at = m.end()
        if m[1] is not None:
            open_blocks.append(shown)
            skipped += not shown
        else:
            skipped -= not shown
    return "".join(out) + ("" if skipped else sheet[at:])


def _declarations(text: str) -> dict[str, str]:
    out = {}
    for part in text.lower().split(";"):
        name, _, value = part.partition(":")
        if value and name.strip() in ("display", "visibility", "white-space"):
            out[name.strip()] = value.replace("!important", "").strip()
    return out


class Styles:
    """Simple selectors (an element, a class, an id, an element with one of them) of a page's style sheets."""

    def __init__(self, sheets: list[str]):
        self.rules: dict[tuple[str, str, str], dict[str, str]] = {}
        for sheet in sheets:
            for selectors, body in _RULE.findall(_on_screen(re.sub(r"/\*(?s:.*?)\*/|<!--|-->", "", sheet))):
                if found := _declarations(body):
                    for s in selectors.split(","):
                        if (m := _SELECTOR.match(s.strip())) and m.group():
                            self.rules.setdefault(((m[1] or "").lower(), m[2] or "", m[3] or ""), {}).update(found)

    def of(self, node: Node) -> dict[str, str]:
        out: dict[str, str] = {}
        if self.rules:
            keys = [("", "")] + [(".", c) for c in node.attrs.get("class", "").split()] + [("#", i) for i in [node.attrs.get("id", "")] if i]
            for kind, name in keys:
                for tag in ("", node.tag) if kind else (node.tag,):
                    out.update(self.rules.get((tag, kind, name), {}))
        if "style" in node.attrs:
            out.update(_declarations(node.attrs["style"]))
        return out


def _width(text: str) -> int:
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Flow:
    """Lines of text under construction."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.ended_in_space = True
        self.gap = 0
        self.indent = [""]
        self.marker = ""

    def deepen(self, more: int) -> None:
        self.indent.append(self.indent[-1] + " " * max(0, min(more, self.width - len(self.indent[-1]))))

    def _lead(self) -> str:
        if self.marker:
            lead = self.indent[-2] + self.marker.ljust(len(self.indent[-1]) - len(self.indent[-2])) if len(self.indent) > 1 else self.marker
            self.marker = ""
            return lead
        return self.indent[-1]

    def text(self, data: str) -> None:
        data = _SPACE.sub(" ", data)
        if self.ended_in_space:
            data = data.removeprefix(" ")
        if data:
            self.parts.append(data)
            self.ended_in_space = data.endswith(" ")

    def end_line(self) -> None:
        """Ends the line if it has anything."""
        if self.parts:
            self._put("".join(self.parts).rstrip(" "))
            self.parts = []
        self.ended_in_space = True

    def _put(self, line: str) -> None:
        if self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        self.lines.append((self._lead() + line.replace("\xa0", " ")).rstrip())

    def put_all(self, lines: list[str]) -> None:
        """Lines that are laid out already."""
        if lines and not self._bare():
            for line in lines:
                self._put(line)
        elif lines:
            self._put(lines[0])
            self.lines += lines[1:]

    def _bare(self) -> bool:
        return not self.indent[-1] and not self.marker

    def new_line(self) -> None:
        """A line break: an empty line where nothing stands."""
        if self.parts:
            self.end_line()
        elif self.lines:
            self.gap = max(self.gap, 1)

    def block(self, spaced: bool) -> None:
        self.end_line()
        if spaced and self.lines:
            self.gap = max(self.gap, 1)

    def verbatim(self, data: str) -> None:
        first, *rest = data.replace("\r\n", "\n").replace("\r", "\n").expandtabs(8).split("\n")
        self.parts.append(first)
        for line in rest:
            self._put("".join(self.parts))
            self.parts = [line]
        self.ended_in_space = not self.parts[-1]
        self.parts = [p for p in self.parts if p]

    def done(self) -> list[str]:
        self.end_line()
        if self.marker:
            self._put("")
        return self.lines


def _number(n: int, kind: str) -> str:
    if kind in "aA" and n > 0:
        out = ""
        while n:
            n, k = divmod(n - 1, 26)
            out = chr(ord("a") + k) + out
        return out if kind == "a" else out.upper()
    if kind in "iI" and 0 < n < 4000:
        out = ""
        for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
            out += sign * (n // value)
            n %= value
        return out if kind == "i" else out.upper()
    return str(n)


def _int(text: str | None, default: int) -> int:
    m = re.match(r"\s*([+-]?)0*+([0-9]{0,19})", text or "")
    if not m or not re.match(r"\s*[+-]?[0-9]", text or "") or len(m[2]) > 18:
        return default
    return int(m[1] + (m[2] or "0"))


#: A layout in progress: it gives the layouts it needs first, takes their lines, and returns its own.
Layout = Generator["Layout", list[str], Any]


def _laid_out(first: Layout) -> list[str]:
    """Runs a layout and those inside of it on a stack of its own."""
    stack, lines = [first], None
    while stack:
        try:
            stack.append(stack[-1].send(lines))
            lines = None
        except StopIteration as e:
            stack.pop()
            lines = e.value
    return lines


class Spans:
    """Grid columns that cells of rows above still cover: ``[start, end, last row]`` by start, those that touch and end in the
    same row as one."""

    def __init__(self) -> None:
        self.held: list[list[int]] = []

    def row(self, y: int) -> list[list[int]]:
        """The columns covered in a row."""
        self.held = [h for h in self.held if h[2] >= y]
        return self.held

    def add(self, new: list[list[int]]) -> None:
        out: list[list[int]] = []
        for h in sorted(self.held + new) if new else self.held:
            if out and out[-1][2] == h[2] and h[0] <= out[-1][1]:
                out[-1][1] = max(out[-1][1], h[1])
            else:
                out.append(h)
        self.held = out


class Renderer:
    def __init__(self, styles: Styles, width: int = 1000):
        self.styles, self.width = styles, width

    def shown(self, node: Node, visible: bool) -> tuple[bool, bool]:
        """Whether the element takes part in the layout, and whether its own text shows."""
        if node.tag in NEVER_SHOWN or "hidden" in node.attrs:
            return False, False
        if node.tag == "dialog" and "open" not in node.attrs or node.tag == "input" and node.attrs.get("type", "").lower() == "hidden":
            return False, False
        style = self.styles.of(node)
        if style.get("display") == "none":
            return False, False
        if "visibility" in style:
            visible = style["visibility"] not in ("hidden", "collapse")
        return True, visible

    def flow(self, children: list[Any], visible: bool, pre: bool = False) -> Layout:
        """The lines of some nodes. The walk keeps its own stack: a callable is an element's end."""
        out = Flow(self.width)
        stack: list[Any] = [(c, visible, pre) for c in reversed(children)]
        counters: list[list[Any]] = []
        while stack:
            item = stack.pop()
            if callable(item):
                item()
                continue
            node, seen, kept = item
            if isinstance(node, str):
                if seen:
                    out.verbatim(node) if kept else out.text(node)
                continue
            takes_part, seen = self.shown(node, seen)
            if not takes_part:
                continue
            tag, inner = node.tag, node.children
            if tag == "br":
                out.new_line()
                continue
            if tag == "input":
                if seen and node.attrs.get("type", "text").lower() not in ("checkbox", "radio", "file", "image", "password", "range", "color"):
                    out.text(" " + node.attrs.get("value", "") + " ")
                continue
            if tag == "table":
                yield from self.table(node, seen, out)
                continue
            spaced = tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and counters)
            if tag == "details" and "open" not in node.attrs:
                inner = [c for c in inner if isinstance(c, Node) and c.tag == "summary"][:1]
            kept = kept or tag in ("pre", "textarea", "xmp") or self.styles.of(node).get("white-space", "").startswith("pre")
            if tag in ("pre", "textarea") and inner and isinstance(inner[0], str) and inner[0].startswith("\n"):
                inner = [inner[0][1:], *inner[1:]]
            if tag in BLOCKS:
                out.block(spaced)
                stack.append(lambda spaced=spaced: out.block(spaced))
            if tag in ("ul", "ol", "menu", "dir"):
                items = sum(isinstance(c, Node) and c.tag == "li" for c in inner) if "reversed" in node.attrs else 0
                counters.append([tag == "ol", _int(node.attrs.get("start"), items or 1), -1 if "reversed" in node.attrs else 1, node.attrs.get("type", "1")[:1] or "1"])
                stack.append(counters.pop)
            elif tag == "li":
                marker = "- "
                if counters and counters[-1][0]:
                    now = counters[-1]
                    n = _int(node.attrs.get("value"), now[1])
                    now[1] = n + now[2]
                    marker = _number(n, now[3]) + ". "
                out.deepen(len(marker))
                if seen:
                    out.marker = marker
                stack.append(lambda: self._leave(out))
            elif tag in ("blockquote", "dd"):
                out.deepen(4)
                stack.append(lambda: self._leave(out))
            elif tag in ("td", "th"):  # a cell outside of a table
                out.text(" ")
            elif tag == "q" and seen:
                out.text("“")
                stack.append(lambda: out.text("”"))
            stack += [(c, seen, kept) for c in reversed(inner)]
        return out.done()

    @staticmethod
    def _leave(out: Flow) -> None:
        out.end_line()
        if out.marker:
            out._put("")
        out.indent.pop()

    def table(self, table: Node, visible: bool, out: Flow) -> Layout:
        out.block(True)
        rows: dict[str, list[tuple[Node, bool]]] = {"thead": [], "tbody": [], "tfoot": []}
        for part in table.children:
            if not isinstance(part, Node):
                continue
            on, seen = self.shown(part, visible)
            if not on:
                continue
            if part.tag == "caption":
                out.put_all((yield self.flow(part.children, seen)))
            elif part.tag in rows:
                for row in part.children:
                    if isinstance(row, Node):
                        row_on, row_seen = self.shown(row, seen)
                        if row_on:
                            rows[part.tag].append((row, row_seen))
            else:
                rows["tbody"].append((part, seen))
        grid = [r for name in ("thead", "tbody", "tfoot") for r in rows[name]]
        spans = Spans()
        cells: list[list[tuple[int, int, list[str]]]] = []
        for y, (row, row_seen) in enumerate(grid):
            covered, at, x = spans.row(y), 0, 0
            line, lasting = [], []
            for cell in row.children if row.tag == "tr" else [row]:
                if not isinstance(cell, Node):
                    continue
                on, seen = self.shown(cell, row_seen)
                if not on:
                    continue
                while at < len(covered) and covered[at][0] <= x:
                    x = max(x, covered[at][1])
                    at += 1
                wide = max(1, _int(cell.attrs.get("colspan"), 1))
                high = _int(cell.attrs.get("rowspan"), 1)
                last = len(grid) - 1 if high <= 0 else min(y + high, len(grid)) - 1
                line.append((x, wide, (yield self.flow(cell.children, seen))))
                if last > y:
                    lasting.append([x, x + wide, last])
                x += wide
            spans.add(lasting)
            cells.append(line)
        self.align(cells, out)
        out.block(True)

    def align(self, cells: list[list[tuple[int, int, list[str]]]], out: Flow) -> None:
        used = sorted({x for row in cells for x, _, lines in row if any(lines)})
        if len(used) == 1:
            for row in cells:
                for _, _, lines in row:
                    if any(lines):
                        out.put_all(lines)
            return
        widths = [0] * len(used)
        spread = []
        for row in cells:
            for x, wide, lines in row:
                if any(lines):
                    first, end = bisect_left(used, x), bisect_left(used, x + wide)
                    longest = max(map(_width, lines))
                    if end == first + 1:
                        widths[first] = max(widths[first], longest)
                    else:
                        spread.append((first, end, longest))
        for first, end, longest in spread:  # then the columns under a wide cell grow, the last of them
            widths[end - 1] += max(0, longest - sum(widths[first:end]) - 2 * (end - first - 1))
        starts = {}
        at = 0
        for x, w in zip(used, widths):
            starts[x] = at
            at += w + 2
        for row in cells:
            shown = [(starts[x], lines) for x, _, lines in row if any(lines)]
            for k in range(max((len(lines) for _, lines in shown), default=0)):
                parts, at = [], 0
                for start, lines in shown:
                    if k < len(lines) and lines[k]:
                        if parts:
                            pad = max(2, start - at) if start <= self.width else 2
                        else:  # leading space is bounded over all nested tables
                            pad = max(0, min(start, self.width - len(lines[k]) + len(lines[k].lstrip(" "))))
                        parts.append(" " * pad + lines[k])
                        at += pad + _width(lines[k])
                out._put("".join(parts))


def render(page: str, width: int = 1000) -> str:
    """The visible text of a page."""
    builder = Builder()
    root = builder.feed(page)
    renderer = Renderer(Styles(builder.sheets), width)
    on, seen = renderer.shown(root, True)
    lines = _laid_out(renderer.flow(root.children, seen)) if on else []
    return "\n".join(lines).strip("\n")


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", width: int = 1000) -> DataFrame:
    """``(page_id, text)`` for every row of ``pages``."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([render(t, width) for t in column_texts(batch, 1)], pa.string())], ["page_id", "text"])

    page_id, html = named([id_col, html_col])
    return arrow_map(pages.select(page_id.alias("page_id"), html.alias("html")), make, f"page_id {dict(pages.dtypes)[id_col]}, text string")
