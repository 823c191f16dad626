"""HTML extraction by layout-aware rendering: a tree builder with implied tags, then visibility rules and a layout pass that
emits all visible text with block spacing, list markers and aligned table cells.

Tree: void elements hold nothing; script, style and the like are raw text; p, li, dd, dt, tr, td, th, thead, tbody, tfoot,
option and headings end the open elements that they imply the end of; an end tag closes up to its element, if that is open in
the same cell; a stray ``</p>`` is an empty paragraph; the first tag or text that is no head matter ends an open head; whatever
is open at the end is closed.

Visible: what a browser without scripts and plug-ins shows: everything but head matter, raw-text elements other than xmp,
comments, datalists, the fallback of audio and video, and elements with ``hidden``, ``aria-hidden=true``, ``type=hidden``, or a
style with display:none or visibility:hidden. So noscript, and what object and canvas hold, are shown. Of svg, its text and
foreignObject elements are shown where they stand (not once more for each ``use``); of math, all but annotations and phantoms, with
/, ^ and _ in fractions, powers and indices. Alternative texts of images count as text.

Layout: blocks start on lines of their own, with a blank line around paragraphs, headings, lists, tables and quotes; blanks
collapse except in pre and textarea; list items get ``- `` or their number, indented by level; the cells of a table are padded
to their columns' widths and parted by `` | ``, spans taken into account; longer lines than ``MAX_PAD`` are wrapped within their
column if cells follow, but not the rows of inner tables. No text is dropped.

Tags end at the first ``>`` outside of quotes, or, if a quote never ends, at the first one; without any they are text. The time
is linear in the source for any mix of open quotes, tags and comments; the output of deeply nested lists is not, as each
level is indented.

Defined results. Null: null. Empty or without visible text: empty. Not HTML: its text. Any nesting depth works: building and
layout keep stacks of their own.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe noembed noframes xmp".split())
RCDATA = frozenset(("textarea", "title"))
HEAD = frozenset("base basefont bgsound link meta title style script noscript noframes template".split())
HIDDEN = RAW - {"xmp"} | frozenset("head title meta link base datalist audio video annotation annotation-xml mphantom".split())
SVG_HIDDEN = frozenset("title desc metadata defs symbol clippath mask pattern marker lineargradient radialgradient filter".split())
#: Within svg and math: where HTML goes on, and the start tags that end them.
INTEGRATION = frozenset("foreignobject desc mi mo mn ms mtext".split())
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: What stands between the parts of a formula; a blank in the others.
MATH_PARTS = {"mfrac": "/", "msup": "^", "msub": "_"} | dict.fromkeys("msubsup munder mover munderover mroot mmultiscripts mtr mtable".split(), " ")
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre xmp figure form fieldset hr".split())
BLOCK = SPACED | frozenset("html body div section article header footer nav aside main address li dt dd tr caption thead tbody tfoot figcaption details summary legend option select textarea center".split())
CELLS = frozenset(("td", "th"))
#: A start tag ends these open elements, looking no further out than the scope.
P_ENDERS = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul xmp".split())
IMPLIED = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
}
MAX_PAD = 40
#: The most columns that a cell spans, as in browsers. A rowspan goes no further than the table has rows.
MAX_COLSPAN = 1000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.DOTALL)
_DECLARATION = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)", re.DOTALL)
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_QUOTE_OR_END = re.compile(r"[>\"']")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.IGNORECASE)


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


class TagEnds:
    """For every place of a source, the first ``>`` behind it that is in no quotes, or -1: one pass from the back, made only
    for sources with a quote that never ends, in which looking ahead from each tag would take quadratic time."""

    def __init__(self, source: str):
        self.at: list[int] = []
        marks = [(m.start(), m[0]) for m in _QUOTE_OR_END.finditer(source)]
        ends, after = [-1] * (len(marks) + 1), {'"': len(marks), "'": len(marks)}
        for k in range(len(marks) - 1, -1, -1):
            place, mark = marks[k]
            if mark == ">":
                ends[k] = place
            else:
                ends[k] = ends[min(after[mark] + 1, len(marks))]
                after[mark] = k
        self.at, self.ends = [place for place, _ in marks], ends

    def behind(self, place: int) -> int:
        return self.ends[bisect_left(self.at, place)]


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(source):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def parse(source: str) -> Node:
    root = Node("#root")
    stack = [root]
    n_open: dict[str, int] = {}

    def close_to(depth: int) -> None:
        for node in stack[depth:]:
            n_open[node.tag] -= 1
        del stack[depth:]

    def end_implied(ended, scope) -> None:
        if not any(n_open.get(t) for t in ended):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in ended:
                close_to(k)
                return
            if stack[k].tag in scope:
                return

    def foreign() -> int:
        """Where the svg or math that the next tag belongs to is on the stack, or 0."""
        if n_open.get("svg") or n_open.get("math"):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ("svg", "math"):
                    return k
                if stack[k].tag in INTEGRATION or (stack[k].tag == "annotation-xml" and "html" in stack[k].attrs.get("encoding", "").lower()):
                    return 0
        return 0

    def text(s: str) -> None:
        if s:
            if n_open.get("head") and s.strip(" \t\n\r\f"):
                end_implied({"head"}, set())
            stack[-1].children.append(html.unescape(s) if "&" in s else s)

    at, size, tag_ends = 0, len(source), None
    last_end = source.rfind(">")  # what opens behind it is no tag
    while at < size:
        m = _TOKEN.search(source, at)
        if m is not None and m[2] and m.start() > last_end:
            m = _DECLARATION.search(source, m.start())
        if m is None:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        close, tag = (m[1], m[2]) if m.re is _TOKEN else (None, None)
        if not tag:  # a comment or declaration
            if m[0].startswith("<![CDATA[") and foreign():
                end = source.find("]]>", m.start() + 9)
                end = size if end < 0 else end
                stack[-1].children.append(source[m.start() + 9 : end])
                at = end + 3
            continue
        quoted = None if tag_ends else _REST.match(source, at)
        if quoted is None:
            tag_ends = tag_ends or TagEnds(source)
        end = quoted.end() - 1 if quoted else tag_ends.behind(at)
        end = source.find(">", at) if end < 0 else end
        rest, at = source[at:end], end + 1
        tag = tag.lower()
        if close:
            if n_open.get(tag):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        close_to(k)
                        break
                    if stack[k].tag in CELLS and tag not in ("tr", "table", "tbody", "thead", "tfoot", "body", "html"):
                        break
            elif tag == "p":
                stack[-1].children.append(Node("p"))
            elif tag == "br":
                stack[-1].children.append(Node("br"))
            continue
        outer = foreign()
        if outer and tag in BREAKOUT:
            close_to(outer)
            outer = 0
        if tag in P_ENDERS:
            end_implied({"p"}, CELLS | INTEGRATION | {"table", "button", "caption"})
            if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456" and stack[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                close_to(len(stack) - 1)
        if tag in IMPLIED:
            end_implied(*IMPLIED[tag])
            if tag == "tr":
                end_implied({"caption"}, {"table"})
        if tag not in HEAD:
            end_implied({"head"}, set())
        node = Node(tag, attributes(rest) if rest.strip(" /") else None)
        stack[-1].children.append(node)
        if (outer or tag in ("svg", "math")) and rest.endswith("/"):
            continue
        if tag in RAW or tag in RCDATA:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>", re.IGNORECASE).search(source, at) if at <= last_end else None
            inner = source[at : end.start() if end else size]
            if tag in RCDATA:
                node.children.append(html.unescape(inner))
            elif tag == "xmp":
                node.children.append(inner)
            at = end.end() if end else size
        elif tag not in VOID:
            stack.append(node)
            n_open[tag] = n_open.get(tag, 0) + 1
    return root


def visible(node: Node) -> bool:
    if node.tag in HIDDEN:
        return False
    a = node.attrs
    return not (a and ("hidden" in a or a.get("aria-hidden", "").lower() == "true" or a.get("type", "").lower() == "hidden" or ("style" in a and _UNSEEN.search(a["style"]))))


def _labels(svg: Node) -> list[Node]:
    """The elements of an svg that show text, in order."""
    out: list[Node] = []
    work = [svg]
    while work:
        node = work.pop()
        a = node.attrs
        if node.tag in SVG_HIDDEN or not visible(node) or a.get("display", "").lower() == "none" or a.get("visibility", "").lower() in ("hidden", "collapse"):
            continue
        if node.tag in ("text", "foreignobject"):
            node.children = [c for c in node.children if isinstance(c, str) or c.tag not in SVG_HIDDEN]
            out.append(node)
        else:
            work += [c for c in reversed(node.children) if not isinstance(c, str)]
    return out


class Lines:
    """Lines of one box: blanks collapse, and blank lines are pending until text follows."""

    def __init__(self):
        self.done: list[str] = []
        self.now: list[str] = []
        self.gap = False
        self.space = False
        self.least = 0  # the width of the widest table in it

    def put(self, s: str) -> None:
        flat = _SPACE.sub(" ", s)
        core = flat.strip(" ")
        if not core:
            self.space |= bool(flat) and bool(self.now)
            return
        if self.now and (self.space or flat[0] == " "):
            self.now.append(" ")
        if not self.now and self.gap and self.done:
            self.done.append("")
        self.gap = False
        self.now.append(core)
        self.space = flat[-1] == " "

    def raw(self, s: str) -> None:
        """Preformatted text, line by line."""
        for k, line in enumerate(s.split("\n")):
            if k and self.now:
                self.end()
            elif k and not self.gap:
                self.done.append("")
            if line:
                if not self.now and self.gap and self.done:
                    self.done.append("")
                self.gap = False
                self.now.append(line)

    def end(self) -> None:
        if self.now:
            self.done.append("".join(self.now))
            self.now = []
        self.space = False

    def rows(self, rows: list[str]) -> None:
        self.end()
        if rows:
            if self.gap and self.done:
                self.done.append("")
            self.gap = False
            self.done += rows


def _number(value: str | None, least: int, most: int | None = None) -> int:
    try:
        n = int(value or "")
    except ValueError:
        return 1
    return max(least, n if most is None else min(n, most))


def _wrapped(line: str, room: int) -> list[str]:
    """Pieces of at most ``room`` characters, cut at blanks where there are some; blanks at cuts go, indents stay."""
    out: list[str] = []
    while len(line) > room:
        cut = line.rfind(" ", 0, room + 1)
        if not line[: max(cut, 0)].strip(" "):
            cut = room
        out.append(line[:cut].rstrip(" "))
        line = line[cut:].lstrip(" ")
    return [*out, line] if line or not out else out


def _grid(rows: list[list[tuple[list[str], int, int, int]]]) -> list[str]:
    """Rows of (lines, colspan, rowspan, width of inner tables) as aligned text."""
    taken: dict[int, int] = {}  # for how many rows more a column is taken
    placed: list[list[tuple[int, int, list[str], int]]] = []
    for k, row in enumerate(rows):
        col, out, used = 0, [], taken
        taken = {c: n - 1 for c, n in used.items() if n > 1}
        for lines, wide, tall, least in row:
            while col in used:
                col += 1
            out.append((col, wide, lines, least))
            if (tall := min(tall, len(rows) - k)) > 1:
                for c in range(col, col + wide):
                    taken[c] = max(taken.get(c, 0), tall - 1)
            col += wide
        placed.append(out)
    width: dict[int, int] = {}
    for row in placed:
        for col, wide, lines, least in row:
            if wide == 1:
                width[col] = max(width.get(col, 0), min(MAX_PAD, max(map(len, lines), default=0)))
    for row in placed:
        for col, wide, lines, least in row:
            room = sum(width.get(c, 0) for c in range(col, col + wide)) + 3 * (wide - 1)
            need = max(min(MAX_PAD, max(map(len, lines), default=0)), least)
            if room < need:
                width[col + wide - 1] = width.get(col + wide - 1, 0) + need - room
    n_cols = max((col + wide for row in placed for col, wide, _, _ in row), default=0)
    out: list[str] = []
    for row in placed:
        cells = {}
        for col, wide, lines, least in row:
            room = sum(width.get(c, 0) for c in range(col, col + wide)) + 3 * (wide - 1)
            last = col == max(c for c, *_ in row)  # nothing after it to align
            cells[col] = wide, lines if last else [piece for line in lines for piece in _wrapped(line, room)]
        for k in range(max((len(lines) for _, lines in cells.values()), default=0)):
            parts, col = [], 0
            while col < n_cols:
                wide, lines = cells.get(col, (1, []))
                room = sum(width.get(c, 0) for c in range(col, col + wide)) + 3 * (wide - 1)
                parts.append((lines[k] if k < len(lines) else "").ljust(room))
                col += wide
            out.append(" | ".join(parts).rstrip(" |") if any(p.strip() for p in parts) else "")
    return out


def render(root: Node) -> str:
    """Depth-first with a stack of work: nodes to open, and calls to make when they are done."""
    page = Lines()
    work: list = [(root, page, False, 0)]
    tables: list[list] = []
    counters: list[list] = []
    while work:
        item = work.pop()
        if callable(item):
            item()
            continue
        node, box, pre, level = item
        if isinstance(node, str):
            if pre:
                box.raw(node)
            else:
                box.put(node)
            continue
        tag = node.tag
        if not visible(node):
            continue
        if tag == "br":
            if box.now:
                box.end()
            elif box.done:
                box.gap = True
            continue
        if tag == "img":
            box.put(" " + node.attrs.get("alt", "") + " ")
            continue
        if tag == "input":
            box.put(" " + node.attrs.get("value", node.attrs.get("placeholder", "")) + " ")
            continue
        if tag == "svg":
            for label in reversed(_labels(node)):
                work += [(" ", box, False, level), (label, box, False, level), (" ", box, False, level)]
            continue
        if tag in MATH_PARTS:
            parts = [c for c in node.children if not isinstance(c, str)]
            for k, part in reversed(list(enumerate(parts))):
                work.append((part, box, False, level))
                if k:
                    work.append((MATH_PARTS[tag], box, False, level))
            continue
        if tag == "table":
            rows: list = []
            tables.append(rows)

            def finish(box=box, rows=rows):
                tables.pop()
                box.end()
                box.gap = True
                box.rows(grid := _grid(rows))
                box.least = max(box.least, max(map(len, grid), default=0))
                box.gap = True

            work.append(finish)
            # What stands in a table outside of cells is shown before it, as browsers do.
            work += [(c, box, False, level) for c in reversed(node.children)]
            box.end()
            box.gap = True
            continue
        if tag == "tr" and tables:
            tables[-1].append([])
        if tag in CELLS and tables:
            if not tables[-1]:
                tables[-1].append([])
            cell = Lines()
            row, wide, tall = tables[-1][-1], _number(node.attrs.get("colspan"), 1, MAX_COLSPAN), _number(node.attrs.get("rowspan"), 1)
            work.append(lambda cell=cell, row=row, wide=wide, tall=tall: (cell.end(), row.append((cell.done, wide, tall, cell.least))))
            work += [(c, cell, False, 0) for c in reversed(node.children)]
            continue
        block = tag in BLOCK
        pre = pre or tag in ("pre", "textarea", "xmp")
        if block:
            box.end()
            box.gap |= tag in SPACED
        if tag in ("ul", "ol"):
            counters.append([_number(node.attrs.get("start"), -(10**9)) if tag == "ol" else None])
            work.append(counters.pop)
            if level:
                box.gap = False
            level += 1
        if tag in ("li", "blockquote", "dd"):
            inner = Lines()
            if tag == "li" and counters and counters[-1][0] is not None:
                if "value" in node.attrs:
                    counters[-1][0] = _number(node.attrs["value"], -(10**9))
                mark = f"{counters[-1][0]}. "
                counters[-1][0] += 1
            else:
                mark = {"li": "- ", "blockquote": "> ", "dd": "  "}[tag]
            rest = mark if tag == "blockquote" else " " * len(mark)

            def place(box=box, inner=inner, mark=mark, rest=rest, spaced=tag in SPACED):
                inner.end()
                box.rows([((mark if k == 0 else rest) + line).rstrip() for k, line in enumerate(inner.done)])
                box.gap |= spaced
                if inner.least:
                    box.least = max(box.least, inner.least + len(mark))

            work.append(place)
            work += [(c, inner, pre, level) for c in reversed(node.children)]
            continue
        if block:

            def leave(box=box, spaced=tag in SPACED and not (tag in ("ul", "ol") and level > 1)):
                box.end()
                box.gap |= spaced

            work.append(leave)
        elif tag == "q":
            box.put('"')
            work.append(lambda box=box: box.put('"'))
        work += [(c, box, pre, level) for c in reversed(node.children)]
    page.end()
    return "\n".join(page.done).strip("\n")


def html_to_text(source: str | None) -> str | None:
    return None if source is None else render(parse(source))


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([html_to_text(x) for x in batch.column("html").to_pylist()], pa.string())], names=["row", "extracted"])


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``row`` (the input's other columns) and ``extracted``; one row a page, without any shuffle."""
    carried = [c for c in pages.columns if c != html_col] or [html_col]
    row = F.struct(*(F.col(f"`{c}`") for c in carried)).alias("row")
    schema = T.StructType([*pages.select(row).schema, T.StructField("extracted", T.StringType())])
    return pages.select(row, F.col(f"`{html_col}`").alias("html")).mapInArrow(_rendered, schema)
