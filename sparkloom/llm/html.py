"""HTML to visible text, laid out.

A forgiving tokenizer feeds a tree builder that supplies the tags authors leave
out (rows, cells, closing paragraphs and items).  The tree is then rendered:
hidden elements are dropped, white space collapses except in preformatted
text, blocks stand on lines of their own with blank lines where a browser has
margins, list items get bullets or numbers and indents, and the cells of a
table are padded to columns; a cell that spans rows keeps its columns blank in
the rows below.  Both passes use explicit stacks, so any nesting works.

Padding and indents are bounded, text never is: a page has ``PAD`` blanks for
each of its characters and ``PAD_LEAST`` more.  A table that would take more
than is left has its columns cut to a half, a quarter and so on, which longer
cells then overrun, and at last no padding; lists and quotes lose the indent.
Beyond ``MOST_FLOWS`` nested items, cells and quotes, a further one is a plain
block, and beyond ``MOST_ALIVE`` cells of a table that reach into a row, a
further one ends with its row.

Defined cases: null and empty html give the empty text; broken markup never
fails; an unclosed element ends with the page; a page of any length is rendered
whole; each row of a repeated page is rendered, so ties need no order; an empty
table gives an empty one; further columns pass through, but ``html`` goes and a
``text`` of the input gives way to the operator's.  White space is ASCII white
space: a no-break space stays.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape
from string import whitespace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.rows import packed, passengers
from sparkloom.runtime import ship

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template datalist object iframe audio video canvas noframes".split())
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure fieldset".split())
BLOCK = MARGIN | frozenset("address article aside body caption center dd details dialog dir div dt fieldset figcaption footer form header hgroup hr html legend li main menu nav optgroup option section summary tbody tfoot thead tr".split())
CLOSES_P = (BLOCK - frozenset("body html option optgroup legend caption tbody thead tfoot tr".split())) | {"p"}
SCOPE = frozenset("table td th caption button html".split())
SECTION = frozenset("tbody thead tfoot".split())
#: A start tag closes open elements of the second set, up to one of the third.
IMPLIED = {
    "li": (frozenset({"li"}), frozenset("ul ol menu dir table td th".split())),
    "dt": (frozenset({"dt", "dd"}), frozenset("dl table td th".split())),
    "dd": (frozenset({"dt", "dd"}), frozenset("dl table td th".split())),
    "option": (frozenset({"option"}), frozenset("select datalist table".split())),
    "optgroup": (frozenset({"option", "optgroup"}), frozenset("select table".split())),
    "td": (frozenset({"td", "th"}), frozenset("tr table".split())),
    "th": (frozenset({"td", "th"}), frozenset("tr table".split())),
    "tr": (frozenset({"tr", "caption", "colgroup"}), frozenset({"table"}) | SECTION),
    **{s: (SECTION | {"caption", "colgroup", "tr"}, frozenset({"table"})) for s in SECTION},
}

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>?", re.S
)
_HIDES = re.compile(r"(?:^|[;\s])(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WANTED = re.compile(r"hidden|style|type|start|colspan|rowspan|open", re.I)
#: Limits of the HTML standard for the spans of cells.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
PAD, PAD_LEAST, MOST_FLOWS, MOST_ALIVE = 4, 65_536, 64, 64
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in ("script", "style", "textarea", "title", "noframes", "iframe", "xmp")}


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def _attributes(source: str) -> dict[str, str]:
    if not source or not _WANTED.search(source):
        return {}
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in reversed(list(_ATTRIBUTE.finditer(source)))}


class TreeBuilder:
    def __init__(self) -> None:
        self.root = Node("html", {})
        self.open = [self.root]
        self.count = {"html": 1}

    def _push(self, tag: str, attrs: dict[str, str]) -> None:
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.count[tag] = self.count.get(tag, 0) + 1

    def _pop_to(self, at: int) -> None:
        for node in self.open[at:]:
            self.count[node.tag] -= 1
        del self.open[at:]

    def _close(self, tags: frozenset, stop: frozenset) -> None:
        if not any(self.count.get(t) for t in tags):
            return
        lowest = None
        for at in range(len(self.open) - 1, 0, -1):
            tag = self.open[at].tag
            if tag in tags:
                lowest = at
                if tag not in SECTION and tag != "tr":
                    break
            elif tag in stop:
                break
        if lowest is not None:
            self._pop_to(lowest)

    def _inside(self, tags: frozenset) -> str | None:
        """The nearest open element among ``tags`` or a table."""
        for node in reversed(self.open):
            if node.tag in tags or node.tag == "table":
                return node.tag
        return None

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in ("html", "body"):
            if tag == "body":
                self._close(frozenset({"head"}), frozenset())
            return
        if tag == "head" and len(self.open) + len(self.root.children) > 1:
            return
        if self.count.get("head") and tag not in HIDDEN and tag not in ("title", "meta", "link", "base", "noscript"):
            self._close(frozenset({"head"}), frozenset())
        if tag in CLOSES_P:
            self._close(frozenset({"p"}), SCOPE)
        if tag in IMPLIED:
            self._close(*IMPLIED[tag])
        if tag in ("td", "th") and self._inside(frozenset({"tr"})) == "table":
            self._push("tr", {})
        self._push(tag, attrs)

    def end(self, tag: str) -> None:
        if tag in ("html", "body") or tag in VOID:
            if tag == "br":
                self._push("br", {})
            return
        if not self.count.get(tag):
            if tag == "p":
                self._close(frozenset({"p"}), SCOPE)
                self.open[-1].children.append(Node("p", {}))
            return
        for at in range(len(self.open) - 1, 0, -1):
            name = self.open[at].tag
            if name == tag:
                self._pop_to(at)
                return
            if name in ("td", "th", "table") and tag not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot"):
                return

    def text(self, data: str) -> None:
        if self.count.get("head") and self.open[-1].tag == "head":
            if not data.strip(whitespace):
                return
            self._close(frozenset({"head"}), frozenset())
        self.open[-1].children.append(data)


def parse(source: str) -> Node:
    tree, at, find = TreeBuilder(), 0, _TOKEN.search
    while True:
        m = find(source, at)
        chunk = source[at : m.start()] if m else source[at:]
        if chunk:
            tree.text(unescape(chunk) if "&" in chunk else chunk)
        if m is None:
            return tree.root
        at = m.end()
        if m[2]:
            tag = m[2].lower()
            tree.start(tag, _attributes(m[3]))
            if tag in _RAW_END:
                stop = _RAW_END[tag].search(source, at)
                raw = source[at : stop.start() if stop else len(source)]
                if tag in ("textarea", "title", "xmp") and raw:
                    tree.text(raw if tag == "xmp" else unescape(raw))
                at = stop.start() if stop else len(source)
        elif m[1]:
            tree.end(m[1].lower())


def hidden(node: Node) -> bool:
    a = node.attrs
    if node.tag in HIDDEN or node.tag == "title":
        return True
    if node.tag == "dialog" and "open" not in a:
        return True
    return bool(a) and ("hidden" in a or ("style" in a and _HIDES.search(a["style"]) is not None))


_SPACES = re.compile(f"[{whitespace}]+")


class _Flow:
    """Lines of one box."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False

    def inline(self, data: str) -> None:
        words = _SPACES.split(data.strip(whitespace)) if data.strip(whitespace) else []
        if data[0] in whitespace and self.now:
            self.space = True
        if not words:
            return
        if self.space:
            self.now.append(" ")
        self.now.append(" ".join(words))
        self.space = data[-1] in whitespace

    def verbatim(self, data: str) -> None:
        first, *rest = data.split("\n")
        self.now.append(first)
        for line in rest:
            self.lines.append("".join(self.now).rstrip(whitespace))
            self.now = [line]

    def end_line(self) -> None:
        if self.now:
            self.lines.append("".join(self.now).rstrip(whitespace))
            self.now = []
        self.space = False

    def force_line(self) -> None:
        self.lines.append("".join(self.now).rstrip(whitespace))
        self.now, self.space = [], False

    def margin(self) -> None:
        self.end_line()
        if self.lines and self.lines[-1]:
            self.lines.append("")

    def done(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        start = 0
        while start < len(self.lines) and not self.lines[start]:
            start += 1
        return self.lines[start:]


def _whole(text: str, default: int) -> int:
    m = re.match(r"\s*(-?\d{1,9})", text)
    return int(m[1]) if m else default


def place(rows: list[list[tuple[list[str], int, int]]]) -> list[list[tuple[list[str], int, int]]]:
    """Rows of (cell lines, columns, rows spanned) as rows of (cell lines, first column, end).

    A cell goes to the first column that no cell above reaches down to.  The
    columns are those in which some cell begins, so an empty span adds none.
    """
    active: list[tuple[int, int, int]] = []  # (first column, end, the first row below), in order
    out = []
    for k, row in enumerate(rows):
        if active:
            active = [x for x in active if x[2] > k]
        at, i, placed, new = 0, 0, [], []
        for lines, columns, down in row:
            while i < len(active) and active[i][0] <= at:
                at, i = max(at, active[i][1]), i + 1
            placed.append((lines, at, at + columns))
            if down > 1 and len(active) + len(new) < MOST_ALIVE:
                new.append((at, at + columns, k + down))
            at += columns
        active = sorted(active + new) if new else active
        out.append(placed)
    starts = sorted({a for row in out for _, a, _ in row})
    return [[(lines, bisect_left(starts, a), bisect_left(starts, b)) for lines, a, b in row] for row in out]


class Room:
    """The blanks that a page may still take."""

    def __init__(self, chars: int):
        self.left = PAD_LEAST + PAD * chars

    def take(self, blanks: int) -> bool:
        if blanks > self.left:
            return False
        self.left -= blanks
        return True


def table_lines(rows: list[list[tuple[list[str], int, int]]], room: Room) -> list[str]:
    """Rows of (cell lines, columns, rows spanned), padded so that columns align."""
    placed = place(rows)
    width = [0] * max((b for row in placed for _, _, b in row), default=0)
    cells = sorted(((b - a, a, max(map(len, lines), default=0)) for row in placed for lines, a, b in row))
    for span, a, needed in cells:  # what a wide cell lacks goes to its last column
        here = width[a] if span == 1 else sum(width[a : a + span]) + 3 * (span - 1)
        width[a + span - 1] += max(0, needed - here)
    # The cells that have each line of a row; a line goes on to where the row's last cell begins.
    made: list[list[list[tuple[int, int, str]]]] = []
    last = [0] * len(width)
    for row in placed:
        lines_of: list[list[tuple[int, int, str]]] = [[] for _ in range(max((len(lines) for lines, _, _ in row), default=0))]
        for lines, a, b in row:
            for k, line in enumerate(lines):
                lines_of[k].append((a, b, line))
        if row:
            last[row[-1][1]] += len(lines_of)
        made.append(lines_of)
    most = max(width, default=0)
    while True:
        begins = [0]  # where a column begins in a line
        for w in width:
            begins.append(begins[-1] + min(w, most) + 3)
        if room.take(sum(n * at for n, at in zip(last, begins, strict=False))):
            break
        if not most:
            return [" | ".join(text for _, _, text in line).rstrip(whitespace) for lines_of in made for line in lines_of]
        most //= 2
    blank = "".join(" " * min(w, most) + " | " for w in width)
    out = []
    for row, lines_of in zip(placed, made, strict=True):
        empty, at = [], 0
        for _, a, b in row:
            empty += [blank[begins[at] : begins[a]], " " * (begins[b] - begins[a] - 3), " | "]
            at = b
        below = "".join(empty)  # the row without its texts
        for line in lines_of:
            if not row[-1][1]:
                out.append(line[0][2].rstrip(whitespace))
                continue
            parts, at = [], 0
            for a, b, text in line:
                parts += [below[begins[at] : begins[a]], text.ljust(begins[b] - begins[a] - 3), " | "]
                at = b
            parts[-1:] = [" | ", below[begins[at] : begins[row[-1][1]]]] if at <= row[-1][1] else []
            out.append("".join(parts).rstrip(whitespace))
    return out


ENTER, LEAVE, LEAVE_LINE, LEAVE_FLOW = range(4)


def render(root: Node, chars: int) -> str:
    flows, room = [_Flow()], Room(chars)
    lists: list[list] = []  # [ordered, next number]
    tables: list[list[list]] = []
    pre = 0
    stack: list[tuple[Node | str, int]] = [(root, ENTER)]
    while stack:
        node, leaving = stack.pop()
        flow = flows[-1]
        if isinstance(node, str):
            (flow.verbatim if pre else flow.inline)(node)
            continue
        tag = node.tag
        if not leaving:
            if hidden(node) or (tag == "input" and node.attrs.get("type", "").lower() == "hidden"):
                continue
            if tag == "br":
                flow.force_line()
                continue
            if tag in MARGIN and not (tag in ("ul", "ol") and lists):
                flow.margin()
            elif tag in BLOCK:
                flow.end_line()
            if tag in ("ul", "ol", "menu", "dir"):
                lists.append([tag == "ol", _whole(node.attrs.get("start", ""), 1)])
            elif tag == "table":
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("pre", "textarea", "xmp"):
                pre += 1
            apart = tag in ("li", "td", "th", "dd", "blockquote") or (tag == "tr" and not tables)
            own = apart and len(flows) < MOST_FLOWS
            if own:
                flows.append(_Flow())
                lists.append([False, 1]) if tag in ("td", "th") else None
            elif apart:
                flow.end_line()
            stack.append((node, LEAVE_FLOW if own else LEAVE_LINE if apart else LEAVE))
            shown = node.children
            if tag == "details" and "open" not in node.attrs:
                shown = [c for c in shown if isinstance(c, Node) and c.tag == "summary"][:1]
            stack.extend((child, ENTER) for child in reversed(shown))
            continue
        if leaving == LEAVE_FLOW:
            lines = flows.pop().done()
            flow = flows[-1]
            if tag in ("td", "th"):
                lists.pop()
            if tag == "li":
                mark = "- "
                if lists and lists[-1][0]:
                    mark = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                flow.end_line()
                indent = " " * len(mark) if room.take(len(mark) * len(lines)) else ""
                flow.lines += [(mark if i == 0 else indent) + line if line else "" for i, line in enumerate(lines)] if lines else [mark.rstrip()]
            elif tag in ("td", "th") and tables and tables[-1]:
                columns, down = (_whole(node.attrs.get(c, ""), 1) for c in ("colspan", "rowspan"))
                tables[-1][-1].append((lines, min(max(1, columns), MOST_COLUMNS), MOST_ROWS if down == 0 else min(max(1, down), MOST_ROWS)))
            else:
                flow.end_line()
                indent = "  " if tag in ("dd", "blockquote") and room.take(2 * len(lines)) else ""
                flow.lines += [indent + line if line else line for line in lines] if indent else lines
        elif leaving == LEAVE_LINE:
            flow.end_line()
        elif tag == "table":
            flow.end_line()
            flow.lines += table_lines(tables.pop(), room)
        elif tag in ("ul", "ol", "menu", "dir"):
            lists.pop()
        elif tag in ("pre", "textarea", "xmp"):
            pre -= 1
        if tag in MARGIN and not (tag in ("ul", "ol") and lists):
            flow.margin()
        elif tag in BLOCK:
            flow.end_line()
    return "\n".join(flows[0].done())


def to_text(source: str | None) -> str:
    return render(parse(source), len(source)) if source else ""


def extract(html: Column) -> Column:
    ship()

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array((to_text(x.as_py()) for x in batch), pa.string())

    return texts(html)


def extract_pages(pages: DataFrame) -> DataFrame:
    """``pages(html, ...)`` with ``text`` in place of the html."""
    rows = packed(pages, "html").withColumn("text", extract(F.col("html")))
    return rows.select(*passengers(rows, ("html", "text")), "text")
