"""HTML extraction by layout-aware rendering.

Markup becomes tokens, tokens a tree (end tags that authors leave out are implied, stray ones
dropped), and the tree is rendered the way a text browser shows it: hidden elements go, blocks
stand on lines of their own with a blank line about paragraphs and headings, list items get a
bullet or their number, quotes and nested lists are indented, preformatted text keeps its lines,
and a table's cells, column and row spans included, are padded so that columns line up. All visible text
comes out, that of SVG, MathML and options too; nothing is guessed to be boilerplate. display:none, the
hidden attribute and elements that show nothing go with all inside; visibility is inherited, so a visible
element in a hidden one shows.

Nothing recurses but tables in tables, DEEPEST deep; deeper ones are rendered as plain blocks, whole. An open
element is found by its name, not by a search, and a cell is padded by MOST_PAD spaces at most (a cell wider than
MOST_WIDTH doesn't widen its column), so time and output are linear in the page.

Defined results: null and empty markup give an empty text; text without tags is itself with
white space folded; repeated rows are rendered one by one; other columns pass through, but for
`text`, which is replaced.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from ..ship import ship

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript iframe object embed noembed noframes datalist audio video canvas title desc defs metadata symbol annotation annotation-xml input".split())
BLOCKS = frozenset("address article aside body blockquote center dd details optgroup option dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul tr td th caption thead tbody tfoot".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())
#: A start tag ends an open element of these names, up to a scope of the second set.
_ITEM_SCOPE = frozenset("ul ol menu dir table td th".split())
_TABLE_SCOPE = frozenset(["table"])
CLOSES: dict[str, tuple[frozenset, frozenset]] = {
    "li": (frozenset(["li"]), _ITEM_SCOPE),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl", "table", "td", "th"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl", "table", "td", "th"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), _TABLE_SCOPE),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    **{x: (frozenset("tr td th thead tbody tfoot caption colgroup".split()), _TABLE_SCOPE) for x in ("thead", "tbody", "tfoot")},
    **{x: (frozenset("h1 h2 h3 h4 h5 h6".split()), frozenset("article aside div section td th body".split())) for x in "h1 h2 h3 h4 h5 h6".split()},
    "body": (frozenset(["head"]), frozenset()),
}
_ENDS_P = BLOCKS - {"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "body", "html"}
_P_SCOPE = frozenset("table td th caption button object".split())

_TAG = re.compile(r"<(?:(!--)|(/?)([A-Za-z][^\s/>]*)|([!?/]))")
_ATTR = re.compile(r"""\s*/?\s*([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?|\s*(>)|\s*["'=/]""")
_GONE = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_SHOWN = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible)", re.I)
DEEPEST, MOST_WIDTH, MOST_PAD, MOST_SPAN = 30, 60, 80, 1000
_SPACE = re.compile(r"[ \t\n\f\r]+")


class Node:
    __slots__ = ("name", "attrs", "kids")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.kids = name, attrs, []


def tokens(page: str):
    """("text", s), ("start", name, attrs) and ("end", name)."""
    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            yield "text", html.unescape(page[at:])
            return
        if m.start() > at:
            yield "text", html.unescape(page[at : m.start()])
        if m[1]:
            end = page.find("-->", m.end())
            at = n if end < 0 else end + 3
            continue
        if m[4]:
            end = page.find("]]>" if page.startswith("<![CDATA[", m.start()) else ">", m.end())
            at = n if end < 0 else end + (3 if page[end] == "]" else 1)
            continue
        name, attrs, at = m[3].lower(), {}, m.end()
        while at < n:
            a = _ATTR.match(page, at)
            if not a:
                at += 1
                continue
            at = a.end()
            if a[5]:
                break
            if a[1]:
                value = next((x for x in a.group(2, 3, 4) if x is not None), "")
                attrs.setdefault(a[1].lower(), html.unescape(value))
        if m[2]:
            yield "end", name
            continue
        yield "start", name, attrs
        if name in RAW:
            e = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            end = e.start() if e else n
            body = page[at:end]
            yield "text", html.unescape(body) if name in ("textarea", "title") else body
            at = end


class Open:
    """The open elements, and by name where each stands."""

    def __init__(self, root: Node):
        self.nodes, self.at = [root], {}

    def push(self, node: Node) -> None:
        self.at.setdefault(node.name, []).append(len(self.nodes))
        self.nodes.append(node)

    def last(self, names) -> int:
        """The innermost of the names, 0 if none is open."""
        return max((x[-1] for n in names if (x := self.at.get(n))), default=0)

    def close(self, names, scope) -> bool:
        """Ends the innermost of the names and all inside, unless one of scope is further in."""
        k = self.last(names)
        if not k or self.last(scope) > k:
            return False
        for node in self.nodes[k:]:
            self.at[node.name].pop()
        del self.nodes[k:]
        return True


_LOOSE = frozenset("table body html td th tr thead tbody tfoot caption".split())


def tree(page: str) -> Node:
    """The page's elements; text as str."""
    root = Node("#root", {})
    open_ = Open(root)
    for kind, *what in tokens(page):
        if kind == "text":
            open_.nodes[-1].kids.append(what[0])
            continue
        name = what[0]
        if kind == "end":
            if name == "br":
                open_.nodes[-1].kids.append(Node("br", {}))
            elif name not in VOID:
                open_.close((name,), () if name in _LOOSE else _TABLE_SCOPE - {name})
            continue
        if name in _ENDS_P:
            open_.close(("p",), _P_SCOPE)
        if name in CLOSES:
            # What encloses may be of the names too (a cell in a row): go on.
            while open_.close(*CLOSES[name]):
                pass
        node = Node(name, what[1])
        open_.nodes[-1].kids.append(node)
        if name not in VOID:
            open_.push(node)
    return root


def hidden(node: Node) -> bool:
    """Whether nothing of it shows, whatever is inside."""
    a = node.attrs
    return node.name in HIDDEN or "hidden" in a or ("style" in a and bool(_GONE.search(a["style"]))) or (node.name == "dialog" and "open" not in a)


def shown(node: Node, before: bool) -> bool:
    """Whether its own text shows; before: of the element around."""
    m = _SHOWN.search(node.attrs["style"]) if "style" in node.attrs else None
    return m[1].lower() == "visible" if m else before


class Page:
    """Lines under way: text is folded as it comes, blocks start lines, gaps don't add up."""

    def __init__(self):
        self.lines: list[str] = []
        self.line = ""
        self.gap = False
        self.lead: list[str] = []  # per open block: what its first line starts with
        self.rest: list[str] = []  # and what its later lines start with

    def text(self, s: str, pre: bool) -> None:
        if pre:
            first, *more = s.replace("\r\n", "\n").split("\n")
            self.line += first
            for x in more:
                self.end(True)
                self.line = x
            return
        s = _SPACE.sub(" ", s)
        if s[:1] == " " and (not self.line or self.line[-1] == " "):
            s = s[1:]
        self.line += s

    def end(self, keep: bool = False) -> None:
        line = self.line.rstrip()
        self.line = ""
        if not line and not keep:
            return
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        prefix = "".join(self.lead)
        self.lead = list(self.rest)
        self.lines.append((prefix + line).rstrip())

    def push(self, first: str, rest: str) -> None:
        self.lead.append(first)
        self.rest.append(rest)

    def pop(self) -> None:
        self.lead.pop()
        self.rest.pop()


def render(root: Node, depth: int = 0, visible: bool = True) -> str:
    page = Page()
    counters: list[list] = []
    pre = 0
    # (node, entered, visible): children are visited between entering and leaving.
    todo: list[tuple] = [(root, False, visible)]
    while todo:
        node, entered, before = todo.pop()
        if isinstance(node, str):
            if before:
                page.text(node, pre > 0)
            continue
        name = node.name
        if entered:
            if name == "pre":
                pre -= 1
            if name in BLOCKS:
                page.end()
                if name in ("li", "dd", "blockquote"):
                    page.pop()
                if name in ("ul", "ol"):
                    counters.pop()
                    page.gap = page.gap or not counters
                elif name in SPACED:
                    page.gap = True
            continue
        if hidden(node):
            continue
        visible = shown(node, before)
        if name == "br":
            page.end(True)
            continue
        if name == "img":
            if visible:
                page.text(node.attrs.get("alt", ""), pre > 0)
            continue
        if name in BLOCKS:
            page.end()
            if name in SPACED and not (name in ("ul", "ol") and counters):
                page.gap = True
        if name == "hr":
            page.line = "---" if visible else ""
            page.end()
            continue
        if name == "table" and depth < DEEPEST:
            for line in aligned(rows_of(node, depth, visible)):
                page.line = line
                page.end(True)
            page.gap = True
            continue
        if name in ("ul", "ol"):
            start = node.attrs.get("start", "")
            counters.append([name, int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1])
        elif name == "li":
            mark = "* "
            if counters and counters[-1][0] == "ol":
                mark = f"{counters[-1][1]}. "
                counters[-1][1] += 1
            page.push(mark, " " * len(mark))
        elif name == "dd":
            page.push("    ", "    ")
        elif name == "blockquote":
            page.push("> ", "> ")
        elif name == "pre":
            pre += 1
        todo.append((node, True, visible))
        todo += [(k, False, visible) for k in reversed(node.kids)]
    page.end()
    return "\n".join(page.lines)


def _span(node: Node, name: str) -> int:
    value = node.attrs.get(name, "")
    return min(MOST_SPAN, max(1, int(value))) if re.fullmatch(r"[0-9]{1,4}", value) else 1


def rows_of(table: Node, depth: int, visible: bool) -> list[list[tuple[str, int, int]]]:
    """The table's rows of (cell text, columns it spans, rows it spans); captions and text outside cells
    make rows of one cell that spans no column."""
    rows: list[list[tuple[str, int, int]]] = []
    stack = [(k, visible) for k in reversed(table.kids)]
    while stack:
        node, seen = stack.pop()
        if isinstance(node, str):
            if (s := _SPACE.sub(" ", node).strip()) and seen:
                rows.append([(s, 0, 1)])
        elif hidden(node):
            continue
        elif node.name == "tr":
            seen, cells = shown(node, seen), []
            for k in node.kids:
                if isinstance(k, str):
                    if (s := _SPACE.sub(" ", k).strip()) and seen:
                        cells.append((s, 1, 1))
                elif not hidden(k):
                    cells.append((_cell(k, depth + 1, shown(k, seen)), _span(k, "colspan"), _span(k, "rowspan")))
            if cells:
                rows.append(cells)
        elif node.name in ("thead", "tbody", "tfoot", "form", "center", "div"):
            stack += [(k, shown(node, seen)) for k in reversed(node.kids)]
        elif s := _cell(node, depth + 1, shown(node, seen)):
            rows.append([(s, 0, 1)])
    return rows


def _cell(node: Node, depth: int, visible: bool) -> str:
    shell = Node("#cell", {})
    shell.kids = node.kids
    return render(shell, depth, visible).strip("\n")


def aligned(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Lines whose cells start at the same columns; a cell of several lines takes several lines, and one
    that spans rows keeps its columns free in those below."""
    placed, below, widths = [], {}, {}
    for row in rows:
        cells, at = [], 0
        taken, below = below, {}  # column -> (columns, rows left) of a cell from above
        for column, (span, left) in taken.items():
            if left > 1:
                below[column] = (span, left - 1)
        for text, span, high in row:
            while at in taken:
                at += taken[at][0]
            lines = text.split("\n")
            cells.append((at, lines))
            if high > 1 and span:
                below[at] = (span, high - 1)
            if span == 1:
                widths[at] = max(widths.get(at, 0), *(len(x) for x in lines if len(x) <= MOST_WIDTH), 0)
            elif span:
                widths.setdefault(at, 0)
            at += max(1, span)
        placed.append(cells)
    start, x = {}, 0
    for column in sorted(widths):
        start[column] = x
        x += widths[column] + 2
    out = []
    for cells in placed:
        for k in range(max(len(lines) for _, lines in cells)):
            line = ""
            for column, lines in cells:
                if k < len(lines) and lines[k]:
                    pad = start.get(column, 0) - len(line)
                    line += " " * (pad if (2 if line else 0) <= pad <= MOST_PAD else 2 if line else 0) + lines[k]
            out.append(line.rstrip())
    return out


def visible_text(page: str | None) -> str:
    return render(tree(page)) if page else ""


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages with `text`, what the markup in column shows; column itself goes, if it isn't `text`."""
    spark = pages.sparkSession
    ship(spark)
    keep = [f for f in pages.schema.fields if f.name not in (column, "text")]
    rows = pages.select(*[f"`{f.name}`" for f in keep], f"`{column}`")

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                texts = pa.array([visible_text(x) for x in part.column(len(keep)).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], texts], names=[*[f.name for f in keep], "text"])

    return rows.mapInArrow(run, StructType([*keep, StructField("text", StringType())]))
