"""HTML extraction by layout-aware rendering.

A tree builder closes what HTML leaves open (implied tags), visibility rules prune what a browser doesn't show, and a
renderer walks the tree: blocks keep their spacing, lists their markers and nesting, tables become aligned columns.
Pages are independent; each task renders one page at a time, without recursion, in time linear in its length.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from larkspur.llm.blocks import text_blocks, with_column
from larkspur.llm.common import free_name

# fixed values of the HTML standard: void elements, elements of raw text, elements that aren't shown
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template title iframe noembed noframes datalist object video audio canvas rp annotation annotation-xml".split())
#: Blocks that stand between blank lines, and blocks that only start a line.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu blockquote pre table figure hr fieldset".split())
PLAIN = frozenset("html body div section article nav header footer main aside address form li dt dd caption figcaption details summary legend center dir hgroup search option optgroup select xmp".split())
BLOCKS = SPACED | PLAIN
#: A start tag of these closes an open paragraph.
CLOSES_P = (BLOCKS - frozenset("html body caption summary legend option optgroup select li dt dd".split())) | {"li", "dt", "dd"}
#: A start tag -> the open elements that it closes, and the elements that it doesn't look beyond.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "table", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select", "datalist"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"tr", "td", "th", "tbody", "thead", "tfoot", "caption"}, {"table"}),
    "thead": ({"tr", "td", "th", "tbody", "thead", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "tbody", "thead", "tfoot", "caption"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
#: Elements that may stand in the head; any other element ends it.
IN_HEAD = frozenset("base link meta script style title template noscript html head".split())
#: An end tag doesn't close elements beyond these.
SCOPE = frozenset({"table", "td", "th", "html"})
#: Columns of a table are padded to this width at most; wider cells stay whole and push their line out.
MAX_PAD = 80
#: Columns that are aligned; cells beyond them follow as they come.
MAX_COLUMNS = 1000
# fixed values of the HTML standard: the most columns and rows that a cell spans
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65534

# White space, a name and its value: a quote opens a value only after "=", and is a letter like others elsewhere. Every
# alternative runs on to its end or to the end of the page, so nothing is scanned twice.
NAME = r"[^ \t\n\f\r/>][^ \t\n\f\r/>=]*+"
IS = r"[ \t\n\f\r]*+=[ \t\n\f\r]*+"
VALUE = r"""(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^ \t\n\f\r>"'][^ \t\n\f\r>]*+)"""
ATTRIBUTE = re.compile(f"({NAME})(?:{IS}({VALUE})?+)?+")
ELEMENT = rf"(/?)([a-zA-Z][^ \t\n\f\r/>]*+)((?:[ \t\n\f\r/]++|{NAME}(?:{IS}{VALUE}?+)?+)*+)(>|\Z)"
COMMENT = r"!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*+(?:>|\Z)|/(?:>|[^a-zA-Z>][^>]*+(?:>|\Z))"
TAG = re.compile(f"<(?:{ELEMENT}|{COMMENT})", re.DOTALL)
SPACES = re.compile(r"[ \t\n\r\f]+")
NO_DISPLAY = re.compile(r"display\s*:\s*none")
VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)")
#: Attributes are read only where one of these can matter.
WATCHED = re.compile(r"style|hidden|span|start|value|type|reversed|open", re.IGNORECASE)


class Node:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def attributes_of(text: str) -> dict[str, str]:
    if not WATCHED.search(text):
        return {}
    found: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), html.unescape(value.strip("\"'")))
    return found


def build(page: str) -> Node:
    """The tree of a page; text is kept as strings among the children."""
    root = Node("#root", {})
    stack = [root]
    where: dict[str, list[int]] = {}  # from a name to the places of its open elements in the stack

    def last(tags) -> int:
        """The place of the innermost open element of these names, 0 for none."""
        return max((where[x][-1] for x in tags if where.get(x)), default=0)

    def close_to(i: int) -> None:
        for node in stack[i:]:
            where[node.tag].pop()
        del stack[i:]

    def imply(tag: str) -> None:
        if where.get("head") and tag not in IN_HEAD:
            close_to(where["head"][-1])
        if tag in CLOSES_P and where.get("p") and where["p"][-1] > last(SCOPE):
            close_to(where["p"][-1])
        if tag in IMPLIED:
            closes, until = IMPLIED[tag]
            beyond = last(until)
            if tag in ("li", "dt", "dd", "option"):
                place = last(closes)
            else:
                inside = [where[x][bisect_right(where[x], beyond)] for x in closes if where.get(x) and where[x][-1] > beyond]
                place = min(inside, default=0)
            if place > beyond:
                close_to(place)

    def text(part: str) -> None:
        if stack[-1].tag == "head" and not part.isspace():
            close_to(len(stack) - 1)
        stack[-1].children.append(part)

    at = 0
    for_text = page.find
    while True:
        start = for_text("<", at)
        if start < 0:
            if at < len(page):
                text(page[at:])
            return root
        found = TAG.match(page, start)
        if found is None:  # a bare "<" is text
            text(page[at : start + 1])
            at = start + 1
            continue
        if start > at:
            text(page[at:start])
        at = found.end()
        if found[2] is None or not found[4]:
            continue  # a comment, or a tag that the page's end cuts off
        tag = found[2].lower()
        if found[1]:
            if tag == "br":
                stack[-1].children.append(Node("br", {}))
            elif tag == "p" and not where.get("p"):
                stack[-1].children.append(Node("p", {}))
            elif where.get(tag) and tag not in ("html", "body"):
                if tag in ("table", "tr", "tbody", "thead", "tfoot", "td", "th") or where[tag][-1] > last(SCOPE):
                    close_to(where[tag][-1])
            continue
        if tag in ("html", "body") and where.get(tag):
            continue
        imply(tag)
        node = Node(tag, attributes_of(found[3]) if found[3] else {})
        stack[-1].children.append(node)
        if tag in VOID or (found[3] and found[3].endswith("/") and tag in ("svg", "math", "path", "g", "text", "use", "rect", "circle", "line")):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.IGNORECASE).search(page, at)
            stop = end.start() if end else len(page)
            if tag not in UNSEEN:
                node.children.append(page[at:stop])
            close = page.find(">", stop)
            at = len(page) if not end or close < 0 else close + 1
            continue
        where.setdefault(tag, []).append(len(stack))
        stack.append(node)


class Sink:
    """Lines of text; white space collapses, and blocks ask for line ends and blank lines."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False  # a blank is due before the next text
        self.blank = False  # a blank line is due before the next line
        self.indent: list[str] = []
        self.marker = ""  # stands before the next line in place of the innermost indent

    def add(self, text: str) -> None:
        text = SPACES.sub(" ", text)
        if text[:1] == " ":
            self.space = True
        core = text.strip(" ")
        if not core:
            return
        if self.line:
            if self.space:
                self.line.append(" ")
        self.line.append(core)
        self.space = text[-1] == " "

    def raw(self, text: str) -> None:
        """Preformatted text."""
        for i, part in enumerate(text.replace("\r\n", "\n").split("\n")):
            if i:
                self.end(force=True)
            if part:
                self.line.append(part)

    def end(self, force: bool = False) -> None:
        """Ends the line, if one has begun."""
        if self.line or force:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            lead = "".join(self.indent)
            if self.marker:
                lead = "".join(self.indent[:-1]) + self.marker
                self.marker = ""
            self.lines.append((lead + "".join(self.line)).rstrip() if self.line else "")
            self.line = []
        self.space = False

    def block(self, spaced: bool) -> None:
        self.end()
        self.blank |= spaced

    def text(self) -> str:
        self.end()
        return "\n".join(self.lines).strip("\n")


def number(text: str | None, default: int) -> int:
    try:
        return int(text) if text is not None and len(text) < 12 else default
    except ValueError:
        return default


def aligned(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Lines of a table whose cells are (text, columns, rows): columns are padded to their widest cell."""
    left: list[int] = []  # for each column, the rows that a cell above still takes
    placed: list[list[tuple[int, str, int]]] = []
    for row in rows:
        c, line = 0, []
        for text, across, down in row:
            while c < len(left) and left[c]:
                c += 1
            line.append((c, text, across))
            to = min(c + across, MAX_COLUMNS)
            left += [0] * (to - len(left))
            left[c:to] = [down] * max(0, to - c)
            c += across
        placed.append(line)
        left = [max(0, n - 1) for n in left]
    widths = [0] * len(left)
    for line in placed:
        for c, text, across in line:
            widest = max(map(len, text.split("\n")))
            if across == 1 and c < len(widths) and widest <= MAX_PAD:
                widths[c] = max(widths[c], widest)
    starts = [0, *accumulate(w + 2 for w in widths)]
    out = []
    for line in placed:
        cells = [(c, text.split("\n"), across) for c, text, across in line]
        for k in range(max((len(x) for _, x, _ in cells), default=0)):
            parts, at = [], 0
            for c, x, across in cells:
                text = x[k] if k < len(x) else ""
                here, to = min(c, len(widths)), min(c + across, len(widths))
                parts.append(" " * (starts[here] - starts[at]))
                parts.append(text.ljust(widths[here]) + "  " if here < len(widths) else text + "  ")
                at = min(here + 1, len(widths))
                parts.append(" " * (starts[to] - starts[at]) if to > at else "")
                at = max(at, to)
            out.append("".join(parts).rstrip())
    return [x for x in out if x]


def render(root: Node) -> str:
    """The visible text of a tree."""
    sinks = [Sink()]
    tables: list[list[list]] = []
    lists: list[list] = []  # [ordered, next number]
    pre = 0
    drawings: list[bool] = []  # whether each open svg is visible: of its contents, only its text elements are text
    todo: list = [(root, True, False)]  # (node or text, visible, leaving)
    while todo:
        node, visible, leaving = todo.pop()
        sink = sinks[-1]
        if isinstance(node, str):
            if visible:
                text = html.unescape(node) if "&" in node else node
                sink.raw(text) if pre else sink.add(text)
            continue
        tag = node.tag
        if leaving:
            if tag in ("td", "th"):
                cell = sinks.pop().text()
                if tables:
                    rows = tables[-1]
                    if not rows:
                        rows.append([])
                    a = node.attributes
                    across = min(max(number(a.get("colspan"), 1), 1), MAX_COLSPAN)
                    down = min(max(number(a.get("rowspan"), 1), 1), MAX_ROWSPAN)
                    rows[-1].append((cell, across, down))
                else:
                    sinks[-1].add(cell + " ")
                continue
            if tag == "table":
                for line in aligned(tables.pop()):
                    sink.line.append(line)
                    sink.end()
            elif tag == "li":
                sink.end()
                if sink.indent:
                    sink.indent.pop()
                sink.marker = ""
            elif tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
            elif tag in ("blockquote", "dd"):
                sink.end()
                if sink.indent:
                    sink.indent.pop()
            elif tag in ("pre", "xmp"):
                pre -= 1
            elif tag == "svg":
                drawings.pop()
            if tag in BLOCKS:
                sink.block(tag in SPACED and not (tag in ("ul", "ol", "menu") and lists))
            continue
        a = node.attributes
        if tag in UNSEEN or "hidden" in a or (tag == "dialog" and "open" not in a):
            continue
        if "style" in a:
            style = a["style"].lower()
            if NO_DISPLAY.search(style):
                continue
            if shown := VISIBILITY.findall(style):
                visible = shown[-1] == "visible"
        if tag == "svg":
            drawings.append(visible)
            visible = False
        elif tag == "text" and drawings:
            visible = drawings[-1]
        if tag == "br":
            sink.end(force=True)
            continue
        if tag == "wbr":
            continue
        if tag in BLOCKS:
            sink.block(tag in SPACED and not (tag in ("ul", "ol", "menu") and lists))
        if tag == "table":
            tables.append([])
        elif tag == "tr":
            if tables:
                tables[-1].append([])
        elif tag in ("td", "th"):
            sinks.append(Sink())
        elif tag in ("ul", "ol", "menu", "dir"):
            lists.append([tag == "ol", number(a.get("start"), 1)])
        elif tag == "li":
            marker = "- "
            if lists and lists[-1][0]:
                lists[-1][1] = number(a.get("value"), lists[-1][1])
                marker = f"{lists[-1][1]}. "
                lists[-1][1] += 1
            sink.marker = (sink.marker or "") + marker if sink.marker else marker
            sink.indent.append(" " * len(marker))
        elif tag in ("blockquote", "dd"):
            sink.indent.append("  ")
        elif tag in ("pre", "xmp"):
            pre += 1
        if tag not in VOID:
            todo.append((node, visible, True))
            todo.extend((x, visible, False) for x in reversed(node.children))
    return sinks[0].text()


def visible_text(page: str) -> str:
    """All visible text of a page, laid out. Anything is accepted; what isn't a tag is text."""
    return render(build(page.replace("\x00", "")))


def extract(pages: DataFrame, page: str = "html", into: str = "text") -> DataFrame:
    """The columns of pages without `page`, and `into`: the page's visible text, empty for a null or empty page.

    Rows, repeats and null keys stay as they are; a column named like `into` is replaced. An empty table stays empty. A page
    may be of any length: its time and memory grow in proportion to it.
    """
    source = page if into != page else free_name(pages, page)
    kept = pages.drop(into) if into != page else pages.withColumnRenamed(page, source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_blocks(batches, source):
            out = with_column(rows, into, pa.array(map(visible_text, texts), pa.string()))
            yield out.drop_columns([source])

    return kept.mapInArrow(run, T.StructType([*[f for f in kept.schema.fields if f.name != source], T.StructField(into, T.StringType())]))
