"""HTML extraction by layout-aware rendering.

A small tree builder reads tags, raw-text elements and character references,
closes elements that end by implication (paragraphs, list items, table parts,
options), ignores stray end tags and moves text that stands between table
cells in front of the table. The head ends at its end tag or, without one, at
the first text or tag that cannot stand in it. The tree is then rendered as text: everything
visible, nothing else. Not visible: the head, scripts, styles, templates,
embedded documents, all of an svg but its text elements and embedded HTML, all
of a math but its token elements (and embedded HTML), elements with ``hidden`` or
``display:none``, what is ``visibility:hidden`` (but elements inside that are
``visible`` again show), and closed details except their summary. Blocks start on
new lines, with a blank line around paragraphs, headings, lists, quotes and
tables; white space collapses outside ``pre``; lists carry bullets or numbers
and nest by indentation; table cells are aligned in columns, over spans too;
buttons show their label. Columns are padded, and lists and quotes indented, up
to ``PAD`` characters; tables inside more than ``DEEP`` tables are set as blocks.

Building and rendering use loops with explicit stacks, so depth is no limit.
The builder knows the places of the open elements of each tag, so a tag costs
the same however many elements are open; time and memory follow the page's size.

Defined cases: a null or empty page gives an empty text; an empty table of pages
gives an empty result; markup that is no tag (``1 < 2``) is text; unclosed markup
runs to the end; very long pages are rendered whole; rows are treated one by one
and other columns pass through, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

from corpusframe.llm.tables import fresh, table

PAD = 60
DEEP = 20
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("head script style template iframe object noembed noframes noscript title canvas audio video datalist".split())
#: Blocks with a blank line around them, and blocks that only start a line.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre xmp table figure fieldset".split())
BLOCK = SPACED | frozenset(
    "html body div section article aside header footer main nav address form li dt dd hr details summary figcaption "
    "legend caption center menu dir option select optgroup textarea dialog hgroup search tr thead tbody tfoot".split()
)
TABLE_PARTS = frozenset("table thead tbody tfoot tr colgroup".split())
#: Start tag: open elements that it closes, and elements beyond which it does not look.
_CELL = frozenset(("td", "th"))
#: Start tags that leave an open head open.
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript noframes template head html".split())
CLOSES = {
    "li": (frozenset(("li",)), frozenset("ul ol menu dir table td th".split())),
    "dt": (frozenset(("dt", "dd")), frozenset("dl table td th".split())),
    "dd": (frozenset(("dt", "dd")), frozenset("dl table td th".split())),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "td": (_CELL, frozenset(("table", "tr"))),
    "th": (_CELL, frozenset(("table", "tr"))),
    "tr": (frozenset(("tr",)) | _CELL, frozenset(("table",))),
    "thead": (frozenset("thead tbody tfoot tr td th caption colgroup".split()), frozenset(("table",))),
    "caption": (frozenset("caption colgroup".split()), frozenset(("table",))),
    "body": (frozenset(("head",)), frozenset(("body",))),
}
CLOSES["tbody"] = CLOSES["tfoot"] = CLOSES["colgroup"] = CLOSES["thead"]
_ENDS_P = BLOCK - frozenset("html body li dt dd option optgroup select textarea caption tr thead tbody tfoot".split()) | frozenset(("li", "dt", "dd"))
_P = (frozenset(("p",)), frozenset("table td th caption button li dd dt object template blockquote div section article body".split()))

#: Foreign elements: those that hold text to be seen, those that pass it on, those that hold HTML, those never seen.
TOKENS = frozenset("mi mn mo ms mtext".split())
TEXTS = frozenset("tspan textpath a tref".split())
HOLDS_HTML = frozenset("foreignobject desc title".split()) | TOKENS
UNSEEN_FOREIGN = frozenset(
    "title desc defs metadata style script symbol clippath mask pattern marker lineargradient radialgradient filter annotation annotation-xml mphantom".split())
#: HTML start tags that end foreign content.
BREAKS_OUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span "
    "strong strike sub sup table tt u ul var".split())

_TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)|<[!?](?P<other>[^>]*)(?:>|\Z)|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))|[^>])*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_SHOWN_BY = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-zA-Z-]+)", re.I)
#: Types of input whose value is a label.
BUTTONS = frozenset("submit reset button".split())
_WHITE = re.compile(r"[ \t\n\f\r]+")


class Node:
    """``kind`` is svg or math in foreign content, else empty; ``shows``: text
    directly in the element is seen."""

    __slots__ = ("tag", "attrs", "children", "kind", "shows")

    def __init__(self, tag: str, attrs: dict[str, str], kind: str = "", shows: bool = True):
        self.tag, self.attrs, self.children, self.kind, self.shows = tag, attrs, [], kind, shows

    def holds_html(self) -> bool:
        if self.tag == "annotation-xml":
            return self.attrs.get("encoding", "").lower() in ("text/html", "application/xhtml+xml")
        return not self.kind or self.tag in HOLDS_HTML and (self.tag in TOKENS) == (self.kind == "math")


def _self_closing(tag: str, attrs: str) -> bool:
    """The slash that ends an unquoted value is part of it, except for svg and
    math, which would take the text behind them along."""
    if not attrs.endswith("/"):
        return False
    return tag in ("svg", "math") or "=" not in attrs.replace('"', " ").replace("'", " ").split()[-1]


def build(html: str) -> Node:
    """The page's tree; children are nodes and texts."""
    root = Node("", {})
    open_: list[Node] = [root]
    places: dict[str, list[int]] = defaultdict(list)  # of the open elements of each tag, in order
    foreign: list[int] = []

    def push(node: Node) -> None:
        places[node.tag].append(len(open_))
        if node.kind:
            foreign.append(len(open_))
        open_.append(node)

    def cut(k: int) -> None:
        """Close the open elements from place ``k`` on."""
        while len(open_) > max(k, 1):
            node = open_.pop()
            places[node.tag].pop()
            if node.kind:
                foreign.pop()

    def last(tags: frozenset) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=0)

    def close(tags: frozenset, barrier: frozenset) -> None:
        """Close the outermost open element of ``tags`` this side of ``barrier``."""
        least = max(last(barrier), foreign[-1] if foreign else 0)
        found = [places[t][i] for t in tags if (i := bisect_right(places[t], least)) < len(places[t])]
        if found:
            cut(min(found))

    def text(s: str) -> None:
        if open_[-1].tag == "head" and s.strip(" \t\n\f\r"):
            cut(len(open_) - 1)
        if open_[-1].tag not in TABLE_PARTS or open_[-1].kind:
            open_[-1].children.append(s)
        elif s.strip():
            # An open table is the last child of the element that it stands in.
            k = places["table"][-1] if places["table"] else 0
            if k:
                open_[k - 1].children.insert(-1, s)
            else:
                root.children.append(s)

    at, headed = 0, False
    while at < len(html):
        m = _TOKEN.search(html, at)
        if m is None:
            text(unescape(html[at:]))
            break
        if m.start() > at:
            text(unescape(html[at : m.start()]))
        at = m.end()
        if open_[-1].kind and html.startswith("<![CDATA[", m.start()):
            end = html.find("]]>", m.start())
            end = len(html) if end < 0 else end
            text(html[m.start() + 9 : end])
            at = end + 3
        elif m["end"]:
            tag = m["end"].lower()
            if tag in ("p", "br"):
                while not open_[-1].holds_html():
                    cut(len(open_) - 1)
            if tag == "br":
                if open_[-1].tag == "head":
                    cut(len(open_) - 1)
                open_[-1].children.append(Node("br", {}))
            else:
                barrier = frozenset() if tag in TABLE_PARTS or tag in ("body", "html") else frozenset(("table",)) if tag in _CELL or tag == "caption" else frozenset(("td", "th", "caption", "table"))
                if places[tag] and places[tag][-1] >= last(barrier):
                    cut(places[tag][-1])
        elif m["start"]:
            tag = m["start"].lower()
            if tag in BREAKS_OUT or tag == "font" and re.search(r"(?i)\b(?:color|face|size)\b", m["attrs"] or ""):
                while not open_[-1].holds_html():
                    cut(len(open_) - 1)
            kind = open_[-1].kind if not open_[-1].holds_html() or tag in ("mglyph", "malignmark") else ""
            kind = tag if tag in ("svg", "math") and (not kind or open_[-1].tag == "annotation-xml") else kind
            if tag == "head" and not kind:
                if headed or open_[-1].tag not in ("", "html"):
                    continue
                headed = True
            elif open_[-1].tag == "head" and tag == "html":
                continue
            elif open_[-1].tag == "head" and tag not in IN_HEAD:
                cut(len(open_) - 1)
            if tag in _ENDS_P and not kind:
                close(*_P)
            if tag in CLOSES and not kind:
                close(*CLOSES[tag])
            attrs = {}
            for name, value in _ATTR.findall(m["attrs"] or ""):
                attrs.setdefault(name.lower(), unescape(value[1:-1] if value[:1] in ("'", '"') else value))
            shows = not kind or (tag in TOKENS if kind == "math" else tag == "text" or tag in TEXTS and open_[-1].kind == "svg" and open_[-1].shows)
            node = Node(tag, attrs, kind, shows)
            open_[-1].children.append(node)
            if kind:
                if not _self_closing(tag, m["attrs"]):
                    push(node)
            elif tag in RAW:
                end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>|\\Z", re.I).search(html, at)
                if tag in ("textarea", "xmp"):
                    node.children.append(unescape(html[at : end.start()]) if tag == "textarea" else html[at : end.start()])
                at = end.end()
            elif tag not in VOID:
                push(node)
    return root


class _Out:
    """Lines of text under construction."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space, self.gap = False, False
        self.indent: list[str] = [""]  # each what its lines begin with
        self.marker: str | None = None

    def _begin(self) -> None:
        if not self.now:
            if self.gap and self.lines and self.lines[-1]:
                self.lines.append("")
            self.gap = False
            lead = self.indent[-1]
            if self.marker is not None:
                lead = lead[: max(len(lead) - len(self.marker), 0)] + self.marker
                self.marker = None
            self.now.append(lead)

    def deeper(self, s: str) -> None:
        self.indent.append(self.indent[-1] + s if len(self.indent[-1]) < PAD else self.indent[-1])

    def words(self, s: str) -> None:
        s = _WHITE.sub(" ", s)
        body = s.strip(" ")
        if s[:1] == " " and self.now:
            self.space = True
        if body:
            started = bool(self.now)
            self._begin()
            self.now.append((" " if self.space and started else "") + body)
            self.space = s[-1] == " "

    def verbatim(self, s: str) -> None:
        for k, part in enumerate(s.replace("\r\n", "\n").split("\n")):
            if k:
                self.end(True)
            if part:
                self._begin()
                self.now.append(part)

    def end(self, empty: bool = False) -> None:
        if self.now:
            self.lines.append("".join(self.now).replace("\xa0", " ").rstrip())
            self.now = []
        elif empty and self.lines:
            self.lines.append("")
        self.space = False

    def block(self, spaced: bool) -> None:
        self.end()
        self.gap |= spaced

    def text(self) -> str:
        self.end()
        lines = self.lines
        while lines and not lines[-1]:
            lines.pop()
        return "\n".join(lines)


def _span(value: str | None, most: int) -> int:
    m = re.match(r"\s*(\d{1,6})", value or "")
    return min(max(int(m[1]), 1), most) if m else 1


def _grid(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Rows of (text, columns, rows) cells as aligned lines."""
    placed, taken = [], {}
    for r, row in enumerate(rows):
        col, line = 0, []
        for text, across, down in row:
            while taken.get(col, 0) > r:
                col += 1
            line.append((col, across, text.split("\n")))
            if down > 1:
                for c in range(col, col + across):
                    taken[c] = max(taken.get(c, 0), r + down)
            col += across
        placed.append(line)
    width: dict[int, int] = {}
    for line in placed:
        for col, across, parts in line:
            if across == 1:
                width[col] = max(width.get(col, 0), min(PAD, max(map(len, parts))))
    starts, at = {}, 0
    for c in range(max((col for line in placed for col, _, _ in line), default=0) + 1):
        starts[c] = at
        at += width[c] + 2 if width.get(c) else 0
    out = []
    for line in placed:
        for k in range(max((len(parts) for _, _, parts in line), default=0)):
            now = ""
            for col, _, parts in line:
                if k < len(parts) and parts[k]:
                    now = now.ljust(starts[col]) if len(now) <= starts[col] else now + "  "
                    now += parts[k]
            out.append(now.rstrip())
    return out


def _shown_by(node: Node) -> dict[str, str]:
    """display and visibility, as far as the element sets them."""
    a = node.attrs
    own = {k: a[k].strip().lower() for k in ("display", "visibility") if k in a} if node.kind else {}
    return own | {k.lower(): v.lower() for k, v in _SHOWN_BY.findall(a["style"])} if "style" in a else own


def _seen(node: Node, parent: Node | None, by: dict[str, str]) -> bool:
    """Whether the element is laid out at all."""
    if by.get("display") == "none":
        return False
    if node.kind:
        return not (node.tag in UNSEEN_FOREIGN and not (node.tag == "annotation-xml" and node.holds_html() and parent.tag != "semantics")) and _open(parent)
    if node.tag in UNSEEN or "hidden" in node.attrs or (node.tag == "dialog" and "open" not in node.attrs):
        return False
    return node.tag == "summary" or _open(parent)


def _open(parent: Node | None) -> bool:
    return parent is None or parent.kind != "" or parent.tag != "details" or "open" in parent.attrs


def render(root: Node) -> str:
    outs = [_Out()]
    tables: list[list] = []  # rows of each open table
    lists: list[list] = []  # [ordered, next number] of each open list
    pre = 0
    todo: list[tuple] = [(root, None, True, False)]  # node, parent, visible, leaving
    while todo:
        node, parent, visible, leaving = todo.pop()
        out = outs[-1]
        if isinstance(node, str):
            if visible and parent.shows and _open(parent):
                (out.verbatim if pre else out.words)(node)
            continue
        tag = node.tag
        grid = bool(tables) and tables[-1] is not None
        if not leaving:
            by = _shown_by(node)
            if not _seen(node, parent, by):
                continue
            visible = {"visible": True, "hidden": False, "collapse": False}.get(by.get("visibility", ""), visible)
            if node.kind:  # inline; separate texts and cells stay apart
                if tag in ("text", "mtd"):
                    out.words(" ")
                todo.append((node, parent, visible, True))
                todo += [(c, node, visible, False) for c in reversed(node.children)]
                continue
            if tag == "br":
                out.end(True)
                continue
            if tag in VOID:
                if tag == "hr":
                    out.block(True)
                elif tag == "input" and visible and node.attrs.get("type", "").strip().lower() in BUTTONS:
                    out.words(f" {node.attrs.get('value', '')} ")
                continue
            if tag in BLOCK:
                out.block(tag in SPACED and not (tag in ("ul", "ol") and lists))
            if tag in ("ul", "ol", "menu", "dir"):
                start = node.attrs.get("start", "")
                lists.append([tag == "ol", int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
            elif tag == "li":
                here = lists[-1] if lists else [False, 1]
                value = node.attrs.get("value", "").strip()
                here[1] = int(value) if re.fullmatch(r"-?\d{1,9}", value) else here[1]
                mark = f"{here[1]}. " if here[0] else "- "
                here[1] += 1
                out.deeper(" " * len(mark))
                out.marker = mark if visible else None
            elif tag in ("blockquote", "dd"):
                out.deeper("  ")
            elif tag in ("pre", "textarea", "xmp"):
                pre += 1
            elif tag == "table":
                tables.append([] if len(tables) < DEEP else None)
            elif tag == "tr" and grid:
                tables[-1].append([])
            elif tag in _CELL and grid:
                if not tables[-1]:
                    tables[-1].append([])
                outs.append(_Out())
            elif tag in _CELL and tables:
                out.block(False)
            todo.append((node, parent, visible, True))
            todo += [(c, node, visible, False) for c in reversed(node.children)]
            continue
        if node.kind:
            if tag in ("text", "mtd"):
                out.words(" ")
            continue
        if tag in _CELL and grid:
            done = outs.pop().text()
            tables[-1][-1].append((done, _span(node.attrs.get("colspan"), 1000), _span(node.attrs.get("rowspan"), 65534)))
            continue
        if tag == "table":
            for line in _grid(tables.pop() or []):
                if line:
                    out.verbatim(line)
                out.end()
        elif tag in ("pre", "textarea", "xmp"):
            pre -= 1
        if tag in BLOCK or (tag in _CELL and tables):
            out.block(tag in SPACED and not (tag in ("ul", "ol") and len(lists) > 1))
        if tag in ("ul", "ol", "menu", "dir"):
            lists.pop()
        elif tag == "li":
            out.indent.pop()
            out.marker = None
        elif tag in ("blockquote", "dd"):
            out.indent.pop()
    return outs[0].text()


def html_to_text(html: str | None) -> str:
    return render(build(html)) if html else ""


def extract(pages: DataFrame, html_col: str = "html", name: str = "text") -> tuple[DataFrame, str]:
    """``pages`` with the rendered text in a new column, whose name is returned
    too; columns of that name keep theirs."""
    out = name if name.lower() not in {c.lower() for c in pages.columns} else fresh(pages, name)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = pa.array([html_to_text(h.as_py()) for h in part.column(html_col)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*part.schema.names, out])

    return pages.mapInArrow(run, StructType([*pages.schema.fields, StructField(out, StringType())])), out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, text = extract(table(spark, sf_dir, "pages").select("page_id", "html"))
    return found.select("page_id", text)
