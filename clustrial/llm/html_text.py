"""HTML extraction: a tree with implied tags, rendered as the page would be laid out."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clustrial.llm.page_styles import StyleSheet, for_screen

_TAG = re.compile(
    r"<!--(?:.*?--!?>|>|->|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>",
    re.S,
)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
HEAD = set("html head title meta link base script style template noscript".split())
HIDDEN = set(
    "head title script style template noscript meta link base iframe noembed noframes object audio video canvas "
    "datalist area param source track".split()
)
#: Parts of graphics and formulas that are not shown in their place.
FOREIGN_HIDDEN = {
    "svg": set("title desc metadata defs symbol clippath mask marker pattern".split()),
    "math": {"annotation", "annotation-xml"},
}
#: Elements of formulas whose parts stand apart, and those that hold text.
PARTS = set("mfrac msub msup msubsup munder mover munderover mroot mtable mtr mlabeledtr mmultiscripts".split())
_MATH_TEXT = set("mi mn mo ms mtext".split())
#: Space above and below, in line ends: blocks 1, paragraphs and the like 2.
SPACE = dict.fromkeys(
    "address article aside body center details dialog dir div dd dl dt fieldset figcaption footer form header hgroup html "
    "legend li main menu nav ol optgroup option search section summary tr tbody thead tfoot caption ul".split(),
    1,
) | dict.fromkeys("blockquote figure h1 h2 h3 h4 h5 h6 hr p pre table xmp textarea".split(), 2)
HEADINGS = {f"h{k}" for k in range(1, 7)}
#: A start tag ends the open elements it names, up to the nearest element that holds them.
_CELLS = {"td", "th"}
IMPLIED: dict[str, tuple[set[str], set[str]]] = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "caption", "colgroup"} | _CELLS, {"table"}),
    "td": (_CELLS, {"tr", "table"}),
    "th": (_CELLS, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "caption", "colgroup"} | _CELLS, {"table"}),
}
IMPLIED["thead"] = IMPLIED["tfoot"] = IMPLIED["tbody"]
_END_BOUNDS = {"table": set()} | dict.fromkeys("td th tr tbody thead tfoot caption".split(), {"table"})
_SCOPE = {"table", "td", "th", "caption", "button", "template", "object", "foreignobject", "desc", "annotation-xml"} | _MATH_TEXT
_CLOSES_P = {t for t, space in SPACE.items() if t not in {"option", "optgroup", "tr", "tbody", "thead", "tfoot", "caption", "legend", "body", "html"}}


class Node:
    """An element: its tag, what its start tag says of its looks, and its children."""

    __slots__ = ("tag", "attrs", "children", "css")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs = tag, attrs
        self.children: list[Node | str] = []
        self.css: list[str] = []  # of the root: the page's style sheets

    def unseen(self, said: dict[str, str]) -> bool:
        """Whether neither the element nor anything in it is laid out; ``said`` is what styles set."""
        if self.tag in HIDDEN or said.get("content-visibility") == "hidden":
            return True
        if "display" in said:  # stronger than what the browser has for these
            return said["display"] == "none"
        return "hidden" in self.attrs or (self.tag == "dialog" and "open" not in self.attrs)

    def shown(self, inherited: bool, kind: str, said: dict[str, str]) -> bool:
        """Visibility, which passes to children and which they may take back."""
        word = said.get("visibility") or (self.attrs.get("visibility", "").lower() if kind != "html" else "")
        return word in {"visible", "initial"} or (inherited and word not in {"hidden", "collapse"})

    def kind_inside(self, kind: str) -> str:
        """What text below is: of a page, of a drawing outside its labels, of a label, or of a formula."""
        if self.tag in {"svg", "math"}:
            return self.tag
        if kind == "svg" and self.tag == "text":
            return "label"
        if (kind in {"svg", "label"} and self.tag == "foreignobject") or (kind == "math" and self.tag in _MATH_TEXT):
            return "html"
        return kind


_GAP = Node(" ", {})


def parse(html: str) -> Node:
    """The tree of a page; end tags that are left out are implied, stray ones ignored."""
    root = Node("html", {})
    stack = [root]
    sheets: list[str] = []
    opened: Counter[str] = Counter()  # tags on the stack

    def push(node: Node) -> None:
        stack[-1].children.append(node)
        stack.append(node)
        opened[node.tag] += 1

    def close(tags: set[str], bounds: set[str], innermost: bool = False) -> bool:
        """End the outermost, or innermost, open element of ``tags`` above the nearest of ``bounds``."""
        if not any(opened[t] for t in tags):
            return False
        found = 0
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                found = k
                if innermost:
                    break
            elif stack[k].tag in bounds:
                break
        if found:
            opened.subtract(node.tag for node in stack[found:])
            del stack[found:]
        return bool(found)

    at, n, last = 0, len(html), html.rfind(">")
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            text = unescape(html[at:lt])
            if stack[-1].tag == "head" and text.strip():
                close({"head"}, set())
            stack[-1].children.append(text)
            at = lt
            continue
        m = _TAG.match(html, at) if at < last else None
        if not m:
            stack[-1].children.append("<")
            at += 1
            continue
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag == "br":
                stack[-1].children.append(Node("br", {}))
            elif tag in HEADINGS:
                close(HEADINGS, _SCOPE, True)
            elif not close({tag}, _END_BOUNDS.get(tag, _SCOPE), True) and tag == "p":
                stack[-1].children.append(Node("p", {}))
            continue
        if not m[2]:
            continue
        tag = m[2].lower()
        attrs = {a[1].lower(): unescape((a[2] or "").strip("\"'")) for a in _ATTR.finditer(m[3])} if m[3] else {}
        if tag == "html" or (tag == "body" and opened["body"]):
            continue
        if tag not in HEAD:
            close({"head"}, set())
        if tag in _CLOSES_P:
            close({"p"}, _SCOPE)
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            close({stack[-1].tag}, set(), True)
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if tag in _CELLS and stack[-1].tag in {"table", "tbody", "thead", "tfoot"}:
            push(Node("tr", {}))
        node = Node(tag, attrs)
        if tag in RAW:
            stack[-1].children.append(node)
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            inner = html[at : end.start() if end else n]
            node.children.append(unescape(inner) if tag in {"textarea", "title"} else inner)
            at = end.end() if end else n
            # A page that runs scripts does not read the sheets of noscript.
            if tag == "style" and not (opened["noscript"] or opened["template"]) and for_screen(attrs.get("media")):
                sheets.append(inner)
        elif tag in VOID or (tag not in SPACE and m[3].endswith("/")):
            stack[-1].children.append(node)
        else:
            push(node)
    root.css = sheets
    return root


class Writer:
    """Lines of text: white space collapsed, space between blocks, list markers and indents."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.blank = False  # white space waits for the next word
        self.space = 0  # line ends before the next text
        self.indents: list[str] = []
        self.marker: str | None = None

    def _begin(self) -> None:
        if self.line:
            return
        if self.space > 1 and self.lines:
            self.lines.append("")
        self.space = 0
        prefix = "".join(self.indents)
        if self.marker is not None:
            prefix, self.marker = prefix[: len(prefix) - len(self.marker)] + self.marker, None
        self.line.append(prefix)
        self.blank = False

    def text(self, text: str) -> None:
        words = text.split()
        if not words:
            self.blank = self.blank or bool(text)
            return
        new = not self.line
        self._begin()
        if not new and (self.blank or text[0].isspace()):
            self.line.append(" ")
        self.line.append(" ".join(words))
        self.blank = text[-1].isspace()

    def end_line(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        self.blank = False

    def apart(self, space: int) -> None:
        self.end_line()
        self.space = max(self.space, space)

    def line_break(self) -> None:
        if self.line:
            self.end_line()
        elif self.lines:
            self.space = max(self.space, 2)

    def as_is(self, lines: list[str]) -> None:
        for line in lines:
            self._begin()
            self.line.append(line)
            self.end_line()

    def result(self) -> list[str]:
        self.end_line()
        return self.lines


def _aligned(rows: list[list[list[str]]]) -> list[str]:
    """Rows of cells of lines, columns as wide as their widest line, two spaces apart."""
    width: list[int] = []
    for row in rows:
        for k, cell in enumerate(row):
            most = max(map(len, cell), default=0)
            width[k:] = [max(width[k], most), *width[k + 1 :]] if k < len(width) else [most]
    out = []
    for row in rows:
        for at in range(max(map(len, row), default=0)):
            parts = [(cell[at] if at < len(cell) else "").ljust(width[k]) for k, cell in enumerate(row)]
            out.append("  ".join(parts).rstrip())
    return out


def render(root: Node) -> str:
    """All visible text of a tree, walked without recursion however deep it is."""
    styles = StyleSheet(root.css)
    writers = [Writer()]
    tables: list[list[list[list[str]]]] = []
    spans: list[dict[int, float]] = []  # for each table, the last row that a cell of a column reaches
    looks: list[tuple[bool, str]] = [(True, "html")]  # visibility and kind of text of the open elements
    lists: list[list] = []  # [next number or None]
    pre = 0
    todo: list[tuple[Node | str, bool]] = [(root, False)]
    while todo:
        node, closing = todo.pop()
        w = writers[-1]
        if isinstance(node, str):
            shown, kind = looks[-1]
            if not shown or kind == "svg" or (kind == "math" and not node.strip()):
                continue
            if not pre:
                w.text(node)
            else:
                first, *rest = node.split("\n")
                for k, line in enumerate([first, *rest]):
                    if k:
                        w.end_line() if w.line else w.as_is([""])
                    if line:
                        w._begin()
                        w.line.append(line)
            continue
        tag = node.tag
        if not closing:
            if tag == "br":
                w.line_break()
                continue
            if node is _GAP:
                w.blank = True
                continue
            if tag == "img" or tag in {"input", "wbr"}:
                continue
            said = styles.says(tag, node.attrs)
            if node.unseen(said):
                continue
            inherited, kind = looks[-1]
            if tag in FOREIGN_HIDDEN.get("svg" if kind == "label" else kind, ()):
                continue
            if kind in {"svg", "label"} and node.attrs.get("display", "").strip().lower() == "none" and "display" not in said:
                continue
            shown = node.shown(inherited, kind, said)
            if tag in _CELLS and tables:
                if not tables[-1]:
                    tables[-1].append([])
                writers.append(Writer())
            else:
                if tag in SPACE:
                    w.apart(1 if lists and SPACE[tag] == 2 and tag != "table" else SPACE[tag])
                elif tag in {"select", "button"}:
                    w.blank = True
            if tag == "hr":
                if shown:
                    w.as_is(["---"])
                w.apart(2)
                continue
            looks.append((shown, node.kind_inside(kind)))
            if tag in {"pre", "xmp", "textarea"}:
                pre += 1
                if node.children and isinstance(node.children[0], str):
                    node.children[0] = node.children[0].removeprefix("\n")
            elif tag in {"ul", "ol", "menu", "dir"}:
                start = node.attrs.get("start", "1")
                lists.append([int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1] if tag == "ol" else [None])
            elif tag == "li":
                number = lists[-1][0] if lists else None
                marker = "- " if number is None else f"{number}. "
                if number is not None:
                    lists[-1][0] += 1
                w.indents.append(" " * len(marker))
                if shown:
                    w.marker = marker
            elif tag in {"blockquote", "dd"}:
                w.indents.append("  ")
            elif tag == "table":
                tables.append([])
                spans.append({})
            elif tag in {"tbody", "thead", "tfoot"} and tables:
                spans[-1].clear()
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif (tag == "text" and kind == "svg") or (tag == "tspan" and not {"x", "y", "dy"}.isdisjoint(node.attrs)):
                w.blank = True
            todo.append((node, True))
            children = node.children
            if tag == "details" and "open" not in node.attrs:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
            if looks[-1][1] == "math" and tag in PARTS:
                parts = [c for c in children if isinstance(c, Node)]
                children = [x for c in parts for x in (_GAP, c)]
            todo.extend((c, False) for c in reversed(children))
            continue
        shown, kind = looks.pop()
        if tag in _CELLS and tables:
            lines = writers.pop().result()
            row, at, reach = tables[-1][-1], len(tables[-1]) - 1, spans[-1]
            while reach.get(len(row), -1) >= at:
                row.append([])
            first = len(row)
            row.append(lines)
            span = node.attrs.get("colspan", "1")
            row += [[]] * (min(int(span), 100) - 1 if re.fullmatch(r"\d{1,4}", span) else 0)
            deep = node.attrs.get("rowspan", "1").strip()
            if deep != "1" and re.fullmatch(r"\d{1,5}", deep):
                last = at + int(deep) - 1 if int(deep) else float("inf")  # 0 reaches to the end of the rows' group
                reach.update(dict.fromkeys(range(first, len(row)), last))
            continue
        if tag in {"pre", "xmp", "textarea"}:
            pre -= 1
        elif tag in {"ul", "ol", "menu", "dir"}:
            lists.pop()
        elif tag == "li":
            if w.marker is not None and shown:
                w._begin()
            w.end_line()
            w.indents.pop()
        elif tag in {"blockquote", "dd"}:
            w.end_line()
            w.indents.pop()
        elif tag == "table":
            w.apart(1)
            spans.pop()
            w.as_is(_aligned([r for r in tables.pop() if any(any(c) for c in r)]))
        elif kind == "label" and tag == "text":
            w.blank = True
        if tag in SPACE:
            w.apart(1 if lists and SPACE[tag] == 2 and tag != "table" else SPACE[tag])
    return "\n".join(writers[0].result())


def extract(df: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """``page_id, text`` of every row: the visible text of the page, laid out in lines.

    Blocks stand on lines of their own and paragraphs apart, list items have their marker
    and indent, and the cells of a table are aligned in columns, below cells that span rows
    too. Formulas give their text, graphics that of their labels. Hidden elements, scripts,
    styles and the head give nothing. The page's own style sheets count for ``display`` and
    ``visibility`` where a selector is one element's tag, classes and id; sheets in other
    files, selectors over several elements, and rules for print or for a window's size do
    not. What is made visible inside ``visibility: hidden`` is
    shown. Text that a graphic repeats by ``use`` is not. Missing pages stay missing, empty ones empty. Pages
    are worked on one by one, without a shuffle.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = (batch.column(1)[k].as_py() for k in range(batch.num_rows))
            texts = [None if p is None else render(parse(p)) for p in pages]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["page_id", "text"])

    picked = df.select(F.col(id_column).cast("long").alias("page_id"), F.col(html_column).alias("html"))
    return picked.mapInArrow(work, "page_id long, text string")
