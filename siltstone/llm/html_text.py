"""HTML to text as a page shows it: a tree builder with implied tags, visibility rules, and a renderer that keeps
block spacing, list markers and the columns of tables. Pages may be nested as deep as they like: neither the builder nor
the renderer recurses. Reading a page takes time in proportion to its length."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from siltstone.llm.common import table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that show no text. A noscript element is hidden, as where scripts run.
HIDDEN = frozenset("head script style title template noscript iframe object video audio canvas noembed noframes datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul xmp caption".split()
)
#: Blocks with a blank line before and after.
SPACED = frozenset("p blockquote dl figure h1 h2 h3 h4 h5 h6 ol pre ul menu table fieldset hr".split())
#: Start tags that end an open p.
ENDS_P = BLOCK - frozenset("td th tr tbody thead tfoot caption option optgroup html body legend".split())
#: Start tag: the open elements that it ends, and those beyond which it doesn't look.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
#: Elements that show no text inside drawings and formulas.
UNSHOWN = {"svg": frozenset("title desc metadata defs symbol".split()), "math": frozenset("annotation annotation-xml".split())}
#: Elements that an end tag inside them can't close from within.
SCOPE = frozenset("table td th caption html template".split())

#: Elements without a layout of their own, whose end tag may come while a block is open inside them.
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
#: End tags that close their element across the limits of SCOPE.
_ACROSS = frozenset("table tr tbody thead tfoot body html".split())
_ENDS_P_WITHIN = SCOPE | {"button", "li", "div"}

#: Where a tag (end mark, name), a declaration or a comment begins; other '<' are text.
_OPENS = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|[!?/])")
_GAP = re.compile(r"[\s/]*")
_NAME = re.compile(r"=?[^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_UNQUOTED = re.compile(r"[^\s>]*")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I | re.A) for tag in RAW}
_BLANKS = re.compile(r"[ \t\n\f\r]+")
_INVISIBLE = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*([a-z]+)", re.I)
_COMMENT_END = re.compile("--!?>")


class Node:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def read_tag(source: str, pos: int) -> tuple[dict[str, str], bool, int]:
    """Attributes of the tag whose name ends at pos (the first of each name holds), whether it closes itself, and where it ends. A tag
    that the page's end cuts is no tag: None. A quote that never ends is an ordinary character."""
    attributes: dict[str, str] = {}
    if source[pos : pos + 1] == ">":
        return attributes, False, pos + 1
    n = len(source)
    while True:
        gap = _GAP.match(source, pos).end()
        if gap >= n:
            return attributes, False, n
        if source[gap] == ">":
            return attributes, source[gap - 1] == "/" and gap > pos, gap + 1
        name = _NAME.match(source, gap)
        pos, value = name.end(), ""
        if equals := _EQUALS.match(source, pos):
            pos = equals.end()
            quote = source[pos : pos + 1]
            close = source.find(quote, pos + 1) if quote in ("'", '"') else -1
            if close >= 0:
                value, pos = source[pos + 1 : close], close + 1
            else:
                found = _UNQUOTED.match(source, pos)
                value, pos = found[0], found.end()
        attributes.setdefault(name[0].lower(), html.unescape(value))


class _Builder:
    """The open elements, and where each tag is among them."""

    def __init__(self) -> None:
        self.root = Node("html", {})
        self.stack = [self.root]
        self.places: dict[str, list[int]] = defaultdict(list)
        self.styled = False  # whether an element says how visible it is

    def last(self, tags: Iterable[str]) -> int:
        """Place of the innermost open element with one of the tags; 0 if there is none but the root."""
        found, places = 0, self.places
        for tag in tags:
            if (own := places.get(tag)) and own[-1] > found:
                found = own[-1]
        return found

    def open(self, node: Node) -> None:
        self.places[node.tag].append(len(self.stack))
        self.stack.append(node)

    def close_to(self, at: int) -> None:
        while len(self.stack) > at:
            self.places[self.stack.pop().tag].pop()

    def end(self, tag: str) -> None:
        """An end tag; one that fits nothing open is ignored."""
        at = self.last((tag,))
        if not at or (tag not in _ACROSS and at < self.last(SCOPE)):
            return
        block = next((k for k in range(at + 1, len(self.stack)) if self.stack[k].tag in BLOCK), None) if tag in FORMATTING else None
        if block is None:
            self.close_to(at)
            return
        # the block stays open beside the formatting element, whose part inside the block goes on in a copy that ends here
        inner, own = self.stack[block], self.stack[at]
        self.stack[block - 1].children.pop()
        self.stack[at - 1].children.append(inner)
        copy = Node(own.tag, own.attributes)
        copy.children, inner.children = inner.children, [copy]
        rest = self.stack[block:]
        self.close_to(at)
        for node in rest:
            self.open(node)

    def start(self, tag: str, attributes: dict[str, str], closed: bool) -> Node | None:
        """A start tag and what it implies; the element, or None for a repeated html or body."""
        if tag == "html":
            self.root.attributes |= attributes
            return None
        if tag == "body":
            if head := self.last(["head"]):
                self.close_to(head)
            if self.places["body"]:
                return None
        elif len(self.stack) == 2 and self.stack[1].tag == "head" and tag in BLOCK:
            self.close_to(1)  # a head ends where the content begins
        if tag in ENDS_P and (p := self.last(("p",))) and p > self.last(_ENDS_P_WITHIN):
            self.close_to(p)
        if tag in IMPLIED:
            ends, limits = IMPLIED[tag]
            limit = self.last(limits)
            inside = [places[k] for t in ends if (places := self.places[t]) and (k := bisect_right(places, limit)) < len(places)]
            if inside:
                self.close_to(min(inside))
        if any(tag in unshown and self.places[x] for x, unshown in UNSHOWN.items()):
            attributes["hidden"] = ""
        if "style" in attributes and _VISIBILITY.search(attributes["style"]):
            self.styled = True
        node = Node(tag, attributes)
        self.stack[-1].children.append(node)
        foreign = closed and (tag in ("svg", "math") or self.places["svg"] or self.places["math"])  # the slash of other elements means nothing
        if tag not in VOID and tag not in RAW and not foreign:
            self.open(node)
        return node


def parse(source: str) -> Node:
    """Tree of a whole page. Tags that don't fit are mended the way browsers do: implied ends, ignored stray ends, blocks that outlive the
    formatting around them."""
    builder = _Builder()
    pos, n = 0, len(source)
    while pos < n:
        opens = _OPENS.search(source, pos)
        at = opens.start() if opens else n
        if at > pos:
            builder.stack[-1].children.append(html.unescape(source[pos:at]))
        if at == n:
            break
        if not opens[2]:  # a comment, a declaration, or a comment in disguise
            if not source.startswith("<!--", at):
                close = source.find(">", at)
                pos = close + 1 if close >= 0 else n
            elif source.startswith((">", "->"), at + 4):  # a comment of nothing
                pos = source.index(">", at) + 1
            else:
                found = _COMMENT_END.search(source, at + 4)
                pos = found.end() if found else n
            continue
        ends, tag = opens[1], opens[2].lower()
        attributes, closed, pos = read_tag(source, opens.end())
        if ends:
            if tag == "br":
                builder.stack[-1].children.append(Node("br", {}))
            else:
                builder.end(tag)
            continue
        node = builder.start(tag, attributes, closed)
        if node is not None and tag in RAW:
            found = _RAW_END[tag].search(source, pos)
            inner = source[pos : found.start() if found else n]
            node.children.append(html.unescape(inner) if tag in ("textarea", "title") else inner)
            close = source.find(">", found.end()) if found else -1
            pos = close + 1 if close >= 0 else n
    if builder.styled:
        _inherit_visibility(builder.root)
    return builder.root


def _inherit_visibility(root: Node) -> None:
    """Elements within an invisible one are invisible unless they say otherwise. One without a visible element inside is hidden as a whole; one with such loses
    its own text."""
    order, states = [root], [False]
    for i, node in enumerate(order):  # grows as it is read: parents come first
        styled = _VISIBILITY.findall(node.attributes.get("style") or "")
        if styled and (last := styled[-1].lower()) in ("hidden", "collapse", "visible"):
            states[i] = last != "visible"
        inside = [c for c in node.children if not isinstance(c, str)]
        order += inside
        states += [states[i]] * len(inside)
    shown: set[int] = set()
    for node, hidden in zip(reversed(order), reversed(states), strict=True):
        inside = any(id(c) in shown for c in node.children if not isinstance(c, str))
        if not hidden or inside:
            shown.add(id(node))
            if hidden:
                node.children = [c for c in node.children if not isinstance(c, str)]
        else:
            node.attributes["hidden"] = ""


def elements(root: Node) -> Iterator[Node]:
    """All elements in the order of the page."""
    open_ = [iter([root])]
    while open_:
        node = next(open_[-1], None)
        if node is None:
            open_.pop()
        elif not isinstance(node, str):
            yield node
            open_.append(iter(node.children))


def visible(node: Node) -> bool:
    a = node.attributes
    return not (node.tag in HIDDEN or "hidden" in a or (node.tag == "input") or (node.tag == "dialog" and "open" not in a) or ("style" in a and _INVISIBLE.search(a["style"])))


class _Page:
    """Lines with collapsed white space; blank lines between spaced blocks collapse to one. Items and quotes write to the page that
    holds them, with an indent."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.margin = False
        self.blank = True  # whether the current line is empty or ends with a blank
        self.indent = 0
        self.marks: list[str] = []  # of items whose first line is still to come
        self.fresh = False  # whether an item or quote has begun and has no line yet

    def text(self, value: str, pre: bool) -> None:
        if pre:
            first, *rest = value.split("\n")
            self.put(first)
            for line in rest:
                self.end_line(True)
                self.put(line)
            return
        value = _BLANKS.sub(" ", value)
        if self.blank and value[:1] == " ":
            value = value[1:]
        self.put(value)

    def put(self, value: str) -> None:
        if value:
            self.parts.append(value)
            self.blank = value[-1] == " "

    def end_line(self, always: bool = False) -> None:
        line = "".join(self.parts).rstrip(" \t\r\f")
        self.parts.clear()
        self.blank = True
        if line.strip() or (always and not self.fresh):
            self.add([line])

    def add(self, lines: list[str]) -> None:
        if self.margin and self.lines and self.lines[-1]:
            self.lines.append("")
        self.margin = self.fresh = False
        for line in lines:
            if self.marks and line:
                own = "".join(self.marks)
                line = " " * (self.indent - len(own)) + own + line
                self.marks.clear()
            elif line:
                line = " " * self.indent + line
            self.lines.append(line)

    def block(self, spaced: bool) -> None:
        self.end_line()
        if not self.fresh:
            self.margin |= spaced

    def enter(self, width: int, mark: str = "") -> tuple[int, bool, bool]:
        """Begins an item or a quote."""
        self.end_line()
        before = (len(self.lines), self.margin, self.fresh)
        self.indent += width
        if mark:
            self.marks.append(mark)
        self.fresh = True
        return before

    def leave(self, width: int, mark: str, before: tuple[int, bool, bool]) -> bool:
        """Ends it; whether it had a line. Blank lines at its end go."""
        self.end_line()
        self.indent -= width
        start, margin, fresh = before
        if len(self.lines) > start:
            while not self.lines[-1].strip():
                self.lines.pop()
            self.margin = self.fresh = False
            return True
        if mark:
            self.marks.pop()
        self.margin, self.fresh = margin, fresh
        return False

    def done(self) -> list[str]:
        self.end_line()
        lines = self.lines
        first, last = 0, len(lines)
        while last and not lines[last - 1].strip():
            last -= 1
        while first < last and not lines[first].strip():
            first += 1
        return lines[first:last]


#: A step of the renderer: it yields the steps to be taken before it goes on.
_Step = Iterator["_Step"]


def _take(step: _Step) -> None:
    """Takes a step and all within it, without recursion."""
    open_ = [step]
    while open_:
        inner = next(open_[-1], None)
        if inner is None:
            open_.pop()
        else:
            open_.append(inner)


SECTIONS = ("thead", "tbody", "tfoot")


def _sections(node: Node) -> list[list[Node]]:
    """Rows of a table, by section: heads first, then bodies, then feet; captions aside. Cells without a row form one."""
    parts: dict[str, list[list[Node]]] = {x: [] for x in SECTIONS}
    open_ = [(node, "tbody")]
    while open_:
        part, kind = open_.pop()
        rows: list[Node] = []
        parts[kind].append(rows)
        loose: Node | None = None
        later = []
        for child in part.children:
            if isinstance(child, str) or not visible(child):
                continue
            if child.tag in ("td", "th"):
                if loose is None:
                    loose = Node("tr", {})
                    rows.append(loose)
                loose.children.append(child)
                continue
            loose = None
            if child.tag == "tr":
                rows.append(child)
            elif child.tag in parts:
                later.append((child, child.tag))
        open_ += reversed(later)
    return [rows for kind in SECTIONS for rows in parts[kind] if rows]


def _strays(node: Node, page: _Page) -> _Step:
    """What stands in a table, section or row and isn't a part of it."""
    for child in node.children:
        if isinstance(child, str):
            page.text(child, False)
        elif child.tag in SECTIONS or child.tag in ("tr", "colgroup"):
            if visible(child):
                yield _strays(child, page)
        elif child.tag not in ("td", "th"):
            yield _render(child, page, False)


def _number(node: Node, name: str, most: int) -> int:
    """A span; 0 stands for all that follow."""
    value = node.attributes.get(name, "1").strip()
    found = int(value) if value.isascii() and value.isdecimal() and len(value) < 9 else 1
    return min(found or (most if name == "rowspan" else 1), most)


def _table(node: Node, page: _Page) -> _Step:
    yield _strays(node, page)  # before the table
    page.block(False)
    grid = []
    for rows in _sections(node):
        held: dict[int, int] = {}  # columns that cells of rows above still take, and for how many rows
        for row in rows:
            cells, column, new = [], 0, {}
            for cell in row.children:
                if isinstance(cell, str) or cell.tag not in ("td", "th") or not visible(cell):
                    continue
                while column in held:
                    column += 1
                inner = _Page()
                yield _children(cell, inner, False)
                span, down = _number(cell, "colspan", 1000), _number(cell, "rowspan", 65534)
                cells.append((column, span, inner.done()))
                if down > 1:
                    new.update((c, down) for c in range(column, column + span))
                column += span
            held = {c: k - 1 for c, k in (held | new).items() if k > 1}
            grid.append(cells)
    starts = sorted({column for cells in grid for column, _, _ in cells})
    widths = dict.fromkeys(starts, 0)
    for cells in grid:
        for column, span, lines in cells:
            if bisect_right(starts, column + span - 1) == bisect_right(starts, column):  # one column only
                widths[column] = max(widths[column], max(map(len, lines), default=0))
    for column, span, lines in sorted((cell for cells in grid for cell in cells), key=lambda c: c[1]):
        own = starts[bisect_right(starts, column) - 1 : bisect_right(starts, column + span - 1)]
        lack = max(map(len, lines), default=0) - sum(widths[c] + 2 for c in own) + 2
        for k, c in enumerate(own if lack > 0 else ()):  # a wide cell widens its columns alike, the last ones first
            widths[c] += (lack + k) // len(own)
    offsets, at = {}, 0
    for column in starts:
        offsets[column], at = at, at + widths[column] + 2
    out = []
    for cells in grid:
        for k in range(max((len(lines) for _, _, lines in cells), default=0)):
            line = ""
            for column, _, lines in cells:
                if k < len(lines) and lines[k]:
                    line = (line + "  " if line else "").ljust(offsets[column]) + lines[k]
            out.append(line.rstrip())
    if out:
        page.add(out)


def _list(node: Node, page: _Page) -> _Step:
    start = node.attributes.get("start", "1").strip()
    number = int(start) if re.fullmatch("-?[0-9]{1,9}", start) else 1
    for child in node.children:
        if isinstance(child, str):
            page.text(child, False)
        elif child.tag == "li" and visible(child):
            page.block(False)
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            before = page.enter(len(mark), mark)
            yield _children(child, page, False)
            page.leave(len(mark), mark, before)
        else:
            yield _render(child, page, False)


def _render(node: Node, page: _Page, pre: bool) -> _Step:
    tag = node.tag
    if not visible(node):
        return
    if tag == "br":
        page.end_line(True)
    elif tag in VOID and tag != "hr":
        return
    elif tag in BLOCK:
        page.block(tag in SPACED)
        if tag == "table":
            yield _table(node, page)
        elif tag in ("ul", "ol", "menu", "dir"):
            yield _list(node, page)
        elif tag in ("blockquote", "dd"):
            before = page.enter(2)
            yield _children(node, page, pre)
            page.leave(2, "", before)
        elif tag == "details" and "open" not in node.attributes:
            for child in node.children:
                if not isinstance(child, str) and child.tag == "summary":
                    yield _render(child, page, pre)
                    break
        else:
            yield _children(node, page, pre or tag in ("pre", "xmp"))
        page.block(tag in SPACED)
    else:
        yield _children(node, page, pre or tag == "textarea")


def _children(node: Node, page: _Page, pre: bool) -> _Step:
    for child in node.children:
        if isinstance(child, str):
            page.text(child, pre)
        elif child.children or child.tag in VOID:
            yield _render(child, page, pre)
        elif child.tag in BLOCK and visible(child):  # an empty block only ends a line
            page.block(child.tag in SPACED)


def render_tree(root: Node) -> str:
    page = _Page()
    if visible(root):
        _take(_children(root, page, False))
    return "\n".join(page.done())


def render(source: str | None) -> str:
    """Visible text of a page; a null or empty page has none."""
    return render_tree(parse(source or ""))


def html_text(df: DataFrame, id_column: str = "page_id", source: str = "html") -> DataFrame:
    """(page_id, text, n_lines, n_chars) per row of df. Null and empty pages give an empty text and 0 lines; repeated rows
    are rendered each; other columns aren't read; nothing is shuffled. Very long and very deep pages are rendered whole; a task holds a
    page and its tree."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [render(x) for x in batch["_html"]]
            yield pd.DataFrame({"page_id": batch["_id"], "text": texts, "n_lines": [t.count("\n") + 1 if t else 0 for t in texts], "n_chars": [len(t) for t in texts]})

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(df[id_column].alias("_id"), df[source].alias("_html")).mapInPandas(run, f"page_id {kind}, text string, n_lines long, n_chars long")


def op9_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(table(spark, sf_dir, "pages"))
