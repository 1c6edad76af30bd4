"""Visible text of web pages, laid out.

A tolerant tree builder reads the page: void elements, raw text, implied ends
(a block ends an open paragraph, an item the item before it, a cell the cell
before it), implied parts of tables (a cell without a row, a row without a
body), end tags that match nothing. Visibility follows the elements that are
never shown, the ``hidden`` attribute, closed ``details`` and ``dialog``, and
``display: none`` and ``visibility`` from style attributes and from simple
selectors (name, class, id and their combinations) of the page's style sheets,
but for blocks that do not hold on a screen. The text of what is visible comes out with blank lines around paragraphs and
headings, line breaks around other blocks, marked and indented list items,
cells of a table padded to the width of their column, and preformatted text
as it stands. Reading a page takes time in proportion to its length, whatever
tags it leaves open.

Two parameters bound the layout and lose no text: cells of more than ``wide``
code points do not widen their column, and no cell gets more padding than that;
tables inside more than ``deep`` others are laid out as plain blocks.

Nulls: a null or empty page has an empty text. A null id is kept. Rows that
repeat are laid out alike; there are no ties to break, as a page's text depends
on the page alone. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, text_chunks

NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
ENDING = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
BRACE = re.compile(r"[{};]")
COMMENT = re.compile(r"/\*.*?(?:\*/|$)", re.S)
SELECTOR = re.compile(r"^([a-z][a-z0-9-]*|\*)?((?:[.#][\w-]+)*)$", re.I)
SPACES = re.compile(r"[ \t\n\r\f]+")
#: Tables in tables that are laid out as tables; code points of a cell that count for its column; the largest colspan.
DEEP, WIDE, SPAN = 40, 100, 1000

# Element names by the part they play in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript textarea title".split())
UNSEEN = frozenset(
    "head script style template noscript meta link title base iframe noembed noframes audio video canvas desc defs metadata datalist param source track area map rp".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr".split())
BLOCK = SPACED | frozenset(
    "html body div section article aside nav header footer main address form fieldset legend details summary dialog figcaption li dt dd tr td th thead tbody tfoot caption center menu dir search hgroup option optgroup".split()
)
ENDS_PARAGRAPH = BLOCK - frozenset("html body tr td th thead tbody tfoot caption option optgroup".split())
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th", "caption"}, {"tr", "table"}),
    "th": ({"td", "th", "caption"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, set()),
}
FENCE = frozenset("table td th caption button object html".split())


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.kids = tag, attrs, []

    def named(self) -> dict[str, str]:
        if not self.attrs or self.attrs.isspace():
            return {}
        return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in reversed(list(ATTRIBUTE.finditer(self.attrs)))}


class Open(list):
    """The open elements, outermost first, and how many there are of each name."""

    def __init__(self, root: Node):
        super().__init__([root])
        self.count = Counter()

    def push(self, node: Node) -> None:
        self[-1].kids.append(node)
        self.append(node)
        self.count[node.tag] += 1

    def cut(self, at: int) -> None:
        """End the element at this place and all in it."""
        for node in self[at:]:
            self.count[node.tag] -= 1
        del self[at:]

    def close(self, tags: set[str], until: set[str] | frozenset[str]) -> None:
        """End the innermost open element of ``tags``, and those of ``tags`` right around it, unless one of ``until`` comes first."""
        if not any(self.count[t] for t in tags):
            return
        for i in range(len(self) - 1, 0, -1):
            if self[i].tag in tags:
                while i > 1 and self[i - 1].tag in tags:
                    i -= 1
                self.cut(i)
                return
            if self[i].tag in until:
                return


class Scanner:
    """Tags of a page in one pass: (start, end, name with its slash, attributes); comments and declarations have no name."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        # Readings that met no end of a tag: where their quotes stand. A tag that begins outside the quotes of one of
        # them ends nowhere either. Readings that differ never meet, so there are three at most.
        self.lost: list[tuple[list[int], list[int]]] = []

    def close(self, at: int) -> int:
        """The first ``>`` outside quotes, -1 if there is none."""
        for opened, closed in self.lost:
            k = bisect.bisect_right(opened, at) - 1
            if k < 0 or closed[k] < at:
                return -1
        opened, closed = [], []
        while True:
            mark = ENDING.search(self.page, at)
            if mark is None:
                break
            if mark[0] == ">":
                return mark.start()
            opened.append(mark.start())
            at = self.page.find(mark[0], mark.end())
            if at < 0:
                closed.append(len(self.page))
                break
            closed.append(at)
            at += 1
        self.lost.append((opened, closed))
        return -1

    def next(self, at: int) -> tuple[int, int, str, str] | None:
        page = self.page
        while (at := page.find("<", at)) >= 0:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                return at, len(page) if end < 0 else end + 3, "", ""
            if at > self.last:
                return None
            if page[at + 1 : at + 2] in ("!", "?"):
                return at, page.find(">", at) + 1, "", ""
            name = NAME.match(page, at + 1)
            if name:
                end = self.close(name.end())
                if end < 0:  # a quote that never ends: the tag ends at the first sign that could end it
                    end = page.find(">", name.end())
                return at, end + 1, name[0], page[name.end() : end]
            at += 1
        return None


def parse(page: str) -> tuple[Node, list[str]]:
    """The tree of a page, and its style sheets."""
    root = Node("#root")
    open_, sheets, at, size = Open(root), [], 0, len(page)
    scanner = Scanner(page)
    while at < size:
        found = scanner.next(at)
        if found is None:
            open_[-1].kids.append(page[at:])
            break
        if found[0] > at:
            open_[-1].kids.append(page[at : found[0]])
        at = found[1]
        tag = found[2].lower()
        if not tag:
            continue
        if tag[0] == "/":
            tag = tag[1:]
            if tag == "br":
                open_[-1].kids.append(Node("br"))
                continue
            if not open_.count[tag]:
                if tag == "p":
                    open_[-1].kids.append(Node("p"))
                continue
            fenced = tag not in ("table", "tr", "td", "th", "thead", "tbody", "tfoot", "html", "body")
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].tag == tag:
                    open_.cut(i)
                    break
                if open_[i].tag in (("td", "th", "caption") if fenced else ("table",)):
                    break
            continue
        if tag in ("html", "body") and any(n.tag == tag for n in open_[1:4]):
            continue
        if tag in ENDS_PARAGRAPH:
            open_.close({"p"}, FENCE)
        if tag in CLOSED_BY:
            open_.close(*CLOSED_BY[tag])
        if tag in ("td", "th") and open_[-1].tag in ("table", "thead", "tbody", "tfoot"):
            if open_[-1].tag == "table":
                open_.push(Node("tbody"))
            open_.push(Node("tr"))
        elif tag == "tr" and open_[-1].tag == "table":
            open_.push(Node("tbody"))
        node = Node(tag, found[3])
        if tag not in VOID and tag not in RAW:
            open_.push(node)
            continue
        open_[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            inner = page[at : end.start() if end else size]
            at = page.find(">", end.end()) + 1 if end else size
            at = at or size
            if tag == "style":
                sheets.append(inner)
            elif tag not in UNSEEN:
                node.kids.append(inner)
    return root, sheets


def declared(style: str) -> tuple[bool, bool | None]:
    """Whether a declaration takes the element away, and whether it hides (True) or shows (False) its text."""
    style = style.lower().replace(" ", "").replace("\n", "")
    hides = None
    if "visibility:" in style:
        value = style.rpartition("visibility:")[2]
        hides = value.startswith(("hidden", "collapse"))
    return "display:none" in style, hides


def blocks(sheet: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of a style sheet, those in blocks that hold on a screen among them."""
    sheet = COMMENT.sub("", sheet)
    start, depth, skip = 0, [], 0  # depth: for each open block whether it is left out, and the head of a rule
    for mark in BRACE.finditer(sheet):
        piece = sheet[start : mark.start()].strip()
        start = mark.end()
        if mark[0] == "{":
            head = piece.lower()
            out = False
            if head.startswith("@"):
                name, _, query = head[1:].partition(" ")
                out = name not in ("media", "supports", "layer", "container", "scope") or (
                    name == "media" and all(re.match(r"\s*(only\s+)?(print|speech)\b|\s*not\s+(all|screen)\b", q) for q in query.split(","))
                )
                piece = ""
            depth.append((out, piece, mark.end()))
            skip += out
        elif mark[0] == "}" and depth:
            out, head, inner = depth.pop()
            skip -= out
            if head and not skip:
                yield head, sheet[inner : mark.start()]


class Sheet:
    """The simple selectors that bear on visibility, by the id, class or name that an element must have; and the layout's bounds."""

    def __init__(self, sheets: list[str], deep: int, wide: int):
        self.deep, self.wide = deep, wide
        self.by: dict[str, list] = {}
        for sheet in sheets:
            if "display" not in sheet and "visibility" not in sheet:
                continue
            for head, body in blocks(sheet):
                gone, hides = declared(body)
                if not gone and hides is None:
                    continue
                for one in head.split(","):
                    match = SELECTOR.match(one.strip())
                    if match:
                        marks = re.findall(r"[.#][\w-]+", match[2])
                        name = (match[1] or "*").lower()
                        key = next((m for m in marks if m[0] == "#"), marks[0] if marks else name)
                        own = self.by.setdefault(key, [])
                        own.append((sum(map(len, self.by.values())), name, frozenset(marks), gone, hides))

    def bearing(self, tag: str, attrs: dict[str, str]) -> list[tuple[bool, bool | None]]:
        """(gone, hides) of the rules that hold for an element, in the order of the sheets."""
        marks = {f".{c}" for c in attrs.get("class", "").split()} | ({f"#{attrs['id']}"} if "id" in attrs else set())
        found = [r for key in ("*", tag, *marks) for r in self.by.get(key, ())]
        return [r[3:] for r in sorted((r for r in found if r[1] in ("*", tag) and r[2] <= marks), key=lambda r: r[0])] if found else []


class Page:
    """Lines of text under construction."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = 0  # line breaks owed before the next text: 1 for a new line, 2 for a blank line
        self.space = False
        self.indent: list[str] = []
        self.mark = ""

    def text(self, s: str) -> None:
        """Add text whose white space is collapsed."""
        s = SPACES.sub(" ", s)
        if not s:
            return
        if s == " ":
            self.space = self.space or bool(self.now)
            return
        self.start()
        if (self.space or s[0] == " ") and self.now and not self.now[-1].endswith(" "):
            self.now.append(" ")
        self.now.append(s.strip(" "))
        self.space = s[-1] == " "

    def start(self) -> None:
        """Settle what is owed before the text that follows."""
        if self.gap:
            self.flush()
            if self.gap > 1 and self.lines and self.lines[-1]:
                self.lines.append("")
            self.gap = 0
        if not self.now:
            prefix = "".join(self.indent)
            if self.mark:
                prefix = prefix[: len(prefix) - len(self.mark)] + self.mark
                self.mark = ""
            self.prefix = prefix

    def flush(self) -> None:
        if self.now:
            self.lines.append((self.prefix + "".join(self.now)).rstrip(" "))
            self.now, self.space = [], False

    def owe(self, gap: int) -> None:
        if self.now or self.lines:
            self.gap = max(self.gap, gap)
        self.space = False

    def newline(self) -> None:
        """A line break in the text."""
        if self.now:
            self.flush()
        elif self.lines and not self.gap:
            self.lines.append("")

    def verbatim(self, s: str) -> None:
        for i, line in enumerate(s.split("\n")):
            if i:
                if not self.now:
                    self.start()
                    self.now.append("")
                self.flush()
            if line:
                self.start()
                self.now.append(line.expandtabs(8))

    def block(self, lines: list[str]) -> None:
        for line in lines:
            self.start()
            self.now.append(line)
            self.flush()

    def done(self) -> list[str]:
        self.flush()
        lines = self.lines
        while lines and not lines[-1]:
            lines.pop()
        return lines


def grid(node: Node, sheet, hidden: bool, depth: int) -> list[str]:
    """Lines of a table: captions, then rows with every cell as wide as its column."""
    out, rows = [], []
    todo = list(reversed(node.kids))
    while todo:
        kid = todo.pop()
        if isinstance(kid, str):
            if kid.strip():
                out += lay(Node("div", ""), [kid], sheet, hidden, depth)
            continue
        gone, veiled = seen(kid, sheet, hidden)
        if gone:
            continue
        if kid.tag in ("thead", "tbody", "tfoot", "colgroup"):
            todo += reversed(kid.kids)
        elif kid.tag == "tr":
            cells = []
            for cell in kid.kids:
                if isinstance(cell, str):
                    if cell.strip():
                        cells.append((lay(Node("td"), [cell], sheet, veiled, depth), 1))
                    continue
                lost, under = seen(cell, sheet, veiled)
                if not lost:
                    wide = cell.named().get("colspan", "1")
                    cells.append((lay(cell, cell.kids, sheet, under, depth), max(1, min(int(wide[:9]), SPAN)) if wide.isascii() and wide.isdigit() else 1))
            rows.append(cells)
        else:
            out += lay(kid, kid.kids, sheet, veiled, depth)
    width: dict[int, int] = {}
    for cells in rows:
        at = 0
        for lines, span in cells:
            if span == 1:
                width[at] = max([width.get(at, 0), *(len(x) for x in lines if len(x) <= sheet.wide)])
            at += span
    for cells in rows:
        full, at = [], 0
        for _, span in cells:
            columns = [width[at + k] for k in range(span) if at + k in width] if span > 1 else [width[at]]
            full.append(min(sum(columns) + 3 * max(len(columns) - 1, 0), sheet.wide))
            at += span
        for i in range(max((len(lines) for lines, _ in cells), default=0)):
            parts = [lines[i] if i < len(lines) else "" for lines, _ in cells]
            while parts and not parts[-1]:
                parts.pop()
            # Only what stands before another cell is padded, so nothing has to be cut off again.
            out.append(" | ".join([p.ljust(n) for p, n in zip(parts[:-1], full, strict=False)] + parts[-1:]))
    return [line for line in out if line]


def seen(node: Node, sheet, hidden: bool) -> tuple[bool, bool]:
    """Whether a node is taken away, and whether text in it is hidden."""
    if node.tag in UNSEEN:
        return True, hidden
    if not sheet.by and (not node.attrs or node.attrs.isspace()):
        return node.tag == "dialog", hidden
    attrs = node.named()
    if "hidden" in attrs or node.tag == "dialog" and "open" not in attrs or node.tag == "input":
        return True, hidden
    for gone, hides in sheet.bearing(node.tag, attrs):
        if gone:
            return True, hidden
        hidden = hidden if hides is None else hides
    if "style" in attrs:
        gone, hides = declared(attrs["style"])
        return gone, hidden if hides is None else hides
    return False, hidden


def lay(node: Node, kids: list, sheet, hidden: bool = False, depth: int = 0) -> list[str]:
    """Lines of a node's visible text."""
    page = Page()
    counts: list[int | None] = []
    # Steps still to do: a child with whether its text is hidden and stands as it is, or what ends an element.
    todo: list = [(k, hidden, node.tag == "pre") for k in reversed(kids)]
    while todo:
        step = todo.pop()
        if callable(step):
            step()
            continue
        kid, veiled, literal = step
        if isinstance(kid, str):
            if not veiled:
                text = html.unescape(kid) if "&" in kid else kid
                page.verbatim(text) if literal else page.text(text)
            continue
        tag = kid.tag
        gone, veiled = seen(kid, sheet, veiled)
        if gone:
            continue
        if tag == "br":
            page.newline()
            continue
        if tag == "table" and depth < sheet.deep:
            page.owe(2)
            lines = grid(kid, sheet, veiled, depth + 1)
            page.block(lines)
            page.owe(2)
            continue
        if tag in BLOCK:
            gap = 2 if tag in SPACED and not (tag in ("ul", "ol") and counts) else 1
            page.owe(gap)
            todo.append(lambda gap=gap: page.owe(gap))
        if tag in ("ul", "ol", "menu", "dir"):
            first = kid.named().get("start", "1") if tag == "ol" else ""
            counts.append(None if tag != "ol" else int(first) if re.fullmatch(r"-?\d{1,9}", first) else 1)
            todo.append(counts.pop)
        elif tag == "li":
            mark = "- "
            if counts and counts[-1] is not None:
                mark = f"{counts[-1]}. "
                counts[-1] += 1
            page.indent.append(" " * len(mark))
            page.mark = mark

            def end() -> None:
                page.flush()
                page.indent.pop()
                page.mark = ""

            todo.append(end)
        elif tag in ("dd", "blockquote"):
            page.indent.append("  ")
            todo.append(lambda: (page.flush(), page.indent.pop()))
        elif tag in ("td", "th"):
            page.text(" ")
        inner = kid.kids
        if tag == "details" and "open" not in kid.named():
            inner = [k for k in inner if isinstance(k, Node) and k.tag == "summary"][:1]
        todo += [(k, veiled, literal or tag in ("pre", "textarea", "xmp")) for k in reversed(inner)]
    return page.done()


def visible_text(page: str, deep: int = DEEP, wide: int = WIDE) -> str:
    root, sheets = parse(page)
    return "\n".join(lay(root, root.kids, Sheet(sheets, deep, wide)))


def renderer(deep: int, wide: int):
    """A function for mapInArrow from (page_id, html) to (page_id, text)."""

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, pages in text_chunks(batches, text="html"):
            texts = [visible_text(p.decode("utf-8", "replace"), deep, wide) for p in pages]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["page_id", "text"])

    return render


def page_texts(pages: DataFrame, deep: int = DEEP, wide: int = WIDE) -> DataFrame:
    """page_id and text for every row of ``pages``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "html")
    return mapped(rows, renderer(deep, wide), "page_id long, text string")
