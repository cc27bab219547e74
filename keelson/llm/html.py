"""Operator 8: layout-aware rendering of web pages.

A tree builder closes what HTML lets authors leave open (paragraphs before blocks, list items, table
parts, inline elements at the end of their block), visibility rules drop what a browser doesn't show
(elements without a rendering, `hidden`, inline styles, and rules of the page's own style sheets whose
selectors are a tag, a class, an id or such together; `visibility` is inherited and may be taken back),
and a walk over the tree emits all visible text: blocks on lines of their own with a blank line
around paragraphs, headings, lists and tables; list items with a bullet or number, indented by depth;
table cells padded to the width of their column, over several columns or rows if they span them;
preformatted text as it is. The builder knows where each open tag stands, so its work is linear.

Edge cases: null or empty pages give an empty text; broken markup never fails; nesting of any depth
is walked with a stack of its own; null ids pass through; repeated rows give repeated results.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rows, slices

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head title script style template noscript datalist iframe object audio video canvas svg math".split())
WIDE = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset".split())  # a blank line around
LINES = frozenset(
    "address article aside body center dd details dialog dir div dt fieldset figcaption footer form header hgroup html legend "
    "li main menu nav search section summary caption tr thead tbody tfoot td th option optgroup select".split()
)
BLOCKS = WIDE | LINES | {"hr"}
ENDS_PARAGRAPH = BLOCKS - {"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "option", "optgroup", "select", "html", "body"}
CLOSES = {  # a start tag ends these open elements, up to the elements that hold it
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th", "caption"}, {"tr", "table"}),
    "th": ({"td", "th", "caption"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
STYLE = re.compile(r"(?:^|[;{])\s*(display|visibility)\s*:\s*([a-z-]+)", re.I)
RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
SELECTOR = re.compile(r"([a-z][a-z0-9]*)?((?:[.#][\w-]+)*)", re.I)
MOST_SPAN = 100
SPACES = " \t\n\r\f"
GAP = "  "  # between columns of a table


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children = tag, attrs, []


class Builder(HTMLParser):
    """Tokens to a tree with implied end tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]
        self.at: dict[str, list[int]] = {}  # where each tag stands among the open ones
        self.blocks = [0]  # where blocks stand
        self.styles: list[str] = []

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.open))
        if node.tag in BLOCKS:
            self.blocks.append(len(self.open))
        self.open.append(node)

    def close_to(self, at: int) -> None:
        while len(self.open) > at:
            tag = self.open.pop().tag
            self.at[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()

    def last(self, tags: Iterable[str]) -> int:
        """The place of the innermost open element of tags, 0 for none."""
        return max((places[-1] for t in tags if (places := self.at.get(t))), default=0)

    def find(self, tags: set[str], stop: set[str]) -> int | None:
        """The outermost open element of tags that is not beyond one of stop."""
        end, found = self.last(stop), None
        for tag in tags:
            places = self.at.get(tag)
            if places and places[-1] > end:
                place = places[bisect_right(places, end)]
                found = place if found is None else min(found, place)
        return found

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "html":
            return
        if tag in CLOSES and (at := self.find(*CLOSES[tag])) is not None:
            self.close_to(at)
        if tag in ENDS_PARAGRAPH and (at := self.find({"p"}, {"td", "th", "table", "button", "object", "caption"})) is not None:
            self.close_to(at)
        if self.open[-1].tag == "head" and tag not in UNSEEN | VOID:
            self.close_to(len(self.open) - 1)  # what isn't of the head ends it
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.push(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            return self.handle_starttag("br", [])
        stop = self.last(({"table"} if tag != "table" else ()) if tag in BLOCKS else ("td", "th", "table"))
        if tag not in BLOCKS:
            stop = max(stop, self.blocks[-1])  # an inline end tag doesn't reach out of its block
        at = self.last((tag,))
        if at > stop:
            self.close_to(at)
        elif tag == "p":  # an end tag alone stands for an empty paragraph
            self.open[-1].children.append(Node("p", {}))
        return None

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag == "style":
            self.styles.append(data)
        self.open[-1].children.append(data)


class Writer:
    """Text with collapsed white space, pending line breaks and a hanging indent."""

    def __init__(self):
        self.parts: list[str] = []
        self.breaks, self.space, self.fresh = 0, False, True  # fresh: nothing on this line yet
        self.indent, self.mark = "", ""

    def brk(self, n: int) -> None:
        self.space = False
        if self.parts:
            self.breaks = max(self.breaks, n)
        self.fresh = True

    def put(self, text: str) -> None:
        if self.breaks:
            self.parts.append("\n" * self.breaks)
        if self.fresh or self.breaks:
            self.parts.append(self.mark or self.indent)
            self.mark = ""
        elif self.space:
            self.parts.append(" ")
        self.breaks, self.space, self.fresh = 0, False, False
        self.parts.append(text)

    def text(self, data: str) -> None:
        words = [w for w in re.split("[ \t\n\r\f]+", data) if w]
        if not words:
            self.space |= bool(data) and not self.fresh
            return
        if data[0] in SPACES and not self.fresh:
            self.space = True
        self.put(" ".join(words))
        self.space = data[-1] in SPACES

    def raw(self, data: str) -> None:
        for i, line in enumerate(data.expandtabs().split("\n")):
            if i:
                if self.parts:
                    self.breaks = self.breaks + 1 if self.breaks or self.fresh else 1
                self.fresh = True
            if line:
                self.put(line)

    def line(self) -> None:
        """A forced break; further ones add empty lines."""
        self.space = False
        if self.parts:
            self.breaks += 1
        self.fresh = True

    def value(self) -> str:
        return "".join(self.parts)


class Sheet:
    """What the rules of a page's style sheets say of display and visibility; rules within others, as for
    a medium, and selectors of several elements are left out."""

    def __init__(self, styles: list[str]):
        self.rules: dict[str, list[tuple]] = {}  # by the last part of the selector: tag, .class or #id
        text = re.sub(r"/\*.*?\*/", " ", " ".join(styles), flags=re.S)
        text = re.sub(r"@[^{};]*\{(?:[^{}]*\{[^{}]*\})*[^{}]*\}|@[^{};]*;", " ", text)
        for i, (selectors, body) in enumerate(RULE.findall(text)):
            said = {k.lower(): v.lower() for k, v in STYLE.findall("{" + body)}
            for selector in selectors.split(",") if said else ():
                if (m := SELECTOR.fullmatch(selector.strip())) and m[0]:
                    marks = re.findall(r"[.#][\w-]+", m[2])
                    tag = (m[1] or "").lower()
                    weight = sum(x[0] == "#" for x in marks), sum(x[0] == "." for x in marks), bool(tag), i
                    self.rules.setdefault(marks[-1] if marks else tag, []).append((weight, tag, set(marks), said))

    def of(self, node: Node) -> dict[str, str]:
        """display and visibility of an element, as far as anything is said."""
        a = node.attrs
        out: dict[str, str] = {}
        if self.rules:
            marks = {f".{c}" for c in a.get("class", "").split()} | ({f"#{a['id']}"} if a.get("id") else set())
            fitting = [r for key in (node.tag, *marks) for r in self.rules.get(key, ()) if (not r[1] or r[1] == node.tag) and r[2] <= marks]
            for _, _, _, said in sorted(fitting, key=lambda r: r[0]):
                out |= said
        if a.get("style"):
            out |= {k.lower(): v.lower() for k, v in STYLE.findall(a["style"])}
        return out


def unseen(node: Node, said: dict[str, str]) -> bool:
    """Whether a browser shows nothing of an element and what is in it."""
    a = node.attrs
    return (
        node.tag in UNSEEN or "hidden" in a and "display" not in said or (node.tag == "input" and a.get("type", "").lower() == "hidden")
        or said.get("display") == "none" or (node.tag == "dialog" and "open" not in a)
    )


def aligned(rows: list[list[tuple[str, int, int]]]) -> str:
    """Rows of cells (text, columns and rows spanned), padded by column; a cell may have several lines."""
    widths: list[int] = []
    placed: list[list[tuple[int, str, int]]] = []
    taken: dict[int, int] = {}  # column -> rows that a cell from above still covers
    for row in rows:
        at, cells, held = 0, [], {}
        for text, span, deep in row:
            while taken.get(at):
                at += 1
            widths += [0] * (at + span - len(widths))
            if span == 1:
                widths[at] = max(widths[at], *map(len, text.split("\n")))
            cells.append((at, text, span))
            if deep > 1:
                held |= {c: deep for c in range(at, at + span)}
            at += span
        placed.append(cells)
        taken = {c: n - 1 for c, n in (taken | held).items() if n > 1}
    starts = [0]
    for w in widths:
        starts.append(starts[-1] + w + len(GAP))
    out = []
    for row in placed:
        cells = [(at, text.split("\n")) for at, text, _ in row]
        for k in range(max((len(lines) for _, lines in cells), default=0)):
            line = ""
            for at, lines in cells:
                if line and len(line) + len(GAP) > starts[at]:
                    line += GAP  # what spans several columns is wider than they are
                line = line.ljust(starts[at]) + (lines[k] if k < len(lines) else "")
            out.append(line.rstrip())
    return "\n".join(out)


def number(text: str | None, default: int, most: int) -> int:
    try:
        return max(1, min(int(text), most)) if text else default
    except ValueError:
        return default


def render(html: str | None) -> str:
    """The visible text of a page."""
    if not html:
        return ""
    builder = Builder()
    builder.feed(html)
    builder.close()
    writer, writers = Writer(), []
    lists: list[list] = []  # [ordered, next number, indent outside]
    tables: list[list] = []  # rows of the open tables
    pre = 0
    sheet = Sheet(builder.styles)
    shown = [True]  # visibility of the open elements that say something of it
    stack: list[tuple[object, bool]] = [(builder.root, False)]
    while stack:
        node, leaving = stack.pop()
        if isinstance(node, str):
            if not shown[-1]:
                continue
            writer.raw(node) if pre else writer.text(node)
            continue
        if node is None:
            shown.pop()
            continue
        tag = node.tag
        if not leaving:
            said = sheet.of(node)
            if unseen(node, said):
                continue
            if "visibility" in said and tag not in VOID:
                shown.append(said["visibility"] not in ("hidden", "collapse"))
                stack.append((None, True))
            if tag == "br":
                writer.line()
                continue
            if tag == "hr":
                writer.brk(1)
                continue
            if tag in ("td", "th"):
                writers.append(writer)
                writer = Writer()
            elif tag == "table":
                writer.brk(2)
                tables.append([])
                writers.append(writer)
                writer = Writer()  # for what stands outside cells, as a caption
            elif tag == "tr":
                if tables:
                    tables[-1].append([])
            elif tag in ("ul", "ol", "menu", "dir"):
                writer.brk(1 if lists else 2)
                first = node.attrs.get("start", "")
                lists.append([tag == "ol", int(first) if re.fullmatch(r"-?\d{1,9}", first) else 1, writer.indent])
            elif tag == "li":
                writer.brk(1)
                base = lists[-1][2] if lists else writer.indent
                sign = f"{lists[-1][1]}. " if lists and lists[-1][0] else "- "
                if lists:
                    lists[-1][1] += 1
                writer.mark, writer.indent = base + sign, base + " " * len(sign)
            elif tag == "dd":
                writer.brk(1)
                writer.indent += "    "
            elif tag in WIDE:
                writer.brk(2)
                pre += tag == "pre"
            elif tag in LINES:
                writer.brk(1)
            pre += tag == "textarea"
            stack.append((node, True))
            children = node.children
            if tag == "details" and "open" not in node.attrs:  # closed: its summary alone
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
            stack += [(c, False) for c in reversed(children)]
            continue
        pre -= tag == "textarea"
        if tag in ("td", "th"):
            text, writer = writer.value(), writers.pop()
            if tables:
                if not tables[-1]:
                    tables[-1].append([])
                tables[-1][-1].append((text, *(number(node.attrs.get(x), 1, MOST_SPAN) for x in ("colspan", "rowspan"))))
            else:
                writer.text(f" {text} ")
        elif tag == "table":
            loose, writer = writer.value(), writers.pop()
            body = aligned(tables.pop())
            for part in (loose, body):
                if part:
                    writer.brk(1)
                    writer.put(part.replace("\n", "\n" + writer.indent))
            writer.brk(2)
        elif tag in ("ul", "ol", "menu", "dir"):
            writer.indent = lists.pop()[2]
            writer.mark = ""
            writer.brk(1 if lists else 2)
        elif tag == "li":
            writer.indent = lists[-1][2] if lists else ""
            writer.mark = ""
            writer.brk(1)
        elif tag == "dd":
            writer.indent = writer.indent[:-4]
            writer.brk(1)
        elif tag in WIDE:
            pre -= tag == "pre"
            writer.brk(2)
        elif tag in LINES:
            writer.brk(1)
    return writer.value()


def texts(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, text of every whole page; no shuffle."""
    schema = f"page_id {df.schema[id_col].dataType.simpleString()}, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        for big in batches:
            for batch in slices(big):
                for key, html in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                    text = render(html)
                    out.add(key, text, size=len(text))
                    if out.full():
                        yield out.take()
        yield from out.rest()

    return df.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html")).mapInArrow(run, schema)
