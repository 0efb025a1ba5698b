"""Operator 7: layout-aware rendering of HTML to text.

A tree builder closes what a tag implies (paragraphs before blocks, list items, table rows and cells, head before
body). Nodes that are not shown (scripts, styles, head, hidden ones, by attribute, by their style or by simple selectors of
the page's style sheets, and what closed details hold) are left out with all that is in them. Blocks stand on lines of
their own, paragraphs and headings with a blank line around, list items have their mark and indent, and the cells of a
table, whether of one or of several rows and columns, are padded to the width of their column. Deep nesting needs no
recursion, and the work grows with the page's length alone.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from html import unescape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_batch, table

# HTML's own classes of elements (fixed values).
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HIDDEN = {"head", "script", "style", "template", "noscript", "title", "meta", "link", "svg", "math", "iframe", "object", "audio", "video", "canvas", "datalist", "dialog"}
SPACED = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "blockquote", "pre", "table", "figure", "hr"}
BLOCK = SPACED | {"html", "body", "div", "article", "section", "nav", "header", "footer", "main", "aside", "address", "form", "fieldset", "legend", "li", "dt", "dd", "figcaption", "details", "summary", "caption", "option", "center", "hgroup", "menu", "search"}
#: A new tag closes the nearest open one of these, unless one of the second set stands between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}), "thead": ({"caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, set()),
}
IN_HEAD = {"base", "link", "meta", "noscript", "script", "style", "template", "title"}
BEFORE_BODY = IN_HEAD | {"html", "head", "body"}
#: Elements through which a new block doesn't close a paragraph.
KEEPS_P = {"td", "th", "table", "button", "object", "caption"}
#: HTML's own limits of spans (fixed values).
MOST_COLUMNS, MOST_ROWS = 1000, 65534
#: Columns are aligned up to this width, and lines indented up to this depth; what is wider is written whole, unaligned.
WIDEST, DEEPEST = 240, 40


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []


BLANK = r"[ \t\n\r\f]"
TAG = re.compile(r"</?([A-Za-z][^ \t\n\r\f/>]*+)")
ATTR = re.compile(rf"""(?:{BLANK}|/)*+([^ \t\n\r\f/>][^ \t\n\r\f/>=]*+)(?:{BLANK}*+=(?:{BLANK}*+)(?:"([^"]*+)"|'([^']*+)'|((?!["'])[^ \t\n\r\f>]*+)))?+""")
UNCLOSED = re.compile(rf"""{BLANK}*+={BLANK}*+["']""")
REST = re.compile(rf"(?:{BLANK}|/)*+(>?)")
#: Elements whose content is text alone: as it is, or with character references.
RAW = {x: re.compile(rf"(?i)</{x}(?=[ \t\n\r\f/>])") for x in ("script", "style", "iframe", "noembed", "noframes", "xmp", "title", "textarea")}
REFERENCES = {"title", "textarea"}


def unescaped(text: str) -> str:
    """Text with character references replaced; numbers beyond all code points stand for U+FFFD."""
    if "&" not in text:
        return text
    text = re.sub(r"&#([xX]?)0++(?=[0-9a-fA-F])", r"&#\1", text)
    return unescape(re.sub(r"&#(?:[0-9]{8,}+|[xX][0-9a-fA-F]{7,}+);?", "\ufffd", text))


def parse(html: str, builder: Builder) -> None:
    """Feeds the builder with a page's tags and texts, in one pass. What HTML drops goes: comments, declarations, and tags
    that the page's end cuts off."""
    at, n = 0, len(html)
    while at < n:
        less = html.find("<", at)
        if less < 0:
            builder.text(unescaped(html[at:]))
            return
        tag = TAG.match(html, less)
        if tag is None and html[less + 1 : less + 2] not in ("!", "?", "/"):
            after = html.find("<", less + 1)
            after = n if after < 0 else after
            builder.text(unescaped(html[at:after]))
            at = after
            continue
        if less > at:
            builder.text(unescaped(html[at:less]))
        if tag is None:
            if html.startswith("<!--", less):
                end = re.compile(r"--!?>").search(html, less + 2)  # <!--> is a comment too
                at = end.end() if end else n
            else:
                end = html.find(">", less)
                at = n if end < 0 else end + 1
            continue
        name, attrs, at = tag[1].lower(), {}, tag.end()
        while (rest := REST.match(html, at))[1] == "" and rest.end() < n:
            found = ATTR.match(html, at)
            if found[2] is found[3] is found[4] is None and UNCLOSED.match(html, found.end()):
                return
            value = next((x for x in found.groups()[1:] if x is not None), "")
            attrs.setdefault(found[1].lower(), unescaped(value))
            at = found.end()
        if rest[1] == "":
            return
        at = rest.end()
        if html[less + 1] == "/":
            builder.end(name)
            continue
        builder.start(name, attrs)
        if name in ("svg", "math", "path") and html[at - 2] == "/":
            builder.end(name)
        elif name in RAW:
            end = RAW[name].search(html, at)
            stop = end.start() if end else n
            builder.text(unescaped(html[at:stop]) if name in REFERENCES else html[at:stop])
            at = stop


class Builder:
    """Open elements are a stack, and for each tag the places of its open elements in it, so that no tag makes the whole
    stack be searched."""

    def __init__(self) -> None:
        self.root = Node("#root", {})
        self.open = [self.root]
        self.places: dict[str, list[int]] = {}
        self.styles: list[str] = []

    def last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def cut(self, i: int) -> None:
        for node in self.open[i:]:
            self.places[node.tag].pop()
        del self.open[i:]

    def close_to(self, tags: set, walls: set) -> None:
        i = self.last(tags)
        if i > 0 and i >= self.last(walls):
            self.cut(i)

    def start(self, tag: str, attrs: dict) -> None:
        if tag not in BEFORE_BODY and self.places.get("head"):
            self.close_to({"head"}, set())
        if tag in ("html", "body", "head") and self.places.get(tag):
            return
        if tag in BLOCK:
            self.close_to({"p"}, KEEPS_P)
        if tag in CLOSES:
            self.close_to(*CLOSES[tag])
        if tag in ("td", "th") and self.last({"tr"}) <= self.last({"table"}):
            self.push(Node("tr", {}))
        node = Node(tag, attrs)
        if tag in VOID:
            self.open[-1].children.append(node)
        else:
            self.push(node)

    def push(self, node: Node) -> None:
        self.open[-1].children.append(node)
        self.places.setdefault(node.tag, []).append(len(self.open))
        self.open.append(node)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.open[-1].children.append(Node("br", {}))
        elif tag == "p" and not self.places.get("p"):
            self.open[-1].children.append(Node("p", {}))
        else:
            self.close_to({tag}, {"table"} if tag not in ("table", "body", "html") else set())

    def text(self, data: str) -> None:
        if not data:
            return
        if self.open[-1].tag == "style":
            self.styles.append(data)
        self.open[-1].children.append(data)


def unseen(declarations: str) -> bool:
    plain = re.sub(r"\s", "", declarations.lower())
    return "display:none" in plain or "visibility:hidden" in plain


def hiding(sheet: str) -> set[str]:
    """The simple selectors (tag, .class, #id, tag.class) that a style sheet hides; blocks of at-rules don't count, as they
    hold for print or some widths only."""
    sheet, found, prelude, at, depth = re.sub(r"(?s)/\*.*?(?:\*/|$)", "", sheet), set(), "", 0, 0
    for m in re.finditer(r"[{}]", sheet):
        if m[0] == "{":
            if depth == 0:
                prelude = sheet[at : m.start()].rpartition(";")[2].strip()
            depth, at = depth + 1, m.end()
        else:
            if depth == 1 and not prelude.startswith("@") and unseen(sheet[at : m.start()]):
                found.update(x for x in map(str.strip, prelude.split(",")) if re.fullmatch(r"[A-Za-z][A-Za-z0-9]*|[A-Za-z0-9]*[.#][\w-]+", x))
            depth, at = max(depth - 1, 0), m.end()
    return found


def hidden(node: Node, rules: set[str] = frozenset()) -> bool:
    if node.tag in HIDDEN and not (node.tag == "dialog" and "open" in node.attrs):
        return True
    if "hidden" in node.attrs or node.tag == "input" or unseen(node.attrs.get("style", "")):
        return True
    if not rules:
        return False
    names = [f".{c}" for c in node.attrs.get("class", "").split()] + ([f"#{node.attrs['id']}"] if node.attrs.get("id") else [])
    return node.tag in rules or any(x in rules or node.tag + x in rules for x in names)


def number(text: str, default: int, most: int) -> int:
    """The whole number that an attribute starts with, at most `most`."""
    m = re.match(r"[ \t\n\f\r]*\+?([0-9]+)", text)
    if not m:
        return default
    digits = m[1].lstrip("0")
    return most if len(digits) > 9 else min(int(digits or "0"), most)


def columns_of(text: str) -> int:
    """Columns that a line takes up: two for wide characters, none for combining ones."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 1 + (unicodedata.east_asian_width(c) in "WF") for c in text)


class Flow:
    """Lines of one block context: the page, or a table cell."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.blank = False  # a blank line is due
        self.indent: list[str] = []
        self.mark = ""

    def text(self, data: str, kept: bool) -> None:
        if kept:
            first, *more = data.split("\n")
            self.now.append(first)
            for line in more:
                self.end_line(kept=True)
                self.now.append(line)
        else:
            self.now.append(re.sub(r"[ \t\n\r\f]+", " ", data))

    def end_line(self, kept: bool = False) -> None:
        line = "".join(self.now)
        line = line.rstrip() if kept else re.sub(" +", " ", line).strip(" ")
        self.now = []
        if line or kept:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            pad = "".join(self.indent[-DEEPEST:])
            if self.mark:
                pad, self.mark = pad[: len(pad) - len(self.mark)] + self.mark, ""
            self.lines.append((pad + line).rstrip() if line else "")

    def whole(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def table_lines(rows: list[list[tuple]]) -> list[str]:
    """Cells (lines, columns, rows) side by side, each column as wide as its widest line. A cell of several rows keeps its
    columns free in the rows below it; rows without text are left out."""
    placed, busy = [], []  # busy: (first column, end, first row that is free again), by column
    for r, row in enumerate(rows):
        busy = [x for x in busy if x[2] > r]
        cells, column, k, held = [], 0, 0, []
        for lines, wide, high in row:
            while k < len(busy) and busy[k][0] < column + 1:
                column = max(column, busy[k][1])
                k += 1
            if lines and any(lines):
                cells.append((column, column + wide, lines))
            if high != 1:
                held.append((column, column + wide, len(rows) if high == 0 else r + high))
            column += wide
        busy = sorted(busy + held) if held else busy
        if cells:
            placed.append(cells)
    used = sorted({c for cells in placed for c, _, _ in cells})
    rank = {c: i for i, c in enumerate(used)}
    width = [0] * len(used)
    spans = []
    for cells in placed:
        for first, end, lines in cells:
            i, j = rank[first], bisect_left(used, end)
            most = max(min(columns_of(x), WIDEST) for x in lines)
            if j - i == 1:
                width[i] = max(width[i], most)
            else:
                spans.append((i, j, most))
    for i, j, most in spans:
        width[j - 1] += max(0, most - sum(width[i:j]) - 2 * (j - i - 1))
    begin = [0]
    for w in width:
        begin.append(begin[-1] + w + 2)
    out = []
    for cells in placed:
        for k in range(max(len(lines) for _, _, lines in cells)):
            line, at = [], 0
            for first, _, lines in cells:
                if k < len(lines) and lines[k]:
                    gap = begin[rank[first]] - at
                    line.append(" " * (gap if at == 0 else max(gap, 2)) + lines[k])
                    at += max(gap, 0 if at == 0 else 2) + columns_of(lines[k])
            out.append("".join(line).rstrip())
    return out


def render(html: str | None) -> str:
    """All visible text of a page; null gives an empty text."""
    if not html:
        return ""
    builder = Builder()
    parse(html, builder)
    rules = set().union(*map(hiding, builder.styles))
    flows, tables, lists, pre = [Flow()], [], [], 0
    todo: list = [(builder.root, False)]
    while todo:
        node, leaving = todo.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if not (tables and tables[-1]["flow"] is flow):  # text between rows and cells counts only if it says something
                flow.text(node, pre > 0)
            elif node.strip():
                flow.text(node, False)
            continue
        tag = node.tag
        if not leaving:
            if hidden(node, rules):
                continue
            todo.append((node, True))
            shown = node.children
            if tag == "details" and "open" not in node.attrs:
                shown = [x for x in shown if isinstance(x, Node) and x.tag == "summary"][:1]
            todo += [(x, False) if isinstance(x, Node) else (x, None) for x in reversed(shown)]
            if tag == "br":
                flow.end_line(kept=True)
            elif tag in BLOCK and tag not in ("td", "th"):
                flow.end_line()
                flow.blank |= tag in SPACED and not (tag in ("ul", "ol") and lists)
            if tag == "pre":
                pre += 1
            elif tag in ("ul", "ol", "menu"):
                lists.append([tag, number(node.attrs.get("start", ""), 1, 10**9)])
            elif tag == "li":
                kind = lists[-1] if lists else ["ul", 1]
                flow.mark = f"{kind[1]}. " if kind[0] == "ol" else "- "
                kind[1] += 1
                flow.indent.append(" " * len(flow.mark))
            elif tag in ("dd", "blockquote"):
                flow.indent.append("  ")
            elif tag == "table":
                tables.append({"rows": [], "flow": flow})
            elif tag == "tr" and tables:
                tables[-1]["rows"].append([])
            elif tag in ("td", "th"):
                flows.append(Flow())
            continue
        if tag in ("td", "th"):
            cell = flows.pop().whole()
            if tables:
                rows = tables[-1]["rows"]
                rows or rows.append([])
                rows[-1].append((cell, max(1, number(node.attrs.get("colspan", ""), 1, MOST_COLUMNS)), number(node.attrs.get("rowspan", ""), 1, MOST_ROWS)))
            else:
                flow = flows[-1]
                flow.text(" ".join(cell) + " ", False)
            continue
        if tag == "table" and tables:
            for line in table_lines(tables.pop()["rows"]):
                flow.now = [line]
                flow.end_line(kept=True)
            flow.blank = True
        elif tag in BLOCK:
            flow.end_line(kept=pre > 0 and any(flow.now))
            flow.blank |= tag in SPACED and not (tag in ("ul", "ol") and len(lists) > 1)
        if tag == "pre":
            pre -= 1
        elif tag in ("ul", "ol", "menu") and lists:
            lists.pop()
        elif tag in ("li", "dd", "blockquote") and flow.indent:
            flow.indent.pop()
            flow.mark = "" if tag == "li" else flow.mark
    while len(flows) > 1:
        rest = flows.pop().whole()
        flows[-1].text(" ".join(rest), False)
    return "\n".join(flows[0].whole())


def _rendered():
    def step(batch):
        texts = [render(x) for x in batch.column("html").to_pylist()]
        return {"page_id": batch.column("page_id").cast("int64"), "text": texts, "n_chars": [len(x) for x in texts]}

    return step


def extract(pages: DataFrame) -> DataFrame:
    """One row for each row of pages (page_id, html): page_id, text, n_chars.

    Null and empty pages give an empty text, malformed ones what a browser would show; very long ones are read whole.
    Other columns are ignored, whatever their names; repeated rows are rendered each; an empty table gives no rows.
    """
    return per_batch(pages.select(F.col("page_id").cast("long").alias("page_id"), "html"), ["page_id", "html"], "page_id long, text string, n_chars long", _rendered)


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
