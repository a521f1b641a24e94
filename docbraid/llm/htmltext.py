"""Layout-aware text of HTML pages.

A tolerant tree builder (implied end tags, void and raw-text elements, stray
end tags) feeds a renderer that keeps what a reader would see: blocks on lines
of their own, paragraphs and headings apart, list items marked and indented,
preformatted text as it is, table cells aligned in columns by their width on
screen, spans over rows and columns included. Elements that are not displayed,
by their kind, attributes or the page's own style rules, are left out; hidden
visibility is inherited until a descendant is visible again. Both work with
explicit stacks and single scans, so neither depth nor broken markup makes the
work grow faster than the page.
"""

from __future__ import annotations

import bisect
import html
import re
import unicodedata
from collections import defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_SPECIAL = re.compile(r">|=\s*[\"']")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_DECLARED = re.compile(r"(?:^|[;\s])(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
_SELECTOR = re.compile(r"(\*|[a-z][a-z0-9]*)?((?:[.#][\w-]+)*)", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes".split())
INVISIBLE = frozenset("head script style template noscript iframe noembed noframes datalist object audio video canvas area base link meta title param source track desc metadata defs symbol annotation annotation-xml".split())
#: Start tags and text other than these end the head.
_HEAD = frozenset("head base basefont bgsound link meta noframes noscript script style template title".split())
_LABELLED = frozenset("submit button reset text search email url tel number".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr fieldset details menu".split())
BLOCK = SPACED | frozenset("html body div section article main nav aside header footer address form li dt dd dialog figcaption summary legend caption thead tbody tfoot tr center option optgroup text".split())
#: A start tag of the key ends open elements of these names, up to a barrier.
_P_ENDS = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "optgroup": ("option", "optgroup"),
           "thead": ("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), "tbody": ("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), "tfoot": ("thead", "tbody", "tfoot", "tr", "td", "th", "caption")}
_BARRIER = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select", "datalist"), "optgroup": ("select",)}
_TABLE = ("table",)
#: Limits of the layout, not of the text: cells that span into a row, columns on screen of padding and of a cell that widens its column.
SPANNING, WIDE = 200, 200


@dataclass
class Node:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)


def _tag_ends(page: str):
    """A function from a place inside a tag to the place of the > that ends it, or -1; > in a quoted value doesn't.

    A quote opens a value only after =, and only if it is closed. Calls must come
    with ascending places; what one of them finds out serves the later ones.
    """
    known: dict[int, int] = {}  # by the place of the first special character
    upcoming = -1
    unclosed: set[str] = set()

    def end(at: int) -> int:
        nonlocal upcoming
        if upcoming is not None and upcoming < at:
            found = _SPECIAL.search(page, at)
            upcoming = found.start() if found else None
        if upcoming is None:
            return -1
        path, place = [], upcoming
        while place not in known:
            path.append(place)
            if page[place] == ">":
                known[place] = place
                break
            quote_at = _SPECIAL.match(page, place).end() - 1
            quote = page[quote_at]
            close = -1 if quote in unclosed else page.find(quote, quote_at + 1)
            if close < 0:
                unclosed.add(quote)
            following = _SPECIAL.search(page, (close if close >= 0 else quote_at) + 1)
            if not following:
                known[place] = -1
                break
            place = following.start()
        result = known[place]
        for x in path:
            known[x] = result
        return result

    return end


def parse(page: str) -> Node:
    """The tree of a page; any text has one."""
    root = Node("html")
    stack = [root]
    at = 0
    places: defaultdict[str, list[int]] = defaultdict(list)  # of the open elements, by name
    tag_end = _tag_ends(page)

    def cut(low: int) -> None:
        for n in stack[low:]:
            places[n.tag].pop()
        del stack[low:]

    def last(names: tuple[str, ...]) -> int:
        return max((places[n][-1] for n in names if places[n]), default=0)

    def close(names: tuple[str, ...], barrier: tuple[str, ...]) -> None:
        """Ends the open elements of these names inside the nearest barrier, with all in them."""
        edge = last(barrier)
        inside = [own[i] for n in names if (own := places[n]) and (i := bisect.bisect_right(own, edge)) < len(own)]
        if inside:
            cut(min(inside))

    def text(s: str) -> None:
        if s:
            if stack[-1].tag == "head" and not s.isspace():
                cut(len(stack) - 1)
            stack[-1].children.append(html.unescape(s) if "&" in s else s)

    while True:
        low = page.find("<", at)
        if low < 0:
            text(page[at:])
            return root
        if page.startswith("<!--", low):
            text(page[at:low])
            end = page.find("-->", low + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        closing = page.startswith("</", low)
        named = _NAME.match(page, low + 1 + closing)
        if not named:
            if page[low + 1 : low + 2] in ("!", "?", "/") and low + 1 < len(page):
                text(page[at:low])
                end = page.find(">", low)
                at = end + 1 if end >= 0 else len(page)
            else:
                text(page[at : low + 1])
                at = low + 1
            continue
        end = tag_end(named.end())
        if end < 0:  # no tag: the rest has no end of one, or this one's lies in an open quote
            text(page[at : low + 1])
            at = low + 1
            continue
        text(page[at:low])
        at = end + 1
        name, rest = named[0].lower(), page[named.end() : end]
        if closing:
            if name == "br":
                stack[-1].children.append(Node("br"))
                continue
            barrier = () if name in ("table", "body", "html") else ("td", "th", "table") if name not in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption") else _TABLE
            own = places[name]
            if own and own[-1] >= last(barrier):
                cut(own[-1])
            continue
        if places["head"] and name not in _HEAD and last(("template",)) < places["head"][-1]:
            close(("head",), ())
        if name in ("html", "body") and len(stack) > 1:
            continue
        if name in ("html",):
            continue
        if name in _P_ENDS:
            close(("p",), ("td", "th", "table", "button", "object", "caption"))
        if name in IMPLIED:
            close(IMPLIED[name], _BARRIER.get(name, _TABLE) + (() if name in ("tr", "td", "th", "thead", "tbody", "tfoot") else ("td", "th", "table")))
        node = Node(name, {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in _ATTRIBUTE.findall(rest)} if rest and not rest.isspace() else {})
        stack[-1].children.append(node)
        if name in ("pre", "textarea", "listing"):  # a line feed right after the tag is not shown
            at += 2 if page.startswith("\r\n", at) else page.startswith("\n", at)
        if name in RAW:
            found = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(page, at)
            end = page.find(">", found.end()) if found else -1
            body = page[at : found.start() if found else len(page)]
            node.children.append(html.unescape(body) if name in ("textarea", "title") else body)
            at = end + 1 if end >= 0 else len(page)
        elif name not in VOID:
            stack.append(node)
            places[name].append(len(stack) - 1)


def _declarations(css: str) -> dict[str, tuple[str, bool]]:
    """display and visibility of a list of declarations, and whether they are important; the last of equals counts."""
    out: dict[str, tuple[str, bool]] = {}
    for name, value, important in _DECLARED.findall(css):
        if important or not out.get(name.lower(), ("", False))[1]:
            out[name.lower()] = (value.lower(), bool(important))
    return out


class Styles:
    """What the page's style elements say on display and visibility, for selectors of one element without states."""

    def __init__(self, sheets: list[str]) -> None:
        self.rules: defaultdict[str, list[tuple]] = defaultdict(list)
        order = 0
        for sheet in sheets:
            for selectors, declared in self._rules(sheet):
                for selector in selectors.split(",") if declared else ():
                    m = _SELECTOR.fullmatch(selector.strip())
                    if not m or not selector.strip():
                        continue
                    parts = re.findall(r"[.#][\w-]+", m[2])
                    tag = (m[1] or "*").lower()
                    weight = (sum(x[0] == "#" for x in parts), sum(x[0] == "." for x in parts), tag != "*")
                    order += 1
                    self.rules[parts[0] if parts else tag].append((weight, order, tag, frozenset(parts), declared))

    @staticmethod
    def _rules(sheet: str):
        """(selectors, declarations) of a sheet, those for the screen among its conditional blocks included."""
        clean, at = [], 0
        while (low := sheet.find("/*", at)) >= 0:
            clean.append(sheet[at:low])
            end = sheet.find("*/", low + 2)
            at = end + 2 if end >= 0 else len(sheet)
        clean.append(sheet[at:])
        skipped: list[bool] = []  # of the open blocks around a rule
        hiding, head = 0, ""
        for part in re.split(r"([{}])", "".join(clean)):
            if part == "{":
                rule = head.rsplit(";", 1)[-1].strip()
                if rule.startswith("@") or "{" in head:
                    medium = rule.lower().split()
                    skipped.append(medium[:1] != ["@media"] or medium[1:] not in (["screen"], ["all"]))
                    hiding, head = hiding + skipped[-1], ""
                else:
                    head = rule + "{"
            elif part == "}":
                selectors, brace, body = head.partition("{")
                if brace:
                    if not hiding:
                        yield selectors, _declarations(body)
                elif skipped:
                    hiding -= skipped.pop()
                head = ""
            else:
                head += part

    def of(self, node: Node) -> dict[str, str]:
        """The element's own display and visibility, where anything sets them."""
        own = {"." + c for c in node.attributes.get("class", "").split()} | ({"#" + node.attributes["id"]} if node.attributes.get("id") else set())
        found: dict[str, tuple] = {}
        for key in [*own, node.tag, "*"] if self.rules else ():
            for weight, order, tag, parts, declared in self.rules.get(key, ()):
                if tag in ("*", node.tag) and parts <= own:
                    for name, (value, important) in declared.items():
                        found[name] = max(found.get(name, ((),)), ((important, 0, *weight, order), value))
        for name, (value, important) in _declarations(node.attributes.get("style", "")).items():
            found[name] = max(found.get(name, ((),)), ((important, 1), value))
        return {name: x[1] for name, x in found.items()}


def hidden(node: Node, style: dict[str, str]) -> bool:
    """Whether a browser shows nothing of the element, whatever is in it."""
    if node.tag in INVISIBLE:
        return True
    a = node.attributes
    if "display" in style:
        return style["display"] == "none"
    return "hidden" in a or (node.tag == "input" and a.get("type", "").lower() == "hidden") or (node.tag == "dialog" and "open" not in a)


def _sheets(root: Node) -> list[str]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag == "style" and node.attributes.get("media", "all").lower() in ("", "all", "screen"):
            out += [c for c in node.children if isinstance(c, str)]
        todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return out


def width(s: str) -> int:
    """Columns on screen: wide characters take two, combining and format characters none."""
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.category(c) in ("Mn", "Me", "Cf") else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


class _Flow:
    """Lines of one block container, with pending spaces and breaks."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.gap = 0
        self.indent = ""
        self.mark = ""

    def end_line(self) -> None:
        s = "".join(self.line)
        if s or self.mark:
            if self.lines and self.gap > 1:
                self.lines.append("")
            self.lines.append((self.indent[: len(self.indent) - len(self.mark)] + self.mark + s).rstrip())
            self.gap, self.mark = 0, ""
        self.line, self.space = [], False

    def block(self, spaced: bool) -> None:
        if self.line:
            self.end_line()
        self.gap = max(self.gap, 2 if spaced else 1)

    def inline(self, s: str) -> None:
        words = s.split()
        if not words:
            self.space |= bool(s and self.line)
            return
        if self.line and (self.space or s[0].isspace()):
            self.line.append(" ")
        self.line.append(" ".join(words))
        self.space = s[-1].isspace()

    def raw(self, s: str) -> None:
        first, *rest = s.split("\n")
        self.line.append(first)
        for x in rest:
            self.end_line() if self.line and "".join(self.line) else self.lines.append("")
            self.line = [x]

    def whole(self) -> list[str]:
        self.end_line()
        return self.lines


def _spans(node: Node, name: str, most: int) -> int:
    n = node.attributes.get(name, "1").strip()
    return min(max(int(n), 0), most) if n.isdecimal() and len(n) < 6 else 1


def _placed(rows: list[list[tuple[list[str], int, int]]]) -> list[list[tuple[int, int, list[str]]]]:
    """(column, span, lines) of each row's cells; columns that a cell from above takes are stepped over, and stay empty."""
    out, above = [], []  # above: (first column, one after the last, rows left)
    for row in rows:
        taken = sorted(above)
        cells, at, k = [], 0, 0
        for lines, across, down in row:
            while k < len(taken) and taken[k][0] < at + across:  # a cell lies right of those from above that it would meet
                at, k = max(at, taken[k][1]), k + 1
            cells.append((at, across, lines))
            if down != 1 and len(above) < SPANNING:
                above.append((at, at + across, down if down else len(rows)))
            at += across
        above = [(a, b, n - 1) for a, b, n in above if n > 1]
        out.append(cells)
    return out


class _Widths:
    """Widths of the columns that have one, with sums over ranges; the others, however many, are of width 0."""

    def __init__(self, columns: set[int]) -> None:
        self.columns = sorted(columns)
        self.own = [0] * len(self.columns)
        self.tree = [0] * (len(self.columns) + 1)

    def at(self, column: int) -> int:
        i = bisect.bisect_left(self.columns, column)
        return self.own[i] if i < len(self.columns) and self.columns[i] == column else 0

    def add(self, column: int, more: int) -> None:
        i = bisect.bisect_left(self.columns, column)
        self.own[i] += more
        i += 1
        while i < len(self.tree):
            self.tree[i] += more
            i += i & -i

    def before(self, column: int) -> int:
        i, total = bisect.bisect_left(self.columns, column), 0
        while i:
            total += self.tree[i]
            i -= i & -i
        return total

    def place(self, column: int) -> int:
        """Where a column begins, or ends with the separator after it."""
        return self.before(column) + 3 * column


def _between(row: list[tuple[int, int, list[str]]], widths: _Widths, after: int, until: int, pad: int) -> str:
    """What stands between the texts of two cells of a row (-1: its start, len(row): its end); over WIDE it is but a separator."""
    low = row[after][0] + row[after][1] if after >= 0 else 0
    high = row[until][0] if until < len(row) else row[-1][0] + row[-1][1]
    if pad + widths.place(high) - widths.place(low) > WIDE:
        return " | "
    parts = [" " * pad] if after >= 0 else []
    for column, span, _ in row[after + 1 : until]:
        parts += [" " * widths.at(x) for x in range(low, column)]
        parts.append(" " * (widths.place(column + span) - widths.place(column) - 3))
        low = column + span
    parts += [" " * widths.at(x) for x in range(low, high)]
    return " | ".join(parts + [""] if until < len(row) else parts)


def _table(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Lines of a table: columns as wide as their widest cell of span one, cells apart by ' | '.

    A cell over WIDE widens no column, and cells more than WIDE apart are apart by
    ' | ' alone: so a table has at most that much padding a cell, and each of its
    lines depends on the columns' widths only, not on how large the table is.
    """
    placed = _placed(rows)
    widths = _Widths({at + span - 1 for row in placed for at, span, _ in row})
    for spans in (False, True):
        for row in placed:
            for at, span, lines in row:
                need = max(map(width, lines), default=0)
                if need <= WIDE and (span > 1) == spans:
                    have = widths.place(at + span) - widths.place(at) - 3 if spans else widths.at(at)
                    widths.add(at + span - 1, max(0, need - have))
    out = []
    for row in placed:
        said: list[list[tuple[int, str]]] = [[] for _ in range(max((len(lines) for _, _, lines in row), default=0))]
        for i, (_, _, lines) in enumerate(row):
            for k, line in enumerate(lines):
                if line:
                    said[k].append((i, line))
        for texts in said:
            parts, last, pad = [], -1, 0
            for i, line in texts:
                parts += [_between(row, widths, last, i, pad), line]
                last, pad = i, max(0, widths.place(row[i][0] + row[i][1]) - widths.place(row[i][0]) - 3 - width(line))
            parts.append(_between(row, widths, last, len(row), pad))
            out.append("".join(parts).rstrip())
    return out


def render(root: Node) -> str:
    """All visible text of a tree."""
    styles = Styles(_sheets(root))
    flow = _Flow()
    flows, lists, tables = [flow], [], []
    pre = 0
    todo: list[tuple[Node | str, bool, bool]] = [(root, True, True)]  # (item, entering, visible)
    while todo:
        item, entering, shown = todo.pop()
        flow = flows[-1]
        if isinstance(item, str):
            if shown:
                flow.raw(item) if pre else flow.inline(item)
            continue
        tag = item.tag
        if entering:
            style = styles.of(item) if styles.rules or "style" in item.attributes else {}
            if hidden(item, style):
                continue
            if "visibility" in style:
                shown = style["visibility"] not in ("hidden", "collapse")
            if tag == "br":
                if "".join(flow.line) or flow.mark:
                    flow.end_line()
                elif flow.lines:
                    flow.gap = 2
                continue
            if tag in ("td", "th") and tables:
                flows.append(_Flow())
            elif tag == "table":
                flow.block(True)
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in BLOCK:
                flow.block(tag in SPACED and not (tag in ("ul", "ol") and lists))
                if tag in ("ul", "ol", "menu"):
                    start = item.attributes.get("start", "")
                    lists.append([tag, int(start) if start.lstrip("-").isdecimal() and len(start) < 10 else 1, flow.indent])
                elif tag == "li":
                    mark = "- "
                    if lists and lists[-1][0] == "ol":
                        mark = f"{lists[-1][1]}. "
                        lists[-1][1] += 1
                    outer = lists[-1][2] if lists else ""
                    flow.indent, flow.mark = outer + " " * len(mark), mark if shown else ""
                elif tag in ("blockquote", "dd"):
                    flow.indent += "  "
                elif tag == "pre":
                    pre += 1
            elif tag == "input" and shown and item.attributes.get("type", "text").lower() in _LABELLED:
                flow.inline(item.attributes.get("value") or item.attributes.get("placeholder", ""))
                continue
            elif tag == "img":
                continue
            todo.append((item, False, shown))
            inner = item.children
            if tag == "details" and "open" not in item.attributes:
                inner = [c for c in inner if isinstance(c, Node) and c.tag == "summary"][:1]
            todo.extend((c, True, shown) for c in reversed(inner))
        elif tag in ("td", "th") and tables:
            lines = flows.pop().whole()
            if not tables[-1]:
                tables[-1].append([])
            tables[-1][-1].append((lines, max(_spans(item, "colspan", 1000), 1), _spans(item, "rowspan", 65534)))
        elif tag == "table":
            rows = tables.pop()
            lines = _table(rows) if any(any(x) for r in rows for x, *_ in r) else []
            if lines:
                flow.end_line()
                if flow.lines:
                    flow.lines.append("")
                flow.lines += [(flow.indent + x).rstrip() for x in lines if x]
            flow.block(True)
        elif tag in BLOCK:
            if tag == "li":
                flow.end_line()
                flow.indent = lists[-1][2] if lists else flow.indent[:-2]
                flow.mark = ""
            flow.block(tag in SPACED and not (tag in ("ul", "ol", "menu") and len(lists) > 1))
            if tag in ("ul", "ol", "menu") and lists:
                flow.indent = lists.pop()[2]
            elif tag in ("blockquote", "dd"):
                flow.indent = flow.indent[:-2]
            elif tag == "pre":
                pre -= 1
    return "\n".join(flows[0].whole())


def page_text(page: str | None) -> str:
    """Visible text of a page; empty for null."""
    return render(parse(page)) if page else ""


def render_pages(pages: DataFrame, page_id: str = "page_id", markup: str = "html") -> DataFrame:
    """(page_id, text) for every row of pages.

    Null and empty pages, and pages that show nothing, have the empty text.
    Text without any tag is a page with one paragraph. Broken markup has some
    text, never an error. Of style rules those count that select an element by
    its own name, class or id; scripts are not run. Repeated rows and null ids are kept; other columns
    play no part; long pages are rendered whole. An empty table gives an empty
    result. There is no shuffle.
    """

    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        return pa.array([page_text(x) for x in column.to_pylist()], pa.string())

    return pages.select(F.col(page_id).alias("page_id"), text(F.col(markup)).alias("text"))
