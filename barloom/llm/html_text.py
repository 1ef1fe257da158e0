"""HTML extraction by layout-aware rendering.

``build`` reads tags and text into a tree in preorder (open, text and close events), adding the end
tags that HTML implies and dropping stray ones. ``render`` lays the tree out as a text browser
would: hidden elements are left out, formulas, texts in drawings and the options that a form shows
are not, blocks are set apart, list items get their marker and
indentation, preformatted text keeps its white space and table cells stand in aligned columns.

Both work without recursion and in time linear in the page, whatever its depth: where an element is
open is looked up and never searched. No text is dropped for depth, width or length; three layout
limits only say how far it is set out: a cell wider than ``WIDEST`` does not widen its column, lines
are indented by ``DEEPEST`` characters at most, and spans are clipped as HTML clips them
(``COLSPAN``, ``ROWSPAN``).
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their own end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that are never drawn: anywhere, in drawings (shapes to be used elsewhere count as such) and in formulas.
UNSEEN = frozenset("head script style title template noscript iframe noembed noframes object audio video canvas datalist".split())
UNSEEN_SVG = frozenset("desc metadata defs symbol clippath mask pattern marker filter lineargradient radialgradient".split())
UNSEEN_MATH = frozenset("annotation annotation-xml".split())
#: Elements in which a tag may close itself, elements in them that hold HTML again, and HTML tags that end them.
FOREIGN = frozenset("svg math".split())
ISLANDS = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
#: Parts of a formula whose children stand apart.
APART = frozenset("mfrac mtable mtr mlabeledtr".split())
#: Blocks with a blank line around them, and blocks that only start on a line of their own.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure fieldset".split())
BLOCKS = SPACED | frozenset(
    "address article aside body center dd details dialog dir div dt fieldset figcaption footer form header hgroup html legend li main menu nav option optgroup search section summary caption".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag implies the end of these, up to the nearest of the given containers.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr", "caption", "colgroup"), ("table",)),
    "tbody": (("tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)), "thead": (("tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)), "option": (("option",), ("select", "datalist", "optgroup")),
    "optgroup": (("optgroup",), ("select",)), "body": (("head",), ("html",)),
}
IN_HEAD = frozenset("html head meta link base title style script noscript template".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_MAY_HIDE = re.compile(r"hidden|style|display|visibility", re.I)
_OPEN_VALUE = re.compile(r"=\s*[^\s\"']+/$")
#: One attribute: a name and its value in double, single or no quotes. A quote never closed runs to the end.
_ATTRIBUTE = re.compile(r"([^\s/][^\s/=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s\"'][^\s]*+)))?")
#: Parts of a style in which colons and semicolons separate nothing.
_OPAQUE = re.compile(r"/\*.*?(?:\*/|$)|\"[^\"]*+\"?|'[^']*+'?|\([^()]*+\)", re.S)
_SPACE = re.compile(r"[ \t\n\r\f\v]+")
_NUMBER = re.compile(r"\s*([+-]?\d{1,9})")

WIDEST = 60
DEEPEST = 200
#: Limits of layout, never of text: columns that cells are set in, tables within tables, and blanks for each
#: character of a table's text, beyond which its cells stand in no columns.
COLUMNS, NESTED, BLANKS = 1000, 32, 64
#: The largest spans of a table cell in HTML.
COLSPAN, ROWSPAN = 1000, 65534


def build(source: str) -> list[tuple]:
    """The tree in preorder: ``(1, tag, attributes)``, ``(0, text)`` and ``(2, tag)`` events."""
    events: list[tuple] = []
    stack: list[str] = []
    places: dict[str, list[int]] = {}  # where in the stack each tag is open, outermost first
    i, n, tags = 0, len(source), _TAG

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            tag = stack.pop()
            places[tag].pop()
            events.append((2, tag))

    def last(names) -> int:
        """Where the innermost open element of these names stands; -1: none is open."""
        return max([places[t][-1] for t in names if places.get(t)], default=-1)

    def put_text(text: str) -> None:
        # Text behind an open head begins the body.
        if stack and stack[-1] in ("head", "html") and places.get("head") and text.strip(" \t\n\r\f"):
            close_to(places["head"][0])
        events.append((0, text))

    def foreign() -> int:
        """Where the drawing or formula stands that the place belongs to; -1: it is in HTML."""
        k = last(FOREIGN)
        return k if k > last(ISLANDS) else -1

    def find(names, stops) -> int:
        """Where the innermost of ``names`` stands, unless one of ``stops`` stands further in."""
        k = last(names)
        return k if k >= 0 and k >= last(stops) else -1

    while i < n:
        j = source.find("<", i)
        if j < 0:
            put_text(source[i:])
            break
        if j > i:
            put_text(source[i:j])
        m = tags.match(source, j)
        if m is None:
            nxt = source[j + 1 : j + 2]
            if source.startswith("<!--", j):
                e = source.find("-->", j + 4)
                i = n if e < 0 else e + 3
            elif source.startswith("<![CDATA[", j):
                e = source.find("]]>", j + 9)
                if foreign() >= 0:  # text, without entities
                    put_text(html.escape(source[j + 9 : n if e < 0 else e], quote=False))
                i = n if e < 0 else e + 3
            elif nxt and nxt in "!?/" or nxt.isalpha() and nxt.isascii():
                if nxt.isalpha() or nxt == "/" and source[j + 2 : j + 3].isalpha():
                    if tags is _TAG:  # a quote that is never closed: from here on quotes count for nothing
                        tags = _PLAIN_TAG
                        i = j
                        continue
                e = source.find(">", j)
                i = n if e < 0 else e + 1
            else:
                put_text("<")
                i = j + 1
            continue
        i = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                events += [(1, "br", ""), (2, "br")]
            elif tag == "p" and find(("p",), ("table", "td", "th")) < 0:
                events += [(1, "p", ""), (2, "p")]
            else:
                k = find((tag,), ("table",) if tag not in ("table", "body", "html", "tbody", "thead", "tfoot", "tr") else ())
                if k >= 0 and tag not in ("body", "html"):
                    close_to(k)
            continue
        if places.get("head") and tag not in IN_HEAD:
            close_to(places["head"][0])
        if foreign() >= 0:
            if tag in BREAKOUT:
                while (k := foreign()) >= 0:
                    close_to(k)
            elif m[3].endswith("/") and not _OPEN_VALUE.search(m[3]):
                events += [(1, tag, m[3]), (2, tag)]
                continue
        if tag in ("select", "input", "textarea") and places.get("select"):
            close_to(places["select"][0])
            if tag == "select":
                continue
        if tag in CLOSES:
            names, stops = CLOSES[tag]
            k = find(names, stops)
            if k >= 0:
                close_to(k)
        elif tag in BLOCKS:
            k = find(("p",), ("table", "td", "th", "li", "button", "object"))
            if k >= 0:
                close_to(k)
            if tag in HEADINGS and stack and stack[-1] in HEADINGS:
                close_to(len(stack) - 1)
        elif tag in ("hr", "a"):
            k = find(("p",) if tag == "hr" else ("a",), ("table", "td", "th", "li", "p", "div"))
            if k >= 0:
                close_to(k)
        events.append((1, tag, m[3]))
        if tag in VOID:
            events.append((2, tag))
        elif tag in RAW:
            e = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(source, i)
            if e is None:
                events += [(0, source[i:]), (2, tag)]
                break
            events += [(0, source[i : e.start()]), (2, tag)]
            g = source.find(">", e.end())
            i = n if g < 0 else g + 1
        else:
            places.setdefault(tag, []).append(len(stack))
            stack.append(tag)
    close_to(0)
    return events


def attributes(source: str) -> dict[str, str]:
    """Names in lower case and values of a tag's attributes; of equal names the first counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


def declarations(style: str) -> dict[str, str]:
    """Properties of a style attribute: the last declaration counts, an important one before others."""
    out: dict[str, str] = {}
    important: set[str] = set()
    for part in _OPAQUE.sub(lambda m: " " if m[0].startswith("/*") else "?", style).lower().split(";"):
        name, colon, value = part.partition(":")
        name, (value, bang, word) = name.strip(), value.partition("!")
        strong = bool(bang) and word.strip() == "important"
        if colon and value.strip() and (strong or not bang and name not in important):
            out[name] = value.strip()
            if strong:
                important.add(name)
    return out


def sight(source: str, drawing: bool = False) -> tuple[bool, str]:
    """Whether a tag's attributes take its element out of the page (a style's display outweighs
    ``hidden``), and its own ``visibility``, which an inner element may set anew ("" if it has none).
    In a drawing display and visibility may be attributes too, which a style outweighs."""
    if not _MAY_HIDE.search(source):
        return False, ""
    found = attributes(source)
    style = declarations(found["style"]) if "style" in found else {}
    if drawing:
        style = {k: found[k].strip().lower() for k in ("display", "visibility") if k in found} | style
    gone = style["display"] == "none" if "display" in style else "hidden" in found
    return gone, style.get("visibility", "")


def number(attributes_: str, name: str, default: int) -> int:
    """A whole-number attribute."""
    m = _NUMBER.match(attributes(attributes_).get(name, "")) if name in attributes_.lower() else None
    return int(m[1]) if m else default


def options(events: list[tuple], at: int) -> tuple[bool, int]:
    """Of the select that opens at ``at``: whether it is a list box, which shows all options, and the
    event of the one option that a drop-down shows (the last selected, else the first enabled one)."""
    found = attributes(events[at][2])
    size = found.get("size", "").strip()
    if "multiple" in found or size.isdecimal() and int(size) > 1:
        return True, -1
    chosen = first = -1
    depth, group = 0, False
    for k in range(at, len(events)):
        ev = events[k]
        if ev[0] == 2:
            depth -= 1
            if not depth:
                break
            group = group and ev[1] != "optgroup"
        elif ev[0] == 1:
            depth += 1
            if ev[1] == "optgroup":
                group = "disabled" in attributes(ev[2])
            elif ev[1] == "option":
                own = attributes(ev[2])
                if "selected" in own:
                    chosen = k
                elif first < 0 and not group and "disabled" not in own:
                    first = k
    return False, chosen if chosen >= 0 else first


class _Flow:
    """Lines of one block context: the page, or a table cell."""

    __slots__ = ("lines", "inline", "gap", "prefix", "marker")

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.gap = False
        self.prefix = ""
        self.marker = ""

    def end_line(self) -> None:
        if self.inline:
            text = _SPACE.sub(" ", "".join(self.inline)).strip(" ")
            self.inline = []
            if text:
                self.put(text)

    def put(self, text: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        if self.marker:
            self.lines.append(self.prefix[: max(0, len(self.prefix) - len(self.marker))] + self.marker + text)
            self.marker = ""
        else:
            self.lines.append(self.prefix + text)

    def block(self, spaced: bool) -> None:
        self.end_line()
        if spaced and not self.marker:
            self.gap = True


class _Table:
    __slots__ = ("rows",)

    def __init__(self) -> None:
        self.rows: list[list[tuple[int, int, list[str]]]] = []  # columns and rows that a cell spans, its lines

    def placed(self) -> Iterator[list[tuple[int, int, list[str]]]]:
        """The rows with (first column, columns, lines) of each cell: cells step aside for those above
        that reach down to them. Cells behind ``COLUMNS`` stand in no column."""
        taken: list[tuple[int, int, int]] = []  # column ranges of cells from above and the row they end before
        for y, row in enumerate(self.rows):
            taken = [x for x in taken if x[2] > y]
            out, new, at, k = [], [], 0, 0
            for across, down, cell in row:
                while k < len(taken) and taken[k][0] <= at:
                    at = max(at, taken[k][1])
                    k += 1
                out.append((min(at, COLUMNS), across, cell))
                to = min(at + across, COLUMNS)
                if down > 1 and at < to:
                    new.append((at, to, min(y + down, len(self.rows))))
                at = max(at, to)
            joined: list[tuple[int, int, int]] = []
            for x in sorted(taken + new) if new else taken:
                if joined and joined[-1][1] >= x[0] and joined[-1][2] == x[2]:
                    joined[-1] = (joined[-1][0], max(joined[-1][1], x[1]), x[2])
                else:
                    joined.append(x)
            taken = joined
            yield out

    def lay_out(self) -> list[str]:
        rows = [r for r in self.placed() if any(c for _, _, c in r)]
        if len(rows) == 1 and len(rows[0]) == 1:
            return rows[0][0][2]
        width: dict[int, int] = {}
        for r in rows:
            for at, across, cell in r:
                if at < COLUMNS:
                    w = max(map(len, cell), default=0) if across == 1 else 0
                    width[at] = max(width.get(at, 0), w if w <= WIDEST else 0)
        edge, total = {COLUMNS: 0}, 0  # where each column begins that has a cell of its own
        for c in sorted(width):
            edge[c] = total
            total += width[c] + 2
        plain = self._blanks(rows, edge) > BLANKS * sum(len(x) for r in rows for _, _, cell in r for x in cell)
        out = []
        for r in rows:
            for k in range(max(len(c) for _, _, c in r)):
                parts, n = [], 0
                for at, _, cell in r:
                    if k < len(cell):
                        gap = 0 if plain else edge[at] - n
                        gap = gap if gap >= 2 or not n else 2
                        parts += [" " * gap, cell[k]]
                        n += max(0, gap) + len(cell[k])
                out.append("".join(parts).rstrip())
        return out

    @staticmethod
    def _blanks(rows: list, edge: dict[int, int]) -> int:
        """At most so many blanks would set the cells in columns."""
        return sum(edge[at] * len(cell) for r in rows for at, _, cell in r[:1]) + sum(
            max(0, edge[y[0]] - edge[x[0]]) * len(y[2]) + (edge[x[0]] * max(0, len(y[2]) - len(x[2]))) for r in rows for x, y in zip(r, r[1:])
        )


def render(events: list[tuple]) -> str:
    """All visible text of a tree as laid-out lines."""
    flow = _Flow()
    outer: list[tuple] = []  # the flows around open cells
    tables: list[_Table] = []
    lists: list[list] = []  # [is numbered, next number, prefix outside]
    hidden = pre = flat = 0  # flat: open tables too deep to be set as tables
    hides: list[bool] = []
    seen: list[bool] = []  # whether what each open element holds is visible
    folded: list[int] = []  # depths of closed details whose summary is still to come; -1 behind it
    indents: list[str] = []
    svg = 0
    formula: list[str] = []  # open elements of a formula
    select, shown, option = 0, -1, 0  # 1: in a drop-down, 2: in a list box; its option shown; open options
    for at, ev in enumerate(events):
        kind = ev[0]
        visible = not seen or seen[-1]
        if kind == 0:
            if hidden or not visible or select and not option or folded and abs(folded[-1]) == len(seen):
                continue
            text = html.unescape(ev[1]) if "&" in ev[1] else ev[1]
            if pre:
                if events[at - 1][:2] == (1, "pre"):  # a line break right behind the tag is none
                    text = text.removeprefix("\r").removeprefix("\n")
                parts = text.expandtabs(8).replace("\r", "").split("\n")
                for x in parts[:-1]:
                    flow.inline.append(x)
                    joined = "".join(flow.inline)
                    flow.inline = []
                    flow.put(joined.rstrip())
                flow.inline.append(parts[-1])
            elif tables and not outer_is_cell(outer, tables):
                if text.strip():  # text between cells is moved before the table
                    flow.inline.append(text)
            else:
                flow.inline.append(text)
        elif kind == 1:
            tag, attrs = ev[1], ev[2]
            gone, own = sight(attrs, bool(svg)) if attrs else (False, "")
            if select == 1 and tag == "option":
                hide = at != shown
            else:
                hide = tag in UNSEEN or bool(svg) and tag in UNSEEN_SVG or bool(formula) and tag in UNSEEN_MATH or gone
                hide = hide or tag == "dialog" and "open" not in attributes(attrs)
                if folded and abs(folded[-1]) == len(seen):
                    if tag == "summary" and folded[-1] > 0:
                        folded[-1] = -folded[-1]
                    else:
                        hide = True
            if own in ("hidden", "collapse"):
                visible = False
            elif own == "visible":
                visible = True
            hides.append(hide)
            seen.append(visible)
            hidden += hide
            if tag == "details" and "open" not in attributes(attrs):
                folded.append(len(seen))
            if hidden:
                continue
            if formula or tag == "math":
                if formula and formula[-1] in APART:
                    flow.inline.append(" ")
                formula.append(tag)
            if tag == "option":
                option += 1
            if select == 1 and tag in ("option", "optgroup"):
                pass
            elif tag == "select":
                box, shown = options(events, at)
                select = 2 if box else 1
                flow.block(False) if box else flow.inline.append(" ")
            elif tag == "svg":
                svg += 1
            elif svg and tag in ("text", "foreignobject"):
                flow.block(False)
            elif tag in BLOCKS:
                if visible:
                    flow.block(tag in SPACED and not (tag in ("ul", "ol", "dl") and lists))
                if tag == "li":
                    level = lists[-1] if lists else [False, 1, flow.prefix]
                    if level[0]:
                        level[1] = number(attrs, "value", level[1])
                    marker = f"{level[1]}. " if level[0] else "- "
                    level[1] += 1
                    flow.prefix = (level[2] + " " * len(marker))[:DEEPEST]
                    if visible:
                        flow.marker = marker
                elif tag in ("ul", "ol", "menu", "dir"):
                    lists.append([tag == "ol", number(attrs, "start", 1) if tag == "ol" else 1, flow.prefix])
                elif tag in ("blockquote", "dd"):
                    indents.append(flow.prefix)
                    flow.prefix = (flow.prefix + "  ")[:DEEPEST]
                elif tag == "pre":
                    pre += 1
                elif tag == "table":
                    if len(tables) < NESTED:
                        tables.append(_Table())
                    else:
                        flat += 1
            elif tag == "br":
                if visible and (pre or flow.inline):
                    flow.end_line()
            elif tag == "hr":
                if visible:
                    flow.block(False)
                    flow.put("---")
            elif flat and tag in ("tr", "td", "th"):
                flow.block(False)
            elif tag == "tr":
                if tables:
                    tables[-1].rows.append([])
            elif tag in ("td", "th") and tables:
                if not tables[-1].rows:
                    tables[-1].rows.append([])
                across, down = number(attrs, "colspan", 1), number(attrs, "rowspan", 1)
                tables[-1].rows[-1].append((min(COLSPAN, max(1, across)), ROWSPAN if down == 0 else min(ROWSPAN, max(1, down)), []))
                flow.end_line()
                outer.append((flow, lists, pre, len(tables), indents))
                flow, lists, pre, indents = _Flow(), [], 0, []
        else:
            tag = ev[1]
            hide = hides.pop()
            if folded and abs(folded[-1]) == len(seen):
                folded.pop()
            seen.pop()
            if hidden:
                hidden -= hide
                continue
            if formula and formula.pop() in APART:
                flow.inline.append(" ")
            if tag == "option":
                option -= 1
            if select == 1 and tag in ("option", "optgroup"):
                pass
            elif tag == "select":
                flow.block(False) if select == 2 else flow.inline.append(" ")
                select = 0
            elif tag == "svg":
                svg -= 1
            elif svg and tag in ("text", "foreignobject"):
                flow.block(False)
            elif flat and tag in ("tr", "td", "th"):
                flow.end_line()
            elif tag in ("td", "th") and outer and outer[-1][3] == len(tables):
                flow.end_line()
                lines = flow.lines
                flow, lists, pre, _, indents = outer.pop()
                tables[-1].rows[-1][-1][2].extend(lines)
            elif tag in BLOCKS:
                if tag == "pre":
                    if flow.inline:
                        text = "".join(flow.inline).rstrip()
                        flow.inline = []
                        if text:
                            flow.put(text)
                    pre = max(0, pre - 1)
                if tag == "table" and flat:
                    flat -= 1
                elif tag == "table" and tables:
                    flow.block(True)
                    for x in tables.pop().lay_out():
                        flow.put(x) if x else flow.lines.append("")
                if visible:
                    flow.block(tag in SPACED and not (tag in ("ul", "ol", "dl") and len(lists) > 1))
                if tag == "li":
                    flow.marker = ""
                    flow.prefix = lists[-1][2] if lists else flow.prefix[:-2]
                elif tag in ("ul", "ol", "menu", "dir") and lists:
                    flow.prefix = lists.pop()[2]
                elif tag in ("blockquote", "dd") and indents:
                    flow.prefix = indents.pop()
    flow.end_line()
    return "\n".join(flow.lines)


def outer_is_cell(outer: list, tables: list) -> bool:
    return bool(outer) and outer[-1][3] == len(tables)


def extract(source: str | None) -> str:
    """The visible text of one page; null or empty: ""."""
    return render(build(source)) if source else ""


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``(page_id, text)`` for every row: a page's visible text. A null or empty page has the text
    "". Ids are numbers and may repeat or be null; rows are independent of each other; other columns
    are ignored; an empty table gives an empty result; no page is cut, however long or deep."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([extract(x) for x in part.column(1).to_pylist()], pa.string())], ["page_id", "text"])

    return pages.select(col(id_col).cast("long").alias("page_id"), col(html_col).alias("html")).mapInArrow(run, "page_id long, text string")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    return extract_pages(pages).withColumn("n_chars", F.char_length("text").cast("long"))
