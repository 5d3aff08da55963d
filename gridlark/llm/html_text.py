"""Visible text of HTML pages, laid out as a browser would place it.

A tree builder turns tags into nested elements, with the end tags that HTML implies;
visibility rules leave out what is not shown; the renderer keeps paragraphs apart,
marks list items, and pads table cells so that columns line up.
"""

from __future__ import annotations

import bisect
import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_w = lambda s: frozenset(s.split())
#: Elements by their part in HTML's parsing and display.
VOID = _w("area base br col embed hr img input link meta param source track wbr")
RAW = _w("script style title textarea xmp iframe noembed noframes")
HIDDEN = _w("head script style title template noscript iframe object canvas audio video datalist noembed noframes annotation annotation-xml defs desc metadata symbol clippath mask")
BLOCK = _w("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul")
SPACED = _w("blockquote dl figure h1 h2 h3 h4 h5 h6 menu ol p pre table ul")
#: An opening tag closes these open elements, looking no further out than the given ones.
IMPLIED = {
    "li": (_w("li"), _w("ul ol menu dir")),
    "dt": (_w("dt dd"), _w("dl")),
    "dd": (_w("dt dd"), _w("dl")),
    "td": (_w("td th"), _w("tr table")),
    "th": (_w("td th"), _w("tr table")),
    "tr": (_w("td th tr caption"), _w("table")),
    "thead": (_w("td th tr thead tbody tfoot caption colgroup"), _w("table")),
    "tbody": (_w("td th tr thead tbody tfoot caption colgroup"), _w("table")),
    "tfoot": (_w("td th tr thead tbody tfoot caption colgroup"), _w("table")),
    "option": (_w("option"), _w("select")),
    "body": (_w("head"), _w("html")),
}
#: Levels of lists that indent; deeper items are shown as far in.  Cells up to so wide line up; wider ones are shown whole and push on.  Columns a cell may span, cells that may reach into further rows at once, and characters a line is padded to: beyond, text stays and columns shift.
DENT, WIDE, SPAN, REACHING, PADDED = 512, 120, 1000, 100, 1000
SCOPES = _w("td th caption table button object template html body")

#: A tag up to its end; quotes count after an equals sign only, as in browsers, and an unclosed one is a plain character.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[\"'=])*+)>")
_TAG_OPENS, _NOT_TEXT = re.compile(r"</?[a-zA-Z]"), re.compile(r"<[!?]|</[^a-zA-Z]")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=][^\s>/=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_BRACE, _SIMPLE = re.compile(r"[{}]"), re.compile(r"[.#]?[A-Za-z][\w-]*")
_BLANKS = re.compile(r"[ \t\n\r\f]+")


def attributes(said: str | None) -> dict[str, str]:
    """Names and values of a tag's attributes; of repeated names the first counts."""
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(said or ""):
        out.setdefault(name.lower(), html.unescape("".join(values)))
    return out


def _next(page: str, at: int) -> tuple[str, re.Match | None, int]:
    """The text from `at` to the next markup, the tag if it is one, and where to read on.

    Every character is passed once: a tag without an end swallows the rest, as in browsers,
    or where no tag can end any more the rest is text.
    """
    start = at
    while (i := page.find("<", at)) >= 0:
        tag = _TAG.match(page, i)
        if tag:
            return page[start:i], tag, tag.end()
        if _NOT_TEXT.match(page, i):
            dashes = page.startswith("<!--", i)
            end = page.find("-->" if dashes else ">", i + 2)
            return page[start:i], None, end + (3 if dashes else 1) if end >= 0 else len(page)
        if _TAG_OPENS.match(page, i):
            if page.find(">", i) >= 0:
                return page[start:i], None, len(page)
            break
        at = i + 1
    return page[start:], None, len(page)


def _declared(said: str) -> dict[str, tuple[bool, str]]:
    """Properties of a style: whether important, and the value; an important one stays, else the last counts."""
    out: dict[str, tuple[bool, str]] = {}
    for part in _COMMENT.sub("", said).split(";"):
        name, _, value = part.lower().partition(":")
        value, mark, _ = value.partition("!")
        if bool(mark) >= out.get(name.strip(), (False, ""))[0]:
            out[name.strip()] = (bool(mark), value.strip())
    return out


class _Sheet:
    """Rules of style elements so far, of simple selectors (tag, .class, #id) and without at-rules; an id outweighs a class, a class a tag."""

    def __init__(self):
        self.of: dict[str, list[tuple[int, int, dict]]] = {}
        self.n = 0

    def read(self, text: str) -> None:
        text, at = _COMMENT.sub("", text), 0
        while (i := text.find("{", at)) >= 0:
            said, depth, j = text[at:i].strip(), 1, i + 1
            for m in _BRACE.finditer(text, i + 1):
                depth += 1 if m[0] == "{" else -1
                j = m.end()
                if not depth:
                    break
            else:
                j = len(text)
            at = j
            if said.startswith("@"):
                continue
            self.n += 1
            declared = {k: v for k, v in _declared(text[i + 1 : j].rstrip("}")).items() if k in ("display", "visibility")}
            for one in said.split(",") if declared else ():
                one = one.strip()
                if _SIMPLE.fullmatch(one):
                    self.of.setdefault(one if one[0] in ".#" else one.lower(), []).append(({"#": 2, ".": 1}.get(one[0], 0), self.n, declared))

    def style(self, tag: str, has: dict[str, str]) -> dict[str, tuple[bool, str]]:
        if not self.of:
            return {}
        names = [tag, *("." + c for c in has.get("class", "").split()), *(["#" + has["id"]] if "id" in has else [])]
        out: dict[str, tuple[bool, str]] = {}
        for _, _, declared in sorted((r for n in names for r in self.of.get(n, ())), key=lambda r: r[:2]):
            out |= {k: v for k, v in declared.items() if v[0] >= out.get(k, (False, ""))[0]}
        return out


def _not_shown(has: dict[str, str], style: dict[str, tuple[bool, str]]) -> bool:
    """Whether an element's attributes or rules hide it: the name hidden, or the display or visibility that counts, its own style before the rules."""
    if "hidden" in has and "display" not in style:
        return True
    if "style" in has:
        style = style | {k: v for k, v in _declared(has["style"]).items() if v[0] >= style.get(k, (False, ""))[0]}
    return style.get("display", (False, ""))[1] == "none" or style.get("visibility", (False, ""))[1] in ("hidden", "collapse")


def _picked(page: str, at: int) -> int:
    """The number of the option that a closed select, whose content starts at `at`, shows: the last selected one, else the first that is not disabled; -1 if none."""
    n, first, chosen = 0, -1, -1
    while at < len(page):
        _, m, at = _next(page, at)
        if m is None:
            continue
        tag = m[2].lower()
        if tag in ("select", "input", "textarea"):
            break
        if tag == "option" and not m[1]:
            has = attributes(m[3])
            chosen = n if "selected" in has else chosen
            first = n if first < 0 and "disabled" not in has else first
            n += 1
    return chosen if chosen >= 0 else first


def elements(page: str) -> Iterator[tuple[str, str, bool, dict[str, str]]]:
    """("open", tag, shown, attributes), ("close", tag, True, {}) and ("text", text, True, {}), nested: the tree in document order.

    Options of a list box and texts of a drawing come as div, each on lines of its own.
    Rules of a style element count from there on.
    """
    stack: list[tuple[str, str]] = []  # open elements: their tag, and what they come as
    places: dict[str, list[int]] = {}  # of each tag, where in the stack it is open
    picked, option = None, 0  # of the select that is open: the option shown (None: all), and options so far
    at, sheet = 0, _Sheet()

    def innermost(tags: frozenset[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def close(tags: frozenset[str], until: frozenset[str]):
        """Closes all that lies inside the innermost of `tags` that is open within `until`, and it."""
        i = innermost(tags)
        if i >= 0 and i >= innermost(until):
            while len(stack) > i:
                tag, comes_as = stack.pop()
                places[tag].pop()
                yield "close", comes_as, True, {}

    while at < len(page):
        text, m, at = _next(page, at)
        if text:
            yield "text", html.unescape(text), True, {}
        if m is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and not places.get("p"):
                yield "open", "p", True, {}
                yield "close", "p", True, {}
            elif tag == "br":
                yield "open", "br", True, {}
            else:
                yield from close(frozenset((tag,)), frozenset() if tag in ("table", "body", "html") else frozenset(("table",)) if tag in ("ul", "ol", "p", "div", "li") else frozenset())
            continue
        if tag in BLOCK:
            yield from close(frozenset(("p",)), SCOPES)
        inner = IMPLIED.get(tag)
        if inner:
            # one closing for each level: a row's start ends an open cell and then the row
            before = -1
            while before != len(stack):
                before = len(stack)
                yield from close(*inner)
        has = attributes(m[3]) if m[3] else {}
        shown = not _not_shown(has, sheet.style(tag, has))
        if tag in VOID:
            if shown:
                yield "open", tag, True, has
            continue
        drawn = bool(places.get("svg"))
        if (drawn or places.get("math") or tag in ("svg", "math")) and m[3].rstrip().endswith("/"):  # closed at once
            continue
        comes_as = "div" if tag == "text" and drawn else tag
        if tag == "select":
            yield from close(frozenset(("select",)), frozenset())
            size = has.get("size", "").strip()
            picked, option = (None if "multiple" in has or (size.isdecimal() and int(size[:9]) > 1) else _picked(page, at)), 0
        elif tag == "option" and places.get("select"):
            if picked is None:
                comes_as = "div"
            else:
                shown = shown and option == picked
            option += 1
        yield "open", comes_as, shown, has
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            body, at = page[at : end.start() if end else len(page)], end.end() if end else len(page)
            if tag == "style" and has.get("type", "text/css").strip().lower() in ("", "text/css"):
                sheet.read(body)
            yield "text", html.unescape(body) if tag in ("title", "textarea") else body, True, {}
            yield "close", tag, True, {}
        else:
            places.setdefault(tag, []).append(len(stack))
            stack.append((tag, comes_as))
    while stack:
        yield "close", stack.pop()[1], True, {}


class _Flow:
    """Lines of a page or of a table cell."""

    def __init__(self):
        self.lines: list[str] = []
        self.line, self.gap, self.blank = "", False, 0

    def text(self, s: str, indent: str) -> None:
        if not s:
            return
        if not self.line:
            s = s.lstrip(" ")
            if not s:
                return
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = 0
            self.line = indent
        elif self.line.endswith(" ") and s.startswith(" "):
            s = s[1:]
        self.line += s

    def end(self, blank: bool = False) -> None:
        if self.line.strip():
            self.lines.append(self.line.rstrip(" "))
        self.line = ""
        self.blank |= blank


def _width(s: str) -> int:
    """Columns that a text takes where wide characters take two and combining ones none."""
    return len(s) if s.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def _span(has: dict[str, str], name: str, most: int) -> int:
    said = has.get(name, "").strip()
    return max(1, min(int(said[:6]), most)) if said.isascii() and said.isdecimal() else 1


def _table(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Lines of rows of cells (text, columns, rows spanned): each cell starts in its column."""
    placed: list[list[tuple[int, int, str, int]]] = []  # of each row: column, columns, text, width
    reaching: list[tuple[int, int, int]] = []  # of cells that reach into further rows: column, columns, last row
    for i, row in enumerate(rows):
        reaching = sorted(r for r in reaching if r[2] >= i)
        out, c, k = [], 0, 0
        for text, across, down in row:
            while k < len(reaching) and reaching[k][0] <= c:
                c = max(c, reaching[k][0] + reaching[k][1])
                k += 1
            out.append((c, across, text, _width(text)))
            if down > 1 and len(reaching) < REACHING:
                reaching.append((c, across, i + down - 1))
            c += across
        placed.append(out)
    widths: dict[int, int] = {}
    for c, across, _, w in sorted((x for row in placed for x in row if x[2]), key=lambda x: x[1]):
        # what a spanning cell needs more than its columns have goes to the last one
        last = c + across - 1
        have = sum(widths.get(k, 0) + 2 for k in range(c, last)) if across > 1 else 0
        widths[last] = max(widths.get(last, 0), min(w, WIDE) - have)
    columns = sorted(widths)
    starts, at = {}, 0
    for k in columns:
        starts[k] = at
        at += max(widths[k], 0) + 2
    lines = []
    for row in placed:
        line, wide = [], 0
        for c, across, text, w in row:
            if not text:
                continue
            first = next((k for k in columns[bisect.bisect_left(columns, c) :]), c)
            gap = max(min(starts.get(first, 0), PADDED) - wide, 2 if line else 0)
            line.append(" " * gap + text)
            wide += gap + w
        if line:
            lines.append("".join(line).rstrip(" "))
    return lines


def rendered(page: str) -> str:
    """The visible text of a page: lines, with a blank one between spaced blocks."""
    flows = [_Flow()]
    tables: list[list[list[tuple[str, int, int]]]] = []
    spans: list[tuple[int, int]] = []  # of the cells that are open
    lists: list[int] = []  # -1 in a bulleted list, else the last number
    hidden, pre, marker = 0, 0, ""
    shut: list[bool] = []  # for each open element, whether it hid its content
    for kind, what, shown, has in elements(page):
        flow = flows[-1]
        if kind == "text":
            if hidden:
                continue
            if pre:
                first, *rest = what.replace("\r\n", "\n").split("\n")
                flow.text(first, "")
                for x in rest:
                    flow.end()
                    flow.line = x
                continue
            s = _BLANKS.sub(" ", what)
            if s.strip(" ") and not flow.line and lists:
                flow.text(s, "  " * min(len(lists) - 1, DENT) + (marker or "  "))
                marker = ""
            else:
                flow.text(s, "")
            continue
        if kind == "open":
            if what in VOID:
                if not hidden:
                    if what == "br":
                        flow.end()
                    elif what == "hr":
                        flow.end(True)
                continue
            off = what in HIDDEN or not shown
            shut.append(off)
            hidden += off
            if hidden:
                continue
            if what in BLOCK:
                flow.end(what in SPACED and not (what in ("ul", "ol") and lists))
            if what in ("ul", "ol", "menu", "dir"):
                lists.append(0 if what == "ol" else -1)
            elif what == "li":
                if lists and lists[-1] >= 0:
                    lists[-1] += 1
                marker = f"{lists[-1]}. " if lists and lists[-1] >= 0 else "- "
                if not lists:
                    flow.text(marker, "")
            elif what == "pre":
                pre += 1
            elif what == "table":
                tables.append([])
            elif what == "tr" and tables:
                tables[-1].append([])
            elif what in ("td", "th"):
                flows.append(_Flow())
                spans.append((_span(has, "colspan", SPAN), _span(has, "rowspan", 65534)))
                if tables and not tables[-1]:
                    tables[-1].append([])
            continue
        off = shut.pop()
        if hidden:
            hidden -= off
            continue
        if what in ("td", "th"):
            flow.end()
            cell = " ".join(x.strip() for x in flow.lines if x.strip())
            across, down = spans.pop() if spans else (1, 1)
            if len(flows) > 1:
                flows.pop()
            if tables and tables[-1]:
                tables[-1][-1].append((cell, across, down))
            else:
                flows[-1].text(f" {cell} ", "")
            continue
        if what == "table" and tables:
            flow.end()
            flow.lines += ([""] if flow.blank and flow.lines else []) + _table(tables.pop())
            flow.end(True)
        elif what in ("ul", "ol", "menu", "dir") and lists:
            flow.end(len(lists) == 1)
            lists.pop()
        elif what == "pre":
            pre -= 1
            flow.end(True)
        elif what in BLOCK:
            flow.end(what in SPACED)
    for flow in flows:
        flow.end()
    return "\n".join(x for flow in flows for x in flow.lines).strip("\n")


def page_text(pages: DataFrame, id_cols: list[str], html_col: str = "html") -> DataFrame:
    """id_cols and text of each row.

    A null page has an empty text.  Broken markup is read as far as it goes, in time
    that grows with the page, and never fails.  Repeated rows each give a row; an empty table gives none.  Other columns are ignored.
    """
    base = pages.select(*id_cols, F.col(html_col).cast("string"))
    n = len(id_cols)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                text = [rendered(p) if p else "" for p in part.column(n).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(n)), pa.array(text, pa.string())], [*(f"c{i}" for i in range(n)), "text"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:-1]] + ["text string"])
    return base.mapInArrow(run, schema)
