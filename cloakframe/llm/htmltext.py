"""Visible text of web pages, laid out: blocks, lists and aligned table cells.

A builder turns markup into properly nested elements with implied tags; a renderer follows them, leaves
out what is not shown, and lays the text out. Both keep a stack and read the page once.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from cloakframe.llm.common import map_rows

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
_HIDDEN = frozenset(
    "head title script style template noscript iframe object embed audio video canvas datalist noembed noframes area meter "
    "progress rp".split()
)
# Within drawings and formulas these are not shown.
_FOREIGN = {
    "svg": frozenset("desc defs metadata symbol clippath mask marker pattern".split()),
    "math": frozenset("annotation annotation-xml mphantom".split()),
}
_CDATA = "<![CDATA["
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot "
    "th thead tr ul caption".split()
)
_APART = frozenset("p blockquote pre table ul ol menu dir dl figure h1 h2 h3 h4 h5 h6 hr fieldset".split())
_LISTS = frozenset("ul ol menu dir".split())
# Start tags that end an open element, and the elements beyond which nothing is ended.
_IMPLIED = {
    "li": (frozenset(["li"]), _LISTS),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "body": (frozenset(["head"]), frozenset()),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select", "datalist"])),
    "select": (frozenset(["select"]), frozenset(["table", "td", "th"])),
    "rt": (frozenset(["rt", "rp"]), frozenset(["ruby"])),
}
_IMPLIED |= {"rp": _IMPLIED["rt"], "thead": _IMPLIED["tbody"], "tfoot": _IMPLIED["tbody"], "caption": _IMPLIED["tbody"]}
_CLOSES_P = (_BLOCKS - frozenset("li dd dt td th tr tbody thead tfoot caption body html legend summary".split())) | {"p"}
_SCOPE = frozenset("table td th caption button li dd object template html body".split())
_HEAD = frozenset("head title meta link base style script noscript template".split())
#: Deeper levels of lists and quotes are not indented further, and the cells of deeper tables are lines.
_DEPTH = 512

_TAG = re.compile(r"<(?:(!--)|([!?])|(/?)([A-Za-z][^\s/>]*))")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_BLANK = re.compile(r"[ \t\r\n\f]+")
_NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)")


# -- markup to events ------------------------------------------------------------------------------


def _tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """Place of the ``>`` that ends a tag, outside its quoted values; -1 if there is none."""
    while True:
        end = page.find(">", at)
        if end < 0:
            return -1
        quotes = [q for q in (page.find('"', at, end), page.find("'", at, end)) if q >= 0]
        if not quotes:
            return end
        quote = min(quotes)
        before = page[at:quote].rstrip()
        if not before.endswith("=") or quote >= last[page[quote]]:
            at = quote + 1  # not the start of a value, or one that never ends
            continue
        at = page.find(page[quote], quote + 1) + 1


def markup(page: str) -> Iterator[tuple[str, str, str]]:
    """``text``, ``start`` and ``end`` events with name and attributes as they stand in the page."""
    at, last = 0, {q: page.rfind(q) for q in "\"'"}
    foreign = 0  # open drawings and formulas, where tags can close themselves and marked sections are text
    while at < len(page):
        found = _TAG.search(page, at)
        if not found:
            break
        if found.start() > at:
            yield "text", page[at : found.start()], ""
        comment, other, closing, name = found.groups()
        if comment:
            end = page.find("-->", found.end())
            at = end + 3 if end >= 0 else len(page)
            continue
        if foreign and other and page.startswith(_CDATA, found.start()):
            start = found.start() + len(_CDATA)
            end = page.find("]]>", start)
            yield "text", html.escape(page[start : end if end >= 0 else len(page)]), ""
            at = end + 3 if end >= 0 else len(page)
            continue
        end = page.find(">", found.end()) if other else _tag_end(page, found.end(), last)
        if end < 0:
            return
        at = end + 1
        if other:
            continue
        name = name.lower()
        yield "end" if closing else "start", name, page[found.end() : end]
        if not closing and page[end - 1] == "/" and (foreign or name in _FOREIGN):
            yield "end", name, ""
            continue
        if name in _FOREIGN:
            foreign = max(0, foreign - 1) if closing else foreign + 1
        if name in _RAW and not closing:
            close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            stop = close.start() if close else len(page)
            yield "raw", page[at:stop], ""
            at = stop
    if at < len(page):
        yield "text", page[at:], ""


def elements(page: str) -> Iterator[tuple[str, str, str]]:
    """The events with implied tags in place: every start has its end, in nested order."""
    open_: list[str] = []
    places: defaultdict[str, list[int]] = defaultdict(list)  # where the open elements of a name are, so no depth makes this slow

    def close_to(depth: int) -> Iterator[tuple[str, str, str]]:
        while len(open_) > depth:
            name = open_.pop()
            places[name].pop()
            yield "end", name, ""

    def implied(ends: frozenset, barrier: frozenset) -> int:
        """Depth to close to so that no open element of ``ends`` is left above the barrier."""
        above = max((places[b][-1] for b in barrier if places[b]), default=-1)
        depth = len(open_)
        for name in ends:
            at = places[name]
            if at and at[-1] > above:
                depth = min(depth, at[bisect_right(at, above)])
        return depth

    for kind, name, rest in markup(page):
        if kind in ("text", "raw"):
            yield kind, name, ""
        elif kind == "start":
            if name in ("html", "body") and places[name]:
                continue
            if places["head"] and name not in _HEAD:
                yield from close_to(places["head"][0])
            if name in _CLOSES_P and places["p"]:
                yield from close_to(implied(frozenset(["p"]), _SCOPE))
            if name in _IMPLIED:
                yield from close_to(implied(*_IMPLIED[name]))
            yield "start", name, rest
            if name in _VOID:
                yield "end", name, ""
            else:
                places[name].append(len(open_))
                open_.append(name)
        elif places[name] and name not in ("html", "body"):
            depth = places[name][-1]
            table = places["table"][-1] if places["table"] else -1
            if depth >= table:  # an end tag in a cell does not reach out of its table
                yield from close_to(depth)
        elif name == "br":
            yield "start", "br", ""
            yield "end", "br", ""
    yield from close_to(0)


# -- events to text --------------------------------------------------------------------------------


@dataclass
class _Flow:
    """Lines of one block context, such as the page or a table cell."""

    lines: list[str] = field(default_factory=list)
    words: list[str] = field(default_factory=list)
    indents: list[str] = field(default_factory=list)
    marker: str = ""
    gap: int = 0  # blank lines owed before the next line
    space: bool = False

    def add(self, text: str) -> None:
        if not text:
            return
        pieces = _BLANK.split(text)
        if self.words and (self.space or pieces[0] == "") and any(pieces):
            self.words.append(" ")
        self.space = pieces[-1] == "" and bool(any(pieces) or self.words)
        self.words.append(" ".join(p for p in pieces if p))
        if not any(pieces):
            self.words.pop()

    def line(self, text: str) -> None:
        indent = "".join(self.indents[:_DEPTH])
        if self.marker:
            text, self.marker = indent.removesuffix(" " * len(self.marker)) + self.marker + text, ""
        else:
            text = indent + text
        if self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        self.lines.append(text.rstrip())

    def end_line(self) -> None:
        if self.words:
            self.line("".join(self.words))
        self.words, self.space = [], False

    def broken(self) -> None:
        """A line ends here even if it is empty."""
        if self.words:
            self.end_line()
        elif self.lines:
            self.gap += 1

    def apart(self) -> None:
        self.end_line()
        self.gap = max(self.gap, 1)

    def raw(self, text: str) -> None:
        """Preformatted text: its line ends stay."""
        first, *others = text.split("\n")
        self.words.append(first)
        for part in others:
            self.line("".join(self.words))
            self.words = [part]

    def finish(self) -> list[str]:
        self.end_line()
        return self.lines


@dataclass
class _Table:
    rows: list[list[tuple[int, str]]] = field(default_factory=list)
    spanned: dict[int, int] = field(default_factory=dict)  # column: rows it is still taken by a cell from above
    column: int = 0

    def new_row(self) -> None:
        self.spanned = {c: n - 1 for c, n in self.spanned.items() if n > 1}
        self.rows.append([])
        self.column = 0

    def cell(self, text: str, columns: int, rows: int) -> None:
        if not self.rows:
            self.new_row()
        while self.column in self.spanned:
            self.column += 1
        self.rows[-1].append((self.column, text))
        if rows > 1:
            self.spanned |= {c: rows for c in range(self.column, self.column + columns)}
        self.column += columns

    def lines(self) -> Iterator[str]:
        widths: dict[int, int] = {}
        for row in self.rows:
            for (column, text), after in zip(row, [*row[1:], None], strict=False):
                if after is None or after[0] == column + 1:
                    widths[column] = max(widths.get(column, 0), len(text))
        places, at = {}, 0
        for column in range(max((c for row in self.rows for c, _ in row), default=-1) + 1):
            places[column] = at
            at += widths.get(column, 0) + 2
        for row in self.rows:
            out = ""
            for column, text in row:
                out = (out.ljust(places[column]) if len(out) < places[column] else out + "  " * bool(out)) + text
            if out.strip():
                yield out


@dataclass
class _Select:
    """The options of a control that are shown: the chosen one, or all of a list box."""

    box: bool
    options: list[tuple[str, bool, bool, bool]] = field(default_factory=list)  # text, selected, disabled, shown
    flow: _Flow | None = None
    label: str = ""
    flags: tuple[bool, bool, bool] = (False, False, True)

    def start(self, given: dict[str, str]) -> None:
        self.flow, self.label = _Flow(), given.get("label", "")
        self.flags = "selected" in given, "disabled" in given, _shown("option", given)

    def end(self) -> None:
        if self.flow is not None:
            self.options.append((self.label or " ".join(self.flow.finish()), *self.flags))
        self.flow = None

    def text(self) -> str:
        if self.box:
            return " ".join(text for text, _, _, shown in self.options if shown)
        chosen = [o for o in self.options if o[1]][-1:] or [o for o in self.options if not o[2]][:1]
        return chosen[0][0] if chosen else ""


def _number(value: str | None, default: int, most: int = 1000) -> int:
    return min(most, int(value)) if value and value.strip().isdecimal() else default


def attributes(rest: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(rest):
        out.setdefault(name.lower(), html.unescape(double or single or bare))
    return out


def _shown(name: str, given: dict[str, str]) -> bool:
    if name in _HIDDEN or "hidden" in given or (name == "dialog" and "open" not in given):
        return False
    return not _NOT_SHOWN.search(given.get("style", "").lower())


def visible_text(page: str | None) -> str:
    """All text that the page shows, with its layout. Empty for a page without any, or none."""
    flows, tables, cells = [_Flow()], [], []
    counters: list[int | None] = []
    hidden, kept = 0, [0]  # open elements inside a hidden one; the same for what closed details hold back
    pre = 0
    folded: list[int] = []
    selects: list[_Select] = []
    foreign: list[str] = []
    depth = 0
    for kind, name, rest in elements(page or ""):
        flow = flows[-1]
        if kind in ("text", "raw"):
            if hidden or folded:
                continue
            if selects:
                if selects[-1].flow is not None:
                    selects[-1].flow.add(html.unescape(name).replace("\xa0", " "))
            elif pre:
                flow.raw(html.unescape(name))
            elif flows[1:] or not tables or name.strip():
                flow.add(html.unescape(name).replace("\xa0", " "))
        elif kind == "start":
            depth += 1
            given = attributes(rest) if rest.strip() else {}
            option = name == "option" and selects  # the control shows a chosen option that its list hides
            if hidden or not (option or _shown(name, given)) or (foreign and name in _FOREIGN[foreign[-1]]):
                hidden += 1
                continue
            if folded and not (name == "summary" and folded[-1] == depth - 1):
                continue
            if name == "summary" and folded and folded[-1] == depth - 1:
                kept.append(folded.pop())
            if name == "select":
                selects.append(_Select("multiple" in given or _number(given.get("size"), 1) > 1))
            elif selects:
                if name == "option":
                    selects[-1].start(given)
                continue
            if name in _FOREIGN:
                foreign.append(name)
            elif foreign and name in ("text", "mtr"):
                flow.end_line()
            elif foreign and name in ("mtd", "mfrac"):
                flow.add(" ")
            if name == "br":
                flow.broken() if not pre else flow.raw("\n")
            elif name in ("tr", "td", "th") and tables and tables[-1] is None:
                flow.end_line()
            elif name in ("td", "th") and tables:
                flows.append(_Flow())
                cells.append((_number(given.get("colspan"), 1) or 1, _number(given.get("rowspan"), 1) or 1))
            elif name == "tr" and tables:
                tables[-1].new_row()
            elif name == "table":
                flow.apart()
                tables.append(_Table() if len(tables) < _DEPTH else None)
            elif name in _BLOCKS:
                flow.apart() if name in _APART and not (name in _LISTS and counters) else flow.end_line()
            if name in _LISTS:
                counters.append(_number(given.get("start"), 1, 10**9) if name == "ol" else None)
            elif name == "li":
                marker = "- "
                if counters and counters[-1] is not None:
                    marker = f"{_number(given.get('value'), counters[-1], 10**9)}. "
                    counters[-1] = int(marker[:-2]) + 1
                flow.indents.append(" " * len(marker))
                flow.marker = marker
            elif name in ("dd", "blockquote"):
                flow.indents.append("  ")
            elif name == "pre":
                pre += 1
            elif name == "details" and "open" not in given:
                folded.append(depth)
        else:
            depth -= 1
            if hidden:
                hidden -= 1
                continue
            if folded and folded[-1] == depth + 1:
                folded.pop()
            elif folded:
                continue
            if name == "summary" and len(kept) > 1 and kept[-1] == depth:
                folded.append(kept.pop())
            if name == "select":
                shown = selects.pop().text()
                if selects or not shown:
                    continue
                if pre:
                    flow.raw(shown)
                else:
                    flow.add(" " + shown + " ")
                continue
            if selects:
                if name == "option":
                    selects[-1].end()
                continue
            if name in _FOREIGN and foreign:
                foreign.pop()
            elif foreign and name in ("text", "mtr"):
                flow.end_line()
            elif foreign and name in ("mtd", "mfrac"):
                flow.add(" ")
            if name in ("tr", "td", "th") and tables and tables[-1] is None:
                flow.end_line()
            elif name in ("td", "th") and tables and cells and len(flows) > 1:
                text = " ".join(line.strip() for line in flows.pop().finish() if line.strip())
                tables[-1].cell(text, *cells.pop())
            elif name == "table":
                table = tables.pop()
                for line in table.lines() if table else ():
                    flow.line(line)
                flow.gap = max(flow.gap, 1)
            elif name in _BLOCKS and name != "tr":
                flow.apart() if name in _APART and not (name in _LISTS and len(counters) > 1) else flow.end_line()
            if name in _LISTS and counters:
                counters.pop()
            elif name == "li":
                if flow.marker:
                    flow.line("")
                if flow.indents:
                    flow.indents.pop()
            elif name in ("dd", "blockquote") and flow.indents:
                flow.indents.pop()
            elif name == "pre":
                pre -= 1
    return "\n".join(flows[0].finish())


def extract_text(pages: DataFrame, key: str = "page_id", page: str = "html") -> DataFrame:
    """``key, text, n_chars, n_lines`` of each page.

    Null and empty pages give an empty text of no lines. Rows are independent: repeats give repeats, null keys
    stay, and an empty table gives no rows. Other columns are not looked at.
    """

    def rows(part: Iterable[tuple]) -> Iterator[tuple]:
        for name, content in part:
            text = visible_text(content)
            yield name, text, len(text), text.count("\n") + 1 if text else 0

    kind = pages.schema[key].dataType.simpleString()
    out = map_rows(pages.select(key, page), rows, f"name {kind}, text string, n_chars long, n_lines long", 128)
    return out.withColumnRenamed("name", key)
