"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped to lines, one a block of the page, with an empty line wherever a container begins or ends. Text lengths are summed over
windows of lines; the text between the point where the sums surge and the point where they dive is the article. Lines that belong to
menus, notices, adverts, forms or comments by their markup have no length and are never kept.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Lines of a window, and the share of the greatest sum at which a surge begins and a dive ends.
WINDOW, SURGE = 3, 0.2
# A line is a link if more than this share of its characters lies in links.
LINK_SHARE = 0.5
BATCH_BYTES = 8 << 20

# Names of elements by what they mean for the text of a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noembed noframes iframe xmp title textarea".split())
DROPPED = frozenset("head script style noscript template nav footer aside button select textarea iframe object svg math canvas audio "
                    "video dialog menu map noembed noframes xmp title datalist".split())
CONTAINERS = frozenset("html body div section article main nav header footer aside form fieldset table tbody thead tfoot tr ul ol dl menu "
                       "dialog details figure blockquote center hgroup".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre address caption figcaption legend option summary hr".split())
PARTS = frozenset("ul ol dl table tbody thead tfoot tr blockquote figure hgroup header details".split())
PLAIN = frozenset("html body article main".split())
# What an opening tag ends: elements that are closed by it, up to an element that keeps them apart.
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
             "option": ("option",)}
APART = frozenset("ul ol dl table menu select body article section div".split())
# Words of class and id that name what is not the article, and roles that do.
HINTS = frozenset("ad ads adv advert adverts advertisement advertising adbox sponsor sponsored sponsors promo promos promotion promoted banner "
                  "cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login "
                  "sidebar sidebars widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs masthead topbar header footer "
                  "comment comments disqus respond replies reply discussion share sharing social related recommended recommendations pagination "
                  "pager toolbar copyright disclaimer skip".split())
# A heading with one of the second words beside it is the article's own; a hint after one of the last is none ("no-sidebar").
HEADS = frozenset("header banner".split())
OWN = frozenset("article post entry story".split())
NEGATIONS = frozenset("no has with without".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())

_MARK = re.compile(r"<!--(?:>|->)|<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|</([^>]*)(?:>|\Z)"
                   r"|<([a-zA-Z][^\s/>]*+)((?:=\s*+\"[^\"]*\"|=\s*+'[^']*'|[^>])*+)(?:>|\Z)", re.S)
_RAW_END = {name: re.compile(rf"</{name}(?![a-z0-9])", re.I) for name in sorted(RAW)}
_NAMED = re.compile(r"(?:^|[\s\"'/])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Line:
    """A block's text, how much of it lies in links, the container it stands in and the innermost suspect element around it."""

    __slots__ = ("text", "size", "linked", "inside", "suspect")

    def __init__(self, text: str, size: int, linked: int, inside: int, suspect: int):
        self.text, self.size, self.linked, self.inside, self.suspect = text, size, linked, inside, suspect


class Suspect:
    """An element that is beside the article by its markup, unless the article turns out to stand in it."""

    __slots__ = ("around", "form", "headed", "article")

    def __init__(self, around: int, form: bool):
        self.around, self.form, self.headed, self.article = around, form, False, False


def _hinted(name: str, attributes: str) -> bool:
    """Whether the attributes of an element name it as something beside the article."""
    if not attributes or name in PLAIN:
        return False
    for found in _NAMED.finditer(attributes):
        key, value = found[1].lower(), (found[2] or "").strip("\"'")
        if key in ("class", "id"):
            for named in value.split():
                parts = [part.lower() for part in _PART.findall(named)]
                if HINTS.intersection(parts) and not (HEADS.intersection(parts) and OWN.intersection(parts)) and parts[0] not in NEGATIONS:
                    return True
        elif key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        elif key == "style" and _HIDDEN.search(value):
            return True
    return False


class Page:
    """The lines of a page. Containers are numbered as they begin; 0 is the page itself."""

    def __init__(self, source: str):
        self.lines: list[Line] = []
        self.names, self.parents, self.ends = ["page"], [0], [0]
        self._suspects = [Suspect(0, False)]
        self._suspect_stack, self._container_stack = [0], [0]
        self._stack: list[tuple[str, bool, bool]] = []  # name, dropped, suspect
        self._open: Counter[str] = Counter()
        self._dropped = 0
        self._text: list[str] = []
        self._linked = 0
        self._read(source)
        self._end_line()
        self.ends = [end or len(self.names) - 1 for end in self.ends]
        kept = self._cleared()
        self.lines = [line for line in self.lines if not line.text or kept[line.suspect]]

    def _cleared(self) -> list[bool]:
        """For each suspect whether it and all around it hold the article, or are forms that hold its heading."""
        suspects = self._suspects
        for one in reversed(suspects[1:]):
            around = suspects[one.around]
            around.headed, around.article = around.headed or one.headed, around.article or one.article
        kept = [True]
        for one in suspects[1:]:
            kept.append((one.article or one.form and one.headed) and kept[one.around])
        return kept

    def within(self, container: int, line: Line) -> bool:
        return container <= line.inside <= self.ends[container]

    def _end_line(self) -> None:
        text = " ".join("".join(self._text).split())
        if text:
            self.lines.append(Line(text, len(text), self._linked, self._container_stack[-1], self._suspect_stack[-1]))
        self._text, self._linked = [], 0

    def _gap(self) -> None:
        """An empty line between containers."""
        if self.lines and self.lines[-1].text:
            self.lines.append(Line("", 0, 0, self._container_stack[-1], 0))

    def _read(self, source: str) -> None:
        at = 0
        while (found := _MARK.search(source, at)) is not None:
            if found.start() > at:
                self._add(source[at:found.start()])
            at = found.end()
            if found[2]:
                name = found[2].lower()
                self._begin(name, found[3] or "")
                if name in RAW:
                    end = _RAW_END[name].search(source, at)
                    if end is None:
                        return
                    at = end.start()
            elif found[1] and found[1].strip():
                self._end(found[1].split(None, 1)[0].lower())
        self._add(source[at:])

    def _add(self, text: str) -> None:
        if self._dropped or not text:
            return
        text = html.unescape(text)
        self._text.append(text)
        if self._open["a"]:
            self._linked += len(" ".join(text.split()))

    def _begin(self, name: str, attributes: str) -> None:
        inner = self._open["article"] or self._open["main"]
        innermost = self._suspects[self._suspect_stack[-1]]
        if name in ("article", "main"):
            innermost.article = True
        elif name == "h1":
            innermost.headed = True
        if name == "br":
            self._text.append("\n")
            return
        if name in BLOCKS:
            self._end_line()
            if self._open["p"]:
                self._close("p", APART)
        for closing in CLOSED_BY.get(name, ()):
            if self._open[closing]:
                self._close(closing, APART)
        if name in CONTAINERS:
            self._gap()
        if name in VOID:
            return
        dropped = name in DROPPED
        suspect = not dropped and (name == "form" or name == "header" and not inner or _hinted(name, attributes))
        if not (dropped or suspect or name in BLOCKS or name == "a" or self._open[name]):
            return
        self._stack.append((name, dropped, suspect))
        self._open[name] += 1
        self._dropped += dropped
        if suspect:
            self._suspects.append(Suspect(self._suspect_stack[-1], name == "form"))
            self._suspect_stack.append(len(self._suspects) - 1)
        if name in CONTAINERS:
            self.parents.append(self._container_stack[-1])
            self._container_stack.append(len(self.names))
            self.names.append(name)
            self.ends.append(0)

    def _end(self, name: str) -> None:
        if name in BLOCKS:
            self._end_line()
        if self._open[name]:
            self._close(name)
        if name in CONTAINERS:
            self._gap()

    def _close(self, name: str, apart: frozenset[str] = frozenset()) -> None:
        """Ends the innermost element of that name and all inside it, unless one of ``apart`` stands between."""
        if apart:
            for other, _, _ in reversed(self._stack):
                if other == name:
                    break
                if other in apart:
                    return
        while True:
            other, dropped, suspect = self._stack.pop()
            self._open[other] -= 1
            self._dropped -= dropped
            if suspect:
                self._suspect_stack.pop()
            if other in CONTAINERS:
                self.ends[self._container_stack.pop()] = len(self.names) - 1
            if other == name:
                return


def window_sums(sizes: list[int]) -> np.ndarray:
    """At each line the greatest sum over a window of ``WINDOW`` lines that holds it."""
    padded = np.concatenate([np.zeros(WINDOW - 1, np.int64), np.asarray(sizes, np.int64), np.zeros(WINDOW - 1, np.int64)])
    sums = np.convolve(padded, np.ones(WINDOW, np.int64), "valid")
    return np.lib.stride_tricks.sliding_window_view(sums, WINDOW).max(axis=1)


def _between(lines: list[Line]) -> tuple[int, int]:
    """First and last line between the surge and the dive that enclose most text."""
    sizes = [0 if line.linked > LINK_SHARE * line.size else line.size for line in lines]
    if not any(sizes):
        return 0, -1
    sums = window_sums(sizes)
    high = sums >= SURGE * sums.max()
    edge = np.diff(np.concatenate([[0], high.astype(np.int8), [0]]))
    surges, dives = np.nonzero(edge > 0)[0], np.nonzero(edge < 0)[0] - 1
    total = np.append(0, np.cumsum(sizes))
    best = int(np.argmax(total[dives + 1] - total[surges]))
    first, last = int(surges[best]), int(dives[best])
    while first < last and not sizes[first]:
        first += 1
    while last > first and not sizes[last]:
        last -= 1
    return first, last


def _menus(page: Page) -> set[int]:
    """Places of lines that are lists of links."""
    of_list: dict[int, list[int]] = {}
    for at, line in enumerate(page.lines):
        if line.text and page.names[line.inside] in ("ul", "ol"):
            of_list.setdefault(line.inside, []).append(at)
    found = set()
    for places in of_list.values():
        if sum(page.lines[at].linked for at in places) > LINK_SHARE * sum(page.lines[at].size for at in places):
            found.update(places)
    return found


def _home(page: Page, texts: list[Line]) -> int:
    """The innermost container that holds all of ``texts``: the article if the page names one around it, and no part of a list or table."""
    home = texts[0].inside
    for line in texts:
        while not page.within(home, line):
            home = page.parents[home]
    article = home
    while article and page.names[article] not in ("article", "main"):
        article = page.parents[article]
    if article:
        return article
    while page.names[home] in PARTS:
        home = page.parents[home]
    return home


def main_text(source: str | None) -> str:
    """The article of a page: its blocks in order, joined by blanks."""
    page = Page(source or "")
    menus = _menus(page)
    lines = [Line("", 0, 0, line.inside, 0) if at in menus else line for at, line in enumerate(page.lines)]
    first, last = _between(lines)
    if last < first:
        return ""
    home = _home(page, [line for line in lines[first:last + 1] if line.text])
    whole = page.names[home] in ("article", "main")

    def beside(line: Line) -> bool:
        """Whether the region grows over this line: to the borders of a named article, else over lines that stand in the same container."""
        if not page.within(home, line):
            return False
        at = line.inside
        while not whole and line.text and at != home:
            if page.names[at] not in PARTS:
                return False
            at = page.parents[at]
        return True

    while first and beside(lines[first - 1]):
        first -= 1
    while last + 1 < len(lines) and beside(lines[last + 1]):
        last += 1
    return " ".join(line.text for line in lines[first:last + 1] if line.text)


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "text", "n_chars"]
    for batch in batches:
        texts, start, size = [], 0, 0
        for at, source in enumerate(batch.column(2), 1):
            texts.append(main_text(source.as_py()))
            size += len(texts[-1])
            if size >= BATCH_BYTES or at == batch.num_rows:
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(start, at - start) for i in (0, 1)], pa.array(texts, pa.string()),
                                                  pa.array([len(t) for t in texts], pa.int64())], names)
                texts, start, size = [], at, 0


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html): the main text of the whole page.

    Character references are decoded, white space inside a block becomes one blank, blocks are joined by one. Elements that are by their
    name, class, id or role menus, headers, footers, sidebars, notices, adverts, forms or comments are left out, unless what is
    so named holds an ``article`` or ``main`` element, or is a form around the page's heading. Null and empty pages, and pages without text outside links, have an
    empty text. Rows are read one by one: nulls in other columns stay nulls, repeated rows give equal rows, an empty
    table gives none, other columns do not matter. Broken markup is read on as browsers do; pages of any length are read whole.
    """
    rows = pages.select(pages["page_id"], pages["url"], pages["html"])
    types = [f.dataType.simpleString() for f in rows.schema.fields[:2]]
    return rows.mapInArrow(_pages, f"page_id {types[0]}, url {types[1]}, text string, n_chars long")
