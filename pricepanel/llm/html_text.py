"""Main text of web pages from streaming parser events and text-to-tag ratios.

The standard library's parser streams events; block tags end a line. Each line has a ratio of its
text to its tags, where text inside menus, adverts, forms and the like counts for nothing. The
ratios are smoothed with a Gaussian over neighbouring lines; a threshold on the smoothed ratios
splits the lines into content and the rest. The content lines vote for the element that holds the
main text: an article or main element, else the deepest container of nearly all their text. The
text is what that element holds outside boilerplate, with the content lines beside it and the blocks
that adjoin at both ends up to a line of links, in page order. A named element ends the text; several
of like size are all part of it. A line that is links for the most part has no ratio of its own to speak of and is never content.
A class word that may also name part of an article (one of ``_WEAK_WORDS``, or any word beside others
that name no part of a page's frame: ``social-history``) makes boilerplate of an element unless it
stands in an article and has the ratio of content. All steps are linear in the page: elements are
numbered in the order in which they open, so those inside one are a range of numbers.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

#: Standard deviation of the smoothing, in lines.
SIGMA = 1.5
#: Content lines have a smoothed ratio of at least this many standard deviations of all ratios.
THRESHOLD = 0.5
#: Share of the content lines' text that a container must hold.
SHARE = 0.8

_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody td tfoot th thead title tr ul".split()
)
_INLINE_BREAK = {"br", "img", "input"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_MAIN = {"article", "main"}
_BOILER_TAGS = set("nav header footer aside form script style noscript template iframe svg button select textarea dialog menu head title object canvas audio video math search".split())
_BOILER_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist status".split())
_BOILER_WORDS = set(
    "ad ads adbox adslot adunit adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist "
    "consent cookie cookies copyright disclaimer discussion disqus feedback footer form gdpr header login masthead menu modal nav navbar navigation "
    "newsletter notice notices notification notifications outbrain overlay pager pagination paywall popup popular promo promotion promotions "
    "recommended related replies reply respond search share sharing sidebar sidebars signin signup skip social sponsor sponsored subscribe "
    "subscription taboola teaser teasers toolbar topbar trending warning widget widgets alert alerts".split()
)
#: Of these, words that may also name part of an article; and the least text, and most of it in links, that it then has.
_WEAK_WORDS = {"warning", "alert", "alerts", "popular", "share", "form", "header", "widget"}
WEAK_CHARS, WEAK_LINKS = 120, 0.25
#: Words that name parts of a page's frame, whatever it holds (fixed values); beside these a word of boilerplate keeps its sense.
_FRAME_WORDS = set(
    "all area article articles bar block blog board body bottom box btn button buttons card cards close col cols column columns container content count "
    "desktop entry field fixed grid group header heading icon icons id inline inner input item items js label large left level link links list lists main "
    "mini mobile modal module more new news number outer page pane panel post posts primary reader right root row rows secondary section site size slot "
    "small sticky stories story text thread title top tree unit user users wrap wrapper zone".split()
)
#: The least share of the largest article's text that makes another one part of the text.
LIKE_SIZE = 1 / 3
#: Lines of a page's foot that say who owns it.
_OWNER = re.compile(r"(?i)^(?:©|\(c\)|copyright\s+(?:©|\(c\)|\d{4})|&copy;)|^.{0,160}all rights reserved\.?$")
OWNER_CHARS = 240
_NOT_BOILER_AFTER = {"has", "with", "no", "without", "is"}
# An open element that the start of another one ends.
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "optgroup": {"option", "optgroup"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
# An end tag or an implied end does not reach beyond these.
_SCOPE = {"table", "article", "main", "section", "nav", "header", "footer", "aside", "form", "ul", "ol", "dl", "body", "html", "div", "td", "th"}
_P_ENDERS = _BLOCK - {"body", "head", "html", "title", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "summary", "figcaption"}


def _words(value: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])", value)]


@dataclass
class _Line:
    text: str
    tags: int
    boiler: bool
    container: int  # innermost open block element
    link_chars: int
    weak: int  # innermost element that a weak word marks
    title: bool  # inside a first-level heading


class _Lines(HTMLParser):
    """Parser events -> lines, and what the elements are: tag, last number inside, element around."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, int]] = []  # tag, element number, 1: boilerplate, 2: header in an article, 3: weak
        self.at: dict[str, list[int]] = defaultdict(list)  # places in the stack by tag, of blocks and of scopes
        self.number = 0
        self.tags_of: dict[int, str] = {}
        self.parent: dict[int, int] = {}  # of block elements: the block element around
        self.last: dict[int, int] = {}  # largest number inside a closed element
        self.weak_in_main: dict[int, bool] = {}
        self.boiler = 0
        self.headers = 0  # open headers inside an article: only headings count there
        self.heading = 0
        self.links = 0
        self.mains = 0
        self.parts: list[str] = []
        self.aside: list[str] = []  # text of the line inside boilerplate, which may be inline
        self.tags = 0
        self.link_chars = 0
        self.lines: list[_Line] = []

    def _number_at(self, key: str) -> int:
        return self.stack[self.at[key][-1]][1] if self.at[key] else 0

    def flush(self) -> None:
        aside, text = " ".join("".join(self.aside).split()), " ".join("".join(self.parts).split())
        if aside or text:
            where, weak, title = self._number_at("#block"), self._number_at("#weak"), bool(self.at["h1"])
            if aside:
                self.lines.append(_Line(aside, 0 if text else self.tags, True, where, 0, weak, title))
            if text:
                self.lines.append(_Line(text, self.tags, False, where, self.link_chars, weak, title))
        self.parts, self.aside, self.tags, self.link_chars = [], [], 0, 0

    def _boilerplate(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        """1 for boilerplate, 3 if only a weak word says so, else 0."""
        if tag in ("html", "body"):
            return 0
        values = {k: v or "" for k, v in attrs}
        if tag in _BOILER_TAGS or "hidden" in values or values.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", values.get("style", "")):
            return 1
        if set(values.get("role", "").lower().split()) & _BOILER_ROLES:
            return 1
        if tag in _HEADINGS:
            return 0
        found = 0
        for value in (*values.get("class", "").split(), values.get("id", "")):
            words = _words(value)
            framed = all(w in _BOILER_WORDS or w in _FRAME_WORDS or w in _NOT_BOILER_AFTER or w.isdigit() for w in words)
            for i, w in enumerate(words):
                if w in _BOILER_WORDS and not (i and words[i - 1] in _NOT_BOILER_AFTER):
                    if framed and w not in _WEAK_WORDS:
                        return 1
                    found = 3
        return found

    def _push(self, tag: str, begins: int) -> None:
        self.number += 1
        place, n = len(self.stack), self.number
        if tag in _BLOCK:
            self.parent[n] = self._number_at("#block")
            self.at["#block"].append(place)
        if tag in _SCOPE:
            self.at["#scope"].append(place)
        if begins == 3:
            self.at["#weak"].append(place)
            self.weak_in_main[n] = self.mains > 0
        self.at[tag].append(place)
        self.stack.append((tag, n, begins))
        self.boiler += begins == 1
        self.headers += begins == 2
        self.heading += tag in _HEADINGS
        self.links += tag == "a"
        self.mains += tag in _MAIN

    def _pop(self) -> None:
        tag, n, begins = self.stack.pop()
        self.at[tag].pop()
        if tag in _BLOCK:
            self.at["#block"].pop()
        if tag in _SCOPE:
            self.at["#scope"].pop()
        if begins == 3:
            self.at["#weak"].pop()
        self.last[n] = self.number
        self.boiler -= begins == 1
        self.headers -= begins == 2
        self.heading -= tag in _HEADINGS
        self.links -= tag == "a"
        self.mains -= tag in _MAIN

    def _close(self, names: set[str], barrier: set[str]) -> None:
        """Close the innermost open element of ``names`` and all inside it, unless one of ``barrier`` lies between."""
        top = lambda keys: max((self.at[k][-1] for k in keys if self.at[k]), default=-1)
        place = top(names)
        if place >= 0 and top(barrier) <= place:
            while len(self.stack) > place:
                self._pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _BLOCK:
            self.flush()
            if tag in _P_ENDERS:
                self._close({"p"}, {"#scope"})
            if tag in _CLOSES:
                self._close(_CLOSES[tag], {"table", "ul", "ol", "dl", "select", "menu"} - {tag})
            if tag == "body":
                self._close({"head"}, {"body"})
        elif tag in _INLINE_BREAK:
            self.parts.append(" ")
        self.tags += 1
        if tag in _VOID:
            return
        begins = self._boilerplate(tag, attrs)
        if begins and self.mains and not self.boiler:
            titled = tag == "header" or (tag in ("div", "section", "hgroup") and not self._boilerplate(tag, [(k, re.sub("(?i)header", "", v or "")) for k, v in attrs]))
            named = tag == "header" or any("header" in _words(v or "") for k, v in attrs if k in ("class", "id"))
            begins = 2 if titled and named else begins
        self._push(tag, begins)
        self.tags_of[self.number] = tag if dict(attrs).get("role") != "main" else "main"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash at the end has no meaning in HTML

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCK:
            self.flush()
        elif tag == "br":
            self.parts.append(" ")
        self.tags += 1
        if tag in _BLOCK or tag in _BOILER_TAGS:
            self._close({tag}, {"body", "html"} - {tag})
        else:
            self._close({tag}, {"#block"})

    def handle_data(self, data: str) -> None:
        if self.boiler > 0 or (self.headers > 0 and not self.heading):
            self.aside.append(data)
        else:
            self.parts.append(data)
            if self.links:
                self.link_chars += len(data)

    def finish(self) -> list[_Line]:
        self.close()
        self.flush()
        while self.stack:
            self._pop()
        self._weigh_weak()
        return self.lines

    def _weigh_weak(self) -> None:
        """Lines inside an element that a weak word marks are boilerplate unless it is content by its ratio."""
        sums: dict[int, list[int]] = defaultdict(lambda: [0, 0, 0])
        for x in self.lines:
            if x.weak and not x.boiler:
                for k, v in enumerate((len(x.text), x.tags, x.link_chars)):
                    sums[x.weak][k] += v
        others = [len(x.text) / max(1, x.tags) for x in self.lines if not x.boiler and not x.weak]
        usual = sum(others) / len(others) if others else 0.0
        for x in self.lines:
            if x.weak and not x.boiler:
                chars, tags, links = sums[x.weak]
                x.boiler = not (self.weak_in_main[x.weak] and chars >= WEAK_CHARS and links <= WEAK_LINKS * chars and chars / max(1, tags) >= usual / 2)


def _smooth(values: np.ndarray) -> np.ndarray:
    reach = math.ceil(3 * SIGMA)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    middle = slice(reach, reach + len(values))
    return np.convolve(values, kernel)[middle] / np.convolve(np.ones(len(values)), kernel)[middle]


def _without_open_end(html: str) -> str:
    """The page up to a tag, comment or declaration that never ends, which has no content."""
    if cut := re.compile(r"<[A-Za-z/!?]").search(html, html.rfind(">") + 1):
        return html[: cut.start()]
    return html


def blocks(html: str | None) -> list[str]:
    """The blocks of the main text, in page order."""
    parser = _Lines()
    html = _without_open_end(html or "")
    at = 0
    while at < len(html):  # the parser keeps what an incomplete event needs; the longer that is, the more is fed at once
        size = max(1 << 16, len(parser.rawdata))
        parser.feed(html[at : at + size])
        at += size
    lines = parser.finish()
    for x in reversed(lines):  # who owns the page stands below its text, among links
        if len(x.text) <= OWNER_CHARS and _OWNER.search(x.text):
            x.boiler = True
        elif not x.boiler and x.link_chars <= len(x.text) / 2:
            break
    if all(x.boiler for x in lines):
        return []
    ratio = np.array([0.0 if x.boiler else len(x.text) / max(1, x.tags) * (1 - min(1.0, x.link_chars / len(x.text))) for x in lines])
    smooth = _smooth(ratio)
    limit = min(THRESHOLD * float(ratio.std()), float(smooth.max()))
    content = [s >= limit and x.link_chars <= len(x.text) / 2 and not x.boiler for s, x in zip(smooth.tolist(), lines, strict=True)]
    if not any(content):
        content = [not x.boiler for x in lines]
    held: dict[int, int] = defaultdict(int)
    for x, yes in zip(lines, content, strict=True):
        if yes:
            held[x.container] += len(x.text)
    total = sum(held.values())
    for n in sorted(parser.parent, reverse=True):  # from inside out
        if held.get(n):
            held[parser.parent[n]] += held[n]
    held.pop(0, None)
    named = sorted(n for n in held if parser.tags_of[n] in _MAIN and held[n])
    best: list[int] = []
    outer: list[int] = []
    if named:
        # those of like size, and of nested ones (an article inside main) the innermost that holds as much
        most = max(held[n] for n in named)
        enough = [n for n in named if held[n] >= LIKE_SIZE * most]
        best = [n for n in enough if held[n] >= SHARE * max(held[m] for m in enough if m <= n <= parser.last[m])]
        # what a main or article around it holds besides (a title, a lead) belongs to it
        for n in named:
            if any(n <= m <= parser.last[n] for m in best) and not (outer and n <= parser.last[outer[-1]]):
                outer.append(n)
    else:
        # short blocks beside a long table or list may stand at any level
        wide = max((n for n in held if held[n] >= SHARE * total and parser.tags_of[n] not in ("p", "li", *_HEADINGS)), default=None)
        best = [wide] if wide is not None and parser.tags_of[wide] not in ("body", "html") else []

    def within(elements: list[int], x: _Line) -> bool:
        k = bisect_right(elements, x.container) - 1
        while k >= 0 and parser.last[elements[k]] < x.container:
            k = around[elements[k]]
        return k >= 0

    around: dict[int, int] = {}  # of the elements of a list: the place of the one around
    for elements in (best, outer):
        open_: list[int] = []
        for k, n in enumerate(elements):
            while open_ and parser.last[elements[open_[-1]]] < n:
                open_.pop()
            around[n] = open_[-1] if open_ else -1
            open_.append(k)
    inside = [not outer or within(outer, x) for x in lines]
    at = [i for i, x in enumerate(lines) if inside[i] and not x.boiler and (content[i] or within(best, x))]
    first, last = at[0], at[-1]
    # short blocks at both ends, up to the next line of links
    links = [not x.boiler and x.link_chars > len(x.text) / 2 for x in lines]
    while first and inside[first - 1] and not links[first - 1]:
        first -= 1
    while last + 1 < len(lines) and inside[last + 1] and not links[last + 1]:
        last += 1
    kept = [i for i in range(first, last + 1) if inside[i] and not lines[i].boiler]
    if named:
        # a first-level heading above the element is its title
        above = first
        while above and not links[above - 1]:
            above -= 1
            if lines[above].title and not lines[above].boiler:
                kept = [i for i in range(above, first) if not lines[i].boiler] + kept
                break
    return [lines[i].text for i in kept]


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row; blocks of the text are joined by two newlines.

    A null or empty html, or one without text, gives an empty text. Repeated rows give repeated
    results, other columns are ignored, an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n\n".join(blocks(h.as_py())) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"]
            )

    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("id", "url")]
    out = rows.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
