"""Main text of web pages by text-to-tag ratio.

The standard library's streaming parser delivers events; block elements end lines.  Each line has its text and the
number of tags that occur in it.  Ratios (text length over tags, 0 for lines in navigation and the like) are smoothed
with a Gaussian, and a two-cluster threshold on their logarithm marks content lines.  The marks select the regions:

* Where lines within ``article`` or ``main`` hold most of the marked text, every outermost article with a line that is
  marked by its own ratio as well, not by its neighbours' alone, is a region (a ``main`` without articles counts as
  one), and so are marked lines of a ``main`` outside its articles.  Without any such line, marked lines count.
* Else the region is the element whose marked text outweighs its unmarked text by most, from its first to its last
  marked line.

All lines of a region that are not left out are returned, short ones and headings too, with the headings and paragraphs
that adjoin it in the elements round it.

Elements are left out by name (``SKIP``), by role, by ``hidden``, or, containers only, by a class or id that
is made up of words for boilerplate (``BOILER``, with ``FILLER``) alone; ``commentlist`` or ``usercomments`` are such words. Paragraphs are left out by words for adverts and comments.  A form is left out unless it wraps an article, a main element
or most of the page's text; its controls always are.

Edge cases: a null or empty page has the empty text. Unclosed and crossed tags are closed by the next block of their
kind or with their parent; unknown declarations are skipped. A page without any tag is one block of text. Repeated rows
are extracted one by one; null urls and ids stay null. An empty table gives an empty result. Extra columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names, roles and class words.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
SECTION = frozenset("article body div main section table td".split())
NAMED = frozenset(("article", "main"))
PARAGRAPH = frozenset("h1 h2 h3 h4 h5 h6 p".split())
CONTAINER = frozenset("article center details div dl li ol section table tbody td tr ul".split())
CONTROL = frozenset("button fieldset input label legend option select textarea".split())
SKIP = frozenset("aside button dialog footer head iframe menu nav noscript object select script style svg template textarea title".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
BOILER = frozenset(
    "ad ads adsense advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies dialog discussion disqus "
    "footer gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted "
    "related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
COMMENT = frozenset("comment comments discussion replies reply".split())
ASIDE = COMMENT | frozenset("ad ads adsense advert advertisement advertising adverts promo promoted sponsor sponsored".split())  # of paragraphs
FILLER = frozenset(
    "area articles bar block blog bottom box btn button buttons column container content entry footer form global group header icons inner item items left links list main module "
    "outer page panel post posts primary reader region right row secondary section site slot stories thread top unit user wrap wrapper".split()
)
CLOSES = {  # an opening tag closes these, up to the nearest of the second set
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[^a-z]+")


@dataclass(frozen=True)
class Open:
    """An open element: whether left out, its section and form, whether in an article or main, its nearest block."""

    name: str
    out: bool
    section: int
    form: int
    named: bool
    block: str


@dataclass(frozen=True)
class Line:
    text: str
    tags: int
    section: int
    form: int
    paragraph: bool


def is_boilerplate(names: str, words: frozenset[str]) -> bool:
    """Whether one of the names is made up of the given words and fillers alone."""
    for name in names.lower().split():
        parts = {"comments" if p.startswith("comment") or p.endswith("comments") else p for p in WORD.split(name) if p}
        if not parts.isdisjoint(words) and parts <= words | BOILER | FILLER:
            return True
    return False


class Lines(HTMLParser):
    """Collects lines, and sections and forms with what they lie in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack = [Open("", False, 0, 0, False, "")]
        self.open: Counter = Counter()
        self.sections: list[tuple[str, int]] = [("body", -1)]  # name, parent
        self.wraps: list[bool] = [True]  # per form, whether an article or main lies in it; form 0 is none
        self.text: list[str] = []
        self.tags, self.dropped = 0, False
        self.out: list[Line] = []

    def flush(self) -> None:
        line, top = SPACE.sub(" ", "".join(self.text)).strip(), self.stack[-1]
        if line or self.dropped:  # a line that is wholly left out still counts in the smoothing
            self.out.append(Line(line, self.tags, top.section, top.form, top.block in PARAGRAPH))
        self.text, self.tags, self.dropped = [], 0, False

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """A ``<![`` section of any name ends at the next ``>``, or with the page."""
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else len(self.rawdata)

    def _left_out(self, tag: str, attrs: list, within: Open) -> bool:
        if tag in SKIP or within.form and tag in CONTROL:
            return True
        if tag == "header":
            return not within.named
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return True
            if name == "role" and value in ROLES and tag != "form":
                return True
            if name in ("class", "id") and value and (tag in CONTAINER or tag == "p") and is_boilerplate(value, {"article": COMMENT, "p": ASIDE}.get(tag, BOILER)):
                return True
        return False

    def _cut(self, at: int) -> None:
        self.open.subtract(x.name for x in self.stack[at:])
        del self.stack[at:]

    def _close(self, names: set, stops: set) -> None:
        while any(self.open[n] > 0 for n in names):
            for at in range(len(self.stack) - 1, 0, -1):
                name = self.stack[at].name
                if name in names:
                    self._cut(at)
                    break
                if name in stops or name in SECTION:
                    return
            else:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK:
            self.flush()
            if tag != "br":
                self._close({"p", "head"}, set())
                if tag in CLOSES:
                    self._close(*CLOSES[tag])
        self.tags += 1
        if tag in VOID:
            return
        top = self.stack[-1]
        section, form = top.section, top.form
        if tag in SECTION:
            self.sections.append((tag, section))
            section = len(self.sections) - 1
        if tag == "form" and not form:
            self.wraps.append(False)
            form = len(self.wraps) - 1
        out = top.out or self._left_out(tag, attrs, top)
        if tag in NAMED and not out:
            self.wraps[form] = True
        self.stack.append(Open(tag, out, section, form, top.named or tag in NAMED, tag if tag in BLOCK else top.block))
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK:
            self.flush()
        self.tags += 1

    def handle_endtag(self, tag: str) -> None:
        block = tag in BLOCK
        if block:
            self.flush()
        self.tags += 1
        if self.open[tag] <= 0:
            return
        for at in range(len(self.stack) - 1, 0, -1):
            name = self.stack[at].name
            if name == tag:
                self._cut(at)
                return
            if not block and name in BLOCK:
                return

    def handle_data(self, data: str) -> None:
        if not self.stack[-1].out:
            self.text.append(data)
        elif not data.isspace():
            self.dropped = True


def content_lines(ratio: np.ndarray, sigma: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Lines of the upper of two clusters of the smoothed log ratio, and lines that are there by their own ratio too.

    All lines, if there is no gap.
    """
    every = np.ones(len(ratio), dtype=bool)
    if len(ratio) < 2:
        return every, every
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    smooth = np.log1p(np.convolve(ratio, kernel / kernel.sum(), mode="full")[reach : reach + len(ratio)])
    low, high = smooth.min(), smooth.max()
    if high - low < 0.1:
        return every, every
    for _ in range(20):
        upper = smooth > (low + high) / 2
        a, b = smooth[~upper].mean(), smooth[upper].mean()
        if abs(a - low) + abs(b - high) < 1e-6:
            break
        low, high = a, b
    upper = smooth > (low + high) / 2
    return upper, upper & (np.log1p(ratio) > (low + high) / 2)


def within_forms(parser: Lines) -> list[bool]:
    """Per line, whether it has text and is in no form, or in one that wraps the content."""
    size = Counter()
    for x in parser.out:
        size[x.form] += len(x.text)
    wraps = [w or 2 * size[f] >= sum(size.values()) for f, w in enumerate(parser.wraps)]
    return [bool(x.text) and wraps[x.form] for x in parser.out]


def region(lines: list[Line], sections: list[tuple[str, int]], kept: list[bool], mark: list[bool], own_mark: list[bool]) -> tuple[list[bool], set[int]]:
    """The lines that the marks select, and the sections round them whose adjoining headings and paragraphs belong to them."""
    unit = [-1]  # outermost article round a section
    main = [-1]  # outermost main round it
    for s, (name, parent) in enumerate(sections[1:], 1):  # parents come before their children
        unit.append(unit[parent] if unit[parent] >= 0 else s if name == "article" else -1)
        main.append(main[parent] if main[parent] >= 0 else s if name == "main" else -1)
    named = [u >= 0 or m >= 0 for u, m in zip(unit, main, strict=True)]
    marked = [i for i, m in enumerate(mark) if m]
    total = sum(len(lines[i].text) for i in marked)
    around: set[int] = set()

    def above(s: int) -> None:  # of a named section, the named ones round it
        inner = s
        while s > 0:
            s = sections[s][1]
            if named[inner] <= named[s]:
                around.add(s)

    if 2 * sum(len(lines[i].text) for i in marked if named[lines[i].section]) >= total:
        strong = [i for i in marked if own_mark[i] and named[lines[i].section]] or marked
        chosen = {unit[lines[i].section] for i in strong} - {-1}
        whole = {m for s, m in enumerate(main) if m >= 0} - {main[s] for s, u in enumerate(unit) if u >= 0}
        whole &= {main[lines[i].section] for i in marked}
        take = [ok and (unit[x.section] in chosen or main[x.section] in whole or m and main[x.section] >= 0) for x, ok, m in zip(lines, kept, mark, strict=True)]
        for s in {x.section for x, ok in zip(lines, take, strict=True) if ok}:
            around.add(s)
            above(s)
        return take, around
    weight = [0] * len(sections)
    for x, ok, m in zip(lines, kept, mark, strict=True):
        weight[x.section] += len(x.text) * (1 if m else -1 if ok else 0)
    for s in range(len(sections) - 1, 0, -1):
        weight[sections[s][1]] += weight[s]
    best = max(range(len(sections)), key=lambda s: (weight[s], s))
    inside = [False] * len(sections)
    for s in range(len(sections)):
        inside[s] = s == best or s > 0 and inside[sections[s][1]]
    own = [i for i in marked if inside[lines[i].section]]
    take = [ok and inside[x.section] and own[0] <= i <= own[-1] for i, (x, ok) in enumerate(zip(lines, kept, strict=True))]
    around |= {s for s in range(len(sections)) if inside[s]}
    above(best)
    return take, around


def extract(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    lines, kept = parser.out, within_forms(parser)
    if not any(kept):
        return ""
    ratio = np.array([len(x.text) / max(1, x.tags) if ok else 0.0 for x, ok in zip(lines, kept, strict=True)])
    mark, own = ((m & np.array(kept)).tolist() for m in content_lines(ratio))
    take, around = region(lines, parser.sections, kept, mark if any(mark) else kept, own)
    shown = [i for i, ok in enumerate(kept) if ok]
    for order in (shown, shown[::-1]):
        for before, i in zip(order, order[1:], strict=False):
            take[i] = take[i] or take[before] and lines[i].paragraph and lines[i].section in around
    return "\n".join(x.text for x, ok in zip(lines, take, strict=True) if ok)


def main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` in place of the html column."""

    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for h in batches:
            yield pd.Series([extract(x) for x in h])

    df = pages.withColumn("text", F.pandas_udf(work, "string")(F.coalesce(F.col(html), F.lit(""))))
    return df.withColumn("n_chars", F.length("text").cast("long")).drop(html)


def op10_main_text(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
