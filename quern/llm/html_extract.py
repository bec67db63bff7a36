"""Main-text extraction from raw HTML.

The standard library's parser streams events; they make one line per block element, with
its characters and its tags. The text-to-tag ratio per line is smoothed with a Gaussian
kernel and the lines fall into two clusters at a threshold found by one-dimensional
2-means. High lines name the content region: the ``article`` elements that hold most of
their text, the ``main`` element that does, or else the deepest container that does. All
lines of that region that stand in no menu, header, footer, sidebar, notice, advert, form or
comment section are the text: a short paragraph inside the region stays whatever its ratio.
Low lines in a row that are nothing but links are a menu, whatever element they stand in.

Menus, footers and asides are told by their tags, the other kinds by a list of words for
class, id and role, and forms. The clusters overrule the list: an element marked by it, or
a form, that holds most of the page's high text, with little dense text in the open beside
it, is no boilerplate.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import read_table

BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td "
    "tfoot th thead title tr ul caption optgroup option".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never article text.
SKIP = frozenset(
    "script style noscript template head title nav footer aside form button select option textarea input dialog menu iframe "
    "object svg math canvas audio video datalist search".split()
)
#: Those of them whose text is never shown as prose, whatever stands around them: it makes no line.
UNREAD = frozenset("script style noscript template title button select option textarea iframe object svg math canvas audio video datalist".split())
#: Elements of which one is closed by the next start tag of the named ones.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
CLOSES_P = BLOCK - {"html", "body", "head", "title", "caption", "option", "optgroup", "legend", "summary", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: Words of class, id and role that mark what is not the article.
BOILER = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted cookie cookies "
    "consent gdpr notice notification alert popup modal overlay newsletter subscribe signup paywall sidebar aside nav navbar "
    "navigation menu breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar comment comments disqus respond reply "
    "replies discussion social share sharing related recommended recommendations widget widgets skip contentinfo complementary search hidden".split()
)
#: Words that mark an ``article`` as another than the page's own.
OTHER_ARTICLE = frozenset("comment comments related ad advert promo sponsored teaser".split())
#: Words that may stand beside a listed one in a name: "comment-list" names comments, "has-sidebar" no sidebar.
GENERIC = frozenset(
    "area bar block box btn button buttons container form group heading icon icons inner item items left link links list main "
    "outer page panel post posts right section site slot text title top bottom wrap wrapper".split()
)
#: Marks of what is prose as dense as the article: overruled only where no dense text stands in the open beside it.
PROSE = frozenset("comment comments disqus respond reply replies discussion".split())
#: So many low lines of nothing but links in a row are a menu, whatever its tags.
MENU = 3
#: Share of the page's high text that is most of it, here as for the region.
MOST = 0.6
HEADER = frozenset({"header", "masthead", "banner"})
CONTAINER = frozenset("article main section div form td body html blockquote".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SPACES = re.compile(r"\s+")
_TOKENS = re.compile(r"[A-Za-z][a-z]+|[A-Z]+|[a-z]+")


def _listed(name: str) -> set[str]:
    """The listed words of one class, id or role, if all of the name is listed or generic words."""
    parts = {t.lower() for t in _TOKENS.findall(name)}
    known = parts & (BOILER | HEADER | OTHER_ARTICLE)
    return known if parts <= known | GENERIC else set()


def _marks(attrs: list[tuple[str, str | None]]) -> tuple[set[str], bool]:
    words: set[str] = set()
    hidden = False
    for name, value in attrs:
        if name in ("class", "id", "role") and value:
            for one in value.split():
                words |= _listed(one)
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and "display:none" in value.replace(" ", "").lower():
            hidden = True
    return words, hidden


@dataclass
class _Line:
    """A block's text with its tags, whether all of it is link text, its innermost container and mark, and whether it
    stands in a heading of an article."""

    text: str
    tags: int
    links: bool
    container: int
    mark: int
    headline: bool

    @property
    def ratio(self) -> float:
        return len(self.text) / max(1, self.tags)


@dataclass
class _Open:
    """An open element: its own kind of mark, and what holds for all that stands in it."""

    tag: str
    kind: int
    doubtful: bool | None
    container: int
    mark: int
    heading: bool
    article: bool


class _Lines(HTMLParser):
    """Lines of a page, and trees of its containers and marks by number: a parent's number is smaller, 0 is none."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[_Line] = []
        self.open: list[_Open] = []
        self.count: Counter = Counter()  # open elements by tag
        self.buffer: list[str] = []
        self.tags = 0
        self.plain = self.linked = 0  # characters outside and inside of links
        self.containers = [0]  # parents
        self.kinds = [""]
        self.marks = [0]  # parents
        self.mark_kinds = [0]
        self.unread: int | None = None  # place in open of the outermost element of UNREAD
        self.before: Counter = Counter()  # open elements by tag when it was opened
        self.doubtful: dict[int, bool] = {}  # marks that the clusters may overrule; whether they name prose

    def flush(self):
        text = _SPACES.sub(" ", "".join(self.buffer)).strip()
        if text:
            # nothing in the buffer is from inside an unread element
            at = len(self.open) if self.unread is None else self.unread
            x = self.open[at - 1] if at else None
            links = self.linked > 0 and not self.plain
            self.lines.append(_Line(text, self.tags, links, x.container if x else 0, x.mark if x else 0, bool(x and x.heading and x.article)))
            self.tags = 0
        self.plain = self.linked = 0
        self.buffer.clear()

    def _push(self, tag: str, kind: int, doubtful: bool | None):
        """Open an element. ``doubtful``: None if its mark is certain, else whether it names prose."""
        x = self.open[-1] if self.open else None
        container, mark = (x.container, x.mark) if x else (0, 0)
        if tag in CONTAINER:
            self.containers.append(container)
            self.kinds.append(tag)
            container = len(self.kinds) - 1
        if kind:
            self.marks.append(mark)
            self.mark_kinds.append(kind)
            mark = len(self.marks) - 1
            if doubtful is not None:
                self.doubtful[mark] = doubtful
        self.count[tag] += 1
        self.open.append(_Open(tag, kind, doubtful, container, mark, tag in HEADINGS or bool(x and x.heading), tag == "article" or bool(x and x.article)))

    def _drop(self, at: int, keep) -> None:
        """Close the element at ``at`` and those in it, but for the ones to keep, which stay open without it."""
        inside = self.open[at + 1 :]
        for x in self.open[at:]:
            self.count[x.tag] -= 1
        del self.open[at:]
        for x in inside:
            if keep(x):
                self._push(x.tag, x.kind, x.doubtful)

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "br":
            self.buffer.append(" ")
        if tag in BLOCK and self.unread is None:
            self.flush()
            if tag in CLOSES_P:
                self._close("p", BLOCK - {"p"})
            for kind, closers in CLOSED_BY.items():
                if tag in closers:
                    self._close(kind, {"ul", "ol", "dl", "table", "select"})
        if tag in VOID:
            return
        skipped = 0
        words: set[str] = set()
        hidden = False
        if tag in SKIP:
            skipped = 1
        elif tag == "header":
            skipped = 2
        elif tag not in ("html", "body", "article", "main"):
            words, hidden = _marks(attrs)
            if hidden or words & BOILER:
                skipped = 1
            elif words & HEADER and tag != "h1":
                skipped = 2
        elif tag == "article":
            words, hidden = _marks(attrs)
            if hidden or words & OTHER_ARTICLE:
                skipped = 1
        if tag in UNREAD and self.unread is None:
            self.unread, self.before = len(self.open), self.count.copy()
        may_be_text = tag == "form" or tag not in SKIP and tag != "header" and not hidden
        self._push(tag, skipped, bool(words & PROSE) if skipped and may_be_text else None)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in UNREAD:  # as in XHTML; left open it would take all that follows
            self.count[self.open.pop().tag] -= 1
            if self.unread == len(self.open):
                self.unread = None

    def _close(self, tag: str, until):
        """Close the innermost ``tag``, if none of ``until`` stands in between; inline elements left open in it stay open."""
        if not self.count[tag]:
            return
        for at in range(len(self.open) - 1, -1, -1):
            name = self.open[at].tag
            if name == tag:
                self._drop(at, lambda x: x.tag not in BLOCK)
                return
            if name in until:
                return

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCK and (self.unread is None or self.count[tag] == self.before[tag]):
            self.flush()
        if not self.count[tag]:
            return
        whole = tag in BLOCK or tag in SKIP
        for at in range(len(self.open) - 1, -1, -1):
            name = self.open[at].tag
            if name == tag:
                if self.unread is not None and at <= self.unread:
                    self.unread = self.unread - 1 if not whole else None
                self._drop(at, lambda x: not whole)
                return
            if not whole and name in BLOCK:
                return

    def handle_data(self, data):
        if self.unread is None:
            self.buffer.append(data)
            if not data.isspace():
                if self.count["a"]:
                    self.linked += len(data)
                else:
                    self.plain += len(data)

    def unknown_decl(self, data):
        pass


def parse_lines(html: str) -> _Lines:
    parser = _Lines()
    try:
        parser.feed(html)
        parser.close()
    except AssertionError:  # the parser gives up on malformed <![...
        parser = _Lines()
        parser.feed(html.replace("<![", "&lt;!["))
        parser.close()
    parser.flush()
    return parser


def smooth(values: list[float], sigma: float = 1.0) -> list[float]:
    reach = max(1, math.ceil(2 * sigma))
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for d in range(-reach, reach + 1):
            if 0 <= i + d < len(values):
                total += kernel[d + reach] * values[i + d]
                weight += kernel[d + reach]
        out.append(total / weight)
    return out


def cluster_threshold(values: list[float]) -> float:
    """Midpoint between the two cluster means (1-d 2-means started at the extremes)."""
    low, high = min(values), max(values)
    for _ in range(32):
        cut = (low + high) / 2
        a = [v for v in values if v < cut]
        b = [v for v in values if v >= cut]
        if not a or not b:
            return cut
        nlow, nhigh = sum(a) / len(a), sum(b) / len(b)
        if nlow == low and nhigh == high:
            break
        low, high = nlow, nhigh
    return (low + high) / 2


def _summed(parents: list[int], own: dict[int, int]) -> list[int]:
    """The sum of ``own`` in each node of a tree and all that stands in it."""
    total = [own.get(at, 0) for at in range(len(parents))]
    for at in range(len(parents) - 1, 0, -1):  # numbers grow inwards
        total[parents[at]] += total[at]
    return total


def _skipped(parser: _Lines, overruled: set[int]) -> list[bool]:
    """Whether each line stands in a marked element; the headline in an article's own header doesn't count as marked."""
    marked, certain = [False], [False]  # in a mark that holds; in one that isn't a header's
    for mark in range(1, len(parser.marks)):
        holds, parent = mark not in overruled, parser.marks[mark]
        marked.append(holds or marked[parent])
        certain.append(holds and parser.mark_kinds[mark] == 1 or certain[parent])
    return [marked[x.mark] and not (x.headline and not certain[x.mark]) for x in parser.lines]


def _high(parser: _Lines, skipped: list[bool], sigma: float) -> tuple[float, list[bool]]:
    """The threshold between the two clusters of smoothed ratios, skipped lines having ratio 0, and which lines lie above."""
    ratios = [0.0 if s else x.ratio for x, s in zip(parser.lines, skipped)]
    smoothed = smooth(ratios, sigma)
    cut = cluster_threshold(smoothed)
    return cut, [v >= cut and not s for v, s in zip(smoothed, skipped)]


def _overruled(parser: _Lines, sigma: float) -> set[int]:
    """The doubtful marks whose element holds most of the page's high text, from outside in.

    Lines are clustered with the doubtful marks left aside. An element is boilerplate after all if more
    than a third as much dense text (of half the threshold's ratio) stands in the open beside it, or any
    if its words name readers' prose.
    """
    overruled: set[int] = set()
    skipped = _skipped(parser, set(parser.doubtful))
    if not parser.doubtful or all(skipped):
        return overruled
    cut, high = _high(parser, skipped, sigma)
    mass: dict[int, int] = {}
    dense: dict[int, int] = {}  # of lines that an overruled mark would open
    heads: dict[int, int] = {}  # of headlines, which are in the open in any case
    still = _skipped(parser, overruled)
    for x, s, h, t in zip(parser.lines, skipped, high, still):
        if h:
            mass[x.mark] = mass.get(x.mark, 0) + len(x.text)
        if not s and 2 * x.ratio >= cut:
            kind = dense if t or not x.mark else heads
            kind[x.mark] = kind.get(x.mark, 0) + len(x.text)
    total = sum(mass.values())
    held, headed = _summed(parser.marks, mass), _summed(parser.marks, heads)
    beside = dense.get(0, 0) + sum(heads.values())
    in_open = {0}
    for mark in sorted(parser.doubtful):  # at most one of two elements side by side holds most of the text
        if not held[mark] or held[mark] < MOST * total:
            continue
        rest = beside - headed[mark]
        if not rest or not parser.doubtful[mark] and 3 * rest <= held[mark]:
            overruled.add(mark)
            if parser.marks[mark] in in_open:
                in_open.add(mark)
                beside += dense.get(mark, 0)
    return overruled


def _menus(lines: list[_Line], high: list[bool]) -> list[bool]:
    """Lines of menus without a menu's tag: ``MENU`` or more low lines in a row of nothing but links."""
    low = [x.links and not h for x, h in zip(lines, high)]
    out = [False] * len(lines)
    at = 0
    while at < len(low):
        end = at
        while end < len(low) and low[end]:
            end += 1
        if end - at >= MENU:
            out[at:end] = [True] * (end - at)
        at = end + 1
    return out


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """The article of one page, blocks joined by an empty line; empty if there is none."""
    if not html:
        return ""
    parser = parse_lines(html)
    lines = parser.lines
    skipped = _skipped(parser, _overruled(parser, sigma))
    if all(skipped):
        return ""
    _, high = _high(parser, skipped, sigma)
    skipped = [s or m for s, m in zip(skipped, _menus(lines, high))]
    if all(skipped):
        return ""
    high = [h and not s for h, s in zip(high, skipped)]
    if not any(high):
        high = [not s for s in skipped]
    own: dict[int, int] = {}
    for x, h in zip(lines, high):
        if h:
            own[x.container] = own.get(x.container, 0) + len(x.text)
    mass = _summed(parser.containers, own)
    regions: set[int] = set()
    for kind in ("article", "main"):
        named = [at for at in range(1, len(mass)) if mass[at] and parser.kinds[at] == kind]
        if named:
            largest = max(mass[at] for at in named)
            # several articles of a page are all its text, unless they are small beside the largest
            regions = {at for at in named if 2 * mass[at] >= largest} if kind == "article" else {max(named, key=lambda at: (mass[at], -at))}
            break
    if not regions:
        # the deepest that holds most of the high lines
        deepest = [at for at in range(1, len(mass)) if mass[at] >= MOST * mass[0]]
        regions = set(deepest[-1:])
    inside = [not regions]
    for at in range(1, len(mass)):
        inside.append(inside[parser.containers[at]] or at in regions)
    return "\n\n".join(x.text for x, s in zip(lines, skipped) if not s and inside[x.container])


def extract_text(df: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """Add the main text of ``html_col`` as ``out_col``, which replaces a column of that name.

    Null or empty html, and pages without text, give the empty string. Pages are parsed one
    by one, so that memory follows the longest page. Repeated rows give equal results.
    """

    @F.pandas_udf("string")
    def extract(html: pd.Series) -> pd.Series:
        return pd.Series([main_text(x) for x in html], dtype=object)

    return df.withColumn(out_col, extract(F.col(html_col)))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of pages: page_id, url, text, n_chars (code points)."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
