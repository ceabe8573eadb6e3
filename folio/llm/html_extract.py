"""Main text of web pages, from streaming parser events and text-to-tag ratios.

The standard library's parser feeds events to a line builder; each line is one block of the page, with its text and
the tags met since the line before. A line's ratio is its text length over its tags. The ratios are smoothed with a
Gaussian and clustered in two by a threshold (one-dimensional two-means). Boilerplate elements (menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles, comments of readers) are never content and end a region;
a region, a run of lines between such borders, is content if one of its lines is on the high side. A content region
is kept whole, so a short paragraph between long ones stays. What holds the page's article, main part or first heading
is no boilerplate, whatever its name; a page with such an element is read once more with it let through.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import small_batches

#: Elements whose text is never shown as part of a page's prose.
HIDDEN = frozenset("script style noscript template svg annotation annotation-xml iframe object canvas head title select textarea button".split())
#: Elements that hold a page's furniture.
FURNITURE = frozenset("nav header footer aside form menu dialog fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin a block of their own.
BLOCKS = frozenset(
    "address article blockquote body caption center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Words that mark furniture, as a class or id or the last part of one.
MARKS = re.compile(
    r"ads?|advert\w*|banner|breadcrumbs?|comments?|commentlist|replies|respond|disqus|cookies?|consent|gdpr|notice|notices|disclaimer|footer|foot|header|masthead|menu|nav|navbar|navigation|newsletter|subscribe|signup|popup|modal|promo\w*|sponsor\w*|related|recommend\w*|share|sharing|social|sidebar|widget|toolbar|pagination|pager|skip"
)
#: Parts after a furniture word that only say how it is shown, as in share-buttons or ad-slot-2.
SHOWN_AS = re.compile(r"area|bar|block|body|box|buttons?|container|content|form|icons?|inner|items?|left|links?|list|main|outer|panel|posts?|right|rows?|sections?|slot|text|top|bottom|unit|widgets?|wrap|wrapper|\d+|")
#: Parts that say that the element is beside furniture, or without it.
BESIDE = frozenset("no not non has have with without".split())
#: Elements that hold what a page is about; whatever holds them is no furniture.
CORE = frozenset("article main h1".split())
#: Furniture even with a heading of the first rank in it.
NEVER_HEADED = frozenset("nav aside footer menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
#: Elements that an opening tag closes when left open.
CLOSED_BY = {"p": BLOCKS | FURNITURE, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}


@lru_cache(maxsize=20_000)
def marks_furniture(names: str) -> bool:
    """Whether a class or id in ``names`` is a furniture word or ends in one.

    A widget is furniture only as a whole name, since page builders call every block a widget.
    """
    for name in names.lower().split():
        parts = re.split("[-_]+", name)
        if BESIDE.intersection(parts):
            continue
        while len(parts) > 1 and SHOWN_AS.fullmatch(parts[-1]) and not MARKS.fullmatch(parts[-1]):
            parts.pop()
        if MARKS.fullmatch(parts[-1]) and (parts[-1] != "widget" or len(parts) == 1):
            return True
    return False


class Lines(HTMLParser):
    """Collects (text, tags, region) lines; text in furniture or hidden elements only moves the region on.

    ``spared`` has the numbers of the start tags that open no furniture whatever they look like; ``holders`` says which
    these are, once the page is read.
    """

    def __init__(self, spared: frozenset[int] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.spared = spared
        self.starts = 0
        self.free_core = False
        #: For each kind of core element the sets of barred elements around one, of those with the fewest.
        self.held: dict[str, set[frozenset[int]]] = {tag: set() for tag in CORE}
        self.open: list[tuple[str, bool, int, bool]] = []
        #: How many elements of each name are open, so that an end tag without a start costs no search.
        self.names: Counter[str] = Counter()
        #: Places in ``open`` of paragraphs and of what no paragraph's end reaches beyond.
        self.borders: list[int] = []
        #: The barred elements among ``open``, as (name, number, unseen), and their numbers while these stay the same.
        self.bars: list[tuple[str, int, bool]] = []
        self.bar_numbers: frozenset[int] | None = None
        self.barred = 0
        self.region = 0
        self.tags = 0
        self.parts: list[str] = []
        self.lines: list[tuple[str, int, int]] = []

    def meets_core(self, tag: str) -> None:
        """Notes what bars an article, a main part or a heading of the first rank; hidden ones stay hidden."""
        if not self.barred:
            self.free_core |= tag != "h1"
            return
        least = len(next(iter(self.held[tag]), ()))
        if least and len(self.bars) > least:
            return
        if self.bar_numbers is None:
            self.bar_numbers = frozenset(number for _, number, _ in self.bars)
        if not any(unseen for *_, unseen in self.bars) and not (tag == "h1" and any(name in NEVER_HEADED for name, *_ in self.bars)):
            if len(self.bars) < least:
                self.held[tag].clear()
            self.held[tag].add(self.bar_numbers)

    def holders(self) -> frozenset[int]:
        """Numbers of the barred elements that hold a heading, a main part, or, where none is free, an article.

        Beside a free article those in furniture are teasers. Of several the ones in the fewest barred elements count.
        """
        out: set[int] = set()
        for tag, chains in self.held.items():
            if not (tag == "article" and self.free_core):
                out.update(*chains)
        return frozenset(out)

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            self.lines.append((text, self.tags, self.region))
            self.tags = 0

    def pop(self) -> None:
        tag, bar, *_ = self.open.pop()
        self.names[tag] -= 1
        if self.borders and self.borders[-1] == len(self.open):
            self.borders.pop()
        if bar:
            self.bars.pop()
            self.bar_numbers = None
            self.barred -= 1
            if not self.barred:
                self.region += tag not in HIDDEN
                self.tags = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        self.starts += 1
        while self.open and tag in CLOSED_BY.get(self.open[-1][0], ()):
            self.flush()
            self.pop()
        if tag in BLOCKS or tag in FURNITURE:
            if tag in CLOSED_BY["p"]:
                self.close_paragraph()
            if not self.barred:
                self.flush()
        elif tag == "br" and not self.barred:
            self.parts.append(" ")
        if tag in VOID:
            return
        marked = dict(attrs)
        if tag in CORE:
            self.meets_core(tag)
        unseen = tag in HIDDEN or self.is_unseen(marked)
        bar = tag in HIDDEN or tag in FURNITURE or (tag not in ("html", "body", "article", "main") and (self.is_marked(marked) or unseen))
        bar = bar and self.starts not in self.spared
        if bar and not self.barred:
            if tag not in HIDDEN:
                self.flush()
                self.region += 1
        if tag == "p" or tag in BLOCKS or tag in FURNITURE or tag in HIDDEN:
            self.borders.append(len(self.open))
        self.open.append((tag, bar, self.starts, unseen))
        self.names[tag] += 1
        self.barred += bar
        if bar:
            self.bars.append((tag, self.starts, unseen))
            self.bar_numbers = None

    @staticmethod
    def is_marked(marked: dict[str, str | None]) -> bool:
        names = f"{marked.get('class') or ''} {marked.get('id') or ''}"
        return marks_furniture(names) or (marked.get("role") or "").lower() in ROLES

    @staticmethod
    def is_unseen(marked: dict[str, str | None]) -> bool:
        return "hidden" in marked or marked.get("aria-hidden") == "true"

    def close_paragraph(self) -> None:
        """A block ends an open paragraph and whatever inline elements it left open."""
        if self.borders and self.open[self.borders[-1]][0] == "p":
            depth = self.borders[-1]
            if not self.barred:
                self.flush()
            while len(self.open) > depth:
                self.pop()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in VOID:
            return
        if not self.names[tag]:
            return
        depth = next(k for k in range(len(self.open) - 1, -1, -1) if self.open[k][0] == tag)
        if not self.barred and (tag in BLOCKS or tag in FURNITURE):
            self.flush()
        while len(self.open) > depth:
            self.pop()

    def handle_data(self, data: str) -> None:
        if not self.barred:
            self.parts.append(data)

    def close(self) -> None:
        super().close()
        self.flush()


def smoothed(values: list[float], sigma: float) -> list[float]:
    """Gaussian smoothing over a window of three deviations, its weights made to sum to one at the borders too."""
    reach = max(1, math.ceil(3 * sigma))
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        low, high = max(0, i - reach), min(len(values), i + reach + 1)
        w = weights[low - i + reach : high - i + reach]
        out.append(sum(a * b for a, b in zip(w, values[low:high])) / sum(w))
    return out


def threshold(values: list[float]) -> float:
    """The border of one-dimensional two-means; alike values are all content."""
    low, high = min(values), max(values)
    if high - low < 1e-9:
        return low
    for _ in range(50):
        cut = (low + high) / 2
        a, b = [v for v in values if v < cut], [v for v in values if v >= cut]
        if not a:
            return cut
        new = sum(a) / len(a), sum(b) / len(b)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def read_lines(html: str, spared: frozenset[int] = frozenset()) -> Lines:
    parser = Lines(spared)
    parser.feed(html)
    parser.close()
    return parser


def main_text(html: str | None, sigma: float = 1.0, least: float = 0.5) -> str:
    """Blocks of the content regions in page order, joined by an empty line; ``least``: share of the threshold that a region's best line must reach."""
    parser = read_lines(html or "")
    if spared := parser.holders():
        parser = read_lines(html or "", spared)
    lines = parser.lines
    if not lines:
        return ""
    ratios = smoothed([len(text) / (1 + tags) for text, tags, _ in lines], sigma)
    cut = threshold(ratios) * least
    best: dict[int, float] = {}
    for (_, _, region), ratio in zip(lines, ratios):
        best[region] = max(best.get(region, 0.0), ratio)
    return "\n\n".join(text for text, _, region in lines if best[region] >= cut)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sigma: float = 1.0) -> DataFrame:
    """One row per page: id, url, main text and its code points.

    A null or empty page has an empty text, as has one of furniture only; repeated rows repeat; an empty table stays empty; other columns are ignored.
    """

    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for html in batches:
            yield html.map(lambda h: main_text(h, sigma), na_action=None)

    return pages.select(id_col, url_col, extracted(F.col(html_col)).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
