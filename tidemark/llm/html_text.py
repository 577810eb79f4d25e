"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing and threshold clustering.

The standard library's parser streams events. Block elements break the page into lines; each line has its characters of text outside links,
its tags, and the region it stands in. Elements that are no content by their kind or role (menus, headers, footers, side bars, forms, scripts, styles) make
no lines, nor do those whose class or id says nothing but that they are reader comments, adverts, consent notices or navigation: these can be as long as an
article, so no ratio tells them from one. The ratio of text to tags, smoothed over neighbouring lines, is clustered by a threshold, and the clusters decide:

- an article, main, section or division is content if one of its lines is above the threshold, smoothed and by itself; then its short lines stay too;
- within an article, divisions, and anywhere lists and tables, go with what they stand in, unless they are below the threshold and nearly all link;
- an element with any other name of that kind ("legal", "search", "related-work", "ad-hoc") is content if it is above the threshold by itself;
- once one article is content, others are too, however short, unless they are mostly link;
- where article or main elements hold a good part of the text above the threshold, they are the content, else all content regions are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
REGION = frozenset("article main section div td body blockquote center".split())
DROPPED = frozenset("nav header footer aside form script style noscript template iframe object svg canvas button select textarea menu dialog head title".split())
LISTS = frozenset("ul ol dl table".split())
#: Roles and words of class or id that mark what is no content.
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
MARKS = re.compile(r"(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|header|masthead|footer|sidebar|aside|widgets?|related|shar(?:e|ing)|social|"
                   r"comments?|commentlist|respond|replies|disqus|cookies?|consent|gdpr|notices?|notifications?|alerts?|popup|modal|overlay|newsletter|subscribe\w*|signup|login|search\w*|form|pagination|pager|copyright|legal)", re.I)
#: Of these, what may be long text and yet is never the article.
NEVER = re.compile(r"(?:ads?|advert\w*|adsense|sponsor\w*|nav\w*|menu\w*|breadcrumbs?|footer|masthead|sidebar|comments?|commentlist|respond|replies|disqus|cookies?|consent|gdpr|newsletter|pagination|pager)", re.I)
#: Words beside those that say nothing about the content.
NEUTRAL = re.compile(r"(?:bar|block|body|bottom|box|btns?|buttons?|column|container|content|footer|global|group|icons?|inner|item|left|links?|list|main|outer|page|panel|post|posts|right|row|section|site|side|slot|text|top|unit|wrap|wrapper|\d+)", re.I)
#: An element of one of these names is closed by the opening of another.
CLOSES_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements whose class or id says nothing against them: the content itself and its headings.
NAMED = frozenset("article main h1 h2 h3 h4 h5 h6".split())
SIGMA = 1.0
#: A list or division with this share of its text in links goes, unless it is above the threshold; articles count from this share of the text on.
LINKED, ARTICLE_SHARE = 0.8, 1 / 3


def named(value: str) -> int:
    """What a class or id says: 2, nothing but that this is never content; 1, a word of that kind, or one like it; 0, nothing."""
    said = 0
    for word in value.split():
        parts = [x for x in re.split(r"[-_]+", word) if x]
        marks = [bool(MARKS.fullmatch(x)) for x in parts]
        if any(marks) or MARKS.fullmatch("".join(parts)):
            plain = all(m or NEUTRAL.fullmatch(x) for m, x in zip(marks, parts, strict=True)) or not any(marks)
            said = max(said, 2 if plain and any(map(NEVER.fullmatch, (*parts, "".join(parts)))) else 1)
    return said


@dataclass
class Region:
    root: int  # the region whose cluster decides
    parent: int
    article: bool  # within an article or main element
    is_article: bool = False
    lines: list[int] = field(default_factory=list)


class Lines(HTMLParser):
    """Lines of a page, [text, tags, characters in links, region], and the regions; line breaks inside dropped elements make none."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[list] = []
        self.regions = [Region(0, 0, False)]
        self.stack: list[tuple[str, bool, int]] = []  # name, dropped, region
        self.open: Counter[str] = Counter()  # names on the stack, so that a stray end tag costs nothing
        self.text: list[str] = []
        self.tags = self.linked = 0
        self.in_link = False
        self.link_at: tuple[int, int] = (0, 0)  # lines and open elements when the link began

    def _end_link(self, closed: bool) -> None:
        """A link that is never closed is one in the block it begins in: later blocks are text."""
        if self.in_link and not closed:
            first = self.link_at[0]
            for line in self.lines[first + 1:]:
                line[2] = 0
            if len(self.lines) > first:
                self.linked = 0
        self.in_link = False

    def _top(self) -> tuple[str, bool, int]:
        return self.stack[-1] if self.stack else ("", False, 0)

    def _break(self) -> None:
        if text := " ".join("".join(self.text).split()):
            _, dropped, region = self._top()
            if not dropped:
                self.regions[region].lines.append(len(self.lines))
                self.lines.append([text, self.tags, min(self.linked, len(text)), region])
            self.tags = 0
        self.linked = 0
        self.text.clear()

    def _pop(self, names: set[str] | frozenset[str], stop: frozenset[str]) -> None:
        if not any(self.open[n] for n in names):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in names:
                self._break()
                self.open.subtract(s[0] for s in self.stack[i:])
                del self.stack[i:]
                if len(self.stack) < self.link_at[1]:
                    self._end_link(False)
                return
            if self.stack[i][0] in stop:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in INLINE:
            if tag == "a":
                self._end_link(False)
                self.in_link, self.link_at = any(k == "href" for k, _ in attrs), (len(self.lines), len(self.stack))
            return
        if tag == "br":
            self.text.append(" ")
            return
        self._break()
        if tag in CLOSES_P:
            self._pop(frozenset(("p",)), REGION | DROPPED)
        if tag in SAME:
            self._pop(SAME[tag], frozenset(("ul", "ol", "dl", "table", "select")) | REGION - {"td"})
        if tag in VOID:
            return
        _, dropped, region = self._top()
        says = 0 if tag in NAMED or tag in ("html", "body") else max((named(v) for k, v in attrs if v and k in ("class", "id")), default=0)
        gone = tag in DROPPED or says == 2 or tag not in ("html", "body", "main") and any(k == "hidden" or k == "role" and (v or "").lower() in ROLES for k, v in attrs)
        if not (dropped or gone) and (says or tag in REGION or tag in LISTS):
            inside = self.regions[region].article
            own = says or tag == "article" or tag in REGION and not inside and tag != "td"
            k = len(self.regions)
            self.regions.append(Region(k if own else self.regions[region].root, region, inside or tag in ("article", "main"), tag == "article"))
            region = k
        self.open[tag] += 1
        self.stack.append((tag, dropped or gone and not (tag == "header" and self.open["article"]), region))

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "a":
            self._end_link(True)
        if tag not in INLINE and tag not in VOID:
            self._pop(frozenset((tag,)), frozenset())

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        if self.in_link:
            self.linked += len(data.strip())

    def unknown_decl(self, data: str) -> None:
        pass

    def close(self) -> None:
        super().close()
        self._break()
        self._end_link(False)


def smooth(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; weights are renewed at the ends."""
    r = max(1, math.ceil(2 * sigma))
    w = np.exp(-np.arange(-r, r + 1) ** 2 / (2 * sigma**2))
    return np.convolve(x, w)[r:r + len(x)] / np.convolve(np.ones(len(x)), w)[r:r + len(x)]


def content_lines(lines: list[list], regions: list[Region]) -> list[int]:
    """The lines of content regions, as the clusters of the smoothed ratio say."""
    own = np.array([(len(t) - linked) / max(1, n) for t, n, linked, _ in lines])
    ratio = smooth(own)
    level = min(float(ratio.std()), float(ratio.max()), float(own.max()))
    high = (ratio >= level) & (own >= level)  # smoothing alone must not lift a region beside a long line
    size = np.array([len(t) for t, *_ in lines])
    roots = [False] * len(regions)
    for g, (*_, r) in zip(high.tolist(), lines, strict=True):
        roots[regions[r].root] |= g
    if any(roots[k] for k, r in enumerate(regions) if r.is_article):
        chars, linked = Counter(), Counter()
        for n, (_, _, in_link, r) in zip(size.tolist(), lines, strict=True):
            chars[regions[r].root] += n
            linked[regions[r].root] += in_link
        for k, r in enumerate(regions):
            if r.is_article and chars[k] > 2 * linked[k]:
                roots[k] = True
    content = [False] * len(regions)
    for k, r in enumerate(regions):
        if r.root == k:
            content[k] = roots[k]
        else:
            total = int(size[r.lines].sum())
            menu = total and sum(lines[i][2] for i in r.lines) >= LINKED * total and not high[r.lines].any()
            content[k] = content[r.parent] and not menu
    mass = sum(int(size[i]) for i in range(len(lines)) if high[i] and content[lines[i][3]])
    within = sum(int(size[i]) for i in range(len(lines)) if high[i] and content[lines[i][3]] and regions[lines[i][3]].article)
    only = within >= ARTICLE_SHARE * mass
    return [i for i, (*_, r) in enumerate(lines) if content[r] and (regions[r].article or not only)]


def main_text(html: str | None) -> str:
    p = Lines()
    p.feed(html or "")
    p.close()
    return "\n\n".join(p.lines[i][0] for i in content_lines(p.lines, p.regions)) if p.lines else ""


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """One row per page: the columns of `keep`, text, n_chars. A null or empty page has an empty text; repeated rows keep their rows."""
    rows = pages.select(*keep, F.col(html_col).alias("__html"))
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            texts = [main_text(h) for h in x["__html"].to_pylist()]
            yield pa.RecordBatch.from_pydict({c: x[c] for c in keep} | {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return rows.mapInArrow(run, f"{schema}, text string, n_chars long")
