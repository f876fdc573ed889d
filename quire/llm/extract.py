"""Main text of HTML pages by text-to-tag ratios.

A page is read once, as a stream of the standard library's parser events, without a
tree. Events make lines, one for each block of text, and a list of elements, each
with its parent. Lines of elements that say what they are (``BARRED`` kinds, roles,
and names among ``NAMES`` or ``COMMENTS``; hidden ones) take no part. Of the others,

1. a line's ratio is its text outside links by its number of tags;
2. ratios are smoothed over neighbouring lines by a Gaussian;
3. smoothed ratios fall into two clusters, parted by the threshold with the least
   variance inside both, and lines of the upper one are content;
4. a region is an element: of the articles of the page (else of its main elements)
   those that hold a quarter as much content as the fullest one; where a page has
   neither, the deepest element that holds most of the content, less what lies
   under the threshold at either end of it, with the headings right before.

All lines of a region are kept, so a short paragraph of an article is, whatever its
ratio. Text is decoded, white space inside a block becomes one space, blocks are
joined by an empty line. ``br`` is white space; cells and list items are blocks.

Defined results: a null or empty page has the empty text, and so has one without
content; a page without any tag is one block; repeated rows are read each for
itself; an empty table gives an empty table; null ids are kept; a page is read
whole, whatever its length, in time that is nearly proportional to it; columns other than the id, the
address and the page are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import table

#: Lines to each side that the Gaussian reaches, and its standard deviation.
REACH, SIGMA = 3, 1.0
#: Share of the fullest article's content from which another article counts too.
LEAST_SHARE = 0.25
#: Share of an element's content that one inside it has to hold to be the region instead.
MOST_SHARE = 0.6

# Element kinds of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
_SILENT = frozenset("script style noscript template iframe object svg canvas audio video select button textarea head title label legend datalist output".split())
_P, _NOT_P = frozenset(["p"]), _BLOCKS - {"p"}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_HOLDERS = frozenset("html body div section main article table tbody tr td center form".split())
#: Elements that an opening one of a kind closes, and those beyond which it doesn't look.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "a": ({"a"}, {"table", "div", "article", "section"}),
}

#: Kinds and roles that are no part of an article.
BARRED = frozenset("nav footer aside header form dialog menu search".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of classes and ids that say as much.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promoted promotion promotions menu nav navbar navigation breadcrumb breadcrumbs "
    "sidebar aside footer header masthead cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay lightbox newsletter subscribe "
    "subscription signup share sharing sharebar social related recommended recommendations teaser teasers widget widgets toolbar pagination pager paginator login search searchbox skip "
    "copyright legal disclaimer form topbar bottombar".split()
)
COMMENTS = frozenset("comment comments commentlist commentary respond responses replies reply disqus feedback reactions".split())
_COMMENT_TITLE = re.compile(r"(\d+\s+)?(reader\s+|user\s+)?(comments?|kommentare?|commentaires?|comentarios?|leave a (comment|reply))(\s*\(\d+\))?\s*:?", re.IGNORECASE)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_NO_DISPLAY = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


class _Line:
    __slots__ = ("element", "kind", "links", "size", "tags", "text")

    def __init__(self, element: int, kind: str, text: str, links: int, tags: int):
        self.element, self.kind, self.text, self.tags = element, kind, text, tags
        self.size = len(text)
        self.links = min(links, self.size)


class _Reader(HTMLParser):
    """Lines and elements of one page, from its parser's events."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.kinds, self.parents, self.bars = ["html"], [-1], [""]  # by element; the first is the page itself
        self.lines: list[_Line] = []
        self.stack = [0]
        self.open = Counter()
        self.silent = self.links = 0
        self.pieces: list[str] = []
        self.link_size = self.tags = 0
        self.holder = 0  # the element that the block belongs to

    def updatepos(self, i, j):
        return j  # lines of the source aren't counted

    # events

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in _VOID:
            if tag == "hr":
                self._flush()
            elif tag == "br":
                self.pieces.append(" ")
            return
        if tag in ("html", "body"):
            return
        if tag in _BLOCKS and not self.silent:
            self._flush()
            if self.open["p"]:
                self._close(_P, _NOT_P)
        if tag in _CLOSES and any(self.open[kind] for kind in _CLOSES[tag][0]):
            self._close(*_CLOSES[tag])
        self.kinds.append(tag)
        self.parents.append(self.stack[-1])
        self.bars.append(_bar(tag, attrs, self.open["article"] + self.open["main"] > 0))
        self.stack.append(len(self.kinds) - 1)
        self.open[tag] += 1
        self.silent += tag in _SILENT
        self.links += tag == "a"
        if tag in _BLOCKS:
            self.holder = self.stack[-1]

    def handle_startendtag(self, tag, attrs):
        # a slash closes nothing but void elements in HTML
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in ("html", "body") or not self.open[tag]:
            return
        if tag in _BLOCKS and not self.silent:
            self._flush()
        while self.kinds[self._pop()] != tag:
            pass
        self._held()

    def handle_data(self, data):
        if self.silent:
            return
        self.pieces.append(data)
        if self.links:
            self.link_size += len(data.strip())

    def close(self):
        super().close()
        self._flush()

    # the stack

    def _pop(self) -> int:
        element = self.stack.pop()
        kind = self.kinds[element]
        self.open[kind] -= 1
        self.silent -= kind in _SILENT
        self.links -= kind == "a"
        return element

    def _close(self, kinds: set, beyond) -> None:
        for at in range(len(self.stack) - 1, 0, -1):
            kind = self.kinds[self.stack[at]]
            if kind in kinds:
                while len(self.stack) > at:
                    self._pop()
                self._held()
                return
            if kind in beyond:
                return

    def _held(self) -> None:
        at = len(self.stack) - 1
        while at and self.kinds[self.stack[at]] not in _BLOCKS:
            at -= 1
        self.holder = self.stack[at]

    def _flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            self.lines.append(_Line(self.holder, self.kinds[self.holder], text, self.link_size, self.tags))
            self.tags = 0
        self.pieces, self.link_size = [], 0


def _bar(tag: str, attrs: list, in_article: bool) -> str:
    """Why an element is no part of an article: "hidden", "comment", "kind" or "name", or nothing."""
    if not attrs and tag not in BARRED:
        return ""
    found = dict(attrs)
    if "hidden" in found or found.get("aria-hidden") == "true" or _NO_DISPLAY.search(found.get("style") or ""):
        return "hidden"
    block = tag in _BLOCKS
    words = set(map(str.lower, _WORD.findall(f"{found.get('class') or ''} {found.get('id') or ''}"))) if block else set()
    if block and (words & COMMENTS or found.get("itemprop") == "comment" or (found.get("itemtype") or "").endswith("/Comment")):
        return "comment"
    if tag in ("nav", "footer", "aside"):
        return "kind"
    if (tag in BARRED and not (tag == "header" and in_article)) or (found.get("role") or "") in _ROLES:
        return "name"
    if words & NAMES and not (tag == "header" and in_article) and tag not in _HEADINGS:
        return "name"
    return ""


def _barred(page: _Reader) -> list[bool]:
    """Whether each element lies in one that is barred.

    Bars by name alone don't hold for an element around an article, nor for one that
    holds most of the page's paragraphs: it is a wrapper, or was left open.
    """
    count = len(page.kinds)
    around, paragraphs, size, begun = [False] * count, [0] * count, [0] * count, [False] * count
    for line in page.lines:
        if line.kind == "p":
            paragraphs[line.element] += 1
            size[line.element] += line.size
        above = line.element
        while above >= 0 and not begun[above]:
            begun[above] = True
            above = page.parents[above]
        # what begins in the heading's parent, or further up, has this line as its first
        if line.kind in _HEADINGS and above != (parent := page.parents[line.element]) and page.kinds[parent] in ("div", "section") and _COMMENT_TITLE.fullmatch(line.text):
            page.bars[parent] = "comment"
    for element in range(count - 1, 0, -1):
        above = page.parents[element]
        around[above] |= around[element] or (page.kinds[element] in ("article", "main") and page.bars[element] == "")
        paragraphs[above] += paragraphs[element]
        size[above] += size[element]
    out = [False] * count
    for element in range(1, count):
        bar = page.bars[element]
        wrapper = bar == "name" and (around[element] or paragraphs[element] >= 3 and 2 * size[element] > size[0])
        out[element] = out[page.parents[element]] or bool(bar) and not wrapper and not (page.kinds[element] == "nav" and around[element])
    return out


def smooth(ratios: np.ndarray) -> np.ndarray:
    """Weighted means of neighbouring values; at the ends the weights inside add up to one."""
    offsets = np.arange(-REACH, REACH + 1)
    weights = np.exp(-(offsets**2) / (2 * SIGMA**2))
    whole = np.convolve(ratios, weights)[REACH:-REACH]
    return whole / np.convolve(np.ones(len(ratios)), weights)[REACH:-REACH]


def threshold(values: np.ndarray) -> float:
    """The least value of the upper of two clusters, parted where variance between them is greatest."""
    ordered = np.sort(np.log1p(values))
    if ordered[0] == ordered[-1]:
        return float(values.min())
    sums, counts = np.cumsum(ordered)[:-1], np.arange(1, len(ordered))
    rest = len(ordered) - counts
    apart = counts * rest * (sums / counts - (sums[-1] + ordered[-1] - sums) / rest) ** 2
    return float(np.expm1(ordered[int(np.argmax(np.where(ordered[1:] > ordered[:-1], apart, -1))) + 1]))


def main_blocks(html: str | None) -> list[str]:
    """The blocks of a page's main text, in order."""
    if not html:
        return []
    page = _Reader()
    page.feed(_closed(html))
    page.close()
    barred = _barred(page)
    lines = [line for line in page.lines if not barred[line.element]]
    if not lines:
        return []
    smoothed = smooth(np.array([(line.size - line.links) / max(1, line.tags) for line in lines]))
    least = threshold(smoothed) * (1 - 1e-9)
    content = smoothed >= least
    held = np.zeros(len(page.kinds))
    for line, counts in zip(lines, content, strict=True):
        held[line.element] += (line.size - line.links) * counts + 1e-6 * line.size
    children: list[list[int]] = [[] for _ in page.kinds]
    for element in range(len(page.kinds) - 1, 0, -1):
        held[page.parents[element]] += held[element]
        children[page.parents[element]].append(element)
    for kind in ("article", "main"):
        if regions := _outermost(page, barred, kind):
            most = max(held[element] for element in regions)
            chosen = np.zeros(len(page.kinds), bool)
            chosen[[element for element in regions if held[element] >= LEAST_SHARE * most]] = True
            for element in range(1, len(page.kinds)):
                chosen[element] |= chosen[page.parents[element]]
            kept = [line.text for line in lines if chosen[line.element]]
            if kept:
                return kept
    region = 0
    while inner := [e for e in children[region] if page.kinds[e] in _HOLDERS and held[e] >= MOST_SHARE * held[region]]:
        region = inner[0]
    return _trimmed(page, lines, least, region)


def _outermost(page: _Reader, barred: list[bool], kind: str) -> list[int]:
    """Elements of the kind that lie in no other of it and in none that is barred."""
    within, found = [False] * len(page.kinds), []
    for element in range(1, len(page.kinds)):
        within[element] = within[page.parents[element]]
        if page.kinds[element] == kind and not within[element] and not barred[element]:
            found.append(element)
            within[element] = True
    return found


def _trimmed(page: _Reader, lines: list[_Line], least: float, region: int) -> list[str]:
    """Lines of a region from the first to the last that looks like an article's, with headings before."""
    inside = [False] * len(page.kinds)
    for element in range(len(page.kinds)):
        inside[element] = element == region or element > 0 and inside[page.parents[element]]

    def likely(at: int) -> bool:
        line = lines[at]
        return line.size - line.links >= least * max(1, line.tags) or line.kind in ("p", "blockquote", "pre") and 2 * line.links < line.size

    places = [at for at in range(len(lines)) if inside[lines[at].element]]
    good = [at for at in places if likely(at)]
    if not good:
        return [lines[at].text for at in places]
    first, last = good[0], good[-1]
    while first and lines[first - 1].kind in _HEADINGS:
        first -= 1
    return [lines[at].text for at in range(first, last + 1) if inside[lines[at].element] or at < good[0]]


def _closed(html: str) -> str:
    """The page without comments that never end, and with what follows its last tag as text.

    Either would have the parser look at the rest of the page again and again.
    """
    end = html.rfind("-->") + 1
    if (begins := html.find("<!--", end)) >= 0:
        html = html[:begins] + html[begins:].replace("<!--", "")
    end = html.rfind(">") + 1
    return html[:end] + html[end:].replace("<", "&lt;")


def extract(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """The rows with ``text``, the main text, for the page; no shuffle."""
    others = [c for c in pages.columns if c not in (html_column, "text")]
    shape = pages.select(*others).schema.add("text", "string")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n\n".join(main_blocks(page.as_py())) for page in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string())], [*others, "text"])

    return pages.select(html_column, *others).mapInArrow(read, shape)


def op12_extraction(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    texts = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op12_extraction": op12_extraction}
