"""Main text of web pages: parser events, text-to-tag ratios per line, Gaussian smoothing and a threshold."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from evalspark.llm.common import kept_columns

#: Elements that begin and end a line of text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold article text.
SKIPPED = frozenset("applet aside audio button canvas datalist dialog footer form head iframe map menu nav noembed noframes noscript object option script select style svg template textarea title video".split())
#: Words of a class, id or role that speak for page furniture, and words that may stand beside them in one name.
FURNITURE = frozenset("ad ads adv advert advertisement adverts alert banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies consent copyright disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe toolbar widget widgets".split())
BESIDE = frozenset("area articles bar block body bottom box button buttons container first form global google header icon icons info inner item items last law left link links list main outer overlay page panel post posts primary right secondary section site slot stories top user wrap wrapper".split())
#: What a name may say of an element that holds the whole page: it is then no furniture.
PAGE = frozenset("html body main".split())
#: Blocks that are parts of a text, not containers of one.
PARTS = frozenset("blockquote caption center dd details dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr legend li ol p pre summary ul".split())
#: Elements that close an open one of the same or the named kind when they begin, within the nearest list or table.
SIBLINGS = {"li": "li", "dt": "dd", "dd": "dt", "tr": "tr", "td": "th", "th": "td", "option": "option"}
LISTS = ("ul", "ol", "dl", "table")
#: Width of the smoothing kernel in lines.
SIGMA = 1.0
#: Share of the standard deviation at which smoothed ratios count as content.
THRESHOLD = 0.5
#: Share of the fullest level's content from which an outer level of marked elements is the page's. What a character
#: counts there in an article or main element, and in an element with a furniture name.
HOME, ARTICLE, NAMED = 0.25, 4.0, 0.1
#: Share of the fullest article's text from which another article of the page is one of its texts.
FELLOW = 0.25
_HIDING = re.compile(r"(?i)(^|;)\s*(display\s*:\s*none|visibility\s*:\s*hidden)")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def furniture_name(name: str) -> bool:
    """Whether a whole class name, id or role speaks for furniture: 'site-footer' and 'cookieNotice' do, 'no-sidebar',
    'comments-open' and 'share-price' do not."""
    parts = [x.lower() for x in _PARTS.findall(name)]
    return not FURNITURE.isdisjoint(parts) and all(x in FURNITURE or x in BESIDE for x in parts)


class Lines(HTMLParser):
    """Collects lines (text, count of tags, element) and the tree of elements; element 0 is the page.

    Per element: its parent, whether it never holds article text, whether it may be a region, whether an article or
    main element is open, and the innermost element around it that a furniture name marks (0: none). Every event costs
    the same at any depth: the places on the stack where a tag is open are at hand.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack, self.tag = [0], [""]
        self.open: dict[str, list[int]] = {}
        self.blocks = [0]
        self.text: list[str] = []
        self.tags = 0
        self.lines: list[tuple[str, int, int]] = []
        self.parent, self.skipped, self.region, self.article, self.marked = [0], [False], [True], [False], [0]
        self.articles: list[int] = []
        self.marks: dict[int, frozenset[str]] = {}
        self.pages = {0}

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.tags, self.stack[-1]))
            self.tags = 0
        self.text.clear()

    def place(self, tag: str) -> int:
        """The innermost place on the stack where ``tag`` is open; 0 if it is not."""
        at = self.open.get(tag)
        return at[-1] if at else 0

    def cut(self, at: int) -> None:
        """Close what is open from place ``at`` on."""
        for element in self.stack[at:]:
            self.open[self.tag[element]].pop()
        del self.stack[at:]
        while self.blocks[-1] >= at:
            self.blocks.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag in BLOCKS:
            self.flush()
            p = self.place("p")
            if p and p == self.blocks[-1]:
                self.cut(p)
            if tag in SIBLINGS:
                for sibling in (tag, SIBLINGS[tag]):
                    at = self.place(sibling)
                    if at and at > max(map(self.place, LISTS)):
                        self.cut(at)
        if tag in VOID:
            return
        names = frozenset(x for k, v in attrs if k in ("class", "id", "role") and v for x in v.split() if furniture_name(x))
        hidden = any(k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and v and _HIDING.search(v)) for k, v in attrs)
        up, element = self.stack[-1], len(self.parent)
        skipped = self.skipped[up] or tag in SKIPPED or hidden or (tag == "header" and not self.article[up])
        article = tag in ("article", "main") and not skipped
        self.parent.append(up)
        self.tag.append(tag)
        self.skipped.append(skipped)
        self.region.append(tag in BLOCKS and tag not in PARTS)
        self.article.append(article or self.article[up])
        if article:
            self.articles.append(element)
        if names and tag not in PAGE:
            self.marks[element] = names
        self.marked.append(element if element in self.marks else self.marked[up])
        if tag in ("html", "body"):
            self.pages.add(element)
        self.open.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append(element)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        at = self.place(tag)
        if at and (tag in BLOCKS or at > self.blocks[-1]):
            self.cut(at)

    def handle_data(self, data: str) -> None:
        """Text counts to the block that it stands in, unless an element inside that block is skipped, hidden or named
        as furniture."""
        e, block = self.stack[-1], self.stack[self.blocks[-1]]
        if e == block or (self.skipped[e] == self.skipped[block] and self.marked[e] == self.marked[block]):
            self.text.append(data)


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Ratios under a Gaussian kernel that reaches three sigma; edges see what is there."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = lambda x: np.convolve(x, kernel, "full")[reach : reach + len(x)]
    return full(ratios) / full(np.ones_like(ratios))


def cluster(lines: list[tuple], free: np.ndarray) -> np.ndarray:
    """Which of the free lines are content: their smoothed ratio reaches a threshold over the page."""
    ratio = smoothed(np.where(free, np.array([len(line[0]) / max(1, line[1]) for line in lines]), 0.0))
    return free & (ratio >= min(ratio[free].max(), THRESHOLD * ratio.std()))


def furniture(page: Lines, content: np.ndarray) -> list[bool]:
    """For each element whether it lies in furniture, as the content lines decide.

    Each line belongs to its innermost marked element, or to none. The outermost of these levels that has a fair share
    of the content is the page's own: names that mark it or what it lies in say nothing on this page.
    """
    depth = {0: 0}
    for m in page.marks:
        depth[m] = depth[page.marked[page.parent[m]]] + 1
    true_article = [False] * len(page.parent)
    for e in range(1, len(true_article)):
        true_article[e] = true_article[page.parent[e]] or (page.article[e] and not page.article[page.parent[e]] and not page.marked[e])
    held: dict[int, float] = {}
    for i in np.flatnonzero(content):
        text, _, e = page.lines[i]
        m = page.marked[e]
        held[m] = held.get(m, 0.0) + len(text) * (ARTICLE if true_article[e] else 1.0) * (NAMED if m else 1.0)
    most = max(held.values())
    home = min((m for m, v in held.items() if v >= HOME * most), key=lambda m: (depth[m], -held[m]))
    said: set[str] = set()
    while home:
        said |= page.marks[home]
        home = page.marked[page.parent[home]]
    bad = [False] * len(page.parent)
    for e in range(1, len(bad)):
        bad[e] = bad[page.parent[e]] or (e in page.marks and not page.marks[e] <= said)
    return bad


def parsed(html: str) -> Lines:
    """The lines of a page, read at once, so that what is never closed is looked for once. A comment or tag without an end
    takes the rest of the page with it, as in browsers."""
    page, begin = Lines(), html.find("<!--", html.rfind("-->") + 1)
    if begin >= 0 and html.rfind("<script", 0, begin) <= html.rfind("</script", 0, begin):
        html = html[:begin]
    page.feed(html)
    if re.match("<[A-Za-z/!?]", page.rawdata) and page.cdata_elem is None:
        page.rawdata = ""
    page.close()
    page.flush()
    return page


def main_text(html: str | None) -> str:
    """The blocks of the page's main region, joined by two newlines; empty if there is none.

    A line's ratio is its characters over its tags (furniture has ratio 0). Lines whose smoothed ratio reaches a
    threshold over the page form the content cluster; the region is the innermost container that holds nearly all of that
    cluster's text, or, where a page has them, its outermost articles and main elements that hold text (of several the
    fullest and those not much shorter). All lines of the region that are no furniture are kept, short ones too. Only where that is the whole page, lines outside the cluster's first and last line are left
    out. A furniture name marks no element that holds the content (see furniture).
    """
    if not html:
        return ""
    page = parsed(html)
    lines, parent = page.lines, page.parent
    free = np.array([not page.skipped[e] for _, _, e in lines], bool)
    if not free.any():
        return ""
    content = cluster(lines, free)
    if page.marks:
        bad = furniture(page, content)
        free &= np.array([not bad[e] for _, _, e in lines], bool)
        content = cluster(lines, free)
    held, whole = [0] * len(parent), [0] * len(parent)
    for i in np.flatnonzero(free):
        whole[lines[i][2]] += len(lines[i][0])
        held[lines[i][2]] += len(lines[i][0]) if content[i] else 0
    for e in range(len(held) - 1, 0, -1):
        held[parent[e]] += held[e]
        whole[parent[e]] += whole[e]
    articles = [e for e in page.articles if whole[e] and not page.article[parent[e]]]
    regions = {e for e in articles if whole[e] >= FELLOW * max(whole[x] for x in articles)}
    for e in [e for e in regions if page.tag[e] == "main"]:  # an article that holds nearly all of a main element is the text
        inner = [x for x in page.articles if whole[x] >= 0.8 * whole[e] and x > e]
        regions = regions - {e} | {max(inner, default=e)}
    regions = regions or {max(e for e in range(len(held)) if page.region[e] and held[e] >= 0.8 * held[0])}
    inside = [0 in regions] * len(parent)
    for e in range(1, len(inside)):
        inside[e] = e in regions or inside[parent[e]]
    keep = [i for i in range(len(lines)) if free[i] and inside[lines[i][2]]]
    if regions & page.pages:
        first, last = np.flatnonzero(content)[[0, -1]]
        keep = [i for i in keep if first <= i <= last]
    return "\n\n".join(lines[i][0] for i in keep)


def extract_pages(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with the main text of each whole page instead of its html.

    Null, empty and textless pages give ''. ``text_col`` wins over a column of the same name.
    """
    keep = kept_columns(pages.drop(html_col), [text_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x.as_py()) for x in batch.column(html_col)], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], texts], names=[*keep, text_col])

    schema = T.StructType([*[pages.schema[c] for c in keep], T.StructField(text_col, T.StringType())])
    return pages.mapInArrow(run, schema)
