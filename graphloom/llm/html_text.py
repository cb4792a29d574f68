"""Main text of HTML pages by text-to-tag ratios.

The standard library's parser is fed a page piece by piece; its events build lines, one for each block of the page, with
the number of text characters and of tags; text inside links counts as markup. The ratios of text to tags, smoothed by a
Gaussian over neighbouring lines, are parted into two clusters around a threshold. The clusters choose the content region:
the block of the page in which lines over the threshold outweigh those below it by most. A declared article takes the
region's place where the clusters find it to be mostly content. Blocks that their names mark as menus, adverts, comments
and the like go, but never one that holds half of the page's content, whatever its name is.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import pieces_of

FEED = 1 << 16
SIGMA = 1.0
#: What a character below the threshold takes from its block's weight; share of a region that must be content.
BELOW, LEAST = 0.5, 0.1
#: Elements that declare the main text, and the share of their text that must be content for that.
DECLARED = {"article": LEAST, "main": 0.5}
#: A marked block stays if it holds this share of the page's content.
WRAPS = 0.8
#: Bytes of pages that a worker holds as Python strings.
HELD_BYTES = 4_000_000

#: Elements that end a block.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements whose text is never content: code, controls, and what stands for something else.
NEVER = frozenset("audio button canvas datalist embed frame head iframe input label map meter noframes noscript object option progress script select style svg template textarea title video".split())
#: Elements that are marked as no content by their name alone.
MARKED = frozenset("aside dialog footer form menu nav".split())
#: Elements without content of their own.
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
#: Elements that can be a region by themselves.
CONTAINERS = frozenset("article body center div form main section table td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class and id that mark what is not content, role values that do, and words that say no more than where or in what shape.
NOISE = frozenset("ad ads adsense advert advertisement adverts alert banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies disclaimer discussion disqus dropdown footer gdpr header hidden login masthead menu menubar menus modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing shoutbox sidebar signup skip social sponsor sponsored subscribe tags toolbar topbar widget widgets".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
GLUE = frozenset("area bar block bottom box buttons card col column container content cta feed fixed form global group inner inline item items js label large left link links list main message middle mobile module nav outer panel policy posts primary right row secondary section site slot small stories sub thread top unit user warning wrap wrapper zone".split())
_WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")
#: An open p ends where these begin; an item ends where the next of its kind begins.
_ENDS_P = BLOCKS - frozenset(("br", "body", "head", "html", "option", "optgroup", "tr", "td", "th", "tbody", "thead", "tfoot", "caption"))
_ENDS_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_SCOPES = frozenset("article aside div dl footer form header main nav ol section table ul".split())


def _names_noise(name: str) -> bool:
    """Whether a class name or id says that its element is no content: all its words do, or say only where it is."""
    words = [w.lower() for w in _WORDS.findall(name)]
    return any(w in NOISE for w in words) and all(w in NOISE or w in GLUE for w in words)


def is_marked(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> bool:
    """Whether names say that an element is no content."""
    if tag in MARKED or tag == "header" and not in_article:
        return True
    if tag in ("body", "html", "main"):
        return False
    for key, value in attrs:
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if value and (key == "role" and value.lower() in ROLES or key in ("class", "id") and any(map(_names_noise, value.split())) or key == "style" and _HIDDEN.search(value)):
            return True
    return False


class Page(HTMLParser):
    """A page's lines and its tree of blocks.

    Lines have text, characters outside links, tags and the innermost block; blocks (and marked elements of any kind) have
    a parent, which comes before them, their tag and whether names mark them as no content.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.plain: list[int] = []
        self.tags: list[int] = []
        self.blocks: list[int] = []
        self.parents, self.kinds, self.marks = [-1], [""], [False]
        self.open: list[tuple[str, int]] = []
        self.silent = self.links = self.articles = 0
        self.now: list[str] = []
        self.linked = self.now_tags = 0

    def end_line(self) -> None:
        if self.now:
            text = " ".join("".join(self.now).split())
            if text:
                self.texts.append(text)
                self.plain.append(max(0, len(text) - self.linked))
                self.tags.append(self.now_tags)
                self.blocks.append(self.open[-1][1] if self.open else 0)
                self.now_tags = 0
            self.now, self.linked = [], 0

    def _count(self, tag: str, by: int) -> None:
        self.silent += by * (tag in NEVER)
        self.links += by * (tag == "a")
        self.articles += by * (tag in DECLARED)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _ENDS_P:
            self._close_in_scope(("p",))
        if tag in _ENDS_SAME:
            self._close_in_scope(_ENDS_SAME[tag])
        self.now_tags += not self.silent
        marked = tag not in VOID and not self.silent and (tag in MARKED or tag == "header" or bool(attrs)) and is_marked(tag, attrs, self.articles > 0)
        if tag in BLOCKS or marked:
            self.end_line()
        if tag in VOID:
            return
        block = self.open[-1][1] if self.open else 0
        if marked or tag in BLOCKS and not self.silent:
            self.parents.append(block)
            self.kinds.append(tag)
            self.marks.append(marked)
            block = len(self.parents) - 1
        self.open.append((tag, block))
        self._count(tag, 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def _close_in_scope(self, tags: tuple[str, ...]) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in tags:
                self._close(k)
                return
            if self.open[k][0] in _SCOPES:
                return

    def _close(self, k: int) -> None:
        self.end_line()
        for tag, _ in self.open[k:]:
            self._count(tag, -1)
        del self.open[k:]

    def handle_endtag(self, tag: str) -> None:
        self.now_tags += not self.silent
        if tag in BLOCKS:
            self.end_line()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                own = self.open[k][1]
                if tag in BLOCKS or tag in NEVER or own and (k == 0 or self.open[k - 1][1] != own):
                    self._close(k)
                elif not any(x in BLOCKS for x, _ in self.open[k:]):
                    del self.open[k]
                    self._count(tag, -1)
                return
            if self.open[k][0] in _SCOPES and tag not in _SCOPES and tag not in ("body", "html"):
                return

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.now.append(data)
            if self.links:
                self.linked += len(data)


def parsed(html: str) -> Page:
    page = Page()
    for k in range(0, len(html), FEED):
        page.feed(html[k : k + FEED])
    if page.rawdata.startswith("<!--"):  # a comment without an end hides the rest
        page.rawdata = ""
    page.close()
    page.end_line()
    return page


def smoothed(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian means over neighbours, with the ends' own values beyond them."""
    reach = max(1, round(3 * sigma))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma**2))
    return np.convolve(np.pad(x, reach, "edge"), kernel / kernel.sum(), "valid")


def split_point(x: np.ndarray) -> float:
    """Threshold between two clusters of values, by alternating means; equal values are all above it."""
    point = x.mean()
    for _ in range(50):
        low, high = x[x < point], x[x >= point]
        if not len(low) or not len(high):
            return float(x.min())
        moved = (low.mean() + high.mean()) / 2
        if abs(moved - point) < 1e-9:
            break
        point = moved
    return float(point)


def content_lines(page: Page, threshold=split_point) -> tuple[np.ndarray, np.ndarray]:
    """Whether each line's ratio of text to tags, smoothed and by itself, is in the upper cluster of the smoothed ones.

    Logarithms keep one very long line from a cluster of its own.
    """
    ratio = np.array(page.plain, float) / np.maximum(1, page.tags)
    even = np.log1p(smoothed(ratio))
    point = threshold(even)
    return even >= point, np.log1p(ratio) >= point


def _sums(page: Page, values: np.ndarray) -> np.ndarray:
    """Sums of lines' values over each block and all within it."""
    out = np.bincount(page.blocks, values, minlength=len(page.parents)).tolist()
    for k in range(len(out) - 1, 0, -1):  # a block comes after the one it is in
        out[page.parents[k]] += out[k]
    return np.array(out)


def _inside(page: Page, blocks: set[int]) -> np.ndarray:
    """Whether each block is one of `blocks` or within one."""
    out = [k in blocks for k in range(len(page.parents))]
    for k in range(1, len(out)):
        out[k] = out[k] or out[page.parents[k]]
    return np.array(out)


def kept_lines(page: Page, content: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """Which lines are the main text, by those that are `content`; those that are so by their neighbours only have no weight."""
    of, size = np.array(page.blocks), np.array([len(x) for x in page.texts], float)
    mass = _sums(page, size * content)
    marked = {k for k in range(1, len(mass)) if page.marks[k] and mass[k] < WRAPS * mass[0]}
    live = ~_inside(page, marked)[of]
    if not live.any():
        return live
    mass, every = _sums(page, size * (content & live)), _sums(page, size * live)
    gain = _sums(page, size * live * np.where(content, content & alone, -BELOW))
    holds = np.array([k == 0 or page.kinds[k] in CONTAINERS for k in range(len(gain))])
    best = _last_best(np.where(holds, gain, -np.inf))
    if mass[best] < LEAST * every[best]:
        best = _last_best(gain)
    region = _declared(page, best, mass, every)
    keep = live & _inside(page, region or {best})[of]
    if region:
        return keep
    if page.kinds[best] in ("", "html", "body"):  # nothing stands out: the whole page but for lines of links before and after its content
        found, place = np.flatnonzero(keep & content), np.arange(len(keep))
        if len(found):
            keep &= (place >= found[0]) & (place <= found[-1]) | (2 * np.array(page.plain) > size)
        return keep
    at = int(np.flatnonzero(keep)[0]) - 1 if keep.any() else -1
    while at >= 0 and live[at] and page.kinds[of[at]] in HEADINGS:  # headings right before the region
        keep[at] = True
        at -= 1
    return keep


def _last_best(gain: np.ndarray) -> int:
    return len(gain) - 1 - int(np.argmax(gain[::-1]))


def _declared(page: Page, best: int, mass: np.ndarray, every: np.ndarray) -> set[int]:
    """The declared blocks that take the place of block `best`: one around it, or those within it that hold most of its content."""
    around = [best]
    while page.parents[around[-1]] >= 0:
        around.append(page.parents[around[-1]])
    inside = _inside(page, {best})
    for kind, share in DECLARED.items():
        for k in around:
            if page.kinds[k] == kind and mass[k] >= share * every[k]:
                return {k}
        within = [k for k in range(len(mass)) if inside[k] and page.kinds[k] == kind]
        outer = [k for k in within if not any(_inside_of(page, k, j) for j in within)]
        large = [k for k in outer if mass[k] >= 0.25 * max(mass[j] for j in outer)]
        if sum(mass[k] for k in large) >= 0.5 * mass[best] > 0:
            return set(large)
    return set()


def _inside_of(page: Page, k: int, outer: int) -> bool:
    k = page.parents[k]
    while k > outer:
        k = page.parents[k]
    return k == outer


def main_text(html: str, threshold=split_point) -> str:
    """Blocks of the content region in page order, joined by blanks; "" if a page has none."""
    page = parsed(html)
    if not page.texts:
        return ""
    keep = kept_lines(page, *content_lines(page, threshold))
    return " ".join(x for x, k in zip(page.texts, keep.tolist(), strict=True) if k)


def extract_text(html: Column) -> Column:
    """Main text of each page; null and empty pages give ""."""

    @F.arrow_udf("string")
    def extract(column: pa.Array) -> pa.Array:
        batch = pa.record_batch([column.cast(pa.string())], ["text"])
        return pa.array((main_text(x.as_py() or "") for rows in pieces_of(batch, HELD_BYTES) for x in rows.column(0)), pa.string())

    return extract(html)


def with_main_text(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """`pages` with the main text of `html_col` in `out_col`, which replaces a column of that name.

    Rows are independent, so repeats repeat. Null, empty and textless pages have ""; a page of bare text is its own main
    text; an empty table gives an empty one; other columns stay as they are.
    """
    return pages.withColumn(out_col, extract_text(F.col(html_col).cast("string")))


def op8_html_text(spark, sf_dir: str) -> DataFrame:
    """The contract's rows over the whole `pages` table."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return with_main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
