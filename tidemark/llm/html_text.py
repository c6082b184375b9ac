"""Main text of web pages by tag-path ratios.

A page becomes a sequence of text blocks, each with its tag path: the block elements from the root, those marked whose
class or id hints at something beside the article. For every path, text length and punctuation are summed over its
blocks; the ratios to the number of blocks, lowered for hinted paths, are smoothed along the page with a Gaussian. The
lesser of a ratio and its smoothed form counts; both kinds are put on a logarithmic scale and multiplied. Paths over a
share of the mean select the content: their blocks, and all blocks without a hint in the element that holds nearly all
of them, short ones for instance.

Only elements that cannot be text of an article by what they are (navigation, forms, code, what is hidden) are left out
before. A class or id does not count where the element holds most of the page's text and no article is beside it.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import frugal, slices

#: Standard deviation of the smoothing, in blocks.
SIGMA = 1.0
#: Share of the fused score's mean, over blocks, that a path needs.
THRESHOLD = 0.5
#: Share of the selected text that the article's element holds.
COVERED = 0.9
#: What a hint leaves of a path's ratios, so that they lift no neighbour, and again of its score, which neighbours lift.
HINTED = 0.02

SCHEMA = "page_id long, url string, text string, n_chars long, n_blocks int"

#: Element names as HTML has them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table body html article section div main".split())
LEFT_OUT = frozenset("nav aside footer form button select option svg canvas object audio video math menu dialog head label".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar".split())
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
    "sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer comment comments commentlist reply replies disqus respond "
    "share sharing social related newsletter subscribe subscription popup modal overlay widget login signup search toolbar skip pagination pager".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
NEVER = frozenset(("html", "body", "article", "main"))

_MARKUP = re.compile(
    r"""<!--(?:.*?(?:--!?>|\Z))|<([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: A word behind one of these says what an element has or lacks, not what it is.
_HINT_WORDS = re.compile(r"(?<![a-z])(?:(?:has|have|no|with|without)[-_]+[a-z]+|[a-z]+)")
_PUNCTUATION = re.compile(r"[.,;:!?…、。，！？；：]")


class Element:
    """An open or closed element. path names its block elements and hints from the root, the same for all that share them."""

    __slots__ = ("tag", "parent", "out", "hinted", "in_article", "block", "path", "text", "picked", "inside", "around")

    def __init__(self, tag: str, parent: Element | None, out: bool, hinted: bool):
        self.tag, self.parent, self.out, self.hinted = tag, parent, out, hinted
        self.in_article = tag in ("article", "main") or parent is not None and parent.in_article
        self.block: Element = self if tag in BLOCK or parent is None else parent.block
        self.path = 0
        self.text = self.picked = 0
        self.inside = self.around = False


def _left_out(tag: str, attributes: str, parent: Element) -> tuple[bool, bool]:
    """(whether the element is left out for what it is, whether a class or id hints that it is no part of an article)."""
    if tag in LEFT_OUT or tag == "header" and not parent.in_article:
        return True, False
    if tag in NEVER or not attributes:
        return False, False
    hinted = False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (values[0] or values[1] or values[2]).lower()
        if name in ("class", "id"):
            words = set(_HINT_WORDS.findall(value))
            hinted |= bool(words & HINTS) or bool(words & {"header", "masthead"}) and not parent.in_article
        elif name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True, False
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, False
    return False, hinted


class Page:
    """elements in the order in which they open, the root first; blocks: (block element, text) in page order, white space
    folded, without what is left out. Every step takes time in proportion to the page, however deep it is."""

    def __init__(self, page: str):
        self.root = Element("", None, False, False)
        self.elements = [self.root]
        self.blocks: list[tuple[Element, str]] = []
        self._stack = [self.root]
        self._open: dict[str, int] = {}
        self._buffer: list[str] = []
        self._parse(page)
        self._mind_hints()

    def _flush(self) -> None:
        if self._buffer:
            text = " ".join(entities.unescape("".join(self._buffer)).split())
            self._buffer.clear()
            if text:
                self.blocks.append((self._stack[-1].block, text))

    def _add(self, text: str) -> None:
        if text and not self._stack[-1].out:
            self._buffer.append(text)

    def _pop_to(self, i: int) -> None:
        if any(e.tag in BLOCK for e in self._stack[i:]):
            self._flush()
        for e in self._stack[i:]:
            self._open[e.tag] -= 1
        del self._stack[i:]

    def _close(self, tags: tuple[str, ...], scope: frozenset[str] = frozenset()) -> None:
        """Close the innermost open element of these tags, unless one of the scope is further in."""
        if not any(self._open.get(t) for t in tags):
            return
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i].tag in tags:
                self._pop_to(i)
                return
            if self._stack[i].tag in scope:
                return

    def _parse(self, page: str) -> None:
        at, lowered = 0, None
        while (m := _MARKUP.search(page, at)) is not None:
            self._add(page[at : m.start()])
            at = m.end()
            opened, attributes, closed = m.group(1, 2, 3)
            if closed:
                self._close((closed.lower(),))
            if not opened:
                continue
            tag = opened.lower()
            if tag in RAW:
                lowered = page.lower() if lowered is None else lowered
                # Lower-casing can change lengths outside ASCII; then the end is searched without regard to case.
                end = lowered.find(f"</{tag}", at) if len(lowered) == len(page) else ((x := re.compile(f"</{tag}", re.I).search(page, at)) and x.start() or -1)
                close = page.find(">", end) if end >= 0 else -1
                at = len(page) if close < 0 else close + 1
            elif tag == "br":
                self._add(" ")
            elif tag in VOID:
                if tag == "hr":
                    self._flush()
            else:
                self._enter(tag, attributes)
        self._add(page[at:])
        self._flush()

    def _enter(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            self._close(("p",), BLOCK - {"p"})
        if tag in CLOSES:
            self._close(CLOSES[tag], SCOPE)
        parent = self._stack[-1]
        out, hint = (True, False) if parent.out else _left_out(tag, attributes, parent)
        if tag in BLOCK:
            self._flush()
        elif out and not parent.out:
            self._add(" ")
        if not attributes.endswith("/") or tag in BLOCK:
            e = Element(tag, parent, out, hint)
            self._stack.append(e)
            self.elements.append(e)
            self._open[tag] = self._open.get(tag, 0) + 1

    def _mind_hints(self) -> None:
        """Drop hints that can't be meant, hand the others down, and name the paths."""
        articles: list[Element] = []
        total = 0
        for e, text in self.blocks:
            e.text += len(text)
            total += len(text)
        # How many articles with text are in an element; those in it are none beside it.
        held = dict.fromkeys((id(e) for e in self.elements), 0)
        for e in reversed(self.elements):
            if e.tag in ("article", "main") and e.text:
                articles.append(e)
                held[id(e)] += 1
            if e.parent is not None:
                e.parent.text += e.text
                held[id(e.parent)] += held[id(e)]
        above = dict.fromkeys((id(e) for e in self.elements), 0)
        names: dict[tuple[int, str, bool], int] = {}
        for e in self.elements[1:]:
            above[id(e)] = above[id(e.parent)] + (e.parent.tag in ("article", "main") and e.parent.text > 0)
            if e.hinted and 2 * e.text > total and held[id(e)] + above[id(e)] == len(articles):
                e.hinted = False
            e.hinted |= e.parent.hinted
            e.path = names.setdefault((e.parent.path, e.tag if e.tag in BLOCK else "", e.hinted), len(names) + 1)


def _smoothed(values: list[float]) -> list[float]:
    reach = math.ceil(2 * SIGMA)
    weights = [math.exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in range(-reach, reach + 1)]
    out, n = [], len(values)
    for i in range(n):
        lo, hi = max(0, i - reach), min(n, i + reach + 1)
        w = weights[lo - i + reach : hi - i + reach]
        out.append(sum(map(float.__mul__, w, values[lo:hi])) / sum(w))
    return out


def path_scores(blocks: list[tuple[Element, str]]) -> dict[int, float]:
    """The fused ratio of each path: the mean over its blocks of text-per-path times punctuation-per-path, each the lesser
    of its own and its smoothed value, on a logarithmic scale; of hinted paths a small share."""
    sums: dict[int, list[float]] = {}
    for e, text in blocks:
        s = sums.setdefault(e.path, [0.0, 0.0, 0.0, HINTED if e.hinted else 1.0])
        s[0] += len(text)
        s[1] += len(_PUNCTUATION.findall(text))
        s[2] += 1
    paths = [e.path for e, _ in blocks]
    ratios = [[sums[k][side] / sums[k][2] * sums[k][3] for k in paths] for side in (0, 1)]
    # Neither does a long advert among links pass, nor a link among paragraphs.
    lengths, marks = ([min(own, around) for own, around in zip(r, _smoothed(r), strict=True)] for r in ratios)
    fused: dict[int, float] = dict.fromkeys(sums, 0.0)
    for k, length, mark in zip(paths, lengths, marks, strict=True):
        fused[k] += math.log1p(length) * (1.0 + math.log1p(mark))
    return {k: v / sums[k][2] * sums[k][3] for k, v in fused.items()}


def main_blocks(html: str | None) -> list[str]:
    """The article's blocks in page order; none for a null or empty page or one without text."""
    page = Page(html) if html else None
    if page is None or not page.blocks:
        return []
    scores = path_scores(page.blocks)
    least = THRESHOLD * sum(scores[e.path] for e, _ in page.blocks) / len(page.blocks)
    total = 0
    for e in page.elements:
        e.text = 0
    for e, text in page.blocks:
        passed = len(text) if scores[e.path] >= least else 0
        total += passed
        e.picked += passed
        e.text += 0 if e.hinted else len(text)
    # The last element to open that is no mere paragraph and holds enough of what passed: two that do are in each other.
    best = page.root
    for e in reversed(page.elements[1:]):
        if best is page.root and e.picked >= COVERED * total and e.tag not in ("p", "li", "pre", "blockquote"):
            best = e
        e.parent.picked += e.picked
        e.parent.text += e.text
    up: Element | None = best
    while up is not None:
        if up.tag in ("article", "main"):
            best = up
        up = up.parent
    best.inside = True
    # Headings in an element around it that adds little belong to the article.
    around = best
    while not around.in_article and around.parent is not None and around.parent.text <= 1.3 * best.text:
        around = around.parent
    around.around = True
    for e in page.elements[1:]:
        e.inside |= e.parent.inside
        e.around |= e.parent.around
    return [text for e, text in page.blocks if scores[e.path] >= least or not e.hinted and (e.inside or e.around and e.tag in HEADINGS)]


def extract_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text (the blocks joined by line ends), n_chars, n_blocks for every row, from the whole html.

    A null, empty or text-less page has empty text. Null ids and urls stay null, repeated rows stay repeated, other
    columns are ignored, an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            blocks = [main_blocks(h) for h in part.column("html").to_pylist()]
            texts = ["\n".join(b) for b in blocks]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(map(len, blocks), pa.int32())],
                names=["page_id", "url", "text", "n_chars", "n_blocks"],
            )

    chosen = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return chosen.mapInArrow(frugal(run), SCHEMA)
