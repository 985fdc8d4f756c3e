"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block of the page. What is no reading matter by
its markup (menus, forms, scripts, adverts and so on) leaves blank lines. Text lengths,
without link texts, are summed over a sliding window of lines. Where the sum rises over a
threshold the main text may begin (a surge), where it falls to nothing it ends (a dive);
what lies between is kept if it surged. Blank lines between two lines of one container (an
advert amid paragraphs) are no dive. If nothing surges, the stretch with the most text is
kept. If the page marks its article, what lies outside counts as blank and any text is a
surge, so the marks decide there and the window does not.

Pages are independent: one pass without a shuffle, one page in memory at a time.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame

from palisade.llm.common import column, small_batches, text_batches

WINDOW = 3
SURGE = 80

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption"
    " figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search"
    " section summary table tbody tfoot thead tr ul".split()
)
# Elements that hold the paragraphs of one text.
CONTAINERS = frozenset("article body center details div fieldset html main section td".split())
# What a page's article does not consist of, by element ...
DROPPED = frozenset(
    "aside audio button canvas datalist dialog footer form head iframe input menu nav"
    " noscript object option script search select style svg template textarea title video".split()
)
# ... and by the words of class, id and role. Those of the second kind stay inside an article.
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment commentlist"
    " comments complementary consent contentinfo cookie cookies disclaimer discussion disqus feedback foot footer"
    " gdpr guestbook login menu menubar modal nav navbar navigation newsletter notice notices notification"
    " outbrain overlay pager pagination paywall popup promo promoted promotion recommendations recommended related"
    " replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe"
    " subscription taboola teaser toolbar topbar widget widgets".split()
)
# What the words must be for an element inside a line to go: a marked name or button stays.
INLINE_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense outbrain sponsored taboola".split())
PAGE_WORDS = frozenset("header masthead banner".split())
# A class of these says what the whole page has, not what the element is.
ABOUT = frozenset("has no with without is".split())
READERS = frozenset("comment comments commentlist discussion disqus guestbook replies reply respond".split())
CONTENT = frozenset("article content entry main post story".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class _Element:
    __slots__ = ("tag", "dropped", "reason", "article", "link")

    def __init__(self, tag: str, dropped: bool, reason: str, article: bool, link: bool):
        self.tag, self.dropped, self.reason, self.article, self.link = tag, dropped, reason, article, link


def _names(attributes: str) -> tuple[set[str], bool]:
    """The words of class, id and role, and whether the element is hidden."""
    words: set[str] = set()
    hidden = False
    for name, a, b, c, bare in _ATTRIBUTE.findall(attributes):
        value, name = a or b or c, name.lower()
        if bare:
            hidden = True
        elif name in ("class", "id", "role"):
            for one in value.split():
                parts = [w.lower() for w in _WORD.findall(one)]
                if not ABOUT.intersection(parts):
                    words.update(parts)
        elif name == "style":
            hidden |= "display:none" in value.replace(" ", "").lower()
        elif name == "aria-hidden":
            hidden |= value.lower() == "true"
    return words, hidden


def _element(tag: str, attributes: str, parent: _Element, by_name: bool) -> _Element:
    dropped, reason, article = parent.dropped, parent.reason, parent.article
    words, hidden = _names(attributes) if attributes.strip() else (set(), False)
    readers = bool(by_name and tag in BLOCKS and words & READERS)
    if tag in ("article", "main") and not readers:
        # A wrapper's name does not take its article away.
        if reason not in ("element", "readers"):
            dropped = False
        article = True
    if not dropped and tag not in ("html", "body", "main"):
        if readers:
            dropped, reason = True, "readers"
        elif tag in DROPPED or hidden:
            dropped, reason = True, "element"
        elif tag != "article" and by_name and words & (WORDS if tag in BLOCKS else INLINE_WORDS):
            dropped, reason = True, "name"
        elif not article and (tag == "header" or by_name and words & PAGE_WORDS):
            dropped, reason = True, "name"
    if not dropped and tag in ("div", "section", "td") and by_name and words & CONTENT and not words & WORDS:
        article = True
    return _Element(tag, dropped, reason, article, parent.link or tag == "a")


def page_lines(page: str, by_name: bool = True) -> list[tuple[str, int, bool]]:
    """(text, characters outside links, inside an article) of every line; blank where something was dropped."""
    return _lines_and_containers(page, by_name)[0]


def _lines_and_containers(page: str, by_name: bool) -> tuple[list[tuple[str, int, bool]], list[_Element | None]]:
    """The lines, and the container that each begins in."""
    lines: list[tuple[str, int, bool]] = []
    containers: list[_Element | None] = []
    stack = [_Element("", False, "", False, False)]
    # Places in the stack of the open elements of a name, of the open blocks and of the open containers.
    places: dict[str, list[int]] = defaultdict(list)
    blocks: list[int] = [0]
    holders: list[int] = [0]
    text: list[str] = []
    plain = at = 0
    inside = False
    container: _Element | None = None

    def end_line() -> None:
        nonlocal plain, inside, container
        line = " ".join("".join(text).split())
        if line:
            lines.append((line, plain, inside))
            containers.append(container)
        text.clear()
        plain, inside, container = 0, False, None

    def add(raw: str) -> None:
        nonlocal plain, inside, container
        top = stack[-1]
        if raw and not top.dropped:
            value = html.unescape(raw) if "&" in raw else raw
            if container is None and not value.isspace():
                container = stack[holders[-1]]
            text.append(value)
            inside |= top.article
            if not top.link:
                plain += sum(map(len, value.split()))

    def close_to(depth: int) -> None:
        if any(e.dropped for e in stack[depth:]) and not stack[depth - 1].dropped:
            lines.extend([("", 0, False)] * WINDOW)
            containers.extend([None] * WINDOW)
        for e in reversed(stack[depth:]):
            places[e.tag].pop()
        del stack[depth:]
        for open_ in (blocks, holders):
            while open_[-1] >= depth:
                open_.pop()

    while at < len(page):
        found = _TOKEN.search(page, at)
        if not found:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        closing, attributes = found[1] or found[4], found[3] or found[6] or ""
        block = tag in BLOCKS
        if block:
            end_line()
        elif tag in ("br", "td", "th", "option"):
            add(" ")
        if closing:
            # An inline end tag does not close blocks.
            if places[tag] and (block or places[tag][-1] > blocks[-1]):
                close_to(places[tag][-1])
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if block:
            # A block ends an open paragraph, an item an open item.
            open_tag = stack[blocks[-1]].tag
            if open_tag == "p" or open_tag == tag and tag in ("li", "dt", "dd", "tr"):
                close_to(blocks[-1])
        places[tag].append(len(stack))
        if block:
            blocks.append(len(stack))
        if tag in CONTAINERS:
            holders.append(len(stack))
        stack.append(_element(tag, attributes, stack[-1], by_name))
    end_line()
    return lines, containers


def _without_gaps(lines: list[tuple[str, int, bool]], containers: list[_Element | None]) -> list[tuple[str, int, bool]]:
    """The lines without the blank ones between two of the same container."""
    out: list[tuple[str, int, bool]] = []
    last, blank = None, 0
    for line, container in zip(lines, containers):
        if line[0]:
            if blank and container is last:
                del out[-blank:]
            last, blank = container, 0
        else:
            blank += 1
        out.append(line)
    return out


def _with_single_links(lines: list[tuple[str, int, bool]], weights: list[int]) -> list[int]:
    """The weights, with one for each line of links that stands alone between two lines of text: a linked
    heading, not a menu."""
    out, n = list(weights), len(weights)
    for i, (line, _, _) in enumerate(lines):
        if line and not weights[i] and 0 < i < n - 1 and weights[i - 1] and weights[i + 1]:
            out[i] = 1
    return out


def between_surge_and_dive(weights: list[int], window: int = WINDOW, surge: int = SURGE) -> list[bool]:
    """Which lines to keep: ``weights`` are the text lengths of the lines.

    A stretch of lines ends where ``window`` lines in a row are empty. It is kept if its
    windows surge to at least ``surge`` characters somewhere.
    """
    n = len(weights)
    sums, total = [0] * n, 0
    for i in range(n - 1, -1, -1):
        total += weights[i] - (weights[i + window] if i + window < n else 0)
        sums[i] = total
    keep, start, surged = [False] * n, None, False
    for i in range(n + 1):
        if i < n and sums[i] > 0:
            if start is None:
                start, surged = i, False
            surged |= sums[i] >= surge
        elif start is not None:
            # The dive: nothing in this window, so the stretch ended before it.
            for k in range(start, i):
                keep[k] = surged
            start = None
    return keep


def best_stretch(weights: list[int], window: int = WINDOW) -> list[bool]:
    """Which lines to keep if none surge: those of the first stretch with the most text."""
    stretches: list[list[int]] = []
    last = -window - 1
    for i, w in enumerate(weights):
        if w:
            if i - last > window:
                stretches.append([])
            stretches[-1].append(i)
            last = i
    best = set(max(stretches, key=lambda s: sum(weights[i] for i in s), default=()))
    return [i in best for i in range(len(weights))]


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The page's main text, blocks joined by two line feeds; empty if there is none."""
    if not page:
        return ""
    read = []
    for by_name in (True, False):
        lines, containers = _lines_and_containers(page, by_name)
        marked = any(inside and line for line, _, inside in lines)
        if marked:
            # Links inside an article are part of its sentences.
            weights = [len(line) if inside else 0 for line, _, inside in lines]
        else:
            lines = _without_gaps(lines, containers)
            # A line of links only is a menu.
            weights = [plain if 2 * plain > len(line) else 0 for line, plain, _ in lines]
        keep = between_surge_and_dive(weights, window, 1 if marked else surge)
        if not marked:
            weights = _with_single_links(lines, weights)
        kept = [line for (line, _, _), k, w in zip(lines, keep, weights) if k and w]
        if kept:
            return "\n\n".join(kept)
        read.append((lines, weights))
    for lines, weights in read:
        kept = [line for (line, _, _), k in zip(lines, best_stretch(weights, window)) if k]
        if kept:
            return "\n\n".join(kept)
    return ""


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    A null or empty page, and one without a main text, has the empty text. Null and repeated
    ids and urls are kept as they are; other columns are ignored. Unclosed elements end with
    the page, as in a page that was cut off.
    """
    small_batches(pages.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(p) for p in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )

    rows = pages.select(
        column(id_col).cast("long").alias("page_id"), column(url_col).alias("url"), column(html_col).alias("html")
    )
    return rows.mapInArrow(text_batches(run), "page_id long, url string, text string, n_chars long")
