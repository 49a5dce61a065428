"""Main text of web pages by tag-path ratios.

A page is read once into text nodes, each with its path of tags from the root (classes included)
and its block.  What can only be furniture is left out on sight: head, scripts, styles, controls.
Forms, menus, footers, asides and hidden elements are left out unless they hold a main, the page's
longest article or (but for menus, footers and asides) most of its running text.  An element whose
class or id is a word for furniture, or a compound that ends in one, is not left out: unless it is or
holds such, its ratios count for less.  For every path that is left, text
length and punctuation are summed; their ratios to the path's nodes tell running text from labels.
Ratios are smoothed along the page by neighbouring nodes and fused with those of the path's container.
A threshold relative to the page's own running text then chooses containers: an article or main (the
outermost), or else the nearest div, section or body.  All text of a chosen container stays, so short
lines, list items and table cells stay with the text around them.  Only outside article and main, a
list, table or block that is mostly links stays by its own ratio or between kept text of its container.
Text that is in no chosen container stays where its own ratio reaches the threshold.

Edge cases: a null or empty page, or one without text, gives an empty text; unclosed, misnested and
cut-off markup is read as far as it goes, in time and memory that grow with the page's length; a very
long page is read whole; a text outside any tag is a block; repeated rows give the
same text each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
FURNITURE = frozenset("head nav footer aside form button select option label svg math canvas object audio video "
                      "dialog menu fieldset datalist map".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption "
                   "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary "
                   "table tbody td tfoot th thead tr ul caption".split())
# Words by which elements name themselves as furniture.
NAMES = frozenset("ad ads adv advert advertisement advertising adsense banner breadcrumb breadcrumbs comment "
                  "comments comentarios commentaires kommentare disqus cookie cookies consent gdpr notice notices "
                  "alert popup modal overlay promo promotion sponsor sponsored newsletter subscribe subscription "
                  "signup login menu nav navbar navigation topbar sidebar side aside footer foot masthead share "
                  "sharing social related recommended recommendations pagination pager widget toolbar tags "
                  "replies reply respond copyright hidden skip".split())
# Of a name in several parts (cookie-banner, post-comments, comment-list) the last part tells what
# it is: a word above but for these, or a word for a container behind one above ..
NOT_LAST = frozenset("side share skip respond reply hidden social related alert".split())
CONTAINERS = frozenset("list box bar banner posts links section area block container wrapper wrap widget form panel "
                       "item items body text thread holder inner message unit slot info icons buttons content feed".split())
# .. unless a part says that the element is only beside such a thing.
SWITCHES = frozenset("has no not with without is show hide".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar "
                  "toolbar form".split())
MAIN = frozenset(("article", "main"))
# Furniture that may still be found to hold the page; the second set is not judged by its size.
HOLDERS = frozenset("nav footer aside form dialog menu fieldset header".split())
ASIDE = frozenset("nav footer aside menu".split())
# Elements whose own text is judged together, and elements that stay or go as one outside articles.
BOXES = frozenset("div section article main body center".split())
CHUNKS = frozenset("ul ol dl table".split())
# A table cell that holds one of these lays out the page and is judged by itself.
LAYOUT = frozenset("div section center table h1 h2 h3 h4 h5 h6".split())
# Tags that end an open <p> and tags that end an open one of their own kind.
ENDS_ITSELF = frozenset("p li dt dd option tr td th".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
                    r"|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"""([A-Za-z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?¿¡…。，、！？；：]")
_CLOSERS = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}

#: A container whose fused ratio is under this share of the page's running text is not chosen.
THRESHOLD = 0.15
#: The ratios of an element that names itself as furniture count for this share.
PRIOR = 0.05
#: The longest article speaks for what holds it when it has this share of the running text.
WEIGHTY = 0.25
#: Neighbours on each side, and the width of the weights, in smoothing.
REACH, WIDTH = 3, 1.5


class Place(NamedTuple):
    """Where a text is: numbers of the outermost article or main (-1 if none), of the nearest box and
    of the outermost list or table in that box (-1 if none), and whether it is in a link."""

    article: int = -1
    box: int = 0
    chunk: int = -1
    link: bool = False

    def inside(self, tag: str, number: int, parent: tuple[str, int]) -> Place:
        article, box, chunk, link = self
        if article < 0 and tag in MAIN:
            article, box, chunk = number, number, -1
        elif article < 0 and tag in LAYOUT and parent[0] in ("td", "th"):
            box, chunk = parent[1], -1
        if tag in BOXES and chunk < 0:
            box = number
        elif tag in CHUNKS and chunk < 0:
            chunk = number
        return Place(article, box, chunk, link or tag == "a")


class Node(NamedTuple):
    #: Numbers of the path of tags and of the path that holds its block.
    path: int
    holder: int
    block: int
    text: str
    place: Place
    #: The outermost element around it that names itself as furniture, 0 if none.
    named: int = 0


class _Open(NamedTuple):
    tag: str
    path: int
    holder: int
    furniture: bool
    number: int
    place: Place
    mark: int         # the innermost article, main or suspect that is open, 0 if none
    nearest: int      # place in the stack of the nearest block, itself included, -1 if none


def _names_furniture(value: str) -> bool:
    for name in value.split():
        if name in NAMES:
            return True
        parts = _WORD.findall(name)
        if len(parts) > 1 and SWITCHES.isdisjoint(parts):
            if parts[-1] in NAMES - NOT_LAST or (parts[-1] in CONTAINERS and not NAMES.isdisjoint(parts[:-1])):
                return True
    return False


def _furniture(tag: str, attrs: str, in_main: bool) -> tuple[bool, bool, bool, str]:
    """Whether an element is furniture by itself, by its tag or role unless it holds the page, or by
    its names; and its name in paths."""
    never = tag in FURNITURE and tag not in HOLDERS
    bad = tag in HOLDERS and not (tag == "header" and in_main)
    if never or not attrs or attrs.isspace():
        return never, bad, False, tag
    names, called = "", False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), html.unescape((m[2] or "").strip("\"'")).lower()
        if key in ("class", "id"):
            called = called or (tag not in MAIN and tag not in ("body", "html") and _names_furniture(value))
            names += "." + "-".join(_WORD.findall(value)) if key == "class" else ""
        elif key == "role":
            bad = bad or value in ROLES
        elif key == "hidden" or (key == "aria-hidden" and value == "true"):
            bad = True
        elif key == "style" and "display:none" in value.replace(" ", ""):
            bad = True
    return False, bad, called, tag + names


class _Mark(NamedTuple):
    """An article, a main or an element that may be furniture, with the mark around it (0: none)."""

    around: int
    main: str          # article or main if its text may be content
    suspect: bool
    aside: bool
    by_tag: bool


def _judge(nodes: list[tuple[Node, int]], marks: list[_Mark]) -> list[Node]:
    """The nodes without those in furniture; those in elements that name themselves so carry its number.

    Marks form a tree, a mark's number is greater than that of the one around it: sums over what a mark
    holds run from the last to the first, sums over what is around it from the first to the last.
    """
    n = len(marks)
    held = [0] * n                                 # running text: characters outside links
    total = 0
    for x, mark in nodes:
        size = 0 if x.place.link else len(x.text.strip())
        total += size
        held[mark] += size
    for k in range(n - 1, 0, -1):
        held[marks[k].around] += held[k]
    longest = max((held[k] for k in range(1, n) if marks[k].main == "article"), default=0)
    weighty = max(longest, WEIGHTY * total, 1)
    holds = [False] * n                            # the page's main, or its weightiest article
    for k in range(n - 1, 0, -1):
        m = marks[k]
        own = bool(m.main and held[k] and (m.main == "main" or held[k] >= weighty))
        holds[m.around] |= holds[k] | own
    left = [marks[k].suspect and not holds[k] for k in range(n)]
    # size speaks where no article or main with text lies elsewhere, but for those in furniture
    lost, above = [False] * n, [0] * n             # in furniture; free mains around
    free = [False] * n
    for k in range(1, n):
        around = marks[k].around
        lost[k] = lost[around] or (left[around] and marks[around].by_tag)
        free[k] = bool(marks[k].main and held[k] and not lost[k])
        above[k] = above[around] + free[around]
    below = [0] * n
    for k in range(n - 1, 0, -1):
        below[marks[k].around] += below[k] + free[k]
    bad, by_tag = [0] * n, [False] * n             # outermost furniture at or around a mark; any by its tag
    for k in range(1, n):
        m = marks[k]
        mine = left[k] and (m.aside or 2 * held[k] <= total or below[k] + above[k] < below[0])
        bad[k] = bad[m.around] or (k if mine else 0)
        by_tag[k] = by_tag[m.around] or (mine and m.by_tag)
    return [x._replace(named=bad[mark]) if bad[mark] else x for x, mark in nodes if not by_tag[mark]]


def text_nodes(page: str) -> list[Node]:
    """Each text node that may be content, in the order of the page.

    Time and memory grow with the page's length on any markup: paths are numbers of (path around, name), end tags
    without an open element are known by a count, and an open paragraph is found by the nearest block.
    """
    out: list[tuple[Node, int]] = []
    marks = [_Mark(0, "", False, False, False)]
    paths: dict[tuple[int, str], int] = {}
    root = _Open("", 0, 0, False, 0, Place(), 0, -1)
    stack: list[_Open] = []
    count: Counter[str] = Counter()
    block, at, n, number = 0, 0, len(page), 0

    def put(s: str) -> None:
        of = stack[-1] if stack else root
        if not of.furniture:
            out.append((Node(of.path, of.holder, block, s, of.place), of.mark))

    def text(a: int, b: int) -> None:
        if b > a:
            put(html.unescape(page[a:b]))

    def close(i: int) -> None:
        for x in stack[i:]:
            count[x.tag] -= 1
        del stack[i:]

    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            text(at, n)
            return _judge(out, marks) if any(x.suspect for x in marks) else [x for x, _ in out]
        text(at, m.start())
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attrs = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag in BLOCKS:
            block += 1
        if closing:
            if count[tag] > 0:
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                close(i)
            continue
        if tag == "br":
            put(" ")
            continue
        if tag in RAW:
            end = _CLOSERS[tag].search(page, at)
            at = end.end() if end else n
            continue
        if tag in VOID or attrs.endswith("/") and tag in ("svg", "path"):
            continue
        if tag in BLOCKS and stack and stack[-1].nearest >= 0:
            # an open paragraph, and what is open inside it, ends here
            i = stack[-1].nearest
            t = stack[i].tag
            if t == "p" or (t == tag and tag in ENDS_ITSELF):
                close(i)
        of = stack[-1] if stack else root
        never, bad, called, name = _furniture(tag, attrs, of.place.article >= 0)
        number += 1
        path = paths.setdefault((of.path, name), len(paths) + 1)
        mark = of.mark
        if bad or called or tag in MAIN:
            marks.append(_Mark(of.mark, tag if tag in MAIN and not of.furniture else "", bad or called, tag in ASIDE, bad))
            mark = len(marks) - 1
        count[tag] += 1
        stack.append(_Open(tag, path, of.path if tag in BLOCKS else of.holder, never or of.furniture, number,
                           of.place.inside(tag, number, (of.tag, of.number)), mark,
                           len(stack) if tag in BLOCKS else of.nearest))


def keep_nodes(nodes: list[Node]) -> np.ndarray:
    """Which text nodes are content, by fused and smoothed tag-path ratios of their containers."""
    n = len(nodes)
    length = np.array([len(x.text.strip()) for x in nodes], np.float64)
    marks = np.array([len(_PUNCTUATION.findall(x.text)) for x in nodes], np.float64)
    real = length > 0
    if not real.any():
        return np.zeros(n, bool)

    def ratios(names: list[int]) -> tuple[np.ndarray, np.ndarray]:
        _, of = np.unique(names, return_inverse=True)
        count = np.maximum(np.bincount(of, real), 1)
        return (np.bincount(of, length) / count)[of], (np.bincount(of, marks) / count)[of]

    long_, pointed = ratios([x.path for x in nodes])
    # the block around a path's block: inline tags and the last block are cut off
    holder = [x.holder for x in nodes]
    box_long, box_pointed = ratios(holder)
    value = long_ * (1 + np.log1p(pointed)) + box_long * (1 + np.log1p(box_pointed))
    where = np.flatnonzero(real)
    v = value[where]
    smooth, weight = np.zeros(len(v)), np.zeros(len(v))
    for k in range(-REACH, REACH + 1):
        if abs(k) >= len(v):
            continue
        w = np.exp(-k * k / (2 * WIDTH * WIDTH))
        a, b = max(0, -k), min(len(v), len(v) - k)
        smooth[a:b] += w * v[a + k:b + k]
        weight[a:b] += w
    smooth /= weight
    named = np.array([x.named for x in nodes])
    fused = np.sqrt(v * smooth) * np.where(named[where], PRIOR, 1)
    # running text: the mean over characters, not nodes, of the fused ratio
    plain = np.where(named[where], 0, length[where])
    plain = plain if plain.any() else length[where]
    typical = float((fused * plain).sum() / plain.sum())
    least = THRESHOLD * typical
    good = np.zeros(n, bool)
    good[where] = fused >= least

    # containers: the mean over characters of their texts' fused ratios
    article = np.array([x.place.article for x in nodes])
    box = np.array([x.place.box for x in nodes])
    # marks and elements are numbered apart: negative for marks
    _, of = np.unique(np.where(named, -named, np.where(article >= 0, article, box)), return_inverse=True)
    chars = np.bincount(of, length)
    chosen = (np.bincount(of[where], fused * length[where], len(chars)) >= least * chars)[of]
    # outside articles, lists, tables and blocks that are mostly links are not taken with their container
    piece = [x.place.chunk if x.place.chunk >= 0 else -1 - x.block for x in nodes]
    _, part = np.unique(piece, return_inverse=True)
    linked = np.bincount(part, length * [x.place.link for x in nodes])
    links = (2 * linked > np.bincount(part, length))[part] & (article < 0) & (named == 0)
    good = np.where(named, real & chosen, good | (real & chosen & ~links))
    # ... unless kept text of the container comes before and after them
    first, last = np.full(box.max() + 1, n), np.full(box.max() + 1, -1)
    kept = np.flatnonzero(good & real)
    np.minimum.at(first, box[kept], kept)
    np.maximum.at(last, box[kept], kept)
    i = np.arange(n)
    good |= real & links & (first[box] < i) & (i < last[box])
    return good | ~real  # blanks between kept nodes are white space of their block


def main_text(page: str | None) -> str:
    """Blocks of the article, white space within each as one blank, joined by an empty line."""
    nodes = text_nodes(page or "")
    size = [len(x.text.strip()) * (PRIOR if x.named else 1) for x in nodes]
    if 2 * sum(n for n, x in zip(size, nodes) if x.place.article >= 0) >= sum(size):
        nodes = [x for x in nodes if x.place.article >= 0]
    if not nodes:
        return ""
    blocks: dict[int, list[str]] = {}
    for x, good in zip(nodes, keep_nodes(nodes).tolist()):
        if good:
            blocks.setdefault(x.block, []).append(x.text)
    texts = (_SPACE.sub(" ", "".join(parts)).strip() for parts in blocks.values())
    return "\n\n".join(t for t in texts if t)


def extract(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, text, n_chars)."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")) \
        .mapInArrow(work, "page_id long, url string, text string, n_chars long")
