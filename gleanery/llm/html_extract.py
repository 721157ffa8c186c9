"""The main text of HTML pages.

A page is read as a flat sequence of text blocks. Each block is described by its number of
words and the density of its links, the same of its two neighbours, and what kind of
elements it stands in. A decision tree says which blocks are main text. The tree is trained
on a small labelled table (html_sample) when the job is planned, and goes along with the
tasks.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Elements whose content is no text of the page. All of them need their end tags; that of head is optional, so
# head is not one of them, and what it may hold is skipped one by one.
SILENT = frozenset(
    "script style noscript template svg math iframe object embed applet canvas audio video map select "
    "textarea button datalist title input".split()
)
# Elements that stand within a line; all others end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby "
    "s samp small span strike strong sub sup time tt u var wbr picture source".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER_TAGS = frozenset("nav footer aside header menu dialog".split())
MAIN_TAGS = frozenset(("article", "main"))
BOILER_HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notices alert popup modal overlay nav navbar navigation menu menus "
    "breadcrumb breadcrumbs pagination pager toolbar topbar masthead header footer foot copyright legal "
    "sidebar side aside complementary widget widgets related recommended recommendations trending popular "
    "comment comments commentlist disqus respond reply replies share sharing social follow newsletter subscribe "
    "subscription signup login signin search form contentinfo skip teaser outbrain taboola".split()
)
# Nothing inside an element with one of these is main text. The other words of BOILER_HINTS are also said of
# wrappers of whole pages (a layout with a sidebar, a page of search results).
FIRM_HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies "
    "consent gdpr breadcrumb breadcrumbs pagination pager copyright related recommended recommendations trending "
    "popular comment comments commentlist disqus respond reply replies teaser outbrain taboola".split()
)
# What follows one of these in a class says what is elsewhere: has-sidebar, layout--no-comments.
MODIFIERS = frozenset("has with no not without".split())
# A header of one of these is the head of the article.
HEADED = frozenset("article post entry story".split())
# On an element that says it is the main part, only these count.
TEASER_HINTS = frozenset("comment comments reply teaser related promo ad ads sponsored".split())
MAIN_HINTS = frozenset("content article main post entry story articlebody maincontent bodytext body text".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[A-Za-z]+|[^\x00-\x7f]+")
_HEADING = re.compile(r"h[1-6]\Z")
FEATURES = (
    "words link_density words_before link_density_before words_after link_density_after "
    "in_boiler in_main any_boiler any_main page_has_main heading"
).split()


def _zone(tag: str, attributes: str) -> tuple[int, bool]:
    """-1 for an element of boilerplate, 1 for one of main text, 0 for neither; and if it is so only by a
    word that is also said of wrappers."""
    hints, main = set(), False
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            for name in (m[2] or m[3] or m[4] or "").split():
                words = [w.lower() for w in _WORDS.findall(name)]
                words = words[: next((i for i, w in enumerate(words) if w in MODIFIERS), None)]
                if "header" in words[1:] and words[0] in HEADED:
                    words = []
                hints.update(words)
                main = main or not MAIN_HINTS.isdisjoint(words) and BOILER_HINTS.isdisjoint(words)
    if tag in MAIN_TAGS:
        return (-1 if hints & TEASER_HINTS else 1), False
    if tag in BOILER_TAGS:
        return -1, False
    if tag in ("html", "head", "body"):
        return 0, False
    if hints & FIRM_HINTS:
        return -1, False
    if hints & BOILER_HINTS:
        # Another of its names may say that it is main text: what is inside decides.
        return (0, False) if main else (-1, True)
    if tag == "form":
        return -1, False
    return (1 if main else 0), False


def blocks(page: str) -> tuple[list[str], list[list[float]]]:
    """Texts of the blocks in page order, and their features.

    A wrapper's hint is outweighed by a main element in it, and by articles and contents in it that
    hold more words than all that stands outside of boilerplate.
    """
    texts, rows, freed = [], [], []
    parts, n_words, n_linked, links, heading = [], 0, 0, 0, False
    # Open elements that are not inline: (tag, zone, nearest zone, boiler above, main above, in a wrapper's main
    # part). Boiler above: 1 for a wrapper alone, 2 for any other. In a wrapper's main part: 2 in a main element.
    stack = [("", 0, 0, 0, 0, 0)]
    opened: Counter[str] = Counter()
    any_main_page = False

    def close():
        nonlocal parts, n_words, n_linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                words = max(1, text.count(" ") + 1)
                top = stack[-1]
                texts.append(text)
                rows.append([words, min(1.0, n_linked / words), top[2] < 0, top[2] > 0, int(top[3] > 0), top[4], heading])
                freed.append(top[5] if top[3] == 1 else 0)
            parts, n_linked = [], 0

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            text = html.unescape(page[at:stop])
            parts.append(text)
            if links:
                n_linked += len(text.split())
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag, closing = tag.lower(), bool(m[1])
        if tag in SILENT:
            if not closing and not m[3].endswith("/") and tag not in VOID:
                at = _end_of(page, tag, at)
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            elif tag == "br":
                parts.append(" ")
            continue
        close()
        links = 0
        if closing:
            # An end tag closes what was opened since; without its start tag it closes nothing.
            while opened[tag]:
                last = stack.pop()[0]
                opened[last] -= 1
                if last == tag:
                    break
            if _HEADING.match(tag):
                heading = False
        else:
            heading = bool(_HEADING.match(tag))
            if tag in VOID or tag == "p" or m[3].endswith("/"):
                continue
            zone, wrapper = _zone(tag, m[3])
            _, _, near, boiler, main, inner = stack[-1]
            if zone < 0 and tag == "header" and near > 0:
                zone = 0  # the head of an article is part of it
            any_main_page = any_main_page or zone > 0
            # A form may go around a whole page, so it does not outweigh what is inside.
            if zone < 0 and tag != "form":
                boiler = max(boiler, 1 if wrapper and not inner else 2)
            if zone > 0 and boiler == 1:
                inner = max(inner, 2 if tag == "main" else 1)
            stack.append((tag, zone, zone or near, boiler, main or int(zone > 0), inner))
            opened[tag] += 1
    close()
    outside = sum(r[0] for r in rows if not r[2] and not r[4])
    enough = 1 if sum(r[0] for r, f in zip(rows, freed) if f and not r[2]) > outside else 2
    for r, f in zip(rows, freed):
        if f >= enough:
            r[4] = 0
    return texts, _with_neighbours(rows, any_main_page)


def _end_of(page: str, tag: str, at: int) -> int:
    """Where a silent element ends; where the page ends if it is not closed."""
    m = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
    return m.end() if m else len(page)


def _with_neighbours(rows, has_main):
    none = [0, 0.0]
    out = []
    for i, r in enumerate(rows):
        before = rows[i - 1] if i else none
        after = rows[i + 1] if i + 1 < len(rows) else none
        out.append([*map(float, (*r[:2], *before[:2], *after[:2], *r[2:6], has_main, r[6]))])
    return out


def grow_tree(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 3):
    """A classification tree: (feature, threshold, left, right), or 0 or 1 at a leaf. Splits by
    Gini impurity into parts of `least` rows or more; ties go to the first feature and the smallest threshold."""
    share = y.mean()
    if depth == 0 or share in (0.0, 1.0):
        return int(share >= 0.5)
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        values, labels = x[order, f], y[order]
        left = np.cumsum(labels)[:-1]
        n = np.arange(1, len(y))
        right = labels.sum() - left
        cost = 2 * left * (1 - left / n) + 2 * right * (1 - right / (len(y) - n))
        cost = np.where((values[1:] > values[:-1]) & (n >= least) & (len(y) - n >= least), cost, np.inf)
        if len(cost) and np.isfinite(cost).any():
            i = int(np.argmin(cost))
            if best is None or cost[i] < best[0] - 1e-12:
                best = (cost[i], f, (values[i] + values[i + 1]) / 2)
    if best is None:
        return int(share >= 0.5)
    _, f, t = best
    low = x[:, f] <= t
    return (f, float(t), grow_tree(x[low], y[low], depth - 1, least), grow_tree(x[~low], y[~low], depth - 1, least))


def train(pages=None):
    """The tree for a labelled table: pairs of a page and the texts of its main blocks."""
    if pages is None:
        from .html_sample import PAGES as pages
    x, y = [], []
    for page, wanted in pages:
        texts, rows = blocks(page)
        for text, row in zip(texts, rows):
            x.append(row)
            # The same text may stand in both parts of a page: a boilerplate element decides.
            y.append(text in wanted and not (row[6] or row[8]))
    return grow_tree(np.array(x), np.array(y, float))


def main_text(page: str, tree) -> str:
    texts, rows = blocks(page)
    kept = []
    for text, row in zip(texts, rows):
        node = tree
        while not isinstance(node, int):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        if node:
            kept.append(text)
    return "\n".join(kept)


def extract(pages: DataFrame, tree=None) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of `pages` (html null: empty text).

    `text` is the main text: blocks in page order, one line each, character references decoded,
    white space turned into single blanks; empty if there is none. `n_chars` counts code points. Null ids
    and URLs stay null, repeated rows are extracted each, and other columns are not looked
    at. Each page is one row's work; nothing is shuffled.
    """
    tree = train() if tree is None else tree

    def task(batches):
        for batch in batches:
            texts = [main_text(h or "", tree) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        task, "page_id long, url string, text string, n_chars long"
    )
