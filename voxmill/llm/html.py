"""Main text of web pages: flat text blocks classified by a small decision tree."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import bound_batches, table
from .trees import Forest, fit_tree

# Element names of HTML by role. What follows the first kind is text until its end tag, or to the end
# of the page; the second kind goes where it is closed before a block begins or ends, and left open it is a tag like others.
RAW = "script style iframe textarea title".split()
INLINE_UNSEEN = "button noscript select svg template".split()
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article aside body details dialog div fieldset figure footer form header li main menu nav ol section table td ul blockquote".split())
SIDE = frozenset("aside dialog fieldset footer form header menu nav".split())
# Words in class, id or role that mark what is not the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus"
    " footer form header login masthead menu nav navbar navigation newsletter notice notices pagination popup promo promoted related replies"
    " respond reviews search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
TALK = frozenset("comment comments disqus replies respond reviews".split())
# A token of several words marks where only these words and numbers follow a mark, as in site-footer or comments-area,
WITHIN = frozenset(
    "area articles author bar block body bottom box button buttons container content footer group holder inner item items left links list lists meta"
    " nav outer panel posts primary reply right secondary section slot stories thread title top unit wrap wrapper".split()
)
# unless it tells of a state of the page, or names the head of the article; these marks count only alone.
STATES = frozenset("allow allowed can closed disabled enabled free has have hide is js no not off on open opened show with without".split())
OWN = frozenset("article content entry page post story title".split())
ALONE = frozenset("form widget".split())

_BLOCK_TAG = r"/?(?:" + "|".join(sorted(BLOCK - {"details", "summary"})) + r")\b"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<part>" + "|".join(INLINE_UNSEEN) + r")\b[^>]*>[^<]*(?:<(?!" + _BLOCK_TAG + r")[^<]*)*?</(?P=part)\s*>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][\w:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*)>|<[a-zA-Z/!?][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
_MAIN = re.compile(r"(?<![\w-])role\s*=\s*[\"']?main\b", re.IGNORECASE)
_LABEL = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_SIZE = re.compile(r"\d+x\d+")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

#: An article with so many times fewer unlinked words than the largest is a teaser.
TEASER = 5

FEATURES = "words_before links_before words links words_after links_after in_article side page_has_article heading".split()

# Blocks labelled by hand. Words and link density (0 to 1) of the block before, the block
# and the block after; whether it lies in an article or main element, in a side part (by element or
# mark), whether the page has an article at all, whether it is a heading; label 1: main text.
LABELLED = (
    # before      block      after     art side has head  label
    (0, 0.0,     1, 1.0,     1, 1.0,   0, 1, 1, 0,   0),  # menu entry
    (1, 1.0,     1, 1.0,     2, 1.0,   0, 1, 1, 0,   0),
    (2, 1.0,     3, 1.0,     8, 0.0,   0, 1, 1, 0,   0),
    (1, 1.0,     8, 0.0,     6, 0.0,   0, 1, 1, 0,   0),  # advert
    (1, 1.0,    25, 0.0,    10, 0.0,   0, 1, 1, 0,   0),
    (90, 0.0,    7, 0.0,     0, 0.0,   0, 1, 1, 0,   0),  # footer
    (60, 0.0,   14, 0.3,     0, 0.0,   0, 1, 1, 0,   0),
    (40, 0.0,   30, 0.0,    20, 0.0,   1, 1, 1, 0,   0),  # notice within the article
    (80, 0.0,   60, 0.0,    45, 0.0,   1, 1, 1, 0,   0),  # reader comment
    (45, 0.0,    2, 0.0,    60, 0.0,   1, 1, 1, 1,   0),
    (1, 1.0,     5, 0.0,    40, 0.0,   0, 1, 1, 1,   0),
    (8, 0.0,     6, 0.0,    30, 0.0,   1, 0, 1, 1,   1),  # headline
    (0, 0.0,     2, 0.0,    80, 0.0,   1, 0, 1, 1,   1),
    (5, 0.0,     4, 1.0,    70, 0.0,   1, 0, 1, 1,   1),  # linked headline
    (6, 0.0,    80, 0.0,    40, 0.0,   1, 0, 1, 0,   1),  # paragraphs
    (80, 0.0,    1, 0.0,     1, 0.0,   1, 0, 1, 0,   1),
    (1, 0.0,     1, 0.0,    50, 0.0,   1, 0, 1, 0,   1),
    (50, 0.0,    3, 0.0,     7, 0.0,   1, 0, 1, 0,   1),
    (30, 0.1,  120, 0.05,   60, 0.0,   1, 0, 1, 0,   1),
    (60, 0.0,   40, 0.3,    50, 0.0,   1, 0, 1, 0,   1),
    (20, 0.0,   12, 0.5,    50, 0.0,   1, 0, 1, 0,   1),
    (50, 0.0,    9, 0.0,     7, 0.0,   1, 0, 1, 0,   1),
    (12, 0.0,   11, 0.0,    13, 0.0,   1, 0, 1, 0,   1),  # list entry
    (7, 0.0,     6, 0.0,     5, 0.0,   1, 0, 1, 1,   1),  # headline after an advert, short page
    (11, 0.0,    6, 0.0,     0, 0.0,   1, 0, 1, 1,   1),
    (25, 0.0,    9, 0.0,     9, 0.0,   1, 0, 1, 1,   1),
    (1, 1.0,     4, 0.0,     4, 0.0,   1, 0, 1, 1,   1),
    (6, 0.0,     6, 0.0,     7, 0.0,   1, 0, 1, 0,   1),  # short pages
    (6, 0.0,     5, 0.0,     0, 0.0,   1, 0, 1, 0,   1),
    (9, 0.0,    30, 0.0,     8, 0.0,   1, 0, 1, 0,   1),
    (1, 0.0,     1, 0.0,     7, 0.0,   1, 0, 1, 0,   1),
    (3, 0.0,     2, 0.0,     2, 0.0,   1, 0, 1, 0,   1),
    (80, 0.0,    2, 0.0,     6, 0.0,   1, 0, 1, 0,   1),
    (70, 0.0,    9, 0.0,    14, 0.3,   1, 0, 1, 0,   1),
    (100, 0.0, 150, 0.0,     1, 1.0,   1, 0, 1, 0,   1),
    (2, 1.0,    18, 0.0,     2, 1.0,   1, 0, 1, 0,   1),
    (4, 0.5,     6, 0.4,     4, 0.5,   1, 0, 1, 0,   1),
    (40, 0.0,    3, 1.0,     3, 1.0,   1, 0, 1, 0,   0),  # links to other pages
    (3, 1.0,     4, 1.0,     3, 1.0,   1, 0, 1, 0,   0),
    (4, 1.0,     6, 1.0,     0, 0.0,   1, 0, 1, 0,   0),
    (3, 1.0,    12, 1.0,     8, 1.0,   1, 0, 1, 0,   0),
    (1, 1.0,     6, 0.0,    40, 0.0,   0, 0, 1, 0,   0),  # outside the article of a page that has one
    (1, 1.0,    30, 0.0,     6, 0.0,   0, 0, 1, 0,   0),
    (70, 0.0,   20, 0.0,     5, 0.0,   0, 0, 1, 0,   0),
    (70, 0.0,    4, 0.0,     2, 1.0,   0, 0, 1, 1,   0),
    (2, 1.0,     2, 1.0,     2, 1.0,   0, 0, 1, 0,   0),
    (75, 0.0,   12, 0.0,     3, 0.0,   0, 0, 1, 0,   0),
    (0, 0.0,    40, 0.0,    60, 0.0,   0, 0, 1, 0,   0),
    (5, 0.0,     9, 0.0,    30, 0.0,   0, 0, 1, 1,   0),
    (12, 0.0,   80, 0.0,    20, 0.0,   0, 0, 1, 0,   0),
    (90, 0.0,    5, 0.0,     0, 0.0,   0, 0, 1, 0,   0),
    (20, 0.0,    8, 0.2,    70, 0.0,   0, 0, 1, 0,   0),
    (70, 0.0,   90, 0.0,    80, 0.0,   0, 1, 1, 0,   0),
    (70, 0.0,   50, 0.0,    70, 0.0,   0, 1, 0, 0,   0),
    (50, 0.0,    6, 0.0,    70, 0.0,   0, 1, 0, 1,   0),
    (20, 0.0,    6, 0.0,    30, 0.0,   1, 1, 1, 1,   0),
    (1, 1.0,     1, 1.0,     1, 1.0,   0, 0, 0, 0,   0),  # pages without an article element
    (1, 1.0,     3, 1.0,    60, 0.0,   0, 0, 0, 0,   0),
    (90, 0.0,   10, 0.9,     0, 0.0,   0, 0, 0, 0,   0),
    (60, 0.0,    2, 0.0,     0, 0.0,   0, 0, 0, 0,   0),
    (3, 1.0,     3, 0.0,     2, 1.0,   0, 0, 0, 0,   0),
    (60, 0.0,   10, 0.0,     0, 0.0,   0, 1, 0, 0,   0),
    (1, 1.0,    40, 0.0,    10, 0.0,   0, 1, 0, 0,   0),
    (2, 1.0,     6, 0.0,    50, 0.0,   0, 0, 0, 1,   1),
    (40, 0.0,    3, 0.0,    80, 0.0,   0, 0, 0, 1,   1),
    (1, 1.0,    50, 0.0,    70, 0.0,   0, 0, 0, 0,   1),
    (70, 0.0,   15, 0.1,    40, 0.0,   0, 0, 0, 0,   1),
    (0, 0.0,    25, 0.0,     0, 0.0,   0, 0, 0, 0,   1),
    (60, 0.0,   12, 0.0,    12, 0.0,   0, 0, 0, 0,   1),
    (60, 0.0,    5, 0.0,    60, 0.0,   0, 0, 0, 0,   1),
    (50, 0.0,   80, 0.2,     3, 1.0,   0, 0, 0, 0,   1),
)


def block_tree() -> Forest:
    data = np.array(LABELLED, float)
    return fit_tree(data[:, :-1], data[:, -1], depth=8)


@lru_cache(1 << 14)
def marked(attrs: str) -> tuple[frozenset, frozenset]:
    """Marks in class, id and role of a start tag: those that are whole tokens (but for numbers), and those within tokens of several words."""
    whole, within = set(), set()
    for token in " ".join(v for found in _LABEL.findall(attrs) for v in found).split():
        parts = [p.lower() for p in _PART.findall(_SIZE.sub("", token))]
        if token.lower() in MARKS or (len(parts) == 1 and parts[0] in MARKS):
            whole.add(token.lower() if token.lower() in MARKS else parts[0])
        elif not STATES & set(parts):
            last = max((k for k, p in enumerate(parts) if p not in WITHIN or p in MARKS), default=0)
            mark = parts[last] if parts else ""
            if mark in MARKS - ALONE and not (mark == "header" and OWN & set(parts)):
                within.add(mark)
    return frozenset(whole), frozenset(within)


@dataclass
class Block:
    text: str
    words: int
    links: float
    article: bool
    side: bool
    heading: bool
    part: int = 0  # the outermost article or main element, from 1
    items: int = 0  # the innermost list, from 1


def flat_blocks(page: str) -> list[Block]:
    """The page's non-empty text blocks in order.

    Comments, scripts, styles and titles hold no text. End tags without a start are passed
    over, and an element left open ends with the one around it. What lies outside an article
    doesn't mark what is inside, except reader comments; nothing marks the body or a main element.
    A mark within a token (right-sidebar) may tell of the page's layout: it doesn't hold for an
    element with most of the page's unlinked words, and neither do a form around them nor a mark on their
    article. Of several articles those with less than a fifth of the largest one's words are teasers.
    """
    blocks: list[Block] = []
    doubts: list[tuple[int, ...]] = []
    elements, articles, lists = 0, 0, 0
    parts: list[str] = []
    linked: list[str] = []
    # Name, in article, side, talk, elements perhaps side, outermost article, innermost list.
    stack: list[tuple[str, bool, bool, bool, tuple[int, ...], int, int]] = [("", False, False, False, (), 0, 0)]
    anchor, heading, at = False, False, 0

    def close() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            words = len(text.split(" "))
            _, article, side, _, doubt, part, items = stack[-1]
            share = min(1.0, len(html.unescape("".join(linked)).split()) / words)
            blocks.append(Block(text, words, share, article, side, heading, part, items))
            doubts.append(doubt)
        parts.clear()
        linked.clear()

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
            if anchor:
                linked.append(page[at : m.start()])
        at = m.end()
        if not m["name"]:
            continue
        name, end = m["name"].lower(), bool(m["end"])
        if name == "a":
            anchor = not end
            linked.append(" ")
        elif name in ("br", "wbr", "img", "input"):
            parts.append(" " if name == "br" else "")
        if name not in BLOCK:
            continue
        close()
        anchor = False
        heading = not end and len(name) == 2 and name[0] == "h" and name[1].isdigit()
        if name not in CONTAINER:
            continue
        if end:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
        else:
            _, article, side, talk, doubt, part, items = stack[-1]
            main = name == "main" or bool(m["attrs"] and _MAIN.search(m["attrs"]))
            whole, within = marked(m["attrs"]) if m["attrs"] and name != "body" and not main else (frozenset(), frozenset())
            if article:
                whole, within = whole - {"header"}, within - {"header"}
            talk = not main and (talk or bool((whole | within) & TALK))
            unsure = bool(within)
            if name == "article" or main:
                if not article:
                    articles += 1
                    part = articles
                article, side, doubt, unsure = True, talk, (), unsure or bool(whole)
            else:
                side = side or bool(whole) or talk or (name in SIDE - {"form"} and not (name == "header" and article))
                unsure = unsure or name == "form"
            if unsure:
                elements += 1
                doubt = (*doubt, elements)
            if name in ("ul", "ol"):
                lists += 1
                items = lists
            stack.append((name, article, side, talk, doubt, part, items))
    parts.append(page[at:])
    close()
    if elements:
        held, total = [0.0] * (elements + 1), 0.0
        for b, doubt in zip(blocks, doubts, strict=True):
            own = 0.0 if b.side else b.words * (1 - b.links)
            total += own
            for k in doubt:
                held[k] += own
        for b, doubt in zip(blocks, doubts, strict=True):
            b.side = b.side or any(held[k] <= total / 2 for k in doubt)
    if articles > 1:
        own = np.zeros(articles + 1)
        for b in blocks:
            own[b.part] += 0.0 if b.side or not b.part else b.words * (1 - b.links)
        for b in blocks:
            b.side = b.side or bool(b.part and own[b.part] * TEASER < own.max())
    return blocks


def whole_lists(blocks: list[Block], kept: np.ndarray) -> np.ndarray:
    """Items of a list of which most unlinked words are kept stay with them, but for side matter."""
    held: dict[int, list[float]] = {}
    for b, k in zip(blocks, kept, strict=True):
        if b.items:
            total = held.setdefault(b.items, [0.0, 0.0])
            total[0] += b.words * (1 - b.links)
            total[1] += b.words * (1 - b.links) * k
    return np.array([bool(k) or (b.items > 0 and not b.side and 2 * held[b.items][1] > held[b.items][0]) for b, k in zip(blocks, kept, strict=True)], bool)


def block_features(blocks: list[Block]) -> np.ndarray:
    n = len(blocks)
    own = np.array([(b.words, b.links) for b in blocks], float).reshape(n, 2)
    pad = np.zeros((1, 2))
    has = any(b.article and not b.side for b in blocks)  # comments may be article elements
    flags = np.array([(b.article, b.side, has, b.heading) for b in blocks], float).reshape(n, 4)
    return np.hstack([np.vstack([pad, own[:-1]]), own, np.vstack([own[1:], pad]), flags]) if n else np.zeros((0, len(FEATURES)))


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of `pages`, from its whole html.

    Kept blocks are joined by an empty line. Null, empty or text-free html gives an empty
    text; bare text without markup is one block; repeated rows stay.
    """
    bound_batches(pages.sparkSession)
    tree = block_tree()

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [flat_blocks(h) if isinstance(h, str) else [] for h in b["html"]]
            kept = tree.margin(np.concatenate([np.zeros((0, len(FEATURES))), *map(block_features, found)])) >= 0.5
            out, at = [], 0
            for blocks in found:
                own = whole_lists(blocks, kept[at : at + len(blocks)])
                out.append("\n\n".join(x.text for x, k in zip(blocks, own, strict=True) if k))
                at += len(blocks)
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": out, "n_chars": [len(t) for t in out]})

    return pages.select("page_id", "url", "html").mapInPandas(texts, "page_id long, url string, text string, n_chars long")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
