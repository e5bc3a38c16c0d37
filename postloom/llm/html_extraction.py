"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut at block-level markup into flat blocks; scripts, styles and other
unseen elements fall away first. A block is described by its words and link
density, those of the blocks before and after it, whether it is a heading, and what
the markup hints at: whether it stands inside the article, whether the page marks an
article at all, and a cue of being something else. The cue is strong (2) where a tag,
a role or a plain name says so and weak (1) where a name that may mean either stands
in the article or beside a name of the article. A small decision tree, trained on the
labelled table below, keeps or drops each block; on weak cues and on pages that mark
no article it is words, links and neighbours that decide.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from .shared import map_batches, read

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "inside", "cue", "unmarked_page", "heading")

#: Labelled blocks: the features in order, then whether the block is main text.
LABELLED = (
    # Paragraphs and headings of an article, long and short.
    (60, 0.0, 12, 0.0, 55, 0.0, 1, 0, 0, 0, 1),
    (120, 0.02, 60, 0.0, 80, 0.0, 1, 0, 0, 0, 1),
    (8, 0.0, 6, 0.0, 70, 0.0, 1, 0, 0, 0, 1),
    (1, 0.0, 40, 0.0, 1, 0.0, 1, 0, 0, 0, 1),
    (1, 0.0, 1, 0.0, 30, 0.0, 1, 0, 0, 0, 1),
    (3, 0.0, 0, 0.0, 0, 0.0, 1, 0, 0, 0, 1),
    (25, 0.2, 50, 0.0, 12, 0.0, 1, 0, 0, 0, 1),
    (14, 0.5, 40, 0.0, 60, 0.0, 1, 0, 0, 0, 1),
    (5, 1.0, 90, 0.0, 45, 0.0, 1, 0, 0, 0, 1),
    (2, 1.0, 30, 0.0, 9, 1.0, 1, 0, 0, 0, 1),
    (300, 0.0, 10, 0.0, 8, 0.0, 1, 0, 0, 0, 1),
    (18, 0.0, 7, 0.0, 4, 0.0, 1, 0, 0, 0, 1),
    (9, 0.0, 0, 0.0, 40, 0.0, 1, 0, 0, 1, 1),
    (4, 0.0, 60, 0.0, 50, 0.0, 1, 0, 0, 1, 1),
    # Menus, headers, footers, side columns, adverts, notices, forms and reader comments that are marked as such.
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 2, 0, 0, 0),
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 2, 0, 0, 0),
    (2, 1.0, 1, 1.0, 9, 0.0, 0, 2, 0, 0, 0),
    (9, 0.0, 2, 1.0, 12, 0.0, 0, 2, 0, 0, 0),
    (14, 0.0, 1, 1.0, 11, 0.0, 0, 2, 0, 0, 0),
    (22, 0.0, 80, 0.0, 0, 0.0, 0, 2, 0, 0, 0),
    (40, 0.0, 50, 0.0, 35, 0.0, 0, 2, 0, 0, 0),
    (85, 0.0, 20, 0.0, 60, 0.0, 0, 2, 0, 0, 0),
    (12, 0.6, 60, 0.0, 3, 1.0, 0, 2, 0, 0, 0),
    (30, 0.0, 70, 0.0, 65, 0.0, 1, 2, 0, 0, 0),
    (6, 0.0, 44, 0.0, 90, 0.0, 1, 2, 0, 0, 0),
    (55, 0.1, 61, 0.0, 12, 0.0, 1, 2, 0, 0, 0),
    (3, 1.0, 75, 0.0, 0, 0.0, 1, 2, 0, 0, 0),
    (28, 0.0, 4, 0.0, 3, 0.0, 0, 2, 1, 0, 0),
    (2, 1.0, 3, 1.0, 2, 1.0, 0, 2, 1, 0, 0),
    # Blocks beside an article, without any mark.
    (4, 0.0, 1, 1.0, 7, 0.0, 0, 0, 0, 0, 0),
    (15, 0.0, 0, 0.0, 12, 0.0, 0, 0, 0, 0, 0),
    (45, 0.0, 120, 0.0, 6, 0.0, 0, 0, 0, 0, 0),
    (3, 1.0, 30, 0.0, 3, 1.0, 0, 0, 0, 0, 0),
    # Pages that mark no article: text by its words, links and neighbours.
    (70, 0.0, 6, 0.0, 80, 0.0, 0, 0, 1, 0, 1),
    (40, 0.1, 50, 0.0, 45, 0.0, 0, 0, 1, 0, 1),
    (26, 0.0, 9, 0.0, 33, 0.0, 0, 0, 1, 0, 1),
    (30, 0.05, 44, 0.0, 3, 0.0, 0, 0, 1, 0, 1),
    (7, 0.0, 60, 0.0, 52, 0.0, 0, 0, 1, 0, 1),
    (9, 0.0, 4, 0.0, 48, 0.0, 0, 0, 1, 0, 1),
    (12, 0.0, 35, 0.0, 20, 0.0, 0, 0, 1, 0, 1),
    (60, 0.0, 0, 0.0, 1, 1.0, 0, 0, 1, 0, 1),
    (80, 0.0, 2, 1.0, 3, 1.0, 0, 0, 1, 0, 1),
    (45, 0.0, 1, 1.0, 2, 1.0, 0, 0, 1, 0, 1),
    (35, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1, 0, 1),
    (150, 0.02, 3, 0.0, 2, 0.0, 0, 0, 1, 0, 1),
    (1, 1.0, 60, 0.0, 45, 0.0, 0, 0, 1, 0, 0),
    (2, 1.0, 100, 0.0, 80, 0.0, 0, 0, 1, 0, 0),
    (4, 1.0, 30, 0.0, 60, 0.0, 0, 0, 1, 0, 0),
    (2, 1.0, 1, 1.0, 3, 1.0, 0, 0, 1, 0, 0),
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 1, 0, 0),
    (10, 0.8, 3, 1.0, 4, 1.0, 0, 0, 1, 0, 0),
    (22, 0.9, 5, 1.0, 6, 0.9, 0, 0, 1, 0, 0),
    (3, 0.0, 2, 1.0, 1, 1.0, 0, 0, 1, 0, 0),
    (5, 0.0, 6, 0.0, 4, 0.0, 0, 0, 1, 0, 0),
    (6, 0.0, 3, 0.0, 0, 0.0, 0, 0, 1, 0, 0),
    (4, 0.5, 70, 0.0, 2, 1.0, 0, 0, 1, 0, 0),
    (8, 0.0, 0, 0.0, 45, 0.0, 0, 0, 1, 1, 1),
    (6, 0.0, 3, 1.0, 70, 0.0, 0, 0, 1, 1, 1),
    (5, 0.0, 50, 0.0, 60, 0.0, 0, 0, 1, 1, 1),
    (3, 0.0, 2, 1.0, 4, 1.0, 0, 0, 1, 1, 0),
    (2, 0.0, 40, 0.0, 2, 1.0, 0, 0, 1, 1, 0),
    # Weak cues inside an article: text among text, and what is short, full of links or beside links.
    (8, 0.0, 0, 0.0, 30, 0.0, 1, 1, 0, 1, 1),
    (11, 0.0, 5, 0.0, 44, 0.0, 1, 1, 0, 1, 1),
    (6, 0.0, 1, 0.0, 25, 0.0, 1, 1, 0, 1, 1),
    (60, 0.0, 8, 0.0, 55, 0.0, 1, 1, 0, 0, 1),
    (35, 0.05, 60, 0.0, 40, 0.0, 1, 1, 0, 0, 1),
    (24, 0.0, 50, 0.0, 18, 0.0, 1, 1, 0, 0, 1),
    (110, 0.0, 30, 0.0, 3, 0.6, 1, 1, 0, 0, 1),
    (18, 0.1, 45, 0.0, 70, 0.0, 1, 1, 0, 0, 1),
    (3, 1.0, 60, 0.0, 2, 1.0, 1, 1, 0, 0, 0),
    (6, 0.7, 80, 0.0, 0, 0.0, 1, 1, 0, 0, 0),
    (4, 0.0, 70, 0.0, 3, 1.0, 1, 1, 0, 0, 0),
    (5, 0.0, 9, 0.0, 2, 0.0, 1, 1, 0, 0, 0),
    (20, 0.8, 60, 0.0, 5, 0.9, 1, 1, 0, 0, 0),
    (7, 0.4, 40, 0.0, 50, 0.0, 1, 1, 0, 0, 0),
    (2, 0.0, 12, 0.0, 60, 0.0, 1, 1, 0, 0, 0),
    (3, 0.0, 4, 1.0, 3, 1.0, 1, 1, 0, 1, 0),
)

_UNSEEN = frozenset("script style noscript template svg math title textarea select button iframe object canvas audio video".split())
#: Unseen elements that hold everything up to the page's end if they are never closed; of others only the tag falls away.
_RAW = frozenset("script style".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
_NESTED = frozenset("article main nav header footer aside form section div ul ol dl table tr td th tbody thead fieldset figure blockquote dialog details body html center menu".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_OTHER_TAGS = frozenset("nav footer aside form dialog menu".split())
_OTHER_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog form menu".split())
#: Names of what never is the article, and of what may be a part of it.
_OTHER_WORDS = frozenset(
    """ad ads adv adbox adslot adunit advert adverts advertisement advertising sponsor sponsored sponsors promo promotion sidebar aside menu nav navbar navigation breadcrumb breadcrumbs
    banner cookie cookies consent gdpr popup modal overlay comment comments commentlist disqus reply replies respond share sharing related recommended newsletter subscribe subscription
    paywall login signup signin register topbar bottombar menubar crumbs discussion pager pagination notice notices alert search""".split()
)
_WEAK_WORDS = frozenset("footer header masthead social widget widgets form toolbar tags".split())
#: An article of its own kind inside another: what its class must say to count as something else.
_OTHER_ARTICLES = frozenset("comment comments reply replies response related teaser promo sponsored ad advert".split())
_MAIN_WORDS = frozenset("article content main post entry story maincontent articlebody".split())

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)(?P<attrs>(?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)>|<[!?][^>]*+>", re.DOTALL)
_CLOSE = {tag: re.compile(rf"</{tag}\s*+>", re.IGNORECASE) for tag in _UNSEEN}
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.IGNORECASE)
_NAME = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


def _place(tag: str, attrs: str, inside: bool, cue: int) -> tuple[bool, int]:
    """Whether an element's content is inside the article, and its cue of being something else, given those of its parent."""
    words, role = set(), ""
    for name, value in _ATTRIBUTE.findall(attrs) if attrs else ():
        value = value.strip("\"'")
        if name.lower() == "role":
            role = value.lower()
        else:
            words.update(w.lower() for w in _NAME.findall(value))
    main = tag in ("article", "main") or role == "main" or bool(words & _MAIN_WORDS)
    whole = tag in ("main", "body", "html")
    if tag in _OTHER_TAGS or role in _OTHER_ROLES or (tag == "header" and not inside) or words & (_OTHER_ARTICLES if tag == "article" else frozenset() if whole else _OTHER_WORDS):
        cue = 2
    elif words & _WEAK_WORDS and not whole:
        cue = max(cue, 1 if main or inside else 2)
    if tag in ("article", "main") or role == "main" or (main and not words & _OTHER_WORDS):
        inside = True
    return inside, cue


@dataclass
class Block:
    text: str
    words: int
    links: float
    inside: bool
    cue: int
    heading: bool


def flat_blocks(page: str) -> list[Block]:
    """The page's blocks in order."""
    out: list[Block] = []
    text: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool, int]] = []
    inside = link = heading = False
    cue = own = 0
    never: set[str] = set()

    def flush() -> None:
        words = html.unescape("".join(text)).split()
        if words:
            out.append(Block(" ".join(words), len(words), min(len(html.unescape("".join(linked)).split()) / len(words), 1.0), inside, max(cue, own), heading))
        text.clear()
        linked.clear()

    at = 0
    while m := _MARKUP.search(page, at):
        if m.start() > at:
            part = page[at : m.start()]
            text.append(part)
            if link:
                linked.append(part)
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _UNSEEN:
            if m["close"] or tag in never:
                continue
            end = _CLOSE[tag].search(page, at)
            if end:
                at = end.end()
            elif tag in _RAW:
                at = len(page)
            else:
                never.add(tag)
            continue
        if tag == "a":
            link = not m["close"]
            linked.append(" ")
        if tag in _INLINE:
            continue
        flush()
        own, heading = 0, tag in _HEADINGS and not m["close"]
        if tag not in _NESTED:
            # A paragraph's own mark holds up to the next block.
            if not m["close"] and m["attrs"].strip():
                own = _place(tag, m["attrs"], inside, 0)[1]
            continue
        if not m["close"]:
            stack.append((tag, inside, cue))
            if not m["attrs"].endswith("/"):
                inside, cue = _place(tag, m["attrs"], inside, cue)
        elif any(t == tag for t, _, _ in stack):
            while True:
                t, inside, cue = stack.pop()
                if t == tag:
                    break
            link = False
    if at < len(page):
        rest = page[at:]
        # A page that ends inside a tag ends before it.
        cut = rest.rfind("<")
        text.append(rest[:cut] if cut >= 0 and re.match(r"</?[a-zA-Z]", rest[cut:]) else rest)
    flush()
    return out


def features(found: list[Block]) -> np.ndarray:
    n = np.array([[b.words, b.links] for b in found], np.float64).reshape(-1, 2)
    before = np.vstack([np.zeros((1, 2)), n[:-1]]) if len(n) else n
    after = np.vstack([n[1:], np.zeros((1, 2))]) if len(n) else n
    where = np.array([[b.inside, b.cue] for b in found], np.float64).reshape(-1, 2)
    unmarked = np.full((len(n), 1), float(not any(b.inside and b.cue < 2 for b in found)))
    heading = np.array([[b.heading] for b in found], np.float64).reshape(-1, 1)
    return np.hstack([n, before, after, where, unmarked, heading])


class Tree:
    """A binary decision tree by Gini impurity; leaves hold the majority label."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int):
        self.label = bool(2 * y.sum() >= len(y))
        self.split = None
        if depth == 0 or y.all() or not y.any():
            return
        best = (len(y) * 2 * y.mean() * (1 - y.mean()) - 1e-9, None)
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[1:] + values[:-1]) / 2:
                left = x[:, f] <= cut
                impurity = sum(2 * k * p * (1 - p) for k, p in ((left.sum(), y[left].mean()), ((~left).sum(), y[~left].mean())))
                if impurity < best[0]:
                    best = (impurity, (f, cut))
        if best[1]:
            f, cut = self.split = best[1]
            left = x[:, f] <= cut
            self.low, self.high = Tree(x[left], y[left], depth - 1), Tree(x[~left], y[~left], depth - 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.split is None:
            return np.full(len(x), self.label)
        f, cut = self.split
        left = x[:, f] <= cut
        out = np.empty(len(x), bool)
        out[left], out[~left] = self.low.predict(x[left]), self.high.predict(x[~left])
        return out


def _by_rule() -> list[tuple]:
    """Blocks by rule: without a cue, inside an article all are text, however short or linked, and beside a marked article none is; with a strong cue none is."""
    sides = [(0, 0.0), (3, 1.0), (40, 0.0)]
    sizes = [(w, link) for w in (1, 2, 3, 5, 9, 20, 60, 150) for link in (0.0, 1.0)]
    inner = [(*x, *b, *a, 1, 0, 0, 0, 1) for x in sizes for b in sides for a in sides]
    outer = [(*x, *b, *a, 0, 0, 0, 0, 0) for x in sizes for b in sides for a in sides]
    cued = [(*x, *b, *a, i, 2, 0, h, 0) for x in sizes for b in sides for a in sides for i in (0, 1) for h in (0, 1)]
    return inner + outer + cued


@functools.cache
def train(depth: int = 9) -> Tree:
    """The tree of the labelled table, in which hand-labelled blocks count as often as those by rule."""
    rows = _by_rule()
    table = np.array([*LABELLED * max(1, len(rows) // len(LABELLED)), *rows], np.float64)
    return Tree(table[:, :-1], table[:, -1] > 0, depth)


def main_text(page: str, tree: Tree | None = None) -> str:
    found = flat_blocks(page)
    keep = (tree or train()).predict(features(found))
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages``.

    A null or empty page has an empty text; repeated rows repeat; other columns are ignored.
    """
    tree = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offs = blocks.texts(batch.column(2))
            for lo, hi in blocks.slices(offs):
                texts = [main_text(x or "", tree) for x in batch.column(2).slice(lo, hi - lo).to_pylist()]
                cols = [batch.column(i).slice(lo, hi - lo) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return map_batches(rows, run, "page_id long, url string, text string, n_chars long")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
