"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into flat blocks at block-level tags. A block has its word count and link density, those of its
neighbours, the kind of element it stands in, and whether the page marks its main part at all. The tree is trained on
the small labelled table of ``examples``; main-text blocks are joined in page order. ``importance`` says how much each
feature lowers the impurity of that table.

Scripts, styles, comments, the head and form controls never make blocks. Character references are decoded, white space
inside a block is one space, and blocks without a word are none.

Defined results: null, empty and broken html give the text of the blocks that can be read, or the empty text. Unclosed
elements end where an enclosing one ends; a tag whose quote is not closed ends at the next ">". A null id or url stays
null, repeated rows stay repeated, an empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import columns, slices

# A comment, a raw-text element with its content (to the end of the page if it is not closed), another dropped element if
# it is closed, or a tag; quoted attribute values may hold ">". An svg or iframe that ends in "/>" is empty. Last, a tag
# with a quote that is not closed, or one that the page ends in.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(?!(?:svg|iframe)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*/>)(noscript|template|select|svg|iframe|title)\b[^>]*>.*?</\2\s*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>"
    r"|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)(?:>|(?=<)|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements without content.
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements and names that say what a part of a page is for.
BOILERPLATE_TAGS = frozenset("nav aside footer header form menu button dialog fieldset legend option label".split())
#: Of these, the ones that can stand around a whole page.
WRAPPER_TAGS = frozenset("form header dialog fieldset".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion popup modal overlay nav navbar "
    "navigation menu breadcrumb breadcrumbs sidebar side aside footer foot header masthead topbar toolbar cookie cookies consent "
    "gdpr notice notices alert newsletter subscribe subscription signup login search share sharing social related recommended "
    "recommendations trending popular comment comments reply replies discussion disqus respond tags pagination pager widget widgets "
    "copyright legal disclaimer toc form".split()
)
#: Names of an article that is a reader's, and words that say that a name is about the page and not the part.
READER_NAMES = frozenset("comment comments reply replies respond disqus".split())
ABOUT_PAGE = frozenset("has with without no is hide show open closed count enabled disabled on off allowed".split())
MAIN_TAGS = frozenset({"article", "main"})
MAIN_NAMES = frozenset("article main content entry post story body text".split())
_NAME = re.compile(r"[a-z]+")

FEATURES = (
    "boilerplate_tag", "boilerplate_name", "boilerplate_around", "main_tag", "main_name", "heading", "list_item", "words", "link_density",
    "words_before", "link_density_before", "words_after", "link_density_after", "page_marked",
)
_NO_MARKS = (0,) * 7


@dataclass
class Block:
    """Flat text with the marks of the elements around it."""

    marks: tuple[int, ...]
    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    text: str = ""
    words: int = 0
    link_density: float = 0.0

    def close(self) -> bool:
        self.text = " ".join(entities.unescape("".join(self.parts)).split())
        self.words = len(self.text.split())
        if self.words:
            self.link_density = len(entities.unescape(" ".join(self.linked)).split()) / self.words
        return bool(self.words)


def names_of(attributes: str) -> tuple[set[str], bool]:
    """The words of an element's class, id and role that name the part, and whether they name a reader's comment.

    A name like has-sidebar or comments-open is about the page.
    """
    names: set[str] = set()
    reader = False
    for m in _ATTRIBUTE.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            words = _NAME.findall(name)
            if ABOUT_PAGE.isdisjoint(words):
                names.update(words)
                reader |= not READER_NAMES.isdisjoint(words)
    return names, reader


def marks_of(tag: str, attributes: str, around: tuple[int, ...]) -> tuple[int, ...]:
    """Marks of an element's text, given those of the element around it.

    A boilerplate tag is 2 where it can't be a page's wrapper, else 1. An article or main part starts anew: what its
    wrappers are called is ``boilerplate_around``.
    """
    tag_off, name_off, around_off, main_tag, main_name, heading, item = around
    names, reader = names_of(attributes) if attributes else (set(), False)
    in_main = tag in MAIN_TAGS
    if in_main:
        around_off = 1 if around_off or name_off or tag_off else 0
        tag_off, name_off = (2 if tag_off == 2 else 0), 1 if reader else 0
    # A header inside an article is the article's own.
    elif tag in BOILERPLATE_TAGS and not (tag == "header" and main_tag):
        tag_off = max(tag_off, 1 if tag in WRAPPER_TAGS else 2)
    if names & BOILERPLATE_NAMES and not in_main and tag not in ("html", "body"):
        name_off = 1
    return (
        tag_off,
        name_off,
        around_off,
        1 if in_main else main_tag,
        1 if names & MAIN_NAMES else main_name,
        1 if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit() else heading,
        1 if tag in ("li", "dd", "dt", "td", "th") else item,
    )


def blocks(page: str | None) -> list[Block]:
    """The flat blocks of a page in order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple]] = []
    current = Block(_NO_MARKS)
    page = page or ""
    place, links, in_head = 0, 0, False

    def text(part: str) -> None:
        if part and not in_head:
            current.parts.append(part)
            if links:
                current.linked.append(part)

    def start_block() -> None:
        nonlocal current
        if current.parts and current.close():
            out.append(current)
        current = Block(stack[-1][1] if stack else _NO_MARKS)

    for m in _TOKEN.finditer(page):
        text(page[place : m.start()])
        place = m.end()
        k = 4 if m[4] is not None else 7
        if m[k] is None:
            continue
        tag, closing, attributes = m[k].lower(), bool(m[k - 1]), m[k + 1]
        if tag == "head":
            in_head = not closing
            start_block()
        elif tag == "br" or tag == "wbr":
            current.parts.append(" " if tag == "br" else "")
        elif tag == "a":
            links = 0 if closing else 1
        elif tag in VOID_TAGS and tag != "hr":
            continue
        elif tag in BLOCK_TAGS:
            in_head = False
            if closing:
                depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
                if depth is not None:
                    del stack[depth:]
            elif tag != "hr":
                if stack and stack[-1][0] == "p":  # a block ends an open paragraph
                    stack.pop()
                if tag == "li" and stack and stack[-1][0] == "li":
                    stack.pop()
                stack.append((tag, marks_of(tag, attributes, stack[-1][1] if stack else _NO_MARKS)))
            links = 0
            start_block()
        elif not closing and attributes and _ATTRIBUTE.search(attributes):
            made = marks_of(tag, attributes, current.marks)
            if made != current.marks and not any(p.strip() for p in current.parts):
                current.marks = made  # an inline element that is all of the block so far
    text(page[place:])
    start_block()
    return out


def table(found: list[Block]) -> np.ndarray:
    """A row of ``FEATURES`` for each block."""
    n = len(found)
    words = np.array([0, *(b.words for b in found), 0], dtype=float)
    density = np.array([0, *(b.link_density for b in found), 0], dtype=float)
    own = np.array([b.marks for b in found], dtype=float).reshape(n, len(_NO_MARKS))
    marked = np.full(n, float(own[:, 3:5].any()))
    return np.column_stack([own, words[1:-1], density[1:-1], words[:-2], density[:-2], words[2:], density[2:], marked])


class DecisionTree:
    """Binary splits that lower the Gini impurity most; ties go to the earlier feature and the lower threshold."""

    def __init__(self, depth: int = 16, least: int = 1):
        self.depth, self.least = depth, least
        self.nodes: list[tuple[int, float, int, int, float]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> DecisionTree:
        self.nodes = []
        self._grow(x, y, 0)
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> int:
        at = len(self.nodes)
        share = float(y.mean()) if len(y) else 0.0
        self.nodes.append((-1, 0.0, -1, -1, share))
        if depth >= self.depth or share in (0.0, 1.0):
            return at
        best = None
        for k in range(x.shape[1]):
            order = np.argsort(x[:, k], kind="stable")
            v, t = x[order, k], y[order]
            cuts = np.nonzero(v[1:] > v[:-1])[0] + 1
            cuts = cuts[(cuts >= self.least) & (len(t) - cuts >= self.least)]
            if not len(cuts):
                continue
            ones = np.cumsum(t)[cuts - 1]
            p, q = ones / cuts, (t.sum() - ones) / (len(t) - cuts)
            impurity = (cuts * p * (1 - p) + (len(t) - cuts) * q * (1 - q)) / len(t)
            i = int(np.argmin(impurity))
            if best is None or impurity[i] < best[0] - 1e-12:
                best = (impurity[i], k, (v[cuts[i] - 1] + v[cuts[i]]) / 2)
        if best is None or best[0] >= share * (1 - share) - 1e-12:
            return at
        _, k, cut = best
        low = x[:, k] <= cut
        left = self._grow(x[low], y[low], depth + 1)
        right = self._grow(x[~low], y[~low], depth + 1)
        self.nodes[at] = (k, float(cut), left, right, share)
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Share of main text in each row's leaf."""
        out = np.zeros(len(x))
        stack = [(0, np.arange(len(x)))]
        while stack:
            at, rows = stack.pop()
            k, cut, left, right, share = self.nodes[at]
            if k < 0:
                out[rows] = share
            else:
                low = x[rows, k] <= cut
                stack += [(left, rows[low]), (right, rows[~low])]
        return out


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of ``examples``."""
    from factloom.llm.html_examples import examples

    pages = [(table(found), [b.text.startswith("+") for b in found]) for found in map(blocks, examples())]
    return np.concatenate([x for x, _ in pages]), np.concatenate([np.array(y, dtype=float) for _, y in pages])


def train() -> DecisionTree:
    """The tree of the labelled table."""
    return DecisionTree().fit(*labelled_table())


def importance(tree: DecisionTree, x: np.ndarray, y: np.ndarray) -> dict[str, float]:
    """Share of the table's impurity that the splits on each feature take away."""
    gain = dict.fromkeys(FEATURES, 0.0)
    stack = [(0, np.arange(len(y)))]
    impurity = lambda rows: len(rows) * y[rows].mean() * (1 - y[rows].mean()) if len(rows) else 0.0
    while stack:
        at, rows = stack.pop()
        k, cut, left, right, _ = tree.nodes[at]
        if k >= 0:
            low = x[rows, k] <= cut
            gain[FEATURES[k]] += impurity(rows) - impurity(rows[low]) - impurity(rows[~low])
            stack += [(left, rows[low]), (right, rows[~low])]
    whole = impurity(np.arange(len(y)))
    return {f: g / whole for f, g in gain.items()}


def main_text(page: str | None, tree: DecisionTree) -> str:
    found = blocks(page)
    if not found:
        return ""
    return "\n".join(b.text for b, share in zip(found, tree.predict(table(found)), strict=True) if share >= 0.5)


def extract(pages: DataFrame, tree: DecisionTree | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    tree = tree or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", 4 << 20):
            texts = [main_text(h, tree) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = columns(pages, page_id="page_id", url="url", html="html").select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    )
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
