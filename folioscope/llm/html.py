"""Main text of web pages: flat text blocks classified by a decision tree."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.tokens import utf8

#: Elements whose content is never text of the page.
SILENT = "script style noscript template svg math iframe object canvas title textarea select button datalist video audio map".split()
#: Elements that do not end a block.
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr br input link meta path picture source base".split()
)
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold blocks and are tracked with what they say about themselves.
HOLDERS = set(
    "html body main article section div nav header footer aside form fieldset ul ol dl li table tr td th thead tbody "
    "tfoot dialog figure details center menu blockquote p pre h1 h2 h3 h4 h5 h6".split()
)
#: What the start of an element ends, if it was not closed.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"}}
_P = frozenset({"p"})  # what any other block ends
BOILER_TAGS = set("nav footer aside form dialog menu fieldset".split())
#: Words in class, id, role or label that mark what is around an article.
BOILER_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies copyright dialog disclaimer disqus feedback footer footnav form login menu modal nav navbar "
    "navigation navs newsletter notice notices notification pagination pager popup promo promoted promotion promotions "
    "recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe "
    "subscription teaser toolbar toc warning widget widgets alert complementary contentinfo masthead skip".split()
)
ARTICLE_WORDS = set("article articlebody content entry main post story".split())
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|visibility\s*:\s*hidden|aria-hidden\s*=\s*[\"']?true", re.I)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<silent>" + "|".join(SILENT) + r")\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=silent)\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs2>[^<>]*)>",
    re.S | re.I,
)
_SELF = re.compile(r"\b(?:class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")

#: Block features in order; neighbours are the blocks before and after.
FEATURES = (
    "words", "links", "words_before", "links_before", "words_after", "links_after",
    "boiler", "article", "heading", "page_has_article",
)

#: The small labelled table: (words, link density, words and link density of
#: the block before, of the block after, inside boilerplate, inside an article,
#: heading, page has an article) -> 1 for main text.
LABELLED = [
    (6, 1.0, 0, 0.0, 1, 1.0, 1, 0, 0, 1, 0), (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0, 1, 0),
    (1, 1.0, 1, 1.0, 12, 0.0, 1, 0, 0, 0, 0), (8, 0.0, 1, 1.0, 10, 0.0, 1, 0, 0, 1, 0),
    (25, 0.0, 4, 0.0, 40, 0.0, 1, 0, 0, 1, 0), (14, 0.0, 120, 0.0, 0, 0.0, 1, 0, 0, 1, 0),
    (60, 0.1, 30, 0.0, 0, 0.0, 1, 0, 0, 0, 0), (90, 0.0, 80, 0.0, 3, 1.0, 1, 1, 0, 1, 0),
    (12, 0.0, 60, 0.0, 50, 0.0, 1, 1, 0, 1, 0), (3, 0.0, 90, 0.0, 20, 0.0, 1, 1, 1, 1, 0),
    (5, 1.0, 70, 0.0, 5, 1.0, 1, 1, 0, 1, 0), (4, 0.0, 0, 0.0, 30, 0.0, 1, 0, 1, 0, 0),
    (10, 0.0, 8, 0.0, 90, 0.0, 0, 1, 1, 1, 1), (120, 0.0, 10, 0.0, 80, 0.0, 0, 1, 0, 1, 1),
    (80, 0.02, 120, 0.0, 60, 0.0, 0, 1, 0, 1, 1), (1, 0.0, 60, 0.0, 14, 0.0, 0, 1, 0, 1, 1),
    (3, 0.0, 40, 0.0, 50, 0.0, 0, 1, 0, 1, 1), (9, 0.5, 50, 0.0, 70, 0.0, 0, 1, 0, 1, 1),
    (2, 1.0, 40, 0.0, 60, 0.0, 0, 1, 0, 1, 1), (5, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0, 1, 1),
    (30, 0.3, 4, 0.0, 12, 0.0, 0, 1, 0, 1, 1), (4, 0.0, 90, 0.0, 60, 0.0, 0, 1, 1, 1, 1),
    (6, 0.0, 5, 0.0, 0, 0.0, 0, 1, 0, 1, 1), (200, 0.0, 12, 0.0, 9, 0.0, 0, 1, 0, 1, 1),
    (40, 0.0, 3, 1.0, 90, 0.0, 0, 0, 0, 1, 0), (12, 0.0, 90, 0.0, 0, 0.0, 0, 0, 0, 1, 0),
    (5, 1.0, 4, 1.0, 8, 0.0, 0, 0, 0, 1, 0), (6, 0.0, 2, 1.0, 12, 0.0, 0, 0, 1, 1, 0),
    (70, 0.0, 60, 0.0, 2, 1.0, 0, 0, 0, 1, 0), (2, 0.0, 0, 0.0, 3, 0.0, 0, 0, 0, 1, 0),
    (60, 0.0, 40, 0.0, 50, 0.0, 0, 0, 0, 0, 1), (35, 0.1, 60, 0.0, 3, 1.0, 0, 0, 0, 0, 1),
    (22, 0.0, 80, 0.0, 90, 0.0, 0, 0, 0, 0, 1), (15, 0.0, 50, 0.0, 45, 0.0, 0, 0, 0, 0, 1),
    (11, 0.0, 30, 0.0, 1, 1.0, 0, 0, 0, 0, 1), (90, 0.2, 1, 1.0, 0, 0.0, 0, 0, 0, 0, 1),
    (5, 0.0, 70, 0.0, 60, 0.0, 0, 0, 0, 0, 1), (8, 0.0, 40, 0.1, 55, 0.0, 0, 0, 0, 0, 1),
    (7, 0.0, 3, 1.0, 60, 0.0, 0, 0, 1, 0, 1), (4, 0.0, 50, 0.0, 40, 0.0, 0, 0, 1, 0, 1),
    (9, 0.0, 0, 0.0, 80, 0.0, 0, 0, 1, 0, 1), (120, 0.05, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1),
    (3, 1.0, 2, 1.0, 4, 1.0, 0, 0, 0, 0, 0), (6, 0.9, 40, 0.0, 5, 1.0, 0, 0, 0, 0, 0),
    (30, 0.8, 3, 1.0, 20, 0.9, 0, 0, 0, 0, 0), (4, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0, 0),
    (5, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0, 0, 0), (2, 0.5, 1, 1.0, 2, 0.5, 0, 0, 0, 0, 0),
    (18, 0.7, 50, 0.0, 12, 0.8, 0, 0, 0, 0, 0), (1, 0.0, 4, 1.0, 0, 0.0, 0, 0, 0, 0, 0),
    (90, 0.0, 100, 0.0, 100, 0.0, 0, 0, 0, 1, 0), (120, 0.0, 1, 1.0, 60, 0.0, 0, 0, 0, 1, 0),
    (20, 0.0, 20, 0.0, 20, 0.0, 0, 0, 0, 1, 0), (55, 0.0, 0, 0.0, 45, 0.0, 0, 0, 0, 1, 0),
    (3, 0.0, 3, 0.0, 90, 0.0, 0, 0, 0, 1, 0), (9, 0.0, 2, 1.0, 100, 0.0, 0, 0, 1, 1, 0),
    (60, 0.0, 60, 0.0, 60, 0.0, 1, 0, 0, 1, 0), (100, 0.0, 0, 0.0, 100, 0.0, 1, 0, 0, 0, 0),
    (2, 1.0, 2, 1.0, 60, 0.0, 1, 0, 0, 1, 0), (15, 0.0, 100, 0.0, 100, 0.0, 1, 1, 0, 1, 0),
    (20, 0.0, 15, 0.0, 15, 0.0, 1, 0, 0, 0, 0), (30, 0.0, 70, 0.0, 45, 0.0, 1, 0, 0, 0, 0),
    (110, 0.0, 90, 0.0, 70, 0.0, 1, 1, 0, 1, 0), (45, 0.0, 5, 0.0, 80, 0.0, 1, 0, 0, 1, 0),
    (3, 0.0, 0, 0.0, 1, 1.0, 0, 1, 0, 1, 1), (8, 0.0, 2, 1.0, 5, 0.0, 0, 1, 0, 1, 1),
    (50, 0.0, 3, 1.0, 12, 0.0, 0, 1, 0, 1, 1), (12, 1.0, 5, 0.0, 5, 0.0, 0, 1, 0, 1, 1),
    (1, 0.0, 1, 0.0, 1, 0.0, 0, 1, 0, 1, 1), (6, 0.0, 6, 0.0, 6, 0.0, 0, 1, 0, 1, 1),
    (75, 0.0, 9, 0.0, 2, 1.0, 0, 1, 0, 1, 1), (2, 0.0, 30, 0.0, 25, 0.0, 0, 1, 0, 1, 1),
    (2, 0.0, 0, 0.0, 4, 0.0, 0, 1, 1, 1, 1), (12, 0.9, 20, 0.0, 0, 0.0, 0, 1, 0, 1, 1),
]

Tree = tuple | int


def train_tree(rows: Sequence[tuple] = LABELLED, depth: int = 6, least: int = 1) -> Tree:
    """A decision tree by least Gini impurity: (feature, threshold, low, high) or a class."""
    data = np.array(rows, dtype=float)

    def grow(x: np.ndarray, y: np.ndarray, left: int) -> Tree:
        share = y.mean()
        if left == 0 or share in (0.0, 1.0):
            return int(share >= 0.5)
        best = None
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for t in (values[:-1] + values[1:]) / 2:
                low = x[:, f] <= t
                a, b = y[low], y[~low]
                if min(len(a), len(b)) >= least:
                    impurity = sum(len(s) * s.mean() * (1 - s.mean()) for s in (a, b))
                    if best is None or impurity < best[0] - 1e-12:
                        best = (impurity, f, float(t), low)
        if best is None:
            return int(share >= 0.5)
        _, f, t, low = best
        return f, t, grow(x[low], y[low], left - 1), grow(x[~low], y[~low], left - 1)

    return grow(data[:, :-1], data[:, -1], depth)


def classify(tree: Tree, features: Sequence[float]) -> int:
    while not isinstance(tree, int):
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return tree


def _about(tag: str, attrs: str, inside_article: bool) -> tuple[bool, bool]:
    """Whether an element opens boilerplate, and whether it opens an article."""
    said: set[str] = set()
    boiler = tag in BOILER_TAGS or (tag == "header" and not inside_article)
    if attrs and not attrs.isspace():
        for m in _SELF.finditer(attrs):
            said.update(_SPLIT.split((m[1] or m[2] or m[3] or "").lower()))
        boiler |= HIDDEN.search(attrs) is not None
    if tag in ("html", "body"):
        return False, False
    if tag in ("article", "main"):
        comment = not said.isdisjoint({"comment", "comments", "reply", "replies"})
        return comment or boiler, not comment
    boiler |= not said.isdisjoint(BOILER_WORDS) or ("header" in said and not inside_article)
    return boiler, not boiler and not said.isdisjoint(ARTICLE_WORDS)


def blocks(page: str) -> list[tuple[str, int, float, bool, bool, bool]]:
    """(text, words, link density, boilerplate, article, heading) in page order."""
    out: list[tuple[str, int, float, bool, bool, bool]] = []
    stack: list[tuple[str, bool, bool]] = []
    text: list[str] = []
    linked: list[str] = []
    in_link = 0

    def flush() -> None:
        words = html.unescape("".join(text)).split()
        text.clear()
        inside = html.unescape(" ".join(linked)).split()
        linked.clear()
        if words:
            heading = any(t in HEADINGS for t, _, _ in stack[-2:])
            out.append(
                (" ".join(words), len(words), min(len(inside) / len(words), 1.0), any(b for _, b, _ in stack), any(a for _, _, a in stack), heading)
            )

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            part = page[at : m.start()]
            text.append(part)
            if in_link:
                linked.append(part)
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            if m["silent"]:
                text.append(" ")
            continue
        tag = tag.lower()
        closing = m["close"] or m["close2"]
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if closing else 1
            elif tag == "br":
                text.append(" ")
            continue
        flush()
        in_link = 0
        if tag not in HOLDERS:
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        while stack and stack[-1][0] in CLOSES.get(tag, _P):
            stack.pop()
        if not attrs.rstrip().endswith("/"):
            stack.append((tag, *_about(tag, attrs, any(a for _, _, a in stack))))
    text.append(page[at:])
    flush()
    return out


def main_text(page: str, tree: Tree) -> str:
    """The blocks that the tree takes for main text, one a line."""
    found = blocks(page)
    has_article = any(a and not b for _, _, _, b, a, _ in found)
    kept = []
    for k, (text, words, links, boiler, article, heading) in enumerate(found):
        before = found[k - 1][1:3] if k else (0, 0.0)
        after = found[k + 1][1:3] if k + 1 < len(found) else (0, 0.0)
        if classify(tree, (words, links, *before, *after, boiler, article, heading, has_article)):
            kept.append(text)
    return "\n".join(kept)


def _extract(tree: Tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.decode(), tree) for p in utf8(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return run


def extract_main_text(pages: DataFrame, labelled: Sequence[tuple] = LABELLED) -> DataFrame:
    """page_id, url, text, n_chars of every page; null and blank pages give "".

    Pages are read as they lie, each whole, so nothing is shuffled.  Repeated
    rows give repeated results, an empty table none.
    """
    rows = pages.select(F.col("page_id").cast("long"), "url", "html")
    return rows.mapInArrow(_extract(train_tree(labelled)), "page_id long, url string, text string, n_chars long")
