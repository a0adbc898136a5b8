"""Main text of web pages: flat text blocks, shallow features and a decision tree.

A page is read as a stream of tags and text.  Block-level tags part the text into flat blocks.  A block is
described by its word count and link density, those of its nearest neighbours outside page furniture, and by where it
stands: inside an article, inside page furniture (menus, footers, forms and the like, told by tag or by
class, id and role), and whether it is a heading.  A decision tree trained on the small labelled table below
tells content from the rest.  Content blocks are joined in page order by one space.

Defined cases: a null or empty html, and a page without content, give an empty text; scripts, styles,
templates, comments and the head are never text, also when not closed, drawings and embedded objects only when closed;
custom elements are plain ones whatever their names begin with; a class, id or role marks furniture only as a whole name (``ad-slot``,
not ``ad-free`` or ``social-science``), on a body, main or html element never,
and on an article only if it is such a word alone or begins with ``comment-``; unclosed and
stray tags are taken as browsers take them; a page is read whole, however long, in time that grows with its length and
not with its depth; a cut page is read as far as it goes; repeated rows are read each, whatever their ids; an empty
table gives no rows; columns other than page_id, url and html are not read.  White space is what ``str.split`` parts.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvatica.llm.boosting import Tree, classification_tree
from sylvatica.llm.storage import small_batches

#: Elements by their part in the layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br button center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hr html iframe legend li main menu nav ol optgroup option p pre section select summary table tbody td "
    "textarea tfoot th thead tr ul video audio canvas".split()
)
FURNITURE = frozenset("nav footer aside form menu button select dialog fieldset label option textarea".split())
CLOSES_P = BLOCK - {"br", "button"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in class, id or role that name page furniture, and those that may stand beside them in one name.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus footer "
    "gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promos promoted promotion recommended "
    "recommendations related reply replies search share sharing sidebar sidebars signup skip social sponsor sponsored sponsors subscribe subscription tags toolbar topbar "
    "widget widgets contentinfo complementary alert respond".split()
)
BESIDE = frozenset(
    "area article articles bar block body bottom box btn button buttons card cell center col column container content danger div el element error feed form global group head "
    "header holder icon icons info inline inner item items label left link links list main message middle outer page panel policy post posts primary reader right row "
    "secondary section site slot small stories story success text title to top unit user warning wrap wrapper zone".split()
)

#: The elements that hold the content itself, whose classes tell of the page.
HOLDERS = frozenset("html body main".split())
#: Class words that make an article element furniture.
LONE = frozenset("comment comments ad ads advert advertisement promo promoted sponsored related reply teaser".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?:svg|math)(?=[\s/>])(?:[^>\"'/]+|\"[^\"]*\"|'[^']*'|/(?!>))*+/>"
    r"|<(?P<raw>script|style|noscript|template|title|iframe|textarea|xmp|noembed|noframes)(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<closed>svg|math|object)(?=[\s/>])[^>]*>.*?</(?P=closed)\s*>"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>(?:[^>\"']+|\"[^\"]*\"|'[^']*')*+(?:>|\Z)|[^>]*(?:>|\Z))"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
#: The end of a tag that closes itself; in ``<a href=/>`` the stroke is a value.
CLOSED = re.compile(r"(?:^|[\s\"'])/>\Z|^[^=]*/>\Z")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    article: bool
    furniture: bool
    heading: bool

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


def _hint(name: str) -> bool:
    """Whether a class names furniture: one of its words does, and the others do not make it another thing."""
    words = re.split(r"[-_:.\d]+|(?<=[a-z])(?=[A-Z])", name)
    words = [w.lower() for w in words if w]
    return any(w in HINTS for w in words) and all(w in HINTS or w in BESIDE for w in words)


@lru_cache(4096)
def _marks(tag: str, attributes: str) -> tuple[bool, bool]:
    """(furniture, article) of an element by its tag and attributes."""
    furniture = tag in FURNITURE
    article = tag in ("article", "main")
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role"):
            article |= name == "role" and value.lower() in ("main", "article")
            if tag in HOLDERS:
                continue
            if tag == "article":
                furniture |= name == "class" and any(word in LONE or word.startswith("comment-") for word in value.lower().split())
                continue
            furniture |= any(_hint(name) for name in value.split())
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            furniture = True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            furniture = True
    return furniture, article and not furniture


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # (tag, furniture, article) of the open elements
    opened: Counter[str] = Counter()  # how many of each are open, so that no search goes down the stack in vain
    parts: list[tuple[str, bool]] = []
    headings = 0

    def flush() -> None:
        if not parts:
            return
        text = " ".join("".join(p for p, _ in parts).split())
        if text:
            linked = sum(len(p.split()) for p, inside in parts if inside)
            furniture, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
            words = len(text.split())
            out.append(Block(text, words, min(linked, words), article, furniture, headings > 0))
        parts.clear()

    def pop_to(depth: int) -> None:
        nonlocal headings
        for tag, _, _ in stack[depth:]:
            opened[tag] -= 1
            headings -= tag in HEADINGS
        del stack[depth:]

    def implied(tags: frozenset[str], within: frozenset[str]) -> None:
        """Close the nearest open element of ``tags``, unless one of ``within`` is opened inside it."""
        if not any(opened[t] for t in tags):
            return
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth][0] in tags:
                pop_to(depth)
                return
            if stack[depth][0] in within:
                return

    def text(raw: str) -> None:
        if raw and not any(t == "head" for t, _, _ in stack[:2]):
            parts.append((entities.unescape(raw) if "&" in raw else raw, opened["a"] > 0))

    at = 0
    for token in TOKEN.finditer(page):
        if token.start() > at:
            text(page[at : token.start()])
        at = token.end()
        tag = token["tag"]
        if not tag:
            if token["raw"] and token["raw"].lower() in BLOCK:
                flush()
            continue
        tag = tag.lower()
        if tag in BLOCK:
            flush()
        if token["close"]:
            if opened[tag]:
                depth = next(d for d in range(len(stack) - 1, -1, -1) if stack[d][0] == tag)
                flush() if tag in BLOCK else None
                pop_to(depth)
            continue
        if tag in VOID:
            continue
        if tag == "body" and opened["head"]:  # ends an unclosed head
            pop_to(next((d for d, s in enumerate(stack) if s[0] == "head"), len(stack)))
        if tag in CLOSES_P:
            implied(frozenset(("p", *HEADINGS)) if tag in HEADINGS else frozenset(("p",)), BLOCK - {"p"} - HEADINGS)
        if tag == "li":
            implied(frozenset(("li",)), frozenset(("ul", "ol", "menu")))
        elif tag in ("dt", "dd"):
            implied(frozenset(("dt", "dd")), frozenset(("dl",)))
        elif tag in ("td", "th"):
            implied(frozenset(("td", "th")), frozenset(("tr", "table")))
        elif tag == "tr":
            implied(frozenset(("tr",)), frozenset(("table",)))
        elif tag == "a":
            implied(frozenset(("a",)), BLOCK)
        if CLOSED.search(token["attributes"]) and tag not in BLOCK:
            continue
        furniture, article = _marks(tag, token["attributes"])
        outer = stack[-1] if stack else ("", False, False)
        if tag == "header" and not outer[2]:
            furniture = True
        stack.append((tag, furniture or outer[1], (article or outer[2]) and not furniture))
        opened[tag] += 1
        headings += tag in HEADINGS
    text(page[at:])
    flush()
    return out


NAMES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "article", "furniture", "heading")

#: The labelled blocks.  Columns as in NAMES, then 1 for content.  Blocks without the article mark come first: there
#: the words and the links of a block and of both its neighbours tell.
LABELLED = np.array([
    # running text, whatever stands beside it
    [40, 0.00, 30, 0.00, 35, 0.00, 0, 0, 0, 1], [90, 0.05, 5, 0.00, 60, 0.02, 0, 0, 0, 1], [22, 0.00, 60, 0.00, 3, 1.00, 0, 0, 0, 1], [18, 0.00, 2, 1.00, 1, 1.00, 0, 0, 0, 1],
    [60, 0.30, 20, 0.00, 4, 0.00, 0, 0, 0, 1], [25, 0.00, 0, 0.00, 0, 0.00, 0, 0, 0, 1], [14, 0.10, 0, 0.00, 25, 0.00, 0, 0, 1, 1], [120, 0.10, 2, 1.00, 2, 1.00, 0, 0, 0, 1],
    [12, 0.25, 3, 1.00, 4, 1.00, 0, 0, 0, 1], [35, 0.40, 1, 1.00, 8, 0.00, 0, 0, 0, 1], [16, 0.00, 0, 0.00, 5, 1.00, 0, 0, 0, 1], [10, 0.00, 45, 0.00, 50, 0.00, 0, 0, 0, 1],
    # short plain blocks beside plain ones: headings, captions, short paragraphs, list items, short pages
    [7, 0.00, 1, 1.00, 55, 0.00, 0, 0, 1, 1], [4, 0.00, 30, 0.00, 28, 0.00, 0, 0, 0, 1], [9, 0.00, 12, 0.00, 0, 0.00, 0, 0, 0, 1], [5, 0.00, 8, 0.00, 9, 0.00, 0, 0, 1, 1],
    [2, 0.00, 3, 0.00, 4, 0.00, 0, 0, 0, 1], [1, 0.00, 1, 0.00, 2, 0.00, 0, 0, 0, 1], [3, 0.00, 0, 0.00, 3, 0.00, 0, 0, 1, 1], [2, 0.00, 3, 0.00, 0, 0.00, 0, 0, 0, 1],
    [3, 0.00, 0, 0.00, 0, 0.00, 0, 0, 0, 1], [1, 0.00, 40, 0.00, 3, 1.00, 0, 0, 0, 1], [2, 0.00, 3, 1.00, 25, 0.00, 0, 0, 0, 1], [4, 0.00, 2, 1.00, 5, 0.00, 0, 0, 1, 1],
    [6, 0.00, 9, 0.00, 2, 1.00, 0, 0, 0, 1], [1, 0.00, 2, 0.00, 1, 1.00, 0, 0, 0, 1], [3, 0.00, 1, 1.00, 2, 0.00, 0, 0, 0, 1], [1, 0.00, 0, 0.00, 30, 0.00, 0, 0, 1, 1],
    # short plain blocks among links: names of menus and of lists of links
    [2, 0.00, 1, 1.00, 1, 1.00, 0, 0, 0, 0], [1, 0.00, 2, 1.00, 3, 1.00, 0, 0, 0, 0], [3, 0.00, 4, 1.00, 2, 1.00, 0, 0, 1, 0], [2, 0.00, 6, 1.00, 5, 0.90, 0, 0, 1, 0],
    [4, 0.00, 3, 0.90, 1, 1.00, 0, 0, 0, 0], [3, 0.20, 2, 1.00, 2, 1.00, 0, 0, 0, 0], [5, 0.00, 1, 1.00, 2, 1.00, 0, 0, 0, 0],
    # links between plain text
    [3, 1.00, 20, 0.00, 25, 0.00, 0, 0, 0, 1], [6, 1.00, 12, 0.00, 40, 0.10, 0, 0, 0, 1], [2, 1.00, 60, 0.00, 9, 0.00, 0, 0, 0, 1], [9, 0.80, 14, 0.10, 16, 0.00, 0, 0, 0, 1],
    [5, 0.60, 11, 0.00, 8, 0.00, 0, 0, 0, 1], [4, 1.00, 8, 0.00, 30, 0.00, 0, 0, 1, 1], [1, 1.00, 9, 0.00, 10, 0.00, 0, 0, 0, 1],
    # links among links, and at the edges of text
    [2, 1.00, 2, 1.00, 2, 1.00, 0, 0, 0, 0], [1, 1.00, 0, 0.00, 3, 1.00, 0, 0, 0, 0], [5, 0.80, 3, 1.00, 2, 1.00, 0, 0, 0, 0], [12, 0.75, 4, 1.00, 20, 0.00, 0, 0, 0, 0],
    [2, 1.00, 1, 1.00, 7, 0.00, 0, 0, 0, 0], [2, 1.00, 60, 0.00, 1, 1.00, 0, 0, 0, 0], [9, 1.00, 2, 1.00, 40, 0.00, 0, 0, 0, 0], [4, 1.00, 40, 0.00, 2, 1.00, 0, 0, 0, 0],
    [1, 1.00, 3, 1.00, 12, 0.00, 0, 0, 0, 0], [3, 1.00, 25, 0.00, 4, 1.00, 0, 0, 0, 0], [5, 1.00, 8, 1.00, 90, 0.00, 0, 0, 0, 0], [30, 0.90, 25, 0.90, 28, 0.95, 0, 0, 0, 0],
    [2, 1.00, 50, 0.00, 0, 0.00, 0, 0, 0, 0], [3, 1.00, 0, 0.00, 60, 0.00, 0, 0, 0, 0], [2, 1.00, 1, 0.00, 1, 0.00, 0, 0, 0, 0], [3, 1.00, 30, 0.00, 6, 1.00, 0, 0, 0, 0], [4, 1.00, 20, 0.00, 9, 1.00, 0, 0, 0, 0], [2, 1.00, 12, 0.00, 14, 0.90, 0, 0, 0, 0], [3, 1.00, 2, 0.00, 40, 0.00, 0, 0, 0, 0],
    [2, 1.00, 30, 0.00, 2, 0.00, 0, 0, 0, 0], [1, 1.00, 0, 0.00, 0, 0.00, 0, 0, 0, 0], [8, 0.60, 0, 0.00, 3, 1.00, 0, 0, 0, 0],
    # an article's own blocks, with its lists of sources
    [85, 0.00, 60, 0.00, 40, 0.00, 1, 0, 0, 1], [12, 0.00, 9, 0.00, 80, 0.00, 1, 0, 1, 1], [2, 0.00, 40, 0.00, 35, 0.00, 1, 0, 0, 1], [1, 0.00, 1, 1.00, 1, 1.00, 1, 0, 0, 1],
    [45, 0.55, 30, 0.00, 20, 0.00, 1, 0, 0, 1], [4, 0.00, 0, 0.00, 0, 0.00, 1, 0, 1, 1], [2, 1.00, 60, 0.00, 55, 0.00, 1, 0, 0, 1], [2, 1.00, 3, 1.00, 2, 1.00, 1, 0, 0, 1],
    [5, 1.00, 4, 1.00, 6, 1.00, 1, 0, 0, 1], [1, 1.00, 1, 1.00, 0, 0.00, 1, 0, 0, 1], [8, 0.95, 9, 1.00, 7, 1.00, 1, 0, 0, 1], [3, 1.00, 0, 0.00, 4, 0.90, 1, 0, 0, 1],
    [2, 0.00, 3, 1.00, 1, 1.00, 1, 0, 1, 1], [1, 1.00, 2, 0.00, 0, 0.00, 1, 0, 0, 1], [7, 0.50, 2, 1.00, 9, 1.00, 1, 0, 0, 1], [4, 1.00, 0, 0.00, 0, 0.00, 1, 0, 0, 1],
    # page furniture, long or short, wherever it stands
    [1, 1.00, 1, 1.00, 1, 1.00, 0, 1, 0, 0], [2, 1.00, 0, 0.00, 1, 1.00, 0, 1, 0, 0], [9, 0.00, 1, 1.00, 12, 0.00, 0, 1, 0, 0], [60, 0.00, 3, 0.00, 45, 0.00, 0, 1, 0, 0],
    [25, 0.10, 40, 0.00, 80, 0.00, 0, 1, 0, 0], [4, 0.00, 70, 0.00, 0, 0.00, 0, 1, 0, 0], [3, 0.00, 90, 0.00, 8, 0.00, 0, 1, 1, 0], [120, 0.00, 80, 0.00, 90, 0.00, 0, 1, 0, 0],
    [15, 0.50, 20, 0.00, 6, 1.00, 0, 1, 0, 0], [6, 0.00, 5, 0.00, 7, 0.00, 0, 1, 0, 0], [2, 0.00, 1, 0.00, 1, 0.00, 0, 1, 0, 0], [40, 0.00, 0, 0.00, 0, 0.00, 0, 1, 0, 0],
    [3, 1.00, 20, 0.00, 25, 0.00, 0, 1, 0, 0], [30, 0.00, 25, 0.00, 35, 0.00, 0, 1, 0, 0], [4, 0.00, 30, 0.00, 28, 0.00, 0, 1, 0, 0], [1, 0.00, 40, 0.00, 3, 1.00, 0, 1, 0, 0],
])


def train() -> Tree:
    return classification_tree(LABELLED[:, :-1], LABELLED[:, -1], depth=8)


def describe(found: list[Block]) -> np.ndarray:
    """The features of each block, in the order of NAMES.  Its neighbours are the nearest blocks that are no furniture."""
    x = np.zeros((len(found), len(NAMES)))
    for i, b in enumerate(found):
        x[i, 0], x[i, 1], x[i, 6], x[i, 7], x[i, 8] = b.words, b.density, b.article, b.furniture, b.heading
    for order, at in ((range(len(found)), 2), (range(len(found) - 1, -1, -1), 4)):
        near = np.zeros(2)
        for i in order:
            x[i, at : at + 2] = near
            if not x[i, 7]:
                near = x[i, 0:2]
    return x


def main_text(page: str | None, tree: Tree) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    content = tree.predict(describe(found)) >= 0.5
    return " ".join(b.text for b, keep in zip(found, content, strict=True) if keep)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    tree = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, held, first = [], 0, 0
            for i, value in enumerate(batch.column(2)):
                texts.append(main_text(value.as_py(), tree))
                held += len(texts[-1])
                if held > 8 << 20 or i == batch.num_rows - 1:
                    n = len(texts)
                    out = [batch.column(0).slice(first, n), batch.column(1).slice(first, n), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                    yield pa.RecordBatch.from_arrays(out, names=["page_id", "url", "text", "n_chars"])
                    texts, held, first = [], 0, i + 1

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html).alias("html"))
    return small_batches(rows).mapInArrow(run, "page_id long, url string, text string, n_chars long")
