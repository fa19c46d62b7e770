"""Op 5: main text of web pages by minimum-cut labelling.

A page is parsed into text blocks in page order.  A linear classifier gives each block a score for
being content; scores become terminal capacities, and smoothness edges join blocks that follow each
other, the stronger the nearer they are in the DOM, and each block to the next one with the same
parent.  The minimum cut separates content from boilerplate.

The classifier is trained here by FTRL, on the blocks of a hashed sample of about ``sample_pages``
pages whose containers name their role (``roles``).  Half of the examples are shown with all names taken
away (classes dropped, elements made for page parts as plain ``div``), so it learns the weight of text
length, links, punctuation and plain tags for pages whose containers say nothing; there the classifier and
the smoothness, thus the cut, decide.

A container made for page parts (``footer``, ``aside``, ``nav``, ``form`` ..., by element, role or class)
gives its blocks a capacity to the sink that is larger than all that could pull them the other way; named
content gets a capacity to the source above the classifier's bound.  A form, or an element that only its
class or id calls boilerplate, says nothing if it is the page's wrapper: if it holds the page's first
heading outside such parts, all named content and other blocks (of a page without a heading: every block).

Defined results: a null or empty page has empty text, as has one without text blocks; markup that is
not closed ends with its parent; scripts, styles and hidden elements are never text; a null id or url
stays; repeated rows are each extracted; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import islice
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import mincut
from .common import map_batches, texts
from .ftrl import Ftrl

# Names of HTML elements and of common page parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr
    ul""".split())
SILENT = frozenset("""script style noscript template head title svg math canvas audio video object iframe textarea select
    option button datalist""".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_ITSELF = {"li": "li", "dt": "dd", "dd": "dt", "tr": "tr", "td": "td", "th": "th"}
APART = frozenset("nav aside footer form dialog menu".split())
ROLE_APART = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NAME_APART = frozenset("""ad ads adv advert advertisement advertising sponsor sponsored sponsors promo promotion banner
    sidebar widget widgets nav navbar navigation menu submenu breadcrumb breadcrumbs footer footnav header masthead topbar
    cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login
    search social share sharing related recommended recommendations comment comments reply replies respond disqus
    pagination pager toolbar skip""".split())
NAME_CONTENT = frozenset("article articlebody post entry content story main body text".split())
NEGATES = frozenset("no not has have with without hide hides".split())     # before a part's name in a class
PLAIN = frozenset("article main section".split()) | APART | {"header"}     # shown as div without names

SIZE = 1 << 12
SAMPLE_PAGES = 2000
LEARNED = 2.0      # bound of the classifier's score
SLOPE = 8.0        # log odds for which the score is about three quarters of the bound 
CONTENT = 3.0      # score of named content; named boilerplate gets what outweighs the bound and its edges
NEXT, SAME_PARENT = 1.2, 0.8
WORDS = re.compile(r"[a-z]+")


def words(value: str) -> set[str]:
    """The words of class or id names, without those that a name negates, like no-sidebar."""
    out: set[str] = set()
    for name in value.split():
        parts = WORDS.findall(name)
        if parts and parts[0] not in NEGATES:
            out.update(parts)
    return out


class Element:
    __slots__ = ("tag", "parent", "depth", "names", "role", "hidden", "number")

    def __init__(self, tag, attrs, parent, number):
        given = {k: (v or "").lower() for k, v in attrs}
        self.tag, self.parent, self.number = tag, parent, number
        self.depth = parent.depth + 1 if parent else 0
        self.names = frozenset(words(f"{given.get('class', '')} {given.get('id', '')} {given.get('itemprop', '')}"))
        self.role = given.get("role", "")
        self.hidden = ("hidden" in given or given.get("aria-hidden") == "true"
                       or "display:none" in given.get("style", "").replace(" ", ""))


class Block:
    __slots__ = ("text", "linked", "element")

    def __init__(self, text, linked, element):
        self.text, self.linked, self.element = text, linked, element


class Parser(HTMLParser):
    """Text blocks of a page: text between the borders of block elements, character references decoded,
    white space as single spaces."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.stack = [Element("#page", [], None, 0)]
        self.elements = list(self.stack)      # in page order, so parents come first
        self.open: dict[str, int] = {}
        self.silent = 0
        self.links = 0
        self.parts: list[str] = []
        self.linked = 0
        self.count = 0

    def flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append(Block(text, self.linked, next(e for e in reversed(self.stack) if e.tag in BLOCK or e.tag == "#page")))
        self.parts, self.linked = [], 0

    def pop(self, at: int):
        if any(e.tag in BLOCK for e in self.stack[at:]):
            self.flush()
        for e in self.stack[at:]:
            self.silent -= e.tag in SILENT or e.hidden
            self.links -= e.tag == "a"
            self.open[e.tag] -= 1
        del self.stack[at:]

    def find(self, tags, stop=frozenset()) -> int:
        if not any(self.open.get(t) for t in tags):
            return 0
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                return i
            if self.stack[i].tag in stop:
                break
        return 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            at = self.find({"p"} | HEADING if tag in HEADING else {"p"}, BLOCK - {"p"} - HEADING)
            if at:
                self.pop(at)
            self.flush()
        if tag in CLOSES_ITSELF:
            at = self.find({tag, CLOSES_ITSELF[tag]}, {"ul", "ol", "dl", "table"})
            if at:
                self.pop(at)
        if tag == "br" or tag in ("td", "th"):
            self.parts.append(" ")
        if tag in VOID:
            return
        self.count += 1
        e = Element(tag, attrs, self.stack[-1], self.count)
        self.stack.append(e)
        self.elements.append(e)
        self.open[tag] = self.open.get(tag, 0) + 1
        self.silent += tag in SILENT or e.hidden
        self.links += tag == "a"

    def handle_endtag(self, tag):
        if tag in BLOCK or tag in SILENT:
            at = self.find({tag})
            if at:
                self.pop(at)
        else:   # an inline end closes its own element only
            at = self.find({tag}, BLOCK)
            if at:
                e = self.stack.pop(at)
                self.open[tag] -= 1
                self.silent -= e.hidden
                self.links -= tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK:
            self.handle_endtag(tag)

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())


def parse(html: str) -> Parser:
    parser = Parser()
    try:
        parser.feed(html)
        parser.close()
    except AssertionError:   # the parser's own check of broken declarations: keep what was read
        pass
    parser.flush()
    return parser


def blocks_of(html: str) -> list[Block]:
    return parse(html).blocks


def chain(e: Element) -> Iterator[Element]:
    while e is not None and e.tag != "#page":
        yield e
        e = e.parent


def content(e: Element) -> bool:
    """Named as content."""
    return e.tag in ("article", "main") or e.role in ("main", "article") or e.tag not in ("body", "html") and bool(e.names & NAME_CONTENT)


def made_apart(e: Element) -> bool:
    """An element made for page parts."""
    return e.tag in APART or e.role in ROLE_APART or e.tag == "header"


def wrappers(page: Parser) -> list[bool]:
    """Per element: it holds the page's first heading outside page parts, all blocks in named content and
    other blocks; of a page without a heading, every block."""
    n = len(page.elements)
    apart, says = [False] * n, [False] * n
    for e in page.elements[1:]:
        up = e.parent.number
        apart[e.number] = apart[up] or made_apart(e) and e.tag != "form" and e.role != "form"
        says[e.number] = says[up] or content(e)
    held, named, headed = [0] * n, [0] * n, [0] * n
    first = next((b for b in page.blocks if b.element.tag in HEADING and not apart[b.element.number]), None)
    for b in page.blocks:
        held[b.element.number] += 1
        named[b.element.number] += says[b.element.number]
        headed[b.element.number] += b is first
    for e in reversed(page.elements[1:]):
        for count in (held, named, headed):
            count[e.parent.number] += count[e.number]
    if first is None:
        return [h == held[0] for h in held]
    return [headed[i] > 0 and named[i] == named[0] and held[i] > 1 for i in range(n)]


def roles(page: Parser) -> list[int]:
    """Per block 1 content, -1 boilerplate, 0 not said, by the names of its containers: elements made for
    page parts decide first, then the innermost container whose name says something.  The heading of named
    content may stand in a header.  One pass over the elements, parents first."""
    wide, n = wrappers(page), len(page.elements)
    # each for all blocks, and for headings
    hard, near, inside = [(False, False)] * n, [(0, 0)] * n, [False] * n
    for e in page.elements[1:]:
        i, up = e.number, e.parent.number
        inside[i] = inside[up] or content(e)
        form = (e.tag == "form" or e.role == "form") and e.role in ("", "form")
        own = made_apart(e) and not (form and wide[i])
        lenient = e.tag == "header" and inside[i] and e.role not in ROLE_APART
        hard[i] = (hard[up][0] or own, hard[up][1] or own and not lenient)
        near[i] = near[up]
        if e.tag not in ("body", "html"):
            apart = frozenset() if wide[i] else e.names & NAME_APART
            says = 1 if content(e) else 0
            title = apart <= {"header", "banner"} and inside[i]
            plain = -1 if apart else says or near[up][0]
            near[i] = (plain, (says or near[up][1]) if title else plain)
    out = []
    for b in page.blocks:
        i, heading = b.element.number, b.element.tag in HEADING
        out.append(-1 if hard[i][heading] else near[i][heading])
    return out


def features(block: Block, named: bool = True) -> np.ndarray:
    """Hashed features: sizes, links and sentence marks in steps, tags, and the names of the near
    containers unless these are to be left out."""
    text, n = block.text, len(block.text)
    marks = sum(text.count(c) for c in ".!?;,")
    tag = lambda e: "div" if not named and e.tag in PLAIN else e.tag
    names = [f"n{int(math.log2(n + 1))}", f"l{int(4 * min(1.0, block.linked / n))}", f"m{min(8, marks)}",
             f"t{tag(block.element)}", f"e{text[-1] in '.!?'}", f"w{min(12, text.count(' ') // 4)}"]
    for e in islice(chain(block.element), 4):
        names.append("a" + tag(e))
        if named:
            names += ["c" + name for name in e.names]
    return np.unique(np.array([0] + [1 + xxhash.xxh32_intdigest(x) % (SIZE - 1) for x in names]))


def edges(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness: neighbours by their distance in the DOM, and next blocks with the same parent."""
    out, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            x, y, steps = blocks[i - 1].element, b.element, 0
            while x is not y:
                if x.depth < y.depth:
                    x, y = y, x
                x = x.parent
                steps += 1
            out.append((i - 1, i, NEXT / (1 + steps / 2)))
        up = b.element.parent.number if b.element.parent else -1
        if up in last:
            out.append((last[up], i, SAME_PARENT))
        last[up] = i
    return out


def scores_of(page: Parser, weights: np.ndarray, links: list[tuple[int, int, float]]) -> list[float]:
    """Terminal capacities: positive to the source (content), negative to the sink."""
    pull = [0.0] * len(page.blocks)
    for a, b, cap in links:
        pull[a] += cap
        pull[b] += cap
    out = []
    for b, r, p in zip(page.blocks, roles(page), pull):
        learned = LEARNED * math.tanh(float(weights[features(b, bool(r))].sum()) / SLOPE)
        out.append(learned + (CONTENT if r > 0 else 0.0) if r >= 0 else -(LEARNED + p + 1.0))
    return out


def main_text(html: str, weights: np.ndarray) -> str:
    page = parse(html)
    if not page.blocks:
        return ""
    links = edges(page.blocks)
    keep = mincut.labels(scores_of(page, weights, links), links)
    return "\n\n".join(b.text for b, k in zip(page.blocks, keep) if k)


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        for html in texts(batch, "html"):
            page = parse(html)
            rows += [(features(b, len(rows) + i & 1), int(r > 0)) for i, (b, r) in enumerate(zip(page.blocks, roles(page))) if r]
    w = Ftrl(SIZE).fit([(at, np.ones(len(at)), y) for at, y in rows], 2).weights()
    at = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w[at], pa.float64())], names=["bucket", "w"])


def train(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, id_col: str = "page_id", html_col: str = "html") -> np.ndarray:
    """Weights of the block classifier, from a hashed sample of about ``sample_pages`` different pages."""
    share = min(1.0, sample_pages / max(1, pages.count()))
    drawn = pages.select(F.xxhash64(id_col, html_col).alias("order"), F.col(html_col).alias("html"))
    sample = (drawn.filter(F.pmod("order", F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
                   .groupBy("order").agg(F.min("html").alias("html")))       # copies of a page count once
    rows = map_batches(sample.repartition(1).sortWithinPartitions("order").select("html"), _train, "bucket bigint, w double")
    model = np.zeros(SIZE)
    got = rows.toArrow()          # one task's weights: at most SIZE rows
    model[got.column("bucket").to_numpy()] = got.column("w").to_numpy()
    return model


def _extract(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [main_text(h, model.value) for h in texts(batch, "html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()),
                                              pa.array([len(t) for t in out], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    model = pages.sparkSession.sparkContext.broadcast(train(pages, sample_pages, id_col, html_col))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).alias("html"))
    return map_batches(rows, _extract(model), "page_id bigint, url string, text string, n_chars bigint")
