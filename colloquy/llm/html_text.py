"""Main text of web pages by flat text blocks.

A page is cut at its block-level tags into a flat sequence of text blocks. A block
is told by its number of words and its link density, by those of its neighbours, and
by the kinds of elements around it; a decision tree, trained on a small labelled
table, says whether it is part of the article.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches
from .page_samples import labelled_pages

# Names of elements that end a block, that hold no text to read, and that have no end tag.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
UNREAD = frozenset("applet audio button canvas datalist embed head iframe math noembed noframes noscript object option script select style svg template textarea title video".split())
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words of names, classes, ids and roles that speak for an article, and against one.
SPEAKS_FOR = frozenset("article articlebody body bodytext blog content entry hentry main maincontent post prose story text".split())
SPEAKS_AGAINST = frozenset(
    "ad ads adsense alert aside author banner bar button complementary consent contentinfo copyright dialog disclaimer discussion disqus feedback foot footer form gdpr login menu menubar meta modal nav notice pager pagination popup privacy promo related replies reply respond search share sharing sidebar signup skip social tagline tags toolbar topbar trackbacks widget widgets"
    .split()
)
#: Beginnings of further ones.
BEGIN_AGAINST = ("advert", "breadcrumb", "comment", "cookie", "navbar", "navig", "newsletter", "promot", "sponsor", "subscri")
HEADS = frozenset("banner head header hgroup masthead".split())
#: Those that may as well name a layout with an article in it; others stand apart from one wherever they are.
LAYOUT = frozenset("author bar button form login menu menubar search sidebar skip tags toolbar topbar".split())
ITEMS = frozenset("dd dt li td th".split())
PARAGRAPHS = frozenset("blockquote figcaption p pre".split())
#: Elements that end one of their kind which is open.
ENDLESS = (("li",), ("dd", "dt"), ("td", "th"), ("tr",))

FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "hint", "against", "within", "apart", "heading", "item", "paragraph")

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HEADING = re.compile(r"h[1-6]")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|$|=)", re.I)
_NO_SHOW = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Element(NamedTuple):
    """An open element, and what holds within it: links, unread and the counts are those of all elements around."""

    name: str = ""
    #: 1 if the innermost element that hints speaks for an article, -1 if against one, 0 without.
    hint: int = 0
    #: How many elements around speak against an article, and for one; and how many are of comments, menus and the like by their names.
    against: int = 0
    within: int = 0
    apart: int = 0
    links: int = 0
    unread: int = 0


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    around: Element
    heading: bool
    item: bool
    paragraph: bool


def _tag_end(page: str, at: int) -> int:
    """Place of the > that ends the tag opened at ``at``, quoted ones passed over; that of the next > if a quote stays open; the page's length without any."""
    plain = page.find(">", at)
    if plain < 0:
        return len(page)
    i = at
    while True:
        stop = page.find(">", i)
        if stop < 0:
            return plain
        quotes = [(q, p) for q in "\"'" if (p := page.find(q, i, stop)) >= 0 and page[max(i, p - 9) : p].rstrip()[-1:] == "="] if "=" in page[i:stop] else []
        if not quotes:
            return stop
        q, p = min(quotes, key=lambda x: x[1])
        close = page.find(q, p + 1)
        if close < 0:
            return plain
        i = close + 1


def hints(name: str, attributes: str) -> tuple[int, bool, bool]:
    """What an element's name, class, id and role hint at: 1, -1 or 0; whether it may head an article; whether it stands apart from one wherever it is."""
    parts = {name}
    if attributes:
        for key, *values in _ATTRIBUTE.findall(attributes):
            value, key = next(filter(None, values), ""), key.lower()
            if key in ("class", "id", "role", "itemprop"):
                parts.update(p.lower() for p in _PART.findall(value))
            elif key == "style" and _NO_SHOW.search(value) or key == "aria-hidden" and value.lower() == "true":
                return -1, False, True
        if _HIDDEN.search(attributes):
            return -1, False, True
    if name in ("html", "body"):
        return 0, False, False
    heads = bool(parts & HEADS)
    against = {p for p in parts - HEADS if p in SPEAKS_AGAINST or p.startswith(BEGIN_AGAINST)}
    if against:
        return -1, False, bool(against - LAYOUT)
    return (1 if parts & SPEAKS_FOR else 0), heads, False


class _Reader:
    """The open elements and the block being read."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.open = [Element()]
        self.names: Counter[str] = Counter()
        self.text: list[str] = []
        self.linked = 0

    def say(self, part: str) -> None:
        top = self.open[-1]
        if not top.unread:
            part = html.unescape(part)
            self.text.append(part)
            if top.links:
                self.linked += len(part.split())

    def end_block(self) -> None:
        words = "".join(self.text).split()
        if words:
            near = [e.name for e in self.open[-4:]]
            self.blocks.append(Block(" ".join(words), len(words), min(self.linked, len(words)), self.open[-1], any(_HEADING.fullmatch(n) for n in near), any(n in ITEMS for n in near), any(n in PARAGRAPHS for n in near)))
        self.text, self.linked = [], 0

    def pop(self, depth: int) -> None:
        self.names.subtract(e.name for e in self.open[depth:])
        del self.open[depth:]

    def end(self, name: str) -> None:
        if self.names[name] > 0:
            self.pop(next(k for k in range(len(self.open) - 1, 0, -1) if self.open[k].name == name))

    def start(self, name: str, attributes: str) -> None:
        if name == "body":  # nothing of the head goes on
            self.pop(1)
        elif name in BLOCKS:  # an end that may be left out
            same = next((group for group in ENDLESS if name in group), ())
            for k in range(len(self.open) - 1, max(0, len(self.open) - 9), -1):
                at = self.open[k].name
                if at == "p" or at in same:
                    self.pop(k)
                if at in BLOCKS:
                    break
        top = self.open[-1]
        hint, heads, apart = hints(name, attributes)
        if heads and hint >= 0 and not top.within:
            hint = -1  # of the page, not of an article
        self.open.append(Element(name, hint or top.hint, top.against + (hint < 0), top.within + (hint > 0), top.apart + apart, top.links + (name == "a"), top.unread + (name in UNREAD)))
        self.names[name] += 1


def blocks_of(page: str) -> list[Block]:
    """The page's text blocks in order, those without text left out; markup may be broken in any way."""
    reader, at, n = _Reader(), 0, len(page)
    endless: set[str] = set()  # ends that do not come any more
    while at < n:
        start = page.find("<", at)
        if start < 0:
            reader.say(page[at:])
            break
        if start > at:
            reader.say(page[at:start])
        after = page[start + 1 : start + 2]
        name = _NAME.match(page, start + 1 + (after == "/"))
        if after in ("!", "?") or after == "/" and not name:  # comments, by the standard
            stop = page.find("-->", start + 2) if page.startswith("<!--", start) and "-->" not in endless else -1
            if stop < 0 and page.startswith("<!--", start):
                endless.add("-->")
            at = stop + 3 if stop >= 0 else _tag_end(page, start) + 1
            continue
        if not name:
            reader.say("<")
            at = start + 1
            continue
        tag, stop = name[0].lower(), _tag_end(page, name.end())
        at = stop + 1
        if stop == n:  # the page breaks off in a tag
            break
        if tag == "br":
            reader.text.append("\n")
            continue
        if tag in BLOCKS:
            reader.end_block()
        if after == "/":
            reader.end(tag)
        elif tag in RAW:
            found = None if tag in endless else _RAW_END[tag].search(page, at)
            if found:
                at = _tag_end(page, found.end()) + 1
            else:
                endless.add(tag)
                if tag in ("script", "style"):  # what never ends is all markup
                    break
        elif tag not in VOID:
            attributes = page[name.end() : stop]
            if tag in BLOCKS or not attributes.endswith("/"):
                reader.start(tag, attributes)
    reader.end_block()
    return reader.blocks


def features(blocks: list[Block]) -> np.ndarray:
    """A row for each block, columns by FEATURES; beyond both ends of a page stand empty blocks."""
    own = np.array([(b.words, b.linked / b.words, *b.around[1:5], b.heading, b.item, b.paragraph) for b in blocks], np.float64).reshape(-1, 9)
    beside = np.pad(own[:, :2], ((1, 1), (0, 0)))
    return np.hstack([own[:, :2], beside[:-2], beside[2:], own[:, 2:]])


@dataclass(frozen=True)
class Tree:
    """Nodes by number: the column tested (-1 in a leaf), the cut, the nodes below, the share of article blocks."""

    column: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        while (inner := self.column[node] >= 0).any():
            rows, at = np.flatnonzero(inner), node[inner]
            node[rows] = np.where(x[rows, self.column[at]] > self.cut[at], self.high[at], self.low[at])
        return self.share[node]


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 5) -> Tree:
    """A classification tree by the Gini impurity; every cut between two values is tried."""
    nodes: list[list] = []

    def descend(rows: np.ndarray, level: int) -> int:
        me, best = len(nodes), (1e-9, -1, 0.0)
        nodes.append([-1, 0.0, 0, 0, float(y[rows].mean()) if len(rows) else 0.0])
        if level < depth and len(rows) >= 2 * least and 0 < nodes[me][4] < 1:
            total, sum_all = len(rows), y[rows].sum()
            for j in range(x.shape[1]):
                order = np.argsort(x[rows, j], kind="stable")
                v, sums = x[rows[order], j], np.cumsum(y[rows[order]])
                at = np.flatnonzero(v[1:] > v[:-1]) + 1
                at = at[(at >= least) & (at <= total - least)]
                if len(at):
                    left = sums[at - 1]
                    gain = left**2 / at + (sum_all - left) ** 2 / (total - at) - sum_all**2 / total
                    k = int(gain.argmax())
                    if gain[k] > best[0] + 1e-9:
                        best = (float(gain[k]), j, float((v[at[k] - 1] + v[at[k]]) / 2))
            if best[1] >= 0:
                above = x[rows, best[1]] > best[2]
                nodes[me][:4] = best[1], best[2], descend(rows[~above], level + 1), descend(rows[above], level + 1)
        return me

    descend(np.arange(len(y)), 0)
    return Tree(*(np.array(c) for c in zip(*nodes)))


def labelled_blocks(spark: SparkSession, pages: int = 400) -> DataFrame:
    """The labelled table: page, block, FEATURES and label, of :func:`~colloquy.llm.page_samples.labelled_pages`."""
    rows = []
    for page, (text, marks) in enumerate(labelled_pages(pages)):
        found = blocks_of(text)
        if len(found) != len(marks):
            raise ValueError(f"page {page} has {len(found)} blocks and {len(marks)} labels")
        rows += [(page, i, *map(float, x), int(mark)) for i, (x, mark) in enumerate(zip(features(found), marks))]
    return spark.createDataFrame(rows, "page long, block long, " + ", ".join(f"{f} double" for f in FEATURES) + ", label int")


def train(labelled: DataFrame, most: int = 50_000, **options) -> Tree:
    """The tree of at most ``most`` rows of a labelled table (FEATURES and label); a larger table is an error."""
    got = labelled.select(*FEATURES, "label").limit(most + 1).toPandas()
    if len(got) > most:
        raise ValueError(f"the labelled table has over {most} rows")
    return grow(got[list(FEATURES)].to_numpy(np.float64), got["label"].to_numpy(np.float64), **options)


def extract(pages: DataFrame, tree: Tree) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html).

    text is the article's blocks in page order, a line each, white space in a block
    turned into single spaces; empty if no block is one. A null or empty page gives an
    empty text. Null ids and urls and repeated rows stay, other columns are ignored, an empty table gives
    none. Pages are read whole, in linear time, by a narrow map without a shuffle.
    """
    shared = pages.sparkSession.sparkContext.broadcast(tree)
    arrow = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batch: pa.RecordBatch) -> dict:
        texts = []
        for page in batch.column("html").cast(pa.string()).to_pylist():
            found = blocks_of(page or "")
            kept = shared.value.predict(features(found)) >= 0.5
            texts.append("\n".join(b.text for b, k in zip(found, kept) if k))
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": list(map(len, texts))}

    picked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_batches(picked, run, "page_id long, url string, text string, n_chars long", arrow)
