"""Main text of web pages: a site style tree per host, and what page structure says on its own.

All pages of a host are merged into one site style tree. Its element nodes stand for a place in the page, its style nodes for the sequence
of child elements (tag and names) that pages show there; a run of like children is one place of the sequence, an element without text none.
Pages share an element's node if they show the same sequences all the way down to it. The importance of

- a leaf is 1 less the mean entropy of its text blocks over the pages: 0 if all pages share the same blocks, 1 if each has its own;
- an inner node with styles i, shown by shares p_i of m pages, is (1 - g^l) * -sum(p_i * log_m(p_i)) + g^l * sum(p_i * importance of i), where
  l is the number of styles, g = 0.9 and a style is worth the mean of its elements; a style or element of one page is worth 1.

A node is noise if its importance and that of all nodes below it are low, in enough pages.

The entropy cannot tell a menu with other words on each page from an article, nor an article copied over a whole site from a menu. So
structure decides too: elements whose tag, role or class names navigation, adverts, forms and the like are left out, and where a page
has an article or main element, the text is what stands there. The tree prunes inside such an element only what at least half of the
host's pages with that element show, never a heading alone, nothing if the element is noise as a whole (a copied article), and nothing if half or more of the
element's text would go. Pages without one are pruned by the tree of their host wherever it says so. What structure leaves out is part of
the tree all the same.

Names are weaker evidence than tags. They never drop an article or main element, nor an element with more than half of the page's text;
such a page is read a second time with that element kept, and without an article or main the tree decides on it. A word after has, with,
without or no (``has-sidebar``) says what the page has, not what the element is.

Only (node, style or block) hashes are shuffled, counted by partial aggregates, so a host with a third of all pages is no larger group than
its styles; pages meet their noise nodes by one join on id and html hash.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser
from itertools import groupby, takewhile
from operator import attrgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoevents.llm.common import batches, cut
from geoevents.session import broadcast_limit, written_bytes

#: Branches are noise from this many pages of a host on, below this importance.
LEAST_PAGES = 8
LEAST_IMPORTANCE = 0.2
#: g above: the more styles a node has, the more its own entropy counts against what is below.
DECAY = 0.9
#: An element this deep is a leaf of the tree, with all blocks in it.
TREE_DEPTH = 64
#: The style of a text block, and of an element with nothing but text.
TEXT = 0
#: Elements open at once; the same number as in browsers.
DEEPEST = 512

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset(("script style noscript template head title nav footer aside form button select textarea label datalist dialog menu "
                     "iframe svg math canvas object video audio map").split())
BLOCKS = frozenset(("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul").split())
CONTAINERS = frozenset(("article", "main"))
#: A start tag of the key ends an open element of the values, up to the nearest scope.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
          **{t: ("p",) for t in BLOCKS - {"body", "html", "caption", "legend", "summary", "tbody", "td", "tfoot", "th", "thead", "tr", "li", "dt", "dd"}}}
SCOPES = frozenset("article aside blockquote body button caption div footer form header html main nav ol section table td th ul dl".split())
#: Words of class, id, role or itemprop that name what is no article.
NOISE_WORDS = frozenset(("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice "
                         "notices alert sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar comment comments "
                         "disqus reply replies respond related recommended share sharing social newsletter subscribe subscription signup popup "
                         "modal overlay login pagination pager toolbar skip copyright complementary contentinfo search").split())
#: Those of them that name what readers wrote; their elements stay only where the page has no other text.
READER_WORDS = frozenset("comment comments disqus reply replies respond".split())
#: A lone article with less than this share of a page's text is a teaser; so are several that hold less than half of it together.
LEAST_SHARE, LEAST_SHARE_TOGETHER = 0.1, 0.5
PAGE_HEADER = frozenset(("header", "banner"))
#: In a name, what follows one of these tells about the page or its parts.
STATE_WORDS = frozenset("has with without no".split())
#: Elements whose text no reader sees.
UNSEEN = frozenset("script style noscript template head title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_WORDS = re.compile(r"[a-z]+")
_OPENS = re.compile(r"<([a-zA-Z][a-zA-Z0-9]*)>")
_ENDS = re.compile(r"</([a-zA-Z][a-zA-Z0-9]*)>")
#: Tags that HTMLParser must see itself, because what follows them is read in another way.
_RAW = frozenset("script style title textarea iframe noembed noframes noscript plaintext xmp".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _hash(text: str) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(text)).view(np.int64))


@lru_cache(10_000)
def _style(tag: str, names: frozenset[str]) -> int:
    return _hash("\0".join((tag, *sorted(names))))


@lru_cache(10_000)
def _names(said: str) -> tuple[frozenset[str], frozenset[str]]:
    """All words of the names, and those that say what the element is."""
    said = re.sub(r"([a-z])([A-Z])", r"\1-\2", said)
    tokens = [_WORDS.findall(token) for token in said.lower().split()]
    return frozenset(w for words in tokens for w in words), frozenset(w for words in tokens for w in takewhile(lambda x: x not in STATE_WORDS, words))


@dataclass(eq=False, slots=True)
class Element:
    """A block element of a page, or a text block in it. ``path`` has its nodes in the style tree, its own first, once ``grow`` was called."""

    style: int
    depth: int
    text: str = ""
    children: list[Element] = field(default_factory=list)
    path: tuple[int, ...] = ()


@dataclass(slots=True)
class Node:
    """An open element; all but the tag also hold for what is inside. ``element`` is the innermost block element, ``dropped`` says that it is
    noise by tag or name, ``noise`` that of tags and hidden elements, ``unseen`` is a script's; ``container`` is the number of the outermost
    article or main around, 0 if there is none; ``named`` has the numbers of the open elements that are noise by their names alone."""

    tag: str
    element: Element
    noise: bool = False
    container: int = 0
    named: tuple[int, ...] = ()
    dropped: bool = False
    unseen: bool = False


@dataclass(slots=True)
class Block:
    """A text block: its words, its place in the page, the number of the outermost article or main that holds it, 0 if none does, that one's
    element, and whether it is a heading."""

    text: str
    element: Element
    container: int
    holder: Element | None
    heading: bool

    @property
    def path(self) -> tuple[int, ...]:
        return self.element.path

    def inside(self) -> tuple[int, ...]:
        """Its nodes within its container, but not a heading's own."""
        nodes = tuple(takewhile(lambda node: node != self.holder.path[0], self.path)) if self.holder.path else self.path
        return nodes[1:] if self.heading else nodes


@dataclass
class PageReader(HTMLParser):
    """Blocks of a page in order. Follows end tags that are left out, and takes whatever follows a page that breaks off.

    Elements are numbered by their start tags; those in ``keep`` are no noise by their names. ``total`` counts the characters outside
    tag noise, ``held`` those in each element that is noise by names, ``around`` has those of them with an article inside.
    ``mains`` are the outermost containers that are a main element, ``readers`` the elements whose names say that readers wrote them."""

    stack: list[Node] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    words: list[str] = field(default_factory=list)
    keep: frozenset[int] = frozenset()
    number: int = 0
    total: int = 0
    held: dict[int, int] = field(default_factory=dict)
    around: set[int] = field(default_factory=set)
    mains: set[int] = field(default_factory=set)
    readers: set[int] = field(default_factory=set)
    holders: dict[int, Element] = field(default_factory=dict)
    root: Element = field(default_factory=lambda: Element(TEXT, 0))

    def __post_init__(self):
        super().__init__(convert_charrefs=True)
        self.bottom = Node("", self.root)

    def updatepos(self, i: int, j: int) -> int:  # lines are not counted
        return j

    def parse_starttag(self, i: int) -> int:
        plain = _OPENS.match(self.rawdata, i)
        if not plain or (tag := plain[1].lower()) in _RAW:
            return super().parse_starttag(i)
        self.lasttag = tag
        self.handle_starttag(tag, [])
        return plain.end()

    def parse_endtag(self, i: int) -> int:
        plain = None if self.cdata_elem else _ENDS.match(self.rawdata, i)
        if not plain:
            return super().parse_endtag(i)
        self.handle_endtag(plain[1].lower())
        return plain.end()

    def _flush(self) -> None:
        if not self.words:
            return
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            top = self.stack[-1] if self.stack else self.bottom
            part = Element(TEXT, top.element.depth + 1, text)
            top.element.children.append(part)
            if not top.dropped:
                heading = next((n.tag for n in reversed(self.stack) if n.tag in BLOCKS), "") in HEADINGS
                self.blocks.append(Block(text, part, top.container, self.holders.get(top.container), heading))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag in CLOSES:
            self._end(CLOSES[tag])
        if tag in BLOCKS:
            self._flush()
        elif tag in VOID:
            self.words.append(" ")
        if tag in VOID:
            return
        if len(self.stack) >= DEEPEST:  # as browsers do: deeper elements become siblings, and no text is lost
            self._flush()
            self.stack.pop()
        top = self.stack[-1] if self.stack else self.bottom
        names, own = _names(" ".join(a.get(k) or "" for k in ("class", "id", "role", "itemprop"))) if a else (frozenset(), frozenset())
        self.number += 1
        hidden = "hidden" in a or a.get("aria-hidden") == "true" or bool(_HIDDEN.search(a.get("style") or ""))
        whole = tag in ("html", "body")
        noise = not whole and (tag in SKIPPED or hidden or tag == "header" and not top.container)
        is_main, named = tag == "main" or a.get("role") == "main", top.named
        if is_main:
            named = ()
        elif tag == "article":
            self.around.update(named)
        elif not whole and self.number not in self.keep and (own & NOISE_WORDS or own & PAGE_HEADER and not top.container):
            named = (*named, self.number)
            if own & READER_WORDS:
                self.readers.add(self.number)
        element, dropped = top.element, top.dropped
        if tag in BLOCKS:
            dropped = top.noise or noise or bool(named)
            if element.depth < TREE_DEPTH:
                element = Element(_style(tag, names), top.element.depth + 1)
                top.element.children.append(element)
        container = top.container or (self.number if not noise and (tag in CONTAINERS or is_main) else 0)
        if container == self.number:
            self.holders[container] = element
            if is_main:
                self.mains.add(container)
        self.stack.append(Node(tag, element, top.noise or noise, container, named, dropped, top.unseen or tag in UNSEEN))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _end(self, tags: tuple[str, ...]) -> None:
        """End the nearest open element of these tags, if no scope stands between."""
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].tag in tags:
                self._flush()
                del self.stack[k:]
                return
            if self.stack[k].tag in SCOPES:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].tag == tag:
                if any(n.tag in BLOCKS for n in self.stack[k:]):
                    self._flush()
                del self.stack[k:]
                return
            if tag not in BLOCKS and tag not in SKIPPED and self.stack[k].tag in BLOCKS:
                return

    def handle_data(self, data: str) -> None:
        top = self.stack[-1] if self.stack else self.bottom
        if top.noise:
            if top.dropped and not top.unseen:
                self.words.append(data)
            return
        n = len("".join(data.split()))
        self.total += n
        for k in top.named:
            self.held[k] = self.held.get(k, 0) + n
        if top.dropped or not top.named:
            self.words.append(data)


def read_page(html: str) -> tuple[list[Block], Element]:
    """The blocks of a page, teasers left out, and the page as elements. Names drop no element with more than half of the page's text, unless they say that readers
    wrote it; such an element stays only if nothing else has text."""
    keep: frozenset[int] = frozenset()
    last = False
    while True:
        reader = PageReader(keep=keep)
        reader.feed(html)
        reader.close()
        reader._flush()
        more = {k for k, n in reader.held.items() if 2 * n > reader.total and (last or k not in reader.readers)}
        if not any(b.container for b in reader.blocks):
            more |= reader.around  # names around it must not drop the page's only article
        if more <= keep:
            if reader.blocks or last:
                return without_teasers(reader.blocks, reader.mains), reader.root
            last = True
        keep |= more


def without_teasers(blocks: list[Block], mains: set[int]) -> list[Block]:
    """The blocks as they are if the page has a main element or its articles hold enough of its text; else the blocks outside articles."""
    sizes: dict[int, int] = {}
    for b in blocks:
        sizes[b.container] = sizes.get(b.container, 0) + len(b.text)
    inside = sum(n for k, n in sizes.items() if k)
    least = LEAST_SHARE if len(sizes.keys() - {0}) == 1 else LEAST_SHARE_TOGETHER
    if not inside or mains & sizes.keys() or inside >= least * sum(sizes.values()):
        return blocks
    return [b for b in blocks if not b.container]


def grow(host: str, page: Element) -> dict[tuple[int, int, bool], tuple[tuple[int, ...], int]]:
    """The page's part of the style tree of its host; sets the paths of the elements. Keys are (node, style, False) for each child sequence
    shown at a node and (node, block, True) for each text block of a leaf, values the nodes above and the number of places beside it."""
    def full(element: Element) -> bool:
        element.children = [c for c in element.children if c.style == TEXT or full(c)]
        return bool(element.children)

    rows = {}
    full(page)
    todo = [(_hash(host), [page], (), 0)]
    while todo:
        node, same, path, places = todo.pop()
        below: dict[tuple[int, int], tuple[int, list[Element]]] = {}
        for element in same:
            element.path = path
            runs = [(style, list(run)) for style, run in groupby(element.children, attrgetter("style"))]
            leaf = [element] if element.text else element.children if [style for style, _ in runs] == [TEXT] else []
            for c in leaf:
                c.path = path
                rows[node, _hash(c.text), True] = path[1:], places
            shown = TEXT if leaf else hash(tuple(style for style, _ in runs))  # hashes of numbers are the same in every process
            rows[node, shown, False] = path[1:], places
            if not leaf:
                for k, (_, run) in enumerate(runs):
                    below.setdefault((shown, k), (len(runs), []))[1].extend(run)
        for (shown, k), (n, run) in below.items():
            child = hash((node, shown, k))
            todo.append((child, run, (child, *path), n))
    return {key: value for key, value in rows.items() if key[0] != _hash(host)}


def main_blocks(blocks: list[Block], noise: frozenset[int] = frozenset()) -> list[str]:
    """Texts of the blocks that stay: those of articles if any block is in one, less a smaller part that is noise there, else those outside
    noise branches."""
    if not any(b.container for b in blocks):
        return [b.text for b in blocks if noise.isdisjoint(b.path)]
    blocks = [b for b in blocks if b.container]
    if noise:
        size, lost = Counter(), Counter()
        gone = [bool(b.holder.path) and b.holder.path[0] not in noise and not noise.isdisjoint(b.inside()) for b in blocks]
        for b, g in zip(blocks, gone):
            size[b.container] += len(b.text)
            lost[b.container] += g * len(b.text)
        blocks = [b for b, g in zip(blocks, gone) if not g or 2 * lost[b.container] >= size[b.container]]
    return [b.text for b in blocks]


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url.cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def style_tree(pages: DataFrame, url: str = "url", html: str = "html", decay: float = DECAY) -> DataFrame:
    """(host, node, above, pages, places, styles, singles, importance) of each element node that two pages or more show. ``above`` holds its
    ancestors, the nearest first, ``places`` the number of places in its child sequence. A page counts in ``pages`` for each style it shows;
    ``singles`` are the styles of one page: all below these is worth 1, so it needs no rows."""
    def work(batch: pa.RecordBatch) -> list:
        rows = Counter()
        for host, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows.update((host, node, mark, content, above, places)
                        for (node, mark, content), (above, places) in grow(host, read_page(text or "")[1]).items())
        if not rows:
            return [[] for _ in range(7)]
        hosts, nodes, marks, content, above, places = zip(*rows)
        return [[None if c else h for h, c in zip(hosts, content)], nodes, marks, content, [None if c else list(a) for a, c in zip(above, content)],
                places, list(rows.values())]

    read = pages.select(host_of(F.col(f"`{url}`")).alias("host"), F.col(f"`{html}`").cast("string").alias("html"))
    seen = batches(read, work, "host string, node bigint, mark bigint, content boolean, above array<bigint>, places int, n bigint")
    counts = seen.groupBy("node", "mark", "content", "host", "above", "places").agg(F.sum("n").alias("n"))
    style, leaf, block = ~F.col("content"), ~F.col("content") & (F.col("mark") == TEXT), F.col("content")
    nodes = counts.groupBy("node").agg(
        F.max("host").alias("host"), F.max("above").alias("above"), F.max("places").alias("places"), F.sum(F.when(style, F.col("n"))).alias("pages"),
        F.count(F.when(style, 1)).alias("styles"), F.count(F.when(style & ~leaf & (F.col("n") == 1), 1)).alias("singles"),
        F.sum(F.when(leaf, F.col("n")).otherwise(0)).alias("leaves"), F.sum(F.when(style, F.col("n") * F.log("n"))).alias("spread"),
        F.avg(F.when(block, F.log("n"))).alias("shared")).filter("pages > 1")
    entropy = 1 - F.col("spread") / (F.col("pages") * F.log("pages"))
    content = F.coalesce(1 - F.col("shared") / F.log("pages"), F.lit(0.0))
    damp = F.pow(F.lit(decay), F.col("styles"))
    own = F.when(F.col("leaves") == F.col("pages"), content).otherwise(
        (1 - damp) * entropy + damp * (F.col("leaves") * content + F.col("singles")) / F.col("pages"))
    nodes = cut(nodes.select("host", "node", "above", "pages", "places", "styles", "singles", own.alias("own")))
    # A node adds to each ancestor its own part times the weights on the way; a weight is damp * p_i / places of the style.
    share = F.log(F.col("pages") / F.col("places"))
    parents = nodes.select(F.col("node").alias("up"), (F.col("styles") * F.log(F.lit(decay)) - F.log("pages")).alias("factor"), share.alias("then"))
    way = nodes.select("node", "own", share.alias("first"), F.posexplode("above").alias("level", "up")).join(parents, "up")
    on = F.sum(F.col("factor") + F.col("then")).over(Window.partitionBy("node").orderBy("level")) - F.col("then") + F.col("first")
    below = way.select("up", (F.col("own") * F.exp(on)).alias("part")).groupBy(F.col("up").alias("node")).agg(F.sum("part").alias("part"))
    return nodes.join(below, "node", "left").select("host", "node", "above", "pages", "places", "styles", "singles",
                                                    (F.col("own") + F.coalesce("part", F.lit(0.0))).alias("importance"))


def noise_nodes(tree: DataFrame, least_pages: int = LEAST_PAGES, least_importance: float = LEAST_IMPORTANCE) -> DataFrame:
    """(node, pages) of nodes of low importance with nothing important below."""
    worth = tree.filter((F.col("importance") >= least_importance) | (F.col("singles") > 0))
    alive = worth.select(F.explode(F.concat(F.array("node"), "above")).alias("node")).distinct()
    return tree.filter(F.col("pages") >= least_pages).join(alive, "node", "left_anti").select("node", "pages")


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id_col, url, text, n_chars), one row per row of ``pages``.

    Null and empty html give an empty text; a null url counts as a host of its own. Null and repeated ids stay; an empty table gives an
    empty one; other columns are not read. A page that breaks off is read as far as it goes."""
    def nodes(batch: pa.RecordBatch) -> list:
        rows = []
        for i, (h, host, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            blocks, page = read_page(text or "")
            grow(host, page)
            held = [b for b in blocks if b.container]
            rows += {(i, h, host, node, None) for b in held for node in b.holder.path[:1]}
            rows += {(i, h, host, node, b.holder.path[0]) for b in held if b.holder.path for node in b.inside()}
            rows += {(i, h, host, node, None) for b in blocks for node in b.path if not held}
        at, *rest = zip(*rows) if rows else [[]] * 5
        return [batch.column(0).take(pa.array(at, pa.int64())), *rest]

    page_hash = F.xxhash64(F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")))
    read = pages.select(F.col(f"`{id_col}`").alias("_id"), page_hash.alias("_hash"), host_of(F.col(f"`{url}`")).alias("_host"),
                        F.col(f"`{html}`").cast("string").alias("_html"), F.col(f"`{url}`").cast("string").alias("_url"))
    kind = read.schema[0].dataType.simpleString()
    tree = cut(style_tree(pages, url, html))
    noise = cut(noise_nodes(tree))
    if noise.isEmpty():
        joined = read.select("_id", "_url", "_html", "_host", F.lit(None).cast("array<bigint>").alias("_noise"))
    else:
        of_page = (batches(read.drop("_url"), nodes, f"_id {kind}, _hash bigint, _host string, node bigint, holder bigint").join(noise, "node")
                   .join(tree.select(F.col("node").alias("holder"), F.col("pages").alias("whole")), "holder", "left")
                   .filter("holder is null or 2 * pages >= whole")
                   .groupBy(F.col("_id").alias("_i"), F.col("_hash").alias("_h"), F.col("_host").alias("_o")).agg(F.collect_set("node").alias("_noise")))
        of_page = cut(of_page)
        if written_bytes(of_page) <= broadcast_limit(pages.sparkSession):
            of_page = F.broadcast(of_page)
        same = read["_id"].eqNullSafe(of_page["_i"]) & (read["_hash"] == of_page["_h"]) & (read["_host"] == of_page["_o"])
        joined = read.join(of_page, same, "left").select("_id", "_url", "_html", "_host", "_noise")

    def work(batch: pa.RecordBatch) -> list:
        texts = []
        for h, host, n in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
            blocks, page = read_page(h or "")
            if n:
                grow(host, page)
            texts.append("\n".join(main_blocks(blocks, frozenset(n or ()))))
        return [batch.column(0), batch.column(1), texts, [len(t) for t in texts]]

    return batches(joined, work, f"`{id_col}` {kind}, `{url}` string, text string, n_chars bigint")
