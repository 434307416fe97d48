"""Main text of web pages by site style trees.

The pages of a host are merged into one tree of style nodes: a node is a path of
elements with their class, id and role.  Two entropies over the host's pages say
how important a node is:

* content: a text that stands on n of the node's m pages has entropy log_m n;
  the importance is one minus the mean entropy of the node's own texts.
* presentation: the sequences of children that the node shows, each with its
  share of pages; the importance is the entropy of those shares, to base m.

A node with l different sequences of children has the importance
(1 - gamma^l) presentation + gamma^l content; a leaf that of its content; a node
on too few pages to judge is important.  A branch is as important as the most
important node in it, and branches of low importance are cut from each page.
Every element takes part, articles and what stands in them included; plain text
elements (headings, paragraphs, lists, tables) inside an article are its flow,
so their texts are the article's own content.

Tags and roles of the HTML standard that are never article text (navigation,
footers, forms, scripts, articles inside an article and the like) are left out
whatever the tree says, and where a page has text in a ``main`` element, or else
in an ``article``, what is outside.  Names of classes and ids are no more than a prior, and only
when every part of a name is a known one.  Inside an article a name raises the
bar of importance that a branch has to reach, so text that a page has for itself
is never cut by a name there.  Outside, a branch that calls itself an advert
or comments goes once it is on enough pages to be judged, unless it holds an
article on any page of the host; a vaguer name (header, notice) raises the bar;
and on too few pages a named branch goes only if its content repeats.

The tree is built by aggregations of hashes on (node, text), pre-summed before
they shuffle, so a host of any size meets as one row a text.  The nodes to cut
are broadcast if they are few; beyond that a page gets its own by a join salted
for hot hosts.

Elements nested deeper than ``DEPTH`` levels belong to the style node above
them; their text counts as any other.  Null and empty pages give the empty text;
a null url is a host by itself, as are urls without a host.  Repeated rows give
repeated results; pages with the same main text count once in the tree.  Other
columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import blake2b
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, parallelism, stash

#: Fixed values of the HTML standard: elements whose content is raw text, elements without content, and elements that start a block.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements that are never part of an article.
NEVER = frozenset("head script style noscript template nav footer aside form menu button select option input textarea iframe object svg canvas dialog title xmp noembed noframes search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
#: Text elements that are an article's flow if they have no class, id or role.
FLOW = frozenset("h1 h2 h3 h4 h5 h6 p ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption hgroup".split())
P_ENDS = BLOCK - frozenset("caption tbody td tfoot th thead tr html body".split())
#: Open elements that end when one of the named kind starts, unless one of SCOPES has begun since.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr")}
SCOPES = frozenset("ul ol dl table select div article section".split())

#: Names of branches that aren't article text, and names that only say so where the content repeats too.
FIRM = frozenset("ad ads advert adverts advertisement advertising adslot adbox sponsor sponsored nav navbar navigation breadcrumb breadcrumbs sidebar comment comments disqus footer newsletter widget pagination pager cookie cookies gdpr toolbar topbar".split())
SOFT = frozenset("header masthead banner notice notices announcement copyright disclaimer menu related recommended share sharing promo popup modal overlay signup subscribe consent".split())
NEUTRAL = frozenset("site page main left right top bottom primary secondary list area block box bar container wrapper inner outer global links buttons form item items unit slot posts articles thread section".split())

TOKENS = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|$)|[^<]+|<", re.DOTALL)
#: Tags up to the next ``>``: for what follows a quote that is never closed.
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)", re.DOTALL)
ATTRIBUTES = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.DOTALL)
SPACE = re.compile(r"\s+")
#: What names say of a node, weakest first: any inside an article, and the two kinds outside.
INSIDE, SOFT_OUTSIDE, SURE = 1, 2, 3
#: Where a block stands.
ARTICLE, MAIN = 1, 2
#: Levels of style nodes below a host.
DEPTH = 64
MASK = (1 << 64) - 1


@dataclass(frozen=True)
class SiteParams:
    #: Branches of less importance are cut; branches with a soft name below the second bar.
    least: float = 0.3
    named: float = 0.9
    #: Distinct pages that a node must be on to be judged.
    pages: int = 3
    gamma: float = 0.9
    #: Most nodes (of 8 bytes) that are broadcast.
    broadcast_nodes: int = 1 << 20
    #: Without the tree only tags and roles decide.
    tree: bool = True


def _hash(s: str) -> int:
    return int.from_bytes(blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _chain(a: int, b: int) -> int:
    """A signed 64-bit hash of a hash and what follows it."""
    x = ((a * 0x9E3779B97F4A7C15) ^ (b & MASK)) * 0xD6E8FEB86659FD93 & MASK
    x ^= x >> 32
    return x - (1 << 64) if x >> 63 else x


@lru_cache(maxsize=20_000)
def name_level(name: str) -> int:
    """What one class or id says: 2 never an article's text, 1 perhaps not, 0 nothing."""
    parts = [p for p in re.split(r"[-_\d]+", re.sub("(?<=[a-z])(?=[A-Z])", "-", name).lower()) if p]
    known = [p for p in parts if p not in NEUTRAL]
    if not known or not all(p in FIRM or p in SOFT for p in known):
        return 0
    return 2 if any(p in FIRM for p in known) else 1


@lru_cache(maxsize=20_000)
def _style(tag: str, given: str) -> tuple[int, bool, bool, int]:
    """An element's style as a hash, whether it is marked (class, id, role), whether it is never article text, and what its names say."""
    if not given.strip("/ \n\t\r"):
        return _hash(tag), False, tag in NEVER, 0
    a = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTES.finditer(given)}
    never = tag in NEVER or a.get("role", "").lower() in ROLES
    level = 0
    if tag not in ("html", "body", "main"):
        never |= "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
        level = max((name_level(x) for x in f"{a.get('class', '')} {a.get('id', '')}".split()), default=0)
    mark = re.sub(r"\d{2,}", "0", ".".join(a[k] for k in ("class", "id", "role") if a.get(k)))
    return _hash(f"{tag}.{mark}" if mark else tag), bool(mark), never, level


def style_of(tag: str, given: str) -> tuple[int, bool, bool, int]:
    # Long attributes aren't kept.
    return _style(tag, given) if len(given) < 300 else _style.__wrapped__(tag, given)


@dataclass
class Page:
    """The text blocks of a page and the style nodes they stand in."""

    #: (text, number of its node, never, inside an article or a main element)
    blocks: list[tuple[str, int, bool, int]] = field(default_factory=list)
    #: Of each node: hash, number of the node above (-1: none), levels below the host, what its names say.
    ids: list[int] = field(default_factory=list)
    above: list[int] = field(default_factory=list)
    level: list[int] = field(default_factory=list)
    said: list[int] = field(default_factory=list)
    #: (number of a node, hash of the sequence of its children)
    shapes: set[tuple[int, int]] = field(default_factory=set)
    numbers: dict[int, int] = field(default_factory=dict)

    def node(self, above: int, style: int, said: int) -> int:
        at = _chain(self.ids[above], style) if above >= 0 else style
        if at in self.numbers:
            n = self.numbers[at]
            self.said[n] = min(self.said[n], said)
            return n
        self.numbers[at] = n = len(self.ids)
        self.ids.append(at)
        self.above.append(above)
        self.level.append(self.level[above] + 1 if above >= 0 else 0)
        self.said.append(said)
        return n

    def chain(self, n: int) -> list[int]:
        """Hashes of a node and those above it, the host left out."""
        found = []
        while self.above[n] >= 0:
            found.append(self.ids[n])
            n = self.above[n]
        return found


class _Open:
    """An open element."""

    __slots__ = ("tag", "node", "own", "never", "inside", "shape")

    def __init__(self, tag: str, node: int, own: bool, never: int, inside: int):
        self.tag, self.node, self.own, self.never, self.inside, self.shape = tag, node, own, never, inside, 0


def parse(html: str | None, host: int = 0) -> Page:
    """The blocks of a page in order, with references decoded and white space made single; linear in the page's length."""
    page = Page()
    root = _Open("", page.node(-1, host, 0), False, 0, 0)
    stack, open_at, scopes = [root], {}, [0]
    text: list[str] = []
    owner, blank = root, True

    def flush() -> None:
        nonlocal blank
        if not blank:
            page.blocks.append((SPACE.sub(" ", "".join(text)).strip(), owner.node, owner.never > 0, owner.inside))
        text.clear()
        blank = True

    def close(k: int) -> None:
        """End the open elements from place k on."""
        nonlocal owner
        if any(e.tag in BLOCK or e.never != stack[k - 1].never or e.own for e in stack[k:]):
            flush()
        while len(stack) > k:
            e = stack.pop()
            open_at[e.tag].pop()
            if e.tag in SCOPES:
                scopes.pop()
            if e.own and e.shape:
                page.shapes.add((e.node, e.shape))
        owner = stack[-1]

    html, at, tokens = html or "", 0, TOKENS
    while at < len(html):
        m = tokens.match(html, at) or TOKENS.match(html, at)
        if m[0] == "<" and (loose := LOOSE.match(html, at)):  # a quote that isn't closed: from here on tags end at the next bracket
            m, tokens = loose, LOOSE
        at, tag = m.end(), m[2]
        if tag is None:
            token = m[0]
            if token[0] != "<" or token == "<":
                text.append(unescape(token))
            elif token.startswith("<![CDATA["):
                text.append(token[9:].removesuffix("]]>"))
            else:
                continue
            blank &= not text[-1].strip()
            continue
        tag = tag.lower()
        if m[1]:
            if open_at.get(tag):
                close(open_at[tag][-1])
            elif tag == "p":
                flush()
            elif tag == "br":
                text.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                text.append(" ")
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])", re.IGNORECASE).search(html, at)
            at = html.find(">", end.end()) + 1 or len(html) if end else len(html)
            continue
        if tag in P_ENDS and open_at.get("p"):
            close(open_at["p"][-1])
        if tag in CLOSES:
            ends = [open_at[t][-1] for t in CLOSES[tag] if open_at.get(t) and open_at[t][-1] > scopes[-1]]
            if ends:
                close(min(ends))
        style, marked, never, level = style_of(tag, m[3])
        up, block = stack[-1], tag in BLOCK
        starts = tag in ("article", "main") and not up.inside
        inside = up.inside or (MAIN if tag == "main" else ARTICLE if starts else 0)
        # 1: never article text unless an article starts inside; 2: never.
        never = 2 * (never or (tag == "article" and bool(open_at.get("article")))) or int(tag == "header" and not up.inside)
        held = 0 if starts and up.never == 1 else up.never
        if starts:  # what holds an article isn't what its name says
            n = up.node
            while n >= 0:
                page.said[n], n = 0, page.above[n]
        said = 0 if not level else (SURE if level == 2 and starts else 0) if tag in ("article", "main") else INSIDE if inside else SURE if level == 2 else SOFT_OUTSIDE
        own = tag not in ("html", "body") and page.level[up.node] < DEPTH and (marked if inside and not starts and tag in FLOW else block or bool(level))
        if block or own or never > held:
            flush()
        up.shape = _chain(up.shape, style) if block or own else up.shape
        node = page.node(up.node, style, said) if own else up.node
        e = _Open(tag, node, own, max(held, never), inside)
        open_at.setdefault(tag, []).append(len(stack))
        if tag in SCOPES:
            scopes.append(len(stack))
        stack.append(e)
        if blank:
            owner = e
    flush()
    close(1)
    return page


def candidates(page: Page) -> list[tuple[str, int, bool, int]]:
    """The blocks that stay if the tree cuts none: those in a main element, else those in articles, else all."""
    within = max((inside for _, _, never, inside in page.blocks if not never), default=0)
    return [b for b in page.blocks if not b[2] and b[3] >= within]


def main_text(page: Page, cut: set[int] | frozenset[int]) -> str:
    """The blocks that stay when the named nodes go, joined by empty lines."""
    gone: list[bool] = []
    for at, above in zip(page.ids, page.above):
        gone.append(above >= 0 and (at in cut or gone[above]))
    return "\n\n".join(b[0] for b in candidates(page) if not gone[b[1]])


def page_host(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    return m[1].lower() if m else f"?{url}"


#: What a page tells of the tree: kind 0 a text of a node, 1 a sequence of children, 2 the node itself with what its names say and those above.
SEEN = "host bigint, page bigint, node bigint, kind int, value bigint, chain array<bigint>"
TEXT, SHAPE, NODE = 0, 1, 2


def style_rows(pages: DataFrame) -> DataFrame:
    """The rows of all pages' style nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: set[tuple] = set()
            chains: dict[int, list[int] | None] = {}
            for url, html in zip(b.column("url").to_pylist(), b.column("html").to_pylist()):
                host = _hash(page_host(url))
                found = parse(html, host)
                number = _hash("\n".join(x[0] for x in candidates(found)))
                rows |= {(host, number, found.ids[n], TEXT, _hash(t)) for t, n, _, _ in found.blocks}
                rows |= {(host, number, found.ids[n], SHAPE, s) for n, s in found.shapes}
                for n, (at, said) in enumerate(zip(found.ids, found.said)):
                    rows.add((host, number, at, NODE, said))
                    if at not in chains:
                        chains[at] = found.chain(n)
            table = list(rows)
            each = [chains.pop(r[2], None) if r[3] == NODE else None for r in table]  # once is enough
            columns = list(zip(*table)) if table else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds)), pa.array(each, pa.list_(pa.int64()))], ["host", "page", "node", "kind", "value", "chain"])

    return pages.mapInArrow(run, SEEN)


def importances(seen: DataFrame, params: SiteParams = SiteParams()) -> DataFrame:
    """host, node, m (pages), chain, said, importance and unjudged of every style node, from :func:`style_rows`.

    ``said`` is the least that the node's names say on any page; ``unjudged`` is
    the importance that two pages are enough for.
    """
    of_value = seen.where(F.col("kind") != NODE).select("node", "kind", "value", "page").distinct().groupBy("node", "kind", "value").agg(F.count("*").alias("n"))
    text, shape = F.col("kind") == TEXT, F.col("kind") == SHAPE
    n_log_n = F.col("n") * F.log("n")
    each = of_value.groupBy("node").agg(
        F.avg(F.when(text, F.log("n"))).alias("log_n"),
        F.sum(F.when(shape, F.col("n"))).alias("shown"),
        F.sum(F.when(shape, n_log_n)).alias("n_log_n"),
        F.count(F.when(shape, 1)).alias("l"),
    )
    on = seen.where(F.col("kind") == NODE).groupBy("host", "node", "page").agg(F.min("value").alias("said"))
    chains = seen.where("chain is not null").groupBy("node").agg(F.first("chain").alias("chain"))
    nodes = on.groupBy("host", "node").agg(F.count("*").alias("m"), F.min("said").alias("said")).join(chains, "node")
    content = F.coalesce(1 - F.col("log_n") / F.log("m"), F.lit(0.0))
    presentation = F.coalesce(F.least(F.lit(1.0), (F.log("shown") - F.col("n_log_n") / F.col("shown")) / F.log("m")), F.lit(0.0))
    own = F.pow(F.lit(params.gamma), F.coalesce("l", F.lit(0)))
    judged = lambda pages: F.when(F.col("m") >= pages, (1 - own) * presentation + own * content).otherwise(1.0)
    return nodes.join(each, "node", "left").select("host", "node", "m", "chain", "said", judged(params.pages).alias("importance"), judged(min(2, params.pages)).alias("unjudged"))


def nodes_to_cut(seen: DataFrame, params: SiteParams = SiteParams()) -> DataFrame:
    """The style nodes (node) whose branches go."""
    nodes = stash(importances(seen, params))
    branch = nodes.select(F.explode("chain").alias("node"), "importance", "unjudged").groupBy("node").agg(F.max("importance").alias("branch"), F.max("unjudged").alias("few"))
    told = nodes.where(F.size("chain") > 0).select("node", "m", "said").join(branch, "node")
    enough = F.col("m") >= params.pages
    low = F.when(enough, F.col("branch") < params.named).otherwise(F.col("few") < params.named)
    named = F.when(F.col("said") == INSIDE, F.col("branch") < params.named).when(F.col("said") == SOFT_OUTSIDE, low).when(F.col("said") == SURE, enough | low)
    return told.where((F.col("branch") < params.least) | F.coalesce(named, F.lit(False))).select("node")


TEXTS = "page_id bigint, url string, text string, n_chars bigint"


def _texts(b: pa.RecordBatch, cuts: Iterator) -> pa.RecordBatch:
    out = []
    for url, html, cut in zip(b.column("url").to_pylist(), b.column("html").to_pylist(), cuts):
        page = parse(html, _hash(page_host(url)))
        out.append(main_text(page, cut if isinstance(cut, frozenset) else cut(page)))
    return batch(TEXTS, b.column("page_id"), b.column("url"), out, [len(t) for t in out])


def extract_main_text(pages: DataFrame, params: SiteParams = SiteParams()) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    p = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    if not params.tree:
        return p.mapInArrow(lambda batches: (_texts(b, [frozenset()] * len(b)) for b in batches), TEXTS)
    cuts = stash(nodes_to_cut(stash(style_rows(p.select("url", "html"))), params))
    if cuts.count() <= params.broadcast_nodes:
        rows = cuts.toArrow().column("node").to_numpy() if params.broadcast_nodes else np.empty(0, np.int64)
        shipped = p.sparkSession.sparkContext.broadcast(np.sort(rows))

        def known(page: Page) -> frozenset[int]:
            held = shipped.value
            ids = np.array(page.ids, np.int64)
            at = np.searchsorted(held, ids)
            return frozenset(ids[(at < len(held)) & (held[np.minimum(at, len(held) - 1)] == ids)].tolist()) if len(held) else frozenset()

        return p.mapInArrow(lambda batches: (_texts(b, [known] * len(b)) for b in batches), TEXTS)
    return _joined(p, cuts)


def _joined(p: DataFrame, cuts: DataFrame) -> DataFrame:
    """The same by joins: each page meets those of its nodes that are to go."""
    # Pages of one url and markup lose the same nodes.
    p = p.withColumn("key", F.xxhash64("url", "html"))
    n = parallelism(p)
    salts = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("salt")
    salt = lambda c: F.pmod(c, F.lit(n)).cast("int")

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = set()
            for url, html, key in zip(b.column("url").to_pylist(), b.column("html").to_pylist(), b.column("key").to_pylist()):
                rows |= {(key, at) for at in parse(html, _hash(page_host(url))).ids}
            yield batch("key bigint, node bigint", *(zip(*rows) if rows else ([], [])))

    held = p.select("url", "html", "key").mapInArrow(nodes, "key bigint, node bigint").distinct().withColumn("salt", salt(F.col("key")))
    lost = held.join(cuts.select("node", salts), ["node", "salt"]).groupBy("key").agg(F.collect_set("node").alias("nodes")).select("key", "nodes", salts)
    # Repeated rows are dealt apart by their numbers.
    joined = p.withColumn("salt", salt(F.monotonically_increasing_id())).join(lost, ["key", "salt"], "left").select("page_id", "url", "html", "nodes")
    return joined.mapInArrow(lambda batches: (_texts(b, [frozenset(x or ()) for x in b.column("nodes").to_pylist()]) for b in batches), TEXTS)
