"""Main text of web pages by a style tree of every site.

The pages of a host are merged into one tree. A node is a path of elements, each named by its tag and
the words of its class and id; equal neighbours are one. A node has as many styles as there are
different sequences of children below it, and texts are leaves. With m pages that hold a node,

* the presentation importance of an element is the entropy, to base m, of its styles over the pages,
* the content importance of a text leaf is 1 less the mean, over its different texts, of log_m(pages
  that hold the text),
* the composite importance is (1 - g^l) * presentation + g^l * mean of the children, l its styles,
  g = ``decay``; a node of one page is fully important.

A branch is noise if neither it nor anything below it reaches ``important`` and at least ``few_pages``
pages hold it. Pages of a host with equal text count once, so copies of an article do not make it
look like a menu.

What the markup itself says goes first (``NOISE_TAGS``, ``NOISE_WORDS``, roles, hidden elements): such
parts are never text, whatever their entropy. Inside an article or main element the plain flow
(paragraphs, headings, lists, tables without class) is always text. All else is judged by the tree. A
page with an article or main element gives what is inside; any other page gives all that is left,
without blocks that are mostly links. The headings of an article's header stay.

Text: character references decoded, white space of a block to one space, trimmed, blocks in page
order joined by a newline; a ``br`` is a space. Markup may be broken or end anywhere. Elements nested
deeper than ``LEVELS`` belong to the branch at that level. Null html is empty, a null url is the host
"". Rows are worked on one by one, so repeated ids are no matter; extra columns are ignored; an empty
table gives no rows.

In Spark: one pass of parsing writes a row per page and node; counts are aggregations whose groups
are spread by page first; a host's distinct nodes, not its pages, are streamed in tree order with
memory for one path. Pages meet only the noisy nodes that they hold themselves, and are not shuffled
while those are few.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import arrow_schema, partitions, written
from sievework.llm.urltree import host_and_path

# What tags, classes, ids and roles say by convention.
RAW_TAGS = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes"}
VOID_TAGS = set("area base br col embed hr img input link meta param source track wbr".split())
HEAD_TAGS = set("head title meta link script style base noscript template html".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
FLOW_TAGS = HEADINGS | set("p ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption".split())
BLOCK_TAGS = FLOW_TAGS | set(
    "address article aside body button center details dialog div fieldset footer form frameset header hgroup hr html legend "
    "main menu nav option section select summary head".split()
)
NOISE_TAGS = set(
    "head nav footer aside form button select option input label fieldset noscript template object svg canvas dialog menu audio video".split()
) | RAW_TAGS
MAIN_ROLES = {"main", "article"}
NOISE_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist".split())
NOISE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promoted promotion "
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager skip "
    "masthead topbar toolbar footer footers colophon copyright "
    "sidebar sidebars aside widget widgets related recommended recommendations trending popular share sharing social "
    "notice notices cookie cookies consent gdpr banner banners alert alerts popup popups modal overlay toast announcement disclaimer "
    "newsletter subscribe subscription signup login signin search form "
    "comment comments commentlist disqus respond reply replies discussion".split()
)
#: Words that count on an article or main element itself, or on the body.
MAIN_NOISE_WORDS = set("comment comments reply ad ads advert advertisement sponsored promo related teaser".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"},
}
SCOPES = {"ul", "ol", "dl", "table", "select", "article", "main", "section", "div", "body", "nav", "aside", "footer", "header", "form", "td", "th", "li", "blockquote"}
LEVELS = 64

_MARK = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass(frozen=True)
class StyleSpec:
    decay: float = 0.9
    important: float = 0.3
    few_pages: int = 5
    link_share: float = 0.5


# --- one page ----------------------------------------------------------------------------


@lru_cache(maxsize=1 << 16)
def _hash(parent: int, name: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{parent}/{name}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


@lru_cache(maxsize=1 << 14)
def _element(tag: str, attributes: str) -> tuple[str, str, bool]:
    """(name in the tree, kind: noise, header, main or "", whether it is styled) of an element."""
    found = {}
    for key, *values in _ATTRIBUTE.findall(attributes):
        found.setdefault(key.lower(), html.unescape("".join(values)))
    label = f"{found.get('class', '')} {found.get('id', '')}"
    words = sorted({w.lower() for w in _WORD.findall(label)})
    role = found.get("role", "").strip().lower()
    hidden = "hidden" in found or found.get("aria-hidden", "").strip().lower() == "true" or _HIDDEN.search(found.get("style", ""))
    name = ".".join([tag, *words])
    name = re.sub(r"[^a-z0-9.-]", "_", name)
    if len(name) > 48:
        name = f"{tag[:16]}.{_hash(0, name) & (2**64 - 1):x}"
    main = tag in ("article", "main") or role in MAIN_ROLES or found.get("itemprop") == "articleBody"
    if tag in NOISE_TAGS or hidden or role in NOISE_ROLES:
        kind = "noise"
    elif tag in ("html", "body") or main:
        kind = "noise" if main and MAIN_NOISE_WORDS & set(words) else "main" if main else ""
    elif NOISE_WORDS & set(words):
        kind = "noise"
    else:
        kind = "header" if tag == "header" or "header" in words else ""
    return name, kind, bool(words)


@dataclass
class Node:
    path: str
    parent: int
    judged: bool
    children: dict[int, None] = field(default_factory=dict)
    texts: set[int] = field(default_factory=set)


@dataclass
class _Open:
    tag: str
    node: int
    path: str
    level: int
    noise: int  # 0 text, 1 an article's header, 2 noise
    main: bool
    flow: bool  # plain flow of an article so far
    link: bool


class Page:
    """Text blocks and tree nodes of one page; branches in ``noisy`` are left out."""

    def __init__(self, text: str, host: str = "", noisy: frozenset[int] = frozenset(), spec: StyleSpec = StyleSpec()):
        self.nodes: dict[int, Node] = {}
        self.spec, self.noisy = spec, noisy
        root = _hash(0, host)
        self.stack = [_Open("", root, "", 0, 0, False, False, False)]
        self.opened: Counter[str] = Counter()
        self.blocks: list[tuple[str, bool, int, int]] = []  # text, inside an article, characters, of them in links
        self._begin()
        at = 0
        while at < len(text):
            mark = _MARK.search(text, at)
            if mark is None:
                self._text(text[at:])
                break
            if mark.start() > at:
                self._text(text[at : mark.start()])
            at = mark.end()
            if mark[2] is None:
                continue
            tag = mark[2].lower()
            if mark[1]:
                self._close(tag)
                continue
            self._open(tag, mark[3])
            if tag in RAW_TAGS:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(text, at)
                at = end.end() if end else len(text)
                self._close(tag)
        self._end()

    # blocks

    def _begin(self) -> None:
        self.parts: list[str] = []
        self.inside, self.size, self.linked = False, 0, 0

    def _end(self) -> None:
        line = " ".join("".join(self.parts).split())
        if line:
            self.blocks.append((line, self.inside, self.size, self.linked))
        self._begin()

    def _text(self, raw: str) -> None:
        top = self.stack[-1]
        text = html.unescape(raw)
        words = text.split()
        if words:
            leaf = _hash(top.node, "#text")
            if leaf not in self.nodes:
                self.nodes[leaf] = Node(f"{top.path} #text".lstrip(), top.node, False)
                self._child(top.node, leaf)
            if not (top.main and top.flow and top.noise == 0):
                self.nodes[leaf].texts.add(_hash(0, " ".join(words)))
        if top.noise:
            return
        self.parts.append(text)
        if words:
            size = sum(map(len, words))
            self.inside |= top.main
            self.size += size
            self.linked += size if top.link else 0

    def _child(self, parent: int, child: int) -> None:
        if parent in self.nodes:
            self.nodes[parent].children[child] = None

    # elements

    def _pop(self, size: int) -> None:
        if any(e.tag in BLOCK_TAGS for e in self.stack[size:]):
            self._end()
        for e in self.stack[size:]:
            self.opened[e.tag] -= 1
        del self.stack[size:]

    def _close(self, tag: str) -> None:
        if tag == "br":
            self._text(" ")
        if not self.opened[tag]:
            return
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at].tag == tag:
                self._pop(at)
                return
            # An inline end tag does not close the block around it.
            if tag not in BLOCK_TAGS and self.stack[at].tag in BLOCK_TAGS:
                return

    def _imply(self, tag: str) -> None:
        """Close what the start of ``tag`` ends."""
        if tag not in HEAD_TAGS:
            for at in range(1, min(4, len(self.stack))):
                if self.stack[at].tag == "head":
                    self._pop(at)
                    break
        ends = CLOSES.get(tag, set()) | ({"p"} if tag in BLOCK_TAGS else set())
        if not any(self.opened[end] for end in ends):
            return
        for at in range(len(self.stack) - 1, 0, -1):
            own = self.stack[at].tag
            if own in ends:
                self._pop(at)
                if own == "p" or tag not in ("tr", "thead", "tbody"):
                    break
            elif own in SCOPES:
                break

    def _open(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self._text(" ")
            return
        self._imply(tag)
        if tag in BLOCK_TAGS:
            self._end()
        if tag in VOID_TAGS:
            return
        name, kind, styled = _element(tag, attributes)
        up = self.stack[-1]
        main = up.main or kind == "main"
        noise = up.noise
        if kind == "noise":
            noise = 2
        elif kind == "header":
            noise = max(noise, 1 if up.main else 2)
        elif noise == 1 and tag in HEADINGS:
            noise = 0
        inline = tag not in BLOCK_TAGS
        flow = (up.flow and not styled and (tag in FLOW_TAGS or inline)) if up.main else kind == "main"
        if up.level >= LEVELS:
            node, path, level = up.node, up.path, up.level
        else:
            node, path, level = _hash(up.node, name), f"{up.path} {name}" if up.path else name, up.level + 1
            if node not in self.nodes:
                judged = noise == 0 and kind != "main" and tag not in ("html", "body") and not (main and flow)
                self.nodes[node] = Node(path, up.node, judged)
                self._child(up.node, node)
        if node in self.noisy and self.nodes[node].judged:
            noise = 2
        self.opened[tag] += 1
        self.stack.append(_Open(tag, node, path, level, noise, main, flow, up.link or tag == "a"))

    # results

    def text(self) -> str:
        inside = any(b[1] for b in self.blocks)
        share = self.spec.link_share
        return "\n".join(t for t, own, size, linked in self.blocks if (own if inside else linked <= share * size))

    def rows(self, key: bytes, host: str) -> Iterator[tuple]:
        """key, host, node, path, style, part, judged, page, texts of every node; page stands for the text."""
        page = _hash(1, self.text())
        for node, n in self.nodes.items():
            style = _hash(2, ",".join(map(str, n.children))) if n.children else 0
            siblings = len(self.nodes[n.parent].children) if n.parent in self.nodes else 1
            yield key, host, node, n.path, style, 1.0 / siblings, n.judged, page, list(n.texts)


# --- the tree of a host ------------------------------------------------------------------

NODE_DDL = "key binary, host string, node long, path string, style long, part double, judged boolean, page long, texts array<long>"


def node_rows(keyed: DataFrame, spec: StyleSpec) -> DataFrame:
    """A row per page and node; ``keyed`` has key, host and html."""
    schema = arrow_schema(NODE_DDL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [r for k, h, t in zip(*(c.to_pylist() for c in part.columns)) for r in Page(t, h, spec=spec).rows(k, h)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return keyed.select("key", "host", "html").mapInArrow(run, NODE_DDL)


def importances(nodes: DataFrame, spec: StyleSpec = StyleSpec()) -> DataFrame:
    """host, path, node, pages, importance, top (largest importance at or below the node)."""
    names = nodes.groupBy("node").agg(F.first("host").alias("host"), F.first("path").alias("path"))
    styles = nodes.groupBy("node", "style", "page").agg(F.avg("part").alias("part"))
    styles = styles.groupBy("node", "style").agg(F.count("*").alias("c"), F.sum("part").alias("part"))
    elements = styles.groupBy("node").agg(
        F.sum("c").alias("m"), F.count("*").alias("l"), F.sum(F.col("c") * F.log("c")).alias("clogc"), F.sum("part").alias("part")
    )
    texts = nodes.filter(F.size("texts") > 0).select("node", "page", F.explode("texts").alias("text")).distinct()
    texts = texts.groupBy("node", "text").agg(F.count("*").alias("c"))
    leaves = texts.groupBy("node").agg(F.count("*").alias("n"), F.sum(F.log("c")).alias("logc"))
    table = names.join(elements, "node").join(leaves, "node", "left")
    ddl = "host string, path string, node long, pages long, importance double, top double"
    schema = arrow_schema(ddl)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come in reverse order of paths: children before their parent, which closes their sums.
        host, open_ = None, []
        for batch in batches:
            out = []
            for own, path, node, m, l, clogc, part, n, logc in zip(*(c.to_pylist() for c in batch.columns)):
                if own != host:
                    host, open_ = own, []
                parent = path.rpartition(" ")[0]
                below, top = None, 0.0
                if open_ and open_[-1][0] == path:
                    _, total, top = open_.pop()
                    below = min(1.0, total / m)
                value = importance(m, l, clogc, n, logc, below, path.endswith("#text"), spec.decay)
                top = max(top, value)
                if open_ and open_[-1][0] == parent:
                    open_[-1][1] += part * value
                    open_[-1][2] = max(open_[-1][2], top)
                else:
                    open_.append([parent, part * value, top])
                out.append((own, path, node, m, value, top))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    table = table.select("host", "path", "node", "m", "l", "clogc", "part", "n", "logc")
    table = table.repartition(partitions(nodes), "host").sortWithinPartitions("host", F.desc("path"))
    return table.mapInArrow(fold, ddl)


def importance(m: int, l: int, clogc: float, n: int | None, logc: float | None, below: float | None, leaf: bool, decay: float) -> float:
    """Composite importance of a node of m pages: l styles, or n texts; ``below`` is the mean of its children."""
    if m == 1:
        return 1.0
    if leaf:
        return 1.0 if not n else max(0.0, 1.0 - logc / math.log(m) / n)
    own = max(0.0, 1.0 - clogc / m / math.log(m))
    return own if below is None else (1 - decay**l) * own + decay**l * below


def noisy_nodes(importance: DataFrame, spec: StyleSpec = StyleSpec()) -> DataFrame:
    return importance.filter((F.col("top") < spec.important) & (F.col("pages") >= spec.few_pages)).select("node")


# --- extraction --------------------------------------------------------------------------


def extract(pages: DataFrame, spec: StyleSpec = StyleSpec()) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html)."""
    host, body = host_and_path(F.col("url"))[0], F.coalesce(F.col("html"), F.lit(""))
    # Equal pages of a host have equal nodes, so a digest of both is key enough.
    key = F.unhex(F.md5(F.concat(F.char_length(host).cast("string"), F.lit(":"), host, body)))
    keyed = pages.select("page_id", "url", host.alias("host"), key.alias("key"), body.alias("html"))
    nodes = written(node_rows(keyed, spec), "nodes")
    noisy = written(noisy_nodes(importances(nodes, spec), spec), "noisy")
    hits = nodes.filter("judged").join(noisy, "node").groupBy("key").agg(F.collect_set("node").alias("noisy"))
    hits = written(hits, "hits")  # its size is known now: few are broadcast, many are joined by key
    id_type = pages.schema["page_id"].dataType.simpleString()
    ddl = f"page_id {id_type}, url string, text string, n_chars long"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = zip(*(part.column(c).to_pylist() for c in ("host", "html", "noisy")))
                texts = [Page(t, h, frozenset(n or ()), spec).text() for h, t, n in rows]
                sizes = pa.array([len(t) for t in texts], pa.int64())
                columns = [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), sizes]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return keyed.join(hits, "key", "left").select("page_id", "url", "host", "html", "noisy").mapInArrow(run, ddl)
