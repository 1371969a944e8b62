"""HTML main text by template deduction over the pages of a host.

Tags with their path, and text blocks with their path, are tokens. A token's
occurrence vector says how often each of the host's pages has it; the vector is
kept as a sum over pages of count times a hash of the page, which aggregates
anywhere in any order. Tokens of equal vectors form an equivalence class, on
however many of the host's pages and however often on each, from a support of
SUPPORT pages and SHARE of the host's; a lone token is none, as a sentence that
articles repeat has no vector but its own. Classes are the host's template. A page
may lack any of them, and has a class if it holds its tokens equally often and
in the class's order, turn by turn; the others are left out for that page.
Text that is itself in a class of the page is constant; what remains between
its tags are slots. The slot that holds the article is the page's article or
main element; where the markup names none, the deepest of the template's
containers on the page with nearly the most unlinked slot text.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.common import batches_of, cut, ship, strings

BATCH_BYTES = 4_000_000
#: Pages, and share of a host's pages, from which a token is taken for template rather than for copied text; the share bounds
#: a host's template by the tokens of 1 / SHARE mean pages, however many pages it has.
SUPPORT, SHARE = 3, 0.2
#: Bytes of templates up to which they are broadcast; beyond, pages are joined by host.
BROADCAST_BYTES = 8_000_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^'\">]|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*\Z|</?\Z", re.S
)
_ATTR = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg canvas object title textarea".split())
BLOCK = frozenset(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol "
    "p pre section summary table tbody td tfoot th thead title tr ul".split()
)
SKIP = frozenset("nav footer aside form button select head dialog menu".split()) | RAW
ENDS_P = BLOCK - frozenset(("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "head", "body", "title"))
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table article section div main body aside nav footer header form blockquote".split())

#: Names of classes, ids and roles that mark what isn't the article.
CHAFF = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted banner cookie cookies consent gdpr notice notices notification alert alerts popup "
    "modal overlay newsletter subscribe subscription signup paywall sidebar rail widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs masthead topbar footer colophon copyright "
    "comment comments disqus reply replies respond discussion share sharing social related recommended recommendations trending popular pagination pager login search skip toolbar outbrain taboola "
    "complementary contentinfo dialog form hidden".split()
)
#: These mark it only outside the article.
OUTER = frozenset(("header", "banner", "masthead", "topbar"))
CONTENT = frozenset(("articlebody", "article", "main", "content", "post", "entry", "story"))


def _names(attrs: dict[str, str]) -> Iterator[list[str]]:
    for key in ("class", "id", "role"):
        for name in attrs.get(key, "").split():
            yield [x for x in re.split(r"[-_:.]+|(?<=[a-z])(?=[A-Z])", name) if x]


def _is_chaff(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I):
        return True
    if tag in ("body", "html", "main"):
        return False
    for parts in _names(attrs):
        low = [x.lower() for x in parts]
        if "with" in low or low[:1] in (["has"], ["no"], ["is"]):
            continue
        for x in {low[0], low[-1]} if low else ():
            if x in CHAFF and not (in_article and x in OUTER) or x in OUTER and not in_article:
                return True
    return False


def _attrs(text: str) -> dict[str, str]:
    return {k.lower(): _html.unescape(v.strip("\"'")) for k, v in _ATTR.findall(text)} if text and not text.isspace() else {}


class Page:
    """A page's blocks in order.

    A path of tags is a node with its parent, so that deep pages stay small:
    ``keys`` has a hash of each node's whole path, equal on all pages.
    ``blocks``: (node, text, unlinked characters, number of the article or main
    element or -1, whether it is chaff). ``tags``: (node, place among the blocks).
    """

    def __init__(self, source: str):
        self.parents, self.depths, self.keys = [-1], [0], [0]
        self._nodes: dict[tuple[int, str], int] = {}
        self.blocks: list[tuple[int, str, int, int, bool]] = []
        self.tags: list[tuple[int, int]] = []
        self.kinds: list[str] = []  # of the elements that may be the article
        stack: list[tuple[str, int, bool, int]] = []  # tag, node, chaff, article
        buf: list[str] = []
        linked = at = links = 0
        path, chaff, art = 0, False, -1

        def flush() -> None:
            nonlocal linked
            if buf:
                text = " ".join("".join(buf).split())
                if text:
                    self.blocks.append((path, text, max(0, len(text) - linked), art, chaff))
                buf.clear()
                linked = 0

        # places in the stack of each tag, of scopes and of blocks: what a tag closes is found without going over the stack
        opened: dict[str, list[int]] = {}
        scopes: list[int] = []
        blocks: list[int] = []

        def nearest(*tags: str) -> int:
            """The innermost open element of these tags; -1 where a scope hides it."""
            i = max((opened[t][-1] for t in tags if opened.get(t)), default=-1)
            return -1 if scopes and scopes[-1] > i else i

        def leave(i: int) -> None:
            nonlocal path, chaff, art, links
            for x in stack[i:]:
                opened[x[0]].pop()
                links -= x[0] == "a"
            for at_ in (scopes, blocks):
                while at_ and at_[-1] >= i:
                    at_.pop()
            del stack[i:]
            _, path, chaff, art = stack[-1] if stack else ("", 0, False, -1)

        n = len(source)
        while at < n:
            m = _TOKEN.search(source, at)
            stop = m.start() if m else n
            if stop > at:
                piece = _html.unescape(source[at:stop]) if "&" in source[at:stop] else source[at:stop]
                buf.append(piece)
                if links:
                    linked += len(piece.strip())
            if not m:
                break
            at = max(m.end(), at + 1)
            tag = (m[2] or "").lower()
            if not tag:
                if m[0].startswith("<![CDATA["):
                    buf.append(m[0][9:].removesuffix("]]>"))
                continue
            if m[1]:
                if tag in BLOCK:
                    flush()
                i = opened[tag][-1] if tag in SCOPES and opened.get(tag) else nearest(tag)
                if i >= 0 and (tag in BLOCK or not (blocks and blocks[-1] >= i)):
                    leave(i)
                continue
            if tag == "br":
                buf.append(" ")
                continue
            if tag in BLOCK:
                flush()
            if tag in RAW:
                end = re.compile(rf"</{tag}\s*>|</{tag}\Z", re.I).search(source, at)
                self.tags.append((self._node(path, tag), len(self.blocks)))
                at = end.end() if end else n
                if tag not in BLOCK:
                    buf.append(" ")
                continue
            if tag in VOID:
                continue
            for ended in (("p",) if tag in ENDS_P else (), CLOSES.get(tag, ())):
                i = nearest(*ended)
                if i >= 0:
                    leave(i)
            attrs = _attrs(m[3])
            inside = art >= 0 and self.kinds[art] != "named"
            now = chaff or tag in SKIP or tag == "header" and not inside or bool(attrs) and _is_chaff(tag, attrs, inside)
            mine = art
            if not now and art < 0:
                named = any("".join(p).lower() in CONTENT or p and p[-1].lower() in CONTENT for p in _names(attrs)) or attrs.get("itemprop", "").lower() == "articlebody"
                kind = tag if tag in ("article", "main") else "main" if attrs.get("role", "").lower() == "main" else "named" if named and tag in BLOCK and tag != "body" else ""
            else:
                kind = "article" if tag == "article" and not now and art >= 0 and self.kinds[art] != "article" else ""
            if kind:
                mine = len(self.kinds)
                self.kinds.append(kind)
            mark = attrs.get("class") or attrs.get("id") or ""
            path = self._node(path, f"{tag}.{mark}" if mark else tag)
            chaff, art = now, mine
            opened.setdefault(tag, []).append(len(stack))
            for kept, of in ((scopes, SCOPES), (blocks, BLOCK)):
                if tag in of:
                    kept.append(len(stack))
            stack.append((tag, path, now, mine))
            links += tag == "a"
            if tag in BLOCK:
                self.tags.append((path, len(self.blocks)))
        flush()

    def _node(self, parent: int, name: str) -> int:
        got = self._nodes.get((parent, name))
        if got is None:
            got = self._nodes[parent, name] = len(self.keys)
            self.parents.append(parent)
            self.depths.append(self.depths[parent] + 1)
            self.keys.append(xxhash.xxh64_intdigest(f"{self.keys[parent]:x}/{name}".encode("utf-8", "surrogatepass"), 3))
        return got

    def token(self, kind: str, node: int, text: str = "") -> int:
        return int(np.uint64(xxhash.xxh64_intdigest(f"{kind}\0{self.keys[node]:x}\0{text}".encode("utf-8", "surrogatepass"), 3)).astype(np.int64))

    def free(self) -> list[int]:
        """Unlinked characters at and below each node, without chaff; a child's number is above its parent's."""
        out = [0] * len(self.keys)
        for node, _, free, _, chaff in self.blocks:
            out[node] += 0 if chaff else free
        for i in range(len(out) - 1, 0, -1):
            out[self.parents[i]] += out[i]
        return out

    def sequence(self) -> Iterator[tuple[str, int, str, int, bool]]:
        """Tags and blocks in the order of the page: kind, node, text, unlinked characters, whether it is chaff."""
        at = 0
        for i, (path, text, free, _, chaff) in enumerate(self.blocks):
            while at < len(self.tags) and self.tags[at][1] <= i:
                yield "tag", self.tags[at][0], "", 0, False
                at += 1
            yield "text", path, text, free, chaff
        for path, _ in self.tags[at:]:
            yield "tag", path, "", 0, False

    def text(self, constants: frozenset[int] = frozenset(), container: int | None = None) -> str:
        keep = [b for b in self.blocks if not b[4]]
        for kind in ("article", "main", "named"):
            sizes: dict[int, int] = {}
            for _, text, _, art, _ in keep:
                if art >= 0 and self.kinds[art] == kind:
                    sizes[art] = sizes.get(art, 0) + len(text)
            if sizes:
                best = max(sizes, key=lambda k: (sizes[k], -k))
                keep = [b for b in keep if b[3] == best]
                break
            if kind in self.kinds and kind != "named":
                return ""
        else:
            under = [False] * len(self.keys)
            for i in range(len(under)) if container else ():
                under[i] = i == container or i > 0 and under[self.parents[i]]
            inside = [b for b in keep if under[b[0]]]
            keep = inside or [b for b in keep if b[2] * 2 >= len(b[1])]
        rest = [b for b in keep if self.token("text", b[0], b[1]) not in constants] if constants else keep
        if 2 * sum(len(b[1]) for b in rest) < sum(len(b[1]) for b in keep):
            rest = keep  # the host's pages are copies of one another rather than of a template
        return "\n".join(b[1] for b in rest)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each token of each page: its count, its place and the unlinked text below it; and one for the page."""
    for b in batches_of(it, "html", BATCH_BYTES):
        cols: list[list] = [[] for _ in range(7)]
        for url, source in zip(b.column(1).to_pylist(), strings(b.column(2)), strict=True):
            page = Page(source)
            key = xxhash.xxh64_intdigest(source.encode("utf-8", "surrogatepass"), 5)
            seen: dict[tuple[str, int, str], list[int]] = {("page", 0, ""): [1, 0]}
            for i, (kind, node, text, _, _) in enumerate(page.sequence()):
                seen.setdefault((kind, node, text), [0, i])[0] += 1
            below, host = page.free(), host_of(url)
            for (kind, node, text), (n, place) in seen.items():
                sign = n * key & 0xFFFFFFFF  # of the vector: sums of 32-bit parts stay within a long
                for col, x in zip(cols, (host, page.token(kind, node, text), kind == "page", n, sign, place, below[node] if kind == "tag" else 0), strict=True):
                    col.append(x)
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["host", "token", "page", "n", "sign", "place", "free"])


def templates(pages: DataFrame) -> DataFrame:
    """(host, pages, constants, free): the equivalence classes of each host.

    ``constants`` are the class's tokens in order, ``free`` the unlinked
    characters below each on a mean page. ``pages`` has page_id, url and html.
    Every step is a pre-aggregated sum by host and token; what is gathered for
    a host are tokens that SHARE of its pages have.
    """
    tokens = pages.select("page_id", "url", "html").mapInArrow(_emit, "host string, token long, page boolean, n long, sign long, place long, free long")
    by_token = tokens.groupBy("host", "token", "page").agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("n"), F.sum("sign").alias("vector"), F.sum("place").alias("place"), F.sum("free").alias("free"))
    by_token = cut(by_token.filter(F.col("pages") >= SUPPORT))
    most = by_token.filter("page").select("host", F.col("pages").alias("all"))
    often = by_token.filter("not page").join(most, "host").filter(F.col("pages") >= SHARE * F.col("all"))
    member = F.struct("place", "token", (F.col("free") / F.col("pages")).alias("free"))
    classes = often.groupBy("host", "vector", "pages", "n").agg(F.array_sort(F.collect_list(member)).alias("members")).filter(F.size("members") >= 2)
    return classes.select("host", "pages", F.transform("members", lambda x: x["token"]).alias("constants"), F.transform("members", lambda x: x["free"]).alias("free"))


def in_turn(places: list[list[int]]) -> bool:
    """Whether all members occur equally often, first to last, and then again."""
    if len({len(p) for p in places}) != 1:
        return False
    turns = [x for turn in zip(*places, strict=True) for x in turn]
    return all(x < y for x, y in zip(turns, turns[1:], strict=False))


def read_by(page: Page, classes: list[dict]) -> tuple[frozenset[int], int | None]:
    """(constants, container) of a page: those of the classes that it has."""
    wanted = {t for c in classes for t in c["constants"]}
    places: dict[int, list[int]] = {}
    nodes: dict[int, int] = {}
    for i, (kind, node, text, _, _) in enumerate(page.sequence()):
        t = page.token(kind, node, text)
        if t in wanted:
            places.setdefault(t, []).append(i)
            if kind == "tag":
                nodes[t] = node
    has = [c for c in classes if all(t in places for t in c["constants"]) and in_turn([places[t] for t in c["constants"]])]
    tags = [(free, nodes[t]) for c in has for t, free in zip(c["constants"], c["free"], strict=True) if t in nodes and len(places[t]) == 1 and free > 0]
    best = max((free for free, _ in tags), default=0)
    deep = max(((page.depths[node], -node) for free, node in tags if free >= 0.9 * best), default=(0, None))[1]
    return frozenset(t for c in has for t in c["constants"] if t not in nodes), None if deep is None else -deep


def _extract(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, list[dict] | None] = {}
    for b in batches_of(it, "html", BATCH_BYTES):
        out = []
        for i, (source, host) in enumerate(zip(strings(b.column(2)), b.column(3).to_pylist(), strict=True)):
            if host not in known:
                if len(known) >= 1000:
                    known.clear()
                known[host] = b.column(4)[i].as_py()
            page = Page(source)
            out.append(page.text(*read_by(page, known[host])) if known[host] else page.text())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` of every row: blocks of the article joined by newlines.

    Null html counts as empty and gives an empty text; a null or odd url is a
    host of its own name ''; repeated rows give a row each; other columns are
    left out; an empty table gives an empty one.
    """
    spark = pages.sparkSession
    ship(spark)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    known = cut(templates(rows).withColumn("_bytes", F.size("constants") * 16 + 64))
    size = known.agg(F.sum("_bytes")).first()[0] or 0
    known = known.groupBy(F.col("host").alias("_host")).agg(F.collect_list(F.struct("constants", "free")).alias("t"))
    if size <= BROADCAST_BYTES:
        known = F.broadcast(known)
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    joined = rows.withColumn("_h", host).join(known, F.col("_h") == F.col("_host"), "left").select("page_id", "url", "html", "_h", "t")
    kind = dict(rows.dtypes)["page_id"]
    return joined.mapInArrow(_extract, f"page_id {kind}, url string, text string")
