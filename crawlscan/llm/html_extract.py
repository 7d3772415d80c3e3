"""Main text of HTML pages by a site style tree.

Pages of one host are merged: every block-level branch is known by its path of tags, classes and ids,
and each style node keeps how many of the host's pages show it and how often each of its contents
(the texts right under it; link targets are not read) occurs.  The importance of a branch is one minus the normalised entropy
of its contents over the pages: contents that repeat across pages spread evenly and score near 0,
contents of one page score 1; presentation counts likewise, by the entropy of how many texts stand
right under the branch.  Each branch is judged by its own texts, not with its children.  Copies of a page count once: pages of a host whose longest texts, up to nine tenths of all outside named
noise, are the same.  Branches under the threshold are removed from each page.

Further rules hold on every page, also for hosts with few pages to compare: branches that name
themselves as no content (scripts, forms, navigation, adverts, comments, ...) go, and so do rows of blocks
that are mostly links, save in an article.  Where a page marks its article, the mark is a prior and the style
tree still judges: branches in the article go if they repeat enough in spite of it, and branches beside
it stay if they are important in spite of it.  Beside an article, branches without statistics go, unless
their text outweighs the article's.
"""

from __future__ import annotations

import hashlib
import html as entities
import itertools
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import by_bytes
from .common import Workspace, small

THRESHOLD = 0.5  # a branch less important than this goes
BROADCAST_NODES = 1_000_000  # eight bytes each; with more, pages and nodes meet in a shuffled join by host
COPY_SHARE = 0.9  # pages with the same longest texts, up to this share of all, are copies
PRIOR = 0.75  # what is left of the evidence that speaks against an article's mark
OUTWEIGHS = 200  # characters beside an article, at least, that can show it not to hold the main text
LINK_SHARE = 0.7  # a block with more of its text in links is part of a menu,
MENU_LINKS = 2  # if it and its like beside it hold so many links, outside articles

# A quote that follows an equals sign holds to its end; elsewhere in a tag it is a character like others.
_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)(?:>|$)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([A-Za-z_:][\w:.-]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# Elements by kind.
RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
NO_CONTENT = frozenset("head script style noscript template nav footer aside form button select option input textarea iframe object embed applet canvas svg math audio video map dialog menu title noembed noframes".split())
ARTICLE = frozenset("article main".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
#: Words in class or id that can name a branch as no content.
NOISE_WORDS = frozenset(
    "ad ads advert advertisement advertisements adverts advertising adsense banner banners breadcrumb breadcrumbs comment comments comentarios kommentare commentaires "
    "cookie cookies consent copyright disclaimer disqus footer gdpr login masthead menu menus modal nav navbar navigation navi newsletter notice notices pager pagination popup "
    "promo promoted promotion recommend recommended related reply replies respond search share sharing sidebar signup skip skyscraper social sponsor sponsored subscribe "
    "subscription tags toolbar topbar widget widgets".split()
)
#: Those that name it so after any other word too (``site-nav``, but not ``market-share``).
STRONG_WORDS = frozenset(
    "ad ads advert advertisement advertisements adverts adsense breadcrumb breadcrumbs comment comments comentarios kommentare commentaires disqus footer menu menus nav navbar "
    "navigation newsletter pager pagination popup sidebar skyscraper toolbar topbar".split()
)
#: Words for parts and places, which say nothing about what a branch holds.
PLAIN_WORDS = frozenset(
    "a and area articles bar block body bottom box button buttons center col column container content for form group head header holder icon icons inner item items label large left "
    "link links list module of outer panel part posts region right row section slot small stories strip text the title to top unit wrap wrapper you your zone".split()
)
#: First words of names that tell a state of the branch (``with-sidebar``), not what it is.
STATE_WORDS = frozenset("has is js no not with without".split())
#: Names of a site's header, outside articles.
HEADER_NAMES = frozenset("header site-header siteheader page-header pageheader main-header mainheader top-header topheader global-header globalheader".split())
#: The few noise words that also hold for an element that marks an article.
ARTICLE_NOISE = frozenset("ad ads advert comment comments promo promoted related reply replies sponsored".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alert alertdialog".split())


class Link(str):
    """Text inside a link."""

    __slots__ = ()


class Node:
    """A block-level element; ``key`` digests its path of tags, classes and ids."""

    __slots__ = ("children", "holds_article", "key", "noise", "parent", "tag")

    def __init__(self, tag: str, names: str, noise: str, parent: Node | None):
        self.tag, self.noise, self.parent, self.holds_article = tag, noise, parent, False
        self.key = _short(f"{parent.key}/{tag}.{names}") if parent else 0
        self.children: list = []  # nodes, and texts in page order


def noise_names(names: str) -> set[str]:
    """Noise words among the names of a class or id.

    A name counts if, but for plain words and numbers, all of its words are noise words, or its last one
    is a strong one: ``related-posts`` and ``article-comments`` count, ``share-price`` and ``related-work`` do not.
    """
    found: set[str] = set()
    for name in names.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        if words and words[0] not in STATE_WORDS:
            telling = [w for w in words if w not in PLAIN_WORDS and not w.isdigit()]
            if telling and (NOISE_WORDS.issuperset(telling) or telling[-1] in STRONG_WORDS):
                found.update(NOISE_WORDS.intersection(telling))
    return found


def _named_noise(tag: str, attributes: dict[str, str], inside_article: bool) -> str:
    """``hard`` if an element is no content by its kind, ``soft`` if by its names, else empty."""
    if tag in NO_CONTENT or "hidden" in attributes or attributes.get("aria-hidden") == "true" or tag == "header" and not inside_article:
        return "hard"
    if attributes.get("role", "").lower() in NOISE_ROLES or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.IGNORECASE):
        return "hard"
    if tag in ("html", "body"):
        return ""
    names = noise_names(f"{attributes.get('class', '')} {attributes.get('id', '')}")
    if tag in ARTICLE:
        return "hard" if names & ARTICLE_NOISE else ""
    header = not inside_article and not HEADER_NAMES.isdisjoint(f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().replace("_", "-").split())
    return "soft" if names or header else ""


def parse(page: str) -> Node:
    """The block-level tree of a page; inline elements leave their text, and ``br`` a space, in place.

    Missing end tags are supplied as browsers do for paragraphs, list items, table cells and options;
    a stray end tag is ignored; markup that never closes ends with the page.
    """
    root = Node("#root", "", "", None)
    here, at, articles, linked = root, 0, 0, False
    inline_noise: list[str] = []
    while m := _TAG.search(page, at):
        if m.start() > at and not inline_noise:
            text = page[at : m.start()]
            here.children.append(Link(text) if linked else text)
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if tag == "a":
            linked = not (m[1] or m[4])
        if m[1] or m[4]:
            if inline_noise:
                if tag == inline_noise[-1]:
                    inline_noise.pop()
                    continue
                if tag in INLINE:
                    continue
                inline_noise.clear()
            if tag in INLINE or tag in VOID:
                continue
            up = here
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                while here is not up.parent:
                    articles -= here.tag in ARTICLE
                    here = here.parent
            continue
        raw = m[3] if m[2] else m[6]
        if tag == "br":
            here.children.append(" ")
            continue
        attributes = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in _ATTRIBUTE.finditer(raw)} if raw and "=" in raw or raw and "hidden" in raw else {}
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in VOID:
            continue
        if tag in INLINE:
            if inline_noise or (attributes and _named_noise(tag, attributes, bool(articles))):
                inline_noise.append(tag)
            continue
        inline_noise.clear()
        linked = False
        if tag in CLOSES_P:
            up = here
            while up is not root and up.tag != "p" and up.tag not in ("table", "td", "th", "button", "article", "section", "div", "li"):
                up = up.parent
            if up.tag == "p":
                here = up.parent
        if tag in CLOSED_BY:
            shut, stop = CLOSED_BY[tag]
            up = here
            while up is not root and up.tag not in shut and up.tag not in stop:
                up = up.parent
            while up.tag in shut and up is not root:
                here = up.parent
                up = here
        names = " ".join(sorted(f"{attributes.get('class', '')} {attributes.get('id', '')} {attributes.get('role', '')}".split()))
        node = Node(tag, names, _named_noise(tag, attributes, bool(articles)), here)
        here.children.append(node)
        if tag in ARTICLE and not node.noise:
            up = here
            while up is not None and not up.holds_article:
                up.holds_article = True
                up = up.parent
        if raw and raw.rstrip().endswith("/") and tag not in ("p", "div", "li"):
            continue
        here = node
        articles += tag in ARTICLE
    if at < len(page) and not inline_noise and here.tag != "head":
        here.children.append(page[at:])
    return root


def _clean(parts: list[str]) -> str:
    return " ".join(entities.unescape("".join(parts)).split())


class Block(NamedTuple):
    """A run of text right under a node, with the node's style key."""

    key: int
    text: str
    inside: bool  # an article
    share: float  # of the text in links
    links: int


def blocks(root: Node, by_name: bool = True) -> Iterator[Block]:
    """The blocks of a page with text, in page order.

    Named noise is left out; names alone do not count against a branch that holds the article, or
    at all without ``by_name``.
    """
    held: list[str] = []

    def flush(node: Node, inside: bool) -> Iterator[Block]:
        if held and (text := _clean(held)):
            linked = [t for t in held if isinstance(t, Link) and not t.isspace()]
            yield Block(node.key, text, inside, sum(map(len, linked)) / max(1, sum(map(len, held))), len(linked))
        held.clear()

    stack = [(root, root.tag in ARTICLE, iter(root.children))]
    while stack:
        node, inside, rest = stack[-1]
        child = next(rest, None)
        if child is None:
            yield from flush(node, inside)
            stack.pop()
        elif isinstance(child, str):
            held.append(child)
        else:
            yield from flush(node, inside)
            if child.noise == "" or (child.noise == "soft" and (child.holds_article or not by_name)):
                stack.append((child, inside or child.tag in ARTICLE, iter(child.children)))


def without_menus(found: list[Block]) -> list[Block]:
    """Blocks but for menus: blocks in a row, outside articles, that are mostly links, with several of them."""
    left: list[Block] = []
    for menu, run in itertools.groupby(found, lambda b: not b.inside and b.share > LINK_SHARE):
        run = list(run)
        if not menu or sum(b.links for b in run) < MENU_LINKS:
            left += run
    return left


def _short(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL; null or hostless URLs share the empty host."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def copy_digest(found: list[tuple[int, str]]) -> int:
    """Digest of the longest of a page's (style key, text), up to ``COPY_SHARE`` of all, in page order."""
    room, most = COPY_SHARE * sum(len(text) for _, text in found), set()
    for k in sorted(range(len(found)), key=lambda k: -len(found[k][1])):
        if room <= 0:
            break
        most.add(k)
        room -= len(found[k][1])
    return _short("\x00".join(f"{key} {text}" for k, (key, text) in enumerate(found) if k in most))


def style_nodes(pages: DataFrame) -> DataFrame:
    """(host, page, node, inside, beside, content, layout) of every style node with text, on every page.

    ``page`` is the same for copies, ``content`` digests the texts right under the node, ``layout`` their number;
    ``inside`` tells nodes of articles, ``beside`` other nodes of pages with text in an article.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "html"):
            out: list[tuple] = []
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                held: dict[tuple[int, bool], list[str]] = {}
                found = list(blocks(parse(page or "")))
                for b in found:
                    held.setdefault((b.key, b.inside), []).append(b.text)
                digest, marked = copy_digest([(b.key, b.text) for b in found]), any(inside for _, inside in held)
                out += [(host, digest, key, inside, marked and not inside, _short("\x00".join(texts)), len(texts)) for (key, inside), texts in held.items()]
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["host", "page", "node", "inside", "beside", "content", "layout"])

    return pages.select("host", "html").mapInArrow(run, "host string, page long, node long, inside boolean, beside boolean, content long, layout int")


def judged_nodes(pages: DataFrame, threshold: float) -> DataFrame:
    """(host, node, noise): style nodes that go, and those beside articles that stay (``noise`` false).

    With m distinct pages showing a node, a content that c of them show spreads over them with entropy
    log(c) / log(m), so content importance is 1 - sum over contents of (c / m) * log(c) / log(m).
    Presentation importance is the entropy of the node's layouts, -sum(q log q) / log(m).  The node's
    importance is 1 - (1 - content) * (1 - presentation / 2) * (m - 1) / (m + 1): what a node lacks counts
    the more, the more pages show it.  An article's mark takes a quarter from what a node of the
    article lacks in importance, and from the importance of a node beside it.  Counts are aggregated
    before each shuffle.
    """
    seen = [F.bool_or(c).alias(c) for c in ("inside", "beside")]
    counts = style_nodes(pages).distinct().groupBy("host", "node", "content", "layout").agg(F.count(F.lit(1)).alias("c"), *seen)
    m = F.col("m")

    def spread(by: str) -> DataFrame:
        """Pages m of each node and the sum of c * log(c) over what ``by`` tells apart."""
        return counts.groupBy("host", "node", by).agg(F.sum("c").alias("c"), *seen).groupBy("host", "node").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias(by), *seen)

    both = spread("content").filter(m > 1).join(spread("layout").drop("m", "inside", "beside"), ["host", "node"])
    repeated, plain = F.col("content") / (m * F.log(m)), F.col("layout") / (m * F.log(m))
    lack = repeated * (1 - (1 - plain) / 2) * (m - 1) / (m + 1)
    noise = 1 - lack * F.when(F.col("inside"), PRIOR).otherwise(1) < threshold
    return both.select("host", "node", noise.alias("noise"), (F.col("beside") & (PRIOR * (1 - lack) >= threshold)).alias("stays")).filter("noise OR stays").drop("stays")


def main_text(page: str | None, noise: frozenset[int], stays: frozenset[int] = frozenset()) -> str:
    """Blocks of a page outside ``noise``, joined by a space; beside text in articles, those in ``stays``.

    Where the plain text beside articles outweighs theirs, it stays too.  If names would remove all text
    of a page, they do not count, nor does the tree if it would.
    """
    root = parse(page or "")
    plain = without_menus(list(blocks(root)) or list(blocks(root, by_name=False)))
    left = [b for b in plain if b.key not in noise] or plain
    marked = sum(len(b.text) for b in left if b.inside)
    if marked and sum(len(b.text) for b in left if not b.inside) <= max(marked, OUTWEIGHS):
        left = [b for b in left if b.inside or b.key in stays]
    return " ".join(b.text for b in left)


def extract(pages: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """Main text of every page.

    ``pages`` needs page_id, url and html; other columns are ignored, whatever their names.  Returns one
    row per input row: page_id, url, text and n_chars.  Null and empty html give an empty text; pages
    without a host share one; repeated rows each get their row; no rows in, no rows out.
    """
    ws = Workspace(pages.sparkSession, "html")
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    judged = ws.save(judged_nodes(rows, threshold), "judged")
    sets = [F.collect_set(F.when(F.col("noise") == noise, F.col("node"))).alias(name) for name, noise in (("nodes", True), ("stays", False))]
    by_host = judged.groupBy(F.col("host").alias("judged_host")).agg(*sets)  # styles, not pages
    by_host = ws.save(by_host, "by-host")
    held = by_host.agg(F.coalesce(F.sum(F.size("nodes") + F.size("stays")), F.lit(0))).first()[0]
    by_host = small(by_host) if held <= BROADCAST_NODES else by_host

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "html"):
            pages_in = zip(*(batch.column(c).to_pylist() for c in ("html", "nodes", "stays")), strict=True)
            texts = [main_text(page, frozenset(nodes or ()), frozenset(stays or ())) for page, nodes, stays in pages_in]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    joined = rows.join(by_host, F.col("host") == F.col("judged_host"), "left").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", "nodes", "stays")
    return joined.mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
