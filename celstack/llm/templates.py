"""Main text of HTML pages by site template removal.

1. Every page is parsed once into its element subtrees. Containers with text that do not hold the article (lists, divisions,
   navigation, footers) are hashed: tag, attributes, texts and children. Rows (host, subtree, article) count, in Spark, on how many
   different articles of a host a subtree occurs, so that copies of one page do not make its article a template.
2. Subtrees on at least ``min_pages`` articles of their host are templates if they recur so outside articles, or if they are on a
   ``share`` of all different articles of the host: a list or a text that some articles have in common is no template. The
   templates of each page, and nothing more, are joined back to it; a page's list is bounded by its own elements.
3. The page is read again: templates go, then what HTML itself marks as no part of an article (elements, roles and names of
   menus, headers, footers, sidebars, notices, adverts, forms, comments; scripts and styles), and the text of the rest is taken.

The article is the ``article`` elements (those with a top heading, if any has one), else ``main``, else the body. Paragraphs and
headings of an article are never templates, only containers beside them. On a page without ``article`` and ``main`` every container counts as inside.

Defined cases: a null or empty page, and one without text, gives the empty text; a null URL is the host ''; unclosed elements end
with their parent or the page, a cut-off tag at the end is dropped; null and repeated ids pass through row by row. Columns other
than ``page_id``, ``url`` and ``html`` are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import utf8

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub sup "
                   "time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes".split())
DROPPED = frozenset("head script style noscript template iframe object embed svg canvas audio video map nav footer aside form button select textarea "
                    "dialog menu title noembed noframes xmp".split())
CONTAINERS = frozenset("nav header footer aside form div section ul ol dl table figure center details menu".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
DROPPED_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb "
                          "breadcrumbs footer header masthead cookie cookies consent notice notices gdpr newsletter subscribe subscription signup login "
                          "share sharing social popup modal overlay toolbar pagination pager skip".split())
#: What has one of these names goes even where it holds articles of its own, as comments and teasers may.
SIDE_NAMES = frozenset("comment comments commentlist disqus respond reply replies related recommended".split())
#: An opening tag of the key closes open elements of the values, up to the nearest of the bounds.
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
          "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")), "option": (("option",), ("select",))}
TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]+|\"[^\"]*\"|'[^']*')*+)>|[!?/][^>]*(?:>|\Z)|[a-zA-Z][^>]*(?:>|\Z))", re.S)
NAMED = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")


def names_dropped(attributes: str) -> int:
    """Whether class, id, role or visibility say that the element is no part of an article: 1, or 2 if even its articles are not."""
    level = 0
    for name, value in NAMED.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            words = {w.lower() for w in WORDS.findall(value)}
            if words & SIDE_NAMES:
                return 2
            level |= not words.isdisjoint(DROPPED_NAMES)
        elif name == "role":
            level |= value.lower() in DROPPED_ROLES
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return 2
    return int(level)


class Element:
    """An open element while its page is read."""

    __slots__ = ("tag", "dropped", "parts", "articles", "holds_main", "hashed", "heading", "has_text")

    def __init__(self, tag: str, attributes: str, articles: int) -> None:
        self.tag, self.articles = tag, articles
        self.dropped = names_dropped(attributes) if attributes and tag not in ("html", "body") else 0
        self.parts: list = []
        self.holds_main = self.heading = self.has_text = False
        self.hashed = xxhash.xxh3_64(utf8(tag + attributes))


def flat(parts: list) -> str:
    """Text of nested lists of strings; pages may nest deeper than Python recurses."""
    out, left = [], [iter(parts)]
    while left:
        for part in left[-1]:
            if isinstance(part, str):
                out.append(part)
            else:
                left.append(iter(part))
                break
        else:
            left.pop()
    return "".join(out)


class Page:
    """Article text and the hashed subtrees of one page; subtrees in ``templates`` are deleted."""

    def __init__(self, source: str | None, templates: frozenset[int] = frozenset()) -> None:
        self.templates, self.subtrees = templates, []  # of a subtree: hash, whether in an article, whether in a main
        self.articles: list[tuple[bool, list]] = []
        self.mains: list[list] = []
        self.stack, self.open = [Element("html", "", 0)], Counter({"html": 1})
        if source:
            self._read(source)
        while len(self.stack) > 1:
            self._close()
        chosen = [p for heading, p in self.articles if heading] or [p for _, p in self.articles] or self.mains or [self.stack[0].parts]
        self.text = " ".join(" ".join(flat(p) for p in chosen).split())

    def outside(self) -> dict[int, bool]:
        """Of every subtree, whether it occurs outside the article."""
        found: dict[int, bool] = {}
        for own, in_article, in_main in self.subtrees:
            inside = in_article if self.articles else in_main if self.mains else True
            found[own] = found.get(own, False) or not inside
        return found

    def _read(self, source: str) -> None:
        at = 0
        while tag := TAG.search(source, at):
            if tag.start() > at:
                self._text(source[at : tag.start()])
            at = tag.end()
            end, name, attributes = tag.group(1), tag.group(2), tag.group(3)
            if name is None:
                continue
            name = name.lower()
            if end:
                self._end(name)
                continue
            attributes = attributes.rstrip("/").strip()
            self._start(name, attributes)
            if name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(source, at)
                inner = source[at : close.start() if close else len(source)]
                self.stack[-1].hashed.update(utf8(inner))
                at = close.start() if close else len(source)
        if at < len(source):
            self._text(source[at:])

    def _text(self, raw: str) -> None:
        own = self.stack[-1]
        text = entities.unescape(raw) if "&" in raw else raw
        own.parts.append(text)
        if not text.isspace():
            own.has_text = True
            own.hashed.update(utf8(" ".join(text.split())))

    def _start(self, name: str, attributes: str) -> None:
        if name in ("html", "body") and self.open[name]:
            return
        if name not in INLINE and name not in VOID and self.open["p"]:
            self._end("p")
        if name in CLOSES and any(self.open[tag] for tag in CLOSES[name][0]):
            closed, bounds = CLOSES[name]
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].tag in bounds:
                    break
                if self.stack[k].tag in closed:
                    while len(self.stack) > k:
                        self._close()
        if name in VOID:
            if name in ("br", "hr"):
                self.stack[-1].parts.append(" ")
            return
        self.stack.append(Element(name, attributes, len(self.articles)))
        self.open[name] += 1

    def _end(self, name: str) -> None:
        if not self.open[name]:
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == name:
                while len(self.stack) > k:
                    self._close()
                return

    def _close(self) -> None:
        own, parent = self.stack.pop(), self.stack[-1]
        self.open[own.tag] -= 1
        parent.hashed.update(own.hashed.digest())
        parent.has_text |= own.has_text
        holds = own.holds_main or own.tag in ("article", "main", "h1", "body")
        gone = own.tag in DROPPED or (own.dropped > own.holds_main and not own.heading) or (own.tag == "header" and not own.heading and not self.open["article"])
        if own.tag in CONTAINERS and own.has_text and not (own.holds_main or own.heading):
            own_hash = own.hashed.intdigest() - (1 << 63)
            self.subtrees.append((own_hash, self.open["article"] > 0, self.open["main"] > 0))
            gone |= own_hash in self.templates
        if gone:
            del self.articles[own.articles :]
            parent.parts.append(" ")
            return
        parent.holds_main |= holds
        parent.heading |= own.heading or own.tag == "h1"
        if own.tag == "article" and not self.open["article"]:
            self.articles.append((own.heading, own.parts))
        elif own.tag == "main":
            self.mains.append(own.parts)
        parent.parts += [own.parts] if own.tag in INLINE else [" ", own.parts, " "]


def host_of(url: str = "url") -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def page_hash(source: str | None) -> int:
    return xxhash.xxh3_64_intdigest(utf8(source)) - (1 << 63)


def subtrees(pages: DataFrame) -> DataFrame:
    """(host, page, article, subtree, outside): hash of the page, of its article's text, and of each of its containers.

    A page with text has one more row without a subtree, which counts its article.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                page = Page(source)
                own, article = page_hash(source), page_hash(page.text)
                out += [(host, own, article, s, outside) for s, outside in page.outside().items()]
                if page.text:
                    out.append((host, own, article, None, False))
            columns = list(zip(*out, strict=True)) or [[], [], [], [], []]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["host", "page", "article", "subtree", "outside"])

    return pages.select(host_of().alias("host"), "html").mapInArrow(run, "host string, page long, article long, subtree long, outside boolean")


def site_templates(found: DataFrame, min_pages: int, share: float) -> DataFrame:
    """(host, subtree) of the subtrees beside at least ``min_pages`` different articles of a host, outside them or beside a ``share`` of all."""
    articles = found.where("subtree is null").groupBy("host", "article").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("articles"))
    beside = found.where("subtree is not null").groupBy("host", "subtree", "article").agg(F.max(F.col("outside").cast("int")).alias("outside"))
    counted = beside.groupBy("host", "subtree").agg(F.count("*").alias("n"), F.sum("outside").alias("outside")).where(F.col("n") >= min_pages)
    known = counted.join(articles, "host", "left").where((F.col("outside") >= min_pages) | (F.col("n") >= share * F.coalesce("articles", F.lit(0))))
    return known.select("host", "subtree")


def extract(pages: DataFrame, min_pages: int = 5, share: float = 0.5) -> DataFrame:
    """(page_id, url, text, n_templates): main text of every page and how many of its subtrees were templates."""
    found = cut(subtrees(pages))
    templates = cut(site_templates(found, min_pages, share))
    own = found.join(templates, ["host", "subtree"]).groupBy("host", "page").agg(F.collect_set("subtree").alias("templates"))
    own = cut(own).withColumnsRenamed({"host": "__host", "page": "__page"})

    @F.arrow_udf("long")
    def hashes(sources: pa.Array) -> pa.Array:
        return pa.array([page_hash(s) for s in sources.to_pylist()], pa.int64())

    @F.arrow_udf("string")
    def texts(sources: pa.Array, gone: pa.Array) -> pa.Array:
        return pa.array([Page(s, frozenset(g or ())).text for s, g in zip(sources.to_pylist(), gone.to_pylist(), strict=True)], pa.string())

    keyed = pages.select("page_id", "url", "html", host_of().alias("host"), hashes("html").alias("page"))
    joined = keyed.join(own, (F.col("host") == F.col("__host")) & (F.col("page") == F.col("__page")), "left")
    return joined.select("page_id", "url", texts("html", "templates").alias("text"), F.coalesce(F.size("templates"), F.lit(0)).alias("n_templates"))
