"""Main text of web pages: what recurs on a site is taken out, what is left of the article is the text.

Every page is read into a flat tree. Element subtrees are hashed (tag, text, children) and counted per host in Spark, once
for each different article they are found with, and those found with ``MIN_PAGES`` or more different articles of a host
are deleted. What a site writes anew for each page is told by its element or its class: menus, headers,
footers, sidebars, notices, adverts, forms, reader comments. If a page marks its article (``article``, else ``main``), only that part
is text; a header inside an article stays if it holds a heading. Inside a marked article only boxes (``BOXES``: author boxes, legal notes, lists of
links) without a heading are counted and deleted, for a sentence that authors repeat is text, and none if nothing but headings would
be left. On other pages every block is counted.

Two pages have the same article if its longest block of text is the same, so that copies of an article, with changes elsewhere too, do not make its
paragraphs look like a template. Blocks on most of a host's different pages (``USUAL``) are passed over there: a long note
under every page does not make one article of them all.

Counts are partial sums over (host, subtree, article), so a host with a third of all pages is spread by subtree; the lists of usual blocks and
recurring subtrees, which hold few per host, are repeated ``PARTS`` times, and the rows that meet them dealt out by page, since one may be on all pages of a host.

Edge cases: null or empty html gives an empty text; a null url is a host of its own. Unclosed and stray tags are read
as browsers do in the main (a block closes an open paragraph; a stray end tag is passed over). Cut-off character
references are decoded where HTML decodes them and else kept. Repeated pages are each returned. An empty table gives no
rows. Only ``page_id`` and ``url`` are carried.
"""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, written
from .url_reputation import url_host

#: different articles of a host with which a subtree must recur
MIN_PAGES = 5
#: share of a host's different pages from which on a block does not tell an article
USUAL = 0.8
#: parts of the rows that meet one usual block or recurring subtree
PARTS = 16

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
LIMITS = frozenset("ul ol dl table body html select article div section".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOXES = frozenset("div section ul ol dl table figure details fieldset address center".split())
DROPPED_TAGS = frozenset("head script style noscript template iframe svg canvas object nav footer aside form button select textarea dialog menu title noembed noframes xmp".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "newsletter subscribe subscription sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus reply "
    "replies share sharing social related recommended widget popup modal login signup search pagination pager copyright masthead".split()
)
#: an ``article`` so named is none of the page's own
ASIDE_NAMES = frozenset("ad ads advert advertisement sponsored promo comment comments reply replies related recommended".split())

_STATE = re.compile(r"(?:with|without|has|no|not|is)[-_]", re.I)
_TAG = re.compile(
    r"<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*+>?|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z))", re.S)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.I) for name in RAW}


class Page:
    """A page as flat lists: parents stand before their children; ``texts`` holds (element, text) in page order, with
    None for a break between blocks."""

    def __init__(self, html: str) -> None:
        self.tags, self.parents, self.dropped = ["#root"], [0], [False]
        self.named, self.heads, self.around = [False], [False], [False]  # dropped by name; holds a heading; holds an article
        self.texts: list[tuple[int, str | None]] = []
        self._read(html)
        self._place()

    def _open(self, tag: str, rest: str, parent: int) -> int:
        me = len(self.tags)
        self.tags.append(tag)
        self.parents.append(parent)
        drop, named = tag in DROPPED_TAGS, False
        if rest and not rest.isspace():
            for name, *values in _ATTR.findall(rest):
                name, value = name.lower(), "".join(values)
                if name in ("class", "id"):
                    words = {w.lower() for token in value.split() if not _STATE.match(token) for w in _NAME.findall(token)}
                    named = named or not words.isdisjoint(ASIDE_NAMES if tag == "article" else DROPPED_NAMES)
                elif name == "role":
                    named = named or value.strip().lower() in DROPPED_ROLES
                    if value.strip().lower() == "main":
                        self.tags[me] = "main"
                elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                    drop = True
        self.dropped.append(drop)
        named = named and self.tags[me] not in ("html", "body", "main")
        self.named.append(named)
        self.heads.append(False)
        self.around.append(False)
        mark = self.around if self.tags[me] in ("article", "main") and not named else self.heads if tag in ("h1", "h2", "h3") else None
        up = parent
        while mark is not None and not mark[up]:
            mark[up] = True
            up = self.parents[up]
        return me

    def _read(self, html: str) -> None:
        stack, at, end = [0], 0, len(html)
        tags, texts = self.tags, self.texts

        def pop_to(names: frozenset[str], limits: frozenset[str]) -> None:
            for k in range(len(stack) - 1, 0, -1):
                if tags[stack[k]] in names:
                    del stack[k:]
                    return
                if tags[stack[k]] in limits:
                    return

        while at < end:
            m = _TAG.search(html, at)
            text = html[at:m.start() if m else end]
            if text:
                texts.append((stack[-1], htmllib.unescape(text) if "&" in text else text))
            if not m:
                return
            at = m.end()
            slash, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], "")
            if not tag:
                continue
            tag = tag.lower()
            if tag not in INLINE:
                texts.append((stack[-1], None))
            if slash:
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] == tag or tag in ("div", "section") and tags[stack[k]] == "main":
                        del stack[k:]
                        break
                continue
            if tag in CLOSES_P:
                pop_to(frozenset(("p",)), LIMITS)
            if tag in SIBLINGS:
                pop_to(frozenset(SIBLINGS[tag].split()), LIMITS)
            me = self._open(tag, rest, stack[-1])
            if tag in RAW:
                stop = _RAW_END[tag].search(html, at)
                at = stop.end() if stop else end
            elif tag not in VOID and not rest.endswith("/"):
                stack.append(me)

    def _place(self) -> None:
        """Settle what is dropped, and which elements lie in the article."""
        n, tags, parents = len(self.tags), self.tags, self.parents
        for i in range(1, n):
            own = self.dropped[i] or self.named[i] and not self.around[i]
            if tags[i] == "header" and not self.around[i]:
                own = own or not self.heads[i] or not self._inside(i)
            self.dropped[i] = self.dropped[parents[i]] or own
        self.in_article = [False] * n
        for kind in ("article", "main"):
            for i in range(1, n):
                self.in_article[i] = self.in_article[parents[i]] or tags[i] == kind and not self.dropped[i]
            if any(self.in_article):
                break
        self.bare = not any(self.in_article)

    def _inside(self, i: int) -> bool:
        while i:
            i = self.parents[i]
            if self.tags[i] in ("article", "main"):
                return True
        return False

    def subtrees(self) -> list[int]:
        """Hash of every element (0: without text), signed."""
        parts: list[list[str]] = [[] for _ in self.tags]
        for i, text in self.texts:
            if text and not text.isspace():
                parts[i].append(" ".join(text.split()))
        out = [0] * len(self.tags)
        for i in range(len(self.tags) - 1, 0, -1):
            if parts[i]:
                h = xxhash.xxh64_intdigest("\x1f".join([self.tags[i], *parts[i]]).encode("utf-8", "surrogatepass"))
                out[i] = h - (1 << 64) if h >> 63 else h
                parts[self.parents[i]].append(f"{h:x}")
        return out

    def countable(self, i: int) -> bool:
        """Whether the element may be a part of a template."""
        if self.around[i]:
            return False
        if self.in_article[i]:
            return self.tags[i] in BOXES and not self.heads[i] and not self.dropped[i]
        return self.tags[i] not in INLINE and self.tags[i] not in ("html", "body")

    def _block(self, i: int) -> int:
        while self.tags[i] in INLINE:
            i = self.parents[i]
        return i

    def _without(self, recurring: frozenset[int]) -> list[bool]:
        if not recurring:
            return self.dropped
        gone, hashes = list(self.dropped), self.subtrees()
        for i in range(1, len(gone)):
            gone[i] = gone[i] or gone[self.parents[i]] or hashes[i] in recurring and self.countable(i)
        return gone

    def _kept(self, gone: list[bool]) -> Iterator[tuple[int, str | None]]:
        return ((i, t) for i, t in self.texts if not gone[i] and (self.bare or self.in_article[i]))

    def taken_out(self, recurring: frozenset[int]) -> frozenset[int]:
        """``recurring``, or nothing if that would leave no more than headings of a marked article."""
        left = self._kept(self._without(recurring)) if recurring and not self.bare else ()
        if recurring and not self.bare and not any(t and not t.isspace() and self.tags[self._block(i)] not in HEADINGS for i, t in left):
            return frozenset()
        return recurring

    def text(self, recurring: frozenset[int] = frozenset()) -> str:
        return " ".join("".join(" " if t is None else t for _, t in self._kept(self._without(recurring))).split())

    def blocks(self) -> dict[int, int]:
        """Hash of the text of every block of the article, or of an unmarked page, and its characters."""
        parts: dict[int, list[str]] = {}
        for i, t in self._kept(self.dropped):
            if t and not t.isspace():
                parts.setdefault(self._block(i), []).extend(t.split())
        told = (" ".join(words) for words in parts.values())
        return {xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) >> 1: len(t) for t in told}


def _keyed(pages: DataFrame) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    return pages.select("page_id", "url", html.alias("html"), url_host(F.col("url")).alias("host"), F.xxhash64("page_id", "url", html).alias("row"), F.xxhash64(html).alias("page"))


def page_parts(pages: DataFrame) -> DataFrame:
    """``host, row, page, part, chars, own``, once per row: the countable subtrees with text (``chars`` 0; ``own``: it would be missing
    in the text) and the blocks that may tell the article."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for host, row, mark, html in zip(*[batch.column(c) for c in ("host", "row", "page", "html")], strict=True):
                page = Page(html.as_py())
                subtrees: dict[int, bool] = {}
                for i, h in enumerate(page.subtrees()):
                    if h and page.countable(i):
                        subtrees[h] = subtrees.get(h, False) or page.bare or page.in_article[i]
                found = [(h, 0, own) for h, own in subtrees.items()] + [(h, n, False) for h, n in page.blocks().items()]
                for part in found:
                    for col, v in zip(out, (host.as_py(), row.as_py(), mark.as_py(), *part), strict=True):
                        col.append(v)
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["host", "row", "page", "part", "chars", "own"])

    return _keyed(pages).select("host", "row", "page", "html").mapInArrow(run, "host string, row long, page long, part long, chars long, own boolean")


def _spread(few: DataFrame) -> DataFrame:
    """Each row once for every part; Spark takes such repeats for smaller than they are, and would send them to all tasks."""
    return few.withColumn("spread", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).hint("merge")


def articles(parts: DataFrame, min_pages: int = MIN_PAGES, usual: float = USUAL) -> DataFrame:
    """``host, page, article``: the longest block of each page but those on most pages of a host; pages without another have none."""
    pages = parts.groupBy("host", "page").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("pages"))
    blocks = parts.where("chars > 0").groupBy("host", "page", "part").agg(F.max("chars").alias("chars"))
    blocks = written(blocks, "blocks")
    often = blocks.groupBy("host", "part").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    known = _spread(often.join(pages, "host").where(F.col("n") >= F.col("pages") * F.lit(usual)).select("host", "part"))
    rare = blocks.withColumn("spread", F.pmod("page", F.lit(PARTS)).cast("int")).join(known, ["host", "part", "spread"], "left_anti")
    return rare.groupBy("host", "page").agg(F.max(F.struct("chars", "part")).alias("most")).select("host", "page", F.col("most.part").alias("article"))


def recurring_subtrees(subtrees: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """``host, part`` of those found with ``min_pages`` or more different articles, if a text would miss them."""
    once = subtrees.groupBy("host", "part", "article").agg(F.max("own").alias("own"))
    return once.groupBy("host", "part").agg(F.count("*").alias("articles"), F.max("own").alias("own")).where((F.col("articles") >= min_pages) & F.col("own")).select("host", "part")


def main_texts(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """Per row: page_id, url, text, n_chars, n_deleted (different recurring subtrees that were taken out).

    Only pages that lose a subtree take part in the join back, so where few do the list is short and Spark sends it to the
    pages; else pages and lists are dealt out by row."""
    parts = written(page_parts(pages), "parts")
    subtrees = parts.where("chars = 0")
    counted = subtrees.select("host", "page", "part", "own").join(articles(parts, min_pages), ["host", "page"], "left").fillna(0, ["article"])
    recurring = _spread(recurring_subtrees(counted, min_pages))
    # a page has no more recurring subtrees than elements
    met = subtrees.where("own").withColumn("spread", F.pmod("row", F.lit(PARTS)).cast("int")).join(recurring, ["host", "part", "spread"])
    deleted = written(met.groupBy("row").agg(F.collect_set("part").alias("deleted")), "deleted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, cuts = [], []
            for html, listed in zip(batch.column("html"), batch.column("deleted"), strict=True):
                page = Page(html.as_py())
                cut = page.taken_out(frozenset(listed.as_py() or ()))
                texts.append(page.text(cut))
                cuts.append(len(cut))
            yield pa.record_batch(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(cuts, pa.int64())],
                names=["page_id", "url", "text", "n_chars", "n_deleted"])

    joined = _keyed(pages).join(deleted, "row", "left").select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "deleted")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_deleted long")


def op6_template_removal(spark: SparkSession, folder: str) -> DataFrame:
    return main_texts(load(spark, folder, "pages"))
