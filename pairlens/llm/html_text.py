"""Main text of web pages by a site style tree.

The pages of one host are merged: nodes at the same place, that is with the same
path of tags, classes and ids, are one node of the site's tree. A node's
importance is ``CONTENT_WEIGHT`` parts entropy of its content and the rest entropy of its
presentation (the sequence of child tags), both over the distinct pages of the host and in
units of the logarithm of their number: 0 if all pages show the same there, 1 if
each shows something else. Pages with the same texts at the same places are one distinct page. What a host with few pages
says is shrunk towards the same place over all hosts, which counts like ``PRIOR_PAGES`` pages. A branch below
``min_importance`` is cut out of the pages whose look there (presentation and content) says little: log(pages / pages
with that look) is at most ``max_information`` of log(pages), and a second page has it. A page that shows something else there keeps
it, and a page of which nothing would stay is left uncut. Elements that say what they are
(navigation, footers, forms, advertisements, reader comments and so on, by tag,
whole class, id or role) are cut without statistics, whatever their size, but a wrapper of the longest
article or main element is not, nor a paragraph or inline element of an article for its class. What stays is the article element, else the
main element, else the body; nothing, if all of it is cut. Only containers and elements with a class or id are
judged by their importance; a bare paragraph or heading is never cut for being repeated.

Statistics combine on the map side, one row per host, place and distinct look, so
a host with a third of all pages is not one task. The list of branches to cut is
joined without hint.

Blocks are decoded, blanks inside are one space, and blocks are joined by an empty
line in page order. Defined cases: null or empty html gives an empty text; a null url
is a host of its own; broken markup is read as far as it goes (unclosed elements end
with their parent, stray end tags are ignored); a page with no text outside forms and named elements
is empty. Repeated rows come out repeated; extra columns are
not read. An empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from .rows import whole_text
from .store import stored

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>|<[!?][^>]*>", re.S
)
_NAMED = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+")
_RAW = frozenset("script style textarea title noscript iframe template xmp noframes noembed".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
_CUT_TAGS = frozenset("head nav footer aside button select menu dialog svg canvas audio video object map".split())
_SITE_TAGS = frozenset(["header"])  # cut outside the article only
_CUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar aside footer cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription share "
    "sharing social related recommended recommendations comment comments disqus respond replies widget pagination pager toolbar login "
    "signup search complementary contentinfo".split()
)
_SITE_NAMES = frozenset(["header", "masthead", "topbar"])
_NAME_FORMS = frozenset(
    "site main left right top bottom upper lower global primary secondary box block bar area list link links button buttons slot unit "
    "wrapper container section posts articles stories x".split()
)
_NEVER_BY_NAME = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
_SCOPES = frozenset("ul ol dl table body article main".split())
_JUDGED = frozenset("div section ul ol dl table tbody tr td fieldset figure details center address blockquote".split())
CONTENT_WEIGHT = 0.9
PRIOR_PAGES = 8


def _joined(pieces: Iterable[str]) -> str:
    return " ".join("".join(pieces).split())


def _digest(parts: Iterable[str]) -> int:
    return xxhash.xxh64_intdigest("\x00".join(parts)) >> 1


def _is_name(token: str, inside: bool) -> bool:
    """Does a whole class, id or role say that it is not main text: one of the names, or several, with words of place or form."""
    parts = set(_PART.findall(token)) - _NAME_FORMS
    return bool(parts) and (parts <= _CUT_NAMES or not inside and parts <= _CUT_NAMES | _SITE_NAMES)


class Element(NamedTuple):
    above: tuple[int, ...]  # judged places around it
    judged: tuple[int, ...]  # the same and its own, if it may be judged
    look: str
    article: bool
    main: bool
    parent: int
    named: bool  # says that it is not main text


class Page:
    """One page read once. ``elements`` that are not cut, and ``blocks``: (pieces of text with their element, in article, in main)."""

    def __init__(self, source: str):
        self.elements = [Element((), (), "", False, False, 0, False)]
        self.blocks: list[tuple[list[tuple[int, str]], bool, bool]] = []
        self._stack: list[tuple[str, int, int, bool]] = []  # tag, element, place, cut
        self._text: list[tuple[int, str]] = []
        self._read(source)
        if any(e.named for e in self.elements):
            self._cut_named()

    def _cut_named(self) -> None:
        """Drops named elements, but none that holds the longest article or main."""
        n = len(self.elements)
        size = [0] * n
        for pieces, _, _ in self.blocks:
            for at, piece in pieces:
                size[at] += len(_joined([piece]))
        for i in range(n - 1, 0, -1):
            size[self.elements[i].parent] += size[i]
        kept = [False] * n
        for kind in ("article", "main"):
            starts = [i for i, e in enumerate(self.elements) if getattr(e, kind) and not getattr(self.elements[e.parent], kind)]
            at = max(starts, key=size.__getitem__, default=0)
            while at:
                kept[at], at = True, self.elements[at].parent
        cut = [False] * n
        for i, e in enumerate(self.elements):
            cut[i] = e.named and not kept[i] or cut[e.parent]
        blocks = [([x for x in pieces if not cut[x[0]]], article, main) for pieces, article, main in self.blocks]
        self.blocks = [block for block in blocks if not all(piece.isspace() for _, piece in block[0])]
        self.elements = [e if not cut[i] else self.elements[0] for i, e in enumerate(self.elements)]

    def _top(self) -> tuple[str, int, int, bool]:
        return self._stack[-1] if self._stack else ("", 0, 0, False)

    def _flush(self) -> None:
        if self._text:
            pieces, self._text = self._text, []
            if not all(piece.isspace() for _, piece in pieces):
                element = self.elements[self._top()[1]]
                self.blocks.append((pieces, element.article, element.main))

    def _read(self, source: str) -> None:
        at = 0
        for token in _TOKEN.finditer(source):
            if token.start() < at:  # inside a raw element
                continue
            self._add(source[at : token.start()])
            at = token.end()
            name = token.group(2)
            if name is None:
                continue
            name = name.lower()
            if token.group(1):
                self._close(name)
            elif name in _RAW:
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(source, at)
                at = end.end() if end else len(source)
            else:
                self._open(name, token.group(3))
        self._add(source[at:])
        self._flush()

    def _add(self, text: str) -> None:
        _, element, _, cut = self._top()
        if text and not cut:
            self._text.append((element, html.unescape(text)))

    def _open(self, tag: str, attributes: str) -> None:
        if tag in ("br", "wbr"):
            if tag == "br":
                self._add(" ")
            return
        if tag in _BLOCK:
            self._flush()
            self._end_p()
        if tag in _CLOSES:
            self._end_open(_CLOSES[tag])
        if tag in ("article", "main"):
            self._end_open({"nav"})
        if tag in _VOID:
            return
        _, element, place, cut = self._top()
        _, judged, _, article, main, _, _ = self.elements[element]
        names = {}
        if attributes:
            names = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _NAMED.finditer(attributes)}
        inside = article or main
        if not cut:
            cut = tag in _CUT_TAGS or tag in _SITE_TAGS and not inside
        # Inside an article only containers are cut by name; a marked paragraph is judged by its importance.
        by_name = tag not in _NEVER_BY_NAME and (not inside or tag in _JUDGED)
        named = tag == "form" or by_name and any(_is_name(x, inside) for v in names.values() for x in v.split())
        look = " ".join(_PART.findall(f"{tag} {names.get('class', '')} {names.get('id', '')}"))
        place = xxhash.xxh64_intdigest(look, seed=place & 0xFFFFFFFFFFFFFFFF) >> 1
        if not cut:
            above = judged
            if tag not in _NEVER_BY_NAME and (tag in _JUDGED or "class" in names or "id" in names):
                judged = (*judged, place)
            if tag == "article" or names.get("itemprop") == "articlebody":
                article = True
            elif tag == "main" or names.get("role") == "main":
                main = True
            self.elements.append(Element(above, judged, look, article, main, element, named))
            element = len(self.elements) - 1
        self._stack.append((tag, element, place, cut))

    def _end_p(self) -> None:
        for i in range(len(self._stack) - 1, -1, -1):
            if self._stack[i][0] == "p":
                del self._stack[i:]
                return
            if self._stack[i][0] in _BLOCK:
                return

    def _end_open(self, tags: set[str]) -> None:
        for i in range(len(self._stack) - 1, -1, -1):
            if self._stack[i][0] in tags:
                del self._stack[i:]
                return
            if self._stack[i][0] in _SCOPES and not tags & {"nav"}:
                return

    def _close(self, tag: str) -> None:
        if tag in _BLOCK:
            self._flush()
        for i in range(len(self._stack) - 1, -1, -1):
            if self._stack[i][0] == tag:
                del self._stack[i:]
                return
            if tag not in _BLOCK and tag not in _CUT_TAGS and self._stack[i][0] in _BLOCK:
                return  # a stray inline end tag does not end blocks

    def looks(self) -> dict[int, tuple[int, int]]:
        """place -> hashes of its presentation and content on this page, for what may be judged."""
        nodes: dict[int, tuple[list[str], list[str]]] = {p: ([], []) for e in self.elements for p in e.judged}
        for element in self.elements[1:]:
            for place in element.above:
                nodes[place][0].append(element.look)
        for pieces, _, _ in self.blocks:
            held: dict[tuple[int, ...], list[str]] = defaultdict(list)  # an inline element has its own pieces only
            for at, piece in pieces:
                held[self.elements[at].judged].append(piece)
            whole = _joined(piece for _, piece in pieces)
            for place in dict.fromkeys(p for judged in held for p in judged):
                own = whole if all(place in judged for judged in held) else _joined(x for at, x in pieces if place in self.elements[at].judged)
                if own:
                    nodes[place][1].append(own)
        return {place: (_digest(tags), _digest(texts)) for place, (tags, texts) in nodes.items()}

    def digest(self, looks: dict[int, tuple[int, int]]) -> int:
        """The same for pages that show the same texts at the same places."""
        return _digest([*(_joined(piece for _, piece in pieces) for pieces, _, _ in self.blocks), repr(sorted(looks.items()))])

    def text(self, cut: set[int] | frozenset[int] = frozenset()) -> str:
        """The main text without the places of ``cut``."""
        kept = []
        for pieces, article, main in self.blocks:
            block = _joined(piece for at, piece in pieces if not cut or cut.isdisjoint(self.elements[at].judged))
            if block:
                kept.append((block, article, main))
        if any(a for _, a, _ in kept):
            kept = [x for x in kept if x[1]]
        elif any(m for _, _, m in kept):
            kept = [x for x in kept if x[2]]
        return "\n\n".join(block for block, _, _ in kept)


def main_text(source: str, repeated: frozenset[int] = frozenset()) -> str:
    """The main text without the looks of ``repeated``; with them if nothing else is left."""
    page = Page(source)
    cut = {place for place, look in page.looks().items() if _key(place, *look) in repeated} if repeated else set()
    return page.text(cut) or page.text()


def _key(place, style, content):
    """One number for a look: place, presentation and content."""
    return place ^ style ^ (content >> 1)


def _with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[a-zA-Z][^:/]*://([^/?#]*)", 1))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        host.alias("host"),
        whole_text("html").alias("html"),
    )


def _looks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Places of each page that may be judged, with hashes of the page and of their presentation and content."""
    for frame in batches:
        out: dict[tuple, int] = defaultdict(int)
        for host, source in zip(frame.host, frame.html):
            page = Page(source)
            looks = page.looks()
            digest = page.digest(looks)
            for place, (style, content) in looks.items():
                out[host, digest, place, style, content] += 1
        if out:
            yield pd.DataFrame([(*key, n) for key, n in out.items()], columns=["host", "page", "place", "style", "content", "n"])


def _entropy(looks: DataFrame, what: str, tree: list[str]) -> DataFrame:
    """``tree``, pages, entropy of ``what`` in units of log(pages)."""
    counts = looks.groupBy(*tree, what).agg(F.sum("n").cast("double").alias("n"))
    sums = counts.groupBy(*tree).agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("x"))
    share = F.when(F.col("pages") > 1, (F.log("pages") - F.col("x") / F.col("pages")) / F.log("pages")).otherwise(1.0)
    return sums.select(*tree, "pages", share.alias(what))


def _page_looks(pages: DataFrame) -> DataFrame:
    rows = _with_host(pages).select("host", "html")
    return rows.mapInPandas(_looks, "host string, page long, place long, style long, content long, n long")


def _look_counts(looks: DataFrame) -> DataFrame:
    return looks.groupBy("host", "place", "style", "content").agg(F.sum("n").alias("n"))


def _weighed(counts: DataFrame, tree: list[str]) -> DataFrame:
    both = _entropy(counts, "style", tree).join(_entropy(counts, "content", tree).drop("pages"), tree)
    return both.select(*tree, "pages", (CONTENT_WEIGHT * F.col("content") + (1 - CONTENT_WEIGHT) * F.col("style")).alias("importance"))


def _importance(counts: DataFrame) -> DataFrame:
    own, everywhere = _weighed(counts, ["host", "place"]), _weighed(counts, ["place"])
    prior = everywhere.select("place", F.col("importance").alias("prior"))
    shrunk = (F.col("pages") * F.col("importance") + PRIOR_PAGES * F.col("prior")) / (F.col("pages") + PRIOR_PAGES)
    return own.join(prior, "place").select("host", "place", "pages", shrunk.alias("importance"))


def importance(pages: DataFrame) -> DataFrame:
    """host, place, pages, importance of every node of the site style trees that may be judged. Every row of ``pages`` counts."""
    return _importance(_look_counts(_page_looks(pages)))


def repeated_looks(pages: DataFrame, min_importance: float = 0.1, max_information: float = 0.7) -> DataFrame:
    """host, look: what ``extract`` cuts where a page shows it, from the distinct pages of each host."""
    distinct = _page_looks(pages).groupBy("host", "page", "place", "style", "content").agg(F.lit(1).alias("n"))
    # Read four times over; written once, so that pages are parsed once for it.
    counts = stored(_look_counts(distinct), "looks")
    low = _importance(counts).where(F.col("importance") < min_importance)
    shown = counts.where(F.col("n") >= 2).join(low.select("host", "place", "pages"), ["host", "place"])
    common = F.log(F.col("pages") / F.col("n")) <= max_information * F.log("pages")
    look = F.col("place").bitwiseXOR(F.col("style")).bitwiseXOR(F.shiftright("content", 1))
    return shown.where(common).select("host", look.alias("look"))


def extract(pages: DataFrame, min_importance: float = 0.1, max_information: float = 0.7) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points)."""
    # Few looks of a place can be common, so a host's list is bounded by the places that its pages share.
    lists = repeated_looks(pages, min_importance, max_information).groupBy("host").agg(F.collect_list("look").alias("cut"))

    @F.pandas_udf("string")
    def texts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sources, cuts in batches:
            yield pd.Series([main_text(s, frozenset() if c is None else frozenset(map(int, c))) for s, c in zip(sources, cuts)], dtype=object)

    rows = _with_host(pages).join(lists, "host", "left")
    found = rows.select("page_id", "url", texts("html", "cut").alias("text"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
