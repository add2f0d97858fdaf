"""Main text of web pages by consensus host paths.

1. Each page is scanned once, in time proportional to its length: blocks of text with the containers they lie in, under
   generalised paths (tag and class names from the root, digits dropped), without what is not the article by its tag or role. A class or id that
   says so is one sign among several (`_dropped`): an element with three quarters of the page's text, or with all its `article`s, is never left
   out for its name. Scores of the containers choose the page's own best path.
2. Pages vote: per host, the path chosen by most pages wins (of equals, the one nearer to the root). A path with two votes and a tenth
   of the host's is a template of the host beside it; there are at most ten.
3. Each page's text is taken again from its blocks: inside its own best path if that is a template of the host, else inside the
   host's winning path if that holds half as much as the page's own best (a quarter, where it lies within it); a page for which it doesn't, and a
   page without a host, uses its own best path.

Votes are counted with partial aggregation, so a host with a third of all pages is no hot task, and only (host, path)
pairs with counts are shuffled. A `header` inside `article` or `main` belongs to it, and so does a heading, whatever its class is; a `footer`
never does. `br` is white space. An unfinished tag at the end is no text.

Pages with empty or null html, or none but boilerplate, have empty text. Pages may be of any length and depth: containers are numbers,
and a path is a hash of its parent's and its own name. Repeated rows are extracted alike. Columns other than the three named
are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.textkit import bound_batches, sliced
from plumbline.llm.url_filter import host_and_path
from plumbline.plans.lookup import join_facts
from plumbline.plans.storage import Scratch

_TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)>",
    re.S,
)
_UNFINISHED = re.compile(r"<[a-zA-Z/!?]")
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|style|aria-hidden|hidden)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"\d+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes template noscript svg".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CONTAINER = frozenset("html body main article section div td center table tbody tr blockquote details".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_NOT_ARTICLE = frozenset("head nav footer aside form button select option menu dialog object audio video canvas input".split())
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
    "body": (("head",), ()),
}
_PARAGRAPH = (("p",), ("td", "th", "table", "button"))
#: Names that say of an element that it is not the article, alone or as the first or last part of a name (fixed values).
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr popup"
    " modal newsletter subscribe subscription signup sidebar navbar navigation breadcrumb breadcrumbs masthead topbar"
    " comment comments commentlist respond reply replies disqus pagination pager login".split()
)
#: Names that say so only alone or as the last part of a name: `site-notice`, but not `notice-board` (fixed values).
_LAST_NAMES = frozenset("notice notices alert overlay menu nav header footer share sharing social related recommended recommendations toolbar widget search".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
_NEGATIONS = frozenset("no without with has not free none off".split())
_ARTICLE_NAMES = frozenset("entry post article story".split())


_COMMENT_NAMES = frozenset("comment comments commentlist respond reply replies disqus".split())
_RUNNING = frozenset("p span em b i strong a q cite code small".split())

_WEAK, _WEAK_ALONE, _STRONG, _COMMENTS = 1, 2, 3, 4


def _doubt(names: list[str]) -> int:
    """What the class or id names say against an element: words of the lists above in their places, as in `ad-slot` or `page-footer`."""
    worst = 0
    for name in names:
        parts = [p.lower() for p in _NAME_PARTS.findall(name)]
        if not parts or parts[0] in _NEGATIONS or parts[-1] in _NEGATIONS:
            continue
        if parts[-1] in ("header", "footer") and parts[0] in _ARTICLE_NAMES:
            continue
        if parts[0] in _NAMES or parts[-1] in _NAMES:
            worst = max(worst, _COMMENTS if {parts[0], parts[-1]} & _COMMENT_NAMES else _STRONG)
        elif parts[-1] in _LAST_NAMES:
            worst = max(worst, _WEAK_ALONE if len(parts) == 1 else _WEAK)
    return worst


class _Named:
    """An element with a name against it, and what it holds."""

    __slots__ = ("kind", "tag", "parent", "article", "chars", "linked", "in_articles", "has_article", "dropped")

    def __init__(self, kind: int, tag: str, parent: int, article: bool):
        self.kind, self.tag, self.parent, self.article = kind, tag, parent, article
        self.chars = self.linked = self.in_articles = 0
        self.has_article = self.dropped = False


def _dropped(d: _Named, page: _Named) -> bool:
    """Whether an element is left out. `page` has the same figures for the whole page."""
    own, every = max(0, d.chars - 2 * d.linked), max(0, page.chars - 2 * page.linked)
    elsewhere = page.in_articles - d.in_articles > 0
    if not elsewhere and (d.has_article or own * 4 >= every * 3):
        return False
    of_links = d.linked * 2 >= d.chars
    if d.kind == _WEAK and (d.article or d.tag in _RUNNING):
        return of_links
    if d.kind == _WEAK_ALONE and d.article and d.tag in _RUNNING:
        return of_links
    return True


class _Element:
    __slots__ = ("tag", "skip", "container", "link", "article", "named")

    def __init__(self, tag: str, skip: bool, container: int, link: bool, article: bool, named: int):
        self.tag, self.skip, self.container, self.link, self.article, self.named = tag, skip, container, link, article, named


class _Stack:
    """The open elements, with the places of each tag's, so that looking one up takes no walk."""

    def __init__(self):
        self.items = [_Element("root", False, 0, False, False, 0)]
        self.places: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []

    def top(self) -> _Element:
        return self.items[-1]

    def push(self, element: _Element) -> None:
        self.places[element.tag].append(len(self.items))
        if element.tag in _BLOCK:
            self.blocks.append(len(self.items))
        self.items.append(element)

    def cut(self, at: int) -> None:
        while len(self.items) > at:
            tag = self.items.pop().tag
            self.places[tag].pop()
            if tag in _BLOCK:
                self.blocks.pop()

    def innermost(self, tags: tuple[str, ...]) -> int:
        """The place of the innermost open element of these tags; 0 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)


class Page:
    """Blocks of one page and its containers, numbered in the order of the page; container 0 is the page."""

    def __init__(self, source: str):
        self.texts: list[str] = []
        self.inside: list[int] = []
        self.good: list[int] = []
        self.parents: list[int] = [-1]
        self.tags: list[str] = ["root"]
        self.paths: list[int] = [0]
        self.depths: list[int] = [0]
        self._named = [_Named(0, "root", -1, False)]
        self._buffer: list[tuple[str, int, bool, bool]] = []
        self._blocks: list[tuple[int, list[tuple[str, int, bool, bool]]]] = []
        self._scan(source)
        self._settle()

    def _flush(self, top: _Element) -> None:
        if self._buffer:
            self._blocks.append((top.container, self._buffer))
            self._buffer = []

    def _text(self, piece: str, top: _Element) -> None:
        if piece and not top.skip:
            self._buffer.append((piece, top.named, top.link, top.article))

    def _settle(self) -> None:
        """Decides about the elements with names against them, and makes the blocks of what is left."""
        named = self._named
        for _, pieces in self._blocks if len(named) > 1 else ():
            for piece, own, link, article in pieces:
                size = len(piece.strip())
                named[own].chars += size
                named[own].linked += size * link
                named[own].in_articles += size * article
        for d in reversed(named[1:]):
            up = named[d.parent]
            up.chars, up.linked, up.in_articles, up.has_article = up.chars + d.chars, up.linked + d.linked, up.in_articles + d.in_articles, up.has_article or d.has_article
        for d in named[1:]:  # parents come before their children
            d.dropped = named[d.parent].dropped or _dropped(d, named[0])
        for container, pieces in self._blocks:
            kept = [p for p in pieces if not named[p[1]].dropped]
            text = " ".join(html_lib.unescape("".join([p[0] for p in kept])).split())
            if text:
                self.texts.append(text)
                self.inside.append(container)
                self.good.append(max(0, len(text) - 2 * sum(len(p[0]) for p in kept if p[2])))
        del self._blocks

    def _scan(self, source: str) -> None:
        stack, never_closed = _Stack(), set()
        at, end = 0, source.rfind(">") + 1  # behind it no tag can end
        while at < end:
            found = _TAG.search(source, at, end)
            stop = found.start() if found else end
            self._text(source[at:stop], stack.top())
            if not found:
                at = end
                break
            at = found.end()
            name = found[2] or found[5]
            if not name:
                if source.startswith("<![CDATA[", stop):
                    self._text(html_lib.escape(source[stop + 9 : at - 3]), stack.top())
                elif source.startswith("<!--", stop) and source[at - 1] != ">":
                    at = len(source)  # a comment that nothing ends
                continue
            tag = name.lower()
            if found[1] or found[4]:
                self._close(tag, stack)
                continue
            attributes = found[3] if found[2] else found[6]
            if tag in _RAW:
                if attributes.rstrip().endswith("/") and tag == "svg":
                    continue
                closing = None if tag in never_closed else re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at, end)
                if closing:
                    at = closing.end()
                elif tag in ("script", "style", "textarea", "title"):
                    at = len(source)
                else:
                    never_closed.add(tag)
                continue
            if tag in _BLOCK:
                self._flush(stack.top())
                self._implied_end(tag, stack)
            elif tag in ("br", "wbr"):
                if tag == "br":
                    self._text(" ", stack.top())
                continue
            if tag not in _VOID:
                stack.push(self._open(tag, attributes, stack.top()))
        rest = source[at:]
        unfinished = _UNFINISHED.search(rest)
        self._text(rest[: unfinished.start()] if unfinished else rest, stack.top())
        self._flush(stack.top())

    def _open(self, tag: str, attributes: str, parent: _Element) -> _Element:
        skip, classes, named = parent.skip or tag in _NOT_ARTICLE or tag == "header" and not parent.article, "", parent.named
        if attributes and not skip:
            values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
            names = values.get("class", "").split()
            role = values.get("role", "").lower()
            hidden = "hidden" in values or values.get("aria-hidden", "").lower() == "true" or "display:none" in values.get("style", "").replace(" ", "").lower()
            exempt = tag in ("html", "body", "main", "article") or parent.article and (tag in _HEADINGS or tag == "header")
            skip = hidden or role in _ROLES
            kind = 0 if skip or exempt else _doubt([*names, *values.get("id", "").split()])
            if kind:
                self._named.append(_Named(kind, tag, named, parent.article))
                named = len(self._named) - 1
            classes = "".join(f".{c}" for c in sorted({_DIGITS.sub("", c).strip("-_") for c in names}) if c)
            if not classes and (own := _DIGITS.sub("", values.get("id", "")).strip("-_")):
                classes = f"#{own}"  # without a class, the id tells containers apart
        if tag in ("article", "main") and not skip:
            self._named[named].has_article = True
        container = parent.container
        if tag in _CONTAINER and not skip:
            path = xxhash.xxh3_64_intdigest(f"{self.paths[container]}/{tag}{classes}".encode("utf-8", "surrogatepass"))
            self.parents.append(container)
            self.tags.append(tag)
            self.paths.append(path - (1 << 63))
            self.depths.append(self.depths[container] + 1)
            container = len(self.parents) - 1
        return _Element(tag, skip, container, parent.link or tag == "a", parent.article or tag in ("article", "main"), named)

    def _close(self, tag: str, stack: _Stack) -> None:
        block, at = tag in _BLOCK, stack.innermost((tag,))
        if block:
            self._flush(stack.top())
        elif stack.blocks and stack.blocks[-1] > at:
            return  # an inline end tag ends nothing outside its block
        if at:
            stack.cut(at)

    def _implied_end(self, tag: str, stack: _Stack) -> None:
        for kinds, stops in (_ENDS.get(tag, _PARAGRAPH), _PARAGRAPH):
            at = stack.innermost(kinds)
            if at and at > stack.innermost(stops):
                stack.cut(at)

    def ends(self) -> list[int]:
        """Per container, one more than the last container inside it."""
        end = list(range(1, len(self.parents) + 1))
        for c in range(len(end) - 1, 0, -1):
            end[self.parents[c]] = max(end[self.parents[c]], end[c])
        return end

    def totals(self) -> list[int]:
        """Per container, the characters of its blocks, those in links counted against it."""
        total = [0] * len(self.parents)
        for container, n in zip(self.inside, self.good, strict=True):
            total[container] += n
        for c in range(len(total) - 1, 0, -1):  # parents come before their children
            total[self.parents[c]] += total[c]
        return total

    def best(self) -> int:
        """From the root towards the container with most of the text, as long as one child has nearly all of it.

        A child has to hold three quarters; an `article` or `main` without a sibling of its kind only a third.
        """
        total, children = self.totals(), {}
        for c in range(1, len(total)):
            children.setdefault(self.parents[c], []).append(c)
        at = 0
        while own := children.get(at):
            heavy = max(own, key=lambda c: total[c])
            named = [c for c in own if self.tags[c] in ("article", "main") and total[c]]
            if len(named) == 1 and 3 * total[named[0]] >= total[at]:
                at = named[0]
            elif total[heavy] and 4 * total[heavy] >= 3 * total[at]:
                at = heavy
            else:
                break
        return at


_SCANNED = "id long, url string, host string, best long, depth int, texts array<string>, inside array<int>, paths array<long>, ends array<int>"


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, "html"):
        pages = [Page(source or "") for source in batch.column("html").to_pylist()]
        best = [p.best() for p in pages]
        columns = [
            pa.array([p.paths[b] for p, b in zip(pages, best, strict=True)], pa.int64()),
            pa.array([p.depths[b] for p, b in zip(pages, best, strict=True)], pa.int32()),
            pa.array([p.texts for p in pages], pa.list_(pa.string())),
            pa.array([p.inside for p in pages], pa.list_(pa.int32())),
            pa.array([p.paths for p in pages], pa.list_(pa.int64())),
            pa.array([p.ends() for p in pages], pa.list_(pa.int32())),
        ]
        names = ["id", "url", "host", "best", "depth", "texts", "inside", "paths", "ends"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names[:3]), *columns], names)


def take(texts: list[str], inside: np.ndarray, paths: np.ndarray, ends: np.ndarray, path: int) -> str:
    """The page's blocks inside a path, joined by line ends. Containers of one path lie beside each other, never in each other."""
    own = np.flatnonzero(paths == path)
    edge = np.zeros(len(paths) + 1, np.int32)
    edge[own] += 1
    np.subtract.at(edge, ends[own], 1)
    return "\n".join(texts[i] for i in np.flatnonzero(np.cumsum(edge)[inside] > 0)) if len(own) else ""


def _chosen(texts: list[str], inside: np.ndarray, paths: np.ndarray, ends: np.ndarray, best: int, winner: int | None) -> str:
    """The text in the host's path where that holds enough of the page's own best, else the latter."""
    own = take(texts, inside, paths, ends, best)
    if winner is None or winner == best:
        return own
    other = take(texts, inside, paths, ends, winner)
    least = 4 if other in own else 2
    return other if other and len(other) * least >= len(own) else own


def _taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        lists = [batch.column(n) for n in ("inside", "paths", "ends")]
        for i, (best, winner, templates) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("best", "winner", "templates")), strict=True)):
            texts = batch.column("texts")[i].as_py()
            if not texts:
                out.append("")
                continue
            inside, paths, ends = (column[i].values.to_numpy() for column in lists)
            out.append(_chosen(texts, inside, paths, ends, best, None if best in (templates or ()) else winner))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(out, pa.string())], ["id", "url", "text"])


def host_templates(scanned: DataFrame) -> DataFrame:
    """Per host: winner (path), templates (at most ten paths with two votes and a tenth of all) and pages."""
    votes = scanned.where("size(texts) > 0").groupBy("host", "best", "depth").agg(F.count(F.lit(1)).alias("n"))
    first = F.min_by("best", F.struct(-F.col("n"), "depth", "best")).alias("winner")
    winners = votes.groupBy("host").agg(first, F.sum("n").alias("votes"), F.count(F.lit(1)).alias("paths"))
    several = join_facts(votes.where("n > 1"), winners, ["host"], "paths", votes.count()).where("n * 10 >= votes")
    templates = several.groupBy("host").agg(F.collect_set("best").alias("templates"))
    pages = scanned.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    return pages.join(winners.select("host", "winner"), "host", "left").join(templates, "host", "left").select("host", "winner", "templates", "pages")


def extract_main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_hosts: int = 100_000
) -> DataFrame:
    """id, url, text and n_chars (code points) for every row of `pages`.

    The hosts' table is broadcast up to `broadcast_hosts` hosts; beyond, only hosts with a great part of all pages are, and the
    other pages are shuffled by host.
    """
    scratch = Scratch(pages.sparkSession, "html-extract")
    bound_batches(pages.sparkSession)
    host, _ = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).alias("html"))
    scanned = scratch.table(rows.mapInArrow(_scanned, _SCANNED), "blocks")
    hosts = scratch.table(host_templates(scanned.where("host <> ''")), "hosts")
    facts = hosts.agg(F.count(F.lit(1)).alias("hosts"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages")).first()
    if facts["hosts"] <= broadcast_hosts:
        chosen = scanned.join(F.broadcast(hosts), "host", "left")
    else:
        chosen = join_facts(scanned, hosts, ["host"], "pages", facts["pages"]).unionByName(scanned.where("host = ''"), allowMissingColumns=True)
    needed = ["id", "url", "best", "winner", "templates", "texts", "inside", "paths", "ends"]
    taken = chosen.select(*needed).mapInArrow(_taken, "id long, url string, text string")
    return taken.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))
