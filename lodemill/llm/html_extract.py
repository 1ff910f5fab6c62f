"""Main text of HTML pages by consensus of the pages of a host.

A page is read once, forwards, into a tree of containers and a list of blocks. Every container is scored by the text
that it holds outside links and boilerplate. From the best one the page goes up to the smallest container around it that
holds all blocks which are not mostly links (inside the outermost marked article, where there is one). The page votes
for the generalised path (tags with their classes, digits removed) of that container; Spark adds the votes up per host.
Then every page is read again and its text is taken from the containers on the host's winning path; a page without
that path uses its own best container.

Words of a class or id hide an element only where neither its share of the page's text nor the host's vote says
otherwise: what holds most of the text stays, and so does a container on the winning path with all around it.

A path is a 64-bit hash of its parent's and its own name, so deep pages take time and memory in proportion to their
length; so do unclosed tags and quotes. Votes are added per (host, path) before anything else, so a host with a third of
all pages is a few rows. Winning paths are broadcast up to ``MAX_HOSTS`` hosts and joined by host beyond that.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemill.llm._base import Scratch, byte_slices
from lodemill.llm.url_filter import host_and_path

#: Winning paths (about 60 bytes each) that are broadcast.
MAX_HOSTS = 100_000
#: Quotes in tags that don't close before a page's quotes are no longer looked at.
BROKEN_QUOTES = 8

# Names of elements by kind, and words of class, id and role that mark what is not the article.
RAW = frozenset("script style textarea title noscript template iframe object svg xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article body blockquote center div html main section table tbody td tr".split())
SKIPPED = frozenset("aside button dialog footer form head header input label menu nav search select option".split())
#: Elements in which a header is the article's own.
ARTICLES = frozenset("article main".split())
MARKS = frozenset(
    "ad ads adv advert advertisement advertorial adsense banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie "
    "cookies disclaimer disqus feedback footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices "
    "notification outbrain overlay pager pagination popup promo promotion recommended related reply replies respond search share sharing "
    "sidebar signup skip social sponsor sponsored subscribe subscription taboola tags teaser toolbar tooltip topbar widget widgets".split()
)
#: Marks of replies, which may be longer than the article. Other marks do not hide an element with most of the text.
REPLIES = frozenset("comment comments commentlist disqus replies reply respond".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: An element closes open ones of these kinds when it begins.
CLOSES = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
    "tbody": ("tr", "td", "th", "thead", "tbody"),
}
#: What such an implied end does not cross.
FENCES = frozenset("ul ol dl table select article section div body html".split())

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
#: The rest of a tag with quotes that close; possessive, so a failure takes one pass.
_REST = re.compile(r"[^'\">]*+(?:(?:\"[^\"]*+\"|'[^']*+')[^'\">]*+)*+>")
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|itemprop|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?(?=[\s/\"']|$)", re.I)
_NAMED = re.compile(r"class|id|role|hidden|itemprop|style", re.I)
_DIGITS = re.compile(r"[0-9]+")
_NAMES = re.compile(r"[^\s_-]+")


def _key(parent: int, name: str) -> int:
    return int.from_bytes(blake2b(f"{parent}>{name}".encode(errors="replace"), digest_size=8).digest(), "little", signed=True)


class _Node:
    """hard: boilerplate by its kind; replies; marked: a word of its class or id says so."""

    __slots__ = ("bonus", "hard", "key", "link", "marked", "parent", "prose", "replies", "skip", "tag", "text")

    def __init__(self, tag: str, parent: _Node | None, key: int, hard: bool, replies: bool, marked: bool, bonus: bool):
        self.tag, self.parent, self.key, self.hard, self.replies, self.marked, self.bonus = tag, parent, key, hard, replies, marked, bonus
        self.text = self.link = self.prose = 0
        self.skip = False


class _Stack:
    """Open elements. Knows where the last one of each tag and the last fence is, so that closing looks at none twice."""

    def __init__(self, root: _Node):
        self.open: list[tuple[str, _Node]] = [("#", root)]
        self.places: dict[str, list[int]] = {}
        self.fences: list[int] = []

    def push(self, tag: str, node: _Node) -> None:
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in FENCES:
            self.fences.append(len(self.open))
        self.open.append((tag, node))

    def place(self, tag: str, fenced: bool) -> int | None:
        """Of the last open element of that tag; fenced: unless a fence was opened after it."""
        at = self.places.get(tag)
        if not at or (fenced and self.fences and self.fences[-1] > at[-1]):
            return None
        return at[-1]

    def cut(self, at: int) -> bool:
        """Close all from there on; whether a block was among them."""
        block = False
        while len(self.open) > at:
            tag, _ = self.open.pop()
            self.places[tag].pop()
            if tag in FENCES:
                self.fences.pop()
            block = block or tag in BLOCKS
        return block


class Page:
    """Containers of a page with the text they hold, and its blocks in order."""

    def __init__(self, source: str):
        self.every: list[_Node] = []  # parents come before their children
        #: (container, [(element's node, text, whether in a link)])
        self.parts: list[tuple[_Node, list[tuple[_Node, str, bool]]]] = []
        self._now: list[tuple[_Node, str, bool]] = []
        self._read(source)
        self._majority = self._hold_most()
        self.settle(self._majority)

    def _end_block(self, node: _Node) -> None:
        if self._now:
            self.parts.append((node, self._now))
            self._now = []

    def _read(self, source: str) -> None:
        root = _Node("#", None, 0, False, False, False, False)
        self.every.append(root)
        stack = _Stack(root)
        at, links, broken = 0, 0, 0
        ends: dict[str, re.Pattern] = {}
        while at < len(source):
            begin = source.find("<", at)
            self._text(source[at : begin if begin >= 0 else len(source)], stack.open[-1][1], links)
            if begin < 0:
                break
            first = source[begin + 1 : begin + 2]
            if first in ("!", "?"):
                long = source.startswith("<!--", begin)
                end = source.find("-->" if long else ">", begin + (4 if long else 2))
                at = len(source) if end < 0 else end + (3 if long else 1)
                continue
            name = _NAME.match(source, begin + 1)
            if name is None:  # a lone <
                self._text("<", stack.open[-1][1], links)
                at = begin + 1
                continue
            rest = _REST.match(source, name.end()) if broken < BROKEN_QUOTES else None
            if rest is None:
                broken += 1
                end = source.find(">", name.end())
                if end < 0:
                    break  # the tag never ends
                attributes, at = source[name.end() : end], end + 1
            else:
                attributes, at = rest[0][:-1], rest.end()
            tag = name[0].lower()
            if tag[0] == "/":
                tag = tag[1:]
                if tag == "a":
                    links = max(0, links - 1)
                self._close(stack, tag, False)
                continue
            if tag in RAW:
                if tag not in ends:
                    ends[tag] = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I)
                end = ends[tag].search(source, at)
                at = end.end() if end else len(source)
                continue
            if tag == "br":
                self._now.append((stack.open[-1][1], " ", False))
                continue
            if tag in BLOCKS:
                self._end_block(stack.open[-1][1])
                self._close(stack, "p", True)
                for k in CLOSES.get(tag, ()):
                    self._close(stack, k, True)
            if tag in VOID:
                continue
            if tag == "a":
                links += 1
            if attributes.rstrip().endswith("/") and tag not in BLOCKS:
                continue
            stack.push(tag, self._open(tag, attributes, stack))
        self._end_block(stack.open[-1][1])

    def _text(self, text: str, node: _Node, links: int) -> None:
        if text:
            self._now.append((node, html.unescape(text), links > 0))

    def _open(self, tag: str, attributes: str, stack: _Stack) -> _Node:
        above = stack.open[-1][1]
        hard, bonus, classes = tag in SKIPPED, tag in ARTICLES, []
        if tag == "header" and any(stack.places.get(t) for t in ARTICLES):
            hard = False
        marks: set[str] = set()
        if attributes and _NAMED.search(attributes):
            for name, value in _ATTRIBUTE.findall(attributes):
                name, value = name.lower(), value.strip("\"'").lower()
                if name == "class":
                    classes = sorted(set(value.split()))
                if name in ("class", "id") and tag not in ("body", "html", "article", "main"):
                    marks |= MARKS.intersection(_NAMES.findall(value))
                elif name == "role":
                    hard, bonus = hard or value in ROLES, bonus or value == "main"
                elif name == "itemprop":
                    hard, bonus = hard or value == "comment", bonus or value == "articlebody"
                elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
                    hard = True
        if tag == "header" and not hard:
            marks.discard("header")
        if tag not in CONTAINERS and not hard and not marks:
            return above
        node = _Node(tag, above, _key(above.key, tag + "".join("." + _DIGITS.sub("*", c) for c in classes)), hard, bool(marks & REPLIES), bool(marks), bonus)
        self.every.append(node)
        return node

    def _close(self, stack: _Stack, tag: str, fenced: bool) -> None:
        at = stack.place(tag, fenced)
        if at is not None:
            node = stack.open[-1][1]
            if stack.cut(at):
                self._end_block(node)

    def _hold_most(self) -> set[int]:
        """Marked elements (by id()) with more than half of the text that is neither in links, nor boilerplate by its
        kind, nor replies."""
        for n in self.every:
            n.skip = n.hard or n.replies or (n.parent is not None and n.parent.skip)
            n.text = 0
        total = 0
        for _, parts in self.parts:
            for node, text, link in parts:
                if not link and not node.skip:
                    size = len(text.strip())
                    node.text += size
                    total += size
        for n in reversed(self.every):
            if n.parent is not None:
                n.parent.text += n.text
        return {id(n) for n in self.every if n.marked and not n.replies and n.text > total / 2}

    def settle(self, spared: set[int]) -> None:
        """Fix what is skipped, and from that the blocks and the sums of all containers."""
        for n in self.every:
            n.skip = n.hard or (n.marked and id(n) not in spared) or (n.parent is not None and n.parent.skip)
            n.text = n.link = n.prose = 0
        self.blocks: list[tuple[_Node, str]] = []
        for node, parts in self.parts:
            kept = [(text, link) for own, text, link in parts if not own.skip]
            text = " ".join("".join(t for t, _ in kept).split())
            if text:
                self.blocks.append((node, text))
                links = sum(len(t.strip()) for t, link in kept if link)
                plain = max(0, len(text) - links)
                node.text += plain
                node.link += links
                node.prose += len(text) if plain > links else 0
        for n in reversed(self.every):
            if n.parent is not None:
                n.parent.text += n.text
                n.parent.link += n.link
                n.parent.prose += n.prose
        self.nodes = [n for n in self.every if n.tag in CONTAINERS and not n.skip]

    def best(self) -> _Node | None:
        """The smallest container with all prose around the deepest one that has 70 % of the best score.

        Marked articles count half as much again, and the outermost marked one around it bounds the search.
        """
        score = lambda n: (n.text - n.link) * (1.5 if n.bonus else 1.0)
        most = max((score(n) for n in self.nodes), default=0)
        if most <= 0:
            return max(self.nodes, key=lambda n: n.text, default=None)
        chain = [[n for n in self.nodes if score(n) >= 0.7 * most][-1]]
        while chain[-1].parent is not None:
            chain.append(chain[-1].parent)
        chain = [n for n in chain if n.tag in CONTAINERS]
        last = max((k for k, n in enumerate(chain) if n.bonus), default=len(chain) - 1)
        return next(n for n in chain if n.prose == chain[last].prose)

    def text_on(self, path: int) -> str:
        """The text of the containers on a path, in page order. No word of a class hides these or what is around them."""
        wanted = [n for n in self.every if n.key == path and n.tag in CONTAINERS]
        around: set[int] = set()
        for n in wanted:
            while n is not None and id(n) not in around:
                around.add(id(n))
                n = n.parent
        if any(n.marked and not n.replies and id(n) in around and id(n) not in self._majority for n in self.every):
            self.settle(self._majority | {id(n) for n in self.every if id(n) in around and not n.replies})
            text = self.text_of({id(n) for n in wanted})
            self.settle(self._majority)
            return text
        return self.text_of({id(n) for n in wanted}) if wanted else ""

    def text_of(self, wanted: set[int]) -> str:
        """The blocks inside any of the containers (by id()), in page order."""
        inside: set[int] = set()
        for n in self.every:
            if id(n) in wanted or (n.parent is not None and id(n.parent) in inside):
                inside.add(id(n))
        return "\n".join(text for node, text in self.blocks if id(node) in inside)


def vote(source: str) -> tuple[int, int] | None:
    node = Page(source).best()
    return (node.key, max(1, node.text)) if node is not None else None


def extract(source: str, path: int | None) -> str:
    """Text on the path where the page has it and it holds text, else in the page's own best container."""
    page = Page(source)
    if path is not None and (text := page.text_on(path)):
        return text
    node = page.best()
    # Without a container, all blocks that are not boilerplate.
    return page.text_of({id(node)}) if node is not None else "\n".join(t for _, t in page.blocks)


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, path): for each host the path with the most votes; ties go to the smaller path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "html"):
            found: dict[tuple[str, int], list[int]] = {}
            for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                if (v := vote(source)) is not None:
                    sums = found.setdefault((host, v[0]), [0, 0])
                    sums[0] += 1
                    sums[1] += v[1]
            keys, sums = list(found), list(found.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), *[pa.array([s[i] for s in sums], pa.int64()) for i in (0, 1)]],
                names=["host", "path", "votes", "chars"],
            )

    host, _ = host_and_path(F.col("url"))
    rows = pages.select(host.alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    sums = rows.mapInArrow(run, "host string, path long, votes long, chars long").groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("chars").alias("chars"))
    first = F.min(F.struct((-F.col("votes")).alias("v"), (-F.col("chars")).alias("c"), "path"))
    return sums.groupBy("host").agg(first.path.alias("path"))


def main_text(pages: DataFrame, max_hosts: int = MAX_HOSTS, scratch: Scratch | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of pages.

    Null and empty html, and pages without any text, give an empty text. Null urls and urls without ``://`` share one
    empty host. Repeated rows and null ids are pages like others; ties between paths go to the smaller hash; further
    columns are ignored; an empty table gives an empty result. Long, deep and broken pages take memory of some 30 bytes a
    byte of html, one page at a time.
    """
    scratch = scratch or Scratch(pages.sparkSession, "paths")
    winners = scratch.written(winning_paths(pages))
    host, _ = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    small = winners.count() <= max_hosts
    rows = rows.join(F.broadcast(winners) if small else winners, "host", "left").select("page_id", "url", "path", "html")
    kind = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "html"):
            texts = [extract(s, p) for s, p in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return rows.mapInArrow(run, kind)
