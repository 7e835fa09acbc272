"""Operator 2: main text of web pages by consensus host paths.

Every page's containers are scored by the text in their blocks that is neither boilerplate nor links. The best one votes
for its generalised path (tags with their classes, numbers masked) within its host. Votes are counted in Spark; the paths
with at least SHARE of their host's votes win. Each page is extracted again: all containers of its own path, if that won,
make the text; else those of the first winning path, by votes, whose containers score on this page; else its own best one.

Votes are grouped with map-side counts. A path with SHARE of its host's votes has that share of its own salted part of
them too, so parts keep a bounded list each, and a host with a third of all pages or with many paths is no hot spot.
Hosts' paths are broadcast while there are at most BROADCAST_HOSTS of them and joined by a shuffle beyond. Reading a page takes time and memory in proportion to it, however deep its elements lie: blocks are numbered, and
an element is a range of them, so what it holds is a difference of prefix sums.

What a class, id or role calls a menu, a notice, comments and the like is left out. A name that says it of a part that
the element has or lacks (``has-notice``, ``no-sidebar``) does not count. An element that holds most of the page's unlinked
text stays if it has the page's heading or article inside, or if other words of it speak of content or layout and no name
has such a part as its head, the last word but for boxes (``post-sidebar-wrap`` is a sidebar, ``social-news`` news).
Readers' comments never stay for these reasons. If nothing else has text, what is left over stays.

Edge cases: null and empty pages give an empty text; markup that is not closed at the end of a page is left out, wrong
declarations count as comments, end tags without a start are ignored; pages without a usable url vote together under the
empty host; repeated rows are extracted each; an empty table gives an empty result; only the three named columns are
read. White space inside a block becomes one space, ``br`` counts as white space, blocks are joined by a line feed.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import settle, small_batches, tidy

#: Least share of its host's votes that a winning path has; hosts that are broadcast; parts of a host's votes.
SHARE, BROADCAST_HOSTS, PARTS = 0.1, 100_000, 64
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
_SILENT = frozenset("script style noscript template head title iframe object svg canvas audio video map nav footer aside button select option textarea input dialog menu noembed noframes xmp".split())
#: Elements whose content is no markup.
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_CONTAINERS = frozenset("body main article section div td center form".split())
_LANDMARKS = frozenset("article main h1".split())
#: What a class, id or role may say, as a whole word, of parts that are not the article.
_BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "copyright disclaimer discussion disqus footer hidden login masthead menu menubar modal nav navbar navigation newsletter notice notices notification "
    "pager pagination popup promo promoted promotion related recommended recommendations reply replies respond search share sharing sidebar sitemap "
    "skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets complementary contentinfo alert".split()
)
#: Of these an article or main element can be one, too.
_REPLIES = frozenset("ad advert advertisement comment comments promo related reply replies sponsored".split())
#: Readers' comments, whatever else a name says.
_READERS = frozenset("comment comments commentlist discussion disqus reply replies respond".split())
_CONTENT = frozenset("article body content entry main post story text".split())
_LAYOUT = frozenset("col columns container layout page row site wrap wrapper".split())
#: Words that say of an element that it has, or lacks, such parts.
_HAVING = frozenset("free has no with without".split())
#: Words that may follow the head of a name.
_BOXES = frozenset("area block box col column columns container group holder inner left list outer right row section wrap wrapper".split())
#: Elements that end when one of these begins; only these, and rows of tables, are looked through for it.
_CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
_LOOSE = frozenset("p li td th tr dt dd option tbody thead tfoot".split())
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_NUMBER = re.compile(r"\d+")
_TAG_END = r"""(?>[^>=]++|=\s*+(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*+|(?=>)))*+>"""
#: Comment, wrong declaration or end tag, end tag, start tag; else markup that is not closed.
_MARKUP = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?![A-Za-z])[^>]*(?:>|\Z)|</([A-Za-z][^\s/>]*+){_TAG_END}|<([A-Za-z][^\s/>]*+)({_TAG_END})|</?[A-Za-z].*", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_READ = frozenset(("class", "id", "role", "style", "hidden", "aria-hidden"))


@lru_cache(50_000)
def _words(said: str) -> tuple[frozenset[str], frozenset[str]]:
    """Words of the names in an attribute, but for those of parts that an element has or lacks; and the names' heads."""
    words, heads = set(), set()
    for name in said.split():
        parts = [w.lower() for w in _NAME.findall(name)]
        having = next((k for k, w in enumerate(parts) if w in _HAVING), None)
        if having is not None:
            parts = [w for w in parts[:having] if parts[having] != "free" or w not in _BOILERPLATE]
        if parts:
            words |= set(parts)
            heads.add(next((w for w in reversed(parts) if w not in _BOXES), parts[-1]))
    return frozenset(words), frozenset(heads)


class _Node:
    __slots__ = ("tag", "label", "parent", "block", "silent", "link", "within", "depth", "bonus", "suspect", "excused", "readers", "first", "last", "path", "inline")

    def __init__(self, tag: str, label: str, parent: _Node | None, first: int):
        self.tag, self.label, self.parent, self.first, self.last = tag, label, parent, first, first
        self.block = self if parent is None or tag not in _INLINE else parent.block
        self.depth = parent.depth + 1 if parent else 0
        self.link = tag == "a" or (parent is not None and parent.link)
        #: Stands for the path from the root.
        self.path = hash((parent.path, label)) if parent else 0
        self.silent = self.suspect = self.excused = self.readers = self.within = False
        self.bonus = 0.0
        self.inline: Counter | None = None

    def way(self) -> list[str]:
        labels, node = [], self
        while node.parent is not None:
            labels.append(node.label)
            node = node.parent
        return labels[::-1]


def _attributes(said: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(said):
        name = m[1].lower()
        if name in _READ and name not in out:
            out[name] = unescape(m[2] or m[3] or m[4] or "")
    return out


class Page:
    """Blocks of text, and the containers that hold them as ranges of blocks."""

    def __init__(self, html: str):
        self.node = _Node("", "", None, 0)
        #: The root stands for a body that is not written.
        self.containers: list[_Node] = [self.node]
        self.suspects: list[_Node] = []
        self.landmarks: list[int] = []
        self.blocks: list[str] = []
        self.links: list[int] = []
        self.text: list[str] = []
        self.linked = 0
        self.open: Counter = Counter()
        self._read(html)
        self._end_block()
        while self.node.parent is not None:
            self._pop()
        self.node.last = len(self.blocks)
        self._judge()

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            m = _MARKUP.search(html, at)
            if m is None:
                self._data(html[at:])
                return
            if m.start() > at:
                self._data(html[at : m.start()])
            at = m.end()
            if m[1]:
                self._end(m[1].lower())
            elif m[2]:
                tag = m[2].lower()
                self._start(tag, m[3])
                if tag in _RAW:
                    close = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(html, at)
                    at = close.start() if close else n

    def _data(self, raw: str) -> None:
        if not self.node.silent:
            data = unescape(raw) if "&" in raw else raw
            self.text.append(data)
            if self.node.link:
                self.linked += len(data.strip())

    def _end_block(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.blocks.append(text)
                self.links.append(self.linked)
        self.text, self.linked = [], 0

    def _pop(self) -> None:
        node = self.node
        node.last = len(self.blocks)
        if node.tag in _INLINE:
            node.block.inline[node.tag] -= 1
        else:
            self.open[node.tag] -= 1
        self.node = node.parent

    def _start(self, tag: str, said: str) -> None:
        if tag in _VOID:
            if tag == "br":
                self.text.append(" ")
            elif tag == "hr":
                self._end_block()
            return
        if tag not in _INLINE:
            self._end_block()
            closes, node = _CLOSES.get(tag, {"p"}), self.node.block
            while node.tag in _LOOSE and node.tag not in closes:
                node = node.parent.block
            if node.tag in closes:
                while self.node is not node:
                    self._pop()
                self._pop()
        self._open(tag, _attributes(said))

    def _open(self, tag: str, values: dict[str, str]) -> None:
        said = [_words(values[k]) for k in ("class", "id", "role") if k in values]
        names = frozenset().union(*(words for words, _ in said))
        inside = self.node
        label = tag + "".join(f".{_NUMBER.sub('#', c)}" for c in sorted(values.get("class", "").split()))
        node = _Node(tag, label, inside, len(self.blocks))
        node.bonus = 0.5 if tag in ("article", "main") or "main" in names else 0.25 if not _CONTENT.isdisjoint(names) else 0.0
        node.within = inside.within or tag in ("article", "main", "section") or node.bonus > 0
        node.silent = inside.silent or tag in _SILENT or "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in values.get("style", "").replace(" ", "").lower() or (tag == "header" and not inside.within)
        self.node = node
        if tag in _INLINE:
            if node.block.inline is None:
                node.block.inline = Counter()
            node.block.inline[tag] += 1
        else:
            self.open[tag] += 1
        if node.silent:
            return
        words = _REPLIES if tag in ("article", "main") else _BOILERPLATE
        node.suspect = tag not in ("html", "body") and (tag == "form" or not words.isdisjoint(names))
        if node.suspect:
            node.readers = not _READERS.isdisjoint(names)
            node.excused = not (_CONTENT | _LAYOUT).isdisjoint(names) and all(words.isdisjoint(heads) for _, heads in said)
            self.suspects.append(node)
        elif tag in _LANDMARKS:
            self.landmarks.append(len(self.blocks))
        if tag in _CONTAINERS:
            self.containers.append(node)

    def _end(self, tag: str) -> None:
        if tag == "br":
            self.text.append(" ")
            return
        if tag in _INLINE:
            inline = self.node.block.inline
            if inline and inline[tag]:
                while self.node.tag != tag:
                    self._pop()
                self._pop()
            return
        if tag == "p" or self.open[tag]:
            self._end_block()
        if self.open[tag]:
            while self.node.tag != tag:
                self._pop()
            self._pop()

    def _judge(self) -> None:
        """Leave out the blocks of parts that are not the article, and sum up the rest."""
        free = [max(0, len(b) - k) for b, k in zip(self.blocks, self.links, strict=True)]
        before = [0, *accumulate(free)]
        keep = [True] * len(free)
        marks = [0] * (len(free) + 2)
        for at in self.landmarks:
            marks[at + 1] += 1
        marks = list(accumulate(marks))
        doubtful = []
        gone_to = 0
        for node in self.suspects:
            most = 2 * (before[node.last] - before[node.first]) > before[-1]
            # A landmark that starts at block k lies inside if k is among its blocks.
            if most and not node.readers and (node.excused or marks[node.last] > marks[node.first]):
                continue
            doubtful.append(node)
            for k in range(max(node.first, gone_to), node.last):
                keep[k] = False
            gone_to = max(gone_to, node.last)
        if doubtful and not any(f and k for f, k in zip(free, keep, strict=True)):
            keep = [True] * len(free)
        self.keep = keep
        self.good = [0, *accumulate(len(b) if k else 0 for b, k in zip(self.blocks, keep, strict=True))]
        self.free = [0, *accumulate(f if k else 0 for f, k in zip(free, keep, strict=True))]
        self.bound = [0, *accumulate(n if k else 0 for n, k in zip(self.links, keep, strict=True))]

    def score(self, containers: list[_Node]) -> float:
        """Text of containers, none inside another, less twice the linked, with what their names add."""
        return sum(max(0, self.good[c.last] - self.good[c.first] - 2 * (self.bound[c.last] - self.bound[c.first])) * (1 + c.bonus) for c in containers)

    def scored(self) -> list[tuple[float, _Node]]:
        """Containers with their scores, best first; of equals the deeper one, then the first."""
        out = [(-self.score([c]), -c.depth, k) for k, c in enumerate(self.containers) if self.good[c.last] > self.good[c.first]]
        return [(-score, self.containers[k]) for score, _, k in sorted(out)]

    def text_of(self, containers: list[_Node]) -> str:
        """Blocks inside any of the containers, in page order; all blocks if there are none."""
        if not containers:
            return "\n".join(b for b, k in zip(self.blocks, self.keep, strict=True) if k)
        out, at = [], 0
        for c in sorted(containers, key=lambda c: c.first):
            out += [self.blocks[k] for k in range(max(at, c.first), c.last) if self.keep[k]]
            at = max(at, c.last)
        return "\n".join(out)

    def holding(self, way: list[str]) -> list[_Node]:
        """The containers of a path; none of them lies in another, as a path tells the depth."""
        path = 0
        for label in way:
            path = hash((path, label))
        return [c for c in self.containers if c.path == path and self.good[c.last] > self.good[c.first]]

    def chosen(self, ways: list[list[str]]) -> tuple[list[_Node], bool]:
        """The containers that make the text, by the winning paths; whether one of those chose them."""
        scored = self.scored()
        best = [scored[0][1]] if scored else []
        if best and scored[0][0] > 0 and best[0].way() in ways:
            return self.holding(best[0].way()), True
        found = next((c for c in map(self.holding, ways) if self.score(c) > 0), None)
        return found or best, found is not None


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, pages, weight) of the containers that pages (page_id, host, html) score best; a path is its labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, weights = [], [], []
            for host, html in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                best = Page(html).scored()[:1]
                if best and best[0][0] > 0:
                    hosts.append(host)
                    paths.append(best[0][1].way())
                    weights.append(best[0][0])
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.list_(pa.string())), pa.array(weights, pa.float64())], names=["host", "path", "weight"])

    return pages.mapInArrow(tidy(run), "host string, path array<string>, weight double").groupBy("host", "path").agg(F.count("*").alias("pages"), F.sum(F.log1p("weight")).alias("weight"))


def winning_paths(counted: DataFrame, share: float = SHARE) -> DataFrame:
    """(host, paths): the paths with at least ``share`` of their host's votes, most first; ties by weight, then by path."""
    part = Window.partitionBy("host", "part")
    parts = counted.withColumn("part", F.pmod(F.xxhash64("path"), F.lit(PARTS))).withColumn("votes", F.sum("pages").over(part))
    could = F.when(F.col("pages") >= share * F.col("votes"), F.struct(-F.col("pages"), -F.round("weight", 3), "path"))
    # At most 1 / share paths of a part could win.
    hosts = parts.groupBy("host").agg(F.sum("pages").alias("votes"), F.sort_array(F.collect_list(could)).alias("could"))
    won = F.filter("could", lambda c: -c["col1"] >= share * F.col("votes"))
    return hosts.select("host", F.transform(won, lambda c: c["path"]).alias("paths"))


def extract(df: DataFrame, share: float = SHARE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, path, by_vote) of every page."""
    small_batches(df.sparkSession)
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    pages = df.select(F.col(id_col).cast("long").alias(id_col), host.alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), F.col(url_col).alias("url"))
    won = settle(winning_paths(votes(pages.select(id_col, "host", "html")), share))
    joined = pages.join(F.broadcast(won) if won.count() <= BROADCAST_HOSTS else won, "host", "left").select(id_col, "url", "html", "paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, used, voted = [], [], []
            for html, ways in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                page = Page(html)
                nodes, by_vote = page.chosen(ways or [])
                texts.append(page.text_of(nodes))
                used.append(">".join(nodes[0].way()) if nodes else None)
                voted.append(by_vote)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(used, pa.string()), pa.array(voted, pa.bool_())], names=[id_col, "url", "text", "path", "by_vote"])

    return joined.mapInArrow(tidy(run), f"`{id_col}` long, url string, text string, path string, by_vote boolean")


def main_texts(df: DataFrame) -> DataFrame:
    """Query op2: main text of every page and its length in code points."""
    return extract(df).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
