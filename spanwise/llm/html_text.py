"""Main text of web pages by minimum-cut labelling.

A page is read once from front to back and cut into blocks at block-level tags.  A linear
classifier gives each block a log-odds of being content, from its own words, links and
sentence marks and from the elements and names around it; its two costs become capacities
to the terminals.  Neighbouring blocks are joined by smoothness edges, stronger the closer
they are in the element tree, and blocks that share a container are tied to its first
block.  The maximum flow's cut labels all blocks at once: isolated short paragraphs follow
their article, and a link list between two paragraphs does not.

Element and class names are evidence, not a verdict.  A name speaks in full only where all
its parts are known ("site-header"), and doubts about containers count as far as the page
bears them out: where a page marks no main part, and less than a quarter of its prose lies
outside of doubted containers, the names are taken for misleading and doubts shrink in
proportion.

The text of a block has its character references decoded and its white space turned into
single spaces; kept blocks are joined in page order by a line end.  Left out without being
judged are comments, declarations, and the contents of script, style, title, template and
form controls (select, datalist, textarea, button); all else becomes part of a block, the
contents of math, svg, object, noscript or iframe too.

Reading takes time in proportion to a page, however deep it nests and whatever is left
open: an unclosed tag, quote, comment or element hides nothing before it, and an unclosed
title or control hides nothing at all.

Nulls: a null or empty page gives an empty text, and nulls in other columns stay.
Repeated rows are read alike, and equal evidence for and against (log-odds 0) leaves a
block to its neighbours, out if they are out.  Very long pages are read whole.  Extra
columns are ignored unless asked for, whatever their names; an empty table gives none.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import read_table, released, text_slices

# Element names.
HIDDEN = frozenset("script style title textarea template select datalist button".split())  # contents never shown as text
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": "li", "dd": "dd dt", "dt": "dd dt", "tr": "tr", "td": "td th", "th": "td th", "option": "option"}  # open ones that a start tag closes
LISTS = ("ul", "ol", "menu", "table", "dl")  # unless one of these lies between
# Evidence of elements, names and roles, as log-odds.
OUTSIDE = dict.fromkeys("nav footer aside form menu dialog fieldset".split(), -7.0) | {"header": -6.0, "label": -3.0}
INSIDE = {"article": 5.0, "main": 4.0}
BAD_NAMES = frozenset(
    "ad ads advert advertisement advertising adbox banner promo promotion sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs footer header masthead sidebar side aside widget related recommended recommendations share sharing social cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup login search form comment comments disqus replies reply respond pagination pager copyright legal toolbar hidden".split()
)
PLAIN_NAMES = frozenset("site page top bottom left right box wrap wrapper container section block area inner outer list links link item items bar row col column group body title text js id main content".split())
GOOD_NAMES = frozenset("article content entry post story body main text prose".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
WHOLE_NAME, PART_OF_NAME, GOOD_NAME = -6.0, -2.5, 2.0
#: Share of a page's prose outside doubted containers from which doubts count in full.
TRUSTED = 0.25
#: Evidence from which a block lies in a part marked as the main one.
MARKED = 4.0
MOST_ODDS = 9.0

TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
TAG_STOP = re.compile(r">|=\s*[\"']")
ATTRIBUTE = re.compile(r"([a-zA-Z:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
SPACE = re.compile(r"\s+")
CLOSING = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in HIDDEN}


@dataclass
class Block:
    text: str
    element: int  # number of the innermost block-level element
    apart: int  # elements left and entered since the block before
    link_chars: int


@dataclass
class Page:
    """A page's elements, numbered in order of their start, with 0 for what is in none, and its blocks."""

    tag: list[str] = field(default_factory=lambda: [""])
    parent: list[int] = field(default_factory=lambda: [0])
    good: list[float] = field(default_factory=lambda: [0.0])  # evidence for content, summed from the last doubt
    doubt: list[float] = field(default_factory=lambda: [0.0])  # evidence against it, summed from the root
    blocks: list[Block] = field(default_factory=list)


def pieces(page: str) -> Iterator[tuple[str, str, str, str]]:
    """Text and tags in order, in one pass: (text, "", "", "") or ("", "/" or "", name, attributes)."""
    at, n, quoted, unclosed = 0, len(page), True, set()
    last_tag, last_data = page.rfind(">"), page.rfind("]]>")
    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            break
        if begin > at:
            yield page[at:begin], "", "", ""
        at = begin
        after = page[begin + 1 : begin + 2]
        if after in ("!", "?"):
            mark, skip = ("-->", 4) if page.startswith("<!--", begin) else ("]]>", 9) if last_data > begin and page.startswith("<![CDATA[", begin) else (">", 1)
            if page.startswith(("<!-->", "<!--->"), begin):
                mark, skip = ">", 1
            end = page.find(mark, begin + skip)
            if end < 0:
                return
            at = end + len(mark)
            continue
        closing = after == "/"
        m = TAG_NAME.match(page, begin + 1 + closing)
        if m is None:
            if closing and last_tag > begin:
                at = page.find(">", begin) + 1  # no end tag at all, but markup
            else:
                yield "<", "", "", ""
                at = begin + 1
            continue
        end = -1
        if quoted and not closing:
            stop = m.end()
            while (found := TAG_STOP.search(page, stop)) is not None:
                if found[0] == ">":
                    end = found.start()
                    break
                stop = page.find(found[0][-1], found.end()) + 1
                if not stop:
                    break
            quoted = end >= 0  # after a quote that never ends, tags end at their first >
        if end < 0:
            end = page.find(">", m.end())
        if end < 0:
            return  # a tag that the page's end cuts off
        name, rest = m[0].lower(), page[m.end() : end]
        at = end + 1
        yield "", "/" if closing else "", name, rest
        if name in HIDDEN and not closing and not rest.endswith("/"):
            close = None if name in unclosed else CLOSING[name].search(page, at)
            if close is None:
                unclosed.add(name)  # no end tag from here on
                if name in ("script", "style"):
                    return
            else:
                at = close.end()
    if at < n:
        yield page[at:], "", "", ""


def named(names: str) -> float:
    """Evidence of class names and an id."""
    total, good = 0.0, False
    for name in names.split():
        parts = [p.lower() for p in NAME_PART.findall(name)]
        bad = sum(p in BAD_NAMES for p in parts)
        if bad:
            total = min(total, WHOLE_NAME if bad + sum(p in PLAIN_NAMES and p not in BAD_NAMES for p in parts) == len(parts) else PART_OF_NAME)
        good |= any(p in GOOD_NAMES for p in parts)
    return total if total else GOOD_NAME * good


def _evidence(tag: str, attributes: str, within: bool) -> float:
    """Of one element alone; within an article its header and label say little."""
    value = OUTSIDE.get(tag, 0.0) + INSIDE.get(tag, 0.0)
    if within and tag in ("header", "label"):
        value = -0.5
    if attributes and not attributes.isspace():
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
        if tag not in ("html", "head", "body", "main") and ("class" in found or "id" in found):
            value += named(f"{found.get('class', '')} {found.get('id', '')}")
        if found.get("role", "").lower() in BAD_ROLES or "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
            value += WHOLE_NAME
    return value


def read(page: str) -> Page:
    """A page's elements and text blocks."""
    out = Page()
    stack: list[int] = []  # open elements
    open_at: dict[str, list[int]] = {}  # depths of the open elements of each name
    inside: list[int] = [0]  # innermost block-level element of each open element
    articles = links = before = lowest = 0
    parts: list[str] = []

    def close() -> None:
        nonlocal links, before, lowest
        if parts:
            text = SPACE.sub(" ", "".join(parts)).strip()
            if text:
                depth = len(stack)
                lowest = min(lowest, depth)
                out.blocks.append(Block(text, inside[-1], before + depth - 2 * lowest, links))
                before = lowest = depth
            parts.clear()
        links = 0

    def pop(depth: int) -> None:
        nonlocal lowest, articles
        while len(stack) > depth:
            tag = out.tag[stack.pop()]
            open_at[tag].pop()
            inside.pop()
            articles -= tag in INSIDE
        lowest = min(lowest, depth)

    def last(names: str) -> int:
        return max((open_at[t][-1] for t in names.split() if open_at.get(t)), default=-1)

    for text, closing, tag, attributes in pieces(page):
        if not tag:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if open_at.get("a"):
                links += len(text)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK:
            close()
        if closing:
            if open_at.get(tag):
                pop(open_at[tag][-1])
            continue
        if tag in VOID or tag in HIDDEN or attributes.endswith("/"):
            continue
        if tag in CLOSES:
            depth = last(CLOSES[tag])
            if depth > max((open_at[t][-1] for t in LISTS if open_at.get(t)), default=-1):
                pop(depth)
        if tag in BLOCK and (depth := last("p")) > max(last("table button td th"), -1):
            pop(depth)
        value = _evidence(tag, attributes, articles > 0)
        parent = stack[-1] if stack else 0
        number = len(out.tag)
        out.tag.append(tag)
        out.parent.append(parent)
        share = 0.5 if out.doubt[parent] <= WHOLE_NAME else 1.0  # comments may be articles too
        out.good.append(0.0 if value < PART_OF_NAME else out.good[parent] + share * max(value, 0.0))
        out.doubt.append(out.doubt[parent] + min(value, 0.0))
        open_at.setdefault(tag, []).append(len(stack))
        stack.append(number)
        inside.append(number if tag in BLOCK else inside[-1])
        articles += tag in INSIDE
    close()
    return out


def _link_share(block: Block) -> float:
    return min(1.0, block.link_chars / max(1, len(block.text)))


def trust(page: Page) -> float:
    """How far doubts about containers count: fully, if the page marks its main part or enough prose lies outside of them."""
    whole = free = 0.0
    for block in page.blocks:
        if page.good[block.element] >= MARKED:
            return 1.0
        words = block.text.count(" ") + 1
        if words >= 5:
            prose = words * (1 - _link_share(block))
            whole += prose
            free += prose * (page.doubt[block.element] > PART_OF_NAME)
    return min(1.0, free / whole / TRUSTED) if whole else 1.0


def log_odds(page: Page, block: Block, trusted: float) -> float:
    """How much likelier content is than boilerplate, from fixed weights and the page's own statistics."""
    words = block.text.count(" ") + 1
    marks = sum(block.text.count(c) for c in ".!?;:,")
    value = 0.5 * min(marks, 4) + min(words, 40) / 20 - 0.5 - 5.0 * _link_share(block)
    tag = page.tag[block.element]
    if tag in ("p", "blockquote", "pre"):
        value += 1.0
    elif tag in ("h1", "h2", "h3", "h4"):
        value += 0.5
    elif tag in ("li", "option", "td", "th"):
        value -= 0.5
    value += page.good[block.element] + trusted * page.doubt[block.element]
    return max(-MOST_ODDS, min(MOST_ODDS, value))


class Flow:
    """Maximum flow by shortest augmenting levels; nodes 0..n-1, source n, sink n + 1."""

    def __init__(self, n: int):
        self.n, self.to, self.room, self.out = n, [], [], [[] for _ in range(n + 2)]

    def edge(self, a: int, b: int, forward: float, backward: float = 0.0) -> None:
        self.out[a].append(len(self.to))
        self.to.append(b)
        self.room.append(forward)
        self.out[b].append(len(self.to))
        self.to.append(a)
        self.room.append(backward)

    def _levels(self) -> list[int]:
        level, queue = [-1] * (self.n + 2), deque([self.n])
        level[self.n] = 0
        while queue:
            a = queue.popleft()
            for e in self.out[a]:
                if self.room[e] > 1e-9 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[a] + 1
                    queue.append(self.to[e])
        return level

    def source_side(self) -> list[bool]:
        """After saturating: whether each node stays with the source."""
        source, sink = self.n, self.n + 1
        while (level := self._levels())[sink] >= 0:
            nexts = [0] * (self.n + 2)
            path: list[int] = []
            at = source
            while True:
                if at == sink:
                    flow = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= flow
                        self.room[e ^ 1] += flow
                    cut = next(i for i, e in enumerate(path) if self.room[e] <= 1e-9)
                    at = self.to[path[cut] ^ 1]
                    del path[cut:]
                    continue
                while nexts[at] < len(self.out[at]):
                    e = self.out[at][nexts[at]]
                    if self.room[e] > 1e-9 and level[self.to[e]] == level[at] + 1:
                        break
                    nexts[at] += 1
                else:
                    if at == source:
                        break
                    level[at] = -1
                    at = self.to[path.pop() ^ 1]
                    continue
                path.append(e)
                at = self.to[e]
        return [x >= 0 for x in level[: self.n]]


def costs(page: Page, smoothness: float = 2.0) -> tuple[list[float], list[tuple[int, int, float]]]:
    """The log-odds of a page's blocks, and what it costs to part two of them."""
    trusted = trust(page)
    odds = [log_odds(page, block, trusted) for block in page.blocks]
    edges, first_of = [], {}
    for i, block in enumerate(page.blocks):
        if i:
            edges.append((i - 1, i, smoothness / (1 + block.apart)))
        if (head := first_of.setdefault(page.parent[block.element], i)) < i - 1:
            edges.append((head, i, smoothness / 4))
    return odds, edges


def label(page: Page, smoothness: float = 2.0) -> list[bool]:
    """Content or not, for all blocks at once, by a minimum cut."""
    odds, edges = costs(page, smoothness)
    flow = Flow(len(odds))
    for i, value in enumerate(odds):
        if value > 0:
            flow.edge(flow.n, i, value)
        else:
            flow.edge(i, flow.n + 1, -value)
    for a, b, weight in edges:
        flow.edge(a, b, weight, weight)
    return flow.source_side() if odds else []


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = read(page)
    return "\n".join(b.text for b, keep in zip(found.blocks, label(found), strict=True) if keep)


def extract(pages: DataFrame, html_column: str = "html", columns: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The given columns, text and n_chars of each page (columns of these two names are replaced)."""
    columns = tuple(c for c in columns if c not in ("text", "n_chars"))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for part in text_slices(batch, names[-1]):
                texts = [main_text(x) for x in part.columns[-1].to_pylist()]
                yield pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in part.columns[:-1]), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names[:-1], "text", "n_chars"])

    page = "_html" + "_" * max((len(c) for c in pages.columns), default=0)  # a name that no column has
    rows = pages.select(*columns, F.col(html_column).cast("string").alias(page))
    return rows.mapInArrow(run, rows.select(*columns).schema.add("text", "string").add("n_chars", "long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
