"""Main text of HTML pages by minimum-cut labelling.

A page is read into blocks: runs of text that no block-level tag interrupts.
Each block and each element that holds several of them is a node of a graph.

* Terminal capacities are the costs of a classifier: evidence for the article
  (length, few links, ``article`` and ``main`` elements, class names) on one
  side, evidence against it (links, ``nav``, ``footer``, ``aside``, forms,
  names of adverts, notices, comments ...) on the other.
* Smoothness edges join blocks that follow each other and, along the DOM,
  blocks with the elements that hold them, so that a label costs least where
  neighbours and siblings share it.

Maximum flow gives the cheapest labelling; the blocks on the article's side are
the text. Costs are whole hundredths of a nat. They are set by hand, as pages
carry no labels to learn from. Pages do not meet each other: one task per file
split, one page in memory at a time.

Edge cases: a null page is empty and has no text; tags without an end close
with their parent; an end tag that nothing opened is ignored; a comment, script
or tag that never ends takes the rest of the page; a page whose blocks all are
boilerplate has the empty text; repeated rows are repeated; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

# --- reading a page ---------------------------------------------------------------------------------------

#: HTML's fixed element classes: those without an end, those whose content is no text of the page, and those inside a line.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noframes xmp iframe noembed".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
#: A start tag on the left ends an open element on the right, unless one that bounds it lies between.
_ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}, "body": {"head"}}
_BOUNDS = set("ul ol dl table select body html".split())

_TOKEN = re.compile(r"""<!--(?:.*?--!?>|.*)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]++|"[^"]*"|'[^']*')*+)>|[^<]+|<""", re.S)
_OPENS, _LOOSE = re.compile("/?[a-zA-Z]"), re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Element:
    tag: str
    parent: int
    names: str = ""


@dataclass
class Page:
    elements: list[Element]
    texts: list[str]
    linked: list[int]  # characters inside links
    holders: list[int]


def read_page(source: str) -> Page:
    """Blocks of text and the tree of block-level elements above them."""
    page = Page([Element("", -1)], [], [], [])
    stack: list[tuple[str, int]] = [("", 0)]  # open tags and the block-level element that each stands in
    open_tags: Counter[str] = Counter()
    run: list[str] = []
    links = linked = 0

    def close() -> None:
        nonlocal run, linked
        if run:
            text = " ".join("".join(run).split())
            if text:
                page.texts.append(text)
                page.linked.append(linked)
                page.holders.append(stack[-1][1])
            run, linked = [], 0

    def pop_to(depth: int) -> None:
        nonlocal links
        for tag, _ in stack[depth:]:
            open_tags[tag] -= 1
            if tag == "a":
                links -= 1
            if tag not in INLINE:
                close()
        del stack[depth:]

    def end(tags: set[str], bounds: set[str]) -> None:
        if not any(open_tags[t] for t in tags):
            return
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth][0] in tags:
                return pop_to(depth)
            if stack[depth][0] in bounds:
                return

    at, size = 0, len(source)
    while at < size:
        found = _TOKEN.match(source, at)
        at = found.end()
        tag = found[2]
        if tag is None:
            text = found[0]
            if text[0] != "<" or text == "<":
                if text == "<" and _OPENS.match(source, at):
                    found = _LOOSE.match(source, at - 1)  # a quote that never ends: the tag goes to the next ">"
                    if not found:
                        break
                    at, tag = found.end(), found[2]
            if tag is None and (text[0] != "<" or text == "<"):
                text = html.unescape(text) if "&" in text else text
                run.append(text)
                if links:
                    linked += len(text)
            if tag is None:
                continue
        tag = tag.lower()
        if found[1]:
            if tag == "br":
                run.append("\n")
            else:
                end({tag}, set() if tag in _BOUNDS or tag not in INLINE else {"td", "th", "p", "li"})
            continue
        if tag in RAW:
            stop = re.compile(f"</{re.escape(tag)}[^>]*>", re.I).search(source, at)
            at = stop.end() if stop else size
            continue
        if tag == "br":
            run.append("\n")
            continue
        if tag in INLINE:
            if tag == "a" and links:
                end({"a"}, {"td", "th"})
            if tag not in VOID:
                stack.append((tag, stack[-1][1]))
                open_tags[tag] += 1
                links += tag == "a"
            continue
        close()
        if tag in _ENDED_BY:
            end(_ENDED_BY[tag], _BOUNDS)
        else:
            end({"p"}, _BOUNDS | {"td", "th", "button"})
        if tag in VOID:
            continue
        names = "" if tag in ("html", "body") or "=" not in found[3] else " ".join(a or b or c for _, a, b, c in _ATTRIBUTE.findall(found[3]))
        page.elements.append(Element(tag, stack[-1][1], names))
        stack.append((tag, len(page.elements) - 1))
        open_tags[tag] += 1
    close()
    return page


# --- the classifier's costs -------------------------------------------------------------------------------

AGAINST, FOR, ADJACENT, APART, HELD, NESTED = 700, 350, 50, 15, 60, 30
#: Elements and words in class, id and role that speak against or for the article.
AGAINST_TAGS = set("nav footer aside form menu dialog button select fieldset noscript template head svg object audio video canvas map datalist".split())
FOR_TAGS = {"article", "main"}
AGAINST_NAMES = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notices notification alert "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar aside rail footer copyright colophon comment comments commentlist disqus respond reply replies discussion "
    "share sharing social related recommended recommendations newsletter subscribe subscription signup signin login register search popup modal overlay widget widgets toolbar masthead contentinfo complementary".split()
)
FOR_NAMES = set("article articlebody content post entry story main maincontent".split())
_NEGATING = {"no", "not", "has", "with", "without"}


@lru_cache(maxsize=20_000)
def _named(names: str) -> int:
    """Evidence in an element's class, id and role."""
    against = good = header = False
    for name in names.split():
        words = {w.lower() for w in _NAME.findall(name)} | {name.lower()}
        if words & _NEGATING:
            continue
        against |= bool(words & AGAINST_NAMES)
        good |= bool(words & FOR_NAMES)
        header |= "header" in words
    return -AGAINST if against or (header and not good) else FOR if good and not header else 0


def _evidence(page: Page) -> list[int]:
    """Per element the evidence that it and its ancestors give."""
    holding = set()  # elements with the article inside
    for i in range(len(page.elements) - 1, 0, -1):
        if i in holding or page.elements[i].tag in FOR_TAGS:
            holding.add(page.elements[i].parent)
    good, bad = [False], [False]
    for i, e in enumerate(page.elements[1:], 1):
        own = _named(e.names) if e.names else 0
        inside = good[e.parent]
        against = own < 0 or (e.tag in AGAINST_TAGS and not (e.tag == "form" and i in holding)) or (e.tag == "header" and not inside)
        good.append(inside or own > 0 or e.tag in FOR_TAGS)
        bad.append(bad[e.parent] or against)
    return [FOR * g - AGAINST * b for g, b in zip(good, bad)]


def costs(page: Page) -> list[int]:
    """Per block: evidence for the article, below zero if against it."""
    above = _evidence(page)
    out = []
    for text, linked, holder in zip(page.texts, page.linked, page.holders):
        words = text.count(" ") + 1
        own = min(words, 30) * 8 - 60 - min(100, 100 * linked // len(text)) * 2
        out.append(above[holder] + own + (40 if page.elements[holder].tag in ("p", "blockquote", "pre") else 0))
    return out


# --- the cut ----------------------------------------------------------------------------------------------


def graph(page: Page) -> tuple[int, list[tuple[int, int, int]]]:
    """Number of nodes (blocks first, then elements that hold several units) and the smoothness edges ``(node, node, capacity)``."""
    n = len(page.texts)
    filled = [0] * len(page.elements)  # units with text directly below
    for i, holder in enumerate(page.holders):
        while filled[holder] == 0 and holder:
            filled[holder] = 1
            holder = page.elements[holder].parent
        filled[holder] += 1
    # An element with a single unit adds nothing: its unit belongs to the next element above that holds several.
    several = [0] * len(page.elements)
    for i, e in enumerate(page.elements[1:], 1):
        several[i] = i if filled[i] > 1 else several[e.parent]
    node: dict[int, int] = {}
    edges: list[tuple[int, int, int]] = []

    def of(element: int) -> int:
        if element not in node:
            node[element] = n + len(node)
            if element:
                waiting.append(element)
        return node[element]

    waiting: list[int] = []
    held = [several[h] for h in page.holders]
    for i, element in enumerate(held):
        edges.append((i, of(element), HELD))
        if i:
            edges.append((i - 1, i, ADJACENT if held[i - 1] == element else APART))
    while waiting:
        element = waiting.pop()
        edges.append((node[element], of(several[page.elements[element].parent]), NESTED))
    return n + len(node), edges


def source_side(evidence: list[int], n: int, edges: list[tuple[int, int, int]]) -> list[bool]:
    """Maximum flow by shortest augmenting levels; the nodes that the source still reaches.

    ``evidence`` above zero is capacity from the source, below zero to the sink; nodes past its end have none. Edges go both ways.
    """
    out: list[list[int]] = [[] for _ in range(n)]
    to, room = [], []
    for a, b, capacity in edges:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to += [b, a]
        room += [capacity, capacity]
    supply = [max(e, 0) for e in evidence] + [0] * (n - len(evidence))
    demand = [max(-e, 0) for e in evidence] + [0] * (n - len(evidence))
    while True:
        level = [-1] * n
        queue = deque(i for i in range(n) if supply[i])
        for i in queue:
            level[i] = 0
        reached = False
        while queue:
            a = queue.popleft()
            reached = reached or demand[a] > 0
            for e in out[a]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if not reached:
            return [x >= 0 for x in level]
        tried = [0] * n
        for start in range(n):
            path: list[int] = []
            a = start
            while supply[start]:
                if demand[a]:
                    pushed = min([supply[start], demand[a], *(room[e] for e in path)])
                    supply[start] -= pushed
                    demand[a] -= pushed
                    for e in path:
                        room[e] -= pushed
                        room[e ^ 1] += pushed
                    path, a = [], start
                    continue
                while tried[a] < len(out[a]):
                    e = out[a][tried[a]]
                    if room[e] and level[to[e]] == level[a] + 1:
                        break
                    tried[a] += 1
                if tried[a] < len(out[a]):
                    path.append(out[a][tried[a]])
                    a = to[path[-1]]
                elif path:
                    a = to[path.pop() ^ 1]
                    tried[a] += 1
                else:
                    break


def main_text(source: str | None) -> tuple[str, int, int]:
    """The article's text, its number of blocks, and the number of all blocks."""
    page = read_page(source or "")
    n, edges = graph(page)
    chosen = source_side(costs(page), n, edges)
    kept = [t for t, c in zip(page.texts, chosen) if c]
    return "\n".join(kept), len(kept), len(page.texts)


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: ``page_id, url, text, n_chars, n_kept, n_blocks``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(x.as_py()) for x in batch.column("html")]
            text, kept, blocks = (list(x) for x in zip(*found)) if found else ([], [], [])
            arrays = [batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64()), pa.array(kept, pa.int64()), pa.array(blocks, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "text", "n_chars", "n_kept", "n_blocks"])

    plain = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    return plain.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_kept long, n_blocks long")
