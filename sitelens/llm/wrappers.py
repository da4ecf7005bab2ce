"""Main text of web pages through wrappers inferred for each host.

A wrapper is a union-free regular expression over tag and text tokens, kept as a tree:
an open and its close tag form a node, and nodes carry marks for *optional* and
*repeated*. Two token streams of one host are aligned node by node. A text that differs
becomes a slot; tokens on one side only become an optional group; equal neighbours, or
neighbouring pairs and triples, become one repeated group. Alignment is a merge, so
wrappers are built where the pages are read, and the partial ones of a host are merged
in rounds of small groups until one is left, however many pages the host has.

The wrapper decides what the article is. Each place knows how much text its slots hold,
links apart, and with how many different contents its text stayed the same. From the
root the search goes on into the child that holds nearly all varying prose, and the
place where it stops is the article; groups that stay the same with many contents are
furniture, and go from it. Semantic marks and class words weigh in that choice, no more:
a known furniture word gives way where the host's pages put their varying text.
"""

from __future__ import annotations

import html as entities
import json
import re
import sys
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, private, table

#: Wrappers of one host that one task merges at a time.
FAN_IN = 32
#: Up to so many bytes of wrappers go to every worker as one table; beyond, they are joined.
MOST_BROADCAST = 16_000_000
#: Bounds of a wrapper: places kept (those most pages have) and the length of a key. Places may lie at any depth.
MOST_PLACES, LONGEST_KEY = 20_000, 48
#: Places of the weighed wrappers that a worker remembers at a time.
KNOWN_PLACES = 100_000
#: A page's content is known by its longest blocks, so many of them. How many contents are remembered
#: for each place, and how many a text must stay the same with to be furniture.
LONGEST_BLOCKS, MOST_CONTENTS, FURNITURE_CONTENTS = 4, 6, 3
#: Share of a place's varying prose that one child must hold for the search to go on into it.
SHARE = 0.8
#: Weights in that share: of known furniture words, of semantic marks, of repeated containers, of text outside paragraphs.
WORDED, MARKED, REPEATED, LOOSE = 0.1, 5.0, 0.3, 0.3
#: Equal neighbours that always become a repeated group; containers do from a run of this length on.
CONTAINER_RUN = 4

#: Element kinds of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp")
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table ul".split())
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr",), "th": ("tr",), "option": ("select",)}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PROSE = {"p", "pre", "blockquote", *HEADINGS}
#: Blocks of running text: never entered in search of the article, never furniture by themselves.
FLOW = {*PROSE, "li", "dt", "dd", "figcaption", "caption", "br"}
CONTAINERS = {"div", "section", "article", "ul", "ol", "dl", "table", "tbody", "figure", "center", "main"}

#: Elements and roles that are never part of the article, and class words that seldom are.
SKIP_TAGS = set("head nav footer aside form button select input textarea script style noscript template iframe svg canvas object menu dialog header video audio map".split())
SKIP_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar tablist toolbar status".split())
SKIP_WORDS = set(
    "nav navbar navigation menu sidebar side footer masthead topbar header banner cookie cookies consent gdpr notice notices notification alert ad ads adv advert adverts "
    "advertisement advertising sponsor sponsored promo promotion newsletter subscribe subscription signup comment comments commentlist disqus reply replies respond discussion "
    "share sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager login search popup modal overlay widget tagcloud toolbar skip".split()
)
HARD, WORD = 2, 1

sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))  # for trees of any depth

_ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_LETTERS = re.compile(r"[a-z]+")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_QUOTE_OR_END = re.compile("[>\"']")
_SENTENCE = re.compile(r"[.!?]+\s")
#: Open elements looked through for one that a tag closes; browsers nest no deeper.
REACH = 512


@dataclass(slots=True)
class Element:
    tag: str
    key: str
    skip: int
    main: int
    items: list = field(default_factory=list)  # str or Element, in page order
    place: bool = True  # blocks, and inline elements that hold blocks
    prose: bool = False  # whether there is a paragraph or heading in it
    whole: int = 0  # characters of text anywhere in it


def _element(tag: str, attributes: str) -> Element:
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return Element(tag, tag, HARD * (tag in SKIP_TAGS), 2 * (tag == "article") or int(tag == "main"))
    found = {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTRIBUTE.findall(attributes)}
    names = f"{found.get('class', '')} {found.get('id', '')}".lower()
    role = found.get("role", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    skip = HARD if tag in SKIP_TAGS or role in SKIP_ROLES or hidden else 0
    if not skip and tag not in ("html", "body", "main") and not SKIP_WORDS.isdisjoint(_LETTERS.findall(names)):
        skip = WORD
    main = 0 if skip == HARD else 3 if found.get("itemprop", "").lower() == "articlebody" else 2 * (tag == "article" or role == "article") or int(tag == "main" or role == "main")
    key = ".".join([tag, *sorted(re.sub(r"\d+", "", names).split())])
    if len(key) > LONGEST_KEY:
        key = f"{key[: LONGEST_KEY - 9]}~{zlib.crc32(key.encode('utf-8', 'surrogatepass')):08x}"
    return Element(tag, key, skip, main)


def _tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) in page order, in linear time however broken the markup is.

    A tag ends at the first > outside quotes. Where quotes never come out even, quotes
    don't count for the rest of the page; a tag that never ends is dropped with what follows.
    """
    at, last, quotes = 0, page.rfind(">"), True
    while (begin := page.find("<", at)) >= 0:
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            yield "text", page[at:begin], ""
            at = end + 3 if end >= 0 else len(page)
            continue
        if page.startswith("<![CDATA[", begin) and (end := page.find("]]>", begin)) >= 0:
            yield "text", page[at:begin] + page[begin + 9 : end], ""
            at = end + 3
            continue
        following = page[begin + 1 : begin + 2]
        close = following == "/"
        name = _NAME.match(page, begin + 1 + close)
        if not name and following not in ("!", "?"):
            # A < that begins no tag is text.
            yield "text", page[at : begin + 1], ""
            at = begin + 1
            continue
        yield "text", page[at:begin], ""
        if begin > last:
            return
        end = name.end() if name else begin
        if name and not close and quotes:
            while (m := _QUOTE_OR_END.search(page, end)) and m[0] != ">":
                shut = page.find(m[0], m.end())
                if shut < 0:
                    m = None
                    break
                end = shut + 1
            quotes = m is not None
            end = m.start() if m else name.end()
        end = page.find(">", end)
        if end < 0:
            return
        at = end + 1
        if name and close:
            yield "close", name[0].lower(), ""
        elif name:
            yield "open", name[0].lower(), page[name.end() : end]
            tag = name[0].lower()
            if tag in RAW:
                shut = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                yield "raw", page[at : shut.start() if shut else len(page)], ""
                at = shut.end() if shut else len(page)
    yield "text", page[at:], ""


def parse(page: str | None) -> Element:
    """A lenient element tree of a page; broken markup never fails, and depth doesn't matter."""
    root = Element("", "", 0, 0)
    stack, parents, opened = [root], [], Counter()
    order = [root]

    def close(names: set[str] | tuple, scope: tuple = ()) -> None:
        if not any(opened[n] for n in names):
            return
        for k in range(len(stack) - 1, max(0, len(stack) - 1 - REACH), -1):
            if stack[k].tag in names:
                opened.subtract(e.tag for e in stack[k:])
                del stack[k:]
                return
            if stack[k].tag in scope:
                return

    parents.append(-1)
    depth_index = {id(root): 0}
    for kind, value, attributes in _tokens(page or ""):
        if kind == "text":
            if value and not value.isspace():
                stack[-1].items.append(value)
            elif value and stack[-1].items:
                stack[-1].items.append(" ")
        elif kind == "raw":
            order[-1].items.append(value)
        elif kind == "close":
            if opened[value]:
                close({value})
            elif value == "br":
                stack[-1].items.append(Element("br", "br", 0, 0))
        else:
            if value in CLOSES_P:
                close({"p"}, ("button", "table", "td", "th"))
            if value in SAME_CLOSES:
                close(SAME_CLOSES[value], SCOPES[value])
            new = _element(value, attributes)
            stack[-1].items.append(new)
            parents.append(depth_index[id(stack[-1])])
            depth_index[id(new)] = len(order)
            order.append(new)
            if value not in RAW and value not in VOID and not attributes.endswith("/"):
                stack.append(new)
                opened[value] += 1
    # From the last element to the first: what it holds is known before what holds it.
    for k in range(len(order) - 1, 0, -1):
        e, holder = order[k], order[parents[k]]
        e.place = e.place and (e.tag not in INLINE and e.tag not in VOID or e.tag in INLINE and e.prose)
        if e.tag not in RAW:
            e.whole += sum(len(x.strip()) for x in e.items if isinstance(x, str))
            holder.whole += e.whole
        holds = e.prose or e.tag in PROSE
        if holds or e.place and e.tag not in RAW:
            holder.prose = holder.prose or holds or holder.tag in INLINE
        if e.tag in ("div", "section", "td", "span") and e.key == e.tag and e.place:
            # Containers without a name are told apart by what they hold.
            e.key += ":p" if e.prose else ":l" if any(not isinstance(x, str) and x.place and x.tag not in RAW for x in e.items) else ":t"
    return root


@dataclass(slots=True)
class Node:
    """Of a wrapper. text: None if there never is any, 0 for a slot, else the hash of the fixed text."""

    key: str
    skip: int = 0
    main: int = 0
    seen: int = 1
    mass: int = 0
    text: int | None = None
    optional: bool = False
    repeated: bool = False
    contents: list[list[int]] = field(default_factory=list)  # by rank of the block
    kids: list[Node] = field(default_factory=list)
    prose: float = 0.0  # varying prose of a page, itself and below; by weigh()
    fixed: bool = False  # furniture: all text below it stays the same; by weigh()

    def distinct(self) -> int:
        """How many contents its pages have: two blocks must tell them apart, so a changed line in a copy doesn't."""
        return sorted(map(len, self.contents))[-2] if len(self.contents) > 1 else 0

    def pack(self) -> list:
        """The tree as a flat list, each node before its kids and with their number."""
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            out.append([n.key, n.skip, n.main, n.seen, n.mass, n.text, int(n.optional), int(n.repeated), n.contents, len(n.kids)])
            stack += reversed(n.kids)
        return out

    @staticmethod
    def unpack(rows: list) -> Node:
        top, open_ = None, []  # nodes that still lack kids, with how many
        for x in rows:
            n = Node(*x[:6], bool(x[6]), bool(x[7]), x[8])
            if open_:
                open_[-1][0].kids.append(n)
                open_[-1][1] -= 1
            top = top or n
            while open_ and not open_[-1][1]:
                open_.pop()
            if x[9]:
                open_.append([n, x[9]])
        return top

    @property
    def tag(self) -> str:
        return re.split("[.:]", self.key, maxsplit=1)[0]


def _hash(text: str) -> int:
    data = text.encode("utf-8", "surrogatepass")
    return zlib.crc32(data) << 20 | zlib.adler32(data) & 0xFFFFF | 1


def _fold(kids: list[Node]) -> list[Node]:
    """Neighbouring runs of one, two or three nodes that repeat become repeated groups."""
    for size in (1, 2, 3):
        if len({k.key for k in kids}) == len(kids):
            return kids
        out: list[Node] = []
        k = 0
        while k < len(kids):
            unit = [x.key for x in kids[k : k + size]]
            n = 1
            while len(unit) == size and [x.key for x in kids[k + n * size : k + (n + 1) * size]] == unit:
                n += 1
            group = kids[k : k + size]
            flows = all(x.tag not in CONTAINERS or x.repeated for x in group) or any(x.repeated for x in kids[k : k + n * size])
            if n > 1 and len(set(unit)) == size and (flows or n >= CONTAINER_RUN):
                for j in range(1, n):
                    group = [_merge(a, b, False) for a, b in zip(group, kids[k + j * size : k + (j + 1) * size])]
                for x in group:
                    x.repeated = True
                out += group
                k += n * size
            else:
                out.append(kids[k])
                k += 1
        kids = out
    return kids


def _by_key(kids: list) -> dict[str, list[int]]:
    found: dict[str, list[int]] = {}
    for k, x in enumerate(kids):
        found.setdefault(x.key, []).append(k)
    return found


def _align(x: list[Node], y: list[Node]) -> list[tuple[Node | None, Node | None]]:
    """Both lists in one order: nodes of one key meet by their occurrence, as far as the order allows."""
    theirs, pairs = _by_key(y), []
    for key, mine in _by_key(x).items():
        other = theirs.get(key, [])
        if len(mine) > len(other):
            need = [k for k in mine if not x[k].optional]
            mine = need if len(need) == len(other) else mine
        elif len(mine) < len(other):
            need = [k for k in other if not y[k].optional]
            other = need if len(need) == len(mine) else other
        pairs += zip(mine, other)
    # The longest run of pairs that is in order on both sides.
    pairs.sort()
    tails, ends, before = [], [], {}
    for n, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        tails[at:], ends[at:] = [j] + tails[at + 1 :], [n] + ends[at + 1 :]
        before[n] = ends[at - 1] if at else None
    chain, n = [], ends[-1] if ends else None
    while n is not None:
        chain.append(pairs[n])
        n = before[n]
    out, i, j = [], 0, 0
    for a, b in [*reversed(chain), (len(x), len(y))]:
        out += [(k, None) for k in x[i:a]] + [(None, k) for k in y[j:b]]
        if a < len(x) and b < len(y):
            out.append((x[a], y[b]))
        i, j = a + 1, b + 1
    return out


def _merge(a: Node, b: Node, pages: bool = True) -> Node:
    """The wrapper of both; pages: of different pages, else of one page's repeats.

    Calls go as deep as places nest, which takes heap alone in this interpreter.
    """
    text = a.text if a.text == b.text else 0 if None not in (a.text, b.text) else (b.text if a.text is None else a.text)
    seen = a.seen + b.seen if pages else max(a.seen, b.seen)
    contents = a.contents if a.contents == b.contents else [sorted({*p, *q})[:MOST_CONTENTS] for p, q in zip(a.contents, b.contents)]
    new = Node(a.key, min(a.skip, b.skip), max(a.main, b.main), seen, a.mass + b.mass, text, a.optional or b.optional, a.repeated or b.repeated, contents)
    x, y = a.kids, b.kids
    if [k.key for k in x] != [k.key for k in y]:
        x, y = _fold(x), _fold(y)
    for p, q in _align(x, y) if [k.key for k in x] != [k.key for k in y] else zip(x, y):
        if p and q:
            new.kids.append(_merge(p, q, pages))
        else:
            new.kids.append(p or q)
            new.kids[-1].optional = True
    return new


def _bounded(root: Node) -> Node:
    """The wrapper with its MOST_PLACES places that most pages have; no place is kept without the one that holds it."""
    every, stack = [], [(root, 0)]
    while stack:
        node, depth = stack.pop()
        every.append((-node.seen, depth, len(every), node))
        stack += [(k, depth + 1) for k in reversed(node.kids)]
    if len(every) > MOST_PLACES:
        kept = {id(x[3]) for x in sorted(every)[:MOST_PLACES]}
        for *_, node in every:
            node.kids = [k for k in node.kids if id(k) in kept]
    return root


def _own(e: Element) -> tuple[str, int]:
    """An element's text with that of its inline parts, and how many characters of it are in links."""
    parts, links, stack = [], 0, [(x, False) for x in reversed(e.items)]
    while stack:
        x, linked = stack.pop()
        if isinstance(x, str):
            parts.append(x)
            links += len(x.strip()) if linked else 0
        elif x.tag in INLINE and not x.place and not x.skip:
            stack += [(y, linked or x.tag == "a") for y in reversed(x.items)]
        else:
            parts.append(" ")
    return " ".join("".join(parts).split()), links


def _places(e: Element) -> list[Element]:
    """The places directly below an element, through inline elements that hold none themselves."""
    return [x for x in e.items if not isinstance(x, str) and x.place]


def template(root: Element) -> Node:
    """The wrapper of a single page."""
    texts: list[str] = []
    top = Node("")
    stack, made = [(root, top)], [top]
    while stack:
        e, node = stack.pop()
        if e.tag in RAW:
            continue
        own, links = _own(e)
        if own:
            node.text, node.mass = _hash(own), max(0, len(own) - links)
            if not e.skip and node.mass:
                texts.append(own)
        for x in _places(e):
            kid = Node(x.key, x.skip, x.main)
            node.kids.append(kid)
            made.append(kid)
            stack.append((x, kid))
    # Copies with small changes share most contents: a block counts by the least of its sentences.
    content = []
    for block in (sorted(texts, key=lambda t: (-len(t), t)) + [""] * LONGEST_BLOCKS)[:LONGEST_BLOCKS]:
        sentences = [s for s in _SENTENCE.split(block) if len(s) >= 20] or [block]
        content.append([min(zlib.crc32(s.encode("utf-8", "surrogatepass")) for s in sentences)])
    for node in made:
        node.contents = content
    for node in reversed(made):
        node.kids = _fold(node.kids)
    return top


def packed(node: Node) -> str:
    return json.dumps(_bounded(node).pack(), separators=(",", ":"), ensure_ascii=False)


def merge_wrappers(wrappers: list[str]) -> str:
    nodes = [Node.unpack(json.loads(w)) for w in wrappers]
    while len(nodes) > 1:
        nodes = [_bounded(_merge(*nodes[k : k + 2])) if k + 1 < len(nodes) else nodes[k] for k in range(0, len(nodes), 2)]
    return packed(nodes[0])


def weigh(root: Node) -> Node:
    """Set prose and fixed of every node of a wrapper."""
    every, stack = [], [(root, root)]
    while stack:
        node, holder = stack.pop()
        every.append((node, holder))
        stack += [(k, node) for k in node.kids]
    for node, holder in reversed(every):
        # The same with many contents, and on most pages that have what holds it.
        same = bool(node.text) and node.distinct() >= max(FURNITURE_CONTENTS, min(MOST_CONTENTS, node.seen) / 2) and 2 * node.seen >= holder.seen
        tag = node.tag
        node.prose = 0.0 if same else node.mass / node.seen * (1.0 if tag in PROSE else LOOSE)
        for k in node.kids:
            if k.skip < HARD:
                often = k.repeated and k.tag in CONTAINERS
                node.prose += k.prose * k.seen / node.seen * (REPEATED if often else 1.0) * (WORDED if k.skip else 1.0)
        node.fixed = (same or node.text is None) and all(k.fixed for k in node.kids) and (same or bool(node.kids)) and tag not in FLOW
        if node.text is None and not node.kids and tag not in FLOW:
            node.fixed = True  # nothing to show at all
        elif same and tag in FLOW and all(k.fixed for k in node.kids):
            node.fixed = True  # counts for the group that holds it
    return root


def _met(e: Element, node: Node | None) -> list[tuple[Element, Node | None]]:
    """The places below an element with their nodes of the wrapper."""
    kids = _places(e)
    if node is None or not node.kids:
        return [(x, None) for x in kids]
    if len(kids) == len(node.kids) and all(x.key == n.key for x, n in zip(kids, node.kids)):
        return list(zip(kids, node.kids))
    theirs, found = _by_key(node.kids), [None] * len(kids)
    for key, mine in _by_key(kids).items():
        other = [node.kids[k] for k in theirs.get(key, [])]
        need = [n for n in other if not n.optional]
        pool = other if len(mine) != len(need) else need
        for k, at in enumerate(mine):
            found[at] = pool[min(k, len(pool) - 1)] if pool else None
    return list(zip(kids, found))


def find_article(root: Element, wrapper: Node) -> tuple[Element, Node | None, list[Element]]:
    """The article's element, its node, and headings before it that belong to it."""
    e, node, heads = root, wrapper, []
    while True:
        kids = [(x, n) for x, n in _met(e, node) if x.skip < HARD and x.tag not in RAW]
        often = Counter(id(n) for _, n in kids if n is not None)
        weights = []
        for x, n in kids:
            w = n.prose / often[id(n)] if n is not None else LOOSE * x.whole
            w *= (REPEATED if n is not None and n.repeated and x.tag in CONTAINERS else 1.0) * (WORDED if x.skip else 1.0) * (MARKED if x.main else 1.0)
            weights.append(w)
        inner = sum(n.prose * n.seen / node.seen * (WORDED if n.skip else 1.0) for n in node.kids if n.skip < HARD) if node else 0.0
        own = max(0.0, node.prose - inner) if node else 0.0
        total = own + sum(weights)
        able = [(w, -k) for k, (w, (x, _)) in enumerate(zip(weights, kids)) if x.tag not in FLOW]
        best = max(able, default=(0.0, 0))
        sole = len(kids) == 1 and not _own(e)[0]
        if not able or not total > 0 and not sole or best[0] < SHARE * total and not sole or kids[-best[1]][0].tag in FLOW:
            return e, node, heads
        chosen, next_node = kids[-best[1]]
        if chosen.main >= 2:
            heads = []
        else:
            before = [x for x, n in kids[: -best[1]] if x.tag == "h1" and not x.skip and n is not None and not n.fixed]
            heads = before or heads
        e, node = chosen, next_node


def _holds_article(node: Node | None, holder: Node | None) -> bool:
    """Whether a place with a furniture word is where the host's pages put their varying text."""
    return node is not None and holder is not None and node.prose * node.seen * 2 >= holder.prose * holder.seen > 0 and node.distinct() >= FURNITURE_CONTENTS


def article_blocks(article: Element, node: Node | None) -> list[str]:
    """The article's blocks of text in page order, furniture left out."""
    blocks: list[str] = []
    line: list[str] = []

    def end() -> None:
        words = entities.unescape("".join(line)).split()
        line.clear()
        if words:
            blocks.append(" ".join(words))

    # Entries: a text, the end of a block (None), or an element with its node, its holder's, and whether only headings count.
    stack: list = [(article, node, None, False)]
    while stack:
        entry = stack.pop()
        if entry is None:
            end()
            continue
        if isinstance(entry, str):
            line.append(entry)
            continue
        e, node, holder, heads_only = entry
        if e is not article:
            if e.tag in RAW or e.skip == HARD and e.tag != "header" or e.skip == WORD and not _holds_article(node, holder):
                if e.place:
                    end()
                continue
            if node is not None and node.fixed and e.tag not in FLOW and e.tag not in INLINE:
                end()
                continue
            if e.skip == HARD:  # the article's own head line is part of it
                heads_only = True
        inline = e.tag in INLINE and not e.place
        if not inline:
            end()
            stack.append(None)
        met = {id(x): n for x, n in _met(e, node)} if e.place or e is article else {}
        heads = heads_only and e.tag not in HEADINGS
        for x in reversed(e.items):
            if not isinstance(x, str):
                stack.append((x, met.get(id(x)), node, heads))
            elif not heads:
                stack.append(x)
    end()
    return blocks


def main_text(page: str | None, wrapper: Node | None = None) -> str:
    """The article of a page in one line; empty for null, empty and textless pages.

    wrapper: the weighed wrapper of the page's host; without one the page stands alone.
    """
    root = parse(page)
    wrapper = wrapper or weigh(template(root))
    article, node, heads = find_article(root, wrapper)
    body = article_blocks(article, node)
    if heads and not any(x.tag == "h1" for x in _below(article)):
        body = [b for h in heads for b in article_blocks(h, None)] + body
    return " ".join(body)


def _below(e: Element) -> Iterator[Element]:
    stack = [e]
    while stack:
        x = stack.pop()
        yield x
        stack += [y for y in x.items if not isinstance(y, str)]


def host_of(url: Column) -> Column:
    """Lower-case host of an address, empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def _partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Wrappers of the hosts of each batch."""
    for rows in batches:
        out = []
        for host, pages in rows.groupby("host")["html"]:
            node = None
            # Equal pages say nothing about what varies.
            for page in dict.fromkeys(pages.fillna("")):
                one = _bounded(template(parse(page)))
                node = one if node is None else _bounded(_merge(node, one))
            out.append((host, packed(node)))
        yield pd.DataFrame(out, columns=["host", "wrapper"])


def _merged(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"host": [key[0]], "wrapper": [merge_wrappers(sorted(rows["wrapper"]))]})


def infer_wrappers(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """(host, wrapper) for every host of a table of pages, from all of its pages."""
    rows = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
    left = durable(rows.mapInPandas(_partial, "host string, wrapper string").distinct())
    while True:
        counts = left.groupBy("host").agg(F.count("*").alias("n"))
        if counts.filter("n > 1").isEmpty():
            return left
        counts = counts.withColumnRenamed("host", "_host")
        dealt = left.join(counts, F.col("host") == F.col("_host")).drop("_host")
        bucket = F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("n") / FAN_IN))
        dealt = dealt.select("host", "wrapper", bucket.alias("bucket"))
        left = durable(dealt.groupBy("host", "bucket").applyInPandas(_merged, "host string, wrapper string"))


class _Known(dict):
    """Weighed wrappers by host, of a bounded number of places in all."""

    places = 0

    def of(self, host: str, wrapper: str | None) -> Node | None:
        if host not in self:
            rows = json.loads(wrapper) if wrapper else []
            self.places += 1 + len(rows)
            if self.places > KNOWN_PLACES:
                self.clear()
                self.places = 1 + len(rows)
            self[host] = weigh(Node.unpack(rows)) if rows else None
        return self[host]


@F.pandas_udf(T.StringType())
def _extracted(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    known = _Known()
    for pages, hosts, wrappers in parts:
        yield pd.Series([main_text(p, known.of(h, w)) for p, h, w in zip(pages, hosts, wrappers)], dtype="object")


def with_main_text(pages: DataFrame, html: str = "html", url: str = "url", into: str = "text") -> DataFrame:
    """Add the main text of every page, in place of a column of that name; all rows and other columns stay.

    Null and empty pages have an empty text; pages without a host share one wrapper.
    Repeated pages each keep their row; ties between places go to the first on the page.
    An empty table stays empty. Columns may have any names.
    """
    inferred = infer_wrappers(pages, html, url)
    size = inferred.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0
    if size <= MOST_BROADCAST:
        shared = pages.sparkSession.sparkContext.broadcast({r.host: r.wrapper for r in inferred.toLocalIterator()})

        @F.pandas_udf(T.StringType())
        def text_of(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            known = _Known()
            for values, hosts in parts:
                yield pd.Series([main_text(p, known.of(h, shared.value.get(h))) for p, h in zip(values, hosts)], dtype="object")

        return pages.withColumn(into, text_of(F.col(html), host_of(F.col(url))))
    host, wrapper = private(pages, "_host", "_wrapper")
    joined = pages.join(inferred.select(F.col("host").alias(host), F.col("wrapper").alias(wrapper)), host_of(F.col(url)) == F.col(host), "left")
    return joined.withColumn(into, _extracted(F.col(html), host_of(F.col(url)), F.col(wrapper))).drop(*({host, wrapper} - {into}))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars of every page; see with_main_text."""
    seen = with_main_text(table(spark, sf_dir, "pages"))
    return seen.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
