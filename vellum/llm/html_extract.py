"""Main text of web pages by minimum-cut labelling.

A page is parsed into blocks of text. A rule-based classifier gives each block a cost of being content and of being
boilerplate: the capacities of its edges to the two terminals. Neighbours in page order and blocks close in the document
tree are joined by smoothness edges. The minimum cut, found by max-flow, parts content from boilerplate with the least
total cost. Blocks on the content side are joined in page order.

A name or tag counts by what its element holds, once the page is read: not if it wraps the page or its main part, and a name for
something short not if it holds prose.

Cases: null or empty html gives an empty text; a page without blocks too, and an empty table no rows; unclosed and stray tags
are tolerated; a page of any length is read whole, in time proportional to its length; ties in the cut go to boilerplate;
repeated rows get one result each; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

_NAME = r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)"
#: A quote opens a value only behind an equals sign. Possessive, so that a failure costs one scan.
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<{_NAME}((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>|<[!?][^>]*+>", re.S)
_OPEN = re.compile(r"<(?:/?[a-zA-Z]|[!?])")
#: After a tag that nothing closes: a tag ends before the next one begins, so that the rest is read in one scan.
_PLAIN = re.compile(rf"<!--.*?(?:-->|\Z)|<{_NAME}([^<>]*+)>|<[!?][^<>]*+>", re.S)
#: An attribute with its value consumed, so that nothing within a value is taken for a name.
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?|\"[^\"]*\"|'[^']*'")
#: The attributes that are looked at; of a name given twice the first counts.
_NAMES = frozenset("class id role hidden itemprop style".split())
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Elements whose content is raw: it ends at their end tag or with the page.
RAW = frozenset("script style textarea template".split())
#: Elements whose content is no text. One that isn't closed, or only behind another of its kind, is empty.
SKIPPED = RAW | frozenset("noscript svg select option button iframe object canvas head title audio video annotation annotation-xml".split())
#: Elements that run within a line of text; all others part blocks.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mspace semantics mfenced mpadded".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of the key ends where one of these begins.
ENDS = {k: frozenset(v.split()) for k, v in {
    "p": "p div section article nav footer header aside main ul ol dl table form h1 h2 h3 h4 h5 h6 blockquote pre figure hr address details fieldset",
    "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr", "td": "td th tr", "th": "td th tr",
}.items()}

_BAD_TAG = {"nav": 6.0, "footer": 6.0, "aside": 6.0, "form": 6.0, "menu": 6.0, "dialog": 6.0, "header": 2.5}
_GOOD_TAG = {"article": 3.0, "main": 2.0}
#: Parts of class names and ids that mark boilerplate wherever they stand.
_BAD_PART = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs footer masthead sidebar aside widget widgets ad ads advert adverts advertisement advertorial sponsor sponsored"
    " cookie cookies consent gdpr popup modal comment comments disqus respond reply replies share sharing newsletter subscribe signup pagination pager toolbar".split()
)
#: Parts that mark it where they are the whole name, or all but a word for a container.
_BAD_WHOLE = frozenset("header foot side promo promotion banner notice alert overlay discussion thread threads responses social related recommend recommended recommendations more login search copyright legal disclaimer skip tag tags meta".split())
_CONTAINER = frozenset("site page main top bottom left right posts post articles article items item links link list bar box block section container wrapper wrap area inner content widget panel group buttons icons nav row".split())
#: Parts that mark what readers wrote. It may be long; all else that a name marks is short or made of links.
_READERS = frozenset("comment comments disqus respond reply replies discussion thread threads responses".split())
#: Parts that say how an element is laid out, so that the name tells nothing of what it holds.
_LAYOUT = frozenset("no not has with without is are hide hidden show open opened close closed collapsed expanded active enabled disabled toggle toggled sticky fixed left right full wide".split())
#: Parts of a phrase: a title made into a name.
_PHRASE = frozenset("a an and are as at by for from how in into is it its of on or our that the their this to vs what when where which who why with your".split())
_GOOD_NAME = re.compile(r"(?:^|[\s_-])(?:article|content|entry|post|story|body|text|main|prose|article-?body|post-?content|entry-?content)(?:$|[\s_-])", re.I)
_BAD_ROLE = frozenset(["navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"])
_NOTICE = re.compile(r"^(?:©|\(c\) |copyright\b|all rights reserved|we use cookies|this (?:site|website) uses cookies|accept (?:all )?cookies|subscribe|sign up|advertisement|sponsored|share this|read more|skip to)", re.I)


@dataclass(frozen=True)
class Weights:
    adjacent: float = 0.4
    same_parent: float = 0.8
    near: float = 0.2
    bad_name: float = 5.0
    #: Share of it that a doubtful name has within an article.
    in_article: float = 0.2
    good_name: float = 1.5
    link: float = 4.0
    long_text: float = 1.5
    notice: float = 3.0
    #: What a block with no sign of its own leans to.
    outside: float = 0.3
    #: An element with more than this share of the page's text wraps the page, if no main part stands outside it.
    wrapper: float = 0.6
    #: Characters of unlinked prose, and of its longest block, from which a name for something short isn't believed; links it may have.
    prose: int = 250
    paragraph: int = 150
    prose_links: float = 0.2


def bad_name(value: str, in_article: bool, w: Weights) -> tuple[float, bool]:
    """What the names in a class or id attribute cost at most, and whether they speak of readers. Within an article a name that may mean
    other things counts far less; a name of layout, or a phrase, counts nothing."""
    worst, readers = 0.0, False
    for token in value.lower().split():
        parts = [p for p in re.split(r"[-_]+", token) if p]
        bad = _BAD_PART.intersection(parts)
        whole = not _BAD_WHOLE.isdisjoint(parts) and all(p in _BAD_WHOLE or p in _CONTAINER for p in parts)
        if not bad and not whole:
            continue
        if len(parts) > 1 and not _LAYOUT.isdisjoint(parts) and not (set(parts) <= bad | _CONTAINER):
            continue
        if len(parts) > 2 and not _PHRASE.isdisjoint(parts):
            continue
        worst = max(worst, w.bad_name if bad else w.bad_name * (w.in_article if in_article else 1.0))
        readers = readers or not _READERS.isdisjoint(parts)
    return worst, readers


class _Node:
    __slots__ = ("tag", "bad", "good", "parent", "gone", "in_article", "named", "readers", "told", "praised", "is_main", "text", "linked", "longest", "mains")

    def __init__(self, tag: str, attrs: str, parent: _Node | None, w: Weights):
        self.tag, self.parent = tag, parent
        self.gone = parent is not None and parent.gone
        #: What the tag and the role cost, what the name costs at most, what speaks for content.
        self.told, self.named, self.readers, self.praised = 0.0, 0.0, False, 0.0
        self.text = self.linked = self.longest = self.mains = 0
        self.in_article = parent is not None and (parent.in_article or parent.tag == "article")
        if tag in _BAD_TAG:
            # A header of the article itself holds its title.
            self.told += 0.0 if tag == "header" and self.in_article else _BAD_TAG[tag]
        elif tag in _GOOD_TAG and (not self.in_article or tag == "main"):
            # An article within another, or within a comment list, is a comment or a teaser, not the main text.
            self.praised = _GOOD_TAG[tag]
        self.is_main = tag in ("main", "h1") or (tag == "article" and not self.in_article)
        if attrs:
            seen = set()
            for name, a, b, c in _ATTR.findall(attrs):
                value = a or b or c
                name = name.lower()
                if name not in _NAMES or name in seen:
                    continue
                seen.add(name)
                if name == "hidden" or (name == "style" and _UNSEEN.search(value)):
                    self.gone = True
                elif name == "role":
                    self.told += w.bad_name if value.lower() in _BAD_ROLE else 0
                    self.is_main = self.is_main or value.lower() == "main"
                elif name != "style" and tag not in ("body", "html"):
                    cost, readers = bad_name(value, self.in_article, w)
                    self.named, self.readers = self.named + cost, self.readers or readers
                    if not cost and _GOOD_NAME.search(value):
                        self.praised = max(self.praised, w.good_name)
                        self.is_main = self.is_main or value.lower() == "articlebody"
        self.weigh(self.told, self.named)

    def weigh(self, told: float, named: float) -> None:
        up = self.parent
        self.bad, self.good = (up.bad if up else 0.0) + told + named, max(up.good if up else 0.0, self.praised)

    def settle(self, page: int, mains: int, w: Weights) -> None:
        """Count the tag and the name by what the element turned out to hold."""
        told, named = self.told, self.named
        if told or named:
            main_inside = self.mains > self.is_main
            if self.text > w.wrapper * page and (main_inside or not mains) and self.linked < 0.5 * self.text:
                told = named = 0.0  # it wraps the page
            elif main_inside and not self.readers and self.tag in ("div", "section", "body", "form", "center", "table", "tbody", "tr", "td"):
                told = named = 0.0
            elif named and not self.readers and self.text - self.linked >= w.prose and self.longest >= w.paragraph and self.linked <= w.prose_links * self.text and (self.in_article or not mains):
                named *= w.in_article * 0.5
        self.weigh(told, named)


@dataclass
class Block:
    text: str
    node: _Node
    linked: int


class _Ahead:
    """Where tags of a name come next; each is searched for once on the way through a page."""

    def __init__(self, page: str):
        self.page, self.known, self.made = page, {}, {}

    def find(self, tag: str, at: int, ends: bool) -> tuple[int, int] | None:
        """Start and end of the next tag from at on."""
        key = tag, ends
        if key not in self.made:
            self.made[key] = re.compile(rf"</{tag}\s*>" if ends else rf"<{tag}(?=[\s/>])", re.I)
        place = self.known.get(key, (-1, -1))
        if place is not None and place[0] < at:
            found = self.made[key].search(self.page, at)
            place = self.known[key] = found.span() if found else None
        return place


def _past(ahead: _Ahead, tag: str, at: int) -> int:
    """Where the content of an element that holds no text ends: behind its end tag."""
    end = ahead.find(tag, at, True)
    if end is None:
        return len(ahead.page) if tag in RAW else at
    if tag not in RAW and tag not in ("svg", "object") and (other := ahead.find(tag, at, False)) and other[0] < end[0]:
        return at
    return end[1]


def blocks(page: str, w: Weights = Weights()) -> list[Block]:  # noqa: B008
    """The page's blocks of text in order: white space as single spaces, references decoded."""
    root = _Node("html", "", None, w)
    stack, nodes, out, buf = [root], [root], [], []
    at, links, linked, token, ahead = 0, 0, 0, _TOKEN, _Ahead(page)
    standing: Counter[str] = Counter()  # open elements by tag, without the root

    def close() -> None:
        nonlocal linked
        if buf:
            text = " ".join(html.unescape("".join(buf)).split())
            if text and not stack[-1].gone:
                out.append(Block(text, stack[-1], min(linked, len(text))))
            buf.clear()
        linked = 0

    while at < len(page):
        begin = page.find("<", at)
        piece = page[at:begin] if begin >= 0 else page[at:]
        if piece:
            buf.append(piece)
            if links:
                linked += len(piece)
        if begin < 0:
            break
        m = token.match(page, begin)
        if m is None and token is _TOKEN and _OPEN.match(page, begin):
            token = _PLAIN  # nothing closes this tag
            m = token.match(page, begin)
        if m is None:
            buf.append("<")
            at = begin + 1
            continue
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                links = 0 if m[1] else 1
            continue
        if tag == "br":
            buf.append(" ")
            continue
        if not m[1] and tag in SKIPPED:
            if not m[3].endswith("/"):
                at = _past(ahead, tag, at)
            buf.append(" ")
            continue
        close()
        links = 0
        if m[1]:
            while standing[tag]:
                standing[stack[-1].tag] -= 1
                if stack.pop().tag == tag:
                    break
            continue
        while len(stack) > 1 and tag in ENDS.get(stack[-1].tag, ()):
            standing[stack.pop().tag] -= 1
        if tag not in VOID and not m[3].endswith("/"):
            stack.append(_Node(tag, m[3], stack[-1], w))
            nodes.append(stack[-1])
            standing[tag] += 1
    close()
    for b in out:
        b.node.text += len(b.text)
        b.node.linked += b.linked
        b.node.longest = max(b.node.longest, len(b.text) - b.linked)
    for n in reversed(nodes):  # children before their parents
        n.mains += n.is_main and n.text > 0
        if up := n.parent:
            up.text, up.linked, up.longest, up.mains = up.text + n.text, up.linked + n.linked, max(up.longest, n.longest), up.mains + n.mains
    for n in nodes:
        n.settle(root.text, root.mains, w)
    return out


def costs(block: Block, w: Weights) -> tuple[float, float]:
    """What it costs to call a block content, and to call it boilerplate."""
    n = len(block.text)
    density = block.linked / max(1, n)
    as_content = block.node.bad + (w.link * density if density > 0.5 else 0.0)
    as_boiler = block.node.good
    if _NOTICE.match(block.text):
        as_content += w.notice * (n < 200) * (0.5 if block.node.good >= 3 else 1.0)
    if block.node.bad == 0 and density < 0.3:
        as_boiler += w.long_text * min(1.0, n / 200)
        if block.node.tag in ("p", "blockquote", "pre", "h1"):
            as_boiler += 0.3
    return as_content + w.outside, as_boiler


def smoothness(a: _Node, b: _Node, w: Weights) -> float:
    """The closer two neighbouring blocks are in the tree, the dearer it is to part them."""
    if a is b or a.parent is b.parent:
        return w.adjacent + w.same_parent
    if a.parent is b or b.parent is a or (a.parent and b.parent and a.parent.parent is b.parent.parent):
        return w.adjacent + w.near if a.bad == b.bad and a.good == b.good else w.near
    return w.adjacent if a.bad == b.bad and a.good == b.good else w.near


def min_cut(to_content: list[float], to_boiler: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (content or not) of least cost: a block pays to_boiler as content, to_content as boilerplate; parted edges pay their weight.

    Max-flow in phases: each sends a blocking flow along shortest paths, and an arc once found useless in a phase isn't tried
    again in it. What a block can send straight from source to sink is taken off first.
    """
    n, least = len(to_content), 1e-9
    s = [max(0.0, a - b) for a, b in zip(to_content, to_boiler, strict=True)]
    t = [max(0.0, b - a) for a, b in zip(to_content, to_boiler, strict=True)]
    joined: dict[tuple[int, int], float] = {}
    for a, b, c in edges:
        joined[min(a, b), max(a, b)] = joined.get((min(a, b), max(a, b)), 0.0) + c
    arcs: list[list[int]] = [[] for _ in range(n)]
    head, room = [], []  # arc k leads to head[k]; k ^ 1 is its reverse
    for (a, b), c in joined.items():
        arcs[a].append(len(head))
        arcs[b].append(len(head) + 1)
        head += [b, a]
        room += [c, c]
    while True:
        level = [0 if x > least else -1 for x in s]
        queue = [i for i in range(n) if level[i] == 0]
        end = False
        for i in queue:
            end = end or t[i] > least
            for k in arcs[i]:
                if room[k] > least and level[head[k]] < 0:
                    level[head[k]] = level[i] + 1
                    queue.append(head[k])
        if not end:
            return [x >= 0 for x in level]
        tried = [0] * n
        for start in range(n):
            path, i = [], start
            while s[start] > least:
                if t[i] > least:
                    flow = min([s[start], t[i], *[room[k] for k in path]])
                    s[start] -= flow
                    t[i] -= flow
                    for k in path:
                        room[k] -= flow
                        room[k ^ 1] += flow
                    cut = next((j for j, k in enumerate(path) if room[k] <= least), len(path))
                    i = head[path[cut] ^ 1] if cut < len(path) else i
                    del path[cut:]
                    continue
                while tried[i] < len(arcs[i]) and not (room[k := arcs[i][tried[i]]] > least and level[head[k]] == level[i] + 1):
                    tried[i] += 1
                if tried[i] < len(arcs[i]):
                    path.append(arcs[i][tried[i]])
                    i = head[path[-1]]
                elif path:
                    i = head[path.pop() ^ 1]
                    tried[i] += 1
                else:
                    break


def main_blocks(page: str, w: Weights = Weights()) -> list[str]:  # noqa: B008
    """Texts of the blocks on the content side of the cut."""
    found = blocks(page, w)
    if not found:
        return []
    pairs = [costs(b, w) for b in found]
    edges = [(k, k + 1, smoothness(found[k].node, found[k + 1].node, w)) for k in range(len(found) - 1)]
    # Proximity in the tree beyond neighbours: each block and the block before it with the same parent.
    last: dict[int, int] = {}
    for k, b in enumerate(found):
        key = id(b.node.parent)
        if key in last and last[key] < k - 1:
            edges.append((last[key], k, w.same_parent))
        last[key] = k
    labels = min_cut([b for _, b in pairs], [a for a, _ in pairs], edges)
    return [b.text for b, content in zip(found, labels, strict=True) if content]


def extract(pages: DataFrame, keep: list[str] | None = None, html_col: str = "html", weights: Weights = Weights()) -> DataFrame:  # noqa: B008
    """One row for each page: keep, text (its main text) and n_chars. One pass, no shuffle."""
    keep = keep or ["page_id", "url"]
    given = pages.select(*keep, *([] if html_col in keep else [html_col]))
    made = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [" ".join(main_blocks(h, weights)) if h else "" for h in batch.column(batch.schema.get_field_index(html_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return given.mapInArrow(run, f"{made}, text string, n_chars long")
