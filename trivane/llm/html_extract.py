"""Main text of web pages by wrapper induction.

Pages are parsed once. A page's frame is the tree of its structural elements (nothing below an article); runs of siblings of
one shape count once in it. Frames of a host that simple tree matching (Yang 1991) aligns in the share ALIKE of the larger
one are one layout; the layout's most frequent frame stands for it, every other frame of the layout is aligned with that one,
and the matched elements are the wrapper's places. Over the distinct pages of a layout, or of the host, the wrapper learns

- constant nodes: a block that is the same, at its place, in at least CONSTANT of the pages is template and is dropped;
- slots: places whose text varies from page to page. From the body down it goes to the slot that holds DOMINANT of the varying
  text outside links, as long as what stays behind are slots of a line (LINE characters a page) and no varying text of the
  element itself; then up again until the varying h1 is inside. That is the content slot; what lies outside is furniture.

Where the wrapper has no content slot (fewer than LEAST distinct pages, no host, no dominant slot) or the slot encloses a main or
article element together with other things, the page's own tags decide: the main element that holds several article elements,
else the largest article element and those beside it, else main, else
the element marked as content, else the body; there, without an article or main element, blocks of links alone are menus. Inside
either, elements that say what they are go: menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments, by tag, role, class or id; a class counts only if all its words are of that kind or neutral. Character
references are decoded, white space in a block becomes one space, and blocks are joined by a newline, in page order.

Pages are parsed whole, broken markup and any depth included. A null html counts as empty and gives an empty text. Repeated
rows get equal results, an empty table gives an empty result, extra columns are not read."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trivane.llm.common import arrow_map, partitions, sorted_groups, stored
from trivane.session import gathered

LEAST, CONSTANT, ALIKE = 4, 0.6, 0.6
DOMINANT, LINE = 0.8, 160

_TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"\s+")
_TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {t: re.compile(rf"</{t}\s*(?:[/\s][^>]*)?(?:>|\Z)", re.I) for t in "script style noscript template iframe textarea title xmp noembed noframes svg math".split()}
BLOCK = frozenset(
    "html body address article aside blockquote center details dd dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option select legend".split()
)
CLOSES = {
    "li": ("li", ("ul", "ol", "menu", "dir")),
    "dt": ("dt dd", ("dl",)),
    "dd": ("dt dd", ("dl",)),
    "tr": ("tr td th", ("table", "thead", "tbody", "tfoot")),
    "td": ("td th", ("tr", "table")),
    "th": ("td th", ("tr", "table")),
    "option": ("option", ("select", "datalist")),
}
CLOSES = {k: (frozenset(a.split()), frozenset(b)) for k, (a, b) in CLOSES.items()}
DROP_TAGS = frozenset("nav footer aside form head button select input menu dialog object embed audio video canvas datalist label".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist status".split())
#: Elements that make up a page's frame.
FRAME_TAGS = frozenset("html body div section main article header footer nav aside form table".split())
#: Words of a class or id that say what an element is.
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notification notifications alert popup modal overlay paywall nav navbar navigation menu menus breadcrumb breadcrumbs crumbs sidebar sidenav rail aside footer header masthead topbar comment comments commentlist disqus respond reply replies share sharing social related recommended recommendations newsletter subscribe subscription signup login search toolbar pagination pager widget widgets skip hidden toc".split()
)
#: Words that say nothing of what an element is; a class or id of these and DROP_WORDS alone names boilerplate.
NEUTRAL_WORDS = frozenset(
    "area bar block body bottom box btn button buttons col column container content footer group header icon icons inner item items js left link links list main module outer page panel post posts primary region right row secondary section site slot top unit ul wrap wrapper".split()
)
#: These mean a page's header; inside an article they name the heading of a part of it.
HEADER_WORDS = frozenset("header masthead topbar".split())
#: Of these words, what a wrapper around the whole article may carry.
CONTENT_WORDS = frozenset("article post entry content story body main text".split())


class Node:
    __slots__ = ("attrs", "children", "label", "parent", "path", "tag", "within")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None, label: str | None = None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        name = attrs.get("class", "") if attrs else ""
        self.label = label or (f"{tag}.{'.'.join(sorted(name.split()))}" if name else tag)
        # A hash of the labels from the root, and the nearest article or main element above.
        self.path = xxhash.xxh3_64_intdigest(self.label, parent.path if parent else 0)
        self.within = None if parent is None else parent.tag if parent.tag in ("article", "main") else parent.within


class _Open:
    """The open elements, and where those of each tag, blocks and barriers lie among them, so that no tag scans them."""

    def __init__(self, root: Node):
        self.stack, self.at, self.blocks, self.barriers = [root], {}, [], []

    def push(self, node: Node) -> None:
        k = len(self.stack)
        self.stack.append(node)
        self.at.setdefault(node.tag, []).append(k)
        if node.tag in BLOCK:
            self.blocks.append(k)
        if node.tag in ("article", "main", "body"):
            self.barriers.append(k)

    def cut(self, to: int) -> None:
        while len(self.stack) > to:
            node, k = self.stack.pop(), len(self.stack)
            self.at[node.tag].pop()
            for marks in (self.blocks, self.barriers):
                if marks and marks[-1] == k:
                    marks.pop()

    def last(self, tags: frozenset[str]) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)


def parse(html: str) -> Node:
    """A tree of the whole page; every text is in it, but for comments and the contents of scripts and the like."""
    root = Node("#root", {}, None)
    up, at, end = _Open(root), 0, len(html)
    stack = up.stack
    search = _TAG.search
    while at < end:
        m = search(html, at)
        if m is None:
            stack[-1].children.append(html[at:])
            break
        if m.start() > at:
            stack[-1].children.append(html[at : m.start()])
        at = m.end()
        close, tag, attrs = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if m[1]:
            stack[-1].children.append(m[1])
        if not tag:
            continue
        tag = tag.lower()
        if close:
            # An end tag closes nothing beyond the article, main or body that it stands in.
            k = up.at[tag][-1] if up.at.get(tag) else 0
            if k and (tag in ("body", "html", "article", "main") or not up.barriers or k > up.barriers[-1]):
                up.cut(k)
            continue
        if tag in CLOSES:
            names, edge = CLOSES[tag]
            while (k := up.last(names)) > up.last(edge):
                up.cut(k)
                if tag != "tr":
                    break
        elif tag in BLOCK and up.blocks and stack[up.blocks[-1]].tag == "p":
            up.cut(up.blocks[-1])
        node = Node(tag, {a.lower(): b or c or d for a, b, c, d in _ATTR.findall(attrs)} if attrs and attrs != "/" else {}, stack[-1])
        stack[-1].children.append(node)
        if tag in RAW:
            if not (attrs.endswith("/") and tag in ("svg", "math")):
                stop = RAW[tag].search(html, at)
                at = stop.end() if stop else end
        elif tag not in VOID and not (attrs.endswith("/") and tag in ("path", "use", "g")):
            up.push(node)
    return root


def _words(text: str) -> list[str]:
    return [w.lower() for w in _TOKENS.findall(text)]


def _names(node: Node) -> list[list[str]]:
    """The words of each class, and of the id."""
    if not node.attrs:
        return []
    return [w for c in [*node.attrs.get("class", "").split(), node.attrs.get("id", "")] if (w := _words(c))]


def _walk(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += [c for c in reversed(n.children) if not isinstance(c, str)]
    return out


def _named_boilerplate(node: Node) -> bool:
    if node.attrs:
        if node.attrs.get("role", "").lower() in DROP_ROLES or "hidden" in node.attrs or node.attrs.get("aria-hidden") == "true":
            return True
        if "display:none" in node.attrs.get("style", "").replace(" ", "").lower():
            return True
        for words in _names(node):
            named = DROP_WORDS.intersection(words)
            if named and all(w in DROP_WORDS or w in NEUTRAL_WORDS or w.isdigit() for w in words):
                if not (named <= HEADER_WORDS and node.within):
                    return True
    return False


def boilerplate(root: Node) -> set[int]:
    """ids of the elements that say that they are no content; what lies below them isn't looked at."""
    every = _walk(root)
    out: set[int] = set()
    # Elements around the article may bear any name: "page with-sidebar", a form around the whole page.
    around: set[int] = set()
    for n in every:
        if n.tag in ("article", "main") and not any(DROP_WORDS.intersection(w) for w in _names(n)) or n.tag == "h1":
            inside = n.parent
            while inside is not None and id(inside) not in around:
                if n.tag == "h1" and inside.tag in ("header", "hgroup"):
                    break
                around.add(id(inside))
                inside = inside.parent
    for n in every:
        if n.tag in RAW or n.tag in ("head", "#root", "html", "body", "main"):
            if n.tag in RAW or n.tag == "head":
                out.add(id(n))
            continue
        if n.tag in DROP_TAGS:
            if not (n.tag in ("form", "object") and id(n) in around):
                out.add(id(n))
        elif n.tag == "header":
            if n.within != "article":
                out.add(id(n))
        elif id(n) not in around and _named_boilerplate(n):
            out.add(id(n))
    return out


def _text_lengths(root: Node, skip: set[int]) -> dict[int, int]:
    """Characters below each element, those of skipped elements left out, by id."""
    out: dict[int, int] = {}
    for n in reversed(_walk(root)):
        out[id(n)] = 0 if id(n) in skip else sum(len(c.strip()) if isinstance(c, str) else out[id(c)] for c in n.children)
    return out


def scope(root: Node, skip: set[int]) -> tuple[list[Node], bool]:
    """The elements that hold the article, and whether the page says so by its tags.

    Of several article elements, none in another, a main element that holds more than one is taken as a whole; without such, the
    largest one and those beside it."""
    found: dict[str, list[Node]] = {"article": [], "main": [], "marked": [], "named": []}
    todo = [root]
    while todo:
        n = todo.pop()
        if id(n) in skip:
            continue
        if n.tag in ("article", "main"):
            found[n.tag].append(n)
        elif n.attrs:
            if n.attrs.get("role") in ("main", "article") or n.attrs.get("itemprop") == "articleBody":
                found["marked"].append(n)
            elif n.tag in ("div", "section", "td") and any(CONTENT_WORDS.intersection(w) for w in _names(n)):
                found["named"].append(n)
        todo += [c for c in n.children if not isinstance(c, str)]
    size = _text_lengths(root, skip) if any(found.values()) else {}
    largest = lambda nodes: max(enumerate(nodes), key=lambda x: (size[id(x[1])], -x[0]))[1]
    if found["article"]:
        every = {id(n) for n in found["article"]}
        inner = {id(c) for n in found["article"] for c in _walk(n)[1:] if id(c) in every}
        outer = [n for n in found["article"] if id(n) not in inner and size[id(n)]]
        holders = [m for m in found["main"] if sum(id(c) in every - inner and bool(size[id(c)]) for c in _walk(m)) > 1]
        if len(outer) > 1 and holders:
            return [largest(holders)], True
        top = largest(found["article"])
        return [n for n in outer if n.parent is top.parent] or [top], True
    for kind in ("main", "marked"):
        if found[kind]:
            return [largest(found[kind])], True
    # The innermost of those that hold most of the text.
    large = [n for n in found["named"] if size[id(n)] >= 0.5 * size[id(root)] and size[id(n)] > 0]
    return [large[-1] if large else root], False


@dataclass(slots=True)
class Block:
    node: Node  # the block element
    text: str
    chars: int  # outside links
    menu: bool  # links alone
    inside: bool  # in the element that the page's tags choose


def blocks(root: Node, skip: set[int], tops: list[Node] | None = None) -> list[Block]:
    """The blocks of the page, in order; tops are the elements chosen by tags, all of the page if there is none."""
    out: list[Block] = []
    parts: list[str] = []
    state = [root, 0, 0]  # the element that the open block belongs to, characters of text and of links
    chosen = {id(n) for n in tops or [root]}
    links, inside = 0, int(id(root) in chosen)

    def close(node: Node) -> None:
        if parts:
            text = _SPACE.sub(" ", unescape("".join(parts))).strip()
            if text:
                out.append(Block(state[0], text, state[1] - state[2], bool(state[1]) and state[2] >= 0.8 * state[1], inside > 0))
            parts.clear()
        state[:] = [node, 0, 0]

    todo: list = [(root, 0)]
    while todo:
        n, done = todo.pop()
        if isinstance(n, str):
            parts.append(n)
            size = len(n.strip())
            state[1] += size
            state[2] += size if links else 0
            continue
        if done:
            if n.tag in BLOCK or id(n) in chosen:
                close(n.parent if n.parent is not None else n)
            links -= n.tag == "a"
            inside -= id(n) in chosen
            continue
        if id(n) in skip:
            if n.tag in BLOCK:
                close(state[0])
            continue
        if n.tag in BLOCK or id(n) in chosen:
            close(n)
        elif n.tag == "br":
            parts.append(" ")
            continue
        inside += id(n) in chosen and n is not root
        links += n.tag == "a"
        todo.append((n, 1))
        todo += [(c, 0) for c in reversed(n.children)]
    close(root)
    return out


def _key(path: int, text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace"), path) - (1 << 63)


def _kids(n: Node) -> list[Node]:
    return [c for c in n.children if not isinstance(c, str)]


def _subtrees(root: Node, known: dict[tuple, int]) -> dict[int, tuple[int, int]]:
    """(number of its form, elements) of every subtree by id; trees numbered by the same table have equal numbers if they are equal."""
    out: dict[int, tuple[int, int]] = {}
    for n in reversed(_walk(root)):
        kids = [out[id(c)] for c in _kids(n)]
        out[id(n)] = known.setdefault((n.label, *(k[0] for k in kids)), len(known)), 1 + sum(k[1] for k in kids)
    return out


def align(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Simple tree matching: the largest order-preserving match of two trees whose matched nodes have equal labels.

    Equal subtrees match as a whole. Of two lists of children, equal subtrees at either end are matched first, which no
    other match can better, so that only what lies between differing children is searched."""
    known: dict[tuple, int] = {}
    left, right = _subtrees(a, known), _subtrees(b, known)
    memo: dict[tuple[int, int], tuple[int, list]] = {}

    def match(x: Node, y: Node) -> Iterator[tuple[Node, Node]]:
        """Asks for the matches of children that it needs, and puts its own into memo."""
        p, q = _kids(x), _kids(y)
        s, e = 0, 0
        while s < min(len(p), len(q)) and left[id(p[s])][0] == right[id(q[s])][0]:
            s += 1
        while e < min(len(p), len(q)) - s and left[id(p[-1 - e])][0] == right[id(q[-1 - e])][0]:
            e += 1
        same = [*zip(p[:s], q[:s], strict=True), *zip(p[len(p) - e :], q[len(q) - e :], strict=True)]
        p, q = p[s : len(p) - e], q[s : len(q) - e]
        places: dict[str, list[int]] = {}
        for j, d in enumerate(q):
            places.setdefault(d.label, []).append(j)
        # The heaviest chain of matches that ends at or before each child of y, as prefix maxima (Fenwick 1994).
        best: list[tuple[int, tuple | None]] = [(0, None)] * (len(q) + 1)

        def upto(k: int) -> tuple[int, tuple | None]:
            top = (0, None)
            while k:
                if best[k][0] > top[0]:
                    top = best[k]
                k -= k & -k
            return top

        for c in p:
            new = []
            for j in places.get(c.label, ()):
                if left[id(c)][0] == right[id(q[j])][0]:
                    w = left[id(c)][1]
                else:
                    if (id(c), id(q[j])) not in memo:
                        yield c, q[j]
                    w = memo[id(c), id(q[j])][0]
                before, chain = upto(j)
                new.append((j + 1, before + w, (chain, (c, q[j]))))
            for at, w, chain in new:
                while at <= len(q):
                    if best[at][0] < w:
                        best[at] = (w, chain)
                    at += at & -at
        size, chain = upto(len(q))
        pairs = []
        while chain is not None:
            chain, pair = chain
            pairs.append(pair)
        memo[id(x), id(y)] = 1 + size + sum(left[id(c)][1] for c, _ in same), pairs + same

    if a.label != b.label:
        return []
    running = [match(a, b)]
    while running:
        ask = next(running[-1], None)
        if ask is None:
            running.pop()
        else:
            running.append(match(*ask))
    out, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        out.append((x, y))
        todo += memo[id(x), id(y)][1] if (id(x), id(y)) in memo else zip(_kids(x), _kids(y), strict=True)
    return out


def frame(root: Node) -> str:
    """The page's frame with all equal siblings merged, a line of depth and label for each element."""
    top = Node("#root", {}, None)
    at: dict[tuple[int, str], Node] = {}
    todo = [(root, top)]
    while todo:
        n, to = todo.pop()
        for c in n.children:
            if isinstance(c, str) or c.tag in RAW or c.tag == "head":
                continue
            if c.tag not in FRAME_TAGS:
                todo.append((c, to))
                continue
            new = at.get((id(to), c.label))
            if new is None:
                new = at[id(to), c.label] = Node(c.tag, {}, to, c.label)
                to.children.append(new)
            if c.tag != "article":
                todo.append((c, new))
    lines, walk = [], [(c, 0) for c in reversed(top.children)]
    while walk:
        n, depth = walk.pop()
        lines.append(f"{depth} {n.label}")
        walk += [(c, depth + 1) for c in reversed(n.children)]
    return "\n".join(lines)


#: Siblings that repeat in groups of up to so many are merged.
PERIOD = 16


def folded(shapes: list[int]) -> tuple[list[int], list[int]]:
    """A sequence with groups that repeat at once written once, and for each entry its place in that: a b a b a is a b a."""
    out: list[int] = []
    members: list[list[int]] = []
    for k, s in enumerate(shapes):
        out.append(s)
        members.append([k])
        p = 1
        while p <= min(PERIOD, len(out) // 2):
            if out[-1] == out[-1 - p] and out[-p:] == out[-2 * p : -p]:
                for i in range(p):
                    small, large = sorted((members[-1 - i], members[-1 - i - p]), key=len)
                    large += small
                    members[-1 - i - p] = large
                del out[-p:], members[-p:]
                p = 0
            p += 1
    at = [0] * len(shapes)
    for i, group in enumerate(members):
        for k in group:
            at[k] = i
    return out, at


def ordered_frame(root: Node) -> tuple[str, dict[int, int]]:
    """The page's frame with runs of siblings of one shape, and groups of them that repeat, merged: a line of its parent's number and label for each element,
    and for every element of the page the number of the frame's element that it lies in, by id.

    An element's shape is its label, the block elements that it holds directly, and the shapes of its parts."""
    nodes: list[Node] = []
    kids: list[list[int]] = []
    holds: list[set[str]] = []
    within: dict[int, int] = {}
    todo: list[tuple[Node, int, bool]] = [(root, -1, False)]
    while todo:
        n, at, closed = todo.pop()
        if n is root or (n.tag in FRAME_TAGS and not closed):
            nodes.append(n)
            kids.append([])
            holds.append(set())
            if at >= 0:
                kids[at].append(len(nodes) - 1)
            at, closed = len(nodes) - 1, n.tag == "article"
        elif not closed and n.tag in BLOCK:
            holds[at].add(n.tag)
        within[id(n)] = at
        todo += [(c, at, closed) for c in reversed(n.children) if not isinstance(c, str) and c.tag not in RAW and c.tag != "head"]
    known: dict[tuple, int] = {}
    shape = [0] * len(nodes)
    places: list[list[int]] = [[]] * len(nodes)
    for k in range(len(nodes) - 1, -1, -1):
        runs, places[k] = folded([shape[c] for c in kids[k]])
        shape[k] = known.setdefault((nodes[k].label, tuple(sorted(holds[k])), tuple(runs)), len(known))
    number, lines, parts_of = [0] * len(nodes), ["-1 #root"], {0: []}
    for k in range(len(nodes)):
        mine, first = parts_of[number[k]], not parts_of[number[k]]
        for c, run in zip(kids[k], places[k], strict=True):
            if first and run == len(mine):
                mine.append(len(lines))
                parts_of[len(lines)] = []
                lines.append(f"{number[k]} {nodes[c].label}")
            number[c] = mine[run]
    return "\n".join(lines), {n: number[k] for n, k in within.items()}


def _frame_tree(text: str) -> tuple[Node, dict[int, int]]:
    """A frame's tree, and the paths of its elements below the body by id."""
    top = Node("#root", {}, None)
    stack, paths = [top], {}
    for line in text.split("\n") if text else ():
        depth, label = line.split(" ", 1)
        del stack[int(depth) + 1 :]
        n = Node(label.split(".", 1)[0], {}, stack[-1], label)
        stack[-1].children.append(n)
        stack.append(n)
        if n.tag not in ("html", "body"):
            paths[id(n)] = n.path
    return top, paths


def _ordered_tree(text: str) -> list[Node]:
    out: list[Node] = []
    for line in text.split("\n"):
        up, label = line.split(" ", 1)
        n = Node(label.split(".", 1)[0], {}, out[int(up)] if out else None, label)
        if out:
            out[int(up)].children.append(n)
        out.append(n)
    return out


def places(stands: str, own: str) -> tuple[list[int], list[int], list[str]]:
    """For each element of the frame own: its place, the place above, its tag. Places are the elements of the frame that
    stands for the layout, by number; an element without a match there has a place of its own below its parent's."""
    a, b = _ordered_tree(stands), _ordered_tree(own)
    number = {id(n): k for k, n in enumerate(a)}
    at = {id(y): number[id(x)] for x, y in align(a[0], b[0])}
    for n in b[1:]:
        if id(n) not in at:
            at[id(n)] = -(xxhash.xxh3_64_intdigest(n.label, at[id(n.parent)] & ((1 << 64) - 1)) >> 2) - 2
    return [at[id(n)] for n in b], [-1, *(at[id(n.parent)] for n in b[1:])], [n.tag for n in b]


def layouts(frames: list[str]) -> list[int]:
    """For each of a host's different frames the number of the one that stands for its layout, an earlier one or itself."""
    trees = [_frame_tree(f) for f in frames]
    often = Counter(p for _, paths in trees for p in paths.values())
    leaders: dict[int, list[int]] = {}
    out = []
    for k, (tree, paths) in enumerate(trees):
        # Frames that share ALIKE of their paths share one of these, the rarest (prefix filter).
        rare = sorted(paths.values(), key=lambda p: (often[p], p))
        rare = rare[: len(rare) - math.ceil(ALIKE * len(rare)) + 1]
        own, found, best = set(paths.values()), k, 0.0
        for j in sorted({j for p in rare for j in leaders.get(p, ())}):
            other, theirs = trees[j]
            most = max(len(own), len(theirs))
            if len(own.intersection(theirs.values())) >= max(ALIKE, best) * most:
                score = sum(id(x) in theirs for x, _ in align(other, tree)) / most
                if score >= ALIKE and score > best:
                    found, best = j, score
        if found == k:
            for p in rare:
                leaders.setdefault(p, []).append(k)
        out.append(found)
    return out


@dataclass(slots=True)
class Slot:
    place: int
    up: int
    tag: str
    chars: int  # of varying text outside links directly at the place, over all pages
    text: int  # pages with such text there
    heads: int  # pages with a varying h1 there


def content_slot(slots: list[Slot], pages: int) -> tuple[int, bool] | None:
    """The place of the content, and whether it is, or lies in, a main or article element; None if none stands out."""
    at = {s.place: s for s in slots}
    below: dict[int, list[int]] = {}
    for s in slots:
        if s.place != 0:
            below.setdefault(s.up, []).append(s.place)
    order, depth = [0], {0: 0}
    for p in order:
        for c in sorted(below.get(p, ())):
            depth[c] = depth[p] + 1
            order.append(c)
    total = {p: at[p].chars for p in order}
    for p in reversed(order[1:]):
        total[at[p].up] += total[p]
    cur = 0
    while kids := below.get(cur):
        best = max(kids, key=lambda c: (total[c], -depth[c], c))
        left = all(c == best or total[c] <= LINE * pages for c in kids)
        if not left or total[best] < DOMINANT * total[cur] or total[best] == 0 or at[cur].text >= CONSTANT * pages:
            break
        cur = best
    head = max(order, key=lambda p: (at[p].heads, -depth[p], p))
    if at[head].heads >= CONSTANT * pages:
        above = set()
        while head not in above:
            above.add(head)
            head = at[head].up if head else 0
        while cur not in above:
            cur = at[cur].up
    tags, p = set(), cur
    while p:
        tags.add(at[p].tag)
        p = at[p].up
    return None if at[cur].tag in ("#root", "html", "body") else (cur, bool(tags & {"article", "main"}))


@dataclass(slots=True)
class Item:
    """A block without its tree."""

    key: int  # hash of place and text
    node: int  # the element of the ordered frame that it lies in
    chars: int
    head: bool
    inside: bool
    menu: bool
    text: str


@dataclass(slots=True)
class Page:
    items: list[Item]
    shape: str
    form: str
    sure: bool
    copy: int | None  # what copies of the page share; None without a block


def read(html: str | None) -> Page:
    root = parse(html or "")
    skip = boilerplate(root)
    tops, sure = scope(root, skip)
    found = blocks(root, skip, tops)
    form, number = ordered_frame(root)
    # Copies of one page would make its content look constant: pages of the same content, or without any of the same blocks, count once.
    own = [b.text for b in found if b.inside] or [b.text for b in found]
    items = [Item(_key(b.node.path, b.text), number[id(b.node)], b.chars, b.node.tag == "h1", b.inside, b.menu, b.text) for b in found]
    return Page(items, frame(root), form, sure, _key(0, "\0".join(own)) if own else None)


def induce(pages: list[str]) -> list[int]:
    """The constant nodes of pages of one host, as hashes of place and text; wrappers() does the same for a table."""
    keys = lambda p: [x.key for x in p.items]
    one: dict[int, Page] = {}
    shapes: Counter[str] = Counter()
    for p in map(read, pages):
        if p.copy is not None and (p.copy not in one or (p.shape, keys(p)) < (one[p.copy].shape, keys(one[p.copy]))):
            one[p.copy] = p
    for p in one.values():
        shapes[p.shape] += 1
    order = sorted(shapes, key=lambda s: (-shapes[s], _key(0, s)))
    layout = dict(zip(order, layouts(order), strict=True))
    groups: dict[int, list[list[int]]] = {-1: [keys(p) for p in one.values()]}
    for p in one.values():
        groups.setdefault(layout[p.shape], []).append(keys(p))
    out: set[int] = set()
    for group in groups.values():
        if len(group) >= LEAST:
            out |= {k for k, c in Counter(k for items in group for k in set(items)).items() if c >= CONSTANT * len(group)}
    return sorted(out)


def extract(html: str | None, template: frozenset[int] = frozenset()) -> str:
    """The text that a page's own tags and constant nodes give."""
    p = read(html)
    return "\n".join(x.text for x in p.items if x.inside and (p.sure or not x.menu) and x.key not in template)


_BLOCKS = "array<struct<key long, node int, chars int, head boolean, inside boolean, menu boolean, text string>>"


def parsed(pages: DataFrame) -> DataFrame:
    """Every row read: its frames and its blocks."""
    kinds = [("key", pa.int64()), ("node", pa.int32()), ("chars", pa.int32()), ("head", pa.bool_()), ("inside", pa.bool_()), ("menu", pa.bool_()), ("text", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 256):
                b = whole.slice(s, 256)
                got = [read(html) for html in b.column(3).to_pylist()]
                inner = pa.StructArray.from_arrays([pa.array([getattr(x, k) for p in got for x in p.items], t) for k, t in kinds], names=[k for k, _ in kinds])
                ends = pa.array(np.cumsum([0, *(len(p.items) for p in got)]), pa.int32())
                new = {
                    "frame": pa.array([_key(0, p.shape) for p in got], pa.int64()),
                    "shape": pa.array([p.shape for p in got], pa.string()),
                    "full": pa.array([_key(0, p.form) for p in got], pa.int64()),
                    "form": pa.array([p.form for p in got], pa.string()),
                    "sure": pa.array([p.sure for p in got], pa.bool_()),
                    "copy": pa.array([p.copy for p in got], pa.int64()),
                    "blocks": pa.ListArray.from_arrays(ends, inner),
                }
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *new.values()], names=["page_id", "url", "host", *new])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.expr("try_parse_url(cast(url AS string), 'HOST')").alias("host"), F.col("html").cast("string").alias("html"))
    return arrow_map(rows, run, f"page_id long, url string, host string, frame long, shape string, full long, form string, sure boolean, copy long, blocks {_BLOCKS}")


def _constant(counts: DataFrame, sizes: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, name): the items that stand in CONSTANT of a group's pages, of groups of LEAST pages or more."""
    fit = counts.join(sizes.where(F.col("n") >= LEAST), keys).where(F.col("c") >= CONSTANT * F.col("n"))
    return fit.groupBy(*keys).agg(F.sort_array(F.collect_list("item")).alias(name))


def wrappers(rows: DataFrame) -> DataFrame:
    """(host, frame, full, items, within, semantic) from parsed rows: for pages of that host with these frames the constant
    nodes, for each element of the frame whether it lies in the content slot (null: the host's layout has none), and whether
    that slot is, or lies in, a main or article element."""
    spark = rows.sparkSession
    found = rows.where("host IS NOT NULL AND copy IS NOT NULL")

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in sorted_groups(batches, ["host"]):
            shape, ids = t.column("shape").to_pylist(), t.column("frame").to_numpy()
            same = [ids[s:e][layouts(shape[s:e])] for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([t.column("host").combine_chunks(), pa.array(ids), pa.array(np.concatenate(same))], names=["host", "frame", "layout"])

    narrow = F.transform("blocks", lambda b: F.struct(b["key"].alias("key"), b["node"].alias("node"), b["chars"].alias("chars"), b["head"].alias("head")))
    one = found.groupBy("host", "copy").agg(F.min(F.struct("frame", "full", narrow.alias("blocks"))).alias("p")).select("host", "p.*")
    one = stored(one, "distinct")
    shapes = found.groupBy("host", "frame").agg(F.min("shape").alias("shape"))
    shapes = one.groupBy("host", "frame").agg(F.count(F.lit(1)).alias("n")).join(shapes, ["host", "frame"], "right")
    # The most frequent frames of a host lead.
    shapes = shapes.select("host", "frame", "shape", (-F.coalesce("n", F.lit(0))).alias("few")).repartition(partitions(spark), "host").sortWithinPartitions("host", "few", "frame")
    layout = stored(arrow_map(shapes.select("host", "frame", "shape"), group, "host string, frame long, layout long"), "layouts")
    placed = one.join(layout, ["host", "frame"])
    items = F.explode(F.array_distinct(F.transform("blocks", lambda b: b["key"])))
    counts = stored(placed.select("host", "layout", items.alias("item")).groupBy("host", "layout", "item").agg(F.count(F.lit(1)).alias("c")), "counts")
    sizes = stored(placed.groupBy("host", "layout").agg(F.count(F.lit(1)).alias("n")), "sizes")
    own = _constant(counts, sizes, ["host", "layout"], "own")
    every = _constant(counts.groupBy("host", "item").agg(F.sum("c").alias("c")), sizes.groupBy("host").agg(F.sum("n").alias("n")), ["host"], "every")
    none = F.expr("cast(array() AS array<long>)")
    known = sizes.join(own, ["host", "layout"], "left").join(every, "host", "left")
    known = stored(known.select("host", "layout", F.array_union(F.coalesce("own", none), F.coalesce("every", none)).alias("items")), "constant")

    # The most frequent ordered frame stands for a layout; the others are aligned with it.
    forms = found.groupBy("host", "frame", "full").agg(F.min("form").alias("form")).join(layout, ["host", "frame"])
    often = placed.groupBy("host", "layout", "full").agg(F.count(F.lit(1)).alias("n")).groupBy("host", "layout").agg(F.max_by("full", F.struct("n", "full")).alias("lead"))
    lead = forms.groupBy("host", "layout", "full").agg(F.min("form").alias("stands")).join(often, ["host", "layout"]).where("full = lead").select("host", "layout", "stands")
    forms = forms.join(lead, ["host", "layout"]).select("host", "layout", "frame", "full", "form", "stands")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [places(*x) for x in zip(b.column(5).to_pylist(), b.column(4).to_pylist(), strict=True)]
            lists = [pa.array([g[k] for g in got], pa.list_(t)) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), *lists], names=["host", "layout", "frame", "full", "place", "up", "tag"])

    aligned = stored(arrow_map(forms, match, "host string, layout long, frame long, full long, place array<long>, up array<long>, tag array<string>"), "places")

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 256):
                out = []
                for r in whole.slice(s, 256).to_pylist():
                    fixed = set(r["items"])
                    sums = {p: [u, t, 0, 0, 0] for p, u, t in zip(r["place"], r["up"], r["tag"], strict=True)}
                    for x in r["blocks"]:
                        if x["key"] not in fixed:
                            at = sums[r["place"][x["node"]]]
                            at[2] += x["chars"]
                            at[3] |= x["chars"] > 0
                            at[4] |= x["head"]
                    out += [(r["host"], r["layout"], p, *v) for p, v in sums.items()]
                if out:
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["host", "layout", "place", "up", "tag", "chars", "text", "heads"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in sorted_groups(batches, ["host", "layout"]):
            out = []
            rows = t.to_pylist()
            for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                got = content_slot([Slot(*(r[k] for k in ("place", "up", "tag", "chars", "text", "heads"))) for r in rows[s:e]], rows[s]["n"])
                if got:
                    out.append((rows[s]["host"], rows[s]["layout"], *got))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["host", "layout", "slot", "semantic"])

    wide = placed.join(known, ["host", "layout"]).join(aligned, ["host", "layout", "frame", "full"]).select("host", "layout", "items", "blocks", "place", "up", "tag")
    sums = arrow_map(wide, slots, "host string, layout long, place long, up long, tag string, chars long, text long, heads long")
    sums = sums.groupBy("host", "layout", "place").agg(F.min("up").alias("up"), F.min("tag").alias("tag"), *[F.sum(c).alias(c) for c in ("chars", "text", "heads")])
    sums = gathered(sums.join(sizes.where(F.col("n") >= LEAST), ["host", "layout"]), partitions(spark), "host", "layout").sortWithinPartitions("host", "layout", "place")
    slot = stored(arrow_map(sums.select("host", "layout", "place", "up", "tag", "chars", "text", "heads", "n"), choose, "host string, layout long, slot long, semantic boolean"), "slots")

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for place, up, tag, at in zip(*(b.column(k).to_pylist() for k in (5, 6, 7, 8)), strict=True):
                if at is None:
                    out.append(None)
                    continue
                # Further articles beside the content slot's article belong to it.
                beside = {u for p, u, t in zip(place, up, tag, strict=True) if p == at and t == "article"}
                got: set[int] = set()
                for p, u, t in zip(place, up, tag, strict=True):
                    if p == at or u in got or (t == "article" and u in beside):
                        got.add(p)
                out.append([p in got for p in place] if got else None)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in (0, 1, 2, 3, 4)), pa.array(out, pa.list_(pa.bool_()))], names=["host", "frame", "full", "items", "semantic", "within"])

    out = aligned.join(known, ["host", "layout"]).join(slot, ["host", "layout"], "left").select("host", "frame", "full", "items", "semantic", "place", "up", "tag", "slot")
    return stored(arrow_map(out, inside, "host string, frame long, full long, items array<long>, semantic boolean, within array<boolean>").where("size(items) > 0 OR within IS NOT NULL"), "wrappers")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row, and wrapped: whether the wrapper chose its content."""
    rows = stored(parsed(pages), "pages")
    known = wrappers(rows).select(*[F.col(c).alias(f"_{c}") for c in ("host", "frame", "full", "items", "semantic", "within")])
    same = (F.col("host") == F.col("_host")) & (F.col("frame") == F.col("_frame")) & (F.col("full") == F.col("_full"))
    joined = rows.select("page_id", "url", "host", "frame", "full", "sure", "blocks").join(known, same, "left")
    joined = joined.withColumn("_items", F.coalesce("_items", F.expr("cast(array() AS array<long>)")))
    joined = joined.withColumn("wrapped", F.expr("_within IS NOT NULL AND (_semantic OR NOT sure)"))
    keep = "NOT array_contains(_items, b.key) AND IF(wrapped, _within[b.node], b.inside AND (sure OR NOT b.menu))"
    text = F.expr(f"array_join(transform(filter(blocks, b -> {keep}), b -> b.text), '\n')")
    return joined.select("page_id", "url", text.alias("text"), "wrapped").withColumn("n_chars", F.length("text").cast("long")).select("page_id", "url", "text", "n_chars", "wrapped")
