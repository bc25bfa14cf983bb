"""Main text of web pages by wrapper induction.

Pages of a host come from a few templates. Pages with the same frame (labels of the upper elements) are one layout.
Over all pages of a layout, and over all of the host, the stories (a story is known by its longest blocks, so near
copies count once) that each block of text stands beside are counted by partial aggregates: what stands at the same
path of most stories is template. Up to eight exemplars a layout, each of another story, are parsed, and the first
one's tree is aligned with each of the others by simple tree matching: the greatest set of node pairs that keeps
labels, ancestors and sibling order. What is constant is template. The deepest node that holds most varying text
outside links is the wrapper's slot; an ``article`` or ``main`` element that holds a quarter of it is preferred.
On every page the template text of its layout and host goes, and the article is what stands at the wrapper's slot. A
slot that is no ``article`` or ``main`` may leave parts of the story out, so every other varying block with text of its
own beside links stays too. Only pages without a wrapper, or without its slot, fall back on their own ``article`` or
``main`` element, else their body. Menus, headers, footers, sidebars, notices, adverts, forms, reader comments and the
like that vary from page to page are also known by element, role, class and id.

Character references are decoded, white space inside a block becomes one space, blocks are joined by line feeds.

Cases: null, empty or text-less html gives the empty string; broken or unclosed markup is parsed leniently and never
fails; layouts and hosts with few stories (or no host) have no template and keep the rest of the rules; repeated rows
are extracted each; an empty table gives no rows. Exemplars are a documented bounded sample, for slots only.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quarry.llm.common import group_arrow, input_bytes, map_arrow, ship, written

EXEMPLARS = 8
#: Text is template if it stands beside this share of the other stories, and no fewer than LEAST.
SHARE, LEAST = 0.75, 3
#: Template text inside an article is dropped up to this length: a whole shared paragraph stays.
SHORT = 80
#: So many of a page's longest blocks tell its story; elements of so many upper levels are its frame.
LONGEST, FRAME = 3, 4
#: Wrappers are broadcast if their table has at most so many bytes.
BROADCAST = 8 << 20
#: Nodes deeper than this hang on the last level; what is dropped still holds its own, up to so many levels more.
DEEPEST, MORE = 120, 40

# Fixed lists of element names and of words in class and id.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Parts of a story: a slot is never one of them, but what holds them.
PARTS = INLINE | set("p li h1 h2 h3 h4 h5 h6 blockquote pre figure ul ol dl dt dd".split())
STORIES = ("article", "main")
HOLDS = set("ul ol menu dl table tbody thead tfoot select div article section".split())
DROPPED = set("nav footer aside form script style noscript template head title iframe button select textarea svg object canvas dialog menu audio video".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
HINTS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent notice notices gdpr popup "
    "alert modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist respond responses replies discussion disqus search searchbox widget "
    "toolbar pagination pager skip hidden".split()
)

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?/](?![a-zA-Z])[^>]*(?:>|\Z)|<![^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
NAME = re.compile(r"[^a-z]+")
NUMBER = re.compile(r"\d+")
WORDY = re.compile(r"[^\W_]")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    """An element (children: nodes and text) of a parsed page."""

    __slots__ = ("attrs", "children", "label", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs = tag, attrs
        self.label = f"{tag}.{attrs['class']}" if "class" in attrs else tag
        self.children: list[Node | str] = []


def parse(html: str) -> Node:
    """The tree of a page; never fails."""
    root = Node("#root", {})
    stack = [root]
    beyond: dict[int, dict[str, int]] = {}  # open elements that are not on the stack, by its height then
    at = 0
    for m in iter(lambda: TOKEN.search(html, at), None):
        if m.start() > at:
            _text(stack[-1], unescape(html[at : m.start()]))
        at = max(m.end(), m.start() + 1)
        name = m[2] or m[5]
        if not name:
            if m[0].startswith("<![CDATA["):
                _text(stack[-1], m[0][9:].removesuffix("]]>"))
            continue
        tag = name.lower()
        if beyond:
            beyond = {k: v for k, v in beyond.items() if k <= len(stack)}
        if m[1] or m[4]:
            for i in range(len(stack) - 1, 0, -1):
                if beyond and beyond.get(i + 1, {}).get(tag):
                    beyond[i + 1][tag] -= 1
                    del stack[i + 1 :]
                    if tag not in INLINE:
                        stack[i].children.append(Node(tag, {}))  # ends the block
                    break
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag in INLINE and stack[i].tag in HOLDS:
                    break
            continue
        raw = m[3] or m[6] or ""
        attrs = {a.lower(): unescape(x or y or z) for a, x, y, z in ATTRIBUTE.findall(raw)} if "=" in raw or "hidden" in raw else {}
        inside = beyond.get(len(stack), {})
        held = any(inside.get(h) for h in HOLDS) if inside else False
        if tag in CLOSES_P and not held:
            _close(stack, {"p"}, HOLDS)
        if tag in CLOSED_BY and not held:
            _close(stack, CLOSED_BY[tag], HOLDS)
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])|\Z", re.I).search(html, at)
            at = end.start()
            stack.append(node)
        elif tag not in VOID and not raw.endswith("/"):
            if len(stack) < DEEPEST or len(stack) < DEEPEST + MORE and dropped(node, True):
                stack.append(node)
            else:
                open_ = beyond.setdefault(len(stack), {})
                open_[tag] = open_.get(tag, 0) + 1
    if at < len(html):
        _text(stack[-1], unescape(html[at:]))
    return root


def _text(node: Node, text: str) -> None:
    if node.children and isinstance(node.children[-1], str):
        node.children[-1] += text
    else:
        node.children.append(text)


def _close(stack: list[Node], tags: set[str], until: set[str]) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            del stack[i:]
            return
        if stack[i].tag in until:
            return


def dropped(node: Node, inside: bool) -> bool:
    """Whether an element is never part of an article."""
    if node.tag in DROPPED or node.tag == "header" and not (inside and _has_heading(node)):
        return True
    a = node.attrs
    if not a or node.tag in ("html", "body", "#root"):
        return False
    if a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true":
        return True
    if "display:none" in a.get("style", "").replace(" ", "").lower():
        return True
    named = CAMEL.sub(" ", f"{a.get('class', '')} {a.get('id', '')}").lower()
    words = set(NAME.split(named))
    if node.tag in ("article", "main"):
        return "comment" in named
    return bool(HINTS & words) or "header" in words and not _has_heading(node)


def _has_heading(node: Node) -> bool:
    return any(isinstance(c, Node) and (re.fullmatch("h[1-6]", c.tag) or _has_heading(c)) for c in node.children)


# ---------------------------------------------------------------- wrappers


def skeleton(node: Node) -> list:
    """[label, text or "", children, times] without what is dropped anyway; like siblings in a row become one."""
    children: list[list] = []
    for c in node.children:
        if isinstance(c, str):
            text = " ".join(c.split())
            if text:
                children.append(["#", text, [], 1])
        elif not dropped(c, True) and c.tag not in VOID:
            children.append(skeleton(c))
    return [node.label, "", children, 1]


class _Shapes:
    """Labels of subtrees as numbers: equal subtrees share one, so each pair of shapes is matched once.

    The matching ignores text. A table of siblings is filled row by row and only every k-th row is kept, so its memory
    grows with the longer list and not with the product of both; the way back fills the rows between again.
    """

    def __init__(self) -> None:
        self.known: dict[tuple, int] = {}
        self.labels: list[str] = []
        self.children: list[np.ndarray] = []
        self.nodes: list[int] = []  # how many a subtree has
        self.of: dict[int, int] = {}  # shapes of trees by their identity
        self.sizes: dict[tuple[int, int], int] = {}

    def add(self, tree: list) -> int:
        below = [self.add(k) for k in tree[2]]
        number = self.known.setdefault((tree[0], *below), len(self.known))
        if number == len(self.labels):
            self.labels.append(tree[0])
            self.children.append(np.array(below, np.int64))
            self.nodes.append(1 + sum(self.nodes[k] for k in below))
        self.of[id(tree)] = number
        return number

    def size(self, p: int, q: int) -> int:
        """Size of the greatest matching of two shapes."""
        if self.labels[p] != self.labels[q]:
            return 0
        if p == q:
            return self.nodes[p]
        if not len(self.children[p]) or not len(self.children[q]):
            return 1
        if (p, q) not in self.sizes:
            last = None
            for last in self.rows(p, q):
                pass
            self.sizes[p, q] = 1 + int(last[0])
        return self.sizes[p, q]

    def gains(self, p: int, q: int):
        """How much each child of ``q`` gains with one of ``p``, by its shape."""
        kinds, place = np.unique(self.children[q], return_inverse=True)
        kinds, found = kinds.tolist(), {}

        def of(shape: int) -> np.ndarray:
            if shape not in found:
                found[shape] = np.array([self.size(shape, k) for k in kinds], np.int64)
            return found[shape][place]

        return of

    def rows(self, p: int, q: int, first: int = 0, end: int | None = None, below: np.ndarray | None = None, gains=None) -> Iterator[np.ndarray]:
        """Rows of the table of two shapes' children, from the one before ``end`` up to ``first``."""
        x, m = self.children[p], len(self.children[q])
        gains = gains or self.gains(p, q)
        below = np.zeros(m + 1, np.int64) if below is None else below
        for shape in x[first:end][::-1].tolist():
            here = np.zeros(m + 1, np.int64)
            here[:m] = np.maximum.accumulate(np.maximum(below[:-1], below[1:] + gains(shape))[::-1])[::-1]
            yield here
            below = here

    def pairs(self, p: int, q: int) -> Iterator[tuple[int, int]]:
        """Which children pair."""
        x, n, m = self.children[p], len(self.children[p]), len(self.children[q])
        if p == q:
            yield from ((i, i) for i in range(n))
            return
        gains = self.gains(p, q)
        step = math.isqrt(n) + 1
        kept = {n: np.zeros(m + 1, np.int64)}
        kept |= {i: row for i, row in zip(range(n - 1, -1, -1), self.rows(p, q, gains=gains)) if not i % step}
        j = 0
        for first in range(0, n, step):
            end = min(first + step, n)
            table = [kept[end], *self.rows(p, q, first, end, kept[end], gains)][::-1]
            i = first
            while i < end and j < m:
                here, below, gain = table[i - first], table[i - first + 1], gains(int(x[i]))
                while j < m:
                    if gain[j] and here[j] == below[j + 1] + gain[j]:
                        yield i, j
                        i, j = i + 1, j + 1
                        break
                    if here[j] == below[j]:
                        i += 1
                        break
                    j += 1


def matching(a: list, b: list, found: list[tuple[list, list]]) -> int:
    """Size of the greatest simple tree matching of two skeletons; ``found`` gets its pairs of text nodes."""
    shapes = _Shapes()
    size = shapes.size(shapes.add(a), shapes.add(b))

    def gather(a: list, b: list) -> None:
        if not a[2] or not b[2]:
            if a[0] == "#":
                found.append((a, b))
            return
        for i, j in shapes.pairs(shapes.of[id(a)], shapes.of[id(b)]):
            gather(a[2][i], b[2][j])

    if size:
        gather(a, b)
    return size


def part_key(path: str, text: str) -> int:
    """64 bits for a text at a path of labels."""
    return int.from_bytes(hashlib.blake2b(f"{path}\0{text}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _own(tree: list) -> list[tuple[tuple[str, ...], list[tuple[tuple[str, ...], list, bool]]]]:
    """Each block of a skeleton that has text of its own: path, and (path, text node, in a link) of its parts."""
    out: list[tuple[tuple[str, ...], list[tuple[tuple[str, ...], list, bool]]]] = []

    def block(t: list, path: tuple[str, ...], linked: bool) -> None:
        own: list[tuple[tuple[str, ...], list, bool]] = []

        def gather(t: list, at: tuple[str, ...], in_link: bool) -> None:
            for k in t[2]:
                tag = k[0].split(".")[0]
                if k[0] == "#":
                    own.append((at, k, in_link))
                elif tag in INLINE:
                    gather(k, (*at, k[0]), in_link or tag == "a")
                else:
                    block(k, (*at, k[0]), in_link)

        gather(t, path, linked)
        if own:
            out.append((path, own))

    block(tree, (), False)
    return out


def layout(tree: list) -> int:
    """64 bits for a skeleton's frame: label paths of its upper elements, numbers in labels aside."""
    frame: set[str] = set()

    def walk(t: list, path: str, level: int) -> None:
        for k in t[2]:
            if k[0] != "#" and k[0].split(".")[0] not in PARTS:
                here = f"{path}/{NUMBER.sub('0', k[0])}"
                frame.add(here)
                if level < FRAME:
                    walk(k, here, level + 1)

    walk(tree, "", 1)
    return part_key("frame", "\n".join(sorted(frame))) or 1


def told(tree: list) -> tuple[int, list[tuple[int, int]]]:
    """A skeleton's story (64 bits of its longest blocks outside links) and the (block, part) keys of its text.

    A block's own text is template only as a whole: a constant word beside varying ones is content.
    """
    longest: list[tuple[int, str]] = []
    keys: set[tuple[int, int]] = set()
    for path, own in _own(tree):
        words = " ".join(k[1] for _, k, in_link in own if not in_link)
        longest.append((-len(words), words))
        parts = [part_key("/".join(at), k[1]) for at, k, _ in own]
        whole = parts[0] if len(parts) == 1 else part_key("/".join(path), ",".join(map(str, parts)))
        keys |= {(whole, p) for p in parts}
    return part_key("story", "\n".join(w for _, w in sorted(longest)[:LONGEST])), sorted(keys)


def induced(pages: list[str], known: set[int] | None = None) -> dict | None:
    """The wrapper of some pages of one layout: its template and the path to the slot; None for too few stories.

    ``known`` are the keys of template text; without it they are counted over these pages alone.
    """
    trees = [skeleton(parse(p)) for p in pages]
    if known is None:
        beside: dict[tuple[int, int], set[int]] = {}
        stories = set()
        for tree in trees:
            story, keys = told(tree)
            stories.add(story)
            for k in keys:
                beside.setdefault(k, set()).add(story)
        if len(stories) <= LEAST:
            return None
        need = max(LEAST, SHARE * (len(stories) - 1))
        known = {part for (_, part), s in beside.items() if len(s) - 1 >= need}
    first, others = trees[0], trees[1:]
    same: dict[int, int] = {}
    for other in others:
        found: list[tuple[list, list]] = []
        matching(first, other, found)
        for a, b in found:
            same[id(a)] = same.get(id(a), 0) + (a[1] == b[1])
    need = max(LEAST, SHARE * len(others))
    template: dict[str, list[str]] = {}
    mass: dict[tuple[str, ...], int] = {}
    for tree in trees:
        for _, own in _own(tree):
            for at, k, _ in own:
                texts = template.setdefault("/".join(at), [])
                if part_key("/".join(at), k[1]) in known and k[1] not in texts:
                    texts.append(k[1])
    for _, own in _own(first):
        constant = all(same.get(id(k), 0) >= need or k[1] in template["/".join(at)] for at, k, _ in own)
        for at, k, in_link in own:
            if not constant and not in_link:
                for d in range(1, len(at) + 1):
                    mass[at[:d]] = mass.get(at[:d], 0) + len(k[1])
    return {"template": {p: texts for p, texts in template.items() if texts}, "slot": list(_slot(mass))}


def _slot(mass: dict[tuple[str, ...], int]) -> tuple[str, ...]:
    """The path of the story by how much varying text stands below each path."""
    whole = max(mass.values(), default=0)
    stories = {p: v for p, v in mass.items() if p[-1].split(".")[0] in STORIES and 4 * v >= whole}
    if stories:
        most = max(stories.values())
        return max((p for p, v in stories.items() if v >= 0.8 * most), key=len)
    slot = max((p for p, v in mass.items() if v >= 0.8 * whole), key=len, default=())
    while slot and slot[-1].split(".")[0] in PARTS:
        slot = slot[:-1]
    return slot


# ---------------------------------------------------------------- extraction


def _articles(node: Node, tags: tuple[str, ...], out: list[Node]) -> None:
    for c in node.children:
        if isinstance(c, Node) and not dropped(c, False):
            if c.tag in tags or "main" in tags and c.attrs.get("role") == "main":
                out.append(c)
            else:
                _articles(c, tags, out)


def _size(node: Node) -> int:
    return sum(len(c) if isinstance(c, str) else _size(c) for c in node.children)


def _at(node: Node, path: list[str]) -> list[Node]:
    """All nodes at a path of labels: siblings may share a label."""
    nodes = [node]
    for label in path:
        nodes = [c for n in nodes for c in n.children if isinstance(c, Node) and c.label == label and not dropped(c, False)]
    return nodes


def _blocks(node: Node, known: set[int], path: str, short: int | None, out: list[str], line: list[tuple[str, bool]], slots: set[int] | None = None, linked: bool = False) -> None:
    """Adds a node's blocks to ``out``; ``line`` holds the open block's parts and whether each is reason to keep it.

    Outside ``slots`` (ids of nodes; None: all is inside) a block stays if it has words that are not in a link.
    """
    for c in node.children:
        if isinstance(c, str):
            if known:
                text = " ".join(c.split())
                if text and (short is None or len(text) <= short) and part_key(path, text) in known:
                    continue
            line.append((c, slots is None or not linked and bool(WORDY.search(c))))
        elif c.tag in VOID:
            line.append((" ", False))
            if c.tag == "hr":
                _flush(out, line)
        elif not dropped(c, True):
            below = f"{path}/{c.label}" if path else c.label
            inner = None if slots is None or id(c) in slots else slots
            if c.tag in INLINE:
                _blocks(c, known, below, short, out, line, inner, linked or c.tag == "a")
            else:
                _flush(out, line)
                _blocks(c, known, below, short, out, line, inner, linked)
                _flush(out, line)


def _flush(out: list[str], line: list[tuple[str, bool]]) -> None:
    if line:
        text = " ".join("".join(part for part, _ in line).split())
        if text and any(keep for _, keep in line):
            out.append(text)
        line.clear()


def _path_to(node: Node, goal: Node, path: tuple[str, ...] = ()) -> tuple[str, ...] | None:
    for c in node.children:
        if isinstance(c, Node):
            here = (*path, c.label)
            if c is goal:
                return here
            found = _path_to(c, goal, here)
            if found is not None:
                return found
    return None


def keys_of(wrapper: dict) -> set[int]:
    """Keys of a wrapper's template text."""
    if "known" not in wrapper:
        wrapper["known"] = {part_key(path, text) for path, texts in wrapper["template"].items() for text in texts}
    return wrapper["known"]


def _region(root: Node, wrapper: dict | None) -> tuple[Node, int | None, set[int] | None, bool]:
    """(node, longest template text that goes, slots in it, whether the wrapper decided) of one page's article."""
    found = _at(root, wrapper["slot"]) if wrapper and wrapper["slot"] else []
    decided = bool(found)
    if decided and found[0].tag not in STORIES:
        return root, None, {id(n) for n in found}, True
    for tag in STORIES:
        if not found:
            _articles(root, (tag,), found)
    if found:
        return max(found, key=_size) if len(found) > 1 else found[0], SHORT, None, decided
    return root, None, None, False


def main_text(html: str | None, wrapper: dict | None = None) -> str:
    """The article of one page."""
    if not html:
        return ""
    root = parse(html)
    known = keys_of(wrapper) if wrapper else set()
    node, short, slots, _ = _region(root, wrapper)
    path = "/".join(_path_to(root, node) or ()) if known and node is not root else ""
    out: list[str] = []
    line: list[tuple[str, bool]] = []
    _blocks(node, known, path, short, out, line, slots)
    _flush(out, line)
    return "\n".join(out)


def decided(html: str | None, wrapper: dict | None) -> bool:
    """Whether a page's article is found by its wrapper, not by the page's own elements."""
    return bool(html) and _region(parse(html), wrapper)[3]


def _frames(pages: DataFrame) -> DataFrame:
    """(host, html, ...) with each page's ``layout``; null without html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frames = [layout(skeleton(parse(x))) if x is not None else None for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(frames, pa.int64())], [*batch.schema.names, "layout"])

    return map_arrow(pages, run, StructType([*pages.schema.fields, StructField("layout", LongType())]))


def wrappers(pages: DataFrame) -> DataFrame:
    """``host``, ``layout`` (0: the whole host) and ``wrapper`` (JSON) of the layouts of (host, html) with enough stories."""
    ship(pages.sparkSession)
    keyed = pages.where("host <> '' and html is not null").select("host", F.xxhash64("html").alias("h"), "html")

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for host, h, html in zip(*(c.to_pylist() for c in batch.columns)):
                tree = skeleton(parse(html))
                frame = layout(tree)
                story, keys = told(tree)
                rows += [(host, frame, h, story, block, part) for block, part in keys]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, [pa.string(), *[pa.int64()] * 5])], ["host", "layout", "h", "story", "block", "part"])

    told_ = written(map_arrow(keyed, tell, "host string, layout long, h long, story long, block long, part long"), "blocks")
    both = told_.withColumn("layout", F.explode(F.array(F.lit(0).cast("long"), "layout")))
    many = both.select("host", "layout", "story").distinct().groupBy("host", "layout").agg(F.count(F.lit(1)).alias("stories")).where(F.col("stories") > LEAST)
    beside = both.select("host", "layout", "block", "part", "story").distinct().groupBy("host", "layout", "block", "part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LEAST)
    common = beside.join(many, ["host", "layout"]).where(F.col("n") - 1 >= SHARE * (F.col("stories") - 1))
    known = many.select("host", "layout").join(common.groupBy("host", "layout").agg(F.collect_set("part").alias("known")), ["host", "layout"], "left")
    chosen = both.groupBy("host", "layout", F.pmod("story", F.lit(EXEMPLARS)).alias("class")).agg(F.min(F.struct("story", "h")).alias("least"))
    chosen = chosen.join(known, ["host", "layout"]).select("host", "layout", "known", F.col("least.h").alias("h"))
    few = keyed.join(written(chosen, "exemplars"), ["host", "h"]).dropDuplicates(["host", "layout", "h"])

    def induce(t: pa.Table) -> pa.Table:
        rows = sorted(zip(t.column("h").to_pylist(), t.column("html").to_pylist()))
        keys = t.column("known")[0].as_py() or []
        wrapper = {"known": sorted(keys), "slot": induced([html for _, html in rows], set(keys))["slot"]}
        return pa.table({"host": t.column("host").slice(0, 1).combine_chunks().cast(pa.string()), "layout": t.column("layout").slice(0, 1).combine_chunks(), "wrapper": pa.array([json.dumps(wrapper)], pa.string())})

    return group_arrow(few.groupBy("host", "layout"), induce, "host string, layout long, wrapper string")


def _merged(own: str | None, hosts: str | None) -> dict | None:
    """The wrapper of a page by those of its layout and its host."""
    found = [json.loads(w) for w in (own, hosts) if w is not None]
    return {"known": {k for w in found for k in w["known"]}, "slot": found[0]["slot"]} if found else None


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every row of (page_id, url, html)."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    hosted = pages.select("page_id", "url", "html", host.alias("host"))
    learned = written(wrappers(hosted), "wrappers")
    of_host = learned.where("layout = 0").select("host", F.col("wrapper").alias("of_host"))
    if input_bytes(learned) <= BROADCAST:  # beyond it a sort-merge join, whose left side Spark splits for a hot host
        learned, of_host = F.broadcast(learned), F.broadcast(of_host)
    joined = _frames(hosted).join(learned, ["host", "layout"], "left").join(of_host, "host", "left").select("page_id", "url", "html", "wrapper", "of_host")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, dict | None] = {}
        for batch in batches:
            texts = []
            for html, *both in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                key = tuple(both)
                if key not in found:
                    if len(found) > 1000:
                        found.clear()
                    found[key] = _merged(*key)
                texts.append(main_text(html, found[key]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    types = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return map_arrow(joined, run, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")
