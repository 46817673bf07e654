"""Operator 6: main text of pages by wrapper induction over the pages of a host."""

from __future__ import annotations

import html
import json
import re
import sys
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Elements by their part in a page, as HTML defines them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math select object canvas audio video xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var ruby rt rp wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
#: Opening one of these ends an open one of the group, up to the element that holds the group.
PEERS = {
    **{x: ({"li"}, {"ul", "ol", "menu"}) for x in ("li",)},
    **{x: ({"dt", "dd"}, {"dl"}) for x in ("dt", "dd")},
    **{x: ({"tr", "td", "th"}, {"table"}) for x in ("tr",)},
    **{x: ({"td", "th"}, {"table", "tr"}) for x in ("td", "th")},
    **{x: ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}) for x in ("thead", "tbody", "tfoot")},
    "option": ({"option"}, {"select"}),
}
#: Elements, roles and words of class or id that mark what is around an article.
AROUND = frozenset("nav header footer aside form button head menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead footer sidebar aside widget cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login "
    "comment comments disqus reply replies respond discussion share sharing social related recommended toolbar pagination pager skip form search copyright".split()
)
#: Of these, words of what readers wrote: more of it than of the article is no sign of a layout.
READERS = frozenset("comment comments disqus reply replies respond discussion".split())
MAIN = ("article", "main")

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPLIT = re.compile(r"[^a-z0-9]+")
BREAK = None

#: A text of a template stands on this share of a host's aligned pages, and on so many at least.
CONSTANT = 0.6
LEAST_PAGES = 5
FLUSH = 200_000
#: Nesting up to which shapes are compared; text is taken from any depth.
DEPTH = 40


class Node:
    """An element: its tag, whether it stands around an article (by its part in HTML, or ``marked`` by words
    of class or id), and its children (nodes, texts, breaks)."""

    __slots__ = ("tag", "around", "marked", "role", "children", "shape", "raw")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.children = tag, []
        self.around, self.marked, self.role = tag in AROUND, frozenset(), ""
        self.shape = self.raw = None
        if "=" in attributes or "hidden" in attributes:
            for m in _ATTRIBUTE.finditer(attributes):
                name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
                if name == "role":
                    self.role = value
                    self.around |= value in ROLES
                elif name in ("class", "id") and tag not in ("body", "html", "article", "main"):
                    self.marked |= MARKS.intersection(_SPLIT.split(value))
                elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                    self.around = True


def parse(page: str) -> Node:
    """The page's tree, leniently: unclosed elements end where their parents or peers begin anew."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000 + page.count("<")))
    root = Node("")
    stack, at, raw = [root], 0, None
    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        if raw:
            if not (m[1] and m[2].lower() == raw):
                continue
            raw = None
            at = m.end()
            continue
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        tag = m[2] and m[2].lower()
        if not tag:
            continue
        if m[1]:
            if tag == "p" and all(x.tag != "p" for x in stack):
                stack[-1].children.append(BREAK)
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag in INLINE and stack[i].tag not in INLINE:
                    break
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag not in INLINE:
                    break
        elif tag in PEERS:
            group, holders = PEERS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in group:
                    del stack[i:]
                elif stack[i].tag in holders:
                    break
        if tag in VOID:
            stack[-1].children.append(BREAK if tag in ("br", "hr") else "")
        elif tag in RAW:
            raw = tag if not m[3].rstrip().endswith("/") else None
        else:
            node = Node(tag, m[3])
            stack[-1].children.append(node)
            stack.append(node)
    if not raw and at < len(page):
        stack[-1].children.append(page[at:])
    return root


def blocks(node: Node, skip) -> list[str]:
    """Texts of the blocks below ``node`` in page order, without subtrees for which ``skip`` holds."""
    out, line = [], []

    def end() -> None:
        text = " ".join(html.unescape("".join(line)).split())
        line.clear()
        if text:
            out.append(text)

    def walk(x: Node) -> None:
        for child in x.children:
            if child is BREAK:
                end()
            elif isinstance(child, str):
                line.append(child)
            elif not skip(child):
                block = child.tag not in INLINE
                if block:
                    end()
                walk(child)
                if block:
                    end()

    walk(node)
    end()
    return out


def skeleton(node: Node, depth: int = DEPTH) -> tuple[str, tuple]:
    """(tag, children) where elements alike in a row are one: the shape that pages of a host share.
    What lies deeper than ``depth`` is not part of the shape."""
    return _shape(node, depth)[1]


def _shape(node: Node, depth: int) -> tuple[int, tuple[str, tuple]]:
    """(height, skeleton); kept at the node, as it does not depend on a depth above its height."""
    if node.shape and node.shape[0] <= depth:
        return node.shape
    kinds: list[tuple[str, tuple]] = []
    height = 0
    for child in node.children:
        if isinstance(child, Node) and child.tag not in INLINE:
            if not depth:
                return DEPTH + 1, (node.tag, ())
            below, shape = _shape(child, depth - 1)
            height = max(height, below + 1)
            if not kinds or kinds[-1] != shape:
                kinds.append(shape)
    found = (height, (node.tag, tuple(kinds)))
    if height <= depth:
        node.shape = found
    return found


def shape_of(data: list) -> tuple[str, tuple]:
    """A skeleton read from JSON."""
    return data[0], tuple(map(shape_of, data[1]))


def runs(node: Node) -> list[tuple[tuple[str, tuple], list[Node]]]:
    """The element children by runs of the same shape."""
    out: list[tuple[tuple[str, tuple], list[Node]]] = []
    for child in node.children:
        if isinstance(child, Node) and child.tag not in INLINE:
            shape = skeleton(child)
            if out and out[-1][0] == shape:
                out[-1][1].append(child)
            else:
                out.append((shape, [child]))
    return out


def _nodes(shape: tuple[str, tuple]) -> int:
    return 1 + sum(map(_nodes, shape[1]))


def matching(a, b) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two forests of (tag, children): size, and the pairs of roots.

    Trees match only if their roots have the same tag; then the matching is one more than the
    best order-preserving matching of their children, found by dynamic programming.
    """
    if a == b:
        # only equal places match all
        return sum(map(_nodes, a)), [(i, i) for i in range(len(a))]
    size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    weight = [[1 + matching(x[1], y[1])[0] if x[0] == y[0] else 0 for y in b] for x in a]
    for i in range(len(a)):
        for j in range(len(b)):
            size[i + 1][j + 1] = max(size[i][j + 1], size[i + 1][j], size[i][j] + weight[i][j])
    pairs, i, j = [], len(a), len(b)
    while i and j:
        if weight[i - 1][j - 1] and size[i][j] == size[i - 1][j - 1] + weight[i - 1][j - 1]:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif size[i][j] == size[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return size[-1][-1], pairs[::-1]


def aligned(node: Node, wrapper: tuple, place: str = ""):
    """(slot, nodes): the runs of ``node``'s tree matched to the wrapper's nodes, named by their path there."""
    if not wrapper[1]:
        return
    own = runs(node)
    for i, j in matching(tuple(shape for shape, _ in own), wrapper[1])[1]:
        slot = f"{place}/{j}"
        yield slot, own[i][1]
        if len(own[i][1]) == 1:
            yield from aligned(own[i][1][0], wrapper[1][j], slot)


def raw_text(node: Node) -> str:
    """All text below ``node`` but a head's, blocks apart."""
    if node.raw is None:
        parts = []
        for child in node.children:
            if child is BREAK:
                parts.append("\n")
            elif isinstance(child, str):
                parts.append(child)
            elif child.tag in INLINE:
                parts.append(raw_text(child))
            elif child.tag != "head":
                parts += ("\n", raw_text(child), "\n")
        node.raw = "".join(parts)
    return node.raw


def item(node: Node) -> int:
    """Digest of what a node of a slot says."""
    text = raw_text(node)
    return digest(" ".join((html.unescape(text) if "&" in text else text).split()))


def holders(root: Node, tag: str, skip) -> list[Node]:
    """Outermost ``tag`` elements outside subtrees for which ``skip`` holds."""
    out: list[Node] = []

    def find(x: Node) -> None:
        for child in x.children:
            if isinstance(child, Node) and not skip(child):
                if child.tag == tag or tag == "main" and child.role == "main":
                    out.append(child)
                else:
                    find(child)

    find(root)
    return out


def wide(root: Node, template: set[int]) -> dict[int, bool]:
    """Marked elements that hold most of the page's varying text, by id; true for those of readers' words."""
    length: dict[int, int] = {}
    marked: list[Node] = []

    def measure(x: Node) -> int:
        n = 0
        for child in x.children:
            if isinstance(child, str):
                n += len(child.strip())
            elif child is not BREAK and not child.around and id(child) not in template:
                n += measure(child)
        if x.marked:
            length[id(x)] = n
            marked.append(x)
        return n

    half = measure(root) / 2
    return {id(x): not READERS.isdisjoint(x.marked) for x in marked if length[id(x)] > half}


def content(root: Node, template: set[int]) -> list[str]:
    """Blocks of the page's article: what is not in ``template``, then by the parts of elements in HTML.

    An article or main element that has such text is the whole content; else all of the page is. Words of
    class or id cut an element out only if it does not hold most of the varying text, or the only article
    or main element. Comments longer than an article stay out, unless nothing else is left.
    """
    kept = wide(root, template)
    roles = lambda x: x.around or id(x) in template
    marks = lambda x: roles(x) or bool(x.marked) and kept.get(id(x), True)
    for skip in (marks, roles):
        for tag in MAIN:
            found = [x for holder in holders(root, tag, skip) for x in blocks(holder, marks)]
            if found:
                return found
    return blocks(root, marks) or blocks(root, lambda x: roles(x) or bool(x.marked) and id(x) not in kept)


def main_text(page: str, wrapper: tuple | None, constant: frozenset) -> str:
    """The article of a page: its varying slots, without what HTML's parts put around an article.

    Nodes that say what the template says in their slot are left out, inside article and main
    elements too.
    """
    root = parse(page)
    template: set[int] = set()
    if wrapper and constant:
        slots = {slot for slot, _ in constant}
        for slot, nodes in aligned(root, wrapper):
            if slot in slots:
                template.update(id(node) for node in nodes if (slot, item(node)) in constant)
    return " ".join(content(root, template))


def digest(text: str) -> int:
    data = text.encode("utf-8", "surrogatepass")
    return zlib.crc32(data) << 31 ^ zlib.adler32(data)


EMPTY = digest("")


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, constant) per host of ``pages`` (page_id, host, html), as JSON.

    The wrapper is the shape of one page per host, the one whose id has the smallest hash. All
    pages are aligned to it. What a node says in its slot is the template's if it does so on
    ``CONSTANT`` of the pages aligned there; pages with the same content (as far as one page
    shows it) count once, so that copies of a page do not make its text a template.
    """

    def shape(batches):
        for batch in batches:
            found = [json.dumps(skeleton(parse(x or ""))) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["host", "wrapper"])

    def items(batches):
        seen: set = set()

        def out():
            columns = zip(*seen)
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()))]
            return pa.RecordBatch.from_arrays(arrays, ["host", "slot", "text", "page"])

        load = {}
        for batch in batches:
            for host, page, wrapper in zip(*(c.to_pylist() for c in batch.columns)):
                if wrapper not in load:
                    load.clear()
                    load[wrapper] = shape_of(json.loads(wrapper))
                root = parse(page or "")
                name = digest("\n".join(content(root, set())))
                seen.update((host, slot, item(node), name) for slot, nodes in aligned(root, load[wrapper]) for node in nodes)
                if len(seen) > FLUSH:
                    yield out()
                    seen = set()
        if seen:
            yield out()

    first = pages.groupBy("host").agg(F.min(F.struct(F.xxhash64("page_id").alias("k"), "page_id"))["page_id"].alias("page_id"))
    chosen = pages.join(first, ["host", "page_id"]).dropDuplicates(["host"])
    shapes = materialize(chosen.select("host", "html").mapInArrow(shape, "host string, wrapper string"))
    found = pages.join(shapes, "host").select("host", "html", "wrapper")
    found = materialize(found.mapInArrow(items, "host string, slot string, text long, page long").distinct())
    sizes = found.select("host", "slot", "page").distinct().groupBy("host", "slot").agg(F.count("*").alias("all"))
    texts = found.where(F.col("text") != EMPTY).groupBy("host", "slot", "text").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_PAGES)
    fixed = texts.join(sizes, ["host", "slot"]).where(F.col("n") >= CONSTANT * F.col("all"))
    fixed = fixed.groupBy("host").agg(F.to_json(F.collect_list(F.struct("slot", "text"))).alias("constant"))
    return materialize(shapes.join(fixed, "host", "left"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages`` (page_id, url, html).

    Wrappers are induced per host from all its pages; texts then come from a second alignment.
    Null html counts as empty and gives an empty text; null urls form a host; null ids, repeated
    rows and very long pages are handled like others (a page is one row of one task); an empty
    table gives no row.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1)), F.lit(""))
    pages = pages.select(F.col("page_id").cast("bigint"), "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    known = wrappers(pages.select(F.coalesce("page_id", F.lit(-1)).alias("page_id"), "host", "html"))

    def run(batches):
        load = {}
        for batch in batches:
            page_id, url, page, wrapper, constant = (c.to_pylist() for c in batch.columns)
            found = []
            for x, w, c in zip(page, wrapper, constant):
                if (w, c) not in load:
                    load.clear()
                    fixed = frozenset((y["slot"], y["text"]) for y in json.loads(c)) if c else frozenset()
                    load[w, c] = (shape_of(json.loads(w)) if w else None, fixed)
                found.append(main_text(x, *load[w, c]))
            n = pa.array([len(x) for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), n], ["page_id", "url", "text", "n_chars"])

    rows = pages.join(known, "host", "left").select("page_id", "url", "html", "wrapper", "constant")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
