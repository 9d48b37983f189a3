"""Main text of web pages by composite text density.

Every DOM node gets its link-adjusted characters per tag, and every node sums the densities of its children; the node with
the largest sum is the core of the page. Tags, roles and whole words of class and id that speak for boilerplate
weigh densities down, for a node and all below it; article and main weigh them up. A class word doesn't count against a node that holds
an article or most of the page's text outside links. The threshold is the least density on the path
from the core to the body: ancestors are taken in while other children reach it, up to an article or main. Of the chosen subtree
the boilerplate below the core is left out.
"""

from __future__ import annotations

import html as htmllib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boostlake.llm.blocks import blocks, bounded

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
ENDS_P = BLOCK - frozenset("body html td th tr tbody thead tfoot caption legend".split())
# Elements, roles and class words that hold no main text.
DROPPED = frozenset("nav header footer aside form script style noscript template iframe textarea title head button select option svg canvas object embed audio video dialog menu input label fieldset datalist map math".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
CLASS_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation menu menubar header masthead topbar footer sidebar aside widget comment comments commentlist disqus respond reply replies discussion breadcrumb breadcrumbs pagination pager share sharing social cookie cookies consent gdpr notice notices banner popup modal overlay newsletter subscribe signup login related recommended recommendations toolbar skip search form legal copyright disclaimer alert".split()
)
# Last parts of names that say nothing else ("sidebar-box"), and first parts that tell of another element ("has-sidebar").
GENERIC = frozenset("box bar block area container wrapper wrap inner outer section panel list item items link links text content holder region zone group title label icon button buttons slot unit row col left right top bottom message messages count meta info thread tools form post posts stories".split())
NEGATING = frozenset("has with no without not hide hidden is js".split())
KEPT = frozenset("article main body html".split())
#: Weights of densities: of boilerplate by tag or role, of boilerplate by class or id, and of article and main.
BY_TAG, BY_WORD, BY_ARTICLE = 0.01, 0.1, 4.0

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>\0]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?(?=[\s/>]|\Z)", re.I)
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class Node:
    """An element: tag, parent, items (nodes and text), what speaks against it, and its measures."""

    __slots__ = ("tag", "parent", "items", "dropped", "named", "chars", "tags", "link_chars", "link_tags", "free", "holds", "weight", "density", "total")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False, named: bool = False):
        self.tag, self.parent, self.dropped, self.named, self.items = tag, parent, dropped, named, []
        self.chars = self.tags = self.link_chars = self.link_tags = self.free = 0
        self.holds = False
        self.weight, self.density, self.total = 1.0, 0.0, 0.0


def _attributes(attrs: str) -> list[tuple[str, str]]:
    return [(name.lower(), value.strip("\"'").lower()) for name, value in _ATTR.findall(attrs)]


def _boilerplate(tag: str, attrs: str) -> bool:
    if tag in DROPPED:
        return True
    if not attrs or tag in KEPT:
        return False
    for name, value in _attributes(attrs):
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in ROLES):
            return True
    return False


def _named(tag: str, attrs: str) -> bool:
    """Whether a word of class or id tells boilerplate: one that is whole, or the last part of a name that starts with one."""
    if not attrs or tag in KEPT:
        return False
    tokens = [t for name, value in _attributes(attrs) if name in ("class", "id") for t in value.split()]
    parts = [_WORDS.findall(t) for t in tokens]
    return any(p and p[0] in CLASS_WORDS and (len(p) == 1 or p[-1] in CLASS_WORDS or p[-1] in GENERIC) or len(p) > 1 and p[-1] in CLASS_WORDS and p[0] not in NEGATING for p in parts)


def parse(page: str) -> Node:
    """A forgiving parse: unclosed elements end with their parents, stray end tags are ignored."""
    root = Node("html", None)
    node, at, n = root, 0, len(page)
    while at < n:
        if page[at] != "<":
            to = page.find("<", at)
            to = n if to < 0 else to
            node.items.append(page[at:to])
            at = to
            continue
        m = _TOKEN.match(page, at)
        if not m:
            node.items.append("<")
            at += 1
            continue
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            x = node
            while x is not root and x.tag != tag:
                if x.tag in ("td", "th", "table", "article", "main") and tag not in BLOCK:
                    x = root
                    break
                x = x.parent
            if x is not root:
                node = x.parent
            continue
        if tag in ("html", "body"):
            continue
        if tag in ENDS_P or tag == "li":
            x = node
            while x is not root and x.tag not in BLOCK:
                x = x.parent
            if x.tag == "p" and tag in ENDS_P:
                node = x.parent
        if tag in ("li", "dt", "dd", "option", "tr", "td", "th"):
            same = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}[tag]
            stop = ("ul", "ol", "menu", "dl", "select", "table", "tbody", "thead", "tfoot") + (("tr",) if tag in ("td", "th") else ())
            x = node
            while x is not root and x.tag not in stop:
                if x.tag in same:
                    node = x.parent
                    if tag != "tr":
                        break
                x = x.parent
        child = Node(tag, node, dropped := _boilerplate(tag, m[3]), not dropped and _named(tag, m[3]))
        node.items.append(child)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            if tag in ("textarea", "title"):
                child.items.append(page[at : end.start() if end else n])
            at = n if not end else (page.find(">", end.end() - 1) + 1 or n)
            continue
        if m[3].rstrip().endswith("/") and tag in ("svg", "path", "use"):
            continue
        node = child
    return root


def _nodes(root: Node) -> list[Node]:
    """All nodes, parents before their children."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack += [c for c in x.items if isinstance(c, Node)]
    return order


def link_adjusted(chars: int, tags: int, link_chars: int, link_tags: int, page_chars: int, page_link_chars: int) -> float:
    """Composite text density of a node: characters per tag, less the more of them stand in links."""
    if not chars:
        return 0.0
    free = max(chars - link_chars, 1)
    base = math.log(chars / free * link_chars + page_link_chars / max(page_chars, 1) * chars + math.e)
    adjust = math.log(max(chars / max(link_chars, 1) * max(tags, 1) / max(link_tags, 1), 1) + 1, max(base, 1.0001) + 1)
    return chars / max(tags, 1) * adjust * (1 - link_chars / chars)


def measure(root: Node) -> list[Node]:
    """Counts, weights, densities and density sums of every node, parents first. Raw elements hold no text."""
    order = _nodes(root)
    for x in reversed(order):
        for c in x.items:
            if isinstance(c, str):
                own = 0 if c.isspace() or x.tag in RAW else len(c) - c.count(" ")
                x.chars += own
                x.free += own
            else:
                x.chars += c.chars
                x.tags += c.tags + 1
                x.link_chars += c.chars if c.tag == "a" else c.link_chars
                x.link_tags += c.link_tags + (c.tag == "a")
                x.free += c.free
                x.holds = x.holds or c.holds
        if x.dropped or x.tag == "a":
            x.free = 0
        x.holds = x.holds or (x.tag in ("article", "main") and x.chars > 0)
    _acquit(root)
    for x in order:
        x.density = link_adjusted(x.chars, x.tags, x.link_chars, x.link_tags, root.chars, root.link_chars)
        if x.parent is not None:
            x.weight = x.parent.weight
        x.weight *= BY_TAG if x.dropped else BY_WORD if x.named else BY_ARTICLE if x.tag in ("article", "main") else 1.0
    for x in order:
        x.total = sum(c.density * c.weight for c in x.items if isinstance(c, Node))
    return order


def _acquit(root: Node) -> None:
    """Words don't speak against a node that holds an article or most of the page's text outside links, from the top
    down, until an article or main is free of them."""
    open_, shown = [root], []
    while open_:
        stack, open_ = open_, []
        while stack:
            x = stack.pop()
            if x.tag in ("article", "main") and x.chars:
                return
            for c in x.items:
                if isinstance(c, Node) and not c.dropped:
                    (shown if c.named else stack).append(c)
        open_ = [x for x in shown if x.holds or 2 * x.free > root.free]
        shown = [x for x in shown if not (x.holds or 2 * x.free > root.free)]
        for x in open_:
            x.named = False


def choose(root: Node) -> tuple[Node, Node]:
    """The core, whose children have the largest sum of densities, and the subtree chosen by the threshold of its path."""
    order = measure(root)
    core = max(order, key=lambda x: x.total)
    if not core.total:  # no element below the body holds text
        return root, root
    path = [core]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(x.density for x in path)
    chosen, on_path = core, {id(x) for x in path}
    for x in path[1:]:
        if chosen.tag in ("article", "main"):
            break
        beside = [c for c in x.items if isinstance(c, Node) and id(c) not in on_path and not (c.dropped or c.named)]
        text = any(isinstance(c, str) and not c.isspace() for c in x.items)
        if text or x.tag in ("article", "main") or any(c.density * min(c.weight, 1.0) >= threshold and c.chars for c in beside):
            chosen = x
    return core, chosen


def render(node: Node, core: Node | None = None) -> str:
    """Blocks of a subtree without its boilerplate, but with ``core`` whatever it lies in: white space is one space, blocks
    are joined by an empty line."""
    spared = set()
    while core is not None:
        spared.add(id(core))
        core = core.parent
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", htmllib.unescape("".join(run))).strip()
        run.clear()
        if text:
            out.append(text)

    stack: list[object] = [node]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif x.tag == "br":
            run.append(" ")
        elif not (x.dropped or x.named) or x is node or id(x) in spared:
            if x.tag in BLOCK:
                flush()
                stack.append(None)
            stack += reversed(x.items)
    flush()
    return "\n\n".join(out)


def main_text(page: str | None) -> str:
    """Main text of one page; empty for null, empty and textless pages, and for pages of boilerplate by tag alone."""
    if not page:
        return ""
    core, chosen = choose(parse(page))
    while core is not None and _below_dropped(core):
        core = core.parent
    return render(chosen, core)


def _below_dropped(x: Node | None) -> bool:
    while x is not None:
        if x.dropped:
            return True
        x = x.parent
    return False


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with text and n_chars (code points) in place of the html; columns of these names are replaced."""
    bounded(pages.sparkSession)
    carried = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in pages.select(*carried).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "__html"):
            texts = [main_text(x) for x in batch.column("__html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(carried))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*carried, "text", "n_chars"])

    return pages.select(*[F.col(f"`{c}`") for c in carried], F.col(html).alias("__html")).mapInArrow(run, f"{fields}text string, n_chars long")
