"""Main text of web pages by composite text density.

A page is parsed to a tree of elements (end tags that HTML implies are filled in). Elements that are
never text of an article (menus, footers, asides, forms, scripts, styles, headers outside of one, and
what is hidden or has the role of one of these) are left out. Every other node has its characters,
tags, link characters and link tags; its composite density is the characters a tag, raised or lowered
by how much of its text is links. Names only adjust densities: below a class or id that speaks of
boilerplate or comments they are a fiftieth, below an article or main element twice as much. A node's
sum is that of its children's densities, and the node with the largest sum is the core, or what
holds it if that is a paragraph or inline. The lowest density on the path from the core to the body
is the threshold. Inside the core all stays but parts below the threshold that are mostly links or
have such a name; from the core up to the body, the parts beside it that reach the threshold belong
to it, and so do loose text, headings before such parts, and what lies between two of them and is
not mostly links.

Blocks are the runs of text between the boundaries of block elements and line breaks.

Defined results: null or empty html, and pages without text, give an empty text; a tag that does
not end before the page does is dropped; repeated rows give the same result; null ids and urls stay
null; a page of any length is parsed whole; of equal sums the node that comes first is the core; an
empty table gives no rows; other columns are kept, whatever they are called, but text and n_chars.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from stackwise.session import ship

# HTML element names and words of class and id names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("head title script style noscript template iframe object embed applet svg canvas math nav footer aside form button select option textarea input label fieldset dialog menu audio video map".split())
BLOCK = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre search section summary table caption tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"br", "body", "html", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
WORDS = frozenset("nav navbar navigation menu menus breadcrumb breadcrumbs masthead footer sidebar aside ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription social share sharing related recommended recommendations comment comments commentlist disqus respond widget pagination pager toolbar login signup search skip copyright alert alerts cookiebar cookiebanner disclaimer paywall topbar sharebar adbox adslot adunit adbanner".split())
ARTICLES = frozenset("article main".split())
HOLDERS = frozenset("article main body section div td th li dd blockquote center figure".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
COMMENTS = frozenset("comment comments commentlist disqus respond".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th", "thead", "tbody"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "thead", "tbody"}}
WALLS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
P_WALLS = frozenset("html body table td th caption button object template".split())

#: What densities are multiplied by below a name of boilerplate, and below an article or main element.
LOW, HIGH = 0.02, 2.0

TAG = re.compile(r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)(?:>|\Z)|/?[a-zA-Z][^>]*(?:>|\Z)|/[^>]*(?:>|\Z))""", re.S)
ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
SPLIT = re.compile(r"[^a-z0-9]+")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "parts", "attrs", "chars", "tags", "link_chars", "link_tags", "density", "total", "holds", "named", "comments", "low", "inside")

    def __init__(self, tag: str, parent: "Node | None", attrs: str = ""):
        self.tag, self.parent, self.attrs = tag, parent, attrs
        self.parts: list = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.holds = self.named = self.comments = self.low = self.inside = False


def parse(html: str) -> Node:
    """The tree; its parts are nodes and strings (character references still in them)."""
    root = Node("html", None)
    at, node, pos, size = root, root, 0, len(html)
    search, lower = TAG.search, html.lower
    low = ""
    while pos < size:
        m = search(html, pos)
        if m is None:
            at.parts.append(html[pos:])
            break
        if m.start() > pos:
            at.parts.append(html[pos : m.start()])
        pos = m.end()
        name = m[2]
        if name is None:
            if html.startswith("<![CDATA[", m.start()):
                at.parts.append(entities_safe(html[m.start() + 9 : pos - 3]))
            continue
        name = name.lower()
        if m[1]:
            if name in VOID:
                if name == "br":
                    at.parts.append(Node("br", at))
                continue
            node = at
            block = name in BLOCK
            while node is not None and node.tag != name:
                if not block and node.tag in BLOCK and node.tag != "p":
                    node = None
                    break
                node = node.parent
            if node is not None and node.parent is not None and name not in ("body", "html"):
                at = node.parent
            continue
        if name in ("html", "body"):
            if name == "body" and not any(isinstance(x, Node) and x.tag == "body" for x in root.parts):
                at = Node("body", root, m[3])
                root.parts.append(at)
            continue
        if name in CLOSES_P:
            node = at
            while node is not None and node.tag != "p" and node.tag not in P_WALLS:
                node = node.parent
            if node is not None and node.tag == "p":
                at = node.parent
        if name in SAME:
            node, last = at, None
            walls = WALLS[name]
            while node is not None and node.tag not in walls and node.tag not in ("body", "html"):
                if node.tag in SAME[name]:
                    last = node
                node = node.parent
            if last is not None:
                at = last.parent
        new = Node(name, at, m[3])
        at.parts.append(new)
        if name in VOID or m[3].endswith("/") and name in ("svg", "path", "br"):
            continue
        if name in RAW:
            low = low or lower()
            end = low.find("</" + name, pos)
            stop = size if end < 0 else end
            if name in ("textarea", "title"):
                new.parts.append(html[pos:stop])
            close = html.find(">", stop)
            pos = size if end < 0 or close < 0 else close + 1
            continue
        at = new
    return root


def entities_safe(text: str) -> str:
    return text.replace("&", "&amp;")


def names_of(node: Node) -> tuple[set[str], bool]:
    """The words of a node's class and id, and whether it is hidden or has the role of an element that is left out."""
    names: set[str] = set()
    out = False
    seen = node.attrs.lower()
    if "class" in seen or "id" in seen or "role" in seen or "hidden" in seen:
        for k, a, b, c in ATTR.findall(node.attrs):
            k = k.lower()
            if k in ("class", "id"):
                names.update(SPLIT.split((a or b or c).lower()))
            elif k == "role" and (a or b or c).lower() in ROLES or k == "hidden":
                out = True
    return names, out


def measured(root: Node) -> list[Node]:
    """Leaves out the elements that are never text, and measures the others; the nodes that stay, parents first."""
    kept, stack = [], [(root, False)]
    while stack:
        node, inside = stack.pop()
        kept.append(node)
        inside = inside or node.tag in ARTICLES
        parts = []
        for x in node.parts:
            if isinstance(x, Node):
                if x.tag in DROPPED or x.tag == "header" and not inside:
                    continue
                if x.attrs and x.tag not in ("html", "body"):
                    names, out = names_of(x)
                    if out:
                        continue
                    x.comments = bool(names & COMMENTS)
                    x.named = bool(names & WORDS) or "header" in names and not inside
            parts.append(x)
        node.parts = parts
        stack.extend((x, inside) for x in reversed(parts) if isinstance(x, Node))
    for node in reversed(kept):
        node.holds = node.holds or node.tag in ARTICLES
        if node.holds and node.parent is not None:
            node.parent.holds = True
        for x in node.parts:
            if isinstance(x, Node):
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.link_chars
                node.link_tags += x.link_tags + (x.tag == "a")
            else:
                node.chars += len(x.strip())
        if node.tag == "a":
            node.link_chars = node.chars
    return kept


def densities(kept: list[Node], body: Node) -> None:
    """Composite densities, adjusted by names, and their sums."""
    ratio = body.link_chars / max(body.chars, 1)
    for node in kept:
        above = node.parent
        # what holds an article, or blocks with most of a page, is a frame and not what its name says
        frame = node.holds or 2 * node.chars > body.chars and any(isinstance(x, Node) and x.tag in BLOCK for x in node.parts)
        node.low = above is not None and above.low or node.comments or node.named and not frame
        node.inside = node.tag in ARTICLES or above is not None and above.inside
        if not node.chars:
            continue
        c, t, lc, lt = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
        # the logarithm's base grows with the share of links, the argument shrinks with it
        base = math.log(c / max(c - node.link_chars, 1) * node.link_chars + ratio * c + math.e)
        node.density = c / t * math.log(max(c / lc * t / lt, 1.0)) / math.log(max(base, 1.01))
        node.density *= (LOW if node.low else 1) * (HIGH if node.inside else 1)
    for node in kept:
        if node.parent is not None:
            node.parent.total += node.density


def core(root: Node) -> Node:
    """The node that holds the text; parts that do not belong to it are taken out of it."""
    kept = measured(root)
    body = next((x for x in kept if x.tag == "body"), root)
    densities(kept, body)
    best = body
    for node in kept:
        if node.total > best.total and node is not root:
            best = node
    while best is not body and best.parent is not None and best.tag not in HOLDERS:
        best = best.parent
    threshold, node = body.density, best
    while node is not None and node is not body:
        threshold = min(threshold, node.density)
        node = node.parent
    stack = [best]
    while stack:
        node = stack.pop()
        node.parts = [x for x in node.parts if isinstance(x, str) or not boilerplate(x, threshold)]
        stack.extend(x for x in node.parts if isinstance(x, Node) and x.tag in BLOCK)
    while best is not body and best.parent is not None:
        best.parent.parts = grown(best, threshold)
        best = best.parent
    return best


def boilerplate(node: Node, threshold: float) -> bool:
    """Whether a part inside the core is left out: below the threshold, and named so or a block mostly of links."""
    if not node.chars or node.density >= threshold:
        return False
    return node.low or node.tag in BLOCK and node.tag not in HEADINGS and node.tag != "p" and node.link_tags > 1 and 2 * node.link_chars > node.chars


def grown(best: Node, threshold: float) -> list:
    """The parts of the parent of ``best`` that belong to the text with it."""
    runs: list[list] = []  # a block, or text and inline elements side by side
    for x in best.parent.parts:
        inline = isinstance(x, str) or x.tag not in BLOCK
        if not (inline and runs and runs[-1][0]):
            runs.append([inline])
        runs[-1].append(x)
    dense = [any(isinstance(x, Node) and (x is best or x.chars and x.density >= threshold) for x in r[1:]) for r in runs]
    first, last = dense.index(True), len(dense) - 1 - dense[::-1].index(True)
    kept: list = []
    after = False  # whether the block after it stays
    for i in range(len(runs) - 1, -1, -1):
        inline, *parts = runs[i]
        nodes = [x for x in parts if isinstance(x, Node)]
        loose = any(isinstance(x, str) and x.strip() for x in parts)
        chars, link_chars = sum(x.chars for x in nodes), sum(x.link_chars for x in nodes)
        if not loose and not chars:
            continue
        heading = not inline and nodes[0].tag in HEADINGS
        stays = dense[i] or loose or (heading and after) or (first < i < last and 2 * link_chars <= chars)
        if stays:
            kept[:0] = parts
        after = stays
    return kept


def blocks(top: Node) -> list[str]:
    out: list[str] = []
    run: list[str] = []

    def cut() -> None:
        if run:
            text = SPACE.sub(" ", entities.unescape("".join(run))).strip()
            if text:
                out.append(text)
            run.clear()

    stack: list = [top]
    while stack:
        x = stack.pop()
        if x is None:
            cut()
        elif isinstance(x, str):
            run.append(x)
        elif x.tag in BLOCK:
            cut()
            stack.append(None)
            stack.extend(reversed(x.parts))
        else:
            stack.extend(reversed(x.parts))
    cut()
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    return "\n".join(blocks(core(parse(html))))


def extract(df: DataFrame, html_col: str = "html") -> DataFrame:
    """The columns of ``df`` other than ``html_col``, with text and n_chars; columns of these names are replaced."""
    ship(df.sparkSession)
    keep = [c for c in df.columns if c not in (html_col, "text", "n_chars")]

    def run(batches):
        for b in batches:
            texts = [main_text(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["row", "text", "n_chars"])

    rows = df.select(F.struct(*keep).alias("row"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, T.StructType([rows.schema["row"]]).add("text", "string").add("n_chars", "long")).select("row.*", "text", "n_chars")
