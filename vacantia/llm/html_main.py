"""Main text of web pages by tree scoring.

The page is read into a tree of block elements. A paragraph passes points to its parent and, by half, to its grandparent: for
its length and its commas, discounted by the share of its characters that are links. The container with most points wins; its
siblings join if they score well themselves or are running text, and an ``article`` or ``main`` around it is taken whole. Menus,
headers (that of the article too), footers, sidebars, scripts and styles are left out by their element. The words of class, id or role
are evidence, which the points of the page are held against: a form or a part named like layout (sidebar, search, share) goes unless it
holds the ``main`` or ``article`` or four fifths of all points, one named like matter beside the article (adverts, comments) goes
unless nothing else on the page is running text. Inline elements named like adverts or comments go as well. Should nothing be
left, the names count for less, step by step. Everything else in the container is returned.

Markup may be broken: elements left open are closed where their parent ends, stray end tags are ignored, an unfinished tag or
comment at the end of the page ends it, the first tag or text that a head can't hold closes it, and contents of scripts, styles and
titles are never read as markup.

Defined results: null or empty html, or a page without text, gives an empty text. Pages are read whole. Repeated rows are
extracted alike. Empty tables give empty tables. Other columns are ignored."""
from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from vacantia.llm.common import append, pick, table

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)"
    r"|([^<]+|<)",
    re.S,
)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_RAW = frozenset("script style title textarea noscript xmp iframe noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var".split()
)
_SKIPPED = frozenset(
    "script style title textarea noscript xmp iframe noembed noframes head nav header footer aside button select option template svg math "
    "canvas object dialog menu".split()
)
#: Names of matter beside the article, and of layout, which often names what it surrounds as well.
_BESIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense promo promos promotion sponsor sponsored sponsors "
    "breadcrumb breadcrumbs pagination pager cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login "
    "comment comments commentlist disqus reply replies respond discussion related recommended recommendations trending".split()
)
_LAYOUT = frozenset(
    "banner banners nav navbar navigation menu menus sitemap header masthead footer sidebar sidebars rail aside complementary contentinfo "
    "notice notices alert share sharing social widget widgets toolbar search form".split()
)
#: Share of the page's points from which a part counts as what the page is about, whatever its name.
MOST = 0.8
_IN_HEAD = frozenset("head base link meta script style title noscript template".split())
_PARAGRAPH = frozenset("p pre td blockquote li dd section div article main h1 h2 h3 h4 h5 h6".split())
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main menu nav ol p pre section table ul".split()
)
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}


class Node:
    """A block element: its text runs and child blocks in page order."""

    __slots__ = ("tag", "parent", "items", "skip", "named", "score", "chars", "linked")

    def __init__(self, tag: str, parent: Node | None, skip: bool, named: int = 0):
        self.tag, self.parent, self.skip = tag, parent, skip
        self.named = named  # by its class, id or role: 0 for nothing, 1 like layout, 2 like matter beside the article
        self.items: list = []  # strings, (string,) for link text, Nodes
        self.score = 0.0
        self.chars = self.linked = 0


def _named(tag: str, attrs: str) -> int:
    """What class, id and role say: 0 nothing, 1 layout, 2 matter beside the article."""
    out = 0
    if tag in ("body", "html", "article", "main") or not attrs:
        return out
    for _, value in _ATTR.findall(attrs):
        for w in re.split(r"[\s_\-\"':.]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()):
            out = max(out, 2 if w in _BESIDE else 1 if w in _LAYOUT else 0)
    return out


def parse(page: str) -> Node:
    """The tree of blocks of a page."""
    root = Node("html", None, False)
    node, links, at = root, 0, 0
    mute: list[str] = []  # open inline elements from the one that is left out on
    while at < len(page):
        m = _TOKEN.match(page, at)
        if not m:  # an unfinished tag: the page ends here
            break
        at = m.end()
        closing, name, attrs, _, text = m.groups()
        if text is not None:
            if text == "<" and (page[at : at + 1].isalpha() or page[at : at + 1] == "/"):  # a tag with a quote left open
                end = page.find(">", at)
                at = len(page) if end < 0 else end + 1
                continue
            if node.tag == "head" and not text.isspace():
                node = node.parent
            if not node.skip and not mute:
                node.items.append((text,) if links else text)
            continue
        if name is None:
            continue
        tag = name.lower()
        if node.tag == "head" and tag not in _IN_HEAD:
            node = node.parent
        if tag in _INLINE or tag in _VOID:
            if tag in _INLINE and closing and tag in mute:
                while mute.pop() != tag:
                    pass
            elif tag in _INLINE and not closing and (mute or _named(tag, attrs) == 2):
                mute.append(tag)
            if tag == "a":
                links = 0 if closing else 1
            elif tag in ("br", "hr", "img") and not node.skip:
                node.items.append(" ")
            if tag != "hr":
                continue
        mute.clear()  # a block ends what is open inside the one around it
        if closing:
            open_ = node
            while open_ is not None and open_.tag != tag:
                open_ = open_.parent
            if open_ is not None and open_.parent is not None:
                node, links = open_.parent, 0
            continue
        if tag in _RAW and not attrs.rstrip().endswith("/"):
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in _CLOSES_P:
            above = node
            while above is not None and above.tag not in ("p", "td", "th", "table", "button", "body", "html"):
                above = above.parent if above.tag in ("p",) else None
            if above is not None and above.tag == "p":
                node = above.parent
        if tag in _SAME:
            above = node
            while above is not None and above.tag not in _SCOPE[tag] and above.tag not in _SAME[tag]:
                above = above.parent
            if above is not None and above.tag in _SAME[tag]:
                node = above.parent
        if tag in ("html", "body", "hr"):
            continue
        child = Node(tag, node, node.skip or tag in _SKIPPED, max(_named(tag, attrs), int(tag == "form")))
        node.items.append(child)
        node, links = child, 0
        if attrs.rstrip().endswith("/") and tag in ("svg", "path", "math"):
            node = child.parent
    return root


def _walk(root: Node) -> list[Node]:
    """Kept nodes in page order."""
    nodes, todo = [], [root]
    while todo:
        node = todo.pop()
        nodes.append(node)
        todo += [x for x in reversed(node.items) if isinstance(x, Node) and not x.skip]
    return nodes


def _own(node: Node) -> tuple[int, int, float]:
    """Characters, link characters and points of the text right inside a node."""
    own = " ".join("".join(x if isinstance(x, str) else x[0] for x in node.items if not isinstance(x, Node)).split())
    linked = sum(len(x[0]) for x in node.items if isinstance(x, tuple))
    points = min(len(own) / 100.0, 3.0) + own.count(",") + own.count("،") + own.count("、") + (1.0 if len(own) >= 25 else 0.1)
    return len(own), linked, points * (1.0 - min(1.0, linked / len(own))) if own and node.tag in _PARAGRAPH else 0.0


def _judge_names(root: Node, strict: int) -> None:
    """Leave out the named parts that the points of the page don't speak for. ``strict``: 2 heeds all names, 1 only those of matter
    beside the article, 0 none."""
    nodes = _walk(root)
    held = {id(n): _own(n)[2] for n in nodes}  # points in the whole subtree
    marks = {id(n): int(n.tag == "main") * 2 + int(n.tag in ("article", "main")) for n in nodes}
    for n in reversed(nodes):
        if n.parent is not None:
            # what lies in a part named like matter beside the article is no evidence for the parts around it
            if n.named < 2:
                held[id(n.parent)] += held[id(n)]
            marks[id(n.parent)] |= marks[id(n)] if n.named < 2 else 0
    total = held[id(root)]
    for n in nodes:
        if n.parent is not None and n.parent.skip:
            n.skip = True
        elif n.named == 1 and strict > 1:
            n.skip = not marks[id(n)] and held[id(n)] < MOST * total
        elif n.named == 2 and strict > 0:
            n.skip = not (marks[id(n)] & 2) and (total >= 1.0 or bool(total and marks[id(root)]))


def _measure(root: Node) -> list[Node]:
    """Kept nodes in page order, with characters, link characters and points."""
    nodes = _walk(root)
    for node in nodes:
        node.score = 0.0
    for node in nodes:
        node.chars, node.linked, points = _own(node)
        if points and node.parent is not None:
            node.parent.score += points
            if node.parent.parent is not None:
                node.parent.parent.score += points / 2.0
            if node.tag in ("div", "section", "article", "main", "td", "blockquote"):
                node.score += points
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
    return nodes


def _density(node: Node) -> float:
    return min(1.0, node.linked / node.chars) if node.chars else 0.0


def main_nodes(root: Node) -> list[Node]:
    """The best container and the siblings that belong to it, in page order."""
    nodes = [n for n in _measure(root) if n.chars]
    if not nodes:
        return []
    value = {id(n): n.score * (1.0 - _density(n)) * (1.5 if n.tag in ("article", "main") else 1.0) for n in nodes}
    best = max(nodes, key=lambda n: value[id(n)])  # of equals the outermost, which comes first
    around = best
    while around is not None and around.tag not in ("article", "main"):
        around = around.parent
    best = around or best
    if best.parent is None:
        return [best]
    floor = max(3.0, 0.2 * value[id(best)])
    out = []
    for n in best.parent.items:
        if n is best:
            out.append(n)
        elif isinstance(n, Node) and not n.skip and n.chars:
            running = n.tag == "p" and n.chars > 80 and _density(n) < 0.25
            if value.get(id(n), 0.0) >= floor or running:
                out.append(n)
    return out


def _blocks(nodes: list[Node]) -> list[str]:
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(run)).split())
        if text:
            out.append(text)
        run.clear()

    todo: list = list(reversed(nodes))
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, Node):
            if not x.skip:
                flush()
                todo.append(None)
                todo += reversed(x.items)
        else:
            run.append(x if isinstance(x, str) else x[0])
    flush()
    return out


def _unskip(node: Node) -> None:
    """Forget what names have decided."""
    todo = [node]
    while todo:
        n = todo.pop()
        n.skip = n.tag in _SKIPPED or (n.parent is not None and n.parent.skip)
        todo += [x for x in n.items if isinstance(x, Node)]


def main_text(page: str | None) -> str:
    """Blocks of the main content, joined by one space."""
    if not page:
        return ""
    root, text = parse(page), ""
    for strict in (2, 1, 0):
        _judge_names(root, strict)
        text = " ".join(_blocks(main_nodes(root)))
        if text:
            break
        _unskip(root)
    return text


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``."""

    def run(batch: pa.RecordBatch) -> list:
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        return [texts, [len(t) for t in texts]]

    return append(pick(pages, page_id=page_id, url=url, html=html), "text string, n_chars long", run, ("html",))


def query(spark: SparkSession, sf: str) -> DataFrame:
    return extract(table(spark, sf, "pages"))


QUERIES = {"op5_html_main": (query, None)}
