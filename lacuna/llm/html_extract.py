"""Main text of web pages by composite text density.

The page is read into a tree by one tokenising expression (void elements, implied ends of p, li, td and the like, raw text
elements, comments). For every node with C
characters, LC of them link-like, T tags, LT of them link-like, the composite text density is

    C / T * log_b((C / LC) * (T / LT)),  b = ln(C / (C - LC) * LC + LC_body / C_body * C + e)

with counts of zero taken as one (and b = e on a page without any such characters). The density sum of a node adds up its children's densities. The node of the largest sum
is the core; the smallest density on the path from the body to the core is the threshold, and blocks inside the core whose
density falls below it are dropped if they are mostly link-like.

What counts: elements that are no text (scripts, styles, forms, ...) or that the tag itself names as something else (nav,
footer, aside, a header outside the article) are left out. Text in links is link-like, and so is text in an element whose
role, class or id, as a whole or by one of its parts, names it as a menu, notice, advert, reader comment and the like: such
text lowers a density, and it is the density that decides, inside of an article too. An `article` or `main` is the place to look in unless the text outside of it is more
than three times its own; it is then taken as a whole, so that a title beside the densest part stays.

Text: character references decoded, white space inside a block one blank, trimmed, blocks joined in page order by one \\n.

Rows: a null or empty page, or one without text, gives an empty text; repeated rows and nulls in other columns are kept;
an unclosed tag or comment ends with the page; a page is parsed by itself, so memory follows the longest page.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_limits

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)|([^\s=/>\"']+)")
#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas select xmp".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
NEVER = frozenset("nav footer aside form header button dialog menu head script style noscript template textarea title svg math iframe object canvas select xmp audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
#: Whole classes and ids whose text is link-like.
BOILER = frozenset("ad ads adv advert advertisement advertising adsbygoogle banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar footer masthead topbar toolbar share sharing social related recommended recommendations comment comments disqus reply replies respond newsletter subscribe signup login cookie cookies consent gdpr notice popup modal overlay widget pagination pager tags metadata byline copyright disclaimer skip hidden ad-banner ad-slot cookie-banner cookie-notice comment-list related-posts share-buttons social-links site-header site-footer".split())
#: Parts of a class or id, between hyphens, underscores and inner capitals, that do so by themselves ...
BOILER_PARTS = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense breadcrumb breadcrumbs comment comments commenting consent cookie cookies disqus gdpr newsletter newsletters notice notices paywall popup promo promos promoted promotion reply replies signup sidebar sponsor sponsored sponsors subscribe subscription".split())
#: ... and parts that do so together: what is listed, and as what.
BOILER_KINDS = frozenset("related recommended recommendations popular trending latest more share sharing social follow read next".split())
BOILER_LISTS = frozenset("posts post articles stories links link buttons button bar icons items news reads media widget widgets box".split())
_PART = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])")
CLOSES = {
    "p": frozenset({"p"}), "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}),
    "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"}), "body": frozenset({"head"}),
}
_ENDS_P = BLOCK - frozenset("br body html td th tr tbody thead tfoot caption li dd dt option optgroup legend summary".split())
_P, _NONE = frozenset({"p"}), frozenset()
_RAW_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
_SCOPE = frozenset("ul ol dl table div article section main aside nav header footer form blockquote td th body html".split())
_WALL = frozenset("article main body table td".split())
_HOME = frozenset({"article", "main"})
#: The text outside an article that makes the whole page the place to look in, as a multiple of the article's.
OUTSIDE = 3


class Node:
    __slots__ = ("tag", "parts", "parent", "chars", "link_chars", "tags", "link_tags", "density", "total", "dropped", "linkish")

    def __init__(self, tag: str, dropped: bool = False, linkish: bool = False, parent: Node | None = None) -> None:
        self.tag, self.dropped, self.linkish, self.parent, self.parts = tag, dropped, linkish, parent, []
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density = self.total = 0.0

    def nodes(self) -> list[Node]:
        return [p for p in self.parts if isinstance(p, Node) and not p.dropped]


@lru_cache(100_000)
def _boiler(name: str) -> bool:
    """Whether parts of a class or id name what isn't the article."""
    parts = frozenset(part.lower() for part in _PART.findall(name))
    return not BOILER_PARTS.isdisjoint(parts) or not (BOILER_KINDS.isdisjoint(parts) or BOILER_LISTS.isdisjoint(parts))


def _named(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is hidden; whether its role, class or id makes its text link-like."""
    hidden = linkish = False
    for m in _ATTR.finditer(attributes):
        name = (m[1] or m[3]).lower()
        said = (m[2] or "").strip("\"'")
        value = said.lower()
        if name in ("class", "id") and tag not in ("article", "main", "body"):
            linkish |= not BOILER.isdisjoint(value.split()) or any(map(_boiler, said.split()))
        linkish |= name == "role" and value in ROLES
        hidden |= name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and bool(re.search(r"display\s*:\s*none", value))
    return hidden, linkish


def parse(page: str) -> Node:
    """The tree of a page; text stands in `parts` between the children. Open elements are found by tag, not by search."""
    root = Node("html")
    stack, at = [root], 0
    places: dict[str, list[int]] = {"html": [0]}
    walls, scopes = [0], [0]

    def close(depth: int) -> None:
        while len(stack) > depth:
            tag = stack.pop().tag
            places[tag].pop()
            for edge in (walls, scopes):
                if edge and edge[-1] == len(stack):
                    edge.pop()

    def innermost(tag: str) -> int:
        return places[tag][-1] if places.get(tag) else 0

    while m := _TOKEN.search(page, at):
        if m.start() > at:
            stack[-1].parts.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                stack[-1].parts.append(Node("br", parent=stack[-1]))
            depth = innermost(tag)
            if depth and (tag in BLOCK or not walls or walls[-1] <= depth):
                close(depth)
            continue
        if tag == "html":
            continue
        ends = CLOSES.get(tag, _P if tag in _ENDS_P else _NONE)
        if ends and (depth := max(innermost(t) for t in ends)) and depth >= (scopes[-1] if scopes else 0):
            close(depth)
        hidden, linkish = _named(tag, m[3]) if m[3] else (False, False)
        inside = any(places.get(t) for t in _HOME)
        node = Node(tag, hidden or tag in NEVER and not (tag == "header" and inside), linkish, stack[-1])
        stack[-1].parts.append(node)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            end = _RAW_ENDS[tag].search(page, at)
            at = end.end() if end else len(page)
            node.dropped = True
            continue
        places.setdefault(tag, []).append(len(stack))
        if tag in _WALL:
            walls.append(len(stack))
        if tag in _SCOPE:
            scopes.append(len(stack))
        stack.append(node)
    if at < len(page):
        stack[-1].parts.append(page[at:])
    return root


def _count(root: Node) -> list[Node]:
    """Characters, tags and densities of every subtree without what is dropped; the nodes, parents before children."""
    order, todo = [], [(root, False)]
    while todo:
        node, link = todo.pop()
        link = link or node.linkish or node.tag == "a"
        order.append((node, link))
        todo += [(part, link) for part in node.nodes()]
    for node, link in reversed(order):
        for part in node.parts:
            if isinstance(part, str):
                n = len("".join(part.split()))
                node.chars += n
                node.link_chars += n if link else 0
            elif not part.dropped:
                node.chars += part.chars
                node.link_chars += part.link_chars
                node.tags += part.tags + 1
                node.link_tags += part.tags + 1 if link else part.link_tags + (part.tag == "a" or part.linkish)
    ratio = root.link_chars / max(root.chars, 1)
    for node, _ in order:
        c, lc, t, lt = node.chars, max(node.link_chars, 1), max(node.tags, 1), max(node.link_tags, 1)
        if c:
            base = math.log(c / max(c - node.link_chars, 1) * node.link_chars + ratio * c + math.e) if ratio else math.e
            inner = (c / lc) * (t / lt)
            node.density = c / t * (math.log(inner) / math.log(base) if inner > 1 and base > 1 else 0.0)
    for node, _ in order:
        node.total = sum(part.density for part in node.nodes())
    return [node for node, _ in order]


def _core(root: Node) -> tuple[Node, float]:
    """The node of the largest density sum and the smallest density on its path; the article it lies in, if that is where to look."""
    nodes = _count(root)
    homes = [n for n in nodes if n.tag in _HOME and not _within(n.parent, _HOME)]
    home = max(homes, key=lambda n: n.chars - n.link_chars, default=None)
    own = home.chars - home.link_chars if home else 0
    if own and own * OUTSIDE >= root.chars - root.link_chars - own:
        nodes = _count_below(home)
    else:
        home = None
    best = max(nodes, key=lambda n: n.total)
    while best.parent and best.tag not in ("div", "section", "body", "html", "td", "article", "main"):
        best = best.parent
    threshold, node = best.density, best
    while node.parent:
        node = node.parent
        threshold = min(threshold, node.density)
    return home or best, threshold


def _within(node: Node | None, tags: frozenset[str]) -> bool:
    while node:
        if node.tag in tags:
            return True
        node = node.parent
    return False


def _count_below(top: Node) -> list[Node]:
    out = [top]
    for node in out:
        out += node.nodes()
    return out


def _linky(node: Node, threshold: float) -> bool:
    return node.density < threshold and node.chars > 0 and node.link_chars * 2 > node.chars and node.tag in BLOCK


def extract(page: str | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    core, threshold = _core(parse(page))
    blocks: list[list[str]] = [[]]
    todo: list = [core]
    while todo:
        part = todo.pop()
        if part is None:
            blocks.append([])
        elif isinstance(part, str):
            blocks[-1].append(part)
        elif not part.dropped and not (part is not core and _linky(part, threshold)):
            if part.tag in BLOCK:
                blocks.append([])
                todo.append(None)
            todo.extend(reversed(part.parts))
    lines = (" ".join(html.unescape("".join(b)).split()) for b in blocks if b)
    return "\n".join(line for line in lines if line)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points)."""
    arrow_limits(pages.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = [extract(page) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as long) as page_id", "cast(url as string) as url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
