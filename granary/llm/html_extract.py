"""Main text of HTML pages by composite text density.

Every node of the DOM gets the number of characters per tag below it, adjusted for links: a node whose text is mostly link
text counts for little. A node's density sum is the sum of its children's densities. The subtree with the largest sum is the
article; the least density on its path to ``body`` is the threshold that blocks beside that path must reach to belong to
it. Elements that can't be article text (menus, forms, adverts, comments and the like) are taken out before counting; among what is left
tags decide ties only.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROP = frozenset("script style noscript template iframe object embed svg math canvas audio video map head title nav footer aside form button select option input textarea dialog menu fieldset noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Start tags that end an open element of the second kind, unless one of the third kind stands between.
_ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsors sponsored promo promos promotion banner banners sidebar sidebars comment comments commentlist disqus respond "
    "replies cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead share sharing social related "
    "recommended recommendations widget widgets toolbar pagination pager login search alert alerts disclaimer paywall teaser teasers outbrain taboola".split()
)
_OWN = frozenset("article post entry content main story".split())
_VALUE = r"""=\s*(?>"[^"]*"|'[^']*'|[^\s"'>][^\s>]*)"""  # a ">" inside quotes ends no tag
_TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>[^>"'=]+|{_VALUE}|["'=])*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")


def _unwanted(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in _DROP:
        return True
    if tag == "header" and not in_article:
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value.strip() in _ROLES:
            return True
        if name in ("class", "id") and value:
            words = set(_SPLIT.split(re.sub(r"([a-z])([A-Z])", r"\1-\2", m[2] or m[3] or m[4] or "").lower()))
            hit = words & _WORDS
            if hit and not (hit <= {"header"} and words & _OWN):
                return True
    return False


class _Tree:
    """Nodes in page order, as parallel lists; node 0 is the root."""

    def __init__(self) -> None:
        self.tag, self.parent, self.attrs = ["#root"], [-1], [""]
        self.texts: list[tuple[int, str]] = []  # (node, text), or (node, "") where a block begins or ends

    def add(self, tag: str, parent: int, attrs: str) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.attrs.append(attrs)
        return len(self.tag) - 1


class _Open:
    """Open elements: a stack of nodes with the depths of each tag's, so that no question needs a walk down the stack."""

    def __init__(self) -> None:
        self.nodes, self.tags = [0], ["#root"]
        self.depths: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def __len__(self) -> int:
        return len(self.nodes)

    def last(self, *tags: str) -> int:
        """Depth of the innermost open element of some tags, 0 if there is none."""
        return max((self.depths[t][-1] for t in tags if self.depths.get(t)), default=0)

    def push(self, node: int, tag: str) -> None:
        depth = len(self.nodes)
        self.nodes.append(node)
        self.tags.append(tag)
        self.depths.setdefault(tag, []).append(depth)
        if tag in _BLOCK:
            self.blocks.append(depth)

    def cut(self, depth: int) -> None:
        """Close elements down to a depth, which is closed too."""
        while len(self.nodes) > depth:
            self.nodes.pop()
            self.depths[self.tags.pop()].pop()
        while self.blocks and self.blocks[-1] >= depth:
            self.blocks.pop()


_WALLS = ("table", "td", "article", "main", "body")


def parse(page: str) -> _Tree:
    """A tree of the elements that may hold article text. Unclosed and stray tags are taken as browsers do, roughly."""
    tree, open_, at, n = _Tree(), _Open(), 0, len(page)
    dropped = 0  # depth of the stack where an unwanted element began, 0: none
    texts = tree.texts
    while at < n:
        m = _TOKEN.search(page, at)
        end = m.start() if m else n
        if end > at and not dropped:
            texts.append((open_.nodes[-1], page[at:end]))
        if not m:
            break
        at = m.end()
        name = m[2]
        if name is None:
            continue
        tag, attrs, closing = name.lower(), m[3], m[1] == "/"
        if closing:
            depth = open_.last(tag)
            if depth and (tag in _BLOCK or depth >= open_.last(*_WALLS)):
                open_.cut(depth)
            elif tag == "p":
                if not dropped:
                    texts.append((open_.nodes[-1], ""))
                continue
            if dropped and len(open_) <= dropped:
                dropped = 0
            elif not dropped and tag in _BLOCK:
                texts.append((open_.nodes[-1], ""))
            continue
        if tag in ("html", "body") and open_.last(tag):
            continue
        if tag in _BLOCK:  # a block ends an open paragraph
            depth = open_.last("p")
            if depth > dropped and depth == open_.blocks[-1]:
                open_.cut(depth)
        if tag in _ENDS:
            kinds, walls = _ENDS[tag]
            depth = open_.last(*kinds)
            if depth > dropped and depth > open_.last(*walls):
                open_.cut(depth)
        if tag == "body" and dropped and open_.tags[dropped] == "head":
            open_.cut(dropped)
            dropped = 0
        if tag in _RAW:
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else n
            continue
        node = tree.add(tag, open_.nodes[-1], attrs)
        if tag in _VOID or attrs.endswith("/") and tag not in _BLOCK:
            if not dropped and (tag == "br" or tag == "hr"):
                texts.append((open_.nodes[-1], " " if tag == "br" else ""))
            continue
        open_.push(node, tag)
        if not dropped:
            if _unwanted(tag, attrs, open_.last("article", "main") > 0):
                dropped = len(open_) - 1
                tree.attrs[node] = None
                if tag in _BLOCK:
                    texts.append((tree.parent[node], ""))
            elif tag in _BLOCK:
                texts.append((node, ""))
    return tree


class Counts:
    """Characters (without white space), tags, characters in links and links of every node's subtree; unwanted ones count nothing."""

    def __init__(self, tree: _Tree):
        n = len(tree.tag)
        self.keep = [True] * n
        for i in range(1, n):
            self.keep[i] = self.keep[tree.parent[i]] and tree.attrs[i] is not None
        self.chars, self.tags, self.link_chars, self.link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        for node, text in tree.texts:
            self.chars[node] += len("".join(text.split()))
        for i in range(n - 1, 0, -1):
            if self.keep[i]:
                self.tags[i] += tree.tag[i] not in ("br", "wbr")
                if tree.tag[i] == "a":
                    self.link_tags[i] += 1
            if tree.tag[i] == "a":
                self.link_chars[i] = self.chars[i]
            p = tree.parent[i]
            self.chars[p] += self.chars[i]
            self.tags[p] += self.tags[i]
            self.link_chars[p] += self.link_chars[i]
            self.link_tags[p] += self.link_tags[i]


def density(chars: int, tags: int, link_chars: int, link_tags: int, ratio: float) -> float:
    """Composite density of a node: characters per tag, times how much more text than link text it holds; ``ratio``: link characters to characters of the page.

    The second factor is the logarithm of ``chars / link_chars * tags / link_tags`` in a base that grows with the node's share of link text.
    """
    if not chars:
        return 0.0
    tags, more = max(1, tags), chars / max(1, link_chars) * max(1, tags) / max(1, link_tags)
    base = math.log(chars / max(1, chars - link_chars) * link_chars + ratio * chars + math.e)
    if base <= 1.0:  # no links anywhere: the natural logarithm
        return chars / tags * math.log(max(math.e, more))
    return chars / tags * max(0.0, math.log(max(1.0, more)) / math.log(max(base, 1.0 + 1e-9)))


def densities(tree: _Tree) -> tuple[Counts, list[float], list[float]]:
    """Counts, composite density and density sum of every node."""
    c, n = Counts(tree), len(tree.tag)
    ratio = c.link_chars[0] / c.chars[0] if c.chars[0] else 0.0
    own = [density(c.chars[i], c.tags[i], c.link_chars[i], c.link_tags[i], ratio) if c.keep[i] else 0.0 for i in range(n)]
    total = [0.0] * n
    for i in range(1, n):
        total[tree.parent[i]] += own[i]
    return c, own, total


_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup header".split())
_TEXTUAL = _HEADINGS | frozenset("p blockquote pre ul ol dl table figure".split())


def select(tree: _Tree) -> set[int]:
    """The nodes whose subtrees are the article.

    The subtree with the largest density sum is chosen among nodes that hold blocks (a paragraph's inline elements make no article); ties go to ``article`` and
    ``main`` and then to the earlier one. Beside its path to ``body``, blocks whose density reaches the least one of the path belong to it
    if they are text blocks or of the same kind as the path's node there, each with its own subtree of the largest sum; so do
    blocks between two that belong and a heading right before one. A page without blocks is chosen whole.
    """
    counts, own, total = densities(tree)
    n = len(tree.tag)
    if not counts.chars[0]:
        return set()
    children: dict[int, list[int]] = {}
    for i in range(1, n):
        if counts.chars[i] and counts.keep[i] and tree.tag[i] in _BLOCK:
            children.setdefault(tree.parent[i], []).append(i)
    rank = lambda i: (total[i], tree.tag[i] in ("article", "main"), -i)
    best = max((i for i in children if i == 0 or tree.tag[i] in _BLOCK), key=rank, default=0)
    path, i = [], best
    while i >= 0 and tree.tag[i] not in ("html", "#root"):
        path.append(i)
        i = tree.parent[i]
    threshold = min((own[i] for i in path), default=0.0)
    last = list(range(n))  # the last node of each subtree
    for i in range(n - 1, 0, -1):
        last[tree.parent[i]] = max(last[tree.parent[i]], last[i])
    chosen = {best}
    for inner in path:
        beside = children.get(tree.parent[inner], [])
        if tree.parent[inner] < 0 or inner not in beside:
            continue
        kind = tree.tag[inner], tree.attrs[inner]
        taken = [c for c in beside if c == inner or own[c] >= threshold and (tree.tag[c] in _TEXTUAL or (tree.tag[c], tree.attrs[c]) == kind)]
        first, final = beside.index(taken[0]), beside.index(taken[-1])
        while first and tree.tag[beside[first - 1]] in _HEADINGS:
            first -= 1
        marked = set(taken)
        for c in beside[first : final + 1]:
            if c == inner:
                continue
            if c not in marked or tree.tag[c] in _TEXTUAL:
                chosen.add(c)  # between blocks that belong, a heading, or a text block: all of it
            else:
                chosen.add(max((j for j in range(c, last[c] + 1) if j in children), key=rank, default=c))
    return chosen


def extract(page: str | None) -> str:
    """Main text of a page: blocks in page order, joined by line feeds; empty if there is none or the page is null."""
    if not page:
        return ""
    tree = parse(page)
    chosen = select(tree)
    if not chosen:
        return ""
    within = [False] * len(tree.tag)
    for i in range(len(within)):
        within[i] = i in chosen or i > 0 and within[tree.parent[i]]
    blocks, current = [], []
    for node, text in tree.texts:
        if text == "":
            if current:
                blocks.append("".join(current))
                current = []
        elif within[node]:
            current.append(text)
    if current:
        blocks.append("".join(current))
    cleaned = (" ".join(html.unescape(b).split()) for b in blocks)
    return "\n".join(b for b in cleaned if b)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages``, from the whole HTML (null: empty text).

    ``n_chars`` counts code points. Repeated rows stay repeated, null ids and urls stay null, an empty table gives no rows; pages, attributes and nesting may be of any
    length, the work grows with it in proportion. Columns that aren't named are not read, so they can't clash.
    """

    def run(batches):
        for batch in batches:
            texts = [extract(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], [id_col, url_col, "text"])

    source = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).cast("string"))
    kinds = [f.dataType.simpleString() for f in source.schema.fields]
    out = source.mapInArrow(run, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string")
    return out.select("*", F.length("text").cast("long").alias("n_chars"))
