"""Main text of web pages by tag-path ratios.

A page is read into blocks of text, each with the tag path from the root to it. Per path the
text length, the punctuation and the linked text of its blocks are summed; a path's ratio is
the text of a block by its punctuation, by its share of the page's text and of text that isn't linked.
Names of furniture (nav, footer, class words ...) are one more signal: a path below one has a fraction of its
ratio, unless that element holds nearly all of the page's text. Ratios are smoothed from a path to those above it in
the article, for headings from the block that follows, for lists outside the article from the one before; paths over a threshold are content,
and the blocks of content paths, in page order, are the text. No block is kept or left out by anything else.
"""

from __future__ import annotations

import heapq
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuespark.llm._util import arrow_map, pieces

# Names of HTML elements and of common page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output q ruby rb rp rt s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
#: Elements whose content is no text of the page.
SILENT = frozenset(
    "head script style noscript template iframe object embed svg canvas audio video dialog button select option textarea input title map applet datalist".split()
)
#: Elements, roles and class or id words of furniture.
FURNITURE = frozenset("nav footer aside form menu fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar sidebars menu menus nav navbar "
    "navigation navi breadcrumb breadcrumbs cookie cookies consent gdpr notice notices notification popup modal overlay comment comments "
    "disqus reply replies respond discussion share sharing social related recommended footer foot copyright newsletter subscribe subscription "
    "signup login search widget toolbar pagination pager skip hidden".split()
)
HEADER_NAMES = frozenset("header masthead topbar".split())
#: Words that stand beside one of these in the name of the furniture itself; with any other the name may be of something around it.
NEUTRAL = frozenset("area bar block box container form item items left list right row section site top bottom wrap wrapper unit slot".split())
NEGATING = frozenset("has no with without free non".split())
ROOTS = frozenset(("article", "main"))
ROOT_NAMES = frozenset("comment comments reply ad advert sponsored promo teaser related".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ITEMS = frozenset("li dt dd td th".split())
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "main menu nav ol p pre section summary table ul".split()
)
_SIBLINGS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
_LISTS = frozenset("ul ol dl table body html article main section div menu".split())

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>")
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"([^\s=/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])")
_PUNCT = re.compile(r"[.,;:!?…。、，；：！？]")

#: Text and punctuation of a block beyond which its path's ratio doesn't grow.
FULL_TEXT, FULL_PUNCT = 400, 8
#: What a path above counts for against the path below it; a path in an <article> or <main> against others.
DECAY = 0.8
ROOTED = 3.0
#: The part that linked text counts for at least.
LINKED = 0.02
#: The part of the largest ratio that a content path has at least; paths that say where the article is have STRONG of it.
THRESHOLD = 0.05
STRONG = 0.3
#: By kind of furniture: the factor of ratios below; and the share of its own text outside, under which the element is no furniture.
FACTOR = {"element": 0.0001, "name": 0.0002, "part": 0.1}
ALONE = {"element": 0.02, "name": 0.02, "part": 0.5}


class Node:
    """An element: furniture is its kind of furniture or None; path is set when ratios are computed."""

    __slots__ = ("furniture", "label", "name", "off", "parent", "path", "root")

    def __init__(self, name: str, parent: Node | None, off: bool, label: str, furniture: str | None = None) -> None:
        self.name, self.parent, self.label, self.furniture = name, parent, label, furniture
        self.off = off or (parent is not None and parent.off)
        self.root = name in ROOTS and furniture is None or parent is not None and parent.root
        self.path = -1


class Block:
    __slots__ = ("linked", "node", "punct", "text")

    def __init__(self, node: Node, text: str, linked: int) -> None:
        self.node, self.text, self.linked = node, text, linked
        self.punct = len(_PUNCT.findall(text))

    def weight(self) -> float:
        return min(len(self.text), FULL_TEXT) * (1 + min(self.punct, FULL_PUNCT)) * max(LINKED, 1 - self.linked / len(self.text))


def _named(value: str, names: frozenset[str]) -> str | None:
    """Whether class or id words name furniture (name), may name what holds it (part), or neither."""
    found = None
    for token in value.split():
        words = {x.lower() for x in _SPLIT.split(token) if x and not x.isdigit()}
        if words & names:
            if words <= names | NEUTRAL:
                return "name"
            found = None if words & NEGATING and found is None else "part"
    return found


def signals(name: str, attrs: str, in_root: bool) -> tuple[bool, str | None]:
    """(whether an element is silent, its kind of furniture)."""
    if name in SILENT:
        return True, None
    kind = "element" if name in FURNITURE or name == "header" and not in_root else None
    if not attrs or name in ("html", "body"):
        return False, kind
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True, None
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, None
        if kind in ("element", "name"):
            continue
        if key == "role" and value.lower() in ROLES:
            kind = "element"
        elif key in ("class", "id"):
            kind = _named(value, ROOT_NAMES if name in ROOTS else NAMES if in_root else NAMES | HEADER_NAMES) or kind
    return False, kind


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, without those in silent elements. Unclosed and stray tags are allowed."""
    top = Node("", None, False, "")
    stack = [top]
    out: list[Block] = []
    parts: list[str] = []
    linked = links = 0
    owner = top
    size = len(page)

    def end() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(owner, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    at = 0
    while at < size:
        lt = page.find("<", at)
        stop = size if lt < 0 else lt
        if stop > at and not stack[-1].off:
            if not parts:
                owner = next((n for n in reversed(stack) if n.name not in INLINE), top)
            parts.append(page[at:stop])
            if links:
                linked += stop - at
        if lt < 0:
            break
        if page.startswith("<!--", lt):
            close = page.find("-->", lt + 4)
            at = size if close < 0 else close + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            close = page.find(">", lt)
            at = size if close < 0 else close + 1
            continue
        m = _TAG.match(page, lt) or _LOOSE.match(page, lt)
        if not m:
            after = page[lt + 1 : lt + 2]
            if after.isalpha() or after == "/":  # a tag that never ends
                break
            if not stack[-1].off:
                if not parts:
                    owner = next((n for n in reversed(stack) if n.name not in INLINE), top)
                parts.append("<")
            at = lt + 1
            continue
        at = m.end()
        closing, name, attrs = m[1], m[2].lower(), m[3]
        inline = name in INLINE
        if not inline and name not in VOID:
            end()
        elif name in ("br", "hr"):
            if parts:
                parts.append(" ")
            if name == "hr":
                end()
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    links -= sum(n.name == "a" for n in stack[k:])
                    del stack[k:]
                    break
                if inline and stack[k].name not in INLINE:
                    break
            continue
        if name in VOID:
            continue
        if name in _CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == "p":
                    links -= sum(n.name == "a" for n in stack[k:])
                    del stack[k:]
                    break
                if stack[k].name not in INLINE:
                    break
        elif name in _SIBLINGS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in _SIBLINGS[name]:
                    links -= sum(n.name == "a" for n in stack[k:])
                    del stack[k:]
                    if name in ("td", "th", "li", "dt", "dd", "option"):
                        break
                elif stack[k].name in _LISTS:
                    break
        if name == "body":
            del stack[1 + (len(stack) > 1 and stack[1].name == "html") :]
        parent = stack[-1]
        silent, furniture = (True, None) if parent.off else signals(name, attrs, parent.root)
        label = name
        if not inline and "class" in attrs and (c := re.search(r"class\s*=\s*[\"']?([\w-]+)", attrs)):
            label = f"{name}.{c[1]}"
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            at = size if close is None else close.start()
            if close is not None:
                gt = page.find(">", at)
                at = size if gt < 0 else gt + 1
            continue
        if attrs.endswith("/") and name in ("svg", "math"):
            continue
        stack.append(Node(name, parent, silent, label, furniture))
        links += name == "a"
    end()
    return out


def lift_furniture(page: list[Block]) -> None:
    """Take the mark of furniture from elements that hold nearly all of the text, the largest first: names can be wrong.

    An element stays marked if the text outside all marked elements is over a share (ALONE) of what it holds.
    """
    own: dict[Node | None, float] = {}
    above: dict[Node, Node | None] = {}
    for b in page:
        marked = [n for n in _line(b.node) if n.furniture]
        for n, m in zip(marked, [*marked[1:], None], strict=False):
            above[n] = m
        first = marked[0] if marked else None
        own[first] = own.get(first, 0.0) + b.weight()
    held = {n: own.get(n, 0.0) for n in above}
    below: dict[Node | None, list[Node]] = {}
    depth = {n: sum(1 for _ in _line(n)) for n in above}
    for n in sorted(above, key=lambda n: -depth[n]):
        below.setdefault(above[n], []).append(n)
        if (m := above[n]) is not None:
            held[m] += held[n]
    outside = own.get(None, 0.0)
    todo = [(-ALONE[n.furniture] * held[n], k, n) for k, n in enumerate(below.get(None, []))]
    heapq.heapify(todo)
    while todo and outside < -todo[0][0]:
        n = heapq.heappop(todo)[2]
        n.furniture = None
        outside += own.get(n, 0.0)
        for m in below.get(n, []):
            heapq.heappush(todo, (-ALONE[m.furniture] * held[m], len(above) + id(m), m))


def _line(node: Node | None):
    while node is not None:
        yield node
        node = node.parent


def common(nodes: list[Node]) -> Node:
    """The lowest element that holds all nodes, or is one of them and holds the rest."""
    line = list(_line(nodes[0]))
    place = {n: k for k, n in enumerate(line)}
    at = 0
    for n in dict.fromkeys(nodes):
        while n not in place:
            n = n.parent
        at = max(at, place[n])
    return line[at]


class Paths:
    """Tag paths as numbers: parents come before children; labels holds each one's last step."""

    def __init__(self) -> None:
        self.number: dict[tuple[int, str], int] = {}
        self.parents: list[int] = []
        self.labels: list[str] = []
        self.factors: list[float] = []

    def of(self, node: Node) -> int:
        way = []
        n: Node | None = node
        while n is not None and n.path < 0:
            way.append(n)
            n = n.parent
        at = -1 if n is None else n.path
        for m in reversed(way):
            step = m.label + "!" * bool(m.furniture)
            key = (at, step)
            if key not in self.number:
                factor = self.factors[at] if at >= 0 else 1.0
                if m.furniture:
                    factor = min(factor, FACTOR[m.furniture])
                elif m.name in ROOTS and factor == 1.0:
                    factor = ROOTED
                self.number[key] = len(self.parents)
                self.parents.append(at)
                self.labels.append(step)
                self.factors.append(factor)
            at = m.path = self.number[key]
        return at

    def text(self, path: int) -> str:
        steps = []
        while path >= 0:
            steps.append(self.labels[path])
            path = self.parents[path]
        return "/".join(reversed(steps))


def raw_ratios(page: list[Block], paths: Paths) -> tuple[list[float], list[float]]:
    """Of every path (the ratio of the blocks on it, that of the blocks on and below it).

    A ratio: mean text * (1 + mean punctuation) * text not linked * sqrt(share of the page).
    """
    size = len(paths.parents)
    sums = [[0.0] * 5 for _ in range(size)]
    for b in page:
        s = sums[b.node.path]
        for k, x in enumerate((1, min(len(b.text), FULL_TEXT), min(b.punct, FULL_PUNCT), b.linked, len(b.text))):
            s[k] += x
    total = sum(len(b.text) for b in page)

    def ratio(n: float, text: float, punct: float, linked: float, chars: float) -> float:
        return text / n * (1 + punct / n) * max(LINKED, 1 - linked / chars) * (chars / total) ** 0.5 if n else 0.0

    own = [ratio(*s) for s in sums]
    for p in range(size - 1, 0, -1):
        up = paths.parents[p]
        sums[up] = [a + b for a, b in zip(sums[up], sums[p], strict=True)]
    return own, [ratio(*s) for s in sums]


def path_ratios(page: list[Block]) -> dict[int, float]:
    """The smoothed and fused ratio of each path that has blocks; block.node.path is the number of its path."""
    lift_furniture(page)
    paths = Paths()
    own = [paths.of(b.node) for b in page]
    raw, below = raw_ratios(page, paths)
    heading = {p for p, b in zip(own, page, strict=True) if b.node.name in HEADINGS}
    fused = {p: raw[p] * paths.factors[p] for p in own}
    most = max((x for p, x in fused.items() if p not in heading), default=0.0)
    strong = [b.node for p, b in zip(own, page, strict=True) if p not in heading and fused[p] >= STRONG * most]
    article = common([_home(n) for n in strong]) if strong else None
    if article is not None and article.name in ("", "html", "body"):
        article = None
    # in the article a path takes over a part of those above it, up to the article's own
    outer = {p for p, b in zip(own, page, strict=True) if article is None or article not in _line(b.node)}
    shares = _linked(page)
    smooth = {}
    for p in fused:
        s, w, part, up = raw[p], 1.0, DECAY, p if article is not None and p == article.path else paths.parents[p]
        while p not in outer:
            s, w, part = s + part * below[up], w + part, part * DECAY
            if up == article.path:
                s *= max(LINKED, 1 - shares[p])
                break
            up = paths.parents[up]
        smooth[p] = s / w * paths.factors[p]
    # a heading is as much content as what it stands over; furniture between them is passed over
    after: dict[int, list[float]] = {}
    following: float | None = None
    for p, b in zip(reversed(own), reversed(page), strict=True):
        if p in heading:
            after.setdefault(p, []).append(smooth[p] if following is None else following * min(1.0, paths.factors[p]))
        elif paths.factors[p] >= 1:
            following = smooth[p]
    # outside the article a list is a part of what it follows
    before: dict[int, list[float]] = {}
    leading = 0.0
    for p, b in zip(own, page, strict=True):
        if b.node.name in ITEMS:
            if p in outer:
                before.setdefault(p, []).append(DECAY * leading * min(1.0, paths.factors[p]) * max(LINKED, 1 - shares[p]))
        elif p not in heading and paths.factors[p] >= 1:
            leading = smooth[p]
    return smooth | {p: max(smooth[p], sum(x) / len(x)) for p, x in before.items()} | {p: sum(x) / len(x) for p, x in after.items()}


def _linked(page: list[Block]) -> dict[int, float]:
    """Share of linked text of each path."""
    linked: dict[int, list[int]] = {}
    for b in page:
        x = linked.setdefault(b.node.path, [0, 0])
        x[0] += b.linked
        x[1] += len(b.text)
    return {p: a / max(1, n) for p, (a, n) in linked.items()}


def _home(node: Node) -> Node:
    """The element around a block's own, within the body."""
    return node.parent if node.parent is not None and node.parent.name not in ("", "html") else node


def main_text(page: str | None) -> str:
    """The text of a page's content paths: white space in a block is one space, blocks are joined by one."""
    found = blocks(page) if page else []
    if not found:
        return ""
    ratios = path_ratios(found)
    least = THRESHOLD * max(ratios.values())
    return " ".join(b.text for b in found if ratios[b.node.path] >= least)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row; null, empty or text-free html gives an empty text.

    Null ids and urls pass through. Repeated rows give repeated rows, an empty table an empty one; other columns are
    ignored, whatever their names. Long html is read whole, page by page; the state of a page grows with its
    number of elements. Where several paths have the largest ratio, all are content. One pass, no shuffle.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "cs_html", 8 << 20):
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                [id_col, url_col, "text", "n_chars"],
            )

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    rows = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).alias("cs_html"))
    return arrow_map(rows, work, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars bigint")
