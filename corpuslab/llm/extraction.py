"""Main text of web pages by tag-path ratios.

Every text block of a page belongs to the path of block elements from the root to it. Per path, the text
length, the punctuation and the share of link text over all its blocks are aggregated and divided
by the number of blocks, smoothed over neighbouring paths in page order, fused into one score and
held against a threshold from the scores' mean and deviation. The paths that pass select the
content nodes: the subtree that holds them (an article or main element if they lie in one). So a
short paragraph stays because of its path, and a long notice elsewhere does not pass.

Elements that are never main text (scripts, styles, menus, footers, forms, adverts, reader comments and the
like) are left out by tag, role, class or id before paths are counted. A class, id or role counts if the
whole of it is such a name, besides words of place and kind ('site-footer', not 'has-sidebar'); an element
left out by name stays if it holds more than MOST of the text that is left without it. In an article, names that
its own parts can bear too (OWN) leave the choice to the scores, and lists of links stay.

Inline elements belong to their block. Character references are decoded; white space in a block
becomes one space; blocks are joined by a newline. Defined results: null, empty and text-free pages
give an empty text; unclosed elements end with their parent; a page of any length and depth is read once, from
front to back, in time that grows with its length (paths are nodes of a tree, open elements are found by name). Repeated rows are treated alike; extra columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslab.llm.common import slices

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_NAMED = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_SPAN_END = re.compile(r"</span\s*>", re.I)
_PART = re.compile(r"[a-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PUNCTUATION = re.compile(r"[.,;:!?…。，！？；：、]")

RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins",
    "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
    "tt", "u", "var",
}
LEFT_OUT = {
    "audio", "button", "canvas", "datalist", "dialog", "footer", "form", "head", "iframe", "map", "math", "menu",
    "nav", "noscript", "object", "option", "aside", "script", "select", "style", "svg", "template", "textarea", "title", "video",
}
LEFT_OUT_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "alert", "banner", "breadcrumb", "breadcrumbs",
    "comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "dialog", "disclaimer",
    "discussion", "disqus", "footer", "login", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice",
    "notices", "notification", "overlay", "pager", "pagination", "popup", "promo", "promotion", "recommended", "related",
    "replies", "reply", "respond", "share", "sharing", "sidebar", "signup", "skyscraper", "social", "sponsor",
    "sponsored", "subscribe", "subscription", "toolbar", "widget",
}
#: Words that may stand beside such a name in a class or id.
BESIDE = {
    "area", "article", "aside", "bar", "block", "body", "bottom", "box", "container", "content", "entry", "footer", "global", "group",
    "header", "inner", "item", "items", "left", "links", "list", "main", "outer", "page", "panel", "post", "posts", "primary",
    "right", "secondary", "section", "site", "slot", "text", "title", "top", "unit", "wrap", "wrapper",
}
#: In an article the scores decide about elements of these names.
OWN = {"alert", "banner", "disclaimer", "discussion", "notice", "notices", "notification", "related", "widget"}
MOST = 0.9
#: Left out unless they lie in the article itself.
OUTER = {"header", "masthead", "topbar"}
CONTENT = {"article", "main"}
#: A start tag closes an open element of these names that is the nearest of its kind.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "thead", "tbody"},
}
HOLDERS = {"ul", "ol", "dl", "table"}
#: A path passes at this many deviations over the mean score; a page's best path always passes.
DEVIATIONS = 0.5
LINKED = 0.8


def _names(attributes: str) -> set[str]:
    """The names in LEFT_OUT_NAMES and OUTER that a whole class, id or role bears."""
    found: set[str] = set()
    for m in _NAMED.finditer(attributes):
        for token in (m[2] or m[3] or m[4] or "").split():
            parts = set(_PART.findall(_HUMP.sub("-", token).lower()))
            named = parts & (LEFT_OUT_NAMES | OUTER)
            if named and parts - named <= BESIDE:
                found |= named
    return found


class Paths:
    """The tag paths of a page as a tree: a path is the number of its node, so that deep pages share
    what their paths have in common. Node 0 is the empty path; a node comes after its parent."""

    def __init__(self) -> None:
        self.names, self.parents, self.depths = [""], [0], [0]
        self.roots = [-1]  # the outermost article or main of the path
        self.in_article, self.own = [False], [False]
        self._below: dict[tuple[int, str], int] = {}

    def child(self, node: int, name: str) -> int:
        found = self._below.setdefault((node, name), len(self.names))
        if found == len(self.names):
            self.names.append(name)
            self.parents.append(node)
            self.depths.append(self.depths[node] + 1)
            above = self.roots[node]
            self.roots.append(found if above < 0 and name in CONTENT else above)
            self.in_article.append(self.in_article[node] or name == "article")
            self.own.append(self.own[node] or name.endswith("!"))
        return found

    def path(self, node: int) -> tuple[str, ...]:
        names = []
        while node:
            names.append(self.names[node])
            node = self.parents[node]
        return tuple(reversed(names))

    def meeting(self, nodes: list[int]) -> int:
        """The deepest node that all of these lie in."""
        held = [0] * len(self.names)
        for n in nodes:
            held[n] += 1
        for n in range(len(held) - 1, 0, -1):
            if held[n] == len(nodes):
                return n
            held[self.parents[n]] += held[n]
        return 0

    def inside(self, root: int) -> list[bool]:
        """Per node whether it lies in the root."""
        found = [False] * len(self.names)
        for n, parent in enumerate(self.parents):
            found[n] = n == root or (n > 0 and found[parent])
        return found


class Open(NamedTuple):
    """An open element, with what it inherits from those around it."""

    name: str
    #: its text is left out
    out: bool
    #: start of the only element around it (or itself) that is left out by name; 0: none, -1: several
    named: int
    #: its place in the paths
    node: int
    #: an article or main lies around it; one of them keeps its text or is an article
    content: bool
    kept: bool


class Stack:
    """The open elements; of each name the places are known, so that no search walks through all of them."""

    def __init__(self) -> None:
        self.held = [Open("", False, 0, 0, False, False)]
        self._places: dict[str, list[int]] = {}

    @property
    def top(self) -> Open:
        return self.held[-1]

    def place(self, names: set[str]) -> int:
        """Place of the innermost open element of these names, 0 if there is none."""
        return max((self._places[n][-1] for n in names if self._places.get(n)), default=0)

    def push(self, element: Open) -> None:
        self._places.setdefault(element.name, []).append(len(self.held))
        self.held.append(element)

    def cut(self, place: int) -> None:
        """Close everything from this place on."""
        while len(self.held) > place:
            self._places[self.held.pop().name].pop()


def read_page(page: str) -> tuple[Paths, list[tuple[int, str, int]]]:
    """The tree of paths and (path, text, characters in links) of the blocks in page order, without what
    is left out. A page is read once; the work grows with its length, however deep it nests."""
    blocks: list[tuple[int, str, int, int]] = []
    paths, stack = Paths(), Stack()
    pieces: list[str] = []
    links: list[str] = []
    state = {"link": 0}
    spans_end = True  # whether a later end tag of a span is known to be possible

    def flush() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text and not stack.top.out:
                linked = len(" ".join(html.unescape("".join(links)).split()))
                blocks.append((stack.top.node, text, min(linked, len(text)), stack.top.named))
            pieces.clear()
            links.clear()

    def say(raw: str) -> None:
        if raw and not stack.top.out:
            pieces.append(raw)
            if state["link"]:
                links.append(raw)

    at, end = 0, len(page)
    while at < end:
        token = _TOKEN.search(page, at)
        if token is None:
            say(page[at:])
            break
        say(page[at: token.start()])
        at = token.end()
        name = (token[2] or token[5] or "").lower()
        if not name:
            if token[0].startswith("<![CDATA["):
                say(html.escape(token[0][9:].removesuffix("]]>")))
            continue
        closing, attributes = (token[1] or token[4] or "") == "/", token[3] or token[6] or ""
        if name in INLINE:
            if name == "a":
                state["link"] = 0 if closing else 1
            if not closing and spans_end and name == "span" and _HIDDEN.search(attributes):
                found = _SPAN_END.search(page, at)
                spans_end = found is not None
                at = found.end() if found else at
            continue
        if name in ("br", "wbr", "img", "input"):
            say(" " if name == "br" else "")
            continue
        flush()
        state["link"] = 0
        if name in VOID:
            continue
        if closing:
            place = stack.place({name})
            if place:
                stack.cut(place)
            continue
        if name in RAW:
            found = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            at = found.start() if found else end
            continue
        if attributes.rstrip().endswith("/") and name in ("path", "circle", "rect", "use"):
            continue
        if stack.top.name == "p":
            stack.cut(len(stack.held) - 1)
        if name in CLOSES:
            while (place := stack.place(CLOSES[name])) > stack.place(HOLDERS):
                stack.cut(place)
                if name not in ("td", "th", "tr", "tbody", "tfoot"):
                    break
        if name == "body":
            stack.cut(1 + (len(stack.held) > 1 and stack.held[1].name == "html"))
        inside = stack.top.kept or (stack.top.content and name != "article")
        names = _names(attributes) if attributes and name not in ("html", "body") else set()
        if name in CONTENT and not inside and not names & LEFT_OUT_NAMES:
            while (stack.top.out or stack.top.named) and len(stack.held) > 1:  # an unclosed advert or menu does not swallow the article
                stack.cut(len(stack.held) - 1)
        around = stack.top
        out = around.out or name in LEFT_OUT or (not inside and name in OUTER) or bool(
            attributes and _HIDDEN.search(attributes))
        if inside:
            names -= OUTER
        own = bool(names) and names <= OWN and bool(stack.place({"article"}))
        named = around.named
        if names and not own:
            named = -1 if named else at
        stack.push(Open(
            name, out, named, paths.child(around.node, f"{name}!" if own else name), around.content or name in CONTENT,
            around.kept or (name in CONTENT and (name == "article" or not (out or named)))))
    flush()
    return paths, _without_named(blocks)


def text_blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """The blocks of ``read_page`` with their paths written out."""
    paths, blocks = read_page(page)
    return [(paths.path(node), text, linked) for node, text, linked in blocks]


def _without_named(blocks: list[tuple[int, str, int, int]]) -> list[tuple[int, str, int]]:
    """The blocks outside the elements that are left out by name, and those of such an element if it
    holds nearly all of the text."""
    held: dict[int, int] = {}
    for _, text, _, named in blocks:
        held[named] = held.get(named, 0) + len(text)
    seen = held.get(0, 0)
    stays = {x for x, n in held.items() if not x or x > 0 and n > MOST * (n + seen)}
    return [(path, text, linked) for path, text, linked, named in blocks if named in stays]


def content_paths(tree: Paths, blocks: list[tuple[int, str, int]]) -> set[int]:
    """The paths whose blocks are main text."""
    sums: dict[int, list[int]] = {}
    for path, text, linked in blocks:
        s = sums.setdefault(path, [0, 0, 0, 0])
        s[0] += len(text)
        s[1] += len(_PUNCTUATION.findall(text))
        s[2] += linked
        s[3] += 1
    paths = list(sums)
    free = [sums[p][0] - sums[p][2] for p in paths]
    lengths = [free[i] / sums[p][3] for i, p in enumerate(paths)]
    marks = [sums[p][1] * free[i] / (sums[p][0] * sums[p][3]) for i, p in enumerate(paths)]
    scores = [math.sqrt(a * (1 + b)) for a, b in zip(_smooth(lengths), _smooth(marks), strict=True)]
    mean = sum(scores) / len(scores)
    deviation = math.sqrt(sum((s - mean) ** 2 for s in scores) / len(scores))
    best = max(range(len(paths)), key=lambda i: (free[i] * (1 + marks[i]), scores[i]))
    chosen = [p for p, s, f in zip(paths, scores, free, strict=True) if f and s >= mean + DEVIATIONS * deviation]
    chosen.append(paths[best])
    content = [p for p in paths if tree.roots[p] >= 0]
    held = [p for p in chosen if tree.roots[p] >= 0] if content else chosen
    if not held:  # an article without text of its own weight
        held = content
    if content:
        roots = {tree.roots[p] for p in held}
        near = {p for p in content if tree.roots[p] in roots}
    else:
        first = tree.parents[held[0]] if tree.depths[held[0]] > 1 else held[0]
        inside = tree.inside(tree.meeting([first, *held[1:]]))
        near = {p for p in paths if inside[p]}
    return set(held) | {
        p for p in near if not tree.own[p] and (tree.in_article[p] or sums[p][2] <= LINKED * sums[p][0])}


def _smooth(values: list[float]) -> list[float]:
    """Each value with a quarter of either neighbour; a value alone stays."""
    n = len(values)
    return [(2 * v + values[max(i - 1, 0)] + values[min(i + 1, n - 1)]) / 4 for i, v in enumerate(values)]


def main_text(page: str | None) -> str:
    paths, blocks = read_page(page or "")
    if not blocks:
        return ""
    picked = content_paths(paths, blocks)
    return "\n".join(text for path, text, _ in blocks if path in picked)


def extract(pages: DataFrame, key: str = "page_id", page: str = "html") -> DataFrame:
    """Add text and n_chars to the pages, without the page itself."""
    rest = [c for c in pages.columns if c not in (page, "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(p.as_py()) for p in batch.column(len(rest))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                [*rest, "text", "n_chars"])

    rows = pages.select(*rest, F.col(page).cast("string").alias(page))
    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1])
    return rows.mapInArrow(run, f"{fields}, text string, n_chars long")
