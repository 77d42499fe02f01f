"""Main text of web pages by minimum-cut labelling of their blocks.

A page is read into blocks of text with their places in the element tree.  A
classifier's costs for calling a block content or boilerplate become capacities to
the two terminals; neighbours in the page, and blocks under one parent, get edges
that grow with their nearness in the tree.  The minimum cut, found by maximum flow,
labels all blocks of a page at once.

The classifier is a logistic regression over the looks of a block (links, length,
punctuation), trained on the blocks of a bounded sample of pages whose markup leaves no
doubt, with what markup says (elements, names in class and id) as prior log-odds.  It judges
every block; priors that rest on part of a name are within reach of neighbours.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampled import least_by_hash


@dataclass(frozen=True)
class ExtractParams:
    """sample: pages for the regression at most, those of least id hash.  The rest are log-odds and capacities:
    of any block, of one inside an article, of one outside on a page that has an article, of a name that
    is boilerplate in all its words (in part of them: that part), of a name of content, at most of the looks."""

    sample: int = 400
    any_block: float = 1.0
    in_article: float = 2.0
    outside_article: float = 4.0
    boilerplate: float = 8.0
    named_content: float = 1.0
    looks: float = 2.0
    next_block: float = 0.8
    same_parent: float = 0.4


# Element names of HTML by their part in a page.
RAW = frozenset(["script", "style", "template", "iframe", "title", "textarea", "select", "datalist"])
#: Elements whose text is read like any other; one without an end after it is passed over, so that its marks reach no further text.
EMBEDDED = frozenset(["noscript", "svg", "math", "object", "noembed", "noframes", "xmp", "canvas", "audio", "video", "map"])
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
BLOCK = frozenset(
    ["address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"]
)
BOILERPLATE_TAGS = frozenset(["nav", "footer", "aside", "form", "head", "button", "menu", "dialog", "fieldset", "search"])
CONTENT_TAGS = frozenset(["article", "main"])
#: Elements and names that may stand around a whole page: an article that opens inside them is one all the same.
AROUND_TAGS, AROUND_WORDS = frozenset(["form", "fieldset", "dialog"]), frozenset(["overlay", "modal", "popup"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
#: An opening element ends an open one of these, up to the given borders.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
# Words in a class, id or role that mark boilerplate, or content.
BOILERPLATE_WORDS = frozenset(
    ["ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "nav", "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs", "pagination", "pager", "sidebar", "side", "aside", "complementary", "widget", "footer", "foot", "contentinfo", "masthead", "topbar", "toolbar", "header", "share", "sharing", "social", "comment", "comments", "reply", "replies", "respond", "disqus", "related", "recommended", "recommendations", "newsletter", "subscribe", "subscription", "signup", "login", "search", "form", "copyright", "disclaimer", "skip", "hidden"]
)
CONTENT_WORDS = frozenset(["article", "articlebody", "content", "entry", "main", "post", "story", "text", "body"])

_COMMENT, _OPEN = r"<!--.*?(?:-->|\Z)", r"<(/?)([a-zA-Z][^\s/>]*)"
_QUOTED = r"((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
_TAG = re.compile(rf"{_COMMENT}|{_OPEN}{_QUOTED}|{_OPEN}([^>]*)>|<[!?/][^>]*(?:>|\Z)", re.S)
#: The same without quotes, for what follows so many tags whose quotes don't end: each of these was looked for to the page's end.
_PLAIN, UNENDED = re.compile(rf"{_COMMENT}|{_OPEN}(?!)()>|{_OPEN}([^>]*)>|<[!?/][^>]*(?:>|\Z)", re.S), 8
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_END_OF = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for name in RAW | EMBEDDED}


@dataclass
class Block:
    """A run of text: its element's parent, how deep it lies in block elements and how many of these it shares
    with the block before, its marks, its element, and letters inside links.

    mark: 0 to 1, how surely markup calls it boilerplate.  inside: in an article.  named: a content word names it.
    """

    parent: int
    depth: int
    shared: int
    mark: float
    inside: bool
    named: bool
    tag: str
    parts: list[str]
    linked: int = 0
    text: str = ""


@dataclass
class _Element:
    tag: str
    number: int
    mark: float
    inside: bool
    named: bool
    around: bool = False  # whether its mark comes only from what may stand around an article

    @property
    def kind(self) -> tuple[float, bool]:
        return self.mark, self.inside


def _marks(tag: str, attributes: str, outer: _Element) -> tuple[float, bool, bool, bool]:
    """An element's mark, whether it is in an article, whether a content word names it, and whether its mark
    comes only from what may stand around an article; all are handed down.

    A name (class, id, role) is boilerplate by the share of its words that are; a heading's id is an
    anchor and names nothing.
    """
    if outer.mark == 1 and not outer.around:
        return 1.0, outer.inside, False, False
    names: list[set[str]] = []
    hidden = main = False
    if attributes.strip():
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), html.unescape(value.strip("\"'"))
            if name in ("class", "id", "role", "itemprop") and not (name == "id" and tag in HEADINGS):
                own = [{w.lower() for w in _WORD.findall(token)} for token in value.split()]
                names += [words for words in own if words]
                main |= (name == "role" and {"main"} in own) or (name == "itemprop" and value.lower() == "articlebody")
            hidden |= name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and "display:none" in value.lower().replace(" ", ""))
    article = tag in CONTENT_TAGS or main
    words = set().union(*names)
    heading = outer.inside or bool(words & CONTENT_WORDS)
    mark = max((len(w & BOILERPLATE_WORDS) / len(w) for w in names if not (heading and w & BOILERPLATE_WORDS == {"header"})), default=0.0)
    if tag in ("body", "html"):
        mark = 0.0
    around = not outer.inside and not hidden and (tag in AROUND_TAGS or (mark == 1 and all(w <= AROUND_WORDS for w in names if w <= BOILERPLATE_WORDS)))
    if hidden or tag in BOILERPLATE_TAGS or (tag == "header" and not outer.inside):
        mark = 1.0
    if not (article and outer.around):
        around = (around or mark < 1) if outer.around else around
        mark = max(mark, outer.mark)
    return mark, outer.inside or article, mark < 1 and (outer.named or bool(words & CONTENT_WORDS)), around and mark == 1


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page with text, in order; markup may be unfinished or badly nested."""
    root = _Element("", 0, 0.0, False, False)
    stack, out, serial = [root], [], 0
    levels = [root]  # the stack's block elements
    opened: Counter[str] = Counter()
    low = 1  # the least depth since the last block
    now: Block | None = None
    ends: dict[str, int] = {}

    def close(i: int) -> None:
        """Closes the stack from its i-th element on."""
        nonlocal low
        for element in reversed(stack[i:]):
            opened[element.tag] -= 1
            if element is levels[-1]:
                levels.pop()
        del stack[i:]
        low = min(low, len(levels))

    def ended(tag: str, at: int) -> bool:
        if tag not in ends:
            ends[tag] = max((m.start() for m in _END_OF[tag].finditer(page)), default=-1)
        return ends[tag] >= at

    def say(text: str) -> None:
        nonlocal now, low
        if not text:
            return
        top = stack[-1]
        if now is not None and top.kind != (now.mark, now.inside) and text.strip():
            now = None
        if now is None:
            if not text.strip():
                return
            parent = levels[-2].number if len(levels) > 1 else -1
            now = Block(parent, len(levels), low, top.mark, top.inside, top.named, levels[-1].tag, [])
            low = len(levels)
            out.append(now)
        text = html.unescape(text)
        now.parts.append(text)
        if any(e.tag == "a" for e in stack[-4:]):
            now.linked += len(text)

    # No tag ends behind the last bracket.
    at, stop, tags, unended = 0, page.rfind(">") + 1, _TAG, 0
    while match := tags.search(page, at, stop):
        say(page[at : match.start()])
        at = match.end()
        if page.startswith("<!--", match.start()) and not page.startswith("-->", max(at - 3, match.start() + 4)):
            at = len(page)
            break
        name = match[2] or match[5]
        if not name:
            continue
        if match[5]:
            unended += 1
            tags = _TAG if unended < UNENDED else _PLAIN
        tag, closing, attributes = name.lower(), bool(match[1] or match[4]), match[3] or match[6] or ""
        if closing:
            if tag in EMBEDDED and tag != "math":
                say(" ")
            if tag in BLOCK:
                now = None
            for i in range(len(stack) - 1, 0, -1) if opened[tag] > 0 else ():
                if stack[i].tag == tag:
                    if tag not in EMBEDDED and any(stack[j].kind != stack[i - 1].kind for j in range(i, len(stack))):
                        now = None
                    close(i)
                    break
                if tag not in BLOCK and stack[i].tag in BLOCK:
                    break
            continue
        if tag in RAW:
            if tag in ("select", "datalist") and not ended(tag, at):
                continue
            end = _END_OF[tag].search(page, at)
            at = end.end() if end else len(page)
            say(" ")
            continue
        if tag in EMBEDDED:
            if tag != "math":
                say(" ")
            if not ended(tag, at):
                continue
            if tag == "xmp":
                end = _END_OF[tag].search(page, at)
                now = None
                say(html.escape(page[at : end.start()]))
                now, at = None, end.end()
                continue
        if tag == "br":
            say(" ")
            continue
        if tag in BLOCK:
            now = None
            if opened["svg"] + opened["math"] > 0:
                foreign = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in ("svg", "math", "foreignobject", "annotation-xml")), 0)
                if stack[foreign].tag in ("svg", "math"):
                    close(foreign)
            same, border = ENDS.get(tag, ({"p"}, {"td", "th", "li", "button"}))
            for i in range(len(stack) - 1, 0, -1) if opened["p"] > 0 or any(opened[x] > 0 for x in same) else ():
                if stack[i].tag in same or (stack[i].tag == "p" and tag not in ("li", "td", "th", "tr", "dt", "dd")):
                    close(i)
                    break
                if stack[i].tag in border or (stack[i].tag in BLOCK and stack[i].tag not in same and stack[i].tag not in ("ul", "ol") and tag not in ENDS):
                    break
        if tag in VOID:
            continue
        mark, inside, named, around = _marks(tag, attributes, stack[-1])
        if (mark, inside) != stack[-1].kind and tag not in EMBEDDED:
            now = None
        if attributes.endswith("/") and tag not in BLOCK:
            continue
        serial += 1
        stack.append(_Element(tag, serial, mark, inside, named, around))
        opened[tag] += 1
        if tag in BLOCK:
            levels.append(stack[-1])
    rest = page[at:]
    unclosed = re.search(r"<[a-zA-Z/!?]", rest)
    say(rest[: unclosed.start()] if unclosed else rest)
    for block in out:
        block.text = " ".join("".join(block.parts).split())
    return [b for b in out if b.text]


def looks(block: Block) -> list[float]:
    """What the regression sees of a block: its text and links, no markup."""
    text = block.text
    n = len(text)
    return [1.0, min(1.0, block.linked / n), min(1.0, math.log1p(n) / 7), float(text[-1] in ".!?…:;\"»”"), min(1.0, sum(map(text.count, ".,;:!?")) * 10 / n), float("|" in text or "©" in text or "·" in text)]


N_LOOKS = 6


def fit_looks(rows: np.ndarray, labels: np.ndarray, ridge: float = 0.02, steps: int = 12) -> np.ndarray:
    """Logistic regression by Newton's method; zeros if either class is missing.

    ridge: for each row, so that pages whose markup settles all don't make their looks sure.
    """
    weights = np.zeros(N_LOOKS)
    if len(labels) == 0 or labels.min() == labels.max():
        return weights
    hold = ridge * len(labels) * np.eye(N_LOOKS)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-rows @ weights))
        gradient = rows.T @ (labels - p) - hold @ weights
        hessian = (rows * (p * (1 - p))[:, None]).T @ rows + hold
        weights = weights + np.linalg.solve(hessian, gradient)
    return weights


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that cost least: |odds| for a label against its sign, an edge's weight for two unequal ends.

    Dinic's maximum flow from content to boilerplate; a node is content if the
    source still reaches it, so what costs the same either way is boilerplate.
    """
    n = len(odds)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    of: list[list[int]] = [[] for _ in range(n + 2)]

    def link(a: int, b: int, there: float, back: float) -> None:
        of[a].append(len(to))
        of[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for i, x in enumerate(odds):
        if x > 0:
            link(source, i, x, 0.0)
        elif x < 0:
            link(i, sink, -x, 0.0)
    for a, b, weight in edges:
        if weight > 0:
            link(a, b, weight, weight)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in of[u]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                path, u = [], source
                continue
            while at[u] < len(of[u]):
                e = of[u][at[u]]
                if room[e] > tiny and level[to[e]] == level[u] + 1:
                    break
                at[u] += 1
            else:
                if u == source:
                    break
                level[u] = -1
                u = to[path.pop() ^ 1]
                continue
            path.append(of[u][at[u]])
            u = to[path[-1]]


def _near(a: Block, b: Block) -> float:
    """1 for a block and the next of one element, less the more steps lie between them in the tree."""
    return 1 / (1 + 0.5 * max(0, a.depth + b.depth - 2 * b.shared - 2))


def costs(blocks: list[Block], weights: np.ndarray, p: ExtractParams) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Each block's log-odds of being content, and the edges between blocks."""
    article = any(b.inside and b.mark < 1 for b in blocks)
    odds = []
    for b in blocks:
        seen = max(-p.looks, min(p.looks, float(np.dot(looks(b), weights))))
        place = p.in_article if b.inside else -p.outside_article if article else 0.0
        odds.append(p.any_block + seen + place - p.boilerplate * b.mark + (p.named_content if b.named else 0.0))
    edges = [(i, i + 1, p.next_block * _near(blocks[i], blocks[i + 1])) for i in range(len(blocks) - 1)]
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if b.parent in last and last[b.parent] != i - 1:
            edges.append((last[b.parent], i, p.same_parent))
        last[b.parent] = i
    return odds, edges


def main_text(page: str | None, weights: np.ndarray, p: ExtractParams) -> str:
    """The blocks labelled content, joined by newlines."""
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    return "\n".join(b.text for b, content in zip(blocks, minimum_cut(*costs(blocks, weights, p)), strict=True) if content)


def train_looks(pages: DataFrame, p: ExtractParams, id_col: str, html_col: str) -> np.ndarray:
    """The regression's weights, from blocks that markup marks in at most ``p.sample`` pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(looks(b), float(b.mark == 0)) for page in batch.column(0).to_pylist() for b in blocks_of(page or "") if b.mark == 1 or (b.inside and b.mark == 0)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.list_(pa.float64())), pa.array([y for _, y in found], pa.float64())], ["looks", "label"])

    # Ids first, so that whole pages move only if chosen; of pages that repeat an id, the one of least hash.
    ids = least_by_hash(pages.where(F.col(id_col).isNotNull()).select(id_col).distinct(), id_col, p.sample)
    chosen = pages.join(F.broadcast(ids), id_col, "left_semi").groupBy(id_col).agg(F.min_by(html_col, F.xxhash64(html_col)).alias("html"))
    rows = chosen.select("html").mapInArrow(run, "looks array<double>, label double").groupBy("looks", "label").count().collect()
    rows = sorted((tuple(r.looks), r.label, r["count"]) for r in rows)
    if not rows:
        return np.zeros(N_LOOKS)
    times = [r[2] for r in rows]
    return fit_looks(np.repeat(np.array([r[0] for r in rows]), times, axis=0), np.repeat(np.array([r[1] for r in rows]), times))


def extract_text(pages: DataFrame, params: ExtractParams | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row; n_chars counts code points.

    A null or empty page, or one without content, has an empty text.  Rows with null
    or repeated ids are read as they are; other columns are neither read nor returned.
    """
    p = params or ExtractParams()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    weights = train_looks(rows, p, "page_id", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), weights, p) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    schema = rows.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")
    return rows.mapInArrow(run, schema)
