"""Operator 8: main text of web pages by minimum-cut labelling of their blocks."""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumivox.llm.storage import slices
from lumivox.plans.scratch import written

_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z]+")

#: Elements whose text is no part of the page.
_SILENT = {"script", "style", "noscript", "template", "title", "textarea", "iframe", "object", "svg", "math", "select", "button", "audio", "video", "canvas", "datalist"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol",
    "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: What an element ends, where it begins beside it.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_FENCES = {"ul", "ol", "dl", "table", "article", "section", "div", "body", "main", "aside", "nav", "footer", "header", "form", "td", "th"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_ITEMS = {"li", "dt", "dd", "td", "th", "menu"}
_PROSE = {"p", "blockquote", "pre"}
_NEVER = {"nav", "aside", "footer", "form", "menu", "dialog", "search", "address"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
_COMMENTS = {"comment", "comments", "commentlist", "disqus", "respond", "replies", "reply"}
_BOILERPLATE = _COMMENTS | {
    "ad", "ads", "adsense", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "consent", "cookie", "cookies", "copyright", "footer",
    "header", "legal", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pager", "pagination", "popup", "promo",
    "promotion", "recommended", "related", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "tags", "toolbar", "widget",
}


@dataclass(frozen=True)
class _Element:
    """An open element; what its ancestors say is carried, so no block walks up its path.

    ``mark`` is 1 within an article, -1 within boilerplate, 0 where nothing says either; ``sure`` marks hold for all that is inside.
    ``sign`` is what gives the mark (a number of ``SIGNS``), ``by`` the number of the element that does.
    ``own`` is the number of the nearest element that makes a container, ``holder`` of the container around that.
    """

    name: str
    mark: int
    sure: bool
    own: int
    holder: int
    sign: int = 0
    by: int = 0


#: What a mark is given by: an element for articles, one for what is never content, a header, a role, words of a class or id, words for comments, or being hidden.
SIGNS = ("article", "element", "header", "role", "words", "comments", "hidden")
_ROOT = _Element("", 0, False, 0, 0)


@dataclass(frozen=True)
class Block:
    """A run of text that no block boundary parts: its text, the characters of it in links, its element, mark, containers, and what gives the mark."""

    text: str
    linked: int
    name: str
    mark: int
    own: int
    holder: int
    sign: int = 0
    by: int = 0


def _opened(parent: _Element, name: str, attributes: dict[str, str], number: int) -> _Element:
    """The element ``name`` inside ``parent``; of marks the innermost that says something decides."""
    words = frozenset(_WORD.findall(f"{attributes.get('class', '')} {attributes.get('id', '')}".lower()))
    role = attributes.get("role", "").lower()
    hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
    signs = {"element": name in _NEVER, "hidden": hidden, "role": role in _ROLES, "comments": bool(words & _COMMENTS)}
    mark, sure, sign, by = parent.mark, parent.sure, parent.sign, parent.by
    if not sure:
        if any(signs.values()):
            mark, sure, sign, by = -1, True, SIGNS.index(next(k for k, v in signs.items() if v)), number
        elif name in ("html", "body"):
            pass
        elif words & _BOILERPLATE or (name == "header" and parent.mark < 1):
            mark, sign, by = -1, SIGNS.index("words" if words & _BOILERPLATE else "header"), number
        elif name in ("article", "main") or role in ("article", "main"):
            mark, sign, by = 1, SIGNS.index("article"), number
    if name in ("html", "body"):
        return _Element(name, mark, sure, 0, 0, sign, by)
    if name in _BLOCK or words or role:
        return _Element(name, mark, sure, number, parent.own, sign, by)
    return _Element(name, mark, sure, parent.own, parent.holder, sign, by)


def blocks(page: str) -> list[Block]:
    """The non-empty blocks of a whole page in order, references decoded, white space as one space; in time and memory in proportion to its length."""
    out: list[Block] = []
    stack: list[_Element] = [_ROOT]
    places: dict[str, list[int]] = {}  # of each name, where it is open in the stack
    fences: list[int] = []
    parts: list[tuple[str, bool]] = []
    holds: list[str] = []  # the block elements that are open
    links = at = number = 0

    def flush() -> None:
        if parts:
            text = " ".join("".join(t for t, _ in parts).split())
            if text:
                e = stack[-1]
                out.append(Block(text, sum(len(t.strip()) for t, link in parts if link), holds[-1] if holds else "", e.mark, e.own, e.holder, e.sign, e.by))
            parts.clear()

    def close(upto: int) -> None:
        nonlocal links
        while len(stack) > upto:
            name = stack[-1].name
            if name in _BLOCK:
                flush()
                holds.pop()
            stack.pop()
            places[name].pop()
            if fences and fences[-1] == len(stack):
                fences.pop()
            links -= name == "a"

    last = lambda name: places[name][-1] if places.get(name) else 0
    while at < len(page):
        found = _MARK.search(page, at)
        end = found.start() if found else len(page)
        if end > at:
            parts.append((html.unescape(page[at:end]), links > 0))
        if not found:
            break
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        if found[1] or found[4]:
            if last(name):
                close(last(name))
            elif name in _BLOCK:
                flush()
            continue
        if name in _SILENT:
            shut = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = shut.end() if shut else len(page)
            continue
        if name in _BLOCK:
            if last("p") > (fences[-1] if fences else 0):
                close(last("p"))
            ended = max(map(last, _ENDS.get(name, ())), default=0)
            if ended and ended >= (fences[-1] if fences else 0):
                close(ended)
            flush()
        if name == "br":
            parts.append((" ", False))
        if name in _VOID:
            continue
        raw = found[3] or found[6] or ""
        attributes = {k.lower(): a or b or c or "" for k, a, b, c in _ATTRIBUTE.findall(raw)} if raw.strip(" /") else {}
        number += 1
        places.setdefault(name, []).append(len(stack))
        if name in _FENCES:
            fences.append(len(stack))
        if name in _BLOCK:
            holds.append(name)
        stack.append(_opened(stack[-1], name, attributes, number))
        links += name == "a"
    flush()
    return out


def features(found: list[Block]) -> np.ndarray:
    """What a block looks like, a row a block: length, links, kind of element, and the blocks beside it. No class, role or mark is in it."""
    words = np.log1p([b.text.count(" ") + 1 for b in found])
    density = np.minimum(1.0, [b.linked / len(b.text) for b in found])
    beside = lambda x: (np.append(x[:1], x[:-1]) + np.append(x[1:], x[-1:])) / 2
    place = (np.arange(len(found)) + 0.5) / len(found)
    kind = lambda names: np.array([b.name in names for b in found], float)
    ends = np.array([b.text[-1] in ".!?:\"”»…。" for b in found], float)
    return np.stack([np.ones(len(found)), words, density, kind(_HEADINGS), kind(_ITEMS), kind(_PROSE), ends, beside(words), beside(density), np.abs(2 * place - 1)], axis=1)


#: The weights that a fit begins with and leans to, for the columns of ``features``; what is used where no block is marked.
PRIOR = np.array([-2.0, 1.0, -4.0, 1.5, -0.5, 0.5, 0.5, 0.2, -1.0, -0.5])
#: The columns that name the kind of element; a fit sees each block once without them too, as on a page of nothing but ``div``.
KINDS = slice(3, 6)


#: How often a sign is taken to be right and wrong before any page has been seen, and its worth by that.
SEEN = (20.0, 0.4)
SIGN = float(np.log(SEEN[0] / SEEN[1]))


@dataclass(frozen=True)
class Costs:
    """The fitted prices of a cut, all in log-odds.

    ``weights`` of the features and ``most``, the most that they say; what the mark of each of ``SIGNS`` is worth; and what it costs to part two
    blocks that are neighbours in a container, neighbours of unlike containers, and one after the other in a container with others between.
    """

    weights: np.ndarray = field(default_factory=lambda: PRIOR)
    edges: tuple[float, float, float] = (1.0, 0.25, 0.75)
    signs: tuple[float, ...] = (SIGN,) * len(SIGNS)
    most: float = 4.0


def evidence(found: list[Block], costs: Costs, but: int | None = None) -> np.ndarray:
    """The log-odds of each block for being content, by itself: its terminal capacities. Marks that the element ``but`` gives are left out."""
    own = np.clip(features(found) @ costs.weights, -costs.most, costs.most)
    return own + np.array([b.mark * costs.signs[b.sign] if b.by != but else 0.0 for b in found])


def edges(found: list[Block]) -> list[tuple[int, int, int]]:
    """The pairs of blocks that a cut pays for parting, and their kind: neighbours in one container or in two, and a container's block before."""
    out: list[tuple[int, int, int]] = []
    last: dict[int, int] = {}
    for i, block in enumerate(found):
        if i:
            out.append((i - 1, i, 0 if found[i - 1].holder == block.holder else 1))
        if last.get(block.holder, i - 1) < i - 1:
            out.append((last[block.holder], i, 2))
        last[block.holder] = i
    return out


def cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source's side of a minimum cut (those the residual graph reaches), by Dinic's max-flow."""
    n = len(source)
    s, t = n, n + 1
    graph: list[list[list]] = [[] for _ in range(n + 2)]

    def add(a: int, b: int, forth: float, back: float) -> None:
        graph[a].append([b, forth, len(graph[b])])
        graph[b].append([a, back, len(graph[a]) - 1])

    for i in range(n):
        if source[i] > 0:
            add(s, i, source[i], 0.0)
        if sink[i] > 0:
            add(i, t, sink[i], 0.0)
    for a, b, weight in edges:
        add(a, b, weight, weight)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for b, room, _ in graph[a]:
                if room > 1e-9 and level[b] < 0:
                    level[b] = level[a] + 1
                    queue.append(b)
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[tuple[int, int]] = []
        a = s
        while True:  # blocking flow along one path after another, without recursion
            if a == t:
                least = min(graph[x][k][1] for x, k in path)
                for x, k in path:
                    edge = graph[x][k]
                    edge[1] -= least
                    graph[edge[0]][edge[2]][1] += least
                path, a = [], s
                continue
            while turn[a] < len(graph[a]):
                b, room, _ = graph[a][turn[a]]
                if room > 1e-9 and level[b] == level[a] + 1:
                    break
                turn[a] += 1
            if turn[a] < len(graph[a]):
                path.append((a, turn[a]))
                a = b
            elif path:
                a = path.pop()[0]
                turn[a] += 1
            else:
                break


def main_text(page: str | None, costs: Costs = Costs()) -> str:
    """The content blocks of a whole page, joined by line feeds; empty for null, or where nothing is content."""
    found = blocks(page or "")
    return "\n".join(b.text for b, keep in zip(found, content(found, costs)) if keep)


def content(found: list[Block], costs: Costs = Costs(), but: int | None = None) -> list[bool]:
    """Which blocks are content: those on the source's side of the minimum cut. Marks that the element ``but`` gives are left out."""
    if not found:
        return []
    own = evidence(found, costs, but)
    return cut(np.maximum(own, 0).tolist(), np.maximum(-own, 0).tolist(), [(a, b, costs.edges[kind]) for a, b, kind in edges(found) if costs.edges[kind] > 0])


def _fitted(x: np.ndarray, y: np.ndarray, lean: float) -> np.ndarray:
    """Logistic weights by Newton's method, leaning to ``PRIOR`` by ``lean``."""
    w = PRIOR.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + lean * np.eye(len(w)), x.T @ (y - p) - lean * (w - PRIOR))
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _borne_out(found: list[Block], costs: Costs, each: int = 12) -> np.ndarray:
    """How many blocks' marks the rest of the page bears out, and how many it doesn't, by sign: an element's marks are left out, and the cut is asked for its blocks.

    At most ``each`` elements a page are asked about, at even strides.
    """
    counts = np.zeros((len(SIGNS), 2), np.int64)
    by = sorted({b.by for b in found if b.mark})
    for element in by[:: max(1, -(-len(by) // each))]:
        for block, kept in zip(found, content(found, costs, element)):
            if block.mark and block.by == element:
                counts[block.sign, int((block.mark > 0) != kept)] += 1
    return counts


def fit_costs(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", most: int = 1000, each: int = 40, lean: float = 10.0, smooth: float = 2.0) -> Costs:
    """Prices learned from the blocks that pages themselves mark (by element, role or class), on at most ``most`` pages.

    The weights are those of a logistic model of the marks by the features, which have no mark in them, so that they
    also price the blocks of pages that mark nothing. An edge costs the log-odds with which two such blocks have the same
    mark, ``smooth`` at most. A sign is worth the log-odds of its being borne out: of the blocks of an element that marks them, how many come out of
    the cut as it says where its own marks are left out, against how many don't. The sample (pages with the lowest hashes of their ids, ``each`` blocks a page at
    even strides) is a documented bound of what the driver gathers; a row a page reaches it. Without marked blocks the prior's prices hold.
    """
    draw = F.pmod(F.xxhash64(id_col, F.col(html_col), F.lit(17)), F.lit(1 << 30))
    rows = pages.where(F.col(html_col).isNotNull()).select(F.col(html_col).alias("html"), draw.alias("draw"))
    share = most / max(1, rows.count())
    chosen = rows.where(F.col("draw") < int(min(1.0, 1.2 * share) * (1 << 30)))
    chosen = written(chosen.orderBy("draw", "html").limit(most).select("html").repartition(16), "pages")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", 4 << 20):
            out = []
            for page in batch.column("html").to_pylist():
                found = blocks(page)
                marked = [i for i, b in enumerate(found) if b.mark]
                taken = marked[:: max(1, -(-len(marked) // each))]
                pairs = [0] * 6
                for a, b in zip(found, found[1:]):
                    if a.mark and b.mark:
                        pairs[(0 if a.holder == b.holder else 2) + (a.mark != b.mark)] += 1
                before: dict[int, Block] = {}
                for b in found:
                    if b.mark and b.holder in before:
                        pairs[4 + (before[b.holder].mark != b.mark)] += 1
                    before[b.holder] = b
                out.append({"x": features(found)[taken].ravel().tolist() if taken else [], "y": [found[i].mark > 0 for i in taken], "pairs": pairs})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("x", pa.list_(pa.float64())), ("y", pa.list_(pa.bool_())), ("pairs", pa.list_(pa.int64()))]))

    found = chosen.mapInArrow(scan, "x array<double>, y array<boolean>, pairs array<long>").toArrow().combine_chunks()
    if not found.num_rows:
        return Costs()
    x = found.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(PRIOR))
    y = found.column("y").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
    pairs = found.column("pairs").combine_chunks().flatten().to_numpy().reshape(-1, 6).sum(axis=0)
    priors = ((3, 1), (1.3, 1), (2, 1))
    agreed = [float(np.clip(np.log((pairs[2 * k] + a) / (pairs[2 * k + 1] + b)), 0.0, smooth)) for k, (a, b) in enumerate(priors)]
    plain = x.copy()
    plain[:, KINDS] = 0
    costs = Costs(_fitted(np.concatenate([x, plain]), np.concatenate([y, y]), lean), (agreed[0], agreed[1], agreed[2]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sum((_borne_out(blocks(page), costs) for batch in slices(batches, "html", 4 << 20) for page in batch.column("html").to_pylist()), np.zeros((len(SIGNS), 2), np.int64))
        yield pa.record_batch([pa.array(np.arange(len(SIGNS))), pa.array(held[:, 0]), pa.array(held[:, 1])], names=["sign", "right", "wrong"])

    seen = chosen.mapInArrow(count, "sign long, right long, wrong long").groupBy("sign").agg(F.sum("right"), F.sum("wrong")).collect()
    worth = {sign: float(np.log((right + SEEN[0]) / (wrong + SEEN[1]))) for sign, right, wrong in seen}
    return replace(costs, signs=tuple(max(0.0, worth.get(i, SIGN)) for i in range(len(SIGNS))))


def extract(pages: DataFrame, costs: Costs = Costs(), html_col: str = "html") -> DataFrame:
    """Adds ``text`` and ``n_chars`` (code points) to every page; the html is left out, other columns pass through.

    Null or empty html has an empty text; so has a page without content blocks. Marks that a page's end cuts off
    are no text. Repeated rows are each extracted; an empty table gives an empty one; columns that are called
    text or n_chars are replaced. A page is one task's work, in time in proportion to its length, however deep it is nested.
    """
    kept = [c for c in pages.columns if c not in ("text", "n_chars")]
    rows = pages.select(*[F.col(f"`{c}`") for c in kept])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, html_col, 4 << 20):
            texts = [main_text(p, costs) for p in batch.column(html_col).to_pylist()]
            others = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n != html_col]
            yield pa.record_batch([*[c for _, c in others], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*[n for n, _ in others], "text", "n_chars"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields if f.name != html_col)
    return rows.mapInArrow(scan, f"{fields}text string, n_chars long")
