"""HTML extraction: a recurrent network labels the blocks of a page as main text or not.

A page is read as the sequence of its leaf blocks (text between block-level tags; scripts, styles, drawings, comments and
the head never become text). A head without end tag ends at the first tag or text that belongs to the body, a drawing
without one where a block begins or ends; only scripts, styles and frames without one run to the end of the page. Each block is described by its tag path (tags, classes and ids of all open elements, hashed), its
words (hashed), its length, link share and place. A bidirectional LSTM in numpy reads the whole sequence, so that every
block is labelled with the context of all others, and blocks above one half are kept in page order.

The network is trained on at most ``sample`` pages (the first by a hash of their id, of those with at most ``most``
characters), in stretches of ``longest`` blocks, with labels from their own markup (inside article or main, outside
navigation, footers, adverts, forms and comments; pages without such marks teach nothing), and on variants of these pages in
which containers are renamed and menus, notices, sidebars, adverts, forms and reader comments are put around and into the
text, so that no single tag decides. Every page is labelled by the network over its whole html.

Defined results: null and empty html, and pages without main text, give the empty text; character references are
decoded, white space within a block becomes one space, blocks are joined by two line ends; unclosed elements end with the
page; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huegrid.llm.common import by_size, slices, table, tidy

START = re.compile(
    r"<!--|<(?P<raw>script|style|template|svg|iframe|object|canvas|noscript|head|annotation(?:-xml)?)(?![\w:\-])|<(?P<end>/?)(?P<name>[a-z][a-z0-9:\-]*)|<[!?]",
    re.IGNORECASE,
)
SPECIAL = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
#: Fixed values of HTML: elements without content, and elements that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup html label legend li main menu nav ol option p pre section select summary table tbody td textarea "
    "tfoot th thead title tr ul".split()
)
#: Elements whose text is no markup: without an end tag they run to the end of the page.
RAW = frozenset("script style iframe".split())
BARE = re.compile(r"[^\s\"'>]*")
IN_HEAD = re.compile(r"\s+|<!--.*?(?:-->|\Z)|<(?P<whole>script|style|title|noscript|template)(?![\w:\-])[^>]*>.*?(?:</(?P=whole)\s*>|\Z)|<(?:meta|link|base|basefont|bgsound)(?![\w:\-])[^>]*>", re.IGNORECASE | re.DOTALL)
HEAD_END = re.compile(r"</head\s*>", re.IGNORECASE)
#: Inside a drawing: elements that may hold HTML, the drawing itself, and what ends a drawing that was left open.
DRAWN = re.compile(
    r"<(?P<end>/?)(?:(?P<holder>foreignobject|desc|title)|(?P<svg>svg)|(?P<out>b|big|br|code|em|embed|hr|i|img|s|small|span|strong|sub|sup|u|"
    + "|".join(sorted(BLOCKS - {"title"}))
    + r"))(?![\w:\-])(?P<rest>[^>]*)>",
    re.IGNORECASE,
)
#: Names of elements, classes and ids that tell main text from the rest where a page's own markup says so.
MAIN = frozenset(("article", "main"))
OTHER = frozenset(
    "nav aside footer form header ad ads advert advertisement banner sponsored promo menu navbar breadcrumb sidebar widget related cookie consent "
    "notice popup modal comment comments respond reply share social newsletter subscribe button select option label textarea".split()
)
PATH, WORDS, HIDDEN = 40, 32, 20
INPUT = PATH + WORDS + 8
CELLS = 16_384  # blocks that the network reads at once, padding counted


class Element:
    """An open element: its names, those it is in, and what all of them say together."""

    __slots__ = ("inside", "links", "main", "names", "other", "tag", "vector")

    def __init__(self, inside: Element | None, tag: str, names: tuple[str, ...]):
        self.inside, self.tag, self.names = inside, tag, names
        plain = {n.lstrip(".") for n in names}
        self.main, self.other = bool(plain & MAIN) or inside is not None and inside.main, bool(plain & OTHER) or inside is not None and inside.other
        self.links = (tag == "a") + (inside.links if inside else 0)
        self.vector = inside.vector.copy() if inside else np.zeros(PATH, np.float32)
        for name in names:
            k, sign = _place(name, PATH)
            self.vector[k] += sign


class Block(NamedTuple):
    element: Element | None
    text: str
    links: float  # share of its characters inside links

    @property
    def path(self) -> tuple[str, ...]:
        """Names of all open elements, classes and ids as .name, from the outermost on."""
        names, element = [], self.element
        while element:
            names.append(element.names)
            element = element.inside
        return tuple(n for some in reversed(names) for n in some)


def block(path: tuple[str, ...], text: str, links: float) -> Block:
    element = None
    for name in path:
        element = Element(element, name, (name,))
    return Block(element, text, links)


def _names(tag: str, rest: str) -> tuple[str, ...]:
    names = [tag]
    for m in ATTRIBUTE.finditer(rest):
        names.extend("." + part for part in re.split(r"[\s_\-]+", (m[2] or m[3] or m[4] or "").lower()) if part)
    return tuple(names)


class Marks:
    """Where tags and drawings of a page end. Whatever stays open is looked for once, so that a page is read in linear time."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.missing: set[str] = set()  # names with no further end tag
        self.astray: set[int] = set()  # quotes from which no tag's end is reached
        self.drawn: list[re.Match] | None = None

    def tag_end(self, at: int) -> int:
        """The place of a tag's closing bracket: the first outside quotes, or the first of all if its quotes don't close."""
        tried, here = [], at
        while (m := SPECIAL.search(self.page, here)) and m[0] != ">" and m.start() not in self.astray:
            tried.append(m.start())
            here = self.page.find(m[0], m.end()) + 1
            if not here:
                break
        else:
            if m and m[0] == ">":
                return m.start()
        self.astray.update(tried)
        return self.page.find(">", at)

    def drawing_end(self, at: int) -> int:
        """Where a drawing ends whose start tag ends at ``at``: behind its end tag, or before the first element that can't stand in one."""
        if self.drawn is None:
            self._drawings()
        k = bisect_left(self.starts, at)
        svg, out = self.svg_end[k], self.out[k]
        if svg < out:
            return self.drawn[svg].end()
        return self.drawn[out].start() if out < len(self.drawn) else at

    def _drawings(self) -> None:
        self.drawn = [m for m in DRAWN.finditer(self.page, 0, self.last + 1) if m["out"] or not m["rest"].endswith("/")]
        self.starts, n = [m.start() for m in self.drawn], len(self.drawn)
        # From each mark on: the one that ends an open drawing, an open element that may hold HTML, and the first that ends a drawing from without.
        self.svg_end, holder_end, self.out = ([n] * (n + 2) for _ in range(3))

        for k in range(n - 1, -1, -1):
            m = self.drawn[k]
            svg, holder, out = self.svg_end[k + 1], holder_end[k + 1], self.out[k + 1]
            if m["svg"]:
                svg = k if m["end"] else self.svg_end[svg + 1]
            elif m["holder"]:
                out = out if m["end"] else self.out[holder + 1]
                holder = k if m["end"] else holder_end[holder + 1]
            else:
                out = k
            self.svg_end[k], holder_end[k], self.out[k] = svg, holder, out


def _open_value(own: str) -> bool:
    """Whether a tag's text ends in a value without quotes, of which a slash at the end is a part."""
    size = BARE.match(own[::-1]).end()
    tail, head = own[len(own) - size :], own[: len(own) - size]
    return "=" in tail[:-1] or bool(tail) and head.rstrip().endswith("=")


def _raw_end(page: str, name: str, own: str, at: int, marks: Marks) -> int:
    """Where an element without text of its own ends, end tag included, whose start tag says ``own`` and ends at ``at``."""
    if name == "head":
        while inside := IN_HEAD.match(page, at):
            at = inside.end()
        end = HEAD_END.match(page, at)
        return end.end() if end else at
    if name not in ("script", "style") and own.endswith("/") and not _open_value(own):
        return at
    if name == "svg":
        return marks.drawing_end(at)
    end = None if name in marks.missing else re.compile(rf"</{name}\s*>", re.IGNORECASE).search(page, at)
    if end:
        return end.end()
    marks.missing.add(name)
    return len(page) if name in RAW else at


BARRIERS = ("article", "body", "main", "section")


class Stack:
    """The open elements, with the places of each name, so that no tag has to walk over them."""

    def __init__(self):
        self.open: list[Element] = []
        self.places: dict[str, list[int]] = {}

    def top(self) -> Element | None:
        return self.open[-1] if self.open else None

    def last(self, name: str) -> int:
        return (self.places.get(name) or [-1])[-1]

    def push(self, name: str, names: tuple[str, ...]) -> None:
        self.places.setdefault(name, []).append(len(self.open))
        self.open.append(Element(self.top(), name, names))

    def cut(self, at: int) -> None:
        while len(self.open) > at:
            self.places[self.open.pop().tag].pop()


def blocks_of(page: str | None) -> list[Block]:
    out: list[Block] = []
    if not page:
        return out
    stack = Stack()
    pieces: list[str] = []
    linked = total = at = 0

    def close() -> None:
        nonlocal pieces, linked, total
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split()) if len(pieces) == 1 else " ".join("".join(map(html.unescape, pieces)).split())
            if text:
                out.append(Block(stack.top(), text, linked / max(1, total)))
        pieces, linked, total = [], 0, 0

    marks, seek = Marks(page), 0
    while m := START.search(page, seek):
        if m[0] == "<!--":
            close_at = page.find("-->", m.end())
            end = len(page) if close_at < 0 else close_at + 3
        elif m.start() > marks.last:  # no tag ends behind here; a comment may still begin
            seek = m.end()
            continue
        else:
            end = 1 + (page.find(">", m.end()) if m[0] in ("<!", "<?") else marks.tag_end(m.end()))
        if m.start() > at:
            pieces.append(page[at : m.start()])
            total += m.start() - at
            linked += m.start() - at if stack.open and stack.open[-1].links else 0
        seek = at = end
        rest, name = page[m.end() : end - 1], m["name"]
        if not name:
            if m["raw"]:
                seek = at = _raw_end(page, m["raw"].lower(), rest, end, marks)
                if m["raw"].lower() == "head":  # other elements without text may stand inside a block
                    close()
            continue
        name = name.lower()
        if name == "br":
            pieces.append("\n")
            continue
        if name in BLOCKS:
            close()
        if m["end"]:
            k = stack.last(name)
            if k >= 0 and (name in (*BARRIERS, "html", "div") or k >= max(map(stack.last, BARRIERS))):
                stack.cut(k)
        elif name not in VOID:
            if name in BLOCKS and (open_p := stack.last("p")) >= 0:
                stack.cut(open_p)
            if name in ("li", "option", "dt", "dd", "tr", "td", "th") and stack.open and stack.open[-1].tag == name:
                stack.cut(len(stack.open) - 1)
            if not rest.endswith("/"):
                stack.push(name, _names(name, rest))
    if at < len(page):
        pieces.append(page[at:])
    close()
    return out


def markup_label(found: Block) -> int:
    return int(found.element is not None and found.element.main and not found.element.other)


_PLACE: dict[str, tuple[int, float]] = {}


def _place(name: str, size: int) -> tuple[int, float]:
    key = f"{size} {name}"
    if key not in _PLACE:
        if len(_PLACE) > 400_000:
            _PLACE.clear()
        h = zlib.crc32(key.encode("utf-8", "surrogatepass"))
        _PLACE[key] = ((h >> 1) % size, 1.0 if h & 1 else -1.0)
    return _PLACE[key]


def features(blocks: list[Block]) -> np.ndarray:
    """One row of INPUT numbers for each block."""
    out = np.zeros((len(blocks), INPUT), np.float32)
    for i, b in enumerate(blocks):
        row = out[i]
        last = b.element.names if b.element else ()
        before = b.element.inside.names[-1:] if b.element and b.element.inside and len(last) < 2 else ()
        if b.element:
            row[:PATH] = b.element.vector
        words = b.text.lower().split()
        places = [_place(w, WORDS) for w in words]
        row[PATH : PATH + WORDS] = np.bincount([k for k, _ in places], [s for _, s in places], WORDS) / max(1.0, len(words) ** 0.5) / 4
        row[PATH + WORDS :] = (
            np.log1p(len(words)) / 4,
            np.log1p(len(b.text)) / 6,
            b.links,
            sum(map(b.text.count, ".!?")) / max(1, len(words)),
            i / len(blocks),
            float(bool({"h1", "h2", "h3", "h4"} & set(last[-1:]))),
            float("p" in (*before, *last[-2:])),
            np.log1p(len(blocks)) / 6,
        )
    return out


class Labeller:
    """A bidirectional LSTM with a logistic output, trained by back-propagation through time with Adam."""

    def __init__(self, seed: int = 3):
        random = np.random.default_rng(seed)
        self.p = {}
        for side in "fb":
            self.p["w" + side] = (random.normal(size=(INPUT + HIDDEN, 4 * HIDDEN)) / np.sqrt(INPUT + HIDDEN)).astype(np.float32)
            self.p["c" + side] = np.zeros(4 * HIDDEN, np.float32)
            self.p["c" + side][HIDDEN : 2 * HIDDEN] = 1
        self.p["o"] = (random.normal(size=2 * HIDDEN) / np.sqrt(2 * HIDDEN)).astype(np.float32)
        self.p["d"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, there: np.ndarray, side: str, keep: bool = False, carried: tuple | None = None):
        """x: time, page, input. there: time, page. Padding leaves the state as it is; ``carried`` is where another stretch ended."""
        w, c = self.p["w" + side], self.p["c" + side]
        given = x @ w[:INPUT] + c
        state, memory = carried or (np.zeros((x.shape[1], HIDDEN), np.float32),) * 2
        out, trace = np.empty((*x.shape[:2], HIDDEN), np.float32), []
        for t in range(len(x)) if side == "f" else range(len(x) - 1, -1, -1):
            z = given[t] + state @ w[INPUT:]
            z[:, : 3 * HIDDEN] = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
            z[:, 3 * HIDDEN :] = np.tanh(z[:, 3 * HIDDEN :])
            i, f, o, g = (z[:, k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
            m = there[t][:, None]
            new = np.where(m, f * memory + i * g, memory)
            squashed = np.tanh(new)
            if keep:
                trace.append((t, z, state, memory, squashed))
            memory, state = new, np.where(m, o * squashed, state)
            out[t] = state
        return out, trace, (state, memory)

    def logits(self, x: np.ndarray, there: np.ndarray) -> np.ndarray:
        forward, backward = self._run(x, there, "f")[0], self._run(x, there, "b")[0]
        return forward @ self.p["o"][:HIDDEN] + backward @ self.p["o"][HIDDEN:] + self.p["d"][0]

    def scores(self, pages: list[np.ndarray]) -> np.ndarray:
        """time, page. Long pages run in stretches of at most CELLS blocks, each from the state in which the one before ended."""
        longest = max(map(len, pages))
        z = np.full((longest, len(pages)), self.p["d"][0], np.float32)
        stretches = list(slices(longest, max(1, CELLS // len(pages))))
        for k, side in enumerate("fb"):
            weight, carried = self.p["o"][k * HIDDEN : (k + 1) * HIDDEN], None
            for part in stretches if side == "f" else stretches[::-1]:
                out, _, carried = self._run(*padded([p[part] for p in pages]), side, carried=carried)
                z[part] += out @ weight
        return z

    def _gradients(self, x: np.ndarray, y: np.ndarray, there: np.ndarray) -> dict[str, np.ndarray]:
        runs = {s: self._run(x, there, s, keep=True) for s in "fb"}
        z = runs["f"][0] @ self.p["o"][:HIDDEN] + runs["b"][0] @ self.p["o"][HIDDEN:] + self.p["d"][0]
        error = np.where(there, 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y, 0).astype(np.float32) / there.sum()
        grads = {"o": np.concatenate([np.einsum("tp,tph->h", error, runs[s][0]) for s in "fb"]), "d": np.array([error.sum()], np.float32)}
        for k, side in enumerate("fb"):
            w = self.p["w" + side]
            outer = error[:, :, None] * self.p["o"][k * HIDDEN : (k + 1) * HIDDEN]
            dw, dc = np.zeros_like(w), np.zeros_like(self.p["c" + side])
            dstate = np.zeros((x.shape[1], HIDDEN), np.float32)
            dmemory = np.zeros_like(dstate)
            for t, z, state, memory, squashed in reversed(runs[side][1]):
                i, f, o, g = (z[:, j * HIDDEN : (j + 1) * HIDDEN] for j in range(4))
                m = there[t][:, None]
                dh = dstate + outer[t]
                dm = dmemory + np.where(m, dh * o * (1 - squashed**2), 0)
                dz = np.concatenate([dm * g * i * (1 - i), dm * memory * f * (1 - f), dh * squashed * o * (1 - o), dm * i * (1 - g**2)], 1) * m
                dw[:INPUT] += x[t].T @ dz
                dw[INPUT:] += state.T @ dz
                dc += dz.sum(0)
                dstate = dz @ w[INPUT:].T + np.where(m, 0, dh)
                dmemory = np.where(m, dm * f, dm)
            grads["w" + side], grads["c" + side] = dw, dc
        return grads

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 14, rate: float = 0.01, seed: int = 4) -> Labeller:
        random = np.random.default_rng(seed)
        first, second, step = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        pages = sorted((p for p in pages if len(p[0])), key=lambda p: len(p[0]))
        groups = [pages[s] for s in slices(len(pages), 32)]
        for epoch in range(epochs):
            for k in random.permutation(len(groups)):
                x, there = padded([p[0] for p in groups[k]])
                y = np.zeros(there.shape, np.float32)
                for j, (_, label) in enumerate(groups[k]):
                    y[: len(label), j] = label
                grads, step = self._gradients(x, y, there), step + 1
                norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
                for name, g in grads.items():
                    g = g * min(1.0, 1 / max(norm, 1e-9))
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.999 * second[name] + 0.001 * g**2
                    now = rate * (1 - epoch / epochs) + 0.001
                    self.p[name] = (self.p[name] - now * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def labels(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Whether each block is main text. Pages of like length run together, at most CELLS blocks with their padding."""
        out: list[np.ndarray] = [np.empty(0, bool)] * len(pages)
        groups: list[list[int]] = []
        for i in sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i])):
            if not groups or len(pages[i]) * (len(groups[-1]) + 1) > CELLS:
                groups.append([])
            groups[-1].append(i)
        for some in groups:
            z = self.scores([pages[i] for i in some])
            for j, i in enumerate(some):
                out[i] = z[: len(pages[i]), j] > 0
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, pages))
    x, there = np.zeros((longest, len(pages), INPUT), np.float32), np.zeros((longest, len(pages)), bool)
    for j, p in enumerate(pages):
        x[: len(p), j], there[: len(p), j] = p, True
    return x, there


ROOTS = [("article",), ("main",), ("main", "article"), ("div", ".content"), ("div", ".post"), ("div", ".entry", ".content"), ("div", ".main"), ("section",), ("div", "section", ".article", ".body"), ("div", ".story"), ("div",), ("table", "tr", "td")]
LEAVES = [("ul", "li"), ("ol", "li"), ("blockquote", "p"), ("h2",), ("h3",), ("pre",), ("table", "tr", "td"), ("figure", "figcaption"), ("div",), ("section", "p")]
BEFORE = [("nav", "ul", "li", "a"), ("header", "div"), ("header", "p"), ("div", ".ad"), ("div", ".cookie", ".notice", "p"), ("div", ".menu", "a"), ("div", ".banner"), ("ul", ".breadcrumb", "li", "a"), ("div", ".header", "h1"), ("form", "label")]
AFTER = [
    ("section", ".comments", "div", ".comment", "p"),
    ("div", ".comments", "li", "p"),
    ("div", ".comment", "p"),
    ("aside", ".sidebar", "ul", "li", "a"),
    ("aside", "p"),
    ("div", ".sidebar", "p"),
    ("footer",),
    ("footer", "p"),
    ("div", ".footer", "p"),
    ("form", "label"),
    ("form", "button"),
    ("div", ".related", "li", "a"),
    ("div", ".newsletter", "p"),
    ("div", ".share", "a"),
    ("div", ".advert", "p"),
]
#: What stands around the main text where a page is laid out by a table.
CELLS_BEFORE = [("table", "tr", "td", ".menu", "a"), ("table", "tr", "td", ".header"), ("table", "tr", "td", ".sidebar", "li", "a"), ("table", "tr", "td", ".ad")]
CELLS_AFTER = [("table", "tr", "td", ".footer"), ("table", "tr", "td", ".footer", "p"), ("table", "tr", "td", ".sidebar", "a"), ("table", "tr", "td", ".related", "a")]
#: What stands inside the element of the main text without belonging to it: in front, and behind.
HEAD_OF_ROOT = [("div", ".notice", "p"), ("ul", ".breadcrumb", "li", "a"), ("nav", "li", "a"), ("div", ".share", "a"), ("div", ".ad")]
INSIDE = 0.3  # share of the variants that have such a tail
TAIL_OF_ROOT = [
    [("section", ".comments", "h2"), ("section", ".comments", "div", ".comment", "p")],
    [("div", ".comments", "h3"), ("div", ".comments", "div", ".comment", "p")],
    [("div", ".comments", "ul", "li", "p")],
    [("section", ".comments", "article", ".comment", "p")],
    [("div", ".comments", "article", ".comment", "p")],
    [("section", ".comments", "h2"), ("section", ".comments", "ol", "li", "article", ".comment", "p")],
    [("article", ".comment", "p")],
    [("section", ".comments", "h2"), ("section", ".comments", "form", "label"), ("section", ".comments", "form", "button")],
    [("div", ".related", "h3"), ("div", ".related", "li", "a")],
    [("div", ".newsletter", "p"), ("form", "button")],
    [("footer", "p"), ("div", ".share", "a")],
]


def variant(blocks: list[Block], others: list[str], random: np.random.Generator) -> tuple[list[Block], list[int]]:
    """The main text of a page in other containers, with other blocks around and inside it."""
    root = ROOTS[random.integers(len(ROOTS))]
    main = [b for b in blocks if markup_label(b)]

    def other(path: tuple[str, ...], inside: tuple[str, ...] = (), most: int = 60) -> Block:
        words = others[random.integers(len(others))].split() if others else ["x"]
        link = path[-1] == "a"
        size = most if most < 60 else random.integers(1, 4) if link or path[-1] in ("label", "button") else random.integers(3, 60)
        return block(("html", "body", *inside, *path), " ".join(words[:size]), 1.0 if link else 0.0)

    def some(paths: list, most: int) -> list[Block]:
        out = []
        for _ in range(random.integers(0, most + 1)):
            path = paths[random.integers(len(paths))]
            out.extend(other(path) for _ in range(random.integers(1, 6)))
        return out

    table = root[0] == "table"
    made, labels = some(CELLS_BEFORE if table else BEFORE, 3), []
    if random.random() < 0.15:
        path = HEAD_OF_ROOT[random.integers(len(HEAD_OF_ROOT))]
        made.extend(other(path, root) for _ in range(random.integers(1, 4)))
    labels = [0] * len(made)
    for b in main:
        if random.random() < 0.06:
            made.append(other((("div", ".ad"), ("aside", "p"), ("div", ".advert", "p"), ("div", ".promo"))[random.integers(4)], root))
            labels.append(0)
        path = b.path
        leaf = path[max((i for i, n in enumerate(path) if n in MAIN), default=-1) + 1 :] or ("p",)
        text = b.text
        if random.random() < 0.2:
            leaf = LEAVES[random.integers(len(LEAVES))]
        if random.random() < 0.3:
            text = " ".join(text.split()[: random.integers(2, 14)])
        made.append(block(("html", "body", *root, *leaf), text, b.links))
        labels.append(1)
    tail = []
    if random.random() < INSIDE:
        first, *rest = TAIL_OF_ROOT[random.integers(len(TAIL_OF_ROOT))]
        tail.append(other(first, root, random.integers(1, 4) if rest else 60))
        tail.extend(other(path, root) for path in rest or [first] for _ in range(random.integers(1, 8)))
    tail += some(CELLS_AFTER if table else AFTER, 4)
    return made + tail, labels + [0] * len(tail)


def train(pages: list[str | None], variants: int = 8, longest: int = 150, seed: int = 9) -> Labeller:
    random = np.random.default_rng(seed)
    read = [b for b in map(blocks_of, pages) if b]
    others = [b.text for page in read for b in page]
    rows = []

    def add(page: list[Block], labels: list[int]) -> None:
        x, y = features(page), np.array(labels, np.float32)
        rows.extend((x[part], y[part]) for part in slices(len(page), longest))

    for page in read:
        if any(labels := [markup_label(b) for b in page]):  # without marks, a page doesn't tell what is main text
            add(page, labels)
            for _ in range(variants):
                add(*variant(page, others, random))
    return Labeller().fit(rows) if rows else Labeller()


def main_texts(pages: list[str | None], labeller: Labeller) -> list[str]:
    read = [blocks_of(p) for p in pages]
    kept = labeller.labels([features(b) for b in read])
    return ["\n\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k) for blocks, keep in zip(read, kept, strict=True)]


@tidy
def _texts(batches: Iterator[pa.RecordBatch], labeller: Labeller) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in by_size(batch.column("html"), 1 << 20):
            rows = batch.slice(part.start, part.stop - part.start)
            texts = main_texts(rows.column("html").to_pylist(), labeller)
            yield pa.RecordBatch.from_arrays([rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, labeller: Labeller | None = None, sample: int = 200, most: int = 1 << 20) -> DataFrame:
    """page_id, url, text, n_chars of every page; without a labeller, one is trained on the pages' own markup."""
    rows = pages.select("page_id", "url", "html")
    if labeller is None:
        there = rows.where("html IS NOT NULL AND page_id IS NOT NULL").where(F.length("html") <= most)
        chosen = there.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
        some = there.join(F.broadcast(chosen), "page_id", "left_semi").dropDuplicates(["page_id"]).select("page_id", "html")  # ``sample`` pages
        labeller = train([r.html for r in sorted(some.collect(), key=lambda r: r.page_id)])
    kind, url = (rows.schema[c].dataType.simpleString() for c in ("page_id", "url"))
    return rows.mapInArrow(lambda b: _texts(b, labeller), f"page_id {kind}, url {url}, text string, n_chars long")


def op2_html_extraction(spark, sf_dir) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
