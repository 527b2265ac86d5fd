"""Main text of web pages by a recurrent block labeller.

A page is cut at its tags into leaf blocks, each with the path of open elements (names
and the words of their class and id) and its decoded text.  A bidirectional LSTM in
numpy reads the blocks of a whole page in order, as hashed path tokens, hashed words
and a few shares, and gives each block the probability of being main text.  Blocks are
labelled by the network alone; the rules below only make its training labels.

Training uses the blocks of at most ``TRAIN_PAGES`` pages, the first by a hash of their
id, of at most ``TRAIN_CHARS`` characters each.  Elements whose meaning HTML itself fixes
give weak labels.  Each page is then laid out anew several times under other containers
with borrowed furniture, so that path words, position and neighbours are what counts,
not one site's template.

Results by case: null html is empty and gives an empty text; text outside any tag is a
block; unclosed and unmatched tags close as in browsers; scripts, styles, comments and
hidden elements never become blocks; attributes and comments end as in browsers, and a
tag that the page's end cuts off is no text; a page of any length is read whole, one block after
another; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.llm.common import checked, text_of

TRAIN_PAGES = 200
TRAIN_CHARS = 30_000
LAYOUTS = 5
STEPS = 60
PATH_DIM, WORD_DIM, HIDDEN = 96, 16, 16
BATCH = 96

# Elements by their role in HTML.
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr br".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = set("script style template noscript textarea svg math iframe object select option title head datalist".split())
# Words in names, classes and ids of page furniture, by kind.
FURNITURE = {
    "menu": "nav menu navbar navigation breadcrumb breadcrumbs tabs toolbar pagination pager skip".split(),
    "header": "header masthead topbar banner branding logo".split(),
    "footer": "footer copyright legal colophon bottom".split(),
    "side": "aside sidebar side rail widget related recommended popular trending tags archive".split(),
    "notice": "cookie cookies consent notice alert popup modal overlay gdpr subscribe newsletter paywall".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion adsense".split(),
    "form": "form search login signup contact input button label fieldset".split(),
    "comments": "comment comments reply replies respond discussion disqus".split(),
    "share": "share social sharing follow".split(),
}
BODIES = "article main content post entry body story text page".split()

_ELEMENTS = [
    ("<h1>",), ("<h2>",), ("<h3>",), ("<ul>", "<li>"), ("<ol>", "<li>"), ("<blockquote>", "<p>"), ("<div>",),
    ("<table>", "<tr>", "<td>"), ("<pre>",), ("<section>", "<p>"), ("<p>",), ("<header>", "<h1>"), ("<figure>", "<figcaption>"),
    (),
]

# Attributes: a quote opens a value only behind "=", and an open value ends with the page.
_KEY = r"[^\t\n\f\r />][^\t\n\f\r />=]*+"
_IS = r"[\t\n\f\r ]*+=[\t\n\f\r ]*+"
_PAIRS = rf"""(?:[\t\n\f\r /]++|{_KEY}(?:{_IS}(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\t\n\f\r >]++)?+)?+)*+"""
_ATTRIBUTE = re.compile(rf"""({_KEY})(?:{_IS}(?:"([^"]*+)"?|'([^']*+)'?|([^\t\n\f\r >]++))?+)?+""")
# Comments end at once too, or with a mark; tags and comments also end with the page.
_TAG = re.compile(
    rf"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</(?:>|[^a-zA-Z>][^>]*+(?:>|\Z))"""
    rf"""|<(/?)([a-zA-Z][^\t\n\f\r />]*+)({_PAIRS})(?:>|\Z)""",
    re.S,
)
_MAY_HIDE = re.compile(r"hidden|style", re.I)
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\s*(?:!\s*important\s*)?(?:;|$)", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_P_ENDS = set(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hgroup hr li listing main menu nav ol p pre search section summary table ul".split()
)
# Elements whose content is plain characters up to their end tag, or the page's end.
_RAW = set("script style textarea title noscript iframe".split())
# What does not end a head whose end tag is left out.
_IN_HEAD = set("base link meta template head html".split()) | _RAW
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# An element ends those open in its container: the names it ends, and what bounds the search.
_LISTS, _ROWS = {"ul", "ol", "menu"}, {"table"}
_SIBLINGS = {
    "li": ({"li"}, _LISTS), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, _ROWS | {"tr"}), "th": ({"td", "th"}, _ROWS | {"tr"}), "tr": ({"tr"}, _ROWS),
    "option": ({"option"}, {"select", "datalist", "optgroup"}), "optgroup": ({"optgroup", "option"}, {"select"}),
    **{n: ({"thead", "tbody", "tfoot", "caption", "colgroup"}, _ROWS) for n in ("thead", "tbody", "tfoot", "colgroup")},
}
# Pictures and formulas end where one of these begins.
_FOREIGN = {"svg", "math"}
_BREAKOUT = set(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr "
    "ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: float


def _attributes(text: str) -> dict[str, str]:
    """Values by name; the first of a name counts."""
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), double or single or bare)
    return found


def _tokens(name: str, attributes: str) -> tuple[str, ...]:
    out = [f"<{name}>"]
    if "=" in attributes:
        for kind, value in _attributes(attributes).items():
            if kind in ("class", "id", "role"):
                out += [w.lower() for w in _NAME.findall(value)]
    return tuple(out)


def _hides(attributes: str) -> bool:
    """Whether an element's own attributes hide it."""
    if not _MAY_HIDE.search(attributes):
        return False
    found = _attributes(attributes)
    return "hidden" in found or bool(_NO_DISPLAY.search(html.unescape(found.get("style", ""))))


@cache
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\t\n\f\r />]){_PAIRS}>", re.I)


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order; white space inside each is one blank.

    Elements that are never seen lie on the stack like others, so that what ends an element
    without end tag (the next of its kind, its parent's end, the body) ends them too.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], bool]] = []
    parts: list[str] = []
    linked = 0
    links = 0
    unseen = 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                path = tuple(t for name, tokens, _ in stack if name not in INLINE for t in tokens)
                out.append(Block(path, text, min(1.0, linked / len(text))))
        parts, linked = [], 0

    def cut(k: int) -> None:
        nonlocal links, unseen
        links -= sum(1 for n, _, _ in stack[k:] if n == "a")
        unseen -= sum(1 for _, _, hides in stack[k:] if hides)
        del stack[k:]

    def last(names: set[str], bounds: set[str]) -> int:
        """The innermost of the names inside the innermost bound, or -1."""
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                return k
            if stack[k][0] in bounds:
                break
        return -1

    def close(names: set[str], bounds: set[str] = frozenset()) -> None:
        k = last(names, bounds)
        if k >= 0:
            cut(k)

    at = 0
    while at < len(page):
        tag = _TAG.search(page, at)
        piece = page[at : tag.start()] if tag else page[at:]
        if unseen and stack[-1][0] == "head" and piece.strip():
            cut(len(stack) - 1)
        if piece and not unseen:
            parts.append(piece)
            linked += len(piece) if links else 0
        if not tag:
            break
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if not tag[1] and unseen:
            if stack[-1][0] == "head" and name not in _IN_HEAD:
                cut(len(stack) - 1)
            elif name in _BREAKOUT:
                k = last(_FOREIGN, {"foreignobject", "desc"})
                if k >= 0:
                    cut(k)
        if name in INLINE:
            if name == "br" or name == "wbr":
                parts.append(" ")
            elif tag[1]:
                close({name})
            elif name not in VOID:
                stack.append((name, (), False))
                links += name == "a"
            continue
        flush()
        if tag[1]:
            close({name})
            continue
        # Only pictures and formulas have elements that end at once.
        foreign = name in _FOREIGN or (unseen and last(_FOREIGN, {"foreignobject", "desc"}) >= 0)
        if foreign and tag[3].endswith("/"):
            continue
        if name in _RAW:
            end = _raw_end(name).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in _P_ENDS:
            close({"p"}, {"td", "th", "caption", "button", "table", "object", "template"})
            if name in _HEADINGS and stack and stack[-1][0] in _HEADINGS:
                cut(len(stack) - 1)
        if name in _SIBLINGS:
            close(*_SIBLINGS[name])
        if name not in VOID:
            hides = name in UNSEEN or _hides(tag[3])
            stack.append((name, _tokens(name, tag[3]), hides))
            unseen += hides
    flush()
    return out


_HASHES: dict[str, int] = {}


def _hash(word: str) -> int:
    got = _HASHES.get(word)
    if got is None:
        if len(_HASHES) > 200_000:
            _HASHES.clear()
        got = _HASHES[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
    return got


def features(page: list[Block]) -> np.ndarray:
    """One row for each block: path tokens, words, shares, place."""
    n = len(page)
    out = np.zeros((n, PATH_DIM + WORD_DIM + 8), np.float32)
    paths: dict[tuple, np.ndarray] = {}
    for k, block in enumerate(page):
        row = paths.get(block.path)
        if row is None:
            row = np.zeros(PATH_DIM, np.float32)
            for token in block.path:
                h = _hash(token)
                row[h % PATH_DIM] += 1.0 if h & 0x10000 else -1.0
            paths[block.path] = row
        out[k, :PATH_DIM] = np.clip(row, -2, 2)
        words = block.text.split()
        counts = np.bincount([_hash(w) % WORD_DIM for w in words], minlength=WORD_DIM)
        out[k, PATH_DIM : PATH_DIM + WORD_DIM] = counts / len(words)
        size = len(block.text)
        out[k, PATH_DIM + WORD_DIM :] = (
            np.log1p(size) / 6,
            np.log1p(len(words)) / 4,
            block.linked,
            sum(map(block.text.count, ".,;:!?")) / len(words),
            block.text[-1:] in ".!?…:;\"»",
            (k + 0.5) / n,
            k < 3,
            n - k <= 3,
        )
    return out


def weak_label(path: tuple[str, ...]) -> bool | None:
    """What HTML's own elements say: main text, furniture, or nothing."""
    names = {t[1:-1] for t in path if t[0] == "<"}
    words = {t for t in path if t[0] != "<"}
    if names & {"nav", "footer", "aside", "form", "button"} or words & {w for v in FURNITURE.values() for w in v}:
        return False
    if names & {"article", "main"}:
        return True
    return False if "header" in names else None


def _layouts(page: list[Block], labels: list[bool], pool: list[str], rng: np.random.Generator, n: int):
    """The page's main blocks under other containers, among borrowed furniture."""
    main = [b for b, good in zip(page, labels, strict=True) if good]
    for _ in range(n):
        name = str(rng.choice(BODIES))
        kind = rng.integers(5)
        body = (
            ("<article>",) if kind == 0 else
            ("<main>",) if kind == 1 else
            ("<div>", name) if kind == 2 else
            ("<main>", "<div>", name) if kind == 3 else
            ("<section>", name, str(rng.choice(BODIES)))
        )
        top = ("<html>", "<body>", *(("<div>", str(rng.choice(["wrapper", "container", "page", "site"]))) * int(rng.integers(2))))

        def furniture(kind: str) -> list[tuple[Block, bool]]:
            word = str(rng.choice(FURNITURE[kind]))
            holder = {
                "menu": ("<nav>",), "header": ("<header>",), "footer": ("<footer>",), "side": ("<aside>",),
                "form": ("<form>",),
            }.get(kind, ("<div>", word))
            if rng.random() < 0.5:
                holder = ("<div>", word) if rng.random() < 0.7 else ("<section>", word)
            if rng.random() < 0.3:
                holder = (*holder, word)
            inner = {"menu": ("<ul>", "<li>"), "form": ("<label>",)}.get(kind, ("<p>",))
            if rng.random() < 0.3:
                inner = (str(rng.choice(["<div>", "<li>", "<span>", "<h3>", "<p>", "<ul>"])),)
            where = (*top, *(body if rng.random() < 0.2 and kind != "header" else ()), *holder, *inner)
            out = []
            for _ in range(int(rng.integers(1, 7 if kind in ("menu", "comments", "side") else 4))):
                text = str(pool[int(rng.integers(len(pool)))])
                words = text.split()
                short = kind in ("menu", "share", "form") or rng.random() < 0.3
                size = int(rng.integers(1, 5 if short else 60))
                first = int(rng.integers(max(1, len(words) - size)))
                linked = 1.0 if kind in ("menu", "share") else float(rng.random() < 0.2)
                out.append((Block(where, " ".join(words[first : first + size]), linked), False))
            return out

        inner = [(Block((*top, *body, *_inside(b.path, rng)), _some(b.text, rng), b.linked), True) for b in main]
        for kind in ("advert", "share", "side", "notice"):
            if inner and rng.random() < 0.25:
                at = int(rng.integers(len(inner) + 1))
                inner[at:at] = furniture(kind)
        before = [x for k in rng.permutation(["menu", "header", "notice", "advert", "form", "side"]) if rng.random() < 0.5 for x in furniture(str(k))]
        after = [x for k in rng.permutation(["comments", "side", "form", "advert", "share", "notice", "menu"]) if rng.random() < 0.4 for x in furniture(str(k))]
        if rng.random() < 0.8:
            after += furniture("footer")
        rows = before + inner + after
        yield [b for b, _ in rows], [good for _, good in rows]


def _inside(path: tuple[str, ...], rng: np.random.Generator) -> tuple[str, ...]:
    """What lies below the main container, or another element that main text may have."""
    if rng.random() < 0.35:
        return _ELEMENTS[int(rng.integers(len(_ELEMENTS)))]
    at = max((k for k, t in enumerate(path) if t in ("<article>", "<main>")), default=-1)
    return path[at + 1 :]


def _some(text: str, rng: np.random.Generator) -> str:
    """The text, or a few words of it: main text has short blocks too."""
    words = text.split()
    if rng.random() < 0.7:
        return text
    first, size = int(rng.integers(len(words))), int(rng.integers(1, 15))
    return " ".join(words[first : first + size])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Lstm:
    """One direction: weights, forward pass, backward pass through time."""

    def __init__(self, w: np.ndarray, b: np.ndarray):
        self.w, self.b = w, b

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        """x: time x batch x inputs; mask: time x batch, 0 past a page's end."""
        t, n, d = x.shape
        h = c = np.zeros((n, HIDDEN), np.float32)
        out, saved = np.zeros((t, n, HIDDEN), np.float32), []
        from_x = x.reshape(t * n, d) @ self.w[:d] + self.b
        from_x = from_x.reshape(t, n, -1)
        for k in range(t):
            z = from_x[k] + h @ self.w[d:]
            i, f, o = (_sigmoid(z[:, j * HIDDEN : (j + 1) * HIDDEN]) for j in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[k][:, None]
            c_new = m * (f * c + i * g) + (1 - m) * c
            s = np.tanh(c_new)
            h_new = m * (o * s) + (1 - m) * h
            if keep:
                saved.append((i, f, o, g, c, h, s))
            h, c = h_new, c_new
            out[k] = h
        return out, saved

    def backward(self, x: np.ndarray, mask: np.ndarray, saved: list, grad: np.ndarray):
        t, n, d = x.shape
        dw, db = np.zeros_like(self.w), np.zeros_like(self.b)
        dh = dc = np.zeros((n, HIDDEN), np.float32)
        for k in range(t - 1, -1, -1):
            i, f, o, g, c, h, s = saved[k]
            m = mask[k][:, None]
            dh = dh + grad[k]
            own = m * dh
            ds = own * o * (1 - s * s) + m * dc
            dz = np.hstack([ds * g * i * (1 - i), ds * c * f * (1 - f), own * s * o * (1 - o), ds * i * (1 - g * g)])
            dw[:d] += x[k].T @ dz
            dw[d:] += h.T @ dz
            db += dz.sum(axis=0)
            dh = (1 - m) * dh + dz @ self.w[d:].T
            dc = ds * f + (1 - m) * dc
        return dw, db


@dataclass
class Labeller:
    """Parameters of both directions and of the output."""

    parts: list[np.ndarray]

    def probabilities(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        x, mask = padded(pages)
        wf, bf, wb, bb, wo, bo = self.parts
        ahead, _ = Lstm(wf, bf).forward(x, mask)
        back, _ = Lstm(wb, bb).forward(x[::-1], mask[::-1])
        p = _sigmoid(np.concatenate([ahead, back[::-1]], axis=2) @ wo + bo)[..., 0]
        return [p[: len(f), k] for k, f in enumerate(pages)]


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, pages))
    x = np.zeros((longest, len(pages), PATH_DIM + WORD_DIM + 8), np.float32)
    mask = np.zeros((longest, len(pages)), np.float32)
    for k, f in enumerate(pages):
        x[: len(f), k] = f
        mask[: len(f), k] = 1
    return x, mask


def fit(pages: list[np.ndarray], labels: list[np.ndarray], rounds: int = 450, seed: int = 5) -> Labeller:
    """Adam on the mean cross-entropy of the blocks."""
    rng = np.random.default_rng(seed)
    d = PATH_DIM + WORD_DIM + 8
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    bias = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)
    parts = [draw(d + HIDDEN, 4 * HIDDEN), bias, draw(d + HIDDEN, 4 * HIDDEN), bias.copy(), draw(2 * HIDDEN, 1), np.zeros(1, np.float32)]
    one, two = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for step in range(1, rounds + 1):
        pick = rng.integers(len(pages), size=24)
        x, mask = padded([pages[k] for k in pick])
        y = np.zeros_like(mask)
        for j, k in enumerate(pick):
            y[: len(labels[k]), j] = labels[k]
        ahead_net, back_net = Lstm(*parts[:2]), Lstm(*parts[2:4])
        ahead, saved_a = ahead_net.forward(x, mask, keep=True)
        back, saved_b = back_net.forward(x[::-1], mask[::-1], keep=True)
        both = np.concatenate([ahead, back[::-1]], axis=2)
        p = _sigmoid(both @ parts[4] + parts[5])[..., 0]
        gap = (mask * (p - y) / mask.sum())[..., None]
        grad = gap * parts[4][:, 0]
        grads = [
            *ahead_net.backward(x, mask, saved_a, grad[..., :HIDDEN]),
            *back_net.backward(x[::-1], mask[::-1], saved_b, grad[::-1, :, HIDDEN:]),
            np.einsum("tnh,tnk->hk", both, gap),
            gap.sum(axis=(0, 1)),
        ]
        size = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.02 * (1 - 0.8 * step / rounds)
        for k, g in enumerate(grads):
            g = g / max(1.0, size)
            one[k] = 0.9 * one[k] + 0.1 * g
            two[k] = 0.99 * two[k] + 0.01 * g * g
            parts[k] = parts[k] - rate * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.99**step)) + 1e-7)
    return Labeller([p.astype(np.float32) for p in parts])


def training_set(pages: list[str], layouts: int = LAYOUTS, seed: int = 11):
    """Features and labels of the pages as they are and laid out anew."""
    rng = np.random.default_rng(seed)
    read = [[(b, weak_label(b.path)) for b in blocks(p)] for p in pages]
    pool = [b.text for page in read for b, _ in page] or ["text"]
    x, y = [], []
    for page in read:
        known = [(b, bool(good)) for b, good in page if good is not None]
        if not any(good for _, good in known):
            continue
        own, labels = [b for b, _ in known], [good for _, good in known]
        variants = [(own, labels), (own, labels), *_layouts(own, labels, pool, rng, layouts)]
        for some, good in variants:
            # At most STEPS blocks in a row, anywhere in the page.
            first = int(rng.integers(max(1, len(some) - STEPS)))
            x.append(features(some)[first : first + STEPS])
            y.append(np.array(good[first : first + STEPS], np.float32))
    return x, y


#: Stands in where a table has no page with a labelled main part: three plain pages.
_FALLBACK = [
    f"<body><nav><ul><li>menu {k}</li></ul></nav><article><h1>Title {k}</h1><p>A sentence of main text, number {k}.</p>"
    f"<p>Another one follows, and it is longer than the first.</p></article><footer>foot {k}</footer></body>"
    for k in range(3)
]


def train(pages: DataFrame, count: int = TRAIN_PAGES) -> Labeller:
    """A labeller from a bounded sample of pages."""
    rows = checked(pages, "page_id", "html").filter(F.char_length(text_of("html")).between(1, TRAIN_CHARS))
    # Ids first: each task offers the driver ``count`` numbers, not as many pages.
    chosen = rows.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(count)
    ids = [r["page_id"] for r in chosen.collect()]
    sample = rows.filter(F.col("page_id").isin(ids)).limit(2 * count).select("html").toPandas()["html"]
    x, y = training_set(sorted(sample))
    if not x:
        x, y = training_set(_FALLBACK)
    return fit(x, y)


def extract(pages: DataFrame, labeller: Labeller | None = None) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_main for every row."""
    labeller = labeller or train(pages)
    rows = checked(pages, "page_id", "url", "html").select("page_id", "url", text_of("html").alias("html"))

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            read = [blocks(p) for p in batch["html"]]
            texts, counts = [""] * len(read), [0] * len(read)
            # Pages of like length together, so that padding stays small.
            order = sorted((k for k in range(len(read)) if read[k]), key=lambda k: len(read[k]))
            at = 0
            while at < len(order):
                stop, total = at, 0
                while stop < len(order) and stop - at < BATCH and (stop == at or total < 20_000):
                    stop += 1
                    total = (stop - at) * len(read[order[stop - 1]])
                part = order[at:stop]
                for k, p in zip(part, labeller.probabilities([features(read[k]) for k in part]), strict=True):
                    main = [b.text for b, q in zip(read[k], p, strict=True) if q >= 0.5]
                    texts[k], counts[k] = "\n\n".join(main), len(main)
                at = stop
            yield pd.DataFrame(
                {
                    "page_id": batch["page_id"].astype("Int64"),
                    "url": batch["url"],
                    "text": texts,
                    "n_chars": [len(t) for t in texts],
                    "n_blocks": [len(r) for r in read],
                    "n_main": counts,
                }
            )

    return rows.mapInPandas(task, "page_id long, url string, text string, n_chars long, n_blocks long, n_main long")
