"""Main text of web pages: every leaf block of a page is kept or left out by a recurrent labeller trained here.

A page is cut into leaf blocks, runs of text between block-level tags. Each has a vector: hashed names of its tag path (tags, and
classes and ids on it), hashed words, and a few measures. A bidirectional LSTM in numpy reads a page's blocks in both directions, so each
decision sees the whole page, and a logistic layer decides. It is trained on a bounded sample of pages whose blocks are labelled by where
they stand (`taught`), and on variants of these pages with other containers and further kinds of boilerplate. Prediction covers every
block of every page; nothing is dropped for its length.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.rows import beside, spread, with_row

TRAIN_PAGES = 300
TRAIN_BYTES = 1 << 16  # a longer page is not trained on
TRAIN_BLOCKS = 64  # of a page in one training step
EPOCHS = 16
VARIANTS = 4
SEED = 5
PATH, WORDS, MEASURES, HIDDEN = 96, 48, 6, 16
BATCH = 64  # pages that go through the network at once, at most
SLOTS = 1 << 13  # blocks, with the padding of shorter pages, that do; a longer page goes through alone, in pieces of this size

# What the elements of a page are.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr"
                   " math annotation annotation-xml maction menclose merror mfenced mfrac mglyph mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms"
                   " mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head title script style noscript template textarea select option button svg iframe object canvas audio video".split())
IN_HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
RAW = frozenset("script style textarea title noscript template iframe".split())

MAIN = ("article", "main")
ASIDE = frozenset("nav header footer aside form menu dialog figure fieldset".split())
ASIDE_NAMES = ("ad", "ads", "advert", "advertisement", "banner", "sponsor", "promo", "sidebar", "side", "menu", "nav", "navigation", "breadcrumb", "header", "footer",
               "notice", "cookie", "consent", "popup", "modal", "newsletter", "subscribe", "share", "social", "related", "comment", "comments", "reply", "replies", "login", "search")
BODY_NAMES = ("content", "post", "entry", "story", "text", "body", "article", "main", "page")

# A tag ends at the first > that is not in a quoted value; a quote elsewhere is no more than a character. Whatever begins like a tag ends
# with the page at the latest, so no place is looked at again.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)(?:(>)|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
WORD = re.compile(r"[a-z0-9]+")

# Which open elements a start tag ends, and within which one they have to stand.
CELLS, ROWS, ROW_GROUPS = ("td", "th"), ("tr",), ("tbody", "thead", "tfoot", "caption", "colgroup")
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "table", *CELLS)),
    "dt": (("dt", "dd"), ("dl", "table", *CELLS)), "dd": (("dt", "dd"), ("dl", "table", *CELLS)),
    "option": (("option",), ("select", "datalist")), "optgroup": (("option", "optgroup"), ("select",)),
    "rt": (("rt", "rp"), ("ruby",)), "rp": (("rt", "rp"), ("ruby",)),
    **{tag: (CELLS, ("table",)) for tag in CELLS},
    "tr": ((*CELLS, *ROWS), ("table",)),
    **{tag: ((*CELLS, *ROWS, *ROW_GROUPS), ("table",)) for tag in ROW_GROUPS},
}


@dataclass(frozen=True, eq=False)
class Place:
    """An open element: its tag and names, the element around it, the nearest one that is no inline element, and the hashed names on the way."""

    names: tuple[str, ...]
    around: Place | None = field(repr=False)
    block: Place | None = field(repr=False)
    depth: int
    mask: int  # a bit per bucket of path names

    @classmethod
    def within(cls, around: Place | None, names: tuple[str, ...], inline: bool = False) -> Place:
        mask = around.mask if around else 0
        for name in names:
            mask |= 1 << _bucket(name, PATH)
        self = cls(names, around, around.block if inline and around else None, around.depth + 1 if around else 0, mask)
        if not inline:
            object.__setattr__(self, "block", self)
        return self

    @classmethod
    def of(cls, path: Iterable[str]) -> Place | None:
        place = None
        for name in path:
            place = cls.within(place, (name,))
        return place

    @property
    def path(self) -> tuple[str, ...]:
        found, place = [], self
        while place:
            found.append(place.names)
            place = place.around
        return tuple(name for names in reversed(found) for name in names)


@dataclass(eq=False)
class Block:
    place: Place | None
    text: str
    linked: int = 0  # characters inside links

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Block) and (self.path, self.text, self.linked) == (other.path, other.text, other.linked)

    @property
    def path(self) -> tuple[str, ...]:
        """Tags, and names as .name, from the page's root."""
        return self.place.path if self.place else ()


_NOWHERE = object()


@dataclass
class _Page:
    """Open elements are links from each to the one around it, and every tag knows where it is open, so a tag costs no more in a deep page."""

    blocks: list[Block] = field(default_factory=list)
    last: Place | None = None
    stack: list[Place] = field(default_factory=list)
    depths: dict[str, list[int]] = field(default_factory=dict)  # of the open elements of each tag
    parts: list[str] = field(default_factory=list)
    place: object = _NOWHERE  # where the block's text began
    linked: int = 0
    unseen: int = 0

    def leave_head(self) -> None:
        """An open head ends where something begins that cannot stand in it."""
        while self.depths.get("head"):
            self.close("head")

    def text(self, part: str) -> None:
        if part and not part.isspace():
            self.leave_head()
        if self.unseen or not part:
            return
        if self.place is _NOWHERE and not part.isspace():
            self.place = self.last
        if self.depths.get("a"):
            self.linked += len(part)
        self.parts.append(part)

    def end(self) -> None:
        if self.place is not _NOWHERE:
            whole = " ".join(unescape("".join(self.parts)).split())
            if whole:
                self.blocks.append(Block(self.place, whole, self.linked))
        self.parts, self.place, self.linked = [], _NOWHERE, 0

    def close_from(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag = self.stack.pop().names[0]
            self.depths[tag].pop()
            self.unseen -= tag in UNSEEN
        self.last = self.stack[-1] if self.stack else None

    def close(self, tag: str) -> None:
        if self.depths.get(tag):
            self.close_from(self.depths[tag][-1])

    def deepest(self, tags: Iterable[str]) -> int:
        return max((self.depths[tag][-1] for tag in tags if self.depths.get(tag)), default=-1)

    def open(self, tag: str, attributes: str) -> None:
        if tag not in INLINE:
            holder = self.last.block if self.last else None
            if holder and holder.names[0] == "p":  # an open paragraph ends where a block begins
                self.close_from(holder.depth)
        if tag in ENDS:
            ended, inside = ENDS[tag]
            bound = self.deepest(inside)
            open_ = [self.depths[t][-1] for t in ended if self.depths.get(t) and self.depths[t][-1] > bound]
            if open_:
                self.close_from(min(open_))
        names = [f".{n}" for found in NAMES.findall(attributes) for n in WORD.findall(found.lower())] if attributes else []
        self.last = Place.within(self.last, (tag, *names), tag in INLINE)
        self.depths.setdefault(tag, []).append(len(self.stack))
        self.stack.append(self.last)
        self.unseen += tag in UNSEEN


def blocks(html: str) -> list[Block]:
    """The leaf blocks of a page in order. A tag that the page's end cuts off is no text; open elements end with the page, and a head
    before text or a tag that cannot stand in it. List items, terms, options and parts of tables end where the next one begins. Formulas are text of
    the block they stand in.
    """
    page, at = _Page(), 0
    while at < len(html):
        found = TAG.search(html, at)
        if not found:
            break
        page.text(html[at : found.start()])
        at, tag = found.end(), (found[2] or "").lower()
        if not tag or not found[4]:
            continue
        if tag not in IN_HEAD and not found[1]:
            page.leave_head()
        if tag == "br":
            page.text(" ")
        elif tag not in INLINE:
            page.end()
        if found[1]:
            page.close(tag)
        elif tag not in VOID and not found[3].endswith("/"):
            page.open(tag, found[3])
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}\b", re.I).search(html, at)
                at = close.start() if close else len(html)
    page.text(html[at:])
    page.end()
    return page.blocks


def _bucket(word: str, buckets: int) -> int:
    return zlib.crc32(word.encode()) % buckets


def vectors(page: list[Block], first: int = 0, last: int | None = None) -> np.ndarray:
    """A row per block, from the first to before the last one: path names, words (as shares) and measures."""
    own = page[first:last]
    out = np.zeros((len(own), PATH + WORDS + MEASURES), dtype=np.float32)
    if own:
        masks = b"".join((block.place.mask if block.place else 0).to_bytes(PATH // 8, "little") for block in own)
        out[:, :PATH] = np.unpackbits(np.frombuffer(masks, dtype=np.uint8).reshape(len(own), -1), axis=1, bitorder="little")
    for row, block in enumerate(own):
        i = first + row
        words = block.text.lower().split()
        counts = np.bincount([zlib.crc32(w.encode()) % WORDS for w in words], minlength=WORDS)
        out[row, PATH : PATH + WORDS] = counts / len(words)
        n = len(block.text)
        out[row, PATH + WORDS :] = (np.log1p(n) / 8, np.log1p(len(words)) / 6, min(1.0, block.linked / n), block.text[-1] in ".!?", i / len(page), 1 / (1 + i))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _steps(seen: np.ndarray, live: np.ndarray, weights: dict, side: str, trace: list | None = None, state: list | None = None) -> np.ndarray:
    """One direction of the network over (time, page, features). `state` holds what was before, and after it what came out."""
    inner = weights[f"h{side}"]
    given = seen @ weights[f"x{side}"] + weights[f"b{side}"]
    h, c = state or [np.zeros((seen.shape[1], HIDDEN), dtype=np.float32)] * 2
    out = np.empty((*seen.shape[:2], HIDDEN), dtype=np.float32)
    for t in range(len(seen)):
        gates = given[t] + h @ inner
        i, f, o = (_sigmoid(gates[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(gates[:, 3 * HIDDEN :])
        new = f * c + i * g
        squashed = np.tanh(new)
        if trace is not None:
            trace.append((h, c, i, f, o, g, squashed))
        on = live[t][:, None]
        c, h = np.where(on, new, c), np.where(on, o * squashed, h)
        out[t] = h
    if state is not None:
        state[:] = [h, c]
    return out


def _steps_back(error: np.ndarray, seen: np.ndarray, live: np.ndarray, weights: dict, side: str, trace: list) -> dict:
    """Gradients of one direction; padding stands after a page's last block, so no error reaches it."""
    inner = weights[f"h{side}"]
    down = np.empty((*seen.shape[:2], 4 * HIDDEN), dtype=np.float32)
    to_h = np.zeros((seen.shape[1], HIDDEN), dtype=np.float32)
    to_c = np.zeros_like(to_h)
    grad = np.zeros_like(inner)
    for t in range(len(seen) - 1, -1, -1):
        h, c, i, f, o, g, squashed = trace[t]
        on = live[t][:, None]
        dh = np.where(on, error[t] + to_h, 0)
        dc = np.where(on, to_c + dh * o * (1 - squashed**2), 0)
        down[t] = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g**2)], axis=1)
        grad += h.T @ down[t]
        to_h, to_c = np.where(on, down[t] @ inner.T, to_h), np.where(on, dc * f, to_c)
    return {f"x{side}": np.einsum("tbd,tbg->dg", seen, down), f"h{side}": grad, f"b{side}": down.sum(axis=(0, 1))}


def _turned(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Every page's blocks in reverse; padding stays behind them."""
    t = np.arange(len(values))[:, None]
    source = np.where(t < lengths, lengths - 1 - t, t)
    return values[source, np.arange(values.shape[1])]


class Labeller:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        size = PATH + WORDS + MEASURES
        self.weights = {"out": rng.normal(0, 0.2, 2 * HIDDEN), "shift": np.zeros(1)}
        for side in "fb":
            self.weights |= {f"x{side}": rng.normal(0, 0.15, (size, 4 * HIDDEN)), f"h{side}": rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN)), f"b{side}": np.zeros(4 * HIDDEN)}
            self.weights[f"b{side}"][HIDDEN : 2 * HIDDEN] = 1
        self.weights = {k: v.astype(np.float32) for k, v in self.weights.items()}

    @staticmethod
    def _stacked(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(p) for p in pages])
        seen = np.zeros((lengths.max(), len(pages), PATH + WORDS + MEASURES), dtype=np.float32)
        for k, page in enumerate(pages):
            seen[: len(page), k] = page
        return seen, lengths, np.arange(len(seen))[:, None] < lengths

    def probabilities(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Of every block of every page (each with one block at least) to be main text."""
        seen, lengths, live = self._stacked(pages)
        forth = _steps(seen, live, self.weights, "f")
        back = _turned(_steps(_turned(seen, lengths), live, self.weights, "b"), lengths)
        score = _sigmoid(np.concatenate([forth, back], axis=2) @ self.weights["out"] + self.weights["shift"])
        return [score[:n, k] for k, n in enumerate(lengths)]

    def long_probabilities(self, page: list[Block], piece: int = SLOTS) -> np.ndarray:
        """`probabilities` of one page of any length, in pieces: each direction carries its state from one to the next."""
        edges = [*range(0, len(page), piece), len(page)]
        pieces = list(zip(edges[:-1], edges[1:], strict=True))
        both = np.empty((len(page), 2 * HIDDEN), dtype=np.float32)
        for at, side in enumerate("fb"):
            state: list = []
            for lo, hi in pieces if side == "f" else reversed(pieces):
                seen, live = vectors(page, lo, hi)[:, None], np.ones((hi - lo, 1), dtype=bool)
                out = _steps(seen if side == "f" else seen[::-1], live, self.weights, side, state=state)[:, 0]
                both[lo:hi, at * HIDDEN : (at + 1) * HIDDEN] = out if side == "f" else out[::-1]
        return _sigmoid(both @ self.weights["out"] + self.weights["shift"])

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, seed: int = SEED) -> None:
        rng, step = np.random.default_rng(seed), 0
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for epoch in range(epochs):
            order = rng.permutation(len(pages))
            for lo in range(0, len(order), 16):
                own = order[lo : lo + 16]
                seen, lengths, live = self._stacked([pages[i] for i in own])
                truth = np.zeros(live.shape, dtype=np.float32)
                for k, i in enumerate(own):
                    truth[: len(labels[i]), k] = labels[i]
                turned = _turned(seen, lengths)
                traces: dict[str, list] = {"f": [], "b": []}
                both = np.concatenate([_steps(seen, live, self.weights, "f", traces["f"]), _turned(_steps(turned, live, self.weights, "b", traces["b"]), lengths)], axis=2)
                error = (np.where(live, _sigmoid(both @ self.weights["out"] + self.weights["shift"]) - truth, 0) / live.sum()).astype(np.float32)
                grads = {"out": np.einsum("tbh,tb->h", both, error), "shift": error.sum(keepdims=True)[0]}
                below = error[:, :, None] * self.weights["out"]
                grads |= _steps_back(below[:, :, :HIDDEN], seen, live, self.weights, "f", traces["f"])
                grads |= _steps_back(_turned(below[:, :, HIDDEN:], lengths), turned, live, self.weights, "b", traces["b"])
                step += 1
                for name, weight in self.weights.items():
                    first[name] += 0.1 * (grads[name] - first[name])
                    second[name] += 0.001 * (grads[name] ** 2 - second[name])
                    weight -= 0.01 * (1 - epoch / epochs) * first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)


def taught(page: list[Block]) -> np.ndarray:
    """Training labels: 1 for blocks inside the page's article, or anywhere if it marks none, and not in a container of other matter."""
    marked = any(tag in block.path for block in page for tag in MAIN)
    aside = {f".{name}" for name in ASIDE_NAMES} | ASIDE
    return np.array([(not marked or any(tag in b.path for tag in MAIN)) and not aside.intersection(b.path) for b in page], dtype=np.float32)


def _made_up(rng: random.Random) -> str:
    return "." + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8)))


def _few_words(text: str, rng: random.Random, most: int) -> str:
    return " ".join(text.split()[: rng.randint(1, most)]) or text


def varied(page: list[Block], others: list[str], rng: random.Random) -> tuple[list[Block], np.ndarray]:
    """A variant of a training page and its labels: another container for the article, other matter before, in and after it.

    In half of the variants containers lose the names that give them away: every telling tag is a plain one and every name made up, so that what is
    left to learn from are links, lengths, leaves, order and the blocks around. Labels stay those of the page that the blocks come from.
    """
    labels = list(taught(page))
    strange, other_names = rng.random() < 0.5, {}
    if strange:
        holder = (rng.choice(["div", "section", "td"]), *((_made_up(rng),) if rng.random() < 0.7 else ()))
    else:
        holder = rng.choice([("article",), ("main",), ("div",), ("section",)]) + tuple(f".{n}" for n in rng.sample(BODY_NAMES, rng.randint(0, 2)))

    def renamed(name: str, main: bool) -> tuple[str, ...]:
        if name in MAIN:
            return holder
        if strange and not main and name in ASIDE:
            return ("div",) if rng.random() < 0.3 else other_names.setdefault(name, ("div", _made_up(rng)))
        if strange and name.startswith("."):
            return other_names.setdefault(name, (_made_up(rng),))
        return (name,)

    made = []
    for block, x in zip(page, labels, strict=True):
        path = [n for name in block.path for n in renamed(name, bool(x))]
        if x and path[-1] == "p" and rng.random() < 0.2:
            path[-1:] = rng.choice([["blockquote"], ["blockquote", "p"], ["ul", "li"], ["ol", "li", "p"], ["pre"], ["div"], ["section", "p"]])
        made.append((Block(Place.of(path), block.text, block.linked), x))
        if x and path[-1] in ("p", "h1") and rng.random() < 0.15:  # a heading inside
            made.append((Block(Place.of([*path[:-1], rng.choice(["h2", "h3", "h4"])]), _few_words(rng.choice(others), rng, 6), 0), 1.0))
    inside = [i for i, (_, x) in enumerate(made) if x]
    for _ in range(rng.randint(1, 5)):
        if strange:  # outside the article, short or linked, or it could not be told from it
            tag, name, leaf = rng.choice(["div", "ul", "section", "td"]), _made_up(rng) if rng.random() < 0.7 else None, rng.choice(["p", "li", "div", "span", "td"])
            at = rng.choice([0, len(made)]) if rng.random() < 0.8 or not inside else rng.choice([inside[0], inside[-1] + 1])
            root: tuple[str, ...] = ("html", "body")
        else:
            tag = rng.choice(["div", "section", "ul", *sorted(ASIDE)])
            name = "." + rng.choice(ASIDE_NAMES) if tag not in ASIDE or rng.random() < 0.5 else None
            leaf = rng.choice(["p", "li", "div", "h3", "span"])
            at = rng.choice([0, len(made), rng.choice(inside) if inside else 0])
            around = made[at - 1][0].path if 0 < at < len(made) and made[at - 1][1] and rng.random() < 0.5 else ("html", "body")
            root = tuple(n for n in around if n not in ("p", "h1", "b"))
        place = Place.of((*root, tag, *((name,) if name else ()), leaf))
        for text in rng.sample(others, min(len(others), rng.randint(1, 5))):
            linked = rng.random() < (0.7 if strange else 0.3)
            if strange:
                text = _few_words(text, rng, 8 if linked else 5)
            made.insert(at, (Block(place, text, len(text) * linked if rng.random() < 0.8 else len(text) * linked // 2), 0.0))
        inside = [i for i, (_, x) in enumerate(made) if x]
    return [b for b, _ in made], np.array([x for _, x in made], dtype=np.float32)


def trained(htmls: list[str], seed: int = SEED) -> Labeller:
    """A labeller fitted to the sample and VARIANTS variants of each of its pages."""
    rng = random.Random(seed)
    pages = [p for p in map(blocks, htmls) if p]
    texts = sorted({b.text for p in pages for b in p})
    sample = [(p, taught(p)) for p in pages] + [varied(p, texts, rng) for p in pages for _ in range(VARIANTS)]
    labeller = Labeller(seed)
    seen, labels = [], []
    for k, (page, truth) in enumerate(sample):
        rows = vectors(page)
        if k >= len(pages):  # variants are seen without some or all of their words, so that these are not learned by heart
            mask = np.random.default_rng([seed, k])
            rows[:, PATH : PATH + WORDS] *= mask.random(WORDS) > mask.choice([0.2, 1.0])
        for lo in range(0, len(rows), TRAIN_BLOCKS):
            seen.append(rows[lo : lo + TRAIN_BLOCKS])
            labels.append(truth[lo : lo + TRAIN_BLOCKS])
    if seen:
        labeller.fit(seen, labels, seed=seed)
    return labeller


def learned(pages: DataFrame, key: str = "page_id", html: str = "html", most: int = TRAIN_PAGES) -> Labeller:
    """A labeller trained on the `most` pages with the lowest hashes of their key."""
    short = pages.where(F.octet_length(html) <= TRAIN_BYTES).withColumn("_at", F.xxhash64(key))
    chosen = [r[0] for r in short.select("_at", key).orderBy("_at", key).limit(most).collect()]  # keys first, so that few texts travel
    own = short.where(F.col("_at").isin(chosen)).select("_at", key, html)
    return trained([r[2] for r in own.orderBy("_at", key, html).limit(most).collect()])


def main_texts(pages: DataFrame, labeller: Labeller, columns: list[str], html: str = "html") -> DataFrame:
    """The given columns of every page and text: its main blocks in page order, two line ends between them.

    White space in a block is one blank, character references are decoded. A null or empty page has an empty text, as has one
    without main blocks. Repeated pages are kept. The columns may have any names but `text`.
    """
    rows = beside(pages, columns, html=F.coalesce(F.col(html), F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [""] * batch.num_rows

            def settle(waiting: list[tuple[int, list[Block]]]) -> None:
                for (i, page), share in zip(waiting, labeller.probabilities([vectors(page) for _, page in waiting]), strict=True):
                    texts[i] = main_text(page, share)  # noqa: B023

            for lo in range(0, batch.num_rows, 8 * BATCH):
                cut = []
                for i in range(lo, min(batch.num_rows, lo + 8 * BATCH)):
                    page = blocks(batch.column(1)[i].as_py())
                    if len(page) > SLOTS:  # alone, and not kept
                        texts[i] = main_text(page, labeller.long_probabilities(page))
                    elif page:
                        cut.append((i, page))
                cut.sort(key=lambda x: len(x[1]))
                waiting: list[tuple[int, list[Block]]] = []
                for own in cut:
                    if waiting and (len(waiting) == BATCH or (len(waiting) + 1) * len(own[1]) > SLOTS):
                        settle(waiting)
                        waiting = []
                    waiting.append(own)
                if waiting:
                    settle(waiting)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "text"])

    return spread(rows.mapInArrow(run, with_row(rows, "text string")))


def main_text(page: list[Block], share: np.ndarray) -> str:
    return "\n\n".join(b.text for b, p in zip(page, share, strict=True) if p > 0.5)
