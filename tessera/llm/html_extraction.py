"""Main text of web pages by a recurrent block labeller.

A page's markup becomes a sequence of blocks: runs of text between block-level tags, each with the path of elements that
hold it. A bidirectional LSTM (numpy) reads a vector for each block: hashed elements, classes and ids of the path, hashed
words, and a few shares (links, punctuation, length, place). Both directions see the whole page, and each block is labelled
as article or not from both.

The labeller is trained here, once for a driver process and in a few seconds, on TRAINING_PAGES generated pages whose
structure is drawn at random (with and without semantic elements, telling classes and closing tags), so every block's label
is known. Weights go to the executors as a broadcast of fixed size (under 200 kB).

Defined cases: a null or empty html gives ""; a page without article blocks gives ""; markup that breaks off is read up to
there; an element of no text that is never closed ends with the element around it; long pages are read whole, in linear time; repeated rows each give a row; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import arrow

TRAINING_PAGES, EPOCHS, SEED = 900, 10, 20
PATH_SIZE, WORD_SIZE, HIDDEN = 128, 32, 20
FEATURES = PATH_SIZE + WORD_SIZE + 8
#: Elements that part blocks.
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page: markup that is read to its end tag, or to that of an element around it.
SKIPPED = set("template noscript svg iframe object canvas audio video head".split())
#: The same, where only the end tag ends it.
RAW = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in ("script", "style", "textarea", "title")}
#: Elements that a new one of the same kind (or of the given ones) closes.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}
MARKUP = re.compile(r"<[a-zA-Z!?/]")
#: A whole tag. A quote opens a value only behind an equals sign; nothing is tried twice, so time is linear.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]*+))*+)>")
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAME_PARTS = re.compile(r"[a-z]+")


class Element:
    """An open element; bits: the slots of its path's parts."""

    __slots__ = ("name", "own", "around", "bits")

    def __init__(self, name: str, own: tuple[str, ...], around: Element | None):
        self.name, self.own, self.around = name, own, around
        self.bits = around.bits if around else 0
        for part in own:
            self.bits |= 1 << _slot(part) % PATH_SIZE


class Block:
    __slots__ = ("element", "text", "linked")

    def __init__(self, element: Element | None, text: str, linked: int):
        self.element, self.text, self.linked = element, text, linked

    @property
    def tag(self) -> str:
        return self.element.name if self.element else ""

    @property
    def path(self) -> tuple[str, ...]:
        parts, at = [], self.element
        while at:
            parts.append(at.own)
            at = at.around
        return tuple(x for own in reversed(parts) for x in own)


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order, with character references decoded and white space made single spaces."""
    blocks: list[Block] = []
    stack: list[Element] = []
    parts: list[str] = []
    linked, links, at, skipped = 0, 0, 0, None  # skipped: the place on the stack of the outermost skipped element
    held: dict[str, int] = {}  # open elements by name

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                blocks.append(Block(stack[-1] if stack else None, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text and skipped is None:
            parts.append(text)
            if links:
                linked += len(text)

    def close(size: int) -> None:
        nonlocal skipped
        while len(stack) > size:
            held[stack.pop().name] -= 1
        if skipped is not None and skipped >= size:
            skipped = None

    def begin(name: str, attributes: str) -> None:
        own = [name]
        for found in NAMED.finditer(attributes):
            own += NAME_PARTS.findall((found[1] or found[2] or found[3] or "").lower())
        stack.append(Element(name, tuple(own), stack[-1] if stack else None))
        held[name] = held.get(name, 0) + 1

    while token := MARKUP.search(page, at):
        add(page[at : token.start()])
        at = token.start()
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = len(page) if end < 0 else end + 3
            continue
        if not page[at + 1 : at + 3].lstrip("/")[:1].isalpha():  # a declaration, or an end tag without a name
            end = page.find(">", at + 2)
            at = len(page) if end < 0 else end + 1
            continue
        tag = TAG.match(page, at)
        if not tag:  # the page breaks off inside a tag
            at = len(page)
            break
        at, name = tag.end(), tag[2].lower()
        if tag[1]:
            if name == "a":
                links = max(0, links - 1)
            elif name in BLOCK or name in SKIPPED:
                inside = skipped is not None
                if held.get(name):
                    to = len(stack) - 1
                    while stack[to].name != name:
                        to -= 1
                    inside = inside and to >= skipped
                    if not inside and name in BLOCK:
                        flush()
                    close(to)
                elif not inside and name in BLOCK:
                    flush()
                if not inside and name in BLOCK:
                    links = 0
            continue
        if name in RAW:
            end = RAW[name].search(page, at)
            at = end.start() if end else len(page)
        elif name == "a":
            links = links or 1
        elif name == "br":
            add(" ")
        elif name in SKIPPED:
            if not (name == "svg" and tag[3].endswith("/")):
                if skipped is None:
                    skipped = len(stack)
                begin(name, "")
        elif name in BLOCK:
            if skipped is not None and stack[skipped].name in ("head", "svg") and (name == "body" or len(stack) == skipped + 1):
                close(skipped)  # nothing that stands in a head or a picture
            if skipped is None:
                flush()
                links = 0
            while stack and (stack[-1].name == "p" or name in CLOSED_BY.get(stack[-1].name, ())):
                close(len(stack) - 1)
            if name not in VOID:
                begin(name, tag[3])
    add(page[at:])
    flush()
    return blocks


_slots: dict[str, int] = {}


def _slot(word: str) -> int:
    if len(_slots) > 200_000:
        _slots.clear()
    slot = _slots.get(word)
    if slot is None:
        slot = _slots[word] = zlib.crc32(word.encode("utf-8", "replace"))
    return slot


def vectors(blocks: list[Block]) -> np.ndarray:
    out = np.zeros((len(blocks), FEATURES), np.float32)
    n = len(blocks)
    for i, block in enumerate(blocks):
        row = out[i]
        bits = block.element.bits if block.element else 0
        row[:PATH_SIZE] = np.unpackbits(np.frombuffer(bits.to_bytes(PATH_SIZE // 8, "little"), np.uint8), bitorder="little")
        row[(_slot("own " + block.tag)) % PATH_SIZE] = 1
        words = block.text.lower().split(" ")
        slots = np.fromiter(map(_slot, words), np.int64, len(words)) % WORD_SIZE
        row[PATH_SIZE : PATH_SIZE + WORD_SIZE] = np.bincount(slots, minlength=WORD_SIZE) / len(words)
        size = len(block.text)
        row[-8:] = (
            np.log1p(size) / 6,
            np.log1p(len(words)) / 4,
            block.linked / size,
            sum(map(block.text.count, ".,;!?")) / len(words),
            block.text[-1] in ".!?\"”…",
            i / n,
            1.0,
            sum(map(block.text.count, "©|·»›→")) > 0,
        )
    return out


# The network: two LSTMs and a logistic layer over both.


def _start(rng: np.random.Generator) -> dict[str, np.ndarray]:
    weights = {}
    for side in "fb":
        weights["x" + side] = rng.normal(0, 0.1, (FEATURES, 4 * HIDDEN))
        weights["h" + side] = rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN))
        weights["c" + side] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
    weights["out"] = rng.normal(0, 0.1, (2 * HIDDEN, 1))
    weights["bias"] = np.zeros(1)
    return {k: v.astype(np.float32) for k, v in weights.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _forward(weights: dict, x: np.ndarray, mask: np.ndarray, side: str) -> tuple[np.ndarray, list]:
    """Hidden states (time, page, HIDDEN) of one direction; mask: which blocks are there."""
    steps, pages = mask.shape
    order = range(steps) if side == "f" else range(steps - 1, -1, -1)
    states, memory = np.zeros((steps, pages, HIDDEN), np.float32), []
    h = c = np.zeros((pages, HIDDEN), np.float32)
    drive = x @ weights["x" + side] + weights["c" + side]
    for t in order:
        gates = drive[t] + h @ weights["h" + side]
        i, f, o = (_sigmoid(gates[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(gates[:, 3 * HIDDEN :])
        kept = mask[t][:, None]
        fresh = np.where(kept, f * c + i * g, c)
        wave = np.tanh(fresh)
        memory.append((t, h, c, i, f, o, g, wave, kept))
        c, h = fresh, np.where(kept, o * wave, h)
        states[t] = h
    return states, memory


def _backward(weights: dict, grads: dict, x: np.ndarray, memory: list, d_states: np.ndarray, side: str) -> None:
    d_h = d_c = np.zeros_like(d_states[0])
    for t, h, c, i, f, o, g, wave, kept in reversed(memory):
        d_h = d_h + d_states[t]
        d_wave = np.where(kept, d_h * o * (1 - wave**2), 0)
        d_fresh = d_c + d_wave
        live = np.where(kept, d_fresh, 0)
        d_gates = np.concatenate([live * g * i * (1 - i), live * c * f * (1 - f), np.where(kept, d_h * wave, 0) * o * (1 - o), live * i * (1 - g**2)], 1)
        grads["x" + side] += x[t].T @ d_gates
        grads["h" + side] += h.T @ d_gates
        grads["c" + side] += d_gates.sum(0)
        d_h = np.where(kept, 0, d_h) + d_gates @ weights["h" + side].T
        d_c = np.where(kept, d_fresh * f, d_c)


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), FEATURES), np.float32), np.zeros((steps, len(pages)), bool)
    for i, page in enumerate(pages):
        x[: len(page), i], mask[: len(page), i] = page, True
    return x, mask


def label(weights: dict, pages: list[np.ndarray], together: int = 64) -> list[np.ndarray]:
    """Each block's probability of being article text; pages of like length run together."""
    out: list[np.ndarray] = [np.empty(0)] * len(pages)
    order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
    start = 0
    while start < len(order):
        end = start + 1
        while end < len(order) and end - start < together and len(pages[order[end]]) * (end - start) < 20_000:
            end += 1
        own = order[start:end]
        x, mask = _padded([pages[i] for i in own])
        states = np.concatenate([_forward(weights, x, mask, s)[0] for s in "fb"], 2)
        chance = _sigmoid((states @ weights["out"] + weights["bias"])[..., 0])
        for k, i in enumerate(own):
            out[i] = chance[: len(pages[i]), k]
        start = end
    return out


# Generated pages.

_ROLES = {
    "nav": ("nav", "nav navbar menu navigation breadcrumb toc pagination topnav"),
    "head": ("header", "header masthead top banner site-header branding logo"),
    "foot": ("footer", "footer colophon copyright site-footer bottom legal"),
    "side": ("aside", "sidebar side widget related rail recommended trending tags"),
    "note": ("div", "notice cookie cookies consent gdpr alert banner popup modal message disclaimer"),
    "ad": ("div", "ad ads advert advertisement sponsored promo adsbox sponsor banner-ad"),
    "form": ("form", "form newsletter subscribe signup login search contact"),
    "comments": ("section", "comments comment commentlist replies reply discussion disqus responses"),
    "share": ("div", "share social sharing follow buttons"),
}
_ARTICLE = "content article post entry story body text main entry-content post-body article-body page"
_PHRASES = {
    "nav": "home about contact news products services blog archive next previous login start".split(),
    "foot": "© all rights reserved privacy policy terms imprint contact sitemap powered by".split(),
    "note": "we use cookies accept this site by continuing you agree consent settings".split(),
    "ad": "buy now sponsored advertisement sale offer free shipping click here".split(),
    "form": "name email subscribe send search sign up password submit your message".split(),
    "comments": "reply says posted by thanks great comment likes report ago user".split(),
    "share": "share tweet like print email facebook follow".split(),
    "side": "related popular posts recent tags read more latest categories".split(),
    "head": "welcome menu search official site skip to content".split(),
}


class _Writer:
    """Writes a page and, in the same order, whether each of its blocks is article text."""

    def __init__(self, rng: random.Random):
        self.rng, self.out, self.labels = rng, [], []
        parts = [["th", "er", "in", "an", "re", "on", "st", "ly"], ["en", "sch", "un", "ge", "keit", "ver"], ["ció", "os", "ra", "ñe", "ll", "do"], ["qu", "eau", "é", "ment", "les", "oi"], ["文", "字", "的", "一", "是"]]
        self.parts = [rng.choice(parts), rng.choice(parts)]
        self.telling = rng.random() < 0.8  # whether elements and classes tell their role
        self.closes = rng.random() < 0.8

    def word(self) -> str:
        return "".join(self.rng.choices(self.rng.choice(self.parts), k=self.rng.randint(1, 4)))

    def prose(self, low: int, high: int, stop: bool = True) -> str:
        words = [self.word() for _ in range(self.rng.randint(low, high))]
        for i in range(0, len(words), self.rng.randint(6, 18)):
            words[i] = words[i].capitalize()
            if i and stop:
                words[i - 1] += self.rng.choice(".,.?")
        return " ".join(words) + (self.rng.choice("..!") if stop and self.rng.random() < 0.9 else "")

    def odd(self) -> str:
        """Text such as articles hold now and then: lists in a line, marks, figures, one word."""
        words = [self.word() for _ in range(self.rng.randint(1, 25))]
        kind = self.rng.randrange(5)
        if kind == 0:
            return " | ".join(words)
        if kind == 1:
            return " ".join(w + self.rng.choice(["###", "***", "%%%", "&amp;", "!!!"]) for w in words)
        if kind == 2:
            return " ".join(words[:1] * len(words))
        if kind == 3:
            return " ".join(str(self.rng.randrange(10**6)) for _ in words)
        return words[0] + self.rng.choice(["", ".", ":"])

    def block(self, tag: str, text: str, main: bool, close: bool = True) -> None:
        if self.rng.random() < 0.1 and main:
            text = f"<{self.rng.choice(['b', 'em', 'span', 'strong'])}>{text}"
        self.out.append(f"<{tag}>{text}" + (f"</{tag.split()[0]}>" if close else ""))
        self.labels.append(main)

    def open(self, tag: str, names: str, tell: bool) -> str:
        name = self.rng.choice(names.split())
        if not tell:
            self.out.append("<div>")
            return "div"
        kind = self.rng.random()
        if kind < 0.35:
            self.out.append(f"<{tag}>" if tag != "div" else f'<div class="{name}">')
            return tag
        other = self.rng.choice([tag, "div", "section", "div"])
        self.out.append(f"<{other} {self.rng.choice(['class', 'class', 'id'])}=\"{self.rng.choice(['', '', 'x-', 'site-'])}{name}{self.rng.choice(['', '', '-box', ' wide', '-1'])}\">")
        return other

    def boilerplate(self, role: str) -> None:
        rng = self.rng
        tag, names = _ROLES[role]
        tag = self.open(tag, names, self.telling or role in ("ad", "note"))
        phrases = lambda low, high: " ".join(rng.choice(_PHRASES[role]) if rng.random() < 0.5 else self.word() for _ in range(rng.randint(low, high)))
        if role in ("nav", "share") or role in ("side", "foot", "head") and rng.random() < 0.5:
            listed = rng.random() < 0.7
            if listed:
                self.out.append("<ul>")
                for _ in range(rng.randint(2, 9)):
                    self.block("li", f'<a href="/{self.word()}">{phrases(1, 3)}</a>', False, self.closes)
                self.out.append("</ul>")
            else:
                self.out.append(" | ".join(f'<a href="#">{phrases(1, 2)}</a>' for _ in range(rng.randint(2, 6))))
                self.labels.append(False)
        elif role == "comments":
            for _ in range(rng.randint(1, 5)):
                inner = rng.choice(["div class=comment", "li", "div", "p"])
                if inner != "p":
                    self.out.append(f"<{inner}>")
                    if rng.random() < 0.6:
                        self.block(rng.choice(["h4", "cite-x", "h5"]).replace("cite-x", "div"), phrases(1, 4), False)
                    self.block("p", self.prose(4, 50), False, self.closes)
                    self.out.append(f"</{inner.split()[0]}>")
                else:
                    self.block("p", self.prose(4, 50), False, self.closes)
        elif role == "form":
            for _ in range(rng.randint(1, 3)):
                self.block(rng.choice(["p", "div", "button", "label-x"]).replace("label-x", "div"), phrases(1, 8), False)
                self.out.append('<input type="text">')
        else:
            kind = rng.random()
            if kind < 0.45:
                text = ("&copy; " if role == "foot" else "") + (phrases(3, 14) if rng.random() < 0.4 else self.prose(4, 22))
                self.out.append(text)
                self.labels.append(False)
            else:
                if rng.random() < 0.3:
                    self.block("h3", phrases(1, 4), False)
                for _ in range(rng.randint(1, 3)):
                    self.block("p", phrases(3, 14) if rng.random() < 0.5 else self.prose(4, 30), False, self.closes)
        self.out.append(f"</{tag}>")

    def article(self) -> None:
        rng = self.rng
        kind, opened = rng.random(), []
        if kind < 0.45:
            opened.append("article")
            self.out.append("<article>" if rng.random() < 0.6 else f'<article class="{rng.choice(_ARTICLE.split())}">')
        elif kind < 0.6:
            opened += ["main"]
            self.out.append("<main>")
        elif kind < 0.9 and self.telling:
            opened.append("div")
            self.out.append(f"<div {rng.choice(['class', 'id'])}=\"{rng.choice(_ARTICLE.split())}\">")
        else:
            opened.append("div")
            self.out.append("<div>")
        if rng.random() < 0.9:
            nested = rng.random() < 0.15
            self.out.append("<header>" if nested else "")
            self.block(rng.choice(["h1", "h1", "h1", "h2"]), self.prose(2, 14, rng.random() < 0.3), True)
            self.out.append("</header>" if nested else "")
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            if kind < 0.15:
                for _ in range(rng.choice([1, 1, 1, 4])):
                    self.block("p", self.odd(), True, self.closes)
            elif kind < 0.78:
                self.block("p", self.prose(3, 90) if rng.random() < 0.9 else self.prose(1, 6), True, self.closes)
            elif kind < 0.84:
                self.block(rng.choice(["h2", "h3"]), self.prose(1, 8, False), True)
            elif kind < 0.9:
                self.out.append("<ul>")
                for _ in range(rng.randint(2, 5)):
                    self.block("li", self.prose(2, 20), True, self.closes)
                self.out.append("</ul>")
            elif kind < 0.93:
                self.block("blockquote", self.prose(5, 40), True)
            elif kind < 0.95:
                self.block("pre", self.prose(5, 40), True)
            else:
                self.boilerplate(rng.choice(["ad", "share", "note", "form", "side", "nav"]))
        self.out += [f"</{tag}>" for tag in reversed(opened)]

    def page(self) -> tuple[str, list[bool]]:
        rng = self.rng
        self.out.append(f"<!DOCTYPE html><html><head><title>{self.prose(2, 8)}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>")
        wrapped = rng.random() < 0.3
        self.out.append('<div id="wrapper">' if wrapped else "")
        for role in ("note", "head", "nav", "ad", "side", "form"):
            if rng.random() < {"nav": 0.85, "head": 0.5, "ad": 0.4}.get(role, 0.2):
                self.boilerplate(role)
        if rng.random() < 0.97:
            self.article()
        for role in ("share", "ad", "side", "comments", "form", "note", "nav", "foot"):
            if rng.random() < {"foot": 0.85, "comments": 0.35, "side": 0.35}.get(role, 0.15):
                self.boilerplate(role)
        self.out.append("</div>" if wrapped else "")
        self.out.append("</body></html>")
        return "".join(self.out), self.labels


def training_pages(n: int = TRAINING_PAGES, seed: int = SEED) -> list[tuple[np.ndarray, np.ndarray]]:
    """(block vectors, labels) of n generated pages."""
    pages = []
    for i in range(n):
        page, labels = _Writer(random.Random(seed * 1_000_003 + i)).page()
        found = blocks_of(page)
        if len(found) == len(labels) and found:
            pages.append((vectors(found), np.array(labels, np.float32)))
    return pages


def train(pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = SEED, together: int = 32) -> dict[str, np.ndarray]:
    """Weights after Adam steps on the mean cross-entropy of the blocks."""
    rng = np.random.default_rng(seed)
    weights = _start(rng)
    first, second = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))
    step, rate = 0, 0.01
    for epoch in range(epochs):
        for chosen in np.array_split(rng.permutation(len(pages)), -(-len(pages) // together)):
            x, mask = _padded([pages[i][0] for i in chosen])
            x *= rng.random(FEATURES) > 0.03
            truth = np.zeros(mask.shape, np.float32)
            for k, i in enumerate(chosen):
                truth[: len(pages[i][1]), k] = pages[i][1]
            forward, memory_f = _forward(weights, x, mask, "f")
            backward, memory_b = _forward(weights, x, mask, "b")
            states = np.concatenate([forward, backward], 2)
            chance = _sigmoid((states @ weights["out"] + weights["bias"])[..., 0])
            d_out = (np.where(mask, chance - truth, 0) / mask.sum())[..., None]
            grads = {k: np.zeros_like(v) for k, v in weights.items()}
            grads["out"] = np.tensordot(states, d_out, ((0, 1), (0, 1)))
            grads["bias"] = d_out.sum((0, 1))
            d_states = d_out @ weights["out"].T
            _backward(weights, grads, x, memory_f, d_states[..., :HIDDEN], "f")
            _backward(weights, grads, x, memory_b, d_states[..., HIDDEN:], "b")
            step += 1
            scale = min(1.0, 1 / (1e-9 + np.sqrt(sum(float((g**2).sum()) for g in grads.values()))))
            for k, g in grads.items():
                g = g * scale
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g**2
                pace = rate * (1 - epoch / epochs) * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                weights[k] = (weights[k] - pace).astype(np.float32)
    return weights


@lru_cache(1)
def labeller() -> dict[str, np.ndarray]:
    return train(training_pages())


def main_texts(weights: dict[str, np.ndarray], pages: list[str]) -> list[str]:
    """The article text of each page."""
    blocks = [blocks_of(p) if p else [] for p in pages]
    chances = label(weights, [vectors(b) for b in blocks])
    return ["\n\n".join(b.text for b, c in zip(own, chance, strict=True) if c > 0.5) for own, chance in zip(blocks, chances, strict=True)]


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    weights = pages.sparkSession.sparkContext.broadcast(labeller())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow.slices(batches, html, 2 << 20):
            texts = main_texts(weights.value, arrow.texts(batch.column(html)))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", html).mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
