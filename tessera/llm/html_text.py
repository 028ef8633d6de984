"""HTML extraction with a recurrent block labeller.

A page becomes its sequence of text blocks (text between block-level tags, with
the path of open elements). Each block has a vector: the hashed elements of its
tag path (tags, classes, ids, roles), the hashed words, and a few numbers. A
bidirectional LSTM in numpy reads the whole sequence, so every block is labelled
with the document's context, main text or not.

It is trained here, on about TRAIN_PAGES pages (those with the smallest hashes)
and variants of them that keep their labels: other containers around the
article, wrappers around the page, sections and headers with open names inside,
and boilerplate of many kinds put between. Collapsed
text (hidden elements) is the labeller's to decide. The first labels come from `teacher`,
which reads the path alone. Afterwards blocks under elements that are never main
text (menus, forms, comments and so on) go whatever the labeller says, unless
the element holds most of the article's text and so is a layout wrapper. Running
text where the paths have main text stays; of the rest (short lines, headings)
the labeller must be sure to leave out what the paths call main; all other
blocks, also those outside <article> and <main>, are its own decision.

A line of text goes on over inline elements, icons, scripts, buttons and fields
inside it; what an icon or script holds is left out, a button's words are the
line's unless they are all of it.

Edge cases: a null page is empty, a null id or url stays null, and only the kept
columns and the html are read, so others can't clash; a block's label is
a threshold on one number, so there are no ties; a page without main text gives an empty
string; broken markup (open tags, cut entities, cut comments) is read to its
end; long pages are read whole; repeated rows are answered each; without a page
to train on, a small built-in one takes its place.
"""

from __future__ import annotations

import html as html_lib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import worker_state

TRAIN_PAGES, VARIANTS, STEPS = 128, 3, 150
PATH_DIMS, WORD_DIMS, NUMBERS, HIDDEN = 96, 16, 4, 16
SURE, PROSE = 0.98, 60
BATCH = 64

# HTML's element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle merror "
                   "mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd mspace semantics".split())
RAW = frozenset("script style noscript iframe textarea title".split())
# Stand inside a line of text and don't end it; what a button or label says is the line's, unless it is all of it.
WITHIN = INLINE | frozenset("script style noscript button label input link meta source track param embed area".split())
PRESSED = frozenset(["button", "label"])
# Left out when closed, whatever line they stand in; one that is never closed counts as empty.
SKIPPED = frozenset("template svg select object canvas video audio annotation annotation-xml".split())
FOREIGN = frozenset(["svg", "math"])               # '/>' closes an element only here
CLOSED_BY = {"p": frozenset("p div article section ul ol table h1 h2 h3 h4 h5 h6 blockquote pre form nav header footer "
                            "aside main figure hr address dl fieldset".split()),
             "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
             "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
             "option": frozenset(["option"])}
SCOPE = frozenset("article section div td th li ul ol table body main blockquote".split())
HARD = frozenset("head nav button label legend input dialog menu option".split())
NEVER = HARD | frozenset("header footer aside form".split())
NEVER_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer foot sidebar aside widget cookie "
    "cookies consent gdpr notice notices banner alert popup modal overlay newsletter subscribe signup promo promotion "
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored share sharing social related "
    "recommended comment comments commentlist disqus respond reply replies form search login pagination pager copyright "
    "complementary contentinfo dialog toolbar skip".split())
# Words that name a topic, an anchor or a layout as often as boilerplate: the labeller decides on them.
OPEN_WORDS = frozenset(
    "navigation menu header foot notice notices alert promotion advert advertisement advertising sponsor share sharing "
    "social related recommended respond reply form search login signup subscribe copyright cookies consent skip dialog "
    "overlay hidden widget banner".split())
COMMENTS = frozenset("comment comments commentlist disqus".split())
TEASER = COMMENTS | frozenset("reply respond replies teaser related recommended promo sponsored widget card preview".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset(["article", "main"])
MAIN_WORDS = frozenset("article content main post entry story body text".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
                   r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Block(NamedTuple):
    text: str
    path: tuple[tuple[str, frozenset], ...]     # (tag, words of class, id and role)
    linked: float                               # share of the text inside links
    serials: tuple[int, ...] = ()               # of the path's elements, to tell equal ones apart


def _marks(attributes: str) -> frozenset:
    words = set()
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        value = a or b or c
        if name.lower() == "hidden" or name.lower() == "style" and HIDDEN_STYLE.search(value):
            words.add("(hidden)")
        elif name.lower() in ("class", "id", "role"):
            words.update(p.lower() for p in NAME_PARTS.findall(value))
    return frozenset(words)


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order, with their paths."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset]] = []
    serials: list[int] = []                         # of the stack's elements
    ends: dict[str, dict[int, int]] = {}            # per skipped tag: where each element begins and ends
    parts: list[str] = []
    links = linked = pressed = presses = serial = 0

    def drop(i: int):
        nonlocal links, presses
        links -= sum(e[0] == "a" for e in stack[i:])
        presses -= sum(e[0] in PRESSED for e in stack[i:])
        del stack[i:], serials[i:]

    def close_block():
        nonlocal linked, pressed
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                shown = [i for i, e in enumerate(stack) if e[0] not in WITHIN]
                path, own = tuple(stack[i] for i in shown), tuple(serials[i] for i in shown)
                if pressed >= sum(map(len, text.split())):
                    path, own = (*path, ("button", frozenset())), (*own, -len(out) - 1)
                out.append(Block(text, path, min(1.0, linked / len(text)), own))
            parts.clear()
        linked = pressed = 0

    def say(text: str):
        nonlocal linked, pressed
        if text:
            text = html_lib.unescape(text) if "&" in text else text
            parts.append(text)
            if links:
                linked += len(text)
            if presses:
                pressed += sum(map(len, text.split()))

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at:m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing = m[1] or m[4]
        if tag in SKIPPED:
            if tag not in ends:
                ends[tag] = _elements(page, tag)
            if not closing and (stop := ends[tag].get(m.start())):
                at = stop
            continue
        if tag not in WITHIN:
            close_block()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    drop(i)
                    break
                if tag in INLINE and stack[i][0] not in INLINE:
                    break
            continue
        attributes = m[3] or m[6] or ""
        if attributes.endswith("/") and (tag in FOREIGN or any(e[0] in FOREIGN for e in stack)):
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            at = page.find(">", stop.start()) + 1 if stop else end
            at = at or end
            continue
        if tag in VOID:
            continue
        for i in range(len(stack) - 1, -1, -1):
            if tag in CLOSED_BY.get(stack[i][0], ()):
                drop(i)
                break
            if stack[i][0] in SCOPE:
                break
        serial += 1
        stack.append((tag, _marks(attributes)))
        serials.append(serial)
        links += tag == "a"
        presses += tag in PRESSED
    close_block()
    return out


def _elements(page: str, tag: str) -> dict[int, int]:
    """Where the closed elements of a tag begin and end, nested ones too."""
    open_, out = [], {}
    for m in re.finditer(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*?(/?)>", page, re.I):
        if not m[1]:
            if not (m[2] and tag in FOREIGN):
                open_.append(m.start())
        elif open_:
            out[open_.pop()] = m.end()
    return out


# What an element says about its text: nothing, ask the labeller, never main
# unless it holds most of it, never main.
FREE, ASK, MOSTLY, ALWAYS = range(4)


@lru_cache(1 << 14)
def marked(tag: str, words: frozenset) -> int:
    if tag in HARD:
        return ALWAYS
    if tag in NEVER:
        return MOSTLY
    if tag in ("html", "body", "p") or tag in HEADINGS:     # their names are anchors and page-wide states
        return FREE
    if tag in MAIN:
        return FREE if words.isdisjoint(TEASER) else MOSTLY
    named = words & NEVER_WORDS
    return MOSTLY if named - OPEN_WORDS else ASK if named or not words.isdisjoint(("hidden", "(hidden)")) else FREE


def in_main(path: tuple) -> bool:
    return any(tag in MAIN and words.isdisjoint(TEASER) for tag, words in path)


def in_named(path: tuple) -> bool:
    return any(tag not in ("html", "body") and not words.isdisjoint(MAIN_WORDS) and marked(tag, words) == FREE
               for tag, words in path)


def serials(b: Block) -> tuple:
    return b.serials or b.path


def judged(blocks: list[Block]) -> tuple[list[int], list[bool]]:
    """What is marked over each block, and whether it lies in the article: in
    <article> or <main> (no comment or teaser), else in an element named like
    one, else anywhere. A marked element that holds most of the article's text
    is a wrapper and says nothing."""
    marks = [[marked(t, w) for t, w in b.path] for b in blocks]
    free = [ALWAYS not in m for m in marks]
    told = [f and all(w.isdisjoint(COMMENTS) for _, w in b.path) for f, b in zip(free, blocks)]
    inside = free
    for rule, among in ((in_main, told), (in_named, told), (in_main, free), (in_named, free), (None, told)):
        found = [a and (rule is None or rule(b.path)) for a, b in zip(among, blocks)]
        if any(found):
            inside = found
            break
    held: dict = {}
    for b, i, m in zip(blocks, inside, marks):
        if i and any(m):
            for e, k in zip(serials(b), m):
                if k:
                    held[e] = held.get(e, 0) + len(b.text)
    half = sum(len(b.text) for b, i in zip(blocks, inside) if i) / 2
    out = []
    for b, m in zip(blocks, marks):
        worst = main = FREE
        if any(m):
            heading = any(t in HEADINGS for t, _ in b.path)
            for e, k, (tag, words) in zip(serials(b), m, b.path):
                if k == MOSTLY and tag == "header" and (main or heading) and not words & NEVER_WORDS - OPEN_WORDS:
                    k = ASK                         # an article's own header
                if k == ALWAYS or k and held.get(e, 0) <= half:
                    worst = max(worst, k)
                main = main or tag in MAIN
        out.append(worst)
    return out, inside


def teacher(blocks: list[Block]) -> np.ndarray:
    """Labels from the paths: main text lies in the article and in no
    boilerplate element. Where only an open word is against it, headings and
    running text count as main."""
    worst, inside = judged(blocks)
    prose = [running(b) or bool(b.path) and b.path[-1][0] in HEADINGS for b in blocks]
    return np.array([i and (k == FREE or k == ASK and p) for i, k, p in zip(inside, worst, prose)], float)


# ---- vectors --------------------------------------------------------------

def vectors(blocks: list[Block], words: dict[str, int]) -> np.ndarray:
    """(blocks, features) of a page; ``words``: a cache of hashes."""
    x = np.zeros((len(blocks), PATH_DIMS + WORD_DIMS + NUMBERS), np.float32)
    for i, b in enumerate(blocks):
        for tag, marks in b.path:
            for name in (tag, *("." + m for m in marks)):
                h = words.get(name)
                if h is None:
                    h = words[name] = zlib.crc32(name.encode("utf-8", "replace"))
                x[i, h % PATH_DIMS] += 1.0 if h & 0x80000000 else -1.0
        dims = []
        for w in b.text.split():
            h = words.get(w)
            if h is None:
                if len(words) > 1 << 18:
                    words.clear()
                h = words[w] = zlib.crc32(w.encode("utf-8", "replace"))
            dims.append(h % WORD_DIMS)
        x[i, PATH_DIMS:PATH_DIMS + WORD_DIMS] = np.bincount(dims, minlength=WORD_DIMS) / max(1, len(dims))
        x[i, -NUMBERS:] = (np.log1p(len(b.text)) / 8, b.linked, i / len(blocks), b.text[-1] in ".!?…")
    return x


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(steps, pages, features) and the mask (steps, pages, 1)."""
    steps = max(map(len, pages), default=0)
    x = np.zeros((steps, len(pages), PATH_DIMS + WORD_DIMS + NUMBERS), np.float32)
    mask = np.zeros((steps, len(pages), 1), np.float32)
    for j, p in enumerate(pages):
        x[:len(p), j], mask[:len(p), j] = p, 1
    return x, mask


# ---- the network ----------------------------------------------------------

def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def lstm_forward(x, mask, w, b):
    """Hidden states (steps, pages, H) and what the backward pass needs. Padded
    steps carry the state on."""
    steps, n, _ = x.shape
    hidden = w.shape[1] // 4
    h = c = np.zeros((n, hidden), x.dtype)
    xs = x @ w[:-hidden] + b
    states, kept = np.empty((steps, n, hidden), x.dtype), []
    for t in range(steps):
        a = xs[t] + h @ w[-hidden:]
        i, f, o = (_sigmoid(a[:, k * hidden:(k + 1) * hidden]) for k in range(3))
        g = np.tanh(a[:, 3 * hidden:])
        new = f * c + i * g
        tc = np.tanh(new)
        kept.append((h, c, i, f, o, g, tc))
        m = mask[t]
        c = m * new + (1 - m) * c
        h = m * (o * tc) + (1 - m) * h
        states[t] = h
    return states, kept


def lstm_backward(x, mask, w, kept, grad):
    """Gradients of w and b from those of the states."""
    hidden = w.shape[1] // 4
    gw, gb = np.zeros_like(w), np.zeros(w.shape[1], w.dtype)
    dh = dc = np.zeros_like(grad[0])
    for t in range(len(x) - 1, -1, -1):
        h, c, i, f, o, g, tc = kept[t]
        m = mask[t]
        total = grad[t] + dh
        d_out, pass_h = total * m, total * (1 - m)
        d_new = dc * m + d_out * o * (1 - tc * tc)
        da = np.concatenate([d_new * g * i * (1 - i), d_new * c * f * (1 - f), d_out * tc * o * (1 - o),
                             d_new * i * (1 - g * g)], axis=1)
        gw += np.concatenate([x[t], h], axis=1).T @ da
        gb += da.sum(axis=0)
        dh = pass_h + da @ w[-hidden:].T
        dc = dc * (1 - m) + d_new * f
    return gw, gb


def label(model: dict, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Probability of main text per block, (steps, pages)."""
    fwd, kf = lstm_forward(x, mask, model["wf"], model["bf"])
    bwd, kb = lstm_forward(x[::-1], mask[::-1], model["wb"], model["bb"])
    both = np.concatenate([fwd, bwd[::-1]], axis=2)
    return _sigmoid(both @ model["v"] + model["c"])[:, :, 0], (both, kf, kb)


def train(pages: list[tuple[np.ndarray, np.ndarray]], steps: int = STEPS, seed: int = 5) -> dict:
    """Adam on the cross-entropy of (vectors, labels) pairs."""
    rng = np.random.default_rng(seed)
    width, h = PATH_DIMS + WORD_DIMS + NUMBERS, HIDDEN
    shapes = {"wf": (width + h, 4 * h), "bf": (4 * h,), "wb": (width + h, 4 * h), "bb": (4 * h,), "v": (2 * h, 1), "c": (1,)}
    model = {k: (rng.normal(0, 0.15, s) if len(s) > 1 else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}
    for k in ("bf", "bb"):
        model[k][h:2 * h] = 1.0                         # remember at first
    m1, m2 = ({k: np.zeros_like(p) for k, p in model.items()} for _ in range(2))
    for step in range(1, steps + 1):
        chosen = [pages[i] for i in rng.choice(len(pages), min(BATCH, len(pages)), replace=False)]
        x, mask = padded([p for p, _ in chosen])
        y = np.zeros(x.shape[:2], np.float32)
        for j, (_, t) in enumerate(chosen):
            y[:len(t), j] = t
        p, (both, kf, kb) = label(model, x, mask)
        d = ((p - y) * mask[:, :, 0] / mask.sum())[:, :, None].astype(np.float32)
        grad = {"v": np.einsum("tnh,tno->ho", both, d), "c": d.sum(axis=(0, 1))}
        back = d @ model["v"].T
        grad["wf"], grad["bf"] = lstm_backward(x, mask, model["wf"], kf, back[:, :, :h])
        grad["wb"], grad["bb"] = lstm_backward(x[::-1], mask[::-1], model["wb"], kb, back[::-1, :, h:])
        for k, g in grad.items():
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.999 * m2[k] + 0.001 * g * g
            model[k] = (model[k] - 0.02 * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return model


# ---- training pages -------------------------------------------------------

LONG = "A sentence of the running text goes on for some time, as the ones before and after it do. "
BUILT_IN = [
    "<html><body><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav><article>"
    "<h1>A title</h1><p>The first paragraph of some length, with words.</p><p>The second one.</p></article>"
    "<footer>All rights reserved.</footer></body></html>",
    "<html><body><header>Site<a href='/'>home</a></header><div class='ad'>Buy now</div><article><h1>On things</h1><p>" + LONG +
    "<p>Short.<h2>More</h2><p>" + LONG * 3 + "<ul><li>one</li><li>two of them</li></ul><blockquote>" + LONG + "</blockquote><p>" +
    LONG * 2 + "</article><aside><a href='/x'>Also read</a></aside><footer>Contact</footer></body></html>"]


def variants(blocks: list[Block], rng: np.random.Generator, n: int = VARIANTS) -> Iterator[tuple[list[Block], list[float]]]:
    """The page itself with its labels, then n versions that keep the labels of
    its blocks: other containers around the article, wrappers around the page,
    sections with open names and headers inside the article; boilerplate put
    between and comments put behind is no main text."""
    labels = teacher(blocks).tolist()
    yield blocks, labels
    names, tags, loose = sorted(NEVER_WORDS), sorted(NEVER - {"head", "input", "option"}), sorted(OPEN_WORDS)
    places, named = ["main", "article", "article", "section", "div", "div"], [*sorted(MAIN_WORDS), "page", "col", "inner", "region"]
    wrappers = [("div", ("content", "sidebar", "wrap")), ("div", ("has", "sidebar")), ("div", ("page", "header", "fixed")),
                ("form", ("aspnet", "form")), ("div", ("site", "container")), ("div", ("layout", "with", "menu"))]
    pick = lambda xs: xs[rng.integers(len(xs))]
    short = [b.text[:60] for b in blocks]
    for _ in range(n):
        box = (pick(places), frozenset(pick(named) for _ in range(int(rng.integers(0, 3)))))
        page = [b._replace(path=tuple(box if t in MAIN else (t, w) for t, w in b.path)) for b in blocks]
        marks = list(labels)
        new = 0
        for _ in range(int(rng.integers(0, 3))):            # sections and headers of the article itself
            at = int(rng.integers(len(page)))
            new -= 1
            section = (pick(["section", "div"]), frozenset([pick(loose), pick(["work", "engines", "part", "intro"])]))
            for i in range(at, min(len(page), at + int(rng.integers(1, 5)))):
                b = page[i]
                if not marks[i]:
                    break
                if b.path and b.path[-1][0] in HEADINGS and rng.random() < 0.5:
                    page[i] = b._replace(path=(*b.path[:-1], ("header", frozenset()), b.path[-1]), serials=(*b.serials[:-1], new, *b.serials[-1:]))
                elif len(b.text) >= PROSE or b.path and b.path[-1][0] in HEADINGS:
                    page[i] = b._replace(path=(*b.path[:-1], section, *b.path[-1:]), serials=(*b.serials[:-1], new, *b.serials[-1:]))
        if rng.random() < 0.4:                              # a site builder's layout: every block in an element of its own
            built = frozenset([pick(loose), pick(loose), pick(["builder", "editor", "column", "text", "element"])])
            for i, b in enumerate(page):
                if marks[i] and (len(b.text) >= PROSE or b.path and b.path[-1][0] in HEADINGS):
                    new -= 1
                    page[i] = b._replace(path=(*b.path[:-1], ("div", built), *b.path[-1:]), serials=(*b.serials[:-1], new, *b.serials[-1:]))
        if rng.random() < 0.4:
            tag, words = pick(wrappers)
            new -= 1
            for i, b in enumerate(page):
                k = sum(t in ("html", "body") for t, _ in b.path)
                page[i] = b._replace(path=(*b.path[:k], (tag, frozenset(words)), *b.path[k:]), serials=(*b.serials[:k], new, *b.serials[k:]))
        for _ in range(int(rng.integers(1, 6))):
            at = int(rng.integers(len(page) + 1))
            around = page[min(at, len(page) - 1)] if page else None
            odd = (pick(tags), frozenset()) if rng.random() < 0.4 else (pick(["div", "section"]), frozenset([pick(names)]))
            if rng.random() < 0.2:
                odd = ("article", frozenset([pick(sorted(TEASER))]))
            new -= 1
            for _ in range(int(rng.integers(1, 4))):
                page.insert(at, Block(pick(short), (*around.path, odd), float(rng.random() < 0.3), (*around.serials, new)))
                marks.insert(at, 0.0)
        yield page, marks


def fit(pages: list[str]) -> dict:
    rng = np.random.default_rng(3)
    words: dict[str, int] = {}
    examples = []
    n = max(VARIANTS, TRAIN_PAGES // (len(pages) + len(BUILT_IN)))
    for page in [*pages, *BUILT_IN]:
        blocks = blocks_of(page)
        if blocks:
            # long pages are cut into runs for training only
            for v, labels in variants(blocks, rng, n):
                x, y = vectors(v, words), np.array(labels)
                examples += [(x[i:i + 60], y[i:i + 60]) for i in range(0, len(v), 60)]
    return train(examples)


# ---- pages to text --------------------------------------------------------

def running(b: Block) -> bool:
    return len(b.text) * (1 - b.linked) >= PROSE


def choose(blocks: list[Block], p: np.ndarray) -> list[bool]:
    """The labeller's choice, but for blocks in elements that are never main
    text, and for running text where the paths have main text; of the rest it
    must be sure to leave out what the paths call main."""
    return [k < MOSTLY and (q > (1 - SURE if likely else 0.5) or bool(likely) and running(b))
            for b, k, q, likely in zip(blocks, judged(blocks)[0], p, teacher(blocks))]


def texts(model: dict, pages: list[str | None]) -> list[str]:
    words = worker_state("html").setdefault("words", {})
    parsed = [blocks_of(p or "") for p in pages]
    out = [""] * len(pages)
    order = sorted((i for i in range(len(pages)) if parsed[i]), key=lambda i: len(parsed[i]))
    for at in range(0, len(order), BATCH):
        part = order[at:at + BATCH]
        x, mask = padded([vectors(parsed[i], words) for i in part])
        p, _ = label(model, x, mask)
        for j, i in enumerate(part):
            keep = choose(parsed[i], p[:, j])
            out[i] = "\n".join(b.text for b, k in zip(parsed[i], keep) if k)
    return out


def _extract(model: dict, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                s = b.slice(at, 512)
                yield pa.RecordBatch.from_arrays(
                    [*s.columns[:-1], pa.array(texts(model, s.column(s.num_columns - 1).to_pylist()), pa.string())], schema=schema)
    return run


def sample_pages(pages: DataFrame, html: str = "html", limit: int = TRAIN_PAGES) -> list[str]:
    """About `limit` pages (all, if fewer): those whose hash is in the lowest
    limit / rows of all hashes, equal pages once, in the order of their hashes.
    Only they leave the tasks, whatever the number of tasks."""
    share = min(1.0, limit / max(1, pages.count()))
    top = min(int(share * (1 << 64)) - (1 << 63), (1 << 63) - 1)
    page = F.col(html).cast("string")
    taken = pages.where(F.col(html).isNotNull()).select(F.xxhash64(page).alias("h"), page.alias("page")) \
        .where(F.col("h") <= top).dropDuplicates(["h"])
    return [r["page"] for r in sorted(taken.collect(), key=lambda r: r["h"])]


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"),
            train_pages: int = TRAIN_PAGES) -> DataFrame:
    """One row per page: the kept columns and ``text``."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema
    model = fit(sample_pages(pages, html, train_pages))
    rows = pages.select(*keep, F.col(html).cast("string").alias("text"))
    out = T.StructType(rows.schema.fields[:-1]).add("text", T.StringType())
    return rows.mapInArrow(_extract(model, to_arrow_schema(out)), out)
