"""Main text of web pages by a recurrent block labeller.

A page is parsed into leaf blocks in page order: runs of text between block-level tags. Each leaf becomes a
vector: learned embeddings of its tag path (tags and class, id and role words, hashed) and of its words
(hashed), averaged, and a few figures (length, share of link text, place). A bidirectional LSTM in numpy
reads a page's leaves, so every label may draw on the whole document, and labels each as main text or not.

The labeller is trained on pages whose labels are known by construction (``training_pages``): templates of
page furniture around articles, in many mark-ups, filled with words of a bounded sample (``SAMPLE``) of the
pages at hand; the same template parts appear with and without telling tags and names. Training runs in one
task; pages are then labelled where they lie and only the weights travel.

Defined results: a null or empty page has no leaves and the empty text; mark-up that is never closed ends
with the page; repeated rows are labelled alike; sequences are never cut, however long; an empty table gives
no rows. Only ``page_id``, ``url`` and ``html`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.llm.common import read, small_batches

#: Bounded training input: pages sampled for their words, pages made of them, passes.
SAMPLE, MADE, EPOCHS, SEED = 200, 2500, 5, 7
PATH_BUCKETS, WORD_BUCKETS, PATH_DIM, WORD_DIM, HIDDEN = 512, 2048, 12, 8, 16
FIGURES = 6
#: Share of training leaves that are seen without their words, so that no single word decides.
BLANK = 0.25
#: Leaves labelled together in one batch of pages.
BATCH_LEAVES = 20_000

#: Tags whose text is never shown as text.
UNSHOWN = frozenset("script style template noscript head title iframe object svg math select option textarea button".split())
#: Tags that do not end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that a new one of the same group closes.
ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
#: Block tags that close an open paragraph.
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class Leaf(NamedTuple):
    path: tuple[str, ...]  #: tags and attribute words from the outside in
    text: str
    link_chars: int


class LeafParser(HTMLParser):
    """Leaves of a page, in order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.leaves: list[Leaf] = []
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.parts: list[str] = []
        self.links = self.anchors = self.unshown = 0

    def end_block(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                path = tuple(w for tag, words in self.stack if tag not in INLINE for w in (tag, *words))
                self.leaves.append(Leaf(path, text, min(self.links, len(text))))
            self.parts, self.links = [], 0

    def pop(self, to: int) -> None:
        while len(self.stack) > to:
            tag, _ = self.stack.pop()
            self.unshown -= tag in UNSHOWN
            self.anchors -= tag == "a"

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in INLINE and tag in VOID:
            return
        if tag not in INLINE:
            self.end_block()
            if tag == "body":  # a head or title that is never closed ends here
                self.pop(next((i for i, x in enumerate(self.stack) if x[0] in ("head", "title")), len(self.stack)))
            close = ENDS.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
            if close:
                for i in range(len(self.stack) - 1, -1, -1):
                    if self.stack[i][0] in close:
                        self.pop(i)
                        break
                    if self.stack[i][0] not in INLINE:
                        break
        if tag in VOID:
            return
        words = []
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                words += value.lower().replace("-", " ").replace("_", " ").split()
        self.unshown += tag in UNSHOWN
        self.anchors += tag == "a"
        self.stack.append((tag, tuple(words)))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.end_block()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self.pop(i)
                return

    def handle_data(self, data):
        if not self.unshown:
            self.parts.append(data)
            if self.anchors:
                self.links += len(data)


def leaves(html: str | None) -> list[Leaf]:
    """Leaf blocks of a whole page."""
    if not html:
        return []
    p = LeafParser()
    p.feed(html)
    p.close()
    p.end_block()
    return p.leaves


@lru_cache(maxsize=200_000)
def _word_bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % WORD_BUCKETS


@lru_cache(maxsize=50_000)
def _path_buckets(path: tuple[str, ...]) -> frozenset[int]:
    """Places of the words of a path, and of its last two: what holds the leaf tells most."""
    words = [*path, *(f"{w} <" for w in path[-1:]), *(f"{w} <<" for w in path[-2:-1])]
    return frozenset(zlib.crc32(w.encode("utf-8", "replace")) % PATH_BUCKETS for w in words)


class Vectors(NamedTuple):
    """Leaves of several pages, ready for the network: bags of hashed places with their leaf, and figures."""

    path: np.ndarray
    path_leaf: np.ndarray
    word: np.ndarray
    word_leaf: np.ndarray
    figures: np.ndarray
    pages: np.ndarray  #: leaves up to each page


def vectorised(pages: list[list[Leaf]], blank: random.Random | None = None) -> Vectors:
    """Vectors of ``pages``; in training, ``blank`` picks leaves whose words are left out."""
    path, path_leaf, word, word_leaf, figures = [], [], [], [], []
    n = 0
    for page in pages:
        total = len(page)
        for k, leaf in enumerate(page):
            own = _path_buckets(leaf.path)
            path += own
            path_leaf += [n] * len(own)
            words = leaf.text.split()
            own = set() if blank and blank.random() < BLANK else set(map(_word_bucket, words))
            word += own
            word_leaf += [n] * len(own)
            chars = len(leaf.text)
            figures.append((np.log1p(len(words)) / 4, leaf.link_chars / chars, k / total, 1 - k / total, leaf.text[-1] in ".!?…", 1 / (1 + len(leaf.path))))
            n += 1
    at = np.cumsum([0, *map(len, pages)])
    return Vectors(np.array(path, np.int64), np.array(path_leaf, np.int64), np.array(word, np.int64), np.array(word_leaf, np.int64),
                   np.array(figures, np.float32).reshape(-1, FIGURES), at)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _means(table: np.ndarray, at: np.ndarray, leaf: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean embedding per leaf (leaves without any: 0) and one over the counts. ``leaf`` is sorted."""
    count = np.bincount(leaf, minlength=n)
    out = np.zeros((n, table.shape[1]), np.float32)
    some = np.flatnonzero(count)
    if len(some):
        out[some] = np.add.reduceat(table[at], (np.cumsum(count) - count)[some], axis=0)
    weight = (1 / np.maximum(count, 1)).astype(np.float32)
    return out * weight[:, None], weight


class Labeller:
    """Embeddings, a forward and a backward LSTM, and a logistic output."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        size = PATH_DIM + WORD_DIM + FIGURES
        make = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.w = {"path": rng.standard_normal((PATH_BUCKETS, PATH_DIM)).astype(np.float32) * 0.3,
                  "word": rng.standard_normal((WORD_BUCKETS, WORD_DIM)).astype(np.float32) * 0.3}
        for way in "fb":
            self.w[f"x{way}"], self.w[f"h{way}"] = make(size, 4 * HIDDEN), make(HIDDEN, 4 * HIDDEN)
            self.w[f"c{way}"] = np.zeros(4 * HIDDEN, np.float32)
            self.w[f"c{way}"][HIDDEN : 2 * HIDDEN] = 1.0  # remember at first
        self.w["out"], self.w["bias"] = make(2 * HIDDEN + size, 1), np.zeros(1, np.float32)
        self.moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.w.items()}
        self.steps = 0

    def _run(self, way: str, x: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """Hidden states over ``x`` (steps, pages, size); past a page's end the state stays as it is."""
        steps, pages, _ = x.shape
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        out = np.zeros((steps, pages, HIDDEN), np.float32)
        into = x.reshape(-1, x.shape[2]) @ self.w[f"x{way}"] + self.w[f"c{way}"]
        into = into.reshape(steps, pages, -1)
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            g = into[t] + h @ self.w[f"h{way}"]
            gates, new = _sigmoid(g[:, : 3 * HIDDEN]), np.tanh(g[:, 3 * HIDDEN :])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            c2 = f * c + i * new
            squashed = np.tanh(c2)
            on = mask[t][:, None]
            if keep is not None:
                keep.append((t, h, c, i, f, o, new, squashed, on))
            c = np.where(on, c2, c)
            h = np.where(on, o * squashed, h)
            out[t] = h
        return out

    def forward(self, v: Vectors, keep: dict | None = None) -> np.ndarray:
        """Probability that each leaf is main text."""
        n = len(v.figures)
        p, pw = _means(self.w["path"], v.path, v.path_leaf, n)
        q, qw = _means(self.w["word"], v.word, v.word_leaf, n)
        flat = np.concatenate([p, q, v.figures], axis=1)
        long = np.diff(v.pages)
        steps = int(long.max(initial=0))
        page = np.repeat(np.arange(len(long)), long)
        step = np.arange(n) - v.pages[:-1][page]
        x = np.zeros((steps, len(long), flat.shape[1]), np.float32)
        x[step, page] = flat
        mask = np.zeros((steps, len(long)), bool)
        mask[step, page] = True
        tapes = {"f": [], "b": []} if keep is not None else {"f": None, "b": None}
        states = [self._run(way, x, mask, tapes[way])[step, page] for way in "fb"]
        joint = np.concatenate([*states, flat], axis=1)
        y = _sigmoid(joint @ self.w["out"] + self.w["bias"])[:, 0]
        if keep is not None:
            keep.update(x=x, joint=joint, step=step, page=page, tapes=tapes, pw=pw, qw=qw)
        return y

    def train(self, v: Vectors, labels: np.ndarray, rate: float = 0.01) -> None:
        """One step of back-propagation through time on the mean cross-entropy, by Adam."""
        k: dict = {}
        y = self.forward(v, k)
        g = {name: np.zeros_like(w) for name, w in self.w.items()}
        dy = ((y - labels) / len(labels)).astype(np.float32)[:, None]
        g["out"], g["bias"] = k["joint"].T @ dy, dy.sum(axis=0)
        joint = dy @ self.w["out"].T
        flat = joint[:, 2 * HIDDEN :].copy()
        step, page, x = k["step"], k["page"], k["x"]
        for at, way in enumerate("fb"):
            up = np.zeros((*x.shape[:2], HIDDEN), np.float32)
            up[step, page] = joint[:, at * HIDDEN : (at + 1) * HIDDEN]
            dh, dc = np.zeros(up.shape[1:], np.float32), np.zeros(up.shape[1:], np.float32)
            dx = np.zeros_like(x)
            for t, h, c, i, f, o, new, squashed, on in reversed(k["tapes"][way]):
                total = np.where(on, up[t] + dh, 0)
                through = np.where(on, dc, 0) + total * o * (1 - squashed**2)
                dg = np.concatenate([through * new * i * (1 - i), through * c * f * (1 - f), total * squashed * o * (1 - o), through * i * (1 - new**2)], axis=1)
                g[f"x{way}"] += x[t].T @ dg
                g[f"h{way}"] += h.T @ dg
                g[f"c{way}"] += dg.sum(axis=0)
                dx[t] = dg @ self.w[f"x{way}"].T
                dh = np.where(on, dg @ self.w[f"h{way}"].T, dh)
                dc = np.where(on, through * f, dc)
            flat += dx[step, page]
        for name, at, leaf, part, weight in (("path", v.path, v.path_leaf, flat[:, :PATH_DIM], k["pw"]),
                                             ("word", v.word, v.word_leaf, flat[:, PATH_DIM : PATH_DIM + WORD_DIM], k["qw"])):
            part = part * weight[:, None]
            for d in range(part.shape[1]):
                g[name][:, d] = np.bincount(at, part[leaf, d], len(g[name]))
        self.steps += 1
        for name, d in g.items():
            m, s = self.moment[name]
            m += 0.1 * (d - m)
            s += 0.01 * (d * d - s)
            self.w[name] -= rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(s / (1 - 0.99**self.steps)) + 1e-6)


# Training pages: furniture around an article, in many mark-ups. Labels are known as each part is made.

#: Ways to open a region of each kind. Kinds but "main" are furniture.
REGIONS = {
    "main": ("article", "main", "section", 'div class="content"', 'div class="post-body"', 'div id="main-content"', 'div class="entry article"',
             'article class="story"', 'div class="text"', 'div class="article-body"', 'div role="main"', "div"),
    "menu": ("nav", 'div class="menu"', 'ul class="navigation"', 'div id="nav"', 'nav class="breadcrumb"', 'div class="topbar"', 'div role="navigation"', 'div class="nav-links"', "ul", "div"),
    "header": ("header", 'div class="header"', 'div id="masthead"', 'div class="site-header"', 'header class="banner"'),
    "footer": ("footer", 'div class="footer"', 'div id="footer"', 'div class="site-footer copyright"', 'div role="contentinfo"'),
    "sidebar": ("aside", 'div class="sidebar"', 'aside class="related"', 'div id="sidebar"', 'div class="widget"', 'section class="related-posts"', 'div class="recommended"'),
    "notice": ('div class="cookie-banner"', 'div class="notice"', 'div id="cookie-notice"', 'section class="consent"', 'div role="alert"', 'div class="newsletter popup"', 'p class="notice"', 'div class="cookie"'),
    "advert": ('div class="ad"', 'div class="ads"', 'div class="advert"', 'section class="sponsored"', 'div id="banner-ad"', 'div class="promo"', 'aside class="ad"', 'p class="ad"', 'div class="advertisement"'),
    "form": ("form", 'form class="search"', 'form id="login"', 'form class="subscribe"', 'div class="form"'),
    "comments": ('section class="comments"', 'div id="comments"', 'div class="comment-list"', 'ol class="comments"', 'div class="reader-comments"', 'section id="discussion"', 'div class="comment"'),
}
#: Set phrases of furniture; the words between come from the pages.
PHRASES = {
    "menu": ("Home", "About", "Contact", "News", "Login", "Archive", "Topics", "Menu", "Skip to content"),
    "header": ("Home", "Subscribe", "Search", "Sign in", "The daily"),
    "footer": ("© 2024 All rights reserved.", "Privacy policy", "Terms of use", "Imprint", "Contact us", "© ·"),
    "sidebar": ("Related articles", "Most read", "Popular posts", "Recommended for you", "See also", "Trending"),
    "notice": ("We use cookies to improve your experience.", "Accept all cookies", "This site uses cookies.", "Subscribe to our newsletter", "Please enable JavaScript."),
    "advert": ("Advertisement", "Sponsored", "Buy now", "Special offer", "Click here", "Ad"),
    "form": ("Email", "Name", "Search", "Password", "Send", "Your message", "Subscribe"),
    "comments": ("Comments", "Reply", "Leave a comment", "Posted by", "Great article, thanks!", "2 comments", "I disagree.", "Report"),
}


class _Maker:
    """One made page: its mark-up, and whether each leaf is main text."""

    def __init__(self, rng: random.Random, texts: list[list[str]]):
        self.rng, self.texts, self.out, self.labels = rng, texts, [], []

    def words(self, low: int, high: int) -> str:
        own = self.rng.choice(self.texts)
        n = self.rng.randint(low, high)
        at = self.rng.randrange(max(1, len(own) - n))
        return " ".join(own[at : at + n]).replace("&", "&amp;").replace("<", "&lt;") or "x"

    def leaf(self, tag: str, text: str, main: bool, close: bool = True) -> None:
        self.out.append(f"<{tag}>{text}" + (f"</{tag.split()[0]}>" if close else ""))
        self.labels.append(main)

    def region(self, kind: str) -> None:
        rng = self.rng
        opened = rng.choice(REGIONS[kind])
        self.out.append(f"<{opened}>")
        phrases = PHRASES[kind]
        text = lambda low, high: rng.choice(phrases) if rng.random() < 0.5 else self.words(low, high)
        if kind == "menu":
            inner = "" if opened.startswith(("ul", "ol")) else rng.choice(("ul", "ul", 'ul class="menu"', "div", ""))
            self.out.append(f"<{inner}>" if inner else "")
            tag = rng.choice(("li", "li", "li", "div"))
            for _ in range(rng.randint(2, 10)):
                body = text(1, 3)
                self.leaf(tag, f'<a href="/{rng.randrange(99)}">{body}</a>' if rng.random() < 0.9 else body, False)
            self.out.append(f"</{inner.split()[0]}>" if inner else "")
        elif opened.startswith("p ") or kind in ("notice", "advert", "footer", "header") and rng.random() < 0.6:
            self.out.append(self.words(3, 30) if rng.random() < 0.6 else text(2, 8))
            self.labels.append(False)
        else:
            for _ in range(rng.randint(1, 5)):
                tag = rng.choice(("p", "p", "div", "h3", "li", 'div class="comment"' if kind == "comments" else "span class=x" if kind == "form" else "p"))
                tag = "div" if tag.startswith("span") else tag
                body = text(1, 40 if kind == "comments" else 25)
                if kind in ("sidebar", "footer", "header") and rng.random() < 0.5:
                    body = f'<a href="#">{body}</a>'
                if kind == "form":
                    body = f'<label>{body}</label><input name="q">'
                self.leaf(tag, body, False)
        self.out.append(f"</{opened.split()[0]}>")

    def article(self) -> None:
        rng = self.rng
        opened = rng.choice(REGIONS["main"]) if rng.random() < 0.5 else "article"
        self.out.append(f"<{opened}>")
        if rng.random() < 0.85:
            self.leaf(rng.choice(("h1", "h1", "h2")), self.words(1, 12), True)
        plain = rng.random() < 0.4
        for _ in range(rng.choice((1, 2, 4, 8, 14, 30))):
            kind = rng.random() * (0.75 if plain else 1)
            if kind < 0.7:
                text = self.words(1, 4) if rng.random() < 0.35 else self.words(4, 90)
                if rng.random() < 0.15:
                    at = text.split()
                    text = " ".join([f"<{t}>{w}</{t.split()[0]}>" if rng.random() < 0.2 else w for w in at for t in [rng.choice(("b", "em", 'a href="#"'))]])
                self.leaf("p", text, True, close=rng.random() < 0.9)
            elif kind < 0.8:
                self.leaf("p", f"<b>{self.words(1, 12)}<br>", True, close=False)
            elif kind < 0.87:
                self.leaf("h2", self.words(1, 6), True)
            elif kind < 0.94:
                self.out.append("<ul>")
                for _ in range(rng.randint(1, 4)):
                    self.leaf("li", self.words(2, 15), True)
                self.out.append("</ul>")
            else:
                self.leaf("blockquote", self.words(4, 40), True)
            if rng.random() < 0.06:  # lines that a page repeats
                text = self.words(1, 8)
                for _ in range(rng.randint(2, 20)):
                    self.leaf("p", text, True)
            if rng.random() < 0.05:
                self.region(rng.choice(("advert", "sidebar", "notice", "form", "comments")))
        self.out.append(f"</{opened.split()[0]}>")

    def page(self) -> tuple[str, list[bool]]:
        rng = self.rng
        self.out.append('<!DOCTYPE html><html><head><meta charset="utf-8"><title>' + self.words(1, 9) + "</title><script>var t='</p>';</script></head><body>")
        wrap = rng.random() < 0.3
        if wrap:
            self.out.append(rng.choice(('<div class="wrapper">', '<div id="page">', "<div>")))
        before = [k for k in ("notice", "header", "menu", "advert", "form", "sidebar") if rng.random() < (0.75 if k == "menu" else 0.3)]
        if rng.random() < 0.3:
            rng.shuffle(before)
        for kind in before:
            self.region(kind)
        self.article()
        for kind in ("form", "advert", "comments", "sidebar", "notice", "menu", "footer"):
            if rng.random() < (0.8 if kind == "footer" else 0.5 if kind == "comments" else 0.25):
                self.region(kind)
        self.out.append("</div>" * wrap + "</body></html>")
        return "".join(self.out), self.labels


def training_pages(texts: list[list[str]], n: int = MADE, seed: int = SEED) -> list[tuple[list[Leaf], list[bool]]]:
    """``n`` made pages as leaves with labels; ``texts`` are lists of words to fill them with."""
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        html, labels = _Maker(rng, texts).page()
        found = leaves(html)
        if len(found) == len(labels):  # else a template opened a paragraph that swallowed its neighbour
            out.append((found, labels))
    return out


def fitted(texts: list[list[str]], made: int = MADE, epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """Weights of a labeller trained on made pages."""
    pages = training_pages(texts or [["text"]], made)
    rng = random.Random(SEED)
    model = Labeller()
    for epoch in range(epochs):
        pages.sort(key=lambda p: len(p[0]) + 3 * rng.random())  # like lengths together, so few steps are padding
        batches = [pages[at : at + 16] for at in range(0, len(pages), 16)]
        rng.shuffle(batches)
        for part in batches:
            model.train(vectorised([p for p, _ in part], rng), np.array([x for _, y in part for x in y], np.float32), 0.01 if epoch < epochs - 2 else 0.003)
    return model.w


def sampled_words(html: str | None) -> list[str]:
    """Words of a page's shown text, to fill templates with."""
    return [w for leaf in leaves(html) for w in leaf.text.split()]


def fit(pages: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Weights learned in one task from the words of ``sample`` pages, those with the smallest hashes of the id."""
    chosen = pages.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    rows = pages.select("page_id", "html").join(F.broadcast(chosen.distinct()), "page_id").select("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [w for batch in batches for html in batch.column(0).to_pylist() if (w := sampled_words(html))]
        w = fitted(sorted(texts))
        yield pa.record_batch({"name": pa.array(list(w)), "shape": pa.array([list(v.shape) for v in w.values()], pa.list_(pa.int32())),
                               "value": pa.array([v.tobytes() for v in w.values()], pa.binary())})

    got = rows.repartition(1).mapInArrow(run, "name string, shape array<int>, value binary").collect()
    return {r["name"]: np.frombuffer(r["value"], np.float32).reshape(r["shape"]) for r in got}


def labelled(model: Labeller, pages: list[list[Leaf]]) -> list[np.ndarray]:
    """Whether each leaf of each page is main text; pages of like length are run together."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * len(pages[order[end]]) <= BATCH_LEAVES:
            end += 1
        part = order[at:end]
        v = vectorised([pages[i] for i in part])
        y = model.forward(v) >= 0.5
        for k, i in enumerate(part):
            out[i] = y[v.pages[k] : v.pages[k + 1]]
        at = end
    return out


def extract(pages: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """``page_id, url, text, n_chars``: the leaves labelled as main text, joined by one space."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Labeller()
        model.w = weights
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                parsed = [leaves(x.as_py()) for x in part.column("html")]
                texts = [" ".join(leaf.text for leaf, keep in zip(p, y, strict=True) if keep) for p, y in zip(parsed, labelled(model, parsed), strict=True)]
                yield pa.record_batch([part.column("page_id").cast(pa.int64()), part.column("url").cast(pa.string()), pa.array(texts, pa.string()),
                                       pa.array([len(x) for x in texts], pa.int64())], schema=schema)

    return small_batches(pages).select("page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op5_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = read(spark, sf_dir, "pages")
    return extract(pages, fit(pages))
