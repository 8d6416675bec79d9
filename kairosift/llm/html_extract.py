"""Operator 11: main text of web pages by a recurrent block labeller.

A page is the sequence of its leaf blocks (see ``page_blocks``). Each block is read as hashed vectors of the tokens of its tag path
(names, classes and ids of all elements around it, and its own element), the mean of the hashed vectors of its words, and
a few shares (length, links, punctuation, digits). A bidirectional LSTM in numpy runs over the whole sequence, so every
block is judged with all of its page; a logistic output says whether the block is main text.

There are no labels for pages, so the labeller is trained here on two kinds of pages with known blocks: given ones that
mark their article themselves, and generated ones, which put blocks of the given pages into layouts of their own (menus,
headers, footers, sidebars, notices, adverts, forms and reader comments around and within the article, with named and with
nameless containers). Of the given pages about ``sample`` are taken by a hash of page_id and url, twice as many at most,
each as a whole and none over ``longest`` characters: a documented bound of the fit. All pages are labelled, whole.

Each page is labelled in the task that reads it: no shuffle; the weights (under 2 MB) go with the job.

Defined cases
* null, empty or blockless page: empty text, 0 characters; null page_id or url is kept;
* repeated rows give equal rows; a table without any text: every text is empty; other columns are not read;
* broken markup is read as far as it goes: an unclosed script takes the rest, other unclosed elements take nothing.
"""

from __future__ import annotations

import re
import string
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_slices, table
from .page_blocks import PATHS, WORDS, Block, blocks, number

_SENTENCE = re.compile(r"[.,;:!?]")
_DIGIT = re.compile(r"[0-9]")
STATS = 6


class _WordNumbers(dict):
    """Number of each word met, kept in a worker up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        got = self[word] = zlib.crc32(word.lower().strip(string.punctuation).encode("utf-8", "surrogatepass")) % WORDS
        return got


_NUMBERS = _WordNumbers()


class Features(NamedTuple):
    """The blocks of some pages, page after page."""

    path: np.ndarray  # tokens of all blocks
    path_at: np.ndarray  # where each block's begin; none is without
    word: np.ndarray
    word_at: np.ndarray
    stats: np.ndarray
    starts: np.ndarray  # where each page's blocks begin; pages by falling length
    lengths: np.ndarray


def features(pages: list[list[Block]]) -> Features:
    """Of pages by falling length, none of them empty."""
    path, path_n, word, word_n, stats = [], [], [], [], []
    for page in pages:
        for b in page:
            tokens = [*b.path, b.own]
            path += tokens
            path_n.append(len(tokens))
            numbers = [*map(_NUMBERS.__getitem__, b.text.split())]
            word += numbers
            word_n.append(len(numbers))
            size = len(b.text)
            stats.append((np.log1p(len(numbers)) / 4, b.links, 10 * len(_SENTENCE.findall(b.text)) / size, 10 * len(_DIGIT.findall(b.text)) / size, float(b.text[-1] in ".!?"), 1.0))
    lengths = np.array([len(p) for p in pages])
    begins = lambda n: np.cumsum(n) - n
    return Features(np.array(path), begins(np.array(path_n)), np.array(word), begins(np.array(word_n)), np.array(stats), begins(lengths), lengths)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Lstm:
    """One direction over sequences of falling length, laid behind one another: step t has the first sequences alone."""

    def __init__(self, f: Features, back: bool):
        self.active = np.searchsorted(-f.lengths, -np.arange(f.lengths[0]), side="left")  # sequences longer than t
        self.rows = [f.starts[:a] + (f.lengths[:a] - 1 - t if back else t) for t, a in enumerate(self.active)]

    def forward(self, x: np.ndarray, turn: np.ndarray) -> np.ndarray:
        """x: what the input gives to the four gates of each block; ``turn``: from the state to the gates."""
        size = turn.shape[0]
        h, c = np.zeros((self.active[0], size)), np.zeros((self.active[0], size))
        out, self.kept, self.turn = np.empty((len(x), size)), [], turn
        for a, rows in zip(self.active, self.rows):
            h0, c0 = h[:a], c[:a]
            z = x[rows] + h0 @ turn
            gates = _sigmoid(z[:, : 3 * size])
            i, f, o, g = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :], np.tanh(z[:, 3 * size :])
            c = f * c0 + i * g
            t = np.tanh(c)
            h = o * t
            out[rows] = h
            self.kept.append((h0, c0, i, f, o, g, t))
        return out

    def backward(self, dout: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The gradients of x and ``turn``."""
        size = self.turn.shape[0]
        dx, dturn = np.empty((len(dout), 4 * size)), np.zeros_like(self.turn)
        dh, dc = np.zeros((self.active[0], size)), np.zeros((self.active[0], size))
        for a, rows, (h0, c0, i, f, o, g, t) in zip(self.active[::-1], self.rows[::-1], self.kept[::-1]):
            d = dh[:a] + dout[rows]
            e = dc[:a] + d * o * (1 - t * t)
            dz = np.concatenate([e * g * i * (1 - i), e * c0 * f * (1 - f), d * t * o * (1 - o), e * i * (1 - g * g)], 1)
            dx[rows] = dz
            dturn += h0.T @ dz
            dh[:a], dc[:a] = dz @ self.turn.T, e * f
        return dx, dturn


class Labeller:
    """The weights, and what is done with them."""

    def __init__(self, seed: int = 11, vector: int = 12, size: int = 20):
        rng = np.random.Generator(np.random.PCG64(seed))
        d = 2 * vector + STATS
        draw = lambda *shape: rng.standard_normal(shape) / np.sqrt(shape[0])
        self.w = {"path": rng.standard_normal((PATHS, vector)) * 0.3, "word": rng.standard_normal((WORDS, vector)) * 0.3, "out": draw(2 * size) * 0.5, "bias": np.zeros(1)}
        for way in ("ahead", "back"):
            self.w[f"in_{way}"], self.w[f"turn_{way}"], self.w[f"gate_{way}"] = draw(d, 4 * size), draw(size, 4 * size), np.repeat([0.0, 1.0, 0.0, 0.0], size)

    def _run(self, f: Features):
        w = self.w
        path_n, word_n = np.diff(f.path_at, append=len(f.path)), np.diff(f.word_at, append=len(f.word))
        x = np.concatenate([np.add.reduceat(w["path"][f.path], f.path_at) / np.sqrt(path_n)[:, None], np.add.reduceat(w["word"][f.word], f.word_at) / word_n[:, None], f.stats], 1)
        runs = {way: Lstm(f, way == "back") for way in ("ahead", "back")}
        h = np.concatenate([runs[way].forward(x @ w[f"in_{way}"] + w[f"gate_{way}"], w[f"turn_{way}"]) for way in runs], 1)
        return x, h, runs, path_n, word_n

    def probability(self, f: Features) -> np.ndarray:
        """For each block, that it is main text."""
        return _sigmoid(self._run(f)[1] @ self.w["out"] + self.w["bias"])

    def gradients(self, f: Features, truth: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean logistic loss of the blocks and its gradient for every weight."""
        w = self.w
        x, h, runs, path_n, word_n = self._run(f)
        p = _sigmoid(h @ w["out"] + w["bias"])
        loss = -float(np.log(np.where(truth, p, 1 - p) + 1e-12).mean())
        dz = (p - truth) / len(p)
        g = {"out": h.T @ dz, "bias": dz.sum(keepdims=True)}
        dh, dx, size = np.outer(dz, w["out"]), np.zeros_like(x), len(w["out"]) // 2
        for n, way in enumerate(runs):
            d, g[f"turn_{way}"] = runs[way].backward(dh[:, n * size : (n + 1) * size])
            g[f"in_{way}"], g[f"gate_{way}"] = x.T @ d, d.sum(0)
            dx += d @ w[f"in_{way}"].T
        v = w["path"].shape[1]
        for name, ids, n, part in (("path", f.path, path_n, dx[:, :v] / np.sqrt(path_n)[:, None]), ("word", f.word, word_n, dx[:, v : 2 * v] / word_n[:, None])):
            g[name] = np.zeros_like(w[name])
            np.add.at(g[name], ids, np.repeat(part, n, axis=0))
        return loss, g

    def fit(self, pages: list[tuple[list[Block], list[bool]]], epochs: int = 6, batch: int = 32, rate: float = 0.01, seed: int = 12) -> list[float]:
        """Adam over the labelled pages; gives the mean loss of each epoch."""
        pages = [p for p in pages if p[0]]
        rng = np.random.Generator(np.random.PCG64(seed))
        m, v, step, losses = {k: np.zeros_like(x) for k, x in self.w.items()}, {k: np.zeros_like(x) for k, x in self.w.items()}, 0, []
        for epoch in range(epochs):
            order, total = rng.permutation(len(pages)), []
            for at in range(0, len(pages), batch):
                some = sorted((pages[i] for i in order[at : at + batch]), key=lambda p: -len(p[0]))
                loss, g = self.gradients(features([p[0] for p in some]), np.concatenate([p[1] for p in some]).astype(float))
                total.append(loss)
                step += 1
                for k, d in g.items():
                    m[k] += 0.1 * (d - m[k])
                    v[k] += 0.001 * (d * d - v[k])
                    self.w[k] -= rate / (1 + epoch) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
            losses.append(float(np.mean(total)) if total else 0.0)
        return losses

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page, whether each of its blocks is main text."""
        out = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: -len(pages[i]))
        if order:
            p = self.probability(features([pages[i] for i in order])) >= 0.5
            for i, part in zip(order, np.split(p, np.cumsum([len(pages[i]) for i in order])[:-1])):
                out[i] = part
        return out


#: What sites write around their articles, for the generated pages.
PHRASES = [
    "Home", "Menu", "Search", "Contact us", "About", "Login", "Subscribe", "Read more", "Share", "Next", "Previous", "Related articles", "Most read", "Advertisement", "Sponsored",
    "We use cookies to improve this site.", "Accept all", "Sign up for our newsletter", "Your e-mail address", "Leave a comment", "Reply", "All rights reserved.", "Privacy policy", "Terms of use",
    "Back to top", "Follow us", "Tags", "Categories", "Archive", "3 comments", "Posted by", "Please enable JavaScript.", "Free shipping today", "Buy now", "Print this page", "Loading",
]
_HOLDS = ["<article>", "<main>", "<main><article>", '<div class="content">', '<div id="main-content">', '<div class="post-body entry">', '<section class="story">', '<div class="article-text">', '<div role="main">',
          "<table><tr><td class='body'>", "<div>", "<div class='{junk}'>", "<section><div class='{junk}'>", '<article class="post">', '<div id="page"><article>']
_ASIDES = ["<aside>", '<div class="sidebar">', '<div id="right-rail" class="widget">', '<section class="related">', '<div class="share social">', '<div class="{junk}">', '<ul class="tags">']
_ADS = ['<div class="ad">', '<div class="advert banner">', '<section id="sponsored">', '<div class="promo-box">', '<ins class="adsbygoogle"><div>', '<aside class="ad-slot">']
_NOTICES = ['<div class="cookie-notice">', '<div class="notice">', '<div id="consent" role="alert">', '<section class="alert message">', '<dialog>', '<div class="gdpr overlay">']
_COMMENTS = ['<section id="comments">', '<div class="comments">', '<ol class="comment-list">', '<div id="disqus-thread" class="responses">', '<section class="reader-comments discussion">']


#: A private character: it tells main text from the rest after the scan of a generated page.
_MARK = "\ue000"


class Layouts:
    """Pages made of blocks of given texts, with the truth of each block."""

    def __init__(self, long_: list[str], short: list[str], seed: int):
        self.rng = np.random.Generator(np.random.PCG64(seed))
        self.long, self.short = long_, short or long_

    def one(self, items: list):
        return items[int(self.rng.integers(len(items)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def _say(self, text: str, main: bool = False) -> str:
        text = text.replace(_MARK, "").replace("&", "&amp;").replace("<", "&lt;")
        return f"{_MARK}{text}" if main else text

    def _words(self) -> str:
        return self._say(self.one(PHRASES) if self.chance(0.4) else self.one(self.short) if self.chance(0.7) else self.one(self.long))

    def _open(self, holder: str) -> tuple[str, str]:
        holder = holder.replace("{junk}", "".join(self.one(list(string.ascii_lowercase)) for _ in range(6)))
        return holder, "".join(f"</{n}>" for n in re.findall(r"<(\w+)", holder)[::-1])

    def _items(self, most: int = 9) -> str:
        kind = self.rng.integers(3)
        each = [self._words() for _ in range(int(self.rng.integers(1, most)))]
        if kind == 0:
            return "<ul>" + "".join(f'<li><a href="/x">{w}</a></li>' for w in each) + "</ul>"
        return "".join(f"<p>{w}</p>" for w in each[:3]) if kind == 1 else " ".join(f'<a href="/x">{w}</a>' for w in each)

    def _in(self, holder: str, inside: str) -> str:
        a, b = self._open(holder)
        return a + inside + b

    def _menu(self) -> str:
        return self._in(self.one(["<nav>", "<header>", "<header><nav>", '<div class="menu navbar">', '<div id="top" role="navigation">', '<ul class="breadcrumbs">', '<div class="header">']), self._items())

    def _form(self) -> str:
        fields = "".join(f"<label>{self._words()}<input name='x'></label><br>" for _ in range(int(self.rng.integers(1, 4))))
        inside = f"<p>{self._words()}</p>{fields}<button>{self._words()}</button>"
        return self._in(self.one(["<form>", '<form class="newsletter">', '<div class="subscribe"><form>', '<form id="search">', '<div class="login-box"><form>']), inside)

    def _comments(self) -> str:
        each = "".join(self._in(self.one(['<div class="comment">', "<article>", "<li>", '<article class="comment">']), f"<b>{self._words()}</b><p>{self._say(self.one(self.long))}</p>") for _ in range(int(self.rng.integers(1, 5))))
        return self._in(self.one(_COMMENTS), ("<h3>" + self._words() + "</h3>" if self.chance(0.6) else "") + each)

    def _aside(self) -> str:
        kind = int(self.rng.integers(4))
        if kind == 0:
            return self._in(self.one(_ADS), self._words())
        if kind == 1:
            return self._in(self.one(_NOTICES), f"<p>{self._words()}</p>")
        return self._form() if kind == 2 else self._in(self.one(_ASIDES), f"<h3>{self._words()}</h3>{self._items(5)}" if self.chance(0.5) else self._items(6))

    def _article(self) -> str:
        parts = [f"<h1>{self._say(self.one(self.short), True)}</h1>"] if self.chance(0.8) else []
        for _ in range(int(self.rng.integers(1, 12))):
            text = self._say(self.one(self.long) if self.chance(0.85) else self.one(self.short), True)
            kind = int(self.rng.integers(9))
            parts.append(f"<h2>{text}</h2>" if kind == 0 else f"<blockquote>{text}</blockquote>" if kind == 1 else f"<ul><li>{text}</li></ul>" if kind == 2 else f"<p><b>{text}</b><br>" if kind == 3 else f"<p>{text}</p>")
            if self.chance(0.08):
                parts.append(self._aside())
        if self.chance(0.1):
            parts.append(self._comments())
        return self._in(self.one(_HOLDS), "".join(parts))

    def page(self) -> tuple[list[Block], list[bool]]:
        before = [f() for f, p in ((self._menu, 0.8), (self._aside, 0.5), (self._menu, 0.3), (self._aside, 0.2)) if self.chance(p)]
        after = [f() for f, p in ((self._aside, 0.3), (self._comments, 0.4), (self._form, 0.3), (self._aside, 0.3)) if self.chance(p)]
        if self.chance(0.85):
            after.append(self._in(self.one(["<footer>", "<footer>", '<div class="footer">', '<div id="bottom" class="copyright">']), self._items(4) if self.chance(0.4) else f"&copy; {self._words()} &middot; {self._words()}"))
        found = blocks("<body>" + "".join(before) + self._article() + "".join(after) + "</body>")
        return [b._replace(text=b.text.replace(_MARK, "") or "x") for b in found], [_MARK in b.text for b in found]



def own_labels(page: str) -> tuple[list[Block], list[bool]] | None:
    """The blocks of a page that marks its article, and which of them are in it; None if it doesn't."""
    found = blocks(page)
    inside, other = number("e:article", PATHS), {number(f"e:{n}", PATHS) for n in ("nav", "aside", "footer", "form")}
    labels = [inside in b.path and not (other & b.path) for b in found]
    return (found, labels) if any(labels) and not all(labels) else None


def trained(pages: list[str], generated: int = 600, seed: int = 7) -> Labeller:
    """A labeller fitted on the given pages that mark their articles and on as many generated ones as said."""
    own = [x for p in pages if (x := own_labels(p))]
    parts = [b for p in pages for b in blocks(p)]
    long_ = sorted({b.text for b in parts if b.text.count(" ") >= 12})
    short = sorted({b.text for b in parts if b.text.count(" ") < 12})
    out = Labeller()
    if long_ or short:
        layouts = Layouts(long_ or short, short, seed)
        out.fit([*own, *[layouts.page() for _ in range(generated)]])
    return out


def fitted(pages: DataFrame, sample: int = 300, longest: int = 100_000) -> Labeller:
    """A labeller for the table ``pages`` (page_id, url, html), from a bounded sample of it."""
    n = pages.count()
    some = pages.where(F.pmod(F.xxhash64("page_id", "url"), F.lit(max(n, 1))) < sample).where(F.length("html").between(1, longest))
    return trained(sorted(some.select("html").limit(2 * sample).toArrow()["html"].to_pylist()))


TEXTS = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_blocks", T.LongType())])


def _texts(weights: dict[str, np.ndarray]):
    def run(batches):
        labeller = Labeller()
        labeller.w = weights
        for batch in small_slices(batches, 256):
            pages = [blocks(p.as_py()) for p in batch.column(2)]
            texts = ["\n".join(b.text for b, kept in zip(page, main) if kept) for page, main in zip(pages, labeller.label(pages))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(p) for p in pages], pa.int64())], names=TEXTS.names)

    return run


def extract(pages: DataFrame, labeller: Labeller | None = None) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks) of every row of ``pages`` (page_id, url, html, any more): its main text, and of how many blocks it was chosen."""
    labeller = labeller or fitted(pages)
    weights = {k: v.astype(np.float32) for k, v in labeller.w.items()}
    return pages.selectExpr("cast(page_id as long) AS page_id", "cast(url as string) AS url", "html").mapInArrow(_texts(weights), TEXTS)


def op11_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
