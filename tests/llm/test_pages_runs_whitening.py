"""Operators 11 to 13 against brute force, held-out accuracy and odd tables."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kairosift.llm import html_extract, page_blocks, whitening, word_runs
from kairosift.llm.common import table

SF = "/root/testdata/sf0.001"


# Operator 11


def test_gradients():
    layouts = html_extract.Layouts(["a long text of words, and more.", "another of them."], ["short", "x y"], 3)
    pages = sorted([layouts.page() for _ in range(4)], key=lambda p: -len(p[0]))
    labeller, f = html_extract.Labeller(), html_extract.features([p[0] for p in pages])
    truth = np.concatenate([p[1] for p in pages]).astype(float)
    g = labeller.gradients(f, truth)[1]
    for name, w in labeller.w.items():
        at = np.unravel_index(np.abs(g[name]).argmax(), w.shape)
        losses = []
        for step in (1e-6, -1e-6):
            w[at] += step
            losses.append(labeller.gradients(f, truth)[0])
            w[at] -= step
        assert g[name][at] == pytest.approx((losses[0] - losses[1]) / 2e-6, rel=1e-4)


@pytest.fixture(scope="module")
def labeller(spark):
    return html_extract.fitted(table(spark, SF, "pages"))


def test_held_out_layouts(spark, labeller):
    pages = [r.html for r in table(spark, SF, "pages").collect() if r.html]
    parts = [b.text for p in pages for b in page_blocks.blocks(p)]
    layouts = html_extract.Layouts([t for t in parts if t.count(" ") >= 12], [t for t in parts if t.count(" ") < 12], 1234)
    wrong = total = 0
    for _ in range(150):
        found, truth = layouts.page()
        wrong += int((labeller.label([found])[0] != np.array(truth)).sum())
        total += len(truth)
    assert wrong < 0.03 * total


def test_whole_table(spark):
    got = {r.page_id: r for r in html_extract.op11_html_extract(spark, SF).collect()}
    rows = table(spark, SF, "pages").collect()
    assert len(got) == len(rows)
    for r in rows:
        found, labels = html_extract.own_labels(r.html)
        assert got[r.page_id].text == "\n".join(b.text for b, keep in zip(found, labels) if keep)
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_odd_pages(spark, labeller):
    page = (
        '<html><head><title>T</title><script>var a="<p>no</p>";</script><style>p{}</style></head><body><header><nav><ul><li><a href=/>Home</a><li><a href=/b>News</a></ul></nav></header>'
        '<div class="cookie-notice"><p>We use cookies.</p></div><article><h1>A &amp; B&nbsp;&#8212; title</h1><p>One\n two <b>three</b>.<br>four<p>Second, with more words in it &lt;here&gt;.'
        '<div class="ad">Buy now</div></article><section id="comments"><div class="comment"><p>Reader words, quite a lot of them.</p></div></section><form><label>Name</label></form><footer>&copy; me</footer>'
    )
    long_ = "<article>" + "<p>word word word word word, word word.</p>" * 20_000 + "</article><footer>end</footer>"
    rows = [(1, "u", page, "x"), (1, "u", page, "x"), (2, None, None, None), (None, "v", "", "y"), (3, "w", "<script>never closed <p>x</p>", "z"), (4, "w", long_, "z"), (5, "w", "<<<>&&<p", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extract.extract(df, labeller).collect()
    by_id = {r.page_id: r for r in got}
    assert len(got) == 7 and by_id[1].text == "A & B — title\nOne two three. four\nSecond, with more words in it <here>."
    assert [by_id[i].text for i in (2, None, 3)] == ["", "", ""] and by_id[2].url is None
    assert by_id[4].text.count("\n") == 19_999 and by_id[4].n_chars == len(by_id[4].text)
    empty = html_extract.extract(df.where("false"))
    assert empty.count() == 0
    assert [r.text for r in html_extract.extract(df.where("page_id = 2")).collect()] == [""]


def test_blocks():
    got = page_blocks.blocks("<ul id='mainNav'><li>a<li><a>b</a></ul><p>x<p>y<table><tr><td>1<td>2</table>z<svg>no</svg><!-- no <p> -->w<hr>e&amp")
    assert [b.text for b in got] == ["a", "b", "x", "y", "1", "2", "zw", "e&"]
    assert [b.links for b in got[:2]] == [0.0, 1.0] and page_blocks.number("n:nav", page_blocks.PATHS) in got[0].path
    for hostile in ('<a "' * 30_000, "<div>" * 50_000 + "x", "<svg>" * 50_000, "<p><li>" * 30_000, "<!-- " * 50_000):
        page_blocks.blocks(hostile)  # in linear time


# Operator 12


def brute_runs(x, shortest=24, periods=3):
    out, n = set(), len(x)
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            size = j - i + q
            if size >= max(shortest, periods * q) and not any(all(x[i + t] == x[i + t + d] for t in range(size - d)) for d in range(1, q)):
                out.add((i, size, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs():
    rng = random.Random(5)
    for _ in range(150):
        docs = []
        for _ in range(rng.randint(1, 5)):
            k, n = rng.choice([1, 2, 3, 5]), rng.randint(0, 90)
            doc = [rng.randint(1, k) for _ in range(n)]
            root = [rng.randint(1, k) for _ in range(rng.randint(1, 12))]
            at = rng.randint(0, n)
            docs.append(np.array(doc[:at] + root * rng.randint(0, 7) + root[: rng.randint(0, len(root))] + doc[at:], np.int64))
        for limits in ((24, 3), (1, 3), (1, 2)):
            assert [[tuple(r) for r in g.tolist()] for g in word_runs.runs_of(docs, *limits)] == [brute_runs(d.tolist(), *limits) for d in docs]


def brute_op12(doc_id, text):
    words = [w for w in (text or "").translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ") if w]
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
    told = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(runs), *best, runs and math.floor(1000 * best[1] / best[2]) or None, sha(told), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_word_runs(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["a", "b", "c d", "e\u00a0f", "é"]) for _ in range(rng.randint(0, 120)))) for i in range(60)]
    docs += [(60, None), (61, ""), (62, " \t\n"), (63, "x " * 400), (63, "x " * 400), (None, "y z\x0b" * 50), (64, "a b c " * 30 + "q " + "a b c " * 40)]
    df = spark.createDataFrame([(i, t, 1, "r") for i, t in docs], "doc_id long, text string, start int, runs string").repartition(3)
    got = word_runs.word_runs(df, tail=True).collect()
    fields = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert Counter((r.doc_id, *[r[f] for f in fields]) for r in got) == Counter((i, *brute_op12(i, t)) for i, t in docs)
    row = next(r for r in word_runs.word_runs(df.where("doc_id = 64")).collect())
    assert row.runs == [[0, 90, 3], [91, 120, 3]] and row.collapsed == "a b c q a b c"
    assert word_runs.word_runs(df.where("false")).count() == 0


def test_op12_of_short_texts(spark):
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    got = word_runs.op12_word_runs(spark, SF).collect()
    assert len(got) == len(texts) and "runs" not in got[0].asDict()
    for r in got:
        if len(texts[r.doc_id] or "") < 1500:
            assert tuple(r)[1:] == brute_op12(r.doc_id, texts[r.doc_id])


def test_long_text(spark):
    text = "one two three " * 70_000 + "end"
    row = word_runs.word_runs(spark.createDataFrame([(7, text)], "doc_id long, text string")).first()
    assert row.n_runs == 1 and (row.start, row.length, row.period) == (0, 210_000, 3) and row.collapsed == "one two three end"


# Operator 13


def brute_whitening(vectors, k=16):
    """vec index -> (deviation, whitened); and n, explained."""
    x = [tuple(math.floor(64 * float(c)) + 1_000_000 for c in v) for v in vectors]
    fit = sorted(set(x))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * a - s) / n for a, s in zip(v, sums)] for v in fit])
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    rows = [(sum((n * a - s) ** 2 for a, s in zip(v, sums)), np.array([(n * a - s) / n for a, s in zip(v, sums)]) @ u / np.sqrt(e)) for v in x]
    return rows, n, e / np.trace(centred.T @ centred / n)


def test_whitening(spark):
    rows = sorted(table(spark, SF, "embeddings").collect(), key=lambda r: r.vec_id)
    rows = [r for r in rows if r.embedding and all(c is not None and math.isfinite(c) for c in r.embedding)]
    want, n, explained = brute_whitening([r.embedding for r in rows])
    got = whitening.op13_whitening(spark, SF).collect()
    k = len(explained)
    assert len(got) == k * len(rows) and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1
    assert max(r.identity_error for r in got) < 1e-9
    at = {(r.vec_id, r.component): r for r in got}
    signs = [1 if at[rows[0].vec_id, c + 1].whitened * want[0][1][c] > 0 else -1 for c in range(k)]
    for r, (deviation, whitened) in zip(rows, want):
        for c in range(k):
            mine = at[r.vec_id, c + 1]
            assert mine.deviation == deviation and mine.whitened == pytest.approx(signs[c] * whitened[c], abs=1e-8) and mine.explained == pytest.approx(explained[c], rel=1e-9)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0, 0.5], [0.0, -3.0, 1.0], [2.5, 2.0, -1.0], [4.0, 0.25, 0.0], [4.0, 0.25, 0.0]]
    rows = [(i, v, 1) for i, v in enumerate(good)] + [(10, None, 1), (11, [], 1), (12, [1.0, None, 2.0], 1), (13, [nan, 0.0, 0.0], 1), (14, [inf, 0.0, 0.0], 1), (15, [1.0, 2.0], 1), (None, good[0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int")
    got = whitening.whiten(df).collect()
    assert Counter(r.vec_id for r in got) == {i: 3 for i in [0, 1, 2, 3, 4, None]} and {r.n for r in got} == {4}
    want = brute_whitening(good)[0]
    assert all(r.deviation == want[r.vec_id][0] for r in got if r.vec_id is not None)
    assert whitening.whiten(df.where("vec_id = 3")).count() == 0 == whitening.whiten(df.where("false")).count()
    flat = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whiten(flat).collect()} == {1}
    far = spark.createDataFrame([(i, [v]) for i, v in enumerate([1e9, -1e9, 0.0])], "vec_id long, embedding array<double>")
    assert [r.deviation for r in whitening.whiten(far).orderBy("vec_id").collect()] == [None, None, 0]


@pytest.mark.parametrize("d", [5, 64, 300])
def test_lobpcg(d):
    rng = np.random.default_rng(d)
    a = rng.standard_normal((d, d))
    c = a @ np.diag(np.linspace(1, 9, d)) @ a.T
    found = whitening.lobpcg(lambda block: c @ block, d, 16)
    values, vectors = np.linalg.eigh(c)
    k = len(found.values)
    assert k == min(d, 16) and np.allclose(found.values, values[::-1][:k], rtol=1e-10)
    assert np.allclose(np.abs((found.vectors * vectors[:, ::-1][:, :k]).sum(0)), 1, atol=1e-9)


def test_products_over_partitions(spark):
    df = spark.createDataFrame([([int(v) for v in row],) for row in np.random.default_rng(1).integers(0, 50, (500, 6))], "x array<long>").repartition(5)
    covariance = whitening.Covariance.of(df)
    x = np.array([r.x for r in df.collect()], float)
    block = np.eye(6)[:, :4]
    assert covariance.n == 500 and np.allclose(covariance.times(block), np.cov(x.T, bias=True) @ block) and covariance.trace == pytest.approx(np.trace(np.cov(x.T, bias=True)))
    assert df.select(F.size("x")).first()[0] == 6
