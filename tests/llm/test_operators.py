import hashlib
import itertools
import random
import time
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kairosift.llm import ann, lang_crf, line_dedup, minhash_dedup, packing, piece_codec, risk_rules, url_filter
from kairosift.llm.components import components

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# ---- 1 URLs


def test_host_path_and_rules(spark):
    urls = ["https://Blog.Example.ORG/es/1?q=1#x", "http://example.org/en/12", "x.com/fr/", None, "ftp://a.com/fr/x", "http://ÄB.com?de", "http://a.com/de/", "http://org/", "http://b.net/x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rule, verdict = url_filter.own_rule(F.col("host"), F.col("path"))
    rows = pages.select("page_id", url_filter.host_of(F.col("url")).alias("host"), url_filter.path_of(F.col("url")).alias("path")).select("*", rule.alias("rule"), verdict.alias("verdict")).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in rows] == [
        ("blog.example.org", "/es/1", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("", "", None, None), ("", "", None, None),
        ("a.com", "/fr/x", "com/fr/", "allow"), ("Äb.com", "", None, None), ("a.com", "/de/", "com/de/", "block"), ("org", "/", "org/", "allow"), ("b.net", "/x", None, None),
    ]


def test_mined_rules_against_counting(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        host, part = rng.choice(["good", "mixed", "spam"]), rng.choice(["a", "b", "c"])
        bad = host == "spam" and part != "c" or host == "mixed" and part == "b" or rng.random() < 0.05
        rows.append((i, f"http://{host}.net/{part}/{rng.randint(1, 9)}", bad))
    pages = spark.createDataFrame([r[:2] for r in rows] + [(900, None), (901, "http://spam.net/a/5"), (902, "http://good.net/a/5")], "page_id long, url string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(5000, True), (None, True)], "page_id long, bad boolean")
    rules = url_filter.mine_rules(pages, labels, 0.01, 0.6, 1.2).collect()
    baskets = [({f"h={u.split('/')[2].split('.')[0]}", "h=net", f"p={u.split('/')[3]}", "p=0"}, bad) for _, u, bad in rows]
    n, n_bad = len(baskets), sum(b for _, b in baskets)
    want = {}
    for size in range(1, 5):
        for items in {frozenset(c) for t, _ in baskets for c in itertools.combinations(sorted(t), size)}:
            freq, hits = sum(items <= t for t, _ in baskets), sum(b for t, b in baskets if items <= t)
            if hits >= 0.01 * n and hits / freq >= 0.6 and hits / freq / (n_bad / n) >= 1.2:
                want[items] = hits / freq
    want = {i: c for i, c in want.items() if not any(i - {x} in want and want[i - {x}] >= c for x in i)}
    assert {frozenset(r.antecedent): round(r.confidence, 9) for r in rules} == {i: round(c, 9) for i, c in want.items()}
    found = url_filter.mine_rules(pages, labels, 0.01, 0.6, 1.2)
    out = {r.page_id: r for r in url_filter.judge(pages, found).collect()}
    assert {i for i, r in out.items() if r.matched} == {i for i, (t, _) in enumerate(baskets) if any(w <= t for w in want)} | {901}
    best = lambda t: max((c, " ".join(sorted(w))) for w, c in want.items() if w <= t)
    assert all((round(r.confidence, 9), r.matched, r.verdict) == (round(best(baskets[i][0])[0], 9), best(baskets[i][0])[1], "block") for i, r in out.items() if r.matched and i < 300)


def test_urls_are_judged_alone(spark):
    rules = spark.createDataFrame([(["h=spam"], [["h=bad", "h=spam"]], 1.0, 1.0, 2.0), (["h=spam", "p=x"], [["h=bad", "h=spam"], ["p=x"]], 0.9, 1.0, 2.0)], "antecedent array<string>, parts array<array<string>>, confidence double, support double, lift double")
    rows = [(1, "http://spam.net/"), (1, "http://good.net/x"), (None, "http://spam.net/"), (None, None), (2, "no url"), (3, "http://bad.net/x"), (3, "http://bad.net/x"), (4, ""), (5, "http://spam.example.org/es/1"), (6, "http://" + "x" * 100_000)]
    pages = spark.createDataFrame([(*r, "own") for r in rows], "page_id long, url string, Matched string")
    out = sorted(((r.page_id or 0, r.verdict, r.matched) for r in url_filter.judge(pages, rules).collect()), key=str)
    want = [(1, "block", "h=spam"), (1, "allow", None), (0, "block", "h=spam"), (0, "allow", None), (2, "allow", None), (3, "block", "h=spam"), (3, "block", "h=spam"), (4, "allow", None), (5, "block", "h=spam"), (6, "allow", None)]
    assert out == sorted(want, key=str)
    assert url_filter.judge(pages.limit(0), rules).count() == 0 and url_filter.judge(pages, rules.limit(0)).where("verdict = 'block'").count() == 1


def test_tokens_that_go_together_are_one_item(spark):
    """Twenty tokens on the same pages would be 2^20 combinations."""
    same = "/".join(f"t{chr(97 + i)}" for i in range(20))
    rows = [(i, f"http://spam.net/{same}") for i in range(30)] + [(100 + i, f"http://good{i % 5}.net/x") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, i < 100) for i, _ in rows], "page_id long, bad boolean")
    rules = url_filter.mine_rules(pages, labels).collect()
    assert len(rules) == 1 and len(rules[0].parts[0]) == 21
    probe = spark.createDataFrame([(1, "http://other.org/tc"), (2, "http://spam.net/"), (3, "http://good1.net/x")], "page_id long, url string")
    found = url_filter.judge(probe, url_filter.mine_rules(pages, labels), ())
    assert {r.page_id: r.verdict for r in found.collect()} == {1: "block", 2: "block", 3: "allow"}


def test_no_labels(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert url_filter.mine_rules(pages, spark.createDataFrame([], "page_id long, bad boolean")).count() == 0


# ---- 2 pieces


def test_codec_against_library(spark):
    import sentencepiece

    model = piece_codec.default_model()
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    rng = random.Random(5)
    pool = list("ab cde\n\t  ▁éß梦漢😀\x00​.,!?'Ａﬁ\xa0　") + ["the", "ing", "</s>", "<0x41>", "    ", "\r\n", "aaaa"]
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 40))) for _ in range(500)] + ["", None, " ", "▁", "a" * 3000, "ab" * 2000, "日本語テキスト" * 50]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    out = piece_codec.decode_ids(piece_codec.encode_texts(docs)).collect()
    assert len(out) == len(texts)
    for r in out:
        want = sp.encode(r.text or "")
        assert r.ids == want and r.decoded == sp.decode(want)
    n = {r.doc_id: r.n_tokens for r in piece_codec.token_counts(docs).collect()}
    assert all(n[r.doc_id] == len(r.ids) for r in out)


# ---- 4 languages


def test_languages_on_held_out_documents(spark):
    rows = lang_crf.op4_lang_crf(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 200 and np.mean([r.lang == r.lang_pred for r in held]) > 0.9
    assert all(0 <= r.score <= 1 for r in rows)


def test_blocks_are_exact_and_switches_found(spark):
    field = lang_crf.Field(["a", "b", "c"], {})
    rng = np.random.default_rng(0)
    field.w = (rng.normal(size=field.w.shape) * 0.3).astype(np.float32)
    field.t = rng.normal(size=(3, 3))
    docs = [["".join(rng.choice(list("abcdef"), 3)) for _ in range(n)] for n in (1, 5, 64, 65, 200, 0, 130)]
    for words, p in zip(docs, field.label(docs)):
        if words:
            want, _ = lang_crf.posteriors(field.emissions(words)[None], np.ones((1, len(words)), bool), field.t)
            assert np.allclose(want[0], p, atol=1e-9)
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 600")
    model = lang_crf.train(base)
    en, fr = (base.where(F.col("lang") == lang).orderBy("doc_id").first().text[:400] for lang in ("en", "fr"))
    out = lang_crf.identify(spark.createDataFrame([(1, en + " " + fr), (2, "12 34"), (3, None), (4, "")], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert {x.lang for x in out[0].runs} >= {"en", "fr"} and len(out[0].runs) <= 8
    assert [(r.lang_pred, r.score) for r in out[1:]] == [("und", 0.0)] * 3
    assert lang_crf.train(base.limit(0)) is None
    assert lang_crf.identify(base.limit(1).select("doc_id", "text"), None).first().lang_pred == "und"


# ---- 5 near duplicates


def brute_components(texts, k, percent):
    sets = []
    for t in texts:
        words = [w for w in lower(t or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
        sets.append({tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set())
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_duplicates_against_all_pairs(spark, k, percent):
    rng = random.Random(k)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    texts = [" ".join(word() for _ in range(rng.randint(0, 120))) for _ in range(40)]
    for base in range(4):  # families with ever more edits
        words = [word() for _ in range(150)]
        for copy in range(25):
            own = list(words)
            for _ in range(rng.randint(0, 9)):
                own[rng.randrange(150)] = word()
            texts.append(" ".join(own[: 150 - rng.randint(0, 12)]))
    texts += [texts[5].upper(), texts[5] + " ", "one two", "ONE\ttwo", "one", "", None, "  \n "]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, key int")
    rows = {r.doc_id: r for r in minhash_dedup.near_duplicates(docs, k, percent).collect()}
    want = brute_components(texts, k, percent)
    assert [(rows[i].n_shingles, rows[i].component_id) for i in range(len(texts))] == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows.values())
    kept = minhash_dedup.drop_near_duplicates(docs, k, percent)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, w in enumerate(want) if w[1] == i}


def test_near_duplicates_of_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (1, "x y z w"), (2, "x y z w"), (2, None)], "doc_id long, text string")
    rows = minhash_dedup.near_duplicates(docs, 3, 85).collect()
    assert len(rows) == 5 and all(r.kept for r in rows if r.doc_id is None)
    assert minhash_dedup.near_duplicates(docs.limit(0), 3, 85).count() == 0


def test_texts_of_one_doc_id_are_dropped_alone(spark):
    texts = {"a": "p q r s t u v w x y z", "b": "one two three four five six", "c": "seven eight nine ten eleven twelve"}
    docs = spark.createDataFrame([(1, texts["a"], 1, "x"), (2, texts["a"], 1, "x"), (2, texts["b"], 1, "x"), (2, texts["c"], 1, "x"), (3, texts["c"], 1, "x"), (4, None, 1, "x"), (5, "", 1, "x"), (None, texts["a"], 1, "x")], "doc_id long, text string, t1 int, Kept string")
    left = minhash_dedup.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == sorted([(0, texts["a"]), (1, texts["a"]), (2, texts["b"]), (2, texts["c"]), (4, ""), (5, "")])
    assert minhash_dedup.drop_near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("cells, leaders", [(minhash_dedup.CELLS, 32), (0, 32), (0, 1), (6_000, 2)])
def test_group_that_shares_much_beside_its_leader(spark, monkeypatch, cells, leaders):
    """Finished by tasks, by levels alone, and by both. Members of one bucket family that share different extras, some of them linked with their leader and some not."""
    rng = random.Random(12)
    core = [f"c{i}" for i in range(80)]
    blocks = [[f"b{j}x{i}" for i in range(14)] for j in range(6)]
    docs = [" ".join(core)]
    for i in range(150):
        words = core + [w for j in rng.sample(range(6), rng.randint(0, 3)) for w in blocks[j]] + [f"own{i}x{k}" for k in range(rng.randint(0, 4))]
        docs.append(" ".join(words))
    monkeypatch.setattr(minhash_dedup, "LEADERS", leaders)
    monkeypatch.setattr(minhash_dedup, "CLASSES", 2 * leaders)
    rows = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), 1, 85, cells=cells).collect()}
    assert [rows[i] for i in range(len(docs))] == [c for _, c in brute_components(docs, 1, 85)]


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)]
    out = {r.node: r.component for r in components(spark.createDataFrame(edges, "x long, y long")).collect()}
    label = {n: n for e in edges for n in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert out == {n: c for n, c in label.items() if any(n in e and e[0] != e[1] for e in edges)}


@pytest.mark.parametrize("origins, edits", [(1, 40), (1, 6), (3, 20)])
def test_a_star_is_finished_by_its_members_differences(origins, edits):
    """Members far from all others are counted with few; the components are those of all pairs."""
    rng = random.Random(origins * edits)
    texts = [[f"o{o}w{i}" for i in range(120)] for o in range(origins)]
    for _ in range(400):
        words = list(rng.choice(texts if rng.random() < 0.2 else texts[:origins]))
        for _ in range(rng.randint(0, edits)):
            at = rng.randrange(len(words))
            words[at : at + rng.randint(0, 2)] = rng.choices(["new", f"n{rng.random()}", "w"], k=rng.randint(0, 1))
        texts.append(words)
    sets = list({s.tobytes(): s for s in (minhash_dedup.shingle_set(" ".join(w), 3) for w in texts)}.values())
    star = pa.table({"x": pa.array([0] * len(sets), pa.int64()), "y": pa.array(range(len(sets)), pa.int64()), "c": pa.array([min(i, i // 2 * 2) for i in range(len(sets))], pa.int64()), "shingles": pa.array([s.tobytes() for s in sets], pa.binary())})
    plain = [set(s.tolist()) for s in sets]
    alike = lambda a, b: 100 * len(plain[a] & plain[b]) >= 85 * len(plain[a] | plain[b])

    def components_of(links):
        label = star["c"].to_pylist()
        for a, b in links:
            label = [label[a] if c == label[b] else c for c in label]
        return {frozenset(i for i, c in enumerate(label) if c == one) for one in label}

    got = minhash_dedup._links_within(85)(star).to_pylist()
    assert all(alike(r["x"], r["y"]) for r in got)
    assert components_of([(r["x"], r["y"]) for r in got]) == components_of([(a, b) for a in range(len(sets)) for b in range(a) if alike(a, b)])
    found = minhash_dedup.Differences(sets, 85)
    for z in range(len(sets)):
        near = set(np.flatnonzero(found.near)) if found.near[z] else set()
        assert {y for y in range(len(sets)) if y != z and alike(z, y)} <= near | set(found.candidates(z))
    assert sum(len(found.candidates(z)) for z in range(len(sets))) < len(sets) ** 2 / (4 if origins == 1 else 2)


def test_links_beside_leaders_that_are_unlike(spark):
    """Two near copies; every bucket they meet in is led by a third document with six to eight of their 60 words."""
    x = [f"w{i}" for i in range(60)]
    y = x[:57] + ["u1", "u2", "u3"]
    word = {int(minhash_dedup.shingle_set(w, 1)[0]): w for w in x + y}
    a, b = minhash_dedup._coefficients(60)
    least = [[min((h for h, w in word.items() if w in t), key=lambda h: ((h ^ int(b[j])) * int(a[j])) % 2**64) for j in range(60)] for t in (x, y)]
    same = [[i for i in range(10) if all(least[0][at + 3 * i + j] == least[1][at + 3 * i + j] for j in range(3))] for at in (0, 30)]
    assert same[0] and same[1]
    docs = [(1, " ".join(x)), (2, " ".join(y))]
    for i in same[0]:
        for k in same[1]:
            docs.append((len(docs) + 1, " ".join(sorted({word[least[0][j]] for j in (*range(3 * i, 3 * i + 3), *range(30 + 3 * k, 33 + 3 * k))}))))
    rows = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 1, 85).collect()}
    want = brute_components([t for _, t in docs], 1, 85)
    assert rows[2] == 1 and [rows[d] for d, _ in docs] == [docs[c][0] for _, c in want]


@pytest.mark.parametrize("cells", [minhash_dedup.CELLS, 0])
def test_links_in_a_pool_of_passages(spark, cells):
    rng = random.Random(6)
    pool = [" ".join(f"p{i}x{j}" for j in range(8)) for i in range(60)]
    docs = [" ".join(rng.sample(pool, rng.randint(20, 30))) for _ in range(600)]
    for i in range(0, 100, 2):
        parts = docs[i].split(" ")
        docs[i + 1] = " ".join(parts[:-6] + [f"n{i}y{j}" for j in range(6)])
    rows = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), 3, 85, cells=cells).collect()}
    assert [rows[i] for i in range(600)] == [c for _, c in brute_components(docs, 3, 85)]


# ---- 6 rules


def brute_counts(text):
    text = text or ""
    words = [w for w in "".join(" " if c in SPACE else c for c in text).split(" ") if w]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    cover = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(cover)


def test_counts_against_brute_force():
    rng = random.Random(6)
    for _ in range(200):
        t = "".join(rng.choices(["a ", "b ", "c# ", "é\n", "a b c a b c a b ", "\x0b", "|", "\xa0"], k=rng.randint(0, 60)))
        assert risk_rules.text_counts(t)[:5] == brute_counts(t)
    assert risk_rules.text_counts(None)[:5] == (0, 0, 0, 0, 0)


def test_binomial_bound():
    from math import comb

    for n, k, p in [(10, 3, 0.2), (50, 0, 0.05), (50, 50, 0.5), (200, 7, 0.02), (37, 20, 0.6)]:
        assert abs(risk_rules.binomial_cdf(k, n, p) - sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))) < 1e-9


def test_cutoffs_hold_their_risk(spark):
    rng = np.random.default_rng(1)
    n = 24000
    good = rng.random(n) < 0.7
    share = np.where(good, rng.beta(1, 200, n), rng.beta(2, 3, n))
    rows = [(i, "en" if i % 2 else "xx", bool(g), float(s), 0.0, 0.0, 0.0) for i, (g, s) in enumerate(zip(good, share))] + [(n + 1, "few", True, 0.5, 0.0, 0.0, 0.0)]
    labelled = spark.createDataFrame(rows, "doc_id long, stratum string, good boolean, symbol_share double, dup_line_share double, repeat_share double, upper_share double")
    found = {(r.stratum, r.rule): r.cutoff for r in risk_rules.cutoffs(labelled).collect()}
    assert set(found) == {("en", "symbol_share"), ("xx", "symbol_share")}
    for (stratum, _), cut in found.items():
        mine = [r for r in rows if r[1] == stratum]
        assert np.mean([r[3] > cut for r in mine if r[2]]) < 0.02 and np.mean([r[3] > cut for r in mine if not r[2]]) > 0.8


def brute_cutoffs(rows, risk, delta, gain):
    """rows: (doc_id, stratum, good, shares by rule)."""
    import zlib
    from math import comb

    half = lambda r: zlib.crc32(str(r[0]).encode()) % 2 == 0
    paths = {}
    for st in {r[1] for r in rows}:
        path = [{} for _ in risk_rules.LEVELS]
        mine = [r for r in rows if r[1] == st and not half(r)]
        n_good, n_bad = sum(r[2] for r in mine), sum(not r[2] for r in mine)
        for rule in risk_rules.RULES:
            for i, level in enumerate(risk_rules.LEVELS):
                for at, g in enumerate(risk_rules.GRID):
                    over = [r for r in mine if r[3][rule] > g]
                    a, b = sum(r[2] for r in over), sum(not r[2] for r in over)
                    top = risk_rules.GRID[at + 1] if at + 1 < len(risk_rules.GRID) else 9
                    if b and b * max(n_good, 1) >= gain * a * max(n_bad, 1) and a <= level * risk * n_good and any(g < r[3][rule] <= top for r in mine):
                        path[i][rule] = g
                        break
        if any(path):
            paths[st] = path
    out = {}
    for st, path in paths.items():
        mine = [r for r in rows if r[1] == st and half(r) and r[2]]
        used = None
        for cuts in path:
            k, n = sum(any(r[3][x] > c for x, c in cuts.items()) for r in mine), len(mine)
            if not n or sum(comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1)) > delta / len(paths):
                break
            used = cuts
        out |= {(st, x): c for x, c in (used or {}).items()}
    return out


def test_judge_against_brute_force(spark):
    rng = random.Random(15)
    docs = []
    for i in range(1500):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(15, 60))]
        bad = rng.random() < 0.3
        for j in range(len(words)):
            if rng.random() < (0.4 if bad else 0.002):
                words[j] += rng.choice("#$|")
            elif bad and i % 2 and rng.random() < 0.5:
                words[j] = words[j].upper()
        docs.append((i, rng.choice(["en", "en", "en", None]), " ".join(words), bad))
    docs += [(2000, "en", None, True), (2001, None, "", True), (2002, "zz", "a b " * 30, True)]
    table = spark.createDataFrame([(i, lang, t, 1, 2) for i, lang, t, _ in docs] + [(0, *docs[0][1:3], 1, 2)], "doc_id long, lang string, text string, kept int, rules int")
    labels = spark.createDataFrame([(i, int(not b), 0) for i, *_, b in docs if i % 4] + [(1, None, None)], "doc_id long, quality int, toxic int")
    rows = []
    shares = {}
    for i, lang, t, bad in docs:
        c = dict(zip(risk_rules.COUNTS, risk_rules.text_counts(t)))
        shares[i] = {"symbol_share": c["n_symbols"] / max(c["word_chars"], 1), "dup_line_share": c["n_dup_lines"] / max(c["n_lines"], 1), "repeat_share": c["n_repeat_words"] / max(c["n_words"], 1), "upper_share": c["n_upper"] / max(c["n_letters"], 1)}
        shares[i]["failed"] = c["n_words"] < 20 or 100 * c["n_repeat_words"] > 30 * c["n_words"]
        if i % 4 and not shares[i]["failed"]:
            rows.append((i, lang or "", not bad, shares[i]))
    want = brute_cutoffs(rows, 0.05, 0.1, 3.0)
    assert want
    out = risk_rules.judge(table, labels, 0.05, 0.1).collect()
    assert len(out) == len(docs) + 1
    lang_of = {i: lang or "" for i, lang, *_ in docs}
    for r in out:
        failed = [x for x in risk_rules.RULES if shares[r.doc_id][x] > want.get((lang_of[r.doc_id], x), 9)]
        assert list(r.rules) == failed and r.base_failed == shares[r.doc_id]["failed"] and r.kept == (not r.base_failed and not failed)
    none = risk_rules.judge(table, labels.limit(0)).collect()
    assert all(r.kept == (not r.base_failed) and not r.rules for r in none) and len(none) == len(out)
    assert risk_rules.judge(table.limit(0), labels).count() == 0


def test_rules_fire_on_the_tables(spark):
    rows = risk_rules.op6_risk_rules(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("not base_failed").collect()
    lost = lambda q: np.mean([not r.kept for r in rows if r.quality == q])
    assert lost(1) < 0.02 and lost(0) > 0.5


# ---- 8 lines


def brute_lines(texts, least=20, docs=3):
    keys = [[lower(x.strip(SPACE)) for x in (t or "").split("\n")] for t in texts]
    holders = defaultdict(set)
    for i, ks in enumerate(keys):
        for k in ks:
            if len(k) >= least:
                holders[k].add(i)
    out = []
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, keys[i]) if not (len(holders.get(k, ())) >= docs and i != max(holders[k]))]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("batches, fan_in", [(1, 2), (4, 3), (6, 2)])
def test_lines_against_brute_force(spark, batches, fan_in):
    rng = random.Random(8)
    pool = [f"{'line of text number '}{i} ÉÀ" for i in range(30)] + ["short", "", "x" * 20]
    vary = lambda s: rng.choice([s, s.upper() if s.isascii() else s, f"  {s}\t", s + "\r"])
    texts = ["\n".join(vary(rng.choice(pool)) for _ in range(rng.randint(0, 8))) for _ in range(60)] + [None, "", "\n\n"]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_lines int")
    rows = {r.doc_id: r for r in line_dedup.drop_repeated_lines(docs, batches=batches, fan_in=fan_in).collect()}
    assert [(rows[i].n_lines, rows[i].n_dropped, rows[i].text) for i in range(len(texts))] == brute_lines(texts)


def test_lines_of_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a line that is long enough")] * 3 + [(7, "a line that is long enough")] * 3, "doc_id long, text string")
    assert sum(r.n_dropped for r in line_dedup.drop_repeated_lines(docs).collect()) == 0
    assert line_dedup.drop_repeated_lines(docs.limit(0)).count() == 0


# ---- 9 packing


def test_buckets_are_optimal():
    rng = random.Random(9)
    for _ in range(60):
        lengths = sorted(rng.sample(range(1, 40), rng.randint(1, 9)))
        counts = [rng.randint(1, 20) for _ in lengths]
        k = rng.randint(1, 5)
        waste = lambda tops: sum(c * (min(t for t in tops if t >= x) - x) for x, c in zip(lengths, counts))
        best = min(waste([*c, lengths[-1]]) for c in itertools.combinations(lengths[:-1], min(k, len(lengths)) - 1))
        got = packing.bucket_lengths(np.array(lengths), np.array(counts), k)
        assert len(got) <= k and waste(got) == best and got == sorted(got)


def test_batches_hold_every_token(spark):
    rng = random.Random(10)
    n = {i: rng.choice([0, 1, 5, 17, 90, 250, 1000]) for i in range(400)}
    rows = packing.pack(spark.createDataFrame(list(n.items()) + [(None, 3)], "doc_id long, n_tokens long"), max_len=100, buckets=4, budget=400, per_shard=60).collect()
    spans = defaultdict(list)
    for r in rows:
        spans[r.doc_id].append((r.start, r.n_tokens))
        assert r.n_tokens <= r.bucket_len <= 100
    for i, total in n.items():
        at = 0
        for start, size in sorted(spans[i]):
            assert start == at
            at += size
        assert at == total
    slots = Counter((r.bucket_len, r.shard, r.batch) for r in rows)
    assert all(c * b <= 400 for (b, _, _), c in slots.items())
    assert len({(r.bucket_len, r.shard, r.batch, r.slot) for r in rows}) == len(rows)
    full = Counter((b, s) for (b, s, _), c in slots.items() if c < 400 // b)
    assert all(v == 1 for v in full.values())
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0


# ---- 10 neighbours


def test_recall_and_exact_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    v = ann.valid_vectors(df)
    got = defaultdict(list)
    for r in ann.nearest(v, v.where("vec_id % 20 = 0"), per_list=25, block=64).collect():
        got[r.query_id].append((r.rank, r.score, r.vec_id))
    hits = 0
    for q in ids[ids % 20 == 0]:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(1))
        d[ids == q] = np.inf
        want = np.lexsort((ids, d))[:10]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 11)) and mine == sorted(mine, key=lambda m: (m[1], m[2]))
        assert all(abs(m[1] - d[ids == m[2]][0]) < 1e-9 for m in mine)
        hits += len({m[2] for m in mine} & set(ids[want]))
    assert hits / (10 * len(got)) >= 0.9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, None), (7, [None, 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (1, [1.0, 0.0])]
    v = ann.valid_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    out = [(r.query_id, r.rank, r.vec_id) for r in ann.nearest(v, v.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()]
    assert out == [(0, 1, 1), (0, 2, 100), (0, 3, 2), (100, 1, 0), (100, 2, 1), (100, 3, 2)]
    assert ann.nearest(v.limit(0), v.limit(0)).count() == 0


def spread_vectors(n, means=30, seed=8):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(means, 64))[rng.integers(0, means, n)] * 0.08 + rng.normal(size=(n, 64)) * 0.1


def test_every_list_within_reach_is_probed():
    """1,000 lists: a beam of 64 was the most that a query looked into."""
    x = spread_vectors(3000)
    graph = ann.Centroids(x[:1000], x)
    q = x[2000:2100]
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(q.tolist(), pa.list_(pa.float64()))], names=["vec_id", "v"])
    sizes = np.full(1000, 3)
    found = defaultdict(set)
    for part in ann._lists(SimpleNamespace(value=graph), 64, 0.25, sizes=sizes, need=400)([batch]):
        for at, i in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            assert at not in found[i]
            found[i].add(at)
    for i in range(100):
        d = np.sqrt(((x[:1000] - q[i]) ** 2).sum(1))
        within = set(np.flatnonzero(d <= 1.25 * d.min() * (1 - 1e-9)).tolist())
        assert within <= found[i] and set(np.argsort(d)[:134].tolist()) <= found[i]


def test_neighbours_over_many_lists(spark):
    x = spread_vectors(12_000)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
    rows = ann.nearest(df, df.where("vec_id % 200 = 0"), per_list=8).collect()
    found = defaultdict(set)
    for r in rows:
        found[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, 12_000, 200):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(found[q] & set(np.argsort(d)[:10].tolist()))
    assert hits / 600 > 0.99


def test_decoding_makes_no_scalar_of_each_id():
    codec = piece_codec.pieces(piece_codec.default_model())
    texts = ["no id is a scalar, größer 漢字 " * 4000, "", None, "b a"]
    column = pa.array([None if t is None else codec.encode(t).tolist() for t in texts], pa.list_(pa.int32()))
    began = time.process_time()
    got = piece_codec._decoded(codec, column)
    decoded = time.process_time()
    [x.values.to_pylist() for x in column if x.is_valid]
    listed = time.process_time()
    assert got.to_pylist() == [t or "" for t in texts] and piece_codec._decoded(codec, column[1:]).to_pylist() == ["", "", "b a"]
    assert decoded - began < 0.6 * (listed - decoded)
