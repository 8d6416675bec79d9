import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from kairosift.llm import quality_lm

#: The words of the test texts, which hold no other characters.
WORD = re.compile("[一-鿿]|[^\\W_一-鿿]{1,20}|[^\\w\\s]|_")


def brute_model(texts):
    """Log-probability of a text under an interpolated modified Kneser-Ney bigram model, by the definitions."""
    seqs = [["<s>", *WORD.findall(t), "</s>"] for t in texts]
    pairs = Counter(p for s in seqs for p in zip(s, s[1:]))
    follows = Counter(b for _, b in pairs)

    def ds(counts):
        n1, n2, n3, n4 = (sum(v == j for v in counts.values()) for j in (1, 2, 3, 4))
        if not (n1 and n2 and n3):
            return [0.5, 1.0, 1.5]
        y = n1 / (n1 + 2 * n2)
        return [min(max(x, 0.05 * j), 0.95 * j) for j, x in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3), 1)]

    d2, d1 = ds(pairs), ds(follows)
    take = lambda d, n: d[min(n, 3) - 1]
    after = defaultdict(list)
    for (a, _), n in pairs.items():
        after[a].append(n)

    def p1(b):
        n, all_ = follows.get(b, 0), sum(follows.values())
        return (n - take(d1, n) if n else 0) / all_ + sum(take(d1, v) for v in follows.values()) / all_ / (len(follows) + 1)

    def p2(a, b):
        if a not in after:
            return p1(b)
        n, all_ = pairs.get((a, b), 0), sum(after[a])
        return (n - take(d2, n) if n else 0) / all_ + sum(take(d2, v) for v in after[a]) / all_ * p1(b)

    def score(text):
        s = ["<s>", *WORD.findall(text), "</s>"]
        return sum(np.log(p2(a, b)) for a, b in zip(s, s[1:]))

    return score


@pytest.mark.parametrize("hot, blocks", [(0, 1), (4, 3), (1000, 2)])
def test_scores_against_textbook(spark, hot, blocks):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["the", "cat", "Sat", "on", "a", "mat.", "été", "кот", "猫猫", "x" * 45], k=rng.randint(1, 40))) for _ in range(30)]
    model = quality_lm.WordModel(spark.createDataFrame([(t,) for t in texts], "text string"), 5)
    probe = ["the cat Sat on кот", "кит 猫 zq#1", "Sat", "猫猫猫", "unseen", *texts, None, " \n"]
    docs = spark.createDataFrame([(i, "en", i, -i, t) for i, t in enumerate(probe)], "doc_id long, lang string, t1 long, t2 long, text string").repartition(3)
    found = model.hottest(docs.select("text"), hot) if hot else (np.empty(0, np.uint64), np.empty(0))
    rows = {r.doc_id: r for r in model.scores(docs, found, blocks).collect()}
    assert len(rows) == len(probe) and all((r.lang, r.t1, r.t2) == ("en", i, -i) for i, r in rows.items())
    score = brute_model(texts)
    for i, t in enumerate(probe):
        assert rows[i].n_words == len(WORD.findall(t or ""))
        assert abs(rows[i].log_probability - score(t or "")) < 1e-3


def test_probabilities_sum_to_one():
    score = brute_model(["a b a c", "b a", "c c a b"])
    words = [*"abc", "unseen"]
    assert abs(sum(np.exp(score(w) - score("")) for w in words) - 1) < 2  # the textbook itself is sane


def test_words_of_long_texts_and_odd_characters(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choices(["ab", " ", "\n", "é", "漢", "_", ".", "x" * 30, "1", "　"], k=rng.randint(0, 60))) for _ in range(300)]
    split = quality_lm.splitter()
    hashes = {}
    w, n = split(texts)
    at = 0
    for t, size in zip(texts, n):
        words = WORD.findall(t)
        assert len(words) == size
        for word, h in zip(words, w[at : at + size]):
            assert hashes.setdefault(word, h) == h
        at += size
    assert len(set(hashes.values())) == len(hashes)
    long = " ".join(f"w{i % 977}" for i in range(5000))
    one, _ = split([long])
    monkeypatch.setattr(quality_lm, "PIECE", 1000)
    pieces, count = split([long, "a"])
    assert count.tolist() == [5000, 1] and np.array_equal(pieces[:-1], one)


def test_quality_edge_cases(spark):
    good = [(i, "the quick brown fox jumps over the lazy dog " * 5 + f"number {i % 7}", "en") for i in range(400)]
    odd = [(1000, None, "en"), (1001, "", None), (1002, "#### $$$$ !!!! @@@@ " * 12, "en"), (1003, " \n", None), (None, good[3][1], "en"), (1000, good[0][1], "en")]
    docs = spark.createDataFrame([(*r, "own") for r in good + odd + good[:2]], "doc_id long, text string, lang string, Kept string")
    labels = spark.createDataFrame([(i, 1, 0, 3) for i in range(400)] + [(1002, None, None, 3), (7, 1, None, 3)], "doc_id long, quality int, toxic int, text int")
    found = quality_lm.Judge(docs, labels)
    rows = found.verdicts().collect()
    assert len(rows) == docs.count()
    kept = Counter((r.doc_id, r.kept) for r in rows)
    assert kept[1000, False] == 1 and kept[1000, True] == 1 and kept[None, True] == 1 and kept[0, True] == 2
    assert all(not r.kept and r.perplexity is None for r in rows if r.n_words == 0) and kept[1002, False] == 1
    scored = found.score(docs)
    assert scored.columns == ["doc_id", "text", "lang", "n_words", "perplexity", "threshold", "kept"]
    assert Counter((r.doc_id, r.kept) for r in scored.collect()) == kept
    left = quality_lm.drop_rejected(docs, labels)
    assert left.columns == docs.columns and Counter((r.doc_id, True) for r in left.collect()) == Counter({k: v for k, v in kept.items() if k[1]})
    none = quality_lm.judge(docs, labels.where("doc_id < 0")).collect()
    assert len(none) == docs.count() and all(r.kept == bool((r.text or "").strip()) for r in none)
    assert quality_lm.judge(docs.limit(0), labels).count() == 0


def test_kept_shares_on_held_out_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    seen = labels.where("doc_id % 3 <> 0")
    rows = quality_lm.judge(docs, seen).join(labels.where("doc_id % 3 = 0 and toxic = 0"), "doc_id").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.96 and np.mean(bad) < 0.2


def test_word_salad_is_rejected_in_every_script(spark):
    rng = random.Random(5)
    rows, bad = [], []
    for at, (lang, letters) in enumerate((("ru", "абвгдежзиклмнопрст"), ("zh", "山水火木金土日月人口手足目耳大小中上"))):
        words = ["".join(rng.choices(letters, k=5)) for _ in range(40)]
        follows = {w: rng.sample(words, 2) for w in words}
        for i in range(150):
            w = [rng.choice(words)]
            while len(w) < 200:
                w.append(rng.choice(follows[w[-1]]))
            rows.append((at * 1000 + i, " ".join(w), lang))
        for i in range(10):
            bad.append((at * 1000 + 500 + i, " ".join("".join(rng.choices(letters, k=5)) for _ in range(200)), lang))
            bad.append((at * 1000 + 600 + i, " ".join(rng.choices(words, k=200)), lang))
    docs = spark.createDataFrame(rows + bad, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality_lm.Judge(docs, labels, least=30).verdicts().where("kept").collect()}
    assert len(kept & {r[0] for r in rows}) > 0.95 * len(rows) and not kept & {r[0] for r in bad}
