import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from kairosift.llm import suffix_dedup
from kairosift.llm.suffix_sort import suffix_array


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    windows = Counter(hashlib.md5(d[i : i + length]).digest() for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        cover = np.zeros(len(d) + 1, int)
        for i in range(len(d) - length + 1):
            if windows[hashlib.md5(d[i : i + length]).digest()] > 1:
                cover[i] += 1
                cover[i + length if i + length <= len(d) else len(d)] -= 1
        gone = np.cumsum(cover[:-1]) > 0
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(d) else 0
        out.append((len(d), int(gone.sum()), runs, bytes(np.frombuffer(d, np.uint8)[~gone])))
    return out


def test_suffix_array_against_sorting():
    rng = random.Random(3)
    for _ in range(500):
        s = [rng.randint(1, rng.choice([1, 2, 3, 26])) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.3:
            s = s[:5] * 5
        assert suffix_array(np.array(s, np.int64)) == sorted(range(len(s)), key=lambda i: s[i:])


def corpus(rng):
    word = lambda: "".join(rng.choices("abcdeéß ", k=rng.randint(1, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    shared = [line(30), line(60), line(15)]
    texts = [line(rng.randint(1, 80)) for _ in range(40)]
    texts += [line(rng.randint(0, 20)) + rng.choice(shared) + line(rng.randint(0, 20)) for _ in range(60)]
    base = line(150)
    for _ in range(12):  # near copies
        i = rng.randrange(len(base))
        texts.append(base[:i] + "#" + base[i + 1 :])
    texts += [texts[3]] * 3 + ["ab" * 300, "x" * 500, "x" * 90, "", None, "Reaton " * 60]
    return texts


@pytest.mark.parametrize("most", [1024, 3])
def test_against_every_window(spark, most):
    texts = corpus(random.Random(most))
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kept string")
    rows = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs, length=100, most=most, as_text=False).collect()}
    for i, (n, removed, runs, kept) in enumerate(brute(texts, 100)):
        r = rows[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == (n, removed, runs, kept), i
    assert len(rows) == len(texts)


@pytest.mark.parametrize("most", [1024, 3])
def test_shorter_repeats_are_counted_beside(spark, most):
    texts = corpus(random.Random(most + 1))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs, length=100, most=most, as_text=False, shorter=45).collect()}
    for i, ((n, removed, runs, kept), short) in enumerate(zip(brute(texts, 100), brute(texts, 45))):
        r = rows[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]), r["n_shorter"]) == (n, removed, runs, kept, short[1]), i


def test_query_shows_passages_under_its_limit(spark, tmp_path):
    rng = random.Random(7)
    own = lambda: "".join(rng.choices("abcdefgh ", k=700))
    passage = " ".join(f"w{rng.randint(0, 9999)}" for _ in range(55))  # over 50 words, under 400 bytes
    docs = [(1, own() + passage + own()), (2, own() + passage), (3, own()), (4, None), (5, own() + "x" * 150)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert len(passage) < 398
    got = {r.doc_id: (r.n_removed, r.n_repeated_200 >= len(passage), r.repeats_200) for r in suffix_dedup.op7_suffix_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (0, True, True), 2: (0, True, True), 3: (0, False, False), 4: (0, False, False), 5: (0, False, False)}


def test_text_keeps_whole_characters(spark):
    docs = spark.createDataFrame([(1, "é" * 120 + "1"), (2, "é" * 120 + "2"), (None, None)], "doc_id long, text string")
    out = suffix_dedup.remove_repeats(docs, length=101).collect()
    assert sorted(r["text"] for r in out) == ["", "1", "2"]


def test_empty_table(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string"), length=100).count() == 0
