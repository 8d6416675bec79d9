"""Odd tables: empty, null, repeated, very long, clashing columns."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kairosift.llm import ann, lang_crf, line_dedup, packing, piece_codec, suffix_dedup, url_filter

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 5003}" for i in range(60_000))
ROWS = [(1, "one short line", "en"), (1, "one short line", "en"), (2, None, "en"), (3, "", None), (None, "a text without an id", "de"), (4, LONG, "en"), (5, LONG, "en"), (6, " \n\t", "fr")]
EXTRA = "source string, n_chars long, d1 string, __id string, t1 long, Kept string, n_lines long, __drop string, length int"


def odd_docs(spark):
    rows = [(*r, "s", len(r[1] or ""), "x", "y", 1, "k", 2, "z", 3) for r in ROWS]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, {EXTRA}")


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_of_odd_tables(spark, name, stage):
    docs = odd_docs(spark)
    out = stage(spark, docs, SF)
    rows = out.collect()
    none = stage(spark, docs.limit(0), SF)
    assert none.count() == 0
    if name == "packing":
        assert {r.doc_id for r in rows} == {1, 2, 3, 4, 5, 6, None} and sum(r.piece == 0 for r in rows) == len(ROWS)
        return
    assert out.columns == docs.columns == none.columns and all(r.d1 == "x" and r.Kept == "k" for r in rows)
    left = sorted((r.doc_id or 0, r.text or "") for r in rows)
    whole = sorted((r[0] or 0, r[1] or "") for r in ROWS)
    if name == "quality":
        assert not {2, 3, 6} & {d for d, _ in left}
    elif name == "lines":
        assert left == whole
    elif name == "near_duplicates":
        assert left == [x for x in whole if x[0] != 5]
    elif name == "passages":
        assert left == [(d, "" if d in (4, 5) else t) for d, t in whole]
        assert all(r.n_chars == len(r.text) for r in rows)


def test_codec_of_odd_tables(spark):
    docs = odd_docs(spark).withColumn("ids", F.lit("own"))
    out = piece_codec.decode_ids(piece_codec.encode_texts(docs)).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in out) == sorted((r[0] or 0, r[1] or "") for r in ROWS)
    assert all(r.n_tokens == len(r.ids) for r in piece_codec.token_counts(piece_codec.encode_texts(docs)).collect())
    assert piece_codec.encode_texts(docs.limit(0)).count() == 0


def test_lines_of_long_texts(spark):
    many = "\n".join(f"line number {i} of a very long text" for i in range(30_000))
    docs = spark.createDataFrame([(1, many, "a"), (2, many, "b"), (3, many + "\nits own line is here too", "c")], "doc_id long, text string, __id string")
    out = {r.doc_id: r for r in line_dedup.drop_repeated_lines(docs).collect()}
    assert (out[1].n_dropped, out[2].n_dropped, out[3].n_dropped, out[3].text, out[3]["__id"]) == (30_000, 30_000, 0, many + "\nits own line is here too", "c")


def test_planted_passages_go(spark):
    """Passages that repeat across documents: from 400 bytes on every byte, below none, in any language."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzäéß", k=rng.randint(2, 9)))
    texts, planted = [], {}
    for p, size in enumerate((60, 120, 250, 399, 400, 401, 600, 1500)):
        passage = ""
        while len(passage.encode()) < size:
            passage += word() + " "
        data = passage.encode()
        while len(data) > size or data != data.decode("utf-8", "ignore").encode():
            data = data[:-1] if len(data) > size else data[:-1] + b"."
        data = data + b"." * (size - len(data))
        planted[p] = data.decode()
        for _ in range(3):
            mark = "ABCDEFGHIJKLMNOPQRSTUVWX"[len(texts)]  # so that copies agree in the passage and the line ends beside it alone
            own = lambda: mark + " ".join(word() for _ in range(rng.randint(30, 80))) + mark  # noqa: E731, B023
            texts.append((p, own() + "\n" + planted[p] + "\n" + own()))
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    out = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).collect()}
    for i, (p, t) in enumerate(texts):
        size = len(planted[p].encode())
        assert (planted[p] not in out[i].text) == (size + 2 >= 400)  # the line ends at both sides repeat as well
        assert out[i].n_removed == (size + 2 if size + 2 >= 400 else 0)


def brute_marginals(e, t):
    """Of every label at every place: sums over all label sequences; a chain begins with a step from any label."""
    import itertools

    n, k = e.shape
    begin = np.log(np.exp(t).sum(0))
    out = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        p = np.exp(begin[path[0]] + sum(e[i, y] for i, y in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:])))
        for i, y in enumerate(path):
            out[i, y] += p
    return out / out.sum(1, keepdims=True)


def test_forward_backward_against_all_sequences():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5):
        e, t = rng.normal(size=(n, 3)), rng.normal(size=(3, 3))
        p, _ = lang_crf.posteriors(e[None], np.ones((1, n), bool), t)
        assert np.allclose(p[0], brute_marginals(e, t), atol=1e-9)


def test_languages_of_odd_tables(spark):
    docs = spark.createDataFrame([(i, f"the word and of the {'x' * (i % 3)}", "en", "s", 0.5) for i in range(30)] + [(i, f"der das und ist {'x' * (i % 3)}", "de", "s", 0.5) for i in range(30, 60)], "doc_id long, text string, lang string, source string, Score double")
    model = lang_crf.train(docs)
    odd = spark.createDataFrame([(None, "the word and of"), (1, None), (1, ""), (2, "12 !?"), (3, LONG)], "doc_id long, text string").withColumn("Lang_pred", F.lit("own"))
    rows = lang_crf.identify(odd, model).collect()
    assert len(rows) == 5 and {r.lang_pred for r in rows if r.doc_id in (1, 2)} == {"und"} and lang_crf.identify(odd.limit(0), model).count() == 0


def test_queries_end_to_end(spark):
    """The registered queries on the smallest tables, against what their contracts say of every row."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = lang_crf.op4_lang_crf(spark, SF).collect()
    assert {r.doc_id: r.held_out for r in rows} == {d: zlib.crc32(str(d).encode()) % 4 == 2 for d in docs}
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    judged = url_filter.op1_url_filter(spark, SF).collect()
    assert sorted(r.page_id for r in judged) == sorted(pages)
    for r in judged:
        url = pages[r.page_id]
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut].lower() if rest.isascii() else r.host, rest[cut:].split("?")[0].split("#")[0]
        best = max([(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)], default=None)
        assert (r.host, r.path, r.rule) == (host, path, best and best[1])
        assert r.verdict == (best[2] if best else "block" if r.matched else "allow")
    codec = piece_codec.pieces(piece_codec.default_model())
    total = sum(codec.count(r.text) for r in docs.values())
    assert sum(r.n_tokens for r in packing.op9_packing(spark, SF).collect()) == total
    x = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    found = ann.op10_ann(spark, SF).collect()
    for q in [v for v in x if v % 100 == 0]:
        near = sorted((np.sqrt(((x[v] - x[q]) ** 2).sum()), v) for v in x if v != q)[:10]
        mine = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 11)) and len({m[1] for m in mine} & {v for _, v in near}) >= 9
        assert all(abs(s - np.sqrt(((x[v] - x[q]) ** 2).sum())) < 1e-9 for _, v, s in mine)


def test_repeated_labelled_rows_are_one_trial(spark):
    """The rules of a table are those of the table whose labelled rows are there many times."""
    from kairosift.llm import risk_rules

    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    often = base.union(base.where("doc_id % 3 = 0")).union(base.where("doc_id % 3 = 0")).union(base.limit(1).selectExpr("cast(null as long)", "text", "lang"))
    rules = lambda df: {(r.doc_id, r.kept, tuple(r.rules)) for r in risk_rules.judge(df, labels, risk=0.1, delta=0.5).collect() if r.doc_id is not None}
    assert rules(often) == rules(base)


def test_held_out_without_a_doc_id(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.union(docs.limit(3).selectExpr("cast(null as long) as doc_id", *docs.columns[1:])).write.parquet(f"{tmp_path}/documents.parquet")
    rows = [r for r in lang_crf.op4_lang_crf(spark, str(tmp_path)).collect() if r.doc_id is None]
    assert len(rows) == 3 and all(r.held_out is False and r.lang_pred for r in rows)


def test_windows_lie_all_over_a_text():
    import pyarrow as pa

    text = " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(32 * 9))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["x", "y"]), pa.array([text, ""])], names=["doc_id", "lang", "text"])
    got = next(lang_crf._windows(3)(iter([batch]))).column(2).to_pylist()
    words = text.split()
    assert got == [words[:32], words[128:160], words[256:288]]
