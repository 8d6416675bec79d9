import pytest
from test_operators import brute_components, brute_lines

import corpus_pipeline as p
from kairosift.llm.quality_lm import Judge
from test_suffix_dedup import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """What each stage returns, written and read again."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for name, stage in p.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(kept):
    assert all(df.columns == kept[0].columns for df in kept[1:5])


def test_quality_stage(spark, kept):
    found = Judge(kept[0], spark.read.parquet(f"{SF}/labels.parquet"))
    assert set(texts(kept[1])) == {r.doc_id for r in found.verdicts().where("kept").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 and toxic = 0").collect()}
    assert len(good & set(texts(kept[1]))) >= 0.97 * len(good)


def test_lines_stage(kept):
    before = texts(kept[1])
    ids = sorted(before)
    want = {i: t for i, (_, _, t) in zip(ids, brute_lines([before[i] for i in ids]))}
    assert texts(kept[2]) == want


def test_near_duplicates_stage(kept):
    before = texts(kept[2])
    ids = sorted(before)
    want = {i for at, (i, (_, c)) in enumerate(zip(ids, brute_components([before[i] for i in ids], 5, 80))) if c == at}
    assert set(texts(kept[3])) == want


def test_passages_stage(kept):
    before = texts(kept[3])
    ids = sorted(before)
    after = texts(kept[4])
    for i, (n, removed, _, rest) in zip(ids, brute([before[i] for i in ids], p.PASSAGE_BYTES)):
        assert after[i] == rest.decode("utf-8", "ignore") or abs(len(after[i].encode()) - len(rest)) <= 8 * (removed > 0)


def test_packing_stage(kept):
    assert {r.doc_id for r in kept[5].collect()} == set(texts(kept[4]))


def test_run(spark, kept):
    assert p.run(spark, SF).count() == kept[5].count()
