"""Identity of urls, validation of records, ablations and stage metrics on literals."""

import pytest
from pyspark.sql import functions as F

from kairosift.functions import urls
from kairosift.operators import evidence, fusion, represent, validation
from kairosift.streaming import runs


@pytest.mark.parametrize(
    "url, want",
    [
        ("HTTP://Example.ORG:80/a/./b/../c?b=2&a=1#x", "http://example.org/a/c?a=1&b=2"), ("https://example.org", "https://example.org/"), ("https://example.org:443/", "https://example.org/"),
        ("https://example.org:8443/A/", "https://example.org:8443/A/"), (" https://e.org/a?utm_source=x&REF=y ", "https://e.org/a"), ("https://e.org/../../a/..", "https://e.org/"), ("https://e.org/a/b/..", "https://e.org/a/"),
        ("https://e.org/a/.", "https://e.org/a/"), ("https://e.org?b&a", "https://e.org/?a&b"), ("https://e.org//a", "https://e.org//a"), ("/relative", None), ("", None), (None, None), ("https:///a", None),
    ],
)
def test_canonical_urls(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(urls.canonical(F.col("u"))).first()[0] == want


def test_tracking_keys_are_a_parameter(spark):
    df = spark.createDataFrame([("https://e.org/?ref=1&k=2",)], "u string")
    assert df.select(urls.canonical(F.col("u"), ["k"])).first()[0] == "https://e.org/?ref=1"


def test_consolidation(spark):
    found = [(3, "https://E.org/a", "web", 1), (1, "https://e.org/a?utm_source=x", "web", 2), (7, None, "local", 1), (7, None, "local", 2), (8, "no url", "local", 1)]
    got = evidence.consolidated(spark.createDataFrame(found, "evidence_id long, url string, route string, run int")).collect()
    rows = {r.identity: (r.representative, r.n, [tuple(a) for a in r.associations]) for r in got}
    assert rows == {"https://e.org/a": (1, 2, [(1, "web", 2), (3, "web", 1)]), "id:7": (7, 2, [(7, "local", 1), (7, "local", 2)]), "id:8": (8, 1, [(8, "local", 1)])}


def test_completeness(spark):
    pages = ["<HTML><p>x</p></html>\n", "<html><p>x", None, "", "just text"]
    df = spark.createDataFrame([(p,) for p in pages], "html string")
    assert [r[0] for r in df.select(urls.completeness(F.col("html"))).collect()] == ["FULL", "PARTIAL", "UNKNOWN", "UNKNOWN", "UNKNOWN"]


FIELDS = [
    validation.Field("id", "integer", low=1, high=9), validation.Field("title", "text", size=5), validation.Field("kind", "text", required=False, allowed=("a", "b")), validation.Field("share", "number", required=False, low=0),
    validation.Field("done", "flag", required=False), validation.Field("parts", "list", required=False, size=2),
]


@pytest.mark.parametrize(
    "record, codes",
    [
        ('{"id": 3, "title": "abc", "kind": "a", "share": 0.5, "done": true, "parts": [1, {"x": 2}]}', []), ('{"id": 3, "title": "abc"}', []), ('{"id": "3", "title": "abc"}', ["WRONG_TYPE:id"]), ('{"id": 3.5, "title": 7}', ["WRONG_TYPE:id", "WRONG_TYPE:title"]),
        ("{}", ["MISSING:id", "MISSING:title"]), ('{"id": null, "title": "abcdef"}', ["MISSING:id", "TOO_LONG:title"]), ('{"id": 0, "title": "", "kind": "c", "share": -1}', ["NOT_ALLOWED:kind", "OUT_OF_RANGE:id", "OUT_OF_RANGE:share"]),
        ('{"id": 10, "title": "x", "done": "true", "parts": [1, 2, 3], "other": 1}', ["OUT_OF_RANGE:id", "TOO_LONG:parts", "UNKNOWN:other", "WRONG_TYPE:done"]), ('{"id": 1', ["MALFORMED"]), ("[1]", ["MALFORMED"]), ("7", ["MALFORMED"]), ("", ["MALFORMED"]), (None, ["MALFORMED"]),
    ],
)
def test_validation_codes(spark, record, codes):
    row = validation.validated(spark.createDataFrame([(1, record)], "n int, record string"), "record", FIELDS).first()
    assert list(row.codes) == codes and row.n == 1
    if not codes:
        assert row.value.id == 3 and row.value.title == "abc"


def test_open_schemas_keep_other_fields(spark):
    df = spark.createDataFrame([('{"id": 1, "title": "x", "other": 1}',)], "record string")
    assert list(validation.validated(df, "record", FIELDS, closed=False).first().codes) == []


def test_ablations(spark):
    ranked = spark.createDataFrame([(1, "a", "dense", 1), (1, "b", "dense", 2), (1, "b", "lexical", 1), (1, "c", "temporal", 1)], "query_id int, item string, route string, rank int")
    judged = spark.createDataFrame([(1, "b", False), (1, "c", True), (2, "z", False)], "query_id int, item string, dated boolean")
    out = fusion.ablations(ranked, {"dense": ["dense"], "lexical": ["lexical"], "all": ["dense", "lexical", "temporal"]}, judged, 2)
    assert {(r.subset, r.query_id): (r.recall, r.temporal_recall) for r in out.collect()} == {
        ("dense", 1): (0.5, 0.0), ("lexical", 1): (0.5, 0.0), ("all", 1): (0.5, 0.0), ("dense", 2): (0.0, None), ("lexical", 2): (0.0, None), ("all", 2): (0.0, None),
    }


def test_stage_metrics_cost_no_job(spark):
    tracker = spark.sparkContext.statusTracker()

    def jobs(f):
        group = f"g{id(f)}"
        spark.sparkContext.setJobGroup(group, group)
        f()
        n = len(tracker.getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return n

    df, log = spark.range(100), runs.StageLog(spark)
    from kairosift.session import saved

    plain = jobs(lambda: saved(df, "plain"))
    assert jobs(lambda: log.run("stage", df, rows=F.count(F.lit(1)), even=F.count_if(F.col("id") % 2 == 0))) == plain
    assert {(r.stage, r.metric): r.n for r in log.metrics().collect()} == {("stage", "rows"): 100, ("stage", "even"): 50} and log.seconds["stage"] > 0


def test_vectors_are_pinned(spark):
    got = {r["item"]: [round(x, 6) for x in r.v] for r in represent.fake_embedding(spark.createDataFrame([("x", "a"), ("y", None)], "item string, text string"), 4).collect()}
    import hashlib

    digest = hashlib.sha256(b"a").digest()
    raw = [int.from_bytes(digest[i : i + 2], "big") / 65535 - 0.5 for i in range(0, 8, 2)]
    size = sum(x * x for x in raw) ** 0.5
    assert got == {"x": [round(x / size, 6) for x in raw]}
