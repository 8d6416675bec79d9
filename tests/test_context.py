"""Context assembly on literals."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kairosift.operators import blocks, context, evidence, lifecycle
from kairosift.sources import intake

CLAIM = "query_id int, unit int, kind string, claim_id int, evidence_id int, value double, low int, high int, stance int"


def test_sides_and_groups(spark):
    rows = [
        (1, 1, "QUANTITY", 1, 11, 1.0, None, None, None), (1, 1, "QUANTITY", 2, 12, 1.4, None, None, None), (1, 1, "QUANTITY", 3, 13, 3.0, None, None, None), (1, 1, "QUANTITY", 9, 19, None, None, None, None),
        (1, 2, "TIME", 4, 14, None, 0, 10, None), (1, 2, "TIME", 5, 15, None, 3, 4, None), (1, 2, "TIME", 6, 16, None, 9, 12, None), (1, 2, "TIME", 7, 17, None, 13, 20, None), (1, 2, "TIME", 8, 18, None, 5, 1, None),
        (1, 3, "FACT", 20, 20, None, None, None, 1), (1, 3, "FACT", 21, 21, None, None, None, 0), (1, 3, "FACT", 22, 22, None, None, None, None), (2, 3, "FACT", 23, 23, None, None, None, 1), (2, 4, "EXPLANATION", 24, 24, None, None, None, 5), (2, 4, "EXPLANATION", 25, 24, None, None, None, 6),
        (3, 1, "OTHER", 30, 30, 1.0, 1, 2, 1),
    ]
    sided = context.sides(spark.createDataFrame(rows, CLAIM), 0.5)
    assert {r.claim_id: r.side for r in sided.collect()} == {1: 1, 2: 1, 3: 2, 9: None, 4: 1, 5: 1, 6: 1, 7: 2, 8: None, 20: 2, 21: 1, 22: None, 23: 1, 24: 1, 25: 2, 30: None}
    groups = {(r.query_id, r.unit): (r.conflict_type, r.n_sides, [(s.side, list(s.claims), list(s.evidence)) for s in r.competing]) for r in context.conflict_groups(sided).collect()}
    assert groups == {
        (1, 1): ("QUANTITATIVE_CONFLICT", 2, [(1, [1, 2], [11, 12]), (2, [3], [13])]), (1, 2): ("TEMPORAL_CONFLICT", 2, [(1, [4, 5, 6], [14, 15, 16]), (2, [7], [17])]),
        (1, 3): ("FACTUAL_CONFLICT", 2, [(1, [21], [21]), (2, [20], [20])]), (2, 4): ("INTERPRETATION_DIVERGENCE", 2, [(1, [24], [24]), (2, [25], [24])]),
    }


def test_priorities(spark):
    rows = [(1, 1, 9.0, 1, 1, 5, True, False), (1, 2, 8.0, 1, 1, 5, True, True), (1, 3, 1.0, 1, 2, 6, False, False), (1, 4, 7.0, 1, 1, 7, True, False), (1, 5, 6.0, None, None, 8, False, False), (1, 6, 5.0, None, None, 8, None, None)]
    df = spark.createDataFrame(rows, "query_id int, evidence_id int, score double, unit int, side int, family int, independent boolean, dated boolean")
    assert {r.evidence_id: r.priority for r in context.priorities(df).collect()} == {1: 1, 2: 4, 3: 2, 4: 3, 5: 5, 6: 5}


@pytest.mark.parametrize(
    "text, want",
    [("a b c", ("FULL", "a b c", 0, 5)), (" a\tb\n c d", ("EXTRACTED", " a\tb\n c", 0, 7)), ("a b c  \n", ("FULL", "a b c  \n", 0, 8)), ("", ("FULL", "", 0, 0)), (" \n", ("FULL", " \n", 0, 2)), ("é 😀 漢 x", ("EXTRACTED", "é 😀 漢", 0, 5)), (None, None)],
)
def test_extracts(spark, text, want):
    x = spark.createDataFrame([(text,)], "t string").select(context.extracted(F.col("t"), 3).alias("x")).first().x
    assert (x and (x.extent, x.text, x.spans[0].start, x.spans[0].end)) == want


def test_relations(spark):
    rows = [(1, "a", "Some text.", False), (2, "a", "Other words", True), (3, "b", "Some text.", True), (4, "c", "some, TEXT", True), (5, "d", "new", True), (6, None, "new too", False), (7, None, None, True), (8, None, None, False), (9, "e", "...", None)]
    df = spark.createDataFrame(rows, "evidence_id int, identity string, text string, basis boolean")
    got = {r.evidence_id: (r.relation, r.family) for r in context.relations(df).collect()}
    assert got == {
        1: ("UNKNOWN_DEPENDENCE", 1), 2: ("SAME_IDENTITY", 2), 3: ("EXACT_DUPLICATE", 1), 4: ("DERIVATIVE", 1), 5: ("INDEPENDENT", 5), 6: ("UNKNOWN_DEPENDENCE", 6), 7: ("INDEPENDENT", 7), 8: ("UNKNOWN_DEPENDENCE", 8),
        9: ("UNKNOWN_DEPENDENCE", 9),
    }


def test_budgets(spark):
    t0 = datetime(2024, 1, 1)
    rows = [(1, i, t0 + timedelta(seconds=10 * i), "s1" if i < 3 else "s2", kind, retry) for i, (kind, retry) in enumerate([("SEARCH", None), ("REFORMULATION", None), ("SUBQUERY", 0), ("SUBQUERY", 0), ("REFORMULATION", 0)])]
    calls = spark.createDataFrame(rows, "query_id int, call_id int, at timestamp, source string, kind string, retry_of int")
    limits = {"tool_calls": 4, "source_attempts": 2, "retries": 2, "reformulations": 1, "subqueries": 1, "deadline": 35}
    assert [list(r.over) for r in context.budget_overruns(calls, limits).orderBy("call_id").collect()] == [[], [], ["source_attempts"], ["subqueries"], ["tool_calls", "retries", "reformulations", "deadline"]]
    assert all(not r.over for r in context.budget_overruns(calls, {}).collect())


def test_block_order(spark):
    rows = [(1, "b0000", "x" * 20), (1, "b0001", "y"), (2, "b0001", "x" * 20), (3, "b0000", "x" * 20), (3, "b0000", "y"), (4, "c1", "x" * 20), (5, "b0000", "x")]
    b = spark.createDataFrame(rows, "doc_id int, block_id string, text string").withColumn("type", F.lit("PARAGRAPH"))
    assert {r.doc_id: r.error for r in blocks.parse_report(b, b).collect()} == {1: None, 2: "block_order", 3: "block_order", 4: "block_order", 5: "empty_extraction"}


def test_files_that_cannot_be_read(spark):
    files = spark.createDataFrame([(1, bytearray(b"%PDF-1.4 x %%EOF")), (2, bytearray(b"%PDF-1.4 /Encrypt 5 0 R %%EOF")), (3, bytearray(b"<html>")), (4, bytearray(b"%PDF-1.4 cut"))], "doc_id int, content binary")
    pages = spark.createDataFrame([(i, 0, "") for i in (1, 2, 3, 4)], "doc_id int, page int, line string")
    assert {r.doc_id: r.error for r in intake.page_report(pages, files).collect()} == {1: "scanned_or_image_only", 2: "encrypted_document", 3: "corrupt_document", 4: "corrupt_document"}


def test_artifacts_are_validated(spark):
    good = spark.createDataFrame([("t", ["a\n\"b\"", ""])], "title string, blocks array<string>").select(intake.read_artifact(intake.artifact(F.col("title"), F.col("blocks"))).alias("a")).first().a
    assert (good.title, list(good.blocks)) == ("t", ["a\n\"b\"", ""])
    with pytest.raises(Exception):  # noqa: B017
        spark.createDataFrame([('{"title": ["x"], "blocks": 7}',)], "x string").select(intake.read_artifact(F.col("x"))).collect()


def test_lexemes(spark):
    df = spark.createDataFrame([("...",), ("The of",), ("the bridge",), ("7",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(lifecycle.no_lexeme(F.col("t"))).collect()] == [True, True, False, False, True, True]


def test_extracts_look_at_a_head_once(spark):
    rows = [(1, " one  two \n"), (2, "one two three \x0b"), (3, " \t"), (4, ""), (5, None), (6, "one\x0btwo\xa0three " + " " * 9), (7, "one two" + " " * 60_000 + "three")]
    df = spark.createDataFrame(rows, "id int, text string").select("id", context.extracted(F.col("text"), 2).alias("x"))
    df = df.select("id", "x.extent", "x.text", F.col("x.spans")[0]["end"].alias("end"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 1  # before: once for each of its uses, and a lazy one over the whole text
    got = {r.id: (r.extent, r.text, r.end) for r in df.collect()}
    assert got == {
        1: ("FULL", " one  two \n", 11), 2: ("EXTRACTED", "one two", 7), 3: ("FULL", " \t", 2), 4: ("FULL", "", 0), 5: (None, None, None),
        6: ("FULL", rows[5][1], 23), 7: ("EXTRACTED", "one two", 7),
    }


@pytest.mark.parametrize("hot", [0, 3, 100])
def test_dangling_claims_of_one_thing_share_no_task(spark, monkeypatch, hot):
    monkeypatch.setattr(evidence, "HOT", hot)
    asked = [(i, -1 if i % 7 == 0 else None if i % 7 == 1 else i, i % 5) for i in range(200)] + [(201, 500, 1), (7, -1, 1)]
    claims = spark.createDataFrame(asked, "claim_id int, item_id int, unit int")
    known = spark.createDataFrame([(i, i % 3) for i in range(200) for _ in range(2)] + [(None, None)], "item_id int, unit int")
    found = evidence.dangling(claims, "item_id", known, "ITEM")
    assert sorted(tuple(r) for r in found.collect()) == sorted((c, "ITEM") for c, i, _ in asked if i in (-1, 500))
    assert sorted(tuple(r) for r in evidence.dangling(claims, "unit", known, "UNIT").collect()) == sorted((c, "UNIT") for c, _, u in asked if u > 2)
    assert evidence.dangling(claims, "item_id", claims, "NONE").count() == 0
    if hot == 3:  # the 30 claims of -1 aren't dealt by it
        assert "BroadcastHashJoin" in found._jdf.queryExecution().sparkPlan().toString()
        assert evidence.violations(found, found).count() == len({c for c, i, _ in asked if i in (-1, 500)})
