"""Retrieval of requests in a batch: what is refused, what a lost route costs, what a moved snapshot does."""

import threading
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from kairosift.operators import requests, retrieval, routes


def small_engine(spark):
    """Six chunks of three documents; document 3 isn't in scope."""
    chunk = lambda i, doc, text: (f"c{i}", doc * 10, doc, "one" if doc < 3 else "two", i, "pg", text)
    c = [chunk(0, 1, "the old bridge"), chunk(1, 1, "a bridge of stone"), chunk(2, 2, "Bridge AB12 fell"), chunk(3, 2, "nothing here"), chunk(4, 3, "bridge bridge"), chunk(5, 2, "the river")]
    docs = [(d, "one" if d < 3 else "two", d * 10) for d in (1, 2, 3)]
    tables = {
        "chunks": spark.createDataFrame(c, "chunk_id string, version_id long, document_id long, corpus_id string, ordinal long, pg string, source_text string"),
        "documents": spark.createDataFrame(docs, "document_id long, corpus_id string, active_version_id long"),
        "versions": spark.createDataFrame([(v, "READY", "pg") for _, _, v in docs], "version_id long, status string, published_pg string"),
        "representations": spark.createDataFrame([(x[0], "srg1") for x in c], "chunk_id string, srg string"),
        "mentions": spark.createDataFrame([("c1", 7, "CONTENT_MENTION", *routes.asked_bounds(1900)), ("c3", 8, "SOURCE_METADATA", *routes.asked_bounds(1900, 5)), ("c4", 9, "CONTENT_MENTION", *routes.asked_bounds(1900))], "item string, mention_id long, origin string, bound_low int, bound_high int"),
    }
    vectors = spark.createDataFrame([(x[0], [1.0, float(i)]) for i, x in enumerate(c)], "chunk_id string, v array<double>")
    return tables, vectors


def state_of(spark, **changed):
    tables, vectors = small_engine(spark)
    return retrieval.State(tables | {"vectors": vectors} | changed, model="fake", dims=2)


REQUEST = {"query_id": 1, "query": "the bridge", "corpora": ["one"], "query_vector": [1.0, 0.0]}
SCHEMA = (
    "query_id long, query string, corpora array<string>, query_vector array<double>, model string, profile string, relation string, q_low int, q_high int, q_month int, q_day int, "
    "constraint string, s_low int, s_high int"
)


def asked(spark, *rows):
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple((REQUEST | {"query_id": i + 1} | r).get(n) for n in names) for i, r in enumerate(rows)], SCHEMA)


def run(spark, *rows, capture=None, **more):
    state = None if capture else state_of(spark)
    out = retrieval.retrieve(spark, asked(spark, *rows), capture or (lambda: state), **more)
    found = {}
    for r in out.candidates.collect():
        found.setdefault(r.query_id, []).append(r)
    return {r.query_id: r for r in out.requests.collect()}, {q: sorted(rs, key=lambda r: r.rank) for q, rs in found.items()}, out


YEAR = {"relation": "RANGE", "q_low": routes.asked_bounds(1900, 3)[0], "q_high": routes.asked_bounds(1900, 7)[1]}


def test_a_batch(spark):
    told, found, out = run(spark, {}, {"query": "AB12.", "query_vector": None}, YEAR, {"query": "the of"}, {"corpora": ["one", "two"], "query": '"bridge bridge"'}, {"corpora": ["one", "gone"]})
    assert told[1].outcome == "SUCCESS_WITH_CANDIDATES" and told[1].errors == [] and told[1].route_counts == {"dense": 5, "lexical": 3} and not told[1].fallback
    first = found[1][0]
    assert (first["item"], first.routes, first.n_routes) == ("c0", "dense,lexical", 2) and abs(first.score - 2 / 61) < 1e-9 and first.signals["dense"]["rank"] == 1
    assert {r["item"] for r in found[1]} == {"c0", "c1", "c2", "c3", "c5"} and first.document_id == 1 and first.mentions is None
    # without a vector: degraded; the token is found whatever stands behind it
    assert told[2].outcome == "SUCCESS_DEGRADED" and told[2].errors == ["QUERY_EMBEDDING_FAILED"] and told[2].fallback and [r["item"] for r in found[2]] == ["c2"]
    third = {r["item"]: r for r in found[3]}
    assert told[3].route_counts["temporal"] == 2 and told[3].profile == "TEMPORAL_RANGE" and told[3].profile_source == "DERIVED"
    assert third["c1"].mentions == [7] and "temporal" in third["c1"].routes and 0 < third["c3"].adjustment < third["c1"].adjustment
    assert told[4].outcome == "SUCCESS_WITH_CANDIDATES" and told[4].fallback and set(told[4].route_counts) == {"dense"}
    assert found[5][0]["item"] == "c4"  # the phrase; document 3 is in scope here
    assert told[6].outcome == "SUCCESS_DEGRADED" and told[6].warnings == ["gone"] and len(found[6]) == 5
    assert set(out.phases) >= {"dense", "lexical", "literal", "temporal", "shortlist", "validation"} and out.routes == {n: None for n in ("dense", "lexical", "literal", "temporal")}


@pytest.mark.parametrize(
    "change, error",
    [
        ({"profile": "DEEP"}, "INVALID_RETRIEVAL_REQUEST"), ({"relation": "NEAR", "q_low": 1, "q_high": 2}, "INVALID_RETRIEVAL_REQUEST"), ({"relation": "RANGE"}, "INVALID_RETRIEVAL_REQUEST"),
        ({"relation": "RANGE", "q_low": 5, "q_high": 4}, "INVALID_RETRIEVAL_REQUEST"), ({"relation": "RECURRING", "q_month": 13, "q_day": 1}, "INVALID_RETRIEVAL_REQUEST"),
        ({"constraint": "AUTHOR", "s_low": 1, "s_high": 2}, "INVALID_RETRIEVAL_REQUEST"), ({"constraint": "SOURCE_TIME"}, "INVALID_RETRIEVAL_REQUEST"), ({"query": None}, "INVALID_RETRIEVAL_REQUEST"),
        ({"corpora": []}, "NO_EXECUTABLE_CORPUS_SCOPE"), ({"corpora": None}, "NO_EXECUTABLE_CORPUS_SCOPE"), ({"corpora": ["gone"]}, "NO_EXECUTABLE_CORPUS_SCOPE"),
        ({"model": "other"}, "EMBEDDING_GENERATION_INCOMPATIBLE"), ({"query_vector": [1.0]}, "EMBEDDING_GENERATION_INCOMPATIBLE"),
        ({}, None), ({"profile": "TIMELINE"}, None), ({"relation": "RECURRING", "q_month": 5, "q_day": 31}, None),
    ],
)
def test_checks_before_a_search(spark, change, error):
    docs = spark.createDataFrame([(1, "one")], "document_id long, corpus_id string")
    row = retrieval.checked_requests(asked(spark, change), docs, "fake", 2).first()
    assert row.error == error


def test_refused_requests_come_back(spark):
    told, found, _ = run(spark, {"profile": "DEEP"}, {})
    assert told[1].outcome == "FAILURE" and told[1].errors == ["INVALID_RETRIEVAL_REQUEST"] and 1 not in found and told[2].outcome == "SUCCESS_WITH_CANDIDATES"


def test_recurring_and_other_relations(spark):
    state = state_of(spark)
    dated = state.tables["mentions"].withColumns({"start_month": F.when(F.col("mention_id") == 7, 3), "start_day": F.when(F.col("mention_id") == 7, 15)})
    state = replace(state, tables=state.tables | {"mentions": dated})
    low, high = routes.asked_bounds(1901)
    rows = [{"relation": "RECURRING", "q_month": 3, "q_day": 15}, {"relation": "BEFORE", "q_low": low, "q_high": high}, {"relation": "AFTER", "q_low": low, "q_high": high}, {"relation": "AROUND", "q_low": low, "q_high": high}]
    told, found, _ = run(spark, *rows, capture=lambda: state)
    assert [told[i].route_counts.get("temporal") for i in (1, 2, 3, 4)] == [1, 2, None, 2]
    assert [told[i].profile for i in (1, 2, 4)] == ["TEMPORAL_POINT", "TEMPORAL_RANGE", "TEMPORAL_RANGE"]


def test_source_time_bounds_every_route(spark):
    may = routes.asked_bounds(1900, 5)
    told, found, _ = run(spark, {"constraint": "SOURCE_TIME", "s_low": may[0], "s_high": may[1]}, {"constraint": "SOURCE_TIME", "s_low": may[0], "s_high": may[1], "query": "nothing"} | YEAR)
    assert {r["item"] for rs in found.values() for r in rs} == {"c3"}  # the one item whose source is of that month
    assert told[1].route_counts == {"dense": 1} and told[2].route_counts == {"dense": 1, "lexical": 1, "temporal": 1}


def broken(spark, *names):
    """A state some of whose routes can't read what they need."""
    state, fail = state_of(spark), F.raise_error(F.lit("lost"))
    tables = dict(state.tables)
    if "dense" in names:
        tables["vectors"] = tables["vectors"].withColumn("v", F.when(F.length("chunk_id") > 0, fail.cast("array<double>")))
    if "temporal" in names:
        tables["mentions"] = tables["mentions"].withColumn("bound_low", F.when(F.length("item") > 0, fail.cast("int")))
    return replace(state, tables=tables)


@pytest.mark.parametrize(
    "lost, request_, outcome, errors",
    [
        ("dense", {}, "SUCCESS_DEGRADED", ["VECTOR_SEARCH_FAILED"]), ("lexical", {}, "SUCCESS_DEGRADED", ["LEXICAL_SEARCH_FAILED"]), ("dense lexical", {}, "FAILURE", ["VECTOR_SEARCH_FAILED", "LEXICAL_SEARCH_FAILED"]),
        ("dense lexical", YEAR, "SUCCESS_DEGRADED", ["VECTOR_SEARCH_FAILED", "LEXICAL_SEARCH_FAILED"]), ("literal", {"query": "AB12"}, "SUCCESS_DEGRADED", ["LITERAL_FALLBACK_FAILED"]),
        ("literal", {}, "SUCCESS_WITH_CANDIDATES", []), ("dense lexical temporal", YEAR, "FAILURE", ["VECTOR_SEARCH_FAILED", "LEXICAL_SEARCH_FAILED", "TEMPORAL_SEARCH_FAILED"]),
    ],
)
def test_lost_routes(spark, monkeypatch, lost, request_, outcome, errors):
    names, whole = lost.split(), retrieval.Tasks.run

    def failing(self, name, plan, schema):
        return whole(self, name, (lambda: plan().withColumn("score", F.raise_error(F.lit("lost")).cast("double"))) if name in names else plan, schema)

    monkeypatch.setattr(retrieval.Tasks, "run", failing)
    told, found, out = run(spark, request_)
    assert told[1].outcome == outcome and sorted(told[1].errors) == sorted(errors) and (1 in found) == (outcome != "FAILURE")
    assert {n for n, e in out.routes.items() if e} == {n for n in names if retrieval.FAILED[n] in errors}


def test_a_temporal_route_that_dies_in_its_tasks(spark):
    told, _, _ = run(spark, {}, capture=lambda: broken(spark, "dense"))
    assert told[1].outcome == "SUCCESS_DEGRADED" and told[1].errors == ["VECTOR_SEARCH_FAILED"]


def test_a_slow_route_is_cancelled(spark):
    """The tag's jobs are cancelled at the deadline, long before the route would end by itself."""
    tasks = retrieval.Tasks(spark, 4000)

    def slow(batches):
        for batch in batches:
            time.sleep(60)
            yield batch

    began = time.monotonic()
    rows = tasks.run("dense", lambda: spark.range(1).mapInArrow(slow, "id long"), "id long")
    assert rows.count() == 0 and tasks.errors == {"dense": "REQUEST_DEADLINE_EXCEEDED"} and time.monotonic() - began < 30
    assert not [t for t in threading.enumerate() if isinstance(t, threading.Timer) and t.is_alive()]
    assert spark.range(3).count() == 3  # later jobs don't carry the tag


def test_a_deadline_that_has_passed(spark):
    told, found, _ = run(spark, {}, YEAR, deadline_ms=0.001)
    assert {r.outcome for r in told.values()} == {"FAILURE"} and all("REQUEST_DEADLINE_EXCEEDED" in r.errors for r in told.values()) and not found


def captures(*states):
    states = list(states)
    return lambda: states.pop(0) if len(states) > 1 else states[0]


def test_candidates_are_checked_again(spark):
    state = state_of(spark)
    moved = state.tables["documents"].withColumn("active_version_id", F.expr("if(document_id = 1, -1, active_version_id)"))
    later = replace(state, tables=state.tables | {"documents": moved})
    told, found, _ = run(spark, {}, capture=captures(state, later), config=requests.RetrievalConfig(output_limit=2))
    assert [r["item"] for r in found[1]] == ["c2", "c3"] and told[1].rejected == {"VERSION_REPLACED": 2} and told[1].outcome == "SUCCESS_WITH_CANDIDATES"
    gone = replace(state, tables=state.tables | {"documents": state.tables["documents"].where("false")})
    told, found, _ = run(spark, {}, capture=captures(state, gone))
    assert told[1].errors == ["ELIGIBILITY_STATE_CHANGED"] and told[1].n_candidates == 0 and told[1].rejected == {"DOCUMENT_DELETED": 5}


def test_a_moved_pointer_fails_closed(spark):
    state = state_of(spark)
    told, found, _ = run(spark, {}, capture=captures(state, replace(state, srg="srg2")))
    assert told[1].outcome == "FAILURE" and told[1].errors == ["SEARCH_GENERATION_CHANGED"] and not found


def test_tables_that_cannot_be_read(spark):
    def lost():
        raise OSError("no such store")

    told, found, _ = run(spark, {}, capture=lost)
    assert told[1].outcome == "FAILURE" and told[1].errors == ["DATABASE_UNAVAILABLE"]
    state, calls = state_of(spark), []

    def lost_later():
        calls.append(1)
        return state if len(calls) == 1 else lost()

    told, found, _ = run(spark, {}, capture=lost_later)
    assert told[1].outcome == "FAILURE" and told[1].errors == ["ELIGIBILITY_VALIDATION_FAILED"] and not found


def test_candidates_without_lineage_are_left_out(spark):
    state = state_of(spark)
    chunks = state.tables["chunks"].withColumn("source_text", F.expr("if(chunk_id = 'c0', null, source_text)")).withColumn("contextualized_text", F.lit("bridge"))
    told, found, _ = run(spark, {}, capture=lambda: replace(state, tables=state.tables | {"chunks": chunks}))
    assert told[1].outcome == "SUCCESS_DEGRADED" and told[1].errors == ["MALFORMED_CANDIDATE_METADATA"] and "c0" not in {r["item"] for r in found[1]}


def test_the_fallback_has_a_switch(spark):
    told, found, _ = run(spark, {"query": "AB12", "query_vector": None}, config=requests.RetrievalConfig(literal_fallback=False))
    assert not told[1].fallback and set(told[1].route_counts) == {"lexical"}


def test_rounds_and_dense(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)] + [(90, None), (91, [0.0, 0.0]), (92, [float("nan"), 1.0]), (93, [1.0])], "item long, v array<double>")
    q = v.where("item < 30").selectExpr("item as query_id", "v as qv")
    parts = routes.rounds(q, "query_id", 7)
    assert len(parts) > 3 and sum(p.count() for p in parts) == 30
    whole = routes.dense(q, v, 3, own=False)
    assert whole.count() == 90 and whole.where("query_id = item or item >= 90").isEmpty()
    assert "NestedLoop" not in whole._jdf.queryExecution().executedPlan().toString()
    assert routes.dense(q.where("false"), v, 3).count() == 0
    tied = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(2000)], "item long, v array<double>").repartition(3)
    assert [r["item"] for r in routes.dense(q.where("query_id = 1"), tied, 3).orderBy("rank").collect()] == [1, 3, 5]
