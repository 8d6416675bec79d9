"""Effects of ingestion: snapshots, publication, reconciliation, vectors by batch, the worker queue."""

import random
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kairosift.operators import ingestion, represent, retrieval
from kairosift.sources.snapshots import PublicationConflict, Snapshots
from kairosift.streaming import queue


def folder():
    return "file://" + tempfile.mkdtemp(prefix="spark-")


# ---- snapshots and publication


def test_snapshots(spark):
    store = Snapshots(spark, folder() + "/store")
    assert store.newest().number == 0
    one = store.publish(store.newest(), {"a": spark.range(3), "b": spark.range(1)}, srg="srg1")
    held = store.read(one)
    two = store.publish(one, {"a": spark.range(5)})
    assert store.newest() == two and two.number == 2 and two.pointers == {"srg": "srg1"} and two.paths["b"] == one.paths["b"]
    assert held["a"].count() == 3 and store.read(two)["a"].count() == 5  # the old reader still sees its own
    with pytest.raises(PublicationConflict):
        store.publish(one, {"a": spark.range(9)})
    with pytest.raises(Exception):  # noqa: B017  a table that can't be written: the pointer stays
        store.publish(two, {"a": spark.range(2).select(F.raise_error(F.lit("lost")).alias("id"))})
    assert store.newest() == two


def tables(spark):
    """Document 1 with its active version 10 and the new 11, document 2 with the new version 20 that lacks a vector, document 3 at rest."""
    chunk = lambda v, doc, n, text, pg: (f"{v}:{n}", v, doc, "one", n, pg, text, 0, len(text))
    chunks = [chunk(10, 1, 0, "old text", "pg1"), chunk(11, 1, 0, "new text", "pg2"), chunk(11, 1, 1, "more text", "pg2"), chunk(20, 2, 0, "a text", "pg2"), chunk(30, 3, 0, "at rest", "pg1")]
    return {
        "chunks": spark.createDataFrame(chunks, "chunk_id string, version_id long, document_id long, corpus_id string, ordinal long, pg string, source_text string, span_start int, span_end int"),
        "versions": spark.createDataFrame(
            [(10, 1, "one", 0, "READY", "pg1", []), (11, 1, "one", 1, "RUNNING", None, ["TEMPORAL"]), (20, 2, "one", 0, "RUNNING", None, []), (30, 3, "one", 0, "READY", "pg1", [])],
            "version_id long, document_id long, corpus_id string, version_no int, status string, published_pg string, degraded array<string>",
        ),
        "documents": spark.createDataFrame([(1, "one", 10), (2, "one", None), (3, "one", 30)], "document_id long, corpus_id string, active_version_id long"),
        "representations": spark.createDataFrame([(c[0], "srg1") for c in chunks if c[1] != 20], "chunk_id string, srg string"),
        "mentions": spark.createDataFrame([("11:0", 11, 5, 9, 1, "CONTENT_MENTION", 0, 0)], "item string, version_id long, start_offset int, end_offset int, mention_id long, origin string, bound_low int, bound_high int"),
        "vectors": spark.createDataFrame([(c[0], [1.0, 0.0]) for c in chunks], "chunk_id string, v array<double>"),
    }


def test_publication(spark):
    store = Snapshots(spark, folder())
    base = store.publish(store.newest(), tables(spark), srg="srg1")
    wanted = spark.createDataFrame([(11, "pg2"), (20, "pg2")], "version_id long, pg string")
    out = ingestion.publish_versions(store, wanted, "srg1")
    assert [tuple(r) for r in out.failures.collect()] == [(20, "missing_vector")] and out.snapshot.number == base.number + 1
    now = store.read(out.snapshot)
    assert {r.version_id: (r.status, r.published_pg, r.error) for r in now["versions"].collect()} == {
        10: ("READY", "pg1", None), 11: ("READY_DEGRADED", "pg2", None), 20: ("FAILED", None, "missing_vector"), 30: ("READY", "pg1", None),
    }
    assert {r.document_id: r.active_version_id for r in now["documents"].collect()} == {1: 11, 2: None, 3: 30}
    assert {r.document_id: r.active_version_id for r in store.read(base)["documents"].collect()} == {1: 10, 2: None, 3: 30}
    # a generation that isn't the active one any more
    later = store.publish(out.snapshot, {}, srg="srg2")
    again = ingestion.publish_versions(store, wanted.where("version_id = 11"), "srg1")
    assert [r.failure for r in again.failures.collect()] == ["superseded_representation"] and store.newest().number == later.number + 1
    assert {r.document_id: r.active_version_id for r in store.read(again.snapshot)["documents"].collect()}[1] == 11


def test_a_retrieval_reads_one_snapshot(spark):
    """Published between its two reads: a moved generation fails closed, a new version is seen by the final check, never a mixture."""
    request = spark.createDataFrame([(1, "text", ["one"], [1.0, 0.0])], "query_id long, query string, corpora array<string>, query_vector array<double>")

    def between(change):
        store = Snapshots(spark, folder())
        store.publish(store.newest(), tables(spark), srg="srg1")
        calls = []

        def capture():
            if calls:
                change(store)
            calls.append(1)
            at = store.newest()
            return retrieval.State(store.read(at), at.pointers["srg"], at.name)

        out = retrieval.retrieve(spark, request, capture)
        return out.requests.first(), {r["item"] for r in out.candidates.collect()}

    told, found = between(lambda store: None)
    assert found == {"10:0", "30:0"} and told.snapshot == "snapshot-1" and told.outcome == "SUCCESS_WITH_CANDIDATES"
    told, found = between(lambda store: store.publish(store.newest(), {}, srg="srg2"))
    assert not found and told.errors == ["SEARCH_GENERATION_CHANGED"]
    told, found = between(lambda store: ingestion.publish_versions(store, spark.createDataFrame([(11, "pg2")], "version_id long, pg string"), "srg1"))
    assert found == {"30:0"} and told.rejected == {"VERSION_REPLACED": 1}


# ---- reconciliation


def chunk_rows(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, version_id long, pg string, ordinal long, source_text string, content_hash string")


def test_reconciled_chunks(spark):
    base = folder()
    old = [(f"{v}:{n}", v, "pg1", n, f"t{v}.{n}", f"h{v}.{n}") for v in range(1, 40) for n in range(3)] + [("x", 1, "pg0", 0, "other generation", "h")]
    ingestion.write_parts(chunk_rows(spark, old), f"{base}/chunks", 8)
    for name in ("representations", "mentions"):
        ingestion.write_parts(spark.createDataFrame([(r[0], r[1], "srg1") for r in old], "chunk_id string, version_id long, srg string"), f"{base}/{name}", 8)
    before = {r.chunk_id: r.file for r in spark.read.parquet(f"{base}/chunks").withColumn("file", F.input_file_name()).collect()}
    # version 1: first kept, second changed, third gone, a fourth new; version 2 as it was; version 99 is new
    drafts = [("", 1, "pg1", 0, "t1.0", "h1.0"), ("", 1, "pg1", 1, "changed", "new"), ("", 1, "pg1", 3, "added", "h1.3"), *[("", 2, "pg1", n, "ignored", f"h2.{n}") for n in range(3)], ("", 99, "pg1", 0, "first", "h99")]
    new = chunk_rows(spark, drafts).drop("chunk_id")
    assert {r.action: r.n for r in ingestion.apply_chunks(spark, base, new, 8).collect()} == {"KEEP": 4, "UPDATE": 1, "DELETE": 1, "INSERT": 2}
    rows = {r.chunk_id: r for r in spark.read.parquet(f"{base}/chunks").withColumn("file", F.input_file_name()).collect()}
    want = {r[0]: r[4] for r in old if r[0] != "1:2"} | {"1:1": "changed", "1:pg1:3": "added", "99:pg1:0": "first"}
    assert {i: r.source_text for i, r in rows.items()} == want
    changed = {r.part for r in rows.values() if r.version_id in (1, 99)}
    assert all(r.file == before[i] for i, r in rows.items() if r.part not in changed) and len({r.part for r in rows.values()} - changed) > 3
    for name in ("representations", "mentions"):
        left = {r.chunk_id for r in spark.read.parquet(f"{base}/{name}").collect()}
        assert left == {r[0] for r in old} - {"1:1", "1:2"}  # the changed and the deleted one lost theirs
    assert {r.action: r.n for r in ingestion.apply_chunks(spark, base, new, 8).collect()} == {"KEEP": 7}
    # nothing is left of a part whose one version is emptied
    alone = folder()
    ingestion.write_parts(chunk_rows(spark, old[:3] + old[6:9]), f"{alone}/chunks", 64)
    for name in ("representations", "mentions"):
        ingestion.write_parts(spark.createDataFrame([(r[0], r[1]) for r in old[:3] + old[6:9]], "chunk_id string, version_id long"), f"{alone}/{name}", 64)
    ingestion.apply_chunks(spark, alone, chunk_rows(spark, [("", 1, "pg1", 9, "only", "h9")]).drop("chunk_id"), 64)
    assert {r.chunk_id for r in spark.read.parquet(f"{alone}/chunks").collect()} == {"1:pg1:9", "3:0", "3:1", "3:2"}
    assert {r.chunk_id for r in spark.read.parquet(f"{alone}/mentions").collect()} == {"3:0", "3:1", "3:2"}


def test_reconciliation_moves_texts_once(spark, monkeypatch):
    base, texts = folder(), ["".join(random.Random(i).choices("abcdefgh", k=2000)) for i in range(60)]
    old = [(f"{v}:{n}", v, "pg1", n, texts[v], f"h{v}") for v in range(60) for n in range(9)]
    ingestion.write_parts(chunk_rows(spark, old), f"{base}/chunks", 8)
    for name in ("representations", "mentions"):
        ingestion.write_parts(chunk_rows(spark, old).select("chunk_id", "version_id"), f"{base}/{name}", 8)
    plans, plain = [], ingestion.saved
    monkeypatch.setattr(ingestion, "saved", lambda df, *rest: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df, *rest))
    drafts = chunk_rows(spark, [("", v, "pg1", n, texts[v], f"h{v}" if n else "new") for v in range(0, 60, 2) for n in range(9)]).drop("chunk_id")
    assert {r.action: r.n for r in ingestion.apply_chunks(spark, base, drafts, 8).collect()} == {"KEEP": 240, "UPDATE": 30}
    assert len(plans) == 3 and plans[0].count("Exchange hashpartitioning") == 1  # no table of all chunks but the plan's, and one shuffle for it
    held = spark.read.parquet(f"{base}/chunks").select("chunk_id", "source_text", "content_hash").collect()
    assert sorted(held) == sorted((i, text, "new" if v % 2 == 0 and n == 0 else h) for i, v, _, n, text, h in old)


# ---- vectors


def test_vectors_are_committed_by_batch(spark):
    base = folder()
    for n in range(4):
        rows = [(f"c{n}.{i}", f"text {n} {i}") for i in range(5)]
        spark.createDataFrame(rows, "chunk_id string, source_text string").coalesce(1).write.mode("append").parquet(f"{base}/chunks")
    asked = []

    def embed(chunks, broken=()):
        rows = chunks.collect()
        asked.extend(r.chunk_id for r in rows)
        if len(asked) > 10 and broken:
            raise OSError("provider is down")
        return spark.createDataFrame([(r.chunk_id, [float(x) for x in represent.unit_vector(r.text, 4)]) for r in rows], "chunk_id string, v array<double>")

    with pytest.raises(Exception, match="provider is down"):
        ingestion.embed_batches(spark, f"{base}/chunks", f"{base}/out", f"{base}/ledger1", "srg1", lambda df: embed(df, ("x",)))
    done = {r.chunk_id for r in ingestion.vectors(spark, f"{base}/out").collect()}
    assert len(done) == 10  # two batches of files are paid for
    asked.clear()
    out = ingestion.embed_batches(spark, f"{base}/chunks", f"{base}/out", f"{base}/ledger1", "srg1", embed)
    assert out.count() == 20 == out.select("chunk_id").distinct().count() and len(asked) == 10 and not done & set(asked)
    asked.clear()
    assert ingestion.embed_batches(spark, f"{base}/chunks", f"{base}/out", f"{base}/ledger2", "srg1", embed).count() == 20 and not asked  # a new run embeds nothing
    assert ingestion.embed_batches(spark, f"{base}/chunks", f"{base}/out", f"{base}/ledger3", "srg2", embed).count() == 20 and len(asked) == 20


# ---- the queue


def brute(events, watermark, stale, ttl):
    """The transitions of one job's events up to the watermark, told again as plain rules."""
    out, state, attempts, beat, end = [], "PENDING", 0, None, None
    for at, _, kind in sorted(e for e in events if e[0] <= watermark) + [(watermark, 0, "LOOK")]:
        if state == "CLAIMED" and at > beat + stale:
            out.append((beat + stale, "RECLAIMED", attempts))
            state = "STALE"
        if kind == "LOOK":
            continue
        if state in ("DONE", "FAILED"):
            if at <= end + ttl:
                continue
            state, attempts = "PENDING", 0
        if kind == "BEAT":
            if state != "CLAIMED":
                attempts += state == "PENDING"
                state = "CLAIMED"
                out.append((at, "CLAIMED", attempts))
            beat = at
        elif state == "CLAIMED":
            state = "DONE" if kind == "DONE" else "PENDING" if attempts < 3 else "FAILED"
            end = at
            out.append((at, state, attempts))
    return out


def streamed(spark, files, stale, ttl, late="10 minutes"):
    base = folder()
    for n, rows in enumerate(files):
        spark.createDataFrame(rows, "job_id long, ts timestamp, event_id long, kind string").coalesce(1).write.parquet(f"{base}/in/{n}")
    paths = spark.readStream.schema("job_id long, ts timestamp, event_id long, kind string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{base}/in")
    was = {k: spark.conf.get(k, None) for k in queue.STATE_STORE}
    for k, v in queue.STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        return queue.kept(queue.transitions(paths, late, int(stale.total_seconds()), int(ttl.total_seconds())), f"{base}/out", f"{base}/checkpoint", "queue").collect()
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_queue_of_events(spark):
    """All events in three files end as the rules say, up to the last watermark."""
    events = queue.job_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet")).orderBy("ts", "event_id").collect()
    third = -(-len(events) // 3)
    stale, ttl = timedelta(hours=6), timedelta(days=2)
    got = streamed(spark, [events[i : i + third] for i in range(0, len(events), third)], stale, ttl)
    watermark = max(e.ts for e in events) - timedelta(minutes=10)
    watermark = watermark.replace(microsecond=watermark.microsecond // 1000 * 1000)  # watermarks are milliseconds
    jobs = {}
    for e in events:
        jobs.setdefault(e.job_id, []).append((e.ts, e.event_id, e.kind))
    want = sorted((j, *t) for j, rows in jobs.items() for t in brute(rows, watermark, stale, ttl))
    assert sorted((r.job_id, r["at"], r.transition, r.attempts) for r in got) == want and {t[2] for t in want} == {"CLAIMED", "RECLAIMED", "PENDING", "DONE", "FAILED"}


def test_queue_out_of_order_late_and_stale(spark):
    t0 = datetime(2024, 1, 1)
    at = lambda s: t0 + timedelta(seconds=s)
    rng = random.Random(3)
    one = [(1, at(0), 1, "BEAT"), (1, at(500), 4, "BEAT"), (2, at(0), 1, "BEAT"), (3, at(0), 1, "BEAT"), (3, at(10), 2, "FAIL"), (None, at(5), 3, "BEAT"), (4, at(3), 1, "FAIL")]
    two = [(1, at(280), 2, "BEAT"), (3, at(100), 3, "BEAT"), (3, at(110), 4, "FAIL"), (3, at(120), 5, "BEAT"), (3, at(130), 6, "FAIL"), (3, at(140), 7, "BEAT"), (9, at(3000), 1, "BEAT")]
    three = [(1, at(2900), 5, "DONE"), (9, at(3100), 2, "DONE"), (8, at(9000), 1, "BEAT")]
    four = [(2, at(200), 2, "BEAT"), (8, at(9100), 2, "BEAT")]  # job 2's beat comes when its claim has gone back
    for rows in (one, two, three, four):
        rng.shuffle(rows)
    got = streamed(spark, [one, two, three, four], timedelta(seconds=300), timedelta(days=1))
    found = {}
    for r in sorted(got, key=lambda r: (r["at"], r.attempts)):
        found.setdefault(r.job_id, []).append(((r["at"] - t0).total_seconds(), r.transition, r.attempts))
    assert found[1] == [(0, "CLAIMED", 1), (800, "RECLAIMED", 1)]  # the beat at 280 came later and still kept the claim; DONE of a lost claim is ignored
    assert found[2] == [(0, "CLAIMED", 1), (300, "RECLAIMED", 1)]
    assert [x[1:] for x in found[3]] == [("CLAIMED", 1), ("PENDING", 1), ("CLAIMED", 2), ("PENDING", 2), ("CLAIMED", 3), ("FAILED", 3)]
    assert found[9] == [(3000, "CLAIMED", 1), (3100, "DONE", 1)] and not {4, 8, None} & set(found)


def test_files_to_embed_are_bounded(spark, monkeypatch, tmp_path):
    from kairosift.plans import effects
    from kairosift.plans.more import QUERIES

    spark.createDataFrame([(i, "\n".join(f"{i} {n} " + "x" * 900 for n in range(40)), "src0", "en") for i in range(30)], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    seen, plain = [], ingestion.embed_batches
    monkeypatch.setattr(effects, "FILE", 200_000)
    monkeypatch.setattr(effects.ingestion, "embed_batches", lambda spark, folder, *rest, files: seen.append((folder, files)) or plain(spark, folder, *rest, files=files))
    got = {(r.version_id, r.n_chunks, r.n_vectors) for r in QUERIES["ING19_committed_vectors"](spark, str(tmp_path)).collect()}
    assert got == {(i * 10 + no, 40, 40) for i in range(30) for no in range(i % 3 + 1)}
    rows = spark.read.parquet(seen[0][0]).groupBy(F.input_file_name()).agg(F.sum(F.octet_length("source_text")).alias("n")).collect()
    assert len(rows) == 12 and max(r.n for r in rows) < 300_000 and seen[0][1] == 6  # before: four files of any size


def test_a_silent_job_costs_few_state_calls():
    calls = []

    class Held:
        def __init__(self, value):
            self.value = value

        def __getattr__(self, name):
            return lambda *a: calls.append(name) or self.value

    class Timers:
        def getCurrentWatermarkInMs(self):
            return 0

    q = queue.Queue(60, 60)
    q.handle, q.job, q.waiting = Held(None), Held(None), Held([])
    assert list(q._advance((1,), [(5_000, 1, "BEAT")], Timers())) == []  # before: an empty frame
    assert calls == ["get", "get", "put", "registerTimer"]  # before: two exists and a clear as well
    q.waiting.value, q.job.value = [(0, 1, "BEAT"), (0, 2, "DONE")], None
    frame = next(iter(q._advance((7,), [], Timers())))
    assert frame.astype({"at": "int64"}).values.tolist() == [[7, 0, "CLAIMED", 1], [7, 0, "DONE", 1]] and str(frame.dtypes["attempts"]) == "int32"
