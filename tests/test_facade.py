"""Documents created, updated and deleted, with their effects on the tables."""

import tempfile

from pyspark.sql import functions as F

from kairosift.operators import facade


def uploads(spark, rows, key="corpus_id"):
    return spark.createDataFrame([(i, k, p, bytearray(c)) for i, k, p, c in rows], f"request_id int, {key} string, path string, content binary")


def told(df):
    return {r.request_id: (r.code, r.reason) for r in df.collect()}


def test_life_of_documents(spark):
    store = facade.open_store(spark, "file://" + tempfile.mkdtemp(prefix="spark-"), spark.createDataFrame([("one",), ("two",)], "corpus_id string"))
    rows = [(1, "one", "a.txt", b"first"), (2, "one", "b.txt", b"first"), (3, "two", "a.txt", b"first"), (4, "none", "a.txt", b"x"), (5, "one", "a.exe", b"x"), (6, "one", "c.txt", b" \n"), (7, "one", "d.md", b"other")]
    out = facade.create_documents(store, uploads(spark, rows))
    assert told(out) == {1: (201, None), 2: (200, None), 3: (201, None), 4: (404, "no_corpus"), 5: (415, "unsupported_media_type"), 6: (400, "empty"), 7: (201, None)}
    ids = {r.request_id: (r.document_id, r.version_id) for r in out.collect()}
    assert ids[1] == ids[2] and ids[1] != ids[3] and ids[4] == (None, None)
    t = store.read(store.newest())
    assert t["documents"].count() == 3 and t["versions"].where("status = 'PENDING' and version_no = 0").count() == 3 and t["jobs"].where("state = 'PENDING'").count() == 3
    assert {bytes(r.content) for r in t["artifacts"].collect()} == {b"first", b"other"}
    # the same again: nothing changes
    before = store.newest()
    assert {c for c, _ in told(facade.create_documents(store, uploads(spark, rows[:1]))).values()} == {200} and store.newest() == before

    a, other = ids[1][0], ids[7][0]
    put = lambda *rows: facade.update_documents(store, uploads(spark, rows, "document_id"))
    assert told(put((1, a, "a.txt", b"second"))) == {1: (409, "in_flight")}  # its first version is still PENDING
    t = store.read(store.newest())
    store.publish(store.newest(), {"versions": t["versions"].withColumn("status", F.lit("READY"))})
    got = told(put((1, a, "a.txt", b"first"), (2, a, "a.txt", b"other"), (3, a, "a.txt", b"second"), (4, a, "a.txt", b"second"), (5, a, "a.txt", b"third"), (6, "nothing", "a.txt", b"x"), (7, other, "a.txt", b"second"), (8, a, "a.bin", b"x")))
    assert got == {1: (200, None), 2: (409, "other_document"), 3: (201, None), 4: (200, None), 5: (409, "in_flight"), 6: (404, "no_document"), 7: (409, "other_document"), 8: (415, "unsupported_media_type")}
    t = store.read(store.newest())
    assert sorted((r.version_no, r.status) for r in t["versions"].where(F.col("document_id") == a).collect()) == [(0, "READY"), (1, "PENDING")]

    chunks = t["versions"].select(F.concat(F.lit("c"), "version_id").alias("chunk_id"), "version_id")
    store.publish(store.newest(), {"chunks": chunks, "representations": chunks.select("chunk_id"), "mentions": chunks.select("chunk_id")})
    gone = facade.delete_documents(store, spark.createDataFrame([(1, a), (2, a), (3, "nothing")], "request_id int, document_id string"))
    assert told(gone) == {1: (204, None), 2: (404, "no_document"), 3: (404, "no_document")}
    t = store.read(store.newest())
    assert t["documents"].count() == 2 and t["versions"].count() == 2 == t["jobs"].count() and t["tombstones"].count() == 1 and t["chunks"].count() == 4
    assert facade.sweep(store) == {"artifacts": 2, "chunks": 2, "representations": 2, "mentions": 2}  # b"first" is still the other corpus's
    assert {bytes(r.content) for r in store.read(store.newest())["artifacts"].collect()} == {b"first", b"other"}
    assert told(facade.create_documents(store, uploads(spark, [(9, "one", "a.txt", b"second")]))) == {9: (201, None)}


def test_a_lost_race_is_decided_again(spark, monkeypatch):
    store = facade.open_store(spark, "file://" + tempfile.mkdtemp(prefix="spark-"), spark.createDataFrame([("one",)], "corpus_id string"))
    whole, lost = store.publish, []

    def publish(base, *args, **more):
        if not lost:
            lost.append(1)
            monkeypatch.setattr(store, "publish", whole)
            facade.create_documents(store, uploads(spark, [(5, "one", "b.txt", b"first")]))
        return whole(base, *args, **more)

    monkeypatch.setattr(store, "publish", publish)
    assert told(facade.create_documents(store, uploads(spark, [(1, "one", "a.txt", b"first"), (2, "one", "c.txt", b"new")]))) == {1: (200, None), 2: (201, None)}
    assert store.read(store.newest())["documents"].count() == 2
