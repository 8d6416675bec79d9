"""Create, update and delete documents: what the requests of a service do to the tables, for many requests at once.

Each call reads the newest snapshot, decides every request, and publishes all effects as the next one; where another writer
was first it decides again on what that one left. Ids are made of what they name, so a repeated call changes nothing. New rows are
added to tables; only the tables of documents, versions and jobs are rewritten, by a deletion. What a deleted document leaves in
larger tables isn't reachable from then on, and ``sweep`` removes it.

Tables: corpora (corpus_id), documents (document_id, corpus_id, title, active_version_id), versions (version_id, document_id, corpus_id,
version_no, status, source_hash, artifact_key, media_type, byte_size), jobs (version_id, state, attempts), artifacts (key,
byte_size, content), and, once they are built, chunks, representations and mentions (chunk_id, ...).

Results: (request_id, code, reason, document_id, version_id); 201 made, 200 there already, 204 deleted, 400, 413 and 415 rejected by
the intake, 404 unknown, 409 in conflict. Of requests of one call with the same bytes the least request_id is first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import saved
from ..sources.intake import artifact_key, intake
from ..sources.snapshots import PublicationConflict, Snapshots
from .lifecycle import IN_FLIGHT

_REJECTS = {"unsupported_media_type": 415, "too_large": 413, "empty": 400}
TABLES = {
    "corpora": "corpus_id string", "documents": "document_id string, corpus_id string, title string, active_version_id string",
    "versions": "version_id string, document_id string, corpus_id string, version_no int, status string, source_hash string, artifact_key string, media_type string, byte_size long",
    "jobs": "version_id string, state string, attempts int", "artifacts": "key string, byte_size long, content binary", "tombstones": "document_id string",
}


def open_store(spark: SparkSession, root: str, corpora: DataFrame) -> Snapshots:
    """A new store with the given ``corpora`` (corpus_id) and nothing else."""
    store = Snapshots(spark, root)
    store.publish(store.newest(), {name: spark.createDataFrame([], schema) for name, schema in TABLES.items() if name != "corpora"} | {"corpora": corpora.select("corpus_id").distinct()}, srg="srg1")
    return store


def _id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24))


def _decided(store: Snapshots, decide: Callable, rounds: int = 5) -> DataFrame:
    """``decide`` (tables) gives results, changed and added tables; published, or decided again where another writer was first."""
    for _ in range(rounds):
        base = store.newest()
        results, changed, added = decide(store.read(base))
        try:
            if changed or added:
                store.publish(base, changed, added)
            return results
        except PublicationConflict:
            continue
    raise PublicationConflict(f"{rounds} other writers were first")


def _read(uploads: DataFrame) -> DataFrame:
    """Uploads (request_id, path, content, ...) with their hash and the code of a reject."""
    codes = F.create_map(*[F.lit(x) for pair in _REJECTS.items() for x in pair])
    return intake(uploads).withColumns({"source_hash": F.sha2("content", 256), "reject_code": codes[F.col("reject")]})


def _made(results: DataFrame) -> dict[str, DataFrame]:
    """The rows that go with new versions, from results that keep the uploads' columns."""
    new = results.where("code = 201")
    versions = new.select("version_id", "document_id", "corpus_id", "version_no", F.lit("PENDING").alias("status"), "source_hash", artifact_key(F.col("content")).alias("artifact_key"), "media_type", F.length("content").cast("long").alias("byte_size"))
    artifacts = new.select(artifact_key(F.col("content")).alias("key"), F.length("content").cast("long").alias("byte_size"), "content").dropDuplicates(["key"])
    return {"versions": versions, "jobs": new.select("version_id", F.lit("PENDING").alias("state"), F.lit(0).alias("attempts")), "artifacts": artifacts}


def _told(results: DataFrame) -> DataFrame:
    return results.select("request_id", "code", "reason", "document_id", "version_id")


def create_documents(store: Snapshots, uploads: DataFrame) -> DataFrame:
    """POST: ``uploads`` (request_id, corpus_id, path, content). The same bytes in one corpus are one document."""

    def decide(t: dict[str, DataFrame]):
        held = t["versions"].groupBy("corpus_id", "source_hash").agg(F.min_by(F.struct("document_id", "version_id"), "version_id").alias("held"))
        known = t["corpora"].withColumn("known", F.lit(True))
        asked = _read(uploads).join(known, "corpus_id", "left").join(held, ["corpus_id", "source_hash"], "left")
        fine = F.col("known") & F.col("reject").isNull() & F.col("held").isNull()
        first = F.row_number().over(Window.partitionBy("corpus_id", "source_hash", fine).orderBy("request_id")) == 1
        code = F.when(F.col("known").isNull(), 404).when(F.col("reject").isNotNull(), F.col("reject_code")).when(F.col("held").isNotNull() | ~first, 200).otherwise(201)
        reason = F.when(F.col("known").isNull(), F.lit("no_corpus")).otherwise(F.col("reject"))
        made = code.isin(200, 201)
        document = _id("d", F.col("corpus_id"), F.col("source_hash"))
        out = asked.withColumns({"code": code, "reason": reason, "document_id": F.when(made, F.coalesce("held.document_id", document)), "version_no": F.lit(0)})
        out = saved(out.withColumn("version_id", F.when(made, F.coalesce("held.version_id", _id("v", F.col("document_id"), F.col("source_hash"))))), "created")
        documents = out.where("code = 201").select("document_id", "corpus_id", F.col("path").alias("title"), F.lit(None).cast("string").alias("active_version_id"))
        return _told(out), {}, ({"documents": documents} | _made(out)) if not documents.isEmpty() else {}

    return _decided(store, decide)


def update_documents(store: Snapshots, uploads: DataFrame) -> DataFrame:
    """PUT: ``uploads`` (request_id, document_id, path, content). A version in flight, or bytes of another document, are a conflict."""

    def decide(t: dict[str, DataFrame]):
        held = t["versions"].groupBy("corpus_id", "source_hash").agg(F.min_by(F.struct("document_id", "version_id"), "version_id").alias("held"))
        busy = t["versions"].groupBy("document_id").agg(F.bool_or(F.col("status").isin(IN_FLIGHT)).alias("busy"), F.max("version_no").alias("last"))
        asked = _read(uploads).join(t["documents"].select("document_id", "corpus_id"), "document_id", "left").join(busy, "document_id", "left").join(held, ["corpus_id", "source_hash"], "left")
        known, same = F.col("corpus_id").isNotNull(), F.col("held.document_id") == F.col("document_id")
        fine = known & F.col("reject").isNull() & F.col("held").isNull() & ~F.coalesce("busy", F.lit(False))
        of_document = Window.partitionBy("document_id", fine).orderBy("request_id")
        of_bytes = Window.partitionBy("corpus_id", "source_hash", fine).orderBy("request_id")
        asked = asked.withColumns({"fine": fine, "first": F.first("source_hash").over(of_document) == F.col("source_hash"), "turn": F.row_number().over(of_document), "owner": F.first("document_id").over(of_bytes)})
        # of several new versions of one call: the first one's bytes are the version, others come too early; bytes of two documents are the first one's
        code = (
            F.when(~known, 404).when(F.col("reject").isNotNull(), F.col("reject_code")).when(same, 200).when(F.col("held").isNotNull(), 409).when(~F.col("fine"), 409)
            .when((F.col("owner") != F.col("document_id")) | ~F.col("first"), 409).when(F.col("turn") > 1, 200).otherwise(201)
        )
        reason = (
            F.when(~known, F.lit("no_document")).when(F.col("reject").isNotNull(), F.col("reject")).when(F.col("held").isNotNull() & ~same, F.lit("other_document"))
            .when(F.col("held").isNull() & ~F.col("fine"), F.lit("in_flight")).when(F.col("held").isNull() & (F.col("owner") != F.col("document_id")), F.lit("other_document")).when(F.col("held").isNull() & ~F.col("first"), F.lit("in_flight"))
        )
        version = F.coalesce("held.version_id", _id("v", F.col("document_id"), F.col("source_hash")))
        out = asked.withColumns({"code": code, "reason": reason, "version_no": (F.coalesce("last", F.lit(-1)) + 1).cast("int")})
        out = saved(out.withColumn("version_id", F.when(F.col("code").isin(200, 201), version)), "updated")
        return _told(out), {}, _made(out) if not out.where("code = 201").isEmpty() else {}

    return _decided(store, decide)


def delete_documents(store: Snapshots, requests: DataFrame) -> DataFrame:
    """DELETE: ``requests`` (request_id, document_id). Documents, versions and jobs go at once; a second request finds nothing."""

    def decide(t: dict[str, DataFrame]):
        known = t["documents"].select("document_id", F.lit(True).alias("known"))
        first = F.row_number().over(Window.partitionBy("document_id").orderBy("request_id")) == 1
        out = requests.join(known, "document_id", "left").withColumn("code", F.when(F.col("known") & first, 204).otherwise(404))
        out = saved(out.withColumns({"reason": F.when(F.col("code") == 404, F.lit("no_document")), "version_id": F.lit(None).cast("string")}), "deleted")
        gone = out.where("code = 204").select("document_id")
        if gone.isEmpty():
            return _told(out), {}, {}
        versions = t["versions"].join(gone, "document_id", "left_anti")
        changed = {"documents": t["documents"].join(gone, "document_id", "left_anti"), "versions": versions.select(*t["versions"].columns), "jobs": t["jobs"].join(versions.select("version_id"), "version_id", "left_semi")}
        return _told(out), changed, {"tombstones": gone}

    return _decided(store, decide)


def sweep(store: Snapshots) -> dict[str, int]:
    """Remove what no version has any more: chunks with their representations and mentions, and artifacts; gives the rows left of each."""
    left: dict[str, int] = {}

    def decide(t: dict[str, DataFrame]):
        changed = {"artifacts": t["artifacts"].join(t["versions"].select(F.col("artifact_key").alias("key")).distinct(), "key", "left_semi")}
        if "chunks" in t:
            changed["chunks"] = t["chunks"].join(t["versions"].select("version_id"), "version_id", "left_semi")
            for name in ("representations", "mentions"):
                if name in t:
                    changed[name] = t[name].join(changed["chunks"].select("chunk_id"), "chunk_id", "left_semi")
        left.update({name: df.count() for name, df in changed.items()})
        return None, changed, {}

    _decided(store, decide)
    return left
