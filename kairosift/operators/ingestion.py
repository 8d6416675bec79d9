"""What ingestion does to its tables: reconciled chunks, vectors committed by batch, publication in one step.

Chunks, representations (chunk_id, srg, v, ...) and mentions (chunk_id, ...) are kept in folders partitioned by ``part``, a
hash of the version, so a changed version rewrites its own part of each and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import saved
from ..sources.snapshots import Snapshot, Snapshots
from . import lifecycle

PARTS = 64
#: A part is dealt to this many tasks at most, so a task has a share of a part only.
_SHARES = 4


def part(version: str = "version_id", parts: int = PARTS) -> F.Column:
    return F.pmod(F.xxhash64(version), F.lit(parts)).cast("int").alias("part")


def _write(df: DataFrame, folder: str) -> None:
    """The parts that ``df`` has, anew; other parts stay as they are. No shuffle: a task adds a file to each part it has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("part").parquet(folder)


def write_parts(df: DataFrame, folder: str, parts: int = PARTS) -> None:
    """A whole table, by part; ``df`` has version_id."""
    df.withColumn("part", part(parts=parts)).write.mode("overwrite").option("compression", "zstd").partitionBy("part").parquet(folder)


def reconciled(old: DataFrame, drafts: DataFrame, parts: int = PARTS) -> DataFrame:
    """The ``old`` chunks (with part) against ``drafts`` (version_id, pg, ordinal, content_hash, ...): a row for each key of both, with its ``action``.

    KEEP rows are the old ones, UPDATE keeps the old chunk_id, INSERT gets a new one, DELETE has nothing but its key and chunk_id.
    STAY: old chunks of versions and generations without drafts. Texts are shuffled once, by version, and both sides meet there.
    """
    key, fields = ["version_id", "pg", "ordinal"], [c for c in old.columns if c not in ("version_id", "pg", "ordinal", "chunk_id", "part")]
    mine = old.select("part", *key, "chunk_id", *fields, F.lit(False).alias("new"))
    asked = [F.col(c) if c in drafts.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in fields]
    both = mine.unionByName(drafts.select(part(parts=parts), *key, F.lit(None).cast("string").alias("chunk_id"), *asked, F.lit(True).alias("new")))
    both = both.withColumn("share", F.pmod(F.xxhash64("version_id"), F.lit(parts * _SHARES))).repartition("share")
    built, same = Window.partitionBy("share", "version_id", "pg"), Window.partitionBy("share", *key)
    was, now = F.max(F.when(~F.col("new"), F.struct("content_hash", "chunk_id"))), F.max(F.when(F.col("new"), F.struct("content_hash")))
    both = both.withColumns({"built": F.max("new").over(built), "was": was.over(same), "now": now.over(same)})
    action = (
        F.when(~F.col("built"), F.lit("STAY")).when(F.col("was").isNull(), F.lit("INSERT")).when(F.col("now").isNull(), F.lit("DELETE"))
        .when(F.col("was.content_hash").eqNullSafe(F.col("now.content_hash")), F.lit("KEEP")).otherwise(F.lit("UPDATE"))
    )
    rows = both.withColumn("action", action).where(F.col("new") == F.col("action").isin("INSERT", "UPDATE"))
    chunk_id = F.coalesce("chunk_id", "was.chunk_id", F.concat_ws(":", *key))
    return rows.select("action", chunk_id.alias("chunk_id"), *key, *[F.when(F.col("action") != "DELETE", F.col(c)).alias(c) for c in fields], "part")


def apply_chunks(spark: SparkSession, folder: str, drafts: DataFrame, parts: int = PARTS) -> DataFrame:
    """Bring chunks, representations and mentions below ``folder`` in line with ``drafts``; gives (action, n).

    A changed chunk keeps its id and loses its vectors and mentions, a deleted one loses them with itself; unchanged ones, and
    other versions and generations, stay. Projections go first: where a run breaks in between, what is missing is missing
    and is made by the next run, and nothing points into a text that has changed. A second run with the same drafts changes nothing.
    """
    listed = lambda df: [r["part"] for r in df.select("part").distinct().collect()]  # noqa: E731  at most ``parts``
    touched = listed(drafts.select(part(parts=parts)))
    here = F.col("part").isin(touched)
    old = spark.read.parquet(f"{folder}/chunks").where(here)
    plan = saved(reconciled(old, drafts, parts), "reconciled", "zstd")
    gone = plan.where("action in ('UPDATE', 'DELETE')").select("chunk_id", "part")
    for name in ("representations", "mentions"):
        rows = spark.read.parquet(f"{folder}/{name}").where(here)
        told = saved(rows.join(gone.withColumn("__gone", F.lit(True)), ["chunk_id", "part"], "left"), name)
        hit = listed(told.where("__gone"))
        left = told.where(F.col("part").isin(hit) & F.col("__gone").isNull()).select(*rows.columns).repartition("part")
        # a dynamic overwrite leaves absent parts alone, so those that lose all their rows are dropped
        emptied = sorted({*hit} - {*listed(left)})
        if not left.isEmpty():
            _write(left, f"{folder}/{name}")
        _drop(spark, f"{folder}/{name}", emptied)
    changed = listed(plan.where("action not in ('KEEP', 'STAY')"))
    whole = plan.where(F.col("part").isin(changed) & (F.col("action") != "DELETE")).select(*old.columns)
    emptied = sorted({*changed} - {*listed(whole)})
    if not whole.isEmpty():
        _write(whole, f"{folder}/chunks")
    _drop(spark, f"{folder}/chunks", emptied)
    return plan.where("action <> 'STAY'").groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def _drop(spark: SparkSession, folder: str, parts: list[int]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for n in parts:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/part={n}")
        path.getFileSystem(conf).delete(path, True)


def embed_batches(spark: SparkSession, folder: str, out: str, checkpoint: str, srg: str, embed: Callable[[DataFrame], DataFrame], files: int = 1) -> DataFrame:
    """Vectors for the chunks below ``folder`` that have none of generation ``srg``, committed batch by batch.

    The chunks' files are a stream, ``files`` of them to a batch; a batch's vectors are one folder, written anew if the batch
    runs again, and the checkpoint is the ledger of the batches that are done. A run that breaks goes on with the batch that
    broke; a new run (another checkpoint) finds the vectors that are there and embeds the others alone. ``embed``: (chunk_id, text)
    to (chunk_id, v). Gives all vectors of the generation.
    """
    schema = spark.read.parquet(folder).schema
    kind = "chunk_id string, srg string, v array<double>"
    target = f"{out}/srg={srg}"

    def write(batch: DataFrame, number: int) -> None:
        todo = batch.select("chunk_id", F.coalesce("contextualized_text", "source_text").alias("text") if "contextualized_text" in batch.columns else F.col("source_text").alias("text"))
        here = f"{target}/run={name}/batch={number}"
        done = vectors(spark, out).where((F.col("srg") == srg) & ~F.col("file").contains(f"/run={name}/batch={number}/"))
        todo = todo.join(done.select("chunk_id"), "chunk_id", "left_anti")
        embed(todo).select("chunk_id", "v").write.mode("overwrite").parquet(here)

    name = checkpoint.rstrip("/").rsplit("/", 1)[-1]
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return vectors(spark, out).where(F.col("srg") == srg).select(*[c.split()[0] for c in kind.split(", ")])


def vectors(spark: SparkSession, out: str) -> DataFrame:
    """(chunk_id, v, srg, run, batch, file) of all committed vectors."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    schema = "chunk_id string, v array<double>, srg string, run string, batch int"
    rows = spark.read.schema(schema).option("basePath", out).parquet(out) if found else spark.createDataFrame([], schema)
    return rows.withColumn("file", F.input_file_name() if found else F.lit(""))


@dataclass(frozen=True)
class Publication:
    snapshot: Snapshot
    failures: DataFrame


def publish_versions(store: Snapshots, wanted: DataFrame, srg: str) -> Publication:
    """Check the ``wanted`` versions (version_id, pg: the generation that was built) and activate the sound ones in one step.

    Sound versions get their generation, a served status and the document's pointer (the newest of a document wins); the others
    become FAILED with their first reason, and no pointer moves to them. Tables are read from one snapshot and written as
    the next: readers see all of it or nothing. Where another writer was first, nothing is published.
    """
    base = store.newest()
    t = store.read(base)
    versions = t["versions"]
    built = versions.join(wanted.select("version_id", F.col("pg").alias("built")), "version_id")
    chunks = t["chunks"].join(wanted.select("version_id", "pg"), ["version_id", "pg"], "left_semi")
    mentions = t["mentions"].join(wanted.select("version_id"), "version_id", "left_semi")
    failures = saved(lifecycle.publication_failures(built, chunks, t["representations"], mentions, srg, base.pointers["srg"]), "failures")
    first = failures.groupBy("version_id").agg(F.min("failure").alias("failure"))
    judged = wanted.select("version_id", F.col("pg").alias("built")).join(first, "version_id", "left")
    status = F.when(F.size(F.coalesce("degraded", F.array().cast("array<string>"))) > 0, F.lit("READY_DEGRADED")).otherwise(F.lit("READY")) if "degraded" in versions.columns else F.lit("READY")
    sound, asked = F.col("built").isNotNull() & F.col("failure").isNull(), F.col("built").isNotNull()
    new = versions.join(judged, "version_id", "left").withColumns({
        "published_pg": F.when(sound, F.col("built")).otherwise(F.col("published_pg")),
        "status": F.when(sound, status).when(asked, F.lit("FAILED")).otherwise(F.col("status")),
        "error": F.when(asked, F.col("failure")).otherwise(F.col("error") if "error" in versions.columns else F.lit(None).cast("string")),
    }).drop("built", "failure")
    good = built.join(failures.select("version_id").distinct(), "version_id", "left_anti")
    newest = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("version_no"), F.desc("version_id")))
    good = good.withColumn("r", newest).where("r = 1").select("document_id", F.col("version_id").alias("new"))
    documents = t["documents"].join(good, "document_id", "left").withColumn("active_version_id", F.coalesce("new", "active_version_id")).drop("new")
    return Publication(store.publish(base, {"versions": new, "documents": documents}), failures)


__all__ = ["PARTS", "Publication", "apply_chunks", "embed_batches", "part", "publish_versions", "reconciled", "vectors", "write_parts"]
