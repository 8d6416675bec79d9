"""Versions, generations, eligibility, cutover, invariants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import SERVED
from . import routes, textsearch

IN_FLIGHT = ["PENDING", "RUNNING"]


def latest_run(runs: DataFrame) -> DataFrame:
    """The run of highest attempt of every version; of equal attempts the one of the largest run_id."""
    rank = F.row_number().over(Window.partitionBy("version_id").orderBy(F.desc("attempt"), F.desc("run_id")))
    return runs.withColumn("rank", rank).where("rank = 1").drop("rank")


def reported_version(versions: DataFrame) -> DataFrame:
    """Of every document the version to report: in flight first, else the active one, else the newest."""
    order = [F.desc(F.col("status").isin(IN_FLIGHT)), F.desc(F.col("version_id") == F.col("active_version_id")), F.desc("version_no")]
    rank = F.row_number().over(Window.partitionBy("document_id").orderBy(*order))
    return versions.withColumn("rank", rank).where("rank = 1").drop("rank")


def eligible_chunks(chunks: DataFrame, documents: DataFrame, versions: DataFrame, representations: DataFrame, scope: list[str], srg: str) -> DataFrame:
    """Chunks that may be searched: scope, active version, served status, published generation, captured representation."""
    chunks = chunks.where(F.col("corpus_id").isin(scope))
    active = documents.select("document_id", "corpus_id", F.col("active_version_id").alias("version_id"))
    served = versions.where(F.col("status").isin(SERVED)).select("version_id", F.col("published_pg").alias("pg"))
    built = representations.where(F.col("srg") == srg).select("chunk_id").distinct()
    return chunks.join(active, ["document_id", "corpus_id", "version_id"]).join(served, ["version_id", "pg"]).join(built, "chunk_id", "left_semi")


def rejection_reason(candidates: DataFrame, documents: DataFrame, versions: DataFrame, representations: DataFrame, scope: list[str], srg: str) -> DataFrame:
    """(chunk_id, reason): the first rule that a candidate breaks on freshly read tables, null if it may stay."""
    d = documents.select("document_id", F.col("corpus_id").alias("owner"), F.col("active_version_id").alias("active"))
    v = versions.select("version_id", "status", "published_pg")
    r = representations.where(F.col("srg") == srg).select("chunk_id").distinct().withColumn("built", F.lit(True))
    joined = candidates.join(d, "document_id", "left").join(v, "version_id", "left").join(r, "chunk_id", "left")
    reason = (
        F.when(F.col("owner").isNull(), F.lit("DOCUMENT_DELETED"))
        .when(F.col("owner") != F.col("corpus_id"), F.lit("CORPUS_MOVED"))
        .when(~F.col("corpus_id").isin(scope), F.lit("OUT_OF_SCOPE"))
        .when(F.coalesce(F.col("active") != F.col("version_id"), F.lit(True)), F.lit("VERSION_REPLACED"))
        .when(~F.coalesce(F.col("status").isin(SERVED), F.lit(False)), F.lit("NOT_SERVED"))
        .when(F.coalesce(F.col("published_pg") != F.col("pg"), F.lit(True)), F.lit("GENERATION_REPLACED"))
        .when(F.col("built").isNull(), F.lit("REPRESENTATION_MISSING"))
    )
    return joined.select("chunk_id", reason.alias("reason"))


def missing_vectors(chunks: DataFrame, representations: DataFrame, srg: str) -> DataFrame:
    return chunks.join(representations.where(F.col("srg") == srg).select("chunk_id"), "chunk_id", "left_anti")


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    """The keys that more than one row has: an invariant of uniqueness holds where this is empty."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(df: DataFrame, parent: DataFrame, *keys: str) -> DataFrame:
    return df.join(parent.select(*keys).distinct(), list(keys), "left_anti")


def no_lexeme(text: Column) -> Column:
    """Nothing of the text can be asked for: no words, or stop words alone."""
    return F.size(F.filter(textsearch.words(F.coalesce(text, F.lit(""))), lambda w: ~w.isin(routes.STOP_WORDS))) == 0


def publication_failures(versions: DataFrame, chunks: DataFrame, representations: DataFrame, mentions: DataFrame, srg: str, active_srg: str) -> DataFrame:
    """(version_id, failure): why a version may not be published; none: it may. Chunks are grouped once."""
    built = representations.where(F.col("srg") == srg).select("chunk_id").distinct().withColumn("built", F.lit(True))
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    owner = versions.select("version_id", F.col("document_id").alias("of_document"), F.col("corpus_id").alias("of_corpus"))
    mine = chunks.join(built, "chunk_id", "left").join(owner, "version_id").groupBy("version_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"), F.countDistinct("ordinal").alias("d"),
        any_(F.expr("span_start < 0 or span_end > length(source_text) or span_start > span_end")).alias("span_outside"),
        any_(F.col("built").isNull()).alias("missing_vector"),
        any_(no_lexeme(F.col("source_text"))).alias("empty_lexical"),
        any_(~F.col("document_id").eqNullSafe(F.col("of_document")) | ~F.col("corpus_id").eqNullSafe(F.col("of_corpus"))).alias("wrong_lineage"),
    )
    own = versions.select("version_id").join(mine, "version_id", "left")
    named = [F.when(F.col(c), F.lit(c)) for c in ("span_outside", "missing_vector", "empty_lexical", "wrong_lineage")]
    found = F.array_compact(F.array(F.when(F.col("n").isNull(), F.lit("no_chunks")), F.when(F.expr("lo <> 0 or hi <> n - 1 or d <> n"), F.lit("ordinal_gap")), *named))
    checks = [own.select("version_id", F.explode(found).alias("failure")), mentions.where("start_offset >= end_offset").select("version_id", F.lit("broken_mention").alias("failure")).distinct()]
    if "degraded" in versions.columns:  # what a version couldn't do isn't held against it
        checks[1] = checks[1].join(versions.where(F.array_contains("degraded", "TEMPORAL")).select("version_id"), "version_id", "left_anti")
    if srg != active_srg:
        checks.append(versions.select("version_id", F.lit("superseded_representation").alias("failure")))
    return reduce(DataFrame.union, checks)


def cut_over(documents: DataFrame, versions: DataFrame, failures: DataFrame) -> DataFrame:
    """``documents`` with active_version_id moved to the newest publishable version; written as a whole, then swapped."""
    good = versions.join(failures.select("version_id").distinct(), "version_id", "left_anti")
    newest = good.groupBy("document_id").agg(F.max_by("version_id", "version_no").alias("new_version_id"))
    return documents.join(newest, "document_id", "left").withColumn("active_version_id", F.coalesce("new_version_id", "active_version_id")).drop("new_version_id")


def existing_versions(uploads: DataFrame, versions: DataFrame) -> DataFrame:
    """``uploads`` (corpus_id, source_hash, ...) with the least document_id that holds the same bytes in the corpus, or null."""
    held = versions.groupBy("corpus_id", "source_hash").agg(F.min("document_id").alias("existing"))
    return uploads.join(held, ["corpus_id", "source_hash"], "left")


def swapped_pointer(pointer: DataFrame, chunks: DataFrame, representations: DataFrame, srg: str) -> DataFrame:
    """The one-row ``pointer`` (id, srg), moved to the generation ``srg`` if that holds a vector of every chunk."""
    missing = missing_vectors(chunks, representations, srg).agg((F.count(F.lit(1)) == 0).alias("complete"))  # one row
    moved = pointer.crossJoin(missing)  # one row with one row
    return moved.select("id", F.when(F.col("complete"), F.lit(srg)).otherwise(F.col("srg")).alias("srg"))


def deletion_states(documents: DataFrame, tombstones: DataFrame, chunks: DataFrame) -> DataFrame:
    """``documents`` with ``deletion``: null without a tombstone, DELETING while chunks of it are left, then DELETED.

    A document with a tombstone isn't eligible from then on, whatever is still to be cleaned.
    """
    gone = tombstones.select("document_id").distinct().withColumn("gone", F.lit(True))
    left = chunks.select("document_id").distinct().withColumn("left", F.lit(True))
    state = F.when(F.col("gone") & F.col("left"), F.lit("DELETING")).when(F.col("gone"), F.lit("DELETED"))
    return documents.join(gone, "document_id", "left").join(left, "document_id", "left").withColumn("deletion", state).drop("gone", "left")


def capabilities(degraded: Column) -> Column:
    """Capability -> state of a version with these ``degraded`` capabilities: search always works once it is served."""
    state = lambda name: F.when(F.array_contains(degraded, name), F.lit("DEGRADED")).otherwise(F.lit("READY"))
    return F.create_map(F.lit("SEMANTIC"), F.lit("READY"), F.lit("LEXICAL"), F.lit("READY"), F.lit("TEMPORAL"), state("TEMPORAL"), F.lit("PROVENANCE_LOCATION"), state("PROVENANCE_LOCATION"))


def pointer_violations(pointer: DataFrame) -> DataFrame:
    """(n, fine): the table of the one global pointer has a single row, of id 1."""
    return pointer.agg(F.count(F.lit(1)).alias("n"), ((F.count(F.lit(1)) == 1) & F.coalesce(F.bool_and(F.col("id") == 1), F.lit(False))).alias("fine"))


def published_status(degraded: Column) -> Column:
    return F.when(F.size(degraded) > 0, F.lit("READY_DEGRADED")).otherwise(F.lit("READY"))


def update_outcome(uploads: DataFrame, versions: DataFrame) -> DataFrame:
    """Of each upload (document_id, corpus_id, source_hash): EXISTING, CONFLICT, IN_FLIGHT or NEW_VERSION."""
    same = versions.groupBy("corpus_id", "source_hash").agg(F.min("document_id").alias("owner"))
    busy = versions.where(F.col("status").isin(IN_FLIGHT)).select("document_id").distinct().withColumn("busy", F.lit(True))
    joined = uploads.join(same, ["corpus_id", "source_hash"], "left").join(busy, "document_id", "left")
    outcome = (
        F.when(F.col("owner") == F.col("document_id"), F.lit("EXISTING")).when(F.col("owner").isNotNull(), F.lit("CONFLICT"))
        .when(F.col("busy"), F.lit("IN_FLIGHT")).otherwise(F.lit("NEW_VERSION"))
    )
    return joined.select("document_id", "corpus_id", "source_hash", outcome.alias("outcome"))
