"""The ingestion queue: claims, retries and resumption as columns, and the same over event streams."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import STAGES
from ..session import saved, shared_folder

MAX_ATTEMPTS = 3
BACKOFF_S = 30
STALE_S = 300


def claimable(now: Column, stale_s: int = STALE_S) -> Column:
    """Jobs (state, retry_after, heartbeat_at) that are due, or claimed by a worker that fell silent."""
    due = (F.col("state") == "PENDING") & (F.col("retry_after") <= now)
    silent = (F.col("state") == "CLAIMED") & (F.col("heartbeat_at") < now - F.make_interval(secs=F.lit(stale_s)))
    return F.coalesce(due | silent, F.lit(False))


def claim(jobs: DataFrame, now: Column, workers: int) -> DataFrame:
    """The oldest due jobs, one for each worker: (job_id, worker)."""
    due = jobs.where(claimable(now)).orderBy("retry_after", "job_id").limit(workers)
    return due.select("job_id", F.row_number().over(Window.orderBy("retry_after", "job_id")).alias("worker"))


def after_failure(attempts: Column, retryable: Column) -> Column:
    return F.when(retryable & (attempts < MAX_ATTEMPTS), F.lit("PENDING")).otherwise(F.lit("FAILED"))


def failure(code: Column, known: dict[str, bool]) -> dict[str, Column]:
    """The reason and whether it may be retried, by the ``known`` codes; an unclassified failure may not."""
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return {"reason": F.when(names[code].isNotNull(), code).otherwise(F.lit("unexpected")), "retryable": F.coalesce(names[code], F.lit(False))}


def backoff_seconds(attempts: Column) -> Column:
    return attempts * BACKOFF_S


def resume_index(stage: Column) -> Column:
    """Number of the stage to go on from; an unknown one starts over."""
    return F.greatest(F.array_position(F.array(*[F.lit(s) for s in STAGES]), stage) - 1, F.lit(0))


def next_attempt(runs: DataFrame) -> DataFrame:
    """(version_id, attempt): the unfinished attempt goes on, else the next one opens."""
    last = runs.groupBy("version_id").agg(F.max_by(F.struct("attempt", "finished"), "attempt").alias("l"))
    return last.select("version_id", (F.col("l.attempt") + F.col("l.finished").cast("int")).alias("attempt"))


def settled(stages_done: Column, degraded: Column) -> Column:
    return F.when(stages_done < len(STAGES), F.lit("RUNNING")).when(degraded, F.lit("READY_DEGRADED")).otherwise(F.lit("READY"))


def throughput(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, event_type, n, failures) by event-time window; works on a stream or a table of (ts, event_type)."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    out = marked.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("failures"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "failures")


STATE = T.StructType([T.StructField("n", T.LongType()), T.StructField("errors", T.LongType())])
OUTPUT = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("errors", T.LongType())])


def _count_runs(key, frames, state):
    import pandas as pd

    n, errors = state.get if state.exists else (0, 0)
    for pdf in frames:
        n, errors = n + len(pdf), errors + int((pdf.event_type == "error").sum())
    state.update((n, errors))
    yield pd.DataFrame({"user_id": [key[0]], "n": [n], "errors": [errors]})


def running_counts(events: DataFrame) -> DataFrame:
    """Stateful: for each user_id its events and failures so far, updated with every batch of a stream."""
    return events.groupBy("user_id").applyInPandasWithState(_count_runs, OUTPUT, STATE, "update", "NoTimeout")


def poll(spark: SparkSession, folder: str, pattern: str, schema: str, files: int = 1) -> DataFrame:
    """A stream of the rows of the files of ``folder`` that match, ``files`` of them with each poll."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(folder)


def drain(spark: SparkSession, stream: DataFrame, name: str, checkpoint: str | None, mode: str = "update") -> DataFrame:
    """Run a stream over all there is now and return its rows: of mode ``complete`` the last batch's, else all that were written.

    Each batch is a folder of its own in the shared folder, written anew if the batch runs again.
    """
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(write).queryName(name).trigger(availableNow=True)
    writer.option("checkpointLocation", checkpoint or f"{folder}/checkpoint").start().awaitTermination()
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    rows = spark.read.schema(f"{kinds}, batch long").parquet(f"{folder}/rows")
    if mode == "complete":
        rows = rows.where(F.col("batch") == (rows.agg(F.max("batch")).first()[0] or 0))
    return rows.drop("batch")


class StageLog:
    """Runs stages of ingestion and keeps what each has counted while it wrote, without another job."""

    def __init__(self, spark: SparkSession):
        self.spark, self.rows, self.seconds = spark, [], {}

    def run(self, stage: str, df: DataFrame, **counts: Column) -> DataFrame:
        """The stage's rows, written; ``counts``: aggregates of whole numbers over them."""
        seen, began = Observation(), time.monotonic()
        out = saved(df.observe(seen, *[c.alias(name) for name, c in counts.items()]), stage)
        self.seconds[stage] = time.monotonic() - began
        self.rows += [(stage, name, int(seen.get[name] or 0)) for name in counts]
        return out

    def metrics(self) -> DataFrame:
        """(stage, metric, n); times are in ``seconds``, as they are no result."""
        return self.spark.createDataFrame(self.rows, "stage string, metric string, n long")
