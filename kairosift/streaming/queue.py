"""The worker queue as state: heartbeats, silence, retries and the end of a job, over a stream of its events.

Each job keeps its state and the events that the watermark hasn't passed yet. Events are taken in order of time once the
watermark has passed them, so those that come out of order within the delay change nothing; later ones are dropped by
the watermark. A timer wakes a job when its next event is due, when its worker has been silent for too long (the claim
goes back, its attempt goes on), and when a job that has ended is to be forgotten.

Events (job_id, ts, event_id, kind): BEAT claims a job that isn't claimed and keeps a claim alive, FAIL ends an attempt (it
is tried again while attempts are left), DONE ends the job. FAIL and DONE of a job that isn't claimed, and all of one that
has ended, are ignored until it is forgotten. Events of one time go by event_id; null job_id or ts: no event.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .runs import MAX_ATTEMPTS, STALE_S

_S = 1_000_000  # times are microseconds
TRANSITIONS = "job_id long, at timestamp, transition string, attempts int"


@dataclass
class Job:
    """CLAIMED, PENDING (before a claim, after a failure), STALE (its claim went back), DONE or FAILED."""

    state: str = "PENDING"
    attempts: int = 0
    beat: int = 0
    ended: int = 0


def step(job: Job, at: int, kind: str, stale: int, ttl: int) -> list[tuple[int, str, int]]:
    """The job after an event; what happened: (time, transition, attempts)."""
    out = silence(job, at, stale)
    if job.state in ("DONE", "FAILED"):
        if at <= job.ended + ttl:
            return out
        job.__dict__.update(Job().__dict__)
    if kind == "BEAT":
        if job.state != "CLAIMED":
            job.attempts += job.state == "PENDING"
            job.state = "CLAIMED"
            out.append((at, "CLAIMED", job.attempts))
        job.beat = at
    elif job.state == "CLAIMED":
        job.state = "DONE" if kind == "DONE" else "PENDING" if job.attempts < MAX_ATTEMPTS else "FAILED"
        job.ended = at
        out.append((at, job.state, job.attempts))
    return out


def silence(job: Job, now: int, stale: int) -> list[tuple[int, str, int]]:
    if job.state == "CLAIMED" and now > job.beat + stale:
        job.state = "STALE"
        return [(job.beat + stale, "RECLAIMED", job.attempts)]
    return []


class Queue(StatefulProcessor):
    def __init__(self, stale_s: int, ttl_s: int):
        self.stale, self.ttl = stale_s * _S, ttl_s * _S

    def init(self, handle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "state string, attempts int, beat long, ended long")
        self.waiting = handle.getListState("waiting", "at long, event_id long, kind string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(at), int(i), kind) for pdf in rows for at, i, kind in zip(pdf.ts.astype("datetime64[us]").astype("int64"), pdf.event_id, pdf.kind)]
        yield from self._advance(key, new, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, [], timerValues)

    def close(self) -> None:
        pass

    def _advance(self, key, new: list[tuple[int, int, str]], timers) -> Iterator[pd.DataFrame]:
        """The job's transitions as a frame, none if there are none: each call of the state is a round trip, and a frame takes longer than the job."""
        passed = timers.getCurrentWatermarkInMs() * 1000
        held, was = [tuple(r) for r in self.waiting.get()], self.job.get()
        events = sorted([*held, *new])
        job = Job(*was) if was else Job()
        due = [e for e in events if e[0] <= passed]
        left = events[len(due) :]
        out = [t for at, _, kind in due for t in step(job, at, kind, self.stale, self.ttl)]
        out += silence(job, passed, self.stale)
        if job.state in ("DONE", "FAILED") and passed > job.ended + self.ttl:
            job = Job()
        wake = []
        if left:
            self.waiting.put(left)
            wake.append(left[0][0])
        elif held:
            self.waiting.clear()
        if job == Job():
            if was:
                self.job.clear()
        else:
            self.job.update((job.state, job.attempts, job.beat, job.ended))
            if job.state == "CLAIMED":
                wake.append(job.beat + self.stale)
            elif job.state in ("DONE", "FAILED"):
                wake.append(job.ended + self.ttl)
        for at in wake:
            self.handle.registerTimer(at // 1000 + 1)
        if out:
            at, told, attempts = zip(*out)
            yield pd.DataFrame({"job_id": np.full(len(out), key[0], "int64"), "at": np.array(at, "datetime64[us]"), "transition": np.array(told, object), "attempts": np.array(attempts, "int32")})


def transitions(events: DataFrame, late: str = "1 minute", stale_s: int = STALE_S, ttl_s: int = 86_400) -> DataFrame:
    """(job_id, at, transition, attempts) of a stream of events: CLAIMED, RECLAIMED, PENDING, DONE, FAILED."""
    known = events.where("job_id is not null and ts is not null").select("job_id", "ts", "event_id", "kind").withWatermark("ts", late)
    return known.groupBy("job_id").transformWithStateInPandas(Queue(stale_s, ttl_s), TRANSITIONS, "append", "eventTime")


def kept(stream: DataFrame, folder: str, checkpoint: str, name: str) -> DataFrame:
    """Run a stream over all there is now; each batch becomes a folder of its own, written anew if the batch runs again."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    stream.writeStream.foreachBatch(write).queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(folder)


STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def job_events(events: DataFrame) -> DataFrame:
    """(job_id, ts, event_id, kind) of (event_id, ts, user_id, event_type): a job for each user and week."""
    kind = F.when(F.col("event_type") == "purchase", F.lit("DONE")).when(F.col("event_type") == "error", F.lit("FAIL")).otherwise(F.lit("BEAT"))
    return events.select((F.col("user_id") * 10 + F.floor(F.dayofmonth("ts") / 7)).cast("long").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", kind.alias("kind"))
