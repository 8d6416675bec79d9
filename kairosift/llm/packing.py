"""Operator 9: packing by optimal length buckets.

The lengths of all sequences make one histogram (at most ``max_len`` rows). Dynamic programming over it finds the
``buckets`` upper lengths that need the least padding in all. Each bucket takes batches of as many sequences as
the token budget allows at its padded length.

A bucket is dealt by hash to shards of about ``per_shard`` sequences, and batches are numbered within a shard, so
no task orders a whole bucket; a shard has one batch that isn't full at most.

Defined cases
* documents over ``max_len`` tokens become consecutive pieces, every token in one of them;
* null or empty text: one piece of 0 tokens, which takes the room of one token;
* equal lengths share a bucket; repeated rows are sequences of their own; null doc_id is kept;
* fewer different lengths than ``buckets``: a bucket for each length; empty table: empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .piece_codec import token_counts


def bucket_lengths(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The at most ``buckets`` upper lengths of least padding for a histogram of lengths, ascending."""
    order = np.argsort(lengths)
    x, c = np.asarray(lengths, np.float64)[order], np.asarray(counts, np.float64)[order]
    n = len(x)
    if n <= buckets:
        return [int(v) for v in x]
    number, total = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(c * x)])
    # padding[i, j]: lengths i .. j in one bucket
    padding = x[None, :] * (number[None, 1:] - number[:-1, None]) - (total[None, 1:] - total[:-1, None])
    padding[np.tril_indices(n, -1)] = np.inf
    best = padding[0].copy()  # of lengths 0 .. j in k buckets
    chosen = []
    for _ in range(1, buckets):
        cost = np.concatenate([[np.inf], best[:-1]])[:, None] + padding
        chosen.append(cost.argmin(0))
        best = cost.min(0)
    out, j = [], n - 1
    for first in reversed(chosen):
        out.append(int(x[j]))
        j = int(first[j]) - 1
    return [int(x[j]), *reversed(out)]


def pack(sequences: DataFrame, max_len: int = 2048, buckets: int = 16, budget: int = 16_384, per_shard: int = 20_000) -> DataFrame:
    """(doc_id, piece, start, n_tokens, bucket_len, shard, batch, slot) of ``sequences`` (doc_id, n_tokens)."""
    whole = sequences.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("total"))
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("total") - 1, F.lit(0)), F.lit(max_len).cast("long"))
    pieces = whole.select("doc_id", "total", F.posexplode(starts).alias("piece", "start"))
    pieces = pieces.select("doc_id", "piece", "start", F.least(F.col("total") - F.col("start"), F.lit(max_len)).alias("n_tokens"))
    pieces = pieces.withColumn("__room", F.greatest("n_tokens", F.lit(1)))
    histogram = pieces.groupBy("__room").agg(F.count(F.lit(1)).alias("n")).toArrow()  # max_len rows at most
    room, n = histogram["__room"].to_numpy(), histogram["n"].to_numpy()
    tops = bucket_lengths(room, n, buckets) if len(room) else [max_len]
    top, shards, fit, low = F.lit(tops[-1]), F.lit(1), F.lit(1), 0
    for t in reversed(tops):
        low = max([b for b in tops if b < t], default=0)
        size = int(n[(room > low) & (room <= t)].sum()) if len(room) else 0
        many = max(1, budget // t)
        inside = F.col("__room") <= t
        top = F.when(inside, F.lit(t)).otherwise(top)
        fit = F.when(inside, F.lit(many)).otherwise(fit)
        shards = F.when(inside, F.lit(-(-size // max(per_shard, 50 * many)) or 1)).otherwise(shards)
    hashed = F.xxhash64("doc_id", "piece")
    dealt = pieces.select("doc_id", "piece", "start", "n_tokens", top.alias("bucket_len"), fit.alias("__fit"), F.pmod(hashed, shards).cast("int").alias("shard"))
    place = F.row_number().over(Window.partitionBy("bucket_len", "shard").orderBy(hashed, "doc_id", "piece")) - 1
    dealt = dealt.withColumn("__place", place)
    return dealt.select(
        "doc_id", "piece", "start", "n_tokens", "bucket_len", "shard",
        F.floor(F.col("__place") / F.col("__fit")).cast("long").alias("batch"), (F.col("__place") % F.col("__fit")).cast("int").alias("slot"),
    )


def pack_documents(docs: DataFrame, **limits) -> DataFrame:
    """``pack`` by the token counts of whole texts."""
    return pack(stored(token_counts(docs.select("doc_id", "text")).select("doc_id", "n_tokens"), "lengths"), **limits)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
