"""Operator 8: line dedup over levelled sorted runs of line hashes.

A run is a table of (h1, h2, n_docs, owner) sorted by the 128-bit line hash. Batches of documents arrive
from the largest doc_id down. Each batch is merge-anti-joined with the runs so far: keys that no run holds
are new, and the batch's largest doc_id owns them; keys that a run holds only add to the count. The batch's
rows become a run of level 0. ``fan_in`` runs of one level are merged to one of the next (sum of counts, the
owner kept), so a key is rewritten once a level.

Defined cases
* null or empty text: one empty line, text '' in the result;
* a document is a row; rows with one doc_id count each, and all of them keep a line that this doc_id owns;
* null doc_id: the row neither counts nor loses lines;
* empty table: empty result; a column of the input named as one this operator adds is replaced;
* keys are compared by 128 bits of hash (collisions: under 1e-14 for 1e12 different lines).
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_SPACE, fields, fresh, small_slices, stored, with_columns, without

H = ["__h1", "__h2"]


def line_key(line: str) -> bytes:
    """The line stripped of ASCII white space, A-Z lower-cased (bytes.lower touches ASCII alone)."""
    return line.strip(ASCII_SPACE).encode("utf-8", "surrogatepass").lower()


def key_hash(line: str, min_chars: int) -> tuple[int, int] | None:
    key = line.strip(ASCII_SPACE)
    if len(key) < min_chars:
        return None
    n = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass").lower())
    return (n >> 64) - (1 << 63), (n & (1 << 64) - 1) - (1 << 63)


def _keys(min_chars: int):
    def run(batches):
        for batch in small_slices(batches, 500):
            ids, h1, h2 = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k in {k for k in (key_hash(x, min_chars) for x in text.split("\n")) if k}:
                    ids.append(doc)
                    h1.append(k[0])
                    h2.append(k[1])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())], names=["__id", *H])

    return run


def _drop(min_chars: int):
    def run(batches):
        for batch in small_slices(batches, 500):
            kept, n_lines, n_dropped = [], [], []
            drops = batch.column(batch.schema.get_field_index("__drop")).to_pylist()
            for text, drop in zip(batch.column(batch.schema.get_field_index("text")).to_pylist(), drops):
                lines = (text or "").split("\n")
                if drop:
                    gone = {(d["__h1"], d["__h2"]) for d in drop}
                    stay = [x for x in lines if key_hash(x, min_chars) not in gone]
                else:
                    stay = lines
                kept.append("\n".join(stay))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
            at = [i for i, n in enumerate(batch.schema.names) if n != "__drop"]
            rest = pa.RecordBatch.from_arrays([batch.column(i) for i in at], names=[batch.schema.names[i] for i in at])
            yield with_columns(rest, {"text": pa.array(kept, pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())})

    return run


class LineRuns:
    """Levelled sorted runs of line hashes, all of them tables in the shared folder."""

    def __init__(self, fan_in: int = 3):
        self.fan_in = fan_in
        self.levels: list[list[DataFrame]] = [[]]

    def all(self) -> DataFrame | None:
        runs = [r for level in self.levels for r in level]
        return reduce(DataFrame.unionByName, runs) if runs else None

    def add(self, keys: DataFrame) -> None:
        """Take in a batch of (doc_id, line hash): find which of its keys no run holds, and add the batch's own run."""
        own = keys.groupBy(*H).agg(F.count(F.lit(1)).alias("n_docs"), F.max("__id").alias("owner"))
        held = self.all()
        if held is not None:
            held = held.select(*H).hint("merge")
            fresh = own.join(held, H, "left_anti")
            again = own.join(held, H, "left_semi").withColumn("owner", F.lit(None).cast("long"))
            own = fresh.unionByName(again)
        self.levels[0].append(stored(own.sortWithinPartitions(*H), "line-run"))
        self.compact()

    def compact(self) -> None:
        for at, level in enumerate(self.levels):
            if len(level) >= self.fan_in:
                if at + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[at + 1].append(stored(merged(reduce(DataFrame.unionByName, level)).sortWithinPartitions(*H), "line-run"))
                self.levels[at] = []


def merged(runs: DataFrame) -> DataFrame:
    return runs.groupBy(*H).agg(F.sum("n_docs").alias("n_docs"), F.max("owner").alias("owner"))


def drop_repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fan_in: int = 3) -> DataFrame:
    """``docs`` (doc_id, text, any more) with text less its repeated lines, n_lines (before) and n_dropped.

    A line goes if its key has ``min_chars`` code points, is in ``min_docs`` documents and the document isn't
    the one of the largest doc_id holding it.
    """
    docs = without(docs, "n_lines", "n_dropped", "__drop")
    core = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")
    cuts = core.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.02) if batches > 1 else []
    cuts = sorted(set(cuts), reverse=True)
    batch = F.lit(len(cuts))
    for i, cut in reversed(list(enumerate(cuts))):  # batch 0 holds the largest ids
        batch = F.when(F.col("__id") > cut, F.lit(i)).otherwise(batch)
    keys = core.mapInArrow(_keys(min_chars), T.StructType([T.StructField(n, T.LongType()) for n in ("__id", *H)]))
    keys = stored(keys.withColumn("__batch", batch), "line-keys", ["__batch"])
    runs = LineRuns(fan_in)
    for i in range(len(cuts) + 1):
        runs.add(keys.where(F.col("__batch") == i).drop("__batch"))
    common = merged(runs.all()).where(F.col("n_docs") >= min_docs).select(*H, "owner")
    common = stored(common, "line-common")  # a plain table: Spark then splits a hot line
    drops = keys.join(common, H).where(F.col("__id") != F.col("owner"))
    drops = drops.groupBy("__id").agg(F.collect_set(F.struct(*H)).alias("__drop"))
    (own,) = fresh(docs, "__id")
    joined = docs.join(drops.withColumnRenamed("__id", own), F.col("doc_id") == F.col(own), "left").drop(own)
    return joined.mapInArrow(_drop(min_chars), fields(docs, ("n_lines", T.LongType()), ("n_dropped", T.LongType())))


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = drop_repeated_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: DuckDB. translate() lower-cases A-Z alone; chr(11) and chr(12) are the two white space characters without an escape.
OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)
), keyed AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), common AS (
  SELECT k, max(doc_id) AS owner FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT keyed.doc_id, i, line, (owner IS NOT NULL AND owner <> keyed.doc_id) AS gone FROM keyed LEFT JOIN common USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
