"""Operator 10: approximate nearest neighbours over balanced posting lists.

Centroids come from balanced k-means on a sample of at most about ``sample`` vectors; every valid vector is then
put into the list of its nearest centroid and, if it lies near a boundary, also into up to ``replicas`` - 1 others
whose centroids are at most (1 + ``closure``) times as far. Centroids are found by beam search over a neighbour
graph held in memory (at most ``max_lists`` centroids, so its size is bounded; beyond ``max_lists`` * ``per_list``
vectors the lists grow with the data). A query looks into all the lists whose
centroids are at most (1 + ``reach``) times as far as its nearest, and into the next ones as long as those hold under
40 * k vectors; where the beam ends before that, the query ranks all the centroids. Lists and their queries are joined in blocks of
at most about ``block`` vectors and ``block`` queries, dealt before any exchange, so no task holds a whole hot list; each block gives every
query its nearest, measured again in double precision on the original vectors.

Defined cases
* null vector, null or non-finite component, zero vector, null vec_id, or a length that isn't the commonest:
  takes no part, neither as a query nor as a candidate;
* rows sharing a vec_id are one item, as far away as the nearest of them, and never a candidate of their own query;
* equal distances: the smaller vec_id first; fewer than k candidates: all of them; empty table: empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_slices, stored


def valid_vectors(df: DataFrame, item: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    out = df.select(F.col(item).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    out = out.where(fine)
    commonest = out.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return out.where(F.size("v") == (commonest["dim"] if commonest else 0))


def balanced_centroids(x: np.ndarray, lists: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k-means whose assignment pays for crowded clusters."""
    rng = np.random.default_rng(seed)
    lists = min(lists, len(x))
    c = x[rng.choice(len(x), lists, replace=False)].copy()
    price = np.zeros(lists)
    for _ in range(rounds):
        near = np.empty(len(x), np.int64)
        total = 0.0
        half = (c**2).sum(1)
        for at in range(0, len(x), 2048):
            d = half[None] - 2 * x[at : at + 2048] @ c.T + (x[at : at + 2048] ** 2).sum(1)[:, None]
            near[at : at + 2048] = (d + price).argmin(1)
            total += float(np.maximum(d, 0).min(1).sum())
        size = np.bincount(near, minlength=lists)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        full = size > 0
        c[full] = sums[full] / size[full][:, None]
        lost = np.flatnonzero(~full)
        c[lost] = x[rng.choice(len(x), len(lost))]
        price = np.maximum(price + 0.3 * total / len(x) * (size * lists / len(x) - 1), 0)
    return c


class Centroids:
    """Centroids and a graph of near neighbours and a few far ones, searched by beam."""

    def __init__(self, c: np.ndarray, sample: np.ndarray, degree: int = 24, far: int = 8, seed: int = 11):
        self.c = c
        self.norm = (c**2).sum(1)
        n, rng = len(c), np.random.default_rng(seed)
        near = np.empty((n, min(degree, max(n - 1, 1))), np.int64)
        for at in range(0, n, 1024):
            d = self.norm[None] - 2 * c[at : at + 1024] @ c.T
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
            near[at : at + 1024] = d.argsort(1)[:, : near.shape[1]]
        self.links = np.hstack([near, rng.integers(0, n, (n, far))])
        self.entry = rng.choice(n, min(n, 16), replace=False)
        #: Distances under the usual one count as that: a vector may be a centroid itself.
        self.least = float(np.median(self.search(sample[:1000], 4)[1][:, 0])) if len(sample) else 0.0

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row of q the ``beam`` nearest centroids found and their distances, nearest first; -1 and inf fill up."""
        b, n = len(q), len(self.c)
        rows = np.arange(b)[:, None]
        qn = (q**2).sum(1)[:, None]

        def distance(ids):
            return np.maximum(qn + self.norm[ids] - 2 * np.einsum("bd,bkd->bk", q, self.c[ids]), 0)

        ids = np.broadcast_to(self.entry, (b, len(self.entry))).copy()
        dist = distance(ids)
        seen = np.zeros((b, n), bool)
        seen[rows, ids] = True
        open_ = np.ones(ids.shape, bool)
        while True:
            order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
            ids, dist, open_ = ids[rows, order], dist[rows, order], open_[rows, order]
            if not open_.any():
                return np.where(np.isfinite(dist), ids, -1), np.sqrt(dist)
            pick = np.argmax(open_, axis=1)[:, None]  # the nearest one not yet expanded
            todo = open_[rows, pick]
            open_[rows, pick] = False
            new = self.links[ids[rows, pick][:, 0]]
            fresh = todo & ~seen[rows, new]
            new_sorted = np.sort(np.where(fresh, new, -1), axis=1)  # a far link may repeat a near one
            fresh = new_sorted >= 0
            fresh[:, 1:] &= new_sorted[:, 1:] != new_sorted[:, :-1]
            new = np.maximum(new_sorted, 0)
            row, at = np.nonzero(fresh)
            seen[row, new[row, at]] = True
            d = np.where(fresh, distance(new), np.inf)
            ids, dist, open_ = np.hstack([ids, new]), np.hstack([dist, d]), np.hstack([open_, fresh])


    def rank(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of q all the centroids and their distances, nearest first."""
        dist = np.maximum((q**2).sum(1)[:, None] + self.norm[None] - 2 * q @ self.c.T, 0)
        ids = np.argsort(dist, axis=1, kind="stable")
        return ids, np.sqrt(np.take_along_axis(dist, ids, axis=1))


def _lists(shared, beam: int, ratio: float, most: int | None = None, sizes: np.ndarray | None = None, need: int = 0):
    """Rows of (vec_id, v) to rows of (list, vec_id, v), one for each list.

    With ``sizes`` of the lists, all within the ratio are taken, and as many of the nearest as hold ``need`` vectors,
    however far they are: the beam is no bound.
    """

    def chosen(graph, ids, dist):
        inside = (ids >= 0) & (dist <= (1 + ratio) * np.maximum(dist[:, :1], graph.least))
        if most:
            inside[:, most:] = False
        if sizes is not None:
            nearer = np.cumsum(np.where(ids >= 0, sizes[ids], 0), axis=1)
            inside[:, 1:] |= (nearer[:, :-1] < need) & (ids[:, 1:] >= 0)
        return inside

    def run(batches):
        graph = shared.value
        for batch in small_slices(batches, 512):
            if not batch.num_rows:
                continue
            v = np.array(batch.column(1).flatten()).reshape(batch.num_rows, -1)
            ids, dist = graph.search(v, beam)
            inside = chosen(graph, ids, dist)
            row, at = np.nonzero(inside)
            found = [(row, ids[row, at])]
            if sizes is not None and ids.shape[1] < len(graph.c):
                cut = np.flatnonzero(inside[:, -1])  # more lists may follow beyond the beam
                found = [(row[~inside[row, -1]], ids[row, at][~inside[row, -1]])]
                if len(cut):
                    ids, dist = graph.rank(v[cut])
                    row, at = np.nonzero(chosen(graph, ids, dist))
                    found.append((cut[row], ids[row, at]))
            for row, lists in found:
                for at in range(0, len(row), 4096):
                    part = pa.array(row[at : at + 4096])
                    yield pa.RecordBatch.from_arrays([pa.array(lists[at : at + 4096]), batch.column(0).take(part), batch.column(1).take(part)], names=["list", "vec_id", "v"])

    return run


def _nearest(k: int):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if vectors.num_rows and queries.num_rows:
            ids, qids = vectors["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
            v = vectors["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            q = queries["v"].combine_chunks().flatten().to_numpy().reshape(len(qids), -1)
            vn = (v**2).sum(1)
            for at in range(0, len(q), 256):
                part, part_ids = q[at : at + 256], qids[at : at + 256]
                d = vn[None] + (part**2).sum(1)[:, None] - 2 * part @ v.T
                d[part_ids[:, None] == ids[None]] = np.inf
                kth = np.partition(d, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
                slack = 1e-9 * (vn.max() + (part**2).sum(1) + 1e-300)
                for i in range(len(part)):
                    near = np.flatnonzero((d[i] <= kth[i] + slack[i]) & np.isfinite(d[i]))
                    exact = np.sqrt(((v[near] - part[i]) ** 2).sum(1))
                    best = np.lexsort((ids[near], exact))[:k]
                    out_q += [int(part_ids[i])] * len(best)
                    out_v += ids[near][best].tolist()
                    out_s += exact[best].tolist()
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_s, pa.float64())})

    return run


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 10, per_list: int = 256, max_lists: int = 4096, sample: int = 20_000,
    closure: float = 0.1, replicas: int = 4, reach: float = 0.25, beam: int = 64, block: int = 4096,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of ``vectors`` found for each of ``queries``, both (vec_id, v)."""
    spark = vectors.sparkSession
    n = vectors.count()
    part = min(1.0, sample / max(n, 1))
    chosen = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < round(part * 1_000_000)).select("v").limit(2 * sample).toArrow()
    x = chosen["v"].combine_chunks().flatten().to_numpy().reshape(chosen.num_rows, -1) if chosen.num_rows else np.zeros((1, 1))
    lists = int(max(1, min(n // per_list, max_lists, len(x))))
    shared = spark.sparkContext.broadcast(Centroids(balanced_centroids(x, lists), x))
    schema = "list long, vec_id long, v array<double>"
    posted = stored(vectors.mapInArrow(_lists(shared, 16, closure, replicas), schema), "postings")
    sizes = np.zeros(lists, np.int64)
    for r in posted.groupBy("list").count().collect():  # max_lists rows at most
        sizes[r["list"]] = r["count"]
    probes = stored(queries.mapInArrow(_lists(shared, beam, reach, sizes=sizes, need=40 * k), schema), "probes")

    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))

    shape = stored(blocks(posted, "nv").join(blocks(probes, "nq"), "list"), "blocks")  # max_lists rows at most, so it may go to all executors

    def dealt(df: DataFrame, own: str, other: str, mine: str, copies: str) -> DataFrame:
        df = df.join(F.broadcast(shape), "list").withColumn(own, F.pmod(F.xxhash64("vec_id"), F.col(mine)).cast("int"))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(copies) - 1))).select("list", "bv", "bq", "vec_id", "v")

    keys = ["list", "bv", "bq"]
    left, right = dealt(posted, "bv", "bq", "nv", "nq"), dealt(probes, "bq", "bv", "nq", "nv")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_nearest(k), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_ann(spark, sf_dir: str) -> DataFrame:
    vectors = valid_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))
