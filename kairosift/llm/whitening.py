"""Operator 13: embedding whitening by LOBPCG.

The leading eigenvectors of the covariance come from a locally optimal block iteration. Each step takes the blocks of the
iterate, of its residuals and of the directions of the step before, makes them orthonormal, and asks Spark for one product
of the covariance with them: every task centres its rows, multiplies, and gives a sum for each cell; the sums are added by
cell. Rayleigh-Ritz on that product gives the next iterate with its residuals. The covariance itself is never formed. The
iteration ends when the residuals of all wanted vectors are certified by a fresh product: below ``tolerance`` of the
largest eigenvalue, or no longer falling (what rounding allows) while below ``worst`` of it; else it raises an error.

Only sums go to the driver: the dimensions' sums, and a cell for each dimension and vector of the blocks. Only the block
(dimensions x vectors) goes to the tasks. Sums of whole numbers are exact; rows are centred as (n*x - S)/n, exactly but
for the division.

Defined cases
* vectors that are null or empty, or hold null or non-finite entries, and those whose length isn't the commonest one
  (ties: the shorter) take no part: no row;
* repeated vectors count once in the fit and each get their rows; null vec_id is kept;
* components without variance (eigenvalue not over 1e-12 of the largest) have no whitened value and are left out, so one
  different vector, or an empty table, gives no row;
* fewer dimensions than components: as many as there are dimensions; other columns are not read;
* a deviation beyond the range of long is null.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_slices, stored, table

_PARTS = T.StructType([T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(T.LongType()))])
_CELLS = T.StructType([T.StructField("cells", T.ArrayType(T.DoubleType())), T.StructField("squares", T.DoubleType())])
#: Rows of a batch that are multiplied at once.
ROWS = 2048


def grid_vectors(embeddings: DataFrame, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """(vec_id, x): floor(scale * entry) + shift of the vectors that take part."""
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where("size(v) > 0")
    rows = rows.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
    sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    wanted = sizes[0]["size"] if sizes else 0
    return rows.where(F.size("v") == wanted).select("vec_id", F.transform("v", lambda c: F.floor(c * scale) + shift).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _sums(batches):
    n, sums = 0, None
    for batch in small_slices(batches, ROWS):
        if batch.num_rows:
            x = _matrix(batch.column(0))
            n, sums = n + len(x), x.sum(0) if sums is None else sums + x.sum(0)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([sums], pa.list_(pa.int64()))], names=_PARTS.names)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (n * x - sums) / n


def _products(n: int, sums: np.ndarray, block: np.ndarray):
    """Sums over a task's rows c of c c' block, cell by cell, and of c'c."""

    def run(batches):
        cells, squares = np.zeros(block.shape), 0.0
        for batch in small_slices(batches, ROWS):
            if batch.num_rows:
                c = _centred(_matrix(batch.column(0)), n, sums)
                cells += c.T @ (c @ block)
                squares += float((c * c).sum())
        yield pa.RecordBatch.from_arrays([pa.array([cells.ravel()], pa.list_(pa.float64())), pa.array([squares])], names=_CELLS.names)

    return run


@dataclass
class Covariance:
    """The covariance of the rows of ``fit`` (a column x) as something that multiplies."""

    fit: DataFrame
    n: int
    sums: np.ndarray
    trace: float = 0.0

    @classmethod
    def of(cls, fit: DataFrame) -> Covariance:
        parts = fit.mapInArrow(_sums, _PARTS)
        by_place = parts.select("n", F.posexplode("sums").alias("place", "s")).groupBy("place").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
        found = by_place.orderBy("place").collect()  # a row for each dimension
        if not found:
            return cls(fit, 0, np.zeros(0, np.int64))
        return cls(fit, found[0]["n"], np.array([int(r["s"]) for r in found], np.int64))

    def times(self, block: np.ndarray) -> np.ndarray:
        parts = self.fit.mapInArrow(_products(self.n, self.sums, block), _CELLS)
        # the place after the last cell holds the squares
        cells = parts.select(F.posexplode(F.concat("cells", F.array("squares"))).alias("place", "v"))
        got = cells.groupBy("place").agg(F.sum("v").alias("v")).toArrow()  # a row for each cell of the block
        out = np.zeros(block.size + 1)
        out[got["place"].to_numpy()] = got["v"].to_numpy()
        self.trace = out[-1] / self.n
        return out[:-1].reshape(block.shape) / self.n


def _orthonormal(blocks: list[np.ndarray], most: int) -> np.ndarray:
    """An orthonormal basis of what the blocks span, the first one first; parts that add nothing are left out."""
    basis = np.zeros((len(blocks[0]), 0))
    for block in blocks:
        size = np.linalg.norm(block, axis=0)
        block = block[:, size > 0] / size[size > 0]
        for _ in range(2):
            block = block - basis @ (basis.T @ block)
        if block.shape[1]:
            u, s, _ = np.linalg.svd(block, full_matrices=False)
            u = u[:, s > 1e-10]
            u = u - basis @ (basis.T @ u)
            basis = np.concatenate([basis, np.linalg.qr(u)[0]], 1)[:, :most]
    return basis


@dataclass
class Eigen:
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray  # of the last product, over the largest eigenvalue
    steps: int


def lobpcg(times, d: int, wanted: int, guard: int = 8, tolerance: float = 1e-13, worst: float = 1e-8, most: int = 300) -> Eigen:
    """The ``wanted`` leading eigenpairs of the symmetric map ``times`` of d x k blocks; ``guard`` more vectors speed it up."""
    m = min(d, wanted + guard)
    wanted = min(wanted, d)
    x = np.random.Generator(np.random.PCG64(13)).standard_normal((d, m))
    residual, direction, best, idle = np.zeros((d, 0)), np.zeros((d, 0)), np.inf, 0
    basis = _orthonormal([x], d)
    for step in range(1, most + 1):
        product = times(basis)
        gram = basis.T @ product
        values, turn = np.linalg.eigh((gram + gram.T) / 2)
        values, turn = values[::-1][:m], turn[:, ::-1][:, :m]
        new, image = basis @ turn, product @ turn
        residual = image - new * values
        top = max(values[0], np.finfo(float).tiny)
        error = np.linalg.norm(residual[:, :wanted], axis=0) / top
        # the part of the step beside the former iterate, which comes first in the basis
        ahead = turn.copy()
        ahead[: x.shape[1]] = 0
        direction, x = basis @ ahead, new
        idle = idle + 1 if error.max() >= best else 0
        best = min(best, error.max())
        if error.max() <= tolerance or idle >= 6 and error.max() <= worst or not values[0] > 0:
            return Eigen(values[:wanted], new[:, :wanted], error, step)
        basis = _orthonormal([x, residual, direction], d)
    raise RuntimeError(f"residuals of {error.max():.3g} of the largest eigenvalue after {most} steps")


WHITENED = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
     *[T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error")]]
)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    apart = n * x - sums
    rough = (apart.astype(float) ** 2).sum(1)
    exact = (apart * apart).sum(1)
    near = np.flatnonzero(rough > 9e18)
    out = exact.tolist()
    for i in near:  # whole numbers of any size
        value = sum(int(v) ** 2 for v in apart[i])
        out[i] = value if value < 1 << 63 else None
    return pa.array(out, pa.int64())


def _rows(n: int, sums: np.ndarray, eigen: Eigen, trace: float, identity_error: float):
    k = len(eigen.values)
    scaled, explained = eigen.vectors / np.sqrt(eigen.values), eigen.values / trace

    def run(batches):
        for batch in small_slices(batches, ROWS):
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            each = pa.array(np.repeat(np.arange(len(x)), k))
            whitened = _centred(x, n, sums) @ scaled
            size = len(x) * k
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(size, n)), _deviations(x, n, sums).take(each),
                 pa.array(whitened.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(size, identity_error))], names=WHITENED.names)

    return run


def whiten(embeddings: DataFrame, components: int = 16) -> DataFrame:
    """A row for each vector that takes part and each component: see ``WHITENED``."""
    spark = embeddings.sparkSession
    rows = grid_vectors(embeddings)
    fit = stored(rows.select("x").distinct(), "whitening-fit")
    covariance = Covariance.of(fit)
    if covariance.n:
        eigen = lobpcg(covariance.times, len(covariance.sums), components)
        some = eigen.values > 1e-12 * max(eigen.values[0], 0)
        eigen = Eigen(eigen.values[some], eigen.vectors[:, some], eigen.residuals[some], eigen.steps)
    if not covariance.n or not some.any():
        return spark.createDataFrame([], WHITENED)
    scaled = eigen.vectors / np.sqrt(eigen.values)
    error = float(np.abs(scaled.T @ covariance.times(scaled) - np.eye(len(eigen.values))).max())
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "x")
    return rows.mapInArrow(_rows(covariance.n, covariance.sums, eigen, covariance.trace, error), WHITENED)


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
