"""Joins of intervals by equality on bins.

An interval is put on the level whose bins are just as wide as it is long, or wider (level l: base ** l), so it lies in two
bins of it at most. Two intervals meet on the coarser one of their levels: each side is put there into its bins, again two
at most, and the bins are joined by equality; what overlaps is checked then. A pair that shares two bins is taken from the
first one. Levels are those that a histogram of the lengths has, so a side has at most two rows for each of a few levels.

Few long intervals don't widen the bins of many short ones, a hot bin is an exchange on plain columns that Spark can split,
and nothing is sent to all executors. Pairs that are met but don't overlap are at most of the order of those that do.

Defined cases: bounds that are null, or low over high, meet nothing; bounds are inclusive; equal intervals are pairs of
their own; an empty side gives no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = 8


def _level(length: Column) -> Column:
    """The least l with base ** l >= length, in whole numbers."""
    level = F.lit(0)
    for at in range(20):
        level = F.when(length > BASE**at, F.lit(at + 1)).otherwise(level)
    return level


def levels(low: Column, high: Column) -> Column:
    return _level((high - low + 1).cast("long"))


def _on_levels(side: DataFrame, low: str, high: str, found: list[int]) -> DataFrame:
    """A row for each bin of each level from its own on: adds own, level, bin and the first bin there."""
    own = side.where(F.col(low) <= F.col(high)).withColumn("__own", levels(F.col(low), F.col(high)))
    width = lambda at: F.element_at(F.create_map(*[F.lit(x) for n in found for x in (n, BASE**n)]), at).cast("long")
    # whole division that goes down for dates before the year 1 too
    place = lambda value, at: F.floor((F.col(value).cast("long") - F.pmod(F.col(value).cast("long"), width(at))) / width(at))
    each = own.withColumn("__level", F.explode(F.filter(F.array(*[F.lit(n) for n in found]), lambda n: n >= F.col("__own"))))
    each = each.withColumn("__from", place(low, F.col("__level")))
    return each.withColumn("__bin", F.explode(F.sequence(F.col("__from"), place(high, F.col("__level")))))


def overlaps(a: DataFrame, b: DataFrame, a_bounds: tuple[str, str], b_bounds: tuple[str, str]) -> DataFrame:
    """All pairs of rows whose intervals share a point; columns of both, whose names must differ."""
    (al, ah), (bl, bh) = a_bounds, b_bounds
    histogram = a.where(f"{al} <= {ah}").select(levels(F.col(al), F.col(ah)).alias("n")).union(b.where(f"{bl} <= {bh}").select(levels(F.col(bl), F.col(bh)).alias("n")))
    found = [r["n"] for r in histogram.groupBy("n").count().orderBy("n").collect()] or [0]  # 21 at most
    x = _on_levels(a, al, ah, found)
    y = _on_levels(b, bl, bh, found).withColumnsRenamed({c: f"{c}_b" for c in ("__own", "__level", "__from", "__bin")})
    pairs = x.join(y, (F.col("__level") == F.col("__level_b")) & (F.col("__bin") == F.col("__bin_b")))
    met = (F.col("__level") == F.greatest("__own", "__own_b")) & (F.col("__bin") == F.greatest("__from", "__from_b"))
    return pairs.where(met & (F.col(al) <= F.col(bh)) & (F.col(bl) <= F.col(ah))).select(*[F.col(f"`{c}`") for c in (*a.columns, *b.columns)])


def contained(spans: DataFrame, inner: DataFrame, on: list[str], outer_bounds: tuple[str, str], inner_bounds: tuple[str, str]) -> DataFrame:
    """Pairs of rows of equal ``on`` where the inner bounds lie within the outer ones; a cut one is in neither."""
    (al, ah), (bl, bh) = outer_bounds, inner_bounds
    return inner.join(spans, on).where((F.col(al) <= F.col(bl)) & (F.col(bh) <= F.col(ah)))
