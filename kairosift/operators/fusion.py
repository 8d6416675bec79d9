"""Fusion of routes: reciprocal ranks, bounded adjustment, diversity, metrics of rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF = 60


def ranked_union(**routes: DataFrame) -> DataFrame:
    """(query_id, item, route, rank) of all routes."""
    return reduce(DataFrame.unionByName, [df.select("query_id", "item", F.lit(name).alias("route"), "rank") for name, df in routes.items()])


def fuse(ranked: DataFrame, constant: int = RRF) -> DataFrame:
    """(query_id, item, score, n_routes, routes, rank): sum of 1 / (constant + rank), ties to the smaller item."""
    fused = ranked.groupBy("query_id", "item").agg(
        F.round(F.sum(1.0 / (constant + F.col("rank"))), 12).alias("score"),
        F.count(F.lit(1)).alias("n_routes"), F.array_join(F.array_sort(F.collect_set("route")), ",").alias("routes"),
    )
    return ranks(fused)


def ranks(scored: DataFrame) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item")))


def adjust(fused: DataFrame, adjustment: Column, cap: float = 0.25) -> DataFrame:
    """Adds an adjustment of at most ``cap`` times the query's best score, and ranks anew."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    bounded = F.greatest(F.lit(0.0), F.least(adjustment, cap * best))
    return ranks(fused.withColumn("adjustment", F.round(bounded, 12)).withColumn("score", F.round(F.col("score") + F.col("adjustment"), 12)).drop("rank"))


def diversify(ranked: DataFrame, group: str, free: int = 3, penalty: float = 0.001) -> DataFrame:
    """After ``free`` items of one group each further one loses ``penalty`` more; ranks anew."""
    place = F.row_number().over(Window.partitionBy("query_id", group).orderBy(F.desc("score"), "item"))
    lowered = F.round(F.col("score") - penalty * F.greatest(F.lit(0), place - free), 12)
    return ranks(ranked.withColumn("score", lowered).drop("rank"))


def origin_weight(origin: Column, source_time: Column) -> Column:
    """Content mentions before metadata, the other way round for a question of source time."""
    wanted = F.when(source_time, F.lit("SOURCE_METADATA")).otherwise(F.lit("CONTENT_MENTION"))
    return F.when(origin == wanted, F.lit(1.0)).otherwise(F.lit(0.5))


def ranking_metrics(ranked: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, precision, mrr, ndcg, hit) at k; ``judged`` (query_id, item) are the relevant ones."""
    top = ranked.where(F.col("rank") <= k).join(judged.withColumn("rel", F.lit(1)), ["query_id", "item"], "left")
    rel = F.coalesce("rel", F.lit(0))
    per = top.groupBy("query_id").agg(
        F.sum(rel).alias("found"), F.coalesce(F.max(F.when(rel == 1, 1.0 / F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.sum(rel / F.log2(F.col("rank") + 1)).alias("dcg"),
    )
    wanted = judged.groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("wanted"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1))
    out = wanted.join(per, "query_id", "left").na.fill(0, ["found", "dcg", "mrr"])
    return out.select(
        "query_id", F.round(F.col("found") / F.col("wanted"), 9).alias("recall"), F.round(F.col("found") / k, 9).alias("precision"),
        F.round("mrr", 9).alias("mrr"), F.round(F.col("dcg") / ideal, 9).alias("ndcg"), (F.col("found") > 0).alias("hit"),
    )


def ablations(ranked: DataFrame, subsets: dict[str, list[str]], judged: DataFrame, k: int, constant: int = RRF) -> DataFrame:
    """(subset, query_id, recall, temporal_recall) at k of every subset of routes, fused and ranked in one pass.

    ``ranked`` (query_id, item, route, rank), ``judged`` (query_id, item, dated): the relevant items, and whether a date is what
    makes them so. Each row goes to the subsets that have its route; temporal recall is null where no item is dated.
    """
    of = F.map_from_entries(F.array(*[F.struct(F.lit(r), F.array(*[F.lit(s) for s, held in subsets.items() if r in held])) for r in sorted({r for held in subsets.values() for r in held})]))
    each = ranked.select("query_id", "item", "rank", F.explode(F.element_at(of, F.col("route"))).alias("subset"))
    fused = each.groupBy("subset", "query_id", "item").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 12).alias("score"))
    place = F.row_number().over(Window.partitionBy("subset", "query_id").orderBy(F.desc("score"), "item"))
    best = fused.withColumn("place", place).where(F.col("place") <= k)
    hit = best.join(judged, ["query_id", "item"]).groupBy("subset", "query_id").agg(F.count(F.lit(1)).alias("found"), F.count_if("dated").alias("found_dated"))
    wanted = judged.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("dated").alias("n_dated"))
    wanted = wanted.withColumn("subset", F.explode(F.array(*[F.lit(s) for s in subsets])))
    out = wanted.join(hit, ["subset", "query_id"], "left").na.fill(0, ["found", "found_dated"])
    dated = F.when(F.col("n_dated") > 0, F.round(F.col("found_dated") / F.col("n_dated"), 9))
    return out.select("subset", "query_id", F.round(F.col("found") / F.col("n"), 9).alias("recall"), dated.alias("temporal_recall"))
