"""Orchestration, context assembly and validation of generated answers, over tables of structured outputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import canonical
from ..session import saved

# ---- orchestration


def source_policy(has_corpora: Column, web: Column) -> Column:
    return (
        F.when(has_corpora & web, F.lit("HYBRID")).when(has_corpora, F.lit("LOCAL_ONLY")).when(web, F.lit("WEB_ONLY")).otherwise(F.lit("REJECT"))
    )


def over_budget(calls: DataFrame, limit: int, order: list[str]) -> DataFrame:
    """``calls`` (query_id, ...) with their number in the query and whether it is over the limit."""
    number = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return calls.withColumn("call_no", number).withColumn("over_budget", number > limit)


def completion(runs: DataFrame) -> DataFrame:
    """(query_id, status) of ``runs`` (query_id, source, required, ok): by required sources that have one good run."""
    sources = runs.groupBy("query_id", "source").agg(F.bool_or("required").alias("required"), F.bool_or("ok").alias("ok"))
    per = sources.groupBy("query_id").agg(
        F.coalesce(F.bool_and(F.when(F.col("required"), F.col("ok"))), F.lit(True)).alias("all_required"), F.bool_or("ok").alias("any_ok"), F.bool_and("ok").alias("all_ok")
    )
    status = (
        F.when(~F.col("any_ok"), F.lit("REJECTED")).when(F.col("all_required") & F.col("all_ok"), F.lit("COMPLETED")).otherwise(F.lit("COMPLETED_DEGRADED"))
    )
    return per.select("query_id", status.alias("status"))


def ancestry(runs: DataFrame, depth: int) -> DataFrame:
    """(run_id, root_id, depth) of ``runs`` (run_id, parent_id); lineages are bounded by the budget of ``depth``."""
    now = runs.select("run_id", F.col("run_id").alias("root_id"), F.col("parent_id").alias("up"), F.lit(0).alias("depth"))
    parents = runs.select(F.col("run_id").alias("up"), F.col("parent_id").alias("next"))
    for _ in range(depth):
        now = now.join(parents, "up", "left").select(
            "run_id", F.coalesce("up", "root_id").alias("root_id"), F.when(F.col("up").isNotNull(), F.col("next")).alias("up"),
            (F.col("depth") + F.col("up").isNotNull().cast("int")).alias("depth"),
        )
    return now.select("run_id", "root_id", "depth")


# ---- context


def relationship(same_item: Column, same_hash: Column, similar: Column, independent: Column) -> Column:
    return (
        F.when(same_item, F.lit("SAME_IDENTITY")).when(same_hash, F.lit("EXACT_DUPLICATE")).when(similar, F.lit("DERIVATIVE"))
        .when(independent, F.lit("INDEPENDENT")).otherwise(F.lit("UNKNOWN_DEPENDENCE"))
    )


def representatives(evidence: DataFrame) -> DataFrame:
    """One row a family: its best evidence, how many stand behind it and how many sources."""
    return evidence.groupBy("family").agg(
        F.max_by("evidence_id", F.struct("score", -F.col("evidence_id"))).alias("representative"),
        F.count(F.lit(1)).alias("n_evidence"), F.countDistinct("source").alias("n_sources"),
    )


def independent_support(evidence: DataFrame) -> DataFrame:
    """(unit, n_evidence, n_families): support is counted by families, raw counts don't stand in for it."""
    return evidence.groupBy("unit").agg(F.count(F.lit(1)).alias("n_evidence"), F.countDistinct("family").alias("n_families"))


def coverage(units: DataFrame, items: DataFrame, least: int = 2) -> DataFrame:
    """(unit, n_items, support): SUPPORTED with ``least`` families, PARTIALLY_SUPPORTED with any, else UNSUPPORTED."""
    n = items.groupBy("unit").agg(F.countDistinct("family").alias("n"))
    out = units.join(n, "unit", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    support = F.when(F.col("n") >= least, F.lit("SUPPORTED")).when(F.col("n") > 0, F.lit("PARTIALLY_SUPPORTED")).otherwise(F.lit("UNSUPPORTED"))
    return out.select("unit", F.col("n").cast("long").alias("n_items"), support.alias("support"))


def sufficiency(covered: DataFrame, query: str = "query_id") -> DataFrame:
    per = covered.groupBy(query).agg(F.bool_and(F.col("support") == "SUPPORTED").alias("whole"), F.bool_or(F.col("support") != "UNSUPPORTED").alias("some"))
    state = F.when(F.col("whole"), F.lit("SUFFICIENT")).when(F.col("some"), F.lit("PARTIALLY_SUFFICIENT")).otherwise(F.lit("INSUFFICIENT"))
    return per.select(query, state.alias("sufficiency"))


def select_within(items: DataFrame, budget: int, order: list[Column]) -> DataFrame:
    """``items`` (query_id, tokens, ...) in priority order with the running token sum and the decision."""
    spent = F.sum("tokens").over(Window.partitionBy("query_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    decision = F.when(F.col("spent") <= budget, F.lit("SELECTED_PRIMARY")).otherwise(F.lit("DROPPED_BUDGET"))
    return items.withColumn("spent", spent).withColumn("decision", decision)


def assembly_trace(chosen: DataFrame, config: str) -> DataFrame:
    """For each query and decision of ``chosen`` (query_id, decision, tokens, place): counts, tokens, places, configuration."""
    per = chosen.groupBy("query_id", "decision").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"), F.min("place").alias("first_place"), F.max("place").alias("last_place"))
    return per.withColumn("config", F.lit(config))


def trim(text: Column, tokens: Column, limit: int) -> Column:
    """(extent, text) by words: FULL, or EXTRACTED to the first ``limit`` words."""
    words = F.split(text, " ")
    short = F.array_join(F.slice(words, 1, limit), " ")
    return F.when(tokens <= limit, F.struct(F.lit("FULL").alias("extent"), text.alias("text"))).otherwise(F.struct(F.lit("EXTRACTED").alias("extent"), short.alias("text")))


# ---- generation


#: Claims that name one missing thing; beyond that the thing is sent to all executors (there are few such).
HOT = 100_000


def dangling(claims: DataFrame, key: str, known: DataFrame, code: str) -> DataFrame:
    """(claim_id, code) of the claims that name something that isn't there.

    What is named is looked up once for all of its claims, so no task gets all the claims of one thing: a missing thing that
    more than ``HOT`` claims name goes to the claims, the others meet them by a join.
    """
    named = claims.where(F.col(key).isNotNull()).select("claim_id", key)
    lost = saved(named.groupBy(key).agg(F.count(F.lit(1)).alias("n")).join(known.select(key).distinct(), key, "left_anti"), "lost")
    sides = [F.broadcast(lost.where(F.col("n") > HOT).select(key)), lost.where(F.col("n") <= HOT).select(key)]
    return reduce(DataFrame.union, [named.join(side, key, "left_semi").select("claim_id", F.lit(code).alias("code")) for side in sides if not side.isEmpty()] or [named.limit(0).select("claim_id", F.lit(code).alias("code"))])


def violations(*found: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, found).distinct()


def precision_violations(premises: DataFrame) -> DataFrame:
    """Claims whose precision is finer than that of any premise (claim_id, out_rank, premise_rank)."""
    worst = premises.groupBy("claim_id", "out_rank").agg(F.min("premise_rank").alias("least"))
    return worst.where("out_rank > least").select("claim_id", F.lit("TEMPORAL_PRECISION_INCREASED").alias("code"))


def citation_ids(bindings: DataFrame) -> DataFrame:
    """``bindings`` (answer_id, provenance, ...) with citation_id, 1 for the answer's first provenance key and so on."""
    return bindings.withColumn("citation_id", F.dense_rank().over(Window.partitionBy("answer_id").orderBy("provenance")))


def request_fits(parts: DataFrame, limit: int) -> DataFrame:
    """(query_id, total, fits) before any provider is called."""
    return parts.groupBy("query_id").agg(F.sum("tokens").alias("total")).withColumn("fits", F.col("total") <= limit)


def consolidated(found: DataFrame) -> DataFrame:
    """(identity, representative, n, associations) of ``found`` (evidence_id, url, and where it was found: route, run, ...).

    The identity is the canonical url, without one the evidence_id; every association is kept, in order of evidence_id.
    """
    where = [c for c in found.columns if c not in ("evidence_id", "url")]
    identity = F.coalesce(canonical(F.col("url")), F.concat(F.lit("id:"), F.col("evidence_id")))
    return found.groupBy(identity.alias("identity")).agg(
        F.min("evidence_id").alias("representative"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("evidence_id", *where))).alias("associations"),
    )
