"""States, reasons and failures of orchestration, context and generation, as columns over structured signals.

Each function takes the signals as columns and gives one of a fixed vocabulary; the first rule that holds decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The vocabularies.
INTERPRETATIONS = ["RESOLVED", "PARTIALLY_RESOLVED", "AMBIGUOUS_BUT_SEARCHABLE", "AMBIGUOUS_REQUIRES_CLARIFICATION", "UNRESOLVED"]
STOP_REASONS = [
    "REQUIRED_EXECUTION_COMPLETE", "NO_USEFUL_ADAPTATION", "MAX_ATTEMPTS_REACHED", "BUDGET_EXHAUSTED", "DEADLINE_EXHAUSTED", "REQUIRED_TOOL_FAILURE",
    "INVALID_REQUEST", "CLARIFICATION_REQUIRED",
]
SEEKING_REASONS = [
    "NO_RESULTS", "UNRESOLVED_REFERENCE", "TEMPORAL_ANCHOR_RECOVERY", "QUERY_OVERCONSTRAINED", "SUBQUERY_UNCOVERED", "RELEVANT_SOURCE_DEGRADED",
    "CONFLICT_FOLLOWUP",
]
#: Class of a failed tool call -> whether the same call may be repeated.
TOOL_FAILURES = {
    "INVALID_REQUEST": False, "TIMEOUT": True, "RATE_LIMIT": True, "TRANSIENT_PROVIDER_FAILURE": True, "PERMANENT_PROVIDER_FAILURE": False,
    "MALFORMED_TOOL_RESPONSE": False, "AUTH_OR_CONFIGURATION_FAILURE": False, "INTERNAL_RETRIEVAL_FAILURE": False,
}
#: Code of a failed generation -> whether a transport retry may help.
GENERATION_FAILURES = {
    "INVALID_GENERATION_REQUEST": False, "PROMPT_BUDGET_EXCEEDED": False, "PROVIDER_UNAVAILABLE": True, "PROVIDER_TIMEOUT": True, "PROVIDER_RATE_LIMITED": True,
    "PROVIDER_AUTH_FAILURE": False, "PROVIDER_REJECTED_REQUEST": False, "MALFORMED_PROVIDER_RESPONSE": True, "STRUCTURED_OUTPUT_INVALID": False,
    "REFERENTIAL_VALIDATION_FAILED": False, "GROUNDING_VALIDATION_FAILED": False, "REQUIRED_DISCLOSURE_MISSING": False, "CITATION_RESOLUTION_FAILED": False,
    "REPAIR_EXHAUSTED": False, "INTERNAL_GENERATION_ERROR": False,
}
#: What a presentation may ask for, and what it may never override.
PRESENTABLE = ["table", "bullets", "brief", "formal", "chronological"]
INVARIANTS = ["no_citations", "hide_conflicts", "hide_gaps", "pick_a_winner"]


def first_of(*rules: tuple[str, Column], otherwise: str | None = None) -> Column:
    """The name of the first rule that holds; a null condition doesn't."""
    return F.coalesce(*[F.when(c, F.lit(name)) for name, c in rules], F.lit(otherwise))


# ---- orchestration


def interpretation(references: Column, resolved: Column, ambiguous: Column, material: Column) -> Column:
    """Clarification only where the ambiguity changes what is asked for."""
    return first_of(
        ("AMBIGUOUS_REQUIRES_CLARIFICATION", ambiguous & material), ("AMBIGUOUS_BUT_SEARCHABLE", ambiguous), ("UNRESOLVED", (references > 0) & (resolved == 0)),
        ("PARTIALLY_RESOLVED", resolved < references), otherwise="RESOLVED",
    )


def required_sources(policy: Column) -> dict[str, Column]:
    """Which sources a policy makes obligatory."""
    return {"local_required": policy.isin("LOCAL_ONLY", "HYBRID"), "web_required": policy.isin("WEB_ONLY", "HYBRID")}


def current_plans(revisions: DataFrame) -> DataFrame:
    """(query_id, revision, plan, n_revisions, in_order) of the append-only ``revisions`` (query_id, revision, plan).

    The highest revision is the plan; a trace with a gap or a repeated number isn't in order.
    """
    per = revisions.groupBy("query_id").agg(F.max(F.struct("revision", "plan")).alias("last"), F.count(F.lit(1)).alias("n_revisions"), F.countDistinct("revision").alias("d"), F.min("revision").alias("lo"))
    in_order = (F.col("d") == F.col("n_revisions")) & (F.col("lo") == 1) & (F.col("last.revision") == F.col("n_revisions"))
    return per.select("query_id", "last.revision", "last.plan", "n_revisions", in_order.alias("in_order"))


def stop_reason(valid: Column, clarify: Column, left_ms: Column, left_calls: Column, required_failed: Column, adaptable: Column, attempts: Column, most: int) -> Column:
    """Why gathering ends; null while a justified action remains. ``adaptable``: a bounded change of strategy would help."""
    return first_of(
        ("INVALID_REQUEST", ~valid), ("CLARIFICATION_REQUIRED", clarify), ("DEADLINE_EXHAUSTED", left_ms <= 0), ("BUDGET_EXHAUSTED", left_calls <= 0),
        ("REQUIRED_TOOL_FAILURE", required_failed & ~adaptable), ("MAX_ATTEMPTS_REACHED", adaptable & (attempts >= most)), ("NO_USEFUL_ADAPTATION", ~adaptable & (attempts > 0)),
        ("REQUIRED_EXECUTION_COMPLETE", ~adaptable),
    )


def seeking_error(reason: Column, plausible: Column, conflict_signal: Column) -> Column:
    """Why an evidence-seeking attempt isn't justified; null: it is. Operational retries have no such reason."""
    needs_hope = reason.isin("UNRESOLVED_REFERENCE", "RELEVANT_SOURCE_DEGRADED") & ~plausible
    return first_of(
        ("REASON_MISSING", reason.isNull()), ("NOT_A_SEEKING_REASON", ~reason.isin(SEEKING_REASONS)), ("NO_PLAUSIBLE_RECOVERY", needs_hope),
        ("NO_CONFLICT_SIGNAL", (reason == "CONFLICT_FOLLOWUP") & ~conflict_signal),
    )


def classified(failures: DataFrame, classes: dict[str, str], key: str = "code") -> DataFrame:
    """``failures`` with failure_class and retryable by their source's own code; an unknown code is the engine's failure.

    Rows without a code (no results is no failure) have neither.
    """
    names = F.create_map(*[F.lit(x) for pair in classes.items() for x in pair])
    retry = F.create_map(*[F.lit(x) for pair in TOOL_FAILURES.items() for x in pair])
    of = F.when(F.col(key).isNotNull(), F.coalesce(names[F.col(key)], F.lit("INTERNAL_RETRIEVAL_FAILURE")))
    return failures.withColumn("failure_class", of).withColumn("retryable", retry[F.col("failure_class")])


def web_time_violation(constraint: Column, filter_kind: Column) -> Column:
    """A time of events or of content may not become a filter by date of publication."""
    return F.when((filter_kind == "PUBLICATION") & ~F.coalesce(constraint == "PUBLICATION", F.lit(False)), F.lit("TIME_SEMANTICS_CHANGED"))


def conflict_signal_violation(used_for: Column) -> Column:
    """A possible conflict may lead to another retrieval, never to grouping or to a winner."""
    return F.when(used_for != "RETRIEVAL", F.concat(F.lit("SIGNAL_USED_FOR_"), used_for))


# ---- context


def assembly(completion: Column, well_formed: Column, provenance: Column) -> Column:
    return first_of(
        ("FAILED", ~well_formed), ("NOT_APPLICABLE", completion.isin("CLARIFICATION_REQUIRED", "REJECTED")), ("FAILED", ~provenance),
        ("ASSEMBLED", completion.isin("COMPLETED", "COMPLETED_DEGRADED")), otherwise="FAILED",
    )


def conflict_categories(claims: DataFrame, tolerance: float) -> DataFrame:
    """(unit, kind, n_claims, category) of ``claims`` (unit, kind, value, low, high, stance); no side wins.

    By kind: quantities farther apart than the tolerance, intervals of which two are disjoint (the latest begin is after
    the earliest end), facts with both stances, explanations with more than one. No pair of claims is made.
    """
    per = claims.groupBy("unit", "kind").agg(
        F.count(F.lit(1)).alias("n_claims"), (F.max("value") - F.min("value")).alias("spread"), (F.max("low") - F.min("high")).alias("gap"), F.countDistinct("stance").alias("stances")
    )
    category = first_of(
        ("QUANTITATIVE_CONFLICT", (F.col("kind") == "QUANTITY") & (F.col("spread") > tolerance)), ("TEMPORAL_CONFLICT", (F.col("kind") == "TIME") & (F.col("gap") > 0)),
        ("FACTUAL_CONFLICT", (F.col("kind") == "FACT") & (F.col("stances") > 1)), ("INTERPRETATION_DIVERGENCE", (F.col("kind") == "EXPLANATION") & (F.col("stances") > 1)),
        otherwise="NOT_A_CONFLICT",
    )
    return per.select("unit", "kind", "n_claims", category.alias("category"))


#: Signals of a selection in the order in which they decide, with the reason that each gives; the rest is primary.
SELECTION = {
    "policy_violation": "DROPPED_POLICY_VIOLATION", "invalid_provenance": "DROPPED_INVALID_PROVENANCE", "degraded": "DROPPED_DEGRADED_CONTENT",
    "duplicate": "DROPPED_DUPLICATE", "redundant": "DROPPED_REDUNDANT", "low_relevance": "DROPPED_LOW_RELEVANCE", "crowded": "DROPPED_DIVERSITY_PRESSURE",
    "over_budget": "DROPPED_BUDGET", "conflict_side": "SELECTED_CONFLICT_SIDE", "temporal_segment": "SELECTED_TEMPORAL_SEGMENT",
    "independent": "SELECTED_INDEPENDENT_SUPPORT", "covers": "SELECTED_COVERAGE",
}


def selection_reason(**signals: Column) -> Column:
    """The decision by the signals named in SELECTION; those not given don't hold."""
    return first_of(*[(reason, signals[name]) for name, reason in SELECTION.items() if name in signals], otherwise="SELECTED_PRIMARY")


#: Weights of a context's utility, a version of the configuration.
UTILITY = {"rank": 0.3, "coverage": 0.2, "temporal": 0.1, "independent": 0.1, "conflict": 0.1, "complete": 0.1, "degraded": -0.2, "provenance": 0.1}


def utility(weights: dict[str, float] | None = None, **signals: Column) -> Column:
    """Weighted sum of the structured signals (numbers or booleans)."""
    weights = weights or UTILITY
    if set(signals) != set(weights):
        raise ValueError(f"signals wanted: {sorted(weights)}")
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + weight * F.coalesce(signals[name].cast("double"), F.lit(0.0))
    return F.round(total, 9)


# ---- generation


def statuses(assembled: Column, sufficiency: Column, failure: Column, degraded: Column) -> dict[str, Column]:
    """Three dimensions that don't stand in for each other: execution, answer, sufficiency."""
    execution = first_of(("NOT_APPLICABLE", assembled == "NOT_APPLICABLE"), ("FAILED", (assembled == "FAILED") | failure.isNotNull()), ("GENERATED_DEGRADED", degraded), otherwise="GENERATED")
    answer = first_of(("FULL_ANSWER", sufficiency == "SUFFICIENT"), ("PARTIAL_ANSWER", sufficiency == "PARTIALLY_SUFFICIENT"), otherwise="INSUFFICIENT_EVIDENCE")
    return {"generation_status": execution, "response_status": F.when(execution.isin("GENERATED", "GENERATED_DEGRADED"), answer), "evidence_sufficiency": sufficiency}


def generation_failures(failures: DataFrame, key: str = "code") -> DataFrame:
    """``failures`` with a known code and its explicit retryability; an unknown code is an internal error."""
    retry = F.create_map(*[F.lit(x) for pair in GENERATION_FAILURES.items() for x in pair])
    known = F.when(F.col(key).isNotNull(), F.when(F.col(key).isin(list(GENERATION_FAILURES)), F.col(key)).otherwise(F.lit("INTERNAL_GENERATION_ERROR")))
    return failures.withColumn(key, known).withColumn("retryable", retry[F.col(key)])


def attempt_violation(semantic: Column, transport: Column, most_semantic: int = 2, most_transport: int = 3) -> Column:
    """One attempt and one repair; transport retries are counted apart."""
    return first_of(("REPAIR_EXHAUSTED", semantic > most_semantic), ("PROVIDER_UNAVAILABLE", transport > most_transport))


def repaired(claims: DataFrame, bindings: DataFrame, disclosures: DataFrame) -> DataFrame:
    """(answer_id, claim_id, n_bindings, disclosures): what can be mended without another generation.

    ``bindings`` (answer_id, claim_id, item_id) are taken once each; an optional claim (answer_id, claim_id, optional)
    without one goes, an obligatory one stays with 0; the answer's mandatory ``disclosures`` (answer_id, disclosure)
    are put in.
    """
    n = bindings.distinct().groupBy("answer_id", "claim_id").agg(F.count(F.lit(1)).alias("n_bindings"))
    kept = claims.join(n, ["answer_id", "claim_id"], "left").na.fill(0, ["n_bindings"]).where("n_bindings > 0 or not optional")
    told = disclosures.distinct().groupBy("answer_id").agg(F.array_sort(F.collect_list("disclosure")).alias("disclosures"))
    out = kept.join(told, "answer_id", "left")
    return out.select("answer_id", "claim_id", "n_bindings", F.coalesce("disclosures", F.array().cast("array<string>")).alias("disclosures"))


def claim_type_violation(claim_type: Column, negated: Column, n_premises: Column) -> Column:
    """What the evidence doesn't show may not be told as a fact of the world, nor a fact as a state of the evidence."""
    return first_of(
        ("UNKNOWN_CLAIM_TYPE", ~claim_type.isin("WORLD", "EVIDENCE_STATE")), ("ABSENCE_TOLD_AS_FACT", (claim_type == "WORLD") & negated & (n_premises == 0)),
        ("UNSUPPORTED_CLAIM", (claim_type == "WORLD") & (n_premises == 0)),
    )


def presentation(asked: Column) -> Column:
    """struct(accepted, relaxed, rejected) of the constraints asked for; the engine's invariants can't be overridden."""
    return F.struct(
        F.filter(asked, lambda x: x.isin(PRESENTABLE)).alias("accepted"), F.filter(asked, lambda x: ~x.isin(PRESENTABLE) & ~x.isin(INVARIANTS)).alias("relaxed"),
        F.filter(asked, lambda x: x.isin(INVARIANTS)).alias("rejected"),
    )


def reproduced(executions: DataFrame, versions: list[str]) -> DataFrame:
    """(lineage, n_runs, reproduced) of ``executions`` (the version columns, output): equal lineages give equal outputs."""
    lineage = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(v).cast("string"), F.lit("-")) for v in versions]), 256).alias("lineage")
    return executions.select(lineage, "output").groupBy("lineage").agg(F.count(F.lit(1)).alias("n_runs"), (F.countDistinct("output") == 1).alias("reproduced"))
