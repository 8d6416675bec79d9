"""Requests: validation, captured state, profiles, intents and outcomes, as columns."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import temporal

# Names of profiles and reasons.
PROFILES = ["FACT_LOOKUP", "TEMPORAL_POINT", "TEMPORAL_RANGE", "TIMELINE", "BROAD"]
RELATIONS = ["POINT", "RANGE", "BEFORE", "AFTER", "AROUND", "RECURRING"]


@dataclass(frozen=True)
class RetrievalConfig:
    """All constants of a retrieval; its hash names the version of a result."""

    route_limit: int = 40
    fusion_limit: int = 100
    literal_fallback: bool = True
    output_limit: int = 20
    rrf: int = 60
    adjustment_cap: float = 0.25
    free_per_document: int = 3
    timeline_free: int = 6
    diversity_penalty: float = 0.001
    around_days: int = 372

    @property
    def version(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()


def config_version(**changed: Column) -> Column:
    """The version of a configuration some of whose whole-number constants are columns."""
    values = asdict(RetrievalConfig())
    parts, text = [], json.dumps({k: f"<{k}>" if k in changed else v for k, v in values.items()}, sort_keys=True)
    for name in sorted(changed):
        before, _, text = text.partition(f'"<{name}>"')
        parts += [F.lit(before), changed[name].cast("string")]
    return F.sha2(F.concat(*parts, F.lit(text)), 256)


def captured_state(srg: Column, config: RetrievalConfig, scope: list[str], snapshot: str) -> Column:
    """One id of all that a retrieval reads once: the generation pointer, its constants, its scope and its tables."""
    return F.sha2(F.concat_ws("|", srg, F.lit(config.version), F.lit(",".join(sorted(scope))), F.lit(snapshot)), 256)


def pointer_error(captured: Column, current: Column) -> Column:
    """The generation pointer is read again at the end: where it has moved, the retrieval fails."""
    return F.when(~captured.eqNullSafe(current), F.lit("SEARCH_GENERATION_CHANGED"))


def profile(explicit: Column, relation: Column) -> Column:
    """The explicit one, else by the temporal relation that is asked for."""
    derived = F.when(relation.isin("POINT", "RECURRING"), F.lit("TEMPORAL_POINT")).when(relation.isin("RANGE", "BEFORE", "AFTER", "AROUND"), F.lit("TEMPORAL_RANGE"))
    return F.coalesce(explicit, derived, F.lit("FACT_LOOKUP"))


def request_error(profile_: Column, relation: Column, constraint: Column, n_corpora: Column) -> Column:
    """Why a request is refused before any search; null: it isn't."""
    known = profile_.isNull() | profile_.isin(PROFILES)
    fine = known & (relation.isNull() | relation.isin(RELATIONS)) & (constraint.isNull() | (constraint == "SOURCE_TIME"))
    return F.when(~fine, F.lit("INVALID_RETRIEVAL_REQUEST")).when(n_corpora == 0, F.lit("NO_EXECUTABLE_CORPUS_SCOPE"))


def representation_error(model: Column, dims: Column, want_model: str, want_dims: int) -> Column:
    return F.when((model != want_model) | (dims != want_dims), F.lit("EMBEDDING_GENERATION_INCOMPATIBLE"))


def outcome(n_candidates: Column, dense_ok: Column, lexical_ok: Column, all_ok: Column, temporal: Column) -> Column:
    lost = ~dense_ok & ~lexical_ok & ~(temporal & (n_candidates > 0))
    return (
        F.when(lost, F.lit("FAILURE")).when(~all_ok, F.lit("SUCCESS_DEGRADED")).when(n_candidates > 0, F.lit("SUCCESS_WITH_CANDIDATES")).otherwise(F.lit("SUCCESS_NO_CANDIDATES"))
    )


def derive_intents(queries: DataFrame, enabled: bool = False) -> DataFrame:
    """(query_id, relation, q_low, q_high) of the first resolved date that is found in each query's text; off by default."""
    blocks = queries.select(F.col("query_id").alias("doc_id"), F.lit("b0000").alias("block_id"), "text").where(F.lit(enabled))
    found = temporal.with_bounds(temporal.recognize(blocks)).where("bound_low is not null")
    first = found.groupBy(F.col("doc_id").alias("query_id")).agg(F.min_by(F.struct("precision", "bound_low", "bound_high"), "start_offset").alias("m"))
    relation = F.when(F.col("m.precision") == "RANGE", F.lit("RANGE")).otherwise(F.lit("POINT"))
    return first.select("query_id", relation.alias("relation"), F.col("m.bound_low").alias("q_low"), F.col("m.bound_high").alias("q_high"))
