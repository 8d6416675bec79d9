"""Context assembly: sides of conflicts, priorities of the token budget, extracts with spans, relations between items, budgets of a run.

Everything works by windows and groups over (query_id, unit) or a text's own row; no pairs of claims or items are made.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Kinds of claims and the conflict each can make.
CONFLICTS = {"FACT": "FACTUAL_CONFLICT", "QUANTITY": "QUANTITATIVE_CONFLICT", "TIME": "TEMPORAL_CONFLICT", "EXPLANATION": "INTERPRETATION_DIVERGENCE"}
RELATIONS = ["SAME_IDENTITY", "EXACT_DUPLICATE", "DERIVATIVE", "INDEPENDENT", "UNKNOWN_DEPENDENCE"]
BUDGETS = ["tool_calls", "source_attempts", "retries", "reformulations", "subqueries", "deadline"]


def sides(claims: DataFrame, tolerance: float) -> DataFrame:
    """``claims`` (query_id, unit, kind, claim_id, value, low, high, stance) with ``side``: compatible claims of a unit and kind have one number.

    QUANTITY: in order of value a new side begins where the next one is more than ``tolerance`` away; TIME: where an interval begins
    after all before it have ended; FACT and EXPLANATION: a side for each stance. Claims that lack what their kind compares have no side.
    """
    key = ["query_id", "unit", "kind"]
    at = F.when(F.col("kind") == "QUANTITY", F.col("value").cast("double")).when(F.col("kind") == "TIME", F.when(F.col("low") <= F.col("high"), F.col("low")).cast("double"))
    placed = claims.withColumn("__at", at)
    order = Window.partitionBy(*key).orderBy("__at", "claim_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    gap = F.when(F.col("kind") == "QUANTITY", F.col("__at") - F.lag("__at").over(order) > tolerance).when(F.col("kind") == "TIME", F.col("__at") > F.max("high").over(before))
    ranged = placed.where("__at is not null").withColumn("__new", F.coalesce(gap, F.lit(False)).cast("int")).withColumn("side", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)) + 1)
    told = placed.where("kind in ('FACT', 'EXPLANATION') and stance is not null").withColumn("side", F.dense_rank().over(Window.partitionBy(*key).orderBy("stance")))
    rest = placed.where("__at is null and not coalesce(kind in ('FACT', 'EXPLANATION') and stance is not null, false)").withColumn("side", F.lit(None).cast("int"))
    parts = [ranged.drop("__new"), told, rest]
    return reduce(DataFrame.unionByName, [p.withColumn("side", F.col("side").cast("int")).drop("__at") for p in parts])


def conflict_groups(sided: DataFrame) -> DataFrame:
    """A row for each unit and kind with two sides or more: (query_id, unit, conflict_type, n_sides, competing: side, claims, evidence), no winner.

    ``sided`` as ``sides`` gives it, with evidence_id. Sides are in their order, claims and evidence sorted; all are kept.
    """
    each = sided.where("side is not null").groupBy("query_id", "unit", "kind", "side").agg(F.array_sort(F.collect_set("claim_id")).alias("claims"), F.array_sort(F.collect_set("evidence_id")).alias("evidence"))
    groups = each.groupBy("query_id", "unit", "kind").agg(F.count(F.lit(1)).alias("n_sides"), F.array_sort(F.collect_list(F.struct("side", "claims", "evidence"))).alias("competing"))
    names = F.create_map(*[F.lit(x) for pair in CONFLICTS.items() for x in pair])
    return groups.where("n_sides > 1").select("query_id", "unit", names[F.col("kind")].alias("conflict_type"), "n_sides", "competing")


def priorities(items: DataFrame) -> DataFrame:
    """``items`` (query_id, evidence_id, score, unit, side, family, independent, dated) with ``priority``, 1 before 5.

    1 the best item of a unit, 2 the best of a further side of a conflict, 3 the best of a dependency family whose independence is
    established, 4 a dated item, 5 what else carries provenance.
    """
    best = lambda *key: F.row_number().over(Window.partitionBy("query_id", *key).orderBy(F.desc("score"), "evidence_id")) == 1
    priority = (
        F.when(F.col("unit").isNotNull() & best("unit"), 1).when(F.col("side").isNotNull() & best("unit", "side"), 2)
        .when(F.col("independent") & best("family"), 3).when(F.col("dated"), 4).otherwise(5)
    )
    return items.withColumn("priority", priority)


def extracted(text: Column, limit: int) -> Column:
    """(extent, text, spans): the whole text, or its first ``limit`` words as they stand; spans are offsets in code points, end exclusive."""
    head = F.regexp_extract(text, r"^[ \t\n\r\f\x0b]*(?:[^ \t\n\r\f\x0b]+[ \t\n\r\f\x0b]+){0,%d}[^ \t\n\r\f\x0b]+" % (limit - 1), 0)

    def told(head: Column) -> Column:
        whole = (F.rtrim(text, F.lit(" \t\n\r\f\x0b")) == head) | (head == "")
        kept = F.when(whole, text).otherwise(head)
        span = F.array(F.struct(F.lit(0).alias("start"), F.length(kept).alias("end")))
        return F.struct(F.when(whole, F.lit("FULL")).otherwise(F.lit("EXTRACTED")).alias("extent"), kept.alias("text"), span.alias("spans"))

    # as an element of a list the head is made once, however often it is used
    return F.when(text.isNotNull(), F.transform(F.array(head), told)[0])


def relations(items: DataFrame) -> DataFrame:
    """``items`` (evidence_id, identity, text, basis) with ``family`` and the ``relation`` of each to the earlier ones.

    SAME_IDENTITY: an earlier item has the identity; EXACT_DUPLICATE: one of another identity has the text; DERIVATIVE: one has it but for
    case and what isn't a letter or digit; INDEPENDENT: none has, and the item has a ``basis`` for it; else UNKNOWN_DEPENDENCE. Families are
    those of the normalized text, named by their least evidence_id. A null or wordless text shares nothing with others.
    """
    plain = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " ")
    hashed = items.withColumns({"__t": F.when(F.trim(plain) != "", F.sha2("text", 256)), "__p": F.when(F.trim(plain) != "", F.sha2(F.trim(plain), 256))})
    first = lambda *key: F.min("evidence_id").over(Window.partitionBy(*key))
    own = F.concat(F.lit("id:"), F.col("evidence_id"))
    hashed = hashed.withColumns({"__t": F.coalesce("__t", own), "__p": F.coalesce("__p", own)})
    hashed = hashed.withColumns({"__i": first("identity"), "__ft": first("__t"), "family": first("__p")})
    later = lambda c: F.col(c) < F.col("evidence_id")
    relation = (
        F.when(F.col("identity").isNotNull() & later("__i"), F.lit("SAME_IDENTITY")).when(later("__ft"), F.lit("EXACT_DUPLICATE")).when(later("family"), F.lit("DERIVATIVE"))
        .when(F.col("basis"), F.lit("INDEPENDENT")).otherwise(F.lit("UNKNOWN_DEPENDENCE"))
    )
    return hashed.withColumn("relation", relation).drop("__t", "__p", "__i", "__ft")


def budget_overruns(calls: DataFrame, limits: dict[str, int]) -> DataFrame:
    """``calls`` (query_id, call_id, at, source, kind, retry_of) with ``over``: the budgets of BUDGETS that the call exceeds.

    Calls are counted in order of time: all of the query, those of a source, retries of one call, reformulations, subqueries; the deadline
    counts seconds from the query's first call. A budget without a limit isn't one.
    """
    order = lambda *key: Window.partitionBy("query_id", *key).orderBy("at", "call_id").rowsBetween(Window.unboundedPreceding, 0)
    of_kind = lambda kind: F.when(F.col("kind") == kind, F.count_if(F.col("kind") == kind).over(order()))
    counts = {
        "tool_calls": F.count(F.lit(1)).over(order()), "source_attempts": F.count(F.lit(1)).over(order("source")),
        "retries": F.when(F.col("retry_of").isNotNull(), F.count(F.lit(1)).over(order("retry_of"))), "reformulations": of_kind("REFORMULATION"), "subqueries": of_kind("SUBQUERY"),
        "deadline": F.unix_timestamp("at") - F.unix_timestamp(F.min("at").over(Window.partitionBy("query_id"))),
    }
    over = F.array_compact(F.array(*[F.when(counts[name] > limits[name], F.lit(name)) for name in BUDGETS if name in limits]))
    return calls.withColumn("over", over)
