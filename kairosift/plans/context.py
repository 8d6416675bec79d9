"""Queries of context assembly and of checks over pages and runs, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import blocks, context, evidence, lifecycle
from ..sources import intake, migrations
from . import tables as t
from .queries import ORACLE, query

# ---- conflicts, priorities, extracts, relations

_CLAIMS = (
    "claims AS (SELECT query_id, unit, ['QUANTITY','TIME','FACT','EXPLANATION'][unit % 4 + 1] AS kind, evidence_id AS claim_id, evidence_id, value::DOUBLE AS value, tokens * 3 AS low, tokens * 3 + source % 5 AS high, source % 2 AS stance, score, family FROM evidence), "
    "gaps AS (SELECT *, CASE WHEN kind = 'QUANTITY' THEN value - lag(value) OVER (PARTITION BY query_id, unit, kind ORDER BY value, claim_id) > 0.015 WHEN kind = 'TIME' THEN low > max(high) OVER (PARTITION BY query_id, unit, kind ORDER BY low, claim_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS new FROM claims), "
    "sided AS (SELECT *, CASE WHEN kind = 'QUANTITY' THEN 1 + sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, unit, kind ORDER BY value, claim_id ROWS UNBOUNDED PRECEDING) WHEN kind = 'TIME' THEN 1 + sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, unit, kind ORDER BY low, claim_id ROWS UNBOUNDED PRECEDING) "
    "ELSE dense_rank() OVER (PARTITION BY query_id, unit, kind ORDER BY stance) END AS side FROM gaps)"
)


def _claims(spark, d):
    kind = t.pick(["QUANTITY", "TIME", "FACT", "EXPLANATION"], F.col("unit") % 4)
    e = t.evidence(spark, d).withColumn("low", F.col("tokens") * 3)
    return e.select("query_id", "unit", kind.alias("kind"), F.col("evidence_id").alias("claim_id"), "evidence_id", F.col("value").cast("double").alias("value"), "low", (F.col("low") + F.col("source") % 5).alias("high"), (F.col("source") % 2).alias("stance"), "score", "family", "tokens")


@query("CTX5_conflict_groups")
def _(spark, d):
    """Every unit of every query whose claims fall into several sides, with the claims of each side."""
    found = context.conflict_groups(context.sides(_claims(spark, d), 0.015))
    told = F.array_join(F.transform("competing", lambda s: F.concat(s.side, F.lit(":"), F.array_join(s.claims, "+"))), ";")
    return found.select("query_id", "unit", "conflict_type", "n_sides", told.alias("competing"))


ORACLE["CTX5_conflict_groups"] = t.sql("SELECT 1", "evidence").removesuffix(" SELECT 1") + (
    f", {_CLAIMS}, each AS (SELECT query_id, unit, kind, side, string_agg(claim_id, '+' ORDER BY claim_id) AS claims FROM sided GROUP BY ALL) "
    "SELECT query_id, unit, CASE kind WHEN 'QUANTITY' THEN 'QUANTITATIVE_CONFLICT' WHEN 'TIME' THEN 'TEMPORAL_CONFLICT' WHEN 'FACT' THEN 'FACTUAL_CONFLICT' ELSE 'INTERPRETATION_DIVERGENCE' END AS conflict_type, count(*) AS n_sides, string_agg(CAST(side AS INT) || ':' || claims, ';' ORDER BY side) AS competing "
    "FROM each GROUP BY query_id, unit, kind HAVING count(*) > 1"
)


@query("CTX11_priorities")
def _(spark, d):
    """All evidence in the order of the five priorities under a budget of 2000 tokens a query."""
    sided = context.sides(_claims(spark, d), 0.015).withColumns({"independent": F.col("family") % 3 == 0, "dated": F.col("kind") == "TIME"})
    placed = context.priorities(sided)
    chosen = evidence.select_within(placed, 2000, [F.col("priority"), F.desc("score"), F.col("evidence_id")])
    return chosen.select("query_id", "evidence_id", "priority", "spent", "decision")


ORACLE["CTX11_priorities"] = t.sql("SELECT 1", "evidence").removesuffix(" SELECT 1") + (
    f", {_CLAIMS}, firsts AS (SELECT s.*, tokens, row_number() OVER (PARTITION BY s.query_id, s.unit ORDER BY s.score DESC, s.evidence_id) AS u, row_number() OVER (PARTITION BY s.query_id, s.unit, side ORDER BY s.score DESC, s.evidence_id) AS c, "
    "row_number() OVER (PARTITION BY s.query_id, s.family ORDER BY s.score DESC, s.evidence_id) AS f FROM sided s JOIN (SELECT evidence_id, tokens FROM evidence) e USING (evidence_id)), "
    "placed AS (SELECT *, CASE WHEN u = 1 THEN 1 WHEN c = 1 THEN 2 WHEN family % 3 = 0 AND f = 1 THEN 3 WHEN kind = 'TIME' THEN 4 ELSE 5 END AS priority FROM firsts) "
    "SELECT query_id, evidence_id, priority, spent, CASE WHEN spent <= 2000 THEN 'SELECTED_PRIMARY' ELSE 'DROPPED_BUDGET' END AS decision FROM (SELECT *, CAST(sum(tokens) OVER (PARTITION BY query_id ORDER BY priority, score DESC, evidence_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM placed)"
)


_WS = " \\t\\n\\r\\f\\x0b"


@query("CTX13_spans", f"SELECT doc_id, CASE WHEN whole THEN 'FULL' ELSE 'EXTRACTED' END AS extent, sha256(CASE WHEN whole THEN text ELSE head END) AS text_sha256, '0-' || length(CASE WHEN whole THEN text ELSE head END) AS spans FROM (SELECT *, head = '' OR regexp_replace(text, '[{_WS}]+$', '') = head AS whole FROM (SELECT doc_id, text, regexp_extract(text, '^[{_WS}]*(?:[^{_WS}]+[{_WS}]+){{0,49}}[^{_WS}]+') AS head FROM documents))")
def _(spark, d):
    """Every document, whole or its first 50 words, with the span that is kept."""
    docs = t.read(spark, d, "documents").select("doc_id", context.extracted(F.col("text"), 50).alias("x"))
    spans = F.array_join(F.transform("x.spans", lambda s: F.concat(s.start, F.lit("-"), s.end)), ",")
    return docs.select("doc_id", "x.extent", F.sha2("x.text", 256).alias("text_sha256"), spans.alias("spans"))


_PLAIN = "trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'))"


@query("CTX3_relations")
def _(spark, d):
    """Every document found by two runs, and once more in capitals: what each is to the earlier ones."""
    docs = t.read(spark, d, "documents").select("doc_id", "text", "source", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("run"))
    items = docs.select((F.col("doc_id") + F.col("run") * 10_000_000).alias("evidence_id"), F.when(F.col("run") < 2, F.concat(F.lit("doc:"), F.col("doc_id"))).otherwise(F.concat(F.lit("web:"), F.col("doc_id"))).alias("identity"),
                        F.when(F.col("run") == 2, F.concat("text", F.lit(" !"))).otherwise(F.col("text")).alias("text"), F.col("source").isin("src0", "src1").alias("basis"))
    return context.relations(items).select("evidence_id", "relation", "family")


ORACLE["CTX3_relations"] = (
    "WITH items AS (SELECT doc_id + run * 10000000 AS evidence_id, CASE WHEN run < 2 THEN 'doc:' ELSE 'web:' END || doc_id AS identity, CASE WHEN run = 2 THEN text || ' !' ELSE text END AS text, coalesce(source IN ('src0', 'src1'), false) AS basis FROM documents, (SELECT unnest(range(0, 3)) AS run)), "
    f"plain AS (SELECT *, {_PLAIN} AS p FROM items), keyed AS (SELECT *, CASE WHEN coalesce(p, '') = '' THEN 'id:' || evidence_id ELSE sha256(text) END AS t, CASE WHEN coalesce(p, '') = '' THEN 'id:' || evidence_id ELSE sha256(p) END AS q FROM plain), "
    "firsts AS (SELECT *, min(evidence_id) OVER (PARTITION BY identity) AS i, min(evidence_id) OVER (PARTITION BY t) AS ft, min(evidence_id) OVER (PARTITION BY q) AS family FROM keyed) "
    "SELECT evidence_id, CASE WHEN i < evidence_id THEN 'SAME_IDENTITY' WHEN ft < evidence_id THEN 'EXACT_DUPLICATE' WHEN family < evidence_id THEN 'DERIVATIVE' WHEN basis THEN 'INDEPENDENT' ELSE 'UNKNOWN_DEPENDENCE' END AS relation, family FROM firsts"
)

_LIMITS = {"tool_calls": 20, "source_attempts": 5, "retries": 2, "reformulations": 4, "subqueries": 3, "deadline": 1_000_000}
_COUNTED = (
    "SELECT event_id AS call_id, concat_ws(',', CASE WHEN c > 20 THEN 'tool_calls' END, CASE WHEN s > 5 THEN 'source_attempts' END, CASE WHEN retry_of IS NOT NULL AND r > 2 THEN 'retries' END, CASE WHEN kind = 'REFORMULATION' AND f > 4 THEN 'reformulations' END, CASE WHEN kind = 'SUBQUERY' AND q > 3 THEN 'subqueries' END, CASE WHEN waited > 1000000 THEN 'deadline' END) AS over "
    "FROM (SELECT *, count(*) OVER (w ROWS UNBOUNDED PRECEDING) AS c, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s, count(*) OVER (PARTITION BY user_id, retry_of ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS r, "
    "count(*) FILTER (WHERE kind = 'REFORMULATION') OVER (w ROWS UNBOUNDED PRECEDING) AS f, count(*) FILTER (WHERE kind = 'SUBQUERY') OVER (w ROWS UNBOUNDED PRECEDING) AS q, CAST(floor(epoch(ts)) - floor(epoch(min(ts) OVER (PARTITION BY user_id))) AS BIGINT) AS waited "
    "FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'REFORMULATION' WHEN event_id % 5 = 0 THEN 'SUBQUERY' ELSE 'SEARCH' END AS kind, CASE WHEN value < 40 THEN event_id % 4 END AS retry_of FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"
)


@query("ORC4_six_budgets", _COUNTED)
def _(spark, d):
    """Every event as a call of its user's query: which of the six budgets it exceeds."""
    kind = F.expr("case when event_id % 3 = 0 then 'REFORMULATION' when event_id % 5 = 0 then 'SUBQUERY' else 'SEARCH' end")
    e = t.read(spark, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("call_id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("source"), kind.alias("kind"), F.expr("if(value < 40, event_id % 4, null)").alias("retry_of"))
    return context.budget_overruns(e, _LIMITS).select("call_id", F.array_join("over", ",").alias("over"))


# ---- pages, publication


@query("AGG4_edge_counts", "SELECT doc_id, first, mask, seen, n_pages FROM (SELECT doc_id, line_no = f AS first, mask, count(DISTINCT page) AS seen FROM (SELECT *, regexp_replace(trim(line), '[0-9]+', '#', 'g') AS mask, min(CASE WHEN trim(line) <> '' THEN line_no END) OVER w AS f, max(CASE WHEN trim(line) <> '' THEN line_no END) OVER w AS l FROM (SELECT doc_id, ordinal // 5 AS page, ordinal % 5 AS line_no, line FROM lines) WINDOW w AS (PARTITION BY doc_id, page)) WHERE line_no = f OR line_no = l GROUP BY ALL) JOIN (SELECT doc_id, count(DISTINCT ordinal // 5) AS n_pages FROM lines GROUP BY doc_id) USING (doc_id) WHERE n_pages >= 3 AND 2 * seen > n_pages", "lines")
def _(spark, d):
    """Masked first and last lines of five-line pages that more than half of a document's pages have."""
    p = t.lines(spark, d).select("doc_id", F.expr("cast(floor(ordinal / 5) as int)").alias("page"), F.expr("ordinal % 5").alias("line_no"), "line")
    return intake.edge_counts(p).where("often").select("doc_id", (F.col("side") == "first").alias("first"), "mask", "seen", "n_pages")


@query("SRC9_page_report", "SELECT doc_id, n_pages, n_empty, CASE WHEN doc_id % 11 = 3 THEN 'corrupt_document' WHEN doc_id % 11 = 5 THEN 'encrypted_document' WHEN n_empty = n_pages THEN 'scanned_or_image_only' END AS error, CASE WHEN doc_id % 11 NOT IN (3, 5) AND n_empty > 0 AND n_empty < n_pages THEN 'empty_pages' END AS warning FROM (SELECT doc_id, count(*) AS n_pages, count(*) FILTER (WHERE empty) AS n_empty FROM (SELECT doc_id, ordinal // 4 AS page, bool_and(trim(line) = '' OR (ordinal // 4) % 3 = doc_id % 5) AS empty FROM lines GROUP BY ALL) GROUP BY doc_id)", "lines")
def _(spark, d):
    """Documents in pages of four lines, each third page of some of them failed: their reports, and the classes of files that can't be read."""
    failed = F.expr("floor(ordinal / 4) % 3 = doc_id % 5")
    pages = t.lines(spark, d).select("doc_id", F.expr("cast(floor(ordinal / 4) as int)").alias("page"), F.when(~failed, F.col("line")).otherwise(F.lit("")).alias("line"))
    heads = t.read(spark, d, "documents").select("doc_id", F.expr("encode(case when doc_id % 11 = 3 then '<html>' when doc_id % 11 = 5 then '%PDF-1.7 /Encrypt 5 0 R %%EOF' else '%PDF-1.4 %%EOF' end, 'utf-8')").alias("content"))
    return intake.page_report(pages, heads).select("doc_id", "n_pages", "n_empty", "error", "warning")


@query("ING23_superseded", "SELECT version_id, 'superseded_representation' AS failure FROM versions UNION ALL SELECT version_id, 'broken_mention' FROM versions WHERE version_id % 17 = 0 AND version_id % 2 = 0", "versions")
def _(spark, d):
    """Another generation became the active one; broken mentions count for versions alone whose dates aren't degraded."""
    v = t.versions(spark, d).withColumn("degraded", F.expr("if(version_id % 2 = 1, array('TEMPORAL'), array())").cast("array<string>"))
    c = v.select("version_id", "document_id", "corpus_id", F.concat(F.lit("c"), F.col("version_id")).alias("chunk_id"), F.lit(0).alias("ordinal"), F.lit("some words").alias("source_text"), F.lit(0).alias("span_start"), F.lit(10).alias("span_end"))
    m = v.where("version_id % 17 = 0").select("version_id", F.lit(5).alias("start_offset"), F.lit(5).alias("end_offset"))
    return lifecycle.publication_failures(v, c, c.select("chunk_id", F.lit("srg1").alias("srg")), m, "srg1", "srg2")


# ---- oracles that compare what is made


@query("SRC12_artifacts", "SELECT doc_id, source AS title, len(string_split(text, chr(10))) AS n_blocks, sha256(text) AS text_sha256 FROM documents")
def _(spark, d):
    """Every document as an artifact, written as JSON and read back by its schema."""
    docs = t.read(spark, d, "documents").select("doc_id", intake.read_artifact(intake.artifact(F.col("source"), F.split("text", "\n"))).alias("a"))
    return docs.select("doc_id", "a.title", F.size("a.blocks").cast("long").alias("n_blocks"), F.sha2(F.array_join("a.blocks", "\n"), 256).alias("text_sha256"))


@query("ING8_block_order", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND n > 1 OR doc_id % 3 = 1 AND n > 2 THEN 'block_order' END AS order_error FROM (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id)", "lines")
def _(spark, d):
    """Lines as blocks: of some documents the numbers begin at 1, of some a number is there twice."""
    at = F.expr("if(doc_id % 3 = 0 and n > 1, ordinal + 1, if(doc_id % 3 = 1 and n > 2 and ordinal = 2, 1, ordinal))")
    b = t.lines(spark, d).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc_id"))).withColumn("at", at)
    b = b.select("doc_id", blocks.block_id(F.col("at")).alias("block_id"), F.lit("PARAGRAPH").alias("type"), F.concat("line", F.lit(" and sixteen characters")).alias("text"))
    return blocks.parse_report(b, b).select("doc_id", F.when(F.col("error") == "block_order", F.col("error")).alias("order_error"))


@query("MIG1_revisions", "SELECT doc_id::VARCHAR AS document_id, source AS corpus_id, NULL::VARCHAR AS active_version_id, 'up' AS way FROM documents UNION ALL SELECT doc_id::VARCHAR, source, NULL, 'down and up' FROM documents WHERE doc_id % 2 = 0")
def _(spark, d):
    """The documents of the sixth revision at the newest one; and half of them taken from the newest back to the lifecycle and up again."""
    docs = t.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.col("source").alias("corpus_id"), F.lit("t").alias("title"))
    six = migrations.upgrade(spark, {}, 0, 6) | {"documents": docs}
    up = migrations.upgrade(spark, six, 6)["documents"].withColumn("way", F.lit("up"))
    filled = migrations.upgrade(spark, {}, 0) | {"documents": docs.where("cast(document_id as long) % 2 = 0").withColumn("active_version_id", F.lit("v"))}
    again = migrations.upgrade(spark, migrations.downgrade(filled, 7, 1), 1)["documents"].withColumn("way", F.lit("down and up"))
    return up.unionByName(again).drop("title")
