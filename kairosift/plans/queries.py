"""Queries by name, each with the SQL of the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import temporal as tmp
from ..operators import blocks, chunks, decisions, evidence, fusion, intervals, lifecycle, represent, requests, routes
from ..sources import intake
from ..streaming import runs
from . import tables as t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, body: str | None = None, *needs: str):
    def register(f):
        QUERIES[name] = f
        if body:
            ORACLE[name] = t.sql(body, *needs)
        return f

    return register


def items(spark, d):
    return t.lines(spark, d).select(F.expr("concat(doc_id, ':', ordinal)").alias("item"), F.col("line").alias("text"), "doc_id", "source")


# ---- sources


@query("SRC1_media_type", "SELECT page_id, CASE lower(regexp_extract(url, '(\\.[A-Za-z]+)$', 1)) WHEN '.txt' THEN 'text/plain' WHEN '.md' THEN 'text/markdown' WHEN '.markdown' THEN 'text/markdown' WHEN '.pdf' THEN 'application/pdf' END AS media_type FROM (SELECT page_id, url || (['.TXT', '.md', '.pdf', '.html', ''])[page_id % 5 + 1] AS url FROM pages)")
def _(spark, d):
    p = t.read(spark, d, "pages").select("page_id", F.concat("url", t.pick([".TXT", ".md", ".pdf", ".html", ""], F.expr("page_id % 5"))).alias("url"))
    return p.select("page_id", intake.media_type(F.col("url")).alias("media_type"))


@query("SRC2_size_gate", "SELECT doc_id, CASE WHEN octet_length(encode(text)) > 4000 THEN 'too_large' WHEN regexp_matches(text, '^\\s*$') THEN 'empty' END AS reject FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN ' \t' || chr(10) ELSE text END AS text FROM documents)")
def _(spark, d):
    files = t.read(spark, d, "documents").select("doc_id", F.lit("a.txt").alias("path"), F.expr("if(doc_id % 5 = 0, ' \t\n', text)").cast("binary").alias("content"))
    return intake.intake(files, 4000).select("doc_id", "reject")


@query("SRC3_artifact_put", "SELECT substr(h, 1, 2) || '/' || h AS key, octet_length(encode(any_value(text))) AS byte_size FROM (SELECT sha256(text) AS h, text FROM documents) GROUP BY h")
def _(spark, d):
    return intake.put_artifacts(t.read(spark, d, "documents").select(F.col("text").cast("binary").alias("content")))


@query(
    "SRC4_get_delete",
    "SELECT key, CASE WHEN doc_id % 3 = 0 THEN 'malformed_key' WHEN doc_id % 5 = 0 THEN 'unknown_key' END AS error, CASE WHEN doc_id % 3 > 0 AND doc_id % 5 > 0 THEN length(text) END AS n FROM (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN sha256(text || doc_id) ELSE substr(sha256(text || doc_id), 1, 2) || '/' || sha256(text || doc_id) END AS key FROM documents)",
)
def _(spark, d):
    """Texts stored under their keys, those of every fifth document deleted again, and asked for; some keys are malformed."""
    docs = t.read(spark, d, "documents").select("doc_id", F.concat("text", F.col("doc_id").cast("string")).cast("binary").alias("whole"), F.col("text").alias("content"))
    stored = docs.select("doc_id", intake.artifact_key(F.col("whole")).alias("key"), "content")
    left = intake.delete_artifacts(stored, stored.where("doc_id % 5 = 0"))
    key = F.when(F.col("doc_id") % 3 == 0, F.sha2("whole", 256)).otherwise(intake.artifact_key(F.col("whole")))
    return intake.get_artifacts(left, docs.select(key.alias("key"))).select("key", "error", F.length("content").alias("n"))


@query("SRC5_decode", "SELECT doc_id, length(replace(replace(text, chr(10), chr(13) || chr(10)), chr(13) || chr(10), chr(10))) AS n FROM documents")
def _(spark, d):
    docs = t.read(spark, d, "documents").select("doc_id", F.regexp_replace("text", "\n", "\r\n").cast("binary").alias("c"))
    return docs.select("doc_id", F.length(intake.decode(F.col("c"))).alias("n"))


_PAGES = "paged AS (SELECT doc_id, ordinal // 3 AS page, ordinal % 3 AS line_no, CASE ordinal % 3 WHEN 0 THEN 'Report page ' || (ordinal // 3) ELSE line END AS line FROM lines)"


@query(
    "SRC10_running_lines",
    "SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE edge AND often) AS n_removed FROM (SELECT m.*, o.mask IS NOT NULL AS often FROM marked m LEFT JOIN often o ON o.doc_id = m.doc_id AND o.mask = m.mask) GROUP BY doc_id",
    "lines",
)
def _(spark, d):
    p = t.lines(spark, d).select("doc_id", F.expr("cast(floor(ordinal / 3) as int)").alias("page"), F.expr("ordinal % 3").alias("line_no"), F.expr("if(ordinal % 3 = 0, concat('Report page ', cast(floor(ordinal / 3) as int)), line)").alias("line"))
    return intake.running_lines(p).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if("removed").alias("n_removed"))


ORACLE["SRC10_running_lines"] = ORACLE["SRC10_running_lines"].replace(
    " SELECT doc_id, count(*) AS n_lines",
    f", {_PAGES}, lim AS (SELECT *, min(CASE WHEN trim(line) <> '' THEN line_no END) OVER w AS f, max(CASE WHEN trim(line) <> '' THEN line_no END) OVER w AS l FROM paged WINDOW w AS (PARTITION BY doc_id, page)), "
    "marked AS (SELECT *, coalesce(line_no = f OR line_no = l, false) AS edge, regexp_replace(trim(line), '[0-9]+', '#', 'g') AS mask FROM lim), "
    "often AS (SELECT DISTINCT doc_id, mask FROM (SELECT doc_id, line_no = f AS first, mask, count(DISTINCT page) AS seen FROM marked WHERE edge GROUP BY ALL) JOIN (SELECT doc_id, count(DISTINCT page) AS n FROM paged GROUP BY doc_id) USING (doc_id) WHERE n >= 3 AND 2 * seen > n) SELECT doc_id, count(*) AS n_lines",
    1,
)


@query("SRC14_web_text", None)
def _(spark, d):
    return t.read(spark, d, "pages").select("page_id", intake.web_text(F.col("html")).alias("text"))


@query("SNK1_status_report", "SELECT document_id, version_id, status FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY status IN ('PENDING', 'RUNNING') DESC, version_id = active_version_id DESC, version_no DESC) AS r FROM versions) WHERE r = 1", "versions")
@query("FLT3_reported_version", "SELECT document_id, version_id, status FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY status IN ('PENDING', 'RUNNING') DESC, version_id = active_version_id DESC, version_no DESC) AS r FROM versions) WHERE r = 1", "versions")
def _(spark, d):
    return lifecycle.reported_version(t.versions(spark, d)).select("document_id", "version_id", "status")


@query("FLT1_corpora", "SELECT source AS corpus_id, count(*) AS n_documents FROM documents GROUP BY source")
def _(spark, d):
    return t.documents(spark, d).groupBy("corpus_id").agg(F.count(F.lit(1)).alias("n_documents")).orderBy("corpus_id")


@query("FLT2_exact_duplicates", "SELECT u.doc_id, v.existing FROM (SELECT doc_id, source AS corpus_id, sha256(text || CASE WHEN doc_id % 2 = 0 THEN '1' ELSE 'x' END) AS source_hash FROM documents) u LEFT JOIN (SELECT corpus_id, source_hash, min(document_id) AS existing FROM versions GROUP BY ALL) v USING (corpus_id, source_hash)", "versions")
def _(spark, d):
    up = t.read(spark, d, "documents").select("doc_id", F.col("source").alias("corpus_id"), F.expr("sha2(concat(text, if(doc_id % 2 = 0, '1', 'x')), 256)").alias("source_hash"))
    return lifecycle.existing_versions(up, t.versions(spark, d)).select("doc_id", "existing")


@query("FLT4_latest_run", "SELECT version_id, max(attempt) AS attempt FROM runs GROUP BY version_id", "runs")
def _(spark, d):
    return lifecycle.latest_run(t.runs(spark, d).groupBy("version_id", "attempt").agg(F.max("run_id").alias("run_id"))).select("version_id", "attempt")


@query("FLT5_in_flight_guard", "SELECT document_id, bool_or(status IN ('PENDING', 'RUNNING')) AS busy FROM versions GROUP BY document_id", "versions")
def _(spark, d):
    return t.versions(spark, d).groupBy("document_id").agg(F.bool_or(F.col("status").isin(lifecycle.IN_FLIGHT)).alias("busy"))


@query("FLT6_reusable_artifact", "SELECT version_id, max(run_id) AS run_id FROM runs WHERE event_type = 'view' GROUP BY version_id", "runs")
def _(spark, d):
    key = F.when(F.col("event_type") == "view", F.col("run_id"))
    return t.runs(spark, d).withColumn("key", key).where("key is not null").groupBy("version_id").agg(F.max_by("run_id", "run_id").alias("run_id"))


@query("FLT7_membership", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS has_orders FROM customer")
def _(spark, d):
    c, o = t.read(spark, d, "customer").select("c_custkey"), t.read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").withColumn("has_orders", F.lit(True)).union(c.join(o, "c_custkey", "left_anti").withColumn("has_orders", F.lit(False)))


_JOBS = "jobs AS (SELECT event_id AS job_id, CASE event_type WHEN 'click' THEN 'CLAIMED' WHEN 'view' THEN 'PENDING' WHEN 'signup' THEN 'PENDING' WHEN 'error' THEN 'FAILED' ELSE 'DONE' END AS state, ts AS retry_after, ts + INTERVAL 2 DAY AS heartbeat_at FROM events)"


def _jobs(spark, d):
    state = F.expr("case event_type when 'click' then 'CLAIMED' when 'view' then 'PENDING' when 'signup' then 'PENDING' when 'error' then 'FAILED' else 'DONE' end")
    return t.read(spark, d, "events").select(F.col("event_id").alias("job_id"), state.alias("state"), F.col("ts").alias("retry_after"), F.expr("ts + interval 2 days").alias("heartbeat_at"))


_DUE = "((state = 'PENDING' AND retry_after <= TIMESTAMP '2024-01-15') OR (state = 'CLAIMED' AND heartbeat_at < TIMESTAMP '2024-01-15' - INTERVAL 300 SECOND))"


@query("FLT8_claimable", f"WITH {_JOBS} SELECT job_id, state FROM jobs WHERE {_DUE}")
def _(spark, d):
    return _jobs(spark, d).where(runs.claimable(F.expr("timestamp '2024-01-15'"))).select("job_id", "state")


@query("STR2_claim", f"WITH {_JOBS} SELECT job_id, row_number() OVER (ORDER BY retry_after, job_id) AS worker FROM (SELECT * FROM jobs WHERE {_DUE} ORDER BY retry_after, job_id LIMIT 5)")
@query("TOP1_oldest_due", f"WITH {_JOBS} SELECT job_id, row_number() OVER (ORDER BY retry_after, job_id) AS worker FROM (SELECT * FROM jobs WHERE {_DUE} ORDER BY retry_after, job_id LIMIT 5)")
def _(spark, d):
    return runs.claim(_jobs(spark, d), F.expr("timestamp '2024-01-15'"), 5)


@query("FLT9_source_time_only", "SELECT mention_id FROM mentions WHERE origin = 'SOURCE_METADATA' AND start_year IS NOT NULL", "mentions")
def _(spark, d):
    return t.mentions(spark, d).where("origin = 'SOURCE_METADATA' and start_year is not null").select("mention_id")


# ---- joins


@query("JOIN1_containment", "SELECT m.doc_id, m.ordinal, m.s, c.piece FROM m JOIN c ON c.doc_id = m.doc_id AND c.ordinal = m.ordinal AND c.a <= m.s AND m.e <= c.b", "lines")
def _(spark, d):
    lines = t.lines(spark, d).select("doc_id", "ordinal", F.length("line").alias("n")).where("n > 0")
    m = lines.select("doc_id", "ordinal", "n", F.expr("cast((doc_id * 7 + ordinal * 13) % greatest(n - 9, 1) as int)").alias("s")).withColumn("e", F.least(F.col("s") + 10, F.col("n"))).drop("n")
    c = lines.select("doc_id", "ordinal", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(40))).alias("a"))
    c = c.select("doc_id", "ordinal", "a", F.least(F.col("a") + 60, F.col("n")).alias("b"), F.expr("cast(a / 40 as int)").alias("piece"))
    return intervals.contained(c, m, ["doc_id", "ordinal"], ("a", "b"), ("s", "e")).select("doc_id", "ordinal", "s", "piece")


ORACLE["JOIN1_containment"] = ORACLE["JOIN1_containment"].replace(
    " SELECT m.doc_id",
    ", l AS (SELECT doc_id, ordinal, length(line) AS n FROM lines WHERE length(line) > 0), m AS (SELECT doc_id, ordinal, (doc_id * 7 + ordinal * 13) % greatest(n - 9, 1) AS s, least((doc_id * 7 + ordinal * 13) % greatest(n - 9, 1) + 10, n) AS e FROM l), "
    "c AS (SELECT doc_id, ordinal, a, least(a + 60, n) AS b, a // 40 AS piece FROM (SELECT *, unnest(range(0, n, 40)) AS a FROM l)) SELECT m.doc_id",
    1,
)


@query("JOIN2_missing_vectors", "SELECT chunk_id FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM reps WHERE srg = 'srg1')", "reps")
def _(spark, d):
    return lifecycle.missing_vectors(t.chunks(spark, d), t.representations(spark, d), "srg1").select("chunk_id")


@query(
    "JOIN3_reconcile",
    "SELECT coalesce(a.version_id, b.version_id) AS version_id, coalesce(a.ordinal, b.ordinal) AS ordinal, CASE WHEN a.h IS NULL THEN 'INSERT' WHEN b.h IS NULL THEN 'DELETE' WHEN a.h = b.h THEN 'KEEP' ELSE 'UPDATE' END AS action "
    "FROM (SELECT version_id, ordinal, content_hash AS h FROM chunks WHERE ordinal % 6 <> 1) a FULL JOIN (SELECT version_id, ordinal, CASE WHEN ordinal % 4 = 0 THEN sha256(source_text || '!') ELSE content_hash END AS h FROM chunks WHERE ordinal % 5 <> 3) b ON a.version_id = b.version_id AND a.ordinal = b.ordinal",
    "chunks",
)
def _(spark, d):
    c = t.chunks(spark, d)
    new = c.where("ordinal % 5 <> 3").withColumn("content_hash", F.expr("if(ordinal % 4 = 0, sha2(concat(source_text, '!'), 256), content_hash)"))
    return chunks.reconcile(c.where("ordinal % 6 <> 1"), new)


@query("JOIN4_reference_sweep", "SELECT DISTINCT source_hash AS key FROM versions WHERE source_hash NOT IN (SELECT source_hash FROM versions WHERE version_no = 0 UNION SELECT source_hash FROM versions WHERE status = 'READY')", "versions")
@query("SET2_difference", "SELECT DISTINCT source_hash AS key FROM versions WHERE source_hash NOT IN (SELECT source_hash FROM versions WHERE version_no = 0 UNION SELECT source_hash FROM versions WHERE status = 'READY')", "versions")
def _(spark, d):
    v = t.versions(spark, d).withColumnRenamed("source_hash", "key")
    return intake.unreferenced(v.select("key").distinct(), v.where("version_no = 0"), v.where("status = 'READY'"))


_SCOPE = ["src0", "src1", "src2", "src3"]
_ELIGIBLE = (
    "SELECT c.chunk_id, c.document_id FROM chunks c JOIN docs d ON d.document_id = c.document_id AND d.corpus_id = c.corpus_id AND d.active_version_id = c.version_id "
    "JOIN versions v ON v.version_id = c.version_id AND v.published_pg = c.pg AND v.status IN ('READY', 'READY_DEGRADED') WHERE c.corpus_id IN ('src0', 'src1', 'src2', 'src3') AND c.chunk_id IN (SELECT chunk_id FROM reps WHERE srg = 'srg1')"
)


def _lifecycle(spark, d):
    return t.chunks(spark, d), t.documents(spark, d), t.versions(spark, d), t.representations(spark, d), _SCOPE, "srg1"


@query("JOIN5_eligibility", _ELIGIBLE, "reps", "docs", "versions")
@query("ING35_searchable_chunk", _ELIGIBLE, "reps", "docs", "versions")
@query("RET2_scope", _ELIGIBLE, "reps", "docs", "versions")
def _(spark, d):
    return lifecycle.eligible_chunks(*_lifecycle(spark, d)).select("chunk_id", "document_id")


@query(
    "JOIN6_revalidation",
    "SELECT c.chunk_id, CASE WHEN c.corpus_id NOT IN ('src0', 'src1', 'src2', 'src3') THEN 'OUT_OF_SCOPE' WHEN d.active_version_id <> c.version_id THEN 'VERSION_REPLACED' WHEN v.status NOT IN ('READY', 'READY_DEGRADED') THEN 'NOT_SERVED' "
    "WHEN v.published_pg <> c.pg THEN 'GENERATION_REPLACED' WHEN c.chunk_id NOT IN (SELECT chunk_id FROM reps WHERE srg = 'srg1') THEN 'REPRESENTATION_MISSING' END AS reason FROM chunks c JOIN docs d USING (document_id) JOIN versions v USING (version_id)",
    "reps", "docs", "versions",
)
def _(spark, d):
    c, *rest = _lifecycle(spark, d)
    return lifecycle.rejection_reason(c, *rest)


@query("JOIN9_coverage", "SELECT u.unit, count(DISTINCT e.family) AS n_items, CASE WHEN count(DISTINCT e.family) >= 100 THEN 'SUPPORTED' WHEN count(DISTINCT e.family) > 0 THEN 'PARTIALLY_SUPPORTED' ELSE 'UNSUPPORTED' END AS support FROM (SELECT unnest(range(0, 25)) AS unit) u LEFT JOIN (SELECT * FROM evidence WHERE flag = 'R' AND unit <> 3) e USING (unit) GROUP BY u.unit", "evidence")
@query("CTX6_coverage_units", "SELECT u.unit, count(DISTINCT e.family) AS n_items, CASE WHEN count(DISTINCT e.family) >= 100 THEN 'SUPPORTED' WHEN count(DISTINCT e.family) > 0 THEN 'PARTIALLY_SUPPORTED' ELSE 'UNSUPPORTED' END AS support FROM (SELECT unnest(range(0, 25)) AS unit) u LEFT JOIN (SELECT * FROM evidence WHERE flag = 'R' AND unit <> 3) e USING (unit) GROUP BY u.unit", "evidence")
def _(spark, d):
    return evidence.coverage(spark.range(25).withColumnRenamed("id", "unit"), t.evidence(spark, d).where("flag = 'R' and unit <> 3"), 100)


@query("JOIN8_consolidation", "SELECT item, count(*) AS n_terms, string_agg(term, ',' ORDER BY term) AS terms FROM posts WHERE term IN ('the', 'and', 'of', 'die', 'la') GROUP BY item", "posts")
def _(spark, d):
    hits = routes.postings(items(spark, d)).where(F.col("term").isin("the", "and", "of", "die", "la"))
    return hits.groupBy("item").agg(F.count(F.lit(1)).alias("n_terms"), F.array_join(F.array_sort(F.collect_set("term")), ",").alias("terms"))


@query("JOIN10_dependency_families", "SELECT sha256(text) AS family, min(doc_id) AS representative, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    docs = t.read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("family"))
    return docs.groupBy("family").agg(F.min("doc_id").alias("representative"), F.count(F.lit(1)).alias("n")).where("n > 1")


def _claims(spark, d):
    e = t.evidence(spark, d)
    return e.select(F.col("evidence_id").alias("claim_id"), F.expr("if(evidence_id % 7 = 0, -1, evidence_id)").alias("item_id"), F.expr("if(unit = 5, 99, unit)").alias("unit"))


@query("JOIN12_referential", "SELECT claim_id, code FROM (SELECT evidence_id AS claim_id, 'UNKNOWN_CONTEXT_ITEM' AS code FROM evidence WHERE evidence_id % 7 = 0 UNION SELECT evidence_id, 'UNKNOWN_COVERAGE_UNIT' FROM evidence WHERE unit = 5)", "evidence")
@query("GEN3_referential", "SELECT claim_id, code FROM (SELECT evidence_id AS claim_id, 'UNKNOWN_CONTEXT_ITEM' AS code FROM evidence WHERE evidence_id % 7 = 0 UNION SELECT evidence_id, 'UNKNOWN_COVERAGE_UNIT' FROM evidence WHERE unit = 5)", "evidence")
@query("GEN7_violations", "SELECT claim_id, code FROM (SELECT evidence_id AS claim_id, 'UNKNOWN_CONTEXT_ITEM' AS code FROM evidence WHERE evidence_id % 7 = 0 UNION SELECT evidence_id, 'UNKNOWN_COVERAGE_UNIT' FROM evidence WHERE unit = 5)", "evidence")
def _(spark, d):
    claims, e = _claims(spark, d), t.evidence(spark, d)
    known = e.select(F.col("evidence_id").alias("item_id"))
    return evidence.violations(evidence.dangling(claims, "item_id", known, "UNKNOWN_CONTEXT_ITEM"), evidence.dangling(claims, "unit", e.select("unit").where("unit <> 99"), "UNKNOWN_COVERAGE_UNIT"))


@query("JOIN13_citations", "SELECT query_id AS answer_id, source AS provenance, dense_rank() OVER (PARTITION BY query_id ORDER BY source) AS citation_id, count(*) AS n FROM evidence GROUP BY query_id, source", "evidence")
@query("GEN10_citation_ids", "SELECT query_id AS answer_id, source AS provenance, dense_rank() OVER (PARTITION BY query_id ORDER BY source) AS citation_id, count(*) AS n FROM evidence GROUP BY query_id, source", "evidence")
def _(spark, d):
    bound = t.evidence(spark, d).groupBy(F.col("query_id").alias("answer_id"), F.col("source").alias("provenance")).agg(F.count(F.lit(1)).alias("n"))
    return evidence.citation_ids(bound)


# ---- blocks and chunks


def _texts(spark, d):
    """Documents whose lines become paragraphs, each third line without the stop at its end, a heading if it is short."""
    lines = t.lines(spark, d).select("doc_id", "ordinal", F.expr("if(ordinal % 3 = 0, regexp_replace(line, '[.!?,;:]+$', ''), line)").alias("line"))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "line"))), lambda x: x.line), "\n\n").alias("text"))


_BLOCKS = (
    ", raw AS (SELECT doc_id, ordinal, regexp_replace(CASE WHEN ordinal % 3 = 0 THEN regexp_replace(line, '[.!?,;:]+$', '') ELSE line END, '^\\s+|\\s+$', '', 'g') AS tx FROM lines), "
    "bl AS (SELECT doc_id, ordinal, tx, length(tx) <= 80 AND NOT regexp_matches(tx, '[.!?,;:]$') AS heading, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) - 1 AS i FROM raw WHERE tx <> ''), "
    "blocks AS (SELECT doc_id, 'b' || lpad(CAST(i AS VARCHAR), CAST(greatest(4, length(CAST(i AS VARCHAR))) AS INTEGER), '0') AS block_id, CASE WHEN heading THEN 'HEADING' ELSE 'PARAGRAPH' END AS type, tx AS text, i, CASE WHEN NOT heading THEN last_value(CASE WHEN heading THEN tx END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS section FROM bl) "
)


def _with(name: str, extra: str):
    head, _, tail = ORACLE[name].partition(") SELECT ")
    ORACLE[name] = head + ")" + extra + "SELECT " + tail


for _name, _body in (
    ("ING1_paragraphs", "doc_id, block_id, type, text, section FROM blocks"),
    ("WIN5_carry_forward", "doc_id, block_id, type, text, section FROM blocks"),
    ("ING2_headings", "doc_id, count(*) FILTER (WHERE type = 'HEADING') AS n_headings, count(*) AS n_blocks FROM blocks GROUP BY doc_id"),
    ("ING8_parse_report", "d.doc_id, count(b.i) AS n_blocks, CAST(coalesce(sum(length(b.text)), 0) AS BIGINT) AS n_chars, 0.0::DOUBLE AS unknown_ratio, CASE WHEN coalesce(sum(length(b.text)), 0) < 16 THEN 'empty_extraction' END AS error, NULL::VARCHAR AS warning FROM documents d LEFT JOIN blocks b USING (doc_id) GROUP BY d.doc_id"),
    ("AGG1_text_length", "doc_id, CAST(sum(length(text)) AS BIGINT) AS n FROM blocks GROUP BY doc_id"),
    ("ING13_contextualize", "doc_id, block_id, doc_id || ' > ' || coalesce(section, '-') || chr(10) || chr(10) || text AS contextualized, sha256(text) AS content_hash FROM blocks"),
):
    ORACLE[_name] = t.sql("SELECT 1", "lines").removesuffix(" SELECT 1") + _BLOCKS + "SELECT " + _body


def _named(name):
    def register(f):
        QUERIES[name] = f
        return f

    return register


@_named("ING1_paragraphs")
@_named("WIN5_carry_forward")
def _(spark, d):
    return blocks.text_blocks(_texts(spark, d))


@_named("ING2_headings")
def _(spark, d):
    return blocks.text_blocks(_texts(spark, d)).groupBy("doc_id").agg(F.count_if(F.col("type") == "HEADING").alias("n_headings"), F.count(F.lit(1)).alias("n_blocks"))


@_named("ING8_parse_report")
def _(spark, d):
    docs = _texts(spark, d)
    return blocks.parse_report(blocks.text_blocks(docs), docs)


@_named("AGG1_text_length")
def _(spark, d):
    return blocks.text_blocks(_texts(spark, d)).groupBy("doc_id").agg(F.sum(F.length("text")).alias("n"))


@_named("ING13_contextualize")
def _(spark, d):
    b = blocks.text_blocks(_texts(spark, d))
    context = chunks.contextualize(F.col("doc_id").cast("string"), F.array(F.coalesce("section", F.lit("-"))), F.col("text"))
    return b.select("doc_id", "block_id", context.alias("contextualized"), F.sha2("text", 256).alias("content_hash"))


def _markdown(spark, d):
    """Documents as Markdown: every fifth line a heading of some depth, then items, rows, fences and prose."""
    line = F.expr(
        "case ordinal % 5 when 0 then concat(repeat('#', cast(doc_id % 3 + ordinal % 2 + 1 as int)), ' ', line) when 1 then concat('- ', line) "
        "when 2 then concat('| ', line, ' | b |') when 3 then concat('```\n', line, '\n```') else concat(line, '\n') end"
    )
    lines = t.lines(spark, d).select("doc_id", "ordinal", line.alias("line"))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "line"))), lambda x: x.line), "\n").alias("text"))


@query("ING3_markdown_blocks")
@query("SRC7_markdown")
def _(spark, d):
    return blocks.markdown_blocks(_markdown(spark, d)).withColumn("section_path", F.array_join("section_path", " > "))


@query("ING10_chunks")
def _(spark, d):
    b = blocks.markdown_blocks(_markdown(spark, d)).withColumn("title", F.concat(F.lit("doc "), F.col("doc_id")))
    out = chunks.chunk_blocks(b, target=60, most=90, overlap=10)
    return out.select("doc_id", "ordinal", F.array_join("section_path", " > ").alias("section"), "token_count", "content_hash", F.size("source_spans").alias("n_spans"))


@query("ING11_split_windows", "SELECT doc_id, list_aggregate(list_filter(range(0, greatest(n, 1), 736), lambda s: s = 0 OR s + 64 < n), 'count') AS n_pieces FROM (SELECT doc_id, len(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS n FROM documents)")
def _(spark, d):
    return t.read(spark, d, "documents").select("doc_id", F.size(chunks.split_windows(F.size(routes.terms(F.col("text"))))).cast("long").alias("n_pieces"))


@query("ING12_chunk_groups", "SELECT doc_id, ordinal // 4 AS ordinal, string_agg(line, chr(10) || chr(10) ORDER BY ordinal) AS source_text, CAST(sum(length(line)) AS BIGINT) AS token_count FROM lines GROUP BY doc_id, ordinal // 4", "lines")
@query("AGG5_ordered_concat", "SELECT doc_id, ordinal // 4 AS ordinal, string_agg(line, chr(10) || chr(10) ORDER BY ordinal) AS source_text, CAST(sum(length(line)) AS BIGINT) AS token_count FROM lines GROUP BY doc_id, ordinal // 4", "lines")
def _(spark, d):
    p = t.lines(spark, d).select("doc_id", F.lit("t").alias("title"), F.expr("cast(floor(ordinal / 4) as long)").alias("ordinal"), F.array(F.lit("s")).alias("section"), F.col("ordinal").alias("at"), F.lit("b").alias("block_id"), F.lit(0).alias("start"), F.length("line").alias("end"), F.col("line").alias("text"), F.length("line").alias("tokens"))
    return chunks.group_pieces(p).select("doc_id", "ordinal", "source_text", F.col("token_count").cast("long").alias("token_count"))


@query("ING16_recognize")
def _(spark, d):
    text = F.concat(F.lit("Signed in "), F.date_format("o_orderdate", "MMMM yyyy"), F.lit(", c. "), F.expr("o_orderkey % 900 + 1"), F.lit(" BCE, from 27 BCE until 14 CE and the 1940s, two years later."))
    b = t.read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("b0000").alias("block_id"), text.alias("text"))
    return tmp.recognize(b)


@query("ING20_fake_embedding")
def _(spark, d):
    v = represent.fake_embedding(t.read(spark, d, "part").select(F.col("p_partkey").alias("item"), F.col("p_name").alias("text")), 64)
    return v.select("item", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm"))


@query("ING22_postings", "SELECT item, term, tf, first FROM posts", "posts")
def _(spark, d):
    return routes.postings(items(spark, d)).select("item", "term", "tf", F.col("first").cast("long").alias("first"))


_FAIL = (
    "SELECT version_id, 'ordinal_gap' AS failure FROM ok GROUP BY version_id HAVING min(ordinal) <> 0 OR max(ordinal) <> count(*) - 1 UNION SELECT version_id, 'no_chunks' FROM versions WHERE version_id NOT IN (SELECT version_id FROM ok) "
    "UNION SELECT version_id, 'missing_vector' FROM ok WHERE chunk_id NOT IN (SELECT chunk_id FROM reps WHERE srg = 'srg1') UNION SELECT version_id, 'empty_lexical' FROM ok WHERE source_text IS NULL OR len(list_filter(string_split_regex(lower(source_text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '' AND NOT list_contains(['" + "','".join(routes.STOP_WORDS) + "'], x))) = 0 UNION SELECT version_id, 'wrong_lineage' FROM ok WHERE version_id % 23 = 0 UNION SELECT version_id, 'broken_mention' FROM versions WHERE version_id % 17 = 0"
)


def _failures(spark, d):
    c = t.chunks(spark, d).where("not (version_id % 5 = 0 and ordinal = 1) and version_id % 19 <> 0 and (version_id % 2 = 0 or (ordinal % 11 <> 10 and ordinal % 5 <> 4))")
    c = c.withColumn("corpus_id", F.expr("if(version_id % 23 = 0, 'moved', corpus_id)"))
    m = t.versions(spark, d).where("version_id % 17 = 0").select("version_id", F.lit(5).alias("start_offset"), F.lit(5).alias("end_offset"))
    return lifecycle.publication_failures(t.versions(spark, d), c, t.representations(spark, d), m, "srg1", "srg1")


for _name, _tail in (("ING23_publication_checks", f"SELECT version_id, failure FROM ({_FAIL})"), ("AGG11_rejects_by_reason", f"SELECT failure, count(*) AS n FROM ({_FAIL}) GROUP BY failure"), ("ING24_cutover", f"SELECT d.document_id, coalesce(n.v, d.active_version_id) AS active_version_id FROM docs d LEFT JOIN (SELECT document_id, max(version_id) AS v FROM versions WHERE version_id NOT IN (SELECT version_id FROM ({_FAIL})) GROUP BY document_id) n USING (document_id)")):
    ORACLE[_name] = t.sql("SELECT 1", "reps", "versions", "docs").removesuffix(" SELECT 1") + ", ok AS (SELECT * FROM chunks WHERE NOT (version_id % 5 = 0 AND ordinal = 1) AND version_id % 19 <> 0 AND (version_id % 2 = 0 OR (ordinal % 11 <> 10 AND ordinal % 5 <> 4))) " + _tail


@_named("ING23_publication_checks")
def _(spark, d):
    return _failures(spark, d)


@_named("AGG11_rejects_by_reason")
def _(spark, d):
    return _failures(spark, d).groupBy("failure").agg(F.count(F.lit(1)).alias("n"))


@_named("ING24_cutover")
def _(spark, d):
    return lifecycle.cut_over(t.documents(spark, d), t.versions(spark, d), _failures(spark, d)).select("document_id", "active_version_id")


@query("ING27_update_outcome", "SELECT u.document_id, u.corpus_id, u.source_hash, CASE WHEN o.owner = u.document_id THEN 'EXISTING' WHEN o.owner IS NOT NULL THEN 'CONFLICT' WHEN b.document_id IS NOT NULL THEN 'IN_FLIGHT' ELSE 'NEW_VERSION' END AS outcome FROM (SELECT doc_id AS document_id, source AS corpus_id, sha256(CASE WHEN doc_id % 2 = 0 THEN text || 0 ELSE text || 'new' END) AS source_hash FROM documents) u LEFT JOIN (SELECT corpus_id, source_hash, min(document_id) AS owner FROM versions GROUP BY ALL) o USING (corpus_id, source_hash) LEFT JOIN (SELECT DISTINCT document_id FROM versions WHERE status IN ('PENDING', 'RUNNING')) b ON b.document_id = u.document_id", "versions")
def _(spark, d):
    up = t.read(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("corpus_id"), F.expr("sha2(if(doc_id % 2 = 0, concat(text, 0), concat(text, 'new')), 256)").alias("source_hash"))
    return lifecycle.update_outcome(up, t.versions(spark, d))


# ---- invariants

_UNIQUE = {
    "D1_unique_corpus": ("corpus_id", "docs", lambda s, d: t.documents(s, d)),
    "D2_unique_bytes": ("corpus_id, source_hash", "versions", lambda s, d: t.versions(s, d)),
    "D7_unique_ordinal": ("version_id, pg, ordinal", "chunks", lambda s, d: t.chunks(s, d).withColumn("ordinal", F.expr("ordinal - ordinal % 3"))),
    "D8_one_vector": ("chunk_id", "reps", lambda s, d: t.representations(s, d)),
    "D11_one_attempt": ("version_id, attempt", "runs", lambda s, d: t.runs(s, d)),
}
for _name, (_keys, _table, _df) in _UNIQUE.items():
    _from = "(SELECT * REPLACE (ordinal - ordinal % 3 AS ordinal) FROM chunks)" if _name.startswith("D7") else _table
    ORACLE[_name] = t.sql(f"SELECT {_keys}, count(*) AS n FROM {_from} GROUP BY {_keys} HAVING count(*) > 1", _table)
    QUERIES[_name] = lambda s, d, f=_df, k=tuple(_keys.split(", ")): lifecycle.repeated(f(s, d), *k)


@query("D3_one_in_flight", "SELECT document_id, count(*) AS n FROM versions WHERE status IN ('PENDING', 'RUNNING') GROUP BY document_id HAVING count(*) > 1", "versions")
def _(spark, d):
    return lifecycle.repeated(t.versions(spark, d).where(F.col("status").isin(lifecycle.IN_FLIGHT)), "document_id")


@query("D5_owner_matches", "SELECT v.version_id FROM versions v WHERE NOT EXISTS (SELECT 1 FROM docs x WHERE x.document_id = v.document_id AND x.corpus_id = CASE WHEN v.version_id % 13 = 0 THEN 'moved' ELSE v.corpus_id END)", "versions", "docs")
def _(spark, d):
    v = t.versions(spark, d).withColumn("corpus_id", F.expr("if(version_id % 13 = 0, 'moved', corpus_id)"))
    return lifecycle.orphans(v, t.documents(spark, d), "document_id", "corpus_id").select("version_id")


@query("D6_chunk_lineage", "SELECT chunk_id FROM chunks WHERE version_id NOT IN (SELECT version_id FROM versions WHERE status <> 'FAILED')", "chunks", "versions")
def _(spark, d):
    return lifecycle.orphans(t.chunks(spark, d), t.versions(spark, d).where("status <> 'FAILED'"), "version_id", "document_id", "corpus_id").select("chunk_id")


@query("D12_vector_width", "SELECT vec_id FROM embeddings WHERE len(embedding) <> 64")
def _(spark, d):
    return t.read(spark, d, "embeddings").where(F.size("embedding") != 64).select("vec_id")


# ---- dates

_COMPONENTS = "SELECT mention_id, precision, bound_low, bound_high FROM bounded"


@query("TMP11_bounds", _COMPONENTS, "bounded")
def _(spark, d):
    return t.bounded(spark, d).select("mention_id", "precision", F.col("bound_low").cast("long").alias("bound_low"), F.col("bound_high").cast("long").alias("bound_high"))


@query("TMP10_order_key", "SELECT o_orderkey, y * 372 + (month(o_orderdate) - 1) * 31 + day(o_orderdate) - 1 AS key FROM (SELECT *, year(o_orderdate) - CASE WHEN o_orderkey % 2 = 0 THEN 4000 ELSE 0 END AS y FROM orders)")
def _(spark, d):
    o = t.read(spark, d, "orders").withColumn("y", F.expr("year(o_orderdate) - if(o_orderkey % 2 = 0, 4000, 0)"))
    return o.select("o_orderkey", tmp.order_key(F.col("y"), F.month("o_orderdate"), F.dayofmonth("o_orderdate")).cast("long").alias("key"))


_LOW, _HIGH = routes.asked_bounds(-3, 3), routes.asked_bounds(-1, 6)
for _name, _kind, _where in (
    ("TMP12_overlap", "OVERLAP", f"bound_low <= {_HIGH[1]} AND bound_high >= {_LOW[0]}"),
    ("TMP13_before", "BEFORE", f"bound_high < {_LOW[0]}"),
    ("TMP14_after", "AFTER", f"bound_low > {_HIGH[1]}"),
    ("TMP15_around", "AROUND", f"bound_low <= {_HIGH[1] + 372} AND bound_high >= {_LOW[0] - 372}"),
):
    ORACLE[_name] = t.sql(f"SELECT mention_id FROM bounded WHERE {_where} AND bound_low <= bound_high", "bounded")
    QUERIES[_name] = lambda s, d, k=_kind: t.bounded(s, d).where(tmp.relation(k, F.col("bound_low"), F.col("bound_high"), F.lit(_LOW[0]), F.lit(_HIGH[1]), 372)).select("mention_id")


@query("TMP16_recurring", "SELECT mention_id FROM mentions WHERE start_month = 3 AND start_day = 15", "mentions")
def _(spark, d):
    return t.mentions(spark, d).where(tmp.recurs(F.col("start_month"), F.col("start_day"), 3, 15)).select("mention_id")


@query("TMP17_unresolved", "SELECT mention_id FROM bounded WHERE bound_low IS NULL", "bounded")
def _(spark, d):
    return t.bounded(spark, d).where("bound_low is null").select("mention_id")


_BEST = (
    "SELECT item, mention_id, n_matches, CAST(r AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (ORDER BY dist, item) AS r FROM (SELECT item, count(*) AS n_matches, min(dist) AS dist, arg_min(mention_id, (dist, mention_id)) AS mention_id FROM "
    f"(SELECT *, abs(bound_low + bound_high - {_LOW[0] + _HIGH[1]}) / 2.0 AS dist FROM bounded WHERE bound_low <= {_HIGH[1]} AND bound_high >= {_LOW[0]} AND bound_low <= bound_high) GROUP BY item)) WHERE r <= 50"
)


@query("TMP18_strongest", _BEST, "bounded")
@query("RET11_temporal_route", _BEST, "bounded")
@query("WIN7_strongest_mention", _BEST, "bounded")
def _(spark, d):
    intents = spark.range(1).select(F.lit(1).alias("query_id"), F.lit(_LOW[0]).alias("q_low"), F.lit(_HIGH[1]).alias("q_high"))
    return routes.temporal(intents, t.bounded(spark, d), 50).select("item", "mention_id", "n_matches", F.col("rank").cast("long").alias("rank"))


@query("TMP20_years_apart", "SELECT mention_id, abs(start_year - 3) - CASE WHEN start_year < 0 THEN 1 ELSE 0 END AS years FROM mentions", "mentions")
def _(spark, d):
    return t.mentions(spark, d).select("mention_id", tmp.years_apart(F.col("start_year"), F.lit(3)).alias("years"))


@query("TMP3_decades", "SELECT DISTINCT start_year, start_year + 9 AS decade_end FROM mentions WHERE precision = 'DECADE'", "mentions")
def _(spark, d):
    return t.mentions(spark, d).where("precision = 'DECADE'").select("start_year", tmp.decade_end(F.col("start_year")).alias("decade_end")).distinct()


@query("TMP4_centuries", "SELECT n, bce, CASE WHEN bce THEN -n * 100 ELSE n * 100 - 99 END AS first_year, CASE WHEN bce THEN 99 - n * 100 ELSE n * 100 END AS last_year FROM (SELECT DISTINCT o_orderkey % 21 + 1 AS n, o_custkey % 2 = 0 AS bce FROM orders)")
def _(spark, d):
    c = t.read(spark, d, "orders").select(F.expr("o_orderkey % 21 + 1").alias("n"), F.expr("o_custkey % 2 = 0").alias("bce")).distinct()
    a, b = tmp.century_bounds(F.col("n"), F.col("bce"))
    return c.select("n", "bce", a.alias("first_year"), b.alias("last_year"))


@query("TMP21_source_time", "SELECT item, mention_id FROM mentions WHERE item IN (SELECT item FROM mentions WHERE origin = 'SOURCE_METADATA' AND start_year = -2) AND origin = 'CONTENT_MENTION'", "mentions")
def _(spark, d):
    m = t.mentions(spark, d)
    return m.where("origin = 'CONTENT_MENTION'").join(m.where("origin = 'SOURCE_METADATA' and start_year = -2").select("item"), "item", "left_semi").select("item", "mention_id")


@query("TMP24_chronology", "SELECT item, mention_id, row_number() OVER (PARTITION BY item ORDER BY bound_low NULLS LAST, bound_high NULLS LAST, mention_id) AS place FROM bounded", "bounded")
def _(spark, d):
    w = Window.partitionBy("item").orderBy(F.asc_nulls_last("bound_low"), F.asc_nulls_last("bound_high"), "mention_id")
    return t.bounded(spark, d).select("item", "mention_id", F.row_number().over(w).alias("place"))


_RANKS = "CASE precision WHEN 'DAY' THEN 6 WHEN 'MONTH' THEN 5 WHEN 'SEASON' THEN 4 WHEN 'YEAR' THEN 3 WHEN 'DECADE' THEN 2 WHEN 'CENTURY' THEN 1 WHEN 'RANGE' THEN 0 ELSE -1 END"


@query("TMP25_precision_monotone", f"SELECT item AS claim_id, 'TEMPORAL_PRECISION_INCREASED' AS code FROM mentions GROUP BY item HAVING min({_RANKS}) < 3", "mentions")
@query("GEN6_precision", f"SELECT item AS claim_id, 'TEMPORAL_PRECISION_INCREASED' AS code FROM mentions GROUP BY item HAVING min({_RANKS}) < 3", "mentions")
def _(spark, d):
    p = t.mentions(spark, d).select(F.col("item").alias("claim_id"), F.lit(3).alias("out_rank"), tmp.precision_rank(F.col("precision")).alias("premise_rank"))
    return evidence.precision_violations(p)


# ---- routes and fusion


_DENSE = (
    "SELECT query_id, item, score, CAST(r AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS r FROM (SELECT q.vec_id AS query_id, v.vec_id AS item, "
    "round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]))), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id)) WHERE r <= 20"
)


@query("RET5_dense", _DENSE)
@query("RET12_route_limit", _DENSE)
@query("WIN3_route_rank", _DENSE)
def _(spark, d):
    v = t.read(spark, d, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").alias("v"))
    asked = v.where("item % 50 = 0").select(F.col("item").alias("query_id"), F.col("v").alias("qv"))
    return routes.dense(asked, v, 20, digits=6, own=False).withColumn("rank", F.col("rank").cast("long"))


def _questions(spark, d):
    return t.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


_ASKED = (
    ", asked AS (SELECT * FROM (SELECT DISTINCT item_id AS query_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM benchmark) WHERE term NOT IN ('" + "','".join(routes.STOP_WORDS) + "')), wanted AS (SELECT query_id, count(*) AS n FROM asked GROUP BY query_id), "
    "hits AS (SELECT query_id, item, round(sum(1 + ln(tf)), 9) AS score, count(*) AS hits FROM posts JOIN asked USING (term) GROUP BY ALL) "
)
_TOP = "SELECT query_id, item, score, CAST(r AS BIGINT) AS rank FROM (SELECT query_id, item, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS r FROM hits {}) WHERE r <= 10"
_POSTS = t.sql("SELECT 1", "posts").removesuffix(" SELECT 1")
ORACLE["RET7_lexical"] = _POSTS + _ASKED + _TOP.format("JOIN wanted USING (query_id) WHERE hits = n")
ORACLE["RET7_lexical_any"] = _POSTS + _ASKED + _TOP.format("")
ORACLE["RET22_multi_corpus"] = _POSTS + _ASKED.replace("FROM posts JOIN asked", "FROM (SELECT * FROM posts WHERE CAST(split_part(item, ':', 1) AS BIGINT) IN (SELECT doc_id FROM documents WHERE source IN ('src0', 'src1', 'src2', 'src3'))) JOIN asked") + _TOP.format("")


@_named("RET7_lexical")
def _(spark, d):
    return routes.lexical(_questions(spark, d), items(spark, d), 10).withColumn("rank", F.col("rank").cast("long"))


@_named("RET7_lexical_any")
def _(spark, d):
    return routes.lexical(_questions(spark, d), items(spark, d), 10, all_terms=False).withColumn("rank", F.col("rank").cast("long"))


@_named("RET22_multi_corpus")
def _(spark, d):
    """One ranked set over the corpora of the scope, without quotas."""
    mine = items(spark, d).where(F.col("source").isin(_SCOPE))
    return routes.lexical(_questions(spark, d), mine, 10, all_terms=False).withColumn("rank", F.col("rank").cast("long"))


@query("RET10_fallback", "SELECT p_partkey, regexp_matches(q, '(^|[^a-zA-Z0-9])([a-zA-Z]+[0-9][a-zA-Z0-9]*|[0-9]+[a-zA-Z][a-zA-Z0-9]*)([^a-zA-Z0-9]|$)') OR contains(q, '\"') OR p_size % 10 = 0 OR regexp_matches(q, '[A-Za-z0-9][._/-][A-Za-z0-9]') OR regexp_matches(q, '(^|[^a-zA-Z0-9])[A-Z]{2,}([^a-zA-Z0-9]|$)') AS fallback FROM (SELECT *, p_name || CASE p_partkey % 4 WHEN 0 THEN ' AB12' WHEN 1 THEN ' \"x y\"' ELSE '' END AS q FROM part)")
def _(spark, d):
    p = t.read(spark, d, "part").select("p_partkey", F.expr("concat(p_name, case p_partkey % 4 when 0 then ' AB12' when 1 then ' \"x y\"' else '' end)").alias("q"), F.expr("if(p_size % 10 = 0, 0, 1)").alias("n"))
    return p.select("p_partkey", routes.needs_fallback(F.col("q"), F.col("n")).alias("fallback"))


@query("RET3_profile", "SELECT event_id, CASE event_type WHEN 'view' THEN 'TEMPORAL_POINT' WHEN 'click' THEN 'TEMPORAL_RANGE' WHEN 'signup' THEN 'TIMELINE' ELSE 'FACT_LOOKUP' END AS profile FROM events")
def _(spark, d):
    explicit = F.when(F.col("event_type") == "signup", F.lit("TIMELINE"))
    kind = F.when(F.col("event_type") == "view", F.lit("POINT")).when(F.col("event_type") == "click", F.lit("BEFORE"))
    return t.read(spark, d, "events").select("event_id", requests.profile(explicit, kind).alias("profile"))


def _routes(spark, d):
    """Two routes over evidence: by score, and by tokens."""
    e = t.evidence(spark, d).select("query_id", F.col("evidence_id").alias("item"), "score", "tokens", "source")
    a = routes.top(e.select("query_id", "item", "score"), 40, "item")
    b = routes.top(e.select("query_id", "item", F.col("tokens").cast("double").alias("score")), 40, "item")
    return e, a, b


_FUSED = (
    ", ra AS (SELECT query_id, evidence_id AS item, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, evidence_id) AS r FROM evidence), rb AS (SELECT query_id, evidence_id AS item, row_number() OVER (PARTITION BY query_id ORDER BY tokens DESC, evidence_id) AS r FROM evidence), "
    "u AS (SELECT 'dense' AS route, * FROM ra WHERE r <= 40 UNION ALL SELECT 'lexical', * FROM rb WHERE r <= 40), f AS (SELECT query_id, item, round(sum(1.0::DOUBLE / (60 + r)), 12) AS score, count(*) AS n_routes, string_agg(route, ',' ORDER BY route) AS routes FROM u GROUP BY ALL), "
    "fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS rank FROM f), wide AS (SELECT fused.*, source, tokens FROM fused JOIN evidence ON evidence_id = item) "
)
_EV = t.sql("SELECT 1", "evidence").removesuffix(" SELECT 1")
ORACLE["RET13_rrf"] = ORACLE["AGG9_rrf_sum"] = ORACLE["SET4_route_union"] = ORACLE["TOP7_total_order"] = _EV + _FUSED + "SELECT query_id, item, score, n_routes, routes, rank FROM fused"
ORACLE["RET14_adjustment"] = ORACLE["AGG10_cap"] = _EV + _FUSED + (
    ", adj AS (SELECT query_id, item, score + 0.0 AS s0, round(greatest(0.0, least(tokens / 1000.0::DOUBLE, 0.25::DOUBLE * max(score) OVER (PARTITION BY query_id))), 12) AS adjustment FROM wide) "
    "SELECT query_id, item, adjustment, round(s0 + adjustment, 12) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s0 + adjustment, 12) DESC, item) AS rank FROM adj"
)
ORACLE["RET16_diversity"] = ORACLE["WIN4_diversity"] = ORACLE["CTX10_soft_diversity"] = _EV + _FUSED + (
    ", dv AS (SELECT query_id, item, source, round(score - 0.001::DOUBLE * greatest(0, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, item) - 3), 12) AS score FROM wide) "
    "SELECT query_id, item, source, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS rank FROM dv"
)


def _fused(spark, d):
    e, a, b = _routes(spark, d)
    return e, fusion.fuse(fusion.ranked_union(dense=a, lexical=b))


@_named("RET13_rrf")
@_named("AGG9_rrf_sum")
@_named("SET4_route_union")
@_named("TOP7_total_order")
def _(spark, d):
    return _fused(spark, d)[1]


@_named("RET14_adjustment")
@_named("AGG10_cap")
def _(spark, d):
    e, f = _fused(spark, d)
    wide = f.join(e.select("item", "tokens"), "item")
    return fusion.adjust(wide, F.col("tokens") / 1000.0).select("query_id", "item", "adjustment", "score", "rank")


@_named("RET16_diversity")
@_named("WIN4_diversity")
@_named("CTX10_soft_diversity")
def _(spark, d):
    e, f = _fused(spark, d)
    return fusion.diversify(f.join(e.select("item", "source"), "item"), "source").select("query_id", "item", "source", "score", "rank")


@query("RET15_origin_preference", "SELECT mention_id, CASE WHEN (origin = 'SOURCE_METADATA') = (mention_id % 2 = 0) THEN 1.0 ELSE 0.5 END::DOUBLE AS weight FROM mentions", "mentions")
def _(spark, d):
    return t.mentions(spark, d).select("mention_id", fusion.origin_weight(F.col("origin"), F.col("mention_id") % 2 == 0).alias("weight"))


_OUTCOME = (
    "SELECT user_id, CASE WHEN v = 0 AND c = 0 AND NOT (p > 0) THEN 'FAILURE' WHEN v = 0 OR c = 0 THEN 'SUCCESS_DEGRADED' WHEN p > 0 THEN 'SUCCESS_WITH_CANDIDATES' ELSE 'SUCCESS_NO_CANDIDATES' END AS outcome "
    "FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS v, count(*) FILTER (WHERE event_type = 'click') AS c, count(*) FILTER (WHERE event_type = 'purchase') AS p FROM events GROUP BY {})"
)


def _events_outcome(spark, d):
    """A view stands for a dense route that worked, a click for a lexical one, a purchase for a candidate."""
    is_ = lambda kind: F.count_if(F.col("event_type") == kind)
    e = t.read(spark, d, "events").groupBy("user_id").agg(is_("view").alias("v"), is_("click").alias("c"), is_("purchase").alias("p"))
    dense, lexical = F.col("v") > 0, F.col("c") > 0
    return e.select("user_id", requests.outcome(F.col("p"), dense, lexical, dense & lexical, F.lit(True)).alias("outcome"))


@query("RET25_outcomes", _OUTCOME.format("user_id"))
def _(spark, d):
    return _events_outcome(spark, d)


@query("RET19_route_failure", "SELECT user_id, hour, outcome FROM (" + _OUTCOME.format("user_id, date_trunc('hour', ts)").replace("SELECT user_id, CASE", "SELECT user_id, hour, CASE").replace("(SELECT user_id, count", "(SELECT user_id, date_trunc('hour', ts) AS hour, count") + ")")
def _(spark, d):
    is_ = lambda kind: F.count_if(F.col("event_type") == kind)
    e = t.read(spark, d, "events").groupBy("user_id", F.date_trunc("hour", "ts").alias("hour")).agg(is_("view").alias("v"), is_("click").alias("c"), is_("purchase").alias("p"))
    dense, lexical = F.col("v") > 0, F.col("c") > 0
    return e.select("user_id", "hour", requests.outcome(F.col("p"), dense, lexical, dense & lexical, F.lit(True)).alias("outcome"))


ORACLE["EVAL_metrics"] = _EV + _FUSED + (
    ", judged AS (SELECT query_id, evidence_id AS item FROM evidence WHERE flag = 'R' AND value < 0.03), tp AS (SELECT f.*, CASE WHEN j.item IS NULL THEN 0 ELSE 1 END AS rel FROM fused f LEFT JOIN judged j ON j.query_id = f.query_id AND j.item = f.item WHERE rank <= 10), "
    "per AS (SELECT query_id, sum(rel) AS found, coalesce(max(CASE WHEN rel = 1 THEN 1.0::DOUBLE / rank END), 0) AS mrr, sum(rel / log2(rank + 1)) AS dcg FROM tp GROUP BY query_id), wt AS (SELECT query_id, count(*) AS wanted FROM judged GROUP BY query_id) "
    "SELECT wt.query_id, round(coalesce(found, 0) / wanted, 9) AS recall, round(coalesce(found, 0) / 10.0::DOUBLE, 9) AS precision, round(coalesce(mrr, 0), 9) AS mrr, "
    "round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(wanted, 10) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))), 9) AS ndcg, coalesce(found, 0) > 0 AS hit FROM wt LEFT JOIN per USING (query_id)"
)


@_named("EVAL_metrics")
def _(spark, d):
    judged = t.evidence(spark, d).where("flag = 'R' and value < 0.03").select("query_id", F.col("evidence_id").alias("item"))
    return fusion.ranking_metrics(_fused(spark, d)[1], judged, 10)


# ---- aggregations, windows, sets


@query("AGG6_filtered_counts", "SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE trim(line) = '') AS n_empty FROM lines GROUP BY doc_id", "lines")
def _(spark, d):
    return t.lines(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.trim("line") == "").alias("n_empty"))


@query(
    "AGG2_unknown_ratio",
    "SELECT doc_id, count(*) AS n_blocks, CAST(sum(length(line)) AS BIGINT) AS n_chars, round(count(*) FILTER (WHERE ordinal % 5 > doc_id % 4) / count(*)::DOUBLE, 9) AS unknown_ratio, CASE WHEN sum(length(line)) < 16 THEN 'empty_extraction' END AS error, "
    "CASE WHEN 2 * count(*) FILTER (WHERE ordinal % 5 > doc_id % 4) > count(*) THEN 'mostly_unknown' END AS warning FROM lines GROUP BY doc_id",
    "lines",
)
def _(spark, d):
    b = t.lines(spark, d).select("doc_id", F.expr("if(ordinal % 5 > doc_id % 4, 'UNKNOWN_TEXT', 'PARAGRAPH')").alias("type"), F.col("line").alias("text"))
    return blocks.parse_report(b, t.read(spark, d, "documents")).withColumn("unknown_ratio", F.round("unknown_ratio", 9))


@query(
    "AGG3_empty_pages",
    "SELECT doc_id, count(*) AS n_pages, count(*) FILTER (WHERE empty) AS n_empty, CASE WHEN bool_and(empty) THEN 'scanned_or_image_only' END AS error, CASE WHEN bool_or(empty) AND NOT bool_and(empty) THEN 'empty_pages' END AS warning FROM "
    "(SELECT doc_id, ordinal // 2 AS page, bool_and(regexp_matches(line, '^\\s*$')) AS empty FROM (SELECT doc_id, ordinal, CASE WHEN (doc_id + ordinal // 2) % 3 = 0 OR doc_id % 10 = 0 THEN ' ' ELSE line END AS line FROM lines) GROUP BY ALL) GROUP BY doc_id",
    "lines",
)
def _(spark, d):
    page = F.expr("cast(floor(ordinal / 2) as int)")
    text = F.when(((F.col("doc_id") + page) % 3 == 0) | (F.col("doc_id") % 10 == 0), F.lit(" ")).otherwise(F.col("line"))
    return intake.page_report(t.lines(spark, d).select("doc_id", page.alias("page"), text.alias("line")))


@query("AGG7_ordinals_complete", "SELECT version_id, min(ordinal) = 0 AND max(ordinal) = count(*) - 1 AND count(DISTINCT ordinal) = count(*) AS complete FROM chunks WHERE NOT (version_id % 5 = 0 AND ordinal = 1) GROUP BY version_id", "chunks")
def _(spark, d):
    c = t.chunks(spark, d).where("not (version_id % 5 = 0 and ordinal = 1)").groupBy("version_id")
    return c.agg(((F.min("ordinal") == 0) & (F.max("ordinal") == F.count(F.lit(1)) - 1) & (F.countDistinct("ordinal") == F.count(F.lit(1)))).alias("complete"))


@query("AGG12_independent_support", "SELECT unit, count(*) AS n_evidence, count(DISTINCT family) AS n_families FROM evidence GROUP BY unit", "evidence")
def _(spark, d):
    return evidence.independent_support(t.evidence(spark, d))


_SUFF = "SELECT query_id, CASE WHEN bool_and(n >= 2) THEN 'SUFFICIENT' WHEN bool_or(n > 0) THEN 'PARTIALLY_SUFFICIENT' ELSE 'INSUFFICIENT' END AS sufficiency FROM (SELECT query_id, unit, count(DISTINCT CASE WHEN flag = 'R' THEN family END) AS n FROM evidence GROUP BY ALL) GROUP BY query_id"


@query("AGG13_sufficiency", _SUFF, "evidence")
@query("CTX8_sufficiency", _SUFF, "evidence")
def _(spark, d):
    e = t.evidence(spark, d).groupBy("query_id", "unit").agg(F.countDistinct(F.when(F.col("flag") == "R", F.col("family"))).alias("n"))
    support = F.when(F.col("n") >= 2, F.lit("SUPPORTED")).when(F.col("n") > 0, F.lit("PARTIALLY_SUPPORTED")).otherwise(F.lit("UNSUPPORTED"))
    return evidence.sufficiency(e.select("query_id", support.alias("support")))


@query("AGG14_budget_sums", "SELECT query_id, CAST(sum(tokens) AS BIGINT) AS total, sum(tokens) <= 8000 AS fits FROM evidence GROUP BY query_id", "evidence")
@query("GEN1_request_budget", "SELECT query_id, CAST(sum(tokens) AS BIGINT) AS total, sum(tokens) <= 8000 AS fits FROM evidence GROUP BY query_id", "evidence")
def _(spark, d):
    return evidence.request_fits(t.evidence(spark, d), 8000)


@query("AGG15_retention", "SELECT query_id, round(1 - count(DISTINCT family) / count(*)::DOUBLE, 9) AS duplicate_share FROM evidence GROUP BY query_id", "evidence")
def _(spark, d):
    return t.evidence(spark, d).groupBy("query_id").agg(F.round(1 - F.countDistinct("family") / F.count(F.lit(1)), 9).alias("duplicate_share"))


@query("SET1_union_keys", "SELECT source_hash AS key FROM versions WHERE version_no = 0 UNION SELECT source_hash FROM versions WHERE status = 'READY'", "versions")
def _(spark, d):
    v = t.versions(spark, d)
    return v.where("version_no = 0").select(F.col("source_hash").alias("key")).union(v.where("status = 'READY'").select("source_hash")).distinct()


@query("SET3_stale_ordinals", "SELECT version_id, ordinal FROM chunks WHERE ordinal >= 4", "chunks")
def _(spark, d):
    c = t.chunks(spark, d).select("version_id", "ordinal")
    return c.join(c.where("ordinal < 4"), ["version_id", "ordinal"], "left_anti")


_WITHIN = (
    "SELECT query_id, evidence_id, CAST(spent AS BIGINT) AS spent, CASE WHEN spent <= 2000 THEN 'SELECTED_PRIMARY' ELSE 'DROPPED_BUDGET' END AS decision FROM "
    "(SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY score DESC, evidence_id ROWS UNBOUNDED PRECEDING) AS spent FROM evidence)"
)


@query("WIN8_token_budget", _WITHIN, "evidence")
@query("CTX11_token_budget", _WITHIN, "evidence")
def _(spark, d):
    return evidence.select_within(t.evidence(spark, d), 2000, [F.desc("score"), F.col("evidence_id")]).select("query_id", "evidence_id", "spent", "decision")


# ---- queue


@query("STR4_next_attempt", "SELECT version_id, arg_max(attempt + CASE WHEN finished THEN 1 ELSE 0 END, attempt) AS attempt FROM (SELECT version_id, attempt, bool_or(finished) AS finished FROM runs GROUP BY ALL) GROUP BY version_id", "runs")
def _(spark, d):
    r = t.runs(spark, d).groupBy("version_id", "attempt").agg(F.bool_or("finished").alias("finished"))
    return runs.next_attempt(r)


@query("STR5_resume", "SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 4 ELSE 0 END AS resume FROM events")
def _(spark, d):
    stage = F.expr("case event_type when 'click' then 'chunk' when 'view' then 'publish' when 'error' then 'lost' else 'parse' end")
    return t.read(spark, d, "events").select("event_id", runs.resume_index(stage).alias("resume"))


@query("STR6_retry", "SELECT run_id, CASE WHEN event_type <> 'error' AND attempt < 3 THEN 'PENDING' ELSE 'FAILED' END AS state, attempt * 30 AS backoff FROM runs", "runs")
def _(spark, d):
    r = t.runs(spark, d)
    return r.select("run_id", runs.after_failure(F.col("attempt"), F.col("event_type") != "error").alias("state"), runs.backoff_seconds(F.col("attempt")).alias("backoff"))


@query("STR7_unclassified", "SELECT run_id, CASE WHEN event_type IN ('error', 'view') THEN event_type ELSE 'unexpected' END AS reason, CASE WHEN event_type = 'error' AND attempt < 3 THEN 'PENDING' ELSE 'FAILED' END AS state FROM runs", "runs")
def _(spark, d):
    found = runs.failure(F.col("event_type"), {"error": True, "view": False})
    return t.runs(spark, d).select("run_id", found["reason"].alias("reason"), runs.after_failure(F.col("attempt"), found["retryable"]).alias("state"))


@query("STR8_settle", "SELECT version_id, CASE WHEN count(DISTINCT event_type) < 5 THEN 'RUNNING' WHEN bool_or(value > 99) THEN 'READY_DEGRADED' ELSE 'READY' END AS status FROM runs GROUP BY version_id", "runs")
def _(spark, d):
    r = t.runs(spark, d).groupBy("version_id").agg(F.countDistinct("event_type").alias("n"), F.bool_or(F.col("value") > 99).alias("degraded"))
    return r.select("version_id", runs.settled(F.col("n"), F.col("degraded")).alias("status"))


@query("STR3_stale", f"WITH {_JOBS} SELECT job_id FROM jobs WHERE state = 'CLAIMED' AND heartbeat_at < TIMESTAMP '2024-01-20' - INTERVAL 300 SECOND")
def _(spark, d):
    return _jobs(spark, d).where("state = 'CLAIMED'").where(runs.claimable(F.expr("timestamp '2024-01-20'"))).select("job_id")


@query("STR10_throughput", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS failures FROM events GROUP BY ALL")
def _(spark, d):
    return runs.throughput(t.read(spark, d, "events"))


# ---- orchestration, context, generation


@query("ORC1_source_policy", "SELECT event_id, CASE WHEN user_id % 3 > 0 AND value > 50 THEN 'HYBRID' WHEN user_id % 3 > 0 THEN 'LOCAL_ONLY' WHEN value > 50 THEN 'WEB_ONLY' ELSE 'REJECT' END AS policy FROM events")
def _(spark, d):
    return t.read(spark, d, "events").select("event_id", evidence.source_policy(F.col("user_id") % 3 > 0, F.col("value") > 50).alias("policy"))


@query("ORC2_evidence_policy", "SELECT event_id, user_id % 3 > 0 AS local_required, value > 50 AS web_required FROM events")
def _(spark, d):
    required = decisions.required_sources(evidence.source_policy(F.col("user_id") % 3 > 0, F.col("value") > 50))
    return t.read(spark, d, "events").select("event_id", *[c.alias(n) for n, c in required.items()])


@query("ORC4_budgets", "SELECT run_id, row_number() OVER (PARTITION BY version_id ORDER BY ts, run_id) AS call_no, row_number() OVER (PARTITION BY version_id ORDER BY ts, run_id) > 20 AS over_budget FROM runs", "runs")
def _(spark, d):
    r = t.runs(spark, d).withColumnRenamed("version_id", "query_id")
    return evidence.over_budget(r, 20, ["ts", "run_id"]).select("run_id", "call_no", "over_budget")


@query("ORC5_lineage", "WITH RECURSIVE a AS (SELECT event_id AS run_id, event_id AS root_id, event_id AS cur, 0 AS depth FROM events UNION ALL SELECT run_id, cur // 10, cur // 10, depth + 1 FROM a WHERE cur % 10 <> 0 AND depth < 4) SELECT run_id, arg_max(root_id, depth) AS root_id, max(depth) AS depth FROM a GROUP BY run_id")
def _(spark, d):
    r = t.read(spark, d, "events").select(F.col("event_id").alias("run_id"), F.expr("if(event_id % 10 <> 0, cast(floor(event_id / 10) as bigint), null)").alias("parent_id"))
    return evidence.ancestry(r, 4)


@query("ORC7_completion", "SELECT query_id, CASE WHEN NOT bool_or(ok) THEN 'REJECTED' WHEN coalesce(bool_and(CASE WHEN required THEN ok END), true) AND bool_and(ok) THEN 'COMPLETED' ELSE 'COMPLETED_DEGRADED' END AS status FROM (SELECT version_id AS query_id, event_type AS source, event_type IN ('view', 'click') AS required, bool_or(value > 90) AS ok FROM runs GROUP BY ALL) GROUP BY query_id", "runs")
def _(spark, d):
    r = t.runs(spark, d).select(F.col("version_id").alias("query_id"), F.col("event_type").alias("source"), F.col("event_type").isin("view", "click").alias("required"), (F.col("value") > 90).alias("ok"))
    return evidence.completion(r)


@query("ORC11_conversation_window", "SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3 GROUP BY conv_id")
def _(spark, d):
    last = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    c = t.read(spark, d, "conversations").select("conv_id", "turn", "role").withColumn("r", last).where("r <= 3")
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x.role), ",").alias("roles"))


_REP = "SELECT family, arg_max(evidence_id, (score, -evidence_id)) AS representative, count(*) AS n_evidence, count(DISTINCT source) AS n_sources FROM evidence GROUP BY family"


@query("CTX4_representatives", _REP, "evidence")
def _(spark, d):
    return evidence.representatives(t.evidence(spark, d))


@query("CTX3_relationship", "SELECT evidence_id, CASE WHEN family = 1 AND source = 2 THEN 'SAME_IDENTITY' WHEN family = 1 THEN 'EXACT_DUPLICATE' WHEN family % 10 = 1 THEN 'DERIVATIVE' WHEN source % 5 = 0 THEN 'INDEPENDENT' ELSE 'UNKNOWN_DEPENDENCE' END AS relation FROM evidence", "evidence")
def _(spark, d):
    r = evidence.relationship(F.expr("family = 1 and source = 2"), F.expr("family = 1"), F.expr("family % 10 = 1"), F.expr("source % 5 = 0"))
    return t.evidence(spark, d).select("evidence_id", r.alias("relation"))


@query("CTX13_trim", "SELECT doc_id, CASE WHEN n <= 50 THEN 'FULL' ELSE 'EXTRACTED' END AS extent, CASE WHEN n <= 50 THEN text ELSE array_to_string(string_split(text, ' ')[1:50], ' ') END AS text FROM (SELECT *, len(string_split(text, ' ')) AS n FROM documents)")
def _(spark, d):
    docs = t.read(spark, d, "documents").select("doc_id", evidence.trim(F.col("text"), F.size(F.split("text", " ")), 50).alias("x"))
    return docs.select("doc_id", "x.extent", "x.text")


@query("GEN2_schema", "SELECT event_id, json_valid(props) AND json_extract(props, '$.k') IS NOT NULL AS valid FROM events")
def _(spark, d):
    return t.read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").isNotNull().alias("valid"))


@query("GEN4_monotone_sufficiency", f"SELECT query_id, 'SUFFICIENCY_UPGRADE' AS code FROM ({_SUFF}) WHERE sufficiency <> 'SUFFICIENT' AND query_id % 2 = 0", "evidence")
def _(spark, d):
    rank = lambda c: F.create_map(F.lit("INSUFFICIENT"), F.lit(0), F.lit("PARTIALLY_SUFFICIENT"), F.lit(1), F.lit("SUFFICIENT"), F.lit(2))[c]
    s = QUERIES["CTX8_sufficiency"](spark, d).withColumn("claimed", F.when(F.col("query_id") % 2 == 0, F.lit("SUFFICIENT")).otherwise(F.col("sufficiency")))
    return s.where(rank(F.col("claimed")) > rank(F.col("sufficiency"))).select("query_id", F.lit("SUFFICIENCY_UPGRADE").alias("code"))


@query("GEN5_derivations", "SELECT query_id, count(*) AS n_premises, count(*) FILTER (WHERE flag = 'R') AS n_bound, count(*) FILTER (WHERE flag = 'R') < count(*) AS invalid FROM evidence GROUP BY query_id", "evidence")
def _(spark, d):
    e = t.evidence(spark, d).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_premises"), F.count_if(F.col("flag") == "R").alias("n_bound"))
    return e.withColumn("invalid", F.col("n_bound") < F.col("n_premises"))


@query(
    "GEN8_repair",
    "SELECT query_id AS answer_id, unit AS claim_id, count(DISTINCT family) FILTER (WHERE flag <> 'N') AS n_bindings, CASE WHEN query_id % 2 = 0 THEN 'CONFLICT,GAP' ELSE '' END AS disclosures FROM evidence GROUP BY query_id, unit HAVING count(DISTINCT family) FILTER (WHERE flag <> 'N') > 0 OR unit % 3 > 0",
    "evidence",
)
def _(spark, d):
    e = t.evidence(spark, d).select(F.col("query_id").alias("answer_id"), F.col("unit").alias("claim_id"), F.col("family").alias("item_id"), "flag")
    claims = e.select("answer_id", "claim_id").distinct().withColumn("optional", F.col("claim_id") % 3 == 0)
    told = e.where("answer_id % 2 = 0").select("answer_id", F.explode(F.array(F.lit("GAP"), F.lit("CONFLICT"))).alias("disclosure"))
    out = decisions.repaired(claims, e.where("flag <> 'N'").select("answer_id", "claim_id", "item_id"), told)
    return out.withColumn("disclosures", F.array_join("disclosures", ","))


@query("GEN9_attempt_counters", "SELECT version_id, semantic, transport, CASE WHEN semantic > 2 THEN 'REPAIR_EXHAUSTED' WHEN transport > 3 THEN 'PROVIDER_UNAVAILABLE' END AS error FROM (SELECT version_id, date_trunc('day', ts) AS day, count(*) FILTER (WHERE event_type = 'view') AS semantic, count(*) FILTER (WHERE event_type = 'error') AS transport FROM runs GROUP BY ALL)", "runs")
def _(spark, d):
    r = t.runs(spark, d).groupBy("version_id", F.date_trunc("day", "ts").alias("day")).agg(F.count_if(F.col("event_type") == "view").alias("semantic"), F.count_if(F.col("event_type") == "error").alias("transport"))
    return r.select("version_id", "semantic", "transport", decisions.attempt_violation(F.col("semantic"), F.col("transport")).alias("error"))


@query("GEN15_time_scope", f"SELECT item, bool_or(coalesce(bound_low <= {_HIGH[1]} AND bound_high >= {_LOW[0]} AND bound_low <= bound_high, false)) AS grounded FROM bounded GROUP BY item", "bounded")
def _(spark, d):
    hit = tmp.relation("OVERLAP", F.col("bound_low"), F.col("bound_high"), F.lit(_LOW[0]), F.lit(_HIGH[1]))
    return t.bounded(spark, d).groupBy("item").agg(F.bool_or(hit).alias("grounded"))


@query("GEN20_sanitize", "SELECT page_id, replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS safe FROM pages")
def _(spark, d):
    url = F.col("url")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        url = F.replace(url, F.lit(a), F.lit(b))
    return t.read(spark, d, "pages").select("page_id", url.alias("safe"))
