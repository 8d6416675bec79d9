"""More queries: migrations, metadata, policies and states, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import temporal as tmp
from ..operators import blocks, chunks, decisions, evidence, fusion, lifecycle, requests, retrieval, routes
from ..sources import intake
from ..streaming import runs
from . import context, effects, search  # noqa: F401  their queries are registered
from . import tables as t
from .queries import ORACLE, QUERIES, query

# ---- configuration and migrations


_CONFIG = '{"adjustment_cap": 0.25, "around_days": 372, "diversity_penalty": 0.001, "free_per_document": 3, "fusion_limit": 100, "literal_fallback": true, "output_limit": 20, "route_limit": %s, "rrf": 60, "timeline_free": 6}'


@query("CFG1_config_version", "SELECT route_limit, sha256(replace('" + _CONFIG + "', '%s', CAST(route_limit AS VARCHAR))) AS version FROM (SELECT DISTINCT p_size AS route_limit FROM part)")
@query("RET21_config_version", "SELECT route_limit, sha256(replace('" + _CONFIG + "', '%s', CAST(route_limit AS VARCHAR))) AS version FROM (SELECT DISTINCT p_size AS route_limit FROM part)")
def _(spark, d):
    """The version of a configuration for each route limit that parts have as a size."""
    limits = t.read(spark, d, "part").select(F.col("p_size").alias("route_limit")).distinct()
    return limits.select("route_limit", requests.config_version(route_limit=F.col("route_limit")).alias("version"))


@query("MIG1_added_column", "SELECT version_id, NULL::VARCHAR AS normalized_key, published_pg FROM versions UNION ALL SELECT version_id + 1000000, 'k', published_pg FROM versions WHERE version_no = 0", "versions")
def _(spark, d):
    old = t.versions(spark, d).select("version_id", "published_pg")
    new = t.versions(spark, d).where("version_no = 0").select((F.col("version_id") + 1000000).alias("version_id"), "published_pg", F.lit("k").alias("normalized_key"))
    return old.unionByName(new, allowMissingColumns=True).select("version_id", "normalized_key", "published_pg")


@query("SRC6_text_source", "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS n FROM documents")
def _(spark, d):
    docs = t.read(spark, d, "documents").select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text"))
    n = blocks.text_blocks(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return docs.select("doc_id").join(n, "doc_id", "left").na.fill(0)


@query("SRC9_page_failures", "SELECT doc_id, CASE WHEN bool_and(trim(line) = '' OR ordinal % 2 = 0 AND doc_id % 10 = 0) THEN 'scanned_or_image_only' WHEN bool_or(ordinal % 2 = 0 AND doc_id % 10 = 0) THEN 'some_pages_empty' END AS state FROM lines GROUP BY doc_id", "lines")
def _(spark, d):
    pages = t.lines(spark, d).select("doc_id", (F.trim("line") == "").alias("blank"), F.expr("ordinal % 2 = 0 and doc_id % 10 = 0").alias("lost"))
    state = F.when(F.bool_and(F.col("blank") | F.col("lost")), F.lit("scanned_or_image_only")).when(F.bool_or("lost"), F.lit("some_pages_empty"))
    return pages.groupBy("doc_id").agg(state.alias("state"))


@query("ING7_block_ids", "SELECT doc_id, ordinal, 'b' || lpad(CAST(ordinal AS VARCHAR), CAST(greatest(4, length(CAST(ordinal AS VARCHAR))) AS INTEGER), '0') AS block_id FROM lines", "lines")
def _(spark, d):
    return t.lines(spark, d).select("doc_id", F.col("ordinal").cast("long").alias("ordinal"), blocks.block_id(F.col("ordinal")).alias("block_id"))


@query("ING9_dispatch", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'text/markdown' WHEN 2 THEN 'application/pdf' ELSE 'unsupported_media_type' END AS parser FROM pages")
def _(spark, d):
    p = t.read(spark, d, "pages").select("page_id", t.pick(["a.txt", "a.md", "a.pdf", "a.bin"], F.expr("page_id % 4")).alias("path"))
    return p.select("page_id", F.coalesce(intake.media_type(F.col("path")), F.lit("unsupported_media_type")).alias("parser"))


@query("ING14_content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def _(spark, d):
    return t.read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query("ING17_degraded", "SELECT document_id, CASE WHEN document_id % 6 = 0 THEN 'READY_DEGRADED' ELSE 'READY' END AS status FROM docs", "docs")
def _(spark, d):
    degraded = F.expr("if(document_id % 6 = 0, map('temporal', 'degraded'), cast(map() as map<string,string>))")
    return t.documents(spark, d).select("document_id", lifecycle.published_status(degraded).alias("status"))


@query("ING18_mention_rebuild", "SELECT mention_id, precision FROM mentions WHERE item % 4 <> 0 UNION ALL SELECT mention_id + 10000000, 'YEAR' FROM mentions WHERE item % 4 = 0 AND precision = 'DAY'", "mentions")
def _(spark, d):
    m = t.mentions(spark, d)
    touched = m.where("item % 4 = 0").select("item").distinct()
    new = m.where("item % 4 = 0 and precision = 'DAY'").select((F.col("mention_id") + 10000000).alias("mention_id"), F.lit("YEAR").alias("precision"))
    return m.join(touched, "item", "left_anti").select("mention_id", "precision").unionByName(new)


@query("ING19_embedding_batches", "SELECT version_id, (row_number() OVER (PARTITION BY version_id ORDER BY ordinal) - 1) // 4 AS batch, ordinal FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM reps WHERE srg = 'srg1')", "reps")
def _(spark, d):
    missing = lifecycle.missing_vectors(t.chunks(spark, d), t.representations(spark, d), "srg1")
    place = F.row_number().over(Window.partitionBy("version_id").orderBy("ordinal")) - 1
    return missing.select("version_id", F.floor(place / 4).alias("batch"), "ordinal")


@query("ING25_latest_artifact", "SELECT version_id, arg_max(run_id, attempt * 1000000 + run_id) AS run_id FROM runs WHERE event_type <> 'error' GROUP BY version_id", "runs")
def _(spark, d):
    r = t.runs(spark, d).where("event_type <> 'error'")
    return r.groupBy("version_id").agg(F.max_by("run_id", F.expr("attempt * 1000000 + run_id")).alias("run_id"))


@query("ING26_idempotent_create", "SELECT source AS corpus_id, sha256(text) AS source_hash, min(doc_id) AS document_id FROM documents GROUP BY ALL")
def _(spark, d):
    docs = t.read(spark, d, "documents").select(F.col("source").alias("corpus_id"), F.sha2("text", 256).alias("source_hash"), "doc_id")
    return docs.groupBy("corpus_id", "source_hash").agg(F.min("doc_id").alias("document_id"))


@query("ING28_delete_cascade", "SELECT chunk_id FROM chunks WHERE document_id % 9 <> 0", "chunks")
@query("D13_cascade", "SELECT chunk_id FROM chunks WHERE document_id % 9 <> 0", "chunks")
def _(spark, d):
    gone = t.documents(spark, d).where("document_id % 9 = 0").select("document_id")
    return t.chunks(spark, d).join(gone, "document_id", "left_anti").select("chunk_id")


@query("ING30_corpus_move", "SELECT chunk_id, CASE WHEN corpus_id = 'src3' THEN 'src4' ELSE corpus_id END AS corpus_id FROM chunks", "chunks")
def _(spark, d):
    moved = t.documents(spark, d).withColumn("new_corpus", F.expr("if(corpus_id = 'src3', 'src4', corpus_id)")).select("document_id", "new_corpus")
    return t.chunks(spark, d).join(moved, "document_id").select("chunk_id", F.col("new_corpus").alias("corpus_id"))


@query("ING31_reembedding_complete", "SELECT 1 AS id, CASE WHEN (SELECT count(*) FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM reps WHERE srg = 'srg1')) = 0 THEN 'srg1' ELSE 'srg0' END AS srg, 'incomplete' AS what UNION ALL SELECT 1, 'srg2', 'complete'", "reps")
def _(spark, d):
    """A pointer that stays, as its next generation lacks vectors, and one that moves."""
    pointer = spark.range(1).select(F.lit(1).alias("id"), F.lit("srg0").alias("srg"))
    c, r = t.chunks(spark, d), t.representations(spark, d)
    stays = lifecycle.swapped_pointer(pointer, c, r, "srg1").withColumn("what", F.lit("incomplete"))
    built = c.select("chunk_id", F.lit("srg2").alias("srg"))
    return stays.union(lifecycle.swapped_pointer(pointer, c, built, "srg2").withColumn("what", F.lit("complete")))


@query("ING32_rechunk_cutover", "SELECT pg, count(*) AS n FROM chunks WHERE pg = 'pg1' OR pg = 'pg0' AND document_id % 2 = 0 GROUP BY pg", "chunks")
def _(spark, d):
    chosen = t.documents(spark, d).select("document_id", F.expr("if(document_id % 2 = 0, array('pg0', 'pg1'), array('pg1'))").alias("pgs"))
    both = t.chunks(spark, d).join(chosen, "document_id").where("array_contains(pgs, pg)")
    return both.groupBy("pg").agg(F.count(F.lit(1)).alias("n"))


@query("ING36_run_metrics", "SELECT c.version_id, count(*) AS n_chunks, CAST(sum(length(source_text)) AS BIGINT) AS n_chars, count(r.chunk_id) AS n_vectors FROM chunks c LEFT JOIN (SELECT * FROM reps WHERE srg = 'srg1') r USING (chunk_id) GROUP BY c.version_id", "reps")
def _(spark, d):
    r = t.representations(spark, d).where("srg = 'srg1'").withColumn("has", F.lit(1))
    c = t.chunks(spark, d).join(r, "chunk_id", "left").groupBy("version_id")
    return c.agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("source_text")).alias("n_chars"), F.count("has").alias("n_vectors"))


@query("D4_single_pointer", "SELECT count(*) AS n, count(*) = 1 AND coalesce(bool_and(n_nationkey = 1), false) AS fine FROM nation WHERE n_regionkey = 1 AND n_nationkey < 2")
def _(spark, d):
    return lifecycle.pointer_violations(t.read(spark, d, "nation").where("n_regionkey = 1 and n_nationkey < 2").withColumnRenamed("n_nationkey", "id"))


@query("D9_unique_mentions", "SELECT item, start_year, start_month, start_day, count(*) AS n FROM mentions GROUP BY ALL HAVING count(*) > 1", "mentions")
def _(spark, d):
    return lifecycle.repeated(t.mentions(spark, d), "item", "start_year", "start_month", "start_day")


@query("D10_unknown_generation", "SELECT chunk_id FROM chunks WHERE pg NOT IN (SELECT published_pg FROM versions)", "chunks", "versions")
def _(spark, d):
    return lifecycle.orphans(t.chunks(spark, d), t.versions(spark, d).select(F.col("published_pg").alias("pg")), "pg").select("chunk_id")


# ---- dates


@query("TMP1_precision_counts", "SELECT precision, count(*) AS n, count(start_month) AS with_month, count(start_day) AS with_day FROM mentions GROUP BY precision", "mentions")
def _(spark, d):
    return t.mentions(spark, d).groupBy("precision").agg(F.count(F.lit(1)).alias("n"), F.count("start_month").alias("with_month"), F.count("start_day").alias("with_day"))


@query("TMP2_era_sign", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN -(o_orderkey % 900 + 1) ELSE o_orderkey % 900 + 1 END AS start_year FROM orders")
def _(spark, d):
    text = F.concat(F.lit("in "), F.expr("o_orderkey % 900 + 1"), F.expr("if(o_orderkey % 3 = 0, ' BCE.', ' CE.')"))
    b = t.read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("b0000").alias("block_id"), text.alias("text"))
    return tmp.recognize(b).select(F.col("doc_id").alias("o_orderkey"), F.col("start_year").cast("long").alias("start_year"))


@query("TMP5_ranges", "SELECT o_orderkey, year(o_orderdate) AS start_year, year(o_orderdate) + 3 AS end_year FROM orders")
def _(spark, d):
    text = F.concat(F.lit("from "), F.year("o_orderdate"), F.lit(" to "), F.year("o_orderdate") + 3, F.lit(" it held"))
    b = t.read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("b0000").alias("block_id"), text.alias("text"))
    return tmp.recognize(b).select(F.col("doc_id").alias("o_orderkey"), F.col("start_year").cast("long").alias("start_year"), F.col("end_year").cast("long").alias("end_year"))


@query("TMP7_certainty", "SELECT o_orderkey, (['EXACT', 'APPROXIMATE', 'UNCERTAIN', 'APPROXIMATE'])[o_orderkey % 4 + 1] AS certainty FROM orders")
def _(spark, d):
    text = F.concat(t.pick(["in ", "c. ", "possibly ", "roughly "], F.expr("o_orderkey % 4")), F.date_format("o_orderdate", "yyyy-MM-dd"))
    b = t.read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("b0000").alias("block_id"), text.alias("text"))
    return tmp.recognize(b).select(F.col("doc_id").alias("o_orderkey"), "certainty")


@query("TMP9_offsets", "SELECT o_orderkey, 6 AS start_offset, 6 + length(strftime(o_orderdate, '%-d %B %Y')) AS end_offset, strftime(o_orderdate, '%-d %B %Y') AS found FROM orders")
def _(spark, d):
    """Offsets are code points of the text as it stands: behind two characters of more than one byte."""
    text = F.concat(F.lit("é😀 on "), F.date_format("o_orderdate", "d MMMM yyyy"), F.lit(" x"))
    b = t.read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("b0000").alias("block_id"), text.alias("text"))
    m = tmp.recognize(b).drop("text").join(b.select("doc_id", "text"), "doc_id")
    return m.select(F.col("doc_id").alias("o_orderkey"), "start_offset", "end_offset", F.expr("substring(text, start_offset + 1, end_offset - start_offset)").alias("found"))


@query("TMP11_plain_bounds", "SELECT mention_id, CASE WHEN start_year IS NOT NULL THEN coalesce(end_year, start_year) * 372 + 371 END AS bound_high FROM mentions", "mentions")
def _(spark, d):
    return t.bounded(spark, d, plain=True).select("mention_id", F.col("bound_high").cast("long").alias("bound_high"))


@query("TMP19_signals", "SELECT mention_id, precision IN ('DAY', 'MONTH') AS precise, origin = 'CONTENT_MENTION' AS in_text, coalesce(bound_high - bound_low, -1) AS width FROM bounded", "bounded")
def _(spark, d):
    return t.bounded(spark, d).select("mention_id", (tmp.precision_rank(F.col("precision")) >= 5).alias("precise"), (F.col("origin") == "CONTENT_MENTION").alias("in_text"), F.coalesce(F.col("bound_high") - F.col("bound_low"), F.lit(-1)).cast("long").alias("width"))


@query("TMP23_relative_reference", "SELECT o_orderkey, year(o_orderdate - INTERVAL 100 YEAR) AS year FROM orders")
def _(spark, d):
    return t.read(spark, d, "orders").select("o_orderkey", F.year(F.add_months("o_orderdate", -1200)).cast("long").alias("year"))


# ---- retrieval

_REQ = "(SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'DEEP' WHEN event_id % 5 = 0 THEN 'BROAD' END AS profile, CASE event_type WHEN 'view' THEN 'POINT' WHEN 'click' THEN 'NEAR' END AS rel, CASE WHEN event_id % 11 = 0 THEN 'AUTHOR' WHEN event_id % 13 = 0 THEN 'SOURCE_TIME' END AS con, user_id % 4 AS n FROM events)"


@query("RET1_validation", f"SELECT event_id, CASE WHEN coalesce(profile = 'DEEP', false) OR coalesce(rel = 'NEAR', false) OR coalesce(con = 'AUTHOR', false) THEN 'INVALID_RETRIEVAL_REQUEST' WHEN n = 0 THEN 'NO_EXECUTABLE_CORPUS_SCOPE' END AS error FROM {_REQ}")
def _(spark, d):
    e = t.read(spark, d, "events").select(
        "event_id", F.expr("case when event_id % 7 = 0 then 'DEEP' when event_id % 5 = 0 then 'BROAD' end").alias("profile"), F.expr("case event_type when 'view' then 'POINT' when 'click' then 'NEAR' end").alias("rel"),
        F.expr("case when event_id % 11 = 0 then 'AUTHOR' when event_id % 13 = 0 then 'SOURCE_TIME' end").alias("con"), F.expr("user_id % 4").alias("n"),
    )
    return e.select("event_id", requests.request_error(F.col("profile"), F.col("rel"), F.col("con"), F.col("n")).alias("error"))


_STATE = "sha256(concat_ws('|', srg, sha256('" + _CONFIG.replace("%s", "40") + "'), 'src0,src1', 'snap1'))"


@query("RET4_captured_state", f"SELECT srg, count(DISTINCT chunk_id) AS n_chunks, {_STATE} AS state_id FROM reps GROUP BY srg", "reps")
def _(spark, d):
    built = t.representations(spark, d).groupBy("srg").agg(F.countDistinct("chunk_id").alias("n_chunks"))
    return built.withColumn("state_id", requests.captured_state(F.col("srg"), requests.RetrievalConfig(), ["src1", "src0"], "snap1"))


@query("RET18_pointer_changed", "SELECT document_id, CASE WHEN version_id % 4 = 0 THEN 'SEARCH_GENERATION_CHANGED' END AS error FROM (SELECT document_id, max(version_id) AS version_id FROM versions GROUP BY document_id)", "versions")
def _(spark, d):
    v = t.versions(spark, d).groupBy("document_id").agg(F.max("version_id").alias("version_id"))
    return v.select("document_id", requests.pointer_error(F.lit("srg1"), F.expr("if(version_id % 4 = 0, 'srg2', 'srg1')")).alias("error"))


@query("RET6_compatible", "SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN 'EMBEDDING_GENERATION_INCOMPATIBLE' END AS error FROM embeddings")
def _(spark, d):
    v = t.read(spark, d, "embeddings").select("vec_id", F.expr("if(vec_id % 10 = 0, 'other', 'fake')").alias("model"), F.size("embedding").alias("dims"))
    return v.select("vec_id", requests.representation_error(F.col("model"), F.col("dims"), "fake", 64).alias("error"))


_SCOPE = ["src0", "src1", "src2", "src3"]


def _state(spark, d) -> retrieval.State:
    """The engine's tables; a mention belongs to a line of the document of its item, a chunk has the vector of its document."""
    tables = {"chunks": t.chunks(spark, d), "documents": t.documents(spark, d), "versions": t.versions(spark, d), "representations": t.representations(spark, d)}
    tables["mentions"] = t.bounded(spark, d).withColumn("item", F.expr("concat(item * 10 + item % 3, ':', mention_id % 8)"))
    v = t.read(spark, d, "embeddings").select(F.col("vec_id").alias("document_id"), F.col("embedding").cast("array<double>").alias("v"))
    tables["vectors"] = tables["chunks"].select("chunk_id", "document_id").join(v, "document_id").select("chunk_id", "v")
    return retrieval.State(tables, snapshot="snap1", model="fake", dims=64)


def _asked(spark, d):
    """Every benchmark text as a request, with the vector of its number; each third asks for a time, each sixth of them for a time of the source."""
    low, high = routes.asked_bounds(-3, 3)[0], routes.asked_bounds(-1, 6)[1]
    v = t.read(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("query_vector"))
    words = F.slice(F.split("text", " "), 1, 4)
    asked = t.read(spark, d, "benchmark").join(v, "item_id", "left").select(F.col("item_id").alias("query_id"), F.array_join(words, " or ").alias("query"), "query_vector")
    timed, sourced = F.col("query_id") % 3 == 1, F.col("query_id") % 6 == 1
    when = lambda c, value: F.when(c, F.lit(value))
    return asked.withColumns({
        "corpora": F.array(*[F.lit(c) for c in [*_SCOPE, "nowhere"]]), "relation": when(timed, "RANGE"), "q_low": when(timed, low), "q_high": when(timed, high),
        "constraint": when(sourced, "SOURCE_TIME"), "s_low": when(sourced, low), "s_high": when(sourced, high),
    })


def _later(spark, d) -> Callable[[], retrieval.State]:
    """Reads the tables; from the second time on every fifth document has got another version."""
    states = [_state(spark, d)]
    moved = states[0].tables["documents"].withColumn("active_version_id", F.expr("if(document_id % 5 = 0, -1, active_version_id)"))
    states.append(replace(states[0], tables=states[0].tables | {"documents": moved}))
    return lambda: states.pop(0) if len(states) > 1 else states[0]


def _told(out: retrieval.Outcome):
    """Requests with their maps as text; latencies aren't results."""
    text = lambda c: F.concat_ws(",", F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e.key, e.value)))
    return out.requests.select("query_id", "outcome", F.concat_ws(",", "errors").alias("errors"), F.concat_ws(",", "warnings").alias("warnings"), "profile", "fallback", text("route_counts").alias("routes"), text("rejected").alias("rejected"), "n_candidates")


@query("SNK2_retrieve")
def _(spark, d):
    out = retrieval.retrieve(spark, _asked(spark, d), lambda: _state(spark, d))
    return out.candidates.select("query_id", "item", "document_id", "source_text", "routes", "score", "rank")


@query("RET17_final_validation")
def _(spark, d):
    """The candidates that are left after a change of versions, filled up from the next ones."""
    return retrieval.retrieve(spark, _asked(spark, d), _later(spark, d)).candidates.select("query_id", "item", "document_id", "rank")


@query("RET23_candidates")
def _(spark, d):
    """Candidates with their lineage, each route's rank and score, and the mentions that stand behind them."""
    found = retrieval.retrieve(spark, _asked(spark, d), lambda: _state(spark, d)).candidates
    signal = lambda e: F.concat(e.key, F.lit(":"), e.value["rank"], F.lit(":"), F.round(e.value["score"], 6))
    return found.select(
        "query_id", "item", "document_id", "version_id", "corpus_id", "source_text", "routes", "n_routes", F.concat_ws(",", F.transform(F.map_entries("signals"), signal)).alias("signals"),
        "score", "adjustment", "rank", F.array_join(F.transform("mentions", lambda m: m.cast("string")), ",").alias("mentions"),
    )


@query("RET24_metadata")
def _(spark, d):
    """Of every request its outcome, reasons, scope warnings, candidates by route, whether the fallback ran, and rejects by reason."""
    return _told(retrieval.retrieve(spark, _asked(spark, d), _later(spark, d)))


@query("RET19_lost_route")
def _(spark, d):
    """The dense route can't read its vectors: the others answer, degraded."""
    state = _state(spark, d)
    broken = state.tables["vectors"].withColumn("v", F.when(F.length("chunk_id") >= 0, F.raise_error(F.lit("lost")).cast("array<double>")))
    return _told(retrieval.retrieve(spark, _asked(spark, d), lambda: replace(state, tables=state.tables | {"vectors": broken})))


@query("RET20_deadline")
def _(spark, d):
    """No route ends within a millisecond: every request fails, with the reason."""
    return _told(retrieval.retrieve(spark, _asked(spark, d), lambda: _state(spark, d), deadline_ms=1))


_BATCH = (
    "SELECT event_id AS query_id, scope, warnings, profile, CASE WHEN rel IS NOT NULL AND q_low > q_high OR con IS NOT NULL AND q_low > 900 OR bad THEN 'INVALID_RETRIEVAL_REQUEST' WHEN scope = '' THEN 'NO_EXECUTABLE_CORPUS_SCOPE' WHEN event_id % 10 = 0 THEN 'EMBEDDING_GENERATION_INCOMPATIBLE' END AS error FROM "
    "(SELECT *, coalesce(asked, CASE rel WHEN 'POINT' THEN 'TEMPORAL_POINT' WHEN 'AFTER' THEN 'TEMPORAL_RANGE' END, 'FACT_LOOKUP') AS profile, coalesce(asked = 'DEEP', false) OR coalesce(con = 'AUTHOR', false) AS bad, "
    "CASE WHEN user_id % 3 > 0 AND EXISTS (SELECT 1 FROM documents WHERE source = 'src1') THEN 'src1' ELSE '' END AS scope, CASE WHEN user_id % 3 = 2 THEN '' ELSE 'lost' END AS warnings FROM "
    "(SELECT *, CASE WHEN event_id % 7 = 0 THEN 'DEEP' WHEN event_id % 5 = 0 THEN 'BROAD' END AS asked, CASE event_type WHEN 'view' THEN 'POINT' WHEN 'click' THEN 'AFTER' END AS rel, CASE WHEN event_id % 11 = 0 THEN 'AUTHOR' WHEN event_id % 13 = 0 THEN 'SOURCE_TIME' END AS con, event_id % 1000 AS q_low, user_id % 1000 AS q_high FROM events))"
)


@query("RET2_checked_requests", _BATCH)
def _(spark, d):
    """Every event as a request, checked before any search: unknown profiles and constraints, bounds the wrong way round, corpora that don't exist, vectors of another model."""
    pick = lambda text: F.expr(f"case {text} end")
    asked = t.read(spark, d, "events").select(
        F.col("event_id").alias("query_id"), F.lit("q").alias("query"), pick("when event_id % 7 = 0 then 'DEEP' when event_id % 5 = 0 then 'BROAD'").alias("profile"), pick("event_type when 'view' then 'POINT' when 'click' then 'AFTER'").alias("relation"),
        pick("when event_id % 11 = 0 then 'AUTHOR' when event_id % 13 = 0 then 'SOURCE_TIME'").alias("constraint"), F.expr("cast(event_id % 1000 as int)").alias("q_low"), F.expr("cast(user_id % 1000 as int)").alias("q_high"),
        F.expr("cast(event_id % 1000 as int)").alias("s_low"), F.lit(900).alias("s_high"), F.expr("case user_id % 3 when 0 then array('lost') when 1 then array('src1', 'lost', 'src1') else array('src1') end").alias("corpora"),
        F.expr("transform(sequence(1, if(event_id % 10 = 0, 3, 64)), x -> double(x))").alias("query_vector"),
    )
    out = retrieval.checked_requests(asked, t.documents(spark, d), "fake", 64)
    return out.select("query_id", F.concat_ws(",", "scope").alias("scope"), F.concat_ws(",", "warnings").alias("warnings"), F.expr("coalesce(profile, 'FACT_LOOKUP')").alias("profile"), "error")


@query("TMP22_derived_intents")
def _(spark, d):
    asked = t.read(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), F.concat(F.lit("What was signed in "), F.date_format("o_orderdate", "MMMM yyyy"), F.lit("?")).alias("text"))
    return requests.derive_intents(asked, enabled=True)


@query("RET25_outcome_states", "SELECT event_id, CASE WHEN (event_type = 'error' AND value < 50) AND NOT (user_id % 2 = 0 AND event_id % 3 > 0) THEN 'FAILURE' WHEN event_type = 'error' OR value < 10 THEN 'SUCCESS_DEGRADED' WHEN event_id % 3 > 0 THEN 'SUCCESS_WITH_CANDIDATES' ELSE 'SUCCESS_NO_CANDIDATES' END AS outcome FROM events")
def _(spark, d):
    dense, lexical = F.col("event_type") != "error", (F.col("event_type") != "error") | (F.col("value") >= 50)
    return t.read(spark, d, "events").select("event_id", requests.outcome(F.col("event_id") % 3, dense, lexical, dense & (F.col("value") >= 10), F.col("user_id") % 2 == 0).alias("outcome"))


# ---- windows, sorts, sets


@query("WIN1_latest_run", "SELECT version_id, run_id FROM (SELECT *, row_number() OVER (PARTITION BY version_id ORDER BY attempt DESC, run_id DESC) AS r FROM runs) WHERE r = 1", "runs")
@query("TOP2_newest_first", "SELECT version_id, run_id FROM (SELECT *, row_number() OVER (PARTITION BY version_id ORDER BY attempt DESC, run_id DESC) AS r FROM runs) WHERE r = 1", "runs")
def _(spark, d):
    return t.runs(spark, d).groupBy("version_id").agg(F.max_by("run_id", F.struct("attempt", "run_id")).alias("run_id"))


@query("WIN6_running_totals", "SELECT version_id, ordinal, CAST(sum(length(source_text)) OVER (PARTITION BY version_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM chunks", "chunks")
@query("TOP3_by_ordinal", "SELECT version_id, ordinal, CAST(sum(length(source_text)) OVER (PARTITION BY version_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM chunks", "chunks")
def _(spark, d):
    w = Window.partitionBy("version_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return t.chunks(spark, d).select("version_id", "ordinal", F.sum(F.length("source_text")).over(w).alias("total"))


@query("TOP5_mention_order", "SELECT item, mention_id, row_number() OVER (PARTITION BY item ORDER BY mention_id) AS place FROM mentions", "mentions")
def _(spark, d):
    return t.mentions(spark, d).select("item", "mention_id", F.row_number().over(Window.partitionBy("item").orderBy("mention_id")).alias("place"))


@query("TOP6_limits", "SELECT query_id, evidence_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, evidence_id) AS r FROM evidence) WHERE r <= 20", "evidence")
@query("WIN9_final_rank", "SELECT query_id, evidence_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, evidence_id) AS r FROM evidence) WHERE r <= 20", "evidence")
def _(spark, d):
    e = t.evidence(spark, d).select("query_id", F.col("evidence_id").alias("item"), "score")
    return fusion.ranks(e).where("rank <= 20").select("query_id", F.col("item").alias("evidence_id"))


@query("SET5_selected_corpora", "SELECT doc_id FROM documents WHERE source IN ('src1', 'src2')")
def _(spark, d):
    return t.read(spark, d, "documents").where(F.col("source").isin("src1", "src2")).select("doc_id")


@query("AGG4_edge_frequency", "SELECT mask, count(*) AS n FROM (SELECT regexp_replace(trim(line), '[0-9]+', '#', 'g') AS mask FROM lines WHERE ordinal = 0) GROUP BY mask HAVING count(*) > 1", "lines")
def _(spark, d):
    first = t.lines(spark, d).where("ordinal = 0").select(F.regexp_replace(F.trim("line"), "[0-9]+", "#").alias("mask"))
    return lifecycle.repeated(first, "mask")


@query("AGG8_represented", "SELECT version_id, count(*) AS n, count(*) FILTER (WHERE chunk_id IN (SELECT chunk_id FROM reps)) AS represented FROM chunks GROUP BY version_id", "reps")
def _(spark, d):
    r = t.representations(spark, d).select("chunk_id").distinct().withColumn("has", F.lit(1))
    return t.chunks(spark, d).join(r, "chunk_id", "left").groupBy("version_id").agg(F.count(F.lit(1)).alias("n"), F.count("has").alias("represented"))


@query("STR1_poll_batches", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(spark, d):
    stream = runs.poll(spark, d, "events.parquet", "event_type string").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return runs.drain(spark, stream, f"polled_{uuid.uuid4().hex}", None, "complete")


@query("STR9_idempotent", "SELECT version_id, attempt, min(run_id) AS run_id FROM runs GROUP BY ALL", "runs")
def _(spark, d):
    return t.runs(spark, d).groupBy("version_id", "attempt").agg(F.min("run_id").alias("run_id"))


# ---- orchestration


_SIGNALS = "(SELECT *, event_id % 4 AS n_refs, least(event_id % 4, user_id % 3) AS n_resolved, value > 60 AS ambiguous, value > 95 AS material FROM events)"


@query("ORC3_interpretation", f"SELECT event_id, CASE WHEN ambiguous AND material THEN 'AMBIGUOUS_REQUIRES_CLARIFICATION' WHEN ambiguous THEN 'AMBIGUOUS_BUT_SEARCHABLE' WHEN n_refs > 0 AND n_resolved = 0 THEN 'UNRESOLVED' WHEN n_resolved < n_refs THEN 'PARTIALLY_RESOLVED' ELSE 'RESOLVED' END AS state FROM {_SIGNALS}")
def _(spark, d):
    e = t.read(spark, d, "events").select("event_id", "value", F.expr("event_id % 4").alias("refs"), F.expr("least(event_id % 4, user_id % 3)").alias("resolved"))
    return e.select("event_id", decisions.interpretation(F.col("refs"), F.col("resolved"), F.col("value") > 60, F.col("value") > 95).alias("state"))


@query(
    "ORC6_stop_reason",
    "SELECT event_id, CASE WHEN user_id % 31 = 0 THEN 'INVALID_REQUEST' WHEN value > 97 THEN 'CLARIFICATION_REQUIRED' WHEN value < 3 THEN 'DEADLINE_EXHAUSTED' WHEN value < 6 THEN 'BUDGET_EXHAUSTED' WHEN event_type = 'error' AND event_id % 2 <> 0 THEN 'REQUIRED_TOOL_FAILURE' "
    "WHEN event_id % 2 = 0 AND event_id % 5 >= 3 THEN 'MAX_ATTEMPTS_REACHED' WHEN event_id % 2 <> 0 AND event_id % 5 > 0 THEN 'NO_USEFUL_ADAPTATION' WHEN event_id % 2 <> 0 THEN 'REQUIRED_EXECUTION_COMPLETE' END AS state FROM events",
)
def _(spark, d):
    value, adaptable = F.col("value"), F.col("event_id") % 2 == 0
    reason = decisions.stop_reason(F.col("user_id") % 31 != 0, value > 97, F.when(value < 3, 0).otherwise(100), F.when(value < 6, 0).otherwise(5), F.col("event_type") == "error", adaptable, F.col("event_id") % 5, 3)
    return t.read(spark, d, "events").select("event_id", reason.alias("state"))


@query(
    "ORC8_failure_class",
    "SELECT event_id, code, CASE code WHEN 'error' THEN 'TRANSIENT_PROVIDER_FAILURE' WHEN 'signup' THEN 'RATE_LIMIT' WHEN 'click' THEN 'AUTH_OR_CONFIGURATION_FAILURE' WHEN 'view' THEN 'MALFORMED_TOOL_RESPONSE' WHEN 'purchase' THEN 'INTERNAL_RETRIEVAL_FAILURE' END AS failure_class, "
    "CASE WHEN code IN ('error', 'signup') THEN true WHEN code IS NOT NULL THEN false END AS retryable FROM (SELECT event_id, CASE WHEN value > 50 THEN event_type END AS code FROM events)",
)
def _(spark, d):
    failures = t.read(spark, d, "events").select("event_id", F.when(F.col("value") > 50, F.col("event_type")).alias("code"))
    return decisions.classified(failures, {"error": "TRANSIENT_PROVIDER_FAILURE", "signup": "RATE_LIMIT", "click": "AUTH_OR_CONFIGURATION_FAILURE", "view": "MALFORMED_TOOL_RESPONSE"})


_REASONED = ["NO_RESULTS", "UNRESOLVED_REFERENCE", "TEMPORAL_ANCHOR_RECOVERY", "QUERY_OVERCONSTRAINED", "SUBQUERY_UNCOVERED", "RELEVANT_SOURCE_DEGRADED", "CONFLICT_FOLLOWUP", "TIMEOUT"]


@query(
    "ORC9_seeking_reason",
    "SELECT event_id, CASE WHEN event_id % 9 = 8 THEN 'REASON_MISSING' WHEN event_id % 9 = 7 THEN 'NOT_A_SEEKING_REASON' WHEN event_id % 9 IN (1, 5) AND value <= 50 THEN 'NO_PLAUSIBLE_RECOVERY' WHEN event_id % 9 = 6 AND event_type <> 'click' THEN 'NO_CONFLICT_SIGNAL' END AS error FROM events",
)
def _(spark, d):
    reason = F.get(F.array(*[F.lit(r) for r in _REASONED]), (F.col("event_id") % 9).cast("int"))
    return t.read(spark, d, "events").select("event_id", decisions.seeking_error(reason, F.col("value") > 50, F.col("event_type") == "click").alias("error"))


@query("ORC15_conflict_signal", "SELECT event_id, CASE event_type WHEN 'click' THEN 'SIGNAL_USED_FOR_GROUPING' WHEN 'view' THEN 'SIGNAL_USED_FOR_WINNER' END AS error FROM events")
def _(spark, d):
    used = F.when(F.col("event_type") == "click", "GROUPING").when(F.col("event_type") == "view", "WINNER").otherwise("RETRIEVAL")
    return t.read(spark, d, "events").select("event_id", decisions.conflict_signal_violation(used).alias("error"))


@query(
    "CTX1_assembly",
    "SELECT event_id, CASE WHEN value < 5 THEN 'FAILED' WHEN event_type IN ('signup', 'error') THEN 'NOT_APPLICABLE' WHEN value > 95 THEN 'FAILED' WHEN event_type IN ('view', 'click') THEN 'ASSEMBLED' ELSE 'FAILED' END AS state FROM events",
)
def _(spark, d):
    kinds = {"view": "COMPLETED", "click": "COMPLETED_DEGRADED", "signup": "CLARIFICATION_REQUIRED", "error": "REJECTED"}
    status = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("event_type")]
    return t.read(spark, d, "events").select("event_id", decisions.assembly(F.coalesce(status, F.lit("RUNNING")), F.col("value") >= 5, F.col("value") <= 95).alias("state"))


@query(
    "GEN11_statuses",
    "SELECT event_id, g AS generation_status, CASE WHEN g IN ('GENERATED', 'GENERATED_DEGRADED') THEN CASE s WHEN 'SUFFICIENT' THEN 'FULL_ANSWER' WHEN 'PARTIALLY_SUFFICIENT' THEN 'PARTIAL_ANSWER' ELSE 'INSUFFICIENT_EVIDENCE' END END AS response_status, s AS evidence_sufficiency FROM "
    "(SELECT event_id, CASE WHEN event_type = 'signup' THEN 'NOT_APPLICABLE' WHEN event_type = 'error' OR value > 90 THEN 'FAILED' WHEN event_id % 3 = 0 THEN 'GENERATED_DEGRADED' ELSE 'GENERATED' END AS g, (['SUFFICIENT', 'PARTIALLY_SUFFICIENT', 'INSUFFICIENT'])[user_id % 3 + 1] AS s FROM events)",
)
def _(spark, d):
    assembled = F.when(F.col("event_type") == "signup", "NOT_APPLICABLE").when(F.col("event_type") == "error", "FAILED").otherwise("ASSEMBLED")
    sufficiency = t.pick(["SUFFICIENT", "PARTIALLY_SUFFICIENT", "INSUFFICIENT"], F.col("user_id") % 3)
    out = decisions.statuses(assembled, sufficiency, F.when(F.col("value") > 90, F.lit("PROVIDER_TIMEOUT")), F.col("event_id") % 3 == 0)
    return t.read(spark, d, "events").select("event_id", *[c.alias(n) for n, c in out.items()])


_CODES = list(decisions.GENERATION_FAILURES)


@query(
    "GEN13_failure_taxonomy",
    "SELECT event_id, CASE WHEN k < 15 THEN (['" + "','".join(_CODES) + "'])[k + 1] WHEN k = 15 THEN 'INTERNAL_GENERATION_ERROR' END AS code, CASE WHEN k IN (2, 3, 4, 7) THEN true WHEN k <= 15 THEN false END AS retryable FROM (SELECT event_id, event_id % 17 AS k FROM events)",
)
def _(spark, d):
    code = F.get(F.array(*[F.lit(c) for c in [*_CODES, "HTTP 599"]]), (F.col("event_id") % 17).cast("int"))
    return decisions.generation_failures(t.read(spark, d, "events").select("event_id", code.alias("code")))


@query(
    "GEN17_presentation",
    "SELECT event_id, CASE event_type WHEN 'view' THEN 'table,brief' WHEN 'click' THEN 'bullets' ELSE '' END AS accepted, CASE WHEN event_type IN ('click', 'error') THEN 'as a poem' ELSE '' END AS relaxed, CASE WHEN event_type IN ('error', 'view') THEN 'no_citations' ELSE '' END AS rejected FROM events",
)
def _(spark, d):
    asked = F.create_map(F.lit("view"), F.array(*map(F.lit, ("table", "brief", "no_citations"))), F.lit("click"), F.array(*map(F.lit, ("bullets", "as a poem"))), F.lit("error"), F.array(*map(F.lit, ("as a poem", "no_citations"))))
    e = t.read(spark, d, "events").select("event_id", decisions.presentation(F.coalesce(asked[F.col("event_type")], F.array().cast("array<string>"))).alias("p"))
    return e.select("event_id", *[F.array_join(F.col(f"p.{c}"), ",").alias(c) for c in ("accepted", "relaxed", "rejected")])


@query("ORC10_envelope", "SELECT evidence_id, source % 2 = 0 AS is_web, CASE WHEN source % 2 = 1 THEN family END AS local_id, CASE WHEN source % 2 = 0 THEN source END AS web_id FROM evidence", "evidence")
def _(spark, d):
    web = F.col("source") % 2 == 0
    e = t.evidence(spark, d).select("evidence_id", web.alias("is_web"), F.when(~web, F.struct("family")).alias("local"), F.when(web, F.struct("source")).alias("web"))
    return e.select("evidence_id", "is_web", F.col("local.family").alias("local_id"), F.col("web.source").alias("web_id"))


@query("ORC12_preserved_intent", "SELECT b.event_id FROM events a JOIN events b ON a.event_id = b.event_id // 10 WHERE b.event_id % 10 <> 0 AND a.event_type <> b.event_type")
def _(spark, d):
    e = t.read(spark, d, "events").select("event_id", "event_type")
    child = e.where("event_id % 10 <> 0").select("event_id", F.col("event_type").alias("own"), F.expr("cast(floor(event_id / 10) as bigint)").alias("up"))
    return child.join(e.select(F.col("event_id").alias("up"), "event_type"), "up").where("own <> event_type").select("event_id")


@query("ORC13_web_time", "SELECT event_id, CASE WHEN event_id % 2 = 0 AND event_type <> 'purchase' THEN 'TIME_SEMANTICS_CHANGED' END AS error FROM events")
def _(spark, d):
    constraint = F.when(F.col("event_type") == "purchase", "PUBLICATION").when(F.col("event_type") == "view", "EVENT").when(F.col("event_type") == "click", "CONTENT")
    kind = F.when(F.col("event_id") % 2 == 0, "PUBLICATION").otherwise("CONTENT")
    return t.read(spark, d, "events").select("event_id", decisions.web_time_violation(constraint, kind).alias("error"))


@query("ORC14_plan_revision", "SELECT version_id AS query_id, max(attempt) AS revision, arg_max(run_id, (attempt, run_id)) AS plan, count(*) AS n_revisions, count(DISTINCT attempt) = count(*) AND min(attempt) = 1 AND max(attempt) = count(*) AS in_order FROM runs GROUP BY version_id", "runs")
def _(spark, d):
    return decisions.current_plans(t.runs(spark, d).select(F.col("version_id").alias("query_id"), F.col("attempt").alias("revision"), F.col("run_id").alias("plan")))


# ---- context and answers


@query("CTX2_provenance", "SELECT evidence_id FROM evidence WHERE source NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 20)", "evidence")
def _(spark, d):
    known = t.read(spark, d, "supplier").where("s_nationkey < 20").select(F.col("s_suppkey").alias("source"))
    return t.evidence(spark, d).join(known, "source", "left_anti").select("evidence_id")


@query("CTX7_conflict_orthogonal", "SELECT unit, max(value) - min(value) > 0.05 AS conflict, count(DISTINCT family) >= 100 AS supported FROM evidence GROUP BY unit", "evidence")
def _(spark, d):
    return t.evidence(spark, d).groupBy("unit").agg((F.max("value") - F.min("value") > 0.05).alias("conflict"), (F.countDistinct("family") >= 100).alias("supported"))


@query(
    "CTX9_utility",
    "SELECT evidence_id, round(0.3::DOUBLE * score / 100000 + CASE WHEN unit < 10 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN value < 0.02 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN family % 3 = 0 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN flag = 'A' THEN 0.1::DOUBLE ELSE 0 END "
    "+ 0.1::DOUBLE * least(tokens / 50.0, 1) - CASE WHEN flag = 'N' THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN source > 3 THEN 0.1::DOUBLE ELSE 0 END, 9) AS utility FROM evidence",
    "evidence",
)
def _(spark, d):
    utility = decisions.utility(
        rank=F.col("score") / 100000, coverage=F.col("unit") < 10, temporal=F.col("value") < 0.02, independent=F.col("family") % 3 == 0, conflict=F.col("flag") == "A",
        complete=F.least(F.col("tokens") / 50, F.lit(1.0)), degraded=F.col("flag") == "N", provenance=F.col("source") > 3,
    )
    return t.evidence(spark, d).select("evidence_id", utility.alias("utility"))


_DECIDED = (
    "SELECT evidence_id, CASE WHEN unit = 19 THEN 'DROPPED_POLICY_VIOLATION' WHEN source = 3 THEN 'DROPPED_INVALID_PROVENANCE' WHEN flag = 'N' AND value > 0.07 THEN 'DROPPED_DEGRADED_CONTENT' WHEN nth > 1 THEN 'DROPPED_DUPLICATE' WHEN family % 10 = 1 THEN 'DROPPED_REDUNDANT' "
    "WHEN score < 5000 THEN 'DROPPED_LOW_RELEVANCE' WHEN crowd > 3 THEN 'DROPPED_DIVERSITY_PRESSURE' WHEN spent > 2000 THEN 'DROPPED_BUDGET' WHEN flag = 'A' THEN 'SELECTED_CONFLICT_SIDE' WHEN value < 0.02 THEN 'SELECTED_TEMPORAL_SEGMENT' WHEN family % 3 = 0 THEN 'SELECTED_INDEPENDENT_SUPPORT' "
    "WHEN unit < 10 THEN 'SELECTED_COVERAGE' ELSE 'SELECTED_PRIMARY' END AS reason FROM (SELECT *, row_number() OVER (PARTITION BY query_id, family ORDER BY score DESC, evidence_id) AS nth, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, evidence_id) AS crowd, "
    "sum(tokens) OVER (PARTITION BY query_id ORDER BY score DESC, evidence_id ROWS UNBOUNDED PRECEDING) AS spent FROM evidence)"
)


@query("CTX12_selection", _DECIDED, "evidence")
def _(spark, d):
    """Thirteen reasons, the first that holds."""
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "evidence_id"))
    e = evidence.select_within(t.evidence(spark, d), 2000, [F.desc("score"), F.col("evidence_id")]).withColumns({"nth": nth("query_id", "family"), "crowd": nth("query_id", "source")})
    reason = decisions.selection_reason(
        policy_violation=F.col("unit") == 19, invalid_provenance=F.col("source") == 3, degraded=F.expr("flag = 'N' and value > 0.07"), duplicate=F.col("nth") > 1, redundant=F.col("family") % 10 == 1,
        low_relevance=F.col("score") < 5000, crowded=F.col("crowd") > 3, over_budget=F.col("spent") > 2000, conflict_side=F.col("flag") == "A", temporal_segment=F.col("value") < 0.02,
        independent=F.col("family") % 3 == 0, covers=F.col("unit") < 10,
    )
    return e.select("evidence_id", reason.alias("reason"))


_CATEGORIES = (
    "SELECT unit, kind, count(*) AS n_claims, CASE WHEN kind = 'QUANTITY' AND max(value) - min(value) > 0.05 THEN 'QUANTITATIVE_CONFLICT' WHEN kind = 'TIME' AND max(low) > min(high) THEN 'TEMPORAL_CONFLICT' "
    "WHEN kind = 'FACT' AND count(DISTINCT stance) > 1 THEN 'FACTUAL_CONFLICT' WHEN kind = 'EXPLANATION' AND count(DISTINCT stance) > 1 THEN 'INTERPRETATION_DIVERGENCE' ELSE 'NOT_A_CONFLICT' END AS category FROM "
    "(SELECT query_id * 20 + unit AS unit, (['QUANTITY', 'TIME', 'FACT', 'EXPLANATION'])[family % 4 + 1] AS kind, value, tokens AS low, tokens + 20 AS high, source % 2 AS stance FROM evidence) GROUP BY unit, kind"
)


@query("CTX5_conflict_groups", _CATEGORIES, "evidence")
@query("JOIN11_conflicts", _CATEGORIES, "evidence")
def _(spark, d):
    kind = t.pick(["QUANTITY", "TIME", "FACT", "EXPLANATION"], F.col("family") % 4)
    claims = t.evidence(spark, d).select(F.expr("query_id * 20 + unit").alias("unit"), kind.alias("kind"), "value", F.col("tokens").alias("low"), (F.col("tokens") + 20).alias("high"), (F.col("source") % 2).alias("stance"))
    return decisions.conflict_categories(claims, 0.05)


@query("CTX14_critical_budget", "SELECT query_id, CAST(sum(CASE WHEN flag = 'R' THEN tokens ELSE 0 END) AS BIGINT) > 2500 AS failed FROM evidence GROUP BY query_id", "evidence")
def _(spark, d):
    return t.evidence(spark, d).groupBy("query_id").agg((F.sum(F.when(F.col("flag") == "R", F.col("tokens")).otherwise(0)) > 2500).alias("failed"))


@query("CTX15_context_items", "SELECT query_id, family, count(*) AS n_related, min(evidence_id) AS representative FROM evidence GROUP BY ALL", "evidence")
def _(spark, d):
    item = t.evidence(spark, d).groupBy("query_id", "family").agg(F.struct(F.min("evidence_id").alias("id"), F.count(F.lit(1)).alias("n")).alias("item"))
    return item.select("query_id", "family", F.col("item.n").alias("n_related"), F.col("item.id").alias("representative"))


@query("CTX16_source_failures", "SELECT DISTINCT user_id, event_type FROM events WHERE event_type = 'error' AND user_id NOT IN (SELECT query_id FROM evidence WHERE value > 0.079)", "evidence")
def _(spark, d):
    failed = t.read(spark, d, "events").where("event_type = 'error'").select("user_id", "event_type").distinct()
    chosen = t.evidence(spark, d).where("value > 0.079").select(F.col("query_id").alias("user_id")).distinct()
    return failed.join(chosen, "user_id", "left_anti")


@query("CTX17_no_new_ids", "SELECT evidence_id FROM evidence WHERE family NOT IN (SELECT p_partkey FROM part WHERE p_size < 45)", "evidence")
def _(spark, d):
    gathered = t.read(spark, d, "part").where("p_size < 45").select(F.col("p_partkey").alias("family"))
    return t.evidence(spark, d).join(gathered, "family", "left_anti").select("evidence_id")


@query(
    "CTX18_trace",
    "SELECT query_id, decision, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens, min(place) AS first_place, max(place) AS last_place, 'budget=2000' AS config FROM (SELECT query_id, tokens, row_number() OVER w AS place, CASE WHEN sum(tokens) OVER (w ROWS UNBOUNDED PRECEDING) <= 2000 THEN 'SELECTED_PRIMARY' ELSE 'DROPPED_BUDGET' END AS decision FROM evidence WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, evidence_id)) GROUP BY query_id, decision",
    "evidence",
)
def _(spark, d):
    order = [F.desc("score"), F.col("evidence_id")]
    chosen = evidence.select_within(t.evidence(spark, d), 2000, order).withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return evidence.assembly_trace(chosen, "budget=2000")


@query("GEN12_conflict_sides", "SELECT unit, value, count(DISTINCT source) AS n_citations FROM evidence GROUP BY ALL", "evidence")
def _(spark, d):
    return t.evidence(spark, d).groupBy("unit", "value").agg(F.countDistinct("source").alias("n_citations"))


@query("GEN14_claim_types", "SELECT evidence_id, CASE WHEN flag = 'N' THEN 'UNKNOWN_CLAIM_TYPE' WHEN flag = 'R' AND value = 0 AND tokens < 10 THEN 'ABSENCE_TOLD_AS_FACT' WHEN flag = 'R' AND tokens < 10 THEN 'UNSUPPORTED_CLAIM' END AS error FROM evidence", "evidence")
def _(spark, d):
    kind = F.when(F.col("flag") == "R", "WORLD").when(F.col("flag") == "A", "EVIDENCE_STATE").otherwise("OPINION")
    premises = F.when(F.col("tokens") < 10, 0).otherwise(2)
    return t.evidence(spark, d).select("evidence_id", decisions.claim_type_violation(kind, F.col("value") == 0, premises).alias("error"))


@query("GEN16_merged_dates", "SELECT r.mention_id FROM mentions r WHERE r.precision = 'RANGE' AND EXISTS (SELECT 1 FROM mentions a WHERE a.item = r.item AND a.precision = 'DAY' AND a.start_year = r.start_year) AND EXISTS (SELECT 1 FROM mentions b WHERE b.item = r.item AND b.precision = 'DAY' AND b.start_year = r.end_year)", "mentions")
def _(spark, d):
    m = t.mentions(spark, d)
    day = m.where("precision = 'DAY'").select("item", "start_year").distinct()
    out = m.where("precision = 'RANGE'").join(day, ["item", "start_year"], "left_semi")
    return out.join(day.withColumnRenamed("start_year", "end_year"), ["item", "end_year"], "left_semi").select("mention_id")


@query(
    "GEN18_rerun_identical",
    "SELECT sha256(concat_ws('|', CAST(unit AS VARCHAR), coalesce(flag, '-'))) AS lineage, count(*) AS n_runs, count(DISTINCT output) = 1 AS reproduced FROM (SELECT unit, CASE WHEN flag <> 'A' THEN flag END AS flag, CASE WHEN unit % 2 = 0 THEN unit * 7 ELSE source END AS output FROM evidence) GROUP BY unit, flag",
    "evidence",
)
def _(spark, d):
    runs_ = t.evidence(spark, d).select("unit", F.expr("if(flag <> 'A', flag, null)").alias("flag"), F.expr("if(unit % 2 = 0, unit * 7, source)").alias("output"))
    return decisions.reproduced(runs_, ["unit", "flag"])


@query("GEN19_citation_degradation", "SELECT evidence_id, CASE WHEN source IS NULL THEN 'GROUNDING_FAILURE' WHEN unit = 0 THEN 'CITATION_DEGRADED' ELSE 'RESOLVED' END AS state FROM evidence", "evidence")
def _(spark, d):
    state = F.when(F.col("source").isNull(), F.lit("GROUNDING_FAILURE")).when(F.col("unit") == 0, F.lit("CITATION_DEGRADED")).otherwise(F.lit("RESOLVED"))
    return t.evidence(spark, d).select("evidence_id", state.alias("state"))


@query("EVAL_chunk_sizes", "SELECT length(source_text) // 100 AS bin, count(*) AS n FROM chunks GROUP BY ALL", "chunks")
def _(spark, d):
    return t.chunks(spark, d).groupBy(F.expr("cast(floor(length(source_text) / 100) as bigint)").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("EVAL_leakage", "SELECT source AS corpus_id, source IN ('src0', 'src1', 'src2', 'src3') AS asked, 0 AS n_leaked FROM documents WHERE source IS NOT NULL GROUP BY source")
def _(spark, d):
    """Candidates of all requests that aren't eligible, by corpus; and of a corpus that wasn't asked for every candidate is one."""
    found = QUERIES["SNK2_retrieve"](spark, d).select("item", "document_id")
    corpora = t.documents(spark, d).select("document_id", "corpus_id")
    allowed = QUERIES["JOIN5_eligibility"](spark, d).select(F.col("chunk_id").alias("item"), F.lit(True).alias("fine"))
    asked = F.col("corpus_id").isin(_SCOPE)
    per = found.join(corpora, "document_id").join(allowed, "item", "left").groupBy("corpus_id").agg(F.count_if(F.col("fine").isNull() | ~asked).alias("n"))
    every = corpora.select("corpus_id").distinct().where("corpus_id is not null").join(per, "corpus_id", "left")
    return every.select("corpus_id", asked.alias("asked"), F.coalesce("n", F.lit(0)).cast("int").alias("n_leaked"))




@query("ING33_tombstones", "SELECT document_id, CASE WHEN document_id % 18 = 0 THEN 'DELETED' WHEN document_id % 9 = 0 THEN 'DELETING' END AS deletion FROM docs", "docs")
def _(spark, d):
    docs = t.documents(spark, d)
    return lifecycle.deletion_states(docs, docs.where("document_id % 9 = 0"), t.chunks(spark, d).where("document_id % 18 <> 0")).select("document_id", "deletion")


@query("ING34_capabilities", "SELECT document_id, 'READY' AS semantic, 'READY' AS lexical, CASE WHEN document_id % 6 = 0 THEN 'DEGRADED' ELSE 'READY' END AS temporal, CASE WHEN document_id % 4 = 0 THEN 'DEGRADED' ELSE 'READY' END AS provenance FROM docs", "docs")
def _(spark, d):
    lost = F.array_compact(F.array(F.when(F.col("document_id") % 6 == 0, F.lit("TEMPORAL")), F.when(F.col("document_id") % 4 == 0, F.lit("PROVENANCE_LOCATION"))))
    c = t.documents(spark, d).select("document_id", lifecycle.capabilities(lost).alias("c"))
    return c.select("document_id", *[F.col("c")[k].alias(n) for k, n in (("SEMANTIC", "semantic"), ("LEXICAL", "lexical"), ("TEMPORAL", "temporal"), ("PROVENANCE_LOCATION", "provenance"))])


@query(
    "ING29_table_split",
    "SELECT doc_id, table_id, p AS piece, concat_ws(chr(10), header, body) AS text FROM (SELECT doc_id, table_id, p, any_value(header) AS header, string_agg(line, chr(10) ORDER BY no) FILTER (WHERE no > 0) AS body FROM (SELECT *, greatest((no - 1) // 3, 0) AS p FROM "
    "(SELECT doc_id, ordinal // 10 AS table_id, line, ordinal % 10 AS no, first_value(line) OVER (PARTITION BY doc_id, ordinal // 10 ORDER BY ordinal) AS header FROM lines)) GROUP BY doc_id, table_id, p)",
    "lines",
)
def _(spark, d):
    rows = t.lines(spark, d).select("doc_id", F.expr("cast(floor(ordinal / 10) as long)").alias("table_id"), F.col("ordinal").alias("at"), F.col("line").alias("text"))
    return chunks.split_tables(rows, 3)


@query("TOP4_newest_corpora", "SELECT user_id AS corpus_id, min(ts) AS created_at FROM events GROUP BY user_id")
def _(spark, d):
    """A corpus begins with its first event; newest first."""
    return t.read(spark, d, "events").groupBy(F.col("user_id").alias("corpus_id")).agg(F.min("ts").alias("created_at")).orderBy(F.desc("created_at"), "corpus_id")


def _marked(spark, d, line):
    lines = t.lines(spark, d).select("doc_id", "ordinal", F.expr(line).alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "line"))), lambda x: x.line), "\n")
    return lines.groupBy("doc_id").agg(text.alias("text"))


@query("ING4_list_items", "SELECT doc_id, 'LIST_ITEM' AS type, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS text, count(*) AS n FROM lines GROUP BY ALL", "lines")
def _(spark, d):
    b = blocks.markdown_blocks(_marked(spark, d, "concat(if(ordinal % 2 = 0, '- ', '12) '), line)"))
    return b.groupBy("doc_id", "type", "text").agg(F.count(F.lit(1)).alias("n"))


@query("ING5_table_rows", "SELECT doc_id, 'TABLE_TEXT' AS type, '| ' || line || ' |' AS text, count(*) AS n FROM lines WHERE ordinal % 3 <> 1 GROUP BY ALL", "lines")
def _(spark, d):
    b = blocks.markdown_blocks(_marked(spark, d, "if(ordinal % 3 = 1, '|:--|--|', concat('| ', line, ' |'))"))
    return b.groupBy("doc_id", "type", "text").agg(F.count(F.lit(1)).alias("n"))


@query("ING6_fences", "SELECT doc_id, 'UNKNOWN_TEXT' AS type, string_agg(line, ' ' ORDER BY ordinal) AS text FROM lines GROUP BY doc_id", "lines")
def _(spark, d):
    """Every third document's fence isn't closed."""
    whole = _marked(spark, d, "line").withColumn("text", F.concat(F.lit("```\n"), "text", F.when(F.col("doc_id") % 3 == 0, "").otherwise("\n```")))
    return blocks.markdown_blocks(whole).select("doc_id", "type", "text")


@query("TMP6_relative", "SELECT o_orderkey AS doc_id, 'two years later' AS text, 'UNKNOWN' AS precision, 'UNCERTAIN' AS certainty, NULL::INT AS start_year FROM orders")
def _(spark, d):
    b = t.read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("b0000").alias("block_id"), F.lit("It ended two years later.").alias("text"))
    return tmp.recognize(b).select("doc_id", "text", "precision", "certainty", "start_year")


@query("TMP8_day_is_no_year", "SELECT o_orderkey AS doc_id, year(o_orderdate) AS start_year FROM orders WHERE o_orderkey % 2 = 0")
def _(spark, d):
    text = F.expr("concat('In ', date_format(o_orderdate, 'MMMM'), ' ', if(o_orderkey % 2 = 0, year(o_orderdate), day(o_orderdate)), ' it was cold')")
    b = t.read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("b0000").alias("block_id"), text.alias("text"))
    return tmp.recognize(b).select("doc_id", "start_year")


@query("AGG5_page_spans", "SELECT doc_id, ordinal // 4 AS ordinal, min(ordinal // 3) AS page_start, max(ordinal // 3) AS page_end, CAST(sum(length(line)) AS BIGINT) AS token_count, count(*) AS n_spans FROM lines GROUP BY doc_id, ordinal // 4", "lines")
def _(spark, d):
    p = t.lines(spark, d).select("doc_id", F.lit("t").alias("title"), F.expr("cast(floor(ordinal / 4) as long)").alias("ordinal"), F.array(F.lit("s")).alias("section"), F.col("ordinal").alias("at"), F.lit("b").alias("block_id"), F.lit(0).alias("start"), F.length("line").alias("end"), F.col("line").alias("text"), F.length("line").alias("tokens"), F.expr("cast(floor(ordinal / 3) as int)").alias("page"))
    return chunks.group_pieces(p).select("doc_id", "ordinal", "page_start", "page_end", F.col("token_count").cast("long").alias("token_count"), F.size("source_spans").cast("long").alias("n_spans"))


@query("ING15_tokenizer")
def _(spark, d):
    """Chunks whose sizes are tokens of a byte-pair vocabulary."""
    b = blocks.text_blocks(t.read(spark, d, "documents").select("doc_id", "text"))
    b = b.select("doc_id", F.lit("t").alias("title"), "block_id", "type", "text", F.array_compact(F.array("section")).alias("section_path"))
    return chunks.chunk_blocks(b, target=256, most=400, overlap=32, by="byte_bpe_50k").select("doc_id", "ordinal", "token_count", "content_hash")
