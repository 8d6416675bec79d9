"""Queries of effects and identities: web sources, validation, ablations, stage metrics, applied reconciliation, vectors, the queue."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import urls
from ..operators import evidence, fusion, ingestion, represent, routes, validation
from ..session import shared_folder
from ..streaming import queue, runs
from . import tables as t
from .queries import ORACLE, _routes, query

# ---- web sources


def spellings(spark, d):
    """Every page's url in six spellings: as it is, host in capitals, default port, dot segments, another query order with tracking, a fragment."""
    p = t.read(spark, d, "pages").select("page_id", "url", F.regexp_extract("url", "^([^:]*)://", 1).alias("s"), F.regexp_extract("url", "://([^/?#]*)", 1).alias("h"))
    p = p.withColumns({"rest": F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1), "q": F.regexp_extract("url", r"\?([^#]*)", 1)})
    full = lambda host, path, q: F.concat("s", F.lit("://"), host, path, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))
    h, rest, q = F.col("h"), F.col("rest"), F.col("q")
    turned = F.array_join(F.reverse(F.split(F.concat(q, F.lit("&utm_source=mail&zz=1")), "&")), "&")
    each = [
        full(h, rest, F.concat(q, F.lit("&zz=1"))), full(F.upper(h), rest, F.concat(q, F.lit("&zz=1"))), full(F.concat(h, F.when(F.col("s") == "https", ":443").otherwise(":80")), rest, F.concat(q, F.lit("&zz=1"))),
        full(h, F.concat(F.lit("/x/../."), rest), F.concat(q, F.lit("&zz=1"))), full(h, rest, turned), F.concat(full(h, rest, F.concat(q, F.lit("&zz=1"))), F.lit("#part")),
    ]
    return p.select("page_id", F.posexplode(F.array(*each)).alias("run", "url"))


_CANON = (
    "base AS (SELECT page_id, lower(regexp_extract(url, '^([^:]*)://', 1)) || '://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) || CASE WHEN regexp_extract(url, '://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '://[^/?#]*([^?#]*)', 1) END AS head, "
    "list_sort(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1) || '&zz=1', '&'), lambda x: x <> '' AND NOT list_contains(['" + "','".join(urls.TRACKING) + "'], lower(regexp_extract(x, '^([^=]*)', 1))))) AS q FROM pages), "
    "canon AS (SELECT page_id, head || '?' || array_to_string(q, '&') AS source FROM base)"
)


@query("SRC14_canonical_url", f"WITH {_CANON} SELECT page_id, run, source FROM canon, (SELECT unnest(range(0, 6)) AS run)")
def _(spark, d):
    return spellings(spark, d).select("page_id", F.col("run").cast("long").alias("run"), urls.canonical(F.col("url")).alias("source"))


@query("SRC14_completeness", "SELECT page_id, CASE WHEN NOT contains(lower(coalesce(html, '')), '<html') THEN 'UNKNOWN' WHEN ends_with(rtrim(lower(html), ' ' || chr(9) || chr(13) || chr(10)), '</html>') THEN 'FULL' ELSE 'PARTIAL' END AS completeness FROM pages")
def _(spark, d):
    return t.read(spark, d, "pages").select("page_id", urls.completeness(F.col("html")).alias("completeness"))


@query("JOIN8_web_identity", f"WITH {_CANON} SELECT source, min(page_id) AS representative, count(*) * 6 AS n_associations, string_agg(page_id || ':' || run, ',' ORDER BY page_id, run) AS associations FROM canon, (SELECT unnest(range(0, 6)) AS run) GROUP BY source")
def _(spark, d):
    """Pages found in six runs, each time spelled in another way: one row a source, with all of its associations."""
    found = spellings(spark, d).select(F.col("page_id").alias("evidence_id"), F.col("run").cast("long").alias("run"), "url")
    told = F.array_join(F.transform("associations", lambda a: F.concat(a.evidence_id, F.lit(":"), a.run)), ",")
    return evidence.consolidated(found).select(F.col("identity").alias("source"), "representative", F.col("n").alias("n_associations"), told.alias("associations"))


ORACLE["JOIN8_web_identity"] = ORACLE["JOIN8_web_identity"].replace("count(*) * 6 AS", "count(*) AS")

# ---- validation

FIELDS = [validation.Field("k", "integer", low=0, high=90), validation.Field("name", "text", size=6), validation.Field("kind", "text", allowed=("view", "click", "signup")), validation.Field("tags", "list", required=False, size=2)]
_RECORD = {
    0: '{"k": %s, "name": "ab", "kind": "view"}', 1: '{"k": "%s", "name": "ab", "kind": "view"}', 2: '{"k": %s, "kind": "error"}', 3: '{"k": %s, "name": "abcdefgh", "kind": "click", "tags": [1, 2, 3]}',
    4: '{"k": %s, "name": "ab", "kind": "view"', 5: '{"k": %s, "name": null, "kind": 7, "more": true}', 6: '[%s]', 7: '{"k": %s, "name": "a b", "kind": "signup", "tags": "x"}', 8: '{"k": %s.5, "name": "", "kind": "view", "tags": []}',
}
_CODES = {
    0: "", 1: "WRONG_TYPE:k", 2: "MISSING:name,NOT_ALLOWED:kind", 3: "TOO_LONG:name,TOO_LONG:tags", 4: "MALFORMED", 5: "MISSING:name,UNKNOWN:more,WRONG_TYPE:kind", 6: "MALFORMED", 7: "WRONG_TYPE:tags", 8: "WRONG_TYPE:k",
}


def _with_bound(n: int) -> str:
    """The codes of record n in SQL, with the one of a k over 90 where k is a whole number."""
    codes = _CODES[n]
    if n in (1, 4, 6, 8):
        return f"'{codes}'"
    over = ",".join(sorted([c for c in codes.split(",") if c] + ["OUT_OF_RANGE:k"]))
    return f"CASE WHEN k > 90 THEN '{over}' ELSE '{codes}' END"


_PLANTED = "SELECT event_id, event_id % 9 AS n, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events"


@query("GEN2_codes", "SELECT event_id, CASE n " + " ".join(f"WHEN {n} THEN {_with_bound(n)}" for n in _CODES) + f" END AS codes FROM ({_PLANTED})")
def _(spark, d):
    """The number of every event's props in nine records, most of them with faults."""
    e = t.read(spark, d, "events").select("event_id", F.regexp_extract("props", "([0-9]+)", 1).alias("k"), (F.col("event_id") % 9).alias("n"))
    text = F.lit(None).cast("string")
    for n, record in _RECORD.items():
        before, after = record.split("%s")
        text = F.when(F.col("n") == n, F.concat(F.lit(before), "k", F.lit(after))).otherwise(text)
    return validation.validated(e.select("event_id", text.alias("record")), "record", FIELDS).select("event_id", F.array_join("codes", ",").alias("codes"))


# ---- ablations

SUBSETS = {"dense": ["dense"], "lexical": ["lexical"], "dense+lexical": ["dense", "lexical"], "all": ["dense", "lexical", "temporal"]}
_SETS = "(VALUES " + ", ".join(f"('{name}', '{route}')" for name, held in SUBSETS.items() for route in held) + ") AS s(subset, route)"
_ABLATED = t.sql("SELECT 1", "evidence").removesuffix(" SELECT 1") + (
    ", ranked AS (SELECT * FROM (SELECT query_id, 'dense' AS route, evidence_id AS item, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, evidence_id) AS r FROM evidence UNION ALL "
    "SELECT query_id, 'lexical', evidence_id, row_number() OVER (PARTITION BY query_id ORDER BY tokens DESC, evidence_id) FROM evidence UNION ALL "
    "SELECT query_id, 'temporal', evidence_id, row_number() OVER (PARTITION BY query_id ORDER BY value, evidence_id) FROM evidence WHERE flag = 'R') WHERE r <= 40), "
    f"fused AS (SELECT subset, query_id, item, round(sum(1.0::DOUBLE / (60 + r)), 12) AS score FROM ranked JOIN {_SETS} USING (route) GROUP BY ALL), "
    "placed AS (SELECT *, row_number() OVER (PARTITION BY subset, query_id ORDER BY score DESC, item) AS rank FROM fused), "
    "judged AS (SELECT query_id, evidence_id AS item, value < 0.03 AND flag = 'R' AS dated FROM evidence WHERE value < 0.03), "
    "hit AS (SELECT subset, query_id, count(*) AS found, count(*) FILTER (WHERE dated) AS found_dated FROM placed JOIN judged USING (query_id, item) WHERE rank <= 10 GROUP BY ALL), "
    "wanted AS (SELECT query_id, count(*) AS n, count(*) FILTER (WHERE dated) AS n_dated FROM judged GROUP BY ALL) "
    f"SELECT subset, query_id, round(coalesce(found, 0) / n::DOUBLE, 9) AS recall, CASE WHEN n_dated > 0 THEN round(coalesce(found_dated, 0) / n_dated::DOUBLE, 9) END AS temporal_recall FROM wanted CROSS JOIN (SELECT DISTINCT subset FROM {_SETS}) LEFT JOIN hit USING (subset, query_id)"
)


@query("EVAL_ablations")
def _(spark, d):
    """Recall and recall of dated items at 10 of all queries for every subset of routes, in one plan."""
    e, dense, lexical = _routes(spark, d)
    dated = t.evidence(spark, d).where("flag = 'R'").select("query_id", F.col("evidence_id").alias("item"), (-F.col("value").cast("double")).alias("score"))
    ranked = fusion.ranked_union(dense=dense, lexical=lexical, temporal=routes.top(dated, 40, "item"))
    judged = t.evidence(spark, d).where("value < 0.03").select("query_id", F.col("evidence_id").alias("item"), (F.col("flag") == "R").alias("dated"))
    return fusion.ablations(ranked, SUBSETS, judged, 10)


ORACLE["EVAL_ablations"] = _ABLATED

# ---- effects


@query("ING36_stage_metrics", "SELECT * FROM (SELECT 'blocks' AS stage, 'rows' AS metric, count(*) AS n FROM lines UNION ALL SELECT 'blocks', 'empty', count(*) FILTER (WHERE trim(line) = '') FROM lines UNION ALL SELECT 'chunks', 'rows', count(*) FROM chunks UNION ALL SELECT 'chunks', 'characters', CAST(coalesce(sum(length(source_text)), 0) AS BIGINT) FROM chunks UNION ALL SELECT 'mentions', 'rows', count(*) FROM mentions UNION ALL SELECT 'mentions', 'unresolved', count(*) FILTER (WHERE start_year IS NULL) FROM mentions UNION ALL SELECT 'vectors', 'rows', count(*) FROM reps)", "lines", "chunks", "mentions", "reps")
def _(spark, d):
    """What each stage of ingestion wrote, counted by its own write."""
    log, one = runs.StageLog(spark), F.count(F.lit(1))
    log.run("blocks", t.lines(spark, d), rows=one, empty=F.count_if(F.trim("line") == ""))
    log.run("chunks", t.chunks(spark, d), rows=one, characters=F.coalesce(F.sum(F.length("source_text")), F.lit(0)))
    log.run("mentions", t.mentions(spark, d), rows=one, unresolved=F.count_if(F.col("start_year").isNull()))
    log.run("vectors", t.representations(spark, d), rows=one)
    return log.metrics()


_DRAFTS = (
    "old AS (SELECT * FROM chunks WHERE ordinal % 6 <> 1), drafts AS (SELECT version_id, pg, ordinal, CASE WHEN ordinal % 4 = 0 THEN sha256(source_text || '!') ELSE content_hash END AS content_hash FROM chunks WHERE ordinal % 5 <> 3 AND version_id % 2 = 0) "
    "SELECT d.version_id, d.pg, d.ordinal, coalesce(o.chunk_id, d.version_id || ':' || d.pg || ':' || d.ordinal) AS chunk_id, d.content_hash FROM drafts d LEFT JOIN old o USING (version_id, pg, ordinal) "
    "UNION ALL SELECT version_id, pg, ordinal, chunk_id, content_hash FROM old ANTI JOIN (SELECT DISTINCT version_id, pg FROM drafts) b USING (version_id, pg)"
)


@query("JOIN3_applied", "SELECT 1", "chunks")
def _(spark, d):
    """The chunk table after new drafts of every second version were applied to it."""
    folder = f"{shared_folder(spark)}/applied-{uuid.uuid4().hex[:12]}"
    c = t.chunks(spark, d)
    old = c.where("ordinal % 6 <> 1")
    ingestion.write_parts(old, f"{folder}/chunks")
    for name in ("representations", "mentions"):
        ingestion.write_parts(old.select("chunk_id", "version_id"), f"{folder}/{name}")
    drafts = c.where("ordinal % 5 <> 3 and version_id % 2 = 0").withColumn("content_hash", F.expr("if(ordinal % 4 = 0, sha2(concat(source_text, '!'), 256), content_hash)"))
    ingestion.apply_chunks(spark, folder, drafts.drop("chunk_id"))
    return spark.read.parquet(f"{folder}/chunks").select("version_id", "pg", "ordinal", "chunk_id", "content_hash")


ORACLE["JOIN3_applied"] = ORACLE["JOIN3_applied"].removesuffix(" SELECT 1") + f", {_DRAFTS}"


#: Bytes of chunks in a file that is embedded, about.
FILE = 32_000_000


@query("ING19_committed_vectors", "SELECT version_id, count(*) AS n_chunks, count(*) AS n_vectors FROM chunks WHERE source_text IS NOT NULL GROUP BY version_id", "chunks")
def _(spark, d):
    """A vector of every chunk, committed batch by batch of the chunk table's files: files of a bounded size, dealt to two batches."""
    folder = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex[:12]}"
    c = t.chunks(spark, d).select("chunk_id", "version_id", "source_text").where("source_text is not null")
    size = c.agg(F.coalesce(F.sum(F.octet_length("source_text") + 64), F.lit(0))).first()[0]
    n = max(4, -(-size // FILE))
    c.repartition(n, "chunk_id").write.parquet(f"{folder}/chunks")
    embed = lambda df: represent.fake_embedding(df.select(F.col("chunk_id").alias("item"), "text"), 16).withColumnRenamed("item", "chunk_id")
    v = ingestion.embed_batches(spark, f"{folder}/chunks", f"{folder}/out", f"{folder}/ledger", "srg1", embed, files=-(-n // 2))
    both = c.join(v.select("chunk_id", F.lit(1).alias("there")), "chunk_id", "left")
    return both.groupBy("version_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.count("there").alias("n_vectors"))


@query("STR1_queue")
def _(spark, d):
    """Every event as one of a worker's job, through keyed state: claims, claims that went back, retries and ends, up to the last watermark."""
    folder = f"{shared_folder(spark)}/queue-{uuid.uuid4().hex[:12]}"
    stream = queue.job_events(runs.poll(spark, d, "events.parquet", "event_id long, ts timestamp_ntz, user_id long, event_type string"))
    was = {k: spark.conf.get(k, None) for k in queue.STATE_STORE}
    for k, v in queue.STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        return queue.kept(queue.transitions(stream, "10 minutes", 6 * 3600), f"{folder}/out", f"{folder}/checkpoint", f"queue-{uuid.uuid4().hex[:8]}")
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
