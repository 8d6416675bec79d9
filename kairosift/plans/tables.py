"""The engine's tables, made from the given ones; each with the SQL that makes the same in another engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.temporal import with_bounds
from ..schema import PRECISION, VERSION_STATUS


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pick(values: list[str], index) -> F.Column:
    return F.array(*[F.lit(v) for v in values])[index.cast("int")]


def lines(spark, d) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("ordinal", "line"))
    return docs


def documents(spark, d) -> DataFrame:
    return read(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("corpus_id"), F.expr("doc_id * 10 + doc_id % 3").alias("active_version_id"))


def _versioned(df: DataFrame) -> DataFrame:
    return df.withColumn("no", F.explode(F.sequence(F.lit(0), F.expr("cast(doc_id % 3 as int)"))))


def versions(spark, d) -> DataFrame:
    return _versioned(read(spark, d, "documents")).select(
        F.expr("doc_id * 10 + no").alias("version_id"), F.col("no").alias("version_no"), F.col("doc_id").alias("document_id"), F.col("source").alias("corpus_id"),
        pick(VERSION_STATUS, F.expr("(doc_id * 7 + no * 3) % 5")).alias("status"), F.expr("concat('pg', (doc_id + no) % 2)").alias("published_pg"),
        F.expr("doc_id * 10 + doc_id % 3").alias("active_version_id"), F.expr("sha2(concat(text, no % 2), 256)").alias("source_hash"),
    )


def chunks(spark, d) -> DataFrame:
    return _versioned(lines(spark, d)).select(
        F.expr("concat(doc_id * 10 + no, ':', ordinal)").alias("chunk_id"), F.expr("doc_id * 10 + no").alias("version_id"), F.col("doc_id").alias("document_id"),
        F.col("source").alias("corpus_id"), F.col("ordinal").cast("long").alias("ordinal"), F.expr("if(ordinal % 7 = 6, 'pg9', concat('pg', (doc_id + no) % 2))").alias("pg"),
        F.col("line").alias("source_text"), F.sha2("line", 256).alias("content_hash"), F.lit(0).alias("span_start"), F.length("line").alias("span_end"),
    )


def representations(spark, d) -> DataFrame:
    return chunks(spark, d).where("ordinal % 11 <> 10").select("chunk_id", F.expr("if(ordinal % 5 = 4, 'srg0', 'srg1')").alias("srg"))


def mentions(spark, d) -> DataFrame:
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.expr("year(o_orderdate) - 2000").alias("y0"), F.expr("o_orderkey % 8").alias("k"))
    o = o.withColumn("y", F.expr("if(y0 > 0, y0, y0 - 1)"))
    return o.select(
        F.col("o_orderkey").alias("mention_id"), F.col("o_custkey").alias("item"), pick(PRECISION, F.col("k")).alias("precision"),
        F.expr("if(o_orderkey % 3 = 0, 'SOURCE_METADATA', 'CONTENT_MENTION')").alias("origin"),
        F.expr("if(k = 7, null, y)").alias("start_year"), F.expr("if(k in (0, 1), month(o_orderdate), null)").alias("start_month"), F.expr("if(k = 0, day(o_orderdate), null)").alias("start_day"),
        F.expr("case k when 4 then y + 9 when 5 then y + 99 when 6 then y + 2 end").alias("end_year"), F.lit(None).cast("int").alias("end_month"), F.lit(None).cast("int").alias("end_day"),
    )


def bounded(spark, d, plain: bool = False) -> DataFrame:
    return with_bounds(mentions(spark, d), plain)


def evidence(spark, d) -> DataFrame:
    """Line items; those that share a number are one piece of evidence."""
    items = read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("family"), F.min("l_suppkey").alias("source"), F.min("l_extendedprice").alias("score"),
        F.min(F.expr("cast(l_quantity as int)")).alias("tokens"), F.min("l_tax").alias("value"), F.min("l_returnflag").alias("flag"),
    )
    return items.select(F.expr("l_orderkey * 10 + l_linenumber").alias("evidence_id"), F.expr("l_orderkey % 200").alias("query_id"), "family", F.expr("source % 20").alias("unit"), "source", "score", "tokens", "value", "flag")


def runs(spark, d) -> DataFrame:
    e = read(spark, d, "events")
    return e.select(
        F.col("event_id").alias("run_id"), F.col("user_id").alias("version_id"), "ts", "event_type", "value",
        F.expr("event_id % 4 + 1").alias("attempt"), (F.col("event_type") == "purchase").alias("finished"),
    )


SQL = {
    "lines": "lines AS (SELECT doc_id, source, lang, i - 1 AS ordinal, string_split(text, chr(10))[i] AS line FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))",
    "docs": "docs AS (SELECT doc_id AS document_id, source AS corpus_id, doc_id * 10 + doc_id % 3 AS active_version_id FROM documents)",
    "versions": "versions AS (SELECT doc_id * 10 + no AS version_id, no AS version_no, doc_id AS document_id, source AS corpus_id, "
    "(['PENDING','RUNNING','READY','READY_DEGRADED','FAILED'])[(doc_id * 7 + no * 3) % 5 + 1] AS status, 'pg' || ((doc_id + no) % 2) AS published_pg, "
    "doc_id * 10 + doc_id % 3 AS active_version_id, sha256(text || (no % 2)) AS source_hash FROM (SELECT *, unnest(range(0, doc_id % 3 + 1)) AS no FROM documents))",
    "chunks": "chunks AS (SELECT (doc_id * 10 + no) || ':' || ordinal AS chunk_id, doc_id * 10 + no AS version_id, doc_id AS document_id, source AS corpus_id, ordinal, "
    "CASE WHEN ordinal % 7 = 6 THEN 'pg9' ELSE 'pg' || ((doc_id + no) % 2) END AS pg, line AS source_text, sha256(line) AS content_hash FROM (SELECT *, unnest(range(0, doc_id % 3 + 1)) AS no FROM lines))",
    "reps": "reps AS (SELECT chunk_id, CASE WHEN ordinal % 5 = 4 THEN 'srg0' ELSE 'srg1' END AS srg FROM chunks WHERE ordinal % 11 <> 10)",
    "mentions": "mentions AS (SELECT o_orderkey AS mention_id, o_custkey AS item, (['DAY','MONTH','YEAR','SEASON','DECADE','CENTURY','RANGE','UNKNOWN'])[k + 1] AS precision, "
    "CASE WHEN o_orderkey % 3 = 0 THEN 'SOURCE_METADATA' ELSE 'CONTENT_MENTION' END AS origin, CASE WHEN k <> 7 THEN y END AS start_year, CASE WHEN k IN (0, 1) THEN month(o_orderdate) END AS start_month, "
    "CASE WHEN k = 0 THEN day(o_orderdate) END AS start_day, CASE k WHEN 4 THEN y + 9 WHEN 5 THEN y + 99 WHEN 6 THEN y + 2 END AS end_year FROM "
    "(SELECT *, o_orderkey % 8 AS k, CASE WHEN year(o_orderdate) > 2000 THEN year(o_orderdate) - 2000 ELSE year(o_orderdate) - 2001 END AS y FROM orders))",
    "bounded": "bounded AS (SELECT *, start_year * 372 + (coalesce(start_month, 1) - 1) * 31 + coalesce(start_day, 1) - 1 AS bound_low, CASE WHEN start_year IS NOT NULL THEN "
    "coalesce(end_year, start_year) * 372 + (coalesce(CASE WHEN end_year IS NULL THEN start_month END, 12) - 1) * 31 + coalesce(CASE WHEN end_year IS NULL THEN start_day END, 31) - 1 END AS bound_high FROM mentions)",
    "evidence": "evidence AS (SELECT l_orderkey * 10 + l_linenumber AS evidence_id, l_orderkey % 200 AS query_id, min(l_partkey) AS family, min(l_suppkey) % 20 AS unit, min(l_suppkey) AS source, "
    "min(l_extendedprice) AS score, min(CAST(floor(l_quantity) AS INT)) AS tokens, min(l_tax) AS value, min(l_returnflag) AS flag FROM lineitem GROUP BY l_orderkey, l_linenumber)",
    "runs": "runs AS (SELECT event_id AS run_id, user_id AS version_id, ts, event_type, value, event_id % 4 + 1 AS attempt, event_type = 'purchase' AS finished FROM events)",
    "posts": "posts AS (SELECT doc_id || ':' || ordinal AS item, term, count(*) AS tf, min(pos) AS first FROM (SELECT doc_id, ordinal, p - 1 AS pos, w[p] AS term FROM "
    "(SELECT doc_id, ordinal, w, unnest(range(1, len(w) + 1)) AS p FROM (SELECT doc_id, ordinal, list_filter(string_split_regex(lower(line), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM lines))) GROUP BY ALL)",
}
_NEEDS = {"chunks": ["lines"], "reps": ["lines", "chunks"], "bounded": ["mentions"], "posts": ["lines"]}


def sql(body: str, *names: str) -> str:
    """``body`` after the tables it needs."""
    wanted: list[str] = []
    for n in names:
        for x in [*_NEEDS.get(n, []), n]:
            if x not in wanted:
                wanted.append(x)
    return (f"WITH {', '.join(SQL[n] for n in wanted)} " if wanted else "") + body
