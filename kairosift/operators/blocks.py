"""Blocks of documents: paragraphs, headings, lists, tables and fences, by windows over lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_HEADING = 80
LEAST_CHARS = 16


def looks_like_heading(text: Column) -> Column:
    return ~text.contains("\n") & (F.length(text) <= MAX_HEADING) & ~text.rlike("[.!?,;:]$")


def block_id(index: Column) -> Column:
    return F.format_string("b%04d", index)


def text_blocks(docs: DataFrame) -> DataFrame:
    """Blocks (doc_id, block_id, type, text, section) of plain texts ``docs`` (doc_id, text).

    Paragraphs are parted by blank lines; one that looks like a heading opens the section of those after it.
    """
    parts = docs.select("doc_id", F.posexplode(F.split("text", "\n[ \t\r\f]*\n")).alias("at", "raw"))
    parts = parts.withColumn("raw", F.regexp_replace("raw", r"^\s+|\s+$", "")).where("raw <> ''")
    inner = F.array_join(F.filter(F.transform(F.split("raw", "\n"), lambda x: F.trim(x)), lambda x: x != ""), " ")
    parts = parts.withColumns({"heading": looks_like_heading(F.col("raw")), "text": inner})
    order = Window.partitionBy("doc_id").orderBy("at")
    before = F.last(F.when(F.col("heading"), F.col("text")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    kind = F.when(F.col("heading"), F.lit("HEADING")).otherwise(F.lit("PARAGRAPH"))
    section = F.when(~F.col("heading"), before)
    return parts.select("doc_id", block_id(F.row_number().over(order) - 1).alias("block_id"), kind.alias("type"), "text", section.alias("section"))


def markdown_blocks(docs: DataFrame) -> DataFrame:
    """Blocks (doc_id, block_id, type, text, level, section_path) of Markdown texts ``docs`` (doc_id, text)."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    order = Window.partitionBy("doc_id").orderBy("at")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fence = F.col("line").rlike(r"^\s*(```|~~~)")
    lines = lines.withColumn("fence", fence).withColumn("fences", F.sum(F.col("fence").cast("int")).over(running))
    lines = lines.withColumn("fenced", ~F.col("fence") & (F.col("fences") % 2 == 1))
    open_ = ~F.col("fence") & ~F.col("fenced")
    bare = F.regexp_replace("line", r"^\s+|\s+$", "")
    depth = F.when(open_ & F.col("line").rlike(r"^#{1,6}\s+.*$"), F.length(F.regexp_extract("line", "^(#+)", 1)))
    lines = lines.withColumns({"open": open_, "bare": bare, "depth": depth})
    table = F.col("open") & F.col("depth").isNull() & F.col("bare").rlike(r"(?s)^\|.*\|$") & (F.length("bare") > 1)
    lines = lines.withColumn("table", table)
    item = F.col("open") & F.col("depth").isNull() & ~F.col("table") & F.col("line").rlike(r"^\s*([-*+]|\d+[.)])\s+.*$")
    lines = lines.withColumn("item", item)
    plain = F.col("fenced") | (F.col("open") & (F.col("bare") != "") & F.col("depth").isNull() & ~F.col("table") & ~F.col("item"))
    lines = lines.withColumn("plain", plain)
    lines = lines.withColumn("group", F.sum((~F.col("plain")).cast("int")).over(running))  # plain lines up to the next other one
    # each depth's heading holds until one as shallow or shallower comes
    for d in range(1, 7):
        own = F.last(F.when(F.col("depth") == d, F.struct("at", F.regexp_replace(F.regexp_replace("line", r"^#+\s+", ""), r"\s+$", "").alias("name"))), ignorenulls=True)
        closed = F.max(F.when(F.col("depth") < d, F.col("at")))
        past = order.rowsBetween(Window.unboundedPreceding, -1)
        lines = lines.withColumns({f"h{d}": own.over(past), f"c{d}": closed.over(past)})
        here = F.col(f"h{d}.at") > F.coalesce(F.col(f"c{d}"), F.lit(-1))
        here = here & (F.col("depth").isNull() | (F.col("depth") > d))
        lines = lines.withColumn(f"h{d}", F.when(here, F.col(f"h{d}.name")))
    path = F.array_compact(F.array(*[F.col(f"h{d}") for d in range(1, 7)]))
    deepest = F.coalesce("depth", *[F.when(F.col(f"h{d}").isNotNull(), F.lit(d)) for d in range(6, 0, -1)])
    lines = lines.withColumns({"path": path, "level": deepest})
    text = (
        F.when(F.col("depth").isNotNull(), F.regexp_replace("bare", r"^#+\s+", ""))
        .when(F.col("item"), F.regexp_replace(F.regexp_replace("line", r"^\s*([-*+]|\d+[.)])\s+", ""), r"\s+$", ""))
        .otherwise(F.col("bare"))
    )
    single = lines.where((F.col("depth").isNotNull() | F.col("table") | F.col("item")) & ~(F.col("table") & F.col("bare").rlike(r"^\|[\s:|-]+\|$")))
    kind = F.when(F.col("depth").isNotNull(), F.lit("HEADING")).when(F.col("table"), F.lit("TABLE_TEXT")).otherwise(F.lit("LIST_ITEM"))
    single = single.select("doc_id", "at", kind.alias("type"), text.alias("text"), "level", "path")
    many = lines.where("plain").groupBy("doc_id", "group").agg(
        F.min("at").alias("at"),
        F.when(F.bool_or("fenced"), F.lit("UNKNOWN_TEXT")).otherwise(F.lit("PARAGRAPH")).alias("type"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.when(F.col("fenced"), F.col("line")).otherwise(F.col("bare")).alias("t")))), lambda x: x.t), " ").alias("text"),
        F.first("level").alias("level"), F.first("path").alias("path"),
    ).drop("group")
    both = single.unionByName(many)
    return both.select("doc_id", block_id(F.row_number().over(order) - 1).alias("block_id"), "type", "text", "level", F.col("path").alias("section_path"))


def parse_report(blocks: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, n_blocks, n_chars, unknown_ratio, error, warning) of every document, those without blocks too.

    Blocks that have a block_id must be numbered from 0 without gaps or repeats, else the error is block_order.
    """
    number = F.regexp_extract("block_id", "^b([0-9]+)$", 1).try_cast("long") if "block_id" in blocks.columns else F.lit(None).cast("long")
    found = blocks.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.count_if(F.col("type") == "UNKNOWN_TEXT").alias("unknown"),
        F.min(number).alias("low"), F.max(number).alias("high"), F.countDistinct(number).alias("different"),
    )
    out = docs.select("doc_id").distinct().join(found, "doc_id", "left").na.fill(0, ["n", "chars", "unknown"])
    ratio = F.when(F.col("n") > 0, F.col("unknown") / F.col("n")).otherwise(F.lit(0.0))
    ordered = F.coalesce((F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("different") == F.col("n")), F.lit(False)) | F.lit("block_id" not in blocks.columns)
    return out.select(
        "doc_id", F.col("n").alias("n_blocks"), F.col("chars").alias("n_chars"), ratio.alias("unknown_ratio"),
        F.when((F.col("n") == 0) | (F.col("chars") < LEAST_CHARS), F.lit("empty_extraction")).when(~ordered, F.lit("block_order")).alias("error"),
        F.when(ratio > 0.5, F.lit("mostly_unknown")).alias("warning"),
    )
