"""Sources: intake of files, rejects, content addressing, decoding, page cleaning, web text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import MEDIA_TYPES, UPLOAD_LIMIT


def blank(text: Column) -> Column:
    """Nothing but white space of any kind."""
    return text.rlike(r"^\s*$")


def media_type(path: Column) -> Column:
    """By the file's extension, whatever its case; null if it isn't served."""
    kinds = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    return kinds[F.regexp_extract(F.lower(path), r"(\.[a-z]+)$", 1)]


def decode(content: Column) -> Column:
    """UTF-8 with replacement; every line end is \\n."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "\r\n?", "\n")


def intake(files: DataFrame, limit: int = UPLOAD_LIMIT) -> DataFrame:
    """``files`` (path, content) with media_type and ``reject``: 415, 413 or 400 as its reason, else null."""
    return files.withColumn("media_type", media_type(F.col("path"))).withColumn(
        "reject",
        F.when(F.col("media_type").isNull(), F.lit("unsupported_media_type"))
        .when(F.length("content") > limit, F.lit("too_large"))
        .when(blank(decode(F.col("content"))), F.lit("empty")),
    )


def artifact_key(content: Column) -> Column:
    digest = F.sha2(content, 256)
    return F.concat(F.substring(digest, 1, 2), F.lit("/"), digest)


def put_artifacts(files: DataFrame) -> DataFrame:
    """(key, byte_size) of the different contents: storing twice stores once."""
    return files.select(artifact_key(F.col("content")).alias("key"), F.length("content").cast("long").alias("byte_size")).dropDuplicates(["key"])


def get_artifacts(stored: DataFrame, keys: DataFrame) -> DataFrame:
    """``keys`` (key) with the stored content and ``error``: a malformed key, an unknown one, or null."""
    found = keys.join(stored.select("key", "content").withColumn("held", F.lit(True)), "key", "left")
    error = F.when(~F.coalesce(valid_key(F.col("key")), F.lit(False)), F.lit("malformed_key")).when(F.col("held").isNull(), F.lit("unknown_key"))
    return found.select("key", "content", error.alias("error"))


def delete_artifacts(stored: DataFrame, keys: DataFrame) -> DataFrame:
    """What is left of ``stored``; keys that it hasn't got are passed over."""
    return stored.join(keys.select("key"), "key", "left_anti")


def valid_key(key: Column) -> Column:
    return key.rlike("^[0-9a-f]{2}/[0-9a-f]{64}$")


def unreferenced(stored: DataFrame, *references: DataFrame) -> DataFrame:
    """The stored keys that no table of keys names any more (null references name nothing)."""
    named = references[0].select("key")
    for r in references[1:]:
        named = named.union(r.select("key"))
    return stored.join(named.where("key is not null").distinct(), "key", "left_anti")


def _marked(pages: DataFrame) -> DataFrame:
    """``pages`` with ``edge``, ``first`` and ``last`` non-blank line of the page, and ``mask``: the line with its digits masked."""
    filled = F.when(~blank(F.col("line")), F.col("line_no"))
    page = Window.partitionBy("doc_id", "page")
    marked = pages.withColumns({"first": F.min(filled).over(page), "last": F.max(filled).over(page)})
    marked = marked.withColumn("edge", (F.col("line_no") == F.col("first")) | (F.col("line_no") == F.col("last")))
    return marked.withColumn("mask", F.regexp_replace(F.trim("line"), "[0-9]+", "#"))


def _edge_counts(marked: DataFrame, pages: DataFrame, least_pages: int) -> DataFrame:
    n_pages = pages.groupBy("doc_id").agg(F.countDistinct("page").alias("n_pages"))
    side = F.when(F.col("line_no") == F.col("first"), F.lit("first")).otherwise(F.lit("last"))
    seen = marked.where("edge").select("doc_id", "page", side.alias("side"), "mask").groupBy("doc_id", "side", "mask").agg(F.countDistinct("page").alias("seen"))
    return seen.join(n_pages, "doc_id").withColumn("often", (F.col("n_pages") >= least_pages) & (2 * F.col("seen") > F.col("n_pages")))


def edge_counts(pages: DataFrame, least_pages: int = 3) -> DataFrame:
    """(doc_id, side, mask, seen, n_pages, often): on how many pages each masked first or last line is, and whether that is more than half of them."""
    return _edge_counts(_marked(pages), pages, least_pages)


def running_lines(pages: DataFrame, least_pages: int = 3) -> DataFrame:
    """Lines of ``pages`` (doc_id, page, line_no, line) with ``edge`` and ``removed``.

    A page's first and last non-blank line is removed if, its digits masked, it is an edge on more than half of the
    pages of a document of ``least_pages`` pages or more.
    """
    marked = _marked(pages)
    often = _edge_counts(marked, pages, least_pages).where("often")
    often = often.select("doc_id", "mask").distinct().withColumn("often", F.lit(True))
    out = marked.join(often, ["doc_id", "mask"], "left")
    removed = F.coalesce(F.col("edge") & F.col("often"), F.lit(False))
    return out.select("doc_id", "page", "line_no", "line", F.coalesce("edge", F.lit(False)).alias("edge"), removed.alias("removed"))


def file_error(content: Column) -> Column:
    """Why a PDF file can't be read at all, from its own marks: no head or no end, or a dictionary of encryption."""
    text = F.decode(content, "iso-8859-1")
    return F.when(~text.contains("%PDF-") | ~text.contains("%%EOF"), F.lit("corrupt_document")).when(text.contains("/Encrypt"), F.lit("encrypted_document"))


def page_report(pages: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_pages, n_empty, error, warning) of ``pages`` (doc_id, page, line): no text on any page is a scan; a page that failed is an empty one.

    ``files`` (doc_id, content): the error of a file that can't be read comes first.
    """
    per = pages.groupBy("doc_id", "page").agg(F.bool_and(blank(F.col("line"))).alias("empty"))
    out = per.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"), F.count_if("empty").alias("n_empty"))
    every = F.col("n_empty") == F.col("n_pages")
    error, broken = F.when(every, F.lit("scanned_or_image_only")), F.lit(None).cast("string")
    if files is not None:
        out, broken = out.join(files.select("doc_id", file_error(F.col("content")).alias("broken")), "doc_id", "left"), F.col("broken")
    out = out.withColumns({"error": F.coalesce(broken, error), "warning": F.when(broken.isNull() & ~every & (F.col("n_empty") > 0), F.lit("empty_pages"))})
    return out.select("doc_id", "n_pages", "n_empty", "error", "warning")


ARTIFACT = "title string, blocks array<string>"


def artifact(title: Column, blocks: Column) -> Column:
    """A normalized document as JSON."""
    return F.to_json(F.struct(title.alias("title"), blocks.alias("blocks")))


def read_artifact(text: Column) -> Column:
    """The document of an artifact; one that doesn't fit the schema is an error, not a null."""
    return F.from_json(text, ARTIFACT, {"mode": "FAILFAST"})


def web_text(html: Column) -> Column:
    """The text of a page: no scripts, styles or tags, common entities decoded, white space collapsed."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " "))
