"""Chunks: blocks become pieces, pieces get the number of their chunk, chunks are grouped by Spark."""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\w+|[^\w\s]")



@functools.cache
def tokenizer(name: str):
    """The function that gives the spans of a text's tokens: ``words``, or a byte-pair vocabulary of ranks by its name."""
    if name == "words":
        return lambda text: [m.span() for m in _TOKEN.finditer(text)]
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def spans(text: str) -> list[tuple[int, int]]:
        starts = encoding.decode_with_offsets(encoding.encode_ordinary(text))[1]
        return list(zip(starts, [*starts[1:], len(text)]))

    spans.count = lambda text: len(encoding.encode_ordinary(text))
    return spans


def cut(text: str, most: int, overlap: int, by: str = "words") -> list[tuple[int, int, int]]:
    """(start, end, tokens) of the pieces of a text; over ``most`` tokens it is cut with ``overlap``."""
    spans = tokenizer(by)
    if hasattr(spans, "count"):  # where no cut is made, the places of the tokens aren't needed
        n = spans.count(text)
        if n <= most:
            return [(0, len(text), n)]
    spans = spans(text)
    if len(spans) <= most:
        return [(0, len(text), len(spans))]
    out = []
    for first in range(0, len(spans), most - overlap):
        last = min(first + most, len(spans))
        out.append((spans[first][0] if first else 0, spans[last - 1][1] if last < len(spans) else len(text), last - first))
        if last == len(spans):
            break
    return out


def number_pieces(pieces: list[tuple[str, bool, int]], target: int, most: int) -> list[int]:
    """The chunk number of each piece (section, is a heading, tokens).

    A chunk ends where a heading comes, the section changes or its tokens would pass ``target``; as long as it
    holds headings alone they may go up to ``most``.
    """
    numbers, number, tokens, section, bare = [], -1, 0, None, True
    for own, heading, size in pieces:
        full = tokens + size > (most if bare else target)
        if number < 0 or heading or own != section or full:
            number, tokens, bare = number + 1, 0, True
        section, bare, tokens = own, bare and heading, tokens + size
        numbers.append(number)
    return numbers


def chunk_blocks(blocks: DataFrame, target: int = 512, most: int = 800, overlap: int = 64, by: str = "words") -> DataFrame:
    """Chunks (doc_id, ordinal, title, section_path, source_text, ...) of ``blocks``
    (doc_id, title, block_id, type, text, section_path); the blocks of a document go to one task.
    """

    def per_document(table: pa.Table) -> pa.Table:
        rows = []
        for b in sorted(table.to_pylist(), key=lambda b: b["number"]):
            own = [*b["section_path"], b["text"]] if b["type"] == "HEADING" else b["section_path"]
            for i, (start, end, tokens) in enumerate(cut(b["text"], most, overlap, by)):
                rows.append((b["doc_id"], b["title"], b["block_id"], own, b["type"] == "HEADING" and i == 0, start, end, b["text"][start:end], tokens))
        numbers = number_pieces([(tuple(r[3]), r[4], r[8]) for r in rows], target, most)
        columns = zip(*[(*r[:4], *r[5:], n, i) for i, (r, n) in enumerate(zip(rows, numbers))]) if rows else [[]] * len(_PIECES)
        return pa.Table.from_arrays([pa.array(c, kind) for c, kind in zip(columns, _PIECES.types)], schema=_PIECES)

    number = F.expr("cast(substring(block_id, 2) as long)").alias("number")  # as text, b10000 would come before b1001
    pieces = blocks.select("doc_id", "title", "block_id", number, "type", "text", "section_path").groupBy("doc_id").applyInArrow(
        per_document, "doc_id long, title string, block_id string, section array<string>, start int, end int, text string, tokens int, ordinal int, at int"
    )
    return group_pieces(pieces)


_PIECES = pa.schema([
    ("doc_id", pa.int64()), ("title", pa.string()), ("block_id", pa.string()), ("section", pa.list_(pa.string())), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()),
    ("tokens", pa.int32()), ("ordinal", pa.int32()), ("at", pa.int32()),
])


def group_pieces(pieces: DataFrame) -> DataFrame:
    """A row for each chunk of ``pieces``; where these have a page, the first and the last page of the chunk."""
    page = F.col("page") if "page" in pieces.columns else F.lit(None).cast("int")
    ordered = F.array_sort(F.collect_list(F.struct("at", "block_id", "start", "end", "text")))
    grouped = pieces.groupBy("doc_id", "title", "ordinal").agg(ordered.alias("p"), F.sum("tokens").cast("int").alias("token_count"), F.min_by("section", "at").alias("section_path"), F.min(page).alias("page_start"), F.max(page).alias("page_end"))
    source = F.array_join(F.transform("p", lambda x: x.text), "\n\n")
    return grouped.select(
        "doc_id", "ordinal", "section_path", source.alias("source_text"), contextualize(F.col("title"), F.col("section_path"), source).alias("contextualized_text"),
        F.transform("p", lambda x: F.struct(x.block_id.alias("block_id"), x.start.alias("start"), x.end.alias("end"))).alias("source_spans"),
        "token_count", F.sha2(source, 256).alias("content_hash"), "page_start", "page_end",
    )


def split_tables(rows: DataFrame, per_piece: int) -> DataFrame:
    """(doc_id, table_id, piece, text) of table ``rows`` (doc_id, table_id, at, text): pieces of ``per_piece`` rows, each
    with the header (the table's first row) before them; a table of nothing but a header is one piece.
    """
    whole = Window.partitionBy("doc_id", "table_id").orderBy("at")
    numbered = rows.withColumns({"no": F.row_number().over(whole) - 1, "header": F.first("text").over(whole)})
    numbered = numbered.withColumn("piece", F.greatest(F.floor((F.col("no") - 1) / per_piece), F.lit(0)).cast("long"))
    body = F.array_sort(F.collect_list(F.when(F.col("no") > 0, F.struct("no", "text"))))
    pieces = numbered.groupBy("doc_id", "table_id", "piece").agg(F.first("header").alias("header"), body.alias("body"))
    return pieces.select("doc_id", "table_id", "piece", F.array_join(F.concat(F.array("header"), F.transform("body", lambda x: x.text)), "\n").alias("text"))


def contextualize(title: Column, path: Column, text: Column) -> Column:
    return F.concat(F.array_join(F.concat(F.array(title), path), " > "), F.lit("\n\n"), text)


def reconcile(old: DataFrame, new: DataFrame) -> DataFrame:
    """(version_id, ordinal, action): KEEP, UPDATE, INSERT or DELETE, by content_hash of both chunk sets."""
    a = old.select("version_id", "ordinal", F.col("content_hash").alias("was"))
    b = new.select("version_id", "ordinal", F.col("content_hash").alias("now"))
    action = (
        F.when(F.col("was").isNull(), F.lit("INSERT")).when(F.col("now").isNull(), F.lit("DELETE"))
        .when(F.col("was") == F.col("now"), F.lit("KEEP")).otherwise(F.lit("UPDATE"))
    )
    return a.join(b, ["version_id", "ordinal"], "full_outer").select("version_id", "ordinal", action.alias("action"))


def split_windows(n_tokens: Column, most: int = 800, overlap: int = 64) -> Column:
    """Array of the first tokens of an oversized block's pieces."""
    starts = F.sequence(F.lit(0), F.greatest(n_tokens - 1, F.lit(0)).cast("int"), F.lit(most - overlap))
    return F.filter(starts, lambda s: (s == 0) | (s + overlap < n_tokens))

