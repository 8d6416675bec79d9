"""The corpus pipeline: stages of (name, function), each over all that the one before it has kept.

A stage takes (spark, docs, sf_dir), ``docs`` with the columns of documents, and returns the documents it keeps
(the last one: the packing plan). ``run`` applies them in order; between stages the result is written as Parquet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairosift.llm.common import stored
from kairosift.llm.line_dedup import drop_repeated_lines
from kairosift.llm.minhash_dedup import drop_near_duplicates
from kairosift.llm.packing import pack_documents
from kairosift.llm.quality_lm import drop_rejected
from kairosift.llm.suffix_dedup import remove_repeats

#: Bytes of a repeated passage; 50 words have more in any of the languages.
PASSAGE_BYTES = 200


def _rewritten(docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``docs`` with the texts that ``operator`` gives; the other columns pass by it, so no name clashes; n_chars follows."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", F.struct(F.lit(1).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("others"))
    out = operator(packed)
    columns = {c: F.col("others").getField(c).alias(c) for c in others} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in others:
        columns["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*[columns[c] for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that read like trusted text; the others go.

    Null, empty and blank texts go; without a label all others stay; repeated rows are judged alike; a row of null
    doc_id is judged by its text.
    """
    return drop_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of three documents or more stay in the one of the largest doc_id.

    Null text becomes empty; rows of null doc_id keep their lines and don't count; repeated rows of one doc_id count
    each, and all keep a line that this doc_id owns.
    """
    return _rewritten(docs, drop_repeated_lines)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id of each group of near duplicates: five words, similarity 0.8.

    Null, empty and wordless texts and rows of null doc_id stay; rows of one doc_id are judged by their own texts.
    """
    return drop_near_duplicates(docs, shingle=5, percent=80)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that occur more than once go, all copies of them; whole characters alone.

    Null text becomes empty; repeated rows repeat each other, so all of a long one goes; shorter texts stay.
    """
    return _rewritten(docs, lambda df: remove_repeats(df, length=PASSAGE_BYTES))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of what is left, in length buckets and batches; null and empty texts are a piece of 0 tokens."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("passages", passages), ("packing", packing)]

#: Perplexity, hashing and dynamic programming can't be put in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
