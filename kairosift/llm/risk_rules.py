"""Operator 6: quality rules with risk-controlled thresholds.

Each rule rejects a document whose share of something (symbols, repeated lines, repeated words, capitals) is over
a cutoff. For each stratum (language) alone, half of the labelled documents lay out a path of nested cutoffs, from
loose to strict: at each level every rule takes the least cutoff of a fixed grid that rejects at most so many of that
half's good documents, if it also rejects bad ones ``gain`` times as often as good ones. On the other half, the
holdout, the exact binomial test must then show that all rules of a level together reject fewer than ``risk`` of the
good documents. Levels are tested in order, each at ``delta`` / strata, up to the first that fails (a fixed sequence
needs no correction within a stratum; strata are corrected by Bonferroni), and the last that passed is used. So with
probability 1 - delta no stratum loses more than ``risk`` of its good documents to the rules; a stratum with too few
labels to show that has no rule. The guarantee is for documents that pass the base rule, as the labelled ones did.

Defined cases
* null text: no words, so the base rule rejects it; empty text alike;
* null language: a stratum of its own; a document with several labels is good only if all are good, null
  labels don't count; no labels: no cutoffs, the base rule alone decides;
* rows are judged alone (repeated rows alike), but a labelled doc_id is one trial: of several rows the least counts;
* null doc_id: judged, never a trial; empty table: empty result.
"""

from __future__ import annotations

import math
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_SPACE, fields, small_slices, stored, with_columns
from .minhash_dedup import _P, _U, _WORDS, _mix

SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters"]
#: Rule name -> the share it looks at.
RULES = {
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(n_letters, 1)",
}
GRID = [0.005, 0.01, 0.02, 0.03, 0.05, 0.075, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
#: Levels of the path: the good documents that a rule may reject in the half that lays it out, as parts of the risk.
LEVELS = [0.0, 0.025, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0]
_LETTERS = re.compile(r"[^\W\d_]+")


def capitals(text: str) -> int:
    """Characters that lower-casing changes."""
    low = text.lower()
    if len(low) != len(text):  # some characters become two
        return sum(map(str.isupper, text))
    a, b = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in (text, low))
    return int((a != b).sum())


def repeated_words(words: list[bytes], window: int = 8) -> int:
    """Words covered by ``window``-word windows found twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    w = np.fromiter(map(_WORDS.__getitem__, words), _U, len(words))
    h = np.zeros(n, _U)
    for j in range(window):
        h = h * _P + w[j : n + j]
    _, at, count = np.unique(_mix(h), return_inverse=True, return_counts=True)
    steps = np.zeros(len(words) + 1, np.int64)
    twice = count[at] > 1
    np.add.at(steps, np.flatnonzero(twice), 1)
    np.add.at(steps, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(steps[:-1]) > 0).sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """The values of COUNTS."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, ASCII_SPACE))
    seen: set[str] = set()
    again = 0
    lines = text.split("\n")
    for line in lines:
        if line.strip(ASCII_SPACE):
            again += line in seen
            seen.add(line)
    letters = sum(map(len, _LETTERS.findall(text)))
    return len(words), chars, sum(map(text.count, SYMBOLS)), again, repeated_words(words), len(lines), capitals(text), letters


def with_counts(docs: DataFrame) -> DataFrame:
    """``docs`` (text, any more) with COUNTS in place of text."""
    kept = [c for c in docs.columns if c not in COUNTS]
    docs = docs.select(*kept)

    def run(batches):
        for batch in small_slices(batches, 1000):
            counts = [text_counts(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            columns = zip(*counts) if counts else [[]] * len(COUNTS)
            yield with_columns(batch.drop_columns(["text"]), {c: pa.array(list(x), pa.int64()) for c, x in zip(COUNTS, columns)})

    return docs.mapInArrow(run, fields(docs.drop("text"), *[(c, T.LongType()) for c in COUNTS]))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) of n trials, exactly, as 1 - I_p(k + 1, n - k) by its continued fraction."""
    if k >= n:
        return 1.0
    return 1.0 - _incomplete_beta(k + 1, n - k, p)


def _incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1 - (a + b) * x / (a + 1), tiny)
    value = d
    for m in range(1, 10_000_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1 + num * d if abs(1 + num * d) > tiny else tiny)
            c = 1 + num / c if abs(1 + num / c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1) < 1e-14:
            return front * value
    raise ArithmeticError("the continued fraction has not settled")


def _path(labelled: DataFrame, risk: float, gain: float) -> DataFrame:
    """(stratum, path): for each level a cutoff or null for each rule of RULES."""
    share = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("share")) for r in RULES])).alias("x")
    bucket = F.size(F.filter(F.array(*[F.lit(g) for g in GRID]), lambda g: g < F.col("x.share"))).alias("bucket")
    hist = labelled.select("stratum", "good", share).groupBy("stratum", "x.rule", bucket).agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    up, whole = Window.partitionBy("stratum", "rule").orderBy(F.desc("bucket")), Window.partitionBy("stratum", "rule")
    for c in ("good", "bad"):
        hist = hist.withColumn(f"{c}_over", F.sum(c).over(up)).withColumn(f"{c}_all", F.sum(c).over(whole))
    # bucket i holds the shares over GRID[i - 1]; a cutoff with an empty bucket rejects the same as the next one that has rows
    useful = F.col("bad_over") * F.greatest("good_all", F.lit(1)) >= gain * F.col("good_over") * F.greatest("bad_all", F.lit(1))
    fit = hist.where((F.col("bucket") > 0) & useful & (F.col("bad_over") > 0))
    least = fit.groupBy("stratum", "rule").agg(*[F.min(F.when(F.col("good_over") <= level * risk * F.col("good_all"), F.col("bucket"))).alias(f"b{i}") for i, level in enumerate(LEVELS)])
    cut = lambda i: F.get(F.array(*[F.lit(g) for g in GRID]), F.col(f"b{i}") - 1)
    of = lambda i, r: F.max(F.when(F.col("rule") == r, cut(i)))
    return least.groupBy("stratum").agg(F.array(*[F.array(*[of(i, r) for r in RULES]) for i in range(len(LEVELS))]).alias("path"))


def cutoffs(labelled: DataFrame, risk: float = 0.02, delta: float = 0.05, gain: float = 3.0) -> DataFrame:
    """(stratum, rule, cutoff) from ``labelled`` (doc_id, stratum, good, and the shares named in RULES).

    The tables between have a row for each stratum and level at most.
    """
    holdout = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    path = stored(_path(labelled.where(~holdout), risk, gain), "rule-paths")
    good = labelled.where(holdout & F.col("good")).join(path, "stratum")
    fires = lambda i: reduce(Column.__or__, [F.coalesce(F.col(r) > F.col("path")[i][j], F.lit(False)) for j, r in enumerate(RULES)])
    first = F.coalesce(*[F.when(fires(i), F.lit(i)) for i in range(len(LEVELS))], F.lit(len(LEVELS))).alias("level")
    counts = good.select("stratum", first).groupBy("stratum", "level").count()
    strata = path.count()
    every = path.select("stratum", F.explode(F.sequence(F.lit(0), F.lit(len(LEVELS)))).alias("level"))
    counts = every.join(counts, ["stratum", "level"], "left").na.fill(0, ["count"])
    by = Window.partitionBy("stratum")
    counts = counts.withColumns({"k": F.sum("count").over(by.orderBy("level")), "n": F.sum("count").over(by)}).where(F.col("level") < len(LEVELS))

    def fails(batches):
        for pdf in batches:
            bad = [n == 0 or binomial_cdf(int(k), int(n), risk) > delta / strata for k, n in zip(pdf.k, pdf.n)]
            yield pdf[bad][["stratum", "level"]]

    failed = counts.mapInPandas(fails, "stratum string, level int").groupBy("stratum").agg(F.min("level").alias("failed"))
    used = path.join(failed, "stratum", "left").select("stratum", F.get("path", F.coalesce("failed", F.lit(len(LEVELS))) - 1).alias("cuts")).where("cuts is not null")
    rules = F.explode(F.arrays_zip(F.array(*[F.lit(r) for r in RULES]).alias("rule"), F.col("cuts").alias("cutoff"))).alias("x")
    return used.select("stratum", rules).select("stratum", "x.rule", "x.cutoff").where("cutoff is not null")


def judge(docs: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """COUNTS, base_failed, kept and the failed ``rules`` of every row of ``docs`` (doc_id, text, lang)."""
    counted = with_counts(docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("stratum"), "text"))
    counted = stored(counted.select("*", *[F.expr(e).alias(r) for r, e in RULES.items()]), "rule-counts")
    counted = counted.withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))
    good = labels.where("quality is not null").groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    # a document is one trial, however often it is repeated: of several rows the least
    trials = counted.where("not base_failed").join(good, "doc_id").groupBy("doc_id").agg(F.min(F.struct("stratum", "good", *RULES)).alias("t")).select("doc_id", "t.*")
    limits = cutoffs(trials, risk, delta)
    limits = limits.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("limits"))
    failed = F.array_compact(F.array(*[F.when(F.col(r) > F.col("limits")[r], F.lit(r)) for r in RULES]))
    out = counted.join(limits, "stratum", "left").withColumn("rules", F.coalesce(failed, F.array().cast("array<string>")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("rules") == 0))


def op6_risk_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("rules", ",").alias("failed_rules"))
