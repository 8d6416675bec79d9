"""Operator 1: URL filter by association rules.

Spark's FP-growth mines combinations of URL tokens and the label from labelled pages; combinations that imply the
bad label with enough confidence, support and lift become block rules. Tokens that are on the same labelled pages are
one item for the miner (a host whose pages share twenty tokens would else give 2^20 combinations); a rule's part is met
by any of the item's tokens. Rules are kept in an inverted index under their rarest part: a URL meets a rule only
through one of that part's tokens, and the rest of the rule is then compared. A list of host and path rules of the
user's own goes before the mined ones.

Defined cases
* null url or one without '://': host, path and tokens are empty, so no rule fits and the verdict is allow;
* host: A-Z alone are lower-cased; a host rule fits its host and subdomains, the longest rule string wins;
* labels come by page_id, so rows that share one share its labels; a page labelled more than once counts once, bad if
  any label is bad; null labels and null ids don't count;
* no labels, or none that is bad: no mined rule, all other pages are allowed; empty table: empty result;
* urls are judged alone, whatever their page_id is (shared or null), so equal urls get equal verdicts; other columns
  are left out.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BAD = "label=bad"

#: (host, path, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
_PARTS = r"(?s)://([^/?#]*)([^?#]*)(.*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Sorted distinct tokens: host labels, path segments with digits masked, keys of the query."""

    def parts(text: Column, cut: str, sign: str) -> Column:
        return F.transform(F.filter(F.split(text, cut), lambda x: x != ""), lambda x: F.concat(F.lit(sign), x))

    masked = F.regexp_replace(F.lower(path_of(url)), r"\d+", "0")
    query = F.regexp_replace(F.coalesce(F.regexp_extract(url, _PARTS, 3), F.lit("")), "=[^&#]*", "")
    return F.array_sort(F.array_distinct(F.concat(parts(host_of(url), r"\.", "h="), parts(masked, "[/._-]+", "p="), parts(F.lower(query), "[?&#]+", "q="))))


def own_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule string, verdict) of the longest fitting rule, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda x: len(x[0] + x[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def mine_rules(pages: DataFrame, labels: DataFrame, min_support: float = 0.001, min_confidence: float = 0.5, min_lift: float = 1.5) -> DataFrame:
    """(antecedent, confidence, support, lift) of the token combinations that imply the bad label.

    ``pages`` (page_id, url), ``labels`` (page_id, bad boolean). Rules no better than one of their parts go.
    """
    bad = labels.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.bool_or("bad").alias("bad"))
    baskets = pages.select("page_id", tokens_of(F.col("url")).alias("items")).join(bad, "page_id")
    baskets = baskets.select("bad", F.when(F.col("bad"), F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items")).alias("items")).where(F.size("items") > 0)
    n, n_bad = baskets.agg(F.count(F.lit(1)), F.count_if("bad")).first()
    empty = pages.sparkSession.createDataFrame([], "antecedent array<string>, parts array<array<string>>, confidence double, support double, lift double")
    if not n or not n_bad:
        return empty
    baskets = stored(baskets.withColumn("row", F.xxhash64(F.monotonically_increasing_id())), "url-baskets")
    each = baskets.select("row", F.explode("items").alias("token")).where(F.col("token") != BAD)
    least = max(min_support, 3 / n)
    # pages of a token by their number and two sums of hashes: equal ones are the same pages
    marks = [F.count(F.lit(1)).alias("n"), F.sum(F.col("row").cast("decimal(38,0)")).alias("m1"), F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("m2")]
    tokens = stored(each.groupBy("token").agg(*marks).where(F.col("n") >= least * n), "url-tokens")
    items = tokens.groupBy("n", "m1", "m2").agg(F.min("token").alias("item"), F.array_sort(F.collect_list("token")).alias("tokens"))
    items = stored(items.select("item", "tokens"), "url-items")
    of = items.select("item", F.explode("tokens").alias("token"))
    kept = each.join(of, "token").groupBy("row").agg(F.collect_set("item").alias("items"))
    mined = baskets.select("row", "bad").join(kept, "row", "left").select(F.concat(F.coalesce("items", F.array().cast("array<string>")), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=least, minConfidence=min_confidence).fit(mined.where(F.size("items") > 0)).freqItemsets
    found = found.select(F.array_sort("items").alias("items"), (F.col("freq")).alias("freq"))
    with_label = found.where(F.array_contains("items", BAD) & (F.size("items") > 1)).select(F.array_remove("items", BAD).alias("items"), F.col("freq").alias("hits"))
    rules = with_label.join(found, "items").select(
        F.col("items").alias("antecedent"),
        (F.col("hits") / F.col("freq")).alias("confidence"),
        (F.col("hits") / n).alias("support"),
        (F.col("hits") / F.col("freq") / (n_bad / n)).alias("lift"),
    )
    rules = stored(rules.where((F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift)), "url-rules")
    parts = rules.select("antecedent", "confidence", F.explode("antecedent").alias("left_out"))
    parts = parts.select("antecedent", "confidence", F.array_remove("antecedent", F.col("left_out")).alias("part"))
    shorter = rules.select(F.col("antecedent").alias("part"), F.col("confidence").alias("of_part"))
    worse = parts.join(shorter, "part").where("of_part >= confidence").select("antecedent").distinct()
    rules = rules.join(worse, "antecedent", "left_anti")
    whole = rules.select("antecedent", F.explode("antecedent").alias("item")).join(items, "item").groupBy("antecedent").agg(F.collect_list("tokens").alias("parts"))
    return stored(rules.join(whole, "antecedent").select("antecedent", "parts", "confidence", "support", "lift"), "url-rules")


def match_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, matched, confidence) of each different url that meets a rule; the most confident rule, then the last by text."""
    pieces = rules.select("antecedent", "confidence", "parts", F.posexplode("parts").alias("nth", "part"))
    often = pieces.groupBy("part").count()
    index = pieces.join(often, "part").groupBy("antecedent").agg(F.min_by(F.struct("part", "parts", "confidence"), F.struct("count", "nth")).alias("x"))
    index = index.select("antecedent", "x.parts", "x.confidence", F.explode("x.part").alias("token"))
    urls = pages.where("url is not null").select("url").distinct()
    met = urls.select("url", F.explode(tokens_of(F.col("url"))).alias("token")).join(index, "token").withColumn("tokens", tokens_of(F.col("url")))
    met = met.where(F.forall("parts", lambda p: F.arrays_overlap(p, F.col("tokens"))))
    return met.groupBy("url").agg(F.max(F.struct("confidence", F.array_join("antecedent", " ").alias("matched"))).alias("best")).select("url", "best.matched", "best.confidence")


def judge(pages: DataFrame, rules: DataFrame, own=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, matched, confidence) of every row of ``pages`` (page_id, url)."""
    rule, verdict = own_rule(F.col("host"), F.col("path"), own)
    judged = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = judged.join(match_rules(pages, rules), "url", "left")
    mined = F.when(F.col("matched").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, mined).alias("verdict"), "matched", "confidence")


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    labels = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return judge(pages, mine_rules(pages, labels))
