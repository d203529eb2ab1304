"""URL filter: rules on host and path, and for the rest logistic regression on hashed character n-grams of host and path.

All of it is DataFrame functions. A URL becomes the shares of its hashed 3- and 4-character pieces (with marks at both ends and
between host and path); the regression is fitted on a small labelled table of URLs, and its weights are one constant array in the
scoring expression, so scoring is one pass without a shuffle.

Defined cases: a null url or one without `://` has an empty host and path, fits no rule and is judged by the regression. If the
labelled table is empty every url is allowed; if it has one class, that class is every verdict. Repeated rows are judged alike.
Other columns pass through; those named as a result are replaced.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """`text` is host/path: it fits the host and its subdomains where the path starts with the rule's."""

    verdict: str
    text: str


#: Fixed values of the query's contract.
RULES = [Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/")]
BUCKETS = 1024
SIZES = (3, 4)
#: The classifier is fitted on at most this many different labelled urls, half of them of each class, those with the smallest hashes.
MAX_LABELLED = 4000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        domain, slash, rest = rule.text.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit(f".{domain}"))) & F.startswith(path, F.lit(slash + rest))
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def buckets(host: Column, path: Column) -> Column:
    """Hashed buckets of all character pieces of a url, each as often as it occurs."""
    chars = F.split(F.concat(F.lit("^"), host, F.lit("|"), path, F.lit("$")), "")

    def pieces(size: int) -> Column:
        shifted = [F.slice(chars, k + 1, F.greatest(F.size(chars) - size + 1, F.lit(0))) for k in range(size)]
        return F.transform(F.arrays_zip(*[s.alias(f"c{k}") for k, s in enumerate(shifted)]), lambda x: F.pmod(F.xxhash64(*[x[f"c{k}"] for k in range(size)]), F.lit(BUCKETS)).cast("int"))

    return F.concat(*[pieces(size) for size in SIZES])


def fit(labelled: DataFrame) -> tuple[list[float], float]:
    """Weights per bucket and the intercept, from (url, blocked) with blocked 0 or 1."""
    known = labelled.where("url IS NOT NULL AND blocked IS NOT NULL").select("url", F.col("blocked").cast("int").alias("blocked"))
    different = known.distinct()  # copies of one url count once
    drawn = [different.where(F.col("blocked") == c).orderBy(F.xxhash64("url"), "url").limit(MAX_LABELLED // 2) for c in (0, 1)]
    sample = drawn[0].unionByName(drawn[1])
    host, path = host_and_path(F.col("url"))
    rows = sample.select("blocked", buckets(host, path).alias("pieces"))
    share = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: F.coalesce(F.try_element_at("shares", b), F.lit(0.0)))
    counted = (
        rows.withColumn("row", F.monotonically_increasing_id())
        .select("row", "blocked", F.size("pieces").alias("n"), F.explode("pieces").alias("piece"))
        .groupBy("row", "blocked", "n", "piece").agg(F.count("*").alias("times"))
        .groupBy("row", "blocked").agg(F.map_from_entries(F.collect_list(F.struct("piece", F.col("times") / F.col("n")))).alias("shares"))
        .select(F.col("blocked").cast("double").alias("label"), array_to_vector(share).alias("features"))
    )
    classes = [r.blocked for r in sample.select("blocked").distinct().collect()]
    if len(classes) < 2:
        return [0.0] * BUCKETS, 1.0 if classes == [1] else -1.0
    model = LogisticRegression(maxIter=60, regParam=1e-4, standardization=False).fit(counted)
    return model.coefficients.toArray().tolist(), float(model.intercept)


def log_odds(host: Column, path: Column, weights: list[float], intercept: float) -> Column:
    table, found = F.lit(weights), buckets(host, path)
    total = F.aggregate(found, F.lit(0.0), lambda s, b: s + F.element_at(table, b + 1))
    return F.lit(intercept) + total / F.greatest(F.size(found), F.lit(1))


def judge(pages: DataFrame, labelled: DataFrame, rules: list[Rule]) -> DataFrame:
    """The pages' columns plus host, path, rule, log_odds (of blocking) and verdict."""
    weights, intercept = fit(labelled)
    host, path = host_and_path(F.col("url"))
    parts = pages.withColumns({"host": host, "path": path})
    rule, by_rule = rule_of(F.col("host"), F.col("path"), rules)
    scored = parts.withColumns({"rule": rule, "log_odds": log_odds(F.col("host"), F.col("path"), weights, intercept)})
    return scored.withColumn("verdict", F.coalesce(by_rule, F.when(F.col("log_odds") > 0, "block").otherwise("allow")))


def ruled(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """Labelled urls (url, blocked): those that a rule decides."""
    _, verdict = rule_of(*host_and_path(F.col("url")), rules)
    return pages.select("url", verdict.alias("verdict")).where("verdict IS NOT NULL").select("url", (F.col("verdict") == "block").cast("int").alias("blocked"))


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, ruled(pages, RULES), RULES).select("page_id", "host", "path", "rule", "verdict", "log_odds")
