"""URL filter: host and path rules, and boosted trees over lexical features for the URLs that no rule decides.

URLs that a rule decides are the labelled ones. Trees are grown on a bounded sample of them and compiled into Spark
column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.llm import trees
from tidebar.llm.common import let, lower_ascii
from tidebar.session import materialize

RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
TRAIN_ROWS = 20_000
TREES, DEPTH = 12, 4
FEATURES = ("length", "depth", "digits", "entropy", "parameters", "labels", "host_length", "hyphens", "suffix_rate", "segment_rate")


def with_parts(pages: DataFrame) -> DataFrame:
    """Adds host and path; null URLs and those without ``://`` have neither (empty)."""
    parts = F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 0) != ""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.when(parts, lower_ascii(F.regexp_extract("url", pattern, 1))).otherwise("")
    return pages.withColumn("host", host).withColumn("path", F.when(parts, F.regexp_extract("url", pattern, 2)).otherwise(""))


def with_rule(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Adds rule and decided: the longest rule that fits, null if none does.

    A rule fits its host and the hosts below it, for paths that start with its path. Rules of equal length: the first.
    """
    rule, decided = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, decided = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(decided)
    return pages.withColumn("rule", rule).withColumn("decided", decided)


def _suffix() -> Column:
    return F.substring_index("host", ".", -1)


def _segment() -> Column:
    return F.regexp_extract("path", "^/([^/]*)", 1)


def with_features(pages: DataFrame, rates: dict[str, DataFrame], overall: float) -> DataFrame:
    """Adds the features. ``rates``: tables k, rate of suffixes and segments; keys they lack have the overall rate."""
    for name, key in (("suffix", _suffix()), ("segment", _segment())):
        pages = pages.withColumn("_k", key).join(rates[name].select(F.col("k").alias("_k"), F.col("rate").alias(f"_{name}_rate")), "_k", "left").drop("_k")
    url = F.coalesce("url", F.lit(""))
    size = F.greatest(F.length(url), F.lit(1))
    gone = lambda c: F.length(url) - F.length(F.translate(url, c, ""))
    characters = F.array_distinct(F.filter(F.split(url, ""), lambda c: c != ""))
    part = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / size
    entropy = F.aggregate(F.transform(characters, lambda c: let(part(c), lambda p: -p * F.log2(p))), F.lit(0.0), lambda s, x: s + x)
    rate = lambda name: F.coalesce(f"_{name}_rate", F.lit(overall))
    values = (F.length(url), F.length("path") - F.length(F.translate("path", "/", "")), gone("0123456789") / size, entropy,
              F.when(F.instr(url, "?") > 0, gone("&") + 1).otherwise(0), F.length("host") - F.length(F.translate("host", ".", "")), F.length("host"), gone("-"),
              rate("suffix"), rate("segment"))
    added = ("_suffix_rate", "_segment_rate")
    return pages.select(*[c for c in pages.columns if c not in added], *[v.cast("double").alias(f"_f_{n}") for n, v in zip(FEATURES, values)])


def fit(ruled: DataFrame, rows: int = TRAIN_ROWS, seed: int = 11) -> tuple[list[trees.Tree], dict[str, DataFrame], float]:
    """Trees, tables of suffix and segment rates, and the overall rate from the rule-decided URLs; the trees from at most ``rows`` of them.

    Block rates of host suffixes and first path segments are smoothed towards the overall rate and counted over all
    decided URLs. With one verdict only, there are no trees.
    """
    known = ruled.where("decided is not null").withColumn("label", (F.col("decided") == "block").cast("double"))
    overall = known.agg(F.avg("label")).first()[0]
    base = 0.5 if overall is None else overall
    rates = {}
    for name, key in (("suffix", _suffix()), ("segment", _segment())):
        counted = known.groupBy(key.alias("k")).agg(F.count("*").alias("n"), F.sum("label").alias("s"))
        rates[name] = materialize(counted.select("k", ((F.col("s") + 10 * base) / (F.col("n") + 10)).alias("rate")))
    if overall in (None, 0.0, 1.0):
        return [("leaf", 1.0 if overall else -1.0)], rates, base
    sample = known.select("url", "host", "path", "label").distinct().orderBy(F.md5(F.coalesce("url", F.lit(""))), "url").limit(rows)
    sample = materialize(with_features(sample, rates, base).select("label", *[f"_f_{n}" for n in FEATURES]))
    gathered = VectorAssembler(inputCols=[f"_f_{n}" for n in FEATURES], outputCol="features").transform(sample).cache()
    grown = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=seed, maxMemoryInMB=64).fit(gathered)
    weights = grown.treeWeights
    gathered.unpersist()
    return [scaled(t, w) for t, w in zip(trees.parsed(grown.toDebugString), weights)], rates, base


def scaled(tree: trees.Tree, weight: float) -> trees.Tree:
    if tree[0] == "leaf":
        return ("leaf", tree[1] * weight)
    return (*tree[:3], scaled(tree[3], weight), scaled(tree[4], weight))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score; one row per row of ``pages``.

    verdict is the rule's, or else the trees': block where their sum (score) is above 0. Null URLs are judged by their empty
    features.
    """
    ruled = with_rule(with_parts(pages.select("page_id", "url")), rules)
    grown, rates, overall = fit(ruled)
    wide = with_features(ruled, rates, overall)
    features = [F.col(f"_f_{n}") for n in FEATURES]
    total = F.lit(0.0)
    for t in grown:
        total = total + trees.value_of(t, features)
    scored = wide.select("page_id", "host", "path", "rule", "decided", total.alias("score"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("decided", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score")
