"""URL filters: allow and block rules, and gradient-boosted trees for the rest.

Everything is DataFrame and SQL functions: the URL is taken apart, rules are
matched and lexical features are computed as column expressions, and the trees are
Spark's own. They learn from URLs that the rules label: features are lengths,
depth, digit ratio, character entropy, parameter counts and the block rate of the
host's suffixes among the labelled URLs (smoothed, and without the URL's own label
where it has one). URLs that no rule fits get the trees' verdict.

The trees are fitted on a bounded sample of labelled URLs (``SAMPLE_ROWS``, by a
hash of the URL); the suffix statistics count all of them.

Rows: a null URL, or one without ``://``, has empty host and path; it fits no rule
and gets the verdict of its features; where the rules label nothing, or all alike,
the trees cannot be fitted and the rest is allowed, or gets the one label; rows
that repeat a ``page_id`` are judged one by one; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.llm.shared import stored

SAMPLE_ROWS = 20_000
#: Weight of the overall block rate in a suffix's rate, in URLs.
PRIOR = 20.0
TREES, DEPTH, STEP = 20, 4, 0.2
ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains, for paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: host and path as in ``host/path``.
RULES = (
    Rule("org", "/", ALLOW),
    Rule("example.org", "/es/", BLOCK),
    Rule("example.org", "/en/1", BLOCK),
    Rule("com", "/fr/", ALLOW),
    Rule("com", "/de/", BLOCK),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = (
    "length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy",
    "parameters", "query_length", "hyphens", "has_fragment", "suffix_rate", "site_rate",
)


def parts(url: Column) -> dict[str, Column]:
    """Host, path and query of a URL; empty where it has no ``://``."""
    rest = F.coalesce(F.when(F.locate("://", url) > 0, F.expr("substring(url, locate('://', url) + 3)")), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(rest, r"(?s)^[^?#]*\?([^#]*)", 1)
    return {"host": host, "path": path, "query": query}


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # the longest is tested first
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def lexical(url: Column) -> dict[str, Column]:
    """Features of the URL's own characters; a null URL counts as empty."""
    text = F.coalesce(url, F.lit(""))
    length = F.length(text)
    chars = F.array_distinct(F.split(text, ""))
    share = lambda c: (length - F.length(F.replace(text, c))) / length
    entropy = F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))
    count = lambda c, of: F.length(of) - F.length(F.replace(of, F.lit(c)))
    host, path, query = F.col("host"), F.col("path"), F.col("query")
    return {
        "length": length,
        "host_length": F.length(host),
        "path_length": F.length(path),
        "depth": count("/", path),
        "labels": F.when(host == "", 0).otherwise(count(".", host) + 1),
        "digit_ratio": F.when(length > 0, F.length(F.regexp_replace(text, "[^0-9]", "")) / length).otherwise(0.0),
        "entropy": F.when(length > 0, entropy).otherwise(0.0),
        "parameters": F.when(query == "", 0).otherwise(count("&", query) + 1),
        "query_length": F.length(query),
        "hyphens": count("-", host),
        "has_fragment": F.when(F.locate("#", text) > 0, 1).otherwise(0),
    }


def _rates(labelled: DataFrame, key: str) -> DataFrame:
    """Labelled and blocked URLs per suffix."""
    return labelled.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n"), F.sum("label").alias("blocked"))


def _with_rate(rows: DataFrame, rates: DataFrame, key: str, name: str, base: float) -> DataFrame:
    """Smoothed block rate of the suffix, without the row's own label."""
    own = F.when(F.col("label").isNotNull(), 1).otherwise(0)
    n = F.coalesce("n", F.lit(0)) - own
    blocked = F.coalesce("blocked", F.lit(0)) - F.coalesce("label", F.lit(0))
    joined = rows.join(rates, rows[key] == rates["k"], "left")
    return joined.withColumn(name, (blocked + PRIOR * base) / (n + PRIOR)).drop("k", "n", "blocked")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, url, host, path, rule, verdict."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    rows = rows.withColumns(parts(F.col("url")))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "fixed": verdict})
    rows = rows.withColumns(lexical(F.col("url")))
    rows = rows.withColumns({
        "label": F.when(F.col("fixed") == BLOCK, 1).when(F.col("fixed") == ALLOW, 0),
        "suffix": F.substring_index("host", ".", -1),
        "site": F.substring_index("host", ".", -2),
    })
    rows = stored(rows, "url-features")
    labelled = rows.filter("label is not null")
    total = labelled.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("blocked")).first()
    out = ["page_id", "url", "host", "path", "rule"]
    if total["blocked"] in (0, total["n"]):  # nothing to tell apart
        only = BLOCK if total["n"] and total["blocked"] else ALLOW
        return rows.select(*out, F.coalesce("fixed", F.lit(only)).alias("verdict"))
    base = total["blocked"] / total["n"]
    for key, name in (("suffix", "suffix_rate"), ("site", "site_rate")):
        rows = _with_rate(rows, stored(_rates(labelled, key), f"url-{key}"), key, name, base)
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    train = rows.filter("label is not null").orderBy(F.xxhash64("url", "page_id"), "page_id").limit(sample_rows)
    train = stored(train.select("features", F.col("label").cast("double").alias("label")), "url-sample")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=1, predictionCol="predicted", maxBins=64)
    judged = trees.fit(train).transform(rows)
    learned = F.when(F.col("predicted") > 0.5, BLOCK).otherwise(ALLOW)
    return judged.select(*out, F.coalesce("fixed", learned).alias("verdict"))
