"""URL filtering by empirical-Bayes host reputation. DataFrame expressions only.

A page's outcome is bad if its label says low quality or toxic. Bad rates are shrunk level by level: suffixes towards the
overall rate, registered domains towards their suffix, hosts towards their domain. Each level's prior strength is the
method-of-moments estimate of a beta-binomial, from that level's groups. A host is blocked if the lower posterior bound
of its bad rate (mean - Z standard deviations of its beta posterior) exceeds BLOCK_ABOVE. Explicit rules come first.

The registered domain is the last two labels of a host and the suffix is the last one, since no suffix list is at hand.
Rows are aggregated by host before any level is built. The prior of each level is one row of sums, read by the driver.

Cases: null url, or one without "://" -> host and path are empty, and share the reputation of the empty host (no labels:
the prior); pages without labels, or labels with null values or ids, teach nothing; with no labels at all nothing is
blocked by reputation; repeated rows stay repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z = 1.645
BLOCK_ABOVE = 0.5
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0
#: (action, host, path prefix); at most a few hundred, as they become one expression.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both are empty without "://"."""
    column = F.col(url)
    at = F.instr(column, "://")
    rest = F.when(at > 0, column.substr(at + 3, F.length(column))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """Text and action of the longest rule that fits, or nulls. Of equal lengths the first in the list wins."""
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, of, prefix in reversed(sorted(rules, key=lambda r: -len(r[1] + r[2]))):
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(prefix)
        text, action = F.when(fits, of + prefix).otherwise(text), F.when(fits, verdict).otherwise(action)
    return text, action


def _strength(groups: DataFrame) -> tuple[float, float]:
    """Overall bad rate and beta-binomial prior strength of groups with n outcomes of which y are bad."""
    n, y = F.col("n").cast("double"), F.col("y").cast("double")
    row = groups.where("n > 0").agg(F.sum(n), F.sum(y), F.sum(n * n), F.sum(y * y / n), F.count("*")).first()
    total, bad, squares, spread, k = (float(v or 0) for v in row)
    if not total:
        return 0.0, MOST_STRENGTH
    p = bad / total
    free = total - squares / total
    noise = p * (1 - p)
    between = spread - total * p * p - noise * (k - 1)
    if noise <= 0 or free - (k - 1) <= 0 or between <= 0:
        return p, MOST_STRENGTH
    rho = between / (noise * (free - (k - 1)))
    return p, min(MOST_STRENGTH, max(LEAST_STRENGTH, 1 / rho - 1))


def reputations(outcomes: DataFrame) -> DataFrame:
    """(host, n, y, bad_mean, bad_low) of every host of (host, bad) rows; bad may be null."""
    by_host = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.sum(F.coalesce(F.col("bad"), F.lit(0))).alias("y"))
    by_host = by_host.withColumn("domain", F.substring_index("host", ".", -2)).withColumn("suffix", F.substring_index("host", ".", -1))
    by_domain = by_host.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    by_suffix = by_domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    overall, k_suffix = _strength(by_suffix)
    k_domain, k_host = _strength(by_domain)[1], _strength(by_host)[1]
    shrunk = lambda k, towards: (F.col("y") + F.lit(k) * towards) / (F.col("n") + F.lit(k))
    suffixes = by_suffix.select("suffix", shrunk(k_suffix, F.lit(overall)).alias("suffix_mean"))
    domains = by_domain.join(suffixes, "suffix").select("domain", shrunk(k_domain, F.col("suffix_mean")).alias("domain_mean"))
    mean = shrunk(k_host, F.col("domain_mean"))
    deviation = F.sqrt(F.col("bad_mean") * (1 - F.col("bad_mean")) / (F.col("n") + F.lit(k_host) + 1))
    hosts = by_host.join(domains, "domain").withColumn("bad_mean", mean)
    return hosts.select("host", "n", "y", "bad_mean", (F.col("bad_mean") - Z * deviation).alias("bad_low"))


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_mean, bad_low) of every row of (page_id, url); labels: (doc_id, quality, toxic)."""
    host, path = host_and_path()
    pages = pages.select("page_id", host.alias("host"), path.alias("path"))
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() & F.col("toxic").isNotNull(), 0)
    labelled = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")).where(F.col("page_id").isNotNull())
    found = reputations(pages.join(labelled, "page_id", "left").select("host", "bad"))
    rule, action = matching_rule(F.col("host"), F.col("path"), rules)
    by_reputation = F.when(F.col("bad_low") > BLOCK_ABOVE, "block").otherwise("allow")
    out = pages.join(found.select("host", "bad_mean", "bad_low"), "host")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, by_reputation).alias("verdict"), "bad_mean", "bad_low")
