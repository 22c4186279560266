"""URL filter by rules and empirical-Bayes host reputation.

Labelled page outcomes (1 is bad) are counted by host. The rate of bad pages is shrunk in three steps, from
all pages to the suffix, to the registered domain, to the host: each level's rates scatter around their
parent's as a beta-binomial whose concentration is fitted by moments, and the parent's posterior mean is
the child's prior mean. A host is blocked if the lower bound of its posterior, at ``z`` standard
deviations of the log odds, exceeds ``limit``. Hosts without outcomes stand at their domain's prior.

Explicit rules come first. A rule ``host/path`` fits its host and all subdomains if the url's path starts
with the rule's; the longest fitting rule wins (ties: the first listed).

Counting is an aggregate with a map-side combine; pages meet their host's verdict in a plain join, whose
skewed partitions adaptive execution splits. Only one row of totals per level reaches the driver.

A null url, or one without ``://``, has an empty host and path, fits no rule, and is judged as the host
``''``. A page without outcome takes part only as a page to judge; several outcomes of a page count as
the worst. Null ids have no outcome. Repeated rows count, and are judged, as often as they occur. Without
any outcome all pages are allowed. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treesift.llm.common import narrow

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Labels below which, under a country's two letters, names are registered by anyone.
SECOND_LABELS = "ac asn co com edu gob gouv gov go id mil ne net nom or org res sch web".split()
LONG_SUFFIX = rf"^(?:{'|'.join(SECOND_LABELS)})[.][a-z][a-z]$"
# Numeric addresses are their own domain; they have no suffix but share one level.
ADDRESS = r"^[0-9.]+(?::[0-9]*)?$|^\["
NUMERIC = "(address)"


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str  # host/path


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = [F.coalesce(F.regexp_extract(url, pattern, k), F.lit("")) for k in (1, 2)]
    return F.translate(part[0], UPPER, LOWER), part[1]


def suffix_of(host: Column) -> Column:
    last = F.substring_index(host, ".", -2)
    named = F.when(last.rlike(LONG_SUFFIX), last).otherwise(F.substring_index(host, ".", -1))
    return F.when(host.rlike(ADDRESS), NUMERIC).otherwise(named)


def domain_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    named = F.when(two.rlike(LONG_SUFFIX), F.substring_index(host, ".", -3)).otherwise(two)
    return F.when(host.rlike(ADDRESS), host).otherwise(named)


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest fitting rule, or nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in reversed(sorted(rules, key=lambda r: -len(r.text))):  # the longest is asked first
        own, slash, start = rule.text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + start)
        text = F.when(fits, rule.text).otherwise(text)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def _digamma(x: Column) -> Column:
    y = x + 6
    series = F.log(y) - 1 / (2 * y) - 1 / (12 * y * y) + 1 / (120 * y * y * y * y)
    for k in range(6):
        series = series - 1 / (x + k)
    return series


def _trigamma(x: Column) -> Column:
    y = x + 6
    series = 1 / y + 1 / (2 * y * y) + 1 / (6 * y * y * y) - 1 / (30 * y * y * y * y * y)
    for k in range(6):
        series = series + 1 / ((x + k) * (x + k))
    return series


def _concentration(level: DataFrame) -> float:
    """From ``n``, ``bad`` and the parent's ``mean``, by the moments of the beta-binomial."""
    n, spread = F.col("n"), F.col("mean") * (1 - F.col("mean"))
    deviation = F.col("bad") / n - F.col("mean")
    row = level.where("n > 0").agg(
        F.sum(n * deviation * deviation).alias("seen"), F.sum(spread).alias("least"), F.sum(spread * (n - 1)).alias("more")
    ).first()
    if not row["more"]:
        return 2.0
    share = min(0.999, max(0.001, (row["seen"] - row["least"]) / row["more"]))
    return round(1 / share - 1, 6)


def host_reputations(pages: DataFrame, outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """``host`` with ``n``, ``bad``, the posterior ``mean`` and its lower bound ``low``.

    ``pages`` has ``page_id`` and ``host``; ``outcomes`` has distinct ``page_id`` and ``bad`` (0 or 1).
    """
    joined = pages.join(outcomes, "page_id", "left")
    hosts = joined.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    level = suffixes.withColumn("mean", F.lit(((total["bad"] or 0) + 1) / ((total["n"] or 0) + 2)))
    for children, key in ((domains, "suffix"), (hosts, "domain"), (None, None)):
        weight = _concentration(level)
        level = level.withColumn("a", F.col("mean") * weight + F.col("bad"))
        level = level.withColumn("b", (1 - F.col("mean")) * weight + F.col("n") - F.col("bad"))
        if children is not None:
            prior = level.select(key, (F.col("a") / (F.col("a") + F.col("b"))).alias("mean"))
            level = children.join(prior, key)
    centre = _digamma(F.col("a")) - _digamma(F.col("b"))
    low = centre - z * F.sqrt(_trigamma(F.col("a")) + _trigamma(F.col("b")))
    return level.select(
        "host", "n", "bad", (F.col("a") / (F.col("a") + F.col("b"))).alias("mean"), (1 / (1 + F.exp(-low))).alias("low")
    )


def judged(
    pages: DataFrame, outcomes: DataFrame, rules: list[Rule], limit: float = 0.5, z: float = 1.645,
    id_col: str = "page_id", url_col: str = "url",
) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``low`` of every page."""
    host, path = host_and_path(F.col("url"))
    rows = narrow(pages, page_id=id_col, url=url_col).select("page_id", host.alias("host"), path.alias("path"))
    best = outcomes.where("page_id is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    known = host_reputations(rows.select("page_id", "host"), best, z)
    text, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    found = rows.join(known.select("host", F.round("low", 6).alias("low")), "host", "left")
    own = F.when(F.col("low") > limit, "block").otherwise("allow")
    return found.select("page_id", "host", "path", text.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "low")
