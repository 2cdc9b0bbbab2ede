"""URL verdicts by rules and by the reputation of hosts, in SQL functions.

A rule names a host with its subdomains and the start of a path; the longest that fits
decides. For other pages the labelled outcomes of their host decide: counts of good and
bad pages are shrunk from host to registered domain to public suffix to all pages. At
each level the parent's posterior mean is the prior mean, and the prior's strength is
fitted by moments to the rates found at that level. A host is blocked when even the
lower bound of its posterior bad rate is above a limit.

A url that is null or without ``://`` has an empty host and path, fits no rule, and is
judged by the pages of the empty host, that is, allowed unless those are bad. Labels
may be null (not labelled). Repeated rows count as often as they occur.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.sources.scratch import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Suffixes of several labels below which names are registered; a parameter, to be
#: filled from a public list.
SUFFIXES: tuple[str, ...] = ("co.uk", "org.uk", "com.au", "co.jp", "com.br")
#: Standard deviations below the mean, and the limit on that bound.
BOUND_DEVIATIONS, MOST_BAD = 1.645, 0.5
LEVELS = ("suffix", "domain", "host")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The last two labels where they are a known suffix, else the last one."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, suffix: Column) -> Column:
    """The registered domain: one label more than the suffix."""
    three = F.size(F.split(suffix, r"\.")) == 2
    return F.when(three, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def longest_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest of the rules, like ``example.org/es/``, that fits; null if none."""

    def fits(rule: str) -> Column:
        name, start = rule.split("/", 1)
        below = (host == name) | host.endswith(f".{name}")
        return below & path.startswith(f"/{start}")

    ordered = sorted(rules, key=lambda rule: (-len(rule), rule))
    found = reduce(lambda rest, rule: F.when(fits(rule), rule).otherwise(rest), reversed(ordered), F.lit(None))
    return found.cast("string")


def _names(table: DataFrame, suffixes: Sequence[str]) -> DataFrame:
    named = table.withColumn("suffix", suffix_of(F.col("host"), suffixes))
    return named.withColumn("domain", domain_of(F.col("host"), F.col("suffix")))


def _strength(level: DataFrame) -> float:
    """How many pages the parent's rate weighs, fitted to the rates ``k / n`` around
    the parents' means ``prior``."""
    n, k, m = F.col("n"), F.col("k"), F.col("prior")
    spread = m * (1 - m)
    sums = level.agg(
        F.sum(n * spread).alias("sampling"),
        F.sum(n * n * F.pow(k / n - m, 2)).alias("found"),
        F.sum(n * (n - 1) * spread).alias("pairs"),
    ).first()
    beyond = (sums.found or 0.0) - (sums.sampling or 0.0)
    if beyond <= 0:
        return 1000.0
    return round(min(max((sums.pairs or 0.0) / beyond - 1, 1.0), 1000.0), 6)


def reputation(
    hosts: DataFrame,
    suffixes: Sequence[str] = SUFFIXES,
    deviations: float = BOUND_DEVIATIONS,
    most_bad: float = MOST_BAD,
) -> DataFrame:
    """``(host, blocked)`` from every host's labelled counts ``(host, n, k)``.

    A host without labelled pages takes the verdict of its domain, of its suffix, or of
    all pages.
    """
    named = hosts.withColumn("suffix", suffix_of(F.col("host"), suffixes))
    hosts = cut_lineage(named.withColumn("domain", domain_of(F.col("host"), F.col("suffix"))), "hosts")
    whole = hosts.agg(F.sum("k").alias("k"), F.sum("n").alias("n")).first()
    if not whole.n:
        return hosts.select("host", F.lit(False).alias("blocked"))
    parent = None
    overall = (whole.k + 1) / (whole.n + 2)
    by_all = round(overall - deviations * math.sqrt(overall * (1 - overall) / (whole.n + 3)), 9) > most_bad
    verdicts = hosts
    for depth, level in enumerate(LEVELS):
        above = list(LEVELS[max(0, depth - 1) : depth])
        counts = hosts.groupBy(level, *above).agg(F.sum("n").alias("n"), F.sum("k").alias("k")).where("n > 0")
        if parent is None:
            table = counts.withColumn("prior", F.lit(overall))
        else:
            table = counts.join(parent, above)
        table = cut_lineage(table, level)
        strength = _strength(table)
        total = F.col("n") + strength
        rate = (F.col("k") + strength * F.col("prior")) / total
        bound = rate - deviations * F.sqrt(rate * (1 - rate) / (total + 1))
        judged = table.select(level, rate.alias("prior"), (F.round(bound, 9) > most_bad).alias(f"by_{level}"))
        parent = judged.select(level, "prior")
        verdicts = verdicts.join(judged.drop("prior"), level, "left")
    return verdicts.select("host", F.coalesce("by_host", "by_domain", "by_suffix", F.lit(by_all)).alias("blocked"))


def judge(pages: DataFrame, rules: dict[str, str], suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` of every page.

    ``rules`` gives ``allow`` or ``block``. Pages that a rule decides are the labelled
    outcomes, from which the hosts' reputation follows.
    """
    split = pages.select(
        F.col("page_id").cast("long"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    ruled = split.withColumn("rule", longest_rule(F.col("host"), F.col("path"), rules))
    ordered = sorted(rules)
    decided = reduce(
        lambda rest, rule: F.when(F.col("rule") == rule, rules[rule]).otherwise(rest), ordered, F.lit(None)
    ).cast("string")
    marked = cut_lineage(ruled.withColumn("decided", decided), "ruled")
    counts = marked.groupBy("host").agg(
        F.count("decided").alias("n"), F.sum((F.col("decided") == "block").cast("long")).alias("k")
    )
    blocked = reputation(counts.withColumn("k", F.coalesce("k", F.lit(0))), suffixes).where("blocked")
    verdicts = cut_lineage(blocked, "blocked_hosts")
    by_host = F.when(F.col("blocked"), "block").otherwise("allow")
    return marked.join(verdicts, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("decided", by_host).alias("verdict")
    )
