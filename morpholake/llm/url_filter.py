"""URL filter: rules first, then empirical-Bayes host reputation, in DataFrame functions only.

Reputation shrinks a host's bad share towards its registered domain's, that towards its suffix's, that towards all
pages': a beta-binomial prior at each level, its weight estimated from the spread between the level's groups (method of
moments).  A host is blocked where even the lower posterior bound of its bad share is over the limit, so few outcomes
never block a host.  Sums of outcomes are all that is shuffled; a hot host is one row after partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .common import column, materialize

#: (host, path, verdict): the rules of the contract.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
LIMIT = 0.5
Z = 1.64
WEIGHTS = (1.0, 1000.0)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ://, up to / ? # or the end, A-Z lower-cased; empty for null or where there is no ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host, up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    return ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)


def apply_rules(urls: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """Adds rule (host and path joined, null if none fits) and rule_verdict: the longest fitting rule's; of equals, the first."""
    rule = verdict = F.lit(None).cast("string")
    for host, path, said in sorted(rules, key=lambda r: len(r[0] + r[1])):  # longer ones are asked first
        fits = rule_fits(F.col("host"), F.col("path"), host, path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return urls.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def bare_host(host: Column) -> Column:
    """The host without a user name before it or a port after it."""
    return F.regexp_replace(F.regexp_replace(host, "(?s)^.*@", ""), r":[0-9]*$", "")


def with_levels(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """hosts with suffix and domain (the registered one: the suffix and the label before it).

    suffixes: a table (suffix) of those under which domains are registered, such as `co.uk`; of those that end a host the
    longest counts.  Without one that fits, or without the table, the last label is the suffix."""
    labels = F.split(bare_host(F.col("host")), r"\.")
    tail = lambda n: F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - n + 1), F.size(labels)), ".")
    if suffixes is None:
        return hosts.withColumns({"domain": tail(F.lit(2)), "suffix": tail(F.lit(1))})
    tails = hosts.select("host", F.explode(F.sequence(F.lit(1), F.size(labels))).alias("_n"), labels.alias("_l")).withColumn("_tail", F.array_join(F.slice("_l", F.size("_l") - F.col("_n") + 1, F.col("_n")), "."))
    known = tails.join(suffixes.select(F.col("suffix").alias("_suffix")).distinct(), F.col("_tail") == F.col("_suffix")).groupBy(F.col("host").alias("_host")).agg(F.max("_n").alias("_n"))
    n = F.coalesce("_n", F.lit(1))
    return hosts.join(known, F.col("host") == F.col("_host"), "left").withColumns({"domain": tail(n + 1), "suffix": tail(n)}).drop("_host", "_n")


def _weight(moments: Row) -> float:
    """The prior's weight from c, v and e: sums over groups of m(1 - m) n, (share - m)^2 n and m(1 - m)."""
    low, high = WEIGHTS
    if moments["c"] is None or moments["c"] <= 0 or moments["v"] <= moments["e"]:
        return high
    return min(high, max(low, moments["c"] / (moments["v"] - moments["e"]) - 1))


def _posterior(joined: DataFrame, *keys: str) -> DataFrame:
    """keys, a and b of each group of a level.  joined: keys, bad, n and m, the parent's posterior mean.

    The prior's weight comes from all groups with more than one outcome: their shares vary around m, by chance alone with
    m(1 - m)/n.  One row of sums comes to the driver."""
    spread, chance = F.pow(F.col("bad") / F.col("n") - F.col("m"), 2), F.col("m") * (1 - F.col("m"))
    moments = joined.filter("n > 1").agg(F.sum(chance * F.col("n")).alias("c"), F.sum(spread * F.col("n")).alias("v"), F.sum(chance).alias("e")).first()
    w = F.lit(float(_weight(moments)))
    return joined.select(*keys, (F.col("bad") + w * F.col("m")).alias("a"), (F.col("n") - F.col("bad") + w * (1 - F.col("m"))).alias("b"))


def reputation(outcomes: DataFrame, public_suffixes: DataFrame | None = None) -> DataFrame:
    """(host, mean, low): posterior mean and lower bound of the bad share of every host in outcomes.

    outcomes: host, bad (true, false, or null for a page without an outcome).  A host without outcomes has its domain's
    posterior mean; without any outcome at all, every host has mean 1/2 and a bound below it.  The sums of each level are
    written to the shared folder: pages are read once, and each level joins the one above by its key."""
    hosts = outcomes.groupBy("host").agg(F.coalesce(F.sum(F.col("bad").cast("int")), F.lit(0)).alias("bad"), F.count("bad").alias("n"))
    hosts = materialize(with_levels(hosts, public_suffixes), "hosts")
    domains = materialize(hosts.groupBy("domain", "suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")), "domains")
    suffixes = materialize(domains.groupBy("suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")), "suffixes")
    whole = suffixes.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    mean = F.col("a") / (F.col("a") + F.col("b"))
    top = _posterior(suffixes.withColumn("m", F.lit((whole["bad"] + 1) / (whole["n"] + 2))), "suffix").select(F.col("suffix").alias("_up"), mean.alias("m"))
    mid = _posterior(materialize(domains.join(top, F.col("suffix") == F.col("_up")), "domains"), "domain").select(F.col("domain").alias("_up"), mean.alias("m"))
    low = _posterior(materialize(hosts.join(mid, F.col("domain") == F.col("_up")), "hosts"), "host")
    total = F.col("a") + F.col("b")
    return low.select("host", mean.alias("mean"), (mean - Z * F.sqrt(F.col("a") * F.col("b") / (total * total * (total + 1)))).alias("low"))


def judge(pages: DataFrame, bad: Column, page_id: str = "page_id", url: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES, public_suffixes: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), bad_share and bad_share_low, one row per row of pages.

    bad: the page's labelled outcome as a Column over pages (true, false or null for none).  Null urls and urls without
    :// have the empty host and path, which is a host of its own.  Repeated rows stay and count as outcomes each; an empty
    table gives an empty result.  public_suffixes (suffix): see with_levels.  Columns other than page_id, url and those of bad are not read, so names cannot clash."""
    urls = pages.select(column(page_id).alias("page_id"), host_of(column(url)).alias("host"), path_of(column(url)).alias("path"), bad.alias("bad"))
    known = reputation(urls.select("host", "bad"), public_suffixes)
    ruled = apply_rules(urls.drop("bad"), rules)
    joined = ruled.join(known.withColumnRenamed("host", "_host"), F.col("host") == F.col("_host"), "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.when(F.col("low") > LIMIT, "block").otherwise("allow")).alias("verdict"), F.col("mean").alias("bad_share"), F.col("low").alias("bad_share_low"))
