"""URL filters: longest rule first, else the reputation of the host by empirical Bayes.

Labelled page outcomes are counted per host, registered domain (last two labels) and suffix (last label). Each level is
a beta-binomial whose mean is the posterior mean of the level above and whose strength is fitted, by moments, to how much
children of that level differ: a host with few pages leans on its domain, a domain on its suffix, a suffix on all pages.
A host is blocked where even the upper bound of its good share is below LEAST_GOOD.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, prepare, written

#: The rules (verdict, host, path) of the query.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Blocked below this good share at the upper end of BOUND standard deviations of the posterior.
LEAST_GOOD, BOUND = 0.5, 1.645


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def domain_of(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """(verdict, rule) of the longest rule that fits; of equally long ones a block. Null where none fits."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, own, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(own + start).alias("rule"))).otherwise(out)
    return out


def _strength(rows: DataFrame, good: str, n: str, mean: str) -> DataFrame:
    """One row: pseudo-counts that the level above is worth, from the overdispersion of its children."""
    m = F.least(F.greatest(F.col(mean), F.lit(1e-6)), F.lit(1 - 1e-6))
    over = F.sum(F.pow(F.col(good) - F.col(n) * m, F.lit(2)) / (m * (1 - m))) - F.sum(n)
    pairs = F.sum(F.col(n).cast("double") * (F.col(n) - 1))
    rho = F.least(F.greatest(F.coalesce(F.try_divide(over, pairs), F.lit(0.5)), F.lit(0.001)), F.lit(0.9))
    return rows.agg((1 / rho - 1).alias("_strength"))


def _level(children: DataFrame, key: str, parents: DataFrame | None, parent: str | None) -> DataFrame:
    """(key, good, n) with the posterior (a, b) and its mean, given the parents' means."""
    counts = children.groupBy(*dict.fromkeys([key, parent] if parent else [key])).agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    if parents is None:
        prior = counts.agg((F.sum("good") / F.sum("n")).alias("_prior"))
        counts = counts.join(F.broadcast(prior))  # one row
    else:
        counts = counts.join(parents.select(F.col(parent), F.col("mean").alias("_prior")), parent)
    counts = written(counts, "reputation")
    strength = _strength(counts, "good", "n", "_prior")
    return (counts.join(F.broadcast(strength))  # one row
            .select(*[c for c in counts.columns if c not in ("_prior",)], (F.col("good") + F.col("_strength") * F.col("_prior")).alias("a"),
                    (F.col("n") - F.col("good") + F.col("_strength") * (1 - F.col("_prior"))).alias("b"))
            .withColumn("mean", F.col("a") / (F.col("a") + F.col("b"))))


def reputations(outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(host, good) rows, good 1 or 0 -> posteriors of hosts, domains and suffixes. Null outcomes are not counted."""
    hosts = (outcomes.where(F.col("good").isin(0, 1)).groupBy("host").agg(F.sum(F.col("good").cast("long")).alias("good"), F.count(F.lit(1)).alias("n"))
             .select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "good", "n"))
    hosts = written(hosts, "reputation-hosts")
    suffixes = _level(hosts, "suffix", None, None)
    domains = _level(hosts, "domain", suffixes, "suffix")
    return _level(hosts, "host", domains, "domain"), domains, suffixes


def judged(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url: str = "url", rules=RULES, least_good: float = LEAST_GOOD,
           bound: float = BOUND) -> DataFrame:
    """(id, host, path, rule, verdict, good_share, upper) per row of `pages`; outcomes: (host, good).

    A url that is null or has no "://" has an empty host and path. Where no rule fits, hosts without outcomes of their own are
    judged by their domain, else their suffix; a suffix without outcomes is allowed, as is the empty host. The bound is a normal
    one on the beta posterior; a tie with the threshold is allowed. Repeated rows are judged alike. Other columns are not looked at.
    """
    prepare(pages.sparkSession)
    found = pages.select(F.col(id_col).alias("_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    named = written(found.select("*", rule_for(F.col("host"), F.col("path"), rules).alias("_rule")), "urls")
    hosts, domains, suffixes = reputations(outcomes)

    def posterior(prefix: str) -> list[Column]:
        return [F.col(c).alias(prefix + c) for c in ("a", "b")]

    # One row per distinct host, so a hot host weighs no more than any other until its verdict meets its pages.
    distinct = named.select("host").distinct().withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    met = (distinct.join(hosts.select("host", *posterior("h")), "host", "left").join(domains.select("domain", *posterior("d")), "domain", "left")
           .join(suffixes.select("suffix", *posterior("s")), "suffix", "left"))
    a, b = F.coalesce("ha", "da", "sa"), F.coalesce("hb", "db", "sb")
    upper = a / (a + b) + bound * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    verdicts = written(met.select("host", (a / (a + b)).alias("good_share"), upper.alias("upper"),
                                  F.when((F.col("host") != "") & (upper < least_good), "block").otherwise("allow").alias("_verdict")), "url-verdicts")
    return named.join(verdicts, "host").select(F.col("_id").alias(id_col), "host", "path", F.col("_rule.rule").alias("rule"),
                                               F.coalesce(F.col("_rule.verdict"), F.col("_verdict")).alias("verdict"), "good_share", "upper")
