"""URL filter with empirical-Bayes host reputation, with DataFrame functions only.

Explicit rules come first. What no rule covers is judged by the outcomes (bad or not) of labelled
pages: the rate of bad pages is estimated for the suffix (``com``, ``co.uk``), the registered domain
and the host in turn. Each estimate is a beta posterior whose prior has the mean of the level above
and a strength estimated from how much the rates on that level scatter around it beyond chance
(method of moments for the beta-binomial). A host is blocked if the lower bound of its posterior, mean
minus ``Z`` standard deviations, is above ``LIMIT``; hosts without labels inherit their domain's.

A hot host costs nothing: outcomes are summed before the shuffle, and the estimates, one row per
host, are joined back by a broadcast of checked size or a join whose hot partitions Spark splits.

Defined results: a null url, or one without ``://``, has an empty host and path, is its own host
with an empty suffix, and fits no rule; pages with null ids have no label and are judged like others;
of repeated labels of one id the worst counts; without any label nothing is blocked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazegrid.llm.common import ascii_lower, join_measured, stored

# suffixes of two labels under which names are registered
DOUBLE_SUFFIXES = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "com.br", "com.cn", "com.mx", "com.tr",
                   "co.in", "co.jp", "ne.jp", "or.jp", "co.kr", "co.nz", "co.za")
LIMIT = 0.5
Z = 1.645
STRENGTHS = (1.0, 1000.0)  # least and greatest weight of a prior, in pages

Rule = tuple[str, str, str]  # verdict, host, path


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return ascii_lower(raw), F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"^[^?#]*", 0)


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule string, verdict) of the longest rule that fits, null if none does."""
    longest = sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1])), reverse=True)
    fits = [((host == h) | host.endswith(f".{h}")) & path.startswith(p) for _, h, p in longest]
    none = F.lit(None).cast("string")
    rule = F.coalesce(*(F.when(f, h + p) for f, (_, h, p) in zip(fits, longest)), none)
    return rule, F.coalesce(*(F.when(f, v) for f, (v, _, _) in zip(fits, longest)), none)


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    last2 = F.substring_index(bare, ".", -2)
    double = last2.isin(*DOUBLE_SUFFIXES)
    address = bare.rlike(r"^[0-9.]+$") | bare.startswith("[")
    suffix = F.when(address, "").when(double, last2).otherwise(F.substring_index(bare, ".", -1))
    return F.when(address, bare).when(double, F.substring_index(bare, ".", -3)).otherwise(last2), suffix


def _posterior(units: DataFrame, of: str) -> DataFrame:
    """``units``: a row per unit with n, bad and the prior mean ``prior``. Adds the posterior's two
    parameters under names that end in ``of``; the strength is one number for the level."""
    expected = F.col("n") * F.col("prior") * (1 - F.col("prior"))
    excess = F.sum((F.col("bad") - F.col("n") * F.col("prior")) ** 2 - expected)
    rho = units.agg(F.try_divide(excess, F.sum(expected * (F.col("n") - 1)))).first()[0]
    low, high = STRENGTHS
    strength = high if rho is None or rho <= 0 else min(high, max(low, 1 / rho - 1))
    return units.withColumn(f"a_{of}", strength * F.col("prior") + F.col("bad")).withColumn(
        f"b_{of}", strength * (1 - F.col("prior")) + F.col("n") - F.col("bad"))


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """(host, domain, suffix, bad: 0, 1 or null) -> host, n, bad, rate, lower_bound for every host."""
    hosts = stored(outcomes.groupBy("host", "domain", "suffix").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")), "hosts")

    def up(level: str, *keys: str) -> DataFrame:
        return hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))

    overall = hosts.agg(F.sum("bad") / F.sum("n")).first()[0] if hosts.where("n > 0").take(1) else 0.0
    suffixes = _posterior(stored(up("suffix", "suffix").withColumn("prior", F.lit(float(overall))), "suffixes"), "s")
    prior = stored(suffixes.select(F.col("suffix").alias("_s"), (F.col("a_s") / (F.col("a_s") + F.col("b_s"))).alias("prior")), "prior")
    domains = _posterior(stored(join_measured(up("domain", "domain", "suffix"), prior, [("suffix", "_s")]), "domains"), "d")
    prior = stored(domains.select(F.col("domain").alias("_d"), F.col("suffix").alias("_s"), (F.col("a_d") / (F.col("a_d") + F.col("b_d"))).alias("prior")), "prior")
    judged = _posterior(stored(join_measured(hosts, prior, [("domain", "_d"), ("suffix", "_s")]), "judged"), "h")
    a, b = F.col("a_h"), F.col("b_h")
    spread = F.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
    return judged.select("host", "n", "bad", (a / (a + b)).alias("rate"), (a / (a + b) - Z * spread).alias("lower_bound"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[Rule], page_id: str = "page_id", url: str = "url",
               label_id: str = "doc_id", bad: Column | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), bad rate and its lower bound."""
    host, path = host_and_path(F.col(f"`{url}`"))
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), host.alias("host"), path.alias("path"))
    if bad is None:
        bad = F.greatest(F.col("toxic"), 1 - F.col("quality"))
    known = labels.select(F.col(f"`{label_id}`").alias("_id"), bad.cast("int").alias("_bad")).groupBy("_id").agg(F.max("_bad").alias("bad"))
    domain, suffix = domain_and_suffix(F.col("host"))
    outcomes = rows.join(known, F.col("page_id") == F.col("_id"), "left").select("host", domain.alias("domain"), suffix.alias("suffix"), "bad")
    fame = stored(host_reputation(outcomes).select(F.col("host").alias("_host"), "rate", "lower_bound"), "fame")
    rule, ruled = fitting_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("lower_bound") > LIMIT, "block").otherwise("allow")
    return join_measured(rows, fame, [("host", "_host")]).select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(ruled, own).alias("verdict"), "rate", "lower_bound")
