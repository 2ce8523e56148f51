"""URL filter: fixed rules first, then the reputation of the host, learned by empirical Bayes from labelled pages.

Hosts are shrunk to their registered domain, domains to their suffix, suffixes to the whole. At each level the groups' shares of bad
pages are beta-distributed around the parent's mean with a common precision, which the moments give: with n pages, k bad ones and the
parent's mean m, (k - n*m)^2 - n*m*(1-m) has the expectation n*(n-1)*m*(1-m)*rho, so rho is the sum of the former over the sum of the
latter, and the precision 1/rho - 1. A group's mean is (k + precision*m) / (n + precision); a host's posterior is the beta distribution
of precision*m + k and precision*(1-m) + n - k. A host is blocked when the lower bound of its share of bad pages at the confidence
exceeds the limit, which is: when the posterior probability of a share above the limit reaches the confidence.

Defined cases: a null url, or one without "://", has an empty host and path; the empty host is a host like others. Host names keep
user and port as written, but are grouped without them; an IPv4 address is its own domain and has no suffix. Without labels the prior is
one half with the least precision, and no host is blocked. Repeated rows count each; a null page_id is judged like others. Other columns
of the tables are not read."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallium.llm.common import Staged, looked_up


class Rule(NamedTuple):
    """For the host and all its subdomains, where the path starts so."""

    verdict: str
    host: str
    path: str


#: Rules are configuration, evaluated as one expression.
MOST_RULES = 200
#: Bounds of the correlation of pages in a group; precisions are then from 1 to 9999.
LEAST_RHO, MOST_RHO = 1e-4, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Half width and step of the posterior's integral on the log-odds scale, in standard deviations.
REACH, STEP = 40, 0.05


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(rules: Sequence[Rule], host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((F.col(host) == r.host) | F.endswith(F.col(host), F.lit(f".{r.host}"))) & F.startswith(F.col(path), F.lit(r.path))
        name, verdict = F.when(fits, r.host + r.path).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def domain_and_suffix(host: Column, suffixes: Sequence[str] = ()) -> tuple[Column, Column]:
    """Registered domain and suffix: the last label is the suffix, or one of the given ones of more labels."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"(:\d*|\.+)$", "")
    suffix = F.substring_index(bare, ".", -1)
    for s in sorted(suffixes, key=len):
        suffix = F.when((bare == s) | F.endswith(bare, F.lit(f".{s}")), s).otherwise(suffix)
    labels = F.length(suffix) - F.length(F.replace(suffix, F.lit("."), F.lit(""))) + 2
    is_address = F.rlike(bare, F.lit(r"^\d+(\.\d+){3}$"))
    domain = F.call_function("substring_index", bare, F.lit("."), -labels)
    return F.when(is_address, bare).otherwise(domain), F.when(is_address, "").otherwise(suffix)


def precision(groups: DataFrame) -> float:
    """Of the groups' shares around their parents' means. groups: n, k, m."""
    spread = F.sum((F.col("k") - F.col("n") * F.col("m")) ** 2 - F.col("n") * F.col("m") * (1 - F.col("m")))
    base = F.sum(F.col("n") * (F.col("n") - 1) * F.col("m") * (1 - F.col("m")))
    r = groups.select(F.col("n").cast("double"), F.col("k").cast("double"), "m").agg(spread.alias("spread"), base.alias("base")).first()
    rho = r["spread"] / r["base"] if r["base"] else MOST_RHO
    return 1 / min(MOST_RHO, max(LEAST_RHO, rho)) - 1


def shrunk(strength: float) -> Column:
    return (F.col("k") + strength * F.col("m")) / (F.col("n") + strength)


def probability_above(a: str, b: str, limit: float) -> Column:
    """Of a beta variable: the integral over its log-odds by midpoints, with the limit between two of them."""
    at, points = math.log(limit / (1 - limit)), round(2 * REACH / STEP)
    spread = f"sqrt(({a} + {b}) / ({a} * {b}))"
    start = f"floor((ln({a} / {b}) - {at}D) / ({STEP}D * {spread})) - {points // 2}"
    u = f"({at}D + (p.start + i + 0.5D) * p.h)"
    weight = f"exp({a} * ({u} - p.top) - ({a} + {b}) * (ln(1 + exp({u})) - p.base))"
    total = f"aggregate(sequence(0, {points - 1}), named_struct('all', 0D, 'above', 0D), (s, i) -> named_struct('all', s.all + {weight}, 'above', s.above + if(p.start + i >= 0, {weight}, 0D)), s -> s.above / s.all)"
    setting = f"array(named_struct('start', {start}, 'h', {STEP}D * {spread}, 'top', ln({a} / {b}), 'base', ln(1 + {a} / {b})))"
    return F.expr(f"transform({setting}, p -> {total})[0]")


def host_reputations(pages: DataFrame, limit: float, confidence: float, suffixes: Sequence[str] = ()) -> tuple[DataFrame, int]:
    """host, weight (pages), n_labelled, n_bad, posterior_mean, posterior_above, blocked for each host, stored; and the number of pages.
    pages: host, bad (null: not labelled).

    Means go down the levels through looked_up, so a domain or suffix may hold any share of the hosts."""
    sums = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    domain, suffix = domain_and_suffix(F.col("host"), suffixes)
    counted = pages.groupBy("host").agg(F.count(F.lit(1)).alias("weight"), F.count("bad").alias("n"), F.count_if("bad").alias("k"))
    hosts = Staged(counted.withColumns({"domain": domain, "suffix": suffix}), "hosts")
    whole = hosts.df.agg(F.sum("weight").alias("pages"), F.count(F.lit(1)).alias("hosts"), *sums).first()
    if not whole["pages"]:
        return hosts.df.select("host", "weight", F.col("n").alias("n_labelled"), F.col("k").alias("n_bad"), F.lit(0.5).alias("posterior_mean"), F.lit(0.0).alias("posterior_above"), F.lit(False).alias("blocked")), 0
    by_domain = Staged(hosts.df.groupBy("domain", "suffix").agg(*sums, F.count(F.lit(1)).alias("weight")), "domains")
    by_suffix = Staged(by_domain.df.groupBy("suffix").agg(*sums, F.count(F.lit(1)).alias("weight")).withColumn("m", F.lit((whole["k"] + 0.5) / (whole["n"] + 1))), "suffixes")
    means = by_suffix.df.select("suffix", "weight", shrunk(precision(by_suffix.df)).alias("m"))
    domains = Staged(looked_up(by_domain.df.withColumnRenamed("weight", "hosts"), means, "suffix", by_domain.df.count(), "inner"), "domain-means")
    means = domains.df.select("domain", F.col("hosts").alias("weight"), shrunk(precision(domains.df)).alias("m"))
    placed = Staged(looked_up(hosts.df.withColumnRenamed("weight", "pages"), means, "domain", whole["hosts"], "inner"), "host-means")
    strength = precision(placed.df)
    posterior = placed.df.select("host", F.col("pages").alias("weight"), F.col("n").alias("n_labelled"), F.col("k").alias("n_bad"), (F.col("k") + strength * F.col("m")).alias("a"), (F.col("n") - F.col("k") + strength * (1 - F.col("m"))).alias("b"))
    judged = posterior.select("host", "weight", "n_labelled", "n_bad", (F.col("a") / (F.col("a") + F.col("b"))).alias("posterior_mean"), probability_above("a", "b", limit).alias("posterior_above"))
    out = Staged(judged.withColumn("blocked", (F.col("posterior_above") >= confidence) & F.lit(whole["n"] > 0)), "reputations")
    for s in (hosts, by_domain, by_suffix, domains, placed):
        s.drop()
    return out.df, whole["pages"]


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule], limit: float = 0.5, confidence: float = 0.95, suffixes: Sequence[str] = ()) -> DataFrame:
    """page_id, host, path, rule, verdict, n_labelled, n_bad, posterior_mean, posterior_above of each page.

    pages: page_id, url; outcomes: url, bad for the labelled pages, bad null where not known (any other rows of the same collection)."""
    of = lambda df, *more: df.select(*more, host_and_path(F.col("url").cast("string"))[0].alias("host"), host_and_path(F.col("url").cast("string"))[1].alias("path"))
    reputations, total = host_reputations(of(outcomes, F.col("bad").cast("boolean").alias("bad")), limit, confidence, suffixes)
    rows = looked_up(of(pages, F.col("page_id").cast("long").alias("page_id")), reputations, "host", total, "left")
    rule, verdict = longest_rule(rules)
    own = F.when(F.col("blocked"), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "n_labelled", "n_bad", F.round("posterior_mean", 6).alias("posterior_mean"), F.round("posterior_above", 6).alias("posterior_above"))
