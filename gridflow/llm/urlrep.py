"""URL filters: empirical-Bayes host reputation.

Outcomes of labelled pages are summed per host. Good-page rates are shrunk
down the name: the corpus rate is the prior of each suffix, the suffix of each
registered domain, the domain of each host. Every level's prior is a beta
distribution whose strength is fitted to the beta-binomial by the method of
moments over all groups of that level. A host is blocked only if the upper
posterior bound of its good rate is under a limit. Explicit rules come first.

All statistics are sums: one partial row per host and task is shuffled, so a
host with a third of all pages costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridflow.session import land

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Suffixes of two labels under which names are registered, where no table of them is given.
TWO_LABEL_SUFFIXES = ["ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br",
                      "com.cn", "com.mx", "com.tr", "gov.uk", "net.au", "org.au", "org.uk"]

LONGEST_HOST = 253 # characters of a host that a name server can know
MIN_CHILDREN = 10  # names under a name that make it a suffix
MIN_GOOD = 0.5     # hosts whose upper bound is under this are blocked
Z = 1.645          # of the bound: one-sided 95 %
MIN_STRENGTH, MAX_STRENGTH = 2.0, 1000.0


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; empty without ``://`` or for null."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def suffix_of(host: Column) -> Column:
    """Last label, or the last two if names are registered under them."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """Registered domain: the suffix and one label more (the host if it has none)."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def named(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """``hosts(host, ...)`` (distinct) with ``suffix`` and ``domain``.

    ``suffixes(suffix)`` are rules as in the public suffix list: plain suffixes of any
    number of labels, ``*.x`` (any one label under x) and ``!a.x`` (but not this one).
    The longest that fits holds, exceptions first; without one it is the last label.
    """
    if suffixes is None:
        return hosts.withColumns({"suffix": suffix_of(F.col("host")), "domain": domain_of(F.col("host"))})
    rules = land(suffixes.select(F.translate("suffix", UPPER, LOWER).alias("rule")).where("rule is not null").distinct(), "url-rules")
    most = rules.agg(F.max(F.size(F.split("rule", r"\.")))).first()[0] or 1
    d = hosts.select("host", F.explode(F.sequence(F.lit(1), F.least(F.size(F.split("host", r"\.")), F.lit(most)))).alias("j"))
    d = d.withColumn("end", F.expr("substring_index(host, '.', -j)"))
    d = d.select("host", "j", F.explode(F.array(
        F.col("end"), F.when(F.col("j") > 1, F.concat(F.lit("*."), F.expr("substring_index(end, '.', 1 - j)"))),
        F.concat(F.lit("!"), F.col("end")))).alias("rule"))
    # of an exception the suffix is one label shorter
    d = d.join(rules, "rule").groupBy(F.col("host").alias("__host")).agg(F.coalesce(
        F.max(F.when(F.col("rule").startswith("!"), F.col("j") - 1)), F.max("j")).alias("__j"))
    d = hosts.join(d, F.col("host") == F.col("__host"), "left").withColumn("__j", F.coalesce("__j", F.lit(1)))
    return d.withColumns({"suffix": F.expr("substring_index(host, '.', -__j)"),
                          "domain": F.expr("substring_index(host, '.', -__j - 1)")}).drop("__host", "__j")


def derived_suffixes(hosts: DataFrame, min_children: int = MIN_CHILDREN) -> DataFrame:
    """``suffix``: names of two or more labels under which ``hosts(host)`` show ``min_children`` different
    names or more (longer ones than ``LONGEST_HOST`` characters are none): there, as under a country's ``co`` or at a host of sites, names belong to many owners."""
    label = F.split("host", r"\.")
    d = hosts.select("host").distinct().where((F.size(label) > 2) & (F.length("host") <= LONGEST_HOST)).select("host", F.explode(F.sequence(F.lit(2), F.size(label) - 1)).alias("j"))
    d = d.select(F.expr("substring_index(host, '.', -j)").alias("suffix"),
                 F.expr("substring_index(substring_index(host, '.', -j - 1), '.', 1)").alias("child")).distinct()
    return d.groupBy("suffix").agg(F.count("*").alias("n")).where(F.col("n") >= min_children).select("suffix")


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, or null.

    ``rules``: (verdict, host, path). A rule fits its host and all its
    subdomains if the path starts with the rule's. Of equally long rules the
    one listed first wins.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _strength(groups: DataFrame, up: str, by: list[str]) -> DataFrame:
    """Prior strength (alpha + beta) per ``up`` group, by moments over its children.

    For children with n_i trials and rates p_i around the group's rate m, the
    beta-binomial gives var = m(1-m) (1 + (n-1) rho) / n with rho = 1 / (strength + 1).
    """
    d = groups.withColumn("__m", F.col(f"{up}_good") / F.col(f"{up}_n"))
    d = d.where("n > 0").groupBy(*by).agg(
        F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - F.col("__m"), 2)).alias("s"),
        F.sum(F.col("__m") * (1 - F.col("__m"))).alias("v"),
        F.sum(F.col("__m") * (1 - F.col("__m")) * (F.col("n") - 1)).alias("vn"))
    rho = (F.col("s") - F.col("v")) / F.col("vn")
    fitted = F.when((F.col("vn") > 0) & (rho > 0), 1 / rho - 1).otherwise(MAX_STRENGTH)
    return d.select(*by, F.greatest(F.lit(MIN_STRENGTH), F.least(F.lit(MAX_STRENGTH), fitted)).alias("k"))


def host_reputation(outcomes: DataFrame, z: float = Z, suffixes: DataFrame | None = None) -> DataFrame:
    """``outcomes(host, good)`` (good: 1, bad: 0, null: not labelled), a row per page ->
    ``host, n, good, rate, lower, upper`` for every host that occurs.

    ``rate`` is the posterior mean, the bounds lie ``z`` posterior standard
    deviations from it. Hosts without labels get their domain's prior. No
    labels at all: rate 0.5. ``suffixes``: see ``named``.
    """
    h = outcomes.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    h = land(named(h, suffixes), "url-hosts")
    d = land(h.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), "url-domains")
    s = land(d.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), "url-suffixes")
    g = s.agg(F.sum("n").alias("all_n"), F.sum("good").alias("all_good"))   # one row

    def shrunk(groups, parent, up, on):
        """Posterior rate of each group around its parent's posterior rate."""
        k = _strength(groups.join(parent.select(*on, F.col("n").alias(f"{up}_n"), F.col("good").alias(f"{up}_good")), on)
                      if on else groups.join(F.broadcast(parent.select(
                          F.col("all_n").alias(f"{up}_n"), F.col("all_good").alias(f"{up}_good")))), up, [])
        k = F.broadcast(k)   # one row: the level's strength
        base = parent.select(*on, F.col("rate").alias("prior"))
        j = (groups.join(base, on) if on else groups.join(F.broadcast(base))).join(k)
        strength = F.coalesce("k", F.lit(MAX_STRENGTH))
        a, n = strength * F.col("prior") + F.col("good"), strength + F.col("n")
        sd = F.sqrt(a / n * (1 - a / n) / (n + 1))
        return j.withColumns({"rate": a / n, "lower": F.greatest(F.lit(0.0), a / n - z * sd),
                              "upper": F.least(F.lit(1.0), a / n + z * sd)}).drop("prior", "k")
    g = g.withColumn("rate", F.when(F.col("all_n") > 0, F.col("all_good") / F.col("all_n")).otherwise(0.5))
    s = shrunk(s, g, "all", [])
    d = shrunk(d, s, "suffix", ["suffix"])
    h = shrunk(h, d, "domain", ["suffix", "domain"])
    return h.select("host", "n", "good", "rate", "lower", "upper")


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], key: str = "page_id",
               url: str = "url", min_good: float = MIN_GOOD, z: float = Z,
               suffixes: DataFrame | None = None) -> DataFrame:
    """``key, host, path, rule, verdict, rate, upper`` of every page.

    ``labels(key, good)``: 1 or 0 per labelled page; several labels of a page
    count as one (the worst). ``verdict`` is the longest fitting rule's, else
    ``block`` if the host's upper bound is under ``min_good``, else ``allow``.
    Null urls and urls without ``://`` have an empty host, which is judged
    like any other. Repeated rows are judged alike; empty tables give an
    empty result. ``suffixes``: see ``named``.
    """
    p = pages.select(F.col(key).alias("__key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    lab = labels.groupBy(F.col(key).alias("__key")).agg(F.min("good").alias("good"))
    rep = land(host_reputation(p.select("__key", "host").join(lab, "__key", "left"), z, suffixes), "url-reputation")
    j = p.join(rep.select("host", "rate", "upper"), "host", "left").withColumn(
        "__rule", rule_of(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("upper") < min_good, "block").otherwise("allow")
    return j.select(F.col("__key").alias(key), "host", "path", F.col("__rule")["rule"].alias("rule"),
                    F.coalesce(F.col("__rule")["verdict"], own).alias("verdict"), "rate", "upper")
