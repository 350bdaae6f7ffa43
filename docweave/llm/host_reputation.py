"""URL filtering by rules and by empirical-Bayes host reputation, with DataFrame operations only.

Labelled pages (bad or not) are counted by host. Counts roll up to the registered domain and to the suffix;
each level's rate is shrunk towards its parent's by a beta-binomial prior whose strength is estimated from how much the
children's rates differ (method of moments). What a host's own pages cannot tell, its domain and suffix do. A page is
blocked if the lower bound of its host's bad rate (a low quantile of the beta posterior) exceeds the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import stored

_A_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: what follows the first :// up to /, ?, # or the end, A-Z lower-cased. Path: from there up to ?, # or the end.
    Both are empty for null and where :// is missing."""
    pattern = "://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return F.translate(part(1), _A_Z, _A_Z.lower()), part(2)


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(verdict, rule) of the longest rule that fits, else null. rules: (verdict, host/path prefix) pairs; one fits
    its host and all subdomains if the path starts with its path. Of equally long ones the first wins."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        own, _, start = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + start)
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("struct<verdict:string,rule:string>") if out is None else out


#: Labels under which registries of countries (suffixes of two letters) give out names, as in co.uk.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "govt", "ltd", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
_ADDRESS = r"^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*\])$"


def plain_host(host: Column) -> Column:
    """host without credentials, port and the dot at its end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", ""), r"\.$", "")


def suffix_of(host: Column) -> Column:
    """The public suffix: the last label, or two where it is of two letters and the one before one of SECOND_LEVEL. An IP address
    has the suffix "ip". This is a rule, no list of all registries."""
    own = plain_host(host)
    two = own.rlike(rf"(^|\.)({'|'.join(SECOND_LEVEL)})\.[a-z]{{2}}$")
    return F.when(own.rlike(_ADDRESS), "ip").when(two, F.substring_index(own, ".", -2)).otherwise(F.substring_index(own, ".", -1))


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and one label more; a host that is a suffix, and an IP address, is its own domain."""
    own, suffix = plain_host(host), suffix_of(host)
    labels = F.when(F.contains(suffix, F.lit(".")), F.substring_index(own, ".", -3)).otherwise(F.substring_index(own, ".", -2))
    return F.when(suffix == "ip", own).otherwise(labels)


def beta_bound(a: Column, b: Column, z: float) -> Column:
    """The quantile of Beta(a, b) that lies as low as -z does in the normal distribution: odds are an F ratio, of which the cube
    root is nearly normal (Paulson 1942; within 0.01 where a and b are 1 or more). Below a = 1 the bound is 0, and b counts as
    1 at least: both bounds are too low, never too high."""
    b = F.greatest(b, F.lit(1.0))
    p, q = 1 / (9 * a), 1 / (9 * b)
    low, both, high = (1 - p) * (1 - p) - z * z * p, (1 - p) * (1 - q), (1 - q) * (1 - q) - z * z * q
    root = F.greatest((both - F.sqrt(both * both - low * high)) / high, F.lit(0.0))
    ratio = root * root * root
    return F.when(a < 1, 0.0).otherwise(a * ratio / (a * ratio + b))


def _strength(children: DataFrame, by: str) -> DataFrame:
    """by, n, bad and m, the prior strength for its children: rows of a group have n, bad of one child each. With rates
    p_i = bad_i / n_i, weighted mean p and variance v, m = p (1 - p) / v - 1 after the binomial part of v is taken off; at least 1
    and at most 1000, and 10 where there are fewer than two children."""
    sums = children.groupBy(by).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("k"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("q"))
    p = (F.col("bad") + 0.5) / (F.col("n") + 1.0)
    spread = p * (1 - p)
    # E[sum bad_i^2/n_i] = sum (n_i p^2 + spread (1 + (n_i - 1) rho)); rho = 1 / (m + 1)
    rho = ((F.col("q") - F.col("n") * p * p) / spread - F.col("k")) / F.greatest(F.col("n") - F.col("k"), F.lit(1))
    rho = F.least(F.greatest(rho, F.lit(1 / 1001)), F.lit(0.5))
    return sums.select(by, "n", "bad", F.when(F.col("k") < 2, 10.0).otherwise(1 / rho - 1).alias("m"))


def reputation(labelled: DataFrame) -> DataFrame:
    """labelled: host, bad (0 or 1; null is not counted). Returns the posterior of each level as rows: level (host, domain,
    suffix or all), name, alpha, beta."""
    hosts = stored(labelled.where("bad is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad")).withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))), "hosts")
    domain_sums = hosts.groupBy("domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.first("suffix").alias("suffix"))
    suffix_sums = domain_sums.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    top = _strength(suffix_sums.withColumn("everything", F.lit(1)), "everything").first()  # one row
    alpha, beta, strength = (top["bad"] + 1.0, top["n"] - top["bad"] + 1.0, top["m"]) if top else (1.0, 1.0, 10.0)

    def shrunk(level: str, counts: DataFrame) -> DataFrame:
        a, b = F.col("bad") + F.col("up_m") * F.col("up_p"), F.col("n") - F.col("bad") + F.col("up_m") * (1 - F.col("up_p"))
        return counts.withColumns({"alpha": a, "beta": b}).select(F.lit(level).alias("level"), F.col(level).alias("name"), "alpha", "beta", *[c for c in counts.columns if c in ("m",)])

    suffixes = shrunk("suffix", _strength(domain_sums, "suffix").withColumns({"up_m": F.lit(strength), "up_p": F.lit(alpha / (alpha + beta))}))
    up = suffixes.select(F.col("name").alias("suffix"), F.col("m").alias("up_m"), (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("up_p"))
    domains = shrunk("domain", _strength(hosts, "domain").join(domain_sums.select("domain", "suffix"), "domain").join(up, "suffix"))
    up = domains.select(F.col("name").alias("domain"), F.col("m").alias("up_m"), (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("up_p"))
    own = shrunk("host", hosts.join(up, "domain"))
    top = labelled.sparkSession.createDataFrame([("all", "", float(alpha), float(beta))], "level string, name string, alpha double, beta double")
    columns = ["level", "name", "alpha", "beta"]
    return own.select(columns).unionByName(domains.select(columns)).unionByName(suffixes.select(columns)).unionByName(top)


def posterior(hosts: DataFrame, levels: DataFrame, z: float = 1.645) -> DataFrame:
    """hosts: host (distinct). Returns host, bad_rate and bad_bound of its finest known level: the posterior mean and
    its beta_bound. Without any label: those of the uniform prior."""
    at = hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    for level in ("host", "domain", "suffix"):
        at = at.join(levels.where(F.col("level") == level).select(F.col("name").alias(level), F.struct("alpha", "beta").alias(f"p_{level}")), level, "left")
    top = levels.where("level = 'all'").first()  # one row
    found = at.withColumn("p", F.coalesce("p_host", "p_domain", "p_suffix", F.struct(F.lit(top["alpha"]).alias("alpha"), F.lit(top["beta"]).alias("beta"))))
    a, b = F.col("p.alpha"), F.col("p.beta")
    return found.select("host", F.coalesce(a / (a + b), F.lit(0.5)).alias("bad_rate"), F.coalesce(beta_bound(a, b, z), F.lit(0.0)).alias("bad_bound"))


def judged(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame | None = None, block_above: float = 0.5, url: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict, bad_rate and bad_bound (columns of these names are replaced).

    A rule's verdict holds where one fits; elsewhere a page is blocked if its host's bad_bound exceeds block_above.
    labelled: host, bad outcomes; None takes the pages that the rules decide (block is bad). Null and odd urls
    have the host "", whose reputation is that of the unknown.
    """
    host, path = host_and_path(F.col(url))
    parts = pages.drop("host", "path", "rule", "verdict", "bad_rate", "bad_bound").withColumns({"host": host, "path": path})
    parts = parts.withColumn("rule", matched_rule(F.col("host"), F.col("path"), rules))
    if labelled is None:
        labelled = parts.where("rule is not null").select("host", (F.col("rule.verdict") == "block").cast("int").alias("bad"))
    levels = stored(reputation(labelled), "levels")
    # one row a host, written: the join then has two plain sides, and a host with a third of the pages can be split
    rates = stored(posterior(parts.select("host").distinct(), levels), "rates")
    out = parts.join(rates, "host", "left")
    verdict = F.coalesce("rule.verdict", F.when(F.col("bad_bound") > block_above, "block").otherwise("allow"))
    return out.withColumn("verdict", verdict).withColumn("rule", F.col("rule.rule"))
