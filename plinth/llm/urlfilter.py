"""URL filter: allow and block rules, and an empirical-Bayes reputation for what no rule decides.

A page shows a document, which its path names (/en/123.html), and labels judge documents: a page's outcome is bad if its document is of bad quality or toxic. So
evidence comes from what people said of the contents, never from words in a host's name. Outcomes give each host a count. A beta-binomial prior shrinks the counts in three steps:
the suffix towards all pages, the registered domain towards its suffix, the host towards its domain. A step's
prior strength is fitted by moments over all its groups, so noisy counts lean on their parent and large ones
stand for themselves. A host is blocked if the lower bound of its posterior bad rate is above a limit, hence only
on evidence; hosts without labelled pages have their nearest ancestor's posterior.

All is DataFrame work: counts are pre-aggregated before each shuffle, so a host with a third of all pages is one row
of partial counts for each task, and the final join leaves a hot host to Spark's skew handling.

Defined results: a null url, or one without ://, has an empty host and path, fits no rule and shares the reputation of the
empty host; a host without a dot is its own domain and suffix; pages with a null outcome count as unlabelled; repeated
pages count each time; empty tables give no rows; a lower bound exactly at the limit allows; urls and pages of any length count whole;
other columns of pages are never read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import cut

#: (host, path prefix, verdict), as the contract states them.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Second-level labels under which names are registered, as in example.co.uk.
SHARED_LABELS = ["ac", "co", "com", "edu", "gov", "net", "org"]
#: A host is blocked if the bad rate is above LIMIT with the certainty of a normal quantile Z.
LIMIT, Z = 0.5, 1.645
#: Bounds of a prior's strength, in pages.
MIN_STRENGTH, MAX_STRENGTH = 1.0, 1000.0
#: Where a page's path names its document.
DOCUMENT = r"^/[^/]+/([0-9]{1,18})(?:[./]|$)"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    """The last label, or the last two if the second last is a shared one before a country's two letters."""
    two = F.substring_index(host, ".", -2)
    shared = two.rlike(rf"^({'|'.join(SHARED_LABELS)})\.[a-z][a-z]$")
    return F.when(shared, two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and one label more; an address of digits is its own domain."""
    labels = F.size(F.split(suffix_of(host), r"\."))
    return F.when(host.rlike(r"^[0-9.:\[\]]+$"), host).when(labels == 2, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (length, rule, verdict) of the longest rule that fits, or null."""
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in rules]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<length:int,rule:string,verdict:string>")


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host and bad (1, 0, or null without a label) of each page. Of a document's labels the worst counts; a null label says nothing. labels: doc_id, quality, toxic."""
    judged = labels.select(F.col("doc_id").alias("of"), F.greatest((F.col("quality") == 0).cast("int"), (F.col("toxic") == 1).cast("int")).alias("bad"))
    judged = judged.groupBy("of").agg(F.max("bad").alias("bad"))
    url = F.col("url").cast("string")
    shown = pages.select(host_of(url).alias("host"), F.nullif(F.regexp_extract(path_of(url), DOCUMENT, 1), F.lit("")).cast("long").alias("shows"))
    return shown.join(judged, F.col("shows") == F.col("of"), "left").select("host", "bad")


def _shrunk(groups: DataFrame, name: str, parent: str) -> DataFrame:
    """groups (key, parent, k, n, mean: the parent's posterior): adds alpha and beta, with the level's fitted strength.

    Moments: over groups of n pages the weighted variance of k/n around the parent's mean is m(1-m)(1 + (n-1)rho)/n
    in expectation; rho gives the strength 1/rho - 1."""
    e = F.col("mean") * (1 - F.col("mean"))
    d = F.col("k") / F.col("n") - F.col("mean")
    level = groups.filter("n > 1").agg(F.sum(F.col("n") * d * d - e).alias("over"), F.sum((F.col("n") - 1) * e).alias("room")).first()
    rho = level.over / level.room if level.room else 0.0
    strength = F.lit(float(min(MAX_STRENGTH, max(MIN_STRENGTH, 1 / max(rho, 1e-9) - 1))))
    return groups.select(name, parent, (F.col("mean") * strength + F.col("k")).alias("alpha"), ((1 - F.col("mean")) * strength + F.col("n") - F.col("k")).alias("beta"))


def host_reputation(outcomes: DataFrame, hosts: DataFrame) -> DataFrame:
    """host, alpha, beta: the posterior of the bad rate of each of hosts (column host, distinct)."""
    counts = outcomes.filter(F.col("bad").isNotNull()).groupBy("host").agg(F.sum("bad").alias("k"), F.count("*").alias("n"))
    base = cut(hosts.join(counts, "host", "left").select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), F.coalesce("k", F.lit(0)).alias("k"), F.coalesce("n", F.lit(0)).alias("n")))
    domains = base.groupBy("domain", "suffix").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    suffixes = domains.groupBy("suffix").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    whole = suffixes.agg(F.sum("k").alias("k"), F.sum("n").alias("n")).first()
    # Half a page of either outcome keeps the mean of all pages off 0 and 1.
    s = _shrunk(suffixes.select("*", F.lit(((whole.k or 0) + 0.5) / ((whole.n or 0) + 1)).alias("mean"), F.lit("").alias("root")), "suffix", "root")
    mean = (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("mean")
    d = _shrunk(domains.join(s.select("suffix", mean), "suffix"), "domain", "suffix")
    return _shrunk(base.join(d.select("domain", mean), "domain"), "host", "domain").select("host", "alpha", "beta")


def posterior_bounds(reputation: DataFrame, z: float = Z) -> DataFrame:
    """host, mean and low: the posterior's mean and its lower bound."""
    total = F.col("alpha") + F.col("beta")
    mean = F.col("alpha") / total
    return reputation.select("host", mean.alias("bad_rate"), (mean - z * F.sqrt(mean * (1 - mean) / (total + 1))).alias("bad_rate_low"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, limit: float = LIMIT, z: float = Z) -> DataFrame:
    """page_id, host, path, rule, verdict for each page; bad_rate and bad_rate_low say what its host's pages show."""
    url = F.col("url").cast("string")
    seen = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    bounds = posterior_bounds(host_reputation(outcomes, seen.select("host").distinct()), z).withColumnRenamed("host", "known_host")
    # The reputation has one row a host: broadcast where Spark finds it small, else a join whose hot hosts Spark splits.
    found = seen.join(bounds, F.col("host") == F.col("known_host")).withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("bad_rate_low") > limit, "block").otherwise("allow")
    return found.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", method).alias("verdict"), "bad_rate", "bad_rate_low")
