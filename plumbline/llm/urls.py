"""URL filters: explicit rules, then empirical-Bayes reputation of hosts.

A labelled page is good or bad. The rate of bad pages of a host is shrunk towards that of
its registered domain, the domain's towards its suffix's and the suffix's towards the
whole. The weight of each prior is fitted to the spread of rates on its level by the
moments of the beta-binomial. A page is blocked where even the lower bound of its host's
posterior lies above a limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.staging import stage

#: Rules of (verdict, host, path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Standard deviations below the posterior mean, the limit on that bound, and the bounds of a prior's weight in pages.
BOUND, LIMIT, LEAST_WEIGHT, MOST_WEIGHT = 1.645, 0.5, 1.0, 1000.0
#: Labels under which countries register domains, and the form of addresses.
_PARTS = r"\.(ac|co|com|edu|go|gov|ne|net|or|org)\.[a-z]{2}$"
_ADDRESS = r"^([0-9.]+|\[.*\])$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after(url: Column) -> Column:
    at = F.instr(url, F.lit("://"))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def name_of(host: Column) -> Column:
    """A host without user, port and closing dots."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", ""), r"\.+$", "")


def domain_of(host: Column) -> Column:
    """The registered domain: the last two labels of a name, three where the last two only mark a country's part; an address whole."""
    name = name_of(host)
    return F.when(name.rlike(_ADDRESS), name).when(name.rlike(_PARTS), F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))


def suffix_of(host: Column) -> Column:
    """What domains are registered under: the last label, or the last two of a country's part; empty for addresses."""
    name = name_of(host)
    return F.when(name.rlike(_ADDRESS), F.lit("")).when(name.rlike(_PARTS), F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1))


def matched(host: Column, path: Column, rules: list[tuple[str, str, str]], out: int | None = None) -> Column:
    """The longest rule that fits, as text (or its verdict with ``out`` 0), null if none fits."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == rule[1]) | F.endswith(host, F.lit("." + rule[1]))) & F.startswith(path, F.lit(rule[2]))
        found = F.when(fits, F.lit(rule[1] + rule[2] if out is None else rule[out])).otherwise(found)
    return found


def prior_weight(groups: DataFrame) -> tuple[float, float]:
    """The mean rate and the prior's weight fitted to groups of (n, k): k bad pages of n."""
    s = groups.where("n > 0").agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk")).first()
    if not s["n"]:
        return 0.5, LEAST_WEIGHT
    n, mean = float(s["n"]), s["k"] / s["n"]
    spread = s["kk"] - n * mean * mean - mean * (1 - mean) * (s["g"] - 1)
    scale = n - s["nn"] / n
    between = spread / scale if scale > 0 else 0.0
    if between <= 1e-12:
        return mean, MOST_WEIGHT
    return mean, min(max(mean * (1 - mean) / between - 1, LEAST_WEIGHT), MOST_WEIGHT)


def reputations(pages: DataFrame) -> DataFrame:
    """(host, n, k, mean, bound): the posterior of every host of ``pages`` of (host, bad), bad null where unlabelled."""
    hosts = pages.groupBy("host").agg(F.count("bad").alias("n"), F.sum(F.coalesce("bad", F.lit(0))).cast("long").alias("k"))
    hosts = stage(hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))), "url-hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    mean, top = prior_weight(suffixes)
    _, middle = prior_weight(domains)
    _, low = prior_weight(hosts)

    def shrunk(prior: Column, weight: float) -> Column:
        return (F.lit(weight) * prior + F.col("k")) / (F.lit(weight) + F.col("n"))

    by_suffix = suffixes.select("suffix", shrunk(F.lit(mean), top).alias("suffix_mean"))
    by_domain = domains.join(by_suffix, "suffix").select("domain", shrunk(F.col("suffix_mean"), middle).alias("domain_mean"))
    rated = hosts.join(by_domain, "domain").withColumn("mean", shrunk(F.col("domain_mean"), low))
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.lit(low + 1) + F.col("n")))
    return rated.select("host", "n", "k", "mean", (F.col("mean") - BOUND * deviation).alias("bound"))


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages``.

    ``labels`` has doc_id and quality; a page is bad where the label of its id is 0. Null
    urls and urls without ``://`` have an empty host and path. Repeated rows and null ids
    are judged like any other, each row of an id counting once for its host; pages without
    any label nearby get the overall rate. Pages meet their host's reputation in a join
    whose large side Spark splits where one host has very many; reputations are one row a host.
    """
    parsed = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    outcome = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 0).cast("int")).alias("bad"))
    known = stage(parsed.join(outcome, parsed["page_id"] == outcome["doc_id"], "left").select("page_id", "host", "path", "bad"), "url-pages")
    bad = reputations(known).where(F.col("bound") > LIMIT).select("host", F.lit("block").alias("reputation"))
    judged = known.join(bad, "host", "left")
    host, path = F.col("host"), F.col("path")
    verdict = F.coalesce(matched(host, path, rules, 0), F.col("reputation"), F.lit("allow"))
    return judged.select("page_id", "host", "path", matched(host, path, rules).alias("rule"), verdict.alias("verdict"))
