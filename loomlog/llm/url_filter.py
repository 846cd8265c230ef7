"""URL filters: path rules, and empirical-Bayes host reputation for urls that no rule fits.

Labelled page outcomes (good or bad) are counted for each host, registered
domain and public suffix. A beta-binomial prior is fitted by moments at each
level, and the posterior of a level is the prior of the one below: suffix to
registered domain to host. A url is blocked when the upper posterior bound of
its host's good rate lies below the floor, allowed otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.llm import _common as c

#: Rules of the query: (host and path, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: A host is blocked when posterior mean + BOUND_SDS standard deviations is below FLOOR.
FLOOR, BOUND_SDS = 0.5, 1.645
#: Public suffixes of two labels, as far as the registered domain needs them.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "or.jp", "ne.jp", "com.br", "co.in", "co.nz", "com.cn", "co.za", "com.mx", "com.tr", "co.kr")


#: Parts that the rows of one host are spread over when they meet its reputation.
SALT = 8


def split(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """pages with the columns host and path; both empty for a null url or one without `://`."""
    cut = pages.withColumn("__u", F.coalesce(F.col(url_col).cast("string"), F.lit("")))
    cut = cut.withColumn("__r", F.when(F.instr("__u", "://") > 0, F.expr("substring_index(substring_index(substring(__u, instr(__u, '://') + 3), '#', 1), '?', 1)")).otherwise(""))
    host = F.substring_index("__r", "/", 1)
    path = F.substring(F.col("__r"), F.length(host) + 1, F.length("__r"))
    return cut.withColumn("host", F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).withColumn("path", path).drop("__u", "__r")


def suffix_of(host: Column) -> Column:
    """The public suffix: the last label, or the last two where they are one of SUFFIXES."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """The registered domain: the public suffix and one label more, if there is one."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        name, _, start = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(f"/{start}"))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _strength(units: DataFrame) -> float:
    """The prior's pseudo-count that the spread of the units (n, good, prior mean mu) asks for, by moments."""
    spread = F.col("mu") * (1 - F.col("mu"))
    got = units.agg(F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - F.col("mu"), 2)).alias("seen"), F.sum(spread).alias("own"), F.sum((F.col("n") - 1) * spread).alias("room")).first()
    rho = (got.seen - got.own) / got.room if got.room else 0.5
    rho = min(max(rho, 1e-4), 0.999)
    return 1 / rho - 1


def reputation(outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, float]:
    """Posteriors from outcomes (host, good 0 or 1): tables of suffixes, domains and hosts with mean and strength, and the overall rate.

    Counts are aggregated host by host first, so a frequent host is one row
    before anything else moves. Without outcomes the tables are empty and the rate is 1.
    """
    counts = outcomes.where("good IS NOT NULL").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"))
    hosts = c.stored(counts, c.scratch(outcomes.sparkSession, "hosts")).withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    rate = hosts.agg((F.sum("good") / F.sum("n")).alias("rate")).first().rate
    rate = 1.0 if rate is None else float(rate)
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("mu", F.lit(rate))

    def shrunk(units: DataFrame) -> DataFrame:
        strength = _strength(units)
        return units.withColumn("mean", (F.col("good") + strength * F.col("mu")) / (F.col("n") + strength)).withColumn("strength", F.col("n") + strength)

    suffixes = shrunk(suffixes)
    domains = shrunk(domains.join(suffixes.select("suffix", F.col("mean").alias("mu")), "suffix"))
    hosts = shrunk(hosts.join(domains.select("domain", F.col("mean").alias("mu")), "domain"))
    return suffixes, domains, hosts, rate


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, url_col: str = "url", id_col: str = "page_id", floor: float = FLOOR, sds: float = BOUND_SDS) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, and the reputation (mean and upper bound) that decides where no rule fits.

    outcomes: (host, good). A host without outcomes has its domain's posterior
    as prior, then its suffix's, then the overall rate. A null url, or one
    without `://`, has the empty host and path and is judged by the empty
    host's reputation. Repeated rows and null ids stay as they are; further columns are not read.
    """
    suffixes, domains, hosts, rate = reputation(outcomes)
    rows = split(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))).drop("url")
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("says", says).withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALT)).cast("int"))
    distinct = rows.select("host").distinct().withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    known = distinct.join(hosts.select("host", F.col("mean").alias("h_mean"), F.col("strength").alias("h_s")), "host", "left")
    known = known.join(domains.select("domain", F.col("mean").alias("d_mean"), F.col("strength").alias("d_s")), "domain", "left")
    known = known.join(suffixes.select("suffix", F.col("mean").alias("s_mean"), F.col("strength").alias("s_s")), "suffix", "left")
    known = known.select("host", F.coalesce("h_mean", "d_mean", "s_mean", F.lit(rate)).alias("mean"), F.coalesce("h_s", "d_s", "s_s", F.lit(1.0)).alias("strength"))
    known = known.withColumn("upper", F.col("mean") + sds * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("strength") + 1)))
    known = known.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALT)))))
    judged = rows.join(known, ["host", "salt"], "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("says", F.when(F.col("upper") < floor, "block").otherwise("allow")).alias("verdict"), F.col("mean").alias("reputation"), "upper")
