"""URL filters: rules first, then empirical-Bayes host reputation.

A page's outcome is bad or not where it is labelled. The rate of bad pages is a beta-binomial at three levels: suffix, registered
domain (the suffix and one label more) and host. A suffix is a host's last label, or its last two where registries of countries
sell names below a second level (``co.uk``); a user part, a port and trailing dots are no part of either. An address (IPv4, or IPv6 in brackets) is its own domain and suffix. Each level's units are shrunk towards their
parent's posterior mean, the suffixes towards the overall rate; how strongly is estimated from the labelled pages by
the method of moments (the excess of the units' scatter over binomial scatter). A host's posterior is a beta
distribution; it is blocked when the lower bound of its bad rate, mean less z standard deviations, is above max_bad.

Everything is DataFrame operations. Pages are aggregated by host before they meet anything else; only sums for the three
strengths reach the driver. In the join back to pages, hot hosts (of more than 1 / 65,536 of the pages each) are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stash, join_hot, table

#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Labels that stand before a country's two letters in a suffix.
SECOND_LEVEL = "ac|co|com|edu|go|gob|gov|gouv|net|ne|nom|or|org"
ADDRESS = r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}|\[[^\]]*\]"
SUFFIX = rf"(?:^|\.)({ADDRESS}|(?:{SECOND_LEVEL})\.[a-z]{{2}}|[^.]*)$"
DOMAIN = rf"(?:^|\.)({ADDRESS}|[^.]+\.(?:{SECOND_LEVEL})\.[a-z]{{2}}|[^.]*\.[^.]*|[^.]*)$"
BESIDE_NAME = r"^.*@|:[0-9]*$|\.+(:[0-9]*)?$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("url")))


def with_host_path(pages: DataFrame) -> DataFrame:
    """pages with host and path of its column url; both empty where url is null or has no ``://``."""
    rest = F.coalesce(_rest(F.col("url")), F.lit(""))
    return pages.withColumns({"host": F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


def matched(rules: tuple[tuple[str, str, str], ...], give) -> Column:
    """give(rule) of the longest rule that fits host and path, else null."""
    out: Column = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[0] + r[1])):
        host, path, _ = rule
        out = F.when(((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path), F.lit(give(rule))).otherwise(out)
    return out


def _strength(units: DataFrame) -> float:
    """Prior strength from units (n, bad, prior): the beta prior's two parameters sum to it."""
    r = units.where("n > 0").agg(F.sum(F.expr("n * pow(bad / n - prior, 2) / (prior * (1 - prior))")).alias("s"), F.count("*").alias("k"), F.sum(F.col("n") - 1).alias("m")).first()
    if not r["k"] or not r["m"]:
        return 2.0
    rho = min(0.99, max(0.001, (r["s"] - r["k"]) / r["m"]))
    return round(1 / rho - 1, 6)


def reputation(hosts: DataFrame, stash: Stash, *, z: float = 1.645) -> DataFrame:
    """host, pages, bad_mean, bad_low from hosts (host, its pages, n labelled ones, bad ones of them), one row per host."""
    name = F.regexp_replace("host", BESIDE_NAME, "")
    hosts = stash.put(hosts.withColumns({"suffix": F.regexp_extract(name, SUFFIX, 1), "domain": F.regexp_extract(name, DOMAIN, 1)}))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    rate = ((total["bad"] or 0) + 1) / ((total["n"] or 0) + 2)
    shrunk = lambda k: (F.col("bad") + k * F.col("prior")) / (F.col("n") + k)
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = stash.put(hosts.groupBy("domain", "suffix").agg(*sums, F.count("*").alias("hosts")))
    suffixes = domains.groupBy("suffix").agg(*sums, F.count("*").alias("domains")).withColumn("prior", F.lit(rate))
    suffixes = stash.put(suffixes.select("suffix", "domains", shrunk(_strength(suffixes)).alias("prior")))
    domains = stash.put(join_hot(domains, suffixes, "suffix", "domains", domains.count()))
    domains = stash.put(domains.select("domain", "hosts", shrunk(_strength(domains)).alias("prior")))
    units = stash.put(join_hot(hosts, domains, "domain", "hosts", hosts.count()))
    k = _strength(units)
    a, b = F.col("bad") + k * F.col("prior"), F.col("n") - F.col("bad") + k * (1 - F.col("prior"))
    mean = a / (a + b)
    return units.select("host", "pages", mean.alias("bad_mean"), (mean - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))).alias("bad_low"))


def url_filter(pages: DataFrame, outcomes: DataFrame, *, rules: tuple[tuple[str, str, str], ...] = RULES, id_col: str = "page_id", max_bad: float = 0.5, z: float = 1.645) -> DataFrame:
    """One row per row of pages: id_col, host, path, rule, verdict, bad_mean, bad_low.

    outcomes: doc_id, bad (0/1 or null), one row per labelled document; the document of a page is the first number in
    its path. Rows with the same doc_id count once, bad if one of them is. A null url, or one without ``://``, has empty
    host and path and is judged by the empty host's posterior, as any host without labelled pages is by its
    domain's, suffix's or the overall rate. Without any outcomes the overall rate is a half and nothing is blocked.
    Pages' other columns are not read.
    """
    stash = Stash(pages.sparkSession, "hosts")
    known = outcomes.where(F.col("bad").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("bad").cast("long").alias("bad"))
    pages = with_host_path(pages.select(F.col(id_col), F.col("url")))
    labelled = pages.select("host", F.expr(r"try_cast(nullif(regexp_extract(path, '/([0-9]{1,18})', 1), '') as bigint)").alias("doc_id")).join(known, "doc_id", "left")
    hosts = labelled.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.count("*").alias("pages"))
    out = join_hot(pages, stash.put(reputation(hosts, stash, z=z)), "host", "pages", pages.count())
    verdict = F.coalesce(matched(rules, lambda r: r[2]), F.when(F.col("bad_low") > max_bad, "block").otherwise("allow"))
    return out.select(id_col, "host", "path", matched(rules, lambda r: r[0] + r[1]).alias("rule"), verdict.alias("verdict"), "bad_mean", "bad_low")


def outcomes_of(labels: DataFrame) -> DataFrame:
    """Toxic documents and those of quality 0 are bad."""
    return labels.select("doc_id", F.when(F.greatest(F.col("toxic"), 1 - F.col("quality")) > 0, 1).when(F.coalesce("toxic", "quality").isNotNull(), 0).alias("bad"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), outcomes_of(table(spark, sf_dir, "labels"))).select("page_id", "host", "path", "rule", "verdict")


SQL = rf"""
WITH known AS (
  SELECT doc_id, max(CASE WHEN greatest(toxic, 1 - quality) > 0 THEN 1 ELSE 0 END) AS bad FROM labels
  WHERE doc_id IS NOT NULL AND coalesce(toxic, quality) IS NOT NULL GROUP BY doc_id),
rest AS (SELECT page_id, row_number() OVER () AS r, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (SELECT page_id, r, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
seen AS (SELECT c.host, k.bad FROM cut c LEFT JOIN known k ON k.doc_id = try_cast(nullif(regexp_extract(c.path, '/([0-9]{{1,18}})', 1), '') AS BIGINT)),
named AS (SELECT host, bad, regexp_replace(host, '{BESIDE_NAME}', '', 'g') AS name FROM seen),
hosts AS (SELECT host, any_value(regexp_extract(name, '{SUFFIX}', 1)) AS suffix, any_value(regexp_extract(name, '{DOMAIN}', 1)) AS domain,
                 count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM named GROUP BY host),
total AS (SELECT (coalesce(sum(bad), 0) + 1.0::DOUBLE) / (coalesce(sum(n), 0) + 2) AS rate FROM hosts),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(rate) AS prior FROM hosts, total GROUP BY suffix),
sk AS (SELECT coalesce(round(1 / least(0.99, greatest(0.001, (sum(n * pow(bad::DOUBLE / n - prior, 2) / (prior * (1 - prior))) - count(*)) / nullif(sum(n - 1), 0))) - 1, 6), 2.0) AS k FROM s0 WHERE n > 0),
s1 AS (SELECT suffix, (bad + k * prior) / (n + k) AS prior FROM s0, sk),
d0 AS (SELECT h.domain, h.suffix, sum(n) AS n, sum(bad) AS bad, any_value(s1.prior) AS prior FROM hosts h JOIN s1 ON s1.suffix = h.suffix GROUP BY h.domain, h.suffix),
dk AS (SELECT coalesce(round(1 / least(0.99, greatest(0.001, (sum(n * pow(bad::DOUBLE / n - prior, 2) / (prior * (1 - prior))) - count(*)) / nullif(sum(n - 1), 0))) - 1, 6), 2.0) AS k FROM d0 WHERE n > 0),
d1 AS (SELECT domain, (bad + k * prior) / (n + k) AS prior FROM d0, dk),
h0 AS (SELECT h.host, h.n, h.bad, d1.prior FROM hosts h JOIN d1 ON d1.domain = h.domain),
hk AS (SELECT coalesce(round(1 / least(0.99, greatest(0.001, (sum(n * pow(bad::DOUBLE / n - prior, 2) / (prior * (1 - prior))) - count(*)) / nullif(sum(n - 1), 0))) - 1, 6), 2.0) AS k FROM h0 WHERE n > 0),
h1 AS (SELECT host, bad + k * prior AS a, n - bad + k * (1 - prior) AS b FROM h0, hk),
h2 AS (SELECT host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bad_low FROM h1),
rules(rule_host, rule_path, rule_verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
best AS (SELECT c.page_id, c.host, c.path, u.rule_host || u.rule_path AS rule, u.rule_verdict,
                row_number() OVER (PARTITION BY c.r ORDER BY length(u.rule_host || u.rule_path) DESC) AS k
         FROM cut c LEFT JOIN rules u ON (c.host = u.rule_host OR ends_with(c.host, '.' || u.rule_host)) AND starts_with(c.path, u.rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN bad_low > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM best LEFT JOIN h2 USING (host) WHERE k = 1
"""
