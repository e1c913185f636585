"""URL filters: explicit rules first, else an empirical-Bayes host reputation.

Labelled page outcomes are counted by host, registered domain and suffix. Each
level's rate is shrunk towards the posterior mean of the level above, with a
beta-binomial prior whose strength comes from the level's own spread. A host
without outcomes has its domain's posterior, else its suffix's, else the overall
rate. A host is blocked if the lower bound of its posterior rate of bad pages is
above a limit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, beta_strength, few, reliable, table

#: Fixed values: (verdict, host and path).
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
#: Suffixes of two labels; any other suffix is the last label.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "org.uk")
LIMIT, Z = 0.5, 1.645
STRENGTH = (2.0, 1000.0)


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: Column) -> Column:
    """Labels of a host without port; an address of numbers is one label."""
    bare = F.regexp_replace(host, ":[0-9]*$", "")
    return F.when(bare.rlike("^[0-9.]+$|^\\["), F.array(bare)).otherwise(F.split(bare, "\\."))


def host_suffix(host: Column) -> Column:
    """The last label of a host, or the last two where these are a known suffix."""
    labels = _labels(host)
    two = F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2))
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.element_at(labels, -1))


def registered_domain(host: Column) -> Column:
    """The suffix with one label before it; a shorter host is its own."""
    labels = _labels(host)
    n = F.size(F.split(host_suffix(host), "\\.")) + 1
    return F.when(F.size(labels) == 1, labels[0]).otherwise(F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n)))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # later ones win
        h, slash, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def host_reputation(hosts: DataFrame, outcomes: DataFrame, z: float = Z, strength: tuple[float, float] = STRENGTH) -> DataFrame:
    """Posterior rate of bad pages for every row of ``hosts`` (host; each once).

    ``outcomes`` has host string, bad int (0, 1). Returns host, domain, suffix,
    host_n, host_bad, posterior, bound. Without outcomes both are 0; a null host
    or outcome does not count.
    """
    seen = outcomes.where(F.col("host").isNotNull() & F.col("bad").isNotNull())
    counts = seen.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("k"))
    counts = reliable(counts.withColumn("domain", registered_domain(F.col("host"))).withColumn("suffix", host_suffix(F.col("host"))))
    add = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    domains = counts.groupBy("domain", "suffix").agg(*add)
    suffixes = domains.groupBy("suffix").agg(*add)
    rate, m_suffix = beta_strength(suffixes, "n", "k", *strength)
    m_domain = beta_strength(domains, "n", "k", *strength)[1]
    m_host = beta_strength(counts, "n", "k", *strength)[1]
    mean = lambda n, k, m, prior: (k + prior * m) / (n + m)
    suffixes = suffixes.select("suffix", mean(F.col("n"), F.col("k"), m_suffix, F.lit(rate)).alias("suffix_mean"))
    out = hosts.select("host", registered_domain(F.col("host")).alias("domain"), host_suffix(F.col("host")).alias("suffix"))
    out = out.join(suffixes, "suffix", "left").withColumn("suffix_mean", F.coalesce("suffix_mean", F.lit(rate)))
    domains = domains.select("domain", F.col("n").alias("domain_n"), F.col("k").alias("domain_k"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = out.join(domains, "domain", "left").withColumn("domain_mean", mean(zero("domain_n"), zero("domain_k"), m_domain, F.col("suffix_mean")))
    out = out.join(counts.select("host", F.col("n").alias("host_n"), F.col("k").alias("host_bad")), "host", "left")
    out = out.withColumn("posterior", mean(zero("host_n"), zero("host_bad"), m_host, F.col("domain_mean")))
    sd = F.sqrt(F.col("posterior") * (1 - F.col("posterior")) / (zero("host_n") + m_host + 1))
    return out.select("host", "domain", "suffix", zero("host_n").alias("host_n"), zero("host_bad").alias("host_bad"), "posterior", F.greatest(F.lit(0.0), F.col("posterior") - z * sd).alias("bound"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = RULES, limit: float = LIMIT) -> DataFrame:
    """Host, path, rule, verdict, posterior and bound of every row of ``pages`` (page_id, url), whose other columns do not matter.

    A null url, or one without ``://``, has empty host and path, and the empty
    host is one like any other. A bound equal to the limit allows. Repeated
    rows, null ids among them, are judged each; urls may be of any length; an
    empty table gives no rows.
    """
    seen = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    rule, said = matched_rule(F.col("host"), F.col("path"), rules)
    known = reliable(host_reputation(seen.select("host").distinct(), outcomes).select(F.col("host").alias("__host"), "posterior", "bound"))
    out = seen.join(few(known), F.col("host") == F.col("__host"), "left")
    verdict = F.coalesce(said, F.when(F.col("bound") > limit, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "posterior", "bound")


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Outcome of each page whose path names a labelled document: bad if toxic or of low quality."""
    bad = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0)).alias("bad"))
    named = pages.select(url_host(F.col("url")).alias("host"), F.expr("try_cast(regexp_extract(url, '://[^/?#]*/[^/?#]*/([0-9]{1,18})', 1) AS BIGINT)").alias("doc_id"))
    return named.where(F.col("doc_id").isNotNull()).join(bad, "doc_id").select("host", "bad")


def op10_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, page_outcomes(pages, table(spark, sf_dir, "labels"))).drop("posterior", "bound")


QUERIES = {"op10_host_reputation": op10_host_reputation}

_SUFFIXES = ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)
_RULES = ", ".join(f"('{v}', '{t}', '{t.partition('/')[0]}', '/{t.partition('/')[2]}')" for v, t in RULES)


def _strength(name: str, groups: str) -> str:
    """SQL for beta_strength: a table ``name`` with rate r and strength m of ``groups`` (n, k)."""
    return f"""
{name}_s AS (SELECT count(*) AS g, sum(n) AS n, sum(n * n) AS nn, sum(k) AS k, sum(k * k / n) AS kk, sum(k) / sum(n) AS r FROM {groups}),
{name}_t AS (SELECT *, (kk - k * k / n) / nullif(r * (1 - r), 0) AS spread, n - nn / n - (g - 1) AS room FROM {name}_s),
{name} AS (SELECT coalesce(r, 0.0) AS r, CASE WHEN g = 0 OR r <= 0 OR r >= 1 OR g < 2 OR room <= 0 OR spread - (g - 1) <= 0 THEN {STRENGTH[1]}
  ELSE least({STRENGTH[1]}, greatest({STRENGTH[0]}, room / (spread - (g - 1)) - 1)) END AS m FROM {name}_t)"""


ORACLES = {
    "op10_host_reputation": f"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
         try_cast(regexp_extract(url, '://[^/?#]*/[^/?#]*/([0-9]{{1,18}})', 1) AS BIGINT) AS doc_id
  FROM pages),
b AS (SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
l AS (SELECT host, CASE WHEN regexp_matches(regexp_replace(host, ':[0-9]*$', ''), '^[0-9.]+$|^\\[') THEN [regexp_replace(host, ':[0-9]*$', '')]
                        ELSE string_split(regexp_replace(host, ':[0-9]*$', ''), '.') END AS ls FROM (SELECT DISTINCT host FROM u)),
x AS (SELECT *, CASE WHEN len(ls) > 1 AND list_aggregate(ls[-2:], 'string_agg', '.') IN ({_SUFFIXES}) THEN list_aggregate(ls[-2:], 'string_agg', '.') ELSE ls[-1] END AS suffix FROM l),
d AS (SELECT host, suffix, CASE WHEN len(ls) = 1 THEN ls[1] ELSE list_aggregate(ls[greatest(len(ls) - len(string_split(suffix, '.')), 1):], 'string_agg', '.') END AS domain FROM x),
hosts AS (SELECT u.host, CAST(count(*) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS k FROM u JOIN b ON u.doc_id = b.doc_id GROUP BY u.host),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts JOIN d USING (host) GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY suffix),
{_strength("ms", "suffixes")},
{_strength("md", "domains")},
{_strength("mh", "hosts")},
ps AS (SELECT suffix, (k + ms.r * ms.m) / (n + ms.m) AS p FROM suffixes, ms),
p AS (SELECT d.host, coalesce(h.n, 0) AS n, (coalesce(h.k, 0) + (coalesce(o.k, 0) + coalesce(ps.p, ms.r) * md.m) / (coalesce(o.n, 0) + md.m) * mh.m) / (coalesce(h.n, 0) + mh.m) AS p, mh.m
      FROM d CROSS JOIN ms CROSS JOIN md CROSS JOIN mh LEFT JOIN ps ON ps.suffix = d.suffix LEFT JOIN domains o ON o.domain = d.domain LEFT JOIN hosts h ON h.host = d.host),
v AS (SELECT host, greatest(0.0, p - {Z} * sqrt(p * (1 - p) / (n + m + 1))) AS bound FROM p),
rules(said, rule, h, s) AS (VALUES {_RULES}),
f AS (SELECT page_id, u.host, path, arg_max(rule, length(rule)) AS rule, arg_max(said, length(rule)) AS said
      FROM (SELECT *, row_number() OVER () AS i FROM u) u LEFT JOIN rules ON (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(path, s) GROUP BY i, page_id, u.host, path)
SELECT page_id, f.host, path, rule, coalesce(said, CASE WHEN bound > {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict FROM f JOIN v ON f.host = v.host
"""
}
