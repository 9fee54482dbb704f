"""URL filter: rules first, then the reputation of the host.

Labelled page outcomes are counted per host. A host's share of good pages is shrunk to that of its registered
domain, which is shrunk to that of its suffix, which is shrunk to the share of all labelled pages. Each level is a
beta-binomial model: a group with ``n`` outcomes, ``g`` of them good, below a parent of mean ``m`` gets
``Beta(g + k*m, n - g + k*(1 - m))``; the strength ``k`` of a level is estimated from the over-dispersion of its
groups around their parents (method of moments). A page passes if the lower posterior bound of its host,
``mean - z * sd``, reaches ``min_good``.

Only DataFrame functions are used. Counts are partial sums, so a host with a third of all pages costs one row per
task; the join back to the pages is one that Spark splits where a host is large.

Edge cases: a null url, or one without ``://``, has the empty host and path and is judged by that group's outcomes.
A host nobody labelled gets its domain's or suffix's prior. Repeated pages are judged each; repeated labels of a
document count once, and the document is good only if all of them say so. A null quality is no outcome. Empty tables
give no rows; without any label the prior is ``Beta(1, 1)``. Columns of the input other than ``page_id`` and
``url`` are not carried.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, lower_ascii, written

#: (action, host, path) of the query's rules
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
MIN_GOOD = 0.7
Z = 1.645
#: bounds of the correlation of outcomes within a group, and the prior strength they stand for (1/rho - 1)
RHO = (0.001, 0.5)

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def registered_domain(host: Column) -> Column:
    """The last two labels."""
    return F.substring_index(host, ".", -2)


def suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as a struct (n, rule, action), or null. The cost follows the labels of the host,
    not the number of rules: the rules lie in a map by host."""
    by_host: dict[str, list[Column]] = {}
    for action, at, prefix in rules:
        by_host.setdefault(at, []).append(F.struct(
            F.lit(len(at + prefix)).alias("n"), F.lit(at + prefix).alias("rule"), F.lit(action).alias("action"), F.lit(prefix).alias("prefix"),
        ))
    if not by_host:
        return F.lit(None).cast("struct<n int, rule string, action string, prefix string>")
    table = F.create_map(*[x for at, found in by_host.items() for x in (F.lit(at), F.array(*found))])
    labels = F.split(host, r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    fitting = F.flatten(F.transform(ends, lambda e: F.filter(F.coalesce(F.try_element_at(table, e), F.array().cast("array<struct<n int, rule string, action string, prefix string>>")), lambda r: F.startswith(path, r["prefix"]))))
    return F.array_max(fitting)


def labelled_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``host``, ``good`` (0 or 1) per labelled page. A page shows the document whose number its path ends in."""
    good = F.when((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0), 1).otherwise(0)
    seen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(good).alias("good"))
    shown = pages.select(
        url_host(F.col("url")).alias("host"),
        F.expr("try_cast(nullif(regexp_extract(" + "url" + r", '://[^/?#]*/[a-z]+/([0-9]+)', 1), '') as bigint)").alias("doc_id"),
    ).where("doc_id is not null")
    return shown.join(seen, "doc_id").select("host", "good")


def _shrunk(groups: DataFrame, key: str, parent: str, parents: DataFrame) -> tuple[DataFrame, float | None]:
    """``key``, ``mean`` and ``strength`` of every group, shrunk to its parent's mean; and the level's prior strength (None without groups)."""
    g = written(groups.join(parents.select(F.col(parent), F.col("mean").alias("m")), parent), key)
    p = F.col("m") * (1 - F.col("m"))
    away = F.col("good") - F.col("n") * F.col("m")
    spread, plain, rest = g.agg(F.sum(away * away / F.col("n")), F.sum(p), F.sum(p * (F.col("n") - 1))).first()
    if plain is None:
        return g.select(key, F.col("m").alias("mean"), F.col("m").alias("strength")), None
    rho = min(RHO[1], max(RHO[0], (spread - plain) / rest if rest else RHO[0]))
    k = 1 / rho - 1
    return g.select(key, ((F.col("good") + k * F.col("m")) / (F.col("n") + k)).alias("mean"), (F.col("n") + k).alias("strength")), k


def reputations(outcomes: DataFrame) -> tuple[dict[str, DataFrame], float, float]:
    """Posterior means and strengths by level (suffix, domain, host), the mean of all, and the strength of a host that nobody labelled."""
    counts = outcomes.groupBy("host").agg(F.count("*").alias("n"), F.sum("good").alias("good"))
    hosts = written(counts.withColumns({"domain": registered_domain(F.col("host")), "suffix": suffix(F.col("host")), "all": F.lit("")}), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = hosts.groupBy("suffix", "all").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    n, good = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
    top = (good + 1) / (n + 2)
    by_suffix, _ = _shrunk(suffixes, "suffix", "all", hosts.sparkSession.range(1).select(F.lit("").alias("all"), F.lit(top).alias("mean")))
    by_domain, _ = _shrunk(domains, "domain", "suffix", by_suffix)
    by_host, k = _shrunk(hosts, "host", "domain", by_domain)
    return {"suffix": by_suffix, "domain": by_domain, "host": by_host}, top, n + 2.0 if k is None else k


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, min_good: float = MIN_GOOD, z: float = Z) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, good_bound (lower posterior bound of the host, six decimals)."""
    levels, top, unseen = reputations(outcomes)
    urls = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    found = urls.groupBy("host").agg(F.lit(1).alias("seen")).select("host", registered_domain(F.col("host")).alias("domain"), suffix(F.col("host")).alias("suffix"))
    # a host without outcomes keeps the mean of the nearest level that has some, at the strength of a host's prior
    judged = found
    for name, table in levels.items():
        judged = judged.join(table.select(name, F.col("mean").alias(f"{name}_mean"), F.col("strength").alias(f"{name}_strength")), name, "left")
    mean = F.coalesce("host_mean", "domain_mean", "suffix_mean", F.lit(top))
    strength = F.coalesce(F.col("host_strength"), F.lit(unseen))
    bound = judged.select("host", F.round(mean - F.lit(z) * F.sqrt(mean * (1 - mean) / (strength + 1)), 6).alias("good_bound"))
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    return (
        urls.join(bound, "host", "left").withColumn("fit", rule)
        .select("page_id", "host", "path", F.col("fit.rule").alias("rule"),
                F.coalesce(F.col("fit.action"), F.when(F.col("good_bound") >= min_good, "allow").otherwise("block")).alias("verdict"), "good_bound")
    )


def op5_url_reputation(spark: SparkSession, folder: str) -> DataFrame:
    pages = load(spark, folder, "pages")
    return judge_urls(pages, labelled_outcomes(pages, load(spark, folder, "labels")))


ORACLE = rf"""
WITH u AS (
  SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path,
         try_cast(nullif(regexp_extract(url, '://[^/?#]*/[a-z]+/([0-9]+)', 1), '') AS BIGINT) AS doc_id
  FROM pages),
seen AS (
  SELECT doc_id, min(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END) AS good
  FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
hosts AS (
  SELECT host, count(*) AS n, sum(good) AS good,
         regexp_extract(host, '(?:[^.]*[.])?[^.]*$', 0) AS domain, string_split(host, '.')[-1] AS suffix
  FROM u JOIN seen USING (doc_id) GROUP BY host),
top AS (SELECT (coalesce(sum(good), 0) + 1) / (coalesce(sum(n), 0) + 2)::DOUBLE AS mean, coalesce(sum(n), 0) + 2.0 AS strength FROM hosts),
s0 AS (SELECT suffix, sum(n) AS n, sum(good) AS good, any_value(top.mean) AS m FROM hosts, top GROUP BY suffix),
sk AS (SELECT 1 / least({RHO[1]}, greatest({RHO[0]}, coalesce((sum((good - n*m)*(good - n*m)/n) - sum(m*(1-m))) / nullif(sum(m*(1-m)*(n-1)), 0), {RHO[0]}))) - 1 AS k FROM s0),
s AS (SELECT suffix, (good + k*m)/(n + k) AS mean FROM s0, sk),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good, any_value(s.mean) AS m FROM hosts JOIN s USING (suffix) GROUP BY domain, suffix),
dk AS (SELECT 1 / least({RHO[1]}, greatest({RHO[0]}, coalesce((sum((good - n*m)*(good - n*m)/n) - sum(m*(1-m))) / nullif(sum(m*(1-m)*(n-1)), 0), {RHO[0]}))) - 1 AS k FROM d0),
d AS (SELECT domain, (good + k*m)/(n + k) AS mean FROM d0, dk),
h0 AS (SELECT host, n, good, d.mean AS m FROM hosts JOIN d USING (domain)),
hk AS (SELECT 1 / least({RHO[1]}, greatest({RHO[0]}, coalesce((sum((good - n*m)*(good - n*m)/n) - sum(m*(1-m))) / nullif(sum(m*(1-m)*(n-1)), 0), {RHO[0]}))) - 1 AS k, count(*) AS found FROM h0),
h AS (SELECT host, (good + k*m)/(n + k) AS mean, n + k AS strength FROM h0, hk),
j AS (
  SELECT u.page_id, u.host, u.path, coalesce(h.mean, d.mean, s.mean, top.mean) AS mean,
         coalesce(h.strength, CASE WHEN hk.found > 0 THEN hk.k END, top.strength) AS strength
  FROM u CROSS JOIN top CROSS JOIN hk LEFT JOIN h ON u.host = h.host
  LEFT JOIN d ON regexp_extract(u.host, '(?:[^.]*[.])?[^.]*$', 0) = d.domain
  LEFT JOIN s ON string_split(u.host, '.')[-1] = s.suffix),
b AS (SELECT *, round(mean - {Z} * sqrt(mean * (1 - mean) / (strength + 1)), 6) AS good_bound FROM j),
r(action, rhost, rpath) AS (VALUES {", ".join(str(x) for x in RULES)}),
f AS (
  SELECT b.page_id, b.host, b.path, b.good_bound,
         (SELECT max(struct_pack(n := length(rhost || rpath), rule := rhost || rpath, action := action)) FROM r
          WHERE (b.host = rhost OR ends_with(b.host, '.' || rhost)) AND starts_with(b.path, rpath)) AS fit
  FROM b)
SELECT page_id, host, path, fit.rule AS rule,
       coalesce(fit.action, CASE WHEN good_bound >= {MIN_GOOD} THEN 'allow' ELSE 'block' END) AS verdict, good_bound
FROM f
"""
