"""URL filter: rules first, else an empirical-Bayes reputation of the host.

Labelled page outcomes (bad or not) are counted by host, registered domain and
suffix. Each level is a beta-binomial: its prior has the mean of the level above
and a strength fitted by moments over all groups of the level. A host is blocked
if the lower bound of its posterior bad rate (mean - Z sd) is above ``BOUND``.

Counts are aggregated by host and written once, before anything else is joined;
domains and suffixes come from the host counts. Only four fitted numbers reach
the driver. Pages meet the table of hosts in one join on the host, where Spark
may split a hot one.

Defined results: a null url, or one without ``://``, has an empty host and path
and gets the method's verdict for the empty host; repeated pages are judged
each; repeated labels of one page count once (bad if any says so); without any
label every host has the prior alone and passes; without pages the result is
empty; very long urls are read whole. Other columns of pages are kept, whatever
their names; the added names replace columns so named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import UPPER, cut, set_aside

#: (rule, verdict): host, then path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Second-level labels that act as part of the suffix before a country code.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gen", "go", "gob", "gouv", "gov", "gv", "ltd", "mil", "ne", "net", "nhs", "nom", "or", "org", "plc", "sch")
Z = 1.645
BOUND = 0.5
#: Limits of a fitted prior strength.
WEAKEST, STRONGEST = 1.0, 1000.0


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, action in sorted(rules, key=lambda r: len(r[0])):
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def domain_of(host: Column) -> Column:
    """Registered domain: two labels, or three under a suffix such as co.uk; no user, no port."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")
    second = "|".join(SECOND_LEVEL)
    three = F.regexp_extract(name, rf"([^.]+\.(?:{second})\.[a-z]{{2}})$", 1)
    two = F.regexp_extract(name, r"([^.]+\.[^.]+)$", 1)
    return F.when(three != "", three).when(two != "", two).otherwise(name)


def suffix_of(domain: Column) -> Column:
    return F.when(domain.contains("."), F.regexp_replace(domain, r"^[^.]*\.", "")).otherwise(domain)


def _moments(groups: DataFrame, parent: str) -> list[Column]:
    """Sums for the strength of a level: groups have n, k and the mean of the level above."""
    m, n = F.col(parent), F.col("n")
    p = F.col("k") / n
    return [
        F.sum(n * (p - m) * (p - m)).alias("s"),
        F.sum(m * (1 - m)).alias("v"),
        F.sum(n * m * (1 - m)).alias("nv"),
    ]


def _strength(groups: DataFrame, parent: str) -> float:
    """Beta strength M = 1 / rho - 1, where E[n (p - m)^2] = m (1 - m) (1 + (n - 1) rho)."""
    s, v, nv = groups.agg(*_moments(groups, parent)).first()
    if s is None or nv - v <= 0:
        return STRONGEST
    rho = (s - v) / (nv - v)
    if rho <= 1 / (STRONGEST + 1):
        return STRONGEST
    return max(WEAKEST, 1 / rho - 1)


def reputation(counts: DataFrame) -> tuple[DataFrame, DataFrame, dict]:
    """From (host, domain, suffix, n, k): means by domain and suffix, and the fitted numbers."""
    n, k = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))).first()
    mean = (k + 0.5) / (n + 1)
    suffixes = counts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("m0", F.lit(float(mean)))
    m_suffix = _strength(suffixes, "m0")
    suffixes = suffixes.select("suffix", ((F.col("k") + m_suffix * mean) / (F.col("n") + m_suffix)).alias("suffix_mean"))
    domains = counts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).join(suffixes, "suffix")
    m_domain = _strength(domains, "suffix_mean")
    domains = domains.select("domain", ((F.col("k") + m_domain * F.col("suffix_mean")) / (F.col("n") + m_domain)).alias("domain_mean"))
    hosts = counts.select("host", "domain", "n", "k").join(domains, "domain")
    fitted = {"mean": float(mean), "suffix": m_suffix, "domain": m_domain, "host": _strength(hosts, "domain_mean")}
    return domains, suffixes, fitted


def url_filter(pages: DataFrame, outcomes: DataFrame, rules=RULES, bound: float = BOUND, z: float = Z) -> DataFrame:
    """``outcomes``: page_id, bad (Boolean). Adds host, path, rule, verdict, bad_rate and bad_rate_low."""
    added = ("host", "path", "rule", "verdict", "bad_rate", "bad_rate_low")
    pages, back = set_aside(pages, added, ("page_id", "url"))
    pages = pages.withColumn("host", host_of(F.col("url")))
    bad = outcomes.where(F.col("bad").isNotNull()).groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    labelled = pages.select("page_id", "host").join(bad, "page_id", "left")
    hosts = labelled.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    hosts = cut(hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("domain"))))
    domains, suffixes, fit = reputation(hosts.where("n > 0"))
    prior = F.coalesce("domain_mean", "suffix_mean", F.lit(fit["mean"]))
    a, b = F.col("k") + fit["host"] * prior, F.col("n") - F.col("k") + fit["host"] * (1 - prior)
    hosts = hosts.join(domains, "domain", "left").join(suffixes, "suffix", "left").select("host", a.alias("a"), (a + b).alias("total"))
    rate = F.col("a") / F.col("total")
    hosts = hosts.select("host", rate.alias("bad_rate"), (rate - z * F.sqrt(rate * (1 - rate) / (F.col("total") + 1))).alias("bad_rate_low"))
    judged = pages.withColumn("path", path_of(F.col("url"))).join(hosts, "host", "left")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(verdict, F.when(F.col("bad_rate_low") > bound, "block").otherwise("allow"))
    return back(judged.withColumn("rule", rule).withColumn("verdict", verdict), *added)


def outcomes_of(labels: DataFrame) -> DataFrame:
    """Page outcomes from labels of the same id: bad if of low quality or toxic."""
    return labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))


def query(spark, sf_dir: str) -> DataFrame:
    from lorekeep.llm.common import table

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = url_filter(pages, outcomes_of(table(spark, sf_dir, "labels")))
    return out.select("page_id", "host", "path", "rule", "verdict")


def _case(rules=RULES) -> str:
    whens = []
    for text, _ in sorted(rules, key=lambda r: -len(r[0])):
        h, _, p = text.partition("/")
        whens.append(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '/{p}') then '{text}'")
    return "case " + " ".join(whens) + " end"


def _level(name: str, source: str, parent: str, key: str) -> str:
    return f"""{name}_m as (
  select case when s is null or nv - v <= 0 then {STRONGEST}
              when (s - v) / (nv - v) <= {1 / (STRONGEST + 1)!r} then {STRONGEST}
              else greatest({WEAKEST}, 1 / ((s - v) / (nv - v)) - 1) end as m
  from (select sum(n * (k / n - {parent}) * (k / n - {parent})) s, sum({parent} * (1 - {parent})) v, sum(n * {parent} * (1 - {parent})) nv from {source})
)"""


SQL = rf"""
with p as (
  select page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{UPPER.lower()}') as host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
  from pages
), bad as (
  select doc_id as page_id, max(case when quality = 0 or toxic = 1 then 1 else 0 end) as bad
  from labels where (quality = 0 or toxic = 1) is not null group by doc_id
), d as (
  select *, case when three <> '' then three when two <> '' then two else name end as domain
  from (select *, regexp_extract(name, '([^.]+\.(?:{"|".join(SECOND_LEVEL)})\.[a-z][a-z])$', 1) as three,
               regexp_extract(name, '([^.]+\.[^.]+)$', 1) as two
        from (select *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') as name
              from (select distinct host from p)))
), h as (
  select host, domain, case when contains(domain, '.') then regexp_replace(domain, '^[^.]*\.', '') else domain end as suffix from d
), c as (
  select h.host, domain, suffix, count(*)::double as n, sum(bad)::double as k
  from p join bad using (page_id) join h on h.host = p.host group by all
), g as (
  select (coalesce(sum(k), 0) + 0.5::double) / (coalesce(sum(n), 0) + 1) as m0 from c
), s0 as (
  select suffix, sum(n) as n, sum(k) as k, any_value(m0) as m0 from c, g group by suffix
), {_level("s", "s0", "m0", "suffix")}, s1 as (
  select suffix, (k + m * m0) / (n + m) as suffix_mean from s0, s_m
), d0 as (
  select suffix, domain, sum(n) as n, sum(k) as k, any_value(suffix_mean) as suffix_mean from c join s1 using (suffix) group by suffix, domain
), {_level("d", "d0", "suffix_mean", "domain")}, d1 as (
  select domain, (k + m * suffix_mean) / (n + m) as domain_mean from d0, d_m
), h0 as (
  select host, n, k, domain_mean from c join d1 using (domain)
), {_level("h", "h0", "domain_mean", "host")}, ab as (
  select h.host, coalesce(c.k, 0) + m * coalesce(domain_mean, suffix_mean, m0) as a,
         coalesce(c.n - c.k, 0) + m * (1 - coalesce(domain_mean, suffix_mean, m0)) as b
  from h left join c on c.host = h.host left join d1 on d1.domain = h.domain left join s1 on s1.suffix = h.suffix, h_m, g
), low as (
  select host, a / (a + b) - {Z} * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) as low from ab
), r as (
  select page_id, host, path, {_case()} as rule, low from p join low using (host)
)
select page_id, host, path, rule,
       case {" ".join(f"when rule = '{t}' then '{v}'" for t, v in RULES)} when low > {BOUND} then 'block' else 'allow' end as verdict
from r
"""
