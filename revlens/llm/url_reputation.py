"""URL filter: path rules first, then empirical-Bayes host reputation.

Labelled page outcomes are counted per host. A host's good rate is shrunk
through beta-binomial priors along its names: suffix, registered domain, host.
Each level's prior is centred on its parent's posterior mean; its strength
comes from the spread of the level's own rates around their parents (method of
moments over all labelled pages). A url is blocked when the lower posterior
bound of its host falls under a threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import materialize, require

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"),
         ("com/fr/", "allow"), ("com/de/", "block"))
# Suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "com.cn", "gov.uk", "org.uk")
Z = 1.645
THRESHOLD = 0.5
STRENGTH = (2.0, 1000.0)   # bounds of a prior's weight in pages
_UPPER, _LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    """(host, path): host after the first :// up to / ? # or the end, A-Z lowered; path up to ? # or the end."""
    u = F.col(url) if isinstance(url, str) else url
    full = F.coalesce(u.contains("://"), F.lit(False))
    rest = F.substring_index(u, "://", 1)
    after = F.substr(u, F.length(rest) + 4)
    host = F.translate(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWERED)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(full, host).otherwise(F.lit("")), F.when(full, path).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, NULL without one; equal lengths go by name."""
    rule = verdict = F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, tail = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + tail)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def suffix_of(host: str) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: str) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def _strength(nodes: DataFrame) -> DataFrame:
    """One row: the prior weight M of a level from (n, s, mean) of its nodes; rho = 1 / (M + 1) by moments."""
    rate, m = F.col("s") / F.col("n"), F.col("mean")
    spread = F.sum(F.col("n") * ((rate - m) * (rate - m) - m * (1 - m) / F.col("n")))
    scale = F.sum(m * (1 - m) * (F.col("n") - 1))
    rho = F.when(F.coalesce(F.col("scale"), F.lit(0.0)) > 0, F.col("spread") / F.col("scale")).otherwise(F.lit(0.0))
    low, high = STRENGTH
    return (nodes.filter("n > 0").agg(spread.alias("spread"), scale.alias("scale"))
            .select(F.when(rho <= 1 / (high + 1), F.lit(high))
                    .otherwise(F.greatest(F.lit(low), 1 / rho - 1)).alias("weight")))


def _posterior(nodes: DataFrame) -> DataFrame:
    """``nodes`` (.., n, s, mean of the parent) with the posterior's a and b; the prior weight is a scalar subquery."""
    return (nodes.withColumn("weight", _strength(nodes).scalar())
            .withColumn("a", F.col("weight") * F.col("mean") + F.col("s"))
            .withColumn("b", F.col("weight") * (1 - F.col("mean")) + F.col("n") - F.col("s"))
            .drop("weight", "mean"))


def reputations(outcomes: DataFrame) -> DataFrame:
    """(host, n, posterior_mean, posterior_bound) for hosts with ``n`` labelled pages, ``s`` of them good (0 for none)."""
    # Each level is read by its own prior weight and by the level below: written once, so that pages are counted once.
    hosts = materialize(outcomes.withColumn("domain", domain_of("host")).withColumn("suffix", suffix_of("host")),
                        "url-outcomes")
    domains = materialize(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("s").alias("s")),
                          "url-domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    root = suffixes.agg((F.coalesce(F.sum("s"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).scalar()
    mean = (F.col("a") / (F.col("a") + F.col("b"))).alias("mean")
    at_suffix = _posterior(suffixes.withColumn("mean", root))
    suffix_means = materialize(at_suffix.select("suffix", mean), "url-suffix-means")
    at_domain = _posterior(domains.join(suffix_means, "suffix"))
    domain_means = materialize(at_domain.select("suffix", "domain", mean), "url-domain-means")
    at_host = _posterior(hosts.join(domain_means, ["suffix", "domain"]))
    total = F.col("a") + F.col("b")
    sd = F.sqrt(F.col("a") * F.col("b") / (total * total * (total + 1)))
    return at_host.select("host", "n", (F.col("a") / total).alias("posterior_mean"),
                          (F.col("a") / total - Z * sd).alias("posterior_bound"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, n, s): labelled pages and good ones per host of ``pages`` (host, path); hosts without a label: 0, 0.

    A page shows the document whose number is the first run of digits of its
    path. A document is good when every label row of it has quality 1. Pages of
    one document and host are counted before the join, so that neither a hot
    host nor a hot document is one task's work.
    """
    number = F.regexp_extract("path", r"([0-9]{1,18})", 1)
    counted = (pages.select("host", F.when(number != "", number.cast("long")).alias("doc_id"))
               .groupBy("host", "doc_id").agg(F.count(F.lit(1)).alias("pages")))
    good = (labels.filter("doc_id is not null and quality is not null").groupBy("doc_id")
            .agg(F.min("quality").alias("quality")))
    return (counted.join(good, "doc_id", "left").groupBy("host")
            .agg(F.coalesce(F.sum(F.when(F.col("quality").isNotNull(), F.col("pages"))), F.lit(0)).alias("n"),
                 F.coalesce(F.sum(F.when(F.col("quality") == 1, F.col("pages"))), F.lit(0)).alias("s")))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, threshold: float = THRESHOLD, id_col: str = "page_id",
          url_col: str = "url") -> DataFrame:
    """Per row: (``id_col``, host, path, rule, verdict, n_labelled, posterior_mean, posterior_bound).

    A rule's verdict wins; else ``block`` when the host's lower posterior bound is
    under ``threshold``. A NULL url, or one without ://, has an empty host and path:
    all such rows are one host. Repeated rows are judged each; without labels every host
    has the root's prior. An empty table gives no rows.
    """
    require(pages, id_col, url_col)
    require(labels, "doc_id", "quality")
    host, path = host_and_path(url_col)
    seen = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    known = materialize(reputations(page_outcomes(seen, labels)), "url-hosts")
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("posterior_bound") >= threshold, F.lit("allow")).otherwise(F.lit("block"))
    return (seen.join(known, "host")
            .select(id_col, "host", "path", rule.alias("rule"), F.coalesce(said, own).alias("verdict"),
                    F.col("n").alias("n_labelled"), F.round("posterior_mean", 6).alias("posterior_mean"),
                    F.round("posterior_bound", 6).alias("posterior_bound")))


ORACLE = f"""
with cut as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) end as rest from pages),
seen as (select page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWERED}'), '') as host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from cut),
numbered as (select host, try_cast(nullif(regexp_extract(path, '([0-9]{{1,18}})', 1), '') as bigint) as doc_id from seen),
good as (select doc_id, min(quality) as quality from labels
    where doc_id is not null and quality is not null group by doc_id),
hosts as (select host, count(quality) as n, count(*) filter (where quality = 1) as s,
    case when array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') in {TWO_LABEL_SUFFIXES}
         then array_to_string(list_slice(string_split(host, '.'), -3, -1), '.')
         else array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') end as domain,
    case when array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') in {TWO_LABEL_SUFFIXES}
         then array_to_string(list_slice(string_split(host, '.'), -2, -1), '.')
         else string_split(host, '.')[-1] end as suffix
    from numbered left join good using (doc_id) group by host),
domains as (select suffix, domain, sum(n) as n, sum(s) as s from hosts group by suffix, domain),
suffixes as (select suffix, sum(n) as n, sum(s) as s from domains group by suffix),
p0 as (select suffix, n, s, (select (sum(s) + 1.0) / (sum(n) + 2.0) from suffixes) as m from suffixes),
w0 as (select sum(n * ((s / n - m) * (s / n - m) - m * (1 - m) / n)) / nullif(sum(m * (1 - m) * (n - 1)), 0) as rho
    from (select n::double as n, s::double as s, m from p0) where n > 0),
a0 as (select suffix, w * m + s as a, w * (1 - m) + n - s as b from p0,
    (select case when coalesce(rho, 0) <= 1 / 1001.0 then 1000.0 else greatest(2.0, 1 / rho - 1) end as w from w0)),
p1 as (select suffix, domain, n, s, a / (a + b) as m from domains join a0 using (suffix)),
w1 as (select sum(n * ((s / n - m) * (s / n - m) - m * (1 - m) / n)) / nullif(sum(m * (1 - m) * (n - 1)), 0) as rho
    from (select n::double as n, s::double as s, m from p1) where n > 0),
a1 as (select suffix, domain, w * m + s as a, w * (1 - m) + n - s as b from p1,
    (select case when coalesce(rho, 0) <= 1 / 1001.0 then 1000.0 else greatest(2.0, 1 / rho - 1) end as w from w1)),
p2 as (select host, n, s, a / (a + b) as m from hosts join a1 using (suffix, domain)),
w2 as (select sum(n * ((s / n - m) * (s / n - m) - m * (1 - m) / n)) / nullif(sum(m * (1 - m) * (n - 1)), 0) as rho
    from (select n::double as n, s::double as s, m from p2) where n > 0),
a2 as (select host, n, w * m + s as a, w * (1 - m) + n - s as b from p2,
    (select case when coalesce(rho, 0) <= 1 / 1001.0 then 1000.0 else greatest(2.0, 1 / rho - 1) end as w from w2)),
known as (select host, n, a / (a + b) as mean,
    a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) as bound from a2),
fits as (select page_id, host, path,
    case when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/en/1') then 'example.org/en/1'
         when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/es/') then 'example.org/es/'
         when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/fr/') then 'com/fr/'
         when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/de/') then 'com/de/'
         when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/') then 'org/' end as rule from seen)
select page_id, host, path, rule,
    case when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block'
         when bound >= {THRESHOLD} then 'allow' else 'block' end as verdict,
    cast(n as bigint) as n_labelled, round(mean, 6) as posterior_mean, round(bound, 6) as posterior_bound
from fits join known using (host)"""
