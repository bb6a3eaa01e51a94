"""URL filters: fixed rules, and empirical-Bayes reputations of hosts under their domains and suffixes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.llm.common import lower_ascii, table


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)

# Suffixes of two labels, under which a registered domain has three.
LONG_SUFFIXES = (
    "ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx",
    "com.tr", "gov.uk", "net.au", "org.au", "org.uk",
)


@dataclass(frozen=True)
class Settings:
    """least: a host is blocked if the lower bound of its share of good pages is under it.

    deviations: the bound lies so many posterior standard deviations under the mean.  strengths: bounds of a
    prior's weight in pages, between which it is estimated.
    """

    least: float = 0.5
    deviations: float = 1.645
    strengths: tuple[float, float] = (2.0, 1000.0)


def host_of(url: Column) -> Column:
    """After the first `://`, up to `/`, `?`, `#` or the end, A-Z in lower case; empty without one or for null."""
    return lower_ascii(F.regexp_extract(_after(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """After the host, up to `?`, `#` or the end."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null if none does."""
    name = verdict = None
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, rule.name) if name is None else name.when(fits, rule.name)
        verdict = F.when(fits, rule.verdict) if verdict is None else verdict.when(fits, rule.verdict)
    if name is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return name, verdict


def suffix_of(host: Column) -> Column:
    last_two = F.substring_index(host, ".", -2)
    return F.when(last_two.isin(*LONG_SUFFIXES), last_two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """Registered domain: the label before the suffix and the suffix; a host that is a suffix is its own."""
    last_two = F.substring_index(host, ".", -2)
    return F.when(last_two.isin(*LONG_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(last_two)


def reputations(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """`host, pages, mean, bound` for every host; `pages` has `host` and `good`, null where a page is not labelled.

    A level's share of good pages is a beta-binomial with the mean of the level above as its prior: all pages, then
    the suffix, the registered domain, the host.  The weight of a prior is found from how much the shares of a level
    scatter around it beyond chance.  Hosts without a labelled page have their domain's share, and a bound as wide
    as its prior.
    """
    hosts = pages.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    hosts = hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = suffixes.agg(F.sum("n"), F.sum("good")).first()
    share = ((total[1] or 0) + 1) / ((total[0] or 0) + 2)

    suffixes = suffixes.withColumn("prior", F.lit(share))
    suffixes = _shrunk(suffixes, settings).select("suffix", F.col("mean").alias("prior"))
    domains = _shrunk(domains.join(suffixes, "suffix"), settings).select("domain", F.col("mean").alias("prior"))
    hosts = _shrunk(hosts.join(domains, "domain"), settings)
    spread = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("weight") + 1))
    return hosts.select("host", F.col("n").alias("pages"), "mean", (F.col("mean") - settings.deviations * spread).alias("bound"))


def _shrunk(groups: DataFrame, settings: Settings) -> DataFrame:
    """`mean`: the share `good / n` drawn towards `prior` by a `weight` that is one number for all groups."""
    scatter = (F.col("good") - F.col("n") * F.col("prior")) ** 2 / (F.col("n") * F.col("prior") * (1 - F.col("prior")))
    found = groups.filter("n > 0").agg(F.count("*"), F.sum("n"), F.sum(scatter)).first()
    weight = weight_of(found[0], found[1] or 0, found[2] or 0.0, settings)
    shrunk = groups.withColumn("weight", F.lit(weight))
    return shrunk.withColumn("mean", (F.col("good") + F.col("weight") * F.col("prior")) / (F.col("n") + F.col("weight")))


def weight_of(groups: int, pages: int, scatter: float, settings: Settings) -> float:
    """Of n pages, the scatter has a mean of 1 + (n - 1) / (weight + 1) in each group."""
    low, high = settings.strengths
    if pages <= groups or scatter <= groups:
        return high
    return min(max((pages - groups) / (scatter - groups) - 1, low), high)


def judged(
    pages: DataFrame, outcomes: DataFrame, rules: tuple[Rule, ...] = RULES, settings: Settings = Settings(), key: str = "page_id"
) -> DataFrame:
    """`key, host, path, rule, verdict, bound` for every page.

    `outcomes` has `key` and `good` (0, 1 or null); of several outcomes of a key the worst counts.  A page without a
    host has the reputation of the pages without one.  Repeated pages are judged, and count, each.
    """
    url = F.col("url")
    seen = pages.select(key, host_of(url).alias("host"), path_of(url).alias("path"))
    worst = outcomes.groupBy(key).agg(F.min("good").alias("good"))
    known = reputations(seen.select(key, "host").join(worst, key, "left"), settings).select("host", "bound")
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("bound") < settings.least, "block").otherwise("allow")
    return seen.join(known, "host", "left").select(
        key, "host", "path", name.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "bound"
    )


def op9_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of a page are those of its id; a page is good if its quality is 1 and it is not toxic."""
    good = ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), good.alias("good"))
    found = judged(table(spark, sf_dir, "pages"), outcomes)
    return found.select("page_id", "host", "path", "rule", "verdict")


_LEVEL = """
  {name}_w AS (
    SELECT CASE WHEN sum(n) <= count(*) OR sum(s) <= count(*) THEN 1000.0
           ELSE least(greatest((sum(n) - count(*)) / (sum(s) - count(*)) - 1, 2.0), 1000.0) END AS w
    FROM (SELECT n, power(good - n * prior, 2) / (n * prior * (1 - prior)) AS s FROM {name}_p WHERE n > 0)),
  {name} AS (
    SELECT {name}_p.*, coalesce(w, 1000.0) AS weight, (good + coalesce(w, 1000.0) * prior) / (n + coalesce(w, 1000.0)) AS mean
    FROM {name}_p, {name}_w)"""

SQL = f"""
WITH rest AS (
    SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0
                         THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
  seen AS (
    SELECT page_id, translate(regexp_extract(r, '^[^/?#]*', 0),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
  outcomes AS (
    SELECT doc_id AS page_id, min(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1
                                       WHEN quality IS NULL THEN NULL ELSE 0 END) AS good
    FROM labels GROUP BY doc_id),
  host_n AS (
    SELECT host, count(good) AS n, coalesce(sum(good), 0) AS good
    FROM seen LEFT JOIN outcomes USING (page_id) GROUP BY host),
  host_l AS (SELECT *, regexp_extract(host, '[^.]*[.][^.]*$', 0) AS two FROM host_n),
  host_d AS (
    SELECT host, n, good,
      CASE WHEN two IN ({", ".join(f"'{s}'" for s in LONG_SUFFIXES)}) THEN coalesce(
             nullif(regexp_extract(host, '[^.]*[.][^.]*[.][^.]*$', 0), ''), host)
           ELSE coalesce(nullif(two, ''), host) END AS domain,
      CASE WHEN two IN ({", ".join(f"'{s}'" for s in LONG_SUFFIXES)}) THEN two
           ELSE regexp_extract(host, '[^.]*$', 0) END AS suffix
    FROM host_l),
  domain_n AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM host_d GROUP BY domain, suffix),
  suffix_p AS (
    SELECT suffix, sum(n) AS n, sum(good) AS good,
           ((SELECT coalesce(sum(good), 0) FROM domain_n) + 1) * 1.0
           / ((SELECT coalesce(sum(n), 0) FROM domain_n) + 2) AS prior
    FROM domain_n GROUP BY suffix),{_LEVEL.format(name="suffix")},
  domain_p AS (SELECT d.*, s.mean AS prior FROM domain_n d JOIN suffix s USING (suffix)),{_LEVEL.format(name="domain")},
  host_p AS (SELECT h.host, h.n, h.good, d.mean AS prior FROM host_d h JOIN domain d USING (domain)),{_LEVEL.format(name="host")},
  ruled AS (
    SELECT page_id, host, path, CASE
      {" ".join(
          f"WHEN (host = '{r.host}' OR suffix(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.name}'"
          for r in sorted(RULES, key=lambda r: (-len(r.name), r.name)))}
      END AS rule FROM seen)
SELECT page_id, ruled.host AS host, path, rule, CASE
    {" ".join(f"WHEN rule = '{r.name}' THEN '{r.verdict}'" for r in RULES)}
    WHEN mean - 1.645 * sqrt(mean * (1 - mean) / (n + weight + 1)) < 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled JOIN host ON ruled.host = host.host
""".replace("suffix(host, ", "ends_with(host, ")
