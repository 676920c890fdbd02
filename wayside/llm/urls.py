"""Host reputation by empirical Bayes, with DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayside.llm.common import materialise, table

#: (rule, verdict): a host, then the start of the path.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
#: Suffixes of two labels, under which a registered domain has three.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in", "co.nz")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLIT_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, SPLIT_URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, SPLIT_URL, 2), F.lit(""))


def registered_domain(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null where none does. Rules are few and fixed."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def prior_strength(counts: DataFrame, least: float, most: float) -> DataFrame:
    """One row ``strength``: how many pages the prior of a level weighs, by the moments of its groups.

    ``counts`` has (n, bad) for each group. The share of the variance that lies between groups,
    beyond what chance gives, is rho; a beta prior of strength 1/rho - 1 has that share. Kept
    between ``least`` and ``most``, the latter if the groups don't differ more than by chance.
    """
    s = counts.filter("n > 0").agg(
        F.sum("n").cast("double").alias("pages"), F.sum("bad").cast("double").alias("failed"),
        F.count(F.lit(1)).alias("groups"), F.sum(F.col("n") * F.col("n")).cast("double").alias("squares"),
        F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("within"),
    )
    p = F.col("failed") / F.col("pages")
    between = F.col("within") - F.col("failed") * F.col("failed") / F.col("pages") - p * (1 - p) * (F.col("groups") - 1)
    scale = p * (1 - p) * (F.col("pages") - F.col("squares") / F.col("pages") - (F.col("groups") - 1))
    rho = F.when(scale > 0, between / scale)
    strength = F.when(rho > 0, F.greatest(F.lit(least), F.least(F.lit(most), 1 / rho - 1))).otherwise(F.lit(most))
    return s.select(strength.alias("strength"))


def reputation(
    hosts: DataFrame, threshold: float = 0.5, z: float = 1.645, least: float = 2.0, most: float = 200.0
) -> DataFrame:
    """Posterior failure rate of each host and whether it is blocked.

    ``hosts`` has (host, n labelled pages, bad ones). The overall rate is the prior mean of suffixes,
    a suffix's posterior mean that of its registered domains, and a domain's that of its hosts; the
    strength of each level's prior is estimated from its groups. A host is blocked if the lower
    bound of its posterior, mean minus ``z`` standard deviations, is above ``threshold``. Hosts
    without labelled pages get their domain's rate. Returns host, posterior, lower_bound, blocked.
    """
    hosts = hosts.withColumn("domain", registered_domain(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    total = (F.sum("n").cast("long").alias("n"), F.sum("bad").cast("long").alias("bad"))
    domains = hosts.groupBy("domain", "suffix").agg(*total)
    suffixes = domains.groupBy("suffix").agg(*total)
    overall = suffixes.agg(((F.sum("bad") + 1) / (F.sum("n") + 2)).alias("mean"))

    def posterior(of: DataFrame, prior: DataFrame, on: list[str]) -> DataFrame:
        # a prior of one row joins every group; others join on the key of the level above
        both = of.join(prior, on) if on else of.join(F.broadcast(prior))
        return both.join(F.broadcast(prior_strength(of, least, most)))

    mean = (F.col("bad") + F.col("strength") * F.col("mean")) / (F.col("n") + F.col("strength"))
    by_suffix = posterior(suffixes, overall, []).select("suffix", mean.alias("mean"))
    by_domain = posterior(domains, by_suffix, ["suffix"]).select("domain", mean.alias("mean"))
    a = F.col("bad") + F.col("strength") * F.col("mean")
    b = F.col("n") - F.col("bad") + F.col("strength") * (1 - F.col("mean"))
    deviation = F.sqrt(F.col("a") * F.col("b") / ((F.col("a") + F.col("b")) * (F.col("a") + F.col("b")) * (F.col("a") + F.col("b") + 1)))
    return (
        posterior(hosts, by_domain, ["domain"])
        .select("host", a.alias("a"), b.alias("b"))
        .select("host", (F.col("a") / (F.col("a") + F.col("b"))).alias("posterior"), deviation.alias("deviation"))
        .select("host", "posterior", (F.col("posterior") - z * F.col("deviation")).alias("lower_bound"))
        .withColumn("blocked", F.col("lower_bound") > threshold)
    )


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, threshold: float = 0.5, z: float = 1.645) -> DataFrame:
    """Judge every page's url by the longest fitting rule, else by its host's reputation.

    ``outcomes`` has (page_id, bad 0/1); several rows of a page count as one, bad if any is. Pages
    without an outcome are judged but don't inform. A null url, or one without ``://``, has empty
    host and path; those pages share one reputation. Returns page_id, host, path, rule, verdict,
    posterior and lower_bound (rounded to 6 places), one row for each page, repeated ids included.
    Without outcomes every host has the prior's rate; no pages give no rows; other columns of either table are not read. Pages of a hot host are counted before the shuffle, and its join can be split.
    """
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = outcomes.filter("bad is not null").groupBy(F.col("page_id").alias("o_id")).agg(F.max("bad").cast("long").alias("bad"))
    hosts = (
        urls.join(known, F.col("page_id") == F.col("o_id"), "left")
        .groupBy("host")
        .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
    )
    hosts = materialise(hosts, "hosts")
    rule, says = longest_rule(F.col("host"), F.col("path"), rules)
    judged = urls.join(reputation(hosts, threshold, z), "host", "left")
    return judged.select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(says, F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"),
        F.round("posterior", 6).alias("posterior"), F.round("lower_bound", 6).alias("lower_bound"),
    )


def labelled_outcomes(labels: DataFrame) -> DataFrame:
    """A page is bad if its row in ``labels`` says toxic or of no quality; both null says nothing."""
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(
        F.col("toxic").isNotNull() | F.col("quality").isNotNull(), 0
    )
    return labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))


def op2_host_reputation(spark, sf_dir):
    """Every row of ``pages``; outcomes are the rows of ``labels`` with the page's number."""
    return judge_urls(table(spark, sf_dir, "pages"), labelled_outcomes(table(spark, sf_dir, "labels")))


def _level(name: str, of: str, prior: str, join: str) -> str:
    strength = f"""(SELECT CASE WHEN scale > 0 AND between_ / scale > 0
      THEN greatest(2.0e0, least(200.0e0, 1 / (between_ / scale) - 1)) ELSE 200.0e0 END AS strength FROM (
      SELECT within - failed * failed / pages - (failed / pages) * (1 - failed / pages) * (groups - 1) AS between_,
             (failed / pages) * (1 - failed / pages) * (pages - squares / pages - (groups - 1)) AS scale
      FROM (SELECT sum(n)::DOUBLE AS pages, sum(bad)::DOUBLE AS failed, count(*) AS groups,
                   sum(n * n)::DOUBLE AS squares, sum((bad * bad)::DOUBLE / n) AS within FROM {of} WHERE n > 0)))"""
    return f"""{name} AS (
  SELECT o.*, (o.bad + s.strength * p.mean) / (o.n + s.strength) AS mean, o.bad + s.strength * p.mean AS a,
         o.n - o.bad + s.strength * (1 - p.mean) AS b
  FROM {of} o CROSS JOIN {strength} s {join})"""


def _oracle() -> str:
    rule = verdict = "NULL"
    for text, says in sorted(RULES, key=lambda r: len(r[0])):
        name, slash, rest = text.partition("/")
        fits = f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash}{rest}')"
        rule, verdict = f"CASE WHEN {fits} THEN '{text}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{says}' ELSE {verdict} END"
    two = "array_to_string(list_slice(string_split(host, '.'), -2, -1), '.')"
    three = "array_to_string(list_slice(string_split(host, '.'), -3, -1), '.')"
    known = ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)
    return f"""
WITH urls AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '{SPLIT_URL}', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '{SPLIT_URL}', 2), '') AS path FROM pages),
known AS (SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels
  WHERE toxic IS NOT NULL OR quality IS NOT NULL GROUP BY doc_id),
hosts AS (
  SELECT host, CASE WHEN {two} IN ({known}) THEN {three} ELSE {two} END AS domain,
         CASE WHEN {two} IN ({known}) THEN {two} ELSE string_split(host, '.')[-1] END AS suffix,
         count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS bad
  FROM urls LEFT JOIN known ON page_id = doc_id GROUP BY ALL),
domains AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM domains GROUP BY ALL),
overall AS (SELECT (sum(bad) + 1)::DOUBLE / (sum(n) + 2)::DOUBLE AS mean FROM suffixes),
{_level("by_suffix", "suffixes", "overall", "CROSS JOIN overall p")},
{_level("by_domain", "domains", "by_suffix", "JOIN by_suffix p ON o.suffix = p.suffix")},
{_level("by_host", "hosts", "by_domain", "JOIN by_domain p ON o.domain = p.domain")},
bounds AS (
  SELECT host, a / (a + b) AS posterior, a / (a + b) - 1.645e0 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS lower_bound
  FROM by_host)
SELECT page_id, u.host, path, {rule.replace("host", "u.host")} AS rule,
       coalesce({verdict.replace("host", "u.host")}, CASE WHEN lower_bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
       round(posterior, 6) AS posterior, round(lower_bound, 6) AS lower_bound
FROM urls u JOIN bounds b ON u.host = b.host
"""


ORACLE = _oracle()
