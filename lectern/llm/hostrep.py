"""URL filter: rules by host and path, else the empirical-Bayes reputation of the host. DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import materialise, small

#: (verdict, host/path): a rule fits its host and all subdomains where the path starts with the rule's.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Hosts, some 50 bytes each, up to which their bounds are broadcast; beyond, the join shuffles and AQE may split a large host.
BROADCAST_HOSTS = 200_000
#: Suffixes of two labels under which a registered domain has three, unless the caller has a list of their own (fixed values).
TWO_LABELS = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "com.br", "com.cn", "com.mx", "co.in", "co.kr", "co.za", "com.tr", "com.tw", "com.sg")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, between the first :// and the next of / ? # or the end, A-Z lowered; the path from there to ? # or the end.

    Both are empty for a null url or one without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. The rules are a short list of the caller's."""
    found = F.lit(None)
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, start = rule.split("/", 1)
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def suffix_and_domain(host: Column, two_labels: tuple[str, ...] = TWO_LABELS) -> tuple[Column, Column]:
    """Public suffix and registered domain of a host; a host of one label is all three."""
    labels = F.split(host, r"\.")
    two = F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2))
    three = F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3))
    double = two.isin(*two_labels)
    return F.when(double, two).otherwise(F.element_at(labels, -1)), F.when(double, three).otherwise(two)


def strength(groups: DataFrame, bad: str, n: str) -> float:
    """The prior's weight in observations for groups of one level: 1 / rho - 1 by the analysis of variance of a beta-binomial, from 2 to 1000."""
    p = F.col(bad) / F.col(n)
    s = groups.where(F.col(n) > 0).agg(
        F.count("*").alias("h"), F.sum(n).alias("n"), F.sum(bad).alias("x"), F.sum(F.col(n) * F.col(n)).alias("nn"), F.sum(F.col(n) * p * p).alias("npp"), F.sum(F.col(n) * p * (1 - p)).alias("within"),
    ).first()
    if not s["n"] or s["h"] < 2 or s["n"] <= s["h"]:
        return 1000.0
    mean = s["x"] / s["n"]
    between = (s["npp"] - s["n"] * mean * mean) / (s["h"] - 1)
    within = s["within"] / (s["n"] - s["h"])
    size = (s["n"] - s["nn"] / s["n"]) / (s["h"] - 1)
    scale = between + (size - 1) * within
    rho = (between - within) / scale if scale > 0 else 0.0
    return min(1000.0, max(2.0, 1 / rho - 1)) if rho > 0 else 1000.0


def reputations(outcomes: DataFrame, z: float = 1.645, two_labels: tuple[str, ...] = TWO_LABELS) -> DataFrame:
    """host, bound: for each host of `outcomes` (host, bad 0 or 1) the lower bound of its chance of a bad page.

    Each level's mean is shrunk to that of the level above: suffix to all, registered domain to suffix, host to domain. A host's
    posterior is a beta distribution; the bound is its mean less z deviations. Null outcomes are not counted."""
    suffix, domain = suffix_and_domain(F.col("host"), two_labels)
    hosts = outcomes.where(F.col("bad").isNotNull()).groupBy("host").agg(F.sum("bad").cast("double").alias("x"), F.count("*").cast("double").alias("n"))
    hosts = materialise(hosts.withColumns({"suffix": suffix, "domain": domain}), "hosts")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("x").alias("dx"), F.sum("n").alias("dn"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dx").alias("sx"), F.sum("dn").alias("sn"))
    k_host, k_domain, k_suffix = strength(hosts, "x", "n"), strength(domains, "dx", "dn"), strength(suffixes, "sx", "sn")
    all_ = hosts.agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("x"), F.coalesce(F.sum("n"), F.lit(0.0)).alias("n")).first()
    mean = (all_["x"] + 1) / (all_["n"] + 2)
    suffixes = suffixes.withColumn("m", (F.col("sx") + k_suffix * mean) / (F.col("sn") + k_suffix)).select("suffix", "m")
    domains = domains.join(suffixes, "suffix").withColumn("dm", (F.col("dx") + k_domain * F.col("m")) / (F.col("dn") + k_domain)).select("domain", "dm")
    a, b = F.col("x") + k_host * F.col("dm"), F.col("n") - F.col("x") + k_host * (1 - F.col("dm"))
    bound = a / (a + b) - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return hosts.join(domains, "domain").select("host", bound.alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, most: float = 0.3, z: float = 1.645, two_labels: tuple[str, ...] = TWO_LABELS) -> DataFrame:
    """page_id, host, path, rule, verdict: one row for each row of `pages` (page_id, url and any more).

    The verdict is the longest fitting rule's, else block where the bound of the host's chance of a bad page is over `most`,
    else allow. outcomes: page_id and bad (1 or 0); pages without one are not counted, and with several count as bad if one is.

    - A null url, or one without ://, has empty host and path, fits no rule and shares the reputation of the empty host.
    - Repeated rows are judged each and count each; an empty table gives no rows; without outcomes all is allowed.
    - Urls of any length are read whole; columns beside page_id and url play no part. `two_labels` are the public suffixes of two labels."""
    host, path = host_and_path(F.col("url"))
    parts = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"))
    known = outcomes.groupBy("page_id").agg(F.max("bad").cast("int").alias("bad"))
    seen = parts.select("page_id", "host").join(known, "page_id").select("host", "bad")
    bounds = small(materialise(reputations(seen, z, two_labels), "reputations").withColumnRenamed("host", "_host"), BROADCAST_HOSTS)
    rule = rule_for(F.col("host"), F.col("path"), rules)
    joined = parts.join(bounds, F.col("host") == F.col("_host"), "left")
    method = F.when(F.coalesce(F.col("bound") > most, F.lit(False)), "block").otherwise("allow")
    joined = joined.withColumn("fit", rule)
    return joined.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), method).alias("verdict"))


ORACLE = r"""
WITH parts AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), shown AS (
  SELECT page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad
  FROM (SELECT page_id, TRY_CAST(NULLIF(regexp_extract(path, '/([0-9]+)', 1), '') AS BIGINT) AS doc_id FROM split) s JOIN labels l USING (doc_id)
  WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY page_id
), hosts AS (
  SELECT host, string_split(host, '.') AS l, sum(bad)::DOUBLE AS x, count(*)::DOUBLE AS n FROM split JOIN shown USING (page_id) GROUP BY host
), placed AS (
  SELECT host, x, n, CASE WHEN array_to_string(l[-2:], '.') IN (TWO_LABELS) THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix,
    CASE WHEN array_to_string(l[-2:], '.') IN (TWO_LABELS) THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain FROM hosts
), domains AS (SELECT suffix, domain, sum(x) AS x, sum(n) AS n FROM placed GROUP BY ALL
), suffixes AS (SELECT suffix, sum(x) AS x, sum(n) AS n FROM domains GROUP BY ALL
), levels AS (
  SELECT 'host' AS level, x, n FROM placed UNION ALL SELECT 'domain', x, n FROM domains UNION ALL SELECT 'suffix', x, n FROM suffixes
), sums AS (
  SELECT level, count(*) AS h, sum(n) AS n, sum(x) AS x, sum(n * n) AS nn, sum(x * x / n) AS npp, sum(x * (1 - x / n)) AS w FROM levels GROUP BY level
), squares AS (
  SELECT level, h, n, (npp - x * x / n) / NULLIF(h - 1, 0) AS b, w / NULLIF(n - h, 0) AS w, (n - nn / n) / NULLIF(h - 1, 0) AS s FROM sums
), rhos AS (SELECT level, CASE WHEN h < 2 OR n <= h OR b + (s - 1) * w <= 0 THEN 0 ELSE (b - w) / (b + (s - 1) * w) END AS rho FROM squares
), k AS (SELECT level, CASE WHEN rho > 0 THEN LEAST(1000.0, GREATEST(2.0, 1 / rho - 1)) ELSE 1000.0 END AS k FROM rhos
), ks AS (SELECT max(CASE level WHEN 'host' THEN k END) AS kh, max(CASE level WHEN 'domain' THEN k END) AS kd, max(CASE level WHEN 'suffix' THEN k END) AS ks FROM k
), overall AS (SELECT (COALESCE(sum(x), 0) + 1) / (COALESCE(sum(n), 0) + 2) AS m FROM hosts
), s1 AS (SELECT suffix, (x + ks * m) / (n + ks) AS sm FROM suffixes, ks, overall
), d1 AS (SELECT domain, (x + kd * sm) / (n + kd) AS dm FROM domains JOIN s1 USING (suffix), ks
), beta AS (SELECT host, x + kh * dm AS a, n - x + kh * (1 - dm) AS b FROM placed JOIN d1 USING (domain), ks
), bounds AS (SELECT host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM beta
), rules(verdict, rule, rhost, rpath) AS (VALUES
  ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'), ('allow', 'www.example.com/en/', 'www.example.com', '/en/'),
  ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')
), pairs AS (SELECT DISTINCT host, path FROM split
), fits AS (
  SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM pairs JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path
)
SELECT page_id, host, path, f.rule AS rule, COALESCE(f.verdict, CASE WHEN bound > 0.3 THEN 'block' ELSE 'allow' END) AS verdict
FROM split LEFT JOIN fits f USING (host, path) LEFT JOIN bounds USING (host)
""".replace("TWO_LABELS", ", ".join(f"'{x}'" for x in TWO_LABELS))
