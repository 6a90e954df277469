"""Facts of web pages, shared queues and data cubes."""

from __future__ import annotations

from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import text as t
from lectern.operators import markup


def page_kind(links: Column, html: Column) -> Column:
    """What a search page is: blocked, with results, without any, still loading, or something else."""
    low = F.lower(html)
    return (
        F.when(low.rlike("captcha|access denied|unusual traffic"), "PUBLISHER_BLOCKED").when(links > 0, "RESULTS_PRESENT").when(low.rlike("no results|did not match any"), "GENUINE_ZERO_RESULTS").when(low.rlike("loading"), "PENDING").otherwise("NON_SEARCH_PAGE")
    )


def domain(url: Column) -> Column:
    """The host of a url, lowered, without www. and a closing dot."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", ""), r"\.$", "")


def officiality(pages: DataFrame, domains: list[str]) -> DataFrame:
    """page_id, domain, state, gate: whether a page is on an official domain or a subdomain of one, and what bars it."""
    host = domain(F.col("url"))
    exact, below = F.lit(False), F.lit(False)
    for d in domains:
        exact, below = exact | (host == d), below | host.endswith("." + d)
    text = F.lower(F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style|noscript)\b.*?</\1>", " "), "<[^>]*>", " "))
    gate = F.when(text.contains("captcha"), "CHALLENGE").when(text.rlike("sign in|log in"), "LOGIN")
    return pages.select("page_id", host.alias("domain"), F.when(exact, "CONFIRMED").when(below, "PROBABLE").otherwise("UNVERIFIED").alias("state"), gate.alias("gate"))


@F.arrow_udf(T.StringType())
def absolute(base: pa.Array, href: pa.Array) -> pa.Array:
    """A link as it is followed from its page; null where it cannot be read."""

    def join(b: str | None, h: str | None) -> str | None:
        try:
            return None if h is None else urljoin(b or "", h.strip())
        except ValueError:
            return None

    return pa.array([join(b, h) for b, h in zip(base.to_pylist(), href.to_pylist(), strict=True)], pa.string())


def _within(host: Column, domains: list[str]) -> Column:
    found = F.lit(False)
    for d in domains:
        found = found | (host == d) | host.endswith("." + d)
    return F.coalesce(found, F.lit(False))


# Links that lead off the campus network, and how sure a link is by what tells it.
OFF_CAMPUS = ("校外", "off-campus", "off campus", "remote access")
BOTH, BY_NAME, BY_DOMAIN = 120, 100, 90


def discover(pages: DataFrame, names: list[str], domains: list[str], trusted: list[str]) -> DataFrame:
    """page_id, url, name, domain, basis, confidence of the links of pages (page_id, url, html) to a database: by one of its `names` in the link's text, title,
    label or data-name, by its host among `domains`, or both; a name alone counts on `trusted` hosts and below only.

    Links that say they are for off-campus use are left out. Of links to one address, without user, query and fragment, the surest is told,
    of equally sure ones the first: unique_top() then takes the one that is surest, or tells that none is."""
    held = markup.elements(pages, only={"a"}).where(markup.attribute("href").isNotNull())
    said = F.concat_ws(" ", "whole", *[markup.attribute(a) for a in ("title", "aria-label", "data-name")])
    links = held.select("page_id", "node", said.alias("said"), markup.attribute("href").alias("href")).join(pages.select("page_id", F.col("url").alias("_base")), "page_id")
    links = links.withColumn("url", absolute("_base", "href")).withColumn("domain", domain(F.col("url"))).where("domain IS NOT NULL")
    key = F.lower(t.label_key(F.col("said")))
    by_name = F.exists(F.array(*[F.lower(t.label_key(F.lit(n))) for n in names]), lambda n: (n != "") & key.contains(n))
    by_domain = F.col("domain").isin(*domains)
    off = F.exists(F.array(*map(F.lit, OFF_CAMPUS)), lambda w: F.lower("said").contains(w))
    fits = by_domain | (by_name & _within(F.col("domain"), trusted))
    confidence = F.when(by_name & by_domain, BOTH).when(by_name, BY_NAME).otherwise(BY_DOMAIN)
    basis = F.concat_ws("+", F.when(by_name, "database-name"), F.when(by_domain, "official-domain"), F.when(~by_domain, "trusted-page"))
    found = links.where(~off & fits).select("page_id", t.sanitize_url(F.col("url")).alias("url"), F.struct((-confidence).alias("minus"), "node", t.squeeze(F.col("said")).alias("name"), "domain", basis.alias("basis"), confidence.alias("confidence")).alias("l"))
    best = found.groupBy("page_id", "url").agg(F.min("l").alias("l"))
    return best.select("page_id", "url", "l.name", "l.domain", "l.basis", "l.confidence")


# What in an address or a text says that a page is a gate.
LOGIN_PATHS = ("/login", "/signin", "/sign-in", "/sso", "/auth/")
LOGIN_TEXT, CHALLENGE_TEXT = r"(?i)sign in to continue|please (?:log|sign) in|authentication required|请登录", r"(?i)captcha|verify you are human|security check|unusual traffic|安全验证"
RESTRICTED_TEXT, RESTRICTED_STATUS = r"(?i)access denied|subscribers only|subscription required|purchase access|无权访问", (401, 403, 407, 429, 451)


def official_evidence(pages: DataFrame, claims: list[str], allowed: list[str]) -> DataFrame:
    """page_id, domain, canonical, state, gate of pages (page_id, url, html, status): the address that a page says is its own, whether its host is one that is
    claimed as official (CONFIRMED) or one that is allowed (PROBABLE), and what bars it: LOGIN, CHALLENGE or RESTRICTED, in this order."""
    held = markup.elements(pages, only={"link"})
    own = markup.attribute("href")
    canonical = held.where(F.array_contains(F.split(F.lower(markup.attribute("rel")), r"\s+"), "canonical") & own.rlike(r"^https?://[^/?#]+")).groupBy("page_id").agg(F.min_by(F.trim(own), "node").alias("_canonical"))
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style|noscript)\b.*?</\1>", " "), "<[^>]*>", " ")
    path = F.lower("url")
    login = F.exists(F.array(*map(F.lit, LOGIN_PATHS)), lambda m: path.contains(m)) | text.rlike(LOGIN_TEXT)
    gate = F.when(login, "LOGIN").when(text.rlike(CHALLENGE_TEXT), "CHALLENGE").when(F.col("status").isin(*RESTRICTED_STATUS) | text.rlike(RESTRICTED_TEXT), "RESTRICTED")
    host = domain(F.col("url"))
    state = F.when(_within(host, claims), "CONFIRMED").when(_within(host, allowed), "PROBABLE").otherwise("UNVERIFIED")
    return pages.join(canonical, "page_id", "left").select("page_id", host.alias("domain"), F.coalesce("_canonical", "url").alias("canonical"), state.alias("state"), gate.alias("gate"))


def unique_top(candidates: DataFrame, key: str) -> DataFrame:
    """key, url, confidence, outcome: the candidate (key, url, confidence) of the highest confidence, uncertain if several urls share it."""
    by_url = candidates.groupBy(key, "url").agg(F.max("confidence").alias("confidence"))
    top = by_url.groupBy(key).agg(F.max("confidence").alias("top"))
    leads = by_url.join(top, key).where("confidence = top").groupBy(key).agg(F.count("*").alias("n"), F.min("url").alias("url"), F.max("confidence").alias("confidence"))
    return leads.select(key, F.when(F.col("n") == 1, F.col("url")).alias("url"), "confidence", F.when(F.col("n") == 1, "FOUND").otherwise("UNCERTAIN").alias("outcome"))


def listing(rows: DataFrame, journal: str, start: int, end: int) -> DataFrame:
    """reason, n: how many rows of a listing (doc_id, title, journal, year) are kept and why the others are not, in one pass."""
    reason = F.when(F.col("journal") != journal, "other journal").when(F.col("year") < start, "before the first year").when(F.col("year") > end, "after the last year").when(F.trim("title") == "", "no title").otherwise("kept")
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.count_distinct(F.lower("title")).alias("titles"))


def claim(before: DataFrame, after: DataFrame, fits: Column) -> DataFrame:
    """owner, task, outcome: the one task (owner, task) that is there after and was not before and fits; none and several are outcomes."""
    new = after.join(before.select("owner", "task"), ["owner", "task"], "left_anti").where(fits)
    found = new.groupBy("owner").agg(F.count("*").alias("n"), F.min("task").alias("task"))
    out = after.select("owner").distinct().join(found, "owner", "left")
    return out.select("owner", F.when(F.col("n") == 1, F.col("task")).alias("task"), F.when(F.col("n") == 1, "CLAIMED").when(F.col("n") > 1, "AMBIGUOUS").otherwise("NONE").alias("outcome"))


def cube_size(requests: DataFrame, most: int = 50_000) -> DataFrame:
    """request, cells, accepted of each row of `requests` (request, indicators, regions, first, last)."""
    cells = F.size(F.array_distinct("indicators")) * F.greatest(F.lit(1), F.size(F.array_distinct("regions"))) * (F.col("last") - F.col("first") + 1)
    return requests.select("request", cells.cast("long").alias("cells"), ((cells < most) & (F.col("first") <= F.col("last"))).alias("accepted"))


# Fixed value: the members of the named group `provinces`.
PROVINCES = "北京 天津 河北 山西 内蒙古 辽宁 吉林 黑龙江 上海 江苏 浙江 安徽 福建 江西 山东 河南 湖北 湖南 广东 广西 海南 重庆 四川 贵州 云南 西藏 陕西 甘肃 青海 宁夏 新疆".split()


def expand_members(requests: DataFrame, groups: dict[str, list[str]] | None = None) -> DataFrame:
    """The cube requests with every named group among their regions in the place of its members, distinct and in order; blanks are left out."""

    def members_of(region: Column) -> Column:
        out = F.array(F.trim(region))
        for name, members in (groups or {"provinces": PROVINCES}).items():
            out = F.when(F.lower(F.trim(region)) == name, F.array(*map(F.lit, members))).otherwise(out)
        return out

    return requests.withColumn("regions", F.array_distinct(F.filter(F.flatten(F.transform("regions", members_of)), lambda r: F.coalesce(r, F.lit("")) != "")))


def cube_rows(requests: DataFrame) -> DataFrame:
    """request, indicator, region, year: the cells of a cube that was accepted."""
    rows = requests.select("request", F.explode(F.array_distinct("indicators")).alias("indicator"), "regions", "first", "last")
    rows = rows.select("request", "indicator", F.explode(F.array_distinct("regions")).alias("region"), "first", "last")
    return rows.select("request", "indicator", "region", F.explode(F.sequence("first", "last")).alias("year"))


def latest_finished(queues: DataFrame) -> DataFrame:
    """task, state of each task of a queue (task, list, finished, at): its latest finished entry, else its latest."""
    return queues.groupBy("task").agg(F.max_by("list", F.struct("finished", "at", "list")).alias("list"), F.bool_or("finished").alias("finished"))


def whole_table(downloads: DataFrame, share: float = 0.99) -> DataFrame:
    """task, outcome of downloads (task, format, wanted, rows, total)."""
    return downloads.select("task", F.when(F.col("format") != F.col("wanted"), "WRONG_FORMAT").when(F.col("rows") < share * F.col("total"), "INCOMPLETE").otherwise("WHOLE").alias("outcome"))
