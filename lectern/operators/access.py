"""What observed facts of a page say: access to a full text, challenges, identity, and rows of result pages. Columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lectern.functions import text as t
from lectern.operators import nested
from lectern.operators.markup import JOURNAL_PRODUCTS, JOURNAL_RESOURCE

# Words on a page that say how its text may be read, and pages that stand in for a file.
OPEN = ("open access", "creative commons", "open archive", "funded by")
INSTITUTION = ("access provided by", "institutional access", "signed in via", "you have full access")
# Fixed value: the class of journals in one catalogue.
JOURNAL_CLASS = "YSTT4HG0"
CHALLENGE_TITLES = ("just a moment...", "access denied", "attention required!", "security check")


def has_any(text: Column, words) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.coalesce(F.lower(text).contains(w), F.lit(False))
    return found


def pdf_control(anchors: DataFrame, hosts: Column) -> DataFrame:
    """page_id, control: the first link (page_id, position, href, host, path, label, enabled) to a PDF of its page's own hosts whose label
    says to view or download it; pages without one are left out. hosts: the hosts of the source, an array column of anchors."""
    label = F.lower(F.coalesce("label", F.lit("")))
    fits = F.col("enabled") & F.array_contains(hosts, F.col("host")) & F.lower("path").rlike("pdf") & label.contains("pdf") & label.rlike("view|download|查看|下载")
    return anchors.where(fits).groupBy("page_id").agg(F.min_by("href", "position").alias("control"))


def access(pages: DataFrame, style: str) -> DataFrame:
    """page_id, access of pages (page_id, control, body, denied, blocked, direct), by the way of one kind of source.

    `plain`: without a control the metadata alone; open by its words, else by the institution. `public`: the same, but public without a word of
    an institution. `stated`: without a control unknown, unless the page states a denial; then open, purchased, institutional, subscribed or public,
    in this order. `signals`: without a control the metadata alone; a positive signal beside a block is unknown, a block alone metadata, no signal unknown, else
    institutional or public. `snapshot`: as `signals`, but no signal is metadata alone."""
    none, body = F.col("control").isNull(), F.col("body")
    institution = has_any(body, INSTITUTION)
    if style == "plain":
        return pages.select("page_id", F.when(none, "METADATA_ONLY").when(has_any(body, OPEN), "OPEN_ACCESS").otherwise("INSTITUTIONAL_AUTHENTICATED").alias("access"))
    if style == "public":
        state = F.when(none, "METADATA_ONLY").when(has_any(body, OPEN[:2]), "OPEN_ACCESS").when(institution, "INSTITUTIONAL_AUTHENTICATED").otherwise("PUBLIC_FULL_TEXT")
        return pages.select("page_id", state.alias("access"))
    if style == "stated":
        state = F.when(none & F.col("denied"), "METADATA_ONLY").when(none, "UNKNOWN").when(has_any(body, OPEN[:2]), "OPEN_ACCESS")
        state = state.when(has_any(body, ("purchased",)) | institution | has_any(body, ("subscription",)), "INSTITUTIONAL_AUTHENTICATED").otherwise("PUBLIC_FULL_TEXT")
        return pages.select("page_id", state.alias("access"))
    if style not in ("signals", "snapshot"):
        raise ValueError(f"no style {style}")
    positive = has_any(body, OPEN[:1]) | institution | F.col("direct")
    silent = "UNKNOWN" if style == "signals" else "METADATA_ONLY"
    state = F.when(none, "METADATA_ONLY").when(positive & F.col("blocked"), "UNKNOWN").when(F.col("blocked"), "METADATA_ONLY").when(~positive, silent).when(institution, "INSTITUTIONAL_AUTHENTICATED").otherwise("PUBLIC_FULL_TEXT")
    return pages.select("page_id", state.alias("access"))


def visibility(nodes: DataFrame) -> DataFrame:
    """The nodes (reported, display, visibility, opacity, width, height, aria_hidden, x, y, frame_visible, frame_width, frame_height) with their
    `visible`: false if anything hides them or they lie outside of the view, null if it cannot be told, else true."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    hidden = (F.col("reported") == F.lit(False)) | (low("aria_hidden") == "true") | (low("display") == "none") | low("visibility").isin("hidden", "collapse") | (F.col("width") == 0) | (F.col("height") == 0)
    opaque = F.col("opacity").try_cast("double")
    render = F.when(F.coalesce(hidden, F.lit(False)) | F.coalesce(opaque <= 0, F.lit(False)), False).when(F.col("opacity").isNotNull() & opaque.isNull(), None).when(F.col("reported").isNull(), None).otherwise(True)
    inside = (F.col("x") < F.col("frame_width")) & (F.col("y") < F.col("frame_height")) & (F.col("x") + F.col("width") > 0) & (F.col("y") + F.col("height") > 0)
    view = F.when(~F.col("frame_visible"), False).when(F.col("frame_visible").isNull(), None).when(F.col("x").isNull(), F.when(~F.col("reported"), False)).otherwise(inside)
    return nodes.withColumn("visible", render & view)  # three-valued: false wins over what is not known


def challenge(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """page_id, state of pages (page_id, confirmed, complete, blocking) from their challenge nodes (page_id, visible, overlay)."""
    per = nodes.groupBy("page_id").agg(F.bool_or("visible").alias("seen"), F.bool_or(F.col("visible").isNull()).alias("open"), F.bool_or(F.col("overlay") & F.coalesce("visible", F.lit(True))).alias("covers"))
    out = pages.join(per, "page_id", "left")
    unsure = ~F.col("confirmed") | ~F.col("complete") | F.coalesce("open", F.lit(False))
    state = F.when(F.col("blocking") | F.coalesce("covers", F.lit(False)), "BLOCKING").when(F.coalesce("seen", F.lit(False)), "VISIBLE").when(unsure, "UNCERTAIN").when(F.col("open").isNotNull(), "DORMANT").otherwise("NONE")
    return out.select("page_id", state.alias("state"))


def static_challenge(pages: DataFrame) -> DataFrame:
    """page_id, state of pages (page_id, text, overlay, identity, on_screen, business, runtime): a state found at run time outranks the page's text."""
    state = F.when(~F.col("text"), "NONE").when(F.col("overlay"), "BLOCKING").when(F.col("identity"), "VISIBLE").when(F.col("on_screen") & ~F.col("business"), "VISIBLE").otherwise("DORMANT")
    return pages.select("page_id", F.coalesce("runtime", state).alias("state"))


def page_lock(pages: DataFrame, wanted: DataFrame, domains: list[str]) -> DataFrame:
    """key, page_id, outcome: the one open page (page_id, host, url, title, active) of an official host with the wanted (key, url, title); of
    several the active one, if it is one."""
    official = F.lit(False)
    for d in domains:
        official = official | (F.col("host") == d) | F.col("host").endswith("." + d)
    p = pages.where(official).select("page_id", t.sanitize_url(F.col("url")).alias("url"), t.fold(F.col("title")).alias("title"), "active")
    w = wanted.select("key", t.sanitize_url(F.col("url")).alias("url"), t.fold(F.col("title")).alias("title"))
    per = w.join(p, ["url", "title"]).groupBy("key").agg(F.count("*").alias("n"), F.min("page_id").alias("only"), F.count_if("active").alias("actives"), F.min(F.when(F.col("active"), F.col("page_id"))).alias("live"))
    out = wanted.select("key").join(per, "key", "left")
    page = F.when(F.col("n") == 1, F.col("only")).when(F.col("actives") == 1, F.col("live"))
    return out.select("key", page.alias("page_id"), F.when(page.isNotNull(), "LOCKED").when(F.col("n") > 1, "AMBIGUOUS").otherwise("ABSENT").alias("outcome"))


def identity(files: DataFrame) -> DataFrame:
    """item, verdict of files (item, doi, title, first_dois: array, context_dois: array, first_page, citation): VERIFIED by the DOI on the first page,
    by one of the few pages after it in a labelled context, by the title or by the citation; CONFLICT if only other DOIs stand there; else UNVERIFIED."""
    doi, title = t.normalize_doi(F.col("doi")), t.fold(F.col("title"))
    named = F.transform(F.coalesce("first_dois", F.array().cast("array<string>")), t.normalize_doi)
    context = F.transform(F.coalesce("context_dois", F.array().cast("array<string>")), t.normalize_doi)
    page = t.fold(F.col("first_page"))
    compact = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    by_title = (title != "") & (page.contains(title) | compact(page).contains(compact(title)))
    by_doi = F.coalesce(F.array_contains(named, doi) | F.array_contains(context, doi), F.lit(False))
    conflict = doi.isNotNull() & ((F.size(named) > 0) | (F.size(context) > 0))
    return files.select("item", F.when(by_doi, "VERIFIED").when(conflict, "CONFLICT").when(by_title | F.coalesce("citation", F.lit(False)), "VERIFIED").otherwise("UNVERIFIED").alias("verdict"))


def first_page_citation(text: Column, surname: Column, volume: Column, page: Column) -> Column:
    """Whether a first page cites itself: the surname as a word, and the volume with the first page after at most 16 characters that are no letters."""
    quoted = lambda c: F.regexp_replace(c, r"([^0-9A-Za-z])", r"\\$1")
    name = F.regexp_like(F.lower(text), F.concat(F.lit(r"(?<![\p{L}\p{N}])"), quoted(F.lower(surname)), F.lit(r"(?![\p{L}\p{N}])")))
    return name & F.regexp_like(text, F.concat(F.lit(r"(?<!\d)"), quoted(volume), F.lit(r"(?!\d)[^\p{L}]{0,16}(?<!\d)"), quoted(page), F.lit(r"(?!\d)")))


def result_rows(anchors: DataFrame, path: str, hosts: list[str], most: int = 50) -> DataFrame:
    """page_id, rank, id, label of the links (page_id, position, host, path, label, listed) inside the list of results whose path names a
    work: the first of each work, `most` a page (a page shows no more)."""
    rows = anchors.where(F.col("listed") & F.col("host").isin(*hosts)).withColumn("id", F.nullif(F.regexp_extract("path", path, 1), F.lit(""))).where("id IS NOT NULL")
    first = rows.groupBy("page_id", "id").agg(F.min(F.struct("position", "label")).alias("f")).select("page_id", "id", "f.position", "f.label")
    order = W.partitionBy("page_id").orderBy("position")
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("page_id", "rank", "id", "label")


def snapshot_rows(snapshots: DataFrame, header: str = "题名", footer: str = "共") -> DataFrame:
    """page_id, position, title, url: links of a page's text snapshot (page_id, text) between its last header line and the footer after it; the
    line after a link has its url."""
    lines = snapshots.select("page_id", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("text", F.trim("text"))
    w = W.partitionBy("page_id").orderBy("line")
    lines = lines.withColumns({"next": F.lead("text").over(w), "head": F.max(F.when(F.col("text").contains(header), F.col("line"))).over(W.partitionBy("page_id"))})
    foot = F.min(F.when((F.col("line") > F.col("head")) & F.col("text").startswith(footer), F.col("line"))).over(W.partitionBy("page_id"))
    lines = lines.withColumn("foot", foot).where((F.col("line") > F.col("head")) & (F.col("foot").isNull() | (F.col("line") < F.col("foot"))))
    title, url = F.regexp_extract("text", r'^- link "(.*)":?$', 1), F.regexp_extract("next", r"^- /url: (\S+)$", 1)
    found = lines.where((title != "") & (url != "")).select("page_id", "line", title.alias("title"), url.alias("url"))
    return found.select("page_id", (F.row_number().over(w) - 1).alias("position"), "title", "url")


def scope(requests: DataFrame, below: str = "") -> DataFrame:
    """request, place, field, value of every condition anywhere in a request's JSON (request, json), at or below a path: an object with a field and a value,
    whatever else it has and in whatever order and case. Fields are upper-case; an empty value and one that is an object or a list is no condition."""
    held = nested.nodes(requests, "request").where(F.col("parent").startswith(below) & (F.col("kind") != "null"))
    first = lambda name: F.min_by("value", F.when(F.lower("name") == name, F.col("place")))
    pairs = held.where(F.lower("name").isin("field", "value")).groupBy("request", "parent").agg(F.min("place").alias("place"), F.upper(F.trim(first("field"))).alias("field"), first("value").alias("value"))
    return pairs.where("field <> '' AND value <> ''").select("request", "place", "field", "value")


def journals_only(requests: DataFrame, scopes: DataFrame) -> DataFrame:
    """request, refused of every request: whether its scope() has anything but journals, or says nothing of what was searched."""
    stated = scopes.where("field = 'SCOPE'").groupBy("request").agg(F.bool_or(F.upper(F.trim("value")) != "JOURNAL").alias("refused"))
    return requests.select("request").distinct().join(stated, "request", "left").select("request", F.coalesce("refused", F.lit(True)).alias("refused"))


def executed(requests: DataFrame) -> DataFrame:
    """request, cross, classes, resources, products, conditions, journals of what a result page says that was searched (request, json), a row for each
    request; journals is null where it says nothing that can be read.

    The query is an object under queryJson or a text of one. journals: codes of databases are the journals' alone, or the one class and
    resource are, and no product is of anything else. conditions: fields and values of its tree, in order."""
    held = nested.nodes(requests, "request")
    codes = lambda *paths: F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_list(F.when(F.col("path").isin(*paths) & F.col("kind").isin("string", "number"), F.transform(F.split("value", ","), lambda x: F.upper(F.trim(x)))))), lambda x: x != "")))
    whole = F.bool_or((F.col("path") == "") & (F.col("kind") == "object")) & ~F.bool_or((F.col("path") == "/queryJson") & (F.col("kind") == "string") & ~F.trim("value").startswith("{"))
    said = held.groupBy("request").agg(
        whole.alias("readable"), codes("/queryJson/kuaKuCode", "/kuakuCode", "/kuaKuCode").alias("cross"), codes("/queryJson/classid", "/classid").alias("classes"), codes("/queryJson/resource", "/resource").alias("resources"), codes("/queryJson/Products").alias("products")
    )
    tree = scope(requests, "/queryJson/qnode").groupBy("request").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "field", "value"))), lambda x: F.concat(x["field"], F.lit("="), x["value"])).alias("conditions"))
    alone = lambda codes, code: (F.size(codes) == 1) & F.array_contains(codes, code)
    journals = (alone("cross", JOURNAL_CLASS) | (alone("classes", JOURNAL_CLASS) & alone("resources", JOURNAL_RESOURCE))) & (F.size(F.array_except("products", F.array(*map(F.lit, JOURNAL_PRODUCTS)))) == 0)
    out = requests.select("request").distinct().join(said, "request", "left").join(tree, "request", "left")
    return out.select("request", "cross", "classes", "resources", "products", F.coalesce("conditions", F.array().cast("array<string>")).alias("conditions"), F.when(F.col("readable"), journals).alias("journals"))


def disguised(head: Column) -> Column:
    """Whether the first bytes of a downloaded file, as text, are a page: by its start or by a title that stands for a challenge."""
    low = F.lower(F.ltrim(head))
    title = F.trim(F.regexp_extract(low, r"(?s)<title[^>]*>(.*?)</title>", 1))
    return F.when(title.isin(*CHALLENGE_TITLES), "CHALLENGE").when(low.rlike(r"^(<!doctype html|<html|<head|<\?xml[^>]*>\s*<html)"), "HTML").otherwise("FILE")


# What parts a title from a byline after it, lines that name authors, and the least that a title without its byline has to have.
BYLINE = r"^(.+?)\s*[-\x{2010}\x{2011}\x{2012}\x{2013}\x{2014}\x{2015}:\x{FF1A}]\s*([^\r\n]+?)\s*$"
AUTHOR_LINE = r"(?im)^\s*(?:作\s*者|authors?)\s*[:\x{FF1A}]\s*([^\r\n]+)"
LEAST_TITLE = 12


def title_in_text(title: Column, text: Column, authors: Column) -> Column:
    """Whether an extracted text has a claimed title: normalised, or without any spaces; or its core, where what follows a dash or colon is one of the `authors`
    and the text names that author on a line of authors. Null where title or text says nothing. A DOI never stands in for it."""
    close = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    fold = lambda x: F.coalesce(t.normalize_title(x), F.lit(""))
    want, have = fold(title), fold(text)
    core, byline = fold(F.regexp_extract(title, BYLINE, 1)), close(fold(F.regexp_extract(title, BYLINE, 2)))
    lines = F.transform(F.regexp_extract_all(text, F.lit(AUTHOR_LINE), F.lit(1)), lambda x: close(fold(x)))
    named = (byline != "") & F.exists(F.coalesce(authors, F.array().cast("array<string>")), lambda a: close(fold(a)) == byline) & F.exists(lines, lambda line: line.contains(byline))
    held = lambda x: have.contains(x) | close(have).contains(close(x))
    return F.when((want == "") | (have == ""), None).otherwise(held(want) | (named & (F.length(close(core)) >= LEAST_TITLE) & held(core)))
