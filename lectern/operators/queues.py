"""Shared download queues, cubes, listings of tables, arrivals of files, and runs of batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lectern.functions import text as t


def lock_detail(found: DataFrame, details: DataFrame) -> DataFrame:
    """detail, position of the first search row (query, position, doi, title, year) that is a detail's work (detail, query, doi, title, year).

    Where both have a DOI it decides; else equal titles do, of years that do not disagree."""
    f = found.select("query", "position", t.normalize_doi(F.col("doi")).alias("fdoi"), t.normalize_title(F.col("title")).alias("ftitle"), F.col("year").alias("fyear"))
    d = details.select("detail", "query", t.normalize_doi(F.col("doi")).alias("doi"), t.normalize_title(F.col("title")).alias("title"), "year")
    by_doi = d.join(f, (d["query"] == f["query"]) & (F.col("doi") == F.col("fdoi"))).select("detail", "position")
    title = d.join(f, (d["query"] == f["query"]) & (F.col("title") == F.col("ftitle")))
    title = title.where((F.col("doi").isNull() | F.col("fdoi").isNull()) & (F.col("year").isNull() | F.col("fyear").isNull() | (F.col("year") == F.col("fyear")))).select("detail", "position")
    return details.select("detail").join(by_doi.unionByName(title).groupBy("detail").agg(F.min("position").alias("position")), "detail", "left")


def same_record(kind: str, a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether two records (doi, title, id, year, authors, journal) of a source are one, by the rule of its kind.

    `doi_or_title`: if either has a DOI both must be equal, else the titles. `all_agree`: DOI, title and id each, where b has them. `title_first`: the title, then
    year, authors and journal where both have them, then DOI and id where both have them."""
    both = lambda k: a[k].isNotNull() & b[k].isNotNull()
    agree = lambda k: ~both(k) | (a[k] == b[k])
    if kind == "doi_or_title":
        return F.coalesce(F.when(a["doi"].isNotNull() | b["doi"].isNotNull(), a["doi"] == b["doi"]).otherwise(a["title"] == b["title"]), F.lit(False))
    if kind == "all_agree":
        return F.coalesce(F.when(b["doi"].isNotNull(), a["doi"] == b["doi"]).otherwise(True) & F.when(b["title"].isNotNull(), a["title"] == b["title"]).otherwise(True) & F.when(b["id"].isNotNull(), a["id"] == b["id"]).otherwise(True), F.lit(False))
    if kind == "title_first":
        return F.coalesce((a["title"] == b["title"]) & agree("year") & agree("authors") & agree("journal") & agree("doi") & agree("id"), F.lit(False))
    raise ValueError(f"no kind {kind}")


PARTIAL = r"(?i)\.(crdownload|part|partial|tmp|download)$"


def arrivals(before: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """folder, name, outcome: the file that came into a folder between two listings (folder, name, size, modified, head), told once it is the same in a third.

    New or changed names count, whatever their case; a partial one makes the folder wait, and so does one that still changes; one with the head of
    a PDF has arrived, several are ambiguous, others are rejected."""
    key = lambda df, s: df.select("folder", F.lower("name").alias("key"), F.col("name").alias(f"name{s}"), F.col("size").alias(f"size{s}"), F.col("modified").alias(f"modified{s}"), F.col("head").alias(f"head{s}"))
    both = key(first, 1).join(key(before, 0), ["folder", "key"], "left").join(key(second, 2), ["folder", "key"], "left")
    new = both.where(F.col("size0").isNull() | (F.col("size0") != F.col("size1")) | (F.col("modified0") != F.col("modified1")))
    stable = F.coalesce((F.col("size1") == F.col("size2")) & (F.col("modified1") == F.col("modified2")), F.lit(False))
    pdf = F.col("head1").startswith("%PDF-")
    per = new.groupBy("folder").agg(F.bool_or(F.col("name1").rlike(PARTIAL)).alias("partial"), F.bool_and(stable).alias("stable"), F.count_if(pdf).alias("pdfs"), F.min(F.when(pdf, F.col("name1"))).alias("name"))
    out = first.select("folder").union(before.select("folder")).distinct().join(per, "folder", "left")
    outcome = F.when(F.col("pdfs").isNull(), "TIMED_OUT").when(F.col("partial") | ~F.col("stable"), "WAITING").when(F.col("pdfs") == 1, "ARRIVED").when(F.col("pdfs") > 1, "AMBIGUOUS").otherwise("REJECTED")
    return out.select("folder", F.when(outcome == "ARRIVED", F.col("name")).alias("name"), outcome.alias("outcome"))


def queue_entries(lists: dict[str, DataFrame]) -> DataFrame:
    """task, list, finished, at of the latest entry of each task over several lists (task, at, title), those of finished lists first.

    Names of finished lists begin with "finished". Signed urls are not read."""
    every = None
    for name, df in lists.items():
        one = df.select("task", F.lit(name).alias("list"), F.lit(name.startswith("finished")).alias("finished"), "at", "title")
        every = one if every is None else every.unionByName(one)
    best = every.groupBy("task").agg(F.max_by(F.struct("list", "finished", "at", "title"), F.struct("finished", "at", "list")).alias("b"))
    return best.select("task", "b.*")


def claim_by_name(tasks: DataFrame, names: DataFrame) -> DataFrame:
    """name, task, outcome of each name in the queue (task, name): one row, none, or an error."""
    per = tasks.groupBy("name").agg(F.count("*").alias("n"), F.min("task").alias("task"))
    out = names.select("name").join(per, "name", "left")
    return out.select("name", F.when(F.col("n") == 1, F.col("task")).alias("task"), F.when(F.col("n") == 1, "CLAIMED").when(F.col("n") > 1, "ERROR").otherwise("NONE").alias("outcome"))


def check_task(wanted: DataFrame, tasks: DataFrame) -> DataFrame:
    """task, outcome of each wanted task (task, table): not there, of another table, unfinished, or ready (tasks: task, table, finished)."""
    q = tasks.select("task", F.col("table").alias("its"), "finished")
    outcome = F.when(F.col("its").isNull(), "MISSING").when(F.col("its") != F.col("table"), "WRONG_TABLE").when(~F.col("finished"), "UNFINISHED").otherwise("READY")
    return wanted.join(q, "task", "left").select("task", outcome.alias("outcome"))


def rights(cubes: DataFrame, granted: DataFrame) -> DataFrame:
    """cube, right of each cube: DOWNLOAD, VISIT or NONE, from the flags that are granted (cube, visit, download)."""
    out = cubes.select("cube").join(granted, "cube", "left")
    return out.select("cube", F.when(F.coalesce("download", F.lit(False)), "DOWNLOAD").when(F.coalesce("visit", F.lit(False)), "VISIT").otherwise("NONE").alias("right"))


def check_requests(requests: DataFrame, databases: list[str], formats: list[str]) -> DataFrame:
    """request, problem of each data request (request, database, table, stocks: array, fields: array, format): the first rule that it breaks, else null.

    Databases and formats are closed lists; whole tables only, so no stocks and no fields."""
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    problem = F.when(~F.coalesce(F.col("database").isin(*databases), F.lit(False)), "UNKNOWN_DATABASE").when(F.coalesce(F.trim("table"), F.lit("")) == "", "NO_TABLE").when(~F.coalesce(F.col("format").isin(*formats), F.lit(False)), "UNKNOWN_FORMAT")
    return requests.select("request", problem.when(some("stocks") | some("fields"), "NOT_A_WHOLE_TABLE").alias("problem"))


def confirm_summary(summaries: DataFrame, parts: list[str]) -> DataFrame:
    """request, missing of each summary (request, text): the first of the required parts that does not stand in it after those before, else null."""
    missing, at = F.lit(None).cast("string"), F.lit(1)
    for p in parts:
        found = F.call_function("locate", F.lit(p), F.col("text"), at)
        missing = F.coalesce(missing, F.when(F.coalesce(found, F.lit(0)) == 0, F.lit(p)))
        at = F.when(found > 0, found + len(p)).otherwise(at)
    return summaries.select("request", missing.alias("missing"))


def header_counts(text: Column) -> Column:
    """struct(selected, estimate, total) of the numbers in the header of a cube: 已选择 N, 预估数据 N 行, 总记录数 N; a missing one is null."""
    number = lambda p: F.replace(F.nullif(F.regexp_extract(text, p, 1), F.lit("")), F.lit(","), F.lit("")).cast("long")
    return F.struct(number(r"已选择\s*[:：]?\s*([\d,]+)").alias("selected"), number(r"预估数据\s*[:：]?\s*([\d,]+)\s*行").alias("estimate"), number(r"总记录数\s*[:：]?\s*([\d,]+)").alias("total"))


def long_format(wide: DataFrame, years: list[int]) -> DataFrame:
    """indicator, region, year, value of a wide table (indicator, region and a column for each year, y2010...); empty cells are left out."""
    return wide.unpivot(["indicator", "region"], [f"y{y}" for y in years], "name", "value").where("value IS NOT NULL").select("indicator", "region", F.substring("name", 2, 4).cast("int").alias("year"), "value")


def year_range(text: Column) -> Column:
    """The years of "2010-2023" or "2010年-2023年", an empty array if they are not in order or are none."""
    first, last = (F.try_element_at(F.regexp_extract_all(text, F.lit(r"(\d{4})"), F.lit(1)), F.lit(k)).cast("int") for k in (1, 2))
    return F.when(first <= F.coalesce(last, first), F.sequence(first, F.coalesce(last, first))).otherwise(F.array().cast("array<int>"))


def subscriptions(text: Column) -> Column:
    """Map of codes to days of a list of lines like "- CODE ... 2026-12-31"; the first of a code counts."""
    codes, days = (F.regexp_extract_all(text, F.lit(r"(?m)^-\s*([A-Z][A-Z0-9_]*)\b.*?(\d{4}-\d{2}-\d{2})"), F.lit(k)) for k in (1, 2))
    first = F.filter(F.transform(codes, lambda c, i: F.struct(c.alias("k"), i.alias("i"))), lambda x: F.array_position(codes, x["k"]) == x["i"] + 1)
    return F.map_from_entries(F.transform(first, lambda x: F.struct(x["k"], F.get(days, x["i"]))))


def permitted(text: Column) -> Column:
    """The names in a box "N databases: a<tab>b<newline>c", null if there are not as many as its header says."""
    count = F.regexp_extract(text, r"^\s*(\d+)", 1).try_cast("int")
    names = F.filter(F.transform(F.split(F.regexp_replace(text, r"^[^\n]*\n?", ""), r"[\t\n]+"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(names) == count, names)


def table_rows(pages: DataFrame) -> DataFrame:
    """page_id, row, cells of the task rows of a page (page_id, html): rows of class tableShow, their cells without tags."""
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'(?is)<tr\b[^>]*class="[^"]*\btableShow\b[^"]*"[^>]*>(.*?)</tr>'), F.lit(1))).alias("row", "tr"))
    cells = F.transform(F.regexp_extract_all("tr", F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, "<[^>]*>", "")))
    return rows.select("page_id", "row", cells.alias("cells"))


def pick_table(hits: DataFrame, wanted: DataFrame) -> DataFrame:
    """request, href, outcome: the one link (request, code, database, href) of the wanted code in a permitted database (request, code, databases: array)."""
    w = wanted.select("request", F.col("code").alias("want"), "databases")
    fit = hits.join(w, "request").where((F.col("code") == F.col("want")) & F.array_contains("databases", F.col("database")))
    per = fit.groupBy("request").agg(F.count_distinct("href").alias("n"), F.min("href").alias("href"))
    out = wanted.select("request").join(per, "request", "left")
    return out.select("request", F.when(F.col("n") == 1, F.col("href")).alias("href"), F.when(F.col("n") == 1, "PICKED").when(F.col("n") > 1, "AMBIGUOUS").otherwise("NONE").alias("outcome"))


def check_queue(items: DataFrame, most: int = 25) -> DataFrame:
    """batch, problem of each batch of items (batch, item, title, doi, extra): the first rule that is broken, else null.

    At most `most` items; each of a title or a DOI but not both; no work and no item twice; no fields that are not known."""
    one = F.coalesce(F.trim("title"), F.lit("")) != ""
    two = F.coalesce(F.trim("doi"), F.lit("")) != ""
    key = F.coalesce(t.normalize_doi(F.col("doi")), t.normalize_title(F.col("title")))
    per = items.groupBy("batch").agg(F.count("*").alias("n"), F.bool_or(one == two).alias("odd"), F.count_distinct(key).alias("keys"), F.count(key).alias("keyed"), F.count_distinct("item").alias("ids"), F.count("item").alias("named"), F.bool_or(F.coalesce("extra", F.lit("")) != "").alias("extra"))
    problem = F.when(F.col("n") > most, "TOO_MANY").when(F.col("extra"), "UNKNOWN_FIELD").when(F.col("odd"), "TITLE_XOR_DOI").when(F.col("keys") < F.col("keyed"), "SAME_WORK").when(F.col("ids") < F.col("named"), "SAME_ITEM")
    return per.select("batch", problem.alias("problem"))


def accounting(batches: DataFrame, outcomes: DataFrame, retries: int = 3) -> DataFrame:
    """batch, done, attempts, verdict: whether a run kept to its plan (batch, budget) by its outcomes (batch, attempt, ok, retryable, count).

    What is committed never exceeds the budget; only an error that allows it is tried again, `retries` times at most."""
    w = W.partitionBy("batch").orderBy("attempt")
    o = outcomes.withColumn("after", F.lag(F.when(F.col("ok"), "done").when(F.col("retryable"), "again").otherwise("stop")).over(w))
    per = o.groupBy("batch").agg(F.sum(F.when(F.col("ok"), F.col("count")).otherwise(0)).alias("done"), F.count("*").alias("attempts"), F.bool_or(F.coalesce(F.col("after") != "again", F.lit(False))).alias("odd"))
    out = batches.join(per, "batch", "left").withColumns({"done": F.coalesce("done", F.lit(0)), "attempts": F.coalesce("attempts", F.lit(0))})
    verdict = F.when(F.col("done") > F.col("budget"), "OVER_BUDGET").when(F.coalesce("odd", F.lit(False)), "RETRIED_WRONGLY").when(F.col("attempts") > retries + 1, "TOO_MANY_RETRIES").when(F.col("done") > 0, "DONE").otherwise("NOTHING")
    return out.select("batch", "done", "attempts", verdict.alias("verdict"))


def acquire(records: DataFrame) -> DataFrame:
    """The records (doc_id, decision, duplicate, identity) that are worth fetching: kept, no duplicates, of confirmed identity."""
    return records.where((F.col("decision") == "KEEP") & ~F.col("duplicate") & (F.col("identity") == "VERIFIED")).select("doc_id")


def preflight(sources: DataFrame, cap: int) -> DataFrame:
    """One row: ready, not_ready, action, cleared, formal of sources (source, position, state, candidates): cleared if all are ready; `formal` are
    candidates of ready sources in the order of the plan, up to the cap."""
    w = W.orderBy("position").rowsBetween(W.unboundedPreceding, -1)  # a plan has some sources
    before = F.coalesce(F.sum(F.when(F.col("state") == "READY", F.col("candidates")).otherwise(0)).over(w), F.lit(0))
    own = F.when(F.col("state") == "READY", F.greatest(F.lit(0), F.least(F.col("candidates"), F.lit(cap) - before))).otherwise(0)
    return sources.withColumn("own", own).agg(
        F.count_if(F.col("state") == "READY").alias("ready"), F.count_if(F.col("state") == "NOT_READY").alias("not_ready"), F.count_if(F.col("state") == "ACTION_REQUIRED").alias("action"), F.bool_and(F.col("state") == "READY").alias("cleared"), F.sum("own").cast("long").alias("formal"),
    )


def doctor(checks: DataFrame) -> DataFrame:
    """host, verdict from checks (host, position, kind, blocking, ok): the first blocking check that fails tells the grade by its kind, else whether any fails."""
    failed = checks.where("NOT ok")
    per = failed.groupBy("host").agg(F.min_by("kind", F.when(F.col("blocking"), F.col("position"))).alias("kind"), F.lit(True).alias("some"))
    out = checks.select("host").distinct().join(per, "host", "left")
    verdict = F.when(F.col("kind") == "ENVIRONMENT", "ENVIRONMENT_FAILED").when(F.col("kind").isNotNull(), "CAPABILITY_MISSING").when(F.col("some"), "READY_WITH_WARNINGS").otherwise("READY")
    return out.select("host", verdict.alias("verdict"))


def relocated(expected: DataFrame, found: DataFrame) -> DataFrame:
    """path, kind, outcome of each expected file (path, sha256) against those found (path, sha256) after a move; kind by the first part of the path."""
    f = found.select("path", F.col("sha256").alias("now"))
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in {"library": "LIBRARY", "index": "DERIVED", "cache": "DERIVED", "config": "CONFIG"}.items() for x in kv]), F.lower(F.substring_index(F.regexp_replace("path", r"\\", "/"), "/", 1)))
    return expected.join(f, "path", "left").select("path", F.coalesce(kind, F.lit("OTHER")).alias("kind"), F.when(F.col("now").isNull(), "MISSING").when(F.col("now") == F.col("sha256"), "SAME").otherwise("CHANGED").alias("outcome"))


def recovery(preimages: DataFrame, current: DataFrame) -> DataFrame:
    """doc_id, action of each work whose topics were changed (preimages: doc_id, before, after; current: doc_id, topics): restore where the present is what the change
    left, nothing where it is what was before, else refuse, for somebody has changed it since."""
    both = preimages.join(current, "doc_id", "left")
    return both.select("doc_id", F.when(F.col("topics") == F.col("before"), "NOTHING").when(F.col("topics") == F.col("after"), "RESTORE").otherwise("REFUSE").alias("action"))


def validate_pack(pack: DataFrame, held: DataFrame) -> DataFrame:
    """place, outcome of each row of a reading pack (place, doc_id, sha256) against the files held now (doc_id, sha256)."""
    h = held.select("doc_id", F.col("sha256").alias("now"))
    return pack.join(h, "doc_id", "left").select("place", F.when(F.col("now").isNull(), "GONE").when(F.col("now") == F.col("sha256"), "VALID").otherwise("CHANGED").alias("outcome"))
