"""Screening scores, query plans, caps, readiness and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lectern.functions import text as t

# Fixed value: terms that name a mechanism or method.
MECHANISM_TERMS = ("audit", "auditor", "审计", "earnings management", "盈余管理", "accrual", "应计")


def screen(records: DataFrame, terms: list[str], exact_titles: list[str], as_of: int, start: int | None = None, end: int | None = None, mechanisms=MECHANISM_TERMS) -> DataFrame:
    """doc_id, score, decision of each record (doc_id, title, abstract, year, status, accessible, doi).

    as_of is the current year: the clock is never read. Terms are found in the folded title and abstract; a year to come counts
    as recent; KEEP from 60 or if a title is exact, MAYBE from 30, else REJECT."""
    hay = t.fold(F.concat_ws(" ", "title", "abstract"))
    matched = sum((hay.contains(x).cast("int") for x in terms), F.lit(0))
    exact = t.fold(F.col("title")).isin(*exact_titles) if exact_titles else F.lit(False)
    age = F.lit(as_of) - F.col("year")
    score = F.when(exact, 50).when(matched > 0, F.least(F.lit(40), 15 + 10 * matched)).otherwise(0)
    score += F.when(F.col("status") == "PeerReviewedJournalArticle", 20).when(F.col("status") == "OnlineFirst", 15).otherwise(0)
    score += F.when(age <= 5, 15).when(age <= 10, 8).otherwise(0)
    score += F.when(F.lit(start is not None) & (F.col("year") < F.lit(start or 0)), -20).otherwise(0) + F.when(F.lit(end is not None) & (F.col("year") > F.lit(end or 0)), -20).otherwise(0)
    mechanism = F.lit(False)
    for m in mechanisms:
        mechanism = mechanism | hay.contains(m)
    score += F.when(mechanism, 10).otherwise(0) + F.when(F.col("accessible"), 10).otherwise(0) + F.when(t.normalize_doi(F.col("doi")).isNotNull(), 5).otherwise(0)
    score = F.greatest(F.lit(0), F.least(F.lit(100), score))
    out = records.select("doc_id", score.alias("score"), exact.alias("exact"))
    return out.select("doc_id", "score", F.when(F.col("exact") | (F.col("score") >= 60), "KEEP").when(F.col("score") >= 30, "MAYBE").otherwise("REJECT").alias("decision"))


# The kinds of planned queries, in their order.
QUERY_KINDS = ("journal", "doi", "title", "author", "english", "chinese", "question")


def query_plan(requests: DataFrame, cap: int = 8) -> DataFrame:
    """request, step, kind, query: the queries of each request (request, journals, dois, titles, authors, english, chinese: arrays; question), distinct whatever
    their case, the first `cap` (1 to 20).

    Named journals are searched by source, and then nothing else is: their words are left to screening. Otherwise DOIs, exact titles, authors, the first
    English word with each other one (or alone), the first Chinese one likewise, and the question where nothing else was given."""
    if not 1 <= cap <= 20:
        raise ValueError("a plan has 1 to 20 queries")
    known = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    of = lambda kind, items, query: F.transform(items, lambda x: F.struct(F.lit(kind).alias("kind"), query(x).alias("query")))
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))

    def pairs(kind: int, column: str, one, two) -> Column:
        words = known(column)
        first = F.try_element_at(words, F.lit(1))
        return F.when(F.size(words) == 1, of(kind, words, one)).otherwise(of(kind, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda x: two(first, x)))

    journals = of(0, known("journals"), lambda x: F.concat(F.lit("source:"), quoted(x)))
    others = F.concat(
        of(1, F.filter(F.transform(known("dois"), t.normalize_doi), lambda x: x.isNotNull()), lambda x: x), of(2, known("titles"), quoted), of(3, known("authors"), lambda x: F.concat(F.lit("author:"), quoted(x))),
        pairs(4, "english", quoted, lambda a, b: F.concat(quoted(a), F.lit(" AND "), quoted(b))), pairs(5, "chinese", lambda x: x, lambda a, b: F.concat_ws(" ", a, b)),
    )
    question = F.array(F.struct(F.lit(6).alias("kind"), F.trim("question").alias("query")))
    items = F.when(F.size(journals) > 0, journals).when(F.size(others) > 0, others).otherwise(question)
    rows = requests.select("request", F.posexplode(items).alias("position", "i")).select("request", "position", "i.kind", "i.query").where("trim(query) <> ''")
    rows = rows.withColumn("first", F.row_number().over(W.partitionBy("request", F.lower(F.trim("query"))).orderBy("position"))).where("first = 1")
    rows = rows.withColumn("step", F.row_number().over(W.partitionBy("request").orderBy("position"))).where(F.col("step") <= cap)
    return rows.select("request", "step", F.element_at(F.array(*map(F.lit, QUERY_KINDS)), F.col("kind") + 1).alias("kind"), "query")


def split_caps(sources: DataFrame, total: Column) -> DataFrame:
    """request, source, cap: a request's total over its sources (request, source, position from 0, n): equal parts, the first ones one more."""
    part = F.floor(total / F.col("n")) + (F.col("position") < total % F.col("n")).cast("int")
    return sources.select("request", "source", part.cast("long").alias("cap")).where((F.col("cap") > 0) | (total == 0))


def batches(totals: DataFrame, most: int = 25, candidates: int = 50) -> DataFrame:
    """request, batch, quota_group, downloads, candidates, problem of the batches of each request (request, downloads, candidates, retries, quotas: array of struct
    (group, quota) or null).

    Without quotas downloads are dealt evenly over as few batches of `most` (25 at most) as hold them, the first ones one more; with quotas each group
    fills batches of its own in turn. Candidates are dealt evenly over all batches, with batches without downloads added where these would
    hold more than `candidates` each. A request that breaks a rule has one row, with the first rule that it breaks."""
    if not 1 <= most <= 25 or candidates < 1:
        raise ValueError("a batch takes 1 to 25 downloads and at least one candidate")
    n, quotas = F.col("downloads"), F.coalesce("quotas", F.array().cast("array<struct<group:string,quota:bigint>>"))
    part = lambda group, count: F.struct(group.cast("string").alias("group"), count.cast("long").alias("n"))
    series = lambda k: F.when(k > 0, F.sequence(F.lit(0).cast("long"), k.cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))
    count = F.ceil(n / most)
    even = F.transform(series(count), lambda i: part(F.lit(None), F.floor(n / count) + (i < n % count).cast("int")))
    filled = F.flatten(F.transform(quotas, lambda q: F.transform(series(F.ceil(q["quota"] / most)), lambda i: part(q["group"], F.least(F.lit(most), q["quota"] - i * most)))))
    dealt = F.when(F.size(quotas) > 0, filled).when(n > 0, even).otherwise(F.array(part(F.lit(None), F.lit(0))))
    needed = F.greatest(F.lit(1), F.ceil(F.col("candidates") / candidates))
    whole = F.concat(dealt, F.transform(series(needed - F.size(dealt)), lambda _: part(F.lit(None), F.lit(0))))
    sum_of = F.aggregate(quotas, F.lit(0).cast("long"), lambda s, q: s + q["quota"])
    problem = (
        F.when((n < 0) | (F.col("candidates") < 0), "NEGATIVE_TOTAL").when(n > F.col("candidates"), "MORE_DOWNLOADS_THAN_CANDIDATES").when(~F.coalesce("retries", F.lit(1)).between(0, 3), "RETRIES")
        .when(F.exists(quotas, lambda q: (F.trim(F.coalesce(q["group"], F.lit(""))) == "") | (q["quota"] < 0)), "QUOTA").when((F.size(quotas) > 0) & (sum_of != n), "QUOTA_TOTAL")
    )
    checked = totals.withColumn("problem", problem)
    planned = checked.where("problem IS NULL").select("request", F.col("candidates").alias("all"), whole.alias("parts"))
    rows = planned.select("request", "all", F.size("parts").alias("k"), F.posexplode("parts").alias("batch", "p"))
    mine = F.floor(F.col("all") / F.col("k")) + (F.col("batch") < F.col("all") % F.col("k")).cast("int")
    rows = rows.select("request", "batch", F.col("p.group").alias("quota_group"), F.col("p.n").alias("downloads"), mine.cast("long").alias("candidates"), F.lit(None).cast("string").alias("problem"))
    none = F.lit(None)
    return rows.unionByName(checked.where("problem IS NOT NULL").select("request", none.cast("int").alias("batch"), none.cast("string").alias("quota_group"), none.cast("long").alias("downloads"), none.cast("long").alias("candidates"), "problem"))


# Words in a reason that say what a person has to do, the first kind that fits.
ACTIONS = (("CAPTCHA", ("captcha", "slider", "滑块", "验证码")), ("MFA", ("2fa", "mfa", "otp", "短信")), ("SSO", ("sso", "carsi", "cas", "统一身份")), ("SECURITY_CHALLENGE", ("security challenge", "security verification", "安全验证")), ("LOGIN", ("login", "sign in", "登录")))
EVIDENCE = ("authorized", "validated", "identified", "current", "unattended", "hashed")


def readiness(sources: DataFrame) -> DataFrame:
    """source, state, action, reason of each source by its trial run (source, status, note, downloads and the flags of EVIDENCE).

    A run that asks for a sign-in needs a person's action, told by words of its note in a fixed order. One that needs a person to download, that
    did not succeed or has anything but one download is not ready; so is one for which a flag is missing. All six flags make it ready."""
    note = F.lower(F.coalesce("note", F.lit("")))
    action = F.lit(None).cast("string")
    for kind, words in reversed(ACTIONS):
        action = F.when(F.exists(F.array(*map(F.lit, words)), lambda w: note.contains(w)), kind).otherwise(action)
    asks = F.col("status") == "ACTION_REQUIRED_USER_LOGIN"
    missing = F.filter(F.array(*[F.when(~F.coalesce(F.col(f), F.lit(False)), f) for f in EVIDENCE]), lambda x: x.isNotNull())
    reason = (
        F.when(asks, F.col("note")).when(F.col("status") == "ACTION_REQUIRED_USER_DOWNLOAD", "UNATTENDED_DOWNLOAD_UNSUPPORTED").when((F.col("status") != "SUCCESS") | (F.col("downloads") != 1), F.concat(F.lit("WORKFLOW_STATUS_"), "status"))
        .when(F.size(missing) > 0, F.concat(F.lit("MISSING "), F.array_join(missing, ",")))
    )
    state = F.when(asks, "ACTION_REQUIRED").when(reason.isNull(), "READY").otherwise("NOT_READY")
    return sources.select("source", state.alias("state"), F.when(asks, F.coalesce(action, F.lit("MANUAL_AUTHENTICATION"))).alias("action"), reason.alias("reason"))


def wanted_target(record: dict[str, Column], wanted: dict[str, Column]) -> Column:
    """Whether a detail page's record (doi, title, year, authors: array) is what a request names (dois, titles, authors: arrays; first, last: years).

    A DOI and a title have to be among those named, a year inside the bounds. Of several authors one has to be there beside a DOI or title, all of them
    without; an author is told by the whole name or one of its words. A request that names nothing of a work takes any."""
    fold_all = lambda c, f: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), f), lambda x: x.isNotNull() & (x != ""))
    dois, titles, authors = fold_all(wanted["dois"], t.normalize_doi), fold_all(wanted["titles"], t.normalize_title), fold_all(wanted["authors"], t.normalize_title)
    own = fold_all(record["authors"], t.normalize_title)
    named = (F.size(dois) > 0) | (F.size(titles) > 0)
    among = lambda values, x: (F.size(values) == 0) | F.coalesce(F.array_contains(values, x), F.lit(False))
    year = F.when(F.trim(record["year"]).rlike("^[0-9]+$"), F.trim(record["year"]).cast("int"))
    inside = (wanted["first"].isNull() & wanted["last"].isNull()) | F.coalesce((year >= F.coalesce(wanted["first"], F.lit(0))) & (year <= F.coalesce(wanted["last"], F.lit(99_999))), F.lit(False))
    there = lambda a: F.exists(own, lambda o: (o == a) | F.array_contains(F.split(o, " "), a))
    by_author = F.when(F.size(authors) == 0, True).when(F.size(own) == 0, named).when(named, F.exists(authors, there)).otherwise(F.forall(authors, there))
    return ~(named | (F.size(authors) > 0)) | (among(dois, t.normalize_doi(record["doi"])) & among(titles, t.normalize_title(record["title"])) & inside & by_author)


def route(requests: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """request, task, gate of each row of `requests` (request, text, explicit, candidates, downloads): the explicit type, the first alias
    in the text, or marker words; large requests wait for a human."""
    folded = t.fold(F.col("text"))
    by_alias = F.coalesce(*[F.when(t.contains_word(folded, k), v) for k, v in aliases.items()]) if aliases else F.lit(None).cast("string")
    by_word = F.when(folded.rlike(r"\b(table|data|series)\b"), "DATA").when(folded.rlike(r"\b(paper|article|literature)\b"), "LITERATURE").otherwise("UNKNOWN")
    gate = (F.col("candidates") > 30) | (F.col("downloads") > 10)
    return requests.select("request", F.coalesce("explicit", by_alias, by_word).alias("task"), gate.alias("gate"))
