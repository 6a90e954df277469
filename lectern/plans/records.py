"""q28, q30 to q37, q48 to q54: classification, pages, queues, cubes, ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import classify, ledger, markup, pages
from lectern.sources.tables import WORKS_SQL, fold_sql, table, works


def attempts(spark, d):
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("attempt"), F.col("ts").cast("timestamp").alias("ts"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("source"), F.concat(F.lit("id"), F.pmod("user_id", F.lit(7))).alias("identifier"), F.when(F.col("value") > 50, "ok").otherwise("failed").alias("outcome"), (F.col("event_id") % 13 == 0).alias("refetch"),
    )


ATTEMPTS = "attempts AS (SELECT event_id AS attempt, ts, strftime(ts, '%Y-%m-%d') AS day, event_type AS source, 'id' || user_id % 7 AS identifier, CASE WHEN value > 50 THEN 'ok' ELSE 'failed' END AS outcome, event_id % 13 = 0 AS refetch FROM events)"


def q28_usage(spark, d):
    u = ledger.usage(attempts(spark, d))
    return u.select("source", "identifier", "attempts", F.unix_micros("last").alias("last"), "outcome")


Q28 = f"WITH {ATTEMPTS} SELECT source, identifier, count(*) AS attempts, epoch_us(max(ts)) AS last, arg_max(outcome, (ts, outcome)) AS outcome FROM attempts GROUP BY source, identifier"


def q30_latest_state(spark, d):
    log = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("state"), F.col("event_id").alias("position"))
    return ledger.latest_state(log, ["purchase", "error"])


Q30 = "SELECT user_id AS key, arg_max(event_type, event_id) AS state, arg_max(event_type, event_id) IN ('purchase', 'error') AS done FROM events GROUP BY user_id"


def q31_misses(spark, d):
    log = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("outcome"), F.col("event_id").alias("position"))
    return ledger.misses(log, "purchase", 12)


Q31 = """WITH r AS (SELECT user_id AS key, event_id AS p, event_type = 'purchase' AS hit, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM events
), n AS (SELECT key, p, row_number() OVER (PARTITION BY key, island ORDER BY p) AS n FROM r WHERE NOT hit), s AS (SELECT key, min(p) AS stops_at FROM n WHERE n = 12 GROUP BY key)
SELECT DISTINCT user_id AS key, stops_at FROM events LEFT JOIN s ON user_id = key"""


OUTCOMES = ("DOWNLOADED", "NOT_FOUND", "ALREADY_IN_LIBRARY", "FAILED", "NOT_AUTHORIZED", "DOWNLOADED", "NOT_DOWNLOADED", "NOT_FOUND", "OTHER", "DOWNLOAD_FAILED", "DAILY_BUDGET_EXHAUSTED", "NOT_FOUND", "ENV_NOT_READY")


def q31_stops(spark, d):
    """Batches of sixteen outcomes of the event log: which end at a gate or after three misses in a row, and what they did."""
    k = F.col("event_id")
    outcome = F.element_at(F.array(*map(F.lit, OUTCOMES)), (F.pmod(F.col("user_id") * 7 + F.floor("value"), F.lit(len(OUTCOMES))) + 1).cast("int"))
    return ledger.stops(table(spark, d, "events").select(F.floor(k / 16).alias("batch"), k.alias("position"), outcome.alias("outcome")))


Q31S = f"""WITH e AS (SELECT event_id // 16 AS batch, event_id AS p, {list(OUTCOMES)!r}[((user_id * 7 + floor(value)::BIGINT) % {len(OUTCOMES)} + {len(OUTCOMES)}) % {len(OUTCOMES)} + 1] AS o FROM events
), b AS (SELECT batch, list(o ORDER BY p) AS os, list(p ORDER BY p) AS ps FROM e GROUP BY batch
), t AS (SELECT batch, os, ps, i, os[i] AS o, list_filter(os[:i], lambda x: x NOT IN ('ALREADY_IN_LIBRARY', 'OTHER', 'DAILY_BUDGET_EXHAUSTED', 'ENV_NOT_READY')) AS seen FROM (SELECT *, unnest(range(1, len(os) + 1)) AS i FROM b)
), s AS (SELECT *, CASE o WHEN 'DAILY_BUDGET_EXHAUSTED' THEN 'STOPPED_DAILY_BUDGET_EXHAUSTED' WHEN 'ENV_NOT_READY' THEN 'STOPPED_ENV_NOT_READY' ELSE CASE WHEN o NOT IN ('DOWNLOADED', 'ALREADY_IN_LIBRARY', 'OTHER') AND len(seen) >= 3 AND NOT list_contains(seen[-3:], 'DOWNLOADED') THEN 'STOPPED_CONSECUTIVE_MISSES' END END AS ends FROM t
), f AS (SELECT batch, min(i) FILTER (ends IS NOT NULL) AS cut_, arg_min(ends, i) FILTER (ends IS NOT NULL) AS status FROM s GROUP BY batch)
SELECT b.batch, coalesce(status, 'COMPLETED') AS status, ps[cut_] AS stopped_at, coalesce(cut_, len(os)) AS ran, CAST(len(list_filter(os[:coalesce(cut_, len(os))], lambda x: x = 'DOWNLOADED')) AS BIGINT) AS downloaded FROM b JOIN f ON f.batch = b.batch"""


def q32_anchors(spark, d):
    a = markup.anchors(markup.elements(table(spark, d, "pages"), only={"a"}))
    return a.groupBy("page_id").agg(F.count("*").alias("links"), F.min_by("href", "position").alias("first"), F.count_if(F.col("href") == F.concat(F.lit("/"), F.col("label"))).alias("named"))


Q32 = """WITH x AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\\b[^>]*?href="([^"]*)"[^>]*>.*?</a>', 1) AS h, regexp_extract_all(html, '(?is)<a\\b[^>]*?href="[^"]*"[^>]*>(.*?)</a>', 1) AS l FROM pages)
SELECT page_id, CAST(len(h) AS BIGINT) AS links, h[1] AS first, CAST(len(list_filter(list_zip(h, l), lambda z: z[1] = '/' || trim(z[2]))) AS BIGINT) AS named FROM x WHERE len(h) > 0"""


def q32_articles(spark, d):
    """Article facts of pages to which citation elements or a JSON-LD block are added, by number."""
    k = F.col("page_id")
    head = F.when(k % 3 == 0, F.concat(F.lit('<meta name="citation_title" content="Title '), k, F.lit('"><meta content="A One" name="citation_author"><meta name="citation_author" content="B Two"><meta name="citation_doi" content="10.1000/P'), k, F.lit('"><meta name="citation_journal_title" content="J">')))
    head = head.when(k % 3 == 1, F.concat(F.lit('<script type="application/ld+json">{"@type": "ScholarlyArticle", "headline": "Head '), k, F.lit('", "author": [{"name": "C Three"}], "keywords": "x; y，z"}</script>'))).otherwise("")
    a = markup.article(table(spark, d, "pages").select("page_id", F.concat(head, "html").alias("html")))
    return a.select("page_id", "title", F.array_join("authors", "|").alias("authors"), "journal", "doi", F.array_join("keywords", "|").alias("keywords"), "status")


Q32A = """SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'Title ' || page_id WHEN 1 THEN 'Head ' || page_id ELSE nullif(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')), '') END AS title,
  CASE page_id % 3 WHEN 0 THEN 'A One|B Two' WHEN 1 THEN 'C Three' ELSE '' END AS authors, CASE WHEN page_id % 3 = 0 THEN 'J' END AS journal, CASE WHEN page_id % 3 = 0 THEN '10.1000/p' || page_id END AS doi, CASE WHEN page_id % 3 = 1 THEN 'x|y|z' ELSE '' END AS keywords,
  CASE page_id % 3 WHEN 0 THEN 'PeerReviewedJournalArticle' ELSE 'Unknown' END AS status FROM pages"""


def q33_official(spark, d):
    return pages.officiality(table(spark, d, "pages"), ["example.com", "tionsh.example.net"])


Q33 = r"""WITH h AS (SELECT page_id, html, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\.', ''), '\.$', '') AS domain FROM pages
), t AS (SELECT *, lower(regexp_replace(regexp_replace(html, '(?is)<(script)\b.*?</script>|<(style)\b.*?</style>|<noscript\b.*?</noscript>', ' ', 'g'), '<[^>]*>', ' ', 'g')) AS text FROM h)
SELECT page_id, domain, CASE WHEN domain IN ('example.com', 'tionsh.example.net') THEN 'CONFIRMED' WHEN ends_with(domain, '.example.com') OR ends_with(domain, '.tionsh.example.net') THEN 'PROBABLE' ELSE 'UNVERIFIED' END AS state,
  CASE WHEN contains(text, 'captcha') THEN 'CHALLENGE' WHEN regexp_matches(text, 'sign in|log in') THEN 'LOGIN' END AS gate FROM t"""


def q33_links(spark, d):
    c = table(spark, d, "pages").select((F.col("page_id") % 40).alias("key"), pages.domain(F.col("url")).alias("url"), F.element_at(F.array(F.lit(120), F.lit(100), F.lit(90)), (F.col("page_id") % 3 + 1).cast("int")).alias("confidence"))
    return pages.unique_top(c, "key")


Q33L = r"""WITH c AS (SELECT page_id % 40 AS key, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\.', '') AS url, CASE page_id % 3 WHEN 0 THEN 120 WHEN 1 THEN 100 ELSE 90 END AS confidence FROM pages
), u AS (SELECT key, url, max(confidence) AS confidence FROM c GROUP BY key, url), t AS (SELECT key, max(confidence) AS top FROM u GROUP BY key), l AS (SELECT key, count(*) AS n, min(url) AS url, max(confidence) AS confidence FROM u JOIN t USING (key) WHERE confidence = top GROUP BY key)
SELECT key, CASE WHEN n = 1 THEN url END AS url, confidence, CASE WHEN n = 1 THEN 'FOUND' ELSE 'UNCERTAIN' END AS outcome FROM l"""


def q34_listing(spark, d):
    return pages.listing(works(spark, d), "src3", 2000, 2015)


Q34 = f"""WITH {WORKS_SQL} SELECT CASE WHEN journal <> 'src3' THEN 'other journal' WHEN year < 2000 THEN 'before the first year' WHEN year > 2015 THEN 'after the last year' WHEN trim(title) = '' THEN 'no title' ELSE 'kept' END AS reason, count(*) AS n, count(DISTINCT lower(title)) AS titles FROM works GROUP BY 1"""


def q35_claims(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("task"), "o_orderstatus")
    return pages.claim(o.where("task % 4 <> 1"), o, F.col("o_orderstatus") == "F")


Q35 = """WITH n AS (SELECT o_custkey AS owner, count(*) AS n, min(o_orderkey) AS task FROM orders WHERE o_orderkey % 4 = 1 AND o_orderstatus = 'F' GROUP BY 1)
SELECT owner, CASE WHEN n = 1 THEN task END AS task, CASE WHEN n = 1 THEN 'CLAIMED' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'NONE' END AS outcome FROM (SELECT DISTINCT o_custkey AS owner FROM orders) LEFT JOIN n USING (owner)"""


def q35_finished(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("task"), F.col("l_linenumber").cast("string").alias("list"), (F.col("l_linestatus") == "F").alias("finished"), F.col("l_shipdate").alias("at"))
    return pages.latest_finished(li)


Q35F = "SELECT l_orderkey AS task, arg_max(l_linenumber::VARCHAR, (l_linestatus = 'F', l_shipdate, l_linenumber::VARCHAR)) AS list, bool_or(l_linestatus = 'F') AS finished FROM lineitem GROUP BY 1"


def cubes(spark, d):
    k = F.col("s_suppkey").cast("int")
    return table(spark, d, "supplier").select(k.alias("request"), F.transform(F.sequence(F.lit(1), k % 30 + 1), lambda i: F.concat(F.lit("i"), i)).alias("indicators"), F.transform(F.sequence(F.lit(1), k % 31 + 1), lambda i: F.concat(F.lit("r"), i % 20)).alias("regions"), F.lit(1960).alias("first"), (1960 + k % 70).alias("last"))


def q36_cube_size(spark, d):
    return pages.cube_size(cubes(spark, d), 10_000)


Q36 = "SELECT s_suppkey AS request, (s_suppkey % 30 + 1) * least(20, s_suppkey % 31 + 1) * (s_suppkey % 70 + 1) AS cells, (s_suppkey % 30 + 1) * least(20, s_suppkey % 31 + 1) * (s_suppkey % 70 + 1) < 10000 AS accepted FROM supplier"


def q36_cube_rows(spark, d):
    """The cells of every request that cube_size() accepts."""
    c = cubes(spark, d).join(pages.cube_size(cubes(spark, d), 10_000).where("accepted").select("request"), "request", "left_semi")
    return pages.cube_rows(c).groupBy("request", "region").agg(F.count("*").alias("cells"), F.max("year").alias("last"))


Q36R = """WITH r AS (SELECT s_suppkey AS k FROM supplier WHERE (s_suppkey % 30 + 1) * least(20, s_suppkey % 31 + 1) * (s_suppkey % 70 + 1) < 10000), x AS (SELECT DISTINCT k, 'r' || i % 20 AS region FROM r, range(1, 32) t(i) WHERE i <= k % 31 + 1)
SELECT k AS request, region, (k % 30 + 1) * (k % 70 + 1) AS cells, CAST(1960 + k % 70 AS INTEGER) AS last FROM x"""


def q37_whole_tables(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    x = o.select(k.alias("task"), F.when(k % 8 == 0, "txt").otherwise("csv").alias("format"), F.lit("csv").alias("wanted"), (1000 - k % 30).alias("rows"), F.lit(1000).alias("total"))
    return pages.whole_table(x).groupBy("outcome").agg(F.count("*").alias("n"))


Q37 = "SELECT CASE WHEN o_orderkey % 8 = 0 THEN 'WRONG_FORMAT' WHEN 1000 - o_orderkey % 30 < 990 THEN 'INCOMPLETE' ELSE 'WHOLE' END AS outcome, count(*) AS n FROM orders GROUP BY 1"

TAXONOMY = (("en/tone", "ation与tion"), ("fr/mot", "que"), ("de/wort", "heit、keit"), ("es/voz", "ción"), ("en/method", "方法"))
# concept, label, term: a concept may stand for several labels.
CONCEPTS = (
    ("article", "en/tone", "the"), ("article", "en/tone", "of"), ("article", "en/method", "the"), ("mot", "fr/mot", "de"), ("mot", "fr/mot", "la"), ("wort", "de/wort", "der"), ("wort", "de/wort", "und"), ("voz", "es/voz", "los"), ("voz", "es/voz", "el"),
    ("many", "en/tone", "and"), ("many", "en/tone", "to"), ("many", "en/tone", "in"), ("many", "en/tone", "on"), ("many", "en/tone", "er"),
)
ALIASES = (("fr/mot", "que de"), ("fr/mot", "que"), ("de/wort", "das"), ("es/voz", "la de"), ("en/tone", "of the"))
METHOD_TITLE = "Double machine learning for treatment effects."


def classified(spark, d):
    """Works with their whole texts; every 41st has a title about a method."""
    return works(spark, d).select("doc_id", F.when(F.col("doc_id") % 41 == 7, METHOD_TITLE).otherwise(F.col("title")).alias("title"), F.col("body").alias("fulltext"), "journal")


def scored(spark, d):
    names = classify.name_terms(spark.createDataFrame(TAXONOMY, "label string, name string"))
    concepts, aliases = spark.createDataFrame(CONCEPTS, "concept string, label string, term string"), spark.createDataFrame(ALIASES, "label string, term string")
    return classify.signals(classified(spark, d), concepts, names, ["title", "fulltext", "journal"], aliases, "en/method")


def _signal_sql():
    names = [("en/tone", "ation"), ("en/tone", "tion"), ("fr/mot", "que"), ("de/wort", "heit"), ("de/wort", "keit"), ("es/voz", "ción"), ("en/method", "方法")]
    rows = [f"('concept', '{c}', '{a}', '{b}', 1.0)" for c, a, b in CONCEPTS] + [f"('name', '', '{a}', '{b}', {min(1.5 * len(b), 6.0) / 3!r})" for a, b in names] + [f"('alias', '', '{a}', '{b}', {min(3.0 * len(b.split()), 6.0) / 3!r})" for a, b in ALIASES]
    return f"""{WORKS_SQL}, terms(kind, concept, label, term, w) AS (VALUES {", ".join(rows)}
), src AS (SELECT doc_id, doc_id % 41 = 7 AS method, CASE WHEN doc_id % 41 = 7 THEN 'Double for treatment effects.' ELSE title END AS title, body, journal FROM works
), f AS (SELECT doc_id, 'title' AS field, 3.0 AS fw, ' ' || {fold_sql("title")} || ' ' AS t FROM src UNION ALL SELECT doc_id, 'fulltext', 1.0, ' ' || {fold_sql("body")} || ' ' FROM src UNION ALL SELECT doc_id, 'journal', 0.5, ' ' || {fold_sql("journal")} || ' ' FROM src
), h AS (SELECT doc_id, field, fw, kind, concept, label, term, w FROM f JOIN terms ON CASE WHEN term = '方法' THEN contains(t, term) ELSE contains(t, ' ' || term || ' ') END
), r AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, kind, concept, field ORDER BY length(term) DESC, term) AS place, row_number() OVER (PARTITION BY doc_id, kind, label, field ORDER BY len(string_split(term, ' ')) DESC, length(term) DESC, term) AS best FROM h
), k AS (SELECT doc_id, label, fw::DOUBLE * w::DOUBLE AS w, kind <> 'concept' AS named FROM r WHERE CASE WHEN kind = 'alias' THEN best = 1 WHEN kind = 'concept' AND field = 'fulltext' THEN place <= 3 ELSE true END UNION ALL SELECT doc_id, 'en/method', 9.0, false FROM src WHERE method
), s AS (SELECT doc_id, label, round(sum(w), 6) AS score, bool_or(named) AS named FROM k GROUP BY doc_id, label)"""


def q48_signals(spark, d):
    return scored(spark, d)


Q48 = f"WITH {_signal_sql()} SELECT doc_id, label, score, named FROM s"


def q49_decisions(spark, d):
    return classify.decide(scored(spark, d), works(spark, d))


DECIDED_SQL = f"""{_signal_sql()}, r2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS rank, max(score) OVER (PARTITION BY doc_id) AS lead_score FROM s
), p AS (SELECT *, rank > 1 AND named AND score >= 0.7 * lead_score AS close FROM r2), q AS (SELECT *, sum(close::INT) OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS place FROM p
), a AS (SELECT w.doc_id, label, score, round(score / (score + 3), 6) AS confidence, CASE WHEN lead_score IS NULL OR lead_score / (lead_score + 3) < 0.75 THEN 'REVIEW_REQUIRED' WHEN rank = 1 THEN 'ASSIGNED' WHEN close AND place < 3 THEN 'ASSIGNED' WHEN score >= 0.7 * lead_score THEN 'SUGGESTED' ELSE 'IGNORED' END AS decision,
    CASE WHEN lead_score IS NULL THEN 'NO_TAXONOMY_CONCEPT_MATCHED' WHEN lead_score / (lead_score + 3) < 0.3 THEN 'BELOW_REVIEW_THRESHOLD' WHEN lead_score / (lead_score + 3) < 0.75 THEN 'BELOW_AUTO_ASSIGN_THRESHOLD' ELSE 'AUTO_ASSIGNED_FROM_FROZEN_TAXONOMY' END AS reason FROM works w LEFT JOIN q ON q.doc_id = w.doc_id
), decided AS (SELECT *, CASE WHEN decision = 'REVIEW_REQUIRED' THEN 'REVIEW_REQUIRED' WHEN bool_or(decision = 'SUGGESTED') OVER (PARTITION BY doc_id) THEN 'CLASSIFIED_WITH_REVIEW_SUGGESTIONS' ELSE 'CLASSIFIED' END AS status FROM a)"""
Q49 = f"WITH {DECIDED_SQL} SELECT doc_id, label, score, confidence, decision, reason, status FROM decided"


def q50_confirm(spark, d):
    """What choices of a person make of works of which some have topics: a third choose what was proposed, others the label of their language."""
    n = F.col("doc_id")
    topics = works(spark, d).select("doc_id", F.when(n % 5 == 0, F.array(F.lit("en/tone"))).alias("labels"))
    proposals = classify.decide(scored(spark, d)).where("decision IN ('ASSIGNED', 'SUGGESTED')").select("doc_id", "label")
    chosen = works(spark, d).where("doc_id % 3 < 2").select("doc_id", F.when(n % 3 == 0, "en/tone").otherwise("fr/mot").alias("label"))
    return classify.confirm(topics, proposals, chosen, "a1", "a1").select("doc_id", F.array_join("labels", ";").alias("labels"), "status")


Q50C = f"""WITH {DECIDED_SQL}, pp AS (SELECT DISTINCT doc_id, label FROM decided WHERE decision IN ('ASSIGNED', 'SUGGESTED')), c AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'en/tone' ELSE 'fr/mot' END AS label FROM works WHERE doc_id % 3 < 2
), x AS (SELECT w.doc_id, c.label, pp.label IS NOT NULL AS raised FROM works w LEFT JOIN c USING (doc_id) LEFT JOIN pp ON pp.doc_id = c.doc_id AND pp.label = c.label)
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'en/tone' WHEN label IS NOT NULL AND raised THEN label ELSE '' END AS labels, CASE WHEN doc_id % 5 = 0 THEN 'SKIPPED_EXISTING' WHEN label IS NULL THEN 'REVIEW_REQUIRED' WHEN NOT raised THEN 'FAILED_SAFE' ELSE 'HUMAN_CONFIRMED' END AS status FROM x"""


def q50_reclassify(spark, d):
    """Requests to classify every fourth work anew: some without a reason, some that expect other labels, some of labels that a person gave."""
    n, none = F.col("doc_id"), F.lit(None).cast("string")
    w = works(spark, d)
    current = w.select("doc_id", F.when(n % 5 > 0, F.array(F.when(n % 3 == 0, "en/tone").otherwise("fr/mot"))).alias("labels"), F.when(n % 7 == 1, "HUMAN_CONFIRMED").when(n % 7 > 1, "AUTOMATIC").alias("source"), F.concat(F.lit("f"), n).alias("fingerprint"))
    asked = w.select(
        (n + F.when(n % 16 == 4, 1_000_000_000).otherwise(0)).alias("doc_id"), F.when(n % 11 == 0, " ").otherwise("better terms").alias("reason"), F.when(n % 13 == 0, F.array(F.lit("es/voz"))).alias("expected"), F.when(n % 6 > 0, F.concat(F.lit("f"), n)).alias("fingerprint"),
        F.when(n % 2 == 0, F.concat(F.lit("f"), n)).otherwise(none).alias("authorised"), (n % 9 == 8).alias("dry"),
    )
    out = classify.reclassify(asked, current, classify.decide(scored(spark, d)))
    return out.select("doc_id", "status", F.array_join("labels", ";").alias("labels"))


Q50R = f"""WITH {DECIDED_SQL}, made AS (SELECT doc_id AS n, string_agg(label, ';' ORDER BY score DESC, label) AS made FROM decided WHERE decision = 'ASSIGNED' GROUP BY doc_id
), xx AS (SELECT w.doc_id AS n, w.doc_id + CASE WHEN w.doc_id % 16 = 4 THEN 1000000000 ELSE 0 END AS asked, CASE WHEN w.doc_id % 5 = 0 THEN '' WHEN w.doc_id % 3 = 0 THEN 'en/tone' ELSE 'fr/mot' END AS labels, made FROM works w LEFT JOIN made ON made.n = w.doc_id
), stated AS (SELECT *, CASE WHEN n % 11 = 0 THEN 'REASON_REQUIRED' WHEN n % 9 <> 8 AND n % 13 > 0 AND n % 6 = 0 THEN 'PRECONDITION_REQUIRED' WHEN n % 16 = 4 THEN 'WORK_NOT_FOUND' WHEN labels = '' THEN 'WORK_UNFILED' WHEN n % 13 = 0 THEN 'PRECONDITION_CONFLICT' WHEN made IS NULL THEN 'REVIEW_REQUIRED'
  WHEN n % 9 = 8 THEN 'DRY_RUN' WHEN n % 7 = 0 THEN 'UNKNOWN_PROVENANCE' WHEN n % 7 = 1 AND n % 2 = 1 THEN 'HUMAN_AUTHORIZATION_REQUIRED' WHEN labels = made THEN 'ALREADY_CURRENT' ELSE 'APPLIED' END AS status FROM xx)
SELECT asked AS doc_id, status, CASE WHEN status IN ('APPLIED', 'DRY_RUN') THEN made WHEN n % 16 = 4 THEN '' ELSE labels END AS labels FROM stated"""


def q50_outside(spark, d):
    labels = works(spark, d).select(F.concat_ws("/", "domain", F.element_at(F.array(F.lit("tone"), F.lit("mot"), F.lit("wort"), F.lit("voz")), (F.col("doc_id") % 4 + 1).cast("int"))).alias("label"))
    return classify.outside(labels, spark.createDataFrame(TAXONOMY, "label string, name string"))


Q50 = "SELECT DISTINCT lang || '/' || CASE doc_id % 4 WHEN 0 THEN 'tone' WHEN 1 THEN 'mot' WHEN 2 THEN 'wort' ELSE 'voz' END AS label FROM documents WHERE label NOT IN ('en/tone', 'fr/mot', 'de/wort', 'es/voz', 'en/method')"


def q51_backtest(spark, d):
    decided = classify.decide(scored(spark, d), works(spark, d))
    settled = works(spark, d).join(table(spark, d, "labels").where("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    label = F.element_at(F.create_map(*[F.lit(x) for a, _ in TAXONOMY[:4] for x in (a[:2], a)]), F.col("domain"))
    return classify.backtest(decided.where("decision = 'ASSIGNED'"), settled.select("doc_id", label.alias("label")), decided.where("status = 'REVIEW_REQUIRED'"))


Q51 = f"""WITH {DECIDED_SQL}, asg AS (SELECT doc_id, label, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) = 1 AS lead FROM decided WHERE decision = 'ASSIGNED'), t AS (SELECT DISTINCT w.doc_id, CASE domain WHEN 'en' THEN 'en/tone' WHEN 'fr' THEN 'fr/mot' WHEN 'de' THEN 'de/wort' ELSE 'es/voz' END AS label FROM works w JOIN labels l ON w.doc_id = l.doc_id AND quality = 1
), h2 AS (SELECT t.doc_id, count(g.label) FILTER (WHERE g.label = t.label) AS hits, count(g.label) AS p, count(*) FILTER (WHERE g.label = t.label AND lead) AS first FROM t LEFT JOIN asg g ON t.doc_id = g.doc_id GROUP BY t.doc_id
), v AS (SELECT DISTINCT doc_id FROM decided WHERE status = 'REVIEW_REQUIRED')
SELECT count(*) AS works, round(sum(hits) / sum(p), 6) AS precision, round(sum(hits) / count(*), 6) AS recall, round(sum(first) / count(*) FILTER (WHERE p > 0), 6) AS top1, round(count(*) FILTER (WHERE p > 0) / count(*), 6) AS coverage, round(count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM v)) / count(*), 6) AS review FROM h2"""


def q52_budget(spark, d):
    return ledger.budget(attempts(spark, d), 80)


Q52 = f"WITH {ATTEMPTS} SELECT day, source, count(*) AS attempts, CAST(greatest(80 - count(*), 0) AS BIGINT) AS remaining FROM attempts GROUP BY day, source"


def q53_admitted(spark, d):
    a = ledger.admit(attempts(spark, d), 2, 12)
    return attempts(spark, d).select("attempt", "day", "source").join(a, "attempt").groupBy("day", "source").agg(F.count("*").alias("attempts"), F.count_if("admitted").alias("admitted"))


Q53 = f"""WITH RECURSIVE {ATTEMPTS}, s AS (SELECT *, row_number() OVER (PARTITION BY day, source ORDER BY ts, attempt) AS n FROM attempts
), f AS (SELECT day, source, n, (CASE WHEN TRUE THEN 1 ELSE 0 END) AS total, MAP([identifier], [1]) AS used FROM s WHERE n = 1
  UNION ALL SELECT s.day, s.source, s.n, CASE WHEN total < 12 AND (refetch OR coalesce(used[identifier], 0) < 2) THEN total + 1 ELSE total END,
    CASE WHEN total < 12 AND (refetch OR coalesce(used[identifier], 0) < 2) THEN map_concat(used, MAP([identifier], [coalesce(used[identifier], 0) + 1])) ELSE used END
  FROM f JOIN s ON s.day = f.day AND s.source = f.source AND s.n = f.n + 1)
SELECT day, source, max(n) AS attempts, CAST(max(total) AS BIGINT) AS admitted FROM f GROUP BY day, source"""


def q54_pacing(spark, d):
    return ledger.pacing(attempts(spark, d), ["source", "day"], 15.0, 7200.0, 4)


Q54 = f"""WITH {ATTEMPTS}, l AS (SELECT attempt, epoch_us(ts) / 1e6 AS t, lag(epoch_us(ts) / 1e6) OVER w AS a, lag(epoch_us(ts) / 1e6, 4) OVER w AS b FROM attempts WINDOW w AS (PARTITION BY source, day ORDER BY ts, attempt))
SELECT attempt, round(greatest(0.0, coalesce(15.0 - (t - a), 0.0), coalesce(7200.0 - (t - b), 0.0)), 6) AS wait FROM l"""

QUERIES = {f.__name__: f for f in (q28_usage, q30_latest_state, q31_misses, q31_stops, q32_anchors, q32_articles, q33_official, q33_links, q34_listing, q35_claims, q35_finished, q36_cube_size, q36_cube_rows, q37_whole_tables, q48_signals, q49_decisions, q50_confirm, q50_reclassify, q50_outside, q51_backtest, q52_budget, q53_admitted, q54_pacing)}
ORACLES = {"q28_usage": Q28, "q30_latest_state": Q30, "q31_misses": Q31, "q31_stops": Q31S, "q32_anchors": Q32, "q32_articles": Q32A, "q33_official": Q33, "q33_links": Q33L, "q34_listing": Q34, "q35_claims": Q35, "q35_finished": Q35F, "q36_cube_size": Q36, "q36_cube_rows": Q36R, "q37_whole_tables": Q37, "q48_signals": Q48, "q49_decisions": Q49, "q50_confirm": Q50C, "q50_reclassify": Q50R, "q50_outside": Q50, "q51_backtest": Q51, "q52_budget": Q52, "q53_admitted": Q53, "q54_pacing": Q54}
