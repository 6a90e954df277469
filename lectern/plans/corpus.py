"""q22, q26, q27, q29, q40 to q47: versions, freshness, fingerprints, deduplication, screening, planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as t
from lectern.operators import dedupe, screening, versions
from lectern.sources.tables import WORKS_SQL, fold_sql, table, works


def q22_freshness(spark, d):
    docs = table(spark, d, "documents")
    now = docs.where("doc_id % 11 <> 3").select("doc_id", F.sha2("text", 256).alias("sha256"))
    then = docs.where("doc_id % 7 <> 2").select("doc_id", F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text")), 256).alias("sha256"))
    return versions.freshness(now, then).groupBy("state").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


Q22 = """WITH c AS (SELECT doc_id FROM documents WHERE doc_id % 11 <> 3), i AS (SELECT doc_id FROM documents WHERE doc_id % 7 <> 2
), b AS (SELECT coalesce(c.doc_id, i.doc_id) AS doc_id, CASE WHEN i.doc_id IS NULL THEN 'ABSENT' WHEN c.doc_id IS NULL THEN 'ORPHAN' WHEN c.doc_id % 5 = 0 THEN 'STALE' ELSE 'FRESH' END AS state FROM c FULL JOIN i ON c.doc_id = i.doc_id)
SELECT state, count(*) AS n, min(doc_id) AS first FROM b GROUP BY state"""


def versions_of(spark, d):
    roles = F.element_at(F.array(*[F.lit(x) for x in (" Version of Record", "AcceptedManuscript", "other", "strange")]), (F.pmod("l_partkey", F.lit(4)) + 1).cast("int"))
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.concat_ws("-", F.lpad(F.col("l_suppkey").cast("string"), 6, "0"), "l_linenumber").alias("sha256"), roles.alias("role"),
        F.when(F.col("l_quantity") > 25, "pdf").otherwise("caj").alias("format"), (F.col("l_linenumber") == 2).alias("canonical"), (F.col("l_discount") > 0.03).alias("present"),
    )


def q26_preferred(spark, d):
    """The preferred version of each order's lines, and orders that have none (every one shifted by one)."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"))
    return versions.preferred(versions_of(spark, d), orders.union(orders.selectExpr("-doc_id")))


Q26 = """WITH v AS (SELECT l_orderkey AS doc_id, lpad(l_suppkey::VARCHAR, 6, '0') || '-' || l_linenumber AS sha256, l_discount > 0.03 AS present, l_discount > 0.03 AND l_quantity > 25 AS readable,
  1000 * (l_linenumber = 2)::INT + 100 * CASE l_partkey % 4 WHEN 0 THEN 7 WHEN 1 THEN 5 WHEN 2 THEN 1 ELSE 0 END + 10 * CASE WHEN l_quantity > 25 THEN 3 ELSE 2 END + (l_discount > 0.03 AND l_quantity > 25)::INT AS score FROM lineitem
), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, sha256) AS k, bool_or(present) OVER (PARTITION BY doc_id) AS a, bool_or(readable) OVER (PARTITION BY doc_id) AS l FROM v
), w AS (SELECT o_orderkey AS doc_id FROM orders UNION ALL SELECT -o_orderkey FROM orders)
SELECT w.doc_id, sha256, score, CASE WHEN k IS NULL THEN 'NO_VERSION' WHEN l THEN 'AVAILABLE' WHEN a THEN 'AVAILABLE_NOT_MACHINE_READABLE' ELSE 'FILE_MISSING' END AS status FROM w LEFT JOIN (SELECT * FROM r WHERE k = 1) r ON r.doc_id = w.doc_id"""


def q27_dispositions(spark, d):
    """Odd works as they come in against even ones: some with the DOI of another, some without title, some of broken or unknown bytes."""
    n = F.col("doc_id")
    w = works(spark, d).select("doc_id", F.sha2("body", 256).alias("sha256"), F.when(n % 10 == 4, F.concat(F.lit("10.1234/d"), n)).alias("doi"), "title", F.col("year").cast("string").alias("year"), "author")
    doi = F.when(n % 6 == 1, F.concat(F.lit("https://doi.org/10.1234/D"), (n - n % 10) + 4)).when(n % 22 == 3, F.concat(F.lit("10.9/"), n)).otherwise(F.col("doi"))
    signature = F.when(n % 34 == 5, "PDF_BROKEN").when(n % 34 == 7, "UNKNOWN").otherwise("PDF")
    incoming = w.where("doc_id % 2 = 1").select(n.alias("item"), "sha256", doi.alias("doi"), F.when(n % 14 == 9, "").otherwise(F.col("title")).alias("title"), "year", "author", signature.alias("signature"), (n % 38 != 11).alias("verified"))
    return versions.dispositions(incoming, w.where("doc_id % 2 = 0"))


Q27 = f"""WITH {WORKS_SQL}, w AS (SELECT doc_id, md5(body) AS h, CASE WHEN doc_id % 10 = 4 THEN '10.1234/d' || doc_id END AS doi, nullif({fold_sql("title")}, '') AS title, year, author FROM works
), h AS (SELECT * FROM w WHERE doc_id % 2 = 0), i AS (SELECT doc_id, h, CASE WHEN doc_id % 6 = 1 THEN '10.1234/d' || (doc_id - doc_id % 10 + 4) ELSE doi END AS doi, CASE WHEN doc_id % 14 = 9 THEN NULL ELSE title END AS title, year, author FROM w WHERE doc_id % 2 = 1
), x AS (SELECT *, EXISTS (SELECT 1 FROM h WHERE h.h = i.h) AS file, (SELECT min(coalesce(h.title, '')) FROM h WHERE h.doi = i.doi) AS by_doi, EXISTS (SELECT 1 FROM h WHERE h.title = i.title) AS known, coalesce((SELECT bool_or(h.doi IS NULL) FROM h WHERE h.title = i.title), false) AS without,
    EXISTS (SELECT 1 FROM h WHERE h.title = i.title AND (h.year = i.year OR h.author = i.author)) AS same FROM i)
SELECT doc_id AS item, CASE WHEN title IS NULL AND doi IS NULL THEN 'INSUFFICIENT_IDENTITY' WHEN doc_id % 34 = 5 THEN 'INVALID_PDF' WHEN doc_id % 34 = 7 THEN 'INVALID_FULLTEXT' WHEN doc_id % 38 = 11 THEN 'EXTERNAL_IDENTITY_UNVERIFIED' WHEN file THEN 'EXACT_DUPLICATE'
  WHEN by_doi <> '' AND title IS NOT NULL AND by_doi <> title THEN 'IDENTITY_CONFLICT' WHEN by_doi <> '' THEN 'SAME_WORK_DIFFERENT_VERSION' WHEN doi IS NOT NULL AND by_doi IS NULL AND known AND NOT without THEN 'NEW_PAPER'
  WHEN known AND same THEN 'SAME_WORK_DIFFERENT_VERSION' WHEN known THEN 'IDENTITY_CONFLICT' ELSE 'NEW_PAPER' END AS disposition FROM x"""


def q27_hash_owners(spark, d):
    return versions.hash_conflicts(works(spark, d).select("doc_id", F.sha2("body", 256).alias("sha256")))


Q27H = "SELECT sha256(text) AS sha256, count(DISTINCT doc_id) AS owners, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id) > 1"


def q29_difference(spark, d):
    a = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    b = a.where("c_custkey % 10 <> 4").withColumn("c_nationkey", F.when(F.col("c_custkey") % 9 == 1, F.lit(None)).otherwise(F.col("c_nationkey")))
    return versions.difference(a, b, "c_custkey", ["c_name", "c_nationkey"])


Q29 = """WITH x AS (SELECT c_custkey, 'c_name' AS field, c_name AS before, CASE WHEN c_custkey % 10 <> 4 THEN c_name END AS after FROM customer
  UNION ALL SELECT c_custkey, 'c_nationkey', c_nationkey::VARCHAR, CASE WHEN c_custkey % 10 <> 4 AND c_custkey % 9 <> 1 THEN c_nationkey::VARCHAR END FROM customer)
SELECT * FROM x WHERE before IS DISTINCT FROM after"""


def q29_fingerprint(spark, d):
    docs = table(spark, d, "documents")
    return versions.fingerprints(docs.select("source", "doc_id", F.sha2("text", 256).alias("sha256")), "source", ["doc_id", "sha256"])


Q29F = """WITH r AS (SELECT source, sha256('{"doc_id":' || doc_id || ',"sha256":"' || sha256(text) || '"}') AS h FROM documents
), p AS (SELECT source, count(*) AS n, sum(('0x' || substr(h, 1, 15))::BIGINT) AS a, sum(('0x' || substr(h, 17, 15))::BIGINT) AS b, sum(('0x' || substr(h, 33, 15))::BIGINT) AS c, sum(('0x' || substr(h, 49, 15))::BIGINT) AS e FROM r GROUP BY source)
SELECT source, n AS rows, sha256(n || ',' || a || ',' || b || ',' || c || ',' || e) AS digest FROM p"""


def q40_corrections(spark, d):
    """Corrections from the event log: some would blank a title or change all that identifies a work."""
    w = works(spark, d).select("doc_id", "title", "year", "author", "journal")
    n = F.col("event_id")
    all_ = n % 30 == 0
    c = table(spark, d, "events").select(
        n.alias("position"), F.pmod("user_id", F.lit(50)).alias("doc_id"), F.when(n % 14 == 6, " ").when(n % 2 == 0, F.concat(F.lit("T"), n)).alias("title"), F.when(n % 3 == 0, (2000 + n % 20).cast("int")).alias("year"),
        F.when(all_, F.lit("somebody")).alias("author"), F.when(n % 5 == 0, F.concat(F.lit("j"), n % 9)).alias("journal"),
    )
    return versions.correct(w, c)


Q40 = f"""WITH {WORKS_SQL}, l AS (SELECT user_id % 50 AS doc_id, max(event_id) AS n FROM events WHERE event_id % 14 <> 6 AND event_id % 30 <> 0 GROUP BY 1)
SELECT w.doc_id, coalesce(CASE WHEN n % 2 = 0 THEN 'T' || n END, title) AS title, coalesce(CASE WHEN n % 3 = 0 THEN (2000 + n % 20)::INT END, year) AS year, author, coalesce(CASE WHEN n % 5 = 0 THEN 'j' || n % 9 END, journal) AS journal, n IS NOT NULL AS corrected FROM works w LEFT JOIN l USING (doc_id)"""


def q40_events(spark, d):
    """Corrections of a catalog whose ids are made of DOIs or of titles, years and authors: what became of each, and the works after them."""
    n = F.col("doc_id")
    w = works(spark, d).where("doc_id >= 0")
    doi = F.when(n % 4 == 0, F.concat(F.lit("10.1000/c"), n))
    none = F.lit(None).cast("string")
    w = w.select(n.alias("n"), doi.alias("doi"), "title", F.array("author", F.lit("B")).alias("authors"), F.col("year").cast("string").alias("year"), "journal")
    stable = F.when(F.col("n") % 20 == 4, t.paper_id(none, F.col("title"), F.col("year"), F.get("authors", 0))).otherwise(t.paper_id(F.col("doi"), F.col("title"), F.col("year"), F.get("authors", 0)))
    # Works without a DOI that are alike have one id; the catalog has the first of them.
    w = w.withColumn("paper_id", F.when(F.trim("title") == "", F.concat(F.lit("Q"), "n")).otherwise(stable)).groupBy("paper_id").agg(*[F.min_by(c, "n").alias(c) for c in ("doi", "title", "authors", "year", "journal")], F.min("n").alias("n"))
    k = F.col("n")
    new = {"title": F.when(k % 3 == 0, F.concat(F.lit(" "), "title", F.lit("!"))).when(k % 7 == 1, "other"), "year": F.when(k % 11 == 2, "1900"), "authors": F.when(k % 5 == 1, F.array(F.upper(F.get("authors", 0)), F.lit(" C "))).when(k % 5 == 2, F.array(F.lit("B"))), "journal": F.when(k % 2 == 0, F.concat(F.lit("J"), k % 10))}
    c = w.select(k.alias("position"), F.when(k % 13 == 5, "P000").otherwise(F.col("paper_id")).alias("paper_id"), *[v.alias(c) for c, v in new.items()], none.alias("reason"), F.lit("page").alias("evidence"))
    after, events = versions.correct_catalog(w, c)
    told = events.select(F.col("position").alias("n"), "status", F.array_join("changed", ",").alias("changed"))
    return told.join(after.select("n", "title", F.array_join("authors", ",").alias("authors"), "year", "journal"), "n")


Q40E = f"""WITH {WORKS_SQL}, f AS (SELECT *, {fold_sql("title")} AS folded FROM works), g AS (SELECT *, CASE WHEN trim(title) = '' THEN 'q' || doc_id WHEN doc_id % 4 = 0 AND doc_id % 20 <> 4 THEN 'd' || doc_id ELSE folded || '|' || year || '|' || author END AS id FROM f
), c AS (SELECT min(doc_id) AS n, arg_min(title, doc_id) AS title, arg_min(folded, doc_id) AS folded, arg_min(year, doc_id)::VARCHAR AS year, arg_min(author, doc_id) AS author, arg_min(journal, doc_id) AS journal FROM g GROUP BY id
), x AS (SELECT *, CASE WHEN n % 3 = 0 THEN trim(title || '!') WHEN n % 7 = 1 THEN 'other' END AS t2, CASE WHEN n % 11 = 2 THEN '1900' END AS y2, CASE WHEN n % 5 = 1 THEN upper(author) || ',C' WHEN n % 5 = 2 THEN 'B' END AS a2, CASE WHEN n % 2 = 0 THEN 'J' || n % 10 END AS j2 FROM c
), s AS (SELECT *, t2 IS NULL AND y2 IS NULL AND a2 IS NULL AS untouched, trim(title) = '' AS odd FROM x
), v AS (SELECT *, CASE WHEN n % 13 = 5 THEN 'WORK_NOT_FOUND' WHEN untouched AND j2 IS NULL THEN 'NOTHING_TO_CHANGE' WHEN n % 4 = 0 THEN CASE WHEN n % 20 = 4 OR odd THEN 'IDENTITY_CHANGES' ELSE 'APPLIED' END WHEN untouched THEN 'APPLIED'
  WHEN coalesce({fold_sql("coalesce(t2, title)")}, '') = '' THEN 'IDENTITY_INCOMPLETE' WHEN odd OR y2 IS NOT NULL OR n % 5 = 2 OR (t2 = 'other' AND folded <> 'other') THEN 'IDENTITY_CHANGES' ELSE 'APPLIED' END AS status FROM s)
SELECT n, status, concat_ws(',', CASE WHEN t2 IS NOT NULL THEN 'title' END, CASE WHEN a2 IS NOT NULL THEN 'authors' END, CASE WHEN y2 IS NOT NULL THEN 'year' END, CASE WHEN j2 IS NOT NULL THEN 'journal' END) AS changed,
  CASE WHEN status = 'APPLIED' THEN coalesce(t2, title) ELSE title END AS title, CASE WHEN status = 'APPLIED' THEN coalesce(a2, author || ',B') ELSE author || ',B' END AS authors, CASE WHEN status = 'APPLIED' THEN coalesce(y2, year) ELSE year END AS year, CASE WHEN status = 'APPLIED' THEN coalesce(j2, journal) ELSE journal END AS journal FROM v"""


def records(spark, d):
    """Works as records of searches: few years and authors, so that equal titles meet; a quarter have DOIs of their own, some the one of the record before."""
    w, n = works(spark, d), F.col("doc_id")
    doi = F.when(n % 4 == 1, F.concat(F.lit("10.1000/D"), n)).when(n % 10 == 2, F.concat(F.lit("doi:10.1000/d"), n - 1))
    return w.select(
        n.alias("position"), doi.alias("doi"), "title", (2000 + n % 3).cast("string").alias("year"), F.concat(F.lit("Author "), n % 5).alias("first_author"), F.sha2("body", 256).alias("sha256"),
        F.element_at(F.array(F.lit("Preprint"), F.lit("PeerReviewedJournalArticle"), F.lit("Unknown")), (F.pmod(F.floor(n / 2), F.lit(3)) + 1).cast("int")).alias("status"), (n % 4 == 0).alias("downloaded"),
    )


def q41_components(spark, d):
    return dedupe.components(dedupe.keys(records(spark, d)))


RECORDS_SQL = f"""{WORKS_SQL}, b AS (SELECT doc_id AS position, nullif({fold_sql("title")}, '') AS title, 2000 + doc_id % 3 AS year, 'author ' || doc_id % 5 AS author, md5(body) AS h, doc_id // 2 % 3 AS status, row_number() OVER (ORDER BY doc_id) AS i,
    CASE WHEN doc_id % 4 = 1 THEN '10.1000/d' || doc_id WHEN doc_id % 10 = 2 THEN '10.1000/d' || (doc_id - 1) END AS doi FROM works
), k AS (SELECT position, i, 0 AS kind, doi AS key FROM b WHERE doi IS NOT NULL UNION ALL SELECT position, i, 1, title || '|' || year FROM b WHERE title IS NOT NULL UNION ALL SELECT position, i, 2, title || '|' || author FROM b WHERE title IS NOT NULL UNION ALL SELECT position, i, 3, h FROM b)"""
Q41 = f"""WITH RECURSIVE {RECORDS_SQL}, e AS (SELECT DISTINCT a.position AS a, min(a.position) OVER (PARTITION BY a.kind, a.key) AS b FROM k a
), g AS (SELECT a, b FROM e UNION SELECT b, a FROM e
), reach AS (SELECT position AS a, position AS b FROM b UNION SELECT r.a, g.b FROM reach r JOIN g ON r.b = g.a
) SELECT a AS position, min(b) AS component FROM reach GROUP BY a"""


def q42_deduplicate(spark, d):
    """Records of one work, some of which a DOI of their own keeps apart though their titles agree."""
    return dedupe.deduplicate(records(spark, d))


#: The rule as it is written: records in order, each key's owner the first that has it, groups as one list that every event makes anew.
Q42 = f"""WITH RECURSIVE {RECORDS_SQL}, ev AS (SELECT row_number() OVER (ORDER BY i, kind) AS n, i AS a, owner AS o, kind IN (1, 2) AS by_title FROM (SELECT i, kind, min(i) OVER (PARTITION BY kind, key) AS owner FROM k) WHERE owner < i
), c AS (SELECT list(doi ORDER BY i) AS dois, list(status ORDER BY i) AS sts, count(*) AS m FROM b
), st AS (SELECT 0::BIGINT AS n, (SELECT range(1, m + 1) FROM c) AS grp UNION ALL SELECT ev.n, CASE WHEN grp[a] = grp[o] OR (by_title AND len(list_filter([0, 1, 2], lambda s:
      len(list_filter(range(1, m + 1), lambda r: grp[r] = grp[a] AND sts[r] = s AND dois[r] IS NOT NULL)) > 0 AND len(list_filter(range(1, m + 1), lambda r: grp[r] = grp[o] AND sts[r] = s AND dois[r] IS NOT NULL)) > 0
      AND len(list_intersect(list_transform(list_filter(range(1, m + 1), lambda r: grp[r] = grp[a] AND sts[r] = s AND dois[r] IS NOT NULL), lambda r: dois[r]), list_transform(list_filter(range(1, m + 1), lambda r: grp[r] = grp[o] AND sts[r] = s AND dois[r] IS NOT NULL), lambda r: dois[r]))) = 0)) > 0)
    THEN grp ELSE list_transform(grp, lambda g: CASE WHEN g = grp[o] THEN grp[a] ELSE g END) END FROM st JOIN ev ON ev.n = st.n + 1, c
), last AS (SELECT unnest(range(1, len(grp) + 1)) AS i, unnest(grp) AS g FROM st WHERE n = (SELECT count(*) FROM ev)
), r AS (SELECT b.*, g, row_number() OVER (PARTITION BY g ORDER BY [30, 80, 0][status + 1] DESC, (doi IS NOT NULL) DESC, (position % 4 = 0) DESC, year DESC, position) AS place FROM b JOIN last USING (i)
), x AS (SELECT g, count(DISTINCT status) > 1 AND count(DISTINCT coalesce(title, '')) = 1 AS versions FROM r GROUP BY g)
SELECT r.position, c.position AS canonical, r.position <> c.position AS duplicate, versions, CASE WHEN r.position = c.position THEN NULL WHEN r.doi = c.doi THEN 'DOI exact match' WHEN r.title = c.title AND r.year = c.year THEN 'normalized title + year' WHEN r.title = c.title AND r.author = c.author THEN 'title + first author'
  WHEN r.h = c.h THEN 'SHA256 identical file' ELSE 'same-work evidence' END AS reason FROM r JOIN x USING (g) JOIN r c ON c.g = r.g AND c.place = 1"""


def q43_screen(spark, d):
    w = works(spark, d)
    r = w.select("doc_id", "title", F.col("body").alias("abstract"), "year", F.when(F.col("doc_id") % 3 == 0, "PeerReviewedJournalArticle").when(F.col("doc_id") % 3 == 1, "OnlineFirst").alias("status"), (F.col("doc_id") % 5 == 0).alias("accessible"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("10.1234/"), "doc_id")).alias("doi"))
    return screening.screen(r, ["the", "que", "der"], ["is"], 2024, 1995, 2020, ("ation", "heit"))


Q43 = f"""WITH {WORKS_SQL}, h AS (SELECT doc_id, year, {fold_sql("title || ' ' || body")} AS hay, {fold_sql("title")} IN ('is') AS exact FROM works
), m AS (SELECT *, contains(hay, 'the')::INT + contains(hay, 'que')::INT + contains(hay, 'der')::INT AS n FROM h
), s AS (SELECT doc_id, exact, greatest(0, least(100, CASE WHEN exact THEN 50 WHEN n > 0 THEN least(40, 15 + 10 * n) ELSE 0 END + CASE doc_id % 3 WHEN 0 THEN 20 WHEN 1 THEN 15 ELSE 0 END
  + CASE WHEN 2024 - year <= 5 THEN 15 WHEN 2024 - year <= 10 THEN 8 ELSE 0 END + CASE WHEN year < 1995 THEN -20 ELSE 0 END + CASE WHEN year > 2020 THEN -20 ELSE 0 END
  + CASE WHEN contains(hay, 'ation') OR contains(hay, 'heit') THEN 10 ELSE 0 END + CASE WHEN doc_id % 5 = 0 THEN 10 ELSE 0 END + CASE WHEN doc_id % 2 = 0 THEN 5 ELSE 0 END)) AS score FROM m)
SELECT doc_id, CAST(score AS INTEGER) AS score, CASE WHEN exact OR score >= 60 THEN 'KEEP' WHEN score >= 30 THEN 'MAYBE' ELSE 'REJECT' END AS decision FROM s"""


def q44_query_plan(spark, d):
    """The queries of a request for each customer: journals alone, or DOIs, titles, authors and pairs of words in two languages, or the question."""
    k, none = F.col("c_custkey"), F.array().cast("array<string>")
    some = lambda test, *values: F.when(test, F.array(*[v if not isinstance(v, str) else F.lit(v) for v in values])).otherwise(none)
    r = table(spark, d, "customer").select(
        k.alias("request"), some(k % 7 == 0, F.concat(F.lit("J "), k % 4), "K").alias("journals"), some(k % 5 == 1, F.concat(F.lit("https://doi.org/10.1000/D"), k), "no doi").alias("dois"), some(k % 3 == 0, F.col("c_name"), F.upper("c_name")).alias("titles"), some(k % 4 == 2, "A B").alias("authors"),
        F.when(k % 6 == 0, F.array(F.lit("x"))).when(k % 6 == 1, F.array(F.lit("x"), F.lit("y"), F.lit("z"))).when(k % 6 == 2, F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.lit("w"), i))).otherwise(none).alias("english"),
        F.when(k % 5 == 0, F.array(F.lit("数"))).when(k % 5 == 2, F.array(F.lit("数"), F.lit("字"))).otherwise(none).alias("chinese"), F.concat(F.lit(" about "), "c_name").alias("question"),
    )
    return screening.query_plan(r)


Q44 = """WITH c AS (SELECT c_custkey AS k, c_name AS name FROM customer), o AS (SELECT * FROM c WHERE k % 7 > 0
), q AS (SELECT k, 0 AS p, 'journal' AS kind, 'source:"J ' || k % 4 || '"' AS query FROM c WHERE k % 7 = 0 UNION ALL SELECT k, 1, 'journal', 'source:"K"' FROM c WHERE k % 7 = 0
  UNION ALL SELECT k, 2, 'doi', '10.1000/d' || k FROM o WHERE k % 5 = 1 UNION ALL SELECT k, 3, 'title', '"' || name || '"' FROM o WHERE k % 3 = 0 UNION ALL SELECT k, 4, 'author', 'author:"A B"' FROM o WHERE k % 4 = 2
  UNION ALL SELECT k, 5, 'english', '"x"' FROM o WHERE k % 6 = 0 UNION ALL SELECT k, 5 + i, 'english', '"x" AND "' || ['y', 'z'][i + 1] || '"' FROM o, range(2) t(i) WHERE k % 6 = 1 UNION ALL SELECT k, 5 + i, 'english', '"w0" AND "w' || i || '"' FROM o, range(1, 10) t(i) WHERE k % 6 = 2
  UNION ALL SELECT k, 20, 'chinese', CASE WHEN k % 5 = 0 THEN '数' ELSE '数 字' END FROM o WHERE k % 5 IN (0, 2) UNION ALL SELECT k, 30, 'question', 'about ' || name FROM o WHERE k % 5 IN (3, 4) AND k % 3 > 0 AND k % 4 <> 2 AND k % 6 > 2)
SELECT k AS request, CAST(row_number() OVER (PARTITION BY k ORDER BY p) AS INTEGER) AS step, kind, query FROM q QUALIFY step <= 8"""


def q45_caps(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("request"), F.col("s_suppkey").alias("source"))
    from pyspark.sql.window import Window as W

    w = W.partitionBy("request")
    s = s.withColumn("position", F.row_number().over(w.orderBy("source")) - 1).withColumn("n", F.count("*").over(w))
    return screening.split_caps(s, F.col("request") % 10)


Q45 = """WITH s AS (SELECT s_nationkey AS request, s_suppkey AS source, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS p, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier
), c AS (SELECT request, source, request % 10 AS t, CAST((request % 10) // n + (p < (request % 10) % n)::INT AS BIGINT) AS cap FROM s) SELECT request, source, cap FROM c WHERE cap > 0 OR t = 0"""


def q45_batches(spark, d):
    """Batches of the downloads of each customer, by quotas of groups or without, with their candidates; requests that break a rule."""
    k = F.col("c_custkey")
    n = F.pmod(k, F.lit(140)).cast("long")
    group = lambda name, q: F.struct(F.lit(name).alias("group"), q.cast("long").alias("quota"))
    half = F.floor(n / 2)
    quotas = F.when(k % 4 == 1, F.array(group("a", half), group("b", n - half + F.when(k % 12 == 5, 1).otherwise(0))))
    r = table(spark, d, "customer").select(k.alias("request"), n.alias("downloads"), (n + k % 90 * 3 - F.when(k % 31 == 0, 1).otherwise(0)).cast("long").alias("candidates"), (k % 5).cast("int").alias("retries"), quotas.alias("quotas"))
    return screening.batches(r, candidates=40)


Q45B = """WITH c AS (SELECT c_custkey AS k, c_custkey % 140 AS n, c_custkey % 140 + c_custkey % 90 * 3 - (c_custkey % 31 = 0)::INT AS cand FROM customer
), x AS (SELECT *, CASE WHEN cand < 0 THEN 'NEGATIVE_TOTAL' WHEN n > cand THEN 'MORE_DOWNLOADS_THAN_CANDIDATES' WHEN k % 5 = 4 THEN 'RETRIES' WHEN k % 4 = 1 AND k % 12 = 5 THEN 'QUOTA_TOTAL' END AS problem FROM c
), ok AS (SELECT * FROM x WHERE problem IS NULL), g AS (SELECT k, cand, 1 AS o, 'a' AS grp, n // 2 AS q FROM ok WHERE k % 4 = 1 UNION ALL SELECT k, cand, 2, 'b', n - n // 2 FROM ok WHERE k % 4 = 1
), parts AS (SELECT k, cand, o, i, grp, least(25, q - 25 * i) AS downloads FROM g, range(6) t(i) WHERE 25 * i < q
  UNION ALL SELECT k, cand, 3, i, NULL, n // c + (i < n % c)::INT FROM (SELECT *, (n + 24) // 25 AS c FROM ok WHERE k % 4 <> 1 AND n > 0), range(6) t(i) WHERE i < c
  UNION ALL SELECT k, cand, 4, 0, NULL, 0 FROM ok WHERE k % 4 <> 1 AND n = 0
), held AS (SELECT k, count(*) AS c FROM parts GROUP BY k), more AS (SELECT * FROM parts UNION ALL SELECT k, cand, 5, i, NULL, 0 FROM (SELECT ok.k, cand, coalesce(c, 0) AS c FROM ok LEFT JOIN held ON held.k = ok.k), range(20) t(i) WHERE i < greatest(1, (cand + 39) // 40) - c
), r AS (SELECT k, cand, grp, downloads, row_number() OVER (PARTITION BY k ORDER BY o, i) - 1 AS batch, count(*) OVER (PARTITION BY k) AS c FROM more)
SELECT k AS request, CAST(batch AS INTEGER) AS batch, grp AS quota_group, CAST(downloads AS BIGINT) AS downloads, CAST(cand // c + (batch < cand % c)::INT AS BIGINT) AS candidates, NULL AS problem FROM r
UNION ALL SELECT k, NULL, NULL, NULL, NULL, problem FROM x WHERE problem IS NOT NULL"""


def q46_readiness(spark, d):
    """Sources by what their trial runs said, and by which evidence of theirs is missing."""
    k = F.col("s_suppkey")
    of = lambda n, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.pmod(n, F.lit(len(v))) + 1).cast("int"))
    flags = [(F.pmod(k, F.lit(m)) > 0).alias(f) for m, f in zip((11, 13, 17, 19, 23, 29), screening.EVIDENCE, strict=True)]
    s = table(spark, d, "supplier").select(
        k.alias("source"), of(k, "SUCCESS", "SUCCESS", "ACTION_REQUIRED_USER_LOGIN", "SUCCESS", "ACTION_REQUIRED_USER_DOWNLOAD", "FAILED", "SUCCESS").alias("status"), of(k + F.floor(k / 7), "CAPTCHA after Login", "OTP sent", "Sign in with CARSI", "安全验证", "Login", "please wait").alias("note"),
        of(k, 1, 1, 0, 1, 1, 1, 2).cast("int").alias("downloads"), *flags,
    )
    return screening.readiness(s).groupBy("state", "action", "reason").agg(F.count("*").alias("n"), F.min("source").alias("first"))


Q46 = """WITH s AS (SELECT s_suppkey AS k, ['SUCCESS', 'SUCCESS', 'ACTION_REQUIRED_USER_LOGIN', 'SUCCESS', 'ACTION_REQUIRED_USER_DOWNLOAD', 'FAILED', 'SUCCESS'][s_suppkey % 7 + 1] AS status, (s_suppkey + s_suppkey // 7) % 6 AS m, ['CAPTCHA after Login', 'OTP sent', 'Sign in with CARSI', '安全验证', 'Login', 'please wait'][(s_suppkey + s_suppkey // 7) % 6 + 1] AS note FROM supplier
), f AS (SELECT *, array_to_string(list_filter([CASE WHEN k % 11 = 0 THEN 'authorized' END, CASE WHEN k % 13 = 0 THEN 'validated' END, CASE WHEN k % 17 = 0 THEN 'identified' END, CASE WHEN k % 19 = 0 THEN 'current' END, CASE WHEN k % 23 = 0 THEN 'unattended' END, CASE WHEN k % 29 = 0 THEN 'hashed' END], lambda x: x IS NOT NULL), ',') AS missing FROM s
), r AS (SELECT k, CASE k % 7 WHEN 2 THEN note WHEN 4 THEN 'UNATTENDED_DOWNLOAD_UNSUPPORTED' WHEN 5 THEN 'WORKFLOW_STATUS_FAILED' WHEN 6 THEN 'WORKFLOW_STATUS_SUCCESS' ELSE 'MISSING ' || nullif(missing, '') END AS reason, CASE WHEN k % 7 = 2 THEN ['CAPTCHA', 'MFA', 'SSO', 'SECURITY_CHALLENGE', 'LOGIN', 'MANUAL_AUTHENTICATION'][m + 1] END AS action FROM f)
SELECT CASE WHEN k % 7 = 2 THEN 'ACTION_REQUIRED' WHEN reason IS NULL THEN 'READY' ELSE 'NOT_READY' END AS state, action, reason, count(*) AS n, min(k) AS first FROM r GROUP BY 1, 2, 3"""


def q47_route(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"))
    text = F.element_at(F.array(*[F.lit(x) for x in ("Find a paper on X.", "the EPS data", "a TABLE of y", "hello")]), (F.col("conv_id") % 4 + 1).cast("int"))
    r = c.select(F.col("conv_id").alias("request"), text.alias("text"), F.when(F.col("conv_id") % 9 == 0, "LITERATURE").alias("explicit"), (F.col("turns") * 10).alias("candidates"), F.lit(1).alias("downloads"))
    return screening.route(r, {"eps": "EPS"})


Q47 = """SELECT conv_id AS request, CASE WHEN conv_id % 9 = 0 THEN 'LITERATURE' ELSE CASE conv_id % 4 WHEN 0 THEN 'LITERATURE' WHEN 1 THEN 'EPS' WHEN 2 THEN 'DATA' ELSE 'UNKNOWN' END END AS task, count(*) * 10 > 30 AS gate FROM conversations GROUP BY conv_id"""

QUERIES = {f.__name__: f for f in (q22_freshness, q26_preferred, q27_dispositions, q27_hash_owners, q29_difference, q29_fingerprint, q40_corrections, q40_events, q41_components, q42_deduplicate, q43_screen, q44_query_plan, q45_caps, q45_batches, q46_readiness, q47_route)}
ORACLES = {"q22_freshness": Q22, "q26_preferred": Q26, "q27_dispositions": Q27, "q27_hash_owners": Q27H, "q29_fingerprint": Q29F, "q29_difference": Q29, "q40_corrections": Q40, "q40_events": Q40E, "q41_components": Q41, "q42_deduplicate": Q42, "q43_screen": Q43, "q44_query_plan": Q44, "q45_caps": Q45, "q45_batches": Q45B, "q46_readiness": Q46, "q47_route": Q47}
