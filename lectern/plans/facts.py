"""q61 to q66: text of requests and names, page facts, queues, runs and states. Facts are made from the tables' numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as t
from lectern.operators import access, index, queues
from lectern.sources.tables import table


def choose(n, *values):
    """The value whose place is n modulo their number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def pick(n, *values):
    """The same in SQL."""
    text = ["NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in values]
    return f"(CASE {n} % {len(values)} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(text)) + " END)"


def parts(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("n"), F.col("p_name").alias("name"))


P = "p AS (SELECT p_partkey AS n, p_name AS name FROM part)"


def q61_keywords(spark, d):
    raw = F.concat("name", F.lit("；  "), F.col("n"), F.lit("，k;;"))
    return parts(spark, d).select("n", F.array_join(t.keywords(raw), "|").alias("keywords"), t.label_key(F.concat(F.lit(" a　"), "name", F.lit(" 1 "))).alias("label"), F.upper(t.strip_accents(F.concat(F.lit("ÀÉ"), choose(F.col("n"), "ñ", "ü", "ção")))).alias("plain"))


Q61K = f"WITH {P} SELECT n, trim(name) || '|' || n || '|k' AS keywords, 'a' || replace(name, ' ', '') || '1' AS label, 'AE' || {pick('n', 'N', 'U', 'CAO')} AS plain FROM p"


def q61_file_names(spark, d):
    first = choose(F.col("n"), "con", 'a<b>:"c"', "lpt1.txt", "..x. ", "")
    return parts(spark, d).select("n", t.file_name([first, F.when(F.col("n") % 5 != 0, F.repeat("name", 12))]).alias("file"))


Q61F = rf"""WITH {P}, j AS (SELECT n, {pick('n', 'con', 'a<b>:"c"', 'lpt1.txt', '..x.', '')} AS f, repeat(name, 12) AS r FROM p
), c AS (SELECT n, CASE WHEN n % 5 = 0 THEN f WHEN f = '' THEN trim(r) ELSE f || '_' || trim(r) END AS x FROM j), e AS (SELECT n, regexp_replace(substr(regexp_replace(regexp_replace(x, '[<>:"/\\|?*]', '_', 'g'), '\s+', ' ', 'g'), 1, 180), '^[ .]+|[ .]+$', '', 'g') AS x FROM c)
SELECT n, CASE WHEN string_split(x, '.')[1] IN ('con', 'lpt1') THEN '_' || x WHEN x = '' THEN 'unnamed' ELSE x END AS file FROM e"""


def q61_topic_field(spark, d):
    """Topic fields with repeated pairs, parts of part names among them."""
    first, rest = F.substring_index("name", " ", 1), F.concat(F.col("name"), F.lit(" "), F.col("n"))
    raw = F.concat(first, F.lit(" \\ "), rest, F.lit("; "), choose(F.col("n"), "x\\y", "none"), F.lit(" ;"), first, F.lit("\\"), rest, F.lit(";"), choose(F.col("n"), "x\\y", "c\\d"))
    return parts(spark, d).select("n", t.topic_field(t.topic_pairs(raw)).alias("field"))


Q61T = f"WITH {P} SELECT n, split_part(name, ' ', 1) || chr(92) || name || ' ' || n || ';' || {pick('n', chr(120) + chr(92) + 'y', 'c' + chr(92) + 'd')} AS field FROM p"


def q61_titles(spark, d):
    """Titles with the spaces that markup leaves, around ideographs, marks and part names."""
    say = lambda *values: choose(F.col("n"), *values)
    raw = F.concat(say("数 字 ", "审计 、 质量 、 ", "A - B ", "中国 — — ", "a &amp; b  &lt;c&gt; ", "盈余 + "), "name", say(" 金融 与 企业 - 创新", " 、 风 险", " - C", " — 经验", " &quot;q&quot;", " + 管理  与"), F.col("n"))
    return parts(spark, d).select("n", t.squeeze_title(raw).alias("title"))


Q61S = f"WITH {P} SELECT n, {pick('n', '数字 ', '审计、质量、', 'A - B ', '中国——', 'a & b <c> ', '盈余+')} || name || {pick('n', ' 金融与企业-创新', '、风险', ' - C', '—经验', ' "q"', '+管理与')} || n AS title FROM p"


def q61_spaced_dois(spark, d):
    """DOIs that text extraction has broken at their punctuation, in as many places as a part name has words, with others and with words after them."""
    words = F.replace("name", F.lit(" "), F.lit(". "))
    raw = F.concat(F.lit("see 10.1016 / j. jacc"), F.lit("eco.2008 ."), F.col("n"), F.lit(" and doi 10.1000/AB"), F.col("n"), F.lit(". 10.1000/ab"), F.col("n"), F.lit(" also 10.5555/ "), words, F.lit(" _ "), words, F.lit(" - "), F.col("n"), F.lit(" end"))
    return parts(spark, d).select("n", F.array_join(t.spaced_dois(raw), " ").alias("dois"))


Q61D = f"WITH {P} SELECT n, '10.1016/j.jacceco.2008.' || n || ' 10.1000/ab' || n || ' 10.5555/' || replace(name, ' ', '.') || '_' || replace(name, ' ', '.') || '-' || n AS dois FROM p"


def q61_controls(spark, d):
    text = F.concat(
        choose(F.col("n"), "研究 2010-2020 年", "last 7 years of", "2015年以后", "papers on"), F.lit(" "), choose(F.col("n"), "最多候选 300 篇", "最多下载 40 篇", "do not download", "只找英文", "中英文 peer-reviewed"),
        F.lit(' "A long '), F.col("name"), F.lit('" "short" 10.1000/X'), F.col("n"), F.lit("."),
    )
    c = parts(spark, d).select("n", t.controls(text, 2026).alias("c"))
    return c.select("n", "c.first", "c.last", "c.results", "c.downloads", "c.languages", F.array_join("c.titles", "|").alias("titles"), F.array_join("c.dois", "|").alias("dois"), "c.reviewed")


Q61C = f"""WITH {P} SELECT n, CASE n % 4 WHEN 0 THEN 2010 WHEN 1 THEN 2020 WHEN 2 THEN 2015 END AS first, CASE n % 4 WHEN 0 THEN 2020 WHEN 1 THEN 2026 WHEN 2 THEN 2026 END AS last, {pick('n', 200, 30, 30, 30, 30)} AS results, {pick('n', 5, 25, 0, 5, 5)} AS downloads,
  {pick('n', 'zh,en', 'zh,en', 'zh,en', 'en', 'zh,en')} AS languages, 'A long ' || name AS titles, '10.1000/X' || n AS dois, n % 5 = 4 AS reviewed FROM p"""


def q61_redacted(spark, d):
    values = F.create_map(F.lit("Api_Token"), choose(F.col("n"), "abc", "false", None), F.lit("note"), F.concat(F.lit("password=x"), F.col("n")), F.lit("name"), F.col("name"))
    r = parts(spark, d).select("n", "name", t.redact_keys(values).alias("m"), t.names_secret(F.create_map(choose(F.col("n"), "source.cookie", "source.name"), F.lit("x"))).alias("refused"))
    return r.select("n", F.element_at("m", "Api_Token").alias("token"), F.element_at("m", "note").alias("note"), (F.element_at("m", "name") == F.col("name")).alias("same"), "refused")


Q61R = f"WITH {P} SELECT n, {pick('n', '<REDACTED>', 'false', None)} AS token, 'password=<REDACTED>' AS note, true AS same, n % 2 = 0 AS refused FROM p"


def facts(spark, d):
    n = F.col("n")
    return parts(spark, d).select(
        n.alias("page_id"), F.when(n % 3 > 0, "x").alias("control"), choose(n, "Open Access", "You have full access", "purchased by us", "a subscription", "nothing", None).alias("body"), (n % 7 == 0).alias("denied"), (n % 5 == 0).alias("blocked"), (n % 11 == 0).alias("direct"),
    )


STYLES = ("plain", "public", "stated", "signals", "snapshot")


def q62_access(spark, d):
    """What pages of each kind of source say of their full text."""
    out = None
    for s in STYLES:
        one = access.access(facts(spark, d), s).withColumn("style", F.lit(s))
        out = one if out is None else out.unionByName(one)
    return out


Q62A = f"""WITH {P}, f AS (SELECT n, n % 3 > 0 AS c, n % 6 AS b, n % 7 = 0 AS denied, n % 5 = 0 AS blocked, n % 6 < 2 OR n % 11 = 0 AS positive FROM p)
SELECT n AS page_id, 'plain' AS style, CASE WHEN NOT c THEN 'METADATA_ONLY' WHEN b = 0 THEN 'OPEN_ACCESS' ELSE 'INSTITUTIONAL_AUTHENTICATED' END AS access FROM f
UNION ALL SELECT n, 'public', CASE WHEN NOT c THEN 'METADATA_ONLY' WHEN b = 0 THEN 'OPEN_ACCESS' WHEN b = 1 THEN 'INSTITUTIONAL_AUTHENTICATED' ELSE 'PUBLIC_FULL_TEXT' END FROM f
UNION ALL SELECT n, 'stated', CASE WHEN NOT c THEN CASE WHEN denied THEN 'METADATA_ONLY' ELSE 'UNKNOWN' END WHEN b = 0 THEN 'OPEN_ACCESS' WHEN b < 4 THEN 'INSTITUTIONAL_AUTHENTICATED' ELSE 'PUBLIC_FULL_TEXT' END FROM f
UNION ALL SELECT n, s, CASE WHEN NOT c THEN 'METADATA_ONLY' WHEN positive AND blocked THEN 'UNKNOWN' WHEN blocked THEN 'METADATA_ONLY' WHEN NOT positive THEN CASE WHEN s = 'signals' THEN 'UNKNOWN' ELSE 'METADATA_ONLY' END WHEN b = 1 THEN 'INSTITUTIONAL_AUTHENTICATED' ELSE 'PUBLIC_FULL_TEXT' END
FROM f, (VALUES ('signals'), ('snapshot')) v(s)"""


def q62_controls(spark, d):
    """The control of each page, from links of which some are off, elsewhere, or of another kind."""
    n = F.col("n")
    a = parts(spark, d).select(
        (n % 50).alias("page_id"), n.alias("position"), F.concat(F.lit("/h"), n).alias("href"), choose(n, "www.a.org", "b.org").alias("host"), choose(n, "/pdfft/1", "/article/1", "/x.PDF").alias("path"), choose(n, "View PDF", "PDF", "download pdf", "全文 pdf 下载", None).alias("label"), (n % 13 != 0).alias("enabled"),
    )
    return access.pdf_control(a, F.array(F.lit("www.a.org"), F.lit("a.org")))


Q62C = f"WITH {P} SELECT n % 50 AS page_id, '/h' || min(n) AS control FROM p WHERE n % 2 = 0 AND n % 3 <> 1 AND n % 5 IN (0, 2, 3) AND n % 13 <> 0 GROUP BY 1"


def nodes(spark, d):
    n = F.col("n")
    return parts(spark, d).select(
        (n % 60).alias("page_id"), choose(n, True, True, False, None).alias("reported"), choose(n, "block", "none", None).alias("display"), choose(n, "visible", "visible", "visible", "Hidden", None).alias("visibility"), choose(n, "1", "0.5", "0", "bad", None, "1", "1").alias("opacity"),
        F.when(n % 17 == 0, 0.0).otherwise(20.0).alias("width"), F.lit(10.0).alias("height"), F.when(n % 19 == 0, "true").alias("aria_hidden"), F.when(n % 23 > 0, (n % 90).cast("double") * 10).alias("x"), F.lit(5.0).alias("y"), choose(n, True, True, True, None, False, True).alias("frame_visible"),
        F.lit(800.0).alias("frame_width"), F.lit(600.0).alias("frame_height"), (n % 29 == 0).alias("overlay"), n.alias("node"),
    )


NODES_SQL = f"""{P}, nd AS (SELECT n, n % 60 AS page_id, n % 29 = 0 AS overlay, {pick('n', True, True, False, None)} AS reported, {pick('n', '1', '0.5', '0', 'bad', None, '1', '1')} AS opacity, CASE WHEN n % 17 = 0 THEN 0 ELSE 20 END AS w, CASE WHEN n % 23 > 0 THEN n % 90 * 10 END AS x, {pick('n', True, True, True, None, False, True)} AS fv FROM p
), r AS (SELECT *, CASE WHEN coalesce(NOT reported, false) OR n % 19 = 0 OR n % 3 = 1 OR n % 5 = 3 OR w = 0 OR coalesce(try_cast(opacity AS DOUBLE) <= 0, false) THEN false WHEN opacity = 'bad' OR reported IS NULL THEN NULL ELSE true END AS render,
  CASE WHEN fv = false THEN false WHEN fv IS NULL THEN NULL WHEN x IS NULL THEN CASE WHEN reported = false THEN false END ELSE x < 800 AND x + w > 0 END AS view FROM nd
), vis AS (SELECT n, page_id, overlay, CASE WHEN render = false OR view = false THEN false WHEN render IS NULL OR view IS NULL THEN NULL ELSE true END AS visible FROM r)"""


def q62_visibility(spark, d):
    return access.visibility(nodes(spark, d)).select("node", "visible")


Q62V = f"WITH {NODES_SQL} SELECT n AS node, visible FROM vis"


def q62_challenge(spark, d):
    n = F.col("n")
    pages = parts(spark, d).select(n.alias("page_id"), (n % 4 > 0).alias("confirmed"), (n % 9 > 0).alias("complete"), (n % 31 == 0).alias("blocking"))
    return access.challenge(pages, access.visibility(nodes(spark, d)))


Q62H = f"""WITH {NODES_SQL}, g AS (SELECT page_id, coalesce(bool_or(visible), false) AS seen, bool_or(visible IS NULL) AS open, bool_or(overlay AND coalesce(visible, true)) AS covers FROM vis GROUP BY 1)
SELECT n AS page_id, CASE WHEN n % 31 = 0 OR coalesce(covers, false) THEN 'BLOCKING' WHEN coalesce(seen, false) THEN 'VISIBLE' WHEN n % 4 = 0 OR n % 9 = 0 OR coalesce(open, false) THEN 'UNCERTAIN' WHEN open IS NOT NULL THEN 'DORMANT' ELSE 'NONE' END AS state FROM p LEFT JOIN g ON page_id = n"""


def q62_static_challenge(spark, d):
    n = F.col("n")
    return access.static_challenge(parts(spark, d).select(n.alias("page_id"), (n % 5 > 0).alias("text"), (n % 7 == 0).alias("overlay"), (n % 3 == 0).alias("identity"), (n % 2 == 0).alias("on_screen"), (n % 4 == 0).alias("business"), F.when(n % 11 == 0, "UNCERTAIN").alias("runtime")))


Q62S = f"WITH {P} SELECT n AS page_id, CASE WHEN n % 11 = 0 THEN 'UNCERTAIN' WHEN n % 5 = 0 THEN 'NONE' WHEN n % 7 = 0 THEN 'BLOCKING' WHEN n % 3 = 0 THEN 'VISIBLE' WHEN n % 2 = 0 AND n % 4 <> 0 THEN 'VISIBLE' ELSE 'DORMANT' END AS state FROM p"


def q62_page_lock(spark, d):
    n = F.col("n")
    k = F.floor(n / 3) + F.when(n % 7 == 0, 1).otherwise(0)
    pages = parts(spark, d).select(n.alias("page_id"), choose(n, "www.a.org", "a.org", "b.net").alias("host"), F.concat(F.lit("https://a.org/p/"), k, F.lit("?s="), n).alias("url"), F.concat(F.lit("Title "), k, F.lit("!")).alias("title"), (n % 5 < 2).alias("active"))
    wanted = parts(spark, d).select(n.alias("key"), F.concat(F.lit("https://a.org/p/"), n).alias("url"), F.concat(F.lit("title "), n).alias("title"))
    return access.page_lock(pages, wanted, ["a.org"])


Q62P = f"""WITH {P}, x AS (SELECT n AS page_id, n // 3 + (n % 7 = 0)::INT AS k, n % 5 < 2 AS active FROM p WHERE n % 3 <> 2), g AS (SELECT k, count(*) AS c, min(page_id) AS only_, count(*) FILTER (active) AS a, min(page_id) FILTER (active) AS live FROM x GROUP BY k)
SELECT n AS key, CASE WHEN c = 1 THEN only_ WHEN a = 1 THEN live END AS page_id, CASE WHEN c = 1 OR a = 1 THEN 'LOCKED' WHEN c > 1 THEN 'AMBIGUOUS' ELSE 'ABSENT' END AS outcome FROM p LEFT JOIN g ON k = n"""


def q62_identity(spark, d):
    n = F.col("n")
    doi = F.concat(F.lit("10.1000/f"), n)
    f = parts(spark, d).select(
        n.alias("item"), F.when(n % 3 > 0, doi).alias("doi"), F.col("name").alias("title"), F.when(n % 4 == 0, F.array(F.concat(F.lit("DOI: "), doi))).when(n % 4 == 1, F.array(F.lit("10.9999/other"))).alias("first_dois"), F.when(n % 5 == 0, F.array(doi)).alias("context_dois"),
        F.when(n % 2 == 0, F.concat(F.lit("x "), F.upper("name"), F.lit(" y"))).otherwise("no such").alias("first_page"), (n % 7 == 0).alias("citation"),
    )
    return access.identity(f)


Q62I = f"WITH {P} SELECT n AS item, CASE WHEN n % 3 > 0 AND (n % 4 = 0 OR n % 5 = 0) THEN 'VERIFIED' WHEN n % 3 > 0 AND n % 4 = 1 THEN 'CONFLICT' WHEN n % 2 = 0 OR n % 7 = 0 THEN 'VERIFIED' ELSE 'UNVERIFIED' END AS verdict FROM p"


def q62_first_page(spark, d):
    n = F.col("n")
    text = choose(n, "By Müller. Vol. 12, pp. 101-119", "Mullerson 12 (3): 101", "MÜLLER 12/2009 1101", "Müller, 12 and then 101", "x-müller 12 (4) 101")
    return parts(spark, d).select("n", access.first_page_citation(text, F.lit("Müller"), F.lit("12"), F.lit("101")).alias("cites"))


Q62F = f"WITH {P} SELECT n, n % 5 = 4 AS cites FROM p"


def q63_results(spark, d):
    """Works in the lists of results of pages, the first link of each."""
    n = F.col("n")
    a = parts(spark, d).select((n % 20).alias("page_id"), n.alias("position"), choose(n, "a.org", "ads.net", "a.org").alias("host"), F.concat(choose(n, "/science/article/", "/about/"), F.lit("S"), n % 7).alias("path"), F.concat(F.lit("L"), n).alias("label"), (n % 5 > 0).alias("listed"))
    return access.result_rows(a, r"^/science/article/(S\d+)$", ["a.org"], 3)


Q63R = f"""WITH {P}, f AS (SELECT n % 20 AS page_id, 'S' || n % 7 AS id, min(n) AS position FROM p WHERE n % 3 <> 1 AND n % 2 = 0 AND n % 5 > 0 GROUP BY 1, 2)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY position) AS INTEGER) AS rank, id, 'L' || position AS label FROM f QUALIFY rank <= 3"""


def q63_snapshots(spark, d):
    n = F.col("n")
    text = F.concat(F.lit('- link "old"\n- /url: /o\n- 题名 作者\n- link "First '), n, F.lit('":\n  - /url: /a/'), n, F.lit('\n- text\n- link "Second"\n- /url: /b\n'), F.when(n % 2 == 0, "共 2 条\n").otherwise(""), F.lit('- link "After"\n- /url: /c'))
    return access.snapshot_rows(parts(spark, d).select(n.alias("page_id"), text.alias("text")))


Q63S = f"""WITH {P} SELECT n AS page_id, 0 AS position, 'First ' || n AS title, '/a/' || n AS url FROM p UNION ALL SELECT n, 1, 'Second', '/b' FROM p UNION ALL SELECT n, 2, 'After', '/c' FROM p WHERE n % 2 = 1"""


def q63_page_kinds(spark, d):
    from lectern.operators import pages

    n = F.col("n")
    x = parts(spark, d).select("n", pages.page_kind((n % 3).cast("int"), choose(n, "x", "Please solve the CAPTCHA", "No results", "Loading...", "welcome")).alias("kind"), access.disguised(choose(n, "%PDF-1.7", " <!DOCTYPE html><title>x</title>", "<html><head><title>Just a moment...</title>", "HNLC")).alias("file"))
    return x


Q63K = f"WITH {P} SELECT n, CASE WHEN n % 5 = 1 THEN 'PUBLISHER_BLOCKED' WHEN n % 3 > 0 THEN 'RESULTS_PRESENT' WHEN n % 5 = 2 THEN 'GENUINE_ZERO_RESULTS' WHEN n % 5 = 3 THEN 'PENDING' ELSE 'NON_SEARCH_PAGE' END AS kind, {pick('n', 'FILE', 'HTML', 'CHALLENGE', 'FILE')} AS file FROM p"


def q63_detail_locks(spark, d):
    """The row of a result list that each detail page is: found by DOI, or by title and year."""
    n = F.col("n")
    rows = parts(spark, d).select(F.floor(n / 60).alias("query"), n.alias("position"), F.when(n % 3 == 0, F.concat(F.lit("10.1000/"), n % 50)).alias("doi"), F.concat(F.lit("Title "), n % 50).alias("title"), F.when(n % 4 > 0, (2000 + n % 7).cast("int")).alias("year"))
    details = parts(spark, d).select(n.alias("detail"), F.floor((n + 7) / 60).alias("query"), F.when(n % 2 == 0, F.concat(F.lit("doi:10.1000/"), n % 50)).alias("doi"), F.concat(F.lit("TITLE "), n % 50, F.lit("!")).alias("title"), F.when(n % 5 > 0, (2000 + n % 7).cast("int")).alias("year"))
    return queues.lock_detail(rows, details)


Q63D = f"""WITH {P}, r AS (SELECT n // 60 AS q, n AS position, CASE WHEN n % 3 = 0 THEN n % 50 END AS doi, n % 50 AS title, CASE WHEN n % 4 > 0 THEN 2000 + n % 7 END AS year FROM p), e AS (SELECT n AS detail, (n + 7) // 60 AS q, CASE WHEN n % 2 = 0 THEN n % 50 END AS doi, n % 50 AS title, CASE WHEN n % 5 > 0 THEN 2000 + n % 7 END AS year FROM p)
SELECT detail, min(position) AS position FROM e LEFT JOIN r ON e.q = r.q AND CASE WHEN e.doi IS NOT NULL AND r.doi IS NOT NULL THEN e.doi = r.doi ELSE e.title = r.title AND (e.year IS NULL OR r.year IS NULL OR e.year = r.year) END GROUP BY detail"""


def q63_same_records(spark, d):
    n = F.col("n")
    side = lambda k: {"doi": choose(n + k, "a", None, "b"), "title": choose(n + 2 * k, "t", "u"), "id": choose(n + k, None, "i"), "year": choose(n + k, "1", "2", None), "authors": choose(n + k, "x", None), "journal": F.lit("j")}
    names = ("doi_or_title", "all_agree", "title_first")
    return parts(spark, d).select("n", *[queues.same_record(k, side(0), side(3)).alias(k) for k in names])


def _same_sql():
    a, b = ({"doi": pick(f"(n + {k})", "a", None, "b"), "title": pick(f"(n + {2 * k})", "t", "u"), "id": pick(f"(n + {k})", None, "i"), "year": pick(f"(n + {k})", "1", "2", None), "authors": pick(f"(n + {k})", "x", None)} for k in (0, 3))
    agree = " AND ".join(f"({a[c]} IS NULL OR {b[c]} IS NULL OR {a[c]} = {b[c]})" for c in ("year", "authors", "doi", "id"))
    every = " AND ".join(f"({b[c]} IS NULL OR ({a[c]} IS NOT NULL AND {a[c]} = {b[c]}))" for c in ("doi", "title", "id"))
    return f"WITH {P} SELECT n, CASE WHEN {a['doi']} IS NULL AND {b['doi']} IS NULL THEN {a['title']} = {b['title']} ELSE {a['doi']} IS NOT DISTINCT FROM {b['doi']} END AS doi_or_title, {every} AS all_agree, {a['title']} = {b['title']} AND {agree} AS title_first FROM p"


Q63M = _same_sql()


def q64_arrivals(spark, d):
    n = F.col("n")
    listing = lambda size, at: parts(spark, d).select((n % 30).alias("folder"), F.concat(F.lit("F"), n, F.when(n % 30 == 4, ".part").otherwise(".pdf")).alias("name"), size.alias("size"), at.alias("modified"), F.when(n % 30 == 6, "GIF8").otherwise("%PDF-1.4").alias("head"))
    before, now = listing(F.lit(1), n).where("size = 1 AND (folder % 3 = 0 OR substring(name, 2, 3) < '150')"), listing(F.lit(1), F.when(n % 30 == 9, n + 1).otherwise(n))
    return queues.arrivals(before, now, listing(F.when(n % 30 == 7, 2).otherwise(1), F.when(n % 30 == 9, n + 1).otherwise(n)))


Q64A = f"""WITH {P}, x AS (SELECT n, n % 30 AS folder, 'F' || n || CASE WHEN n % 30 = 4 THEN '.part' ELSE '.pdf' END AS name FROM p), y AS (SELECT *, folder % 3 = 0 OR substr(name, 2, 3) < '150' AS old FROM x
), w AS (SELECT * FROM y WHERE NOT old OR folder = 9), g AS (SELECT folder, count(*) FILTER (folder <> 6) AS pdfs, min(name) FILTER (folder <> 6) AS name FROM w GROUP BY folder)
SELECT f.folder, CASE WHEN pdfs = 1 AND f.folder NOT IN (4, 7) THEN name END AS name, CASE WHEN pdfs IS NULL THEN 'TIMED_OUT' WHEN f.folder IN (4, 7) THEN 'WAITING' WHEN pdfs = 1 THEN 'ARRIVED' WHEN pdfs > 1 THEN 'AMBIGUOUS' ELSE 'REJECTED' END AS outcome FROM (SELECT DISTINCT folder FROM x) f LEFT JOIN g USING (folder)"""


def q64_entries(spark, d):
    """Tasks over four lists: the latest finished entry of each, else the latest."""
    o = table(spark, d, "orders").select((F.col("o_custkey") % 400).alias("task"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("k"), F.col("o_orderkey").cast("string").alias("title"))
    names = ("open_tasks", "open_records", "finished_records", "finished_fast")
    q = queues.queue_entries({n: o.where(F.col("k") % 7 == i).select("task", F.struct("at", "k").alias("at"), "title") for i, n in enumerate(names)})
    return q.select("task", "list", "finished", "title")


Q64E = """WITH e AS (SELECT o_custkey % 400 AS task, ['open_tasks', 'open_records', 'finished_records', 'finished_fast'][o_orderkey % 7 + 1] AS list, o_orderkey % 7 >= 2 AS finished, o_orderdate, o_orderkey FROM orders WHERE o_orderkey % 7 < 4)
SELECT task, arg_max(list, (finished, o_orderdate, o_orderkey)) AS list, bool_or(finished) AS finished, arg_max(o_orderkey::VARCHAR, (finished, o_orderdate, o_orderkey)) AS title FROM e GROUP BY task"""


def q64_tasks(spark, d):
    """Tasks claimed by name, tasks checked, and rights to cubes."""
    n = F.col("n")
    p = parts(spark, d)
    tasks = p.where("n % 3 > 0").select(n.alias("task"), F.concat(F.lit("t"), F.when(n % 10 < 2, n % 10).otherwise(n)).alias("name"), choose(n, "A", "B").alias("table"), (n % 4 > 0).alias("finished"))
    claims = queues.claim_by_name(tasks, p.select(F.concat(F.lit("t"), n).alias("name")))
    checks = queues.check_task(p.select(n.alias("task"), F.lit("A").alias("table")), tasks)
    right = queues.rights(p.select(n.alias("cube")), p.where("n % 5 > 0").select(n.alias("cube"), F.lit(True).alias("visit"), choose(n, True, False, None).alias("download")))
    one = lambda df, kind, key, *c: df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), *c)
    return one(claims, "claim", "name", "outcome", "task").unionByName(one(checks, "check", "task", "outcome", F.lit(None).cast("long").alias("task"))).unionByName(one(right, "right", "cube", F.col("right").alias("outcome"), F.lit(None).cast("long").alias("task")))


Q64T = f"""WITH {P}, q AS (SELECT n AS task, 't' || CASE WHEN n % 10 < 2 THEN n % 10 ELSE n END AS name FROM p WHERE n % 3 > 0), g AS (SELECT name, count(*) AS c, min(task) AS task FROM q GROUP BY name)
SELECT 'claim' AS kind, 't' || n AS key, CASE WHEN c IS NULL THEN 'NONE' WHEN c = 1 THEN 'CLAIMED' ELSE 'ERROR' END AS outcome, CASE WHEN c = 1 THEN task END AS task FROM p LEFT JOIN g ON g.name = 't' || n
UNION ALL SELECT 'check', n::VARCHAR, CASE WHEN n % 3 = 0 THEN 'MISSING' WHEN n % 2 = 1 THEN 'WRONG_TABLE' WHEN n % 4 = 0 THEN 'UNFINISHED' ELSE 'READY' END, NULL FROM p
UNION ALL SELECT 'right', n::VARCHAR, CASE WHEN n % 5 = 0 THEN 'NONE' WHEN n % 3 = 0 THEN 'DOWNLOAD' ELSE 'VISIT' END, NULL FROM p"""


def q64_requests(spark, d):
    n = F.col("n")
    none = F.array().cast("array<string>")
    r = parts(spark, d).select(n.alias("request"), choose(n, "X", "Y", "Z").alias("database"), choose(n, "t", "t", "t", " ").alias("table"), F.when(n % 7 == 0, F.array(F.lit("1"))).otherwise(none).alias("stocks"), none.alias("fields"), choose(n, "csv", "csv", "csv", "csv", "pdf").alias("format"))
    s = queues.confirm_summary(parts(spark, d).select(n.alias("request"), F.concat(F.lit("A "), F.when(n % 2 == 0, "B ").otherwise(""), F.when(n % 3 == 0, "C").otherwise("")).alias("text")), ["A", "B", "C"])
    return queues.check_requests(r, ["X", "Y"], ["csv", "txt"]).join(s, "request")


Q64R = f"WITH {P} SELECT n AS request, CASE WHEN n % 3 = 2 THEN 'UNKNOWN_DATABASE' WHEN n % 4 = 3 THEN 'NO_TABLE' WHEN n % 5 = 4 THEN 'UNKNOWN_FORMAT' WHEN n % 7 = 0 THEN 'NOT_A_WHOLE_TABLE' END AS problem, CASE WHEN n % 2 = 1 THEN 'B' WHEN n % 3 > 0 THEN 'C' END AS missing FROM p"


def q64_headers(spark, d):
    n = F.col("n")
    text = F.concat(F.lit("已选择 "), n % 9, F.lit(" 项 "), F.when(n % 2 == 0, F.concat(F.lit("预估数据："), F.format_number(n * 1000, 0), F.lit(" 行"))).otherwise(""), F.lit(" 总记录数 "), n)
    lines = F.concat(F.lit("- AB_1 x "), choose(n, "2026-01-31", "2027-01-31"), F.lit("\n- CD y\n- AB_1 z 2020-01-01\n- EF 2025-12-"), 10 + n % 9)
    box = F.concat((1 + n % 3).cast("string"), F.lit(" databases:\na\tb\n"), F.when(n % 2 == 0, "c").otherwise(""))
    years = choose(n, "2010-2013", "2013年-2010年", "2015", "none")
    x = parts(spark, d).select("n", queues.header_counts(text).alias("h"), queues.subscriptions(lines).alias("s"), F.array_join(queues.permitted(box), ",").alias("permitted"), F.array_join(queues.year_range(years), ",").alias("years"))
    return x.select("n", "h.*", F.map_keys("s").alias("codes"), "s", "permitted", "years").select("n", "selected", "estimate", "total", F.array_join("codes", ",").alias("codes"), F.element_at("s", "AB_1").alias("until"), "permitted", "years")


Q64H = f"""WITH {P} SELECT n, n % 9 AS selected, CASE WHEN n % 2 = 0 THEN n * 1000 END AS estimate, n AS total, 'AB_1,EF' AS codes, {pick('n', '2026-01-31', '2027-01-31')} AS until,
  CASE WHEN n % 2 = 0 AND n % 3 = 2 THEN 'a,b,c' WHEN n % 2 = 1 AND n % 3 = 1 THEN 'a,b' END AS permitted, {pick('n', '2010,2011,2012,2013', '', '2015', '')} AS years FROM p"""


def q64_long(spark, d):
    n = F.col("n")
    wide = parts(spark, d).select(F.col("name").alias("indicator"), F.concat(F.lit("r"), n).alias("region"), *[F.when(n % k > 0, (n * y).cast("double")).alias(f"y{y}") for k, y in ((2, 2010), (3, 2011), (5, 2012))])
    return queues.long_format(wide, [2010, 2011, 2012])


Q64L = f"WITH {P} SELECT name AS indicator, 'r' || n AS region, year, (n * year)::DOUBLE AS value FROM p, (VALUES (2, 2010), (3, 2011), (5, 2012)) v(k, year) WHERE n % k > 0"


def q64_tables(spark, d):
    """Rows of a table of tasks, and the links that tables are picked by."""
    n = F.col("n")
    html = F.concat(F.lit('<table><tr class="head"><td>x</td></tr><tr class="odd tableShow"><td> <a href="/t">T'), n, F.lit("</a></td><td>"), n % 3, F.lit('</td></tr><tr class="tableShow"><td>z</td></tr></table>'))
    rows = queues.table_rows(parts(spark, d).select(n.alias("page_id"), html.alias("html")))
    hits = parts(spark, d).select(F.floor(n / 4).alias("request"), choose(F.floor(n / 4), "A", "B").alias("code"), choose(n, "X", "Y", "Z").alias("database"), F.concat(F.lit("/h"), F.floor(n / 2)).alias("href"))
    picked = queues.pick_table(hits, parts(spark, d).select((n - 1).alias("request"), choose(n - 1, "A", "B").alias("code"), F.when(n % 24 < 12, F.array(F.lit("X"))).otherwise(F.array(F.lit("X"), F.lit("Y"))).alias("databases")))
    return rows.select(F.lit("row").alias("kind"), F.concat_ws("-", "page_id", "row").alias("key"), F.array_join("cells", "|").alias("value")).unionByName(picked.select(F.lit("pick").alias("kind"), F.col("request").cast("string").alias("key"), F.concat_ws(" ", "outcome", "href").alias("value")))


Q64B = f"""WITH {P}, h AS (SELECT n // 4 AS request, n // 2 AS href, n % 3 AS b FROM p), w AS (SELECT n - 1 AS request, CASE WHEN n % 24 < 12 THEN 1 ELSE 2 END AS bs FROM p
), g AS (SELECT request, count(DISTINCT href) AS c, min('/h' || href) AS href FROM h JOIN w USING (request) WHERE b < bs GROUP BY request)
SELECT 'row' AS kind, n || '-0' AS key, 'T' || n || '|' || n % 3 AS value FROM p UNION ALL SELECT 'row', n || '-1', 'z' FROM p UNION ALL SELECT 'pick', request::VARCHAR, CASE WHEN c = 1 THEN 'PICKED ' || href WHEN c > 1 THEN 'AMBIGUOUS' ELSE 'NONE' END FROM w LEFT JOIN g USING (request)"""


def q65_queues(spark, d):
    """Batches that are refused, and why."""
    n = F.col("n")
    batch = F.when(n <= 40, F.lit(0)).otherwise(1 + n % 50)
    i = parts(spark, d).select(batch.alias("batch"), F.when(batch % 7 == 3, F.lit("same")).otherwise(F.concat(F.lit("i"), n)).alias("item"), F.when(batch % 5 == 2, F.lit("One title")).when((batch % 5 == 1) & (batch % 2 == 0), None).otherwise(F.concat(F.lit("T"), n)).alias("title"), F.when((batch % 5 == 1), F.concat(F.lit("10.1000/"), n)).alias("doi"), F.when(batch % 11 == 4, "x").alias("extra"))
    return queues.check_queue(i)


Q65Q = f"""WITH {P}, b AS (SELECT n, CASE WHEN n <= 40 THEN 0 ELSE 1 + n % 50 END AS batch FROM p), g AS (SELECT batch, count(*) AS c FROM b GROUP BY batch)
SELECT batch, CASE WHEN c > 25 THEN 'TOO_MANY' WHEN batch % 11 = 4 THEN 'UNKNOWN_FIELD' WHEN batch % 5 = 1 AND batch % 2 = 1 THEN 'TITLE_XOR_DOI' WHEN batch % 5 = 2 AND c > 1 THEN 'SAME_WORK' WHEN batch % 7 = 3 AND c > 1 THEN 'SAME_ITEM' END AS problem FROM g"""


def q65_accounting(spark, d):
    n = F.col("n")
    batch = F.when(F.floor(n / 64) % 2 == 0, F.floor(n / 2)).otherwise(F.floor(n / 6))
    e = parts(spark, d).select(batch.alias("batch"), n.alias("attempt"), (n % 3 == 0).alias("ok"), (batch % 4 > 0).alias("retryable"), F.lit(2).alias("count"))
    return queues.accounting(parts(spark, d).select((n - 1).alias("batch"), F.when(n % 6 == 1, 1).otherwise(5).alias("budget")), e)


Q65A = f"""WITH {P}, b AS (SELECT n, CASE WHEN n // 64 % 2 = 0 THEN n // 2 ELSE n // 6 END AS batch FROM p), e AS (SELECT batch, n, n % 3 = 0 AS ok, batch % 4 > 0 AS retry FROM b
), l AS (SELECT *, lag(CASE WHEN ok THEN 'd' WHEN retry THEN 'a' ELSE 's' END) OVER (PARTITION BY batch ORDER BY n) AS after FROM e), g AS (SELECT batch, sum(CASE WHEN ok THEN 2 ELSE 0 END) AS done, count(*) AS attempts, bool_or(coalesce(after <> 'a', false)) AS odd FROM l GROUP BY batch
), w AS (SELECT n - 1 AS batch, CASE WHEN n % 6 = 1 THEN 1 ELSE 5 END AS budget, coalesce(done, 0)::BIGINT AS done, coalesce(attempts, 0) AS attempts, coalesce(odd, false) AS odd FROM p LEFT JOIN g ON batch = n - 1)
SELECT batch, done, attempts, CASE WHEN done > budget THEN 'OVER_BUDGET' WHEN odd THEN 'RETRIED_WRONGLY' WHEN attempts > 4 THEN 'TOO_MANY_RETRIES' WHEN done > 0 THEN 'DONE' ELSE 'NOTHING' END AS verdict FROM w"""


def q65_preflight(spark, d):
    k = F.col("s_suppkey")
    return queues.preflight(table(spark, d, "supplier").select(k.alias("source"), k.alias("position"), choose(k, "READY", "READY", "NOT_READY", "ACTION_REQUIRED", "READY").alias("state"), (k % 7).alias("candidates")), 11)


Q65P = """WITH s AS (SELECT s_suppkey AS k, s_suppkey % 5 AS m, CASE WHEN s_suppkey % 5 IN (0, 1, 4) THEN s_suppkey % 7 ELSE 0 END AS c FROM supplier), b AS (SELECT *, coalesce(sum(c) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
SELECT count(*) FILTER (m IN (0, 1, 4)) AS ready, count(*) FILTER (m = 2) AS not_ready, count(*) FILTER (m = 3) AS action, bool_and(m IN (0, 1, 4)) AS cleared, sum(greatest(0, least(c, 11 - before)))::BIGINT AS formal FROM b"""


def q65_acquire(spark, d):
    n = F.col("n")
    return queues.acquire(parts(spark, d).select(n.alias("doc_id"), choose(n, "KEEP", "MAYBE").alias("decision"), (n % 3 == 0).alias("duplicate"), choose(n, "VERIFIED", "VERIFIED", "CONFLICT").alias("identity")))


Q65C = f"WITH {P} SELECT n AS doc_id FROM p WHERE n % 2 = 0 AND n % 3 = 1"


def q66_doctor(spark, d):
    n = F.col("n")
    return queues.doctor(parts(spark, d).select((n % 40).alias("host"), n.alias("position"), choose(n, "ENVIRONMENT", "CAPABILITY").alias("kind"), (n % 3 == 0).alias("blocking"), ((n % 40 % 5 > 0) | (n % 8 == 0)).alias("ok")))


Q66D = f"""WITH {P}, f AS (SELECT n % 40 AS host, n, n % 2 AS kind, n % 3 = 0 AS blocking FROM p WHERE n % 40 % 5 = 0 AND n % 8 > 0), g AS (SELECT host, arg_min(kind, n) FILTER (blocking) AS kind FROM f GROUP BY host)
SELECT h.host, CASE WHEN kind = 0 THEN 'ENVIRONMENT_FAILED' WHEN kind = 1 THEN 'CAPABILITY_MISSING' WHEN g.host IS NOT NULL THEN 'READY_WITH_WARNINGS' ELSE 'READY' END AS verdict FROM (SELECT DISTINCT n % 40 AS host FROM p) h LEFT JOIN g USING (host)"""


def q66_states(spark, d):
    """Files after a move, topics after a change, packs against what is held, and whether an index may be built."""
    n = F.col("n")
    p = parts(spark, d)
    path = F.concat(choose(n, "library", "Cache", "x"), F.lit("/"), n)
    moved = queues.relocated(p.select(path.alias("path"), F.col("name").alias("sha256")), p.where("n % 5 > 0").select(path.alias("path"), F.when(n % 7 == 0, "y").otherwise(F.col("name")).alias("sha256")))
    undone = queues.recovery(p.select(n.alias("doc_id"), F.lit("a").alias("before"), F.lit("b").alias("after")), p.select(n.alias("doc_id"), choose(n, "a", "b", "c").alias("topics")))
    pack = queues.validate_pack(p.select(n.alias("place"), n.alias("doc_id"), F.col("name").alias("sha256")), p.where("n % 4 > 0").select(n.alias("doc_id"), F.when(n % 9 == 1, "z").otherwise(F.col("name")).alias("sha256")))
    build = index.may_build(p.select(choose(n, "OK", "FAILED", "FILE_MISSING", "OK", "UNREADABLE", "FAILED").alias("outcome")))
    one = lambda df, kind, *c: df.groupBy(F.lit(kind).alias("kind"), F.concat_ws(" ", *c).alias("what")).agg(F.count("*").alias("n"))
    return one(moved, "moved", "kind", "outcome").unionByName(one(undone, "undone", "action")).unionByName(one(pack, "pack", "outcome")).unionByName(build.select(F.lit("build").alias("kind"), F.col("refused").cast("string").alias("what"), F.col("failed").alias("n")))


Q66S = f"""WITH {P} SELECT 'moved' AS kind, {pick('n', 'LIBRARY', 'DERIVED', 'OTHER')} || CASE WHEN n % 5 = 0 THEN ' MISSING' WHEN n % 7 = 0 THEN ' CHANGED' ELSE ' SAME' END AS what, count(*) AS n FROM p GROUP BY 1, 2
UNION ALL SELECT 'undone', {pick('n', 'NOTHING', 'RESTORE', 'REFUSE')}, count(*) FROM p GROUP BY 1, 2 UNION ALL SELECT 'pack', CASE WHEN n % 4 = 0 THEN 'GONE' WHEN n % 9 = 1 THEN 'CHANGED' ELSE 'VALID' END, count(*) FROM p GROUP BY 1, 2
UNION ALL SELECT 'build', (2 * count(*) FILTER (n % 6 IN (1, 4, 5)) > count(*) FILTER (n % 6 <> 2))::VARCHAR, count(*) FILTER (n % 6 IN (1, 4, 5)) FROM p"""

_ALL = (
    (q61_keywords, Q61K), (q61_file_names, Q61F), (q61_topic_field, Q61T), (q61_titles, Q61S), (q61_spaced_dois, Q61D), (q61_controls, Q61C), (q61_redacted, Q61R), (q62_access, Q62A), (q62_controls, Q62C), (q62_visibility, Q62V), (q62_challenge, Q62H), (q62_static_challenge, Q62S),
    (q62_page_lock, Q62P), (q62_identity, Q62I), (q62_first_page, Q62F), (q63_results, Q63R), (q63_snapshots, Q63S), (q63_page_kinds, Q63K), (q63_detail_locks, Q63D), (q63_same_records, Q63M), (q64_arrivals, Q64A), (q64_entries, Q64E), (q64_tasks, Q64T),
    (q64_requests, Q64R), (q64_headers, Q64H), (q64_long, Q64L), (q64_tables, Q64B), (q65_queues, Q65Q), (q65_accounting, Q65A), (q65_preflight, Q65P), (q65_acquire, Q65C), (q66_doctor, Q66D), (q66_states, Q66S),
)
QUERIES = {f.__name__: f for f, _ in _ALL}
ORACLES = {f.__name__: sql for f, sql in _ALL}
