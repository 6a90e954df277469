"""q63_scope, q67: markup and JSON as rows, and what pages and requests say in them. Pages are the table's, or made of the tables' rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import access, markup, nested
from lectern.operators import pages as pages_of
from lectern.plans.facts import P, choose, parts
from lectern.sources.tables import table


def q67_markup(spark, d):
    """Elements of every page by name, with how many say something and how many are links to a place of the same page."""
    held = markup.elements(table(spark, d, "pages"))
    seen = held.where(F.col("name").isin("a", "p", "li", "div", "article", "meta", "title", "h1"))
    return seen.groupBy("page_id", "name").agg(F.count("*").alias("elements"), F.count_if(F.size("classes") > 0).alias("classed"))


Q67 = r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<(?:script|style)\b.*?</(?:script|style)>', '', 'g') AS html FROM pages
), t AS (SELECT page_id, unnest(regexp_extract_all(html, '<[a-zA-Z][^>]*>')) AS tag FROM p), n AS (SELECT page_id, lower(regexp_extract(tag, '<([a-zA-Z0-9]+)', 1)) AS name, regexp_extract(tag, '\sclass=["'']?([^"''>]*)', 1) AS classes FROM t)
SELECT page_id, name, count(*) AS elements, count(*) FILTER (trim(classes) <> '') AS classed FROM n WHERE name IN ('a', 'p', 'li', 'div', 'article', 'meta', 'title', 'h1') GROUP BY ALL"""


def q67_articles(spark, d):
    """Article facts of pages with heads and bylines of three kinds before their own markup: quotes, cases and nesting vary by the number."""
    k = F.col("p_partkey")
    name = F.col("p_name")
    meta = F.concat(F.lit("<html lang=en><META content='"), name, F.lit("' NAME=dc.title><meta name=citation_author content=\"A &amp; "), k, F.lit("\"><meta property='citation_author' content='B'><meta name='prism.doi' content='doi:10.1000/P"), k, F.lit("'><meta content=J name=\"citation_journal_title\"></html>"))
    graph = F.concat(F.lit("<script type='application/LD+json'>{\"@graph\": [{\"@type\": \"Organization\", \"name\": \"O\"}, {\"name\": \""), name, F.lit("\", \"keywords\": [\"x\", \"y; z\"], \"@type\": [\"Thing\", \"ScholarlyArticle\"], \"author\": [{\"name\": \"C "), k, F.lit("\"}, {\"name\": \"D\"}]}]}</script>"))
    byline = F.concat(F.lit("<h1>Of <i>"), name, F.lit("</i></h1><div id=author-group><div><span class='given-name'>E</span> <span class=\"text surname\">"), k, F.lit("</span></div><span class=surname>F</span></div><span class=surname>G</span>"))
    # A page is many times the row that it is made of: rows are dealt out before.
    made = table(spark, d, "part").select("p_partkey", "p_name").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey").select(k.alias("page_id"), F.when(k % 3 == 0, meta).when(k % 3 == 1, graph).otherwise(byline).alias("html"), F.concat(F.lit("https://a.example/doi/10.1234/U"), k).alias("url"))
    a = markup.article(made, F.when(F.col("page_id") % 2 == 0, F.col("url")))
    return a.select("page_id", "title", F.array_join("authors", "|").alias("authors"), "journal", "doi", F.array_join("keywords", "|").alias("keywords"), "status", "language")


Q67A = """SELECT p_partkey AS page_id, CASE WHEN p_partkey % 3 = 2 THEN 'Of ' || p_name ELSE p_name END AS title, CASE p_partkey % 3 WHEN 0 THEN 'A & ' || p_partkey || '|B' WHEN 1 THEN 'C ' || p_partkey || '|D' ELSE 'E ' || p_partkey || '|F' END AS authors,
  CASE WHEN p_partkey % 3 = 0 THEN 'J' END AS journal, CASE WHEN p_partkey % 3 = 0 THEN '10.1000/p' || p_partkey WHEN p_partkey % 2 = 0 THEN '10.1234/u' || p_partkey END AS doi, CASE WHEN p_partkey % 3 = 1 THEN 'x|y|z' ELSE '' END AS keywords,
  CASE WHEN p_partkey % 3 = 0 THEN 'PeerReviewedJournalArticle' ELSE 'Unknown' END AS status, CASE WHEN p_partkey % 3 = 0 THEN 'en' END AS language FROM part"""


def orders_of_customers(spark, d):
    """page_id, orders: each customer's orders by their number. Pages are made of them after they have met, as a page is many times its orders; the
    customers are dealt over all tasks, as their pages are read there."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_custkey")
    return orders.groupBy(F.col("o_custkey").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority", "o_orderdate"))).alias("orders"))


def q67_listing(spark, d):
    """Rows of one result table a customer, made of the customer's orders, with cells left open, quotes of each kind and links beside the title's."""
    row = lambda k, priority, date: F.concat(
        F.lit("<tr><td class=seq>"), k, F.lit("<td class='name'><a class=icon href='/detail?other'>x</a> <a class='x fz14' href=\"/detail?id="), k, F.lit("&amp;db=1\">Order <em>"), k, F.lit("</em> of "), priority, F.lit("</a>"),
        F.when(k % 4 == 0, "<b class='marktip'>网络首发</b>").otherwise(""), F.lit("<a href=/elsewhere>y</a></td><td class=\"author\">A "), k, F.lit("；B,A "), k, F.lit("<td class='source'><p>"), priority, F.lit("</p></td><td class=date>"), date.cast("date").cast("string"),
        F.lit("<td class=data>"), choose(k, "期 刊", "博士", "", "期刊", ""), F.lit("<i data-dbname=' cjfq '></i>"), F.when(k % 3 == 0, "<i data-dbname=CDFD></i>").otherwise(""), F.lit("<tr class=note><td class=name>no link</td></tr>"),
    )
    pages = orders_of_customers(spark, d)
    html = F.concat(F.lit("<table><tr><td class=name><a href='/head'>head</a><tbody>"), F.array_join(F.transform("orders", lambda o: row(o["o_orderkey"], o["o_orderpriority"], o["o_orderdate"])), ""), F.lit("</table><li><a class=fz14 href='/detail?id=0'>beside</a>"))
    found = markup.listing_rows(pages.select("page_id", html.alias("html")), lambda href: href.startswith("/detail?"))
    return found.select("page_id", "position", "title", "href", "source", "year", "label", F.array_join("products", ",").alias("products"), "online_first", F.array_join("authors", "|").alias("authors"), "journal_article")


Q67L = """SELECT o_custkey AS page_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS position, 'Order ' || o_orderkey || ' of ' || o_orderpriority AS title, '/detail?id=' || o_orderkey || '&db=1' AS href, o_orderpriority AS source, year(o_orderdate)::VARCHAR AS year,
  CASE o_orderkey % 5 WHEN 0 THEN '期刊' WHEN 1 THEN '博士' WHEN 3 THEN '期刊' ELSE '' END AS label, CASE WHEN o_orderkey % 3 = 0 THEN 'CJFQ,CDFD' ELSE 'CJFQ' END AS products, o_orderkey % 4 = 0 AS online_first, 'A ' || o_orderkey || '|B' AS authors, o_orderkey % 5 <> 1 AND o_orderkey % 3 > 0 AS journal_article FROM orders"""


def q63_scope(spark, d):
    """What searches really asked for, and which are refused: for more than journals, or because they do not say. Keys vary in order, number and case."""
    n, name = F.col("n"), F.to_json(F.struct(F.concat(F.lit('say "'), F.col("name"), F.lit('" \\ {now}')).alias("v")))
    value = F.regexp_extract(name, r'^\{"v":(.*)\}$', 1)
    kind = choose(n, "JOURNAL", "THESIS", " journal ")
    of = choose(n, '{"Value": "%s", "Field": "SCOPE"}', '{"field": "scope", "Title": "x", "extra": [1, {"a": null}], "value": "%s"}', '{"Title": {"Value": "t"}, "Field": "SCOPE", "Operator": "AND", "Value": "%s"}', '{"Field": "SCOPE", "Value": ""}')
    body = F.concat(F.lit('{"q": [{"a": '), F.replace(of, F.lit("%s"), kind), F.lit('}, [[{"Operator": "OR", "Value": '), value, F.lit(', "Field": "ti"}]]]}'))
    requests = parts(spark, d).select(n.alias("request"), F.when(n % 11 == 5, F.substring(body, F.lit(1), F.length(body) - 1)).otherwise(body).alias("json"))
    said = access.scope(requests)
    return access.journals_only(requests, said).join(said.where("field = 'TI'").select("request", F.col("value").alias("title")), "request", "left")


Q63C = f"""WITH {P} SELECT n AS request, CASE WHEN n % 11 <> 5 THEN 'say "' || name || '" \\ {{now}}' END AS title, n % 11 = 5 OR n % 4 = 3 OR n % 3 = 1 AS refused FROM p"""


def q67_executed(spark, d):
    """What result pages say that was searched: JSON in JSON, by databases or by class and resource, with the conditions of its tree in order."""
    n = F.col("n")
    tree = F.concat(F.lit('{"qgroup": [{"items": [{"field": "su", "title": "主题", "value": "'), F.col("name"), F.lit('"}, {"value": 5, "field": " ly "}, {"field": "", "value": "x"}]}]}'))
    inner = F.concat(choose(n, '{"kuaKuCode": "ystt4hg0"', '{"classid": "YSTT4HG0", "resource": "journal"', '{"kuaKuCode": "YSTT4HG0,LSTPFY1C"', '{"Products": "CJFQ"'), choose(n, "", ', "Products": "CJFQ,CAPJ"', ', "Products": "CDFD"'), F.lit(', "qnode": '), tree, F.lit("}"))
    # The same object, once under its name and once as a text.
    quoted = F.regexp_extract(F.to_json(F.struct(inner.alias("v"))), r'^\{"v":(.*)\}$', 1)
    outer = F.concat(F.lit('{"searchFrom": "x", "queryJson": '), F.when(n % 2 == 0, inner).otherwise(quoted), F.lit("}"))
    made = parts(spark, d).where("n % 4 < 3 OR n % 3 <> 1").select(n.alias("request"), F.when(n % 13 == 7, "[1]").when(n % 13 == 8, "{").otherwise(outer).alias("json"))
    return access.executed(made).select("request", F.array_join("cross", ",").alias("cross"), F.array_join("conditions", " AND ").alias("conditions"), "journals")


Q67E = f"""WITH {P}, r AS (SELECT n, name, n % 13 IN (7, 8) AS bad FROM p WHERE n % 4 < 3 OR n % 3 <> 1)
SELECT n AS request, CASE WHEN n % 13 = 8 THEN NULL WHEN bad THEN '' WHEN n % 4 = 0 THEN 'YSTT4HG0' WHEN n % 4 = 2 THEN 'LSTPFY1C,YSTT4HG0' ELSE '' END AS "cross",
  CASE WHEN bad THEN '' ELSE 'SU=' || name || ' AND LY=5' END AS conditions, CASE WHEN NOT bad THEN n % 4 < 2 AND n % 3 < 2 END AS journals FROM r"""


def q67_redacted(spark, d):
    """Requests of nested JSON with their secrets withheld, and which may not be sent at all."""
    n = F.col("n")
    deep = F.concat(F.lit('{"b": [{"note": "token: abc '), F.col("name"), F.lit('", "list": [1, true, null, "https://u:p@h.example/x?k=1"]}], "a": {"'), choose(n, "Access-Key", "name", "Session Id", "auth_header"), F.lit('": '), choose(n, '"s3"', "false", "null", '{"x": 1}', "[7]"), F.lit("}}"))
    rows = parts(spark, d).select(n.alias("request"), F.when(n % 17 == 3, "not json").otherwise(deep).alias("json"))
    return nested.forbidden(rows, "request").join(rows.select("request", nested.redact("json").alias("json")), "request")


Q67R = f"""WITH {P}, k AS (SELECT n, name, CASE n % 4 WHEN 0 THEN 'Access-Key' WHEN 1 THEN 'name' WHEN 2 THEN 'Session Id' ELSE 'auth_header' END AS key, CASE n % 5 WHEN 0 THEN '"s3"' WHEN 1 THEN 'false' WHEN 2 THEN 'null' WHEN 3 THEN '{{"x":1}}' ELSE '[7]' END AS v FROM p)
SELECT n AS request, n % 17 = 3 OR n % 4 <> 1 AS refused, CASE WHEN n % 17 <> 3 THEN '{{"a":{{"' || key || '":' || CASE WHEN n % 4 = 1 OR n % 5 IN (1, 2) THEN v ELSE '"<REDACTED>"' END || '}},"b":[{{"list":[1,true,null,"https://h.example/x"],"note":"token=<REDACTED> ' || name || '"}}]}}' END AS json FROM k"""

def result_pages(spark, d):
    """page_id, html: a result table for each customer, of the customer's orders, each of them twice where its number is divisible by 7."""
    row = lambda k, priority, date: F.concat(
        F.lit("<tr><td class=name><a class=fz14 href='/detail?id="), k, F.lit("'>Order "), k, F.lit("</a><td class=source>Journal of "), F.substring(priority, F.lit(1), F.lit(1)), F.lit("!<td class=date>"), F.when(k % 9 == 4, "soon").otherwise(date.cast("date").cast("string")), F.lit("<td class=data>"),
        F.when(F.col("page_id") % 31 == 2, F.when(k % 5 == 0, "博士").otherwise("期刊")).when((F.col("page_id") % 31 == 3) & (k % 5 == 0), "").otherwise("期刊"), F.lit("</tr>"),
    )
    twice = lambda o, made: F.when(o["o_orderkey"] % 7 == 0, F.concat(made, made)).otherwise(made)
    rows = F.transform("orders", lambda o: twice(o, row(o["o_orderkey"], o["o_orderpriority"], o["o_orderdate"])))
    return orders_of_customers(spark, d).select("page_id", F.concat(F.lit("<table>"), F.array_join(rows, ""), F.lit("</table>")).alias("html"))


def q34_restricted(spark, d):
    """Rows of result pages for searches of journals alone: which are kept, and why the others are not."""
    n = F.col("page_id")
    pages = result_pages(spark, d)
    scopes = pages.where("page_id % 17 <> 5").select("page_id", (n % 19 != 6).alias("journals"))
    asked = pages.select("page_id", F.when(n % 3 == 0, "journal OF 1").alias("journal"), F.when(n % 2 == 0, 1994).alias("first"), F.when(n % 4 == 0, 1996).alias("last"), F.lit(6).alias("most"))
    return markup.restricted(markup.listing_rows(pages, lambda href: href.startswith("/detail?")), scopes, asked).groupBy("page_id", "verdict").agg(F.count("*").alias("n"), F.min("position").alias("first"))


Q34R = """WITH o AS (SELECT o_custkey AS p, o_orderkey AS k, o_orderpriority, o_orderdate, unnest(range(CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 1 END)) AS twin FROM orders
), r AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY k, twin) - 1 AS pos, p % 31 = 2 AND k % 5 = 0 AS other, p % 31 = 3 AND k % 5 = 0 AS unsure, CASE WHEN k % 9 <> 4 THEN year(o_orderdate) END AS y FROM o
), v AS (SELECT *, CASE WHEN p % 17 = 5 OR p % 19 = 6 THEN 'REFUSED_SCOPE' WHEN bool_or(other) OVER (PARTITION BY p) THEN 'REFUSED_TYPE' WHEN bool_or(unsure) OVER (PARTITION BY p) THEN 'REFUSED_UNCONFIRMED' WHEN p % 3 = 0 AND substr(o_orderpriority, 1, 1) <> '1' THEN 'OTHER_SOURCE'
  WHEN p % 2 = 0 AND y IS NULL THEN 'YEAR_UNREADABLE' WHEN (p % 2 = 0 AND y < 1994) OR (p % 4 = 0 AND y > 1996) THEN 'OUTSIDE_YEARS' WHEN twin = 1 THEN 'DUPLICATE' END AS why FROM r
), w AS (SELECT *, sum((why IS NULL)::INT) OVER (PARTITION BY p ORDER BY pos) AS place FROM v)
SELECT p AS page_id, coalesce(why, CASE WHEN place > 6 THEN 'BEYOND_LIMIT' ELSE 'KEPT' END) AS verdict, count(*) AS n, CAST(min(pos) AS INTEGER) AS first FROM w GROUP BY 1, 2"""


def linked_pages(spark, d):
    k = F.col("page_id")
    links = F.concat(
        F.lit("<a href='//data.example.org/p/"), k, F.lit("?s=1'>x</a><a HREF=\"/list/"), k, F.lit("?q=2\">E P S <i>data</i></a><a href=https://data.example.org/off>EPS Data (Off-Campus)</a><a>none</a><a href='mailto:eps data'>EPS data</a>"),
        F.when(k % 3 == 0, F.concat(F.lit("<a aria-label='eps DATA' href='//data.example.org/p/"), k, F.lit("#z'>y</a>"))).otherwise(""),
    )
    return table(spark, d, "pages").select("page_id", "url", F.concat(links, "html").alias("html"))


def q33_discover(spark, d):
    """Links of pages to a database, by its name, its hosts or both, each address once."""
    found = pages_of.discover(linked_pages(spark, d), ["EPS data"], ["data.example.org"], ["example.com"])
    return found.select("page_id", "url", "basis", "confidence", "name")


Q33D = r"""WITH p AS (SELECT page_id AS k, regexp_extract(url, '^([a-z]+:)//', 1) AS scheme, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS root FROM pages)
SELECT k AS page_id, scheme || '//data.example.org/p/' || k AS url, CASE WHEN k % 3 = 0 THEN 'database-name+official-domain' ELSE 'official-domain' END AS basis, CASE WHEN k % 3 = 0 THEN 120 ELSE 90 END AS confidence, CASE WHEN k % 3 = 0 THEN 'y eps DATA' ELSE 'x' END AS name FROM p
UNION ALL SELECT k, root || '/list/' || k, 'database-name+trusted-page', 100, 'E P S data' FROM p WHERE host = 'example.com' OR ends_with(host, '.example.com')"""


def q33_evidence(spark, d):
    """Pages with an address that they say is theirs, on official, allowed or other hosts, and what bars some of them."""
    k = F.col("page_id")
    head = choose(k, "<link href='https://own.example.org/a' rel='alternate Canonical'>", "<link rel=canonical href=/relative>", "<link rel=\"stylesheet\" href='https://own.example.org/b'>", "")
    body = choose(k, "", "<p>Please log in</p>", "<script>captcha</script>", "<b>Security check</b>", "Subscription required")
    made = table(spark, d, "pages").select("page_id", "url", F.concat(head, body).alias("html"), F.when(k % 11 == 3, 403).otherwise(200).alias("status"))
    return pages_of.official_evidence(made, ["tionsh.example.net"], ["example.com"])


Q33E = r"""WITH p AS (SELECT page_id AS k, url, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\.', ''), '\.$', '') AS h FROM pages)
SELECT k AS page_id, h AS domain, CASE WHEN k % 4 = 0 THEN 'https://own.example.org/a' ELSE url END AS canonical, CASE WHEN h = 'tionsh.example.net' OR ends_with(h, '.tionsh.example.net') THEN 'CONFIRMED' WHEN h = 'example.com' OR ends_with(h, '.example.com') THEN 'PROBABLE' ELSE 'UNVERIFIED' END AS state,
  CASE WHEN regexp_matches(lower(url), '/login|/signin|/sign-in|/sso|/auth/') OR k % 5 = 1 THEN 'LOGIN' WHEN k % 5 = 3 THEN 'CHALLENGE' WHEN k % 11 = 3 OR k % 5 = 4 THEN 'RESTRICTED' END AS gate FROM p"""


def q36_members(spark, d):
    """Cube requests whose regions name a group among others, with its members in its place."""
    k = F.col("s_suppkey")
    r = table(spark, d, "supplier").select(k.alias("request"), choose(k, 0, 1, 2).alias("form"))
    r = r.select("request", F.when(F.col("form") == 0, F.array(F.lit("x"), F.lit(" Provinces"), F.lit("北京"))).when(F.col("form") == 1, F.array(F.lit("湖南 "), F.lit(""), F.lit("PROVINCES"))).otherwise(F.array(F.lit("y"), F.lit("y"))).alias("regions"))
    out = pages_of.expand_members(r)
    return out.select("request", F.size("regions").alias("n"), F.get("regions", F.lit(0)).alias("first"), F.element_at("regions", -1).alias("last"))


Q36M = "SELECT s_suppkey AS request, CAST([32, 31, 1][s_suppkey % 3 + 1] AS INTEGER) AS n, ['x', '湖南', 'y'][s_suppkey % 3 + 1] AS first, ['新疆', '新疆', 'y'][s_suppkey % 3 + 1] AS last FROM supplier"

_ALL = ((q34_restricted, Q34R), (q33_discover, Q33D), (q33_evidence, Q33E), (q36_members, Q36M), (q67_markup, Q67), (q67_articles, Q67A), (q67_listing, Q67L), (q63_scope, Q63C), (q67_executed, Q67E), (q67_redacted, Q67R))
QUERIES = {f.__name__: f for f, _ in _ALL}
ORACLES = {f.__name__: sql for f, sql in _ALL}
