"""q12 to q25: search, lookup, related works, coverage, citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as t
from lectern.operators import access, catalog, classify, index, screening, search
from lectern.plans.text import CHUNKS_SQL, STOPS
from lectern.sources import shared
from lectern.sources.tables import WORKS_SQL, fold_sql, stem_sql, table, works

FIELDS = {"title": 3.0, "topics": 2.5, "authors": 1.6, "journal": 1.0}
WITH_TEXT = FIELDS | {"body": 1.0}
# A small lexicon of the synthetic language: concept, facet, term. One term is Chinese, as some titles below are.
LEXICON = (
    ("onset", "PHENOMENON", "the onth"), ("onset", "PHENOMENON", "ered"), ("heat", "PHENOMENON", "heing"), ("mass", "MECHANISM", "ation"),
    ("mass", "MECHANISM", "of the"), ("tone", "OUTCOME", "tion"), ("tone", "OUTCOME", "que"), ("void", "OUTCOME", "zzzz"), ("way", "METHOD", "der"), ("way", "METHOD", "方法"),
)
LEXICON_SQL = "lexicon(concept, facet, term) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in LEXICON) + ")"
#: The query set of the benchmark: every item whose number is divisible by 100.
ASKED = "item_id % 100 = 0"

#: Works with all that a catalog has: authors, keywords, DOIs of some, topics; every ninth title ends in Chinese.
CATALOG_SQL = f"""{WORKS_SQL}, catalog AS (SELECT doc_id, title || CASE WHEN doc_id % 9 = 0 THEN ' 新方法研究' ELSE '' END AS title, body, year, author, [author, 'author ' || doc_id % 11] AS authors,
  CASE WHEN doc_id % 4 = 0 THEN '10.1000/w' || doc_id END AS doi, journal, domain, subtopic, domain || ' ' || subtopic AS topics, ['k' || doc_id % 13, 'k' || doc_id % 7] AS keywords FROM works)"""


def full(spark, d):
    w, n = works(spark, d), F.col("doc_id")
    return w.select(
        "doc_id", F.concat("title", F.when(n % 9 == 0, " 新方法研究").otherwise("")).alias("title"), "body", "year", "author", F.array("author", F.concat(F.lit("author "), n % 11)).alias("authors"),
        F.when(n % 4 == 0, F.concat(F.lit("10.1000/w"), n)).alias("doi"), "journal", "domain", "subtopic", F.concat_ws(" ", "domain", "subtopic").alias("topics"),
        F.array(F.concat(F.lit("k"), n % 13), F.concat(F.lit("k"), n % 7)).alias("keywords"),
    )


def fields_of(w):
    """What the index holds of a work: its authors, the first of them again, are one field."""
    return w.select("doc_id", "title", "topics", F.concat_ws(" ", "author", "author").alias("authors"), "journal", "body")


_INDEXES: dict[tuple[str, str], tuple[str, tuple]] = {}


def indexed(w):
    return fields_of(w.withColumn("topics", F.concat_ws(" ", "domain", "subtopic")))


def index_of(spark, d):
    """The index of the works of a folder with their passages: made once in a session; where files of the table have changed since, the works that
    are not as the index has them are indexed anew."""
    key = (spark.sparkContext.applicationId, d)
    w = works(spark, d)
    path, seen = _INDEXES.get(key) or (shared.new_path(spark, "index"), None)
    now = shared.state_of_files(w)
    if seen != now:
        index.update(indexed(w), list(WITH_TEXT), path, passages_of="body")
        _INDEXES[key] = path, now
    return index.read(spark, path)


def lexicon(spark):
    return spark.createDataFrame(LEXICON, "concept string, facet string, term string")


def asked(spark, d):
    return table(spark, d, "benchmark").where(ASKED).select(F.col("item_id").alias("query"), "text")


def cjk_sql(folded):
    """The tokens of CJK runs: characters but the function characters, and pairs of neighbours."""
    run = f"[{t.CJK}]+"
    return f"""flatten(list_transform(regexp_extract_all({folded}, '{run}'), lambda r: list_concat(list_filter(string_split(r, ''), lambda c: NOT contains('{t.CJK_STOP}', c)),
      list_transform(range(1, length(r)), lambda i: substr(r, i, 2)))))"""


def tokens_sql(x):
    return f"""list_concat({cjk_sql(fold_sql(x))}, flatten(list_transform(list_filter(regexp_extract_all({fold_sql(x)}, '[0-9a-z]+'), lambda w: w NOT IN ({STOPS})), lambda w: CASE WHEN ({stem_sql("w")}) = w THEN [w] ELSE [w, {stem_sql("w")}] END)))"""


def bm25_sql(terms, fields, rows="works", name="", topics="domain || ' ' || subtopic"):
    """CTEs parts (query, doc_id, token, field, c) and scored (query, doc_id, score) of terms (query, token, weight)."""
    text = {"title": "title", "topics": topics, "authors": "author || ' ' || author", "journal": "journal", "body": "body"}
    raw = " UNION ALL ".join(f"SELECT doc_id, '{f}' AS field, {w}::DOUBLE AS w, {tokens_sql(text[f])} AS ts FROM {rows}" for f, w in fields.items())
    return f"""raw{name} AS ({raw}
), lens{name} AS (SELECT doc_id, field, w, ts, len(ts)::DOUBLE AS len FROM raw{name}
), avgs{name} AS (SELECT field, sum(len) / (SELECT count(*) FROM {rows}) AS avg_len FROM lens{name} GROUP BY field
), tf{name} AS (SELECT query, weight, doc_id, field, w, len, token, count(*) AS tf FROM (SELECT doc_id, field, w, len, unnest(ts) AS token FROM lens{name}) JOIN {terms} USING (token) GROUP BY ALL
), idf{name} AS (SELECT token, greatest(0.05, ln(1 + ((SELECT count(*) FROM {rows}) - df + 0.5) / (df + 0.5))) AS idf FROM (SELECT token, count(DISTINCT doc_id) AS df FROM tf{name} GROUP BY token)
), x{name} AS (SELECT query, weight, doc_id, token, field, w * tf / (1 - 0.75 + 0.75 * len / avg_len) AS x FROM tf{name} JOIN avgs{name} USING (field)
), parts{name} AS (SELECT query, doc_id, token, field, idf * total / (1.2 + total) * 2.2 * weight * x / total AS c FROM (SELECT *, sum(x) OVER (PARTITION BY query, doc_id, token) AS total FROM x{name}) JOIN idf{name} USING (token)
), scored{name} AS (SELECT query, doc_id, round(sum(c), 6) AS score FROM parts{name} GROUP BY query, doc_id)"""


TERMS_SQL = f"terms AS (SELECT DISTINCT item_id AS query, unnest({tokens_sql('text')}) AS token, 1.0 AS weight FROM benchmark WHERE {ASKED})"
BM25_SQL = f"{WORKS_SQL}, {TERMS_SQL}, {bm25_sql('terms', WITH_TEXT)}"


def q12_query_terms(spark, d):
    items = table(spark, d, "benchmark").select("item_id", search.query_terms(F.col("text")).alias("ts"))
    best = F.array_sort("ts", lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    return items.select("item_id", F.size("ts").alias("n"), F.array_join(F.slice(F.filter(best, lambda w: F.length(w) > 1), 1, 5), " ").alias("display"))


Q12 = f"""WITH x AS (SELECT item_id, list_distinct({tokens_sql("text")}) AS ts FROM benchmark
), u AS (SELECT item_id, unnest(ts) AS w FROM x), r AS (SELECT item_id, w, row_number() OVER (PARTITION BY item_id ORDER BY length(w) DESC, w) AS k FROM u WHERE length(w) > 1)
SELECT item_id, CAST(len(ts) AS INTEGER) AS n, (SELECT string_agg(w, ' ' ORDER BY k) FROM r WHERE r.item_id = x.item_id AND k <= 5) AS display FROM x"""


def q12_parse(spark, d):
    """Queries with fields, a DOI or an id, made of each item of the benchmark."""
    k = F.col("item_id")
    form = F.concat_ws(" ", F.substring_index("text", " ", 3), F.when(k % 2 == 0, F.concat(F.lit("year:"), 1990 + k % 30, F.lit(" 2011"))), F.when(k % 3 == 0, F.concat(F.lit("Author:Li Ming journal:Src"), k % 5)), F.when(k % 5 == 0, F.concat(F.lit("doi:10.1234/AB."), k)), F.when(k % 7 == 0, F.lit("P0123456789AB")))
    p = search.parse(table(spark, d, "benchmark").select(k.alias("query"), form.alias("text")))
    return p.select("query", F.size("tokens").alias("n"), "doi", "id", F.array_join("years", " ").alias("years"), F.array_join("authors", "|").alias("authors"), F.try_element_at("filters", F.lit("journal")).alias("journal"), "exact")


Q12P = f"""WITH x AS (SELECT item_id AS k, array_to_string(list_slice(string_split(text, ' '), 1, 3), ' ') AS words FROM benchmark)
SELECT k AS query, CAST(len(list_distinct({tokens_sql("CASE WHEN k % 2 = 1 AND k % 3 > 0 AND k % 5 > 0 AND k % 7 = 0 THEN words || ' P0123456789AB' ELSE words END")})) AS INTEGER) AS n, CASE WHEN k % 5 = 0 THEN '10.1234/ab.' || k END AS doi,
  CASE WHEN k % 7 = 0 THEN 'P0123456789AB' END AS id, CASE WHEN k % 2 = 1 THEN array_to_string(list_distinct(regexp_extract_all(words, '\\b(?:19|20)\\d{{2}}\\b')), ' ') WHEN 1990 + k % 30 = 2011 THEN '2011' ELSE (1990 + k % 30) || ' 2011' END AS years,
  CASE WHEN k % 3 = 0 THEN 'li ming' ELSE '' END AS authors, CASE WHEN k % 3 = 0 THEN 'Src' || k % 5 || CASE WHEN k % 5 > 0 AND k % 7 = 0 THEN ' P0123456789AB' ELSE '' END END AS journal, k % 5 = 0 OR k % 7 = 0 AS exact FROM x"""


def q12_expansion(spark, d):
    """Weighted terms of each item: its own, those of other words for its concepts, those of its concepts' topics."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text")
    x = lexicon(spark).withColumn("topic", F.when(F.col("concept") == "mass", "mass flow").when(F.col("concept") == "tone", "tone quality"))
    return search.expanded_terms(q, x).groupBy("query", "token").agg(F.round(F.sum("weight"), 6).alias("weight"), F.count("*").alias("times"))


Q12E = f"""WITH {LEXICON_SQL}, q AS (SELECT item_id AS query, {tokens_sql("text")} AS ts, ' ' || {fold_sql("text")} || ' ' AS f FROM benchmark
), lit AS (SELECT DISTINCT query, unnest(ts) AS token FROM q), m AS (SELECT DISTINCT query, concept, facet, term FROM q JOIN lexicon ON CASE WHEN term = '方法' THEN contains(f, term) ELSE contains(f, ' ' || term || ' ') END
), strong AS (SELECT DISTINCT query, unnest({tokens_sql("term")}) AS token FROM m WHERE facet = 'PHENOMENON'
), last AS (SELECT query, concept, facet, arg_max(term, (-length(term), term)) AS term FROM m GROUP BY ALL
), o AS (SELECT query, facet, unnest({tokens_sql("other")}) AS token FROM (SELECT l.query, l.facet, x.term AS other FROM last l JOIN lexicon x ON x.concept = l.concept AND x.term <> l.term)
), e AS (SELECT query, token, max(CASE WHEN facet = 'PHENOMENON' THEN 0.9 ELSE 0.6 END) AS weight FROM o ANTI JOIN lit USING (query, token) GROUP BY ALL
), tp AS (SELECT DISTINCT query, CASE concept WHEN 'mass' THEN 'mass flow' ELSE 'tone quality' END AS topic FROM last WHERE concept IN ('mass', 'tone')
), terms AS (SELECT query, token, CASE WHEN s.token IS NULL THEN 1.0 ELSE 1.5 END AS weight FROM lit LEFT JOIN strong s USING (query, token) UNION ALL SELECT query, token, weight FROM e UNION ALL SELECT query, unnest(list_distinct({tokens_sql("topic")})), 0.8 FROM tp)
SELECT query, token, round(sum(weight)::DOUBLE, 6) AS weight, count(*) AS times FROM terms GROUP BY ALL"""


def q13_filters(spark, d):
    """Works that pass the filters of two queries."""
    w = works(spark, d).select("doc_id", "year", "journal", F.array("domain", "subtopic").alias("topics"))
    asked_for = spark.createDataFrame([(1, ["2001", "2007", "2019"], "SRC1", "en"), (2, [], None, "de src")], "query int, years array<string>, journal string, topic string")
    return search.passes(w, asked_for)


Q13 = f"""WITH {WORKS_SQL} SELECT 1 AS query, doc_id FROM works WHERE year IN (2001, 2007, 2019) AND lower(journal) LIKE '%src1%' AND (domain LIKE '%en%' OR subtopic LIKE '%en%')
UNION ALL SELECT 2, doc_id FROM works WHERE domain LIKE '%de src%' OR subtopic LIKE '%de src%'"""


def q14_lookup(spark, d):
    """Looked up: every item of the benchmark by id, DOI, title, author or journal, some by a name alone, some exactly."""
    k = F.col("item_id")
    wanted = table(spark, d, "benchmark").select(
        k.alias("query"), F.when(k % 4 == 0, k * 7).alias("id"), F.when(k % 4 == 1, F.concat(F.lit("https://doi.org/10.1000/W"), k * 4)).alias("doi"), F.when(k % 4 == 2, F.substring_index("text", "\n", 1)).alias("title"),
        F.when(k % 9 == 3, F.concat(F.lit("Author "), k)).alias("author"), F.when(k % 4 == 3, F.concat(F.lit("AUTHOR 9"), k % 7)).otherwise(F.substring_index("text", " ", 4)).alias("bare"), F.when(k % 11 == 5, "src4").alias("journal"), (k % 8 == 1).alias("exact"),
    )
    terms = search.plain_terms(wanted.select("query", F.col("bare").alias("text")))
    lexical = search.ranked(search.term_scores(index_of(spark, d), terms, FIELDS, list(FIELDS)), 10).select("query", "doc_id")
    return catalog.lookup(full(spark, d), wanted, lexical)


Q14 = f"""WITH {CATALOG_SQL}, k AS (SELECT item_id AS k, text FROM benchmark
), ask AS (SELECT k AS query, CASE WHEN k % 4 = 0 THEN k * 7 END AS id, CASE WHEN k % 4 = 1 THEN '10.1000/w' || k * 4 END AS doi, CASE WHEN k % 4 = 2 THEN {fold_sql("split_part(text, chr(10), 1)")} ELSE '' END AS title, CASE WHEN k % 9 = 3 THEN 'author ' || k ELSE '' END AS author,
  CASE WHEN k % 4 = 3 THEN 'AUTHOR 9' || k % 7 ELSE array_to_string(list_slice(string_split(text, ' '), 1, 4), ' ') END AS raw, CASE WHEN k % 11 = 5 THEN 'src4' ELSE '' END AS journal, k % 8 = 1 AS exact FROM k
), names AS (SELECT doc_id, unnest(authors) AS name FROM catalog
), hit AS (SELECT query, doc_id, 0 AS way FROM catalog JOIN ask ON doc_id = id UNION ALL SELECT query, min(doc_id), 1 FROM catalog c JOIN ask a ON c.doi = a.doi GROUP BY query, a.doi UNION ALL SELECT query, doc_id, 2 FROM catalog c JOIN ask a ON {fold_sql("c.title")} = a.title AND a.title <> ''
  UNION ALL SELECT query, doc_id, 3 FROM names JOIN ask ON author <> '' AND (contains(name, author) OR contains(author, name)) UNION ALL SELECT query, doc_id, 4 FROM catalog c JOIN ask a ON a.journal <> '' AND contains(lower(c.journal), a.journal)
), sure AS (SELECT query, doc_id, min(way) AS way FROM hit GROUP BY ALL), open AS (SELECT query, raw, {fold_sql("raw")} AS bare FROM ask WHERE NOT exact AND query NOT IN (SELECT query FROM sure)
), loose AS (SELECT DISTINCT query, doc_id, 5 AS way FROM names JOIN open ON bare <> '' AND (bare = name OR (length(bare) >= 2 AND contains(name, bare)) OR (length(name) >= 2 AND contains(bare, name)))
), terms AS (SELECT DISTINCT query, unnest({tokens_sql("raw")}) AS token, 1.0 AS weight FROM ask), {bm25_sql("terms", FIELDS)}
, lexical AS (SELECT query, doc_id, 6 AS way FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) <= 10
), found AS (SELECT * FROM sure UNION ALL SELECT * FROM loose UNION ALL SELECT * FROM lexical WHERE query IN (SELECT query FROM open) AND query NOT IN (SELECT query FROM loose))
SELECT query, CASE WHEN way IS NULL THEN 'NOT_IN_LIBRARY' WHEN way < 5 THEN 'FOUND' ELSE 'FOUND_APPROXIMATE' END AS status, (['paper_id', 'doi', 'title', 'author', 'journal', 'author', 'lexical'])[way + 1] AS matched_on,
  (['EXACT', 'EXACT', 'EXACT', 'AUTHOR_SET', 'FIELD', 'AUTHOR_SET', 'APPROXIMATE'])[way + 1] AS confidence, doc_id FROM ask LEFT JOIN found USING (query)"""


def q15_lexicon(spark, d):
    return search.lexicon_hits(works(spark, d), lexicon(spark), "body")


HAS = "CASE WHEN term = '方法' THEN contains(text, term) ELSE contains(text, ' ' || term || ' ') END"
HITS_SQL = f"""{WORKS_SQL}, {LEXICON_SQL}, folded AS (SELECT doc_id, ' ' || {fold_sql("body")} || ' ' AS text FROM works
), hits AS (SELECT DISTINCT doc_id, concept, term FROM folded JOIN lexicon ON {HAS})"""
Q15 = f"WITH {HITS_SQL} SELECT doc_id, concept, term FROM hits"


def q15_titles(spark, d):
    """Terms of the lexicon in titles of which some have Chinese characters."""
    return search.lexicon_hits(full(spark, d), lexicon(spark), "title")


Q15T = f"WITH {CATALOG_SQL}, {LEXICON_SQL}, folded AS (SELECT doc_id, ' ' || {fold_sql('title')} || ' ' AS text FROM catalog) SELECT DISTINCT doc_id, concept, term FROM folded JOIN lexicon ON {HAS}"


def q16_title_match(spark, d):
    w = works(spark, d).select("doc_id", t.fold(F.col("title")).alias("title"), t.fold(F.col("body")).alias("body"), t.fold(F.col("author")).alias("author"))
    compact = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    way = F.when(F.col("title") == "", "none").when(F.col("body").contains(F.concat(F.col("title"), F.lit(" "), F.col("author"))), "byline").when(F.col("body").contains(F.col("title")), "contained").when(compact(F.col("body")).contains(compact(F.col("title"))), "compact").otherwise("absent")
    return w.groupBy(way.alias("way")).agg(F.count("*").alias("n"))


Q16 = f"""WITH {WORKS_SQL}, f AS (SELECT {fold_sql("title")} AS t, {fold_sql("body")} AS b, author AS a FROM works)
SELECT CASE WHEN t = '' THEN 'none' WHEN contains(b, t || ' ' || a) THEN 'byline' WHEN contains(b, t) THEN 'contained' WHEN contains(replace(b, ' ', ''), replace(t, ' ', '')) THEN 'compact' ELSE 'absent' END AS way, count(*) AS n FROM f GROUP BY 1"""


def q17_target_match(spark, d):
    w = works(spark, d).withColumn("authors", F.array("author", F.concat(F.lit("author "), F.pmod("doc_id", F.lit(11)))))
    wanted = F.array(F.lit("author 3"), F.lit("author 5"))
    by_title = F.col("title").startswith("And")
    return w.where(F.col("year").between(1995, 2015) & F.when(by_title, F.exists(wanted, lambda a: F.array_contains("authors", a))).otherwise(F.forall(wanted, lambda a: F.array_contains("authors", a)))).select("doc_id", "year", by_title.alias("by_title"))


Q17 = f"""WITH {WORKS_SQL}, a AS (SELECT *, [author, 'author ' || doc_id % 11] AS authors FROM works)
SELECT doc_id, year, title LIKE 'And%' AS by_title FROM a WHERE year BETWEEN 1995 AND 2015 AND CASE WHEN title LIKE 'And%' THEN list_has_any(authors, ['author 3', 'author 5']) ELSE list_has_all(authors, ['author 3', 'author 5']) END"""


def q16_title_in_text(spark, d):
    """Titles that are claimed of texts: as they are, with an author after them, with somebody else, after other words, or nothing."""
    n = F.col("doc_id")
    of = lambda k, *v: F.element_at(F.array(*v), (F.pmod(k, F.lit(len(v))) + 1).cast("int"))
    w = works(spark, d)
    claimed = of(n, F.col("title"), F.concat("title", F.lit(" \u2014 "), F.upper("author")), F.concat("title", F.lit(": nobody")), F.concat(F.lit("zzz "), "title"), F.lit(" "))
    text = of(F.floor(n / 5), F.col("body"), F.concat(F.lit("x\n Authors: somebody; "), "author", F.lit("\n"), "body"), F.regexp_replace("body", "[ \n]", ""))
    return w.select("doc_id", access.title_in_text(claimed, text, F.array(F.lit("somebody"), F.col("author"))).alias("there"))


_SEPARATED = r"'^(.+?)\s*[-\x{2010}\x{2011}\x{2012}\x{2013}\x{2014}\x{2015}:\x{FF1A}]\s*([^\r\n]+?)\s*$'"
Q16T = f"""WITH {WORKS_SQL}, c AS (SELECT doc_id, author, CASE doc_id % 5 WHEN 0 THEN title WHEN 1 THEN title || ' \u2014 ' || upper(author) WHEN 2 THEN title || ': nobody' WHEN 3 THEN 'zzz ' || title ELSE ' ' END AS t,
    CASE doc_id // 5 % 3 WHEN 0 THEN body WHEN 1 THEN 'x' || chr(10) || ' Authors: somebody; ' || author || chr(10) || body ELSE regexp_replace(body, '[ \\n]', '', 'g') END AS x, doc_id // 5 % 3 = 1 AS lined FROM works
), f AS (SELECT *, {fold_sql("t")} AS want, {fold_sql("x")} AS have, {fold_sql(f"regexp_extract(t, {_SEPARATED}, 1)")} AS core, replace({fold_sql(f"regexp_extract(t, {_SEPARATED}, 2)")}, ' ', '') AS who FROM c)
SELECT doc_id, CASE WHEN want <> '' AND have <> '' THEN contains(have, want) OR contains(replace(have, ' ', ''), replace(want, ' ', ''))
  OR ((who = replace(author, ' ', '') OR who = 'somebody') AND (lined OR regexp_matches(x, '(?im)^\\s*authors?\\s*[:]')) AND length(replace(core, ' ', '')) >= 12 AND (contains(have, core) OR contains(replace(have, ' ', ''), replace(core, ' ', '')))) END AS there FROM f"""


def q17_requested(spark, d):
    """Works that are what a request names, the kind of request varying by the work: DOIs, titles, authors, years, any of them or nothing."""
    n = F.col("doc_id")
    some = lambda test, *v: F.when(test, F.array(*v))
    record = {"doi": F.col("doi"), "title": F.col("title"), "year": F.col("year").cast("string"), "authors": F.when(n % 13 == 0, F.array().cast("array<string>")).otherwise(F.col("authors"))}
    wanted = {
        "dois": some(n % 8 < 2, F.lit("10.1000/none"), F.concat(F.lit("DOI:10.1000/W"), n)), "titles": some((n % 5 == 0) & (n % 8 > 0), F.concat(F.upper("title"), F.lit("!")), F.lit("another")),
        "authors": F.when(n % 3 == 0, F.array(F.lit("Author 5"), F.concat(F.lit("AUTHOR "), n % 97))).when(n % 3 == 1, F.array(F.lit("author"), F.concat(F.lit(""), n % 11))), "first": F.when(n % 4 == 1, 2000), "last": F.when(n % 6 == 1, 2010),
    }
    return full(spark, d).select("doc_id", screening.wanted_target(record, wanted).alias("wanted"))


Q17R = f"""WITH {CATALOG_SQL}, r AS (SELECT doc_id AS n, doi, {fold_sql("title")} AS title, year, CASE WHEN doc_id % 13 = 0 THEN [] ELSE authors END AS authors, doc_id % 8 < 2 AS d, doc_id % 5 = 0 AND doc_id % 8 > 0 AND true AS t FROM catalog
), x AS (SELECT *, CASE n % 3 WHEN 0 THEN ['author 5', 'author ' || n % 97] WHEN 1 THEN ['author', (n % 11)::VARCHAR] ELSE [] END AS who FROM r
), m AS (SELECT *, list_transform(who, lambda a: len(list_filter(authors, lambda o: o = a OR list_contains(string_split(o, ' '), a))) > 0) AS there FROM x)
SELECT n AS doc_id, (NOT d AND NOT t AND len(who) = 0) OR ((NOT d OR coalesce(doi = '10.1000/w' || n, false)) AND (NOT t OR title <> '') AND (n % 4 <> 1 OR year >= 2000) AND (n % 6 <> 1 OR year <= 2010)
  AND CASE WHEN len(who) = 0 THEN true WHEN len(authors) = 0 THEN d OR t WHEN d OR t THEN list_contains(there, true) ELSE NOT list_contains(there, false) END) AS wanted FROM m"""


def q18_topic_links(spark, d):
    w = works(spark, d)
    links = w.select("doc_id", F.explode(F.array(F.struct(F.lit("domain").alias("kind"), F.col("domain").alias("name")), F.struct(F.lit("subtopic").alias("kind"), F.col("subtopic").alias("name")))).alias("l"))
    return links.groupBy("l.kind", "l.name").agg(F.count("*").alias("works"), F.min("doc_id").alias("first"))


Q18 = f"WITH {WORKS_SQL}, l AS (SELECT doc_id, 'domain' AS kind, domain AS name FROM works UNION ALL SELECT doc_id, 'subtopic', subtopic FROM works) SELECT kind, name, count(*) AS works, min(doc_id) AS first FROM l GROUP BY kind, name"


def q18_link_rows(spark, d):
    """A row for each topic of each work, with the place of its view."""
    n = F.col("doc_id")
    topic = lambda a, b: F.struct(F.col(a).alias("domain"), F.col(b).alias("subtopic"))
    w = works(spark, d).select("doc_id", F.when(n % 3 > 0, F.concat(F.lit("n"), n, F.lit(".pdf"))).alias("name"), F.when(n % 5 > 0, F.array(topic("domain", "subtopic"), topic("journal", "domain"))).otherwise(F.array(topic("domain", "journal"))).alias("topics"), F.sha2("body", 256).alias("sha256"), F.when(n % 4 == 0, "VOR").alias("version_role"))
    return classify.topic_links(w, "view")


Q18L = f"""WITH {WORKS_SQL}, l AS (SELECT doc_id, domain AS d, CASE WHEN doc_id % 5 > 0 THEN subtopic ELSE journal END AS t, body FROM works UNION ALL SELECT doc_id, journal, domain, body FROM works WHERE doc_id % 5 > 0)
SELECT doc_id, d AS domain, t AS topic, concat_ws('/', 'view', d, t, CASE WHEN doc_id % 3 > 0 THEN 'n' ELSE '' END || doc_id || '.pdf') AS view_path, 'HARDLINK' AS link_type, sha256(body) AS sha256, CASE WHEN doc_id % 4 = 0 THEN 'VOR' ELSE 'PRIMARY_CANONICAL' END AS version_role FROM l"""


def q19_bm25f(spark, d):
    """Ranked top ten for each query of the benchmark's query set, from the stored index."""
    return search.ranked(search.term_scores(index_of(spark, d), search.plain_terms(asked(spark, d)), WITH_TEXT), 10)


RANKED_SQL = "SELECT query, doc_id, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored{0} WHERE score > 0 QUALIFY rank <= {1}"
Q19 = f"WITH {BM25_SQL} {RANKED_SQL.format('', 10)}"


def q20_contributions(spark, d):
    """What each field adds to the scores of all works for each token of every item of the benchmark."""
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text")
    w = works(spark, d).withColumn("topics", F.concat("domain", F.lit(" "), "domain", F.lit(" "), "journal"))  # as the SQL has them: none where one is missing
    totals = search.contribution_totals(fields_of(w), search.plain_terms(queries), WITH_TEXT)
    return totals.select("query", "token", "field", "works", F.round("total", 5).alias("total"))


Q20 = f"WITH {BM25_SQL.replace(f' WHERE {ASKED}', '')} SELECT query, token, field, count(*) AS works, round(sum(c), 5) AS total FROM parts GROUP BY query, token, field"


def q20_repeated_terms(spark, d):
    """A token that stands in a query twice counts twice: the terms of a query and those of its topic, which it may share."""
    terms = search.plain_terms(asked(spark, d)).unionByName(search.plain_terms(asked(spark, d).withColumn("text", F.concat(F.lit("en src1 "), F.substring_index("text", " ", 5)))))
    return search.ranked(search.term_scores(index_of(spark, d), terms, FIELDS, list(FIELDS)), 10)


Q20R = f"""WITH {WORKS_SQL}, both_ AS (SELECT DISTINCT item_id AS query, 0 AS k, unnest({tokens_sql("text")}) AS token FROM benchmark WHERE {ASKED} UNION ALL
  SELECT DISTINCT item_id, 1, unnest({tokens_sql("'en src1 ' || array_to_string(list_slice(string_split(text, ' '), 1, 5), ' ')")}) FROM benchmark WHERE {ASKED}
), terms AS (SELECT query, token, count(*)::DOUBLE AS weight FROM both_ GROUP BY ALL), {bm25_sql("terms", FIELDS)} {RANKED_SQL.format("", 10)}"""


def stages(spark, d):
    """Candidates by what the catalog has of a work, and their passages, for the query set."""
    terms = search.plain_terms(asked(spark, d))
    first = shared.keep(search.ranked(search.term_scores(index_of(spark, d), terms, FIELDS, list(FIELDS)), search.DEPTH), "candidates")
    return first, search.passage_scores(index_of(spark, d), first, terms)


def q21_two_stage(spark, d):
    """Forty candidates by title, topics, authors and journal, ranked again with their passages."""
    return search.two_stage(*stages(spark, d))


STAGES_SQL = f"""{WORKS_SQL}, {TERMS_SQL}, {bm25_sql("terms", FIELDS)}, cand AS ({RANKED_SQL.format("", 40)}
), {CHUNKS_SQL.format("SELECT DISTINCT doc_id FROM cand")}
, c AS (SELECT query, k.doc_id, ordinal, text FROM cand JOIN chunks k ON k.doc_id = cand.doc_id), cl AS (SELECT query, doc_id, ordinal, {tokens_sql("text")} AS ts FROM c
), cs AS (SELECT query, count(*) AS n, sum(len(ts)) / count(*) AS avg_len FROM cl GROUP BY query
), ct AS (SELECT query, doc_id, ordinal, len, token, count(*) AS tf FROM (SELECT query, doc_id, ordinal, len(ts)::DOUBLE AS len, unnest(ts) AS token FROM cl) JOIN terms USING (query, token) GROUP BY ALL
), ci AS (SELECT query, token, count(*) AS df FROM ct GROUP BY ALL
), cx AS (SELECT query, doc_id, ordinal, greatest(0.05, ln(1 + (n - df + 0.5) / (df + 0.5))) AS idf, tf / (0.25 + 0.75 * len / avg_len) AS x FROM ct JOIN ci USING (query, token) JOIN cs USING (query)
), passages AS (SELECT query, doc_id, ordinal, round(sum(idf * x / (1.2 + x) * 2.2), 6) AS score FROM cx GROUP BY query, doc_id, ordinal)"""
Q21 = f"""WITH RECURSIVE {STAGES_SQL}, b AS (SELECT query, doc_id, max(score) AS best FROM passages GROUP BY ALL), n AS (SELECT query, doc_id, least(1.0, best / max(best) OVER (PARTITION BY query)) AS passage FROM b)
SELECT query, doc_id, score AS stage1, round(passage, 6) AS passage, round(score + 0.45 * max(score) OVER (PARTITION BY query) * coalesce(passage, 0.0), 6) AS score FROM cand LEFT JOIN n USING (query, doc_id)"""


def q21_passages(spark, d):
    """The three best passages of each candidate."""
    return search.best_passages(stages(spark, d)[1])


Q21S = f"WITH RECURSIVE {STAGES_SQL} SELECT query, doc_id, ordinal, score, CAST(row_number() OVER (PARTITION BY query, doc_id ORDER BY score DESC, ordinal) AS INTEGER) AS rank FROM passages QUALIFY rank <= 3"


def roles_of(spark, d, only=None):
    """Roles of all works, or of those in `only` (doc_id; some hundreds): texts of no others are looked through."""
    w = full(spark, d) if only is None else full(spark, d).join(shared.small(only, search.BROADCAST_TERMS), "doc_id", "left_semi")
    facets = lexicon(spark).select("concept", "facet").distinct()
    share = F.size(F.array_intersect(F.array_distinct(t.tokens(F.col("title"))), F.array(*map(F.lit, ("der", "que", "on"))))) / 2
    return search.roles(w, search.evidence(w, lexicon(spark), ["title", "topics", "journal", "body"]), facets, share, names_phenomenon=False)


def q21_roles(spark, d):
    return roles_of(spark, d)


_ROLES = f"""{CATALOG_SQL}, {LEXICON_SQL}, fields AS (SELECT doc_id, 'title' AS field, 3 AS w, ' ' || {fold_sql("title")} || ' ' AS text FROM catalog UNION ALL SELECT doc_id, 'topics', 2, ' ' || {fold_sql("topics")} || ' ' FROM catalog
  UNION ALL SELECT doc_id, 'journal', 1, ' ' || {fold_sql("journal")} || ' ' FROM catalog UNION ALL SELECT doc_id, 'body', 1, ' ' || {fold_sql("body")} || ' ' FROM catalog
), ev AS (SELECT doc_id, field, concept, facet, w, min(term) AS term FROM fields JOIN lexicon ON {HAS} GROUP BY ALL
), f AS (SELECT doc_id, sum(w) FILTER (facet = 'PHENOMENON') AS p, coalesce(sum(w) FILTER (facet = 'MECHANISM'), 0) AS m, coalesce(sum(w) FILTER (facet = 'OUTCOME'), 0) AS o, coalesce(sum(w) FILTER (facet = 'METHOD'), 0) AS x FROM ev GROUP BY doc_id
), share AS (SELECT doc_id, len(list_intersect(list_distinct({tokens_sql("title")}), ['der', 'que', 'on'])) / 2 AS s FROM catalog
), roles AS (SELECT doc_id, CASE WHEN p > 0 THEN 'CORE' WHEN s >= 0.4 THEN 'CORE' WHEN m > 0 AND m >= o AND m >= x THEN 'MECHANISM' WHEN o > 0 AND o >= x THEN 'OUTCOME' WHEN x > 0 THEN 'METHOD' ELSE 'BACKGROUND' END AS role FROM share LEFT JOIN f USING (doc_id))"""
Q21R = f"WITH {_ROLES} SELECT doc_id, role FROM roles"


def q21_evidence(spark, d):
    """For each concept and field the works that have evidence, and the first terms that they have."""
    e = search.evidence(full(spark, d), lexicon(spark), ["title", "topics", "journal", "body"])
    return e.groupBy("concept", "field", "term").agg(F.count("*").alias("works"), F.min("doc_id").alias("first"))


Q21E = f"WITH {_ROLES} SELECT concept, field, term, count(*) AS works, min(doc_id) AS first FROM ev GROUP BY ALL"


def q21_pack(spark, d):
    """The twenty best of the query set by role, with the hashes of their texts."""
    best = search.ranked(search.term_scores(index_of(spark, d), search.plain_terms(asked(spark, d)), FIELDS, list(FIELDS)), 20)
    best = shared.keep(best, "best")
    mine = best.select("doc_id").distinct()
    named = works(spark, d).join(shared.small(mine, search.BROADCAST_TERMS), "doc_id", "left_semi")
    return search.reading_pack(best, roles_of(spark, d, mine), named.select("doc_id", F.sha2("body", 256).alias("sha256")))


Q21P = f"""WITH {_ROLES}, {TERMS_SQL}, {bm25_sql("terms", FIELDS)}, best AS ({RANKED_SQL.format("", 20)})
SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY list_position(['CORE', 'MECHANISM', 'OUTCOME', 'METHOD', 'BACKGROUND'], role), rank) AS INTEGER) AS place, role, doc_id, score, sha256(body) AS sha256 FROM best JOIN roles USING (doc_id) JOIN works USING (doc_id)"""


def q21_rerank(spark, d):
    """Candidates ranked again by the cosine of their vectors to that of the query's number."""
    best = search.ranked(search.term_scores(index_of(spark, d), search.plain_terms(asked(spark, d)), FIELDS, list(FIELDS)), search.DEPTH)
    v = table(spark, d, "embeddings").where("embedding IS NOT NULL")
    return search.reranked(best, v.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), v.select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector")))


Q21V = f"""WITH {WORKS_SQL}, {TERMS_SQL}, {bm25_sql("terms", FIELDS)}, best AS ({RANKED_SQL.format("", 40)}), v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL)
SELECT query, doc_id, round(score + 0.5 * max(score) OVER (PARTITION BY query) * coalesce(list_inner_product(q.e, k.e) / sqrt(list_inner_product(q.e, q.e) * list_inner_product(k.e, k.e)), 0.0), 6) AS score FROM best LEFT JOIN v q ON q.vec_id = query LEFT JOIN v k ON k.vec_id = doc_id"""


def q22_index(spark, d):
    """What the index has of each work while the catalog changes: some titles, some works gone, others new; then brought up to date and merged."""
    w = indexed(works(spark, d))
    before = w.where("doc_id % 7 <> 2")
    after = w.where("doc_id % 11 <> 3").withColumn("title", F.when(F.col("doc_id") % 5 == 0, F.concat("title", F.lit(" changed"))).otherwise(F.col("title")))
    path, fields = shared.new_path(spark, "index"), ["title", "journal"]
    rows = [("before", index.status(before, path))]
    index.build(before, fields, path)
    rows += [("same", index.status(before.repartition(3), path)), ("changed", index.status(after, path))]
    states = shared.keep(index.freshness(after, path).groupBy("state").agg(F.count("*").alias("n")), "states")
    rows += [("updated", str(index.update(after, fields, path))), ("again", str(index.update(after, fields, path))), ("now", index.status(after, path))]
    rows += [(r["check"], str(r["ok"])) for r in index.validate(spark, path).collect()]
    postings = lambda: index.read(spark, path).postings.where("field = 'title'").agg(F.count("*").alias("n")).first()["n"]
    segments = postings()
    index.merge(spark, path)
    rows += [("merged", str(postings() == segments)), ("title postings", str(segments)), ("dropped", str(index.drop(spark, path))), ("after", index.status(after, path))]
    return states.select("state", F.col("n").cast("string").alias("result")).unionByName(spark.createDataFrame(rows, "state string, result string"))


Q22I = f"""WITH {WORKS_SQL}, b AS (SELECT doc_id FROM works WHERE doc_id % 7 <> 2), a AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN title || ' changed' ELSE title END AS title FROM works WHERE doc_id % 11 <> 3
), f AS (SELECT CASE WHEN b.doc_id IS NULL THEN 'ABSENT' WHEN a.doc_id IS NULL THEN 'GONE' WHEN a.doc_id % 5 = 0 THEN 'STALE' ELSE 'FRESH' END AS state FROM a FULL JOIN b ON a.doc_id = b.doc_id)
SELECT state, count(*)::VARCHAR AS result FROM f GROUP BY state UNION ALL SELECT 'updated', count(*)::VARCHAR FROM f WHERE state <> 'FRESH'
UNION ALL SELECT 'title postings', sum(len(list_distinct({tokens_sql("title")})))::BIGINT::VARCHAR FROM a
UNION ALL SELECT * FROM (VALUES ('before', 'ABSENT'), ('same', 'FRESH'), ('changed', 'STALE'), ('again', '0'), ('now', 'FRESH'), ('postings', 'True'), ('lengths', 'True'), ('counts', 'True'), ('fields', 'True'), ('merged', 'True'), ('dropped', 'True'), ('after', 'ABSENT')) v(state, result)"""


def q22_fulltext(spark, d):
    """What the index has of the text of every work that an item of the benchmark asks for by its number, some after a change, some that are not there."""
    path, w = shared.new_path(spark, "index"), indexed(works(spark, d)).select("doc_id", "title", "body")
    index.build(w.where("doc_id % 6 <> 1"), ["title", "body"], path, passages_of="body")
    asked_for = table(spark, d, "benchmark").select((F.col("item_id") * 5).alias("doc_id"))
    now = w.withColumn("title", F.when(F.col("doc_id") % 4 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title")))
    return index.fulltext(asked_for, now, path)


Q22F = f"""WITH RECURSIVE {WORKS_SQL}, {CHUNKS_SQL.format("SELECT doc_id FROM works WHERE doc_id % 6 <> 1")}, c AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id), q AS (SELECT DISTINCT item_id * 5 AS doc_id FROM benchmark)
SELECT q.doc_id, CASE WHEN w.doc_id IS NULL THEN 'NOT_IN_LIBRARY' ELSE 'FOUND' END AS status, CASE WHEN w.doc_id IS NOT NULL THEN n IS NOT NULL END AS indexed, CASE WHEN w.doc_id IS NOT NULL THEN coalesce(n, 0) END AS chunks,
  CASE WHEN w.doc_id IS NOT NULL THEN q.doc_id % 6 <> 1 AND q.doc_id % 4 = 0 END AS stale, CASE WHEN w.doc_id IS NULL THEN NULL WHEN q.doc_id % 6 = 1 THEN 'NOT_INDEXED' WHEN n > 0 THEN 'EXTRACTED' ELSE 'NO_TEXT' END AS extraction
FROM q LEFT JOIN works w ON w.doc_id = q.doc_id LEFT JOIN c ON c.doc_id = q.doc_id"""


def q13_filtered_search(spark, d):
    """The query set with years, journals and topics of some queries: the ten best of the works that pass, scored over all works."""
    q = asked(spark, d)
    k = F.col("query")
    wanted = q.where("query % 400 <> 0").select(
        "query", F.when(k % 200 == 0, F.transform(F.sequence(F.lit(1995), F.lit(2010)), lambda y: y.cast("string"))).otherwise(F.array().cast("array<string>")).alias("years"), F.when(k % 300 == 0, "SRC1").alias("journal"), F.when(k % 500 == 0, "En").alias("topic"))
    w = works(spark, d).select("doc_id", "year", "journal", F.array("domain", "subtopic").alias("topics"))
    parts = search.term_scores(index_of(spark, d), search.plain_terms(q), FIELDS, list(FIELDS))
    parts = shared.keep(parts.groupBy("query", "doc_id").agg(F.sum("contribution").alias("contribution")), "scores")  # one row for a work, read by both ways of filtered()
    return search.ranked(search.filtered(parts, w, wanted), 10)


Q13F = f"""WITH {WORKS_SQL}, {TERMS_SQL}, {bm25_sql("terms", FIELDS)}, pass AS (SELECT query, s.doc_id, score FROM scored s JOIN works w USING (doc_id)
  WHERE query % 400 = 0 OR ((query % 200 <> 0 OR year BETWEEN 1995 AND 2010) AND (query % 300 <> 0 OR lower(journal) LIKE '%src1%') AND (query % 500 <> 0 OR lower(domain) LIKE '%en%' OR lower(subtopic) LIKE '%en%')))
{RANKED_SQL.format("", 10).replace("scored", "pass")}"""


def q23_related(spark, d):
    w, seed = full(spark, d), 7
    terms = w.where(F.col("doc_id") == seed).select(F.lit(seed).alias("query"), F.explode(F.array_distinct(t.tokens(F.col("title")))).alias("token"), F.lit(1.0).alias("weight"))
    lexical = search.term_scores(index_of(spark, d), terms, {"title": 3.0}, ["title"]).groupBy("doc_id").agg(F.round(F.sum("contribution"), 6).alias("score"))
    return catalog.related(w.withColumns({"subtopics": F.array("subtopic"), "domains": F.array("domain")}), seed, lexical)


Q23 = f"""WITH {CATALOG_SQL}, terms AS (SELECT DISTINCT 7 AS query, unnest({tokens_sql("title")}) AS token, 1.0 AS weight FROM catalog WHERE doc_id = 7), {bm25_sql("terms", {"title": 3.0})}
, s AS (SELECT * FROM catalog WHERE doc_id = 7
), r AS (SELECT w.doc_id, round(3.0 * (w.subtopic = s.subtopic)::INT + (w.domain = s.domain)::INT + 2.0 * len(list_intersect(w.authors, s.authors)) + 1.5 * len(list_intersect(w.keywords, s.keywords)) + 0.5 * (w.journal = s.journal)::INT
    + least(6.0, coalesce(l.score / (SELECT max(score) FROM scored) * 6.0, 0.0)), 6) AS score FROM catalog w JOIN s ON w.doc_id <> 7 LEFT JOIN scored l ON l.doc_id = w.doc_id)
SELECT doc_id, score FROM r WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10"""


def q24_coverage(spark, d):
    c = catalog.coverage(search.lexicon_hits(works(spark, d), lexicon(spark), "body"), lexicon(spark))
    return c.withColumn("examples", F.array_join("examples", " "))


Q24 = f"""WITH {HITS_SQL}, n AS (SELECT l.concept, count(DISTINCT doc_id) AS works, array_to_string(list_slice(list_sort(list_distinct(list(doc_id) FILTER (doc_id IS NOT NULL))), 1, 5), ' ') AS examples FROM (SELECT DISTINCT concept FROM lexicon) l LEFT JOIN hits USING (concept) GROUP BY l.concept)
SELECT concept, works, coalesce(examples, '') AS examples, CASE WHEN works = 0 THEN 'ABSENT' WHEN works < 3 THEN 'THIN' ELSE 'COVERED' END AS level FROM n"""


def q24_missing(spark, d):
    """Whether there are works enough to tell gaps, and the roles that none of another library has."""
    enough = catalog.sufficient(works(spark, d)).select(F.col("verdict").alias("what"), "works")
    gone = catalog.missing_roles(roles_of(spark, d).where("role IN ('CORE', 'OUTCOME')")).select(F.concat(F.lit("no "), "role").alias("what"), F.lit(0).cast("long").alias("works"))
    return enough.unionByName(gone)


Q24M = f"WITH {_ROLES} SELECT CASE WHEN count(*) < 30 THEN 'REFUSED' WHEN count(*) < 100 THEN 'FEW' ELSE 'ENOUGH' END AS what, count(*) AS works FROM works UNION ALL SELECT 'no ' || r, 0 FROM (VALUES ('CORE'), ('MECHANISM'), ('OUTCOME'), ('METHOD')) v(r) WHERE r NOT IN (SELECT role FROM roles WHERE role IN ('CORE', 'OUTCOME'))"


def q24_pairs(spark, d):
    return catalog.pair_coverage(search.lexicon_hits(works(spark, d), lexicon(spark), "body"), lexicon(spark))


Q24P = f"""WITH {HITS_SQL}, c AS (SELECT DISTINCT concept, facet FROM lexicon), h AS (SELECT DISTINCT doc_id, concept FROM hits)
SELECT a.concept AS phenomenon, b.concept AS other, (SELECT count(*) FROM h x JOIN h y USING (doc_id) WHERE x.concept = a.concept AND y.concept = b.concept) AS joint
FROM c a, c b WHERE a.facet = 'PHENOMENON' AND b.facet IN ('MECHANISM', 'OUTCOME')"""


def citations(spark, d):
    """Every twentieth work as somebody cites it: some by DOI, some with a word more in the title, some without author or title, some of another year."""
    w, n = full(spark, d).where(F.col("doc_id") % 20 == 0), F.col("doc_id")
    title = F.when(n % 160 == 140, "").when(n % 40 == 20, F.concat("title", F.lit(" more"))).otherwise(F.col("title"))
    authors = F.when(n % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("author"))
    return w.select(n.alias("citation"), F.when(n % 140 == 0, F.concat(F.lit("doi:"), "doi")).alias("doi"), title.alias("title"), authors.alias("authors"), F.when(n % 60 == 20, "1900").otherwise(F.col("year").cast("string")).alias("year"))


def q25_citations(spark, d):
    return catalog.verdicts(citations(spark, d), full(spark, d).withColumn("year", F.col("year").cast("string")))


Q25 = f"""WITH {CATALOG_SQL}, c AS (SELECT doc_id AS citation, CASE WHEN doc_id % 140 = 0 THEN doi END AS doi, CASE WHEN doc_id % 160 = 140 THEN '' WHEN doc_id % 40 = 20 THEN title || ' more' ELSE title END AS title, CASE WHEN doc_id % 3 = 0 THEN [] ELSE [author] END AS authors,
  CASE WHEN doc_id % 60 = 20 THEN 1900 ELSE year END AS year FROM catalog WHERE doc_id % 20 = 0
), folded AS (SELECT doc_id, {fold_sql("title")} AS t FROM catalog
), known AS (SELECT citation, (SELECT min(doc_id) FROM catalog w WHERE w.doi = c.doi) AS by_doi, (SELECT min(doc_id) FROM folded w WHERE w.t = {fold_sql("c.title")} AND w.t <> '') AS by_title FROM c
), a AS (SELECT citation, list_distinct({tokens_sql("title")}) AS want, authors, year FROM c JOIN known USING (citation) WHERE by_doi IS NULL AND by_title IS NULL), h AS (SELECT doc_id, list_distinct({tokens_sql("title")}) AS have, authors, year FROM catalog
), p AS (SELECT citation, doc_id, CASE WHEN len(want) > 0 THEN len(list_intersect(want, have)) / len(want) END AS t, CASE WHEN len(a.authors) > 0 THEN len(list_intersect(a.authors, h.authors)) / len(a.authors) END AS au, (a.year = h.year)::INT AS y FROM a, h
), s AS (SELECT citation, doc_id, round((coalesce(t, 0) * 0.6 + coalesce(au, 0) * 0.25 + y * 0.15) / (CASE WHEN t IS NULL THEN 0 ELSE 0.6 END + CASE WHEN au IS NULL THEN 0 ELSE 0.25 END + 0.15), 6) AS score, coalesce((t >= 0.5)::INT, 0) + coalesce((au >= 0.5)::INT, 0) + (y >= 0.5)::INT AS signals,
    coalesce(t, 0) >= 0.32 / 0.6 - 1e-9 OR coalesce(au, 0) > 0 AS pool FROM p
), r AS (SELECT *, row_number() OVER (PARTITION BY citation ORDER BY score DESC, doc_id) AS rank FROM s WHERE score >= 0.3 AND pool
), f AS (SELECT citation, count(*) AS n, min(doc_id) AS sole FROM r WHERE rank <= 5 AND score >= 0.72 AND signals >= 2 GROUP BY citation)
SELECT citation, CASE WHEN by_doi IS NOT NULL OR by_title IS NOT NULL OR n = 1 THEN 'IN_LIBRARY' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'NOT_IN_LIBRARY' END AS verdict, CASE WHEN by_doi IS NOT NULL THEN 'DOI' WHEN by_title IS NOT NULL THEN 'EXACT_TITLE' WHEN n = 1 THEN 'FIELD_AGREEMENT' END AS match,
  coalesce(by_doi, by_title, CASE WHEN n = 1 THEN sole END) AS doc_id FROM known LEFT JOIN f USING (citation)"""


def q25_parse(spark, d):
    """Works cited in three styles, read again. A work without a text is cited without a title, and none is told of it."""
    w, n = full(spark, d), F.col("doc_id")
    title = F.coalesce(F.trim(F.regexp_replace(F.substring("title", 1, 40), r"[^A-Za-z]+", " ")), F.lit(""))
    text = F.when(n % 3 == 0, F.concat(F.lit("Biddle, G., Hilary, G., & Author"), n % 97, F.lit(" et al. ("), "year", F.lit("). "), title, F.lit(". Journal, 4(2)."))).when(n % 3 == 1, F.concat(F.lit("王海森等, 李明, 《"), title, F.lit("》, "), "year")).otherwise(F.concat(title, F.lit(". https://doi.org/10.1000/W"), n, F.lit(".")))
    p = w.select("doc_id", F.col("title").isNotNull().alias("titled"), catalog.parse_citation(text).alias("c"))
    told = lambda x, style: F.when(F.col("titled") | style, x)
    return p.select("doc_id", "c.doi", "c.year", told(F.array_join("c.authors", "|"), n % 3 != 2).alias("authors"), told(F.col("c.title"), n % 3 == 1).alias("title"))


Q25P = f"""WITH {CATALOG_SQL}, x AS (SELECT doc_id AS n, year, trim(regexp_replace(substr(title, 1, 40), '[^A-Za-z]+', ' ', 'g')) AS t FROM catalog)
SELECT n AS doc_id, CASE WHEN n % 3 = 2 THEN '10.1000/w' || n END AS doi, CASE WHEN n % 3 = 2 THEN '' ELSE year::VARCHAR END AS year,
  CASE n % 3 WHEN 0 THEN 'Biddle|Hilary|Author' || n % 97 WHEN 1 THEN array_to_string(list_concat(['王海森', '李明'], list_filter(list_transform(string_split_regex(regexp_replace('《' || t || '》', '\\band\\b', ' ', 'g'), '\\s{{2,}}'), lambda b: trim(b)), lambda b: len(string_split(b, ' ')) <= 4 AND regexp_matches(b, '[A-Za-z]'))), '|')
  ELSE array_to_string(list_slice(list_filter(list_transform(string_split_regex(regexp_replace(t, '\\band\\b', ' ', 'g'), '\\s{{2,}}'), lambda b: trim(b)), lambda b: len(string_split(b, ' ')) <= 4 AND length(b) > 1), 1, 8), '|') END AS authors,
  CASE n % 3 WHEN 0 THEN CASE WHEN length(t) >= 8 THEN t ELSE t || '. Journal, 4(2' END WHEN 1 THEN CASE WHEN length(t) >= 4 THEN t ELSE '' END ELSE t || '.' END AS title FROM x"""

_ALL = (
    (q12_query_terms, Q12), (q12_parse, Q12P), (q12_expansion, Q12E), (q13_filters, Q13), (q14_lookup, Q14), (q15_lexicon, Q15), (q15_titles, Q15T), (q16_title_match, Q16), (q17_target_match, Q17), (q16_title_in_text, Q16T), (q17_requested, Q17R), (q18_topic_links, Q18), (q18_link_rows, Q18L), (q19_bm25f, Q19), (q20_contributions, Q20),
    (q20_repeated_terms, Q20R), (q21_two_stage, Q21), (q21_passages, Q21S), (q21_roles, Q21R), (q21_evidence, Q21E), (q21_pack, Q21P), (q21_rerank, Q21V), (q22_index, Q22I), (q22_fulltext, Q22F), (q13_filtered_search, Q13F), (q23_related, Q23), (q24_coverage, Q24), (q24_missing, Q24M), (q24_pairs, Q24P), (q25_citations, Q25), (q25_parse, Q25P),
)
QUERIES = {f.__name__: f for f, _ in _ALL}
ORACLES = {f.__name__: sql for f, sql in _ALL}
