"""q01 to q11, q38, q39: normalisation, tokens, chunks, redaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as t
from lectern.operators import passages
from lectern.sources.tables import WORKS_SQL, fold_sql, stem_sql, table, works

STOPS = ", ".join(f"'{w}'" for w in t.STOP_WORDS)


def q01_doi(spark, d):
    raw = F.concat(F.element_at(F.array(F.lit("https://doi.org/"), F.lit("doi: "), F.lit("DOI:"), F.lit("see ")), (F.pmod("p_partkey", F.lit(4)) + 1).cast("int")), F.lit("10."), 1000 + F.pmod("p_partkey", F.lit(9000)), F.lit("/ABC."), F.col("p_partkey"), F.lit("?x=1"))
    return table(spark, d, "part").select("p_partkey", t.normalize_doi(raw).alias("doi"))


Q01 = "SELECT p_partkey, '10.' || (1000 + p_partkey % 9000) || '/abc.' || p_partkey AS doi FROM part"


def q02_fold(spark, d):
    return works(spark, d).select("doc_id", t.normalize_title(F.col("title")).alias("title"), F.length(t.fold(F.col("body"))).alias("n"))


Q02 = f"WITH {WORKS_SQL} SELECT doc_id, nullif({fold_sql('title')}, '') AS title, CAST(length({fold_sql('body')}) AS INTEGER) AS n FROM works"


WIDE = "ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ"


def q02_compatible(spark, d):
    """Names in full-width letters, with a ligature and a unit as one character, normalised after NFKC."""
    raw = F.concat(F.translate("p_name", "abcdefghijklmnopqrstuvwxyz", WIDE), F.lit("　ﬁ㎏"), F.col("p_partkey"))
    return table(spark, d, "part").select("p_partkey", t.normalize_title(t.nfkc(raw)).alias("title"), t.label_key(t.nfkc(raw)).alias("label"))


Q02N = f"SELECT p_partkey, {fold_sql('p_name')} || ' fikg' || p_partkey AS title, regexp_replace(p_name, '\\s', '', 'g') || 'fikg' || p_partkey AS label FROM part"


def q03_paper_id(spark, d):
    w = works(spark, d)
    return w.select("doc_id", t.paper_id(F.lit(None).cast("string"), F.col("title"), F.col("year").cast("string"), F.col("author")).alias("paper_id"))


Q03 = f"""WITH {WORKS_SQL} SELECT doc_id, 'P' || upper(substr(sha256('title:' || coalesce(nullif({fold_sql("title")}, ''), 'unknown') || '|year:' || year || '|author:' || {fold_sql("author")}), 1, 12)) AS paper_id FROM works"""


def q04_file_name(spark, d):
    return works(spark, d).select("doc_id", t.safe_name(F.col("title")).alias("name"))


Q04 = rf"""WITH {WORKS_SQL}, c AS (SELECT doc_id, list_slice(string_split(regexp_replace(regexp_replace(trim(title), '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), '[\s_]+', ' ', 'g'), ' '), 1, 10) AS l FROM works)
SELECT doc_id, regexp_replace(substr(regexp_replace(array_to_string(l, '_'), '_+', '_', 'g'), 1, 48), '^[ ._]+|[ ._]+$', '', 'g') AS name FROM c"""


def q05_tokens(spark, d):
    w = works(spark, d).select("doc_id", t.tokens(F.col("title")).alias("tokens"))
    return w.select("doc_id", F.size("tokens").alias("n"), F.array_join("tokens", " ").alias("tokens"))


Q05 = f"""WITH {WORKS_SQL}, l AS (
  SELECT doc_id, list_filter(regexp_extract_all({fold_sql("title")}, '[0-9a-z]+'), lambda w: w NOT IN ({STOPS})) AS ws FROM works
), s AS (SELECT doc_id, flatten(list_transform(ws, lambda w: CASE WHEN ({stem_sql("w")}) = w THEN [w] ELSE [w, {stem_sql("w")}] END)) AS tokens FROM l)
SELECT doc_id, CAST(coalesce(len(tokens), 0) AS INTEGER) AS n, coalesce(array_to_string(tokens, ' '), '') AS tokens FROM s"""


def q06_stems(spark, d):
    words = works(spark, d).select(F.explode(F.regexp_extract_all(t.fold(F.col("body")), F.lit(r"[0-9a-z]+"), F.lit(0))).alias("w"))
    return words.groupBy(t.stem(F.col("w")).alias("stem")).agg(F.count("*").alias("n"), F.count_distinct("w").alias("forms"))


Q06 = f"""WITH {WORKS_SQL}, x AS (SELECT unnest(regexp_extract_all({fold_sql("body")}, '[0-9a-z]+')) AS w FROM works)
SELECT {stem_sql("w")} AS stem, count(*) AS n, count(DISTINCT w) AS forms FROM x GROUP BY 1"""


def q07_names(spark, d):
    raw = F.concat_ws(" ", F.lit("王海森"), F.col("c_name"), F.lit("李明"))
    return table(spark, d, "customer").select("c_custkey", F.array_join(t.names(raw), "|").alias("names"))


Q07 = f"SELECT c_custkey, '王海森|' || {fold_sql('c_name')} || '|李明' AS names FROM customer"


def q08_topics(spark, d):
    raw = F.concat(F.lit(" "), "lang", F.lit("\\ "), "source", F.lit(" ;; none ; "), "lang", F.lit("\\"), "source", F.lit(";x\\y"))
    found = table(spark, d, "documents").select("doc_id", F.posexplode(t.topic_pairs(raw)).alias("pos", "pair"))
    return found.select("doc_id", "pos", "pair.domain", "pair.subtopic")


Q08 = "SELECT doc_id, p.pos::INTEGER AS pos, CASE p.pos WHEN 0 THEN lang ELSE 'x' END AS domain, CASE p.pos WHEN 0 THEN source ELSE 'y' END AS subtopic FROM documents, (VALUES (0), (1)) p(pos)"


def q09_chunks(spark, d):
    chunks = passages.chunks(works(spark, d).select("doc_id", F.col("body").alias("text")))
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max(F.length("text")).alias("longest"), F.sum(F.when(F.col("ordinal") == 0, 1)).alias("firsts"))


#: CTE chunks (doc_id, ordinal, text) of the works of a selection of doc_ids, in a WITH RECURSIVE.
CHUNKS_SQL = """src AS (SELECT doc_id, trim(regexp_replace(body, '\\s+', ' ', 'g')) AS text FROM works WHERE doc_id IN ({0})
), long AS (SELECT doc_id, text, length(text) AS n FROM src WHERE length(text) >= 12
), steps AS (SELECT doc_id, text, n, 0 AS ordinal, 0 AS pos, CASE WHEN n <= 1200 THEN n WHEN strpos(reverse(substr(text, 601, 600)), ' ') > 0 THEN 1200 - strpos(reverse(substr(text, 601, 600)), ' ') ELSE 1200 END AS stop FROM long
  UNION ALL SELECT doc_id, text, n, ordinal + 1, b, CASE WHEN n - b <= 1200 THEN n WHEN strpos(reverse(substr(text, b + 601, 600)), ' ') > 0 THEN b + 1200 - strpos(reverse(substr(text, b + 601, 600)), ' ') ELSE b + 1200 END
  FROM (SELECT *, greatest(stop - 150, pos + 1) AS b FROM steps WHERE stop < n)
), chunks AS (SELECT doc_id, ordinal, trim(substr(text, pos + 1, stop - pos)) AS text FROM steps)"""
Q09 = f"WITH RECURSIVE {WORKS_SQL}, {CHUNKS_SQL.format('SELECT doc_id FROM works')} SELECT doc_id, count(*) AS chunks, CAST(max(length(text)) AS INTEGER) AS longest, count(*) FILTER (ordinal = 0) AS firsts FROM chunks GROUP BY doc_id"


def q10_years(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.concat_ws(" ", F.concat(F.lit("from "), 1990 + F.pmod("conv_id", F.lit(40))), F.concat(F.lit("to "), 2000 + F.pmod("conv_id", F.lit(20)), F.lit(", 20001"))).alias("text"))
    return c.select("conv_id", "turn", F.array_join(t.years(F.col("text")), " ").alias("years"), F.regexp_extract("text", r"(?:18|19|20|21)\d{2}", 0).alias("first"))


Q10 = "SELECT conv_id, turn, CASE WHEN 1990 + conv_id % 40 = 2000 + conv_id % 20 THEN (1990 + conv_id % 40)::VARCHAR ELSE (1990 + conv_id % 40) || ' ' || (2000 + conv_id % 20) END AS years, (1990 + conv_id % 40)::VARCHAR AS first FROM conversations"


def q11_without_references(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.when(F.pmod("doc_id", F.lit(3)) == 0, F.concat("text", F.lit("\n References \n[1] A paper"))).otherwise(F.col("text")).alias("text"))
    return docs.select("doc_id", F.length(passages.before_references(F.col("text"))).alias("n"))


Q11 = "SELECT doc_id, CAST(length(text) + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS n FROM documents"


def q38_redact(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat("text", F.lit(" Authorization: Bearer abc.def; password=x1, https://u:p@host.org/a/b?q=1#f")).alias("text"))
    clean = t.sanitize_text(F.col("text"))
    return docs.select("doc_id", F.md5(clean).alias("digest"), F.regexp_count(clean, F.lit("<REDACTED>")).alias("withheld"))


Q38 = rf"""WITH x AS (SELECT doc_id, text || ' Authorization: Bearer abc.def; password=x1, https://u:p@host.org/a/b?q=1#f' AS text FROM documents
), b AS (SELECT doc_id, regexp_replace(text, '(?i)\bauthorization\s*:\s*bearer\s+[^\s,;]+', 'Authorization: <REDACTED>', 'g') AS text FROM x
), n AS (SELECT doc_id, regexp_replace(text, '(?i)\b({t.SECRET_NAMES})\b\s*[:=]\s*(?:bearer\s+)?([^\s,;&]+)', '\1=<REDACTED>', 'g') AS text FROM b
), u AS (SELECT doc_id, regexp_replace(text, '(?i)(https?://)(?:[^\s/@<>"'']*@)?([^\s?#<>"'']*)[^\s<>"'']*', '\1\2', 'g') AS text FROM n)
SELECT doc_id, md5(text) AS digest, CAST(len(regexp_extract_all(text, '<REDACTED>')) AS INTEGER) AS withheld FROM u"""


def q39_leaks(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    named = F.regexp_extract_all("text", F.lit(rf"(?i)\b({t.SECRET_NAMES})\b\s*[:=]\s*(?:bearer\s+)?([^\s,;&]+)"), F.lit(2))
    return lines.withColumn("found", F.size(F.filter(named, lambda v: ~F.lower(v).isin("true", "false", "none", "<redacted>")))).where("found > 0").select("doc_id", "line", "found")


Q39 = rf"""WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), y AS (SELECT doc_id, unnest(l) AS s, unnest(range(len(l))) AS line FROM x),
z AS (SELECT doc_id, line, list_filter(regexp_extract_all(s, '(?i)\b({t.SECRET_NAMES})\b\s*[:=]\s*(?:bearer\s+)?([^\s,;&]+)', 2), lambda v: lower(v) NOT IN ('true', 'false', 'none', '<redacted>')) AS f FROM y)
SELECT doc_id, CAST(line AS INTEGER) AS line, CAST(len(f) AS INTEGER) AS found FROM z WHERE len(f) > 0"""

QUERIES = {f.__name__: f for f in (q01_doi, q02_fold, q02_compatible, q03_paper_id, q04_file_name, q05_tokens, q06_stems, q07_names, q08_topics, q09_chunks, q10_years, q11_without_references, q38_redact, q39_leaks)}
ORACLES = {"q01_doi": Q01, "q02_fold": Q02, "q02_compatible": Q02N, "q03_paper_id": Q03, "q04_file_name": Q04, "q05_tokens": Q05, "q06_stems": Q06, "q07_names": Q07, "q08_topics": Q08, "q09_chunks": Q09, "q10_years": Q10, "q11_without_references": Q11, "q38_redact": Q38, "q39_leaks": Q39}
