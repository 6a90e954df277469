"""What the reviewer found in round 4."""

import duckdb
from pyspark.sql import functions as F

from lectern.operators import catalog, index, search
from lectern.plans import search as plans


def test_titles_in_citations_are_read_as_their_sql_says(spark, tmp_path):
    """Titles with "et al", with words of one letter and repeats around "and", short, empty and missing ones, in each of the three styles."""
    titles = ["Et al the words", "words et al", "an etale title", "et alto", "ET AL", "of and a and in", "and x and", "red and red", "a b and c and a b", "a and b and c and d and e and f and g", "", "abc", "and", "red sea and a stone", None]
    rows = [(3 * k + style, None if title is None else f"{title}\nbody", "en", "src1") for k, title in enumerate(titles) for style in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(plans.ORACLES["q25_parse"]).fetchall()
    got = [tuple(r) for r in plans.q25_parse(spark, str(tmp_path)).collect()]
    assert sorted(got, key=lambda r: r[0]) == sorted(want, key=lambda r: r[0]) and len(got) == 45


def test_names_before_a_year_leave_out_et_al_and_repeats(spark):
    rows = [(1, "Biddle et al. 2009"), (2, "O'Neil, P., D'Arcy, K., & Biddle, O'Neil (2001). Words of a title."), (3, "李明《一个 a 标题》2019"), (4, "Kim, “Of words and a sea”, 1999"), (5, "Biddle and Biddle et al.")]
    got = spark.createDataFrame(rows, "k int, text string").select("k", catalog.parse_citation(F.col("text")).alias("c")).select("k", "c.authors", "c.title").collect()
    assert {r["k"]: r["authors"] for r in got} == {1: ["Biddle"], 2: ["O'Neil", "D'Arcy", "Biddle"], 3: ["李明", "《一个", "标题》"], 4: ["Kim", "“Of words", "a sea”"], 5: ["Biddle", "Biddle et al"]}
    assert {r["k"]: r["title"] for r in got if r["k"] != 2} == {1: "", 3: "一个 a 标题", 4: "Of words and a sea", 5: "Biddle and Biddle et al."}


def test_every_item_of_the_benchmark_is_asked_for(spark):
    folder = "/root/testdata/sf0.001"
    items = {r["item_id"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id").collect()}
    assert {r["query"] for r in plans.q20_contributions(spark, folder).select("query").distinct().collect()} == items and len(items) == 40


def test_missing_texts_languages_and_sources(spark, tmp_path):
    rows = [(k, [None, "", "red sea en\nof de stones", "the sea"][k % 4], ["en", None, "de"][k % 3], ["src1", "src2", None, None, "src1"][k % 5]) for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, None), (1, ""), (2, "En src1 sea stones"), (3, "de src2 author 7")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(plans.ORACLES["q20_contributions"]).fetchall()
    assert sorted(tuple(r) for r in plans.q20_contributions(spark, str(tmp_path)).collect()) == sorted(want) and len(want) > 8


def test_totals_are_the_sums_of_contributions(spark, tmp_path):
    """For tokens of several queries, of other weights and in no work, and works with empty and missing fields."""
    rows = [(k, None if k % 5 == 0 else f"red sea {k % 3}", "" if k % 4 == 0 else "the sea stones " * (k % 7), "方法" * (k % 2)) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, title string, body string, journal string")
    terms = spark.createDataFrame([(1, "sea", 1.0), (1, "sea", 0.5), (1, "stone", 1.5), (2, "sea", 1.0), (2, "方法", 0.8), (3, "nowhere", 1.0)], "query long, token string, weight double")
    fields = {"title": 3.0, "journal": 1.0, "body": 1.0}
    parts = search.term_scores(index.build(docs, list(fields), f"{tmp_path}/index"), terms, fields)
    want = parts.groupBy("query", "token", "field").agg(F.count("*").alias("works"), F.sum("contribution").alias("total")).collect()
    got = search.contribution_totals(docs, terms, fields)
    rows = lambda x: {(r["query"], r["token"], r["field"], r["works"], round(r["total"], 9)) for r in x}
    assert rows(got.collect()) == rows(want) and len(want) == 6
    assert search.contribution_totals(docs.limit(0), terms, fields).count() == 0
