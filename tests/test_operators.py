"""Rules that the tables do not show, on small rows written out by hand."""

import random

from pyspark.sql import functions as F

from lectern.functions import register
from lectern.functions import text as t
from lectern.operators import catalog, dedupe, ledger, markup, pages, passages, screening, versions


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_doi(spark):
    cases = {
        "https://doi.org/10.1000/ABC.1": "10.1000/abc.1", "doi: 10.1000%2Fx.y)": "10.1000/x.y", "see 10.12345/a#frag": "10.12345/a", "10.1/short": None, "": None, "http://dx.doi.org/10.1016/j.a,": "10.1016/j.a",
    }
    for raw, doi in cases.items():
        assert one(spark, t.normalize_doi(F.lit(raw))) == doi, raw
    assert one(spark, t.normalize_doi(F.lit(None).cast("string"))) is None


def test_fold_and_tokens(spark):
    assert one(spark, t.fold(F.lit("  Groß—Test: (A)  "))) == "gross test a"
    assert one(spark, t.normalize_title(F.lit("!!"))) is None
    assert one(spark, t.fold(t.nfkc(F.lit("ＡＢＣ")))) == "abc"
    assert one(spark, t.tokens(F.lit("企业漂洗 of Firms"))) == ["企", "业", "漂", "洗", "企业", "业漂", "漂洗", "firms", "firm"]
    assert one(spark, t.tokens(F.lit("的X企"))) == ["企", "x"]
    assert one(spark, t.tokens(F.lit(None).cast("string"))) == []


def test_stem(spark):
    for word, want in {"studies": "study", "classes": "class", "matches": "match", "auditing": "audit", "managers": "manag", "firms": "firm", "class": "class", "bonus": "bonus", "is": "is", "gas": "gas"}.items():
        assert one(spark, t.stem(F.lit(word))) == want


def test_redaction(spark):
    assert one(spark, t.sanitize_url(F.lit("https://u:p@h.org:81/a?q=1#f"))) == "https://h.org:81/a"
    assert one(spark, t.sanitize_url(F.lit("ftp://h.org/a"))) == "<REDACTED_URL>"
    text = one(spark, t.sanitize_text(F.lit("token = abc, Authorization: Bearer xyz see https://u@h.org/p?q")))
    assert text == "token=<REDACTED>, authorization=<REDACTED> see https://h.org/p".replace("authorization", "Authorization")


def test_chunks_cover_the_text():
    rng = random.Random(1)
    text = " ".join("x" * rng.randint(1, 30) for _ in range(2000))
    parts = passages.cut(text)
    assert all(len(p) <= passages.SIZE for p in parts) and len(parts) > 20
    at = 0
    for p in parts:
        found = text.find(p, max(0, at - passages.OVERLAP - 1))
        assert 0 <= found <= at + 1
        at = found + len(p)
    assert at == len(text)


def test_dedupe_doi_clash(spark):
    columns = "position long, doi string, title string, year string, first_author string, sha256 string, status string, downloaded boolean"
    rows = [
        (0, "10.1000/a", "One Headline", "2020", None, None, "Other", False),
        (1, "10.1000/b", "One headline", "2020", None, None, "Other", False),  # another DOI under one status: another work
        (2, None, "one headline!", "2020", None, None, "Other", True),  # joins the first that held the key
        (3, "10.1000/a", "Different", "1999", None, None, "Preprint", False),  # a DOI always joins
        (4, None, None, None, None, "FF", "Unknown", False),
        (5, None, None, None, None, "ff", "Unknown", False),
    ]
    got = {r["position"]: r for r in dedupe.deduplicate(spark.createDataFrame(rows, columns)).collect()}
    assert {p: r["canonical"] for p, r in got.items()} == {0: 3, 1: 1, 2: 3, 3: 3, 4: 4, 5: 4}  # a preprint outranks what is only "other"
    assert got[0]["reason"] == "DOI exact match" and got[5]["reason"] == "SHA256 identical file" and got[2]["reason"] == "same-work evidence"


def test_components_of_a_long_chain(spark):
    rows = [(i, k, str(v)) for i in range(200) for k, v in ((0, i // 2), (1, (i + 1) // 2))]
    got = dedupe.components(spark.createDataFrame(rows, "position long, kind int, key string")).collect()
    assert len(got) == 200 and {r["component"] for r in got} == {0}


def test_admission_is_a_fold(spark):
    rows = [(i, "2024-01-01", "s", f"id{i % 3}", i, i % 11 == 0) for i in range(60)]
    got = {r["attempt"]: r["admitted"] for r in ledger.admit(spark.createDataFrame(rows, "attempt long, day string, source string, identifier string, ts long, refetch boolean"), 2, 7).collect()}
    seen, total = {}, 0
    for a, _, _, i, _, r in rows:
        ok = total < 7 and (r or seen.get(i, 0) < 2)
        total += ok
        seen[i] = seen.get(i, 0) + ok
        assert got[a] == ok


def test_article_meta(spark):
    html = '<html><head><meta name="citation_title" content="T"><meta content="A B" name="citation_author"><meta name="citation_author" content="C"><meta name="citation_doi" content="10.1000/X"></head><h1>no</h1></html>'
    ld = '<script type="application/ld+json">{"headline": "L"}</script><h1>no</h1>'
    rows = markup.article(spark.createDataFrame([(1, html), (2, ld), (3, "<h1><b>H</b></h1>"), (4, None)], "page_id int, html string")).orderBy("page_id").collect()
    assert [r["title"] for r in rows] == ["T", "L", "H", None] and rows[0]["authors"] == ["C"] or rows[0]["authors"] == ["A B", "C"]
    assert rows[0]["doi"] == "10.1000/x"


def test_versions_and_screening_on_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, sha256 string, role string, format string, canonical boolean, present boolean")
    assert versions.preferred(empty).count() == 0
    none = spark.createDataFrame([], "doc_id long, title string, abstract string, year int, status string, accessible boolean, doi string")
    assert screening.screen(none, ["a"], [], 2024).count() == 0
    rows = spark.createDataFrame([(1, None, None, None, None, None, None), (2, "exact title", None, 2023, "OnlineFirst", True, "10.1234/x")], none.schema)
    got = {r["doc_id"]: (r["score"], r["decision"]) for r in screening.screen(rows, ["zzz"], ["exact title"], 2024).collect()}
    assert got == {1: (0, "REJECT"), 2: (95, "KEEP")}


def test_ambiguous_citation(spark):
    works = spark.createDataFrame([(1, None, "deep blue sea", ["lee"], "2001"), (2, None, "deep blue sea", ["lee"], "2001"), (3, "10.1000/r", "red hill", ["kim"], "1999"), (4, None, "green", ["gary c biddle"], "2009")], "doc_id long, doi string, title string, authors array<string>, year string")
    rows = [
        (10, None, "deep blue sea today", ["lee"], "2001"), (11, None, "red hill", [], "1999"), (12, None, "nothing here", [], None), (13, "doi:10.1000/R", "wrong", [], None), (14, None, "", ["Biddle"], "2009"), (15, None, None, [], "2009"),
    ]
    cites = spark.createDataFrame(rows, "citation long, doi string, title string, authors array<string>, year string")
    got = {r["citation"]: (r["verdict"], r["match"], r["doc_id"]) for r in catalog.verdicts(cites, works).collect()}
    assert got == {
        10: ("AMBIGUOUS", None, None), 11: ("IN_LIBRARY", "EXACT_TITLE", 3), 12: ("NOT_IN_LIBRARY", None, None), 13: ("IN_LIBRARY", "DOI", 3), 14: ("IN_LIBRARY", "FIELD_AGREEMENT", 4), 15: ("NOT_IN_LIBRARY", None, None),
    }


def test_preferred_versions(spark):
    rows = [
        (1, "a", "Version of Record", "PDF", False, True), (1, "b", "AcceptedManuscript", "PDF", False, True), (2, "c", "OTHER", "CAJ", False, True), (2, "d", "OTHER", "PDF", False, False), (3, "e", None, None, None, False),
    ]
    v = spark.createDataFrame(rows, "doc_id long, sha256 string, role string, format string, canonical boolean, present boolean")
    got = {r["doc_id"]: (r["sha256"], r["score"], r["status"]) for r in versions.preferred(v, spark.range(1, 5).toDF("doc_id")).collect()}
    assert got == {1: ("a", 731, "AVAILABLE"), 2: ("d", 130, "AVAILABLE_NOT_MACHINE_READABLE"), 3: ("e", 0, "FILE_MISSING"), 4: (None, None, "NO_VERSION")}


def test_functions_in_sql(spark):
    assert set(register.register(spark)) >= {"fold", "chunks", "nfkc"}
    r = spark.sql("SELECT fold('Groß—Test: (A)') AS a, normalize_doi('https://doi.org/10.1000/ABC.1).') AS b, years_of('from 1999 to 2010, 1999') AS c, squeeze(' a  b ') AS d, nfkc('ＡＢ') AS e, strip_accents('é') AS f").first()
    assert tuple(r) == ("gross test a", "10.1000/abc.1", ["1999", "2010"], "a b", "AB", "e")
    assert [x["ordinal"] for x in spark.sql("SELECT * FROM chunks(repeat('word ', 600))").collect()] == [0, 1, 2]
