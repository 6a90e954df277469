"""Terms in texts, strings in strings, the segments of an index, and functions that users bring: each against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.functions import extensions
from lectern.functions import text as text_of
from lectern.operators import catalog, index, matcher, search, substrings


def test_terms_in_texts(spark, monkeypatch):
    """All terms of all kinds, also over several automata."""
    rng = random.Random(2)
    words = ["a", "ab", "ba", "b", "数", "数字", "字", "ab数", "c"]
    texts = [(k, " ".join(rng.choices(words, k=rng.randint(0, 9))), rng.choice(["Ab, ba!", "", None, "数字 ab"])) for k in range(120)]
    terms = [(k, " ".join(rng.choices(words, k=n)), n) for k, n in enumerate([1] * 9 + [2] * 60 + [3] * 40)] + [(200, "!!", 0), (201, "AB", 1), (202, "ab", 2)]
    docs = spark.createDataFrame(texts, "doc_id int, one string, two string").repartition(3)
    lexicon = spark.createDataFrame(terms, "label int, term string, n int")
    fold = lambda x: " ".join(re.sub(r"[^\w]+", " ", (x or "").lower()).split())
    want = set()
    for k, one, two in texts:
        for f, text in (("one", fold(one)), ("two", fold(two))):
            for label, term, _ in terms:
                x = fold(term)
                if x and (x in text if re.search("[数字]", x) else f" {x} " in f" {text} "):
                    want.add((k, f, label))
    for size, few in ((matcher.AUTOMATON, matcher.IN_DRIVER), (40, 5)):
        monkeypatch.setattr(matcher, "AUTOMATON", size)
        monkeypatch.setattr(matcher, "IN_DRIVER", few)
        found = matcher.find(docs, lexicon, ["one", "two"])
        assert found.columns == ["doc_id", "field", "label", "term", "n"]
        got = [(r["doc_id"], r["field"], r["label"]) for r in found.collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert matcher.find(docs, lexicon.limit(0), ["one"]).count() == 0 and matcher.find(docs.limit(0), lexicon, ["one"]).count() == 0


def test_ten_thousand_terms(spark):
    terms = spark.range(10_000).select(F.col("id").alias("label"), F.concat(F.lit("term "), F.col("id")).alias("term"))
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("of term "), F.col("id") * 7, F.lit(" and Term-"), F.col("id"), F.lit(".")).alias("text"))
    got = matcher.find(docs, terms, ["text"]).groupBy("doc_id").agg(F.sort_array(F.collect_set("label")).alias("l")).collect()
    assert len(got) == 200 and all(r["l"] == sorted({r["doc_id"] * 7, r["doc_id"]}) for r in got)


def test_strings_in_strings(spark):
    rng = random.Random(8)
    make = lambda n, top: ["".join(rng.choices("abc 数", k=rng.randint(0, top))).strip() for _ in range(n)]
    short, long = make(150, 5), make(120, 14)
    s, n = spark.createDataFrame([(x,) for x in short], "short string"), spark.createDataFrame([(x,) for x in long], "long string")
    for least in (1, 2):
        got = [tuple(r) for r in substrings.inside(s, n, least).collect()]
        assert len(got) == len(set(got)) and set(got) == {(a, b) for a in short for b in long if len(a) >= least and a in b}
    got = {tuple(r) for r in substrings.alike(s.withColumnRenamed("short", "wanted"), n.withColumnRenamed("long", "name")).collect()}
    assert got == {(a, b) for a in short for b in long if a and b and (a == b or (len(a) >= 2 and a in b) or (len(b) >= 2 and b in a))}


def test_lookup_by_parts_of_names(spark):
    works = spark.createDataFrame([(1, None, "t1", ["Ann Lee", "王小明"], "Journal of X"), (2, None, "t2", ["Leeds"], "Y"), (3, None, "t3", ["o"], "Z")], "doc_id long, doi string, title string, authors array<string>, journal string")
    asked = [(1, None, None, None, "lee", None, None, False), (2, None, None, None, "王小明博士", None, None, False), (3, None, None, None, None, "o", None, False), (4, None, None, None, None, "leeds uni", None, False), (5, None, None, None, None, None, "x", False), (6, None, None, None, None, "nobody", None, False)]
    wanted = spark.createDataFrame(asked, "query int, id long, doi string, title string, author string, bare string, journal string, exact boolean")
    got = {(r["query"], r["doc_id"], r["matched_on"]) for r in catalog.lookup(works, wanted).collect()}
    assert got == {(1, 1, "author"), (1, 2, "author"), (2, 1, "author"), (3, 3, "author"), (4, 2, "author"), (5, 1, "journal"), (6, None, None)}


def test_postings_are_the_tokens_of_the_texts(spark, monkeypatch):
    """Counted in Python, as the columns' expressions tokenise: stems, stop words, CJK runs, accents, long texts in parts."""
    rng = random.Random(3)
    words = "the classes churches tries ties dies sing singing runners bus kiss this is as glasses ashes os 7s x1y2 Éclairs naïve 数字的金融 了 数 カタカナ 한국어 STRASSE Straße a-b c_d".split()
    texts = [(k, " ".join(rng.choices(words, k=rng.randint(0, 60))), rng.choice(words) if k % 3 else None) for k in range(150)]
    docs = spark.createDataFrame(texts, "doc_id int, one string, two string")
    fields = ("one", "two")
    each = docs.select("doc_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), text_of.tokens(F.col(f)).alias("ts")) for f in fields])).alias("x")).select("doc_id", "x.field", F.size("x.ts").alias("len"), F.explode("x.ts").alias("token"))
    want = sorted(map(tuple, each.groupBy("doc_id", "field", "token", "len").agg(F.count("*").alias("tf")).select("doc_id", "field", "token", "tf", "len").collect()))
    for part in (index.PART, 5):
        monkeypatch.setattr(index, "PART", part)
        assert sorted(map(tuple, index.postings(docs, list(fields)).collect())) == want


DOCS = "doc_id long, title string, body string"


def corpus(n, changed=()):
    return [(k, f"title {k} of {k % 5}" + (" changed" if k in changed else ""), f"body words {k} " + "and more words " * (k % 90)) for k in range(n)]


def test_index_of_changed_works_alone(spark, tmp_path, monkeypatch):
    """After any changes the index is what it would be if it were built anew, whatever segments it has; only changed works are read."""
    fields, path = ["title", "body"], f"file://{tmp_path}/i"
    states = [corpus(40), corpus(40, {3, 9}), corpus(46, {3}), [r for r in corpus(46, {3}) if r[0] % 4], corpus(46, {3})]
    monkeypatch.setattr(index, "SEGMENTS", 3)
    read = []
    plain = index.postings
    monkeypatch.setattr(index, "postings", lambda docs, f, key="doc_id": read.append(docs.count()) or plain(docs, f, key) if f == fields else plain(docs, f, key))
    for k, rows in enumerate(states):
        docs = spark.createDataFrame(rows, DOCS)
        assert index.status(docs, path) == ("STALE" if k else "ABSENT")
        index.update(docs, fields, path, passages_of="body")
        assert index.status(docs, path) == "FRESH" and index.update(docs, fields, path, passages_of="body") == 0
        assert all(r["ok"] for r in index.validate(spark, path).collect())
        now = index.read(spark, path)
        want = plain(docs, fields)
        assert sorted(map(tuple, now.postings.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
        avg = {r["field"]: (r["n"], r["avg_len"]) for r in now.stats.collect()}
        for f in fields:
            lens = want.where(F.col("field") == f).groupBy("doc_id").agg(F.max("len").alias("l")).agg(F.sum("l")).first()[0]
            assert avg[f] == (len(rows), pytest.approx(lens / len(rows)))
        assert {r["doc_id"] for r in now.chunks.collect()} == {r[0] for r in rows}
    assert read == [40, 2, 7, 0, 12]
    with pytest.raises(ValueError):
        index.update(docs, ["title"], path)


def test_stored_passages_are_searched(spark, tmp_path):
    rows = corpus(30)
    docs = spark.createDataFrame(rows, DOCS)
    made = index.build(docs, ["title", "body"], f"file://{tmp_path}/i", passages_of="body")
    terms = search.plain_terms(spark.createDataFrame([(1, "body 7"), (2, "more")], "query int, text string"))
    first = spark.createDataFrame([(q, k) for q in (1, 2) for k in range(20)], "query int, doc_id long")
    got = search.passage_scores(made, first, terms)
    best = {r["query"]: r["doc_id"] for r in got.groupBy("query").agg(F.max_by("doc_id", "score").alias("doc_id")).collect()}
    assert best[1] == 7 and got.where("query = 2 AND doc_id = 0").count() == 0


def test_reranker_that_fails_changes_nothing(spark):
    results = spark.createDataFrame([(q, k, float(10 - k), f"t{k}") for q in (1, 2, 3) for k in range(5)], "query int, doc_id long, score double, title string")

    def reverse(found):
        if found["query"].iloc[0] == 2:
            raise RuntimeError("no model")
        return [float("nan")] * len(found) if found["query"].iloc[0] == 3 else found["doc_id"].astype(float)

    extensions.register("reranker", "reverse", reverse)
    rows = extensions.rerank(results, "reverse").orderBy("query", "rank").collect()
    order = {q: [r["doc_id"] for r in rows if r["query"] == q] for q in (1, 2, 3)}
    assert order == {1: [4, 3, 2, 1, 0], 2: [0, 1, 2, 3, 4], 3: [0, 1, 2, 3, 4]}
    assert {(r["query"], r["error"] is None) for r in rows} == {(1, True), (2, False), (3, False)} and any("no model" in (r["error"] or "") for r in rows)
    few = extensions.rerank(results, "reverse", most=2).where("query = 1").orderBy("rank").collect()
    assert [r["doc_id"] for r in few] == [1, 0, 2, 3, 4]
    with pytest.raises(KeyError):
        extensions.rerank(results, "unknown")
    with pytest.raises(ValueError):
        extensions.register("thing", "x", len)


def test_readers_and_aggregates(spark):
    files = spark.createDataFrame([("a", b"caf\xc3\xa9"), ("b", b"\xff"), ("c", None)], "path string, content binary")
    rows = {r["path"]: (r["text"], r["error"]) for r in extensions.texts(files, "utf8").collect()}
    assert rows["a"] == ("café", None) and rows["b"][0] is None and "UnicodeDecodeError" in rows["b"][1] and "AttributeError" in rows["c"][1]
    assert "h_index" in extensions.register_all(spark)
    spark.createDataFrame([(1, 5), (1, 4), (1, 3), (1, 1), (2, 9), (2, None)], "author int, citations int").createOrReplaceTempView("cited")
    assert {tuple(r) for r in spark.sql("SELECT author, h_index(citations) FROM cited GROUP BY author").collect()} == {(1, 3.0), (2, 1.0)}
