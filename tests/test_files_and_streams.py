"""Readers and writers over files, and the streaming forms of the ledger against the batch forms."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.operators import ledger
from lectern.sources import files
from lectern.streaming import ledger as streams

FOLDER = "/root/testdata/sf0.001"


def drain(spark, frame, name):
    q = frame.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_tolerant_and_strict(spark, tmp_path):
    path = tmp_path / "papers.jsonl"
    path.write_text('{"paper_id": "P1", "line": 1}\nnot json\n{"paper_id": "P1", "line": 3}\n{"line": 4}\n')
    schema = StructType.fromDDL("paper_id string, line int")
    rows, bad = files.read_tolerant(spark, str(path), schema)
    assert rows.count() == 3 and [r["line"] for r in bad.collect()] == ["not json"]
    try:
        files.read_strict(spark, str(path), schema).collect()
        raise AssertionError("a bad line was let through")
    except Exception as e:
        assert "MALFORMED" in str(e).upper()
    topics = spark.createDataFrame([("P1", "a", 2), ("P1", "b", 1)], "paper_id string, topics string, line int")
    works, problems = files.load_catalog(rows, topics)
    assert [tuple(r) for r in works.collect()] == [("P1", 1, "b")]
    assert sorted((r["line"], r["problem"]) for r in problems.collect()) == [(3, "repeated id"), (4, "no id")]


def test_writers(spark, tmp_path):
    works = spark.createDataFrame([("P2", ["a", "b"]), ("P1", [])], "paper_id string, authors array<string>")
    target = files.write_catalog(works, str(tmp_path / "json"))
    lines = [json.loads(x) for p in sorted((tmp_path / "json" / target.rpartition("/")[2]).glob("part-*")) for x in p.read_text().splitlines()]
    assert [x["paper_id"] for x in lines] == ["P1", "P2"]
    files.write_csv(works, str(tmp_path / "csv"))
    assert {r["authors"] for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()} == {"a; b", None}
    (tmp_path / "x.pdf").write_bytes(b"%PDF-1.4 ...")
    (tmp_path / "y.pdf").write_bytes(b"<html>")
    kinds = files.signature(spark.read.format("binaryFile").load(str(tmp_path / "*.pdf"))).collect()
    assert sorted(r["kind"] for r in kinds) == ["HTML", "PDF"]


def test_streams(spark):
    batch = spark.read.parquet(f"{FOLDER}/events.parquet")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(FOLDER)
    shape = lambda e: e.select(
        F.col("event_id").alias("attempt"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("source"), F.concat(F.lit("id"), F.col("user_id") % 7).alias("identifier"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 13 == 0).alias("refetch")
    )
    want = {tuple(r) for r in ledger.admit(shape(batch), 2, 5).collect()}
    assert {tuple(r) for r in drain(spark, streams.admit(shape(stream), 2, 5), "admitted").collect()} == want
    hours = drain(spark, streams.hourly(stream), "hours").agg(F.sum("n")).first()[0]
    assert 0 < hours <= batch.count()


def test_terms_catalogs_and_runs(spark, tmp_path):
    (tmp_path / "lexicon.json").write_text(json.dumps({"concepts": [{"key": "a", "facet": "METHOD", "terms": ["x", "y"], "topics": ["t"]}, {"key": "b", "facet": "OUTCOME", "terms": ["z"], "topics": []}]}))
    rows = sorted(map(tuple, files.load_terms(spark, str(tmp_path / "lexicon.json"), "lexicon").collect()), key=repr)
    assert rows == [("a", "METHOD", "x", "t"), ("a", "METHOD", "y", "t"), ("b", "OUTCOME", "z", None)]
    (tmp_path / "taxonomy.json").write_text(json.dumps({"domains": {"d": ["s", "t"], "e": ["s"]}}))
    with pytest.raises(ValueError):
        files.load_terms(spark, str(tmp_path / "taxonomy.json"), "taxonomy")
    (tmp_path / "aliases.json").write_text(json.dumps({"aliases": {"s": ["one", "two"]}}))
    assert files.load_terms(spark, str(tmp_path / "aliases.json"), "aliases").count() == 2
    topics = spark.createDataFrame([(1, "P0", "a"), (2, "P0", "b"), (3, None, "c")], "line int, paper_id string, topics string")
    assert list(map(tuple, files.load_last(topics).collect())) == [("P0", "b")]
    good = spark.createDataFrame([("P0123456789AB", "1"), ("P0123456789AC", "1")], "paper_id string, schema_version string")
    assert files.refuse(good, version="1").count() == 2
    for bad in (good.union(good), good.union(spark.createDataFrame([("x", "1")], good.schema)), good.union(spark.createDataFrame([("P0123456789AD", "2")], good.schema))):
        with pytest.raises(ValueError):
            files.refuse(bad, version="1").count()
    manifest = files.write_run(str(tmp_path / "run"), {"q": 1}, topics, good, good)
    assert {r["name"]: r["rows"] for r in manifest.collect()} == {"request": 1, "queries": 3, "results": 2, "screening": 2}
    assert tuple(files.envelope(good, topics.limit(0), "FRESH").first()) == ("1", "FRESH", 2, 0, False)
