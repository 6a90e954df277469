"""Ledgers that are not whole, packs that are stored, reasons of results, summaries in order, and a lookup after a change."""

import json

import pytest
from pyspark.sql import functions as F

from lectern.operators import queues, search
from lectern.sources import commits, files


def test_ledgers(spark, tmp_path):
    row = {"record_type": "attempt", "source": "s", "identifier": "i", "timestamp": "2026-01-01T10:00:00+08:00"}
    path = tmp_path / "good.jsonl"
    path.write_text(json.dumps(row) + "\n" + json.dumps({**row, "timestamp": "2026-01-01T02:00:00Z"}) + "\n")
    rows = files.read_ledger(spark, str(path), "fetches").select(F.date_format("ts", "HH:mm").alias("t")).collect()
    assert [r["t"] for r in rows] == ["02:00", "02:00"]
    for bad in ({**row, "timestamp": "2026-01-01T10:00:00"}, {**row, "source": " "}, {k: v for k, v in row.items() if k != "identifier"}):
        path.write_text(json.dumps(row) + "\n" + json.dumps(bad) + "\n")
        with pytest.raises(Exception, match="not whole"):
            files.read_ledger(spark, str(path), "fetches").collect()
    path.write_text(json.dumps(row) + "\nnot json\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_ledger(spark, str(path), "fetches").collect()


def test_provenance(spark, tmp_path):
    row = {"paper_id": "P1", "topics": ["a"], "assignment_source": "AUTOMATIC", "timestamp": "2026-01-01T10:00:00Z"}
    path = tmp_path / "p.jsonl"
    path.write_text("\n".join([json.dumps(row), "{", json.dumps({**row, "timestamp": "2026-01-02T10:00:00Z", "topics": ["b"]}), json.dumps({**row, "paper_id": ""}), json.dumps({**row, "timestamp": "soon"})]))
    rows, malformed = files.read_provenance(spark, str(path))
    assert malformed == 3 and [(r["topics"], r["latest"]) for r in rows.orderBy("ts").collect()] == [(["a"], False), (["b"], True)]


def test_packs_are_stored_whole_and_once(spark, tmp_path):
    pack = spark.createDataFrame([(1, 1, "CORE", 7, 2.0, "h7"), (1, 2, "METHOD", 8, 3.0, "h8"), (2, 1, "CORE", 7, 1.0, "h7")], "query int, place int, role string, doc_id long, score double, sha256 string")
    texts = spark.createDataFrame([(7, "Seven", True), (8, "Eight", False)], "doc_id long, title string, readable boolean")
    queries = spark.createDataFrame([(1, "first words"), (2, "other words")], "query int, text string")
    path = f"file://{tmp_path}/packs"
    assert search.write_pack(pack, texts, queries, path, "b1") and not search.write_pack(pack, texts, queries, path, "b1")
    read = {t: commits.read(spark, path, t) for t in ("manifest", "ranking", "evidence_plan", "readme")}
    assert {(r["text"], r["entries"], r["works"], r["copies"]) for r in read["manifest"].collect()} == {("first words", 2, 2, 0), ("other words", 1, 1, 0)}
    assert [(r["doc_id"], r["rank"]) for r in read["ranking"].where("rank = 1").orderBy("doc_id").collect()] == [(7, 1), (8, 1)]
    assert {r["extract"] for r in read["evidence_plan"].where("doc_id = 8").collect()} == {search.GUIDANCE["METHOD"]}
    assert sorted(r["readme"] for r in read["readme"].collect())[0] == "# Reading pack: first words\n\n1. [CORE] Seven\n2. [METHOD] Eight (no readable text here)\n"


def test_reasons(spark):
    results = spark.createDataFrame([(1, 7), (1, 8), (1, 9)], "query int, doc_id long")
    roles = spark.createDataFrame([(7, "CORE"), (8, "METHOD"), (9, "BACKGROUND")], "doc_id long, role string")
    found = spark.createDataFrame([(7, "heat", "journal", "warm"), (7, "heat", "title", "hot"), (7, "mass", "title", "big")], "doc_id long, concept string, field string, term string")
    facets = spark.createDataFrame([("heat", "PHENOMENON"), ("mass", "MECHANISM")], "concept string, facet string")
    parts = spark.createDataFrame([(1, 8, "title", "alpha", 2.0), (1, 8, "title", "be", 1.0), (1, 8, "authors", "lee", 9.0), (1, 8, "title", "x", 1.0)], "query int, doc_id long, field string, token string, contribution double")
    passages = spark.createDataFrame([(1, 7, 3), (1, 7, 0), (1, 8, 1)], "query int, doc_id long, ordinal int")
    got = {r["doc_id"]: r["reason"] for r in search.reasons(results, roles, found, facets, parts, passages).collect()}
    assert got[7] == "CORE: title「big」→ mass (mechanism); title「hot」→ heat (phenomenon); journal「warm」→ heat (phenomenon); full text p.1, 4"
    assert got[8] == "METHOD: lexical match on authors「lee」, title「alpha/be」; full text p.2"
    assert got[9] == "BACKGROUND: topic overlap only"


def test_summaries_are_read_in_order(spark):
    rows = spark.createDataFrame([(1, "A then B then C"), (2, "B A C"), (3, "A B"), (4, ""), (5, None), (6, "ABAC")], "request int, text string")
    assert {r["request"]: r["missing"] for r in queues.confirm_summary(rows, ["A", "B", "C"]).collect()} == {1: None, 2: "B", 3: "C", 4: "A", 5: "A", 6: None}
