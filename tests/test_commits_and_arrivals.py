"""Commits that count once, ledgers written ahead, waits for files on a stream, and outcomes that come late."""

import datetime as dt
import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.operators import versions
from lectern.sources import commits, shared
from lectern.streaming import arrivals, ledger

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
T0 = dt.datetime(2026, 1, 1, 12, 0, 0)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def rows(spark, n, start=0):
    return spark.range(start, start + n).select(F.col("id").alias("k"))


def test_commits(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert commits.log(spark, path) == []
    assert commits.commit(path, "w", 0, adds={"a": rows(spark, 5)})
    assert not commits.commit(path, "w", 0, adds={"a": rows(spark, 5)})  # the same batch again
    assert commits.commit(path, "v", 0, adds={"a": rows(spark, 3, 5)}, replaces={"b": rows(spark, 2)})
    assert commits.read(spark, path, "a").count() == 8 and commits.read(spark, path, "a", version=0).count() == 5
    rows(spark, 9).write.parquet(f"{path}/data/a-left-over")  # a commit that never came to be
    assert commits.commit(path, "v", 1, replaces={"b": rows(spark, 7)})
    assert commits.read(spark, path, "a").count() == 8 and commits.read(spark, path, "b").count() == 7
    assert commits.compact(spark, path, "a") and not commits.compact(spark, path, "a")
    assert commits.read(spark, path, "a").count() == 8
    assert commits.vacuum(spark, path) == 4  # the left-over, both parts of a, the first b
    assert commits.read(spark, path, "a").count() == 8 and commits.read(spark, path, "b").count() == 7
    with pytest.raises(ValueError):
        commits.read(spark, path, "c")


def test_two_writers_at_once(spark, tmp_path, monkeypatch):
    """Another writer takes the place in the log between reading and entering: the entry goes after it, once."""
    path, plain = f"file://{tmp_path}/t", commits._enter
    commits.commit(path, "a", 0, adds={"x": rows(spark, 1)})
    between = []

    def enter(s, p, entry):
        if not between:
            between.append(1)
            assert plain(s, p, commits.Entry(entry.version, "b", "0", {}))
        return plain(s, p, entry)

    monkeypatch.setattr(commits, "_enter", enter)
    assert commits.commit(path, "a", 1, adds={"x": rows(spark, 2)})
    assert [(e.version, e.writer) for e in commits.log(spark, path)] == [(0, "a"), (1, "b"), (2, "a")]
    assert commits.read(spark, path, "x").count() == 3


def source(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder)


def put(folder, name, values):
    """A file of rows; a stream takes files in the order of their times, here that of their names."""
    folder.mkdir(exist_ok=True)
    file = folder / f"{name}.json"
    file.write_text("\n".join(json.dumps(v) for v in values))
    os.utime(file, (1_700_000_000 + int(name), 1_700_000_000 + int(name)))


def test_sink_loses_and_repeats_nothing(spark, tmp_path, monkeypatch):
    """A stop after a commit and before the batch is checked off: the batch runs again and is left out."""
    for k in range(3):
        put(tmp_path / "in", f"{k}", [{"k": 10 * k + i} for i in range(4)])
    path, check, plain = f"file://{tmp_path}/t", str(tmp_path / "check"), commits.commit
    calls = []

    def stops(*args, **more):
        made = plain(*args, **more)
        calls.append(args[2])
        if len(calls) == 2:
            raise RuntimeError("stopped here")
        return made

    monkeypatch.setattr(commits, "commit", stops)
    stream = source(spark, str(tmp_path / "in"), "k long")
    with pytest.raises(Exception, match="stopped here"):
        commits.sink(stream, path, "a", check).awaitTermination(120)
    commits.sink(stream, path, "a", check).awaitTermination(120)
    assert calls == [0, 1, 1, 2]
    assert sorted(r["k"] for r in commits.read(spark, path, "a").collect()) == sorted(10 * k + i for k in range(3) for i in range(4))


def test_attempts_are_on_the_ledger_first(spark, tmp_path):
    """A run that stops while it acts: the attempts are on the ledger, are not acted on again, and their outcome says so."""
    for k in range(3):
        put(tmp_path / "in", f"{k}", [{"attempt": 10 * k + i} for i in range(3)])
    path, check, acted = f"file://{tmp_path}/t", str(tmp_path / "check"), []

    def act(mine):
        seen = sorted(r["attempt"] for r in mine.collect())
        assert {r["attempt"] for r in commits.read(spark, path, commits.ATTEMPTS).collect()} >= set(seen)
        acted.append(seen)
        if len(acted) == 2:
            raise RuntimeError("stopped while acting")
        return mine.select("attempt", F.lit("ok").alias("outcome"))

    stream = source(spark, str(tmp_path / "in"), "attempt long")
    with pytest.raises(Exception, match="stopped while acting"):
        commits.run_attempts(stream, act, path, check).awaitTermination(120)
    commits.run_attempts(stream, act, path, check).awaitTermination(120)
    outcome = {r["attempt"]: r["outcome"] for r in commits.read(spark, path, commits.OUTCOMES).collect()}
    assert len(acted) == 3 and commits.read(spark, path, commits.ATTEMPTS).count() == 9
    assert outcome == {a: "INTERRUPTED" if a in acted[1] else "ok" for k in range(3) for a in range(10 * k, 10 * k + 3)}


SEEN = "folder string, name string, size long, modified long, at timestamp, before boolean"


def test_arrivals(spark, tmp_path):
    """Folders: a file that is there before, one that grows and then stands still, partial ones, an empty one, one that nothing comes to, two at once."""
    look = lambda s, folder, *files, before=False: [{"folder": folder, "name": n, "size": z, "modified": m, "at": str(at(s)), "before": before} for n, z, m in files]
    listings = [
        look(0, "a", ("old.pdf", 9, 1), before=True) + look(1, "a", ("old.pdf", 9, 1)) + look(1, "b", ("x.pdf.part", 5, 1)) + look(1, "c", ("new.pdf", 4, 1)) + look(1, "e", ("p.pdf", 7, 1), ("q.pdf", 8, 2)) + look(0, "f", ("Same.pdf", 5, 1), before=True),
        look(2, "a", ("old.pdf", 9, 1)) + look(2, "b", ("x.pdf.part", 9, 2), ("y.pdf", 0, 2)) + look(2, "c", ("new.pdf", 8, 2)) + look(2, "e", ("p.pdf", 7, 1), ("q.pdf", 8, 2)) + look(2, "f", ("same.PDF", 6, 2)),
        look(3, "c", ("new.pdf", 8, 2)) + look(3, "b", ("y.pdf", 0, 2)) + look(3, "e", ("p.pdf", 7, 1), ("q.pdf", 8, 2)),
        look(5, "c", ("new.pdf", 8, 2)) + look(5, "a", ("old.pdf", 9, 1)) + look(5, "b", ("y.pdf", 0, 2)) + look(5, "f", ("same.PDF", 6, 2)),
        look(40, "z", ("late.pdf", 1, 1)),
        look(90, "z", ("late.pdf", 1, 1)) + look(4, "c", ("new.pdf", 1, 9)),
    ]
    for k, values in enumerate(listings):
        put(tmp_path / "in", f"{k}", values)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        stream = arrivals.arrivals(source(spark, str(tmp_path / "in"), SEEN), stable_ms=2000, timeout_ms=30_000, late="1 second")
        q = stream.writeStream.format("memory").queryName("arrived").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination(240)
        got = {r["folder"]: (r["outcome"], r["name"], r["size"]) for r in spark.table("arrived").collect()}
        assert spark.table("arrived").count() == len(got)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    # The wait at z has begun after the others and found nothing that stood still in time: its end has not come, or it has timed out.
    assert got.pop("z", ("TIMED_OUT", None, None)) == ("TIMED_OUT", None, None)
    assert got == {"a": ("TIMED_OUT", None, None), "b": ("TIMED_OUT", None, None), "c": ("ARRIVED", "new.pdf", 8), "e": ("ARRIVED", "q.pdf", 8), "f": ("ARRIVED", "same.PDF", 6)}


def test_archive(spark, tmp_path):
    for folder, name, data in (("d1", "a.pdf", b"%PDF one"), ("d2", "a.pdf", b"%PDF two"), ("d3", "a.pdf", b"%PDF one"), ("d4", "b", b"x")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / name).write_bytes(data)
    seen = arrivals.listing(spark, f"{tmp_path}/d*", T0)
    assert {(r["name"], r["size"]) for r in seen.collect()} == {("a.pdf", 8), ("b", 1)}
    for k, (folder, name) in enumerate((("d1", "a.pdf"), ("d2", "a.pdf"), ("d3", "a.pdf"), ("d4", "b"))):
        put(tmp_path / "in", f"{k}", [{"folder": f"file:{tmp_path}/{folder}", "outcome": "ARRIVED", "name": name, "at": 1_767_268_800_000}])
    path = f"file://{tmp_path}/t"
    for _ in range(2):  # run again: nothing is stored twice
        arrivals.archive(source(spark, str(tmp_path / "in"), "folder string, outcome string, name string, at long"), path, str(tmp_path / "check"), "db").awaitTermination(240)
    manifest = {(r["original"].rpartition("/")[0][-2:], r["stored"], r["sha256"]) for r in commits.read(spark, path, "manifest").collect()}
    one, two, x = (hashlib.sha256(d).hexdigest() for d in (b"%PDF one", b"%PDF two", b"x"))
    assert manifest == {("d1", "a.pdf", one), ("d2", f"a_{two[:12]}.pdf", two), ("d3", "a.pdf", one), ("d4", "b", x)}
    stored = {r["stored"]: bytes(r["content"]) for r in commits.read(spark, path, "archive").collect()}
    assert stored == {"a.pdf": b"%PDF one", f"a_{two[:12]}.pdf": b"%PDF two", "b": b"x"} and commits.read(spark, path, "archive").count() == 3


def test_late_outcomes(spark, tmp_path):
    """The stream of attempts with their outcomes gives the rows of the tables, those without any once the watermark has passed."""
    a = [{"attempt": i, "source": f"s{i % 2}", "identifier": f"i{i % 5}", "ts": str(at(60 * i))} for i in range(30)]
    o = [{"source": f"s{i % 2}", "identifier": f"i{i % 5}", "ts": str(at(60 * i + d)), "outcome": f"{i}/{d}"} for i in range(30) if i % 3 for d in (20, 400)]
    end = [{"attempt": 99, "source": "x", "identifier": "x", "ts": str(at(90_000))}]
    put(tmp_path / "a", "0", a[:20])
    put(tmp_path / "a", "1", a[20:])
    put(tmp_path / "a", "2", end)
    put(tmp_path / "o", "0", o[30:])
    put(tmp_path / "o", "1", o[:30])
    put(tmp_path / "o", "2", [{"source": "x", "identifier": "y", "ts": str(at(90_000)), "outcome": "end"}])
    kinds = ("attempt long, source string, identifier string, ts timestamp", "source string, identifier string, ts timestamp, outcome string")
    joined = ledger.resolved(source(spark, str(tmp_path / "a"), kinds[0]), source(spark, str(tmp_path / "o"), kinds[1]), "5 minutes", "1 hour")
    q = joined.writeStream.format("memory").queryName("resolved").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    table = lambda name, kind: spark.read.schema(kind).json(str(tmp_path / name))
    want = ledger.resolved(table("a", kinds[0]), table("o", kinds[1]), "5 minutes", "1 hour").where("attempt < 99")
    got = spark.table("resolved").where("attempt < 99")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    last = {r["attempt"]: r["outcome"] for r in ledger.last_outcome(got).collect()}
    brute = {}
    for x in a:
        fits = [y for y in o if (y["source"], y["identifier"]) == (x["source"], x["identifier"]) and x["ts"] <= y["ts"] <= str(dt.datetime.fromisoformat(x["ts"]) + dt.timedelta(minutes=5))]
        brute[x["attempt"]] = max(fits, key=lambda y: y["ts"])["outcome"] if fits else None
    assert last == brute and None in brute.values()


def test_kept_tables_are_released(spark):
    mark = shared.kept()
    kept = shared.keep(rows(spark, 3))
    assert kept.count() == 3 and shared.kept() == mark + 1
    assert shared.release(spark, mark) == 1 and shared.kept() == mark


def test_corrections_and_their_log_come_together(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    known = [("P1", None, "Old title", ["A"], "2001", "J", 1), ("P2", "10.1000/x", "T", ["A"], "2002", "K", 2)]
    works = spark.createDataFrame(known, "paper_id string, doi string, title string, authors array<string>, year string, journal string, n int")
    works = works.withColumn("paper_id", text.paper_id(F.col("doi"), F.col("title"), F.col("year"), F.get("authors", 0)))
    assert commits.commit(path, "load", 0, adds={"works": works})
    ids = {r["n"]: r["paper_id"] for r in works.collect()}
    kind = "position int, paper_id string, title string, authors array<string>, year string, journal string, reason string, evidence string"
    asked = [(1, ids[1], "OLD Title.", None, None, "J1", None, "page"), (2, ids[1], "New", None, None, None, None, "page"), (3, ids[2], "Any title", ["B"], "1999", None, "typo", None), (4, "P9", "x", None, None, None, None, None), (5, ids[1], None, None, None, "J2", None, None), (6, ids[1], None, None, None, None, None, None)]
    corrections = spark.createDataFrame(asked, kind)
    plain, between = commits.commit, []

    def commit(p, writer, batch, **more):
        if writer == "corrections" and not between:
            between.append(1)
            plain(p, "other", 0, adds={"notes": rows(spark, 1)})
        return plain(p, writer, batch, **more)

    monkeypatch.setattr(commits, "commit", commit)
    assert versions.commit_corrections(corrections, path, "b1") and not versions.commit_corrections(corrections, path, "b1")
    got = {r["n"]: (r["title"], r["authors"], r["year"], r["journal"], r["paper_id"]) for r in commits.read(spark, path, "works").collect()}
    assert got == {1: ("OLD Title.", ["A"], "2001", "J2", ids[1]), 2: ("Any title", ["B"], "1999", "K", ids[2])}
    events = {r["position"]: (r["status"], r["changed"], r["reason"]) for r in commits.read(spark, path, "corrections").collect()}
    assert {k: v[0] for k, v in events.items()} == {1: "APPLIED", 2: "IDENTITY_CHANGES", 3: "APPLIED", 4: "WORK_NOT_FOUND", 5: "APPLIED", 6: "NOTHING_TO_CHANGE"}
    assert events[1][1] == ["title", "journal"] and events[3][2] == "typo" and events[5][2] == "bibliographic metadata cleanup"
    assert [e.writer for e in commits.log(spark, path)] == ["load", "other", "corrections"]
