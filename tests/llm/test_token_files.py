"""Token ids in ORC: what is read back against the tokenizer on whole texts, and what the files' indexes can skip."""

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import tokenorc
from lectern.llm.common import new_path

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " \n", "Plain words, and more of them.", "añb 日本 İstanbul 𝒳y", "<|endoftext|> don't", "nul\x00 \x85 x" * 3, "long " * 5000]


def plain(rows):
    """(doc_id, start, n, crc, ids) in order of doc_id."""
    tokenizer, at, out = Tokenizer.from_file(PATH), 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    return out


@pytest.mark.parametrize("file_bytes", [1 << 30, 3000])
def test_files_against_tokenizer(spark, file_bytes):
    rows = [(i * 7 % 211, TEXTS[i * 7 % 211 % len(TEXTS)]) for i in range(211)]
    frame = spark.createDataFrame([(*r, 1, "p") for r in rows], "doc_id long, text string, part int, ids string").repartition(7)
    path = tokenorc.write(frame, new_path(spark, "test"), PATH, file_bytes=file_bytes)
    stored = tokenorc.read(spark, path)
    assert stored.columns == ["doc_id", "start", "n_tokens", "ids"]
    want = plain(rows)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids"]) for r in stored.collect()) == [(d, s, n, ids) for d, s, n, _, ids in want]
    assert sorted(map(tuple, tokenorc.checksums(stored).collect())) == [r[:4] for r in want]
    if file_bytes == 3000:
        parts = spark.read.orc(f"{path}/parts").orderBy("part").collect()
        assert len(parts) > 20 and sum(p["docs"] for p in parts) == 211
        spans = spark.read.orc(f"{path}/files").groupBy("part").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).orderBy("part").collect()
        assert all(x["z"] < y["a"] for x, y in zip(spans, spans[1:], strict=False))  # files in order of documents


def test_hot_ids_repeats_and_nulls(spark, monkeypatch):
    """A third of all rows with one id, equal rows and null ids: starts stay gapless, in any number of files."""
    rows = [(5, "the same text")] * 60 + [(5, f"text {i}") for i in range(40)] + [(i, f"of {i}") for i in range(100, 160)] + [(None, "no id"), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for limit in (tokenorc.BROADCAST_FILES, 0):
        monkeypatch.setattr(tokenorc, "BROADCAST_FILES", limit)
        path = tokenorc.write(frame, new_path(spark, "test"), PATH, file_bytes=400)
        got = sorted(map(tuple, tokenorc.checksums(tokenorc.read(spark, path)).collect()), key=lambda r: r[1])
        assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))
        assert all(x[1] + x[2] == y[1] for x, y in zip(got, got[1:], strict=False)) and got[0][1] == 0
        assert sorted((str(r[0]), r[2], r[3]) for r in got) == sorted((str(r[0]), r[2], r[3]) for r in plain(rows))
        assert spark.read.orc(f"{path}/files").where("doc_id = 5").select("part").distinct().count() > 2
    empty = tokenorc.round_trip(frame.limit(0), PATH)
    assert empty.count() == 0


def test_indexes_of_the_files(spark):
    """Stripes have Bloom filters and row indexes on doc_id, a lookup reads the groups of rows that can have it, and ids are not read unasked."""
    frame = spark.range(0, 40_000, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("words "), F.repeat(F.concat(F.col("id"), F.lit(" ")), F.lit(20))).alias("text"))
    path = tokenorc.write(frame, new_path(spark, "test"), PATH)
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    file = spark.read.orc(f"{path}/files").inputFiles()[0]
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(file), jvm.org.apache.orc.OrcFile.readerOptions(conf))
    assert reader.getRowIndexStride() == 1000 and reader.getNumberOfRows() == 20_000
    footer = reader.rows().readStripeFooter(reader.getStripes().get(0))
    streams = {(s.getKind().toString(), s.getColumn()) for s in footer.getStreamsList()}
    assert ("BLOOM_FILTER_UTF8", 2) in streams and ("ROW_INDEX", 2) in streams
    assert all(e.getKind().toString() == "DIRECT_V2" for e in list(footer.getColumnsList())[2:5])  # run lengths of integers
    found = tokenorc.lookup(spark, path, [12_346, 12_347])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[.*In\(doc_id", plan)
    assert [r["doc_id"] for r in found.collect()] == [12_346]
    scanned = spark.read.schema(tokenorc.STORED).orc(f"{path}/files").where("doc_id = 12346").select("doc_id")
    assert "ids" not in re.search(r"ReadSchema: .*", scanned._jdf.queryExecution().executedPlan().toString())[0]
    rows = lambda df: [m.value() for m in [scan_of(df._jdf.queryExecution()).metrics().apply("numOutputRows")]][0]
    scanned.collect()
    assert rows(scanned) <= 2000  # the group that has it, perhaps one more by a false alarm
    odd = spark.read.schema(tokenorc.STORED).orc(f"{path}/files").where("doc_id = 12347").select("doc_id")
    odd.collect()
    assert rows(odd) <= 1000  # within the bounds of a group, but not in its Bloom filter


def scan_of(execution):
    node = execution.executedPlan()
    while node.children().size():
        node = node.children().apply(0)
    return node


def test_corrupt_rows_are_told(spark):
    row = spark.createDataFrame([(1, 0, 3, [5, 1])], "doc_id long, start long, n_tokens long, ids array<int>")
    with pytest.raises(Exception, match="CorruptFile"):
        tokenorc.checksums(row).collect()
