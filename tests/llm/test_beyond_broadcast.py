"""The ways without broadcasts give the rows of those with them, and columns of any names come through."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from lectern.llm import hostrep, mixing, shinglesim, simhash, sitetree, warc

LIMITS = [(m, n) for m in (hostrep, mixing, shinglesim, simhash, sitetree, warc) for n in dir(m) if n.startswith("BROADCAST_")]
DOCS = "doc_id long, text string, source string, _doc int, `_key` string, `_row` int, row string, copies int"


def documents(spark):
    rows = [(i, f"some words of text {i % 9} that repeat {'x ' * (i % 4)}" if i % 5 else None, f"s{i % 3}", i, "k", 1, "r", 2) for i in range(60)]
    return spark.createDataFrame([*rows, rows[7], (None, "some words of text 3 that repeat", "s1", 0, "k", 1, "r", 2)], DOCS)


def pages(spark):
    body = lambda i: f"<div class='m'>Same words</div><div class='c'>{'page ' * (i % 3 + 30)}{i // 2}</div>"
    return spark.createDataFrame([(i, f"http://h{i % 2}.example.org/{i}", body(i)) for i in range(24)], "page_id long, url string, html string")


CASES = {
    "fingerprints": lambda s: simhash.near_duplicates(documents(s)).drop("root"),
    "one of each class": lambda s: simhash.keep_one(documents(s)),
    "one of alike texts": lambda s: shinglesim.keep_one(documents(s)),
    "mix": lambda s: mixing.mix(documents(s)),
    "mixed": lambda s: mixing.mixed(documents(s)),
    "archives": lambda s: warc.round_trip(pages(s)),
    "texts": lambda s: sitetree.extract(pages(s)),
    "verdicts": lambda s: hostrep.judge(pages(s), pages(s).select("page_id", (F.col("page_id") % 2).cast("int").alias("bad"))),
}


@pytest.mark.parametrize("name", CASES)
def test_beyond_broadcast(spark, monkeypatch, name):
    small = CASES[name](spark)
    want = Counter(map(tuple, small.collect()))
    assert want
    for module, limit in LIMITS:
        monkeypatch.setattr(module, limit, 0)
    large = CASES[name](spark)
    assert large.columns == small.columns and Counter(map(tuple, large.collect())) == want
    if name in ("one of each class", "one of alike texts", "mixed"):
        assert large.columns == documents(spark).columns


def test_pipeline_leaves_only_its_last_tables(spark):
    import corpus_pipeline
    from lectern.llm import common

    mark = common.written()
    packed = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert packed.count() > 0
    assert common.written() - mark <= 3  # the mixed documents and the last stage's own
    common.release(spark, mark)
    assert common.written() == mark
