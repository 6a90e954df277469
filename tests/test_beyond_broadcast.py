"""The ways without broadcasts give the rows of those with them."""

from collections import Counter

import pytest

from lectern.operators import catalog, index, matcher, search
from lectern.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
LIMITS = [(m, n) for m in (catalog, index, matcher, search) for n in dir(m) if n.startswith("BROADCAST_")]
NAMES = ("q12_expansion", "q13_filtered_search", "q14_lookup", "q15_lexicon", "q20_contributions", "q21_passages", "q21_roles", "q22_index", "q49_decisions")


@pytest.mark.parametrize("name", NAMES)
def test_beyond_broadcast(spark, monkeypatch, name):
    assert len(LIMITS) >= 4
    want = Counter(map(str, QUERIES[name](spark, FOLDER).collect()))
    for module, limit in LIMITS:
        monkeypatch.setattr(module, limit, 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert Counter(map(str, QUERIES[name](spark, FOLDER).collect())) == want and want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
