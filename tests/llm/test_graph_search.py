"""Recall of the graph search over several shards, on random and on clustered vectors, against brute force."""

import numpy as np
import pytest

from lectern.llm import ann


@pytest.mark.parametrize("clusters", [0, 60])
def test_recall_over_shards(spark, clusters):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(9000, 32))
    if clusters:
        x = rng.normal(size=(clusters, 32))[rng.integers(0, clusters, 9000)] + 0.3 * x
    x = x.astype(np.float32).astype(np.float64)
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = ann.nearest(frame, shard=3000, build_beam=48, beam=64).toPandas()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q, part in got.groupby("query_id"):
        cos = unit @ unit[q]
        cos[q] = -2
        hit += len(set(part["vec_id"]) & set(np.argsort(-cos, kind="stable")[:5]))
        assert np.abs(part["score"].to_numpy() - cos[part["vec_id"]]).max() < 1e-12
    print("recall", clusters, hit / (5 * 180))
    assert len(got) == 5 * 180 and hit >= 0.95 * 5 * 180
