"""Near copies of the pipeline's stage, planted at known similarities and held against brute force."""

import numpy as np
import pytest

import corpus_pipeline
from lectern.llm import shinglesim

FIELDS = "doc_id long, text string"


def planted(similarity, n, length=400):
    """n pairs of texts of `length` random words, of which runs are replaced until the five-word similarity is just `similarity` or more."""
    rng = np.random.default_rng(int(similarity * 100))
    pairs = []
    for _ in range(n):
        words = [f"w{x}" for x in rng.integers(0, 10**6, length)]
        copy, base = list(words), shinglesim.shingles(" ".join(words))
        for at in rng.permutation(length):
            changed = [*copy[:at], "changed", *copy[at + 1 :]]
            other = shinglesim.shingles(" ".join(changed))
            common = len(np.intersect1d(base, other))
            if common / (len(base) + len(other) - common) < similarity:
                break
            copy = changed
        pairs.append((" ".join(words), " ".join(copy)))
    return pairs


@pytest.mark.parametrize("similarity", [0.8, 0.9, 0.95])
def test_stage_removes_planted_near_copies(spark, similarity):
    pairs = planted(similarity, 100)
    rows = [(2 * k + side, text) for k, pair in enumerate(pairs) for side, text in enumerate(pair)]
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, FIELDS), "").collect()}
    caught = sum(2 * k + 1 not in kept for k in range(100)) / 100
    print(f"recall at similarity {similarity}: {caught}")
    assert all(2 * k in kept for k in range(100)) and caught >= 0.98


def test_keep_one_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 60)]
    texts = []
    for _ in range(60):  # a chain: many pairs on both sides of the threshold, and more than one round of pivots
        base = list(base)
        base[int(rng.integers(0, 60))] = f"x{rng.integers(0, 10**6)}"
        texts.append(" ".join(base))
    texts += ["", " ", None, "one", "One", "one two", texts[3].upper()]
    sets = [set(shinglesim.shingles(t).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if not (a | b) or len(a & b) / len(a | b) >= 0.8:
                old, new = root[i], root[j]
                root = [min(old, new) if r in (old, new) else r for r in root]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "one"), (0, texts[0])]
    kept = shinglesim.keep_one(spark.createDataFrame(rows, FIELDS), tile=16)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root))
    assert shinglesim.keep_one(spark.createDataFrame([], FIELDS)).count() == 0
