"""Fingerprints, tile partners and quality scores against their definitions, written plainly."""

import pickle
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lectern.llm import quality, simhash
from lectern.llm.common import crc_remainder

FOLDER = "/root/testdata/sf0.001"


def fingerprint(text):
    """A bit is set if it is set in over half of the hashes of three words in a row."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lower) if w]
    runs = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_fingerprints_by_their_definition(spark):
    made = [None, "", " \t", "One", "two Words", "A b C", "a b c d a b c d", "É é \x1c x\x0by", "long " * 9000 + "end"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + k, t) for k, t in enumerate(made)], "doc_id long, text string"))
    got = {r["doc_id"]: r["f"] for r in simhash.near_duplicates(docs).select("doc_id", simhash.fingerprint_hex("fp").alias("f")).collect()}
    assert got == {r["doc_id"]: f"{fingerprint(r['text']):016x}" for r in docs.collect()}


def test_partners_of_tiles():
    rng = random.Random(6)
    for _ in range(300):
        tiles = []
        for band in sorted(rng.sample(range(6), rng.randint(1, 5))):
            at = 0
            while at < 60 and len(tiles) < 60:
                low = at + rng.randint(0, 4)
                high = low + rng.choice((0, 0, 1, 3))
                tiles += [[band, low, high]] * (rng.randint(1, 3) if low == high else 1)
                at = high + (0 if low == high and rng.random() < 0.3 else 1)
        radius = rng.randint(0, 5)
        got = [sorted(j for a, z in r for j in range(a, z + 1)) for r in simhash.partner_ranges(tiles, radius)]
        assert got == [[j for j, y in enumerate(tiles) if abs(x[0] - y[0]) <= 1 and y[1] - x[2] <= radius and x[1] - y[2] <= radius] for x in tiles]


def plain_score(model, text):
    """Features and network of a stored model, one document at a time, from their definitions."""
    features, network, _ = pickle.loads(model)
    words = (text or "").split()
    m = max(1, len(words))
    pooled = []
    for vectors, of in ((features.cores, quality.core), (features.shapes, quality.shape)):
        rows = [vectors.table[vectors.row.get(of(w), 0)].astype(float) for w in words]
        pooled.append(np.sum(rows, axis=0) / m if rows else np.zeros(quality.DIMENSIONS))
    same, distinct = sum(a == b for a, b in zip(words, words[1:], strict=False)), len(set(words))
    more = [np.log1p(len(words)) / 10, same / m, distinct / m, np.log1p(distinct) / np.log1p(m), sum(map(len, words)) / m / 20, float(not words)]
    z = (np.concatenate([*pooled, more]) - network.mean) / network.scale
    hidden = [np.tanh(sum(z[i] * network.w1[i, k] for i in range(len(z))) + network.b1[k]) for k in range(network.hidden)]
    logit = sum(h * w for h, w in zip(hidden, network.w2, strict=True)) + network.b2
    return 1 / (1 + np.exp(-logit / network.temperature))


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels, crc_remainder(F.col("doc_id"), 5) != 0)
    return docs, labels, model


def test_scores_by_brute_force(spark, scored):
    docs, _, model = scored
    texts = docs.limit(60).unionByName(spark.createDataFrame([(-1, None, "x", "s", 0), (-2, "", "x", "s", 0), (-3, "a a a b", "x", "s", 0)], docs.schema))
    rows = texts.select("text", quality.text_score(spark, F.col("text"), model).alias("score")).collect()
    assert [r["score"] for r in rows] == pytest.approx([plain_score(model, r["text"]) for r in rows], abs=1e-6)


def test_index_vectors_by_definition():
    """Each word's vector is the unit sum of twice its own index vector and the unit sum of its neighbours' at a distance of one or two."""
    rng = random.Random(1)
    texts = [[rng.choice("abcdefg") for _ in range(40)] for _ in range(12)]
    made = quality.Vectors(5, least=3).fit(texts)
    unit = lambda v: v / max(np.linalg.norm(v), 1e-9)
    of = lambda t: quality.index_vector(t if t in made.row else "\0")
    for word, row in made.row.items():
        near = sum((of(x[k + d]) for x in texts for k, w in enumerate(x) if w == word for d in (-2, -1, 1, 2) if 0 <= k + d < len(x)), np.zeros(quality.DIMENSIONS))
        assert made.table[row] == pytest.approx(unit(2 * unit(of(word)) + unit(near)), abs=1e-5)


def test_held_out_rows_are_told_and_calibrated(spark, scored):
    """On labelled rows that were never learned from: accuracy above always saying 1, and mean scores near the shares of label 1, in halves by score."""
    docs, labels, model = scored
    held = docs.where(crc_remainder(F.col("doc_id"), 5) == 0).join(labels.where("quality IS NOT NULL").select("doc_id", "quality"), "doc_id")
    rows = held.select("quality", quality.text_score(spark, F.col("text"), model).alias("score")).collect()
    y, p = np.array([r["quality"] for r in rows]), np.array([r["score"] for r in rows])
    assert len(y) >= 50 and np.mean((p >= 0.3) == (y == 1)) > max(y.mean(), 1 - y.mean()) + 0.05
    for part in np.array_split(np.argsort(p), 2):
        assert abs(p[part].mean() - y[part].mean()) < 0.12
    losses = -np.mean(np.log(np.where(y == 1, p, 1 - p).clip(1e-9)))
    share = y.mean()
    assert losses < -(share * np.log(share) + (1 - share) * np.log(1 - share))  # better than the share of label 1 for all
