"""What the language model keeps on disk: tokens once, and the questions of a group of shards at a time."""

import random

from pyspark.sql import functions as F

from lectern.llm import ngram


def test_shards_answer_in_groups(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    stored, gone = [], []
    parts_of, delete = ngram.materialise_parts, ngram.delete

    def parts(*args):
        out = parts_of(*args)
        # No row beside the batches has their tokens, and every question is in one group.
        stored.append((len(out), out[0][0].where("a IS NOT NULL OR b IS NOT NULL").count(), [{r["shard"] for r in frame.select("shard").distinct().collect()} for frame, _ in out]))
        return out

    def noted(session, path):
        gone.append(path.rpartition("/")[2])
        delete(session, path)

    monkeypatch.setattr(ngram, "materialise_parts", parts)
    monkeypatch.setattr(ngram, "delete", noted)
    got = []
    for groups in (1, 4):
        monkeypatch.setattr(ngram, "GROUPS", groups)
        got.append(sorted(tuple(r) for r in ngram.score(docs, F.col("doc_id") % 5 == 2, batch_tokens=300, shard_tokens=15).collect()))
    assert got[0] == got[1] and len(got[0]) == 60
    assert [(n, tokens) for n, tokens, _ in stored] == [(2, 0), (5, 0)]
    assert stored[1][2][0] == {-1} and all(a.isdisjoint(b) for k, a in enumerate(stored[1][2]) for b in stored[1][2][:k]) and set().union(*stored[1][2]) == set().union(*stored[0][2])
    assert gone == ["_part=1", "_part=1", "_part=2", "_part=3", "_part=4"]
