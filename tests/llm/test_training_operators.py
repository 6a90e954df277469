"""The operators on small tables with nulls, ties, repeats and clashing names, against brute force."""

import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.llm import ann, binpack, hostrep, mixing, ngram, quality, queries, simhash, sitetree, topk, warc
from lectern.llm.common import crc_remainder

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp int, score string"


def docs(spark, rows=None):
    rows = rows if rows is not None else [
        (1, "a b c d e", "en", "s1", 9, 1, "x"), (2, "A b  c d e", "en", "s1", 9, 1, "x"), (3, None, "en", None, None, None, None), (4, "", None, "s2", 0, 1, "x"), (5, "one", "en", "s2", 3, 1, "x"),
        (5, "one", "en", "s2", 3, 1, "x"), (None, "two words", "en", "s3", 9, 1, "x"), (7, "lorem ipsum " * 5000, "en", "s3", 60000, 1, "x"),
    ]
    return spark.createDataFrame(rows, DOCS)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


VECTORS = [(i, [float(x) for x in np.random.default_rng(i % 40).normal(size=8)], 0) for i in range(200)] + [
    (300, None, 0), (350, [1.0, None] * 4, 0), (400, [float("nan")] * 8, 0), (450, [0.0] * 8, 0), (None, [1.0] * 8, 0), (500, [1.0, 2.0], 0), (50, [1.0] * 8, 1),
]


def kept_vectors(nonzero):
    out: dict[int, list[float]] = {}
    for i, v, _ in VECTORS:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and (not nonzero or any(v)):
            v = [float(np.float32(x)) for x in v]
            out[i] = min(out[i], v) if i in out else v
    return out


def expected_top(keep, score):
    out = []
    for q, v in keep.items():
        if q % 50 == 0:
            found = sorted((-score(v, c), i) for i, c in keep.items() if i != q and len(c) == len(v))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:5])]
    return sorted(out)


@pytest.mark.parametrize("block,bins", [(4096, 1024), (16, 4)])
def test_top_k(spark, block, bins):
    got = topk.top_k(vectors(spark, VECTORS), block=block, query_block=3, bins=bins).collect()
    want = expected_top(kept_vectors(False), lambda a, b: sum(int(np.floor(256 * x)) * int(np.floor(256 * y)) for x, y in zip(a, b, strict=True)))
    assert sorted(map(tuple, got)) == want
    assert topk.top_k(vectors(spark, [])).count() == 0


def test_nearest(spark):
    got = sorted(map(tuple, ann.nearest(vectors(spark, VECTORS), shard=64, beam=64).collect()))
    want = expected_top(kept_vectors(True), lambda a, b: float(ann.cosines(np.array([a]), np.array([b]))[0]))
    assert len(set((q, i) for q, _, i, _ in got) & set((q, i) for q, _, i, _ in want)) >= 0.9 * len(want)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert ann.nearest(vectors(spark, [])).count() == 0


def brute_score(rows, mu, discount, others=()):
    """Scores of rows, or of `others` by the model of rows."""
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, *_ in rows]
    split = lambda t: (t or "").encode().lower().split() + [b"\n"]
    uni, pairs, triples, after, kinds = Counter(), Counter(), Counter(), Counter(), Counter()
    for (_, text), h in zip(rows, held, strict=True):
        if not h:
            t = split(text)
            uni.update(t)
            pairs.update(zip([b"\n", *t[:-1]], t, strict=True))
            triples.update(zip([b"\n", *t[:-2]], t[:-1], t[1:]))
    for (a, b, _), n in triples.items():
        after[a, b] += n
        kinds[a, b] += 1
    n, v = sum(uni.values()), len(uni)
    p = lambda w: (uni[w] + 1) / (n + v + 1)
    p2 = lambda a, b: (pairs[a, b] + mu * p(b)) / (uni[a] + mu)
    p3 = lambda a, b, c: (max(0, triples[a, b, c] - discount) + discount * kinds[a, b] * p2(b, c)) / after[a, b] if after[a, b] else p2(b, c)
    for (i, text), h in zip(others or rows, [True] * len(others) or held, strict=True):
        t = split(text)
        base = sum(np.log10(p(w)) for w in t)
        score = np.log10(p2(b"\n", t[0])) + sum(np.log10(p3(a, b, c)) for a, b, c in zip([b"\n", *t[:-2]], t[:-1], t[1:]))
        yield i, h, len(t), sum(uni[w] > 0 for w in t), n, base, score


@pytest.mark.parametrize("batch,shard", [(2_000_000, 3_000_000), (40, 60)])
def test_language_model(spark, batch, shard):
    frame = docs(spark).unionByName(queries.table(spark, FOLDER, "documents").limit(30).select("doc_id", "text", "lang", "source", "n_chars", F.lit(1).alias("fp"), F.lit("").alias("score")))
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    model, scores = ngram.train(frame, crc_remainder(F.col("doc_id"), 7) == 2, batch_tokens=batch, shard_tokens=shard)
    others = [(1, "a b c d e"), (2, None), (3, rows[10][1]), (4, "nothing of this was seen"), (4, rows[12][1] + " two words")]
    asked = model.score(docs(spark, [(i, t, "en", "s", 1, 1, "") for i, t in others]), batch_tokens=batch)
    by = lambda r: (str(r[0]), r[2], r[3])
    for frame_of, want in ((scores, brute_score(rows, ngram.MU, ngram.DISCOUNT)), (asked, brute_score(rows, ngram.MU, ngram.DISCOUNT, others))):
        got, want = sorted(map(tuple, frame_of.collect()), key=by), sorted(want, key=by)
        assert len(got) == len(want)
        for g, w in zip(got, want, strict=True):
            assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-6 * max(1, abs(w[5])) and abs(g[6] - w[6]) < 0.003 * w[2]
    assert ngram.score(docs(spark, []), F.lit(False)).count() == 0


def test_counts_beyond_32_bits():
    words = np.array([5, 9], dtype="<u8")
    pack = lambda a: ngram._zip(np.asarray(a, dtype="<u8"))
    batch = lambda k: (0, k, pack(np.diff(words, prepend=np.uint64(0))), pack([3_000_000_000, 1]))
    out = ngram._number(1)(pd.DataFrame([batch(1), batch(2)], columns=["shard", "batch", "words", "counts"]))
    assert ngram._unzip(out["totals"].iloc[0], "<u8").tolist() == [6_000_000_000, 2]
    assert ngram._unzip(out["ids"].iloc[0], "<u8").tolist() == [1, 2] and out["seen"].tolist() == [0, 0, 2]


def test_pages(spark):
    schema = "page_id long, url string, html string, text string, host string"
    body = lambda i: f"<html><body><div class='top'><p>Same words here</p></div><div class='c'><p>Page {i} says {i * i} things &amp; more</p></div></body></html>"
    rows = [(i, f"http://x.example.com/en/{i}", body(i), "t", "h") for i in range(12)] + [(100, None, None, None, None), (None, "nope", "<p>a</p>", "", ""), (101, "http://y.example.net/es/1", body(3), "t", "h"), (101, "http://y.example.net/es/1", body(3), "t", "h")]
    got = sitetree.extract(spark.createDataFrame(rows, schema)).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows)
    assert text[3] == "Page 3 says 9 things & more"  # the part that all pages of the site share is gone
    assert text[101] == "Same words here Page 3 says 9 things & more"  # too few pages to tell
    assert text[100] == "" and text[None] == "a" and all(r["n_chars"] == len(r["text"]) for r in got)
    assert sitetree.extract(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("tile", [8192, 4])
def test_near_duplicates(spark, tile):
    frame = docs(spark).unionByName(queries.table(spark, FOLDER, "documents").select("doc_id", "text", "lang", "source", "n_chars", F.lit(1).alias("fp"), F.lit("").alias("score")).where("doc_id > 10"))
    got = simhash.near_duplicates(frame, tile=tile).select("doc_id", "fp", "component_id").toPandas()
    rows = [(r["doc_id"], simhash.fingerprint(r["text"])) for r in frame.select("doc_id", "text").collect()]
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            low = min(root[b] for b in fps if bin(a ^ b).count("1") <= 3)
            if low < root[a]:
                root[a], changed = low, True
    small: dict = {}
    for i, f in rows:
        if i is not None:
            small[root[f]] = min(small.get(root[f], i), i)
    want = Counter((i, f, small.get(root[f])) for i, f in rows)
    none = lambda x: None if x is None or x != x else int(x)
    assert Counter((none(i), int(f) & (2**64 - 1), none(c)) for i, f, c in got.itertuples(index=False)) == want
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns and kept.count() == len({root[f] for _, f in rows})
    assert simhash.near_duplicates(docs(spark, [])).count() == 0 and simhash.keep_one(docs(spark, [])).count() == 0


def test_mixing(spark):
    rows = [(i, "w " * (i % 17), "en", f"s{i % 5}" if i % 7 else None, 1, 1, "") for i in range(400)] + [(1000, "w " * 900, "en", "big", 1, 1, ""), (1001, None, "en", "none", 1, 1, "")]
    got = mixing.mix(docs(spark, rows)).toPandas()
    assert len(got) == 402 and (got["taken"] <= 3 * got["size"]).all() and (got["taken"] == got["copies"] * got["size"]).all()
    assert abs(got.drop_duplicates("source_size")["target"].sum() - got["size"].sum()) < 1e-6 * got["size"].sum()
    for _, g in got.groupby("source_size"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= max(1, g["size"].max())
    again = mixing.mix(docs(spark, rows).repartition(3)).toPandas()
    order = ["doc_id", "size"]
    assert got.sort_values(order)["taken"].tolist() == again.sort_values(order)["taken"].tolist()
    out = mixing.mixed(docs(spark, rows))
    words = out.select(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).where("n > 0")
    assert out.columns == docs(spark).columns and words.count() == 1
    assert mixing.mix(docs(spark, [])).count() == 0 and mixing.mix(docs(spark)).count() == 8


def test_mixing_takes_documents_by_their_chances(spark):
    sizes = [1, 2, 3, 5, 8, 13, 21, 34, 12, 7, 4, 2]
    rows = [(100 * k + i, "w " * n, "en", f"s{k:03}", 1, 1, "") for k in range(600) for i, n in enumerate(sizes)]
    got = mixing.mix(docs(spark, rows), weights=(3, 5)).toPandas()
    # Sources are alike and get 3/4 and 5/4 of their words in turn: 84 or 28 words are sampled in each.
    assert set(got["target"]) == {84.0, 140.0}
    words = np.array(sizes)
    for target, whole, due in ((84, 0, 84), (140, 1, 28)):
        low, high = 0.0, 1.0
        for _ in range(60):  # sum of min(1, c * size) * size
            c = (low + high) / 2
            low, high = (c, high) if (np.minimum(1, c * words) * words).sum() < due else (low, c)
        p = np.minimum(1, low * words)
        some = got[got["target"] == target]
        more = some["copies"] - whole
        share = more.groupby(some["doc_id"] % 100).mean().to_numpy()
        assert set(more) <= {0, 1} and (share[p > 0.999] == 1).all() and (p.max() > 0.999) == (target == 84)
        assert np.abs(share - p).max() < 0.12 and np.corrcoef(share, p)[0, 1] > 0.98 and p.min() < 0.1
    taken = got.groupby(got["doc_id"] // 100)["taken"].sum() - got.groupby(got["doc_id"] // 100)["target"].first()
    assert taken.abs().max() <= 34 / 2


def test_mixing_of_rows_that_tie(spark):
    rows = [(None, "same text here", "en", "a", 1, 1, "")] * 300 + [(9, "w w", "en", "a", 1, 1, "")] * 50 + [(1, "w " * 500, "en", "b", 1, 1, "")]
    got = mixing.mix(docs(spark, rows)).toPandas()
    by = got.groupby("source_size")[["taken", "target"]].agg({"taken": "sum", "target": "first"})
    assert (by["taken"] - by["target"]).abs().max() <= 250 and abs(by.loc[1000, "taken"] - by.loc[1000, "target"]) <= 1.5
    assert mixing.mixed(docs(spark, rows)).where("source = 'a'").count() == got[got["source_size"] == 1000]["copies"].sum()


def test_urls(spark):
    schema = "page_id long, url string, host string, verdict string"
    rows = [
        (1, "http://WWW.Example.com/en/1?x", "", ""), (2, "https://a.example.com/en/", "", ""), (3, "http://a.net/fr/9", "", ""), (4, "http://a.net/en/9", "", ""), (5, None, "", ""), (6, "no scheme", "", ""), (7, "x://b.org", "", ""), (8, "http://example.com/enx", "", ""),
    ]
    outcomes = spark.createDataFrame([(4, 1)] * 1 + [(7, 0)], "page_id long, bad int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in hostrep.judge(spark.createDataFrame(rows, schema), outcomes).collect()}
    assert got[1] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[2] == ("a.example.com", "/en/", "example.com/en/", "block")
    assert got[3] == ("a.net", "/fr/9", "net/fr/", "block")
    assert got[5] == got[6] == ("", "", None, "allow") and got[7][:3] == ("b.org", "", None)
    assert got[8] == ("example.com", "/enx", "com/", "allow")
    many = spark.createDataFrame([(i, f"http://{'bad' if i % 2 else 'good'}.org/{i}", "", "") for i in range(400)], schema)
    bad = spark.createDataFrame([(i, i % 2) for i in range(400)], "page_id long, bad int")
    assert {(r["host"], r["verdict"]) for r in hostrep.judge(many, bad).collect()} == {("bad.org", "block"), ("good.org", "allow")}


def test_archives(spark):
    schema = "page_id long, url string, html string, payload string, first int"
    rows = [(3, "u", "x" * 100, "", 1), (1, "u", "x" * 100, "", 1), (2, "v", "short", "", 1), (4, "v", "short", "", 1), (5, None, None, "", None), (None, "w", "x" * 100, "", 1), (6, "z", "é" * 300_000, "", 1), (1, "u", "x" * 100, "", 1)]
    pages = spark.createDataFrame(rows, schema)
    got = warc.round_trip(pages, archive_bytes=300).toPandas()
    key = {(None if p != p else int(p)): (int(b), t, None if r != r else int(r)) for p, b, _, t, r in got.itertuples(index=False)}
    assert len(got) == 8 and key[3] == (100, "revisit", 1) and key[1] == (100, "response", None) and key[2] == (5, "response", None) and key[5] == (0, "response", None) and key[None] == (100, "revisit", 1) and key[6][0] == 600_000
    whole = warc.read_archives(warc.write_archives(pages.where("page_id = 6"))).first()
    assert whole["payload"].decode() == "é" * 300_000
    assert warc.round_trip(spark.createDataFrame([], schema)).count() == 0


def test_quality(spark):
    rows = [(i, ("Good words in order %d here. " % i) * 8 if i % 3 else ("BAD!! $$$ %d### | " % i) * 8, "en", "s", 1, 1, "") for i in range(300)] + [(900, None, "en", "s", 1, 1, ""), (None, "", "en", "s", 1, 1, "")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(5, None, 0)], "doc_id long, quality int, toxic int")
    held = crc_remainder(F.col("doc_id"), 5) == 0
    got = quality.classify(docs(spark, rows), labels, held).toPandas()
    assert len(got) == 302 and got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.3)).all()
    known = got[got["doc_id"].notna() & (got["doc_id"] < 300)]
    right = known["predicted"] == (known["doc_id"] % 3 > 0).astype(int)
    assert right[known["held_out"]].mean() > 0.95
    assert quality.keep_good(docs(spark, rows), labels, held).columns == docs(spark).columns
    assert quality.classify(docs(spark, []), labels, held).count() == 0
    assert set(quality.classify(docs(spark), labels.limit(0), held).toPandas()["score"]) == {0.5}


def test_packing(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    frame = docs(spark).unionByName(docs(spark, [(20, "it's I'LL &&&'s ǅ Σας e\u0301 1234 a\x1cb a\u00a0b <|endoftext|>x ß İ 你好", "en", "s", 1, 1, "")]))
    got = binpack.pack(frame, path, capacity=64).toPandas()
    tokenizer = Tokenizer.from_file(path)
    want = Counter()
    for i, text in ((r["doc_id"], r["text"]) for r in frame.collect()):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want.update((i, n, at, len(ids[at : at + 64]), zlib.crc32(ids[at : at + 64].tobytes())) for n, at in enumerate(range(0, len(ids), 64)))
    none = lambda x: None if x != x else int(x)
    assert Counter((none(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()) == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == (g["length"].cumsum() - g["length"]).tolist() and g["length"].sum() <= 64
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 64) + 1
    assert binpack.pack(docs(spark, []), path).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as c

    frame = queries.table(spark, FOLDER, "documents")
    for name, stage in c.STAGES:
        before = frame
        frame = c.materialise(stage(spark, frame, FOLDER), name)
        if name != "packing":
            assert frame.columns == before.columns
            assert frame.join(before, "doc_id", "left_anti").count() == 0
    assert frame.count() > 0
    packed = frame.toPandas()
    assert packed.groupby("sequence_id")["length"].sum().max() <= 4096
    assert c.ORACLE_SQL is None and isinstance(packed, pd.DataFrame)
