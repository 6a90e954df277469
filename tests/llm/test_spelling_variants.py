"""Spelling variants against brute force over all pairs of a small dictionary."""

import random
import re
import zlib
from collections import Counter

import pytest

from lectern.llm import variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def near(a, b):
    """One insertion, deletion or replacement, by trying each."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(docs, one_in, least_chars=6, least_count=5, times=5):
    count = Counter()
    for doc, text in docs:
        for run in RUN.findall(text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            count[run if h % one_in else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: k for w, k in count.items() if len(w) >= least_chars and k >= least_count}
    by = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(by[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    rows = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n[w], len(by[w]), n[form[w]] if form[w] else None))
    return sorted(rows, key=repr)


def texts(seed, count):
    rng = random.Random(seed)
    stems = ["letter", "lettre", "aaaaaa", "aaaaaaa", "aabaaa", "colour", "coloré", "Écolier", "écolier", "straight", "×÷×÷×÷", "organisation"]
    vocabulary = list(stems)
    for w in stems:
        for _ in range(12):
            k, c = rng.randrange(len(w)), rng.choice("abrstéÿ")
            vocabulary.append(rng.choice((w[:k] + c + w[k:], w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :])))
    weights = [rng.choice((1, 1, 4, 30, 200)) for _ in vocabulary]
    out = []
    for i in range(count):
        words = rng.choices(vocabulary, weights, k=60)
        out.append((i, " ".join(w.upper() if rng.random() < 0.1 else w for w in words) + rng.choice(("", "_x9", " 日本", "\n"))))
    # A chain of forms, each word one edit from the next alone.
    return out + [(5000 + i, " ".join(["harbless"] * (i % 12 == 0) + ["harbles"] * (i % 2 == 0) + ["harble"] * 6)) for i in range(120)]


@pytest.mark.parametrize("block", [2, 5, 128])
@pytest.mark.parametrize("one_in", [199, 3])
def test_against_brute_force(spark, block, one_in):
    docs = [*texts(block, 120), (None, "letter LetterÀ"), (7, None), (8, ""), (9, "letter " * 40)]
    docs += docs[:10]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, word string, n int").repartition(4)
    made = variants.group(frame, one_in=one_in, block=block)
    assert made.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = sorted(map(tuple, made.collect()), key=repr)
    want = brute(docs, one_in)
    assert len(want) > 40 and any(r[1] and r[1] != r[2] for r in want)
    assert got == want


def test_hot_blocks_are_subdivided_and_nothing_is_lost(spark, monkeypatch):
    """A third of all words share both ends or one; blocks of four members are the most that is compared."""
    rng = random.Random(5)
    words = {"pre" + "".join(rng.choices("abc", k=rng.choice((5, 6)))) + "ending" for _ in range(160)} | {"".join(rng.choices("ab", k=k)) for k in (6, 7, 8, 9) for _ in range(80)} | {"q" * k for k in (6, 7, 8, 300, 301)}
    frame = spark.createDataFrame([(w, 5) for w in sorted(words)], "word string, n long")
    for limit in (200_000, 0):
        monkeypatch.setattr(variants, "BROADCAST_BLOCKS", limit)
        got = Counter((r["word"], r["near"]) for r in variants.links(frame, block=4).collect())
        assert set(got.values()) == {1}  # each pair once each way
        assert set(got) == {(a, b) for a in words for b in words if a != b and near(a, b)}


def test_block_steps():
    """Of every pair one edit apart, one block holds both words and finds the pair once, however far blocks are subdivided."""
    rng = random.Random(3)
    for _ in range(3000):
        a = "".join(rng.choices("ab", k=rng.randint(1, 12)))
        k, c = rng.randrange(len(a) + 1), rng.choice("ab")
        b = a[:k] + c + a[k + 1 :] if k < len(a) and rng.random() < 0.5 else a[:k] + c + a[k:]
        if a == b:
            continue
        m = len(a)
        for depth in range(1, 5):
            ways = [("", 0, 0)]
            done = []
            for _ in range(depth):
                step = []
                for path, lo, hi in ways:
                    r = m - lo - hi
                    if path and r <= 1:
                        done.append((path, lo, hi))
                        continue
                    step += [(path + "P", lo + r // 2, hi), (path + "S", lo, hi + r - r // 2)]
                ways = step
            times = 0
            for path, lo, hi in ways + done:
                if a[:lo] == b[:lo] and a[m - hi :] == b[len(b) - hi :]:
                    times += len(list(variants.pairs_of(f"{m}|{path}|{a[:lo]}|", [a, b])))
            assert times == 1, (a, b, depth)


def test_long_texts_in_parts(monkeypatch):
    text = "Word wÉrd x9y " * 500 + "a" * 3000
    whole = variants.runs(text)
    for size in (1, 5, 64):
        monkeypatch.setattr(variants, "PART", size)
        assert variants.runs(text) == whole


def test_empty_and_bad(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert variants.group(empty).count() == 0
    with pytest.raises(ValueError):
        variants.group(empty, times=1)
