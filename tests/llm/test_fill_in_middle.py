"""Fill-in-middle against its definition, written with regular expressions, and an exact way back."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import fim

UNIT = re.compile(fim.UNIT)


def plain(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) as the definition says."""
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = [None, "", " ", "\n\t \r", "one", "  two words\x0b\x0c ", "añb 𝒳y 日本 z q r", "a <P> b", "<S>", "ends <M", "< P> <<S <P < M>", "x" * 3000, "a b\n" * 5000, "\x1f\x85 nul\x00 in"]


def test_against_definition(spark):
    rows = [(i if i % 97 else None, TEXTS[i % len(TEXTS)], "more", i) for i in range(600)]
    rows += rows[:40]
    frame = spark.createDataFrame(rows, "doc_id long, text string, output string, n int").repartition(5)
    got = sorted(map(tuple, fim.transform(frame).collect()), key=repr)
    assert got == sorted(((i, *plain(i, t)) for i, t, *_ in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}
    for r in fim.digests(fim.transform(frame)).join(frame.select("doc_id", "text").distinct(), "doc_id").collect():
        assert r["restored_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def test_long_texts_in_parts(monkeypatch):
    text = "  lead " + " ".join(f"w{k}\n" * (k % 3) for k in range(4000)) + " " * 900
    whole = fim.Units().ends(text)
    for size in (1, 7, 100, 5000):
        monkeypatch.setattr(fim, "PART", size)
        assert (fim.Units().ends(text) == whole).all()
    assert len(whole) == len(UNIT.findall(text)) and whole[-1] == len(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab<>PSM \n\té𝒳"), max_size=40), st.data())
def test_way_back(text, data):
    """Any text without a mark, cut anywhere, is found again between the marks."""
    if any(m in text for m in fim.MARKS):
        return
    a = data.draw(st.integers(0, len(text)))
    b = data.draw(st.integers(a, len(text)))
    for form in ("psm", "spm"):
        parts = re.split("<P>|<S>|<M>", fim.arrange(text, form, a, b))
        assert len(parts) == 4
        assert "".join(parts[k] for k in ((1, 3, 2) if form == "psm" else (2, 3, 1))) == text


def test_units_are_those_of_the_pattern():
    for text in TEXTS:
        ends = fim.Units().ends(text or "").tolist()
        assert ends == [m.end() for m in UNIT.finditer(text or "")]


def test_rates_and_marks(spark):
    frame = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("some words <P> that are cut").alias("text"))
    marks = ("<pre>", "<suf>", "<mid>")
    made = fim.transform(frame, rate=100, spm_rate=0, seed=7, marks=marks)
    assert {r["form"] for r in made.select("form").distinct().collect()} == {"psm"}
    assert made.where(fim.restore(F.col("output"), F.col("form"), marks) != "some words <P> that are cut").count() == 0
    assert fim.transform(frame, rate=0).where("form <> 'plain'").count() == 0
    assert fim.transform(frame.limit(0)).count() == 0
    for bad in (("<a>", "<a>", "<b>"), ("<a>", "b>", "<c>"), ("<a<", "<b>", "<c>")):
        with pytest.raises(ValueError):
            fim.transform(frame, marks=bad)
