"""Fill-in-middle: documents cut into prefix, middle and suffix, and put in the order that a model learns from."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a text is cut into: a word with the white space before it, or white space at the end.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: Where a unit surely ends: a word's last character, before white space.
BETWEEN = re.compile(r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Characters after which a long text goes to the splitter in a further part, and characters of output in a batch.
PART, BATCH = 1 << 19, 1 << 22


class Units:
    """Ends of a text's units, by the tokenizers library's Split with isolated matches: it is made, not trained, and tells offsets in code points."""

    def __init__(self, pattern: str = UNIT):
        from tokenizers import Regex, pre_tokenizers

        self.split = pre_tokenizers.Split(Regex(pattern), behavior="isolated").pre_tokenize_str

    def parts(self, text: str) -> Iterator[tuple[int, str]]:
        """(offset, part) of a text, cut where a unit ends, so that a long one's units are never all held as objects."""
        at = 0
        while len(text) - at > PART:
            end = BETWEEN.search(text, at + PART)
            if not end:
                break
            yield at, text[at : end.start()]
            at = end.start()
        yield at, text[at:] if at else text

    def ends(self, text: str) -> np.ndarray:
        """Offset of the end of each unit; as many as there are units."""
        found = [np.fromiter((end for _, (_, end) in self.split(part)), dtype=np.int64) + at for at, part in self.parts(text) if part]
        return np.concatenate(found) if found else np.empty(0, np.int64)


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers under 2^32 that depend on the document's number and the seed alone."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12)]


def arrange(text: str, form: str, first: int, second: int, marks: tuple[str, str, str] = MARKS) -> str:
    """The text with its middle, from offset `first` to `second`, at the end."""
    p, s, m = marks
    if form == "plain":
        return text
    before, middle, after = text[:first], text[first:second], text[second:]
    return f"{p}{before}{s}{after}{m}{middle}" if form == "psm" else f"{s}{after}{p}{before}{m}{middle}"


def transform(docs: DataFrame, rate: int = 50, spm_rate: int = 80, seed: int = 42, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: each row of `docs` (doc_id, text) in its form.

    Of 100 documents some `rate` are cut at the ends of two units that hash numbers of doc_id choose, and `spm_rate` of 100 of those
    put the suffix first (spm), the others the prefix (psm). One task reads a row and nothing is shuffled.

    - A null text is empty; an empty text, and one that has a mark in it, stays plain. Such rows still count their units in n.
    - A null doc_id draws as one without digits. Repeated rows come out alike, each. An empty table gives no rows.
    - prefix_chars and middle_chars are code points, null for plain. Both cuts may meet: the middle is then empty.
    - A very long text is read whole, in parts of half a million characters that end where a unit ends; white space or a word
      longer than that stays in one part. Columns beside doc_id and text play no part."""
    if len(set(marks)) != 3 or any(not re.fullmatch(r"<[^<>]+>", m) for m in marks):
        raise ValueError("marks have to be three different texts in < and >, so that they never overlap with a text before them")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units()
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        rows: list[tuple] = []
        held = 0

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        for b in batches:
            for doc, value in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                text = value.as_py() or ""
                ends = units.ends(text)
                n = len(ends)
                h1, h2, h3, h4 = draws(doc, seed)
                if not text or h3 % 100 >= rate or any(m in text for m in marks):
                    rows.append((doc, n, "plain", None, None, text))
                else:
                    first, second = (int(ends[k - 1]) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
                    form = "spm" if h4 % 100 < spm_rate else "psm"
                    rows.append((doc, n, form, first, second - first, arrange(text, form, first, second, marks)))
                held += len(text)
                if held >= BATCH:
                    yield out()
                    rows.clear()
                    held = 0
        yield out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of, from the output and its form alone. JVM only.

    A text that was cut holds no mark, and a mark begins with a character that ends none, so it falls into three parts at its marks."""
    parts = F.split(output, "|".join(rf"\Q{m}\E" for m in marks), -1)
    psm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    spm = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(made: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of what transform() made."""
    restored = restore(F.col("output"), F.col("form"), marks)
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored).alias("restored_sha256"))


#: DuckDB. Units by regular expression, cuts by lengths of the first units; the text is restored by its own cuts.
ORACLE = r"""
WITH docs AS (
  SELECT doc_id, COALESCE(text, '') AS text, sha256('42:' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS hex FROM documents
), drawn AS (
  SELECT doc_id, text, CAST('0x' || hex[1:8] AS BIGINT) AS h1, CAST('0x' || hex[9:16] AS BIGINT) AS h2, CAST('0x' || hex[17:24] AS BIGINT) AS h3, CAST('0x' || hex[25:32] AS BIGINT) AS h4,
    regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM docs
), cut AS (
  SELECT *, len(units) AS n, LEAST(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, GREATEST(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, array_to_string(units[:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM cut
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
