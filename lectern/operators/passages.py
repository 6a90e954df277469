"""Passages of full texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a chunk, how many the next one repeats, and the least a text must have.
SIZE, OVERLAP, LEAST = 1200, 150, 12
#: Texts that are cut at a time.
TEXTS = 200


def cut(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Chunks of a text with single spaces: each ends at the last space in its second half, if there is one."""
    text = " ".join(text.split())
    out, at = [], 0
    while len(text) - at > size:
        space = text.rfind(" ", at + size // 2, at + size)
        end = space if space > 0 else at + size
        out.append(text[at:end].strip())
        at = max(end - overlap, at + 1)
    out.append(text[at:].strip())
    return [x for x in out if x]


def chunks(texts: DataFrame, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """doc_id, ordinal, text: the chunks of each row of `texts` (doc_id, text), map-side. Texts under `least` characters give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, TEXTS) for whole in batches for at in range(0, whole.num_rows, TEXTS)):
            rows = [(doc, n, c) for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) if text and len(" ".join(text.split())) >= least for n, c in enumerate(cut(text, size, overlap))]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string())], ["doc_id", "ordinal", "text"])

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, ordinal int, text string")


def before_references(text: Column) -> Column:
    """The text before the first line that is a heading of references."""
    return F.regexp_replace(text, r"(?is)(^|\n)[ \t]*(references|bibliography|works cited|参考文献)[ \t]*:?[ \t]*(\n.*$|$)", "$1")
