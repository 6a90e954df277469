"""Token ids of documents in ORC files, in order of documents, and readers of them."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.binpack import coder
from lectern.llm.common import ceil_div, new_path, small

#: Bytes of text that a file's task encodes: some 15 MB of stored ids. Bytes of text for one of the files that it is stored in, roughly.
#: Bytes of ids in a batch on the way to the writer.
FILE_BYTES, UNPACKED, BATCH_BYTES = 32 << 20, 2, 4 << 20
#: Settings of the files. Stripes are what tasks read apart from one another, so they are small; a group of rows is the least that the
#: row index and the Bloom filters can skip. Rows are long here: the writer looks at its memory every 64 of them, not every 5,000.
LAYOUT = {
    "compression": "snappy",
    "orc.stripe.size": str(8 << 20),
    "orc.row.index.stride": "1000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.rows.between.memory.checks": "64",
}
#: Files up to which the table of where they begin, 24 bytes a file, is broadcast; beyond, the join shuffles.
BROADCAST_FILES = 200_000

STORED = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("place", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])


class CorruptFile(ValueError):
    """What a file says of a document is not what its ids are."""


def text_bytes(docs: DataFrame) -> int:
    """About how many bytes of text a frame has: what Spark's statistics say of the files that it reads, or else, where they say nothing, a count."""
    known = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if known < 1 << 60:  # the size of a frame that is not made of files is told as the largest there is
        return known * UNPACKED
    return docs.agg(F.coalesce(F.sum(F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))) + 16), F.lit(0))).first()[0]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, file_bytes: int = FILE_BYTES) -> str:
    """Write the ids of each row of `docs` (doc_id, text) to ORC files below `path`, in ascending order of doc_id; gives `path`.

    Texts are dealt out by ranges of (doc_id, hash of the text, row), so that one doc_id that very many rows have is in as many files
    as it needs, then encoded and written once. Each row knows its file and the ids before it there: `part`, `place`. Ids and places are
    runs of integers to ORC's encoder. `path`/files has the rows, `path`/parts how many documents and ids each file has and the ids
    before it, which read() adds: files are written beside one another, before any knows what is before it.

    - A null or empty text has the end id alone. A null doc_id comes before all others. Rows of one doc_id follow each other, in the order
      of their texts' hashes. A very long text is encoded in one task. An empty table gives files without rows.
    - Columns beside doc_id and text are left out."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_hash").asc(), F.col("_row").asc()]
    rows = rows.withColumn("_hash", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
    ranged = rows.repartitionByRange(ceil_div(text_bytes(docs), file_bytes), *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(tokenizer, end_id).encode
        part, place = TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, int, bytes]] = []
        size = 0

        def out() -> pa.RecordBatch:
            lengths = np.array([len(data) // 4 for *_, data in held], dtype=np.int64)
            ids = np.frombuffer(b"".join(data for *_, data in held), dtype="<i4")
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            columns = [pa.array([part] * len(held), pa.int32()), pa.array([d for d, *_ in held], pa.int64()), pa.array([p for _, p, _ in held], pa.int64()), pa.array(lengths, pa.int64())]
            return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], STORED.fieldNames())

        for b in batches:
            for doc, value in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                data = code(value.as_py())
                held.append((doc, place, data))
                place += len(data) // 4
                size += len(data)
                if size >= BATCH_BYTES:
                    yield out()
                    held.clear()
                    size = 0
        yield out()

    writer = ranged.mapInArrow(run, STORED).write
    for k, v in LAYOUT.items():
        writer = writer.option(k, v)
    writer.orc(f"{path}/files")
    _write_parts(spark, path)
    return path


def _write_parts(spark: SparkSession, path: str) -> None:
    """part, docs, tokens, base of each file, from two columns of the files; a row a file goes through the driver."""
    sums = spark.read.schema(STORED).orc(f"{path}/files").groupBy("part").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))
    base, parts = 0, []
    for r in sorted(sums.collect()):
        parts.append((r["part"], r["docs"], r["tokens"], base))
        base += r["tokens"]
    spark.createDataFrame(parts, "part int, docs long, tokens long, base long").coalesce(1).write.orc(f"{path}/parts")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of the documents that write() stored: start counts the ids of all documents before.

    Tasks read stripes beside one another, in as many splits as Spark makes of the files; a filter on doc_id reaches ORC, whose minima, maxima
    and Bloom filters skip files, stripes and groups of rows, and a query without ids does not read them."""
    parts = spark.read.schema("part int, docs long, tokens long, base long").orc(f"{path}/parts").select(F.col("part").alias("_part"), "base")
    rows = spark.read.schema(STORED).orc(f"{path}/files")
    joined = rows.join(small(parts, BROADCAST_FILES), F.col("part") == F.col("_part"))
    return joined.select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of read() for some documents, by the files' indexes; `doc_ids` is a list of a request, not a table."""
    return read(spark, path).where(F.col("doc_id").isin(doc_ids))


def checksums(stored: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of rows of read(); fails where a row has not as many ids as it says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            lengths = lists.value_lengths()
            if not lengths.equals(b.column("n_tokens").cast(lengths.type)):
                raise CorruptFile("a document has other ids than as many as its row says")
            offsets, ids = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4", copy=False)
            sums = [zlib.crc32(ids[a:z]) for a, z in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return stored.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """checksums() of what write() stores of the documents in the shared folder, read back."""
    spark = docs.sparkSession
    return checksums(read(spark, write(docs, new_path(spark, "token-ids"), tokenizer, end_id)))
