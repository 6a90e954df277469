"""Best-fit packing of tokenised documents into sequences by minimum bin slack."""

from __future__ import annotations

import json
import os
import zlib
from array import array
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lectern.llm.common import ceil_div, materialise

#: Chunks of text between white space, and parts of them, whose ids a worker keeps: twice as many at most.
CHUNKS, PARTS = 200_000, 50_000
#: A-Z in lower case, and marks that end a chunk and are a part of their own after a letter or digit.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
ENDS = b".,;:!?)]}%*&$#@^~=+-"


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Minimum bin slack over a table of lengths: (repeats, lengths of one bin) until none is left.

    Each bin takes the longest length there is; a bitset of reachable sums over the other lengths (bit s is set if some of
    them add up to s) finds the fullest combination beside it. The same bin is then made as often as the lengths
    allow, which is what repeating the choice would give, so that a choice uses up a length: at most as many patterns
    as there are lengths, whatever the number of pieces."""
    left = {k: v for k, v in counts.items() if v > 0}
    out = []
    full = (1 << (capacity + 1)) - 1
    while left:
        longest = max(left)
        room = capacity - longest
        mask = full >> longest
        steps, reach = [], 1  # (length, how many at once, sums before it)
        for length in sorted((x for x in left if x <= room), reverse=True):
            spare = min(left[length] - (length == longest), room // length)
            take = 1
            while spare > 0 and not reach >> room & 1:
                take = min(take, spare)
                steps.append((length, take, reach))
                reach |= (reach << (length * take)) & mask
                spare -= take
                take *= 2
            if reach >> room & 1:
                break
        at = reach.bit_length() - 1
        lengths = [longest]
        for length, take, before in reversed(steps):
            if not before >> at & 1:
                lengths += [length] * take
                at -= length * take
        need: dict[int, int] = defaultdict(int)
        for x in lengths:
            need[x] += 1
        repeats = min(left[x] // n for x, n in need.items())
        for x, n in need.items():
            left[x] -= n * repeats
            if not left[x]:
                del left[x]
        out.append((repeats, lengths))
    return out


def slots(counts: dict[int, int], capacity: int) -> dict[int, tuple[list[int], list[int], list[int]]]:
    """For each length: where ranges of its ranks begin, and the sequence of the first rank and the offset in each range."""
    table: dict[int, tuple[list[int], list[int], list[int]]] = defaultdict(lambda: ([], [], []))
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for repeats, lengths in patterns(counts, capacity):
        offset = 0
        for x in lengths:
            begins, sequences, offsets = table[x]
            begins.append(used[x])
            sequences.append(sequence)
            offsets.append(offset)
            used[x] += repeats
            offset += x
        sequence += repeats
    return dict(table)


class Recent:
    """What was used lately: two generations of a dictionary, the older of which is dropped when the younger is full."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.young, self.old = {}, self.young
        self.young[key] = value


class ChunkTokenizer:
    """Ids of texts. A tokenizer of the form that is checked here drops white space, never joins across it and splits words by
    `PARTS_OF` before anything else, so it gives the ids of the chunks and of their parts in turn: each is encoded once and kept
    while in use. A tokenizer of any other form encodes every text whole.

    Chunks end at ASCII white space; what else may count as white space, and chunks with letters past Latin, whose
    normal forms may join, are left to the tokenizer whole."""

    PARTS_OF = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
    WHOLE = regex.compile(r"[^\x21-\x7e\xa1-\xac\xae-\u017f]|<\|")

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        form = json.loads(self.tokenizer.to_str())
        steps = (form.get("pre_tokenizer") or {}).get("pretokenizers", [])
        pattern = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
        split = {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Removed", "invert": True}
        normal = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
        # Any other form is encoded whole: it may keep white space or join across it.
        self.splits = len(steps) == 2 and steps[0] == split and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and form.get("normalizer") == normal
        self.splits &= not form.get("truncation") and not form.get("padding")
        # Byte-level vocabularies write a byte as its own character where that is visible, the others as those from U+0100 on.
        seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        self.visible = {c: 256 + n for n, c in enumerate(c for c in range(256) if c not in seen)}
        self.end = end_id.to_bytes(4, "little")
        self.chunks, self.parts = Recent(CHUNKS), Recent(PARTS)

    def _encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _tokenize(self, part: str) -> bytes:
        seen = part if part.isascii() else part.encode().decode("latin-1").translate(self.visible)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(seen)]).tobytes()

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            ids = self._tokenize(part)
            self.parts.put(part, ids)
        return ids

    def _chunk(self, chunk: bytes) -> bytes:
        if chunk.isalpha():  # ASCII letters
            return self._tokenize(chunk.decode().lower())
        text = chunk.decode()
        # "\u0130" in lower case is two characters.
        if "\u0130" in text or self.WHOLE.search(text):
            return self._encode(text)
        text = text.lower()
        if text.isalpha():
            return self._tokenize(text)
        return b"".join(map(self._part, self.PARTS_OF.findall(text)))

    def _ids(self, chunk: bytes) -> bytes:
        """Ids of a chunk that was not used lately; of a word with marks after it the word is kept, and both once it is used again."""
        ids = self.chunks.get(chunk)
        if ids is not None:
            return ids
        word = chunk.rstrip(ENDS)
        if word and len(word) < len(chunk) and (word[-1:].isalnum() or (word[-1] > 127 and word.decode()[-1].isalpha())):
            ids, end = self.chunks.get(word), self._part(chunk[len(word) :].decode())
            if ids is None:
                ids = self._chunk(word)
                self.chunks.put(word, ids)
                return ids + end
            ids += end
        else:
            ids = self._chunk(chunk)
        self.chunks.put(chunk, ids)
        return ids

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids of the whole text and the end id; a null text has the end id alone."""
        if not self.splits:
            return self._encode(text or "") + self.end
        data = (text or "").encode()
        # Letters may compose with marks (U+0300 to U+037F) in one case alone, and special tokens are told by their case.
        if b"\xcc" not in data and b"\xcd" not in data and b"<|" not in data:
            data = data.translate(LOWER)
        chunks = data.split()
        out = list(map(self.chunks.young.get, chunks))
        if None in out:
            for k, ids in enumerate(out):
                if ids is None:
                    out[k] = self._ids(chunks[k])
        out.append(self.end)
        return b"".join(out)


_CODERS: dict[tuple[str, int], ChunkTokenizer] = {}  # a worker's, kept from task to task


def coder(path: str, end_id: int) -> ChunkTokenizer:
    if (path, end_id) not in _CODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks of an executor are its threads
        _CODERS[path, end_id] = ChunkTokenizer(path, end_id)
    return _CODERS[path, end_id]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the pieces of every row, map-side only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(tokenizer, end_id).encode
        for b in batches:
            rows: list[tuple] = []
            ids, texts = b.column("doc_id").to_pylist(), b.column("text")
            for k, doc in enumerate(ids):
                data = code(texts[k].as_py())
                for n, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    rows.append((doc, n, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece of each row of `docs`.

    - The choice of combinations needs only how many pieces have each length: `capacity` numbers at most, whatever the
      data. Pieces of a length are then numbered, by counts of buckets first, and the number gives a piece its place.
    - A null or empty text is one piece, the end id. A null doc_id is kept. Repeated rows are packed as often as they are there.
    - Only documents longer than `capacity` are cut; a very long text is encoded in one task. An empty table gives no rows.
    - Columns beside doc_id and text play no part. However many rows are equal, they are dealt over all buckets."""
    cut = materialise(pieces(docs, tokenizer, capacity, end_id).withColumn("row", F.monotonically_increasing_id()), "pieces")
    by_length = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `capacity` rows at most
    table = slots(by_length, capacity)
    buckets = ceil_div(int(sum(by_length.values()) ** 0.5), 4)
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    counts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("length", "bucket").orderBy("row")
    ranked = dealt.withColumn("place", F.row_number().over(inside) - 1).join(counts, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("place")).alias("rank"))
    shared = docs.sparkSession.sparkContext.broadcast(table)  # bounded: patterns and their slots depend on `capacity` alone

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = shared.value
        for b in batches:
            sequence, offset = [], []
            for length, rank in zip(b.column("length").to_pylist(), b.column("rank").to_pylist(), strict=True):
                begins, sequences, offsets = places[length]
                k = bisect_right(begins, rank) - 1
                sequence.append(sequences[k] + rank - begins[k])
                offset.append(offsets[k])
            kept = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
