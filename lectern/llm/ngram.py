"""Language-model scoring: a trigram model in Elias-Fano tries, sharded by context."""

from __future__ import annotations

import mmap
import os
import struct
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import ceil_div, delete, drop, materialise, materialise_parts, tidy

#: Tokens that a task encodes together, and pairs of tokens of a shard of the model.
BATCH_TOKENS = 1_500_000
SHARD_TOKENS = 1_500_000
#: Groups of shards that answer one after another, so that the questions of one alone are on disk twice, and the shards that a group has at least.
GROUPS, GROUP_SHARDS = 4, 16
#: Weight of the unigram probabilities beside pairs, in occurrences of the context, and what every seen trigram's count is discounted by.
MU = 500.0
DISCOUNT = 0.6
#: Bits of a quantised probability, and the power of ten that code 0 stands for.
CODE_BITS = 12
FLOOR = -10.0
END = b"\n"  # cannot be a word


# ---------------------------------------------------------------------------------------------------- compact arrays


def _words(values: np.ndarray, width: int) -> np.ndarray:
    """Numbers of `width` bits after each other in 64-bit words, and one spare word."""
    n = len(values)
    out = np.zeros(n * width // 64 + 2, dtype=np.uint64)
    if n and width:
        bit = np.arange(n, dtype=np.int64) * width
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        values = values.astype(np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] |= np.bitwise_or.reduceat(values << shift, first)
        spill = np.flatnonzero(shift.astype(np.int64) + width > 64)
        out[word[spill] + 1] |= values[spill] >> (np.uint64(64) - shift[spill])  # one number at most spills into a word
    return out


def _get(words: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    if not width:
        return np.zeros(len(at), dtype=np.int64)
    bit = at * width
    word, shift = bit >> 6, (bit & 63).astype(np.uint64)
    high = np.where(shift > 0, words[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    return (((words[word] >> shift) | high) & np.uint64((1 << width) - 1)).astype(np.int64)


def _select(words: np.ndarray, before: np.ndarray, rank: np.ndarray, flip: bool) -> np.ndarray:
    """Position of the set bit (clear bit, if `flip`) number `rank`, from 0; before: such bits before each word."""
    word = np.searchsorted(before, rank, side="right") - 1
    w = ~words[word] if flip else words[word]
    rank = rank - before[word]
    at = word << 6
    for width in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count(w & np.uint64((1 << width) - 1)).astype(np.int64)
        on = rank >= low
        rank = rank - low * on
        at = at + width * on
        w = w >> (np.uint64(width) * on.astype(np.uint64))
    return at


class EliasFano:
    """A sequence of numbers that never fall: low bits as they are, high parts in unary, some two bits each."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray):
        self.n, self.width, self.low, self.high = n, width, low, high
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])[:-1]
        self.ones, self.zeros = ones, np.arange(len(high), dtype=np.int64) * 64 - ones

    @staticmethod
    def pack(values: np.ndarray) -> bytes:
        n = len(values)
        most = int(values[-1]) if n else 0
        width = max(0, (most // max(1, n)).bit_length() - 1)
        values = values.astype(np.int64)
        low = _words(values & ((1 << width) - 1), width)
        bits = np.zeros(((n + (most >> width) + 1) // 64 + 1) * 64, dtype=np.uint8)
        bits[(values >> width) + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view("<u8")
        return struct.pack("<qqqq", n, width, len(low), len(high)) + low.astype("<u8").tobytes() + high.tobytes()

    @classmethod
    def at(cls, data, offset: int) -> tuple[EliasFano, int]:
        n, width, a, b = struct.unpack_from("<qqqq", data, offset)
        offset += 32
        low, high = np.frombuffer(data, "<u8", a, offset), np.frombuffer(data, "<u8", b, offset + 8 * a)
        return cls(n, width, low, high), offset + 8 * (a + b)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return ((_select(self.high, self.ones, at, False) - at) << self.width) | _get(self.low, self.width, at)

    def successor(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each value the position of the first number that is no smaller (n, if none) and whether it is equal."""
        high = values >> self.width
        last = len(self.high) * 64 - int(self.ones[-1]) - int(np.bitwise_count(self.high[-1])) - 1
        high, beyond = np.minimum(high, last), high > last
        upto = _select(self.high, self.zeros, high, True) - high
        begin = np.where(high > 0, _select(self.high, self.zeros, np.maximum(high - 1, 0), True) - (high - 1), 0)
        begin = np.where(beyond, self.n, begin)
        end, low = np.where(beyond, self.n, upto), values & ((1 << self.width) - 1)
        a, b = begin.copy(), end.copy()
        open_ = np.flatnonzero(a < b)
        while len(open_):
            middle = (a[open_] + b[open_]) >> 1
            less = _get(self.low, self.width, middle) < low[open_]
            a[open_[less]] = middle[less] + 1
            b[open_[~less]] = middle[~less]
            open_ = open_[a[open_] < b[open_]]
        equal = a < end
        equal[equal] = _get(self.low, self.width, a[equal]) == low[equal]
        return a, equal


class Trie:
    """Contexts, pointers to their successors, successors relative to their context, and quantised probabilities.

    A successor is kept as its number (from 1) plus the last value of the context before, so that the whole level
    never falls; the search for a successor of a context is one for that sum."""

    def __init__(self, data):
        at = 0
        self.contexts, at = EliasFano.at(data, at)
        self.pointers, at = EliasFano.at(data, at)
        self.successors, at = EliasFano.at(data, at)
        (count,) = struct.unpack_from("<q", data, at)
        self.codes = np.frombuffer(data, "<u8", count, at + 8)

    @staticmethod
    def pack(context: np.ndarray, word: np.ndarray, probability: np.ndarray) -> bytes:
        """From pairs sorted by (context, word), words from 1."""
        ids, first = np.unique(context, return_index=True)
        ends = np.append(first[1:], len(context)).astype(np.int64)[: len(ids)]
        last = np.cumsum(word[ends - 1]) if len(ids) else np.empty(0, np.int64)
        base = np.concatenate([[0], last[:-1]]).astype(np.int64)[: len(ids)]
        relative = word + np.repeat(base, ends - first)
        codes = _words(quantise(probability), CODE_BITS)
        pointers = np.concatenate([[0], ends]).astype(np.int64)
        return EliasFano.pack(ids) + EliasFano.pack(pointers) + EliasFano.pack(relative) + struct.pack("<q", len(codes)) + codes.astype("<u8").tobytes()

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The position of each pair among all, -1 for one that is not there. Any order."""
        out = np.full(len(context), -1, dtype=np.int64)
        if not self.contexts.n:
            return out
        ids, back = np.unique(context, return_inverse=True)
        place, there = self.contexts.successor(ids)
        place = np.where(there, place, 0)
        begin, end = self.pointers[place], self.pointers[place + 1]
        base = np.where(begin > 0, self.successors[np.maximum(begin - 1, 0)], 0)
        k, equal = self.successors.successor(base[back] + word)
        found = equal & there[back] & (k >= begin[back]) & (k < end[back])
        out[found] = k[found]
        return out

    def code(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The code of each pair, 0 for one that is not there."""
        at = self.find(context, word)
        out = np.zeros(len(at), dtype=np.int64)
        out[at >= 0] = _get(self.codes, CODE_BITS, at[at >= 0])
        return out


class Levels:
    """A shard of the model: a trie of pairs, whose successors are the contexts of a trie of trigrams, and the weight that each pair leaves to
    the level below."""

    def __init__(self, data):
        size, more = struct.unpack_from("<qq", data, 0)
        view = memoryview(data)
        self.pairs, self.triples = Trie(view[16 : 16 + size]), Trie(view[16 + size : 16 + size + more])
        self.rest = np.frombuffer(data, "<u8", -1, 16 + size + more)

    @staticmethod
    def pack(a: np.ndarray, b: np.ndarray, number: np.ndarray, count: np.ndarray, pair: np.ndarray, c: np.ndarray, triples: np.ndarray, mu: float, discount: float) -> bytes:
        """From pairs sorted by (a, b), their counts and those of a; triples sorted by (position of their pair, c) and their counts."""
        of_pair = np.bincount(pair, weights=triples, minlength=len(a))
        kinds = np.bincount(pair, minlength=len(a))
        rest = np.where(of_pair > 0, discount * kinds / np.maximum(of_pair, 1), 1.0)
        first = Trie.pack(a, b, number / (count + mu))
        second = Trie.pack(pair, c, (triples - discount) / of_pair[pair])
        return struct.pack("<qq", len(first), len(second)) + first + second + _words(quantise(rest), CODE_BITS).astype("<u8").tobytes()

    @classmethod
    def mapped(cls, data: bytes) -> Levels:
        """The levels in a file that is mapped and has no name any more: it goes with the last use, however a task ends."""
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            return cls(mmap.mmap(f.fileno(), os.fstat(f.fileno()).st_size, prot=mmap.PROT_READ))

    def ask(self, a: np.ndarray, b: np.ndarray, runs: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of pairs (0: not seen), of what they leave, and of triples: `runs` successors c of each pair in turn."""
        at = self.pairs.find(a, b)
        seen = at >= 0
        codes, rest = np.zeros(len(at), dtype=np.int64), np.full(len(at), (1 << CODE_BITS) - 1, dtype=np.int64)
        codes[seen], rest[seen] = _get(self.pairs.codes, CODE_BITS, at[seen]), _get(self.rest, CODE_BITS, at[seen])
        pair = np.repeat(at, runs)
        triples = np.zeros(len(c), dtype=np.int64)
        asked = (pair >= 0) & (c > 0)
        triples[asked] = self.triples.code(pair[asked], c[asked])
        return codes, rest, triples


def quantise(probability: np.ndarray) -> np.ndarray:
    """Codes from 1: equal steps of the logarithm between 10**FLOOR and 1."""
    steps = (1 << CODE_BITS) - 1
    return np.clip(np.rint((np.log10(np.maximum(probability, 1e-300)) / -FLOOR + 1) * (steps - 1)) + 1, 1, steps).astype(np.int64)


def probability(code: np.ndarray) -> np.ndarray:
    steps = (1 << CODE_BITS) - 1
    return np.where(code > 0, 10.0 ** (-FLOOR * ((code - 1) / (steps - 1) - 1)), 0.0)


# ------------------------------------------------------------------------------------------------------- Spark stages


def _zip(a: np.ndarray) -> bytes:
    """An array's bytes by significance, compressed: small numbers cost little."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(a.reshape(-1).view(np.uint8).reshape(-1, a.itemsize).T).tobytes())


def _unzip(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


ENCODED = pa.schema([("batch", pa.int64()), ("docs", pa.binary()), ("tokens", pa.binary()), ("words", pa.binary()), ("end", pa.int32()), ("n", pa.int64()), ("train", pa.int64())])
ENCODED_SQL = "batch long, docs binary, tokens binary, words binary, end int, n long, train long"


def _encode(batch_tokens: int):
    """Rows (doc_id, text, held) to batches: the documents' tokens as numbers of the batch's own words, in the order of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        words, docs, parts, total = {END: 0}, [], [], 0

        def out() -> pa.RecordBatch:
            nonlocal number
            number += 1
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), "<u8", len(words))
            order = np.argsort(hashes, kind="stable")
            place = np.empty(len(order), "<i4")
            place[order] = np.arange(len(order))
            tokens = place[np.concatenate(parts)]
            about = np.array([(0 if d is None else d, d is None, h, n) for d, h, n in docs], dtype="<i8")
            row = {
                "batch": (part << 24) + number, "docs": _zip(about.T), "tokens": _zip(tokens), "words": _zip(np.diff(hashes[order], prepend=np.uint64(0))), "end": int(place[0]),
                "n": len(tokens), "train": int(about[about[:, 2] == 0, 3].sum()),
            }
            return pa.RecordBatch.from_pylist([row], schema=ENCODED)

        for b in batches:
            for doc, text, h in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("held").to_pylist(), strict=True):
                found = (text.as_py() or "").encode().lower().split()
                found.append(END)
                for w in found:
                    if w not in words:
                        words[w] = len(words)
                parts.append(np.fromiter(map(words.__getitem__, found), "<i4", len(found)))
                docs.append((doc, h, len(found)))
                total += len(found)
                if total >= batch_tokens:
                    yield out()
                    words, docs, parts, total = {END: 0}, [], [], 0
        if docs:
            yield out()

    return run


def _bounds(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Where each of the shards, equal ranges of the hash, begins and the last ends in sorted hashes."""
    return np.searchsorted(hashes, np.array([(k << 64) // shards for k in range(shards)], dtype=np.uint64)).tolist() + [len(hashes)]


def _vocabulary(shards: int):
    """Batches to (shard, batch, words, counts): the batch's words of each range of hashes and their counts in its training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                tokens, hashes = _unzip(row["tokens"], "<i4"), np.cumsum(_unzip(row["words"], "<u8"), dtype=np.uint64)
                about = _unzip(row["docs"], "<i8").reshape(4, -1)
                counts = np.bincount(tokens[np.repeat(about[2] == 0, about[3])], minlength=len(hashes)).astype("<u8")
                at = _bounds(hashes, shards)
                rows = [{"shard": k, "batch": row["batch"], "words": _zip(np.diff(hashes[i:j], prepend=np.uint64(0))), "counts": _zip(counts[i:j])} for k, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)) if i < j]
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("shard", pa.int32()), ("batch", pa.int64()), ("words", pa.binary()), ("counts", pa.binary())]))

    return run


WORDS_SQL = "of long, shard int, totals binary, ids binary, seen long, hashes binary"


def _number(shards: int):
    """All batches' words of a range to (of, shard, totals, ids): for each batch its words' counts in training and their numbers.

    Numbers are from 1 and the commonest words of a range have the smallest; words that training does not have are 0. The
    range's own row (of -1) has the hashes, counts and numbers of all that it has, and how many."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        words = [np.cumsum(_unzip(w, "<u8"), dtype=np.uint64) for w in pdf["words"]]
        sizes = np.cumsum([0, *map(len, words)])
        distinct, back = np.unique(np.concatenate(words), return_inverse=True)
        del words
        totals = np.zeros(len(distinct), dtype="<u8")
        np.add.at(totals, back, np.concatenate([_unzip(c, "<u8") for c in pdf["counts"]]))
        shard = int(pdf["shard"].iloc[0])
        ids = np.zeros(len(distinct), dtype="<u8")
        order = np.argsort(-totals.astype(np.int64), kind="stable")[: int((totals > 0).sum())]
        ids[order] = np.arange(len(order), dtype=np.uint64) * np.uint64(shards) + np.uint64(shard + 1)
        if len(order) and int(ids.max()) >= 1 << 31:
            raise ValueError("a model holds fewer than 2^31 different words")
        rows = [(int(b), shard, _zip(totals[back[i:j]]), _zip(ids[back[i:j]]), 0, None) for b, i, j in zip(pdf["batch"], sizes[:-1], sizes[1:], strict=True)]
        held = totals > 0
        rows.append((-1, shard, _zip(totals[held]), _zip(ids[held]), len(order), _zip(np.diff(distinct[held], prepend=np.uint64(0)))))
        return pd.DataFrame(rows, columns=["of", "shard", "totals", "ids", "seen", "hashes"])

    return run


def _look_up(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Batches' words of a range and the range of a stored vocabulary to what _number() gives for each batch."""
    rows = []
    for known in right.itertuples():
        hashes = np.cumsum(_unzip(known.hashes, "<u8"), dtype=np.uint64)
        totals, ids = (np.append(_unzip(x, "<u8"), np.uint64(0)) for x in (known.totals, known.ids))
        for row in left.itertuples():
            words = np.cumsum(_unzip(row.words, "<u8"), dtype=np.uint64)
            at = np.minimum(np.searchsorted(hashes, words), max(0, len(hashes) - 1))
            at = np.where(hashes[at] == words, at, len(hashes)) if len(hashes) else np.zeros(len(words), dtype=np.int64)
            rows.append((int(row.batch), int(row.shard), _zip(totals[at]), _zip(ids[at]), 0, None))
    return pd.DataFrame(rows, columns=["of", "shard", "totals", "ids", "seen", "hashes"])


def _spread(context: np.ndarray, count: np.ndarray, word: np.ndarray, shards: int, most: int) -> np.ndarray:
    """The shard of each pair: that of its context, or, where the context occurs more than `most` times, one of several by word."""
    turns = -(-count // most)
    mixed = context * 1_000_003 + np.where(turns > 1, word % np.maximum(turns, 1), 0)
    mixed = (mixed.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    return (mixed % np.uint64(shards)).astype(np.int64)


class _Pairs:
    """The distinct pairs of neighbours in a batch, in the order of their shard and then of their words' numbers; those with a word
    that training does not have come first, under shard -1. And the distinct triples, in the order of their first pair and then of
    their last word's number; words without one are as one."""

    def __init__(self, tokens: np.ndarray, lengths: np.ndarray, end: int, count: np.ndarray, ids: np.ndarray, shards: int, most: int):
        self.starts = np.cumsum(lengths) - lengths
        key = np.empty(len(tokens), dtype=np.int64)
        key[1:] = tokens[:-1]
        key[self.starts] = end  # a text begins after an end
        key <<= 32
        key |= tokens
        key, self.of = np.unique(key, return_inverse=True)
        a, b = key >> 32, key & 0xFFFFFFFF
        shard = np.where((ids[a] > 0) & (ids[b] > 0), _spread(ids[a], count[a], ids[b], shards, most), -1)
        order = np.lexsort((ids[b], ids[a], shard))
        self.a, self.b = a[order], b[order]
        place = np.empty(len(order), dtype=np.int32)
        place[order] = np.arange(len(order))
        self.of = place[self.of]
        asked, first = np.unique(shard[order], return_index=True)
        self.shards = {int(s): (int(i), int(j)) for s, i, j in zip(asked, first, np.append(first[1:], len(order)), strict=True)}
        # A text's first token has no pair before it.
        self.later = np.ones(len(tokens), dtype=bool)
        self.later[self.starts] = False
        self.pair = self.of[np.flatnonzero(self.later) - 1].astype(np.int64)
        self.triples, self.triple = np.unique(self.pair << 32 | ids[tokens[self.later]], return_inverse=True)
        self.begins = np.searchsorted(self.triples >> 32, np.arange(len(order) + 1))


def _joined(right: pd.DataFrame, column: str) -> np.ndarray:
    """A column of blobs in the order of their shards."""
    return np.concatenate([_unzip(x, "<u8") for x in right.sort_values("shard")[column]]).astype(np.int64)


PREPARED = "batch long, shard long, a binary, b binary, c binary, d binary, e binary, f binary, end int"
PREPARED_COLUMNS = ["batch", "shard", "a", "b", "c", "d", "e", "f", "end"]


def _prepare(shards: int, most: int):
    """A batch and its words' counts to one row of what scoring it needs beside the batch (shard -1) and one for each shard of the model that it asks."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = left.iloc[0]
        tokens, about = _unzip(row["tokens"], "<i4"), _unzip(row["docs"], "<i8").reshape(4, -1)
        count, ids = _joined(right, "totals"), _joined(right, "ids")
        pairs = _Pairs(tokens, about[3], int(row["end"]), count, ids, shards, most)
        train = np.repeat(about[2] == 0, about[3])
        seen = np.bincount(pairs.of[train], minlength=len(pairs.a)).astype("<u4")
        seen3 = np.bincount(pairs.triple[train[pairs.later]], minlength=len(pairs.triples)).astype("<u4")
        rows = [(-1, None, None, _zip(count), _zip(ids), None, None)]
        for s, (i, j) in pairs.shards.items():
            if s >= 0:
                first = np.flatnonzero(np.diff(pairs.a[i:j], prepend=-1))
                context = pairs.a[i:j][first]
                runs = np.diff(np.append(first, j - i))
                x, y = pairs.begins[i], pairs.begins[j]
                rows.append((s, _zip(np.stack([ids[context], count[context], runs]).astype("<i8")), _zip(ids[pairs.b[i:j]].astype("<u4")), _zip(seen[i:j]),
                             _zip(np.diff(pairs.begins[i : j + 1]).astype("<u4")), _zip((pairs.triples[x:y] & 0xFFFFFFFF).astype("<u4")), _zip(seen3[x:y])))
        return pd.DataFrame([(int(row["batch"]), *r, int(row["end"])) for r in rows], columns=PREPARED_COLUMNS)

    return run


ANSWERS_SQL = "of long, shard long, codes binary, rest binary, triples binary"


def _asked(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch's row for a shard: contexts a (number, count), first and second words of its pairs, triples of each pair, their last words."""
    about = _unzip(row.a, "<i8").reshape(3, -1)
    return about[:2], np.repeat(about[0], about[2]), _unzip(row.b, "<u4").astype(np.int64), _unzip(row.d, "<u4").astype(np.int64), _unzip(row.e, "<u4").astype(np.int64)


#: Pairs and triples that are asked for together.
ASKED_TOGETHER = 200_000


def _tell(levels: Levels, pdf: pd.DataFrame) -> list[tuple]:
    rows: list[tuple] = []
    held: list[tuple] = []

    def ask() -> None:
        asked = [np.concatenate([x[k] for _, _, x in held]) for k in range(4)]
        codes, rest, triples = (x.astype("<u2") for x in levels.ask(*asked))
        i = j = 0
        for batch, shard, (a, _, _, c) in held:
            rows.append((batch, shard, _zip(codes[i : i + len(a)]), _zip(rest[i : i + len(a)]), _zip(triples[j : j + len(c)])))
            i, j = i + len(a), j + len(c)
        held.clear()

    for row in pdf.itertuples():
        held.append((int(row.batch), int(row.shard), _asked(row)[1:]))
        if sum(len(x[0]) + len(x[3]) for _, _, x in held) >= ASKED_TOGETHER:
            ask()
    if held:
        ask()
    return rows


def _answer(mu: float, discount: float, keep: bool):
    """All batches' pairs and triples of a shard: their codes by the levels of those seen in training, for each batch; and the levels (a row of -1), if they are kept."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found, seen, contexts = [np.empty(0, np.int64)], [np.empty(0, np.uint32)], []
        for row in pdf.itertuples():
            about, a, b, _, _ = _asked(row)
            n = _unzip(row.c, "<u4")
            found.append((a << 32 | b)[n > 0])
            seen.append(n[n > 0])
            contexts.append(about)
        key, back = np.unique(np.concatenate(found), return_inverse=True)
        number = np.bincount(back, weights=np.concatenate(seen), minlength=len(key))
        about = np.concatenate(contexts, axis=1)
        ids, first = np.unique(about[0], return_index=True)
        count = about[1][first]
        del found, seen, back, contexts
        found, seen = [np.empty(0, np.int64)], [np.empty(0, np.uint32)]
        for row in pdf.itertuples():
            n = _unzip(row.f, "<u4")
            if n.any():
                _, a, b, runs, c = _asked(row)
                at = np.repeat(np.searchsorted(key, a << 32 | b), runs)[n > 0]  # a triple's pair was seen where it was
                found.append(at << 32 | c[n > 0])
                seen.append(n[n > 0])
        triple, back = np.unique(np.concatenate(found), return_inverse=True)
        triples = np.bincount(back, weights=np.concatenate(seen), minlength=len(triple))
        del found, seen, back
        a = key >> 32
        data = Levels.pack(a, key & 0xFFFFFFFF, number, count[np.searchsorted(ids, a)] if len(a) else np.empty(0), triple >> 32, triple & 0xFFFFFFFF, triples, mu, discount)
        del key, number, triple, triples, a
        rows = [(-1, int(pdf["shard"].iloc[0]), data, None, None)] * keep + _tell(Levels.mapped(data), pdf)
        return pd.DataFrame(rows, columns=["of", "shard", "codes", "rest", "triples"])

    return run


def _answer_from(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Batches' questions to a shard and its stored levels (none, if training has nothing there) to its codes for each batch."""
    columns = ["of", "shard", "codes", "rest", "triples"]
    return pd.DataFrame(_tell(Levels.mapped(bytes(right["codes"].iloc[0])), left) if len(right) and len(left) else [], columns=columns)


def _finish(shards: int, most: int, total: int, distinct: int, mu: float):
    """A batch, what scoring it needs beside it, and the shards' answers to its documents' scores."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row, known = left[left["a"].notna()].iloc[0], left[left["a"].isna()].iloc[0]
        about, tokens = _unzip(row["a"], "<i8").reshape(4, -1), _unzip(row["b"], "<i4")
        count, ids = _unzip(known["c"], "<i8"), _unzip(known["d"], "<i8")
        pairs = _Pairs(tokens, about[3], int(row["end"]), count, ids, shards, most)
        codes, rest = np.zeros(len(pairs.a), dtype=np.int64), np.full(len(pairs.a), (1 << CODE_BITS) - 1, dtype=np.int64)
        triples = np.zeros(len(pairs.triples), dtype=np.int64)
        for answer in right.itertuples():
            i, j = pairs.shards[int(answer.shard)]
            codes[i:j], rest[i:j], triples[pairs.begins[i] : pairs.begins[j]] = (_unzip(x, "<u2") for x in (answer.codes, answer.rest, answer.triples))
        count = count.astype(np.float64)
        share = (count + 1) / (total + distinct + 1)
        after = (probability(codes) + mu / (count[pairs.a] + mu) * share[pairs.b])[pairs.of]
        after[pairs.later] = probability(triples)[pairs.triple] + probability(rest)[pairs.pair] * after[pairs.later]
        doc = pd.array(about[0], dtype="Int64")
        doc[about[1].astype(bool)] = pd.NA
        return pd.DataFrame({
            "doc_id": doc, "held_out": about[2].astype(bool), "n_tokens": about[3], "n_known": np.add.reduceat((count > 0)[tokens].astype(np.int64), pairs.starts), "train_tokens": total,
            "base_score": np.add.reduceat(np.log10(share)[tokens], pairs.starts), "score": np.add.reduceat(np.log10(after), pairs.starts),
        })

    return run


SCORES_SQL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


@dataclass
class Model:
    """A stored model: its vocabulary by range of hash, its levels by shard, and what scoring needs beside them."""

    vocabulary: DataFrame
    levels: DataFrame
    total: int
    distinct: int
    ranges: int
    shards: int
    most: int
    mu: float

    def _finish(self, encoded: DataFrame, asked: DataFrame, answers: DataFrame, parts: int) -> DataFrame:
        kept = encoded.select("batch", F.col("docs").alias("a"), F.col("tokens").alias("b"), "end").unionByName(asked.where("shard < 0").select("batch", "c", "d", "end"), allowMissingColumns=True)
        kept = kept.repartition(parts, "batch").groupBy("batch")
        answers = answers.where("of >= 0").repartition(parts, "of").groupBy("of")
        return kept.cogroup(answers).applyInPandas(_finish(self.shards, self.most, self.total, self.distinct, self.mu), SCORES_SQL)

    def score(self, docs: DataFrame, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
        """The columns of score() for the rows of other documents, from which nothing is learned; all are held out."""
        encoded = materialise(_rows(docs, F.lit(True)).mapInArrow(_encode(batch_tokens), ENCODED_SQL), "batches")
        parts = max(1, encoded.count())
        words = encoded.select("batch", "docs", "tokens", "words").mapInArrow(_vocabulary(self.ranges), VOCABULARY_SQL)
        words = words.groupBy("shard").cogroup(self.vocabulary.groupBy("shard")).applyInPandas(_look_up, WORDS_SQL)
        left = encoded.select("batch", "docs", "tokens", "end").repartition(parts, "batch").groupBy("batch")
        asked = materialise(left.cogroup(words.repartition(parts, "of").groupBy("of")).applyInPandas(_prepare(self.shards, self.most), PREPARED), "asked")
        answers = asked.where("shard >= 0").groupBy("shard").cogroup(self.levels.groupBy("shard")).applyInPandas(_answer_from, ANSWERS_SQL)
        return self._finish(encoded, asked, answers, parts)


def _rows(docs: DataFrame, held_out: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))


VOCABULARY_SQL = "shard int, batch long, words binary, counts binary"


def train(docs: DataFrame, held_out: Column, mu: float = MU, discount: float = DISCOUNT, batch_tokens: int = BATCH_TOKENS, shard_tokens: int = SHARD_TOKENS, keep: bool = True) -> tuple[Model, DataFrame]:
    """The model of the rows of `docs` that are not held out, stored in the shared folder if it is to be kept (some 0.9 times the size of
    compressed text), and the scores of all rows (see score())."""
    encoded = materialise(_rows(docs, held_out).mapInArrow(_encode(batch_tokens), ENCODED_SQL), "batches")
    size = encoded.agg(F.count("*").alias("batches"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("train"), F.lit(0)).alias("train")).first()
    shards, ranges, parts, total = ceil_div(size["n"], shard_tokens), ceil_div(size["n"], 4 * shard_tokens), max(1, size["batches"]), int(size["train"])
    most = max(1, shard_tokens // 4)
    words = encoded.select("batch", "docs", "tokens", "words").mapInArrow(_vocabulary(ranges), VOCABULARY_SQL)
    words = materialise(words.repartition(ranges, "shard").groupBy("shard").applyInPandas(_number(ranges), WORDS_SQL), "words")
    distinct = int(words.agg(F.coalesce(F.sum("seen"), F.lit(0))).first()[0])
    vocabulary = words.where("of < 0").select("shard", "totals", "ids", "hashes")
    vocabulary = materialise(vocabulary, "vocabulary") if keep else vocabulary
    left = encoded.select("batch", "docs", "tokens", "end").repartition(parts, "batch").groupBy("batch")
    known = words.where("of >= 0").select("of", "shard", "totals", "ids").repartition(parts, "of").groupBy("of")
    groups = max(1, min(GROUPS, shards // GROUP_SHARDS))
    part = F.when(F.col("shard") < 0, 0).otherwise(F.col("shard") % groups + 1)
    (kept, _), *questions = materialise_parts(left.cogroup(known).applyInPandas(_prepare(shards, most), PREPARED), part, groups + 1, "asked")
    drop(words)
    tidy(docs.sparkSession)
    answered = []
    for asked, at in questions:
        asked = asked.select("batch", "shard", "a", "b", "c", "d", "e", "f").repartition(ceil_div(shards, groups), "shard")
        answered.append(materialise(asked.groupBy("shard").applyInPandas(_answer(mu, discount, keep), ANSWERS_SQL), "answers"))
        delete(docs.sparkSession, at)
        del asked
        tidy(docs.sparkSession)
    answers = reduce(DataFrame.unionByName, answered)
    model = Model(vocabulary, answers.where("of < 0").select("shard", "codes"), total, distinct, ranges, shards, most, mu)
    return model, model._finish(encoded, kept, answers, parts)


def score(docs: DataFrame, held_out: Column, **options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row for each row of `docs` (doc_id, text and any more).

    The model learns from all rows that are not held out and scores all rows. Seen triples of tokens have their count less a discount,
    over that of their first two; what the discounts leave goes to the last two by their own probability, (pairs seen + mu *
    unigram) / (contexts seen + mu), whose unigram is that of the base. A text's first token follows an end. The tries hold the
    quantised parts: a triple's and a pair's probability, and what a pair leaves to the level below.

    Texts become numbers once, in batches. Counts of words meet by range of hash; pairs and triples meet in the shard of their first
    word, where the tries are built from those of training and answer each batch's. A word with very many occurrences has
    several shards. Batches, ranges and shards have a bounded size; there are more of them on more text, and a batch has a row for a shard
    only where it has a pair in it.

    - A null or empty text is one end. Without training rows every count is 0, base_score and score are 0.
    - A null doc_id stays null; repeated rows are scored each, and count each in training. An empty table gives no rows.
    - A very long text is one batch of its own, held whole in one task. Columns beside doc_id and text play no part.
    - Words are told apart by 64-bit hashes: two of a billion words share one with a chance of some 3 in 100. Counts have 64 bits."""
    return train(docs, held_out, keep=False, **options)[1]
