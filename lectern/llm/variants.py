"""Spelling variants: words one edit apart, found in blocks of shared prefixes and shared suffixes of the dictionary."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import drop, materialise, small

#: A run of letters, once A-Z are lower-case, and all of A-Z to their lower case.
RUN = re.compile("[a-zÀ-ÿ]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Words that a task counts before it passes the counts on, and characters of a text that are cut into runs at a time.
HELD_WORDS, PART = 200_000, 1 << 20
#: Members of a block that are compared with one another; a larger block is subdivided.
BLOCK = 128
#: Blocks that are subdivided in a round up to which their table, some 30 bytes a row, is broadcast; beyond, the join shuffles.
BROADCAST_BLOCKS = 200_000


def runs(text: str) -> Counter:
    """How often each lower-cased run of letters is in a text; a long text is cut into parts between runs."""
    lower = text.encode("utf-8", "surrogatepass").translate(LOWER).decode("utf-8", "surrogatepass")
    found: Counter = Counter()
    at = 0
    while len(lower) - at > PART:
        end = at + PART
        while end < len(lower) and RUN.match(lower, end):
            end += 1
        found.update(RUN.findall(lower, at, end))
        at = end
    found.update(RUN.findall(lower, at))
    return found


def miswritten(run: str, h: int, one_in: int) -> str:
    """The run without one letter if `one_in` divides h."""
    if h % one_in:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def dictionary(docs: DataFrame, one_in: int = 199, least_chars: int = 6, least_count: int = 5) -> DataFrame:
    """word, n: what the runs of letters of all texts come to, each counted over the whole table.

    Counts are summed in a task before they meet, so that a word that is in all texts sends a row a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                head = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in runs(text.as_py() or "").items():
                    word = miswritten(word, zlib.crc32(word.encode(), head), one_in)
                    if len(word) >= least_chars:
                        total[word] += n
                if len(total) >= HELD_WORDS:
                    yield out()
                    total.clear()
        yield out()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# A block is the words whose first `lo` and last `hi` letters are the same, in a class `m`: the length of the shorter word of the
# pairs it is to find. Words of m and of m + 1 letters are in it. Of the r = m - lo - hi letters between, one edit leaves the first
# r // 2 or the last r - r // 2 intact: these are the block's two parts. `path` says which half each step took.


def _block(path: Column, m: Column, lo: Column, hi: Column, word: Column) -> Column:
    """The name of a word's block: forward dictionary by its first letters, reversed dictionary by its last ones."""
    tail = F.when(hi > 0, F.substring(word, F.length(word) - hi + 1, hi)).otherwise("")
    return F.concat_ws("|", m.cast("string"), path, F.substring(word, F.lit(1), lo), tail)


def _halves(members: DataFrame) -> DataFrame:
    """The two parts of each member's block that it is in."""
    between = F.col("m") - F.col("lo") - F.col("hi")
    half = F.floor(between / 2).cast("int")
    steps = F.array(
        F.struct(F.concat("path", F.lit("P")).alias("path"), (F.col("lo") + half).alias("lo"), F.col("hi").alias("hi")),
        F.struct(F.concat("path", F.lit("S")).alias("path"), F.col("lo").alias("lo"), (F.col("hi") + between - half).alias("hi")),
    )
    parts = members.withColumn("step", F.explode(steps)).select("word", "n", "m", "step.path", "step.lo", "step.hi")
    return parts.withColumn("block", _block(F.col("path"), F.col("m"), F.col("lo"), F.col("hi"), F.col("word")))


def one_edit(a: str, b: str) -> bool:
    """Whether b is a with exactly one letter replaced, or one more."""
    if len(a) == len(b):
        for k, x in enumerate(a):
            if x != b[k]:
                return a[k + 1 :] == b[k + 1 :]
        return False
    for k, x in enumerate(a):
        if x != b[k]:
            return a[k:] == b[k + 1 :]
    return True


def taken(m: int, path: str) -> list[tuple[int, int]]:
    """The first halves, as (begin, end), that the block's steps passed over for the last ones."""
    lo, hi, out = 0, 0, []
    for side in path:
        half = (m - lo - hi) // 2
        if side == "P":
            lo += half
        else:
            out.append((lo, lo + half))
            hi += m - lo - hi - half
    return out


def pairs_of(block: str, words: list[str]) -> Iterator[tuple[int, int]]:
    """Places of the pairs of a block's words that are one edit apart and that no other block finds: where a step took the last half,
    the first one must have the edit."""
    head, path, *_ = block.split("|", 3)
    m = int(head)
    passed = taken(m, path)
    short = [k for k, w in enumerate(words) if len(w) == m]
    for x, k in enumerate(short):
        a = words[k]
        halves = [(p, q, a[p:q]) for p, q in passed]
        for j in (*short[x + 1 :], *(j for j, w in enumerate(words) if len(w) > m)):
            b = words[j]
            if all(b[p:q] != h for p, q, h in halves) and one_edit(a, b):
                yield k, j


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, word, n) in order of blocks to links (word, near, near_n), both ways; one block is held at a time."""

    def rows() -> Iterator[tuple[str, str, int]]:
        for b in batches:
            yield from zip(b.column("block").to_pylist(), b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True)

    found: list[tuple[str, str, int]] = []

    def out() -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], ["word", "near", "near_n"])

    for block, members in groupby(rows(), key=lambda r: r[0]):
        held = list(members)
        if len(held) > 1:
            words = [w for _, w, _ in held]
            for k, j in pairs_of(block, words):
                found += [(words[k], words[j], held[j][2]), (words[j], words[k], held[k][2])]
        if len(found) >= 100_000:
            yield out()
            found.clear()
    yield out()


def links(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, near, near_n: each pair of the stored `words` (word, n) that is one edit apart, once each way.

    Every word is in the blocks of its halves, as the shorter and as the longer of a pair. Blocks are counted first. Those with
    `block` members at most are scanned: sorted by block, each is a range of rows. A larger one never meets in one task: its members
    go on to its two parts, until a part has one letter between its shared ends, which few words of its lengths can differ in.
    Nothing is left out: an edit is in one half of whatever is subdivided."""
    length = F.length("word")
    both = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("m")).where(F.col("m") >= 1)
    start = both.select("word", "n", "m", F.lit("").alias("path"), F.lit(0).alias("lo"), F.lit(0).alias("hi"))
    members, stored, out = _halves(start), None, None
    while True:
        counts = members.groupBy("block", "m", "lo", "hi").agg(F.count("*").alias("size")).where(F.col("size") > block)
        # Between the ends of a block are r letters of the shorter word: with one at most it cannot be subdivided, and needs not be.
        large = materialise(counts.where(F.col("m") - F.col("lo") - F.col("hi") > 1).select(F.col("block").alias("_block")), "large-blocks")
        more = not large.isEmpty()
        if more:
            rest = members.join(small(large, BROADCAST_BLOCKS), F.col("block") == F.col("_block"), "left_anti")
        else:
            rest = members
        ordered = rest.select("block", "word", "n").repartition("block").sortWithinPartitions("block")
        found = materialise(ordered.mapInArrow(_scan, "word string, near string, near_n long"), "links")
        out = found if out is None else out.unionByName(found)
        if not more:
            if stored is not None:
                drop(stored)
            return out
        parts = members.join(small(large, BROADCAST_BLOCKS), F.col("block") == F.col("_block"), "left_semi")
        last, stored = stored, materialise(_halves(parts.drop("block")), "members")
        if last is not None:
            drop(last)
        members = stored


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where following forms from each word ends, for `forms` (word, form) without a circle; each round doubles the steps."""
    ways = materialise(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not ways.where("moved").isEmpty():
        then = ways.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        nearer = ways.join(then, F.col("root") == F.col("_word"), "left")
        last, ways = ways, materialise(nearer.select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), "roots")
        drop(last)
    return ways.select("word", "root")


def group(docs: DataFrame, one_in: int = 199, least_chars: int = 6, least_count: int = 5, times: int = 5, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n: the words of all texts, each with the much more frequent word that it may be a variant of.

    - Words are runs of letters (A-Z in lower case, U+00C0 to U+00FF as they are) of `least_chars` letters and `least_count` occurrences.
      Of the runs of a document one in `one_in`, chosen by a hash, is taken with a letter left out.
    - A word's form is its near word of most occurrences, of equal ones the first by code points, if it has `times` those of the
      word. Occurrences grow along forms, so these never lead back.
    - A null text has no runs; a null doc_id hashes as one without digits. Repeated rows count each. An empty table gives no rows.
    - A very long text is cut into runs part by part; a word may have any length. Other columns than doc_id and text play no part."""
    if times < 2 or least_chars < 1 or least_count < 1:
        raise ValueError("a form needs more occurrences than its variant, and words need a letter")
    words = materialise(dictionary(docs, one_in, least_chars, least_count), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near")))
    near = links(words, block).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    near = near.select(F.col("word").alias("_word"), "n_near", F.col("best.near").alias("near"), (-F.col("best.minus")).alias("near_n"))
    known = words.join(near, F.col("word") == F.col("_word"), "left")
    is_form = F.col("near_n") >= times * F.col("n")
    known = materialise(known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")), "forms")
    ends = roots(known.where("form IS NOT NULL")).select(F.col("word").alias("_word"), "root")
    return known.join(ends, F.col("word") == F.col("_word"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: DuckDB. CRC-32 from its polynomial; near words by what is left of both without a letter, the same one for a replaced letter.
ORACLE = r"""
WITH RECURSIVE steps AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM (SELECT i::BIGINT AS i FROM range(256) t(i))
), runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)
), counted AS (
  SELECT doc_id, run, COUNT(*) AS k, hex(encode(COALESCE(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS bytes FROM runs GROUP BY doc_id, run
), hashed AS (
  SELECT run, k, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(bytes) // 2 + 1), lambda i: CAST('0x' || bytes[2 * i - 1:2 * i] AS BIGINT))),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM counted, steps
), words AS (
  SELECT word, CAST(SUM(k) AS BIGINT) AS n
  FROM (SELECT k, CASE WHEN h % 199 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING SUM(k) >= 5
), cut AS (
  SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word
), placed AS (
  SELECT *, COUNT(*) OVER (PARTITION BY word) AS n_near, ROW_NUMBER() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM near
), forms AS (
  SELECT w.word, w.n, COALESCE(p.n_near, 0) AS n_near, CASE WHEN p.near_n >= 5 * w.n THEN p.near END AS form, CASE WHEN p.near_n >= 5 * w.n THEN p.near_n END AS form_n
  FROM words w LEFT JOIN placed p ON p.word = w.word AND p.place = 1
), ways AS (
  SELECT word, word AS at FROM forms
  UNION ALL SELECT ways.word, f.form FROM ways JOIN forms f ON f.word = ways.at WHERE f.form IS NOT NULL
), ends AS (
  SELECT ways.word, ways.at AS root FROM ways JOIN forms f ON f.word = ways.at WHERE f.form IS NULL
)
SELECT f.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM forms f JOIN ends e ON e.word = f.word
"""
