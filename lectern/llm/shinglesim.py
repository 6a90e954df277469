"""Near copies by the similarity of their word shingles: SimHash tiles propose them, exact similarity decides, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import materialise, small
from lectern.llm.simhash import BROADCAST_CLASSES, BROADCAST_REMOVED, connect, keep_first, majority, shingle_hashes, tile_links

#: Words of 64 bits of a fingerprint, how many of them the tiles hold, and the differing bits up to which two may be alike: of the
#: first word, of those of a tile, and of all. Sets of similarity 0.8 differ in 155 of 1024 bits, 11 more or less by chance; in 39 of the
#: first 256, 6 more or less; and in 10 of the first 64; unlike sets in a half of them. Of small sets, whose bits depend on few shingles, more differ.
FINGERPRINT_WORDS, TILE_WORDS = 16, 4
FIRST_RADIUS, TILE_RADIUS, WHOLE_RADIUS = 22, 60, 192
SMALL_SET, SMALL_TILE_RADIUS, SMALL_RADIUS = 24, 84, 288
#: By how much the pivots of a component of candidates grow from round to round.
GROWTH = 8
WORDS = [f"w{k}" for k in range(FINGERPRINT_WORDS)]


def shingles(text: str | None, shingle: int = 5) -> np.ndarray:
    """The distinct hashes of a text's runs of `shingle` words (A-Z lowered), in order; one run for a shorter text, none without words."""
    return np.unique(shingle_hashes(text, shingle))


def remixed(h: np.ndarray, k: int) -> np.ndarray:
    """Other hashes of the same shingles, for word k of a fingerprint (word 0 has the hashes themselves)."""
    if not k:
        return h
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
    return h ^ (h >> np.uint64(29))


def tile_radius(size: np.ndarray) -> np.ndarray:
    """Differing bits of a tile's words up to which two sets may be alike, by the size of the larger."""
    return np.where(size <= SMALL_SET, SMALL_TILE_RADIUS, TILE_RADIUS)


def set_key(h: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(h.tobytes(), 7)


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text_key, set_key (hash of the shingle set), size (of the set) and the words w0.. of its fingerprint, for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.zeros((2 + FINGERPRINT_WORDS, b.num_rows), dtype="<u8")
            for k, text in enumerate(b.column("text")):
                h = shingles(text.as_py(), shingle)
                rows[:2, k] = set_key(h), len(h)
                rows[2:, k] = majority(np.stack([remixed(h, w) for w in range(FINGERPRINT_WORDS)]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), *(pa.array(r.view("<i8")) for r in rows)], ["doc_id", "text_key", "set_key", "size", *WORDS])

    longs = [T.StructField(c, T.LongType()) for c in ("text_key", "set_key", "size", *WORDS)]
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *longs])
    return docs.select("doc_id", text_hash(F.col("text")).alias("text_key"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def candidate_sets(docs: DataFrame, sketched: DataFrame, keys: DataFrame, shingle: int) -> DataFrame:
    """key and set (array of hashes), one row for each of `keys` (key)."""
    rank = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_key")
    wanted = sketched.join(small(keys, BROADCAST_REMOVED), F.col("set_key") == F.col("key"), "left_semi").groupBy("set_key").agg(F.min(rank).alias("r"))
    wanted = materialise(wanted.select(F.col("r.doc_id").alias("_doc"), F.col("r.text_key").alias("_key")), "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py(), shingle) for t in b.column("text")]
            keys = np.array([set_key(s) for s in sets], dtype="<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([s.view("<i8") for s in sets], pa.list_(pa.int64()))], ["key", "set"])

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    texts = texts.join(small(wanted, BROADCAST_REMOVED), F.col("doc_id").eqNullSafe(F.col("_doc")) & (text_hash(F.col("text")) == F.col("_key")), "left_semi")
    sets = materialise(texts.select("text").mapInArrow(run, "key long, set array<long>"), "sets")
    # Rows that repeat doc_id and text come several times; usually there are none.
    return sets if sets.count() == wanted.count() else materialise(sets.dropDuplicates(["key"]), "sets")


def similar_classes(docs: DataFrame, sketched: DataFrame, similarity: float, shingle: int, **tiles) -> DataFrame:
    """node, root: the components of the sets of `sketched` under the links of `similarity` or more.

    Pairs of fingerprints within the radii and of sizes that allow the similarity are candidates; tiles of fingerprints tell the
    components that candidates make. Candidates of a component are then compared exactly in rounds: its smallest set against
    all, then growing numbers of pivots (its next smallest keys; keys are hashes) against all larger. A pair already in one class
    is not compared, so a large group of near copies costs its size; a component is done when its sets that were no pivots are of
    one class. No candidate is left out otherwise."""
    distinct = materialise(sketched.groupBy("set_key").agg(*(F.first(c).alias(c) for c in ("size", *WORDS))), "distinct-sets")
    close = connect(tile_links(distinct, ["set_key", "size", *WORDS[:TILE_WORDS]], "w0", FIRST_RADIUS, tile_radius, similarity, **tiles), "node", "bucket")
    spread = materialise(distinct.join(close, F.col("set_key") == F.col("node")).select(F.col("set_key").alias("key"), "size", *WORDS, "bucket"), "candidates")
    full = materialise(spread.groupBy("bucket").agg(F.count("*").alias("n"), F.min("key").alias("first")).withColumnRenamed("bucket", "_bucket"), "components")
    members = materialise(spread.join(small(full, BROADCAST_CLASSES), F.col("bucket") == F.col("_bucket")).drop("_bucket"), "members")
    sets = candidate_sets(docs, sketched, members.select("key"), shingle)
    # The place of a key among all keys, 0 to 1: keys under p/n are about p of the n keys of a component.
    place = (F.col("key") / F.lit(2.0**64) + 0.5) * F.col("n")
    links = roots = None
    pivots = 0
    while True:
        rooted = members.withColumn("root", F.col("key"))
        if roots is not None:
            rooted = members.join(roots, F.col("key") == F.col("node"), "left").select(*members.columns, F.coalesce("root", "key").alias("root"))
            rest = (F.col("key") != F.col("first")) & (place >= pivots)
            # A component is open while the sets that were no pivots are of several classes.
            still = rooted.where(rest).groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a != b")
            still = small(materialise(still.select(F.col("bucket").alias("_bucket")), "open"), BROADCAST_CLASSES)
            rooted = materialise(rooted.where(rest).join(still, F.col("bucket") == F.col("_bucket"), "left_semi"), "rest")
            if not rooted.limit(1).count():
                return roots
        pivots = pivots * GROWTH if pivots else (GROWTH if roots is not None else 0)
        chosen = (F.col("key") == F.col("first")) if roots is None else (place < pivots)
        pivot = rooted.where(chosen).select(F.col("bucket").alias("_bucket"), F.col("key").alias("a"), F.col("size").alias("a_size"), F.col("root").alias("a_root"), *(F.col(w).alias(f"a_{w}") for w in WORDS))
        pivot = small(materialise(pivot, "pivots"), BROADCAST_CLASSES)
        differ = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"a_{w}"))) for w in WORDS), F.lit(0))
        alike = (F.least("a_size", "size") >= similarity * F.greatest("a_size", "size") - 1e-6) & (F.col("a") < F.col("key")) & (F.col("a_root") != F.col("root"))
        alike &= (F.bit_count(F.col("w0").bitwiseXOR(F.col("a_w0"))) <= FIRST_RADIUS) & (differ <= F.when(F.greatest("a_size", "size") <= SMALL_SET, SMALL_RADIUS).otherwise(WHOLE_RADIUS))
        pairs = materialise(rooted.join(pivot, (F.col("bucket") == F.col("_bucket")) & alike).select("a", F.col("key").alias("b")), "pairs")
        left = sets.select(F.col("key").alias("a"), F.col("set").alias("a_set"))
        right = sets.select(F.col("key").alias("b"), F.col("set").alias("b_set"))
        both = pairs.join(right, "b").join(left, "a").withColumn("common", F.size(F.array_intersect("a_set", "b_set")))
        found = both.where(F.col("common") / (F.size("a_set") + F.size("b_set") - F.col("common")) >= similarity).select("a", "b")
        found = materialise(found, "similar")
        links = found if links is None else links.unionByName(found)
        roots = connect(links, "node", "root")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, **tiles) -> DataFrame:
    """The documents without near copies: one row of each class stays, with all its columns, as simhash.keep_one chooses it.

    A class is a component under links between texts whose sets of `shingle`-word shingles have a Jaccard similarity of
    `similarity` or more; texts without words are one class. The tiled comparison of SimHash fingerprints, 256 bits of 1024, proposes pairs; those within the radius
    of all bits that could still join two classes are verified. A pair of similarity 0.8 is proposed with a chance of 0.999 and more, a closer
    one more surely. The radii hold for similarities from 0.8 on.

    - A null text is an empty one; null ids, repeated rows, columns of any names and an empty table are as in simhash.keep_one.
    - A very long text is read whole, in one task. 64-bit hashes stand for shingles and for sets of them."""
    if similarity < 0.8:
        raise ValueError("the fingerprints' radii hold for similarities of 0.8 and more")
    sketched = materialise(sketches(docs, shingle), "sketches")
    roots = similar_classes(docs, sketched, similarity, shingle, **tiles)
    members = sketched.join(roots, F.col("set_key") == F.col("node"), "left").select("doc_id", "text_key", F.coalesce("root", "set_key").alias("root"))
    return keep_first(docs, materialise(members, "members"))
