"""SimHash near-duplicates: fingerprints, tiled exact comparison, components."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from lectern.llm.common import ceil_div, free_names, materialise, materialise_counted, small

#: Fingerprints of a tile, at least and at most: tiles grow with the table, so that fewer pairs of them are sent around.
TILE, LARGEST_TILE = 8192, 65536
#: Links that a task holds before it shortens them to a forest.
HELD_LINKS = 1_000_000
#: Classes, some 40 bytes each, up to which their table is broadcast; beyond, the join shuffles and AQE may split a large class.
BROADCAST_CLASSES = 200_000


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each run of `shingle` words (A-Z lowered) in turn, repeats included; one run for a shorter text, none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, "<u8")
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    ends = (ends - 1).tolist()[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends, strict=False)], dtype="<u8")


#: For each byte the number whose bytes are its bits: sums of up to 255 of them count eight bits at once.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8).reshape(-1, 1), axis=1, bitorder="little").view("<u8").ravel()


def majority(h: np.ndarray) -> np.ndarray:
    """The numbers whose bits are set where over half of the hashes of their row of h have them set; 0 for none."""
    words, n = h.shape
    ones = np.zeros((words, 64), dtype=np.int64)
    for at in range(0, n, 255 * 32):  # a very long text in bounded memory
        part = _SPREAD[np.ascontiguousarray(h[:, at : at + 255 * 32]).view(np.uint8)].reshape(words, -1, 8)
        for k in range(0, part.shape[1], 255):
            ones += part[:, k : k + 255].sum(axis=1).view(np.uint8).reshape(words, 64)
    return np.packbits(ones * 2 > n, axis=1, bitorder="little").view("<u8").ravel()


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of the words (A-Z lowered), as an unsigned number; 0 for a text without words."""
    return int(majority(shingle_hashes(text, shingle)[None])[0])


def text_fingerprint(text: Column, shingle: int = 3) -> Column:
    """The fingerprint of a text column, its 64 bits as a signed long; a null text counts as an empty one."""

    @F.arrow_udf(T.LongType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), dtype="<u8", count=len(texts)).view("<i8"))

    return run(text.cast("string"))


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of all a[i], b[j] at `radius` differing bits or fewer, some rows of a at a time."""
    step = max(1, (1 << 17) // max(1, len(b)))  # a MB of differences at a time stays in cache
    shape = (min(step, len(a)), len(b))
    differ, bits, near = np.empty(shape, np.uint64), np.empty(shape, np.uint8), np.empty(shape, bool)
    for at in range(0, len(a), step):
        n = min(step, len(a) - at)
        np.bitwise_xor(a[at : at + n, None], b, out=differ[:n])
        np.bitwise_count(differ[:n], out=bits[:n])
        np.less_equal(bits[:n], radius, out=near[:n])
        found = np.flatnonzero(near[:n].ravel())
        if len(found):
            i, j = np.divmod(found, len(b))
            yield i + at, j


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest connected position of each of n positions under the links (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _compare_tiles(radius: int, words: int, whole, similarity: float):
    """Rows of one or two tiles to links (a, b) between keys: a forest of the pairs within the radii (whole: that of all bits, by the larger size)."""
    width = words + 2 if similarity else 1

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tiles = [np.frombuffer(x, dtype="<u8").reshape(width, -1) for x in pdf.sort_values("side")["rows"]]
        a, b = tiles[0], tiles[-1]
        n, own = a.shape[1], len(tiles) == 1
        nodes = a[0] if own else np.concatenate([a[0], b[0]])
        held, count = [], 0
        label = np.arange(len(nodes))

        def shorten() -> np.ndarray:
            # Links that follow from others are left out: a forest connects the same rows and is no longer than the tiles.
            i, j = (np.concatenate(x) for x in zip(*held, (np.arange(len(nodes)), label), strict=True))
            held.clear()
            return forest(i, j, len(nodes))

        first = 2 if similarity else 0
        for i, j in close_pairs(a[first], b[first], radius):
            if own:
                up = i < j
                i, j = i[up], j[up]
            if similarity:
                bits = sum(np.bitwise_count(a[k][i] ^ b[k][j]).astype(np.int32) for k in range(2, width))
                low, high = np.minimum(a[1][i], b[1][j]), np.maximum(a[1][i], b[1][j])
                both = (bits <= whole(high)) & (low >= similarity * high - 1e-6)
                i, j = i[both], j[both]
            held.append((i, j if own else j + n))
            count += len(i)
            if count > HELD_LINKS:
                label, count = shorten(), 0
        root = shorten()
        at = np.flatnonzero(root != np.arange(len(nodes)))
        return pd.DataFrame({"a": nodes[at].view("<i8"), "b": nodes[root[at]].view("<i8")})

    return run


def _pack(columns: list[str]):
    """Lists of equal length to one binary: the columns after each other, 8 bytes a value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, blobs = b.column("list"), []
            for k in range(b.num_rows):
                rows = lists.slice(k, 1).flatten()
                matrix = np.stack([rows.field(c).to_numpy(zero_copy_only=False).astype("<i8") for c in range(len(columns))])
                blobs.append(matrix[:, np.argsort(matrix[0], kind="stable")].tobytes())
            yield pa.RecordBatch.from_arrays([b.column("tile"), b.column("ranges"), pa.array(blobs, pa.binary())], ["tile", "ranges", "rows"])

    return run


def partner_ranges(tiles: list[list[int]], radius: int) -> list[list[tuple[int, int]]]:
    """Ranges (first, last) of the tiles that each tile meets, of tiles (band, lowest and highest bit count) in order of bands and counts: in its
    own band and those beside it, counts grow from tile to tile, so that the ones within the radius stand together."""
    bands: dict[int, list[int]] = defaultdict(list)
    for k, (b, *_) in enumerate(tiles):
        bands[b].append(k)
    bounds = {b: ([tiles[k][1] for k in own], [tiles[k][2] for k in own]) for b, own in bands.items()}
    out = []
    for b, low, high in tiles:
        mine = []
        for near in (b - 1, b, b + 1):
            if near in bands:
                lows, highs = bounds[near]
                first, last = bisect_left(highs, low - radius), bisect_right(lows, high + radius) - 1
                if first <= last:
                    mine.append((bands[near][first], bands[near][last]))
        out.append(mine)
    return out


def tile_links(rows: DataFrame, columns: list[str], word: str, radius: int, whole=None, similarity: float = 0.0, tile: int = TILE, largest: int = LARGEST_TILE) -> DataFrame:
    """Links (a, b) between the values of the first of `columns`, which connect them exactly as all pairs within the radii do.

    Rows (distinct in that column) are dealt over tiles by the number of set bits in column `word`, and, if a similarity of sets is
    asked for, by the size of their set. Two tiles meet only if some of their bit counts differ by the radius at most, since fewer differing
    bits are then impossible, and some of their sizes allow the similarity. The driver sees one count for each pair of bit
    count and magnitude of size, a few thousand at most, and three ranges of partners for each tile; executors make the pairs of tiles."""
    spark = rows.sparkSession
    step = 1 / similarity if similarity else 2.0
    band = F.floor(F.log(F.col("size").cast("double")) / F.lit(float(np.log(step)))).cast("int") if similarity else F.lit(0)
    rows = materialise(rows.select(*columns, F.bit_count(word).cast("int").alias("_pc"), F.coalesce(band, F.lit(-1)).alias("_band")), "fingerprints")
    counts = sorted((r["_band"], r["_pc"], r["n"]) for r in rows.groupBy("_band", "_pc").agg(F.count("*").alias("n")).collect())
    tile = max(tile, min(largest, tile * (sum(n for *_, n in counts) // (64 * tile))))
    # A tile is a range of bit counts of one band; a count with more rows than a tile has several tiles.
    tiles: list[list[int]] = []  # band, lowest and highest bit count
    place = []  # band, bit count, first tile, tiles
    filled = tile
    for b, pc, n in counts:
        if tiles and tiles[-1][0] == b and filled + n <= tile:
            tiles[-1][2], filled = pc, filled + n
            place.append((b, pc, len(tiles) - 1, 1))
        else:
            parts, filled = ceil_div(n, tile), n
            place.append((b, pc, len(tiles), parts))
            tiles += [[b, pc, pc] for _ in range(parts)]
            filled = tile if parts > 1 else n
    ranges = partner_ranges(tiles, radius)
    at = spark.createDataFrame([(b, pc, first, parts) for b, pc, first, parts in place], "_b int, _c int, first int, parts int")
    with_ranges = spark.createDataFrame(list(enumerate(ranges)), "_tile int, ranges array<struct<first:int,last:int>>")
    dealt = rows.join(F.broadcast(at), (F.col("_band") == F.col("_b")) & (F.col("_pc") == F.col("_c")))  # a few thousand rows at most
    dealt = dealt.select(*columns, (F.col("first") + F.pmod(F.xxhash64(columns[0]), F.col("parts"))).cast("int").alias("tile"))
    packed = dealt.groupBy("tile").agg(F.collect_list(F.struct(*columns)).alias("list"))
    with_ranges = F.broadcast(with_ranges) if len(tiles) <= 100_000 else with_ranges  # some 50 bytes each
    packed = packed.join(with_ranges, F.col("tile") == F.col("_tile")).select("tile", "ranges", "list")
    packed = materialise(packed.mapInArrow(_pack(columns), "tile int, ranges array<struct<first:int,last:int>>, rows binary"), "tiles")
    # Each tile goes to the pairs in which it is the smaller number (side 0) and those in which it is the larger (side 1).
    partners = F.flatten(F.transform("ranges", lambda r: F.sequence(r["first"], r["last"])))
    met = packed.select("rows", "tile", F.explode(partners).alias("other"))
    pairs = met.select("rows", (F.col("tile") > F.col("other")).cast("int").alias("side"), F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))
    parts = max(1, min(ceil_div(sum(z - a + 1 for r in ranges for a, z in r), 4), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    words = len(columns) - 2
    return pairs.repartition(parts, "i", "j").groupBy("i", "j").applyInPandas(_compare_tiles(radius, words, whole, similarity), "a long, b long")


def fingerprint_links(fps: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints of column `fp` exactly as all pairs within the radius do."""
    return tile_links(fps.select("fp").distinct(), ["fp"], "fp", radius, tile=tile)


def connect(links: DataFrame, node: str = "node", root: str = "root", rounds: int = 60) -> DataFrame:
    """Connected components: every node of the links (a, b) with the smallest node it reaches.

    Smallest labels travel along links and jump along labels until none changes; each round is written to the shared
    folder. Keys with very many links meet as partial minima first, and their joins are ones that AQE may split."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialise(both, "links")
    label = materialise(both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.col("n")).alias("l")), "labels")
    for _ in range(rounds):
        seen = both.join(label, F.col("b") == F.col("n")).groupBy("a").agg(F.min("l").alias("m"))
        hooked = label.join(seen, F.col("n") == F.col("a")).select("n", "l", F.least("l", "m").alias("x"))
        up = label.select(F.col("n").alias("un"), F.col("l").alias("ul"))
        jumped = hooked.join(up, F.col("x") == F.col("un")).select("n", F.least("x", "ul").alias("l"), (F.least("x", "ul") != F.col("l")).alias("moved"))
        done, moved = materialise_counted(jumped, F.col("moved"), "labels")
        label = done.select("n", "l")
        if not moved:
            return label.select(F.col("n").alias(node), F.col("l").alias(root))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, tile: int = TILE) -> DataFrame:
    """Near-duplicate classes of `docs` (doc_id, text and any more): doc_id, text_key, fp, root, component_id, one row for each row.

    - A null or empty text has fingerprint 0 and links like any other; copies share a fingerprint and need no link.
    - component_id is the smallest doc_id reachable over links of `radius` differing bits or fewer; root is a fingerprint that
      stands for the class, text_key the text's hash.
    - A null doc_id is kept, is never the smallest while its component has another, and component_id is null where all are null.
    - A very long text is read whole, in one task, some thousands of its shingles at a time.
    - An empty table gives an empty result; repeated rows give repeated rows."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    fps = materialise(docs.select("doc_id", F.xxhash64(text).alias("text_key"), text_fingerprint(F.col("text"), shingle).alias("fp")), "doc-fingerprints")
    roots = connect(fingerprint_links(fps, radius, tile), "node", "root")
    smallest = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "smallest")
    # A class of very many fingerprints is one row of each part of the table before it is joined.
    lowest = roots.join(smallest, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("low").alias("lowest")).withColumnRenamed("root", "_root")
    linked = roots.join(small(materialise(lowest, "lowest"), BROADCAST_CLASSES), F.col("root") == F.col("_root")).select("node", "root", "lowest")
    classes = smallest.join(linked, F.col("fp") == F.col("node"), "left").where("n > 1 OR node IS NOT NULL")
    classes = materialise(classes.select(F.col("fp").alias("_fp"), F.coalesce("root", "fp").alias("_class"), F.coalesce("lowest", "low").alias("_low")), "classes")
    # The others are classes of one row.
    placed = fps.join(small(classes, BROADCAST_CLASSES), F.col("fp") == F.col("_fp"), "left")
    own = F.when(F.col("_fp").isNull(), F.col("doc_id")).otherwise(F.col("_low"))
    return placed.select("doc_id", "text_key", "fp", F.coalesce("_class", "fp").alias("root"), own.alias("component_id"))


def fingerprint_hex(fp="fp"):
    """The 16 lower-case hexadecimal digits of a fingerprint held as a long."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


#: Rows to remove, some 50 bytes each, up to which their keys are broadcast; beyond, the join shuffles.
BROADCAST_REMOVED = 1_000_000


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """The documents without near copies: one row of each class stays, with all its columns.

    It is that of the smallest doc_id, rows without doc_id last; of several texts under one doc_id that of the smallest hash; of
    rows that repeat doc_id and text any one."""
    return keep_first(docs, materialise(near_duplicates(docs, shingle, radius).select("doc_id", "text_key", "root"), "members"))


def keep_first(docs: DataFrame, members: DataFrame) -> DataFrame:
    """The rows of docs that stay when each root of `members` (doc_id, text_key, root; one row for each of docs) keeps its first.

    Columns of docs may have any names."""
    rank = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_key")
    first = members.groupBy("root").agg(F.min(rank).alias("first"), F.count("*").alias("n"))
    first = materialise(first.where("n > 1").select(F.col("root").alias("_root"), "first"), "firsts")
    # A row that is alone in its class stays; the others are told from their class's first, of which there are far fewer than rows.
    ranked = members.join(small(first, BROADCAST_CLASSES), F.col("root") == F.col("_root")).select("doc_id", "text_key", (rank == F.col("first")).alias("stays"))
    rows = materialise(ranked.groupBy("doc_id", "text_key", "stays").agg(F.count("*").alias("n")), "decisions")
    doc, key, row = free_names(docs, "doc", "key", "row")
    removed = small(rows.where("NOT stays").select(F.col("doc_id").alias(doc), F.col("text_key").alias(key)), BROADCAST_REMOVED)
    hashed = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    kept = docs.join(removed, docs["doc_id"].eqNullSafe(F.col(doc)) & (hashed == F.col(key)), "left_anti")
    if not rows.where("stays AND n > 1").limit(1).count():
        return kept  # the usual case: texts are not sorted for the sake of rows that repeat
    order = W.partitionBy("doc_id", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))).orderBy(F.lit(0))
    return kept.withColumn(row, F.row_number().over(order)).where(F.col(row) == 1).drop(row)
