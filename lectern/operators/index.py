"""A stored index of token postings in segments: build, update by changed works, freshness, merge, validation, removal."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import text as t
from lectern.operators import passages
from lectern.sources import commits, shared

VERSION = 2


#: Rows of postings in a batch, characters of a text that are cut into words at a time, stems that a worker keeps, and chunks counted at a time.
BATCH, PART, STEMS, CHUNKS = 100_000, 1 << 20, 200_000, 500
_WORD, _RUN = re.compile("[0-9a-z]+"), re.compile(f"{t.CJK_TERM.pattern}+")
_stems: dict[str, str] = {}


def stem(word: str) -> str:
    """What functions.text.stem() makes of a word."""
    if len(word) > 4:
        if word.endswith("ies"):
            return word[:-3] + "y"
        if word.endswith(("sses", "ches", "shes")):
            return word[:-2]
        if word.endswith(("ing", "ers")):
            return word[:-3]
    return word[:-1] if len(word) > 3 and word.endswith("s") and not word.endswith(("ss", "us", "is")) else word


def _stem(word: str) -> str:
    found = _stems.get(word)
    if found is None:
        if len(_stems) >= STEMS:
            _stems.clear()
        found = _stems[word] = stem(word)
    return found


def token_counts(folded: str) -> Counter:
    """How often each of the tokens that functions.text.tokens() gives is in a folded text, which is cut at spaces if it is long."""
    words: Counter = Counter()
    at = 0
    while len(folded) - at > PART and (end := folded.find(" ", at + PART)) >= 0:
        words.update(_WORD.findall(folded, at, end))
        at = end
    words.update(_WORD.findall(folded, at))
    out: Counter = Counter()
    for word, n in words.items():
        if word not in _STOPS:
            out[word] += n
            if (root := _stem(word)) != word:
                out[root] += n
    if not folded.isascii():
        for run in _RUN.finditer(folded):
            out.update(c for c in run[0] if c not in t.CJK_STOP)
            out.update(map("".join, zip(run[0], run[0][1:], strict=False)))
    return out


_STOPS = frozenset(t.STOP_WORDS)


def postings(docs: DataFrame, fields: list[str], key: str = "doc_id") -> DataFrame:
    """key, field, token, tf, len: how often each token is in each field of a row, and how many tokens the field has. A work is one row: its
    tokens are counted where it is read, and nothing is shuffled. Texts are folded before they leave the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at: list[int] = []
            rows: tuple[list, list, list, list] = ([], [], [], [])

            def out() -> pa.RecordBatch:
                kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
                made = [b.column(key).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(rows, kinds, strict=True))]
                for c in (at, *rows):
                    c.clear()
                return pa.RecordBatch.from_arrays(made, [key, "field", "token", "tf", "len"])

            for f in fields:
                for k, text in enumerate(b.column(f"_{f}")):
                    counts = token_counts(text.as_py())
                    n, total = len(counts), sum(counts.values())
                    at += [k] * n
                    for column, values in zip(rows, ([f] * n, counts, counts.values(), [total] * n), strict=True):
                        column.extend(values)
                    if len(at) >= BATCH:
                        yield out()
            if at:
                yield out()

    schema = T.StructType([docs.schema[key], T.StructField("field", T.StringType()), T.StructField("token", T.StringType()), T.StructField("tf", T.LongType()), T.StructField("len", T.LongType())])
    return docs.select(key, *[t.fold(F.col(f)).alias(f"_{f}") for f in fields]).mapInArrow(run, schema)


def field_counts(docs: DataFrame, fields: list[str], tokens: frozenset[str] | None = None) -> DataFrame:
    """lens, token, tf0, tf1, ... (arrays) of each row: how many tokens each of its fields has, and how often each field has those of `tokens`
    (all, if none are given) that the row has. A work's fields stay side by side, and nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, CHUNKS) for whole in batches for at in range(0, whole.num_rows, CHUNKS)):
            lens, found, tfs = [], [], [[] for _ in fields]
            for texts in zip(*b.columns, strict=True):
                counts = [token_counts(x.as_py()) for x in texts]
                mine = [w for w in dict.fromkeys(chain.from_iterable(counts)) if tokens is None or w in tokens]
                lens.append([sum(c.values()) for c in counts])
                found.append(mine)
                for column, c in zip(tfs, counts, strict=True):
                    column.append([c.get(w, 0) for w in mine])
            numbers = [pa.array(c, pa.list_(pa.int64())) for c in (lens, *tfs)]
            yield pa.RecordBatch.from_arrays([numbers[0], pa.array(found, pa.list_(pa.string())), *numbers[1:]], names)

    names = ["lens", "token", *(f"tf{i}" for i in range(len(fields)))]
    schema = ", ".join(f"{c} array<{'string' if c == 'token' else 'long'}>" for c in names)
    return docs.select(*[t.fold(F.col(f)).alias(f"_{f}") for f in fields]).mapInArrow(run, schema)


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """doc_id, ordinal, text, len, tokens, tfs of chunks (doc_id, ordinal, text): each with its distinct tokens and how often it has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, CHUNKS) for whole in batches for at in range(0, whole.num_rows, CHUNKS)):
            counts = [token_counts(x.as_py()) for x in b.column("folded")]
            sums = pa.array([sum(c.values()) for c in counts], pa.int64())
            tokens, tfs = pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ordinal"), b.column("text"), sums, tokens, tfs], ["doc_id", "ordinal", "text", "len", "tokens", "tfs"])

    kept = [chunks.schema["doc_id"], chunks.schema["ordinal"], T.StructField("text", T.StringType()), T.StructField("len", T.LongType()), T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("tfs", T.ArrayType(T.LongType()))]
    return chunks.select("doc_id", "ordinal", "text", t.fold(F.col("text")).alias("folded")).mapInArrow(run, T.StructType(kept))


@dataclass
class Index:
    """Postings (doc_id, field, token, tf, len), and n and avg_len of each field; where passages are stored, their lengths (doc_id, ordinal, len,
    text) and postings (doc_id, ordinal, token, tf, len)."""

    postings: DataFrame
    stats: DataFrame
    chunks: DataFrame | None = None
    chunk_postings: DataFrame | None = None


#: Superseded rows of works, 16 bytes each, up to which their table is broadcast; beyond, the join shuffles. Segments up to which none are merged.
BROADCAST_DEAD, SEGMENTS = 500_000, 8


def digests(docs: DataFrame, fields: list[str], key: str = "doc_id") -> DataFrame:
    """doc_id, digest: what each work's indexed fields hash to."""
    return docs.select(F.col(key).alias("doc_id"), F.xxhash64(key, *fields).alias("digest"))


def _held(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, digest, alive, segment: the last that the index was told of each work."""
    last = F.max_by(F.struct("digest", "alive", "segment", "lens"), "segment").alias("w")
    return commits.read(spark, path, "works").groupBy("doc_id").agg(last).select("doc_id", "w.*")


def _about(spark: SparkSession, path: str):
    entries = commits.log(spark, path)
    return commits.read(spark, path, "about").first() if any("about" in e.tables for e in entries) else None


def freshness(docs: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """doc_id, state of each work that is in `docs` or in the index: FRESH, STALE (other contents), ABSENT (not indexed), GONE (not in docs)."""
    spark = docs.sparkSession
    about = _about(spark, path)
    now = digests(docs, about["fields"].split(","), key)
    then = _held(spark, path).where("alive").select(F.col("doc_id").alias("_doc"), F.col("digest").alias("was"))
    both = now.join(then, F.col("doc_id") == F.col("_doc"), "full")
    state = F.when(F.col("_doc").isNull(), "ABSENT").when(F.col("doc_id").isNull(), "GONE").when(F.col("digest") != F.col("was"), "STALE").otherwise("FRESH")
    return both.select(F.coalesce("doc_id", "_doc").alias("doc_id"), state.alias("state"))


def _segment(docs: DataFrame, fields: list[str], passages_of: str | None, key: str, number: int) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables of one segment, and doc_id, lens (tokens of each field) of its works."""
    # The range exchange samples its input, which is stored so that no text is read twice.
    posted = shared.keep(postings(docs, fields, key).withColumnRenamed(key, "doc_id"), "postings")
    lens = posted.select("doc_id", "field", "len").distinct().groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "len"))).alias("lens"))
    # A frequent token's postings are dealt out by works too, over as many files as they need.
    tables = {"postings": posted.withColumn("segment", F.lit(number)).repartitionByRange("field", "token", "doc_id").sortWithinPartitions("field", "token", "doc_id")}
    if passages_of:
        cut = passages.chunks(docs.select(F.col(key).alias("doc_id"), F.col(passages_of).alias("text")))
        # Sorted where they are cut: groups of rows tell a reader which works they have, and nothing is shuffled.
        counted = shared.keep(chunk_counts(cut).sortWithinPartitions("doc_id", "ordinal"), "chunk-counts").withColumn("segment", F.lit(number))
        tables["chunks"] = counted.select("doc_id", "ordinal", "len", "text", "segment")
        rows = counted.select("doc_id", "ordinal", "len", "segment", F.explode(F.arrays_zip("tokens", "tfs")).alias("x"))
        tables["chunk_postings"] = rows.select("doc_id", "ordinal", F.col("x.tokens").alias("token"), F.col("x.tfs").alias("tf"), "len", "segment")
    return tables, lens


def _statistics(live: DataFrame, fields: list[str]) -> DataFrame:
    """field, n, avg_len of each field over all live works (doc_id, lens); an empty field has 1."""
    total = [F.coalesce(F.sum(F.coalesce(F.try_element_at("lens", F.lit(f)), F.lit(0))), F.lit(0)).alias(f) for f in fields]
    sums = live.agg(F.count("*").alias("n"), *total)
    rows = F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col("n").alias("n"), F.col(f).alias("total")) for f in fields]))
    average = F.nullif(F.col("total") / F.greatest(F.col("n"), F.lit(1)), F.lit(0.0))
    return sums.select(rows).select("field", "n", F.coalesce(average, F.lit(1.0)).alias("avg_len"))


def update(docs: DataFrame, fields: list[str], path: str, key: str = "doc_id", passages_of: str | None = None) -> int:
    """Bring the index up to what `docs` is now; gives the number of works that were indexed or taken out.

    Only works whose fields hash to something else than before are read for their tokens: they make a segment of their own, and what
    the index had of them, and of works that are gone, is told dead. Postings, passages, states and statistics change in one commit.
    Beyond SEGMENTS segments all are merged. `fields` and `passages_of` have to be those that the index was made with."""
    spark = docs.sparkSession
    about = _about(spark, path)
    if about is not None and (about["version"], about["fields"], about["passages_of"]) != (VERSION, ",".join(fields), passages_of):
        raise ValueError(f"the index at {path} holds other fields; drop it first")
    now = digests(docs, fields, key)
    if about is None:
        number, changes, gone, dead = 0, shared.keep(now, "digests"), None, None
        changed = docs
        total = changes.count()
    else:
        number = about["segments"]
        was = _held(spark, path).where("alive").select(F.col("doc_id").alias("_doc"), F.col("digest").alias("was"), F.col("segment").alias("old"))
        both = now.join(was, F.col("doc_id") == F.col("_doc"), "full").where("doc_id IS NULL OR _doc IS NULL OR digest <> was")
        both = shared.keep(both, "changes")
        total = both.count()
        if not total:
            return 0
        changes = both.where("doc_id IS NOT NULL").select("doc_id", "digest")
        gone = both.where("doc_id IS NULL").select(F.col("_doc").alias("doc_id"))
        dead = both.where("_doc IS NOT NULL").select(F.col("_doc").alias("doc_id"), F.col("old").alias("segment"))
        changed = docs.join(changes.select(F.col("doc_id").alias("_doc")), F.col(key) == F.col("_doc"), "left_semi")
    tables, lens = _segment(changed, fields, passages_of, key, number)
    lens = lens.withColumnRenamed("doc_id", "_doc")
    none = F.lit(None).cast("map<string, bigint>")
    told = changes.join(lens, F.col("doc_id") == F.col("_doc"), "left").select("doc_id", "digest", F.lit(True).alias("alive"), F.lit(number).alias("segment"), "lens")
    if gone is not None:
        told = told.unionByName(gone.select("doc_id", F.lit(None).cast("long").alias("digest"), F.lit(False).alias("alive"), F.lit(number).alias("segment"), none.alias("lens")))
    told = shared.keep(told, "states")
    live = told.where("alive").select("doc_id", "lens")
    dead_now = 0
    if about is not None:
        left = _held(spark, path).where("alive").join(told.select(F.col("doc_id").alias("_doc")), F.col("doc_id") == F.col("_doc"), "left_anti")
        live = left.select("doc_id", "lens").unionByName(live)
        dead = shared.keep(commits.read(spark, path, "dead").unionByName(dead), "dead")
        dead_now = dead.count()
    else:
        dead = spark.createDataFrame([], "doc_id long, segment int")
    tables["works"] = told
    described = [(VERSION, ",".join(fields), passages_of, number + 1, dead_now, uuid.uuid4().hex)]
    facts = spark.createDataFrame(described, "version int, fields string, passages_of string, segments int, dead long, mark string").coalesce(1)
    replaces = {"stats": _statistics(live, fields).coalesce(1), "dead": dead.select("doc_id", F.col("segment").cast("int").alias("segment")), "about": facts}
    # Two updates at once read the same number of segments: the second one's commit is the first one's batch, and it is told so.
    if not commits.commit(path, "index", f"segment-{number}", adds=tables, replaces=replaces):
        raise RuntimeError(f"the index at {path} was changed by another update")
    if number + 1 > SEGMENTS:
        merge(spark, path)
    return total


def merge(spark: SparkSession, path: str) -> None:
    """Write all live rows as one segment, without those that are dead."""
    about, index = _about(spark, path), read(spark, path)
    number = about["segments"]
    live = _held(spark, path).where("alive")
    replaces = {"postings": index.postings.withColumn("segment", F.lit(number)).repartitionByRange("field", "token", "doc_id").sortWithinPartitions("field", "token", "doc_id")}
    if index.chunks is not None:
        replaces["chunks"] = index.chunks.withColumn("segment", F.lit(number)).repartition("doc_id").sortWithinPartitions("doc_id", "ordinal")
        replaces["chunk_postings"] = index.chunk_postings.withColumn("segment", F.lit(number)).repartition("doc_id").sortWithinPartitions("doc_id", "ordinal")
    replaces["works"] = live.select("doc_id", "digest", "alive", F.lit(number).alias("segment"), "lens")
    described = [(about["version"], about["fields"], about["passages_of"], number + 1, 0, uuid.uuid4().hex)]
    replaces["about"] = spark.createDataFrame(described, "version int, fields string, passages_of string, segments int, dead long, mark string").coalesce(1)
    replaces["dead"] = spark.createDataFrame([], "doc_id long, segment int")
    if not commits.commit(path, "index", f"merge-{number}", replaces=replaces):
        raise RuntimeError(f"the index at {path} was changed by another update")


def build(docs: DataFrame, fields: list[str], path: str, key: str = "doc_id", passages_of: str | None = None) -> Index:
    """Writes the index of `docs` to a new folder: postings sorted by field, token and work, so that a query reads the files and groups of rows of its
    own tokens; with `passages_of`, a field, also that text's chunks and their postings, sorted by work."""
    if shared.exists(docs.sparkSession, f"{path}/log"):
        raise ValueError(f"there is an index at {path}; drop it first")
    update(docs, fields, path, key, passages_of)
    return read(docs.sparkSession, path)


def read(spark: SparkSession, path: str) -> Index:
    """The index as of its last commit, without dead rows."""
    about = _about(spark, path)
    if about is None:
        raise ValueError(f"there is no index at {path}")
    dead = commits.read(spark, path, "dead").select(F.col("doc_id").alias("_doc"), F.col("segment").alias("_segment")) if about["dead"] else None

    def live(table: str) -> DataFrame:
        rows = commits.read(spark, path, table)
        if dead is not None:
            side = F.broadcast(dead) if about["dead"] <= BROADCAST_DEAD else dead
            rows = rows.join(side, (F.col("doc_id") == F.col("_doc")) & (F.col("segment") == F.col("_segment")), "left_anti")
        return rows.drop("segment")

    parts = [live("chunks"), live("chunk_postings")] if about["passages_of"] else []
    return Index(live("postings"), commits.read(spark, path, "stats"), *parts)


def status(docs: DataFrame, path: str, key: str = "doc_id") -> str:
    """FRESH, STALE (some work of other contents, new or gone), UNREADABLE (another version) or ABSENT."""
    about = _about(docs.sparkSession, path)
    if about is None:
        return "ABSENT"
    if about["version"] != VERSION:
        return "UNREADABLE"
    return "FRESH" if freshness(docs, path, key).where("state <> 'FRESH'").isEmpty() else "STALE"


def validate(spark: SparkSession, path: str) -> DataFrame:
    """check, ok: whether the stored tables agree with one another."""
    about, index = _about(spark, path), read(spark, path)
    r = index.postings.agg(F.count_if((F.col("tf") < 1) | (F.col("tf") > F.col("len"))).alias("odd"), F.count_distinct("field").alias("fields")).first()
    lens = index.postings.groupBy("doc_id", "field").agg(F.sum("tf").alias("sum"), F.max("len").alias("len")).where("sum <> len").isEmpty()
    works = index.postings.select("doc_id").distinct().join(_held(spark, path).where("alive").select(F.col("doc_id").alias("_doc")), F.col("doc_id") == F.col("_doc"), "left_anti").isEmpty()
    rows = [("postings", works), ("lengths", lens), ("counts", r["odd"] == 0), ("fields", index.stats.count() == len(about["fields"].split(",")) >= r["fields"])]
    return spark.createDataFrame(rows, "check string, ok boolean")


def rebuild(docs: DataFrame, fields: list[str], path: str, key: str = "doc_id", passages_of: str | None = None) -> Index:
    drop(docs.sparkSession, path)
    return build(docs, fields, path, key, passages_of)


def drop(spark: SparkSession, path: str) -> bool:
    return shared.delete(spark, path)


def fulltext(wanted: DataFrame, works: DataFrame, path: str) -> DataFrame:
    """doc_id, status, indexed, chunks, stale, extraction of each wanted work (doc_id): NOT_IN_LIBRARY, or FOUND with what the index at `path` has of its
    text now. works: doc_id and the indexed fields; those that a query names, not the whole catalog, are hashed."""
    spark = wanted.sparkSession
    about, index = _about(spark, path), read(spark, path)
    asked = wanted.select("doc_id").distinct()
    rows = works.join(asked.select(F.col("doc_id").alias("_doc")), F.col("doc_id") == F.col("_doc"), "left_semi")
    now = digests(rows, about["fields"].split(",")).select(F.col("doc_id").alias("_doc"), "digest")
    held = _held(spark, path).where("alive").select(F.col("doc_id").alias("_held"), F.col("digest").alias("was"))
    counts = index.chunks.join(asked, "doc_id", "left_semi").groupBy(F.col("doc_id").alias("_cut")).agg(F.count("*").alias("chunks"))
    out = asked.join(now, F.col("doc_id") == F.col("_doc"), "left").join(held, F.col("doc_id") == F.col("_held"), "left").join(counts, F.col("doc_id") == F.col("_cut"), "left")
    here, cut = F.col("_doc").isNotNull(), F.coalesce("chunks", F.lit(0))
    stale = F.when(here, F.coalesce(F.col("digest") != F.col("was"), F.lit(False)))
    extraction = F.when(here, F.when(F.col("_held").isNull(), "NOT_INDEXED").when(cut > 0, "EXTRACTED").otherwise("NO_TEXT"))
    return out.select("doc_id", F.when(here, "FOUND").otherwise("NOT_IN_LIBRARY").alias("status"), F.when(here, cut > 0).alias("indexed"), F.when(here, cut).alias("chunks"), stale.alias("stale"), extraction.alias("extraction"))


def may_build(attempts: DataFrame) -> DataFrame:
    """attempts, failed, refused of extraction outcomes (outcome): a build is refused if all attempts failed or more than half did.

    Missing files and formats that are not read are no attempts."""
    tried = attempts.where(~F.col("outcome").isin("FILE_MISSING", "UNSUPPORTED_FORMAT"))
    counts = tried.agg(F.count("*").alias("attempts"), F.count_if(F.col("outcome").isin("FAILED", "UNREADABLE")).alias("failed"))
    return counts.withColumn("refused", (F.col("attempts") > 0) & (2 * F.col("failed") > F.col("attempts")))
