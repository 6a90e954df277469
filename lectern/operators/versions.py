"""Versions of works: which to prefer, what is stale, what a new file is, and what changed between two states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lectern.functions import text as t
from lectern.sources import commits

# The rank of a version's role and of its format.
ROLE_RANK = {
    "CANONICAL_VERSION": 9, "PEERREVIEWEDJOURNALARTICLE": 8, "FINALPUBLICATION": 8, "PUBLISHERPDF": 7, "VERSIONOFRECORD": 7, "ACCEPTEDMANUSCRIPT": 5,
    "NETWORKFIRST": 4, "网络首发": 4, "HARNESS_DOWNLOAD": 3, "EXTERNAL_IMPORT": 2, "OTHER": 1, "FORMAT_VARIANT": 1, "UNKNOWN": 0,
}
FORMAT_RANK = {"PDF": 3, "CAJ": 2}
READABLE_FORMATS = ("PDF",)


def _rank(name: Column, table: dict[str, int]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.replace(F.upper(F.trim(name)), F.lit(" "), F.lit(""))), F.lit(0))


def preferred(versions: DataFrame, works: DataFrame | None = None) -> DataFrame:
    """doc_id, sha256, score, status of the best row of `versions` (doc_id, sha256, role, format, canonical, present) for each work.

    Best by 1000 if canonical, 100 a rank of role, 10 a rank of format, 1 if readable: there and of a format that machines read; ties by
    sha256. Works (doc_id) without versions have status NO_VERSION. One pass: no sort."""
    readable = F.coalesce(F.col("present") & F.upper(F.trim("format")).isin(*READABLE_FORMATS), F.lit(False))
    score = 1000 * F.coalesce("canonical", F.lit(False)).cast("int") + 100 * _rank(F.col("role"), ROLE_RANK) + 10 * _rank(F.col("format"), FORMAT_RANK) + readable.cast("int")
    best = versions.groupBy("doc_id").agg(F.min(F.struct((-score).alias("order"), "sha256")).alias("best"), F.bool_or("present").alias("any"), F.bool_or(readable).alias("legible"))
    if works is not None:
        best = works.select("doc_id").join(best, "doc_id", "left")
    status = F.when(F.col("best").isNull(), "NO_VERSION").when(F.col("legible"), "AVAILABLE").when(F.col("any"), "AVAILABLE_NOT_MACHINE_READABLE").otherwise("FILE_MISSING")
    return best.select("doc_id", "best.sha256", (-F.col("best.order")).alias("score"), status.alias("status"))


def freshness(catalog: DataFrame, index: DataFrame) -> DataFrame:
    """doc_id, state of every work in the catalog or the index (doc_id, sha256): FRESH, STALE, ABSENT from the index, or ORPHAN in it."""
    c, i = catalog.select("doc_id", F.col("sha256").alias("now")), index.select("doc_id", F.col("sha256").alias("then"))
    both = c.join(i, "doc_id", "full")
    state = F.when(F.col("then").isNull(), "ABSENT").when(F.col("now").isNull(), "ORPHAN").when(F.col("now") == F.col("then"), "FRESH").otherwise("STALE")
    return both.select("doc_id", state.alias("state"))


def dispositions(incoming: DataFrame, held: DataFrame) -> DataFrame:
    """item, disposition of each row of `incoming` (item, sha256, doi, title, year, author, signature, verified) against the works held
    (doc_id and sha256, doi, title, year, author).

    The first that applies: no title and no DOI, bytes of no known kind, an identity from outside that is not verified, the same file, another
    title under the same DOI, the same DOI, the same title with another DOI or another year and author, the same title, new.
    Hashes, DOIs and titles meet by equal joins against one row each: a title that very many works share is counted, not collected."""
    i = incoming.withColumns({"_doi": t.normalize_doi(F.col("doi")), "_title": t.normalize_title(F.col("title"))})
    h = held.withColumns({"_doi": t.normalize_doi(F.col("doi")), "_title": t.normalize_title(F.col("title"))})
    files = h.groupBy("sha256").agg(F.lit(True).alias("file"))
    dois = h.where("_doi IS NOT NULL").groupBy("_doi").agg(F.min("_title").alias("low"), F.max("_title").alias("high"))
    titles = h.where("_title IS NOT NULL")
    any_title = titles.groupBy("_title").agg(F.lit(True).alias("known"), F.bool_or(F.col("_doi").isNull()).alias("without"))
    years = titles.where("year IS NOT NULL").groupBy("_title", "year").agg(F.lit(True).alias("same_year"))
    authors = titles.where("author IS NOT NULL").groupBy("_title", "author").agg(F.lit(True).alias("same_author"))
    out = i.join(files, "sha256", "left").join(dois, "_doi", "left").join(any_title, "_title", "left").join(years, ["_title", "year"], "left").join(authors, ["_title", "author"], "left")
    same = F.coalesce("same_year", F.lit(False)) | F.coalesce("same_author", F.lit(False))
    clash = F.col("low").isNotNull() & F.col("_title").isNotNull() & (F.col("low") != F.col("_title")) & (F.col("high") != F.col("_title"))
    other_doi = F.col("_doi").isNotNull() & F.col("low").isNull() & F.col("known") & ~F.col("without")
    d = (
        F.when(F.col("_title").isNull() & F.col("_doi").isNull(), "INSUFFICIENT_IDENTITY").when(F.col("signature") == "PDF_BROKEN", "INVALID_PDF").when(F.col("signature") == "UNKNOWN", "INVALID_FULLTEXT").when(~F.col("verified"), "EXTERNAL_IDENTITY_UNVERIFIED")
        .when(F.col("file"), "EXACT_DUPLICATE").when(clash, "IDENTITY_CONFLICT").when(F.col("low").isNotNull() | (F.col("_doi").isNotNull() & F.col("high").isNotNull()), "SAME_WORK_DIFFERENT_VERSION")
        .when(F.coalesce(other_doi, F.lit(False)), "NEW_PAPER").when(F.col("known") & same, "SAME_WORK_DIFFERENT_VERSION").when(F.col("known"), "IDENTITY_CONFLICT").otherwise("NEW_PAPER")
    )
    return out.select("item", d.alias("disposition"))


def hash_conflicts(versions: DataFrame) -> DataFrame:
    """sha256, owners, first: files that more than one work owns, from versions (doc_id, sha256)."""
    owners = versions.groupBy("sha256").agg(F.count_distinct("doc_id").alias("owners"), F.min("doc_id").alias("first"))
    return owners.where("owners > 1")


def fingerprints(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """group, rows, digest: a digest of each group's rows that equal sets, in any order, share.

    A row counts by four 64-bit pieces of the SHA-256 of its canonical JSON, summed: sums meet wherever rows are, so that no task
    holds a group. The digest is the SHA-256 of the count and the four sums."""
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    piece = lambda k: F.conv(F.substring(row, 16 * k + 1, 15), 16, 10).cast("decimal(20,0)")
    sums = rows.groupBy(group).agg(F.count("*").alias("rows"), *[F.sum(piece(k)).alias(f"s{k}") for k in range(4)])
    return sums.select(group, "rows", F.sha2(F.concat_ws(",", "rows", *[F.col(f"s{k}").cast("string") for k in range(4)]), 256).alias("digest"))


def difference(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, field, before, after of every field that differs between two states; a row on one side only differs in all that it has."""
    fields = lambda df, name: df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias(name)) for c in columns])).alias("f")).select(key, "f.field", f"f.{name}")
    both = fields(before, "before").join(fields(after, "after"), [key, "field"], "full")
    return both.where(~F.col("before").eqNullSafe(F.col("after")))


def correct(works: DataFrame, corrections: DataFrame, key: str = "doc_id") -> DataFrame:
    """The works with the last correction (position, doc_id, title, year, author, journal; null: unchanged) of each applied, and whether one was.

    A correction that leaves a work without title, or changes title, year and author all at once, would make it another work: it is
    refused, and the last one that is not refused counts."""
    names = ["title", "year", "author", "journal"]
    sane = ~F.coalesce(F.trim("title") == "", F.lit(False)) & ~(F.col("title").isNotNull() & F.col("year").isNotNull() & F.col("author").isNotNull())
    last = corrections.where(sane).groupBy(key).agg(F.max_by(F.struct(*names), "position").alias("new"))
    out = works.join(last, key, "left")
    return out.select(key, *[F.coalesce(F.col(f"new.{c}"), F.col(c)).alias(c) for c in names], F.col("new").isNotNull().alias("corrected"))


CORRECTABLE = ("title", "authors", "year", "journal")


def correct_catalog(works: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(works, events): the works (paper_id, doi, title, authors: array, year, journal and any more) as corrections (position, paper_id, title, authors, year, journal,
    reason, evidence; null: as it was) leave them, and what became of each correction (position, paper_id, status, changed, before, after, reason, evidence).

    A correction never changes which work it is. With a DOI the id has to be the DOI's, whatever is corrected; without, a new title, year or
    author list has to leave the id made of title, year and first author as it is, and none of these may be missing: else it is
    IDENTITY_CHANGES or IDENTITY_INCOMPLETE. So what is accepted before decides nothing about what comes after, and of each field the last accepted
    value counts. One that names no field or no work is told as well."""
    mine = works.select(F.col("paper_id").alias("_id"), t.normalize_doi(F.col("doi")).alias("_doi"), *[F.col(c).alias(f"_{c}") for c in CORRECTABLE])
    rows = corrections.join(mine, F.col("paper_id") == F.col("_id"), "left")
    text = lambda c: F.nullif(F.nullif(F.trim(c), F.lit("")), F.lit("unknown"))
    people = F.filter(F.transform(F.coalesce("authors", "_authors"), lambda x: F.trim(x)), lambda x: x != "")
    title, year, first = text(F.coalesce("title", "_title")), text(F.coalesce("year", "_year")), F.get(people, F.lit(0))
    touched = F.col("title").isNotNull() | F.col("authors").isNotNull() | F.col("year").isNotNull()
    whole = t.normalize_title(title).isNotNull() & year.isNotNull() & t.normalize_title(first).isNotNull()
    none = F.lit(None).cast("string")
    status = (
        F.when(F.col("_id").isNull(), "WORK_NOT_FOUND").when(~touched & F.col("journal").isNull(), "NOTHING_TO_CHANGE").when(F.col("_doi").isNotNull(), F.when(t.paper_id(F.col("_doi"), none, none, none) == F.col("_id"), "APPLIED").otherwise("IDENTITY_CHANGES"))
        .when(~touched, "APPLIED").when(~F.coalesce(whole, F.lit(False)), "IDENTITY_INCOMPLETE").when(t.paper_id(none, title, year, first) == F.col("_id"), "APPLIED").otherwise("IDENTITY_CHANGES")
    )
    values = {"title": F.coalesce(text(F.col("title")), F.lit("unknown")), "authors": F.filter(F.transform("authors", lambda x: F.trim(x)), lambda x: x != ""), "year": F.coalesce(text(F.col("year")), F.lit("unknown")), "journal": F.coalesce(text(F.col("journal")), F.lit("unknown"))}
    rows = rows.withColumn("status", status).withColumns({f"_new_{c}": F.when(F.col(c).isNotNull(), v) for c, v in values.items()})
    state = lambda prefix: F.to_json(F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in CORRECTABLE]))
    changed = F.filter(F.array(*[F.when(F.col(c).isNotNull(), c) for c in CORRECTABLE]), lambda x: x.isNotNull())
    events = rows.select("position", "paper_id", "status", changed.alias("changed"), state("_").alias("before"), state("_new_").alias("after"), F.coalesce("reason", F.lit("bibliographic metadata cleanup")).alias("reason"), "evidence")
    done = rows.where("status = 'APPLIED'").groupBy(F.col("paper_id").alias("_id")).agg(*[F.max_by(f"_new_{c}", F.when(F.col(f"_new_{c}").isNotNull(), F.col("position"))).alias(f"_new_{c}") for c in CORRECTABLE])
    out = works.join(done, F.col("paper_id") == F.col("_id"), "left")
    return out.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in CORRECTABLE else F.col(c) for c in works.columns]), events


def commit_corrections(corrections: DataFrame, path: str, batch: str) -> bool:
    """Apply corrections to the table `works` below `path` and add their events to `corrections`, in one commit, so that no reader sees one without the
    other; false if the batch is in already. A commit in between makes it begin again on what that one left."""
    spark = corrections.sparkSession
    while not any(e.writer == "corrections" and e.batch.rpartition("@")[0] == batch for e in commits.log(spark, path)):
        version = max(e.version for e in commits.log(spark, path))
        works, events = correct_catalog(commits.read(spark, path, "works", version), corrections)
        if commits.commit(path, "corrections", f"{batch}@{version}", adds={"corrections": events}, replaces={"works": works}, at=version):
            return True
    return False


def first_wins(rows: DataFrame, key: str, position: str) -> DataFrame:
    """The first row of each key by position."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(position))).where("_n = 1").drop("_n")
