"""Catalogs and ledgers in files: tolerant and strict readers, staged and append-only writers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window as W


def read_tolerant(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, bad): the rows of a JSON Lines file and the lines that are not rows of the schema, with their file."""
    wide = StructType([*schema.fields, StructField("_bad", StringType())])
    line = F.regexp_replace("value", "^\ufeff", "")
    lines = spark.read.text(path).where(F.trim(line) != "").select(F.col("_metadata.file_path").alias("file"), line.alias("line"))
    parsed = lines.withColumn("row", F.from_json("line", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    good = F.col("row").isNotNull() & F.col("row._bad").isNull()
    return parsed.where(good).select("row.*").drop("_bad"), parsed.where(~good).select("file", "line")


def read_strict(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of a JSON Lines file; a line that is not one fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


#: What the rows of each kind of ledger have to have, and of them what may not be empty.
LEDGERS = {
    "fetches": ("record_type string, source string, identifier string, paper_id string, ok boolean, detail string, timestamp string", ("record_type", "source", "identifier", "timestamp")),
    "searches": ("source string, query string, timestamp string", ("source", "timestamp")),
    "batches": ("item string, outcome string, reason string, timestamp string", ("item", "outcome", "timestamp")),
    "assignments": ("paper_id string, topics array<string>, assignment_source string, timestamp string", ("paper_id", "assignment_source", "timestamp")),
}
#: A time with its zone: one without says nothing.
ZONED = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"


def read_ledger(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The rows of a ledger with ts, its time in UTC; the job fails at a line that is no row, has an empty field that it needs, or a time without zone."""
    schema, needed = LEDGERS[kind]
    rows = read_strict(spark, path, StructType.fromDDL(schema))
    whole = F.coalesce(F.col("timestamp").rlike(ZONED), F.lit(False))
    for c in needed:
        whole = whole & (F.trim(F.coalesce(c, F.lit(""))) != "")
    fault = F.raise_error(F.concat(F.lit(f"a row of the ledger of {kind} is not whole: "), F.to_json(F.struct(*rows.columns))))
    return rows.withColumn("ts", F.when(whole, F.try_to_timestamp("timestamp")).otherwise(fault.cast("timestamp")))


def read_provenance(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(rows, malformed): the assignments that can be read, with the last of each paper_id marked `latest`, and how many lines cannot."""
    schema, needed = LEDGERS["assignments"]
    rows, bad = read_tolerant(spark, path, StructType.fromDDL(schema))
    whole = F.coalesce(F.col("timestamp").rlike(ZONED), F.lit(False))
    for c in needed:
        whole = whole & (F.trim(F.coalesce(c, F.lit(""))) != "")
    good = rows.where(whole).withColumn("ts", F.try_to_timestamp("timestamp"))
    last = F.row_number().over(W.partitionBy("paper_id").orderBy(F.col("ts").desc(), F.col("assignment_source")))
    return good.withColumn("latest", last == 1), bad.count() + rows.where(~whole).count()


def load_catalog(papers: DataFrame, topics: DataFrame, position: str = "line") -> tuple[DataFrame, DataFrame]:
    """(works, problems): the first row of each paper_id with the first topic row of it; rows without id and repeated ids are problems."""
    nth = F.row_number().over(W.partitionBy("paper_id").orderBy(position))
    ranked = papers.withColumn("_n", nth)
    known = F.coalesce("paper_id", F.lit("")) != ""
    first = ranked.where(known & (F.col("_n") == 1)).drop("_n")
    problems = ranked.where(~known | (F.col("_n") > 1)).select(position, F.when(~known, "no id").otherwise("repeated id").alias("problem"))
    one = topics.withColumn("_t", F.row_number().over(W.partitionBy("paper_id").orderBy(position))).where("_t = 1").drop("_t", position)
    return first.join(one, "paper_id", "left"), problems


def load_last(rows: DataFrame, key: str = "paper_id", position: str = "line") -> DataFrame:
    """The last row of each id by position, with all its columns; rows without id are left out."""
    kept = [c for c in rows.columns if c not in (key, position)]
    last = rows.where(F.coalesce(key, F.lit("")) != "").groupBy(key).agg(F.max_by(F.struct(*kept), position).alias("row"))
    return last.select(key, "row.*")


def refuse(rows: DataFrame, key: str = "paper_id", pattern: str = "^P[0-9A-F]{12}$", version: str | None = None) -> DataFrame:
    """The rows of a catalog, if all ids are of the pattern and differ, and all rows of the schema version; else an error that names the first fault."""
    bad = rows.where(~F.coalesce(F.col(key).rlike(pattern), F.lit(False))).limit(1).count()
    twice = rows.groupBy(key).count().where("count > 1").limit(1).count()
    other = version is not None and rows.where(~F.coalesce(F.col("schema_version") == version, F.lit(False))).limit(1).count()
    for fault, found in (("an id of another form", bad), ("an id twice", twice), ("another schema version", other)):
        if found:
            raise ValueError(f"the catalog has {fault}")
    return rows


def load_terms(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The rows of a JSON file: `lexicon` (concept, facet, term, topic), `aliases` or `taxonomy` (label, term or domain, label).

    A lexicon is {"concepts": [{"key", "facet", "terms", "topics"}]}, aliases {"aliases": {label: [alias]}}, a taxonomy {"domains": {domain:
    [label]}} with labels that differ. A file of another form, or a facet that is not known, fails."""
    whole = spark.read.text(path, wholetext=True).select("value")
    if kind == "lexicon":
        parsed = whole.select(F.from_json("value", "concepts array<struct<key string, facet string, terms array<string>, topics array<string>>>", {"mode": "FAILFAST"}).alias("j"))
        rows = parsed.select(F.inline("j.concepts")).select(F.col("key").alias("concept"), "facet", F.explode("terms").alias("term"), "topics")
        rows = rows.select("concept", "facet", "term", F.explode_outer("topics").alias("topic"))
        wrong = rows.where(~F.coalesce(F.col("facet").isin("PHENOMENON", "MECHANISM", "OUTCOME", "METHOD", "CONTEXT"), F.lit(False))).limit(1).count()
    elif kind in ("aliases", "taxonomy"):
        name, columns = ("aliases", ("label", "term")) if kind == "aliases" else ("domains", ("domain", "label"))
        parsed = whole.select(F.from_json("value", f"{name} map<string, array<string>>", {"mode": "FAILFAST"}).alias("j"))
        rows = parsed.select(F.explode(f"j.{name}").alias("k", "v")).select(F.col("k").alias(columns[0]), F.explode("v").alias(columns[1]))
        wrong = kind == "taxonomy" and rows.groupBy("label").count().where("count > 1").limit(1).count()
    else:
        raise ValueError(f"no kind {kind}")
    if wrong or not rows.limit(1).count():
        raise ValueError(f"{path} is no {kind}")
    return rows


def write_run(path: str, request: dict, queries: DataFrame, results: DataFrame, screening: DataFrame) -> DataFrame:
    """name, rows, digest of what a run leaves under `path`: its request, query log, results and screening, and a manifest of them.

    Digests are sums over the hashes of rows: a table that was changed since has another."""
    spark = results.sparkSession
    tables = {"request": spark.createDataFrame([(k, str(v)) for k, v in sorted(request.items())], "key string, value string"), "queries": queries, "results": results, "screening": screening}
    rows = []
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
        stored = spark.read.parquet(f"{path}/{name}")
        r = stored.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*stored.columns).cast("decimal(20,0)")).alias("s")).first()
        rows.append((name, r["n"], str(r["s"])))
    manifest = spark.createDataFrame(rows, "name string, rows long, digest string")
    manifest.coalesce(1).write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def envelope(works: DataFrame, problems: DataFrame, index_status: str, version: str = "1") -> DataFrame:
    """schema_version, index_status, works, problems, degraded: one row that goes with every response."""
    n = works.agg(F.count("*").alias("works")).join(problems.agg(F.count("*").alias("problems")))
    return n.select(F.lit(version).alias("schema_version"), F.lit(index_status).alias("index_status"), "works", "problems", ((F.col("problems") > 0) | F.lit(index_status != "FRESH")).alias("degraded"))


def write_catalog(works: DataFrame, path: str, key: str = "paper_id") -> str:
    """The works as JSON Lines in the order of their ids, in a new folder under `path` that is complete when its _SUCCESS is there."""
    target = f"{path}/{uuid.uuid4().hex}"
    works.orderBy(key).write.json(target)
    return target


def write_csv(works: DataFrame, path: str, arrays: str = "; ") -> None:
    """The works as CSV with a header; arrays become text joined by `arrays`."""
    flat = [F.array_join(c, arrays).alias(c) if kind.startswith("array") else F.col(c) for c, kind in works.dtypes]
    works.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def prune(ledger: DataFrame, now, seconds: int) -> DataFrame:
    """The rows of a ledger (ts) that are younger than `seconds`."""
    return ledger.where(F.col("ts") > F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(seconds)))


def signature(files: DataFrame) -> DataFrame:
    """path, kind of rows of the binaryFile source, by their first bytes (fixed values)."""
    head = F.decode(F.substring("content", 1, 5), "ISO-8859-1")
    kind = F.when(head == "%PDF-", "PDF").when(head.startswith("CAJ") | head.startswith("HNLC") | head.startswith("KDH"), "CAJ").when(F.lower(head).rlike(r"^\s*<(!|h)"), "HTML")
    return files.select("path", F.coalesce(kind, F.lit("UNKNOWN")).alias("kind"), F.sha2("content", 256).alias("sha256"))
