"""Tables that change by commits: data first, then the entry of a log that makes it part of the table; a batch counts once, whatever is restarted."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.sources import shared


@dataclass(frozen=True)
class Entry:
    """A commit: which batch of which writer it is, and what it adds to each table or puts in the place of it."""

    version: int
    writer: str
    batch: str
    tables: dict[str, dict]


def log(spark: SparkSession, path: str) -> list[Entry]:
    """The commits below `path`, in order: one small file each; compact() makes them few again."""
    if not shared.exists(spark, f"{path}/log"):
        return []
    rows = spark.read.text(f"{path}/log", wholetext=True, pathGlobFilter="*.json").collect()
    found = [json.loads(r["value"]) for r in rows]
    return sorted((Entry(e["version"], e["writer"], e["batch"], e["tables"]) for e in found), key=lambda e: e.version)


def _enter(spark: SparkSession, path: str, entry: Entry) -> bool:
    """Put an entry into the log, whole or not at all; false if its place is taken."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    place = jvm.org.apache.hadoop.fs.Path
    draft, target = place(f"{path}/log/.draft-{uuid.uuid4().hex}"), place(f"{path}/log/{entry.version:012d}.json")
    system = draft.getFileSystem(conf)
    out = system.create(draft)
    out.write(json.dumps({"version": entry.version, "writer": entry.writer, "batch": entry.batch, "tables": entry.tables}).encode())
    out.close()
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), conf).rename(system.makeQualified(draft), system.makeQualified(target), none)
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in str(e.java_exception.toString()):
            raise
        system.delete(draft, False)
        return False


def done(spark: SparkSession, path: str, writer: str, batch) -> bool:
    return any((e.writer, e.batch) == (writer, str(batch)) for e in log(spark, path))


def commit(path: str, writer: str, batch, adds: dict[str, DataFrame] | None = None, replaces: dict[str, DataFrame] | None = None, at: int | None = None) -> bool:
    """Add rows to some tables and put others in the place of what they were, all in one step; false, and nothing done, if the batch is in already.

    Rows are written to folders of their own first, which no reader sees until the entry is there. Of two writers at once the second one's
    entry goes after the first one's, unless `at` says after which version it has to stand: then it is not made, and false. Who computes a
    replacement from a table's rows gives the version that they are of."""
    frames = {**(adds or {}), **(replaces or {})}
    spark = next(iter(frames.values())).sparkSession
    if done(spark, path, writer, batch):
        return False
    tables = {}
    for name, rows in frames.items():
        folder = f"data/{name}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{path}/{folder}")
        tables[name] = {"folder": folder, "replaces": name in (replaces or {}), "schema": rows.schema.json()}
    while True:
        entries = log(spark, path)
        last = max((e.version for e in entries), default=-1)
        if any((e.writer, e.batch) == (writer, str(batch)) for e in entries) or at not in (None, last):
            for t in tables.values():
                shared.delete(spark, f"{path}/{t['folder']}")
            return False
        if _enter(spark, path, Entry(last + 1, writer, str(batch), tables)):
            return True


def _folders(entries: list[Entry], table: str) -> tuple[list[str], str | None]:
    folders, schema = [], None
    for e in entries:
        if table in e.tables:
            t = e.tables[table]
            folders = [t["folder"]] if t["replaces"] else [*folders, t["folder"]]
            schema = t["schema"]
    return folders, schema


def read(spark: SparkSession, path: str, table: str, version: int | None = None) -> DataFrame:
    """The rows of a table as of its last commit, or as of a version. A table that no commit names is an error."""
    entries = [e for e in log(spark, path) if version is None or e.version <= version]
    folders, schema = _folders(entries, table)
    if not folders:
        raise ValueError(f"no commit has made {table}")
    return spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(*[f"{path}/{f}" for f in folders])


def compact(spark: SparkSession, path: str, table: str, writer: str = "compact") -> bool:
    """Put all rows of a table into one folder; false, and nothing done, if there is but one or a commit came in between. Old folders stay until vacuum(), for readers that have begun."""
    entries = log(spark, path)
    last = max((e.version for e in entries), default=-1)
    return commit(path, writer, f"{table}-{last}", replaces={table: read(spark, path, table, last)}, at=last) if len(_folders(entries, table)[0]) > 1 else False


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete folders that are part of no table any more, and those of commits that never came to be; for times when nobody writes or reads."""
    entries = log(spark, path)
    used = {f for t in {t for e in entries for t in e.tables} for f in _folders(entries, t)[0]}
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/data")
    system = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    gone = 0
    for status in system.listStatus(place) if system.exists(place) else ():
        if f"data/{status.getPath().getName()}" not in used:
            gone += system.delete(status.getPath(), True)
    return gone


def sink(rows: DataFrame, path: str, table: str, checkpoint: str, writer: str | None = None):
    """Write a stream into a table, a commit a batch: a batch that is run again after a stop is left out."""
    name = writer or f"sink-{table}"
    into = lambda df, batch: commit(path, name, batch, adds={table: df})
    return rows.writeStream.foreachBatch(into).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


ATTEMPTS, OUTCOMES = "attempts", "outcomes"


def run_attempts(attempts: DataFrame, act, path: str, checkpoint: str, writer: str = "run"):
    """Act on a stream of attempts (attempt, ...), each on the ledger before it is acted on, and its outcome after.

    act: attempts to (attempt, outcome), a frame to a frame. Attempts of a batch that was stopped after they were written, whether or not
    something was done about them, are not acted on again: their outcome is INTERRUPTED."""

    def run(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        if done(spark, path, f"{writer}-outcomes", batch):
            return
        fresh = commit(path, f"{writer}-attempts", batch, adds={ATTEMPTS: df.withColumn("batch", F.lit(batch).cast("long"))})
        mine = read(spark, path, ATTEMPTS).where(F.col("batch") == batch)
        made = act(mine) if fresh else mine.select("attempt", F.lit("INTERRUPTED").alias("outcome"))
        commit(path, f"{writer}-outcomes", batch, adds={OUTCOMES: made.select("attempt", "outcome")})

    return attempts.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
