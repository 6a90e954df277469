"""Files that arrive: waits on a stream of listings, with timers, and an archive of what came."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window as W

from lectern.operators.queues import PARTIAL
from lectern.sources import commits

OUTPUT = T.StructType([T.StructField("folder", T.StringType()), T.StructField("outcome", T.StringType()), T.StructField("name", T.StringType()), T.StructField("size", T.LongType()), T.StructField("modified", T.LongType()), T.StructField("at", T.LongType())])
SEEN = T.StructType([T.StructField("size", T.LongType()), T.StructField("modified", T.LongType()), T.StructField("since", T.LongType()), T.StructField("old", T.BooleanType())])
WAIT = T.StructType([T.StructField("began", T.LongType()), T.StructField("over", T.BooleanType())])
NAME = T.StructType([T.StructField("name", T.StringType())])


def listing(spark: SparkSession, folders: str, at, before: bool = False) -> DataFrame:
    """folder, name, size, modified, at, before of the files in some folders (a path with wildcards), without their contents: one look at them."""
    files = spark.read.format("binaryFile").load(folders).select("path", "length", "modificationTime")
    return files.select(
        F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified"), F.lit(at).cast("timestamp").alias("at"), F.lit(before).alias("before")
    )


class Waiting(StatefulProcessor):
    """One folder's wait. State: when it began and whether it is over; for each name what was seen of it, and since when it is the same."""

    def __init__(self, stable: int, timeout: int):
        self.stable, self.timeout = stable, timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.wait = handle.getValueState("wait", WAIT)
        self.files = handle.getMapState("files", NAME, SEEN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows)).sort_values(["at", "before", "modified", "name"], ascending=[True, False, False, True])
        began, over = self.wait.get() if self.wait.exists() else (None, False)
        for r in seen.itertuples():
            if over:
                break
            name = (r.name.lower(),)
            if r.before:
                self.files.updateValue(name, (int(r.size), int(r.modified), int(r.at), True))
                continue
            if began is None:
                began = int(r.at)
                self.handle.registerTimer(began + self.timeout)
            if r.partial or r.size < 0:
                continue
            size, modified, since, old = self.files.getValue(name) if self.files.containsKey(name) else (None, None, None, False)
            if (size, modified) != (r.size, r.modified):
                self.files.updateValue(name, (int(r.size), int(r.modified), int(r.at), False))
            elif not old and r.size > 0 and r.at - since >= self.stable and r.at <= began + self.timeout:
                over = True
                self.files.clear()
                self.handle.deleteTimer(began + self.timeout)
                yield pd.DataFrame([(key[0], "ARRIVED", r.name, int(r.size), int(r.modified), int(r.at))], columns=OUTPUT.fieldNames())
        if began is not None:
            self.wait.update((began, over))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        began, over = self.wait.get()
        if not over:
            self.wait.update((began, True))
            self.files.clear()
            yield pd.DataFrame([(key[0], "TIMED_OUT", None, None, None, began + self.timeout)], columns=OUTPUT.fieldNames()).astype({"size": "Int64", "modified": "Int64"})

    def close(self) -> None:
        pass


def arrivals(listings: DataFrame, stable_ms: int = 2000, timeout_ms: int = 180_000, late: str = "10 seconds") -> DataFrame:
    """folder, outcome, name, size, modified, at (milliseconds) of a stream of listings (folder, name, size, modified, at, before): one row a folder.

    What is there `before` does not count unless it changes; a wait begins with the first look after that. A file has ARRIVED when two looks at
    least `stable_ms` apart find its size, more than zero, and time the same, and no look between another; of several in one look the newest. Names
    of partial files never count. A wait that nothing has ended is TIMED_OUT when event time, less `late`, is past its end. Looks
    at a folder whose wait is over are left out. Needs the RocksDB state store."""
    rows = listings.select("folder", "name", "size", F.col("modified").cast("long").alias("modified"), F.unix_millis("at").alias("at"), "before", F.col("name").rlike(PARTIAL).alias("partial"), F.col("at").alias("time"))
    return rows.withWatermark("time", late).groupBy("folder").transformWithStateInPandas(Waiting(stable_ms, timeout_ms), OUTPUT, "append", "EventTime")


def archive(arrived: DataFrame, path: str, checkpoint: str, database: str):
    """Store the bytes of each arrived file, its hash and where it is kept, in the tables `archive` and `manifest` below `path`, a commit a batch.

    A name that is archived already with the same bytes is not stored twice; with other bytes it is kept under its name and the first
    12 digits of its hash. Both tables come with one commit, so that no manifest names bytes that are not there."""

    def store(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        came = batch.where("outcome = 'ARRIVED'").select(F.concat_ws("/", "folder", "name").alias("original"), "name", "at")
        paths = [r["original"] for r in came.select("original").collect()]  # one row a wait of this batch
        if not paths:
            return
        files = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("original"), "content", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
        new = came.join(files, "original")
        if any("manifest" in e.tables for e in commits.log(spark, path)):
            known = commits.read(spark, path, "manifest").where(F.col("database") == database).select("name", F.col("sha256").alias("known")).distinct()
        else:
            known = spark.createDataFrame([], "name string, known string")
        per = known.groupBy("name").agg(F.collect_set("known").alias("hashes"))  # a row for each content a name has had
        new = new.join(per, "name", "left").withColumn("taken", F.size(F.coalesce("hashes", F.array().cast("array<string>"))) > 0)
        stem, dot = F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("name", r"(\.[^.]*)?$", 1)
        twice = F.coalesce(F.array_contains("hashes", F.col("sha256")), F.lit(False))
        # Of one name's files that come together the first keeps it, and of equal ones one is stored.
        by_name = W.partitionBy("name").orderBy("at", "original")
        first = F.first("sha256").over(by_name)
        stored = F.when((F.col("taken") | (first != F.col("sha256"))) & ~twice, F.concat(stem, F.lit("_"), F.substring("sha256", 1, 12), dot)).otherwise(F.col("name"))
        new = new.select(F.lit(database).alias("database"), F.to_date(F.timestamp_millis("at")).alias("day"), "name", stored.alias("stored"), "sha256", "size", "original", "at", "content", twice.alias("twice"))
        commits.commit(path, f"archive-{database}", n, adds={"archive": new.where("NOT twice").select("database", "day", "stored", "sha256", "content").dropDuplicates(["stored", "sha256"]), "manifest": new.drop("content", "twice")})

    return arrived.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
