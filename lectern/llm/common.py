"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_own_folder: list[str] = []
_written: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only on one machine that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir has to name a shared folder on {master}")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="lectern-"))
        atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
    return f"file://{_own_folder[0]}"


def new_path(spark: SparkSession, what: str) -> str:
    """A place in the shared folder for a table; release() deletes what is there."""
    path = f"{scratch_root(spark)}/{what}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialise(df: DataFrame, what: str = "table") -> DataFrame:
    """Write a frame to the shared folder as Parquet and read it again: the lineage ends there, and a lost executor
    costs one read. The table stays until release()."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_counted(df: DataFrame, condition: Column, what: str = "table") -> tuple[DataFrame, int]:
    """materialise(), and how many rows fulfil a condition, counted while they are written: no job more."""
    seen = Observation()
    return materialise(df.observe(seen, F.count_if(condition).alias("n")), what), seen.get["n"]


def materialise_parts(df: DataFrame, part: Column, parts: int, what: str = "table") -> list[tuple[DataFrame, str]]:
    """The rows of each part, numbered from 0, stored in one pass, and the path of each part for delete()."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{what}-{uuid.uuid4().hex}"
    df.withColumn("_part", part.cast("int")).write.partitionBy("_part").parquet(path)
    _written.append(path)
    # Only the parts that have rows are there.
    stored = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType())])).parquet(path)
    return [(stored.where(F.col("_part") == k).drop("_part"), f"{path}/_part={k}") for k in range(parts)]


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def tidy(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that nothing refers to any more, which it does when the driver's memory is collected."""
    gc.collect()
    spark._jvm.System.gc()


def drop(df: DataFrame) -> None:
    """Delete a table that materialise() wrote and nothing reads any more."""
    spark = df.sparkSession
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if file in _written or any(file.endswith(w.rpartition("/")[2]) for w in _written):
            path = spark._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def written() -> int:
    """How many tables materialise() has written that are not released: a mark for release()."""
    return len(_written)


def release(spark: SparkSession, since: int = 0, last: int = 0) -> int:
    """Delete the tables that materialise() wrote since the mark, but the `last` ones; call it once the results made from them are stored."""
    gone = 0
    for path in _written[since : len(_written) - last]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        gone += at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
        _written.remove(path)
    return gone


def crc_remainder(key: Column, by: int) -> Column:
    """crc32 of the key as text, modulo `by`; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % by


def word_count(text: Column) -> Column:
    """Words of a text, zero if it is null. JVM only."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ceil_div(a: int, b: int) -> int:
    return max(1, -(-a // b))


def small(df: DataFrame, most: int) -> DataFrame:
    """The frame, marked for a broadcast if it has `most` rows at most; beyond, joins with it shuffle. Counts it: give a stored one."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for columns beside those of df: none that it has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"_{name}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
