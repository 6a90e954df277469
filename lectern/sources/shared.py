"""The folder that driver and executors share for intermediate tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def root(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; a temporary folder only on one machine that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir has to name a shared folder on {master}")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="lectern-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def new_path(spark: SparkSession, what: str) -> str:
    return f"{root(spark)}/{what}-{uuid.uuid4().hex}"


_kept: list[str] = []


def keep(df: DataFrame, what: str = "table") -> DataFrame:
    """The frame written as Parquet and read again: its lineage ends there. The table stays until release()."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    _kept.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept() -> int:
    """How many tables keep() has written that are not released: a mark for release()."""
    return len(_kept)


def release(spark: SparkSession, since: int = 0) -> int:
    """Delete the tables that keep() wrote since the mark; call it once the results made from them are stored or no longer wanted."""
    gone = [p for p in _kept[since:] if delete(spark, p)]
    del _kept[since:]
    return len(gone)


def small(df: DataFrame, most: int) -> DataFrame:
    """The frame, marked for a broadcast if it has `most` rows at most; beyond, joins with it shuffle. Counts it: give a stored or small one."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def delete(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def state_of_files(df: DataFrame) -> tuple:
    """Path, length and time of each file that a frame reads: the same as long as none is changed, added or taken away. Asks the file system, reads none."""
    spark = df.sparkSession
    conf, out = spark._jsparkSession.sessionState().newHadoopConf(), []
    for file in sorted(df.inputFiles()):
        at = spark._jvm.org.apache.hadoop.fs.Path(file)
        s = at.getFileSystem(conf).getFileStatus(at)
        out.append((file, s.getLen(), s.getModificationTime()))
    return tuple(out)
