"""Ledgers of attempts: usage, budgets, admission, pacing, outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def usage(attempts: DataFrame) -> DataFrame:
    """source, identifier, attempts, last, outcome of attempts (source, identifier, ts, outcome), the outcome as of the last."""
    return attempts.groupBy("source", "identifier").agg(F.count("*").alias("attempts"), F.max("ts").alias("last"), F.max_by("outcome", F.struct("ts", "outcome")).alias("outcome"))


def budget(attempts: DataFrame, limit: int = 15) -> DataFrame:
    """day, source, attempts, remaining of each UTC day."""
    return attempts.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "source").agg(F.count("*").alias("attempts")).withColumn("remaining", F.greatest(F.lit(limit) - F.col("attempts"), F.lit(0)))


def admit(attempts: DataFrame, per_identifier: int = 2, limit: int = 15) -> DataFrame:
    """attempt, admitted of attempts (attempt, day, source, identifier, ts, refetch).

    In time order, an attempt is refused if its identifier has used its limit of the day, which a refetch lifts, or its source has. A
    refusal uses nothing up. Before a source's limit is met, an attempt passes if it is a refetch or if fewer than `per_identifier` of its
    identifier passed before it; so it depends on its identifier alone, and the source then admits the first `limit` that pass.

    Of an identifier's attempts in a day the first `per_identifier` pass, refetch or not, and of the others the refetches do: what has passed is
    never fewer than the limit from there on. An attempt without a source or identifier is refused."""
    first = _first(attempts, ["day", "source", "identifier"], per_identifier, "_own")
    rows = attempts.join(first, ["day", "source", "identifier"], "left")
    rows = rows.withColumn("passes", F.col("identifier").isNotNull() & (F.col("refetch") | F.coalesce(F.struct("ts", "attempt") <= F.col("_own"), F.lit(False))))
    last = _first(rows.where("passes"), ["day", "source"], limit, "_last")
    rows = rows.join(last, ["day", "source"], "left")
    return rows.select("attempt", (F.col("passes") & F.coalesce(F.struct("ts", "attempt") <= F.col("_last"), F.lit(False))).alias("admitted"))


def _first(rows: DataFrame, keys: list[str], n: int, name: str) -> DataFrame:
    """The keys, and the place (ts, attempt) of the n-th row of each key in time, or of its last: tasks pass on n rows of a key at most, however many it has."""
    order = W.partitionBy(*keys).orderBy("ts", "attempt")
    few = rows.select(*keys, "ts", "attempt").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n)
    return few.groupBy(*keys).agg(F.max(F.struct("ts", "attempt")).alias(name))


def pacing(attempts: DataFrame, scope: list[str], interval: float = 15.0, window: float = 600.0, limit: int = 12) -> DataFrame:
    """attempt, wait: the seconds that each attempt (attempt, ts) would have had to wait for the interval since the last one and for the
    sliding window of the last `limit` ones, inside its scope.

    Only attempts at most so long ago count. A scope is cut into spans of that length, each read with the one before, so that no task
    needs all of a busy scope."""
    span = max(interval, window, 1.0)
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    part = F.floor(F.col("_at") / span)
    spans = F.explode(F.array(F.struct(part.alias("span"), F.lit(True).alias("own")), F.struct((part + 1).alias("span"), F.lit(False).alias("own"))))
    rows = attempts.select(*scope, "ts", "attempt", at.alias("_at")).withColumn("_in", spans)
    w = W.partitionBy(*scope, "_in.span").orderBy("ts", "attempt")
    rows = rows.withColumns({"_last": F.lag("_at").over(w), "_nth": F.lag("_at", limit).over(w)}).where("_in.own")
    wait = F.greatest(F.lit(0.0), F.coalesce(F.lit(interval) - (F.col("_at") - F.col("_last")), F.lit(0.0)), F.coalesce(F.lit(window) - (F.col("_at") - F.col("_nth")), F.lit(0.0)))
    return rows.select("attempt", F.round(wait, 6).alias("wait"))


def latest_state(log: DataFrame, terminal: list[str]) -> DataFrame:
    """key, state, done of each key of a log (key, state, position): the last row's."""
    return log.groupBy("key").agg(F.max_by("state", "position").alias("state")).withColumn("done", F.col("state").isin(*terminal))


def misses(log: DataFrame, hit: str, most: int = 3) -> DataFrame:
    """key, stops_at: where each key's run of `most` misses in a row ends first (key, position, outcome), null if it never does."""
    w = W.partitionBy("key").orderBy("position")
    run = log.withColumn("island", F.sum((F.col("outcome") == hit).cast("int")).over(w))
    inside = W.partitionBy("key", "island").orderBy("position")
    run = run.where(F.col("outcome") != hit).withColumn("n", F.row_number().over(inside))
    stops = run.where(F.col("n") == most).groupBy("key").agg(F.min("position").alias("stops_at"))
    return log.select("key").distinct().join(stops, "key", "left")


# Outcomes that end a batch at once and how it is then said to have ended, and those that reached a source and brought nothing.
GATES = {"HUMAN_ACTION_REQUIRED": "STOPPED_FOR_HUMAN_ACTION", "DAILY_BUDGET_EXHAUSTED": "STOPPED_DAILY_BUDGET_EXHAUSTED", "CAPABILITY_MISSING": "STOPPED_CAPABILITY_MISSING", "ENV_NOT_READY": "STOPPED_ENV_NOT_READY"}
MISSES = ("NOT_FOUND", "NOT_DOWNLOADED", "NOT_AUTHORIZED", "DOWNLOAD_FAILED", "FAILED")


def stops(log: DataFrame, most: int = 3) -> DataFrame:
    """batch, status, stopped_at, ran, downloaded of each batch of outcomes (batch, position, outcome): where it ends, and what was done up to there.

    It ends at the first gate, or at the `most`-th miss in a row; a download begins the count anew, what is in the library already does not. A
    batch is a bounded queue, read in order."""
    order = W.partitionBy("batch").orderBy("position")
    rows = log.withColumn("_island", F.sum((F.col("outcome") == "DOWNLOADED").cast("int")).over(order))
    rows = rows.withColumn("_misses", F.sum(F.col("outcome").isin(*MISSES).cast("int")).over(W.partitionBy("batch", "_island").orderBy("position")))
    gate = F.try_element_at(F.create_map(*[F.lit(x) for kv in GATES.items() for x in kv]), F.col("outcome"))
    ends = F.coalesce(gate, F.when(F.col("outcome").isin(*MISSES) & (F.col("_misses") >= most), "STOPPED_CONSECUTIVE_MISSES"))
    rows = rows.withColumn("_ends", ends)
    first = F.min(F.when(F.col("_ends").isNotNull(), F.col("position"))).over(W.partitionBy("batch"))
    rows = rows.withColumn("_at", first).where(F.col("_at").isNull() | (F.col("position") <= F.col("_at")))
    return rows.groupBy("batch").agg(F.coalesce(F.max_by("_ends", F.when(F.col("_ends").isNotNull(), F.col("position"))), F.lit("COMPLETED")).alias("status"), F.max("_at").alias("stopped_at"), F.count("*").alias("ran"), F.count_if(F.col("outcome") == "DOWNLOADED").alias("downloaded"))
