"""The ledger's rules on streams: windows with a watermark, latest states, and admission with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(events: DataFrame, late: str = "10 minutes", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """start, event_type, n of each window of event time; rows later than the watermark are left out."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    counted = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(window.alias("w"), "event_type")
    return counted.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "4 hours", late: str = "10 minutes") -> DataFrame:
    """user_id, start, n of each session of a user."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), "n")


def admit(attempts: DataFrame, per_identifier: int = 2, limit: int = 15) -> DataFrame:
    """attempt, admitted of a stream of attempts (attempt, day, source, identifier, ts, refetch).

    The state of a source's day is how many were admitted, in all and of each identifier; a refusal changes nothing. The rows of
    a batch are taken in time order."""

    def fold(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        total, names, counts = state.get if state.exists else (0, [], [])
        used = dict(zip(names, counts, strict=True))
        rows = pd.concat(list(batches)).sort_values(["ts", "attempt"])
        out = []
        for r in rows.itertuples():
            ok = total < limit and (r.refetch or used.get(r.identifier, 0) < per_identifier)
            if ok:
                total += 1
                used[r.identifier] = used.get(r.identifier, 0) + 1
            out.append((r.attempt, ok))
        state.update((total, list(used), list(used.values())))
        yield pd.DataFrame(out, columns=["attempt", "admitted"])

    return attempts.groupBy("day", "source").applyInPandasWithState(fold, "attempt long, admitted boolean", "total int, names array<string>, counts array<int>", "append", "NoTimeout")


def append(rows: DataFrame, path: str, checkpoint: str):
    """Write a stream as an append-only Parquet log, once for each row, whatever is restarted."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def resolved(attempts: DataFrame, outcomes: DataFrame, within: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """attempt, source, identifier, ts, outcome, outcome_ts: attempts (attempt, source, identifier, ts) with every outcome (source, identifier, ts, outcome)
    of their source and identifier in the time `within` after them and on their UTC day; attempts without any come once the watermark has passed.

    Both are streams, or both tables. A row a pair: last_outcome() takes the last one of each attempt."""
    a = attempts.select("attempt", "source", "identifier", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    o = outcomes.select(F.col("source").alias("_source"), F.col("identifier").alias("_identifier"), F.col("ts").cast("timestamp").alias("outcome_ts"), "outcome").withWatermark("outcome_ts", late)
    same = (F.col("source") == F.col("_source")) & (F.col("identifier") == F.col("_identifier")) & (F.to_date("ts") == F.to_date("outcome_ts"))
    after = (F.col("outcome_ts") >= F.col("ts")) & (F.col("outcome_ts") <= F.col("ts") + F.expr(f"interval {within}"))
    return a.join(o, same & after, "leftOuter").select("attempt", "source", "identifier", "ts", "outcome", "outcome_ts")


def last_outcome(pairs: DataFrame) -> DataFrame:
    """attempt, outcome, outcome_ts: the last outcome of each attempt of resolved(), null if it has none."""
    last = F.max(F.struct("outcome_ts", "outcome"))
    return pairs.groupBy("attempt").agg(last.alias("o")).select("attempt", "o.outcome", "o.outcome_ts")
