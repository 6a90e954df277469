"""Exact top-k search by distributed histogram selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lectern.llm.common import ceil_div, materialise
from lectern.llm.vectors import best, matrix, usable

#: Candidates and queries of a block: a pair of blocks is scored in one task, some 50 MB.
BLOCK = 4096
QUERY_BLOCK = 1024
#: Bins of a histogram: each round narrows the range of every k-th score by so much.
BINS = 1024
#: Scores beyond count as this: a range of scores and its width then fit into a long.
MOST = (1 << 62) - 2
NONE = -(1 << 63)


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows, exact up to MOST."""
    dim = q.shape[1]
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, dim)
    if most < 2**53:
        return (q @ c.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m.tolist()], dtype=object).reshape(m.shape)
    return np.clip(whole(q).dot(whole(c).T), -MOST, MOST).astype(np.int64)


def _pair(left: pd.DataFrame, right: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, candidate ids and scores of a block of each; a query's own row has no score, marked by NONE."""
    dim = int(left["qdim"].iloc[0])
    s = scores(matrix(left["q"], dim), matrix(right["v"], dim))
    own = left["query_id"].to_numpy()[:, None] == right["vec_id"].to_numpy()[None, :]
    s[own] = NONE
    return left["query_id"].to_numpy(), right["vec_id"].to_numpy(), s


def _histogram(bins: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.empty(0, np.int64), "bin": np.empty(0, np.int64), "n": np.empty(0, np.int64)})
        if left.empty or right.empty:
            return empty
        ids, _, s = _pair(left, right)
        out = [empty]
        for row, (query, low, high) in enumerate(zip(ids, left["low"].tolist(), left["high"].tolist(), strict=True)):
            inside = s[row][(s[row] >= low) & (s[row] <= high)]
            width = -(-(high - low + 1) // bins)
            b, n = np.unique((inside - low) // width, return_counts=True)
            out.append(pd.DataFrame({"query_id": query, "bin": b, "n": n}))
        return pd.concat(out, ignore_index=True)

    return run


def _over(k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0, np.int64)})]
        if not left.empty and not right.empty:
            ids, others, s = _pair(left, right)
            for row, (query, low) in enumerate(zip(ids, left["low"].tolist(), strict=True)):
                at = np.flatnonzero(s[row] >= low)
                at = at[np.lexsort((others[at], -s[row][at]))][:k]  # ties beyond k in this block lose to those before
                out.append(pd.DataFrame({"query_id": query, "vec_id": others[at], "score": s[row][at]}))
        return pd.concat(out, ignore_index=True)

    return run


def top_k(vectors: DataFrame, k: int = 5, query_step: int = 50, scale: int = 256, block: int = BLOCK, query_block: int = QUERY_BLOCK, bins: int = BINS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `query_step` the k other rows of the highest
    integer inner product of floor(scale * x), ties to the smaller vec_id; all others if there are fewer.

    Every pair of a query and a candidate is scored, block by block. In each round a query's histogram over its range of possible
    k-th scores is summed over all blocks, and the bin that holds the k-th becomes the range, until the range is one
    score. Then scores from there on are kept and ties are broken. A block sends no more than `bins` counts or k rows for a query, however
    many candidates tie.

    - Vectors that are null or hold null or non-finite components take no part, nor do rows without vec_id.
    - Rows that repeat a vec_id count once. Vectors of different lengths are not compared; empty ones score 0.
    - Products beyond 62 bits count as the nearest number of 62 bits. An empty table gives no rows."""
    rows = usable(vectors, nonzero=False)
    # floor() of a double is a long in SQL; past 2^53 a double has no fraction and stays as it is.
    rows = rows.withColumn("v", F.transform("v", lambda x: F.when(F.abs(x * scale) < 2.0**53, F.floor(x * scale).cast("double")).otherwise(x * scale)))
    rows = materialise(rows, "vectors")
    queries = rows.where(F.col("vec_id") % query_step == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("dim").alias("qdim"))
    size = rows.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % query_step == 0).alias("q"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).first()
    blocks, query_blocks = ceil_div(size["n"], block), ceil_div(size["q"], query_block)
    candidates = rows.withColumn("cb", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    l1 = F.aggregate("q", F.lit(0.0), lambda a, x: a + F.abs(x))
    most = min(float(size["most"] or 0.0), 1e300)
    bound = F.least(F.ceil(F.least(l1 * F.lit(most * 1.000001) + 1, F.lit(4.7e18))), F.lit(MOST)).cast("long")
    queries = queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int"))
    state = materialise(queries.select("query_id", (-bound).alias("low"), bound.alias("high"), F.lit(0).cast("long").alias("above")), "ranges")
    width = 2 * int(state.agg(F.max("high")).first()[0] or 0) + 1
    rounds = 0
    while width > 1:
        width, rounds = -(-width // bins), rounds + 1

    def pairs(state: DataFrame):
        sides = queries.join(state, "query_id").withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return sides.groupBy("qdim", "qb", "cb").cogroup(candidates.groupBy("dim", "qb", "cb"))

    for _ in range(rounds):
        counts = pairs(state).applyInPandas(_histogram(bins), "query_id long, bin long, n long")
        counts = counts.groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        down = W.partitionBy("query_id").orderBy(F.col("bin").desc())
        counts = counts.withColumn("upto", F.sum("n").over(down)).join(state, "query_id")
        reached = counts.where(F.col("above") + F.col("upto") >= k).groupBy("query_id").agg(F.max_by(F.struct("bin", (F.col("upto") - F.col("n")).alias("over")), "bin").alias("at"))
        step = F.ceil((F.col("high") - F.col("low") + 1).cast("decimal(38,0)") / F.lit(bins)).cast("long")
        low = F.col("low") + F.col("at.bin") * step
        # With fewer than k candidates no bin reaches k: all of them are kept.
        state = state.join(reached, "query_id", "left").select(
            "query_id",
            F.coalesce(low, F.col("low")).alias("low"),
            F.coalesce(F.least(low + step - 1, F.col("high")), F.col("low")).alias("high"),
            (F.col("above") + F.coalesce(F.col("at.over"), F.lit(0))).alias("above"),
        )
        state = materialise(state, "ranges")
    found = pairs(state).applyInPandas(_over(k), "query_id long, vec_id long, score long")
    return best(found, k, F.col("score"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT query_id, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
