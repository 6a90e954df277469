"""What the two searches over vectors share: which rows take part, and best rows of each query."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def usable(vectors: DataFrame, nonzero: bool) -> DataFrame:
    """vec_id, v (array of double), dim: rows whose vector is not null and has only finite components.

    A null vec_id names no row and takes no part. Rows that repeat a vec_id count once, with the smallest vector."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    if nonzero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


def matrix(column: pd.Series, dim: int, dtype=np.float64) -> np.ndarray:
    """The rows of an array column as a matrix."""
    return np.concatenate(column.to_numpy()).astype(dtype, copy=False).reshape(len(column), dim) if dim and len(column) else np.zeros((len(column), dim), dtype)


def best(found: DataFrame, k: int, score: Column) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of each query with the highest scores, ties to the smaller vec_id."""
    order = W.partitionBy("query_id").orderBy(score.desc(), F.col("vec_id").asc())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
