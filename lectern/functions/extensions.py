"""What users bring: rerankers, readers of full texts and aggregates, as functions of Python that run in tasks and may fail."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

KINDS = ("reranker", "reader", "aggregate")
_REGISTRY: dict[tuple[str, str], Callable] = {}


def register(kind: str, name: str, function: Callable) -> None:
    """Make a function known by name. A reranker takes the results of one query (query, doc_id, score and any more columns) and gives a score for each row; a
    reader takes the bytes of a file and gives its text; an aggregate takes the values of a group and gives a number."""
    if kind not in KINDS:
        raise ValueError(f"no kind {kind}; kinds are {', '.join(KINDS)}")
    _REGISTRY[kind, name] = function


def of(kind: str, name: str) -> Callable:
    if (kind, name) not in _REGISTRY:
        raise KeyError(f"no {kind} {name}")
    return _REGISTRY[kind, name]


def rerank(results: DataFrame, name: str, most: int = 1000) -> DataFrame:
    """query, doc_id, score, rank, error of results (query, doc_id, score, ...) in the order that a reranker gives those of each query.

    One that fails, or gives anything but a finite number for each row, changes nothing: the lexical scores and their order stay, and
    error says why. The `most` best of a query are reranked, which bounds what meets in a task; those below keep their order after them."""
    function = of("reranker", name)
    order = W.partitionBy("query").orderBy(F.col("score").desc(), "doc_id")
    ranked = results.withColumn("_place", F.row_number().over(order))
    kinds = {f.name: f.dataType for f in results.schema.fields}
    schema = T.StructType([T.StructField("query", kinds["query"]), T.StructField("doc_id", kinds["doc_id"]), T.StructField("score", T.DoubleType()), T.StructField("error", T.StringType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        error = None
        scores = pdf["score"].astype(float)
        try:
            given = pd.Series(list(function(pdf.drop(columns="_place").copy())), index=pdf.index, dtype=float)
            if not given.map(lambda x: x == x and abs(x) != float("inf")).all():
                raise ValueError("a score is no finite number")
            scores = given
        except Exception as e:  # whatever a user's function does
            error = f"{type(e).__name__}: {e}; lexical ranking retained"
        return pd.DataFrame({"query": pdf["query"], "doc_id": pdf["doc_id"], "score": scores, "error": error})

    best = ranked.where(F.col("_place") <= most).groupBy("query").applyInPandas(run, schema)
    below = ranked.where(F.col("_place") > most).select("query", "doc_id", F.col("score").cast("double").alias("score"), F.lit(None).cast("string").alias("error"), F.lit(1).alias("_part"))
    both = best.withColumn("_part", F.lit(0)).unionByName(below)
    last = W.partitionBy("query").orderBy("_part", F.col("score").desc(), "doc_id")
    return both.select("query", "doc_id", "score", F.row_number().over(last).alias("rank"), "error")


def texts(files: DataFrame, name: str) -> DataFrame:
    """path, text, error of files (path, content): what a reader makes of each; a file that it fails on has an error and no text."""
    function = of("reader", name)

    @F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())]))
    def read(content: pa.Array) -> pa.Array:
        out = []
        for data in content:
            try:
                said = function(data.as_py())
                out.append({"text": None if said is None else str(said), "error": None})
            except Exception as e:
                out.append({"text": None, "error": f"{type(e).__name__}: {e}"})
        return pa.array(out, pa.struct([("text", pa.string()), ("error", pa.string())]))

    return files.select("path", read("content").alias("r")).select("path", "r.text", "r.error")


def aggregate(name: str):
    """The aggregate as a column function: agg(aggregate("h_index")("citations")). A group's values are in one task, so groups have to be bounded."""
    function = of("aggregate", name)

    def run(values: pd.Series) -> float:
        return float(function(values.dropna()))

    return F.pandas_udf(run, "double")


def register_all(spark: SparkSession) -> list[str]:
    """Make all aggregates known to SQL under their names."""
    names = [name for kind, name in _REGISTRY if kind == "aggregate"]
    for name in names:
        spark.udf.register(name, aggregate(name))
    return names


def h_index(values: pd.Series) -> int:
    """The largest h so that h values are h at least."""
    ordered = sorted(values, reverse=True)
    return sum(v >= k for k, v in enumerate(ordered, 1))


register("aggregate", "h_index", h_index)
register("reader", "utf8", lambda data: data.decode("utf-8"))
