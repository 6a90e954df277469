"""Tables of a folder, and frames made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def works(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as works: the first line is the title; year, authors, journal and topics follow from the other columns."""
    docs = table(spark, folder, "documents")
    return docs.select(
        "doc_id",
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("body"),
        (1990 + F.pmod("doc_id", F.lit(35))).cast("int").alias("year"),
        F.concat(F.lit("author "), F.pmod("doc_id", F.lit(97))).alias("author"),
        F.col("source").alias("journal"),
        F.col("lang").alias("domain"),
        F.concat_ws(" ", "lang", "source").alias("subtopic"),
    )


#: The same in SQL.
WORKS_SQL = r"""works AS (
  SELECT doc_id, split_part(text, chr(10), 1) AS title, text AS body, CAST(1990 + doc_id % 35 AS INTEGER) AS year,
    'author ' || (doc_id % 97) AS author, source AS journal, lang AS domain, lang || ' ' || source AS subtopic FROM documents
)"""


def fold_sql(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(coalesce({x}, '')), 'ß', 'ss'), '[\p{{P}}\p{{S}}\s]+', ' ', 'g'), '[^\p{{L}}\p{{N}} ]', '', 'g'), ' +', ' ', 'g'))"


def stem_sql(w: str) -> str:
    return f"""CASE WHEN length({w}) > 4 AND {w} LIKE '%ies' THEN left({w}, length({w}) - 3) || 'y'
      WHEN length({w}) > 4 AND regexp_matches({w}, '(sses|ches|shes)$') THEN left({w}, length({w}) - 2)
      WHEN length({w}) > 4 AND regexp_matches({w}, '(ing|ers)$') THEN left({w}, length({w}) - 3)
      WHEN length({w}) > 3 AND {w} LIKE '%s' AND NOT regexp_matches({w}, '(ss|us|is)$') THEN left({w}, length({w}) - 1) ELSE {w} END"""
