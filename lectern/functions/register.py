"""The library's functions for SQL: expressions as SQL functions, NFKC and marks as Arrow functions, chunks as a table function."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from lectern.functions import text as t
from lectern.operators import passages
from lectern.operators.markup import HtmlElements
from lectern.operators.nested import JsonNodes, redact

#: name -> (parameters, result, body); the bodies say in SQL what functions.text says in columns.
SQL_FUNCTIONS = {
    "fold": ("x STRING", "STRING", r"trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(coalesce(x, '')), 'ß', 'ss'), r'[\p{P}\p{S}\s]+', ' '), r'[^\p{L}\p{N} ]', ''), ' +', ' '))"),
    "normalize_doi": ("x STRING", "STRING", r"nullif(lower(regexp_replace(regexp_extract(coalesce(try_url_decode(x), x), r'10\.\d{4,9}/[^?#\s]+', 0), r'[\x22\x27.,;:)\]}>]+$', '')), '')"),
    "years_of": ("x STRING", "ARRAY<STRING>", r"array_distinct(regexp_extract_all(x, r'\b((?:19|20)\d{2})\b', 1))"),
    "squeeze": ("x STRING", "STRING", r"trim(regexp_replace(x, r'\s+', ' '))"),
}


@udtf(returnType="ordinal int, text string")
class Chunks:
    """chunks(text): the passages of a text, as passages.chunks() cuts them."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        if text and len(" ".join(text.split())) >= passages.LEAST:
            yield from enumerate(passages.cut(text))


TABLE_FUNCTIONS = {"chunks": Chunks, "html_elements": HtmlElements, "json_nodes": JsonNodes}


def register(spark: SparkSession) -> list[str]:
    """Registers them in a session, as temporary functions, and tells their names."""
    for name, (parameters, result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    spark.udf.register("nfkc", t.nfkc)
    spark.udf.register("strip_accents", t.strip_accents)
    spark.udf.register("redact_json", redact)
    for name, function in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, function)
    return [*SQL_FUNCTIONS, "nfkc", "strip_accents", "redact_json", *TABLE_FUNCTIONS]
