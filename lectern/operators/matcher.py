"""Many terms in many texts: one automaton of all terms, one pass over each text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import text as t
from lectern.sources.shared import keep, small

#: Characters of terms, with some 20 bytes of memory each, that one automaton holds. More terms are dealt over several, each with a pass of its own.
AUTOMATON = 4_000_000
#: Rows of found terms in a batch, terms that the driver numbers, and rows of terms up to which their table is broadcast; beyond, the join shuffles.
BATCH, IN_DRIVER, BROADCAST_TERMS = 100_000, 10_000, 50_000

_BUILT: dict[int, object] = {}  # a worker's automaton of the last broadcast, kept from task to task


def _automaton(shared) -> object:
    table = shared.value
    if id(table) not in _BUILT:
        import ahocorasick

        made = ahocorasick.Automaton()
        for pattern, numbers in table.items():
            made.add_word(pattern, numbers)
        if len(made):
            made.make_automaton()
        _BUILT.clear()
        _BUILT[id(table)] = made, table  # the table is kept, so that no other one has its id
    return _BUILT[id(table)][0]


def pattern_of(term: Column) -> Column:
    """What a folded term is looked for as, in a folded text with a space at each end: between spaces, or anywhere if it has CJK characters."""
    return F.when(term.rlike(f"[{t.CJK}]"), term).otherwise(F.concat(F.lit(" "), term, F.lit(" ")))


def find_folded(docs: DataFrame, patterns: DataFrame, columns: list[str], key: str = "doc_id") -> DataFrame:
    """key, field, term of every number of `patterns` (term: long, pattern) that each of the columns has; the columns are folded texts, as pattern_of()
    wants them, in one pass for all columns and terms. A term is told once a row and field.

    Terms up to AUTOMATON characters go to the workers as one automaton; beyond, as several, with a scan of the texts each: nothing is left out."""
    spark = docs.sparkSession
    size = patterns.agg(F.coalesce(F.sum(F.length("pattern")), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-size // AUTOMATON))
    schema = T.StructType([docs.schema[key], T.StructField("field", T.StringType()), T.StructField("term", T.LongType())])
    rows = docs.select(key, *columns)
    out = None
    for part in range(parts):
        mine = patterns if parts == 1 else patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == part)
        table: dict[str, list[int]] = {}
        for r in mine.select("term", "pattern").distinct().collect():  # AUTOMATON characters, more or less
            table.setdefault(r["pattern"], []).append(r["term"])
        found = rows.mapInArrow(_scanner(spark.sparkContext.broadcast(table), columns, key), schema)
        out = found if out is None else out.unionByName(found)
    return out


def _scanner(shared, columns: list[str], key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(shared)
        for b in batches:
            at: list[int] = []
            fields: list[str] = []
            terms: list[int] = []

            def out() -> pa.RecordBatch:
                made = [b.column(key).take(pa.array(at, pa.int64())), pa.array(fields, pa.string()), pa.array(terms, pa.int64())]
                for x in (at, fields, terms):
                    x.clear()
                return pa.RecordBatch.from_arrays(made, [key, "field", "term"])

            for f in columns:
                for k, text in enumerate(b.column(f)):
                    said = text.as_py()
                    if not said or not len(machine):
                        continue
                    for n in {n for _, numbers in machine.iter(said) for n in numbers}:
                        at.append(k)
                        fields.append(f)
                        terms.append(n)
                    if len(at) >= BATCH:
                        yield out()
            if at:
                yield out()

    return run


def find(docs: DataFrame, terms: DataFrame, columns: list[str], key: str = "doc_id") -> DataFrame:
    """key, field and the columns of `terms` (term, ...) for each of its rows whose term, folded, a text of `docs` has: as whole words, or anywhere if
    it has CJK characters. Terms that fold to nothing are in no text."""
    folded_terms = terms.withColumn("_folded", t.fold(F.col("term"))).where("_folded <> ''")
    distinct = folded_terms.select("_folded").distinct()
    few = distinct.limit(IN_DRIVER + 1).collect()
    if len(few) <= IN_DRIVER:
        names = docs.sparkSession.createDataFrame([(k, r["_folded"]) for k, r in enumerate(sorted(few))], "_n long, _name string")
    else:  # numbered where they are; the table is stored, so that a term keeps its number
        names = keep(distinct.select(F.monotonically_increasing_id().alias("_n"), F.col("_folded").alias("_name")), "terms")
    folded = docs.select(key, *[F.concat(F.lit(" "), t.fold(F.col(c)), F.lit(" ")).alias(c) for c in columns])
    found = find_folded(folded, names.select(F.col("_n").alias("term"), pattern_of(F.col("_name")).alias("pattern")), columns, key)
    meant = folded_terms.join(names, F.col("_folded") == F.col("_name")).drop("_folded", "_name")
    return found.withColumnRenamed("term", "_found").join(small(meant, BROADCAST_TERMS), F.col("_found") == F.col("_n")).drop("_found", "_n")
