"""Which strings are in which: short parts propose, `contains` decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a gram, and rows of grams up to which their table is broadcast.
GRAM, BROADCAST_GRAMS = 3, 200_000


def grams(text: Column, n: int) -> Column:
    """The distinct runs of n characters of a text."""
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def inside(short: DataFrame, long: DataFrame, least: int = 2) -> DataFrame:
    """short, long: the pairs of a string of `short` (short), of `least` characters or more, and one of `long` (long) that has it.

    A string is looked for by the rarest of its grams, of GRAM characters or of all it has: only strings that have it meet it, by an equal join. Grams are counted
    over the distinct strings of `long`; one whose grams are not all there is in none. No pair is left out, and none is made that
    shares only common grams."""
    s = short.select("short").where(F.length("short") >= least).distinct()
    held = long.select("long").where(F.length("long") >= least).distinct()
    sizes = range(least, GRAM + 1)
    cut = held.select("long", F.explode(F.flatten(F.array(*[grams(F.col("long"), n) for n in sizes]))).alias("gram"))
    counts = cut.groupBy("gram").agg(F.count("*").alias("n"))
    own = F.when(F.length("short") >= GRAM, grams(F.col("short"), GRAM)).otherwise(F.array("short"))
    asked = s.select("short", F.explode(own).alias("gram"))
    rare = asked.join(counts, "gram", "left").groupBy("short").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return rare.join(cut, "gram").where(F.col("long").contains(F.col("short"))).select("short", "long")


def alike(wanted: DataFrame, names: DataFrame) -> DataFrame:
    """wanted, name: the pairs of strings (wanted) and (name) that are equal, or of which one of two characters or more is in the other."""
    w, n = wanted.select("wanted").where("wanted <> ''").distinct(), names.select("name").where("name <> ''").distinct()
    equal = w.join(n, F.col("wanted") == F.col("name"))
    within = inside(w.withColumnRenamed("wanted", "short"), n.withColumnRenamed("name", "long")).select(F.col("short").alias("wanted"), F.col("long").alias("name"))
    around = inside(n.withColumnRenamed("name", "short"), w.withColumnRenamed("wanted", "long")).select(F.col("long").alias("wanted"), F.col("short").alias("name"))
    return equal.unionByName(within).unionByName(around).distinct()
