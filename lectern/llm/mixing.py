"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lectern.llm.common import materialise, small, word_count

#: Cells in which the words of a source are summed, by rank, before any rows are sorted.
CELLS = 4096
#: Sources up to which their table, some 100 bytes a row, is broadcast; beyond, the join shuffles.
BROADCAST_SOURCES = 10_000


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) with 52 random bits, the same in every run: the first 13 hexadecimal digits of an MD5."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("")))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """source, source_size, target: one row for each source of `sizes` (source, size).

    Sources in code point order, null last, weigh `weights` in turn. Together the targets are all sizes. A target stops
    at `cap` times its source's size and what is over goes to the others by weight, until none is above: that is the
    level at which min(cap * size, level * weight) adds up. Sources of no size get 0; no rows give no rows."""
    by_code_point = W.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_code_point) - 1, F.lit(len(weights)))
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double"))
    per = per.withColumn("most", F.lit(cap) * F.col("source_size"))
    # Sources fill up in the order of most / weight: before it a prefix is full, after it all share one level.
    order = W.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    before = order.rowsBetween(W.unboundedPreceding, -1)
    per = (
        per.withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("left_over", F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left_over") / F.col("open"))
        # The first source that its level does not fill sets it for itself and all after it; theirs is no higher.
        .withColumn("final", F.max(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))).over(everything))
    )
    return per.select("source", "source_size", F.least("most", F.col("final") * F.col("weight")).alias("target"))


def odds(by_size: DataFrame, goal: DataFrame) -> DataFrame:
    """source, source_size, target, certain, slope, need: how each source's target is met, from `by_size` (source, size, n) and targets.

    Every document gets `certain` whole copies, the whole part of target / source_size. One more goes to documents by chances
    in proportion to their size, p = slope * size: the slope at which the words of certain and chosen documents make up what is left.
    Documents with p of 1 and more have their further copy for certain too; `need` is what is left to the sample, in words."""
    ratio = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    goal = goal.withColumn("certain", F.floor(ratio)).withColumn("left", F.greatest(F.col("target") - F.col("certain") * F.col("source_size"), F.lit(0.0)))
    sizes = by_size.where("size > 0").join(small(goal.withColumnRenamed("source", "_source"), BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("_source")))
    words, squares = F.col("n") * F.col("size"), (F.col("n") * F.col("size")).cast("decimal(20,0)") * F.col("size").cast("decimal(12,0)")
    larger = W.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy("source").orderBy("size").rowsBetween(W.unboundedPreceding, 0)
    slope = (F.col("left") - F.coalesce(F.sum(words).over(larger), F.lit(0))) / F.sum(squares).over(upto).cast("double")
    # From the largest size on: the first that its slope does not fill sets the slope for itself and all smaller ones.
    sizes = sizes.select("source", "size", words.alias("words"), slope.alias("slope"))
    chosen = sizes.where(F.col("slope") * F.col("size") <= 1).groupBy("source").agg(F.max_by("slope", "size").alias("slope"))
    chosen = small(materialise(chosen.withColumnRenamed("source", "_source"), "slopes"), BROADCAST_SOURCES)
    whole = sizes.drop("slope").join(chosen, F.col("source").eqNullSafe(F.col("_source"))).groupBy("source").agg(
        F.first("slope").alias("slope"), F.coalesce(F.sum(F.when(F.col("slope") * F.col("size") >= 1, F.col("words"))), F.lit(0)).alias("whole")
    )
    whole = whole.withColumnRenamed("source", "_source")
    out = goal.join(whole, F.col("source").eqNullSafe(F.col("_source")), "left")
    need = F.greatest(F.col("left") - F.coalesce("whole", F.lit(0)), F.lit(0.0))
    return out.select("source", "source_size", "target", "certain", F.coalesce("slope", F.lit(0.0)).alias("slope"), need.alias("need"))


def _ranked(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows (source, doc_id, size, u and any more) with their source's plan, chance p and Pareto's rank q = U/(1-U) over p/(1-p)."""
    due = rows.join(small(plan.withColumnRenamed("source", "_source"), BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    due = due.withColumn("p", F.col("slope") * F.col("size"))
    sampled = (F.col("p") > 0) & (F.col("p") < 1)
    return due.withColumn("q", F.when(sampled, F.col("u") / (1 - F.col("u")) * ((1 - F.col("p")) / F.col("p"))))


def cuts(rows: DataFrame, plan: DataFrame, cells: int) -> DataFrame:
    """source, at, taken, tied: where the sample of each source ends: after `taken` of the `tied` rows of key `at` (q, doc_id, size).

    Words are summed over cells of q first, and only the cell in which the sample ends is sorted, rows of one key as one."""
    due = _ranked(rows, plan).where("q IS NOT NULL").withColumn("cell", F.floor(F.col("q") / (1 + F.col("q")) * cells))
    per_cell = due.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"), F.first("need").alias("need"))
    per_cell = per_cell.withColumn("upto", F.sum("cell_size").over(W.partitionBy("source").orderBy("cell")))
    # Cells that end within the need are taken whole; the first that does not is cut.
    cut = per_cell.where("upto > need").groupBy("source").agg(F.min_by(F.struct("cell", (F.col("upto") - F.col("cell_size")).alias("before")), "cell").alias("cut"))
    cut = materialise(cut.select(F.col("source").alias("_source"), F.col("cut.cell").alias("_cell"), F.col("cut.before").alias("begin")), "cut-cells")
    at_cut = due.join(small(cut, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("_source")) & (F.col("cell") == F.col("_cell")))
    keys = at_cut.groupBy("source", "q", "doc_id", "size").agg(F.count("*").alias("n"), F.first("need").alias("need"), F.first("begin").alias("begin"))
    front = W.partitionBy("source").orderBy("q", F.col("doc_id").asc_nulls_first(), "size")
    before = F.col("begin") + F.coalesce(F.sum(F.col("n") * F.col("size")).over(front.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # A document is taken while its middle lies within the need.
    taken = F.least(F.greatest(F.floor((2 * (F.col("need") - before) + F.col("size")) / (2 * F.col("size"))), F.lit(0)), F.col("n"))
    keys = keys.withColumn("taken", taken).withColumn("place", F.row_number().over(front)).where("taken > 0 OR place = 1")
    ends = keys.groupBy("source").agg(F.max_by(F.struct(F.struct("q", "doc_id", "size").alias("at"), "taken", F.col("n").alias("tied")), "place").alias("end"))
    return ends.select("source", "end.*")


def copies(docs: DataFrame, weights: tuple[int, ...], cap: float, seed: str, cells: int, whole_rows: bool) -> DataFrame:
    """doc_id, source, size, source_size, target, copies for each row of docs, and with `whole_rows` the row itself, as struct `row`.

    Rows are scanned, never shuffled, but for those that share the key at which a sample ends inside."""
    text = F.col("text").cast("string")
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.coalesce(text, F.lit(""))))
    parts = [F.col("doc_id"), F.col("source"), word_count(text).alias("size"), uniform(key, seed).alias("u")]
    sized = materialise(docs.select(*parts), "sizes")
    by_size = materialise(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "size-counts")
    goal = materialise(targets(by_size.select("source", (F.col("n") * F.col("size")).alias("size")), weights, cap), "targets")
    plan = materialise(odds(by_size, goal), "odds")
    ends = materialise(cuts(sized, plan, cells).withColumnRenamed("source", "_source"), "ends")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *parts) if whole_rows else sized
    due = _ranked(rows, plan).join(small(ends, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("_source")), "left")
    here = F.struct("q", "doc_id", "size")
    # Beyond `at` nothing of the sample is taken; a source without an end has all of it.
    more = F.when(F.col("p") >= 1, 1).when(F.col("q").isNull(), 0).when(F.col("at").isNull() | (here < F.col("at")), 1).when(here > F.col("at"), 0)
    more = more.when(F.col("taken") == 0, 0).when(F.col("taken") == F.col("tied"), 1)  # else some of the rows of one key
    kept = ["row"] * whole_rows + ["doc_id", "source", "size", "source_size", "target"]
    due = due.select(*kept, "certain", "taken", more.cast("long").alias("more"))
    if not ends.where("taken > 0 AND taken < tied").limit(1).count():
        return due.select(*kept, (F.col("certain") + F.col("more")).alias("copies"))
    # Rows of one key of which some are taken: numbered inside 256 parts that are written down, so that no task has them all.
    tied = materialise(due.where("more IS NULL").withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(256))), "tied")
    base = tied.groupBy("source", "part").agg(F.count("*").alias("n"))
    base = base.select(F.col("source").alias("_source"), F.col("part").alias("_part"), (F.sum("n").over(W.partitionBy("source").orderBy("part")) - F.col("n")).alias("base"))
    number = F.row_number().over(W.partitionBy("source", "part").orderBy(F.lit(0))) + F.col("base")
    tied = tied.join(F.broadcast(base), F.col("source").eqNullSafe(F.col("_source")) & (F.col("part") == F.col("_part")))  # 256 rows a source that ends so
    tied = tied.withColumn("more", (number <= F.col("taken")).cast("long"))
    out = due.where("more IS NOT NULL").select(*kept, "certain", "more").unionByName(tied.select(*kept, "certain", "more"))
    return out.select(*kept, (F.col("certain") + F.col("more")).alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, seed: str = "mix", cells: int = CELLS) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken: one row for each row of `docs` (doc_id, text, source and any more).

    Every document of a source gets floor(target / source_size) whole copies for certain. The rest of the target is a sample of
    fixed size, in words, with unequal chances: a document's is p, in proportion to its size and 1 at most, and the documents with
    p of 1 have one more copy for certain. The others are ranked by U/(1-U) over p/(1-p) (Pareto order sampling), U being the document's random
    number, and taken from the front while the middle of a document lies within the words still due. So a source misses its target by
    half a document at most, and reruns agree.

    - A null or empty text has size 0 and takes 0 words. The random number is the doc_id's, without one the text's.
    - Ties go by doc_id, then by size; rows that share both are told apart by nothing and any may be taken, as many as fit.
    - A very long text is counted in one task. An empty table gives no rows. Columns beside the three play no part.
    - Words of a source are summed over `cells` cells; only the cell in which the sample ends is sorted. The table of sources, one row
      each, is ordered by code point in one task."""
    out = copies(docs, weights, cap, seed, cells, False)
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, seed: str = "mix", cells: int = CELLS) -> DataFrame:
    """The rows of `docs`, each as often as mix() takes it, with all their columns, whatever their names. Documents without words, which
    take no room in a mix, stay once. Whole rows are scanned and repeated where they are, never shuffled."""
    out = copies(docs, weights, cap, seed, cells, True)
    times = F.when(F.col("size") == 0, 1).otherwise(F.col("copies")).cast("int")
    out = out.withColumn("again", F.explode(F.array_repeat(F.lit(1), times)))
    return out.select("row.*")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, text, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, CAST(1 + (ROW_NUMBER() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS DOUBLE) AS weight, 3.0::DOUBLE * source_size AS most FROM per
), filled AS (
  SELECT *, (SUM(source_size) OVER ())::DOUBLE - COALESCE(SUM(most) OVER w, 0.0) AS left_over,
    SUM(weight) OVER () - COALESCE(SUM(weight) OVER w, 0.0) AS open
  FROM weighed WINDOW w AS (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT *, MAX(CASE WHEN left_over / open * weight <= most THEN left_over / open END) OVER () AS final FROM filled
), goal AS (
  SELECT source, source_size, LEAST(most, final * weight) AS target FROM levels
), ratios AS (
  SELECT *, FLOOR(COALESCE(target / NULLIF(source_size, 0), 0.0)) AS certain FROM goal
), lefts AS (
  SELECT *, GREATEST(target - certain * source_size, 0.0) AS left_words FROM ratios
), by_size AS (
  SELECT s.source, size, left_words, SUM(size) AS words, SUM(size::HUGEINT * size)::HUGEINT AS squares
  FROM sized s JOIN lefts l ON s.source IS NOT DISTINCT FROM l.source WHERE size > 0 GROUP BY s.source, size, left_words
), slopes AS (
  SELECT source, size, words, (left_words - COALESCE(SUM(words) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (SUM(squares) OVER (PARTITION BY source ORDER BY size ROWS UNBOUNDED PRECEDING))::DOUBLE AS slope FROM by_size
), chosen AS (
  SELECT source, arg_max(slope, size) AS slope FROM slopes WHERE slope * size <= 1 GROUP BY source
), whole AS (
  SELECT s.source, any_value(c.slope) AS slope, COALESCE(SUM(CASE WHEN c.slope * size >= 1 THEN words END), 0)::DOUBLE AS whole
  FROM slopes s JOIN chosen c ON s.source IS NOT DISTINCT FROM c.source GROUP BY s.source
), plan AS (
  SELECT l.*, COALESCE(slope, 0.0) AS slope, GREATEST(left_words - COALESCE(whole, 0.0), 0.0) AS need FROM lefts l LEFT JOIN whole w ON l.source IS NOT DISTINCT FROM w.source
), due AS (
  SELECT doc_id, s.source, size, source_size, target, certain, need, slope * size AS p,
    CAST('0x' || substr(md5('mix' || COALESCE(CAST(doc_id AS VARCHAR), 'text ' || COALESCE(text, ''))), 1, 13) AS UBIGINT)::DOUBLE / 4503599627370496.0 AS u
  FROM sized s JOIN plan g ON s.source IS NOT DISTINCT FROM g.source
), ranked AS (
  SELECT *, CASE WHEN p > 0 AND p < 1 THEN u / (1 - u) * ((1 - p) / p) END AS q FROM due
), summed AS (
  SELECT *, SUM(CASE WHEN q IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS upto FROM ranked
), counted AS (
  SELECT *, CAST(certain + CASE WHEN p >= 1 THEN 1 WHEN q IS NULL THEN 0 WHEN 2 * upto - size <= 2 * need THEN 1 ELSE 0 END AS BIGINT) AS copies FROM summed
)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM counted
"""
