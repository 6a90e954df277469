"""q55 to q60: event windows, grouping sets, window functions and joins over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lectern.sources.tables import table


def events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def q55_tumbling(spark, d):
    w = events(spark, d).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.unix_seconds("w.start").alias("start"), "event_type", "n", "total")


Q55 = "SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


def q56_sliding(spark, d):
    w = events(spark, d).groupBy(F.window("ts", "1 day", "6 hours").alias("w")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))
    return w.select(F.unix_seconds("w.start").alias("start"), "n", "users")


Q56 = "WITH x AS (SELECT (epoch(ts)::BIGINT // 21600 - k) * 21600 AS start, user_id FROM (SELECT date_trunc('second', ts) AS ts, user_id FROM events), range(4) t(k)) SELECT start::BIGINT AS start, count(*) AS n, count(DISTINCT user_id) AS users FROM x GROUP BY 1"


def q57_sessions(spark, d):
    s = events(spark, d).groupBy("user_id", F.session_window("ts", "4 hours").alias("s")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.unix_micros("s.start").alias("start"), "n")


Q57 = """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 4 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, k"""


def q58_grouping_sets(spark, d):
    li = table(spark, d, "lineitem")
    g = li.cube("l_returnflag", "l_linestatus").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(20,2)")).cast("double").alias("quantity"))
    return g


Q58 = "SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus)::BIGINT AS level, count(*) AS n, sum(l_quantity::DECIMAL(20, 2))::DOUBLE AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"


def q58_rollup(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.rollup("c_nationkey", "o_orderstatus").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("most"))


Q58R = "SELECT c_nationkey, o_orderstatus, count(*) AS n, max(o_totalprice) AS most FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ROLLUP (c_nationkey, o_orderstatus)"


def q58_percentiles(spark, d):
    """Approximate distinct counts and percentiles beside the exact ones: whether they are within their stated error."""
    li = table(spark, d, "lineitem")
    # Beside a distinct count of an aggregation every other one keeps its sketch for each pair of flag and part: each is counted in a step of its own,
    # exact percentiles from how often each quantity is there.
    about = li.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("about"), F.percentile_approx("l_quantity", 0.9, 10000).alias("about90"))
    parts = li.select("l_returnflag", "l_partkey").distinct().groupBy("l_returnflag").agg(F.count("l_partkey").alias("parts"))
    often = li.groupBy("l_returnflag", "l_quantity").agg(F.count("*").alias("n")).groupBy("l_returnflag").agg(F.percentile("l_quantity", 0.9, F.col("n")).alias("p90"), F.percentile("l_quantity", 0.5, F.col("n")).alias("median"))
    x = about.unionByName(parts, allowMissingColumns=True).unionByName(often, allowMissingColumns=True).groupBy("l_returnflag").agg(*[F.max(c).alias(c) for c in ("about", "about90", "parts", "p90", "median")])
    return x.select("l_returnflag", "parts", (F.abs(F.col("about") - F.col("parts")) <= 0.1 * F.col("parts")).alias("close"), F.round("p90", 4).alias("p90"), (F.abs(F.col("about90") - F.col("p90")) <= 1).alias("close90"), F.round("median", 4).alias("median"))


Q58P = "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, true AS close, round(quantile_cont(l_quantity, 0.9), 4) AS p90, true AS close90, round(median(l_quantity), 4) AS median FROM lineitem GROUP BY 1"


def q59_windows(spark, d):
    o = table(spark, d, "orders")
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select(
        "o_orderkey", F.row_number().over(w).alias("n"), F.lead("o_orderkey").over(w).alias("next"), F.ntile(3).over(w).alias("third"), F.round(F.percent_rank().over(w), 6).alias("share"), F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("last3"),
        F.dense_rank().over(W.partitionBy("o_custkey").orderBy("o_orderstatus")).alias("status_rank"),
    )


Q59 = """SELECT o_orderkey, row_number() OVER w AS n, lead(o_orderkey) OVER w AS next, ntile(3) OVER w AS third, round(percent_rank() OVER w, 6) AS share, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last3,
  dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS status_rank FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"""


def q60_joins(spark, d):
    """Semi, anti and full outer joins in one table of counts."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    n = table(spark, d, "nation")
    key = F.col("c_custkey") == F.col("o_custkey")
    full = n.where("n_regionkey < 3").join(c.groupBy("c_nationkey").agg(F.count("*").alias("k")), F.col("n_nationkey") == F.col("c_nationkey"), "full")
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("join"), "n")
    return one("semi", c.join(o, key, "left_semi")).unionByName(one("anti", c.join(o, key, "left_anti"))).unionByName(one("full", full))


Q60 = """SELECT 'semi' AS join, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) UNION ALL SELECT 'anti', count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
UNION ALL SELECT 'full', count(*) FROM (SELECT * FROM nation WHERE n_regionkey < 3) FULL JOIN (SELECT c_nationkey, count(*) FROM customer GROUP BY 1) ON n_nationkey = c_nationkey"""


def q60_as_of(spark, d):
    """For each purchase the user's last view before it: one sort of both kinds together, no join of all pairs."""
    e = events(spark, d).where("event_type IN ('view', 'purchase')")
    w = W.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "view", 0).otherwise(1), "event_id").rowsBetween(W.unboundedPreceding, 0)
    seen = e.withColumn("view", F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w))
    return seen.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase"), "view")


Q60A = """WITH v AS (SELECT user_id, ts, max(event_id) AS view FROM events WHERE event_type = 'view' GROUP BY user_id, ts)
SELECT p.event_id AS purchase, v.view FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts"""


def q60_range(spark, d):
    """Orders of each customer within thirty days after another of theirs, met in buckets of thirty days."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).alias("day"))
    a = o.select("o_custkey", "day", F.col("o_orderkey").alias("first"), F.explode(F.array(F.floor(F.col("day") / 30), F.floor(F.col("day") / 30) + 1)).alias("bucket"))
    b = o.select(F.col("o_custkey").alias("c"), F.col("day").alias("later"), F.col("o_orderkey").alias("second"), F.floor(F.col("day") / 30).alias("bucket"))
    pairs = a.join(b, (F.col("o_custkey") == F.col("c")) & (a["bucket"] == b["bucket"])).where("later > day AND later - day <= 30")
    return pairs.groupBy("first").agg(F.count("*").alias("n"), F.min("later").alias("soonest")).select("first", "n", (F.col("soonest")).alias("soonest"))


Q60R = """WITH o AS (SELECT o_custkey, o_orderkey, CAST(date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS INTEGER) AS day FROM orders)
SELECT a.o_orderkey AS first, count(*) AS n, min(b.day) AS soonest FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND b.day > a.day AND b.day - a.day <= 30 GROUP BY 1"""

QUERIES = {f.__name__: f for f in (q55_tumbling, q56_sliding, q57_sessions, q58_grouping_sets, q58_rollup, q58_percentiles, q59_windows, q60_joins, q60_as_of, q60_range)}
ORACLES = {"q55_tumbling": Q55, "q56_sliding": Q56, "q57_sessions": Q57, "q58_grouping_sets": Q58, "q58_rollup": Q58R, "q58_percentiles": Q58P, "q59_windows": Q59, "q60_joins": Q60, "q60_as_of": Q60A, "q60_range": Q60R}
