"""Window functions, time windows, as-of and interval joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weir.catalog import query, table
from weir.functions import jsonrows
from weir.operators import keyed
from weir.operators.asof import asof_join
from weir.operators.intervals import interval_join


def windowed(events: DataFrame) -> DataFrame:
    """The flagship transform, for batches and streams: decoded properties of what isn't an error, by hour and type."""
    decoded = events.filter("event_type <> 'error'").withColumn("k", jsonrows.decode(F.col("props"), "k bigint")["k"])
    hours = decoded.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.sum("k").alias("k_sum"))
    return hours.select(F.col("w.start").alias("hour"), "event_type", "n", "total", "k_sum")


PIPELINE_SQL = """SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total,
CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum FROM events WHERE event_type <> 'error' GROUP BY 1, 2"""


@query(PIPELINE_SQL)
def event_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed(table(spark, sf_dir, "events"))


@query("""SELECT o_orderkey, CAST(row_number() OVER w AS INT) AS rn, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS INT) AS rk,
CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS INT) AS dr, CAST(ntile(4) OVER w AS INT) AS quarter,
round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, ties = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(w).alias("rn"), F.rank().over(ties).alias("rk"), F.dense_rank().over(ties).alias("dr"), F.ntile(4).over(w).alias("quarter"), F.round(F.percent_rank().over(w), 9).alias("pr"), F.round(F.cume_dist().over(w), 9).alias("cd"))


@query("""SELECT event_id, lag(value) OVER w AS before, lead(value, 2) OVER w AS after, first_value(event_type) OVER w AS first_type,
nth_value(event_id, 3) OVER w AS third, last_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_id
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def analytic(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, sf_dir, "events").select("event_id", F.lag("value").over(w).alias("before"), F.lead("value", 2).over(w).alias("after"), F.first("event_type").over(w).alias("first_type"), F.nth_value("event_id", 3).over(w).alias("third"), F.last("event_id").over(whole).alias("last_id"))


@query("""SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS running,
round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING), 6) AS moving,
count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW) AS recent FROM events""")
def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    recent = F.expr("count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW)")
    return table(spark, sf_dir, "events").select("event_id", F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("running"), F.round(F.avg("value").over(w.rowsBetween(-3, 1)), 6).alias("moving"), recent.alias("recent"))


@query("""SELECT event_type, event_id, value, CAST(rank_no AS INT) AS rank_no FROM (SELECT *, row_number() OVER (PARTITION BY event_type
ORDER BY value DESC, event_id) AS rank_no FROM events) WHERE rank_no <= 10""")
def top_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.top(table(spark, sf_dir, "events"), ["event_type"], [F.desc("value"), F.col("event_id")], 10).select("event_type", "event_id", "value", "rank_no")


@query("""SELECT event_id, ts, user_id, event_type, value, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id
ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.latest(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"])


@query("""SELECT e.event_id, s.ts AS signup_ts, s.value AS signup_value FROM events e ASOF LEFT JOIN
(SELECT user_id, ts, value FROM events WHERE event_type = 'signup') s ON e.user_id = s.user_id AND e.ts >= s.ts""")
def asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    signups = events.filter("event_type = 'signup'").select("user_id", F.col("ts").alias("signup_ts"), F.col("value").alias("signup_value"))
    return asof_join(events.select("event_id", "user_id", "ts"), signups, "user_id", "ts", "signup_ts", ["signup_value"]).select("event_id", "signup_ts", "signup_value")


@query("""SELECT e.event_id, s.event_id AS signup_id FROM events e JOIN events s ON s.event_type = 'signup' AND e.user_id = s.user_id
AND e.ts >= s.ts AND e.ts < s.ts + INTERVAL 3 HOURS""")
def interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    spans = events.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("signup_id"), F.col("ts").alias("start"), F.expr("ts + INTERVAL 3 HOURS").alias("stop"))
    return interval_join(events.select("event_id", "user_id", "ts"), spans, ["user_id"], "ts", "start", "stop", 3 * 3600).select("event_id", "signup_id")


@query("""SELECT hour + to_minutes(CAST(30 * k AS BIGINT)) - INTERVAL 30 MINUTES AS win_start, user_id, count(*) AS n FROM
(SELECT time_bucket(INTERVAL 30 MINUTES, ts) AS hour, user_id FROM events) CROSS JOIN (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2""")
def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return by.select(F.col("w.start").alias("win_start"), "user_id", "n")


SESSION_SQL = """SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTES AS session_end, count(*) AS n FROM (
SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (
SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s"""


@query(SESSION_SQL)
def session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.sessions(table(spark, sf_dir, "events"), "user_id", "ts", "30 minutes")


@query("""SELECT event_id, CAST(CASE WHEN step >= 0 THEN step WHEN step + 1000 < 500 THEN step + 1000 END AS DECIMAL(20,0)) AS delta FROM (
SELECT event_id, c - lag(c) OVER (PARTITION BY user_id ORDER BY ts) AS step FROM (SELECT event_id, user_id, ts, CAST(floor(value) AS BIGINT) AS c FROM events))
WHERE step IS NULL OR step IS NOT NULL""".replace("step + 1000 < 500 THEN step + 1000", "step + 65536 < 32768 THEN step + 65536"))
def counter_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.floor("value").cast("decimal(20,0)").alias("c"))
    return keyed.counter_rates(counts, ["user_id"], "ts", "c", bits=16).select("event_id", "delta")
