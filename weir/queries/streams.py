"""The event queries as streams over the same file; their results must be those of the batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.catalog import query, table
from weir.operators.keyed import sessions
from weir.plans.durable import fresh_path
from weir.queries.ordered import PIPELINE_SQL, SESSION_SQL, windowed
from weir.sources.files import EVENTS
from weir.sources.ticks import Ticks
from weir.streaming import runs


#: Rows of a file that lands, about.
FILE_ROWS = 1_000_000


def _events(spark: SparkSession, sf_dir: str, order: tuple[int, ...] = (0, 1, 2, 3)) -> DataFrame:
    """The events as slices that landed one after the other, a micro-batch each; those without an id are in the last slice."""
    events = table(spark, sf_dir, "events")
    path = fresh_path(spark, "landed")
    n, last = events.agg(F.count("*"), F.max("event_id")).first()
    step, files = -(-((last or 0) + 1) // len(order)), n // (len(order) * FILE_ROWS) + 1
    for k in order:
        of = (F.col("event_id") >= k * step) & (F.col("event_id") < (k + 1) * step)
        part = events.filter(of | F.col("event_id").isNull() if k == len(order) - 1 else of)
        part.repartition(files).write.mode("append").parquet(path)
    return runs.rows(spark, path, EVENTS, files)


def _ntz(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query(PIPELINE_SQL)
def stream_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship transform on a stream."""
    return _ntz(runs.drain(windowed(runs.timed(_events(spark, sf_dir), "ts", "10 minutes")), "stream-pipeline", "complete"), "hour")


@query(SESSION_SQL)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = sessions(runs.timed(_events(spark, sf_dir), "ts", "10 minutes"), "user_id", "ts", "30 minutes")
    return _ntz(runs.drain(by, "stream-sessions", "complete"), "session_start", "session_end")


CLOSED_SQL = f"""SELECT * FROM ({PIPELINE_SQL}) WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"""


@query(CLOSED_SQL)
def stream_closed_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship transform in append mode: an hour leaves the state, once, when the watermark has passed it."""
    return _ntz(runs.drain(windowed(runs.timed(_events(spark, sf_dir), "ts", "10 minutes")), "stream-closed-hours"), "hour")


@query(f"SELECT * FROM ({SESSION_SQL}) WHERE session_end <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def stream_closed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions in append mode; those that the watermark hasn't passed stay open."""
    by = sessions(runs.timed(_events(spark, sf_dir), "ts", "10 minutes"), "user_id", "ts", "30 minutes")
    return _ntz(runs.drain(by, "stream-closed-sessions"), "session_start", "session_end")


@query("""SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM (SELECT *, (SELECT (max(event_id) + 4) // 4 FROM events) AS step FROM events)
WHERE event_id // step <> 1 GROUP BY 1 HAVING date_trunc('hour', min(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second slice lands last, when the watermark has passed all of its rows: they are dropped."""
    events = runs.timed(_events(spark, sf_dir, (0, 2, 3, 1)), "ts", "10 minutes")
    hours = events.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "n")
    return _ntz(runs.drain(hours, "stream-late"), "hour")


@query("SELECT event_id, user_id, event_type FROM events")
def stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event arrives twice and leaves once."""
    twice = runs.timed(_events(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))), "ts", "1 hour")
    return runs.drain(twice.dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id", "event_type"), "stream-distinct")


@query("""SELECT event_id, c_name, c_nationkey FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'purchase'""")
def stream_static_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    bought = _events(spark, sf_dir).filter("event_type = 'purchase'")
    joined = bought.join(table(spark, sf_dir, "customer"), F.col("user_id") == F.col("c_custkey")).select("event_id", "c_name", "c_nationkey")
    return runs.drain(joined, "stream-static-join")


@query("""SELECT a.event_id AS view_id, b.event_id AS click_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click'
AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR""")
def stream_stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = runs.timed(_events(spark, sf_dir).filter("event_type = 'view'"), "ts", "10 minutes").select(F.col("event_id").alias("view_id"), F.col("user_id").alias("viewer"), F.col("ts").alias("view_ts"))
    clicks = runs.timed(_events(spark, sf_dir).filter("event_type = 'click'"), "ts", "10 minutes").select(F.col("event_id").alias("click_id"), "user_id", "ts")
    close = F.expr("viewer = user_id AND ts >= view_ts AND ts <= view_ts + INTERVAL 1 HOUR")
    return runs.drain(views.join(clicks, close).select("view_id", "click_id"), "stream-stream-join")


@query("""SELECT user_id AS key, ts AS at, CAST(run AS BIGINT) AS length FROM (SELECT user_id, ts, event_type, row_number() OVER (PARTITION BY user_id, g, event_type = 'error' ORDER BY ts) AS run FROM (
SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM events)) WHERE event_type = 'error' AND run >= 3""")
def stream_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three errors of a user in a row, with state of our own."""
    events = _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    return _ntz(runs.drain(runs.streaks(events, "user_id", "ts", "event_type", "error", 3), "stream-streaks"), "at")


@query("SELECT range AS tick, CAST(range * range % 97 AS BIGINT) AS value FROM range(200)")
def stream_plugin_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.dataSource.register(Ticks)
    ticks = spark.readStream.format(Ticks.name()).option("n", 200).load()
    return runs.drain(ticks, "stream-ticks")
