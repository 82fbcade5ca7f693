"""Sources, sinks, serializers and whole pipelines: what is written is read back and must be the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.catalog import query, table
from weir.functions import jsonrows
from weir.operators import keyed
from weir.plans.durable import fresh_path
from weir.plans.pipeline import Pipeline
from weir.queries.ordered import PIPELINE_SQL
from weir.sinks import files as sinks
from weir.sources import files, polls
from weir.sources.ticks import Ticks

EVENTS_SQL = "SELECT event_id, ts, user_id, event_type, value, props FROM events"


def _round_trip(fmt: str):
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = fresh_path(spark, f"events-{fmt}")
        sinks.write(table(spark, sf_dir, "events"), fmt, path)
        return files.read(spark, fmt, path, files.EVENTS, **({"rowTag": "row"} if fmt == "xml" else {}))

    f.__name__ = f"round_trip_{fmt}"
    return f


for _fmt in ("json", "csv", "orc", "parquet", "xml"):
    query(EVENTS_SQL)(_round_trip(_fmt))


@query(EVENTS_SQL)
def encoded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    text = events.select(jsonrows.encode(*events.columns).alias("line"))
    return text.select(jsonrows.decode(F.col("line"), files.EVENTS).alias("r")).select(*(F.col("r")[c].alias(c) for c in events.columns))


def _through(serializer: str):
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        source = ("files", {"fmt": "parquet", "path": f"{sf_dir}/events.parquet", "schema": files.EVENTS})
        return Pipeline(source, [("encode", {"serializer": serializer}), ("decode", {"serializer": serializer, "schema": files.EVENTS})]).frame(spark)

    f.__name__ = f"serialized_{serializer}"
    return f


for _name in ("json", "csv"):
    query(EVENTS_SQL)(_through(_name))


@query("SELECT event_type, count(*) AS n, round(max(value), 4) AS top FROM events WHERE value > 10 GROUP BY 1")
def sql_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step of a pipeline as SQL text."""
    source = ("files", {"fmt": "parquet", "path": f"{sf_dir}/events.parquet", "schema": files.EVENTS})
    return Pipeline(source, [("sql", {"query": "SELECT event_type, count(*) AS n, round(max(value), 4) AS top FROM {rows} WHERE value > 10 GROUP BY event_type"})]).frame(spark)


@query("SELECT event_id, 'not json ' || CAST(event_id AS VARCHAR) AS line FROM events WHERE event_id % 10 = 3")
def damaged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that don't fit the schema are kept apart, whole."""
    events = table(spark, sf_dir, "events")
    path = fresh_path(spark, "damaged")
    bad = F.concat(F.lit("not json "), F.col("event_id").cast("string"))
    sinks.write(events.select(F.when(F.col("event_id") % 10 == 3, bad).otherwise(jsonrows.encode(*events.columns)).alias("value")), "text", path)
    _, lines = files.read_json(spark, path, files.EVENTS)
    return lines.select(F.regexp_extract("line", r"(\d+)$", 1).cast("bigint").alias("event_id"), "line")


@query("SELECT range AS tick, CAST(range * range % 97 AS BIGINT) AS value FROM range(1000)")
def plugin_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.dataSource.register(Ticks)
    return spark.read.format(Ticks.name()).option("n", 1000).load()


def landed_polls(spark: SparkSession, sf_dir: str) -> str:
    """The events as decoded polls of a 64-bit counter for each user, near the top of its range."""
    events = table(spark, sf_dir, "events")
    path = fresh_path(spark, "polls")
    count = (F.lit("18446744073709551615").cast("decimal(20,0)") - F.floor("value").cast("decimal(20,0)")).cast("string")
    oid = F.concat(F.lit("1.3.6.1.2.1.31.1.1.1.6."), F.col("user_id").cast("string"))
    sinks.write(events.select(F.lit("router").alias("device"), oid.alias("oid"), F.lit("Counter64").alias("type"), count.alias("value"), "ts"), "json", path)
    return path


@query("""SELECT user_id AS row_index, ts, CAST(CASE WHEN c >= p THEN c - p WHEN p - c > 9223372036854775808::HUGEINT THEN 18446744073709551616::HUGEINT + c - p END AS DECIMAL(20,0)) AS delta FROM (
SELECT user_id, ts, c, lag(c) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM (SELECT user_id, ts, 18446744073709551615::HUGEINT - CAST(floor(value) AS HUGEINT) AS c FROM events))""")
def poll_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = polls.read(spark, landed_polls(spark, sf_dir))
    return keyed.counter_rates(rows, ["device", "oid"], "ts", "number").select("row_index", "ts", "delta")


EVENT_PIPELINE = [
    ("filter", {"where": "event_type <> 'error'"}),
    ("derive", {"columns": {"k": "from_json(props, 'k bigint').k"}}),
    ("aggregate", {"by": ["window(ts, '1 hour') AS w", "event_type"], "values": {"n": "count(*)", "total": "round(sum(value), 4)", "k_sum": "sum(k)"}}),
    ("select", {"columns": ["w.start AS hour", "event_type", "n", "total", "k_sum"]}),
]


@query(PIPELINE_SQL)
def declared_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship pipeline from registered parts, to JSON files and back."""
    path = fresh_path(spark, "declared")
    source = ("files", {"fmt": "parquet", "path": f"{sf_dir}/events.parquet", "schema": files.EVENTS})
    Pipeline(source, EVENT_PIPELINE).run(spark, "json", path)
    return files.read(spark, "json", path, "hour timestamp_ntz, event_type string, n bigint, total double, k_sum bigint")
