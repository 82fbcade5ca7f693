"""Edge cases of the operators, and what pipelines promise: recovery, single delivery, damaged lines, late rows."""

from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weir.functions import jsonrows
from weir.operators import keyed
from weir.operators.asof import asof_join
from weir.operators.intervals import interval_join
from weir.plans import pipeline
from weir.plans.durable import discard, durable, fresh_path, join_checked, shared_dir
from weir.sinks.files import once_per_batch
from weir.sources import files, polls
from weir.streaming import runs

T = datetime(2024, 1, 1)


def at(minutes):
    return None if minutes is None else T + timedelta(minutes=minutes)


def test_asof_ties_nulls_and_tolerance(spark):
    left = spark.createDataFrame([(1, "a", at(5)), (2, "a", at(0)), (3, "b", at(5)), (4, None, at(5)), (5, "a", None), (6, "a", at(90)), (6, "a", at(90))], "id int, k string, t timestamp_ntz")
    right = spark.createDataFrame([("a", at(1), 1), ("a", at(5), 2), ("a", at(5), 3), (None, at(0), 4), ("a", None, 5), ("b", at(6), 6)], "k string, rt timestamp_ntz, v int")
    got = asof_join(left, right, "k", "t", "rt", ["v"])
    assert sorted((r["id"], r["v"]) for r in got.collect() if r["v"] is not None) == [(1, 3), (6, 3), (6, 3)] and got.count() == 7
    near = asof_join(left, right, "k", "t", "rt", ["v"], tolerance="1 hour").filter("v is not null").collect()
    assert [(r["id"], r["rt"]) for r in near] == [(1, at(5))]
    assert asof_join(left.filter("false"), right, "k", "t", "rt", ["v"]).count() == 0
    assert asof_join(left, right.filter("false"), "k", "t", "rt", ["v"]).filter("v is null").count() == 7


@pytest.mark.parametrize("seconds", [60, 3600, 86_400])
def test_asof_carries_over_stretches_of_time(spark, seconds):
    left = spark.createDataFrame([(i, "a" if i % 3 else "b", at(i * 7)) for i in range(200)], "id int, k string, t timestamp_ntz")
    rows = [("a", at(i * 101), i) for i in range(14)] + [("b", at(333), 99)]
    right = spark.createDataFrame(rows, "k string, rt timestamp_ntz, v int")
    got = {r["id"]: r["v"] for r in asof_join(left, right, "k", "t", "rt", ["v"], bucket_seconds=seconds).collect()}
    assert got == {i: max(((t, v) for k, t, v in rows if k == ("a" if i % 3 else "b") and t <= at(i * 7)), default=(None, None))[1] for i in range(200)}


def test_asof_deals_a_key_over_time_and_makes_no_pairs(spark):
    df = spark.range(10).select(F.col("id").alias("k"), F.lit(at(0)).alias("t"))
    plan = asof_join(df, df.select("k", F.col("t").alias("rt"), F.lit(1).alias("v")), "k", "t", "rt", ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "windowspecdefinition(key_" in plan and ", bucket_" in plan


def test_intervals_at_their_bounds(spark):
    points = spark.createDataFrame([(i, at(m)) for i, m in enumerate([0, 59, 60, 61, 180, None])], "p int, t timestamp_ntz").withColumn("k", F.lit(1))
    spans = spark.createDataFrame([(1, at(0), at(60)), (2, at(60), at(60)), (3, at(90), at(30)), (4, at(59), at(1000)), (5, None, at(5))], "s int, a timestamp_ntz, b timestamp_ntz").withColumn("k", F.lit(1))
    got = interval_join(points, spans, ["k"], "t", "a", "b").select("p", "s").collect()
    assert sorted(map(tuple, got)) == [(0, 1), (1, 1), (1, 4), (2, 4), (3, 4), (4, 4)]


def test_intervals_of_any_length_make_few_rows(spark):
    points = spark.createDataFrame([(i, float(i) * 37.3) for i in range(300)], "p int, x double")
    rows = [(i, float(i * 11), float(i * 11 + 2**i)) for i in range(20)] + [(99, None, 1.0), (98, 0.0, None)]
    spans = spark.createDataFrame(rows, "s int, a double, b double")
    got = interval_join(points, spans, [], "x", "a", "b", 1.0)
    want = sorted((i, s) for i in range(300) for s, a, b in rows[:20] if a <= i * 37.3 < b)
    assert sorted(map(tuple, got.select("p", "s").collect())) == want
    dealt = interval_join(spans.select(F.col("a").alias("x")), spans, [], "x", "a", "b", 1.0)
    assert "CartesianProduct" not in dealt._jdf.queryExecution().executedPlan().toString() and "NestedLoop" not in dealt._jdf.queryExecution().executedPlan().toString()
    assert interval_join(points, spans.filter("false"), [], "x", "a", "b").count() == 0


def test_latest_and_top_with_ties(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), (None, 5, None), ("b", None, "n")], "k string, o int, v string")
    assert sorted(((r["k"] or ""), r["v"]) for r in keyed.latest(df, ["k"], ["o", "v"]).collect()) == [("", None), ("a", "z"), ("b", "n")]
    assert keyed.top(df, ["k"], [F.desc("o"), F.desc("v")], 1).filter("k = 'a'").first()["v"] == "z"
    assert keyed.latest(df.filter("false"), ["k"], ["o"]).count() == 0


def test_counters_wrap_and_reset(spark):
    top = (1 << 64) - 1
    rows = [("c", at(i), Decimal(v)) for i, v in enumerate([5, 10, top, 3, 2])] + [("g", at(0), None), ("g", at(1), Decimal(4))]
    got = keyed.counter_rates(spark.createDataFrame(rows, "k string, t timestamp_ntz, v decimal(20,0)"), ["k"], "t", "v").orderBy("k", "t").collect()
    assert [r["delta"] for r in got] == [None, 5, top - 10, 4, None, None, None]
    assert got[1]["per_second"] == pytest.approx(5 / 60)


@pytest.mark.parametrize("seconds", [60, 3600, 10**9])
def test_counters_over_stretches_of_time(spark, seconds):
    rows = [("a" if i % 3 else None, at(i * 13 % 997), Decimal(i * i % 500)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, v decimal(20,0)")
    got = {(r["k"], r["t"]): r["delta"] for r in keyed.counter_rates(df, ["k"], "t", "v", 16, seconds).collect()}
    for k in ("a", None):
        own = sorted((t, v) for key, t, v in rows if key == k)
        want = [None] + [b - a if b >= a else None for (_, a), (_, b) in zip(own, own[1:])]
        assert [got[k, t] for t, _ in own] == [w if w is None or w >= 0 else None for w in want]


def test_polls_keep_all_bits(spark):
    path = fresh_path(spark, "polls-test")
    lines = ['{"device":"d","oid":"1.3.6.1.7","type":"Counter64","value":"18446744073709551615","ts":"2024-01-01T00:00:00.000001"}', '{"device":"d","oid":"1.3","type":"OctetString","value":"up","ts":null}', "{broken", '{"device":"d","oid":"x","type":"Gauge32","value":"not a number","ts":"2024-01-01T00:00:00.000000"}']
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    good, bad = polls.read(spark, path)
    rows = {r["oid"]: r for r in good.collect()}
    assert rows["1.3.6.1.7"]["number"] == (1 << 64) - 1 and rows["1.3.6.1.7"]["row_index"] == 7 and rows["1.3.6.1.7"]["ts"].microsecond == 1
    assert rows["1.3"]["octets"] == "up" and rows["1.3"]["number"] is None and rows["x"]["number"] is None
    assert [r["line"] for r in bad.collect()] == ["{broken"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.one_of(st.none(), st.text(max_size=12).filter(lambda s: s.isprintable())), st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)), st.one_of(st.none(), st.datetimes(datetime(1970, 1, 2), datetime(2100, 1, 1)))), min_size=1, max_size=6))
def test_json_round_trip(spark, rows):
    schema = "s string, n bigint, t timestamp_ntz"
    df = spark.createDataFrame(rows, schema)
    got = df.select(jsonrows.decode(jsonrows.encode("s", "n", "t"), schema).alias("r")).select("r.s", "r.n", "r.t").collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(rows, key=key)


def slices(spark, path, sf, order):
    events = spark.read.parquet(f"{sf}/events.parquet")
    n = events.count()
    for k in order:
        events.filter(F.floor(F.col("event_id") * 4 / F.lit(n)) == k).coalesce(1).write.mode("append").parquet(path)
        yield k


def test_stream_resumes_where_it_stood(spark, sf):
    path, checkpoint, out = (fresh_path(spark, x) for x in ("resume-in", "resume-checkpoint", "resume-out"))
    seen = []
    for _ in slices(spark, path, sf, range(4)):
        got = runs.drain(runs.rows(spark, path, files.EVENTS), "resume", checkpoint=checkpoint, out=out)
        seen.append((got.count(), got.select("event_id").distinct().count()))
    assert seen == [(2500 * k, 2500 * k) for k in range(1, 5)]
    again = runs.drain(runs.rows(spark, path, files.EVENTS), "resume", checkpoint=checkpoint, out=out)
    assert again.count() == 10000


def test_rows_two_batches_late_are_dropped(spark, sf):
    path = fresh_path(spark, "late-in")
    list(slices(spark, path, sf, (0, 2, 3, 1)))
    hours = runs.timed(runs.rows(spark, path, files.EVENTS), "ts", "10 minutes").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    total = runs.drain(hours.select(F.col("w.start").alias("hour"), "event_type", "n"), "late").agg(F.sum("n")).first()[0]
    assert 7000 < total <= 7500  # slice 1 came after the watermark had passed it


def test_pipeline_in_batch_and_as_a_stream(spark, sf):
    path, out, checkpoint, batch = (fresh_path(spark, x) for x in ("p-in", "p-out", "p-checkpoint", "p-batch"))
    list(slices(spark, path, sf, range(2)))
    steps = [("filter", {"where": "event_type <> 'error'"}), ("derive", {"columns": {"twice": "value * 2"}}), ("drop", {"columns": ["props"]}), ("rename", {"names": {"twice": "double_value"}})]
    p = pipeline.Pipeline(("files", {"fmt": "parquet", "path": path, "schema": files.EVENTS}), steps)
    p.run(spark, "parquet", batch, ("event_type",))
    p.start(spark, "parquet", out, checkpoint).awaitTermination()
    p.start(spark, "parquet", out, checkpoint).awaitTermination()  # nothing new: nothing more
    key = lambda df: sorted((r["event_id"], r["event_type"], r["double_value"]) for r in df.collect())
    assert key(spark.read.parquet(batch)) == key(spark.read.parquet(f"{out}/batch=*"))
    with pytest.raises(ValueError):
        files.read(spark, "avro", path, files.EVENTS)


def test_a_name_is_registered_once(spark):
    for kind, of in ((pipeline.source, pipeline.SOURCES), (pipeline.transform, pipeline.TRANSFORMS), (pipeline.sink, pipeline.SINKS)):
        taken = next(iter(of))
        before = of[taken]
        with pytest.raises(ValueError, match="already"):
            kind(taken)(lambda *a, **k: None)
        assert of[taken] is before
    with pytest.raises(ValueError, match="already"):
        pipeline.serializer("json", None, None)


def test_damaged_text_is_kept_apart(spark):
    df = spark.createDataFrame([('{"a": 1}',), ("{broken",), ('{"a": "x"}',), (None,)], "value string")
    good, bad = (pipeline.TRANSFORMS["decode"](df, serializer="json", schema="a int", damaged=d).collect() for d in (False, True))
    assert [r["a"] for r in good] == [1, None] and sorted(r["value"] for r in bad) == ['{"a": "x"}', "{broken"]


@pytest.mark.parametrize("when", ["half", "all"])
def test_a_crash_inside_a_batch_loses_and_doubles_nothing(spark, sf, monkeypatch, when):
    """The sink dies in the third batch, after half of its rows or all of them are written; the next run delivers the batch again."""
    path, out, checkpoint = (fresh_path(spark, x) for x in ("crash-in", "crash-out", "crash-checkpoint"))
    died = []

    def fragile(df, at, partition_by=(), mode="errorifexists"):
        if at.endswith("batch=2") and not died:
            died.append(at)
            (df.filter("event_id % 2 = 0") if when == "half" else df).write.mode(mode).parquet(at)
            raise OSError("the disk is gone")
        df.write.mode(mode).parquet(at)

    monkeypatch.setitem(pipeline.SINKS, "fragile", fragile)
    list(slices(spark, path, sf, range(4)))
    p = pipeline.Pipeline(("files", {"fmt": "parquet", "path": path, "schema": files.EVENTS, "files_per_batch": 1}))
    with pytest.raises(Exception, match="the disk is gone"):
        p.start(spark, "fragile", out, checkpoint).awaitTermination()
    assert died and spark.read.parquet(f"{out}/batch=*").count() < 10_000
    p.start(spark, "fragile", out, checkpoint).awaitTermination()
    got = spark.read.parquet(f"{out}/batch=*")
    assert (got.count(), got.select("event_id").distinct().count()) == (10_000, 10_000)


def test_state_survives_a_crash_inside_a_batch(spark, sf):
    path, out, checkpoint = (fresh_path(spark, x) for x in ("state-in", "state-out", "state-checkpoint"))
    list(slices(spark, path, sf, range(4)))
    hours = runs.timed(runs.rows(spark, path, files.EVENTS), "ts", "10 minutes").groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select("w.start", "n")
    put, died = once_per_batch(out), []

    def fragile(batch, i):
        put(batch, i)
        if i == 2 and not died:
            died.append(i)
            raise OSError("the power is out")

    start = lambda: hours.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(fragile).start()
    with pytest.raises(Exception, match="the power is out"):
        start().awaitTermination()
    start().awaitTermination()
    got = {r["start"]: r["n"] for r in spark.read.parquet(f"{out}/batch=*").collect()}
    events = spark.read.parquet(f"{sf}/events.parquet")
    want = {r["h"]: r["n"] for r in events.groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.count("*").alias("n")).collect()}
    assert len(got) >= len(want) - 2 and all(want[h] == n for h, n in got.items())


def test_no_local_folder_on_a_cluster(spark):
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session)


def test_durable_tables_and_checked_joins(spark):
    df = durable(spark.range(10).withColumn("v", F.col("id") * 2), "t")
    assert df.count() == 10
    for rows, broadcast in ((50_000, True), (3, False)):
        joined = join_checked(df, df.withColumnRenamed("v", "w"), ["id"], rows=rows)
        assert joined.count() == 10 and ("ResolvedHint" in joined._jdf.queryExecution().analyzed().toString()) == broadcast
    discard(df)
    with pytest.raises(Exception):
        df.count()
