"""Runs of events with state of our own."""

import random
from datetime import datetime, timedelta

import pytest

from weir.plans.durable import fresh_path
from weir.streaming import runs

SCHEMA = "k bigint, t timestamp_ntz, v string"


def plain(batches, least):
    """By key: batches as they arrive, rows in order of time, those without a time last."""
    run, out = {}, []
    for batch in batches:
        for k, t, v in sorted(batch, key=lambda r: (r[1] is None, r[1] or datetime.min)):
            run[k] = run.get(k, 0) + 1 if v == "x" else 0
            if run[k] >= least:
                out.append((k, t, run[k]))
    return sorted(out, key=str)


@pytest.mark.parametrize("groups", [1, 3, 1024])
def test_streaks_over_batches_and_restarts(spark, groups):
    """Keys that share a state, come and go, have no id or no time; far ids; a run that goes on in another session of the stream."""
    dice = random.Random(groups)
    ids = [None, 0, -1, 2**53, 2**53 + 1, 2**63 - 1, *range(100, 110)]
    minute = iter(dice.sample(range(10_000), 2000))
    path, checkpoint, out = (fresh_path(spark, f"streaks-{x}") for x in ("in", "checkpoint", "out"))
    batches = []
    for b in range(4):
        some = dice.sample(ids, 12)
        batches.append([(dice.choice(some), datetime(2024, 1, 1) + timedelta(minutes=next(minute), microseconds=1), dice.choice(["x", "x", "x", "y", None])) for _ in range(150)])
        batches[-1] += [(k, None, "x") for k in some[:5]]
        spark.createDataFrame(batches[-1], SCHEMA).coalesce(1).write.mode("append").parquet(path)
        got = runs.drain(runs.streaks(runs.rows(spark, path, SCHEMA), "k", "t", "v", "x", 3, groups), "streaks", checkpoint=checkpoint, out=out)
        got = [(r["key"], r["at"], r["length"]) for r in got.collect()]
        assert sorted(got, key=str) == plain(batches, 3)


def test_streaks_hold_no_state_for_each_key(spark, sf):
    path = fresh_path(spark, "streaks-state")
    spark.read.parquet(f"{sf}/events.parquet").select("user_id", "ts", "event_type").repartition(2).write.parquet(path)
    stream = runs.rows(spark, path, "user_id bigint, ts timestamp_ntz, event_type string")
    found = runs.streaks(stream, "user_id", "ts", "event_type", "error", 3, 16)
    assert [f.dataType.simpleString() for f in found.schema] == ["bigint", "timestamp", "bigint"] and found.columns == ["key", "at", "length"]
    query = found.writeStream.format("noop").option("checkpointLocation", fresh_path(spark, "streaks-state-checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert len(states) >= 2 and 0 < max(states) <= 16 < spark.read.parquet(path).select("user_id").distinct().count()
