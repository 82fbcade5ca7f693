"""Functions in Python."""

import math

import pytest
from pyspark.sql import functions as F

from weir.functions import python
from weir.queries import QUERIES


def test_geometric_means_at_their_bounds(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 2.0), (1, 8.0), (2, None), (3, nan), (4, -1.0), (4, 3.0), (5, 0.0), (5, 4.0), (6, None), (6, 9.0), (7, inf), (7, 0.0), (None, 5.0), (None, None), (2**53 + 1, 7.0)]
    df = spark.createDataFrame(rows, "k bigint, v double")
    want = {1: 4.0, 2: None, 3: None, 4: 3.0, 5: 0.0, 6: 9.0, 7: None, None: 5.0, 2**53 + 1: 7.0}
    for keys, by in ((df, lambda k: k), (df.withColumn("k", F.col("k").cast("string")), lambda k: None if k is None else str(k))):
        got = python.geometric_means(keys, "k", "v", "m")
        assert got.columns == ["k", "m"] and got.schema["k"].dataType == keys.schema["k"].dataType
        assert {r["k"]: r["m"] for r in got.collect()} == {by(k): v if v is None else pytest.approx(v) for k, v in want.items()}
    assert python.geometric_means(df.filter("false"), "k", "v", "m").count() == 0


def test_geometric_means_of_many_keys_and_of_a_hot_one(spark):
    df = spark.range(300_000, numPartitions=8).select(F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id")).alias("k"), (F.col("id") % 5 + 1).cast("double").alias("v"))
    got = python.geometric_means(df, "k", "v", "m")
    far = got.filter("k >= 0").filter(F.abs(F.col("m") - F.col("k") % 5 - 1) > 1e-9)
    assert got.count() == 150_001 and far.count() == 0
    assert got.filter("k = -1").first()["m"] == pytest.approx(math.prod(range(1, 6)) ** 0.2)


def test_python_is_not_called_for_each_key(spark, sf):
    plan = QUERIES["python_aggregate"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "AggregatePython" not in plan and "AggregateInPandas" not in plan
