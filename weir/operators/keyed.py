"""Operators on the rows of a key in an order: latest row, top rows, gaps, sessions, and rates of counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key, that with the greatest ``order``. An aggregate, so a hot key is combined before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    row = F.max_by(F.struct(*rest), F.struct(*order)).alias("row_")
    return df.groupBy(*key).agg(row).select(*key, "row_.*").select(df.columns)


def top(df: DataFrame, key: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key with their ``rank_no``; Spark drops most rows before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("rank_no", rank).filter(F.col("rank_no") <= k)


def sessions(df: DataFrame, key: str, time: str, gap: str) -> DataFrame:
    """``key, session_start, session_end, n``: runs of rows with less than ``gap`` between neighbours; the end is gap after the last."""
    s = F.session_window(time, gap)
    return df.groupBy(key, s.alias("s")).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def counter_rates(df: DataFrame, key: list[str], time: str, value: str, bits: int = 64, bucket_seconds: int = 86_400) -> DataFrame:
    """``delta`` and ``per_second`` since the key's row before, for counters that wrap around at 2 ** ``bits``.

    A value below the one before is taken as one wrap if that makes a step of less than half the range, else as a reset, when
    both are null. They are null for a key's first row and where the value is null. Rows of one time follow by value, rows without a
    time come first. A key is cut into stretches of time, each of which begins with the last row of the stretch before, so a key with
    very many rows is dealt over its stretches.
    """
    wide = "decimal(38,0)"
    place = F.struct(F.col(time).alias("at_"), F.col(value).cast(wide).alias("value_")).alias("own_")
    bucket = F.floor(F.unix_micros(F.col(time).cast("timestamp")) / F.lit(bucket_seconds * 1_000_000)).alias("bucket_")
    rows = df.select(*key, bucket, place, F.struct(*(c for c in df.columns if c not in ("delta", "per_second"))).alias("row_"))
    order = Window.partitionBy(*key).orderBy("bucket_")  # a row for each stretch
    last = rows.groupBy(*key, "bucket_").agg(F.max("own_").alias("own_")).withColumn("own_", F.lag("own_").over(order)).filter("own_ is not null")
    carried = last.select(*key, "bucket_", "own_", F.lit(None).cast(rows.schema["row_"].dataType).alias("row_"))
    before = Window.partitionBy(*key, "bucket_").orderBy(F.col("row_").isNotNull(), "own_")
    met = rows.unionByName(carried).withColumn("last_", F.lag("own_").over(before)).filter(F.col("row_").isNotNull())
    step = F.col("own_.value_") - F.col("last_.value_")
    wrapped = step + F.lit(str(1 << bits)).cast(wide)
    half = F.lit(str(1 << (bits - 1))).cast(wide)
    delta = F.when(step >= 0, step).when(wrapped < half, wrapped).cast("decimal(20,0)")
    seconds = (F.unix_micros(F.col("own_.at_").cast("timestamp")) - F.unix_micros(F.col("last_.at_").cast("timestamp"))) / F.lit(1e6)
    met = met.select("row_.*", delta.alias("delta"), seconds.alias("seconds_"))
    return met.withColumn("per_second", F.when(F.col("seconds_") > 0, F.col("delta").cast("double") / F.col("seconds_"))).drop("seconds_")
