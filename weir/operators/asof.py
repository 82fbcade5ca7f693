"""As-of join: to each row the last right row of its key at or before its time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, on: str, time: str, right_time: str, columns: list[str], tolerance: str | None = None, bucket_seconds: int = 86_400) -> DataFrame:
    """``left`` with ``columns`` and ``right_time`` of the last right row with ``right_time <= time``, null where there is none.

    Both sides are stacked, cut by key and stretch of time, and a window carries the last right row forward within each;
    no pair is made. What a stretch starts with comes from one row for each stretch of the key, so a key with very many rows
    is dealt over its stretches. tolerance: an interval such as ``1 hour``; older matches are null. Rows with a null key or
    time match nothing. Of right rows with equal times, the one with the greatest ``columns`` counts.
    """

    def bucket(c: Column) -> Column:
        return F.floor(F.unix_micros(c.cast("timestamp")) / F.lit(bucket_seconds * 1_000_000)).alias("bucket_")

    held = F.struct(F.col(right_time).alias("time_"), *columns).alias("held_")
    none = F.lit(None).cast(right.select(held).schema[0].dataType).alias("held_")
    lefts = left.select(F.col(on).alias("key_"), bucket(F.col(time)), F.col(time).alias("at_"), none, F.struct(*left.columns).alias("row_"))
    no_row = F.lit(None).cast(lefts.schema["row_"].dataType).alias("row_")
    rights = right.filter(F.col(on).isNotNull() & F.col(right_time).isNotNull()).select(F.col(on).alias("key_"), bucket(F.col(right_time)), F.col(right_time).alias("at_"), held, no_row)
    stacked = lefts.unionByName(rights)
    before = Window.partitionBy("key_").orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)  # a row for each stretch
    last = stacked.groupBy("key_", "bucket_").agg(F.max("held_").alias("held_")).withColumn("held_", F.last("held_", ignorenulls=True).over(before))
    no_time = F.lit(None).cast(lefts.schema["at_"].dataType).alias("at_")
    carried = last.filter(F.col("held_").isNotNull()).select("key_", "bucket_", no_time, "held_", no_row)
    # what is carried in comes first, and right rows before left rows of the same time
    order = Window.partitionBy("key_", "bucket_").orderBy("at_", F.col("row_").isNotNull(), "held_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = stacked.unionByName(carried).withColumn("last_", F.last("held_", ignorenulls=True).over(order)).filter(F.col("row_").isNotNull())
    fits = F.col("key_").isNotNull() & F.col("at_").isNotNull()
    if tolerance:
        fits &= F.col("last_.time_") >= F.col("at_") - F.expr(f"INTERVAL {tolerance}")
    return met.select("row_.*", *(F.when(fits, F.col(f"last_.{'time_' if c == right_time else c}")).alias(c) for c in [right_time, *columns]))
