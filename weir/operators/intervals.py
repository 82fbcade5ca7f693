"""Interval join: left points with the right spans of their key that hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def interval_join(left: DataFrame, right: DataFrame, on: list[str], point: str, start: str, stop: str, bucket: float = 3600) -> DataFrame:
    """Rows with equal ``on`` and ``start <= point < stop``, of times (``bucket`` in seconds) or of numbers. ``on`` may be empty.

    The axis is cut into buckets, and into coarser ones, each twice as wide, for longer spans. A span is in the one or two buckets of
    its own width that it touches, however long it is; a point is in one bucket of each width that some span has. The join is an
    equality on key, width and bucket with an exact filter. Choose a bucket near the short spans' length. Empty and reversed
    spans, null bounds, null points and null keys match nothing.
    """

    def place(df: DataFrame, c: str) -> Column:
        time = isinstance(df.schema[c].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
        return F.unix_micros(F.col(c).cast("timestamp")) / F.lit(1e6) if time else F.col(c).cast("double")

    a, b = place(right, start), place(right, stop)
    width = F.lit(float(bucket)) * F.pow(F.lit(2.0), F.col("level_"))
    spans = right.filter(F.col(start) < F.col(stop)).withColumn("level_", F.greatest(F.ceil(F.log2((b - a) / bucket)), F.lit(0)).cast("int"))
    top = spans.agg(F.max("level_")).first()[0] or 0
    spans = spans.withColumn("bucket_", F.explode(F.sequence(F.floor(a / width), F.floor(b / width))))
    points = left.withColumn("level_", F.explode(F.sequence(F.lit(0), F.lit(top)))).withColumn("bucket_", F.floor(place(left, point) / width))
    met = points.join(spans, [*on, "level_", "bucket_"]).filter((F.col(point) >= F.col(start)) & (F.col(point) < F.col(stop)))
    return met.drop("level_", "bucket_")
