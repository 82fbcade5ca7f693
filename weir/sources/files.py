"""Local and shared files as sources, always with a declared schema; the same call in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.functions import jsonrows

FORMATS = ("parquet", "orc", "csv", "json", "text", "xml")
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read(spark: SparkSession, fmt: str, path: str, schema: str, stream: bool = False, files_per_batch: int | None = None, **options: str) -> DataFrame:
    """files_per_batch: what a stream takes at once (backpressure). A file must never change under its name: a stream won't see it."""
    if fmt not in FORMATS:
        raise ValueError(f"{fmt} is none of {', '.join(FORMATS)}")
    reader = (spark.readStream if stream else spark.read).format(fmt).schema(schema)
    if fmt in ("json", "csv", "xml"):
        reader = reader.options(**jsonrows.READ)
    if stream and files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.options(**options).load(path)


def read_json(spark: SparkSession, path: str, schema: str, stream: bool = False, files_per_batch: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows that fit the schema, and the lines that don't, as ``line``."""
    lines = read(spark, "text", path, "value string", stream, files_per_batch)
    decoded = lines.select("value", jsonrows.decode(F.col("value"), schema).alias("r"))
    fields = [c for c in decoded.schema["r"].dataType.fieldNames() if c != "damaged_"]
    bad = jsonrows.damaged(F.col("r"))
    good = decoded.filter(~bad).select(*(F.col("r")[c].alias(c) for c in fields))
    return good, decoded.filter(bad).select(F.col("value").alias("line"))
