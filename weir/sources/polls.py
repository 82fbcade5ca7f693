"""SNMP polls that a collector has decoded and landed as JSON lines; the protocol itself isn't spoken here.

A line has ``device, oid, type, value, ts``, the value as text. Types are those of the management protocol's value syntax.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.sources.files import read_json

SCHEMA = "device string, oid string, type string, value string, ts timestamp_ntz"
NUMBERS = ("Integer32", "Counter32", "Counter64", "Gauge32", "Unsigned32", "TimeTicks")


def typed(raw: DataFrame) -> DataFrame:
    """``number`` holds all 64 unsigned bits, as a decimal; ``octets`` other values; ``table_oid`` and ``row_index`` split a column's OID."""
    is_number = F.col("type").isin(*NUMBERS)
    return raw.select(
        "device", "oid", "type", "ts",
        F.when(is_number, F.col("value").try_cast("decimal(20,0)")).alias("number"),
        F.when(~is_number, F.col("value")).alias("octets"),
        F.regexp_extract("oid", r"^(.*)\.(\d+)$", 1).alias("table_oid"),
        F.regexp_extract("oid", r"^(.*)\.(\d+)$", 2).try_cast("bigint").alias("row_index"),
    )


def read(spark: SparkSession, path: str, stream: bool = False, files_per_batch: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Typed rows, and lines that aren't polls."""
    good, bad = read_json(spark, path, SCHEMA, stream, files_per_batch)
    return typed(good), bad
