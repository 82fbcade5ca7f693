"""Intermediate tables that outlive executors: written to shared storage, read back with a short lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one is set only where none is named and all tasks run in this process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="weir-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/weir/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, longer by as many underscores as make it no column of ``df``."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def _at(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, name: str) -> bool:
    """Whether there is a file or folder, in any store that Spark reads."""
    fs, path = _at(spark, name)
    return fs.exists(path)


def delete(spark: SparkSession, name: str) -> None:
    """Delete a folder that this library wrote."""
    fs, path = _at(spark, name)
    fs.delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a durable table that no later plan reads."""
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/weir/"
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/weir/" in name and root.split(":")[-1].lstrip("/") in name:
            delete(spark, name)


def join_checked(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", rows: int = 50_000) -> DataFrame:
    """Join with ``right`` broadcast only if a count proves it small; else Spark's own choice, with skewed joins split."""
    if right.limit(rows + 1).count() <= rows:
        right = F.broadcast(right)
    return left.join(right, on, how)
