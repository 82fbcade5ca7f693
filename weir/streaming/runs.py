"""Streams: event-time windows, de-duplication, state, and runs to the end of what is there."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weir.plans.durable import fresh_path
from weir.sinks.files import once_per_batch, write


def timed(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """With a watermark; those need instants, so a time without zone is taken in the session's."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def drain(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """Run over all that is there, and what came out. In complete mode that is the last batch's result.

    With the same ``checkpoint`` and ``out``, a later run goes on where the last one ended; a batch that failed is run
    again in its place. Nothing is collected: batches are files in the shared folder.
    """
    spark = stream.sparkSession
    checkpoint, out = checkpoint or fresh_path(spark, f"{name}-checkpoint"), out or fresh_path(spark, name)
    put = once_per_batch(out) if mode == "append" else lambda batch, _: write(batch, "parquet", f"{out}/batch=0", mode="overwrite")
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(*(f"{out}/batch=*",))


def rows(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def streaks(stream: DataFrame, key: str, time: str, kind: str, value: str, least: int, groups: int = 1024) -> DataFrame:
    """``key, at, length``: each row that is the ``least``-th or a later one in a row with ``kind = value``. State: the runs so far.

    Rows of a key are taken in order of time within a batch, those without a time last, and batches in order of arrival. Keys share
    ``groups`` states by hash, each with the keys whose run is open, so the calls into Python don't grow with the keys; a call takes its
    group's rows of one batch. Without a key is a key, in a group of its own.
    """

    def step(g: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(batches), ignore_index=True)
        codes, keys = pd.factorize(got["key"].to_numpy())
        order = np.lexsort((got["at"].to_numpy(), codes))
        codes, at, hit = codes[order], got["at"].to_numpy()[order], got["hit"].to_numpy(bool)[order]
        opened = dict(zip(*state.get)) if state.exists else {}
        before = np.fromiter((opened.pop(k, 0) for k in keys.tolist()), np.int64, len(keys))
        row = np.arange(len(codes))
        first, last = np.searchsorted(codes, np.arange(len(keys))), np.searchsorted(codes, np.arange(len(keys)), "right") - 1
        miss = np.maximum.accumulate(np.where(hit, -1, row))
        unbroken = miss < first[codes]
        run = np.where(unbroken, row - first[codes] + 1 + before[codes], row - miss)
        opened.update((k, n) for k, n in zip(keys.tolist(), run[last].tolist()) if n)
        if opened:
            state.update((list(opened), list(opened.values())))
        elif state.exists:
            state.remove()
        far = run >= least
        yield pd.DataFrame({"none": np.full(far.sum(), g[0] < 0), "key": keys[codes[far]], "at": at[far], "length": run[far]})

    k, at, end = F.col(key).cast("bigint"), F.unix_micros(F.col(time).cast("timestamp")), F.lit(2**63 - 1)
    narrow = stream.select(
        F.when(k.isNull(), -1).otherwise(F.pmod(F.xxhash64(k), F.lit(groups))).cast("int").alias("g"),
        F.coalesce(k, F.lit(0)).cast("bigint").alias("key"), F.coalesce(at, end).alias("at"), F.coalesce(F.col(kind) == value, F.lit(False)).alias("hit"),
    )
    found = narrow.groupBy("g").applyInPandasWithState(step, "none boolean, key bigint, at bigint, length bigint", "keys array<bigint>, runs array<bigint>", "append", GroupStateTimeout.NoTimeout)
    return found.select(F.when(~F.col("none"), F.col("key")).alias("key"), F.when(F.col("at") < end, F.timestamp_micros("at")).alias("at"), "length")
