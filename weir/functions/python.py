"""Functions in Python for what has no built-in form: on columns, on groups, and to rows. All go through Arrow or an iterator of rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def words_reversed(texts: pd.Series) -> pd.Series:
    """The words of each text, split by single blanks, in reverse; null stays null."""
    return texts.map(lambda t: " ".join(reversed(t.split(" "))), na_action="ignore")


def geometric_means(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """``key, name``: the geometric mean of a key's positive numbers; null for a key without any, negative numbers are left out.

    Python adds up what is in a batch of rows, for all of its keys at once, and Spark adds up the batches: no call for each key, and no
    key's rows have to be in one task.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with np.errstate(divide="ignore", invalid="ignore"):
                logs = np.log(batch["value"].to_numpy(zero_copy_only=False))
            rows = pa.table({"key": batch["key"], "log": pa.array(logs, pa.float64(), from_pandas=True)})
            yield from rows.group_by("key").aggregate([("log", "sum"), ("log", "count")]).select(["key", "log_sum", "log_count"]).to_batches()

    rows = df.select(F.col(key).alias("key"), F.col(value).cast("double").alias("value"))
    schema = T.StructType([rows.schema["key"], T.StructField("total", T.DoubleType()), T.StructField("n", T.LongType())])
    mean = F.exp(F.try_divide(F.sum("total"), F.sum("n")))
    return rows.mapInArrow(sums, schema).groupBy(F.col("key").alias(key)).agg(F.nullif(mean, F.lit(float("nan"))).alias(name))


@F.udtf(returnType=T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]))
class JsonPairs:
    """A row for each key of a JSON object; none for null or for text that is no object."""

    def eval(self, text: str) -> Iterator[tuple[str, str]]:
        try:
            pairs = json.loads(text) if text is not None else None
        except ValueError:
            return
        if isinstance(pairs, dict):
            for key, value in pairs.items():
                yield key, value if isinstance(value, str) else json.dumps(value)
