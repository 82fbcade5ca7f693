"""A pipeline: a source, transforms and a sink by name; one definition runs in batch and as a stream, local or on a cluster.

Sources, transforms, sinks and serializers are registered by name; a name that is taken can't be registered again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weir.functions import jsonrows
from weir.sinks import files as sinks
from weir.sources import files, polls

SOURCES: dict[str, Callable[..., DataFrame]] = {}
TRANSFORMS: dict[str, Callable[..., DataFrame]] = {}
SINKS: dict[str, Callable[..., None]] = {}
SERIALIZERS: dict[str, Serializer] = {}


@dataclass(frozen=True)
class Serializer:
    """encode: a row's columns, by name, to text; decode: text and a schema to a struct with ``damaged_``, which is null where the text fits."""

    encode: Callable[..., Column]
    decode: Callable[[Column, str], Column]


def _register(kind: str, of: dict, name: str, what):
    if name in of:
        raise ValueError(f"there is a {kind} named {name} already")
    of[name] = what
    return what


def source(name: str) -> Callable:
    """Register a source: ``f(spark, stream=False, **options) -> DataFrame``."""
    return lambda f: _register("source", SOURCES, name, f)


def transform(name: str) -> Callable:
    """Register a transform: ``f(df, **options) -> DataFrame``, of operations that batches and streams both have."""
    return lambda f: _register("transform", TRANSFORMS, name, f)


def sink(name: str) -> Callable:
    """Register a sink: ``f(df, path, partition_by=(), mode="errorifexists")``; ``overwrite`` replaces what is at the path."""
    return lambda f: _register("sink", SINKS, name, f)


def serializer(name: str, encode: Callable[..., Column], decode: Callable[[Column, str], Column]) -> Serializer:
    """Register a serializer."""
    return _register("serializer", SERIALIZERS, name, Serializer(encode, decode))


for _fmt in files.FORMATS:
    sink(_fmt)(lambda df, path, partition_by=(), mode="errorifexists", fmt=_fmt: sinks.write(df, fmt, path, partition_by, mode))

_DAMAGED = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "damaged_"}
_CSV = {**{k: v for k, v in jsonrows.WRITE.items() if k.startswith("timestamp")}, "nullValue": "\\N", "emptyValue": ""}
serializer("json", jsonrows.encode, jsonrows.decode)
serializer("csv", lambda *columns: F.to_csv(F.struct(*columns), _CSV), lambda text, schema: F.from_csv(text, f"{schema}, damaged_ string", {**_CSV, **_DAMAGED}))


@source("files")
def _files(spark: SparkSession, stream: bool = False, **options) -> DataFrame:
    return files.read(spark, stream=stream, **options)


@source("json")
def _json(spark: SparkSession, stream: bool = False, **options) -> DataFrame:
    return files.read_json(spark, stream=stream, **options)[0]


@source("polls")
def _polls(spark: SparkSession, stream: bool = False, **options) -> DataFrame:
    return polls.read(spark, stream=stream, **options)[0]


@transform("select")
def _select(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.selectExpr(*columns)


@transform("filter")
def _filter(df: DataFrame, where: str) -> DataFrame:
    return df.filter(where)


@transform("rename")
def _rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


@transform("drop")
def _drop(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


@transform("derive")
def _derive(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr("*", *(f"{e} AS {name}" for name, e in columns.items()))


@transform("explode")
def _explode(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.selectExpr("*", f"explode({column}) AS {name}")


@transform("aggregate")
def _aggregate(df: DataFrame, by: list[str], values: dict[str, str], watermark: tuple[str, str] | None = None) -> DataFrame:
    """by and values: SQL expressions; watermark: time column and delay, for streams."""
    df = df.withWatermark(*watermark) if watermark else df
    return df.groupBy(*map(F.expr, by)).agg(*(F.expr(e).alias(name) for name, e in values.items()))


@transform("sql")
def _sql(df: DataFrame, query: str) -> DataFrame:
    """query: SQL text in which ``{rows}`` is the DataFrame."""
    return df.sparkSession.sql(query, rows=df)


@transform("encode")
def _encode(df: DataFrame, serializer: str, into: str = "value") -> DataFrame:
    """Each row as one text column."""
    return df.select(SERIALIZERS[serializer].encode(*df.columns).alias(into))


@transform("decode")
def _decode(df: DataFrame, serializer: str, schema: str, column: str = "value", damaged: bool = False) -> DataFrame:
    """The rows whose text fits the schema, or with ``damaged`` the text of the others."""
    rows = df.select(column, SERIALIZERS[serializer].decode(F.col(column), schema).alias("r_"))
    bad = F.col("r_.damaged_").isNotNull()
    return rows.filter(bad).select(column) if damaged else rows.filter(~bad).select("r_.*").drop("damaged_")


@dataclass(frozen=True)
class Pipeline:
    """source and each step: a registered name and its options."""

    source: tuple[str, dict]
    steps: list[tuple[str, dict]] = field(default_factory=list)

    def frame(self, spark: SparkSession, stream: bool = False) -> DataFrame:
        name, options = self.source
        df = SOURCES[name](spark, stream=stream, **options)
        for step, options in self.steps:
            df = df.transform(TRANSFORMS[step], **options)
        return df

    def run(self, spark: SparkSession, sink: str, path: str, partition_by: tuple[str, ...] = ()) -> None:
        SINKS[sink](self.frame(spark), path, partition_by)

    def start(self, spark: SparkSession, sink: str, path: str, checkpoint: str, mode: str = "append", every: str | None = None) -> StreamingQuery:
        """The stream of all that is there (or, with ``every``, from now on), from where ``checkpoint`` stands; each batch is delivered once."""
        writer = self.frame(spark, stream=True).writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
        return writer.foreachBatch(sinks.once_per_batch(path, sink=SINKS[sink])).start()
