"""Files as sinks, in batch and for streams, with each micro-batch delivered once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from weir.functions import jsonrows


def write(df: DataFrame, fmt: str, path: str, partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    writer = df.write.format(fmt).mode(mode)
    if fmt in ("json", "csv", "xml"):
        writer = writer.options(**jsonrows.WRITE)
    if fmt == "xml":
        writer = writer.option("rowTag", "row")
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def once_per_batch(path: str, fmt: str = "parquet", sink: Callable[..., None] | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: a batch that is run again after a failure replaces its own folder and nothing else.

    sink: ``f(df, path, mode=...)`` in place of files of ``fmt``; it must replace what is at ``path`` where the mode is ``overwrite``.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        at = f"{path}/batch={batch_id}"
        sink(batch, at, mode="overwrite") if sink else write(batch, fmt, at, mode="overwrite")

    return put
