"""A source plugin: numbered ticks by partition, in batch and as a replayable stream."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


class Span(InputPartition):
    def __init__(self, start: int, stop: int):
        super().__init__((start, stop))
        self.start, self.stop = start, stop


def rows(span: Span) -> Iterator[tuple[int, int]]:
    for i in range(span.start, span.stop):
        yield i, i * i % 97


class Reader(DataSourceReader):
    def __init__(self, n: int, parts: int):
        self.n, self.parts = n, parts

    def partitions(self) -> list[Span]:
        step = max(1, -(-self.n // self.parts))
        return [Span(i, min(i + step, self.n)) for i in range(0, self.n, step)]

    def read(self, partition: Span) -> Iterator[tuple[int, int]]:
        return rows(partition)


class StreamReader(DataSourceStreamReader):
    """Offsets are tick numbers, so a batch that is run again reads the same ticks."""

    def __init__(self, n: int):
        self.n = n

    def initialOffset(self) -> dict:
        return {"tick": 0}

    def latestOffset(self) -> dict:
        return {"tick": self.n}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return [Span(start["tick"], end["tick"])] if end["tick"] > start["tick"] else []

    def read(self, partition: Span) -> Iterator[tuple[int, int]]:
        return rows(partition)


class Ticks(DataSource):
    """Options: ``n`` ticks, ``parts`` partitions in batch."""

    @classmethod
    def name(cls) -> str:
        return "weir_ticks"

    def schema(self) -> str:
        return "tick bigint, value bigint"

    def reader(self, schema) -> Reader:
        return Reader(int(self.options.get("n", 100)), int(self.options.get("parts", 4)))

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(int(self.options.get("n", 100)))
