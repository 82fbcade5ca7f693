"""Rows to JSON and back without loss."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All microseconds, and nulls as nulls.
WRITE = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}
READ = {k: v for k, v in WRITE.items() if k.startswith("timestamp")}


def encode(*columns: str) -> Column:
    return F.to_json(F.struct(*columns), WRITE)


def decode(text: Column, schema: str) -> Column:
    """A struct, whose fields are null where the text doesn't fit; ``damaged`` tells."""
    return F.from_json(text, f"{schema}, damaged_ string", {**READ, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "damaged_"})


def damaged(decoded: Column) -> Column:
    return decoded["damaged_"].isNotNull()
