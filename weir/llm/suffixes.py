"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are sorted through a threshold of bytes only, most significant digit first, and a suffix that is alone with its
digits so far drops out of all later passes. Not every suffix is a row, as a row for each byte of the corpus would have to be moved:
a window is represented by the suffix that begins with its gram of the least hash, its anchor, which equal windows have at the
same place, and neighbouring windows share (``repeats.anchors``). The passes over these suffixes:

1. The first digit is the gram, the suffix's own leading bytes, by 64 bits of hash. It is counted where it is read, and the counts are merged; suffixes with
   a digit of their own drop out.
2. The next digit is all that a run of windows with one anchor holds. Runs that are there twice are settled whole, by 64 further bits.
3. The suffixes that are left, at the edges of repeated passages, are sorted by their bytes: those behind the gram, and in a second
   order those before it. Neighbours in an order have the longest common bytes, as in a suffix array. A neighbour that shares ``l`` bytes
   before the gram and ``r`` behind it proves all windows between repeated, and no window that reaches beyond the longest of them can be.
4. Where the longest bytes on either side are shared with different suffixes, the windows in between are counted one by one, by
   128 bits for the bytes around the gram. So groups at full depth are exactly the repeated windows.

No text, group or order is in one task: a sorted order is cut into ranges anywhere, also within a group, and what meets
over a cut is compared on the driver, two rows for each range.

Defined cases: a null text is empty; a text shorter than a window loses nothing; very long texts are read in overlapping parts;
repeated rows and equal texts lose all that is at least a window long; grams that tie count by place; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm import repeats
from weir.plans.durable import discard, durable, join_checked

ID = ["key", "place", "start"]


def _contexts(gram: int):
    """For each open run the bytes before its gram, last first, and those behind it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in repeats.parted(batches):
            out = []
            for r in batch.to_pylist():
                data = r["text"].encode()
                out += [{"key": r["key"], **o, "left": data[o["start"] : o["place"]][::-1], "right": data[o["place"] + gram : o["stop"]]} for o in r["open"]]
            yield pa.RecordBatch.from_pylist(out, schema)

    numbers = [pa.field(c, pa.int64()) for c in ("place", "start", "stop", "core", "weight")]
    schema = pa.schema([pa.field("key", pa.binary()), *numbers, pa.field("left", pa.binary()), pa.field("right", pa.binary())])
    return cut


def shared_prefixes(values: list[bytes]) -> np.ndarray:
    """How many leading bytes each value shares with the one behind it."""
    size = np.array([len(v) for v in values], np.int64)
    places = np.arange(int(size.max(initial=0)) + 1)
    rows = np.zeros((len(values), len(places)), np.uint8)
    rows[places < size[:, None]] = np.frombuffer(b"".join(values), np.uint8)
    equal = (rows[:-1] == rows[1:]) & (places < np.minimum(size[:-1], size[1:])[:, None])
    return equal.argmin(1)  # the last place is never equal


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order: what both rows of each pair of neighbours share; and the first and the last row themselves, as ``edge``."""
    part, last = TaskContext.get().partitionId(), None
    names = ["core", "one", "two", *ID]

    def edge(rows: pa.RecordBatch, at: str) -> pa.RecordBatch:
        own = {c: rows.column(c) for c in names}
        return pa.RecordBatch.from_pydict({"a": pa.array([0], pa.int32()), "b": pa.array([0], pa.int32()), "part": pa.array([part], pa.int32()), "edge": pa.array([at]), **own})

    for batch in batches:
        if not len(batch):
            continue
        if last is None:
            yield edge(batch.slice(0, 1), "first")
        rows = batch.select(names) if last is None else pa.Table.from_batches([last, batch.select(names)]).combine_chunks().to_batches()[0]
        core = rows.column("core").to_numpy()
        met = np.flatnonzero(core[1:] == core[:-1])
        a, b = (shared_prefixes(rows.column(c).to_pylist())[met] for c in ("one", "two"))
        both = rows.take(pa.array(np.concatenate([met, met + 1])))
        n = len(both)
        none = {c: pa.nulls(n, pa.binary()) for c in ("one", "two")}
        yield pa.RecordBatch.from_pydict({"a": pa.array(np.tile(a, 2), pa.int32()), "b": pa.array(np.tile(b, 2), pa.int32()), "part": pa.array(np.full(n, part), pa.int32()), "edge": pa.nulls(n, pa.string()), "core": both.column("core"), **none, **{c: both.column(c) for c in ID}})
        last = rows.slice(len(rows) - 1, 1)
    if last is not None:
        yield edge(last, "last")


def _neighbours(contexts: DataFrame, one: str, two: str) -> DataFrame:
    """``key, place, start`` and the bytes of ``one`` and ``two`` shared with a neighbour in the order of core, ``one`` and ``two``."""
    by = ["core", "one", "two", *ID]
    order = contexts.select("core", F.col(one).alias("one"), F.col(two).alias("two"), *ID).repartitionByRange(*by).sortWithinPartitions(*by)
    pairs = durable(order.mapInArrow(_pairs, "a int, b int, part int, edge string, core long, one binary, two binary, key binary, place long, start long"), "suffix-pairs")
    ends = sorted(pairs.filter("edge is not null").collect(), key=lambda r: (r["part"], r["edge"] == "last"))  # two rows a range
    over = []
    for x, y in zip(ends[1::2], ends[2::2]):
        if x["core"] == y["core"]:
            a, b = (int(shared_prefixes([bytes(x[c]), bytes(y[c])])[0]) for c in ("one", "two"))
            over += [(bytes(r["key"]), r["place"], r["start"], a, b) for r in (x, y)]
    told = pairs.filter("edge is null").select(*ID, "a", "b").unionByName(contexts.sparkSession.createDataFrame(over, "key binary, place long, start long, a int, b int"))
    return told.select(*ID, F.col("a").alias(one), F.col("b").alias(two))


def repeated_bytes(docs: DataFrame, length: int = 400, gram: int = 200) -> DataFrame:
    """``key, spans, kept``: per distinct text with repeated windows (key: its SHA-256), the byte spans and what remains."""
    gram = min(gram, length)
    kind = repeats.Kind("bytes", length, gram, width=1)
    found = durable(repeats.anchors(docs, kind), "first-digits")
    again = durable(found.groupBy("core").agg(F.count("*").alias("n")).filter("n > 1"), "digits-again")
    runs = repeats.settle(repeats.sharing(found, again).withColumn("weight", F.lit(1).cast("long")), ["place"], "runs")
    open_run = F.struct("place", "start", "stop", "core", "weight")
    info = runs.groupBy("key").agg(F.collect_set(F.when(F.col("hit"), F.struct("start", "stop"))).alias("whole"), F.collect_set(F.when(F.col("open"), open_run)).alias("open"))
    texts = repeats.with_texts(docs, durable(info, "run-info"))
    discard(runs)
    contexts = texts.filter(F.size("open") > 0).select("key", "text", "open").mapInArrow(_contexts(gram), "key binary, place long, start long, stop long, core long, weight long, left binary, right binary")
    contexts = durable(contexts, "suffix-contexts", compression="zstd")

    near = _neighbours(contexts, "right", "left").unionByName(_neighbours(contexts, "left", "right"))
    most = near.groupBy(*ID).agg(F.max("left").alias("l"), F.max("right").alias("r"), F.collect_set(F.struct(F.col("left").alias("l"), F.col("right").alias("r"))).alias("near"))
    # d: bytes of a window before its gram; from and to: what a run's own windows have, as far as any other suffix goes along
    rest = length - gram
    low = lambda r: F.greatest(F.col("place") - F.col("stop") + length, rest - r)
    high = lambda left: F.least(F.col("place") - F.col("start"), left.cast("long"))
    told = contexts.select(*ID, "stop", "core", "weight").join(most, ID).withColumns({"from": low(F.col("r")), "to": high(F.col("l"))}).filter("from <= to")
    proved = lambda d: F.exists("near", lambda n: (d >= rest - n["r"]) & (d <= n["l"]))
    still = F.exists(F.sequence("from", "to"), lambda d: ~proved(d))
    told = durable(told.withColumn("open", (F.col("weight") == 1) & still), "suffix-told")
    sure = told.filter("weight = 1").select("key", "place", "start", "stop", F.explode("near").alias("n"))
    sure = sure.select("key", "place", low(F.col("n.r")).alias("from"), high(F.col("n.l")).alias("to")).filter("from <= to")
    span = lambda least, most_: [(F.col("place") - most_).alias("start"), (F.col("place") - least + length).alias("stop")]
    spans = sure.select("key", *span(F.col("from"), F.col("to")))

    open_cores = durable(told.filter("open").select("core").distinct(), "open-cores")
    windows = join_checked(told, open_cores, ["core"]).select(*ID, "core", "weight", F.explode(F.sequence("from", "to")).alias("d")).join(contexts.select(*ID, "left", "right"), ID)
    name = F.md5(F.concat(F.substr("left", F.lit(1), F.col("d").cast("int")), F.substr("right", F.lit(1), (rest - F.col("d")).cast("int"))))
    windows = durable(windows.select("key", "place", "core", "weight", "d", F.unhex(name).alias("name")), "suffix-windows")
    twice = durable(windows.groupBy("core", "d", "name").agg(F.sum("weight").alias("n")).filter("n > 1").drop("n"), "windows-again")
    single = windows.filter("weight = 1").join(twice, ["core", "d", "name"], "left_semi").select("key", *span(F.col("d"), F.col("d")))
    spans = spans.unionByName(single).groupBy("key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    return repeats.marked(texts.select("key", "text", "whole").join(spans, "key", "left"), lambda text, cut: without(text.encode(), cut))


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(b for _, b in spans)]
    return b"".join(data[a:b] for a, b in zip(ends, [*(a for a, _ in spans), len(data)]))
