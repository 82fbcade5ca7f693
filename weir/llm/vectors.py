"""Embedding near-duplicates by sorted projection passes.

Each pass gives every vector the concatenated signs of random projections and orders the vectors by label and
that key. The order is cut into blocks; a vector is compared with its own block and the next one, so the window is bounded
whatever the data look like. What a bounded window can't promise, runs do: vectors of a label that share the first bits of
their key are a run, and a run that is longer than a window is compared whole, block against block. A label's size, counted
first, tells how many first bits make a run of about a block where vectors lie evenly, and how many passes a pair at the
threshold needs to share a run in one of them with probability ``recall``. So a dense group of near copies, which no
number of bits cuts, costs its pairs but loses none of its links to the window. Pairs at the threshold or above
are verified in double precision.

A vector carries its place in every pass, so a pair that two passes meet counts in the first only, and pairs
are counted where they are found and never written out. Components come from a spanning forest of each comparison.
Equal vectors, told by 128 bits of two hashes, are one vector with a count.

Defined cases: vectors that are null, empty or zero or hold a null or non-finite component, and vectors without a
label, link with nothing; vectors of different lengths don't link; repeated rows are equal vectors; a vector without an id
links like any other, but names no component, and its ``kept`` is null; a pair at exactly the threshold links; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.llm.components import components, forest
from weir.plans.durable import durable, join_checked

#: Bits of a pass's key, vectors in a block, and later blocks that one comparison of a block takes.
BITS, BLOCK, TAKES = 30, 1024, 8


def plan(block: int, threshold: float, recall: float, bits: int = BITS) -> list[tuple[int, int]]:
    """By the doublings of ``block`` that a label's size has: the first bits that make a run, and the passes."""
    same = 1 - math.acos(threshold) / math.pi
    return [(b, 1 if b == 0 else math.ceil(math.log(1 - recall) / math.log(1 - same**b))) for b in range(bits + 1)]


def _keys(bits: int, seed: int):
    @F.pandas_udf("array<long>")
    def keys(series: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for vectors, passes in series:
            out = [None] * len(vectors)
            sizes = np.array([len(v) for v in vectors], np.int64)
            for size, many in {*zip(sizes.tolist(), passes.tolist())}:
                if (size, many) not in planes:
                    planes[size, many] = np.hstack([np.random.default_rng([seed, size, t]).standard_normal((size, bits)) for t in range(many)])
                at = np.flatnonzero((sizes == size) & (passes.to_numpy() == many))
                signs = (np.stack([vectors.iloc[i] for i in at]).astype(np.float64) @ planes[size, many] > 0).reshape(len(at), many, bits)
                packed = signs @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))
                for i, row in zip(at, packed):
                    out[i] = row
            yield pd.Series(out)

    return keys


def _compare(threshold: float):
    """Counts and links of one comparison: a block with itself, if it is the block's first, and with rows of later blocks."""

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        t, first = int(group["pass_no"].iloc[0]), int(group["slot"].iloc[0]) == 0
        group = group.sort_values("own", ascending=False, kind="stable")
        x = np.stack(group["vector"].to_numpy()).astype(np.float64)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        ids, many, label = group["rep"].to_numpy(), group["many"].to_numpy(), group["label"].to_numpy()
        runs, blocks = (pd.DataFrame(group[c].tolist()).to_numpy() for c in ("runs", "blocks"))  # labels have different numbers of passes
        n = int(group["own"].sum())
        counts, found = np.zeros(len(ids), np.int64), []
        for lo in range(0, n, 256):
            a = slice(lo, min(lo + 256, n))
            near = x[a] @ x.T >= threshold
            near &= label[a, None] == label[None, :]
            near[:, :n] &= first & (np.arange(n)[None, :] > np.arange(lo, a.stop)[:, None])
            i, j = np.nonzero(near)
            i += lo
            inside = lambda u: (np.abs(blocks[i, u] - blocks[j, u]) <= 1) | (runs[i, u] == runs[j, u])  # noqa: B023, E731
            new = inside(t)
            for u in range(t):  # in an earlier pass's window: counted there
                new &= ~inside(u)
            i, j = i[new], j[new]
            counts += np.bincount(i, many[j], len(ids)).astype(np.int64) + np.bincount(j, many[i], len(ids)).astype(np.int64)
            found.append(forest(ids[i], ids[j]))
        a, b = forest(np.concatenate([f[0] for f in found] or [ids[:0]]), np.concatenate([f[1] for f in found] or [ids[:0]]))
        some = np.flatnonzero(counts)
        return pd.DataFrame({"rep": np.concatenate([ids[some], a]), "n": np.concatenate([counts[some], np.zeros(len(a), np.int64)]), "other": np.concatenate([ids[some], b])})

    return compare


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, recall: float = 0.99, block: int = BLOCK, seed: int = 11) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for a table with ``vec_id, embedding, label``.

    recall: of pairs at the threshold, by the runs alone; closer pairs and windows have more.
    """
    # single-precision input stays so in every copy; its squares neither overflow nor vanish in double precision
    kind = "float" if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else "double"
    raw = vectors.select("vec_id", F.col("embedding").cast(f"array<{kind}>").alias("vector"), "label")
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda v: v != 0), F.lit(False))
    # 0.0 and -0.0 are one number; in double precision a scale that would overflow or vanish in squares is taken out
    top = F.lit(1.0).cast("float") if kind == "float" else F.array_max(F.transform("vector", lambda v: F.abs(v)))
    scaled = F.transform("vector", lambda v: (v / top + 0.0).cast(kind))
    rows = raw.select("vec_id", "label", F.when(usable, scaled).alias("vector"))
    equal = [F.when(F.col("vector").isNotNull(), h).alias(name) for name, h in (("h1", F.xxhash64("vector")), ("h2", F.xxhash64(F.lit("again"), "vector")))]
    same = rows.filter("vector is not null").select("*", *equal).groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("many"), F.first("vector").alias("vector"))
    distinct = durable(same.withColumn("rep", F.monotonically_increasing_id()), "vectors")  # numbers that stay, as they are written

    steps = F.array(*(F.struct(F.lit(b).alias("bits"), F.lit(p).alias("passes")) for b, p in plan(block, threshold, recall)))
    size = F.size("vector").alias("size")
    doublings = F.least(F.floor(F.log2(F.greatest(F.count("*") / block, F.lit(1.0)))).cast("int"), F.lit(BITS))
    labels = durable(distinct.groupBy("label", size).agg(doublings.alias("d")).select("label", "size", F.get(steps, F.col("d")).alias("s")).select("label", "size", "s.*"), "vector-labels")
    keyed = join_checked(distinct.withColumn("size", size), labels, ["label", "size"])
    keyed = durable(keyed.select("rep", "label", "size", "bits", _keys(BITS, seed)("vector", "passes").alias("keys")), "vector-keys")

    # The order of every pass, cut into blocks: rows are counted per partition of one range-sorted table.
    order = keyed.select("rep", "label", "size", "bits", F.posexplode("keys").alias("pass_no", "key"))
    order = order.repartitionByRange("pass_no", "label", "size", "key", "rep").sortWithinPartitions("pass_no", "label", "size", "key", "rep")
    placed = durable(order.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id() - F.shiftleft(F.col("part").cast("long"), 33)), "vector-order")
    firsts = placed.groupBy("part").agg(F.count("*").alias("n")).withColumn("first", F.sum("n").over(Window.orderBy("part")) - F.col("n"))  # one row a partition
    run = F.expr(f"shiftright(key, {BITS} - bits)")
    placed = placed.join(F.broadcast(firsts.select("part", "first")), "part").withColumn("block", F.floor((F.col("first") + F.col("at")) / block)).withColumn("run", run)
    by = ["pass_no", "label", "size", "run"]
    long_runs = durable(placed.groupBy(*by).agg(F.min("block").alias("from"), F.max("block").alias("to")).filter(F.col("to") > F.col("from") + 1), "vector-runs")
    spread = join_checked(placed, long_runs, by, "left")
    # the blocks that a row is compared with: from the one before, or from its run's first, up to the one behind or its run's last
    first = F.least(F.col("block") - 1, F.coalesce("from", F.col("block") - 1))
    last = F.greatest(F.col("block") + 1, F.coalesce("to", F.col("block") + 1))
    place = F.struct("pass_no", "block", "run", first.alias("first"), last.alias("last"))
    where = durable(spread.groupBy("rep").agg(F.sort_array(F.collect_list(place)).alias("places")), "vector-places")
    at = distinct.join(where, "rep").select("rep", "label", "many", "vector", F.col("places.block").alias("blocks"), F.col("places.run").alias("runs"), F.explode("places").alias("p"))

    def cell(block: Column, slot: Column, own: bool) -> list[Column]:
        return [F.col("p.pass_no").alias("pass_no"), block.alias("cell"), slot.cast("int").alias("slot"), F.lit(own).alias("own"), *map(F.col, ("rep", "label", "many", "vector", "blocks", "runs"))]

    # A block's comparison takes at most TAKES later blocks, and the first one the block itself.
    slots = at.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("p.last") - F.col("p.block") - 1) / TAKES))))
    own = slots.select(*cell(F.col("p.block"), F.col("slot"), True))
    guests = at.withColumn("to", F.explode(F.sequence(F.col("p.first"), F.col("p.block") - 1)))
    guests = guests.select(*cell(F.col("to"), F.floor((F.col("p.block") - F.col("to") - 1) / TAKES), False))
    met = own.unionByName(guests).groupBy("pass_no", "cell", "slot", F.size("vector")).applyInPandas(_compare(threshold), "rep long, n long, other long")
    met = durable(met, "vector-links")
    roots = components(met.filter("n = 0").select(F.col("rep").alias("a"), F.col("other").alias("b"))).withColumnRenamed("id", "rep")
    linked = met.groupBy("rep").agg(F.sum("n").alias("n"))
    reps = distinct.select("rep", "label", "h1", "h2", "many", "least").join(linked, "rep", "left").join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    least = reps.groupBy("root").agg(F.min("least").alias("component_id"))
    named = reps.join(least, "root").select("label", "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "label", *equal).join(named, ["label", "h1", "h2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
