"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Each source has a target in words. A ratio of target to size of, say, 1.4 gives every document one certain
copy and leaves 0.4 of the words to a sample. The sample ranks documents by Pareto's order: the odds of a
uniform number (a keyed hash of the id, so that reruns agree) over the odds of the document's inclusion
probability. It takes documents from the front of that order until the words run out, then again from the
documents left that still fit.

No source is ever gathered in one task: the point of the order at which the words run out is found by
a histogram of the order's values, and only the bin where it falls is sorted.

Defined cases: a null text or one without words has size 0 and gives no words; a null source is a source of
its own, last; a document without an id has the random number of its text; repeated rows each count as a document, share one
random number and are taken one by one; an empty table gives
no rows; very long texts are counted whole; documents that tie in the order follow by size and id; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weir.plans.durable import durable

#: Bins of the histogram of a source's order, and bins in a coarse one; documents of the one bin where the words run out are sorted.
BINS, COARSE = 1 << 14, 1 << 7
#: Rounds that fill what the whole documents before them left over.
ROUNDS = 3
#: Up to so many sources, counted first, their targets are broadcast.
FEW = 20_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """Per source the target: its weight's part of ``share`` of all words, at most ``cap`` times its size.

    What a capped source leaves goes to the others by weight. In order of cap over weight, a source is capped
    exactly if the level computed with all sources before it capped exceeds its own cap, so one pass over
    the sorted sources (one row each) solves it.
    """
    w = reduce(lambda c, i: c.when(F.col("at") % len(weights) == i, float(weights[i])), range(1, len(weights)), F.when(F.col("at") % len(weights) == 0, float(weights[0])))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ever = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sized = (
        sizes.withColumn("all_size", F.sum("source_size").over(by_name.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("at", F.row_number().over(by_name) - 1)
        .withColumn("weight", w)
        .withColumn("limit_words", F.col("source_size") * F.lit(cap))
        .withColumn("ratio", F.col("limit_words") / F.col("weight"))
        .withColumn("level", (F.col("all_size") * F.lit(share) - F.coalesce(F.sum("limit_words").over(before), F.lit(0.0))) / F.sum("weight").over(after))
        .withColumn("capped", F.col("level") > F.col("ratio"))
        .withColumn("final", F.max(F.when(~F.col("capped"), F.col("level"))).over(ever))
    )
    return sized.select("source", "source_size", F.when(F.col("capped"), F.col("limit_words")).otherwise(F.least(F.col("final") * F.col("weight"), F.col("limit_words"))).alias("target"))


def _first_full(sums: DataFrame, by: str, before: Column) -> DataFrame:
    """``key, by, room, before``: per source the first bin by which its room is more than full, and the words before it."""
    upto = Window.partitionBy("key").orderBy(by)  # at most COARSE or BINS / COARSE rows a source
    full = sums.withColumn("upto", before + F.sum("words").over(upto)).filter(F.col("upto") > F.col("room"))
    first = full.groupBy("key", "room").agg(F.min_by(F.struct(by, (F.col("upto") - F.col("words")).alias("before")), by).alias("s"))
    return first.select("key", "room", f"s.{by}", "s.before")


def _fill(state: DataFrame, room: DataFrame, held: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Take documents from the front of the order until each source's ``room`` is full.

    state: key, size, p in [0, 1), extra and more. room: key, room. Documents above the room aren't asked.
    """
    asked = state.join(held(room), "key", "left").withColumn("bin", F.when(~F.col("extra") & (F.col("size") > 0) & (F.col("size") <= F.col("room")), F.floor(F.col("p") * BINS)))
    sums = durable(asked.filter("bin is not null").groupBy("key", "room", "bin").agg(F.sum("size").alias("words")), "mix-bins")
    coarse = _first_full(sums.groupBy("key", "room", F.floor(F.col("bin") / COARSE).alias("coarse")).agg(F.sum("words").alias("words")), "coarse", F.lit(0)).drop("room")
    fine = sums.withColumn("coarse", F.floor(F.col("bin") / COARSE)).join(held(coarse), ["key", "coarse"])
    stop = _first_full(fine, "bin", F.col("before")).select("key", F.col("bin").alias("stop"), (F.col("room") - F.col("before")).alias("left"))
    asked = asked.join(held(stop), "key", "left")
    last = F.coalesce(F.col("bin") == F.col("stop"), F.lit(False))
    front = F.col("bin").isNotNull() & (F.col("stop").isNull() | (F.col("bin") < F.col("stop")))
    within = Window.partitionBy("key").orderBy("p", "size", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one bin of a source
    sure = asked.filter(~last).withColumn("extra", F.col("extra") | front)
    fits = asked.filter(last).withColumn("extra", F.sum("size").over(within) <= F.col("left"))
    return sure.select(state.columns).unionByName(fits.select(state.columns))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` for a table with ``doc_id, text, source``."""
    # "key" stands for the source in joins, so that a null joins too.
    key = F.xxhash64(F.lit(seed), F.coalesce("source", F.lit("")), F.col("source").isNull()).alias("key")
    mark = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("mark")
    sized = durable(docs.select("doc_id", "source", words(F.col("text")).alias("size"), key, mark), "mix-sizes")
    per = durable(
        targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
        .withColumn("certain", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
        .withColumn("rest", F.col("target") - F.col("certain") * F.col("source_size"))
        .select(key, "source_size", "target", "certain", "rest"),
        "mix-targets",
    )
    few = per.limit(FEW + 1).count() <= FEW
    held = F.broadcast if few else (lambda x: x)
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("order"), F.col("mark")).cast("binary"))
    uniform = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / F.lit(float(1 << 52))
    # A document longer than the words left over can't be in whole: its probability shrinks with its length.
    chance = F.least(F.col("rest") / F.col("source_size"), F.col("rest") / F.col("size"), F.lit(1 - 1e-9))
    q = (F.col("u") / (1 - F.col("u"))) / (F.col("chance") / (1 - F.col("chance")))
    state = sized.join(held(per), "key").withColumn("u", uniform)
    state = state.withColumn("chance", F.when((F.col("size") > 0) & (F.col("rest") > 0), chance)).withColumn("p", F.coalesce(F.least(q / (1 + q), F.lit(1 - 1e-12)), F.lit(0.0)))
    state = state.select("doc_id", "source", "size", "key", "p", F.lit(False).alias("extra"))
    for i in range(ROUNDS):
        used = state.groupBy("key").agg(F.sum(F.when(F.col("extra"), F.col("size")).otherwise(0)).alias("used"))
        room = per.join(used, "key").select("key", F.floor(F.col("rest") - F.col("used") + 0.5).alias("room")).filter(F.col("room") > 0)
        state = durable(_fill(state, room, held), f"mix-state{i}")
    out = state.join(held(per), "key")
    taken = F.col("size") * (F.col("certain") + F.col("extra").cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))
