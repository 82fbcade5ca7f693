"""Connected components of a table of links, by contraction.

Defined cases: repeated and reversed links are one; an id linked with itself only is a component; links with a null id are left out;
which id of a component is its root is fixed by hashes, so ties in rank go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.plans.durable import discard, durable


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``id, root`` for every id in ``links`` (columns ``a, b``, of one type); ids of a component share a root.

    In each round every id follows the neighbour, itself included, with the least rank; ranks are a hash that
    changes with the round, so that no order of ids makes long chains. Links between followed ids go to the next
    round, which has fewer of both by a constant factor on average. Then the parents are applied backwards. Links
    and parents are tables in shared storage; the driver sees only whether links are left.
    """
    a, b = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    first = durable(links.filter("a is not null and b is not null").select(a, b).distinct(), "links")
    alone = first.filter("a = b").select(F.col("a").alias("id"), F.col("a").alias("root"))  # but for those with other links
    left = first.filter("a <> b")
    steps: list[DataFrame] = []
    while not left.isEmpty():
        if len(steps) == rounds:
            raise RuntimeError(f"links are left after {rounds} rounds")
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(steps)), c).alias("h"), F.col(c).alias("id"))  # noqa: B023, E731
        seen = left.select(F.col("a").alias("id"), F.least(rank("a"), rank("b")).alias("r")).unionByName(left.select(F.col("b").alias("id"), F.least(rank("a"), rank("b")).alias("r")))
        parents = durable(seen.groupBy("id").agg(F.min("r").alias("r")).select("id", F.col("r.id").alias("parent")), "parents")
        steps.append(parents)
        to_a, to_b = parents.select(F.col("id").alias("a"), F.col("parent").alias("pa")), parents.select(F.col("id").alias("b"), F.col("parent").alias("pb"))
        moved = left.join(to_a, "a").join(to_b, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
        last, left = left, durable(moved.filter("a <> b").select(a, b).distinct(), "links")
        if len(steps) > 1:
            discard(last)
    if not steps:
        return alone

    def deeper(root: DataFrame, parents: DataFrame) -> DataFrame:
        up = root.select(F.col("id").alias("parent"), "root")
        return parents.join(up, "parent", "left").select("id", F.coalesce("root", "parent").alias("root"))

    # a root of an early round that has no link later is its own root
    roots = reduce(deeper, reversed(steps[:-1]), steps[-1].select("id", F.col("parent").alias("root")))
    return durable(roots.unionByName(alone.join(steps[0], "id", "left_anti")), "roots")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A few links, (node, root), with the components of the links (a[i], b[i])."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[root]
        if np.array_equal(new, root):
            break
        root = new
    moved = root != np.arange(len(ids))
    return ids[moved], ids[root[moved]]
