"""Benchmark decontamination: CGK embedding and bit-sampling LSH over item-sized windows.

An item of n words is in a text if some passage is within ``(1 - similarity) * n`` word edits of it. Windows of each
item's size run over the whole text. A window is embedded by a random walk over its words (at each step the word under
the pointer is put out, and a coin that depends on step and word moves the pointer), which maps few edits to few differing
places; hashes of a few sampled places then meet those of the items. The number of repetitions follows from
the target recall. What meets is verified by exact edit distance on the text's words.

Two conditions that every true window fulfils keep most windows out of the walk: enough of its words are words of
items, and it holds a run of item words that the edits must have left intact. They need no walk and lose nothing.

Words are runs of letters, digits and underscores, lower-cased. Items of fewer than ``least_words`` words aren't looked for, as
such runs of words are in many clean texts.

Defined cases: a null or empty text has no passage of an item; very long texts are searched whole; null or empty items are
ignored; an item at exactly the limit of edits is found; repeated items are all named; repeated rows are judged alike; without items nothing is contaminated; other columns are kept, and
``items`` and ``contaminated`` are replaced if they exist.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.plans.durable import durable, unused

WORD = re.compile(r"\w+")
#: Share of embedded places in which a passage at the limit of edits is taken to differ, and places in a hash.
DIFFER, PLACES = 0.35, 4
#: Words of text walked over at once, and bytes of items in one broadcast.
CHUNK, SLICE_BYTES = 1 << 21, 16 << 20


def repetitions(recall: float) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - (1 - DIFFER) ** PLACES))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def embed(windows: np.ndarray, seed: int) -> np.ndarray:
    """The walk over rows of word numbers: three steps for each word."""
    many, n = windows.shape
    padded = np.hstack([windows, np.zeros((many, 1), windows.dtype)])
    flat, base = padded.ravel(), np.arange(many) * (n + 1)
    at, out = np.zeros(many, np.int64), np.empty((many, 3 * n), windows.dtype)
    for step in range(3 * n):
        word = flat[base + at]
        out[:, step] = word
        coin = _mix(word.astype(np.uint64) + np.uint64((seed << 20) + step * 0x10001)) & np.uint64(1)
        at = np.minimum(at + coin.astype(np.int64), n)
    return out


def edit_distance(item: np.ndarray, regions: np.ndarray) -> np.ndarray:
    """Least edits between the item and any passage of each row of ``regions``."""
    above = np.zeros((len(regions), regions.shape[1] + 1), np.int32)
    ramp = np.arange(regions.shape[1] + 1, dtype=np.int32)
    for i, word in enumerate(item, 1):
        now = np.minimum(above[:, :-1] + (regions != word), above[:, 1:] + 1)
        now = np.hstack([np.full((len(regions), 1), i, np.int32), now])
        above = np.minimum.accumulate(now - ramp, axis=1) + ramp  # inserted words, left to right
    return above.min(1)


def intact(n: int, edits: int) -> int:
    """The longest run of words that so many edits must leave somewhere."""
    return math.ceil((n - edits) / (edits + 1))


@dataclass
class Items:
    """Items of one broadcast, by size; word numbers from 1, 0 for words of no item."""

    ids: list[int]
    words: list[list[str]]
    similarity: float
    recall: float
    number: dict[str, int] = field(default_factory=dict)
    sizes: dict[int, tuple] = field(default_factory=dict)
    seeds: dict[int, np.ndarray] = field(default_factory=dict)

    def prepare(self) -> None:
        """Number the words and build the tables; a worker that has them from a task before does nothing."""
        if self.sizes:
            return
        for w in (w for ws in self.words for w in ws):
            self.number.setdefault(w, len(self.number) + 1)
        by: dict[int, list[int]] = {}
        for i, ws in enumerate(self.words):
            by.setdefault(len(ws), []).append(i)
        for n, at in by.items():
            rows = np.array([[self.number[w] for w in self.words[i]] for i in at], np.int64)
            edits = int((1 - self.similarity) * n + 1e-9)
            run = min(3, intact(n, edits))
            seeds = np.unique(_runs(rows, run))
            tables = []
            for r in range(repetitions(self.recall)):
                places = np.sort(np.random.default_rng([n, r]).choice(3 * n, PLACES, replace=False))
                h = _hash(embed(rows, r // 4)[:, places])
                order = np.argsort(h, kind="stable")
                tables.append((places, h[order], order))
            self.sizes[n] = (np.array(at), rows, edits, run, seeds, tables)
            self.seeds[run] = np.union1d(self.seeds.get(run, seeds), seeds)

    def find(self, texts: list[str | None]) -> list[set[int]]:
        """Places in ``ids`` of the items found in each text."""
        found: list[set[int]] = [set() for _ in texts]
        if not self.sizes:
            return found
        get, gap = self.number.get, np.zeros(max(self.sizes), np.int64)
        parts, owner = [gap], [np.full(len(gap), -1)]
        for i, t in enumerate(texts):
            words = WORD.findall(t.lower()) if t else ()
            parts += [np.fromiter(map(get, words, repeat(0)), np.int64, len(words)), gap]
            owner += [np.full(len(words) + len(gap), i)]
        ids, owner = np.concatenate(parts), np.concatenate(owner)
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        places = {run: self._seeded(ids, known, run, seeds) for run, seeds in self.seeds.items()}
        for n, (_, _, edits, run, seeds, _) in self.sizes.items():
            at, runs = places[run]
            at = at[seeds[np.minimum(np.searchsorted(seeds, runs), len(seeds) - 1)] == runs]
            if not len(at):
                continue
            # all starts of windows that hold one of the runs, each once
            first = np.maximum(at - (n - run), np.concatenate([[0], at[:-1] + 1]))
            many = at - first + 1
            starts = np.arange(many.sum()) + np.repeat(first - np.cumsum(many) + many, many)
            starts = starts[known[starts + n] - known[starts] >= n - edits]
            for lo in range(0, len(starts), 100_000):
                self._verify(ids, owner, starts[lo : lo + 100_000], n, found)
        return found

    def _seeded(self, ids: np.ndarray, known: np.ndarray, run: int, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the runs of words that are in some item of those with this length of run."""
        at = np.flatnonzero(known[run:] - known[:-run] == run)
        runs = _runs_at(ids, at, run)
        hit = seeds[np.minimum(np.searchsorted(seeds, runs), len(seeds) - 1)] == runs
        return at[hit], runs[hit]

    def _verify(self, ids: np.ndarray, owner: np.ndarray, starts: np.ndarray, n: int, found: list[set[int]]) -> None:
        at, rows, edits, _, _, tables = self.sizes[n]
        windows = ids[starts[:, None] + np.arange(n)[None, :]]
        met = []
        for r, (places, hashes, order) in enumerate(tables):
            if r % 4 == 0:
                walked = embed(windows, r // 4)
            h = _hash(walked[:, places])
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            w = np.repeat(np.arange(len(h)), hi - lo)
            k = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange(len(w))
            met.append(w * len(rows) + order[k])
        met = np.unique(np.concatenate(met))
        w, item = met // len(rows), met % len(rows)
        padded = np.concatenate([np.zeros(edits, np.int64), ids, np.zeros(edits + n, np.int64)])
        for i in np.unique(item):
            s = starts[w[item == i]]
            regions = padded[s[:, None] + np.arange(n + 2 * edits)[None, :]]
            # a window may begin or end in the gap between two texts; its middle never lies there
            for doc in np.unique(owner[s[edit_distance(rows[i], regions) <= edits] + n // 2]):
                if doc >= 0:
                    found[doc].add(int(at[i]))


def _hash(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    for c in rows.T:
        h = _mix(h + c.astype(np.uint64) + np.uint64(1))
    return h


def _runs(rows: np.ndarray, run: int) -> np.ndarray:
    """Hashes of all runs of words in the rows."""
    return np.concatenate([_hash(rows[:, i : i + run]) for i in range(rows.shape[1] - run + 1)])


def _runs_at(ids: np.ndarray, at: np.ndarray, run: int) -> np.ndarray:
    return _hash(np.stack([ids[at + k] for k in range(run)], 1))


def _finder(shared: Broadcast):
    """A function that names the items found in each text."""

    @F.pandas_udf("array<long>")
    def find(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        items = shared.value
        items.prepare()
        for texts in series:
            out, some, size = [], [], 0
            for t in [*texts, None]:
                some.append(t)
                size += len(t) // 6 if t else 0
                if size >= CHUNK or len(out) + len(some) > len(texts):
                    out += [sorted(items.ids[i] for i in f) for f in items.find(some)]
                    some, size = [], 0
            yield pd.Series(out[: len(texts)])

    return find


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, recall: float = 0.95, least_words: int = 5) -> DataFrame:
    """``docs`` with ``items``, the ids of benchmark items found in the text, and ``contaminated``.

    A benchmark of any size passes in slices of at most about SLICE_BYTES, one after the other: only one is on the driver and broadcast.
    """
    spark = docs.sparkSession
    kept = benchmark.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text")
    slices = (kept.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SLICE_BYTES + 1

    def sliced(s: int) -> Broadcast | None:
        rows = kept.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == s).collect()
        words = [(r["item_id"], WORD.findall(r["text"].lower())) for r in rows]
        words = [(i, w) for i, w in words if len(w) >= least_words]
        return spark.sparkContext.broadcast(Items([i for i, _ in words], [w for _, w in words], similarity, recall)) if words else None

    none = F.array().cast("array<long>")
    if slices == 1:
        shared = sliced(0)
        docs = docs.withColumn("items", F.array_sort(_finder(shared)("text")) if shared else none)
    else:
        row, more = unused(docs, "row_"), unused(docs, "more_")
        docs = durable(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")  # numbers that stay, as they are written
        found = []
        for s in range(slices):
            if shared := sliced(s):
                found.append(durable(docs.select(row, _finder(shared)("text").alias(more)).filter(F.size(more) > 0), "found-items"))
                shared.destroy()
        if found:
            each = reduce(DataFrame.unionByName, found).groupBy(row).agg(F.array_sort(F.flatten(F.collect_list(more))).alias(more))
            docs = docs.join(each, row, "left").withColumn("items", F.coalesce(more, none)).drop(more)
        docs = (docs if found else docs.withColumn("items", none)).drop(row)
    return docs.withColumn("contaminated", F.size("items") > 0)
