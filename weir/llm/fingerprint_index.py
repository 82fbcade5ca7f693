"""Removal of repeated runs of words with a log-structured index of window fingerprints.

The index is a folder of immutable runs: tables of distinct fingerprints with their counts, bucketed and sorted by
fingerprint, and a manifest that names the runs of each version. A batch becomes a run of its own and is merge-joined with the
runs before it, bucket by bucket and without a shuffle; what it meets is told at once. Two runs of a level are compacted, by
the same kind of join, into one of the next level, so there are as many runs as the logarithm of the batches. A version is
there when its manifest is; runs that no manifest names are left from a crash and are never read. Opened again, in another
session too, the index goes on from its last version.

Fingerprints are the least grams of windows (see ``repeats``): every window of the full length has one, equal windows the
same one. What meets is verified on the whole windows before anything is removed; windows are equal if two polynomial hashes of
128 bits together are, words themselves aren't compared.

Defined cases: a null text has no words; a text of fewer words than a window loses nothing; very long texts are treated
whole; repeated rows and equal texts lose all that is at least a window long; an empty batch adds an empty run; other
columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm import repeats
from weir.plans.durable import delete, durable, exists, fresh_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


class FingerprintIndex:
    """The index at ``path``, new or opened again; ``add`` takes a batch's fingerprints (column ``gram``)."""

    MANIFEST = "version long, buckets int, level int, place int, name string"

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        """buckets: of a new index; by default the number of partitions that its batches are grouped in."""
        self.spark, self.path, self.version = spark, path, 0
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        if exists(spark, self._manifest):
            rows = spark.read.schema(self.MANIFEST).parquet(self._manifest)
            last = rows.filter(F.col("version") == rows.agg(F.max("version")).first()[0]).orderBy("level", "place").collect()  # a row for each run
            self.version, self.buckets = last[0]["version"], last[0]["buckets"]
            for r in last:
                self.levels += [[] for _ in range(r["level"] + 1 - len(self.levels))]
                self.levels[r["level"]].append(r["name"])

    @property
    def _manifest(self) -> str:
        return f"{self.path}/manifest"

    def runs(self) -> list[DataFrame]:
        return [self._opened(name) for level in self.levels for name in level]

    def add(self, grams: DataFrame) -> DataFrame:
        """Add a batch as a run; ``gram`` of its fingerprints that occur elsewhere, in it or in a run before it."""
        name = self._written(grams.groupBy("gram").agg(F.count("*").alias("n")))
        met, again = self._opened(name), F.col("n") > 1
        for i, old in enumerate(self.runs()):
            met = met.join(old.select("gram", F.lit(True).alias(f"in{i}")).hint("merge"), "gram", "left")
            again |= F.col(f"in{i}").isNotNull()
        met = durable(met.filter(again).select("gram"), "met")
        self._put(name)
        return met

    def repeated(self) -> DataFrame:
        """``gram`` of all fingerprints that occur more than once in the index."""
        # as plain files: over a union of bucketed tables, Spark may group each bucket's files where they are read
        runs = [self.spark.read.schema("gram long, n long").parquet(f"{self.path}/{name}") for level in self.levels for name in level]
        return reduce(DataFrame.unionByName, runs).groupBy("gram").agg(F.sum("n").alias("n")).filter("n > 1").select("gram")

    def _written(self, run: DataFrame) -> str:
        name = f"weir_run_{uuid.uuid4().hex}"
        run.write.format("parquet").bucketBy(self.buckets, "gram").sortBy("gram").option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def _opened(self, name: str) -> DataFrame:
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} (gram BIGINT, n BIGINT) USING parquet CLUSTERED BY (gram) SORTED BY (gram) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
        return self.spark.table(name)

    def _put(self, name: str) -> None:
        """Compact the levels that the new run fills, then write the version's manifest, and only then drop what it replaces."""
        old, level = [], 0
        while len(self.levels) > level and self.levels[level]:
            other = self.levels[level].pop()
            a, b = self._opened(other), self._opened(name).withColumnRenamed("n", "more")
            merged = a.join(b.hint("merge"), "gram", "full").select("gram", (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n"))
            old += [other, name]
            name, level = self._written(merged), level + 1
        self.levels += [[] for _ in range(level + 1 - len(self.levels))]
        self.levels[level].append(name)
        self.version += 1
        rows = [(self.version, self.buckets, k, i, run) for k, names in enumerate(self.levels) for i, run in enumerate(names)]
        self.spark.createDataFrame(rows, self.MANIFEST).coalesce(1).write.mode("append").parquet(self._manifest)
        for run in old:
            self.spark.sql(f"DROP TABLE {run}")
            delete(self.spark, f"{self.path}/{run}")


def repeated_words(docs: DataFrame, length: int = 35, gram: int = 10, batches: int = 3) -> DataFrame:
    """``key, spans, kept``: per distinct text with repeated windows (key: its SHA-256), the word spans and the words left.


    The table is taken as ``batches`` that arrive one after the other. A fingerprint that a batch meets is repeated in the
    batch and in what came before, so when all are in, windows of early batches are judged by all that came later too.
    """
    kind = repeats.Kind("words", length, min(gram, length), width=4)
    batch = F.pmod(F.xxhash64("key"), F.lit(batches)).alias("batch")
    found = durable(repeats.anchors(docs, kind).select("*", batch), "fingerprints")
    index = FingerprintIndex(docs.sparkSession, fresh_path(docs.sparkSession, "index"))
    met = [index.add(found.filter(F.col("batch") == b).select(F.col("core").alias("gram"))) for b in range(batches)]
    again = reduce(DataFrame.unionByName, met).distinct().withColumnRenamed("gram", "core")
    marked = repeats.confirm(docs, repeats.sharing(found.drop("batch"), durable(again, "met-in-all")), kind, lambda text, spans: " ".join(without(WORD.findall(text), spans)).encode())
    return marked.withColumn("kept", F.col("kept").cast("string"))


def without(words: list[str], spans: list[tuple[int, int]]) -> list[str]:
    ends = [0, *(b for _, b in spans)]
    return [w for a, b in zip(ends, [*(a for a, _ in spans), len(words)]) for w in words[a:b]]
