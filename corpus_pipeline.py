"""A training corpus from raw documents: toxic ones go, one of each group of near-copies stays, documents with benchmark
passages go, private values become pseudonyms, and sources are mixed to their target weights.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of ``docs``. ``run``
writes what a stage returns and reads it again for the next one, so that no stage computes another one's work again.

In every stage, columns beside ``doc_id``, ``text`` and ``source`` may be missing, null or more than usual, and have any name; they are
carried and never read, but for ``n_chars``. Very long texts are treated whole. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weir.llm import decontamination, mixing, pii, simhash, toxicity
from weir.plans.durable import durable


READ = ("doc_id", "text", "source")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _packed(docs: DataFrame) -> DataFrame:
    """The columns that operators read, and the others as one, so that no operator's own columns replace them."""
    rest = [F.col(c) for c in docs.columns if c not in READ]
    return docs.select(*READ, F.struct(*rest or [F.lit(None)]).alias("rest_"))


def _unpacked(df: DataFrame, columns: list[str], **more: str) -> DataFrame:
    """``columns`` as they were, and others of ``df`` under new names."""
    old = (F.col(c) if c in READ else F.col("rest_")[c].alias(c) for c in columns if c not in more)
    return df.select(*old, *(F.col(c).alias(name) for name, c in more.items()))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more likely not toxic, by a model of this table's labels.

    A null or empty text stays; so does all where no label says that anything is toxic; even odds stay; repeated rows stay or go together.
    """
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), sample_rows=12_000)
    return _unpacked(toxicity.score(_packed(docs), model).filter("p_toxic <= 0.5"), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-copies: five-word shingles, similarity 0.8 or more.

    Texts without words, null ones too, are one group; a text of fewer than five words is one shingle; of repeated rows one stays; a null
    id is larger than any other, and of rows with the same id and different texts, the one whose text's hash is smaller stays.
    """
    return simhash.representatives(docs, shingle=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item.

    A null or empty text stays; null and empty items and those of fewer than five words are ignored; a passage at exactly the limit of
    edits counts; repeated rows stay or go together.
    """
    found = decontamination.contaminated(_packed(docs), _table(spark, sf_dir, "benchmark"), similarity=0.8, recall=0.95, least_words=5)
    return _unpacked(found.filter(~F.col("contaminated")), docs.columns)


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for private values; ``n_chars`` counts the new text.

    A null text stays null, an empty one empty; repeated rows change alike.
    """
    changed = _unpacked(pii.pseudonymise(_packed(docs), key="weir-test-key"), docs.columns)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their size in words, their source's size and target, and the words taken.

    A null source is a source of its own, the last; a null text or one without words has nothing to take and goes; repeated rows each count
    as a document, share one random number, and are told apart by their place.
    """
    mixed = mixing.mix(docs, weights=(5, 2, 1), share=1.5, cap=2.0).filter("taken > 0")

    def keyed(df: DataFrame, size: Column) -> DataFrame:
        """Rows of one id, source and size are told apart by their place only."""
        return df.withColumns({"id_": F.coalesce("doc_id", F.lit(0)), "no_id_": F.col("doc_id").isNull(), "source_": F.coalesce("source", F.lit("")), "no_source_": F.col("source").isNull(), "size_": size})

    key = ["id_", "no_id_", "source_", "no_source_", "size_"]
    takes = keyed(mixed, F.col("size")).groupBy(key).agg(F.first("source_size").alias("mixed_source_size"), F.first("target").alias("mixed_target"), F.sort_array(F.collect_list("taken"), asc=False).alias("takes_"))
    met = keyed(_packed(docs), mixing.words(F.col("text"))).join(durable(takes, "mix-takes"), key)
    met = met.withColumn("place_", F.row_number().over(Window.partitionBy(key).orderBy("size_"))).withColumn("take_", F.try_element_at("takes_", F.col("place_")))
    return _unpacked(met.filter("take_ is not null"), docs.columns, size="size_", source_size="mixed_source_size", target="mixed_target", taken="take_")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", hide_private),
    ("mixing", mix_sources),
]

#: The stages hold a fitted model and edit distances, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
