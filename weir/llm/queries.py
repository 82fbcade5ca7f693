"""The subpackage's queries: one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm import decontamination, fingerprint_index, langid, mixing, oracles, pii, repeats, simhash, suffixes, toxicity, urls, vectors

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: The other operators are held against brute force in tests, as SQL can't express a fitted model, XXH64 or a Feistel permutation.
ORACLES: dict[str, str] = {
    "op1_mix_pareto": oracles.PARETO_MIX,
    "op3_url_templates": oracles.URL_TEMPLATES,
    "op5_substring_index": oracles.SUBSTRING_WORDS,
    "op8_embedding_sorted_passes": oracles.EMBEDDING_PAIRS,
    "op9_suffix_radix": oracles.SUBSTRING_BYTES,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def op1_mix_pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, cap=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


@query
def op2_decontaminate_cgk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items that it holds a passage of."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"), similarity=0.8, recall=0.95, least_words=5)
    return found.select("doc_id", "contaminated", "items")


#: What op3 is told about hosts and paths.
URL_RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}


@query
def op3_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


@query
def op4_toxicity_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's expected severity; ``rejected`` are those more likely toxic than not."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), sample_rows=12_000)
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", "severity", "p_toxic", "grade", (F.col("p_toxic") > 0.5).alias("rejected"))


def _removed(spans: str = "spans"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])


@query
def op5_substring_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = fingerprint_index.repeated_words(docs, length=35)
    marked = marked.select("key", _removed().alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
    words = F.coalesce(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), F.array().cast("array<string>"))
    whole = docs.select("doc_id", repeats.text_key().alias("key"), words.alias("words")).select("doc_id", "key", F.size("words").cast("long").alias("n_words"), F.sha2(F.array_join("words", " ").cast("binary"), 256).alias("whole"))
    return whole.join(marked, "key", "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))


@query
def op6_simhash_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op7_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with pseudonyms for private values."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, key="weir-test-key").select("doc_id", "text", F.col("n_private").cast("long").alias("n_private"))


@query
def op8_embedding_sorted_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


@query
def op9_suffix_radix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = suffixes.repeated_bytes(docs, length=400)
    marked = marked.select("key", _removed().alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    data = F.coalesce("text", F.lit("")).cast("binary")
    whole = docs.select("doc_id", repeats.text_key().alias("key"), F.octet_length(data).cast("long").alias("n_bytes"), F.sha2(data, 256).alias("whole"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return whole.join(marked, "key", "left").select("doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))


@query
def op10_language_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)).alias("held_out")
    docs = docs.select("doc_id", "text", "lang", held_out)
    langs, matrix = langid.fit(docs.filter(~F.col("held_out")), sample_rows=20_000)
    return langid.predict(docs.drop("lang"), langs, matrix).select("doc_id", "held_out", "lang_pred", "score")
