"""Every operator on nulls, empty and very long texts, repeated rows, clashing names and empty tables."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from weir.llm.queries import QUERIES

CLASHING = ["key", "text_", "fp", "root", "place", "start", "core", "block", "spans", "kept", "items", "contaminated", "severity", "p_toxic", "grade", "scored_", "n_private", "found_", "lang_pred", "score", "size", "taken", "target", "bin", "p", "extra", "n", "id_", "held_out"]
DOCUMENTS = [n for n in QUERIES if n.split("_")[0] in {"op1", "op2", "op4", "op5", "op6", "op7", "op9", "op10"}]


@pytest.fixture(scope="module")
def edges(spark, tmp_path_factory):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgéü") for _ in range(rng.randint(1, 9)))
    long = " ".join(word() for _ in range(300_000))
    rows = [(1, long, "en", "a"), (2, None, None, None), (3, "", "en", "a"), (None, "a text without an id", "fr", "b"), (5, "same text here", "en", None), (5, "same text here", "en", None), (6, "x" * 200_000, "de", "b"), (7, " \t\n", None, "c"), (8, long[:5000], "en", "a"), (None, None, None, None)]
    at = tmp_path_factory.mktemp("edges")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs.withColumns({c: F.lit(f"old {c}") for c in CLASHING}).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, 0, None), (5, 1, 1), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, long[200:520]), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(1, None, "x"), (None, "http://a.b/c", None), (3, "http://" + "h" * 100_000 + "/" + "s/" * 50_000, "y"), (3, "", "z")], "page_id long, url string, verdict string").write.parquet(f"{at}/pages.parquet")
    spark.createDataFrame([(1, None, None, "x"), (None, [1.0, 2.0], 1, "y"), (2, [1.0, 2.0], 1, "z"), (2, [1.0, 2.0], 1, "z")], "vec_id long, embedding array<float>, label int, keys string").write.parquet(f"{at}/embeddings.parquet")
    return str(at), rows


@pytest.fixture(scope="module")
def empty(spark, edges, tmp_path_factory):
    at = tmp_path_factory.mktemp("empty")
    for t in ("documents", "labels", "benchmark", "pages", "embeddings"):
        spark.read.parquet(f"{edges[0]}/{t}.parquet").filter("false").write.parquet(f"{at}/{t}.parquet")
    return str(at)


@pytest.mark.parametrize("name", DOCUMENTS)
def test_every_row_of_documents_has_its_answer(spark, edges, name):
    at, rows = edges
    got = QUERIES[name](spark, at).collect()
    key = lambda i: (i is None, i or 0)
    assert sorted((r["doc_id"] for r in got), key=key) == sorted((i for i, *_ in rows), key=key)


def test_answers_at_the_edges(spark, edges):
    at, rows = edges
    op9 = {r["doc_id"]: r for r in QUERIES["op9_suffix_radix"](spark, at).collect()}
    assert (op9[3]["n_bytes"], op9[3]["n_removed"], op9[3]["n_spans"]) == (0, 0, 0) and op9[3]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert op9[8]["n_removed"] == op9[8]["n_bytes"] == len(rows[0][1][:5000].encode()) and op9[1]["n_removed"] == op9[8]["n_bytes"]
    assert op9[6]["n_removed"] == 200_000 and op9[6]["n_spans"] == 1
    op6 = {r["doc_id"]: r for r in QUERIES["op6_simhash_multi_index"](spark, at).collect()}
    assert op6[2]["fingerprint"] == op6[3]["fingerprint"] == "0" * 16 and op6[2]["component_id"] == op6[7]["component_id"] == 2
    op2 = {r["doc_id"]: r["items"] for r in QUERIES["op2_decontaminate_cgk"](spark, at).collect()}
    assert op2[1] == op2[8] == [1] and op2[2] == op2[3] == op2[5] == []
    op10 = {r["doc_id"]: r["lang_pred"] for r in QUERIES["op10_language_bayes"](spark, at).collect()}
    assert op10[2] == op10[3] == op10[7] == "und"
    op8 = QUERIES["op8_embedding_sorted_passes"](spark, at).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"]) for r in op8)[-2:] == [(2, 2), (2, 2)]
    assert QUERIES["op3_url_templates"](spark, at).count() == 4


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables_give_no_rows(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


def test_the_pipeline_at_the_edges(spark, edges, empty):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    for at in (edges[0], empty):
        docs = spark.read.parquet(f"{at}/documents.parquet")
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, at)
            assert docs.columns == columns
        docs.count()
    got = {r["doc_id"]: r["size"] for r in corpus_pipeline.run(spark, edges[0]).collect()}
    assert 5 in got and 2 not in got and all(got.values())
    assert corpus_pipeline.run(spark, empty).count() == 0
