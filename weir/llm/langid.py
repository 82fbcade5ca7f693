"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; everything but letters becomes one space; n-grams of two and three characters are
hashed into a fixed number of buckets. The log-probability matrix (buckets by languages) is broadcast, and
batches of texts are scored at once in numpy. It is fitted on a bounded sample of labelled rows
(``sample_rows``, in the order of a hash of id and text); every text is scored whole.

Defined cases: a null text or one without a letter is ``und`` with score 0; with no labelled text to learn
from all are ``und``; very long texts count all their n-grams; a tie goes to the first language in code point order; repeated rows get the same
answer; other columns are kept, and ``lang_pred`` and ``score`` are replaced if they exist.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.plans.durable import unused

BUCKETS = 1 << 15
#: Characters of text handled at once.
CHUNK = 1 << 20
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, and the text that each belongs to."""
    parts = [f" {t.lower()} " if t else "" for t in texts]
    c = np.frombuffer("".join(parts).encode("utf-32-le"), "<u4")
    doc = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
    is_letter = letters()[c]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    keep[:-1] |= is_letter[1:]
    c = np.where(is_letter, c, 32).astype(np.uint32)[keep]
    doc = doc[keep]
    grams, docs = [], []
    mixed = c * np.uint32(0x9E3779B1)
    for more in (1, 2):
        mixed = (mixed[:-1] ^ (mixed[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + c[more:]
        within = doc[more:] == doc[: len(doc) - more]
        h = mixed * np.uint32(0xC2B2AE3D)
        grams.append(((h ^ (h >> np.uint32(16))) % np.uint32(BUCKETS))[within].astype(np.int32))
        docs.append(doc[more:][within])
    return np.concatenate(grams), np.concatenate(docs)


def chunks(texts: pd.Series) -> Iterator[tuple[int, list]]:
    """Consecutive texts of about CHUNK characters, with the place of the first."""
    start, size, some = 0, 0, []
    for i, t in enumerate(texts):
        some.append(t)
        size += len(t) if t else 0
        if size >= CHUNK:
            yield start, some
            start, size, some = i + 1, 0, []
    if some:
        yield start, some


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per task: how often each bucket occurs in each language."""
    totals: dict[str, np.ndarray] = {}
    n_docs: dict[str, int] = {}
    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            for _, some in chunks(texts):
                totals[lang] = totals.get(lang, 0) + np.bincount(ngrams(some)[0], minlength=BUCKETS)
            n_docs[lang] = n_docs.get(lang, 0) + len(texts)
    for lang, total in totals.items():
        at = np.flatnonzero(total)
        yield pd.DataFrame({"lang": lang, "bucket": np.append(at, -1).astype("int32"), "n": np.append(total[at], n_docs[lang])})


def fit(labelled: DataFrame, sample_rows: int = 20_000, smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages and the matrix of log-probabilities, from ``doc_id, text, lang``; the last row has the priors."""
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.withColumn("pick", F.xxhash64(F.lit("sample"), "doc_id", "text"))  # repeated rows are one
    picked = rows.select("pick").distinct().orderBy("pick").limit(sample_rows)  # the bound
    sample = rows.join(F.broadcast(picked), "pick", "left_semi").dropDuplicates(["pick"]).select("text", "lang")
    got = sample.mapInPandas(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    counts = np.zeros((BUCKETS + 1, len(langs)))
    counts[got["bucket"].to_numpy("int64"), got["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy("int64")] = got["n"]
    grams = counts[:BUCKETS] + smoothing
    matrix = np.vstack([np.log(grams / grams.sum(0)), np.log(np.maximum(counts[BUCKETS:], 1) / max(counts[BUCKETS].sum(), 1))])
    return langs, matrix.astype(np.float32)


def predict(docs: DataFrame, langs: list[str], matrix: np.ndarray, evidence: float = 30.0) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``: the share of the predicted language in the posterior, with the
    likelihood of long texts tempered to that of ``evidence`` n-grams."""
    shared = docs.sparkSession.sparkContext.broadcast((langs, matrix))

    @F.pandas_udf("lang_pred string, score double")
    def scored(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        langs, matrix = shared.value
        columns = [np.ascontiguousarray(matrix[:, i]) for i in range(len(langs))]
        for batch in series:
            out_lang, out_score = np.full(len(batch), "und", dtype=object), np.zeros(len(batch))
            for start, texts in chunks(batch) if langs else ():
                grams, doc = ngrams(texts)
                n = np.bincount(doc, minlength=len(texts))
                ll = np.stack([np.bincount(doc, c[grams], len(texts)) + c[-1] for c in columns], 1)
                best = ll.argmax(1)
                ll = (ll - ll.max(1, keepdims=True)) * np.minimum(1, evidence / np.maximum(n, 1))[:, None]
                post = np.exp(ll)
                post /= post.sum(1, keepdims=True)
                some = np.flatnonzero(n > 0)
                out_lang[start + some] = np.array(langs, dtype=object)[best[some]]
                out_score[start + some] = post[some, best[some]]
            yield pd.DataFrame({"lang_pred": out_lang, "score": out_score})

    at = unused(docs, "scored_")
    return docs.withColumn(at, scored("text")).withColumns({c: F.col(at)[c] for c in ("lang_pred", "score")}).drop(at)
