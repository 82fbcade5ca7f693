"""Toxicity as a severity grade: cumulative-link ordinal regression on sparse text features.

One weight vector serves all thresholds: P(grade <= k) = sigmoid(threshold_k - weights . x), with thresholds
in ascending order. x counts, for hashed words and word beginnings, the distinct words of the text that
have them. Features are screened by how strongly they go with the labels, which keeps the noise of long texts
out of the sum. The model is fitted on a bounded sample of labelled rows (``sample_rows``, taken in the
order of a hash of the id); every text is scored whole.

Grades come from the labels alone: from their ``grade`` where there is one, with a threshold below each grade but the lowest; else
from ``toxic``, which has two grades, so that the model has one threshold and the expected severity is the probability of being toxic.

Defined cases: a null text or one without words has severity 0 and grade 0; very long texts count each word once; labels that
are null or have no document are left out, and of several labels of one document the most severe counts; without labelled rows,
or with one grade only, all get severity 0; a document whose odds are even at a threshold gets the lower grade; features that
tie are taken in the order of their number; repeated rows are scored alike; other columns are kept, and ``severity``,
``p_toxic`` and ``grade`` are replaced if they exist.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weir.plans.durable import durable, unused

WORD = re.compile(r"\w+")
#: Lengths of the word beginnings that are features beside the word, and the number of hash buckets.
BEGINNINGS, BUCKETS = (4, 5), 1 << 22
#: Words whose weight a task remembers, about.
KNOWN = 300_000


def _features(word: str) -> tuple[int, ...]:
    parts = [f"={word}", *(word[:n] for n in BEGINNINGS if len(word) > n)]
    return tuple(xxhash.xxh32_intdigest(p) % BUCKETS for p in parts)


def _words(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def _tokenised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The features of each text, one for each of its words that has it, and a number that copies of a text share."""
    for batch in batches:
        rows = []
        for text, grade in zip(batch["text"], batch["grade"]):
            words = _words(text)
            rows.append(([f for w in words for f in _features(w)], int(grade), min(map(xxhash.xxh64_intdigest, words), default=0) >> 1))
        yield pd.DataFrame(rows, columns=["x", "grade", "like"])


@dataclass
class Model:
    """weights: by feature; thresholds: ascending, one less than there are grades."""

    weights: dict[int, float]
    thresholds: list[float]

    def scores(self, texts: pd.Series, known: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
        """The linear score of each text and whether it has words; known: word weights so far."""
        eta, some = np.zeros(len(texts)), np.zeros(len(texts), bool)
        for i, text in enumerate(texts):
            if len(known) > KNOWN:
                known.clear()
            words = _words(text)
            some[i] = bool(words)
            for w in words:
                if (x := known.get(w)) is None:
                    x = known[w] = sum(self.weights.get(f, 0.0) for f in _features(w))
                eta[i] += x
        return eta, some


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit_ordinal(x: list[np.ndarray], y: np.ndarray, weight: np.ndarray, n_features: int, l2: float = 1.0, steps: int = 400, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by gradient ascent with Adam. x: feature numbers of each row, repeats included."""
    k = int(y.max())
    rows, cols = np.repeat(np.arange(len(x)), [len(f) for f in x]), np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64)
    params = np.concatenate([np.zeros(n_features), [1.0], np.zeros(k - 1)])  # thresholds as a first and log gaps
    m, v = np.zeros_like(params), np.zeros_like(params)
    lower, upper = np.maximum(y - 1, 0), np.minimum(y, k - 1)
    for step in range(1, steps + 1):
        w, gaps = params[:n_features], np.exp(params[n_features + 1 :])
        cut = params[n_features] + np.concatenate([[0.0], np.cumsum(gaps)])
        eta = np.bincount(rows, w[cols], len(x))
        hi, lo = _sigmoid(cut[upper] - eta), _sigmoid(cut[lower] - eta)
        hi, lo = np.where(y == k, 1.0, hi), np.where(y == 0, 0.0, lo)
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = weight * hi * (1 - hi) / p, weight * lo * (1 - lo) / p
        d_eta = d_lo - d_hi
        d_cut = np.bincount(upper, d_hi * (y < k), k) - np.bincount(lower, d_lo * (y > 0), k)
        behind = np.cumsum(d_cut[::-1])[::-1]
        grad = np.concatenate([np.bincount(cols, d_eta[rows], n_features) - l2 * w, [behind[0]], behind[1:] * gaps - 0.01 * params[n_features + 1 :]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    gaps = np.exp(params[n_features + 1 :])
    return params[:n_features], params[n_features] + np.concatenate([[0.0], np.cumsum(gaps)])


def grades(labels: DataFrame) -> DataFrame:
    """``doc_id, grade``: the most severe grade of each labelled document."""
    grade = F.col("grade" if "grade" in labels.columns else "toxic").cast("int")
    return labels.filter(F.col("doc_id").isNotNull() & grade.isNotNull()).groupBy("doc_id").agg(F.greatest(F.max(grade), F.lit(0)).alias("grade"))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 12_000, z: float = 6.0, least: int = 4, features: int = 20_000, l2: float = 0.3) -> Model:
    """Fit on at most ``sample_rows`` labelled documents. labels: ``doc_id`` and ``grade``, or ``toxic``.

    z, least: how strongly a feature must go with toxic labels, and in how many documents it must be; features: the strongest ones
    that a model has at most; l2: how strongly weights are held near 0, chosen on labels kept away from the fit.
    """
    known = grades(labels).orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id").limit(sample_rows)  # the bound
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "grade")
    sample = durable(sample.mapInPandas(_tokenised, "x array<int>, grade int, like long"), "toxicity-sample")  # texts are read once
    n, bad = sample.agg(F.count("*"), F.count_if(F.col("grade") > 0)).first()
    if not bad or bad == n:
        return Model({}, [0.0])
    has = sample.select(F.explode(F.array_distinct("x")).alias("feature"), (F.col("grade") > 0).alias("toxic"))
    counts = has.groupBy("feature").agg(F.count("*").alias("all"), F.count_if("toxic").alias("bad"))
    share = F.col("all") / F.lit(float(n))
    gap = F.col("bad") / F.lit(float(bad)) - (F.col("all") - F.col("bad")) / F.lit(float(n - bad))
    score = gap / F.sqrt(share * (1 - share) * F.lit(1 / bad + 1 / (n - bad)))
    strong = counts.filter((F.col("all") >= least) & (share < 1) & (F.abs(score) >= z)).select("feature", score.alias("z"))
    picked = strong.orderBy(F.abs("z").desc(), "feature").limit(features).toPandas()
    at = {int(f): i for i, f in enumerate(picked["feature"])}

    def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(x=batch["x"].map(lambda x: sorted(at[f] for f in x if f in at)))

    got = sample.mapInPandas(reduced, sample.schema).toPandas()  # at most sample_rows
    got = got.assign(x=got["x"].map(tuple)).sort_values(["like", "grade", "x"], ignore_index=True)  # reruns agree
    y = np.unique(got["grade"].to_numpy(), return_inverse=True)[1] if got["grade"].nunique() <= got["grade"].max() else got["grade"].to_numpy()  # grades without rows have no threshold
    weight = 1 / got.groupby("like")["like"].transform("size").to_numpy()  # copies of one text count once between them
    w, cut = fit_ordinal([np.asarray(r, np.int64) for r in got["x"]], y, weight, len(at), l2)
    return Model({f: float(w[i]) for f, i in at.items()}, [float(c) for c in cut])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``severity`` (expected grade), ``p_toxic`` (of grade 1 or more) and ``grade`` (the median)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as many weights as ``fit`` took features

    @F.pandas_udf(T.StructType([T.StructField("severity", T.DoubleType()), T.StructField("p_toxic", T.DoubleType()), T.StructField("grade", T.IntegerType())]))
    def graded(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[str, float] = {}
        for texts in series:
            eta, some = shared.value.scores(texts, known)
            above = 1 - _sigmoid(np.array(shared.value.thresholds)[None, :] - eta[:, None])
            if not shared.value.weights:
                above = np.zeros_like(above)
            above[~some] = 0
            yield pd.DataFrame({"severity": above.sum(1), "p_toxic": above[:, 0], "grade": (above > 0.5).sum(1).astype("int32")})

    at = unused(docs, "scored_")
    return docs.withColumn(at, graded("text")).withColumns({c: F.col(at)[c] for c in ("severity", "p_toxic", "grade")}).drop(at)
