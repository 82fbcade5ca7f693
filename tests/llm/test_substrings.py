"""Repeated windows of bytes and words against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from weir.llm import fingerprint_index, repeats, suffixes
from weir.llm.queries import QUERIES
from weir.plans.durable import fresh_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def covered(sequences, length):
    seen = Counter(tuple(s[i : i + length]) if isinstance(s, list) else s[i : i + length] for s in sequences for i in range(len(s) - length + 1))
    out = []
    for s in sequences:
        mask = np.zeros(len(s), bool)
        for i in range(len(s) - length + 1):
            if seen[tuple(s[i : i + length]) if isinstance(s, list) else s[i : i + length]] > 1:
                mask[i : i + length] = True
        out.append(mask)
    return out


def runs(mask):
    return int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())


def texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ü\t")[:1] for _ in range(rng.randint(1, 6))).strip() or "w"
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(n) for n in (30, 60, 90)]
    out = [None, "", " ", "a", text(20), text(500)]
    for i in range(40):
        parts = [text(rng.randint(0, 80)) for _ in range(3)]
        out.append(f"{parts[0]} {rng.choice(shared)} {parts[1]}" + (f"\n{rng.choice(shared)} {parts[2]}" if i % 3 else ""))
    out += [out[8], out[8], "x" * 900, shared[2][: len(shared[2]) // 2], "ab" * 300 + " " + "ab" * 20, text(1200)]
    out[-1] += out[-1][-500:]
    return out


@pytest.fixture(scope="module", params=[1, 2])
def table(request, spark, tmp_path_factory):
    rows = [(i, t, "s", i) for i, t in enumerate(texts(request.param))]
    rows += rows[10:11]  # a repeated row
    at = tmp_path_factory.mktemp("substrings")
    spark.createDataFrame(rows, "doc_id long, text string, spans string, key int").repartition(4).write.parquet(f"{at}/documents.parquet")
    return str(at), rows


@pytest.mark.parametrize("chunk", [1 << 20, 700])
def test_bytes(spark, table, monkeypatch, chunk):
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    at, rows = table
    docs = spark.read.parquet(f"{at}/documents.parquet")
    data = [(t or "").encode() for _, t, *_ in rows]
    masks = covered(data, 100)
    got = {bytes(r["key"]): r for r in suffixes.repeated_bytes(docs, 100, 20).collect()}
    for d, m in zip(data, masks):
        r = got.get(hashlib.sha256(d).digest())
        assert (r is not None) == m.any()
        if r:
            assert bytes(r["kept"]) == np.frombuffer(d, np.uint8)[~m].tobytes()
            assert len(r["spans"]) == runs(m)


def test_bytes_query(spark, table):
    at, rows = table
    data = [(t or "").encode() for _, t, *_ in rows]
    want = Counter((i, len(d), int(m.sum()), runs(m), hashlib.sha256(np.frombuffer(d, np.uint8)[~m].tobytes()).hexdigest()) for (i, *_), d, m in zip(rows, data, covered(data, 400)))
    got = QUERIES["op9_suffix_radix"](spark, at).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == want


def test_words_query(spark, table):
    at, rows = table
    words = [WORD.findall(t or "") for _, t, *_ in rows]
    want = Counter((i, len(w), int(m.sum()), hashlib.sha256(" ".join(x for x, c in zip(w, m) if not c).encode()).hexdigest()) for (i, *_), w, m in zip(rows, words, covered(words, 35)))
    got = QUERIES["op5_substring_index"](spark, at).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == want


def test_words_in_small_pieces(spark, table, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 300)
    at, rows = table
    words = [WORD.findall(t or "") for _, t, *_ in rows]
    masks = covered(words, 12)
    got = {bytes(r["key"]): r for r in fingerprint_index.repeated_words(spark.read.parquet(f"{at}/documents.parquet"), 12, 5).collect()}
    for (_, t, *_), w, m in zip(rows, words, masks):
        r = got.get(hashlib.sha256((t or "").encode()).digest()) if t is not None else None
        assert (r is not None) == m.any()
        if r:
            assert r["kept"] == " ".join(x for x, c in zip(w, m) if not c)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.repeated_bytes(none).count() == 0
    assert fingerprint_index.repeated_words(none).count() == 0


def grams(spark, *x):
    return spark.createDataFrame([(g,) for g in x], "gram long")


def told(df):
    return sorted(r["gram"] for r in df.collect())


def test_index_meets_history_and_compacts(spark):
    index = fingerprint_index.FingerprintIndex(spark, fresh_path(spark, "index"))
    assert told(index.add(grams(spark, 1, 2, 3))) == []
    assert told(index.add(grams(spark, 3, 4, 4))) == [3, 4]
    assert told(index.add(grams(spark, 1, 5))) == [1]
    assert [len(level) for level in index.levels] == [1, 1]
    assert told(index.repeated()) == [1, 3, 4]
    assert told(index.add(grams(spark))) == [] and [len(level) for level in index.levels] == [0, 0, 1]


def test_an_index_is_closed_opened_and_added_to(spark):
    rng = random.Random(4)
    batches = [[rng.randrange(-3000, 3000) for _ in range(700)] for _ in range(5)]
    path = fresh_path(spark, "index")
    for k, batch in enumerate(batches):
        index = fingerprint_index.FingerprintIndex(spark, path, buckets=4 if k == 0 else None)
        assert (index.version, index.buckets) == (k, 4)
        before = {g for b in batches[:k] for g in b}
        assert told(index.add(grams(spark, *batch))) == sorted(g for g, n in Counter(batch).items() if n > 1 or g in before)
        for level in index.levels:  # another session has no tables of the catalog, only the folder
            for name in level:
                spark.sql(f"DROP TABLE IF EXISTS {name}")
    again = fingerprint_index.FingerprintIndex(spark, path)
    assert told(again.repeated()) == sorted(g for g, n in Counter(g for b in batches for g in b).items() if n > 1)
    assert [len(level) for level in again.levels] == [1, 0, 1]


def test_runs_are_joined_without_a_shuffle(spark):
    index = fingerprint_index.FingerprintIndex(spark, fresh_path(spark, "index"), buckets=8)
    for k in range(3):
        index.add(grams(spark, *range(k * 50, k * 50 + 100)))
    a, b = index.runs()
    plan = a.join(b.hint("merge"), "gram", "left")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_a_crash_before_the_manifest_leaves_the_version_before(spark, monkeypatch):
    path = fresh_path(spark, "index")
    fingerprint_index.FingerprintIndex(spark, path).add(grams(spark, 1, 2))
    index = fingerprint_index.FingerprintIndex(spark, path)
    monkeypatch.setattr(index, "MANIFEST", "no schema")
    with pytest.raises(Exception):
        index.add(grams(spark, 2, 3))
    index = fingerprint_index.FingerprintIndex(spark, path)
    assert index.version == 1 and told(index.add(grams(spark, 2, 3))) == [2]
