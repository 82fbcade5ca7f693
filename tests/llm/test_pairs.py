"""SimHash, vectors and components against brute force."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from weir.llm import simhash, vectors
from weir.llm.components import components, forest
from weir.llm.queries import QUERIES


def least_reachable(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_stars_and_noise(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(0, 200)] + [(500, 500 + i) for i in range(1, 150)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)] + [(7, 7)]
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = least_reachable({x for p in links for x in p}, links)
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    assert groups(got) == groups({k: v for k, v in want.items()})
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest_spans():
    a, b = forest(np.array([1, 2, 9]), np.array([2, 3, 8]))
    assert sorted(zip(a.tolist(), b.tolist())) == [(2, 1), (3, 1), (9, 8)]
    assert not len(forest(np.array([], int), np.array([], int))[0])


def plain_fingerprint(text, k):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark):
    texts = [None, "", " \t", "One", "one two three", "A b c d e\x0bF g ÄÖ é", "x " * 200, "a b\xa0c d e", "w1 w2 w3 w4 " * 40 + "tail"]
    got = simhash.fingerprints(spark.createDataFrame([(t,) for t in texts], "text string"), 4).collect()
    assert [r["fp"] & (1 << 64) - 1 for r in got] == [plain_fingerprint(t, 4) for t in texts]


def test_simhash_links_all_pairs_within_distance(spark, monkeypatch):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(60)]
    prints = set(base)
    for b in base[:25]:
        x = b
        for _ in range(12):  # chains and dense groups of near fingerprints
            for bit in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << bit
            prints.add(x)
    dense = rng.getrandbits(64)
    prints |= {dense ^ (1 << a) ^ (1 << b) for a in range(10) for b in range(a)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = [(a, b) for i, a in enumerate(prints) for b in prints[:i] if bin(a ^ b).count("1") <= 4]
    want = least_reachable(prints, links)
    for cell in (1 << 14, 64):  # with and without hot buckets
        monkeypatch.setattr(simhash, "CELL", cell)
        found = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()
        found = [(r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1) for r in found]
        assert least_reachable(prints, found) == want


def test_simhash_query_on_small_table(spark, tmp_path):
    text = "the quick brown fox jumps over the lazy dog and runs away from here"
    rows = [(4, text, "x", 1), (2, text, "y", 2), (9, text.upper(), None, 3), (5, None, None, None), (6, "", "z", 5), (7, "something else entirely is written in this one", "z", 6), (7, "something else entirely is written in this one", "z", 6)]
    spark.createDataFrame(rows, "doc_id long, text string, component_id string, fp int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["component_id"]) for r in QUERIES["op6_simhash_multi_index"](spark, str(tmp_path)).collect()}
    assert got == {(4, 2), (2, 2), (9, 2), (5, 5), (6, 5), (7, 7)}


def plain_vectors(rows, threshold):
    ok = [(i, np.array(v, float), l) for i, v, l in rows if l is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = [(a, b) for n, (a, x, l) in enumerate(ok) for b, y, m in ok[:n] if l == m and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold]
    count = {i: 0 for i, _, _ in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return count, least_reachable(list(count), links)


def vector_rows(rng, near=40):
    rows = []
    for label in (1, 2):
        for _ in range(30):
            rows.append((rng.standard_normal(16).tolist(), label))
        for size in (3, near):
            centre = rng.standard_normal(16)
            rows += [((centre + rng.standard_normal(16) * 0.08).tolist(), label) for _ in range(size)]
    same = rng.standard_normal(16).tolist()
    rows += [(same, 1)] * 5 + [(same, 2), ([2 * x for x in same], 1)]
    rows += [(None, 1), ([0.0] * 16, 1), ([float("nan")] * 16, 1), ([float("inf")] + [1.0] * 15, 2), ([None] + [1.0] * 15, 2), (same, None), ([1.0, 2.0], 1), ([], 2), ([2.0, 4.0], 1)]
    return [(i, v, l) for i, (v, l) in enumerate(rows)]


def test_vectors_match_brute_force(spark):
    rows = vector_rows(np.random.default_rng(8))
    count, least = plain_vectors(rows, 0.93)
    df = spark.createDataFrame([(*r, "more") for r in rows], "vec_id long, embedding array<double>, label int, n_links string")
    got = {r["vec_id"]: r for r in vectors.near_duplicates(df, 0.93).collect()}
    assert {i: r["n_links"] for i, r in got.items()} == count
    assert {i: r["component_id"] for i, r in got.items()} == least
    assert all(r["kept"] == (i == least[i]) for i, r in got.items())


def test_vectors_in_many_blocks_count_each_pair_once(spark):
    rows = vector_rows(np.random.default_rng(9), near=120)
    count, _ = plain_vectors(rows, 0.93)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_duplicates(df, 0.93, block=16).collect()}
    assert all(got[i] <= count[i] for i in count)  # none twice, none below the threshold
    assert sum(got.values()) >= 0.98 * sum(count.values())


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def brute(x, label, threshold=0.93):
    """Links of each vector, and the component of each, by all pairs in slices."""
    n, root, u = np.zeros(len(x), np.int64), np.arange(len(x)), unit(x.astype(np.float32).astype(float))
    for m in np.unique(label):
        at = np.flatnonzero(label == m)
        for lo in range(0, len(at), 500):
            part = at[lo : lo + 500]
            near = u[part] @ u[at].T >= threshold
            near[np.arange(len(part)), lo + np.arange(len(part))] = False
            n[part] += near.sum(1)
            i, j = np.nonzero(near)
            a, b = forest(np.concatenate([part[i], np.arange(len(x))]), np.concatenate([at[j], root]))
            root[a] = b
    return n, root


def measured(spark, x, label, **options):
    rows = [(i, v, int(m)) for i, (v, m) in enumerate(zip(x.astype(np.float32).tolist(), label))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_duplicates(df, 0.93, **options).collect()}
    return np.array([got[i] for i in range(len(x))])


def test_planted_pairs_of_labels_of_many_blocks_are_found(spark):
    rng = np.random.default_rng(21)
    x = unit(rng.standard_normal((12_000, 64)))
    near = unit(x[: 3000 : 2] + unit(rng.standard_normal((1500, 64))) * rng.uniform(0.1, 0.39, (1500, 1)))  # cosine 0.93 to 0.99
    x[1:3000:2] = near
    label = np.arange(12_000) // 2 % 3
    want, _ = brute(x, label)
    got = measured(spark, x, label, block=64)  # over 60 blocks a label
    assert want.sum() > 2000 and (got <= want).all() and got.sum() >= 0.97 * want.sum()


def test_a_dense_group_of_many_blocks_keeps_its_links(spark):
    rng = np.random.default_rng(22)
    centre = unit(rng.standard_normal(64))
    x = unit(centre + unit(rng.standard_normal((6000, 64))) * 0.23)  # pairs near 0.95
    x[5000:] = unit(rng.standard_normal((1000, 64)))
    label = np.ones(6000, int)
    want, _ = brute(x, label)
    got = measured(spark, x, label, block=64)  # 94 blocks
    assert want.mean() > 2000 and (got <= want).all() and got.sum() >= 0.97 * want.sum()


def test_vectors_without_ids_link(spark):
    rows = [(None, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (None, [2.0, 4.1], 1), (7, [5.0, -1.0], 1), (None, [5.0, -1.0], 1)]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((r["n_links"], r["component_id"] or 0, r["kept"]) for r in got if r["vec_id"] is None) == [(1, 7, None), (2, 0, None), (2, 0, None), (2, 0, None)]
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] == 7] == [(1, 7, True)]


def test_vectors_of_an_empty_table(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_vector_query_recall(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    count, least = plain_vectors(rows, 0.93)
    got = QUERIES["op8_embedding_sorted_passes"](spark, sf).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {i: (count[i], least[i]) for i in count}


def test_simhash_query_against_brute_force(spark, sf):
    got = QUERIES["op6_simhash_multi_index"](spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    prints = {r["doc_id"]: plain_fingerprint(r["text"], 4) for r in docs}
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in got} == prints
    ids = list(prints)
    f = np.array([prints[i] for i in ids], np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 4
    links = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(near, 1)))]
    assert {r["doc_id"]: r["component_id"] for r in got} == least_reachable(ids, links)
    assert F.col  # the session is up
