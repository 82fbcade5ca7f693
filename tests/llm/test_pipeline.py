"""The corpus pipeline's stages against brute force."""

import random
import re

import numpy as np
import pytest

from weir.llm import simhash

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def edited(rng, text, share):
    words = text.split()
    for i in range(len(words)):
        if rng.random() < share:
            words[i] = sentence(rng, 1)
    return " ".join(words)


def shingles(text, k=5):
    words = text.lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_wide_segments_cover_disjoint_bits():
    bits = [b for first, n in simhash.WIDE for b in range(first, first + n)]
    assert len(bits) == len(set(bits)) and max(bits) < 128
    assert simhash.wide_distance(0.8, 128, 0) == 19 and simhash.wide_distance(1.0, 512, 1) == 0


def test_spanning_links_are_the_lightest():
    rng = np.random.default_rng(3)
    a, b, w = rng.integers(0, 60, 300), rng.integers(0, 60, 300), rng.integers(0, 20, 300)
    kept = simhash.spanning(a, b, w, 60)

    def joined(places):  # by weight, one link after the other
        root, total = list(range(60)), 0
        find = lambda x: x if root[x] == x else find(root[x])
        for i in sorted(places, key=lambda i: w[i]):
            x, y = find(a[i]), find(b[i])
            if x != y:
                root[x], total = y, total + w[i]
        return len({find(x) for x in range(60)}), total

    assert joined(kept) == joined(range(300)) and w[kept].sum() == joined(kept)[1]


@pytest.mark.parametrize("small", [1 << 10, 8])
def test_near_copies_go_and_others_stay(spark, monkeypatch, small):
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = random.Random(6)
    rows, group = [], {}
    for g in range(60):
        base = sentence(rng, rng.randint(80, 400))
        for c in range(1 + g % 4):
            i = len(rows)
            rows.append((i * 7 % 1009, base.upper() if c == 3 else edited(rng, base, 0.008 * c), "en", "s"))
            group[rows[-1][0]] = g
    got = {r["doc_id"] for r in simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string, lang string, root string")).collect()}
    texts = {i: shingles(t) for i, t, *_ in rows}
    assert {group[i] for i in got} == set(range(60))  # each group keeps one
    for i, g in group.items():
        alike = [k for k in group if group[k] == g and jaccard(texts[i], texts[k]) >= 0.9]
        assert i not in got or i == min(alike)
    assert all(i == min(k for k in group if group[k] == group[i]) for i in got if all(jaccard(texts[i], texts[k]) > 0.85 for k in group if group[k] == group[i]))


def test_dense_group_is_one(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 64)  # several cells a bucket
    rng = random.Random(7)
    base = sentence(rng, 300)
    rows = [(i, edited(rng, base, 0.004), "s") for i in range(500)] + [(1000 + i, sentence(rng, 50), "s") for i in range(50)]
    got = sorted(r["doc_id"] for r in simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())
    assert got == [0, *range(1000, 1050)]


def from_template(rng, n, own):
    """Texts of one template of 200 words, each with so many words of its own."""
    base = sentence(rng, 200)
    return [f"{base} {' '.join(f'w{i}x{rng.getrandbits(40)}' for _ in range(own))}" for i in range(n)]


def test_texts_of_one_template_stay(spark):
    texts = from_template(random.Random(11), 200, 36)
    sets = [shingles(t) for t in texts]
    assert 0.7 < max(jaccard(a, b) for k, a in enumerate(sets) for b in sets[:k]) < 0.8
    got = simhash.representatives(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(200))


@pytest.mark.parametrize("small", [1 << 10, 8])
def test_near_copies_in_a_template_are_found(spark, monkeypatch, small):
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = random.Random(12)
    texts = from_template(rng, 400, 40)
    copies = [" ".join([*t.split()[:-14], *(f"c{i}x{rng.getrandbits(40)}" for _ in range(14))]) for i, t in enumerate(texts[:80])]
    similar = [jaccard(shingles(a), shingles(b)) for a, b in zip(texts, copies)]
    assert 0.85 < min(similar) and max(similar) < 0.9
    got = simhash.representatives(spark.createDataFrame(list(enumerate(texts + copies)), "doc_id long, text string"))
    left = {r["doc_id"] for r in got.collect()}
    assert set(range(400)) <= left and len(left) <= 402  # a pair of 0.85 meets in 97 of 100 cases


def test_most_pairs_just_above_the_limit_are_found_and_none_below(spark):
    rng = random.Random(13)
    texts = [sentence(rng, rng.randint(150, 400)) for _ in range(500)]
    copies = [edited(rng, t, rng.uniform(0.018, 0.035)) for t in texts]
    similar = np.array([jaccard(shingles(a), shingles(b)) for a, b in zip(texts, copies)])
    got = simhash.representatives(spark.createDataFrame(list(enumerate(texts + copies)), "doc_id long, text string"))
    left = {r["doc_id"] for r in got.collect()}
    gone = np.array([500 + i not in left for i in range(500)])
    band = (similar >= 0.8) & (similar < 0.85)
    assert set(range(500)) <= left and band.sum() > 100 and gone[band].mean() >= 0.9
    assert not gone[similar < 0.8].any() and (similar < 0.8).sum() > 30


@pytest.mark.parametrize("part", [512, 16])
def test_the_second_look_has_the_groups_of_all_pairs(spark, monkeypatch, part):
    monkeypatch.setattr(simhash, "PART", part)
    rng = random.Random(14)
    texts = from_template(rng, 40, 40)  # alike below the limit; copies of some are above it
    texts += [edited(rng, rng.choice(texts[:10]), 0.01) for _ in range(60)]
    sets = [shingles(t) for t in texts]
    got = {r["doc_id"]: r["root"] for r in simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8 and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    groups = lambda of: {frozenset(k for k in range(len(texts)) if of[k] == v) for v in {of[k] for k in range(len(texts))}}
    assert groups(got) == groups(root)


def test_rows_without_words_or_ids(spark):
    rows = [(None, "one two three four five six", "a"), (None, "one two three four five six", "b"), (3, None, "c"), (2, "", "d"), (5, " \t", "e"), (7, "alone here", "f"), (7, "alone here", "g"), (7, "another text with the same id as others", "h")]
    got = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == [(0, rows[0][1]), (2, ""), (7, "alone here"), (7, rows[7][1])]
    assert simhash.representatives(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_mixing_stage_tells_equal_rows_apart(spark):
    rng = random.Random(8)
    rows = [(i, sentence(rng, rng.randint(0, 30)), "en", rng.choice(["a", "b", None]), 5) for i in range(300)] + [(None, "w w w", "en", "a", 5)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.mix_sources(spark, docs, "").collect()
    mixed = corpus_pipeline.mixing.mix(docs).filter("taken > 0").collect()
    plain = lambda rs: sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in rs)
    assert plain(got) == plain(mixed)
    assert all(r["size"] == len(r["text"].split()) for r in got)


def test_stages_on_the_small_tables(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash", "decontamination", "pii", "mixing"]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    items = [" ".join(re.findall(r"\w+", r["text"].lower())) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    before = docs.collect()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = docs.collect()
        ids = {r["doc_id"] for r in after}
        gone = [r for r in before if r["doc_id"] not in ids]
        if name != "mixing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "toxicity":
            toxic = [r for r in before if labels.get(r["doc_id"]) == 1]
            assert sum(r["doc_id"] in ids for r in toxic) <= 0.4 * len(toxic)  # few labels to learn from here
            assert not any(labels.get(r["doc_id"]) == 0 for r in gone)
        if name == "simhash":
            sets = {r["doc_id"]: shingles(r["text"]) for r in before}
            left = [sets[r["doc_id"]] for r in after]
            sizes = np.array([len(s) for s in left])
            for r in gone:  # each has a near copy that was there
                s = sets[r["doc_id"]]
                assert any(jaccard(s, o) > 0.5 for i, o in sets.items() if i != r["doc_id"] and 0.5 < len(s) / len(o) < 2)
            pairs = sum(jaccard(left[i], left[j]) >= 0.85 for i in range(len(left)) for j in np.flatnonzero((sizes[:i] > 0.85 * sizes[i]) & (sizes[:i] * 0.85 < sizes[i])) if len(left[i] & left[j]))
            assert pairs <= 0.05 * len(gone)
        if name == "decontamination":
            assert not any(i in f" {' '.join(re.findall(chr(92) + 'w+', r['text'].lower()))} " for r in after for i in items if len(i.split()) >= 5)
        if name == "pii":
            assert len(after) == len(before) and all(r["n_chars"] == len(r["text"]) for r in after)
        before = after
    assert {"size", "source_size", "target", "taken"} <= set(docs.columns) and all(r["taken"] > 0 for r in before)
    assert corpus_pipeline.run.__name__ == "run" and corpus_pipeline.ORACLE_SQL is None
