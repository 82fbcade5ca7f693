"""Classification, decontamination, PII, urls and mixing."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weir.llm import decontamination, langid, mixing, pii, toxicity, urls
from weir.llm.queries import QUERIES, URL_RULES


def test_toxicity_of_documents_whose_labels_were_kept_away(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = toxicity.fit(docs, labels.filter(~held_out))
    got = toxicity.score(docs.join(labels.filter(held_out), "doc_id"), model)
    n = {(r["toxic"], r["bad"]): r["count"] for r in got.groupBy("toxic", (F.col("grade") > 0).alias("bad")).count().collect()}
    assert n[1, True] >= 0.85 * (n[1, True] + n.get((1, False), 0)) and n.get((0, True), 0) <= 0.01 * n[0, False]
    assert len(model.thresholds) == 1  # the labels have two grades


def likelihood(x, y, weight, w, cut, l2=1.0):
    """The penalised log-likelihood of cumulative links, row by row."""
    total = -l2 / 2 * sum(v * v for v in w)
    for row, grade, k in zip(x, y, weight):
        eta = sum(w[f] for f in row)
        upto = lambda g: 1.0 if g >= len(cut) else 0.0 if g < 0 else 1 / (1 + math.exp(eta - cut[g]))  # noqa: B023, E731
        total += k * math.log(upto(grade) - upto(grade - 1))
    return total


def test_ordinal_fit_is_the_likeliest(spark):
    rng = np.random.default_rng(3)
    x = [rng.integers(0, 5, rng.integers(0, 6)).tolist() for _ in range(300)]
    eta = np.array([sum([1.2, 0.6, 0.0, -0.4, -1.0][f] for f in r) for r in x])
    y = np.searchsorted([0.2, 1.0], eta + rng.logistic(size=300))
    weight = rng.uniform(0.5, 1.0, 300)
    w, cut = toxicity.fit_ordinal([np.array(r, int) for r in x], y, weight, 5, steps=3000, rate=0.01)
    best = likelihood(x, y, weight, w, cut)
    for _ in range(60):  # it is concave: what no step betters is the top
        step = rng.standard_normal(7) * rng.choice([0.3, 0.05])
        assert likelihood(x, y, weight, w + step[:5], np.sort(cut + step[5:])) < best + 0.01
    quick = toxicity.fit_ordinal([np.array(r, int) for r in x], y, weight, 5)
    assert likelihood(x, y, weight, *quick) > best - 0.05


def test_grades_come_from_the_labels(spark):
    rows = [(1, 0), (2, 0), (3, 1), (4, None), (None, 1), (2, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, toxic int")
    assert {r["doc_id"]: r["grade"] for r in toxicity.grades(labels).collect()} == {1: 0, 2: 1, 3: 1}
    assert [r["grade"] for r in toxicity.grades(labels.withColumn("grade", F.lit(7))).collect()] == [7] * 4


def test_graded_labels_give_a_threshold_each(spark):
    rng = random.Random(5)
    rows = []
    for i in range(1200):
        g = i % 4
        rows.append((i, " ".join([f"n{rng.randrange(500)}" for _ in range(20)] + rng.sample([f"bad{k}" for k in range(6)], 2 * g)), g))
    docs = spark.createDataFrame(rows, "doc_id long, text string, own int")
    model = toxicity.fit(docs, docs.filter("doc_id < 800").select("doc_id", F.col("own").alias("grade")))
    assert len(model.thresholds) == 3 and model.thresholds == sorted(model.thresholds)
    got = toxicity.score(docs.filter("doc_id >= 800"), model).select("own", "grade", "severity").collect()
    assert sum(r["own"] == r["grade"] for r in got) >= 0.95 * len(got)
    means = [np.mean([r["severity"] for r in got if r["own"] == g]) for g in range(4)]
    assert all(abs(m - g) < 0.3 for g, m in enumerate(means))


def test_ordinal_thresholds_ascend_and_share_weights():
    rng = np.random.default_rng(1)
    x = [rng.integers(0, 6, rng.integers(0, 5)) for _ in range(1500)]
    true = np.array([1.5, 1.0, 0.5, 0, -0.5, -1.0])
    eta = np.array([true[r].sum() for r in x])
    y = np.searchsorted([0.0, 1.0, 2.0], eta + rng.logistic(size=len(x)) * 0.5)
    w, cut = toxicity.fit_ordinal(x, y, np.ones(len(x)), 6)
    assert (np.diff(cut) > 0).all() and (np.diff(w) < 0).all()


def test_toxicity_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "you idiot", "c"), (3, "you idiot", "c")], "doc_id long, text string, severity string")
    none = toxicity.fit(docs, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int"))
    assert [(r["severity"], r["grade"]) for r in toxicity.score(docs, none).collect()] == [(0.0, 0)] * 4
    some = toxicity.score(docs, toxicity.Model({f: 9.0 for f in toxicity._features("idiot")[:1]}, [2.0, 4.0])).orderBy("doc_id").collect()
    assert some[0]["severity"] == some[1]["severity"] == 0 and some[2]["severity"] > 1.9 and some[2] == some[3] and some[2]["grade"] == 2


def test_language_accuracy_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op10_language_bayes"](spark, "/root/testdata/sf0.1").join(docs, "doc_id").filter("held_out")
    right, n = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 2000 and right >= 0.98 * n


def plain_ngrams(text):
    """Buckets of the n-grams of letters and single blanks, one by one."""
    if not text:
        return []
    out = []
    padded = f" {text.lower()} "
    kept = [c if c.isalpha() else " " for i, c in enumerate(padded) if c.isalpha() or (i > 0 and padded[i - 1].isalpha()) or (i + 1 < len(padded) and padded[i + 1].isalpha())]
    codes, m = [ord(c) for c in kept], 0xFFFFFFFF
    for n in (2, 3):
        for i in range(len(codes) - n + 1):
            h = codes[i] * 0x9E3779B1 & m
            for c in codes[i + 1 : i + n]:
                h = ((h ^ (h >> 15)) * 0x85EBCA77 + c) & m
            h = h * 0xC2B2AE3D & m
            out.append((h ^ (h >> 16)) % langid.BUCKETS)
    return out


def test_naive_bayes_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.collect()
    langs, matrix = langid.fit(docs.filter("doc_id % 2 = 0"))
    learned = {}  # rows of one id and text are one; here ids are unique
    for r in rows:
        if r["doc_id"] % 2 == 0:
            learned.setdefault(r["lang"], []).append(plain_ngrams(r["text"]))
    assert langs == sorted(learned)
    counts = {lang: np.bincount(np.array([b for t in texts for b in t], int), minlength=langid.BUCKETS) + 0.5 for lang, texts in learned.items()}
    prior = {lang: math.log(len(texts) / sum(map(len, learned.values()))) for lang, texts in learned.items()}
    logs = {lang: np.log(c / c.sum()) for lang, c in counts.items()}
    got = {r["doc_id"]: r for r in langid.predict(docs, langs, matrix).collect()}
    for r in rows[:400]:
        grams = plain_ngrams(r["text"])
        ll = {lang: prior[lang] + logs[lang][grams].sum() for lang in langs}
        best = max(ll, key=ll.get)
        temper = min(1, 30 / max(len(grams), 1))
        score = 1 / sum(math.exp((v - ll[best]) * temper) for v in ll.values())
        assert got[r["doc_id"]]["lang_pred"] == (best if grams else "und")
        assert got[r["doc_id"]]["score"] == pytest.approx(score if grams else 0, abs=1e-3)


def test_language_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "en", 1), (2, "", "en", 2), (3, "123 !?", "en", 3), (4, "hello there", None, 4), (None, "où était", "fr", 5), (6, "the other word", "en", 6)], "doc_id long, text string, lang string, score int")
    langs, matrix = langid.fit(docs)
    got = [tuple(r) for r in langid.predict(docs, langs, matrix).select("doc_id", "lang_pred").collect()]
    assert got == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (None, "fr"), (6, "en")]
    assert [r["lang_pred"] for r in langid.predict(docs, *langid.fit(docs.filter("lang = 'xx'"))).collect()] == ["und"] * 6


def edit(a, b):
    row = list(range(len(b) + 1))
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return min(row)


@pytest.mark.parametrize("slice_bytes", [16 << 20, 150])
def test_decontamination_against_brute_force(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(decontamination, "SLICE_BYTES", slice_bytes)  # in one slice, and in several
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(80)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate([5, 8, 15, 22, 40, 40])]
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (92, "too short"), (4, items[4][1])], "item_id long, text string")
    docs = [None, "", "w1"]
    for k in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        if k % 2:
            item = rng.choice(items)[1].split()
            for _ in range(rng.randint(0, max(1, len(item) // 4))):
                p = rng.randrange(len(item))
                item[p : p + 1] = rng.choice([[], [rng.choice(vocabulary)], [item[p], "zz"]])
            words[len(words) // 2 : len(words) // 2] = item
        docs.append(" ".join(words).upper())
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(docs)], "doc_id long, text string, items string, row_ int")
    found = decontamination.contaminated(df, bench)
    assert set(found.columns) == {*df.columns, "contaminated"} and len(found.columns) == 5
    got = {r["doc_id"]: set(r["items"]) for r in found.collect()}
    want = {i: {k for k, b in items if edit(b.split(), re.findall(r"\w+", (t or "").lower())) <= int(0.2 * len(b.split()) + 1e-9)} for i, t in enumerate(docs)}
    assert all(got[i] <= want[i] for i in want)
    total = sum(map(len, want.values()))
    assert total > 40 and sum(map(len, got.values())) >= 0.95 * total


def test_decontamination_finds_exact_passages(spark, sf):
    got = {r["doc_id"]: r["items"] for r in QUERIES["op2_decontaminate_cgk"](spark, sf).collect()}
    plain = lambda t: f" {' '.join(re.findall(chr(92) + 'w+', t.lower()))} "
    items = [(r["item_id"], plain(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        assert {i for i, t in items if t in plain(r["text"])} <= set(got[r["doc_id"]])


def test_pii_pseudonyms(spark):
    text = "Pay 4111 1111 1111 1111 or 4111111111111111, not 4111111111111112. Call +1 (017) 555-7713 / 017-555-7713 from 97.51.17.173, 300.1.2.3; born 1984-02-29, 1984-02-30 or 29/02/1984; ssn 123-45-6789; mail a.b@mail7.example.com. token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" v3.0"
    rows = [(1, text, "x"), (2, None, "y"), (3, "", "z"), (4, "nothing 12 here", "q"), (1, text, "x"), (5, "n° 4111111111111111 ü 97.51.17.173", "w")]
    got = pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string, found_ string").drop("found_"), "k").collect()
    new = got[0]["text"]
    assert got[1]["text"] is None and got[2]["text"] == "" and got[3]["text"] == rows[3][1] and got[0] == got[4]
    for old in ("4111 1111 1111 1111", "4111111111111111,", "555-7713", "97.51.17.173", "1984-02-29", "29/02/1984", "123-45-6789", "a.b@", "04dbebab"):
        assert old not in new, old
    for kept in ("4111111111111112", "300.1.2.3", "1984-02-30", "@mail7.example.com", " v3.0", "Pay "):
        assert kept in new, kept
    shape = lambda s: re.sub(r"\d", "9", re.sub(r"\S+@|[0-9a-f]{40}", "#", s))
    assert re.sub(r"\d+\.\d+\.\d+\.\d+", "ip", shape(new)) == re.sub(r"\d+\.\d+\.\d+\.\d+", "ip", shape(text))
    cards = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", new)
    assert cards[0].replace(" ", "") == cards[1] == re.search(r"\d{16}", got[5]["text"])[0]
    digits = [int(c) for c in cards[1]][::-1]
    assert (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0
    phones = re.findall(r"\+1 \((\d{3})\) (\d{3})-(\d{4}) / (\d{3})-(\d{3})-(\d{4})", new)[0]
    assert phones[:3] == phones[3:]
    day = re.findall(r"(\d{4})-(\d\d)-(\d\d), 1984-02-30 or (\d\d)/(\d\d)/(\d{4})", new)[0]
    assert day[:3] == (day[5], day[4], day[3])
    assert re.findall(r"\d+\.\d+\.\d+\.\d+", new)[0] == re.findall(r"\d+\.\d+\.\d+\.\d+", got[5]["text"])[0]
    assert got[0]["n_private"] == 10 and got[3]["n_private"] == 0


def test_feistel_is_a_permutation(spark):
    got = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d")).select(pii.permuted_digits(F.col("d"), "k", "x").alias("p")).collect()
    assert sorted(r["p"] for r in got) == [f"{i:03}" for i in range(1000)]


def test_urls(spark):
    rows = ["http://X.Example.COM/en/5?q#f", "https://a.example.com/en/77", "http://com/en/", "http://xcom/en/1", "http://a.example.net/de/81", "http://b.net/de/8", "http://q.org/es", "no scheme", None, "", "http://", "a://b://c/d", "http://h.org?x=/es/"]
    df = spark.createDataFrame([(i, u, "x", None) for i, u in enumerate(rows)] + [(0, rows[0], "x", None)], "page_id long, url string, host string, purity int")
    got = {r["page_id"]: tuple(r[c] for c in ("host", "path", "rule", "verdict")) for r in urls.judge(df, URL_RULES).collect()}
    assert got == {
        0: ("x.example.com", "/en/5", "com/en/", "block"), 1: ("a.example.com", "/en/77", "example.com/en/7", "allow"), 2: ("com", "/en/", "com/en/", "block"),
        3: ("xcom", "/en/1", None, "allow"), 4: ("a.example.net", "/de/81", "example.net/de/8", "block"), 5: ("b.net", "/de/8", "net/de/", "allow"),
        6: ("q.org", "/es", None, "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("", "", None, "allow"), 10: ("", "", None, "allow"),
        11: ("b:", "//c/d", None, "allow"), 12: ("h.org", "", None, "allow"),
    }
    assert urls.judge(df.filter("false"), URL_RULES).count() == 0


def test_url_templates_reject_by_labels(spark):
    rows = [(i, f"http://h.com/shop/{i}/x", None) for i in range(40)] + [(100 + i, f"http://h.com/news/{i}", None) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, note string")
    rules = {f"h.com/shop/{d}": "block" for d in range(1, 4)} | {"h.com/news/1": "allow", "h.com/news/2": "allow"}
    got = {r["page_id"]: r for r in urls.judge(df, rules).collect()}
    assert got[9]["rule"] is None and got[9]["template"] == "/shop/*/x" and got[9]["verdict"] == "block"
    assert got[109]["rule"] is None and got[109]["verdict"] == "allow"


def filled(sizes, weights, share, cap):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > cap * sizes[s]}
        if not full:
            return out | {s: level * w[s] for s in open_}
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_mixing(spark):
    rng = random.Random(4)
    rows = []
    for s, n in (("a", 900), ("B", 300), ("é", 200), (None, 150), ("zz", 40), ("empty", 2)):
        rows += [(len(rows) + i, "w " * (0 if s == "empty" else rng.choice([0, 3, 10, 40, 200])), s, "x") for i in range(n)]
    rows += [(len(rows), None, "a", "x"), rows[5], rows[5], (None, "no id", "B", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(7)).collect()
    plain = lambda rs: sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in rs)
    assert plain(got) == plain(again) and len(got) == len(rows)
    sizes, taken = {}, {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert r["taken"] <= 2 * r["size"]
    want = filled(sizes, (5, 2, 1), 1.5, 2.0)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(5, 0.02 * want[s])
    assert mixing.mix(df.filter("false")).count() == 0


def test_mixing_documents_without_ids_and_repeated_rows(spark):
    rows = [(None, f"t{i} w w w w", "a") for i in range(300)] + [(7, "same w w w w", "b")] * 300 + [(1000 + i, "w w w w w", "c") for i in range(300)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5), weights=(1,), share=1.3)
    per = got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.count("*").alias("n")).collect()
    assert all(r["n"] == 300 and abs(r["taken"] - r["target"]) <= 5 for r in per)


def test_mixing_query(spark, sf):
    got = QUERIES["op1_mix_pareto"](spark, sf)
    off = got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).filter(F.abs(F.col("taken") - F.col("target")) > 0.03 * F.col("target"))
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count() and off.count() == 0


def test_secrets_keep_their_case_and_stay_linked(spark):
    value = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [(1, f"token = {value}."), (2, f"TOKEN = {value.upper()}!"), (3, f"{value[:20]}{value[20:].upper()}")]
    got = [r["text"] for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").orderBy("doc_id").collect()]
    new = re.search(r"[0-9a-f]{40}", got[0])[0]
    assert new != value and new.upper() in got[1] and got[2] == rows[2][1]
