"""Language ID, toxicity and importance resampling: held-out accuracy, small brute-force versions, edges."""

import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from textlab.llm import importance, language_id, toxicity

SF = "/root/testdata/sf0.1"


def test_forward_sums_all_segmentations():
    pieces = language_id.Pieces(["a", "ab", "abc", "b", "bc", "c"])
    p = np.array([[0.1], [0.2], [0.05], [0.3], [0.15], [0.1], [1e-7]])
    model = language_id.Model(["x"], np.ones(1), p, pieces)

    def total(word):
        if not word:
            return 1.0
        heads = [(w, p[pieces.pieces.index(w), 0]) for w in pieces.pieces if word.startswith(w)]
        if word[0] not in pieces.pieces:
            heads.append((word[0], 1e-7))
        return sum(q * total(word[len(w) :]) for w, q in heads)

    words = ["a", "abc", "abcabc", "zab", "é"]
    assert np.allclose(model.log_words(words)[:, 0], [math.log(total(w)) for w in words])


def test_language_held_out(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = language_id.query(spark, SF).collect()
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.99 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en", 7), (2, None, "de", 7), (3, "123 !?", "de", 7), (4, "der hund und die katze " * 3, "de", 7), (4, "der hund und die katze " * 3, "de", 7), (5, "x" * 50_000, None, 7)], "doc_id long, text string, lang string, score int")
    got = sorted((r.doc_id, r.lang_pred) for r in language_id.predict(docs, language_id.fit(docs)).collect())
    assert got[:5] == [(1, "en"), (2, "und"), (3, "und"), (4, "de"), (4, "de")]
    none = docs.limit(0)
    model = language_id.fit(none)
    assert language_id.predict(none, model).count() == 0
    assert {(r.lang_pred, r.score) for r in language_id.predict(docs, model).collect()} == {("und", 0.0)}


def test_toxicity_held_out(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = toxicity.query(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    n = Counter(held)
    assert n[1, 1] >= 0.8 * (n[1, 1] + n[0, 1]) and n[1, 0] <= 0.01 * (n[1, 0] + n[0, 0])


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "you are a worthless idiot and a loser", "k"), (3, "you are a worthless idiot and a loser", "k"), (4, "a plain sentence", "k")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, F.col("doc_id") > 0)
    s = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert s[1] == s[2] == s[4] < s[3] and all(0 <= x <= 1 for x in s.values())
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels, F.col("doc_id") > 0)).count() == 0


def test_label_model_finds_the_better_voter():
    rng = np.random.default_rng(0)
    y = rng.random(3000) < 0.3
    vote = lambda accuracy: np.where(rng.random(3000) < accuracy, y, ~y) * 2 - 1
    a, b, c = vote(0.95), vote(0.85), vote(0.8)
    q, weight = toxicity.label_model(np.stack([a, b, c, c], 1).astype(float), 0.3)
    assert ((q > 0.5) == y).mean() > 0.93
    assert weight[2] < weight[0] and weight[3] < weight[0]


def test_forward_sums_of_long_words_do_not_depend_on_the_way(monkeypatch):
    rng = np.random.default_rng(8)
    pieces = language_id.Pieces(["a", "ab", "abc", "b", "bc", "bcab", "c"])
    model = language_id.Model(["x", "y"], np.full(2, 0.5), rng.dirichlet(np.ones(8), 2).T, pieces)
    words = ["".join(rng.choice(list("abcd"), n)) for n in (1, 3, 23, 24, 25, 65, 200, 900)]
    plain = []
    for w in words:
        log = []
        for k in range(2):
            a, scale = [1.0], 0.0
            for j in range(1, len(w) + 1):
                a.append(sum(a[i] * model.p[pieces.pieces.index(w[i:j]), k] for i in range(max(0, j - 4), j) if w[i:j] in pieces.pieces) + (a[j - 1] * model.p[7, k] if w[j - 1] == "d" else 0))
                if j % 50 == 0:
                    scale += np.log(a[j])
                    a = [x / a[j] for x in a]
            log.append(np.log(a[-1]) + scale)
        plain.append(log)
    for long in (0, 64, 10_000):
        monkeypatch.setattr(language_id, "LONG", long)
        monkeypatch.setattr(language_id, "BLOCK", 37)
        assert np.allclose(model.log_words(words), plain, rtol=1e-9)


def test_kth_largest(spark):
    rng = np.random.default_rng(1)
    values = np.round(rng.normal(size=2000), 2).tolist()
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    for k in (1, 2, 777, 2000):
        assert importance.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]


def test_importance_keeps_good_rejects_bad(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = importance.query(spark, SF).join(labels, "doc_id").collect()
    n = Counter((r.quality, r.kept) for r in rows)
    assert n[1, True] >= 0.99 * (n[1, True] + n[1, False]) and n[0, False] >= 0.9 * (n[0, True] + n[0, False])


def test_importance_counts_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("target", F.col("doc_id") % 3 == 0)
    grams, want = importance.Grams(), np.zeros((2, importance.BUCKETS))
    for r in docs.collect():
        np.add.at(want[0], grams(r.text), 1)
        np.add.at(want[1], grams(r.text) if r.target else [], 1)
    raw, target = importance.bucket_counts(docs)
    assert (raw == want[0]).all() and (target == want[1]).all()


def test_importance_weights_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ratio, grams = np.random.default_rng(2).normal(size=importance.BUCKETS), importance.Grams()
    want = {r.doc_id: sum(float(ratio[g]) for g in grams(r.text)) for r in docs.collect()}
    for r in importance.weights(docs, ratio, ["doc_id"]).collect():
        assert np.isclose(r["__log_weight"], want[r.doc_id], rtol=1e-9, atol=1e-6)


def test_importance_draws_the_k_largest_perturbed_weights(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(w)) for i, w in enumerate(rng.normal(size=3000) * 3)] + [(None, 0.5), (3001, None)]
    df = spark.createDataFrame(rows, "doc_id long, w double")
    noisy = sorted(((r.w + r.g, r.doc_id) for r in df.where("w is not null").select("doc_id", "w", importance.gumbel(7, F.col("doc_id")).alias("g")).collect()), key=lambda r: -r[0])
    kept = df.where(importance.top_k(df, 800, "w", 7, F.col("doc_id"))).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(d) for _, d in noisy[:800])
    plain = {str(r[0]) for r in sorted((r for r in rows if r[1] is not None), key=lambda r: -r[1])[:800]}
    assert len(plain - {str(r.doc_id) for r in kept}) > 50  # a draw, not a threshold


def test_importance_inclusion_follows_the_weights(spark):
    levels = (-2.0, -1.0, 0.0, 1.0, 2.0)
    df = spark.range(40_000).select(F.col("id").alias("doc_id"), F.element_at(F.array(*map(F.lit, levels)), (F.col("id") % 5 + 1).cast("int")).alias("w"))
    k = 10_000
    shares = {r.w: r.share for r in df.select("w", importance.top_k(df, k, "w", 3, F.col("doc_id")).cast("int").alias("kept")).groupBy("w").agg(F.avg("kept").alias("share")).collect()}
    low, high = -10.0, 10.0
    for _ in range(60):  # the cut at which the expected number of draws is k
        cut = (low + high) / 2
        low, high = (cut, high) if sum(8000 * -np.expm1(-np.exp(w - cut)) for w in levels) > k else (low, cut)
    for w in levels:
        assert abs(shares[w] + np.expm1(-np.exp(w - cut))) < 0.02


def test_importance_edges(spark):
    rows = [(1, None, "k"), (2, "", "k"), (3, "some words", "k"), (3, "some words", "k"), (4, "w " * 40_000, "k"), (None, "some words", "k"), (5, "?!", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string").withColumn("log_weight", F.lit("x")).withColumn("target", F.lit("x")).withColumn("n_grams", F.array(F.lit(1)))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert sorted((str(r.doc_id), r["__kept"]) for r in importance.select(docs, labels, ["doc_id"]).collect()) == [("1", False), ("2", False), ("3", True), ("3", True), ("4", True), ("5", True), ("None", True)]
    kept = importance.keep_good(docs, labels)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["3", "3", "4", "5", "None"]
    assert importance.keep_good(docs.limit(0), labels).count() == 0
    both = spark.createDataFrame([(3, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    kept = sorted(str(r.doc_id) for r in importance.keep_good(docs, both).collect())
    assert kept.count("3") in (0, 2) and "1" not in kept and "2" not in kept
