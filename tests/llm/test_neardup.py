import random
import re

import numpy as np

from textlab.llm import neardup as n
from textlab.llm.kernels import WordHashes


def brute(docs, k, percent=80):
    sets = []
    for _, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    up = list(range(len(docs)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(docs))


def corpus(seed, copies=60):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    docs = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([1, 3, 5, 30, 80, 200]))]
        docs.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 5])):
            other = list(base)
            for _ in range(rng.randrange(0, 6)):
                other[rng.randrange(len(other))] = word()
            docs.append(rng.choice([" ", "\n"]).join(other).title())
    chain = [word() for _ in range(100)]
    for _ in range(copies):
        docs.append(" ".join(chain))
        chain[rng.randrange(100)] = word()
    docs += [None, "", " \n", docs[0], docs[0]]
    rng.shuffle(docs)
    return list(enumerate(docs))


def rows(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def test_against_brute_force(spark):
    docs = corpus(1)
    assert rows(n.groups(spark.createDataFrame(docs, "doc_id long, text string"), 4)) == brute(docs, 4)


def test_chunked_buckets_lose_nothing(spark, monkeypatch):
    docs = corpus(2)
    monkeypatch.setattr(n, "CHUNK", 7)
    assert rows(n.groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), 4)) == brute(docs, 4)


def test_chunks_by_load_lose_nothing(spark, monkeypatch):
    docs = corpus(3)
    monkeypatch.setattr(n, "LOAD", 500)
    assert rows(n.groups(spark.createDataFrame(docs, "doc_id long, text string"), 4)) == brute(docs, 4)


def test_large_group_of_near_copies_with_outliers(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"h{i}" for i in range(120)]
    docs = []
    for i in range(300):
        own = list(base)
        for _ in range(rng.randrange(0, 3) if i % 10 else rng.randrange(6, 12)):
            own[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(own)))
    monkeypatch.setattr(n, "CHUNK", 40)
    assert rows(n.groups(spark.createDataFrame(docs, "doc_id long, text string"), 4)) == brute(docs, 4)


def test_null_keys_and_repeated_rows(spark):
    a, b = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    data = [(1, a), (2, b), (1, a), (2, a + " x"), (None, a), (None, "only these few words"), (None, "only these few words"), (None, None), (None, ""), (7, "z " * 90_000)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in n.groups(docs, 4).collect())
    assert got == sorted([("1", 37, "1"), ("2", 37, "2"), ("1", 37, "1"), ("2", 38, "1"), ("None", 37, "1"), ("None", 1, "None"), ("None", 1, "None"), ("None", 0, "None"), ("None", 0, "None"), ("7", 1, "7")])
    kept = sorted((str(r.doc_id), str(r.text)[:8]) for r in n.keep_one(docs).collect())
    assert kept == sorted([("1", "w0 w1 w2"), ("2", "v0 v1 v2"), ("None", "only the"), ("None", "None"), ("None", ""), ("7", "z z z z ")])


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert rows(n.query(spark, "/root/testdata/sf0.001")) == brute(docs, 4)


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:900], rng.integers(0, 1 << 63, 100, dtype=np.uint64)])
    assert (np.maximum(n.sketch(a), n.sketch(b)) == n.sketch(np.union1d(a, b))).all()
    x, y = n.sketch(a), n.sketch(b)
    j = n.similarity(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([1000.0]), np.array([1000.0]))[0]
    assert abs(j - 900 / 1100) < 0.12
    assert len(n.shingles("a b", 4, WordHashes())) == 1 and len(n.shingles(" ", 4, WordHashes())) == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40) if i % 10 != 9] + [(100, 7), (3, 100), (55, 55)]
    got = {r.node: r.root for r in n.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: i // 10 * 10 for i in range(1, 40) if i % 10} | {100: 0}
    assert n.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one_and_edges(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(3, text, "x"), (1, text, "x"), (2, text + " more", "y"), (4, None, "x"), (5, "", "x"), (6, "", "x")], "doc_id long, text string, component_id string")
    assert sorted((r.doc_id, r.component_id) for r in n.keep_one(docs).collect()) == [(1, "x"), (4, "x"), (5, "x"), (6, "x")]
    assert n.groups(spark.createDataFrame([], docs.schema), 4).count() == 0
