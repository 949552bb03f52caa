import random

import numpy as np
import pytest

from textlab.llm import winnowing as w


def brute(docs, items):
    out = {}
    for doc, text in docs:
        words, hit, found = w.words(text), set(), set()
        for item, t in items:
            q = w.words(t)
            k = min(10, len(q))
            windows = {tuple(q[i : i + k]) for i in range(len(q) - k + 1)} if k else set()
            for i in range(len(words) - k + 1):
                if k and tuple(words[i : i + k]) in windows:
                    hit |= set(range(i, i + k))
                    found.add(str(item))
        out[doc] = (len(words), len(hit), sorted(found))
    return out


def cases(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choices(vocabulary[: rng.choice([2, 12])], k=rng.choice([1, 3, 9, 10, 11, 40])))) for i in range(12)] + [(90, ""), (91, None), (92, "Aé b9")]
    docs = []
    for i in range(60):
        words = rng.choices(vocabulary + ["zz"], k=rng.randrange(0, 90))
        for _ in range(rng.randrange(3)):
            q = (rng.choice(items[:12])[1] or "").split()
            a = rng.randrange(len(q))
            words[rng.randrange(len(words) + 1) : 0] = q[a : a + rng.randrange(1, 40)]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(words).upper()))
    return docs + [(90, None), (91, ""), (92, "aé  B9 x"), (0, docs[0][1])], items


@pytest.mark.parametrize(("seed", "block"), [(1, 2_000_000), (2, 150)])
def test_against_brute_force(spark, monkeypatch, seed, block):
    docs, items = cases(seed)
    monkeypatch.setattr(w, "BLOCK_CHARS", block)
    monkeypatch.setattr(w, "RESIDENT", 1)
    got = w.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == len(docs)
    want = brute(docs, items)
    assert all((r.n_words, r.n_hit, r["items"]) == want[r.doc_id] for r in got)


def test_every_shared_span_of_ten_words_has_a_common_fingerprint():
    rng = np.random.default_rng(3)
    for _ in range(200):
        span = rng.integers(1, 5, 10).astype(np.int32)
        a, b = (np.concatenate([rng.integers(1, 5, 20), span, rng.integers(1, 5, 20)]).astype(np.int32) for _ in range(2))
        marks = [set(w.hashes(x, 5)[w.fingerprints(x, np.arange(len(x) - 9))].tolist()) for x in (a, b)]
        assert marks[0] & marks[1]


def test_cut_removes_hits_and_keeps_the_rest(spark):
    item = " ".join(f"q{i}" for i in range(12))
    docs = [(1, "Before it, " + " ".join(["pad"] * 30) + " " + item.upper() + ". After.", "x", 0), (2, item, "x", 0), (3, "clean text", "x", 10), (4, None, "x", None)]
    out = {r.doc_id: r for r in w.cut_hits(spark.createDataFrame(docs, "doc_id long, text string, items string, n_chars long"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert set(out) == {1, 3, 4} and out[3].text == "clean text" and out[4].text is None
    assert "Q3" not in out[1].text and out[1].text.endswith(". After.") and out[1].n_chars == len(out[1].text) and out[1]["items"] == "x"


def test_empty_tables(spark):
    none, bench = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert w.decontaminate(none, bench).count() == 0
    assert w.decontaminate(spark.createDataFrame([(1, "a")], "doc_id long, text string"), bench).first().n_hit == 0


def test_a_benchmark_too_large_to_broadcast_gives_the_same(spark, monkeypatch):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("key", w.F.col("doc_id"))
    docs = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, None, None, None, None, None), (None, "", "en", "s", 0, 1)], docs.schema))
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    short = spark.createDataFrame([(1001, "The of"), (1002, "ER"), (1003, None), (1004, "? !"), (1002, "ER")], "item_id long, text string")
    bench = bench.unionByName(short).unionByName(bench.limit(2).withColumn("item_id", w.F.col("item_id") + 5000))
    read = lambda df: sorted(map(str, df.collect()))
    small, small_cut = read(w.decontaminate(docs, bench)), read(w.cut_hits(docs, bench))
    monkeypatch.setattr(w, "MOST_BROADCAST", 0)
    assert read(w.decontaminate(docs, bench)) == small and read(w.cut_hits(docs, bench)) == small_cut
    monkeypatch.setattr(w, "BLOOM_BITS", 64)  # a filter that lets nearly all pass changes nothing
    few = docs.where("doc_id between 100 and 130")
    got = read(w.decontaminate(few, bench))
    assert len(got) == few.count() and set(got) <= set(small)
