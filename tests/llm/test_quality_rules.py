import re
from collections import Counter

from textlab.llm import quality_rules as q
from textlab.llm.kernels import WordHashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w), len(lines) - len(set(lines)), len(hit)]


def test_counts_against_brute_force(spark):
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        assert q.rule_counts(r.text, WordHashes(50))[0] == brute(r.text)
    for text in (None, "", " \n\n", "a a a a", "x\n\nx\nx \n y", "a b c d a b c d", "é😀 # | <>"):
        assert q.rule_counts(text, WordHashes())[0] == brute(text)


def test_verdict(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = q.judge(docs, labels)
    rows = got.join(labels, "doc_id").collect()
    good, bad = ([r.kept for r in rows if r.quality == y] for y in (1, 0))
    base = [not r.base_failed for r in rows if r.quality == 1]
    assert sum(good) >= 0.98 * sum(base) and sum(bad) < 0.1 * len(bad)
    assert got.where("base_failed and kept").count() == 0


def test_edges(spark):
    schema = "doc_id long, text string, kept string"
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "w " * 30, "x"), (3, "w " * 30, "x"), (4, " ".join(f"w{i}" for i in range(80)), "x")], schema)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = q.judge(docs, none).orderBy("doc_id").collect()
    assert [(r.doc_id, r.base_failed, r.kept) for r in got] == [(1, True, False), (2, True, False), (3, True, False), (3, True, False), (4, False, True)]
    assert q.judge(spark.createDataFrame([], schema), none).count() == 0
