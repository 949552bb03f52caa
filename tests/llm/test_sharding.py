import zlib

import numpy as np

from textlab.llm import sharding as s


def check(rows, shards, tolerance):
    size = [0] * shards
    slots = {}
    for r in rows:
        size[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(size) - min(size) <= tolerance * sum(size) / shards
    return size


def test_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").collect()}
    rows = s.query(spark, "/root/testdata/sf0.1").collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all((r.size, r.text_crc32) == (len((docs[r.doc_id] or "").encode()) + 1, zlib.crc32((docs[r.doc_id] or "").encode())) for r in rows)
    check(rows, 8, 0.02)
    places = {}
    for r in rows:
        places.setdefault(docs[r.doc_id], set()).add(r.shard)
    assert all(len(p) == 1 for p in places.values())
    n = np.bincount([r.shard for r in rows], minlength=8)
    assert n.max() < 1.1 * n.min()


def test_a_group_with_a_third_of_all_rows_is_cut(spark):
    rows = [(i, "the same words again" if i % 3 == 0 else f"text number {i} " * (i % 7), "x") for i in range(6000)] + [(1, "text number 1 ", "x")] * 3
    got = s.assign(spark.createDataFrame(rows, "doc_id long, text string, shard string"), cells=400).collect()
    assert len(got) == len(rows)
    check(got, 8, 0.03)


def test_edges(spark):
    got = s.assign(spark.createDataFrame([(1, None), (2, ""), (2, "")], "doc_id long, text string"), shards=2).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == [(1, 1, 0), (2, 1, 0), (2, 1, 0)]
    assert s.assign(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_same_result_at_other_partitionings(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    a, b = (sorted(map(tuple, s.assign(d).collect())) for d in (docs, docs.repartition(13)))
    assert a == b
