import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textlab.functions import distance as d


def table(a, b):
    t = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i][j] = min(t[i - 1][j - 1] + (a[i - 1] != b[j - 1]), t[i - 1][j] + 1, t[i][j - 1] + 1)
    return t


def walk(a, b):
    t, i, j, out = table(a, b), len(a), len(b), []
    while i or j:
        if i and j and t[i][j] == t[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            out.append((a[i], b[j]))
        elif i and t[i][j] == t[i - 1][j] + 1:
            i -= 1
            out.append((a[i], None))
        else:
            j -= 1
            out.append((None, b[j]))
    return out[::-1]


def aligned(pairs, **more):
    kind = pa.list_(pa.string())
    got = d.align(pa.array([p[0] for p in pairs], kind), pa.array([p[1] for p in pairs], kind), **more).to_pylist()
    return [[(x["ref"], x["hyp"]) for x in g] for g in got]


@pytest.mark.parametrize("cells", [4_000_000, 40, 3])
def test_alignment_of_many_pairs(monkeypatch, cells):
    monkeypatch.setattr(d, "CELLS", cells)
    r = random.Random(cells)
    some = lambda: [r.choice("abc") for _ in range(r.randrange(14))]
    pairs = [(some(), some()) for _ in range(300)]
    assert aligned(pairs) == [walk(*p) for p in pairs]
    assert aligned(pairs, errors_only=True) == [[x for x in walk(*p) if x[0] != x[1]] for p in pairs]


def test_null_lists_and_no_rows():
    assert aligned([(None, ["a"]), (["a"], None), (None, None)]) == [[(None, "a")], [("a", None)], []]
    assert aligned([]) == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("xyz"), max_size=9), st.lists(st.sampled_from("xyz"), max_size=9))
def test_alignment_projects_back(a, b):
    got = aligned([(a, b)])[0]
    assert [x for x, _ in got if x is not None] == a and [y for _, y in got if y is not None] == b
    assert sum(x != y for x, y in got) == table(a, b)[-1][-1]


def test_distances_by_unit(spark):
    r = random.Random(5)
    some = lambda: "".join(r.choice(["க", "கி", "ா", "a", " ", "😀", "்"]) for _ in range(r.randrange(18)))
    rows = [(some(), some()) for _ in range(200)] + [("", ""), ("", "கி"), ("க", ""), ("கி", "க")]
    df = spark.createDataFrame(rows, "ref string, hyp string")
    units = {u: (tokens, distance) for u, (tokens, distance) in d.UNITS.items()}
    got = df.select("ref", "hyp", *[x for u, (t, f) in units.items() for x in (f(F.col("ref"), F.col("hyp")).alias(u), t(F.col("ref")).alias(f"{u}_r"), t(F.col("hyp")).alias(f"{u}_h"))]).collect()
    for row in got:
        for u in units:
            assert row[u] == table(row[f"{u}_r"], row[f"{u}_h"])[-1][-1], (u, row)
    assert any(row.grapheme != row.codepoint for row in got)


def test_many_distinct_tokens(spark):
    words = [f"w{i}" for i in range(600)]
    r = random.Random(2)
    rows = [(" ".join(words), " ".join(w for w in words if r.random() < 0.9)), (" ".join(words[:254]), " ".join(words[1:255]))]
    got = spark.createDataFrame(rows, "ref string, hyp string").select("ref", "hyp", d.word_distance(F.col("ref"), F.col("hyp")).alias("n")).collect()
    assert [x.n for x in got] == [table(x.ref.split(), x.hyp.split())[-1][-1] for x in got]
