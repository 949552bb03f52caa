"""Registered jobs against the size of the reference's: 2,000 resamples, and the confusions that a record holds."""

from collections import Counter

from textlab import queries as core
from textlab.functions import text as T
from textlab.operators import evaluate
from textlab.queries import fixtures as X
from textlab.queries import scores

DIR = "/root/testdata/sf0.001"


def steps(a, b):
    """Errors of one alignment: from the ends, a diagonal step wins over a deletion, a deletion over an insertion."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            d[i][j] = min(d[i - 1][j - 1] + (x != y), d[i - 1][j] + 1, d[i][j - 1] + 1)
    i, j = len(a), len(b)
    while i or j:
        if i and j and d[i][j] == d[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            if a[i] != b[j]:
                yield "substitution", a[i], b[j]
        elif i and d[i][j] == d[i - 1][j] + 1:
            i -= 1
            yield "deletion", a[i], None
        else:
            j -= 1
            yield "insertion", None, b[j]


def test_registered_intervals_use_the_references_resamples(spark, monkeypatch):
    asked = []
    plain = evaluate.bootstrap
    monkeypatch.setattr(evaluate, "bootstrap", lambda *a, **k: asked.append(k["n_boot"]) or plain(*a, **k))
    core.QUERIES["bootstrap_ci_whole"](spark, DIR)
    core.QUERIES["variant_record"](spark, DIR)
    assert asked == [2_000, 2_000]


def test_variant_record_holds_scores_intervals_and_top_confusions(spark, monkeypatch):
    some = X.pairs(spark, DIR).where("name < 'src1' and length(ref) < 60").limit(200)
    some = spark.createDataFrame(some.collect(), some.schema)
    monkeypatch.setattr(X, "pairs", lambda *_: some)
    got = scores.variant_record(spark, DIR).collect()
    texts = some.select(*[T.graphemes(T.normalize(some[c])).alias(c) for c in ("ref", "hyp")]).collect()
    every = Counter(x for r in texts for x in steps(r.ref, r.hyp))
    assert every
    for kind, k in (("substitution", 30), ("deletion", 15), ("insertion", 15)):
        best = sorted((x for x in every.items() if x[0][0] == kind), key=lambda x: (-x[1], x[0][1] or "", x[0][2] or ""))[:k]
        assert sorted(((r.metric, r.ref, r.hyp), r.value) for r in got if r.metric == kind) == sorted(best) if kind == "substitution" else {(r.ref, r.hyp): r.value for r in got if r.metric == kind} == {x[0][1:]: x[1] for x in best}
    names = {r.metric for r in got if r.ref is None and r.hyp is None}
    assert {"lines", "cer_grapheme_micro", "wer_micro", "grapheme_lo", "grapheme_hi", "word_lo", "word_hi"} <= names


def test_unset_method_is_poisson_at_every_size(spark):
    scored = spark.createDataFrame([(f"p{i}", i % 5, 20, i % 2, 4) for i in range(60)], "name string, grapheme_edits int, grapheme_ref int, word_edits int, word_ref int")
    ends = [sorted(evaluate.bootstrap(scored, "name", n_boot=50, **k).collect()) for k in ({}, {"method": "poisson"}, {"method": "index"})]
    assert ends[0] == ends[1] != ends[2]
