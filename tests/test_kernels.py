"""The array kernels against plain Python, and how often a job reads its pairs."""

import hashlib
import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textlab import queries as core
from textlab.functions import digests, units
from textlab.functions import text as T
from textlab.operators import corpus, evaluate
from textlab.queries import scores

SIGNS = [chr(c) for c in (0x0BBE, 0x0BD7, 0x0BC6, 0x0BC7, 0x0BCD)]
LETTERS = [chr(c) for c in (0x0B92, 0x0BCA, 0x0B95, 0xE9, 0x41, 0x20, 0xA0, 0x200C, 0x301, 0x327, 0x1C, 0x3000, 0x2028, 0x11A8, 0xAC00, 0x1F600, 0x212B, 0x0A)]


def some(n, letters, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randrange(14))) for _ in range(n)] + [None, ""]


def plain(text, profile=T.PROFILES[0]):
    text = unicodedata.normalize("NFC", text or "")
    text = text.translate({ord(c): None for c in T.ZERO_WIDTH}) if profile.strip_zero_width else text
    return (re.sub(r"\s+", " ", text) if profile.collapse_whitespace else text).strip()


@pytest.mark.parametrize("profile", T.PROFILES, ids=lambda p: p.name)
def test_normalized_texts_and_their_units(profile):
    texts = some(3_000, SIGNS + LETTERS[:7]) + some(3_000, SIGNS + LETTERS)
    want = [plain(t, profile) for t in texts]
    block = units.normalized(pa.array(["x", *texts])[1:], profile)
    assert units.spelled(block).to_pylist() == want
    ids, at = units.graphemes(block)
    assert [[units.unit_text(int(i)) for i in ids[a:b]] for a, b in zip(at, at[1:])] == [re.findall(f"(?s).[{''.join(chr(c) for c in units._SIGNS)}]*", t) for t in want]
    names: dict = {}
    ids, at = units.words(block)[0]
    assert all(names.setdefault(w, i) == i for t, a, b in zip(want, at, at[1:]) for w, i in zip(t.split(), ids[a:b], strict=True))
    assert len(set(names.values())) == len(names)


def test_every_inert_code_point_stays_as_it_is():
    joining = {int(d.split()[1], 16) for c in range(0x110000) if len((d := unicodedata.decomposition(chr(c))).split()) == 2 and d[0] != "<"}
    inert = [c for lo, hi in T.INERT for c in range(lo, hi + 1)]
    moved = [c for c in inert if unicodedata.combining(chr(c)) or c in joining or unicodedata.normalize("NFC", chr(c)) != chr(c)]
    assert moved == [0x0BBE, 0x0BCD, 0x0BD7]


def test_normal_form_sends_only_texts_that_need_it_to_python(spark):
    texts = some(500, SIGNS + LETTERS)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.nfc("t").alias("f")).collect()
    assert [r.f for r in rows] == [None if r.t is None else unicodedata.normalize("NFC", r.t) for r in rows]
    easy = [t for t in some(500, SIGNS + LETTERS[:3]) if t]
    sent = spark.createDataFrame([(t,) for t in easy], "t string").where(~F.col("t").rlike(T._INERT_ONLY) | F.col("t").rlike(T._MOVED))
    assert sent.count() == 0 and any(unicodedata.normalize("NFC", t) != t for t in easy)


def test_words_are_counted_and_cut():
    r = random.Random(4)
    texts = [" ".join(t or "" for t in some(r.randrange(30), SIGNS + LETTERS, k)) for k in range(200)]
    offsets = np.array([r.randrange(100) for _ in texts])
    assert units.count_words(pa.array(texts)).tolist() == [len(t.split()) for t in texts]
    want = []
    for k, t in enumerate(texts):
        lines: dict = {}
        for i, w in enumerate(unicodedata.normalize("NFC", t).split()):
            lines.setdefault((int(offsets[k]) + i) // 12, []).append(w)
        want += [(k, n, len(v), " ".join(v)) for n, v in lines.items()]
    text, line, n, piece = units.cut_words(pa.array(texts), offsets, 12)
    assert list(zip(text.tolist(), line.tolist(), n.tolist(), piece.to_pylist())) == want


def test_digests_are_md5():
    keys = ["a", "", None, "x" * 50, "y" * 60, "z" * 130, "க்ஷ:9", *(f"src{i % 20}:{i}" for i in range(50))]
    got = np.zeros((1_003, len(keys)), np.uint32)
    for reps, rows, values in digests.digests(7, 1_003, pa.array(["-", *keys])[1:]):
        got[reps, rows] = values
    for rep in (0, 9, 10, 99, 100, 999, 1_000, 1_002):
        said = [f"7|{rep}" + ("" if k is None else f"|{k}") for k in keys]
        assert got[rep].tolist() == [int(hashlib.md5(m.encode()).hexdigest()[:8], 16) for m in said]


def test_index_resamples_are_drawn_from_rows_in_order(spark, monkeypatch):
    monkeypatch.setattr(evaluate, "PACKED_ROWS", 7)
    monkeypatch.setattr(evaluate, "DRAWS_A_TASK", 900)
    rows = [(f"p{i}", i % 5, 20 + i, i % 2, 400 if i == 3 else 4) for i in range(60)]
    scored = spark.createDataFrame(rows, "name string, grapheme_edits int, grapheme_ref int, word_edits int, word_ref int").repartition(4)
    got = {r.metric: (r.lo, r.hi) for r in evaluate.bootstrap(scored, "name", n_boot=50, seed=3, method="index").collect()}
    rows.sort()
    draw = lambda rep, k: rows[int(hashlib.md5(f"3|{rep}|{k}".encode()).hexdigest()[:8], 16) % 60]
    for metric, e in (("grapheme", 1), ("word", 3)):
        rates = sorted(sum(d[e] for d in drawn) / sum(d[e + 1] for d in drawn) for drawn in ([draw(rep, k) for k in range(60)] for rep in range(50)))
        assert got[metric] == (rates[1], rates[48])


def test_registered_index_intervals_use_the_references_resamples(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(evaluate, "bootstrap", lambda *a, **k: asked.append((k["n_boot"], k["method"])))
    scores.bootstrap_ci_index(spark, "/root/testdata/sf0.001")
    assert asked == [(2_000, "index")]
    assert "range(0, 2000)" in core.ORACLES["bootstrap_ci_index"]


def test_variant_metrics_hold_all_rates_over_the_references_resamples(spark):
    got = {r.metric for r in scores.variant_metrics(spark, "/root/testdata/sf0.001").collect()}
    assert got == {*scores._METRICS, "grapheme_lo", "grapheme_hi", "word_lo", "word_hi"} and {"cer_grapheme_macro", "wer_macro", "total_words"} <= got
    assert "range(0, 2000)" in core.ORACLES["variant_metrics"]


def reads(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")


def test_pairs_are_scored_once_for_all_intervals_and_profiles(spark):
    pairs = spark.createDataFrame([("a", "க கி", "கி"), ("b", "x", "x")], "name string, ref string, hyp string")
    assert reads(evaluate.bootstrap(evaluate.score(pairs), "name", n_boot=10)) == 1
    assert reads(evaluate.aggregate(evaluate.score_profiles(pairs, T.PROFILES), ["profile"])) == 1


def test_no_pairs_under_every_profile(spark, monkeypatch):
    none = spark.createDataFrame([], "name string, ref string, hyp string")
    monkeypatch.setattr(scores.X, "pairs", lambda *_: none)
    got = scores.profile_sensitivity(spark, "").collect()
    assert sorted(r.profile for r in got) == sorted(p.name for p in T.PROFILES) and all(not any(r[1:]) for r in got)


def test_documents_are_cut_without_a_udf_over_whole_batches(spark):
    docs = spark.createDataFrame([(1, "s", "a b " * 20), (2, "s", None)], "doc_id long, source string, text string")
    df = corpus.chunk(docs, keep_tail=True)
    assert "ArrowEvalPython" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.line_no, r.n_words) for r in df.collect()) == [(0, 12), (1, 12), (2, 12), (3, 4)]
