"""Readers and writers on real files, the jobs built on them, and golden pairs of our own."""

import json
import math
import os

import pytest
from pyspark.sql import functions as F

from textlab import plans, session, streaming
from textlab.functions.text import NormProfile
from textlab.operators import corpus, evaluate, grid, order, pairs
from textlab.sources import files


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_sources_are_whole_files(spark, tmp_path):
    put(tmp_path, "news a.txt", "one two\nthree")
    put(tmp_path, "poems.txt", "")
    put(tmp_path, "notes.md", "no source")
    got = {r.source: (r.doc_id, r.text) for r in files.read_sources(spark, str(tmp_path)).collect()}
    assert got == {"news a": (0, "one two\nthree"), "poems": (0, "")}
    lines = corpus.chunk(files.read_sources(spark, str(tmp_path)), width=2, keep_tail=True)
    assert sorted((r.source, r.line_no, r.line) for r in lines.collect()) == [("news a", 0, "one two"), ("news a", 1, "three")]


def test_empty_transcriptions_are_found(spark, tmp_path):
    put(tmp_path, "a.gt.txt", "text")
    put(tmp_path, "b.gt.txt", "")
    put(tmp_path, "b.txt", "")
    assert sorted(map(tuple, files.read_stems(spark, str(tmp_path)).collect())) == [("a", "text"), ("b", "")]
    assert sorted(map(tuple, files.read_stems(spark, str(tmp_path), ".txt").collect())) == [("b", "")]


def test_lines_manifest_and_report_round_trips(spark, tmp_path):
    rows = spark.createDataFrame([(2, "c"), (0, "a"), (1, "b, \"q\"")], "rank long, line string").repartition(3)
    files.write_lines(rows, f"{tmp_path}/lines")
    parts = sorted(x for x in os.listdir(tmp_path / "lines") if x.startswith("part"))
    assert "".join((tmp_path / "lines" / x).read_text() for x in parts) == 'a\nb, "q"\nc\n'
    for _ in range(2):
        files.append_manifest(rows, f"{tmp_path}/manifest")
    back = spark.read.option("header", True).csv(f"{tmp_path}/manifest")
    assert sorted(r.line for r in back.collect()) == sorted(["a", 'b, "q"', "c"] * 2)
    files.write_report(rows, f"{tmp_path}/report")
    assert sorted(r.line for r in spark.read.json(f"{tmp_path}/report").collect()) == ["a", 'b, "q"', "c"]


def test_results_are_written_one_a_variant_and_found_by_pattern(spark, tmp_path):
    rows = spark.createDataFrame([("fonts", "f05", 10, 5, 0.1, None, None, 0.2, 0.3, None), ("size", "n001k", 1000, 29, 0.2, 0.1, 0.3, 0.2, 0.3, "t")], grid.RESULT)
    files.write_results(rows, f"file://{tmp_path}")
    put(tmp_path, "fonts/f05/other.json", "{}")
    assert json.loads((tmp_path / "size/n001k/result.json").read_text())["n_lines"] == 1000
    back = files.read_results(spark, f"file://{tmp_path}")
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    variants = spark.createDataFrame([("fonts", "f05", 10, 5, None, 0), ("fonts", "f10", 10, 10, None, 0)], grid.VARIANT)
    assert [r.name for r in grid.unfinished(variants, back).collect()] == ["f10"]
    assert grid.unfinished(variants, back, force=True).count() == 2


def test_journal_is_followed_as_it_grows(spark, tmp_path):
    ok = spark.createDataFrame([("fonts", "f05", 0.25, "t0")], "experiment string, variant string, cer_grapheme_micro double, timestamp string")
    failed = spark.createDataFrame([("fonts", "f10", "failed", "no face", "t1")], "experiment string, variant string, status string, error string, timestamp string")
    seen = []
    for rows in (ok, failed):
        files.append_journal(rows, f"{tmp_path}/journal")
        stream = streaming.follow_journal(spark, f"{tmp_path}/journal")
        run = stream.writeStream.foreachBatch(lambda df, _: seen.append(sorted((r.variant, r.status) for r in df.collect()))).option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
        assert run.awaitTermination(60)
    assert [x for x in seen if x] == [[("f05", None)], [("f10", "failed")]]


def test_corpus_built_before_or_after_the_cut(spark):
    docs = spark.createDataFrame([("a", i, "கி " * 11 + ("ஃ" if i % 3 == 0 else "கா") + str(i)) for i in range(12)], "source string, doc_id long, text string")
    points = spark.createDataFrame([(ord(c),) for c in "கிா0123456789"], "cp int")
    every = plans.build_corpus(docs, points).count()
    assert every == 8
    assert plans.build_corpus(docs, points, n_lines=5, filter_first=True).count() == 5
    assert plans.build_corpus(docs, points, n_lines=12).count() == 8


def test_table_cells_and_frame(spark):
    df = spark.createDataFrame([("a_b & c",), ("",), (None,)], "x string").select(grid.escape(F.col("x")).alias("x"))
    assert [r.x for r in df.collect()] == [r"a\_b \& c", "--", "--"]
    table = grid.latex_table("A & B", ["1 & 2"], "cap", "tab:x")
    assert r"\begin{tabular}{lc}" in table and "1 & 2 \\\\" in table and r"\label{tab:x}" in table


def test_golden_pairs_of_our_own(spark):
    """Pairs with edits counted by hand: one substitution of a grapheme, a lost word, an added word, and equal texts."""
    rows = [("sub", "கி மலை", "கீ மலை"), ("lost", "one two three", "one three"), ("added", "one", "one two"), ("same", "அ ஆ", "அ ஆ")]
    scored = {r.name: r for r in evaluate.score(spark.createDataFrame(rows, "name string, ref string, hyp string"), NormProfile()).collect()}
    got = {k: (r.grapheme_edits, r.grapheme_ref, r.word_edits, r.word_ref) for k, r in scored.items()}
    assert got == {"sub": (1, 4, 1, 2), "lost": (4, 13, 1, 3), "added": (4, 3, 1, 1), "same": (0, 3, 0, 2)}
    total = evaluate.aggregate(evaluate.score(spark.createDataFrame(rows, "name string, ref string, hyp string"))).first()
    assert math.isclose(total.cer_grapheme_micro, 9 / 23) and math.isclose(total.wer_micro, 3 / 8)


def test_rows_without_an_id_lose_no_word(spark, monkeypatch):
    monkeypatch.setattr(order, "BLOCK_IDS", 2)
    rows = [("s", None, "b " * 20), ("s", None, "a " * 34), ("s", 1, "c " * 30), (None, 2, "d " * 12), ("", 3, "e " * 12), ("s", 1, "f " * 12)]
    lines = corpus.chunk(spark.createDataFrame(rows, "source string, doc_id long, text string"), keep_tail=True).collect()
    text = {s: " ".join(r.line for r in sorted(lines, key=lambda r: r.line_no) if r.source == s) for s in ("s", "")}
    assert text["s"].split() == ["a"] * 34 + ["b"] * 20 + ["c"] * 30 + ["f"] * 12 and text[""].split() == ["d"] * 12 + ["e"] * 12
    assert sum(r.n_words for r in lines) == 120


def test_first_problems_and_missing_shared_folder(spark):
    s = spark.createDataFrame([(i, "ok" if i % 2 else f"bad: {i}") for i in range(40)], "i long, status string")
    assert [r.i for r in pairs.first_problems(s, "i").collect()] == list(range(0, 20, 2))

    class Cluster:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(dict)
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(session.NoSharedFolderError):
        session.shared_folder(Cluster)
