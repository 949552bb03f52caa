"""Folder scans, written corpora and evaluations, and report rows on small tables with the awkward cases."""

import json

import pytest

from textlab import __version__
from textlab.operators import coverage, evaluate, grid, reports
from textlab.sources import files


def touch(folder, name, text="x"):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_images_by_suffix_in_any_case(spark, tmp_path):
    for name in ("b 1.JPG", "a.tiff", "c.Png", "notes.txt", "no suffix", "deep/d.tif"):
        touch(tmp_path, name)
    touch(tmp_path, "e+f.jpeg", "")
    assert [tuple(r) for r in files.scan_images(spark, str(tmp_path)).collect()] == [("a.tiff", "a", 1), ("b 1.JPG", "b 1", 1), ("c.Png", "c", 1), ("e+f.jpeg", "e+f", 0)]
    touch(tmp_path, "bare/readme.txt")
    with pytest.raises(files.NoImagesError):
        files.scan_images(spark, str(tmp_path / "bare"))


def test_typefaces_are_sorted_and_unknown_names_raise(spark, tmp_path):
    for name in ("Zed.ttf", "alpha.OTF", "mid.otf", "licence.txt"):
        touch(tmp_path, name)
    folder = str(tmp_path)
    assert [(r.ord, r.stem) for r in files.load_faces(spark, folder).orderBy("ord").collect()] == [(0, "Zed"), (1, "alpha"), (2, "mid")]
    assert [(r.ord, r.stem) for r in files.load_faces(spark, folder, ["mid", "Zed", "mid"]).orderBy("ord").collect()] == [(0, "Zed"), (1, "mid")]
    with pytest.raises(files.UnknownFacesError, match="ghost"):
        files.load_faces(spark, folder, ["mid", "ghost"])


def test_nested_folders_are_checked_by_size(spark, tmp_path):
    for stem in ("l1", "l2", "l 3"):
        touch(tmp_path, f"print/face_a/gt/{stem}.gt.txt", "" if stem == "l2" else "text")
    for stem in ("l1", "l2", "l9"):
        touch(tmp_path, f"print/face_a/images/{stem}.tiff", "")
    touch(tmp_path, "print/face_b/images/l1.tiff")
    touch(tmp_path, "print/face_a/gt/deeper/gt/l7.gt.txt")
    touch(tmp_path, "print/face_a/notes.txt")
    found = files.scan_renderings(spark, str(tmp_path))
    assert found.count() == 7
    got = {r.face: tuple(r)[2:] for r in reports.nested_integrity(found).collect()}
    assert got == {"face_a": (False, 3, 1, 1, 1), "face_b": (True, 0, 0, 0, 0)}


def test_corpus_and_evaluation_are_written_with_their_figures(spark, tmp_path):
    lines = spark.createDataFrame([(0, "கி கா"), (1, "கி")], "rank long, line string")
    files.write_corpus(lines, f"{tmp_path}/corpus")
    stats = json.loads((tmp_path / "corpus.stats.json").read_text(encoding="utf-8"))
    assert (stats["lines"], stats["words"], stats["unique_words"], stats["codepoints"]) == (2, 3, 2, 7)
    assert stats["top_graphemes"] == [["கி", 2], [" ", 1], ["கா", 1]]
    scored = evaluate.score(spark.createDataFrame([("a", "கி", "கா"), ("b", "x", "x")], "name string, ref string, hyp string"))
    files.write_evaluation(scored, evaluate.aggregate(scored), f"{tmp_path}/eval")
    agg = json.loads((tmp_path / "eval" / "aggregate.json").read_text())
    assert agg["lines"] == 2 and agg["cer_grapheme_micro"] == 0.5
    assert {(r.name, r.grapheme_edits) for r in spark.read.json(f"{tmp_path}/eval/per_line").collect()} == {("a", 1), ("b", 0)}
    results = spark.createDataFrame([("fonts", "f05", 10, 5, 0.5, None, None, 0.5, 0.5, None)], grid.RESULT)
    files.write_results(results, f"{tmp_path}/results")
    assert json.loads((tmp_path / "results/fonts/f05/result.json").read_text())["code_version"] == __version__


def test_report_rows_of_awkward_tables(spark):
    empty = spark.createDataFrame([], "source string, line_no long, line string")
    assert [tuple(r) for r in reports.coverage_rows(empty, coverage.syllabary(spark)).collect()] == [(None, "Full corpus", "0 & 0 & 0/247")]
    rows = [("b", 0, "கி கி"), ("b", 1, "க்"), ("a", 0, "x"), (None, 0, "அ")]
    pool = spark.createDataFrame(rows, empty.schema)
    got = {r.label: (r.position, r.cells) for r in reports.coverage_rows(pool, coverage.syllabary(spark)).collect()}
    assert got == {"b": (0, "2 & 4 & 2/247"), "a": (1, "1 & 1 & 0/247"), "Full corpus": (None, "4 & 6 & 3/247")}
    faces = [("b_x", "F & G", "", None, None, None, "(c)"), ("A", None, "d" * 40, "m", "OFL", None, None)]
    inventory = reports.inventory_rows(spark.createDataFrame(faces, "stem string, family string, designer string, manufacturer string, licence string, url string, copyright string"))
    assert [r.cells for r in inventory.collect()] == [f"A & -- & {'d' * 34} & OFL 1.1", r"b\_x & F \& G & -- & proprietary/unstated"]


def test_transcriptions_and_manifest(spark):
    placed = spark.createDataFrame([(0, 1, "second", "f", True), (0, 0, "first", "f", True), (0, 2, "below", "g", False), (1, 0, "next", "g", True)], "page long, row long, line string, stem string, drawn boolean")
    assert sorted((r.page_id, r.text) for r in reports.transcriptions(placed).collect()) == [("page_000001", "first\nsecond"), ("page_000002", "next")]
    faces = spark.createDataFrame([(0, "f"), (1, "g"), (2, "h")], "ord long, stem string")
    m = json.loads(reports.render_manifest(placed, faces, {"dpi": 300}).first().manifest)
    assert m["font_line_counts"] == {"f": 2, "g": 1, "h": 0} and (m["requested_lines"], m["crops_written"], m["n_fonts"]) == (4, 3, 3) and m["config"] == {"dpi": 300}


def test_console_lines():
    agg = {"lines": 3, "total_graphemes": 10, "total_words": 4, "cer_grapheme_micro": 0.1, "cer_grapheme_macro": 0.2, "cer_codepoint_micro": 0.05, "wer_micro": 0.5, "wer_macro": 1.0}
    lines = reports.console(agg, {"grapheme CER": (0.05, 0.15)}, 2000)
    assert "CER (grapheme, micro):   10.00%" in lines and lines[-1] == "95% CI, grapheme CER: [5.00%, 15.00%] (2000 resamples over lines)"
