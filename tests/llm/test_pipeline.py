import sentencepiece

import corpus_pipeline as p
from textlab.llm import importance, pii, sentencepiece_codec, winnowing
from tests.llm.test_neardup import brute as groups
from tests.llm.test_winnowing import brute as hits

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    verdict = {r.doc_id: r["__kept"] for r in importance.select(docs, labels, ["doc_id"]).collect()}
    good = p.quality(spark, docs, SF)
    assert good.columns == docs.columns
    assert sorted(r.doc_id for r in good.collect()) == sorted(d for d, kept in verdict.items() if kept)

    one = p.near_duplicates(spark, good, SF)
    pairs = [(r.doc_id, r.text) for r in good.collect()]
    assert one.columns == docs.columns
    assert sorted(r.doc_id for r in one.collect()) == sorted({c for _, _, c in groups(pairs, 5)})

    clean = {r.doc_id: r for r in p.decontaminate(spark, one, SF).collect()}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = [(r.doc_id, r.text) for r in one.collect()]
    found = hits(before, bench)
    assert sorted(clean) == sorted(d for d, (n, hit, _) in found.items() if hit <= 0.5 * n)
    for d, text in before:
        if d in clean:
            assert (clean[d].text == text) == (found[d][1] == 0)
            assert len(winnowing.words(clean[d].text)) == found[d][0] - found[d][1]

    rows = [tuple(r) for r in clean.values()]
    bare = p.redact(spark, spark.createDataFrame(rows, docs.schema), SF)
    for r in bare.collect():
        assert r.n_chars == len(r.text) and not any(pii.base_spans(r.text).values())

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    texts = {r.doc_id: r.text for r in bare.collect()}
    for r in p.encode(spark, bare, SF).collect():
        assert r.ids == sp.encode(texts[r.doc_id])


def test_run_and_empty_input(spark, tmp_path):
    got = p.run(spark, SF)
    assert got.count() > 100 and got.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256"]
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0
