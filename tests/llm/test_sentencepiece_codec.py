import hashlib

import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from textlab.llm import sentencepiece_codec as codec

SP = sentencepiece.SentencePieceProcessor(model_file=codec.default_model())
TABLE = codec.ChunkCodec(codec.default_model(), most=50, longest=12)


def whole(text):
    ids = SP.encode(text)
    return len(ids), ",".join(map(str, ids)), SP.decode(ids)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t▁aeéß<s>/�,.0 😀க"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_chunks_equal_the_library(text):
    assert TABLE.run([text]) == [whole(text)]


def test_table_stays_small_and_long_chunks_pass():
    text = "x" * 30_000 + " " + " ".join(f"w{i}" for i in range(500)) + "  end  "
    assert TABLE.run([text]) == [whole(text)]
    assert len(TABLE.ids) <= TABLE.most


def test_slices_share_the_table_and_repeat():
    texts = ["the cat", None, "the  cat ", "▁▁ the", "the cat", "", "a\u00a0b \x00"]
    assert TABLE.run(texts) == [whole(t or "") for t in texts]
    assert TABLE.run(texts[::-1]) == [whole(t or "") for t in texts[::-1]]


def test_operator_keeps_columns_and_defines_edges(spark):
    rows = [(1, "a b", "k"), (2, None, "k"), (3, "", "k"), (1, "a b", "k")]
    out = codec.encode_decode(spark.createDataFrame(rows, "doc_id long, text string, ids string")).orderBy("doc_id").collect()
    assert [r.n_tokens for r in out] == [len(SP.encode("a b"))] * 2 + [0, 0]
    assert [r.ids for r in out] == [SP.encode("a b")] * 2 + [[], []]
    assert [r.decoded for r in out] == ["a b", "a b", "", ""]
    assert [r.text for r in out] == ["a b", "a b", None, ""]
    assert codec.encode_decode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_against_the_library(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in codec.query(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        n, ids, text = whole(r.text or "")
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == (n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
