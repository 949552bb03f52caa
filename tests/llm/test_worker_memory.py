"""What a Python worker holds beside an operator's own tables."""

import gc
import weakref

import pyarrow as pa
import sentencepiece

from textlab.llm import common, neardup
from textlab.llm import sentencepiece_codec as sc


class Frame:
    """Stands for a frame: gives the function that Spark would run in a worker."""

    def mapInArrow(self, run, schema):  # noqa: N802
        return run

    def groupBy(self, *keys):  # noqa: N802
        return self

    def applyInArrow(self, run, schema):  # noqa: N802
        return run


BATCH = pa.RecordBatch.from_pydict({"x": [1, 2]})


def codec():
    gc.collect()
    return weakref.ref(sc.worker_codec(sc.default_model()))


def lengths():
    return lambda batch: iter([{"x": batch.column("x")}])


def test_an_operators_tables_go_when_the_worker_turns_to_another(spark):
    held = codec()
    common.drop_unasked()
    assert held() is not None
    assert [b.column("x").to_pylist() for b in common.arrow_map(Frame(), lengths, "x int")([BATCH])] == [[1, 2]]
    gc.collect()
    assert held() is None
    held = codec()
    common.drop_unasked()
    neardup._grouped(Frame(), ["x"], lambda c: {"x": c["x"]}, "x int")(pa.Table.from_batches([BATCH]))
    gc.collect()
    assert held() is None


def test_the_operators_own_tables_stay_between_its_tasks(spark):
    def encode():
        codec = sc.worker_codec(sc.default_model())
        return lambda batch: iter([{"x": [codec.run(["a b"])[0][0]] * batch.num_rows}])

    run = common.arrow_map(Frame(), encode, "x int")
    list(run([BATCH]))
    held = codec()
    list(run([BATCH]))
    gc.collect()
    assert held() is not None and "b" in held().ids


def test_parts_of_a_call_change_no_ids(monkeypatch):
    sp = sentencepiece.SentencePieceProcessor(model_file=sc.default_model())
    texts = ["one two  three", None, "", " two four\n", "one " * 50, "five▁one", "two", "x" * 60 + " one"]
    monkeypatch.setattr(sc, "PART_CHARS", 10)
    for most in (200_000, 3):
        own = sc.ChunkCodec(sc.default_model(), most=most)
        calls = []
        part = own._part
        own._part = lambda t, met, part=part, calls=calls: calls.append(len(t)) or part(t, met)
        for _ in range(2):
            got = own.run(texts)
            assert [g[1] for g in got] == [",".join(map(str, sp.encode(t or ""))) for t in texts]
            assert [g[2] for g in got] == [sp.decode(sp.encode(t or "")) for t in texts]
        assert sum(calls) == 2 * len(texts) and len(calls) > 4
