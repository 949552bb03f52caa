"""What the operators share: table access, Arrow maps over texts, bounded samples, shared-folder tables."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_stashed: list[str] = []


def stash(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes `df` as a compressed table in the shared folder and reads it back. A lost executor costs a
    re-read, not a recomputation. Tables stay until release() or until the folder is cleaned, as checkpoints do."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/textlab/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _stashed.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, since: int, keep: int = 1) -> None:
    """Deletes the stashed tables from number `since` on, but for the last `keep`: for jobs whose result is written."""
    gone = _stashed[since : len(_stashed) - keep]
    del _stashed[since : len(_stashed) - keep]
    for path in gone:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stashed() -> int:
    return len(_stashed)


SLICE_BYTES, SLICE_ROWS = 4_000_000, 2_000


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The parts of a batch, in order, of about SLICE_BYTES bytes of text and SLICE_ROWS rows at most; a longer row is a part
    of its own. What becomes Python objects at once is bounded by this, whatever Spark's batches hold."""
    size = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = 0
    ends = np.cumsum(size)
    while begin < batch.num_rows:
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, min(begin + SLICE_ROWS, int(np.searchsorted(ends, before + SLICE_BYTES, "right"))))
        yield batch.slice(begin, end - begin)
        begin = end


_kept: dict[Hashable, object] = {}
_asked: set[Hashable] = set()


def kept_by_worker(name: Hashable, make: Callable[[], object]) -> object:
    """What this Python worker keeps between its tasks under `name`. Spark gives a worker to any operator's tasks in turn; it
    goes with the first that does not ask for it, so that no operator works beside another's tables."""
    _asked.add(name)
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def drop_unasked() -> None:
    """Called once a task has asked for what it keeps."""
    if gone := _kept.keys() - _asked:
        for name in gone:
            del _kept[name]
        give_back()
    _asked.clear()


def give_back() -> None:
    """Freed memory goes back to the system, not to this worker's next task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def mapped(batches: Iterator[pa.RecordBatch], make: Callable[[], Callable]) -> Iterator[tuple[Callable, pa.RecordBatch]]:
    """The function that `make()` builds for this task, with each of the slices() of its batches."""
    fn = make()
    drop_unasked()
    for batch in batches:
        for part in slices(batch):
            yield fn, part
    del fn


def _fields(schema: str | StructType) -> tuple[StructType, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = StructType.fromDDL(schema) if isinstance(schema, str) else StructType([StructField(f.name, f.dataType) for f in schema])
    return fields, to_arrow_schema(fields)


def _column(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict]]], schema: str | StructType) -> DataFrame:
    """mapInArrow where `make()` builds the batch function once a task and that yields dicts of columns (lists or Arrow
    arrays) for each of the slices() of a batch."""
    fields, arrow = _fields(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fn, part in mapped(batches, make):
            for out in fn(part):
                yield pa.RecordBatch.from_arrays([_column(out[f.name], f.type) for f in arrow], schema=arrow)
        fn = part = out = None
        give_back()

    return df.mapInArrow(run, fields)


def text_map(docs: DataFrame, keep: list[str], make: Callable[[], Callable[[list[str | None]], dict]], results: str, text: str = "text") -> DataFrame:
    """The columns `keep` of `docs`, passed on as Arrow arrays, and the columns `results` (of names of their own) that a
    function of a list of texts gives. Where it gives "take", only these rows (by number) go on, and the results are theirs."""
    fields, arrow = _fields(StructType([docs.schema[c] for c in keep] + list(StructType.fromDDL(results))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fn, part in mapped(batches, make):
            out = fn(part.column(len(keep)).to_pylist())
            rows = part if "take" not in out else part.take(pa.array(out["take"], pa.int64()))
            made = [_column(out[f.name], f.type) for f in list(arrow)[len(keep) :]]
            yield pa.RecordBatch.from_arrays([rows.column(i).cast(arrow.field(i).type) for i in range(len(keep))] + made, schema=arrow)
        fn = part = out = rows = made = None
        give_back()

    return docs.select(*[docs[c] for c in keep], docs[text].alias("__text")).mapInArrow(run, fields)


def with_text(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of `docs`, with the texts in __cut; n_chars, where there is one, is the text's length (that of a null text
    stays)."""
    new = {"text": F.col("__cut")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.length("__cut"), "n_chars").cast(docs.schema["n_chars"].dataType)
    return changed.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def crc_fold(column: str, n: int) -> Column:
    """crc32 of the column as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def unit_hash(seed: int, *columns: str) -> Column:
    """A value in [0, 1) that depends on the columns' values alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 30)) / float(1 << 30)


def bounded_sample(df: DataFrame, cap: int, key: str, by: str | None = None, seed: int = 1) -> DataFrame:
    """About `cap` rows (a value of `by`), by hash of `key`: the same rows at every partitioning, no shuffle of rows."""
    u = unit_hash(seed, key)
    if by is None:
        n = df.count()
        return df.where(u < min(1.0, cap / max(1, n)))
    chosen = F.lit(False)
    for row in df.where(F.col(by).isNotNull()).groupBy(by).count().collect():
        chosen = chosen | ((F.col(by) == F.lit(row[by])) & (u < min(1.0, cap / row["count"])))
    return df.where(chosen)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, cap: int, keep: Column | None = None, seed: int = 1) -> DataFrame:
    """(doc_id, text, label) of about `cap` labelled documents a class: ids are sampled first, so the broadcast side holds
    at most about cap rows a class whatever the tables' sizes."""
    rows = labels.where(F.col(label).isin(0, 1))
    rows = rows if keep is None else rows.where(keep)
    rows = rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    ids = bounded_sample(rows, cap, "doc_id", "y", seed)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
