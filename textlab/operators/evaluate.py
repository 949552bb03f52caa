"""Scores of pairs, micro and macro rates, confusions, and bootstrap intervals."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions import units
from ..functions.digests import KEYS, digests
from ..functions.distance import UNITS, alignment_errors, distances, steps
from ..functions.text import NormProfile, graphemes, rate
from .. import session


class NoPairsError(ValueError):
    pass


KINDS = tuple(UNITS)
SCORES = [f"{unit}_{x}" for unit in KINDS for x in ("edits", "ref")]


def score(pairs: DataFrame, profile: NormProfile = NormProfile(), keep_text: bool = False) -> DataFrame:
    """Edits and reference units by grapheme, code point and word of each pair; one map, no shuffle. A null side counts as
    empty. Texts are normalised, cut and compared as arrays, a slice of a batch at a time."""
    return score_profiles(pairs, (profile,), keep_text)


def score_profiles(pairs: DataFrame, profiles: tuple[NormProfile, ...], keep_text: bool = False) -> DataFrame:
    """The scores of each pair under each of the profiles, from one reading of the pairs."""
    others = [c for c in pairs.columns if c not in ("ref", "hyp")]
    fields = StructType([StructField(pairs.schema[c].name, pairs.schema[c].dataType) for c in others])
    for c in ("ref", "hyp") if keep_text else ():
        fields.add(c, StringType())
    for c in SCORES:
        fields.add(c, IntegerType())
    fields.add("profile", StringType(), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(fields)
        for batch in batches:
            for part in units.slices(batch):
                for profile in profiles:
                    ref, hyp = (units.normalized(part.column(c), profile) for c in ("ref", "hyp"))
                    found = [part.column(c) for c in others] + ([units.spelled(x) for x in (ref, hyp)] if keep_text else [])
                    for unit in KINDS:
                        a, b = units.tokens(unit, ref, hyp)
                        found += [pa.array(distances(a, b).astype(np.int32)), pa.array(np.diff(a[1]).astype(np.int32))]
                    found.append(pa.array([profile.name] * part.num_rows, pa.string()))
                    yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(found, schema)], schema=schema)

    return pairs.select(*others, *[F.col(c).cast("string").alias(c) for c in ("ref", "hyp")]).mapInArrow(run, fields)


def _micro(unit: str) -> Column:
    edits, total = (F.coalesce(F.sum(f"{unit}_{x}"), F.lit(0)) for x in ("edits", "ref"))
    return rate(edits, total)


def aggregate(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Lines, micro and macro rates and reference totals; no pairs give zeros. Rates of an empty table are 0.0."""
    macro = lambda unit: F.coalesce(F.avg(rate(F.col(f"{unit}_edits"), F.col(f"{unit}_ref"))), F.lit(0.0))
    return scored.groupBy(*(by or [])).agg(
        F.count("*").alias("lines"),
        _micro("grapheme").alias("cer_grapheme_micro"), macro("grapheme").alias("cer_grapheme_macro"), _micro("codepoint").alias("cer_codepoint_micro"),
        _micro("word").alias("wer_micro"), macro("word").alias("wer_macro"),
        F.coalesce(F.sum("grapheme_ref"), F.lit(0)).alias("total_graphemes"), F.coalesce(F.sum("word_ref"), F.lit(0)).alias("total_words"),
    )


_CONFUSIONS = "kind string, ref string, hyp string, n long"


def _count_errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in units.slices(batch):
            a, b = (units.graphemes(units.points(part.column(c))) for c in ("ref", "hyp"))
            none = np.uint64(0xFFFFFFFF)
            found = [np.empty(0, np.uint64)]
            for _, i, j in steps(a, b, errors_only=True):
                x, y = (np.where(k < 0, none, s[0][np.maximum(k, 0)] if len(s[0]) else none) for s, k in ((a, i), (b, j)))
                found.append(x.astype(np.uint64) << np.uint64(32) | y.astype(np.uint64))
            both, n = np.unique(np.concatenate(found), return_counts=True)
            sides = [[None if x == int(none) else units.unit_text(x) for x in side.tolist()] for side in (both >> np.uint64(32), both & none)]
            kinds = ["insertion" if x is None else "deletion" if y is None else "substitution" for x, y in zip(*sides)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (kinds, *sides)] + [pa.array(n, pa.int64())], ["kind", "ref", "hyp", "n"])


def confusions(pairs: DataFrame, tokens=graphemes) -> DataFrame:
    """(kind, ref, hyp, n) over the optimal alignments of all pairs: substitution, deletion (hyp null), insertion (ref null).
    Graphemes are counted where they are aligned, so a slice of pairs leaves its distinct confusions only."""
    if tokens is graphemes:
        counted = pairs.select(F.col("ref").cast("string"), F.col("hyp").cast("string")).mapInArrow(_count_errors, _CONFUSIONS)
        return counted.groupBy("kind", "ref", "hyp").agg(F.sum("n").alias("n"))
    errors = pairs.select(F.inline(alignment_errors(tokens(F.col("ref")), tokens(F.col("hyp")))))
    kind = F.when(F.col("hyp").isNull(), "deletion").when(F.col("ref").isNull(), "insertion").otherwise("substitution")
    return errors.groupBy(kind.alias("kind"), "ref", "hyp").agg(F.count("*").alias("n"))


def top_per_kind(found: DataFrame, k: dict[str, int]) -> DataFrame:
    """The k most frequent confusions of each kind, ties by ref, then hyp: a bounded top-k a kind, no sort of a whole kind.
    The pairs are aligned once: the confusions, an inventory, are stored."""
    found, out = session.stored(found), None
    for kind, n in k.items():
        top = found.where(F.col("kind") == kind).orderBy(F.desc("n"), "ref", "hyp").limit(n)
        out = top if out is None else out.unionByName(top)
    return out


def confusion_share(found: DataFrame, stored: int = 30) -> DataFrame:
    """Each stored substitution's share of the stored ones (share_stored) and of all substitutions (share_all)."""
    subs = session.stored(found.where(F.col("kind") == "substitution"))
    top = subs.orderBy(F.desc("n"), "ref", "hyp").limit(stored)
    totals = top.agg(F.sum("n").alias("stored")).join(F.broadcast(subs.agg(F.sum("n").alias("every"))))
    return top.join(F.broadcast(totals)).select("ref", "hyp", "n", (F.col("n") / F.col("stored")).alias("share_stored"), (F.col("n") / F.col("every")).alias("share_all"))


#: Upper ends of the cumulated Poisson(1) probabilities: a uniform below the k-th is a weight of k.
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975, 0.99999887)


def _intervals(replicates: DataFrame, names: tuple[str, ...], n_boot: int, alpha: float) -> DataFrame:
    """(metric, lo, hi) of all units from one aggregate over the replicates, each with the number of rows it was drawn from."""
    lo, hi = int(alpha / 2 * n_boot), min(int((1 - alpha / 2) * n_boot), n_boot - 1)
    rates = [F.array_sort(F.collect_list(rate(F.col(f"{u}_edits"), F.col(f"{u}_ref")))).alias(u) for u in names]
    two = F.coalesce(F.col("n"), F.lit(0)) >= 2
    end = lambda u, k: F.when(two, F.get(u, F.lit(k)))
    ends = [F.struct(F.lit(u).alias("metric"), end(u, lo).alias("lo"), end(u, hi).alias("hi")) for u in names]
    return replicates.agg(*rates, F.max("n").alias("n")).select(F.inline(F.array(*ends)))


def _partial(total: np.ndarray, n: int, sums: list[str]) -> pa.RecordBatch:
    columns = [np.arange(len(total), dtype=np.int32), *total.T, np.full(len(total), n, np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], ["rep", *sums, "n"])


def _by_weight(sums: list[str], n_boot: int, seed: int):
    ends = [math.ceil(p * (1 << 32)) for p in POISSON]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One partial sum a replicate of this task's rows."""
        total, n = np.zeros((n_boot, len(sums)), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            values = np.stack([pc.fill_null(batch.column(c), 0).to_numpy(zero_copy_only=False) for c in sums], axis=1).astype(np.float64)
            for reps, rows, u in digests(seed, n_boot, batch.column("key")):
                weight = np.zeros(u.shape, np.uint8)
                for p in ends:
                    weight += u >= np.uint32(p)
                total[reps] += np.rint(weight.astype(np.float64) @ values[rows]).astype(np.int64)
        if n:
            yield _partial(total, n, sums)

    return run


PACKED_ROWS, DRAWS_A_TASK = 500_000, 20_000_000


def _packed(rows: DataFrame, sums: list[str], kind: str) -> DataFrame:
    """(part, piece, n, data): the rows' sums in the order of their keys, as blocks of fixed-width numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, held, part = 0, [], 0

        def block() -> pa.RecordBatch:
            values = np.concatenate(held)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "piece": pa.array([piece], pa.int32()), "n": pa.array([len(values)], pa.int64()), "data": pa.array([values.tobytes()], pa.binary())})

        for batch in batches:
            if batch.num_rows:
                part = batch.column("part")[0].as_py()
                held.append(np.stack([pc.fill_null(batch.column(c), 0).to_numpy(zero_copy_only=False) for c in sums], axis=1).astype(kind))
            if sum(map(len, held)) >= PACKED_ROWS:
                yield block()
                piece, held = piece + 1, []
        if held:
            yield block()

    ordered = rows.repartitionByRange("key").sortWithinPartitions("key").withColumn("part", F.spark_partition_id())
    return ordered.mapInArrow(run, "part int, piece int, n long, data binary")


def _by_index(rows: DataFrame, sums: list[str], n_boot: int, seed: int) -> DataFrame:
    """Replicates of n rows drawn with replacement: draw k of a replicate takes the row whose number, in the order of the
    keys, is a digest modulo n. Draws are dealt to tasks by k; each task holds all rows as packed numbers, a few bytes a row,
    which reach it by shuffle and never pass the driver."""
    spark = rows.sparkSession
    rows = session.stored(rows)
    size = rows.agg(F.count("*").alias("n"), *[F.max(c).alias(c) for c in sums]).first()
    n, most = size["n"], max([size[c] or 0 for c in sums])
    kind = next(k for k in ("uint8", "uint16", "uint32", "int64") if most <= np.iinfo(k).max)
    blocks = session.stored(_packed(rows, sums, kind))
    begins, at = {}, 0
    for x in sorted(blocks.select("part", "piece", "n").collect()):
        begins[x.part, x.piece], at = at, at + x.n
    tasks = max(1, min(2 * spark.sparkContext.defaultParallelism, -(-n * n_boot // DRAWS_A_TASK), n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, task = np.empty((n, len(sums)), kind), None
        for batch in batches:
            for row in range(batch.num_rows):
                task, part, piece = (batch.column(c)[row].as_py() for c in ("task", "part", "piece"))
                block = np.frombuffer(batch.column("data")[row].as_buffer(), kind).reshape(-1, len(sums))
                begin = begins[part, piece]
                table[begin : begin + len(block)] = block
        if task is None:
            return
        total = np.zeros((n_boot, len(sums)), np.int64)
        low, high = n * task // tasks, n * (task + 1) // tasks
        for begin in range(low, high, KEYS):
            keys = pa.array(np.arange(begin, min(high, begin + KEYS))).cast(pa.string())
            for reps, _, u in digests(seed, n_boot, keys):
                drawn = table[(u % np.uint32(n)).ravel()].reshape(*u.shape, len(sums))
                total[reps] += drawn.sum(axis=1, dtype=np.int64)
        yield _partial(total, high - low, sums)

    whole = spark.range(0, tasks, 1, 1).select(F.col("id").cast("int").alias("task")).crossJoin(blocks)
    return whole.repartitionById(tasks, F.col("task")).mapInArrow(run, _replicate_columns(sums))


def _replicate_columns(sums: list[str]) -> str:
    return f"rep int, {', '.join(f'{c} long' for c in sums)}, n long"


def bootstrap(scored: DataFrame, key: str, units: tuple[str, ...] = ("grapheme", "word"), n_boot: int = 2000, alpha: float = 0.05, seed: int = 0, method: str = "poisson") -> DataFrame:
    """(metric, lo, hi): percentile interval of the micro rate over resampled rows; null ends for fewer than two rows.

    `index` draws n rows with replacement a replicate; each task holds all rows as packed numbers. `poisson` gives
    each row a Poisson(1) weight a replicate: rows stay where they are, weights come from digests, and tasks send one
    partial sum a replicate, at any number of rows; it is the default at every size. All metrics share the resamples."""
    sums = [f"{u}_{x}" for u in units for x in ("edits", "ref")]
    rows = scored.select(F.col(key).cast("string").alias("key"), *[F.col(c).cast("long") for c in sums])
    drawn = _by_index(rows, sums, n_boot, seed) if method == "index" else rows.mapInArrow(_by_weight(sums, n_boot, seed), _replicate_columns(sums))
    replicates = drawn.groupBy("rep").agg(*[F.sum(c).alias(c) for c in (*sums, "n")])
    return _intervals(replicates, units, n_boot, alpha)
