"""From source texts to a selected corpus: chunking into lines of a fixed number of words, first-wins deduplication, script
filter, seeded order, truncation, provenance and statistics.

Order is data: every table carries its ordinal, and no operator relies on the order of rows in a DataFrame.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import units
from ..functions.text import graphemes, has_script, words
from .order import global_rank, id_block, running_offset

WORDS_A_LINE = 12


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds n, the number of words, and leaves out texts without any."""
    for batch in batches:
        for part in units.slices(batch):
            n = units.count_words(part.column("text"))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n)], [*part.schema.names, "n"]).filter(pa.array(n > 0))


def _cutter(width: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of `width` words, or the shorter ones at the ends of documents."""
        for batch in batches:
            for part in units.slices(batch):
                text, line, n, pieces = units.cut_words(part.column("text"), part.column("at").to_numpy(), width)
                take = pa.array(np.flatnonzero((n == width) == whole))
                source, at = (part.column(c).take(pa.array(text)) for c in ("source", "at"))
                yield pa.RecordBatch.from_arrays([x.take(take) for x in (source, at, pa.array(line), pa.array(n), pieces)], ["source", "at", "line_no", "n_words", "line"])

    return run


def chunk(docs: DataFrame, per_source: bool = True, width: int = WORDS_A_LINE, keep_tail: bool = False) -> DataFrame:
    """(source, line_no, line, n_words): the words of all documents, by source (or of the whole stream of sources) in the
    order of doc_id, cut every `width` words. A null text has no words; a null source is the source ""; rows without a
    doc_id come first, in the order of their texts, and so do rows that share one.

    Words never leave their document one by one. Document word counts give offsets, each document cuts its own words at the
    lines' borders, and only the pieces of lines that span documents are shuffled (at most `width` a line). Words are counted
    and cut on arrays of code points, a slice of a batch of documents at a time."""
    docs = docs.select(F.coalesce("source", F.lit("")).alias("source"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counted = docs.mapInArrow(_counted, StructType([*docs.schema.fields, StructField("n", LongType())]))
    placed = running_offset(counted, ["source"], id_block("doc_id", "text"), [F.col("doc_id"), F.col("text")], F.col("n"))
    if not per_source:
        totals = counted.groupBy("source").agg(F.sum("n").alias("total"))
        starts = running_offset(totals, [], F.substring("source", 1, 1), [F.col("source")], F.col("total"), "start").drop("total")
        placed = placed.join(starts, "source").withColumn("offset", F.col("offset") + F.col("start")).drop("start")
    placed = placed.select("source", F.col("offset").cast("long").alias("at"), "text")
    cut = lambda whole: placed.mapInArrow(_cutter(width, whole), "source string, at long, line_no long, n_words long, line string")
    by = ["source", "line_no"] if per_source else ["line_no"]
    order = F.array_sort(F.collect_list(F.struct("at", "line")))
    met = cut(False).groupBy(*by).agg(F.array_join(F.transform(order, lambda x: x["line"]), " ").alias("line"), F.sum("n_words").alias("n_words"))
    out = cut(True).select(*by, "line", "n_words").unionByName(met)
    return out if keep_tail else out.where(F.col("n_words") == width)


def dedup(pool: DataFrame) -> DataFrame:
    """One row a distinct line: its first occurrence in the order of source, then line_no. Aggregation with map-side
    combining, so a line that makes up a third of the pool costs no task more than the others."""
    first = pool.groupBy("line").agg(F.min(F.struct("source", "line_no")).alias("f"))
    return first.select("f.source", "f.line_no", "line")


def seeded(line: Column, seed: int) -> Column:
    """The deterministic shuffle: lines in the order of the digest of seed and line."""
    return F.md5(F.concat(F.lit(f"{seed}|"), line).cast("binary"))


class UnknownSourceError(KeyError):
    pass


class TooFewLinesError(ValueError):
    pass


def select(pool: DataFrame, sources: list[str] | None = None, n_lines: int | None = None, seed: int = 0, deduplicate: bool = True, require_script: bool = True, check: bool = False) -> DataFrame:
    """(rank, source, line_no, line): pool, dedup, script filter, seeded shuffle, truncation, in this order.

    With `check`, unknown sources and asking for more lines than there are raise before anything is returned."""
    if sources is not None:
        if check:
            there = {r.source for r in pool.where(F.col("source").isin(sources)).select("source").distinct().collect()}
            if missing := sorted(set(sources) - there):
                raise UnknownSourceError(", ".join(missing))
        pool = pool.where(F.col("source").isin(sources))
    rows = dedup(pool) if deduplicate else pool.select("source", "line_no", "line")
    if require_script:
        rows = rows.where(has_script(F.col("line")))
    if check and n_lines is not None and (there := rows.count()) < n_lines:
        raise TooFewLinesError(f"asked for {n_lines} of {there} lines")
    rows = rows.withColumn("digest", seeded(F.col("line"), seed))
    ranked = global_rank(rows, "digest", [F.col("source"), F.col("line_no")])
    ranked = ranked if n_lines is None else ranked.where(F.col("rank") < n_lines)
    return ranked.select("rank", "source", "line_no", "line")


def provenance(selected: DataFrame, pool: DataFrame) -> DataFrame:
    """Lines and share by the first source that holds each selected line; `?` where none does."""
    first = dedup(pool).select("line", F.col("source").alias("origin"))
    counts = selected.select("line").join(first, "line", "left").groupBy(F.coalesce("origin", F.lit("?")).alias("source")).agg(F.count("*").alias("n"))
    total = selected.agg(F.count("*").alias("total"))
    return counts.join(F.broadcast(total)).select("source", "n", (F.col("n") / F.col("total")).alias("share"))


def summary(pool: DataFrame) -> DataFrame:
    """Lines and distinct lines of each source and of all (source null)."""
    per = pool.groupBy("source", "line").agg(F.count("*").alias("n"))
    each = per.groupBy("source").agg(F.sum("n").alias("lines"), F.count("*").alias("distinct_lines"))
    every = per.groupBy("line").agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("lines"), F.count("*").alias("distinct_lines"))
    return each.unionByName(every.select(F.lit(None).cast("string").alias("source"), "lines", "distinct_lines"))


def statistics(lines: DataFrame) -> DataFrame:
    """Lines, words, unique words, code points and unique graphemes of a table with a column `line`."""
    c = F.col("line")
    base = lines.agg(F.count("*").alias("lines"), F.coalesce(F.sum(F.size(words(c))), F.lit(0)).alias("words"), F.coalesce(F.sum(F.length(c)), F.lit(0)).alias("codepoints"))
    unique = lambda tokens, name: lines.select(F.explode(tokens).alias("t")).groupBy("t").agg(F.lit(1)).agg(F.count("*").alias(name))
    return base.join(F.broadcast(unique(words(c), "unique_words"))).join(F.broadcast(unique(graphemes(c), "unique_graphemes")))


def frequency(df: DataFrame, tokens: Column, out: str = "unit", by: list[str] | None = None) -> DataFrame:
    """(unit, n): how often each token occurs (by the columns `by`)."""
    by = by or []
    return df.select(*by, F.explode(tokens).alias(out)).groupBy(*by, out).agg(F.count("*").alias("n"))


def duplicates(pool: DataFrame) -> DataFrame:
    """Lines, distinct lines, duplicates and their rate."""
    per = pool.groupBy("line").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("lines"), F.count("*").alias("distinct_lines"))
    extra = F.col("lines") - F.col("distinct_lines")
    return per.select("lines", "distinct_lines", extra.alias("duplicates"), F.when(F.col("lines") == 0, 0.0).otherwise(extra / F.col("lines")).alias("rate"))
