"""Order-dependent primitives that never gather a whole group in one task."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_IDS = 1_024


def running_offset(df: DataFrame, by: list[str], block: Column, order: list[Column], value: Column, out: str = "offset") -> DataFrame:
    """`df` with the sum of `value` over the earlier rows of its group, in two levels.

    `block` is a coarse, monotone function of the order. Blocks are summed with map-side combining, prefix sums run over
    the blocks (one row each), and a window inside each block adds the rest: a group that holds a third of all rows is
    spread over its blocks. Nulls in `by`, `block` and `order` are values like others, and come first."""
    tagged = df.withColumn("__block", block)
    sums = tagged.groupBy(*by, "__block").agg(F.sum(value).alias("__sum"))
    earlier = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    keys = [*by, "__block"]
    before = sums.select(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*by, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = F.coalesce(F.sum(value).over(inside), F.lit(0))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(keys)])
    joined = tagged.withColumn("__local", local).join(before, same)
    return joined.withColumn(out, F.col("__before") + F.col("__local")).drop("__block", "__before", "__local", *[f"__key{i}" for i in range(len(keys))])


def id_block(column: str, text: str | None = None) -> Column:
    """Blocks of neighbouring integer ids; rows without an id by the first characters of `text`, if they are ordered by it."""
    ids = F.floor(F.col(column) / BLOCK_IDS).alias("ids")
    return F.struct(ids) if text is None else F.struct(ids, F.when(F.col(column).isNull(), F.substring(text, 1, 3)).alias("text"))


def global_rank(df: DataFrame, digest: str, order: list[Column], out: str = "rank") -> DataFrame:
    """0-based rank in the order of a hex digest column, then `order`; blocks are the digests' first four digits."""
    return running_offset(df, [], F.substring(digest, 1, 4), [F.col(digest), *order], F.lit(1).cast("long"), out)


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """0-based numbers by `order` for tables of a few thousand rows at most (typefaces, variants, units)."""
    return df.withColumn(out, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
