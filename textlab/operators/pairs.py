"""Reference and hypothesis pairs, integrity of paired tables, resume and status tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_script, lines, nfc, strip

PREVIEW = 10


def by_stem(gt: DataFrame, hyp: DataFrame, key: str = "stem") -> DataFrame:
    """(stem, ref, hyp) of the stems both sides have."""
    return gt.select(key, F.col("text").alias("ref")).join(hyp.select(key, F.col("text").alias("hyp")), key)


def missing(gt: DataFrame, hyp: DataFrame, key: str = "stem") -> DataFrame:
    """How many references have no hypothesis, and the first of them."""
    return gt.select(key).join(hyp.select(key), key, "left_anti").agg(F.count("*").alias("n_missing"), F.min(key).alias("first_missing"))


def by_line(gt: DataFrame, hyp: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line_no from 1, ref, hyp): texts aligned line by line, the shorter side padded with empty lines."""
    cut = lambda df, name: df.select(*keys, F.posexplode(lines("text")).alias("line_no", name)).withColumn("line_no", (F.col("line_no") + 1).cast("long"))
    both = cut(gt, "ref").join(cut(hyp, "hyp"), [*keys, "line_no"], "full_outer")
    return both.select(*keys, "line_no", F.coalesce("ref", F.lit("")).alias("ref"), F.coalesce("hyp", F.lit("")).alias("hyp"))


def presence(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, in_left, in_right), a row a distinct key of either side: one shuffle with map-side combining."""
    tag = lambda df, a, b: df.select(key, F.lit(a).alias("l"), F.lit(b).alias("r"))
    both = tag(left, True, False).unionByName(tag(right, False, True))
    return both.groupBy(key).agg(F.bool_or("l").alias("in_left"), F.bool_or("r").alias("in_right"))


def first_keys(df: DataFrame, key: str, n: int = PREVIEW) -> DataFrame:
    """One row: the first n keys in order, as text joined by commas."""
    few = df.select(key).orderBy(key).limit(n)
    return few.agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x.cast("string")), ",").alias("keys"))


def integrity(images: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """Counts of images, transcriptions, pairs and orphans of either side, with the first orphans."""
    seen = presence(images, texts, key)
    n = lambda cond, name: F.count_if(cond).alias(name)
    counts = seen.agg(n(F.col("in_left"), "images"), n(F.col("in_right"), "transcriptions"), n(F.col("in_left") & F.col("in_right"), "pairs"), n(~F.col("in_right"), "orphan_images"), n(~F.col("in_left"), "orphan_transcriptions"))
    a = first_keys(seen.where(~F.col("in_right")), key).withColumnRenamed("keys", "first_images")
    b = first_keys(seen.where(~F.col("in_left")), key).withColumnRenamed("keys", "first_transcriptions")
    return counts.join(F.broadcast(a)).join(F.broadcast(b))


def completeness(images: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """Counters of a test set: pairs that are complete, empty, not in normal form C, without the script. The last two count
    complete pairs, so the buckets overlap."""
    t = strip(F.col("text"))
    both = texts.select(key, t.alias("t")).join(images.select(key).distinct(), key, "left_semi")
    full = F.col("t") != ""
    checked = both.withColumn("nfc", nfc("t"))
    counts = checked.agg(F.count_if(full).alias("complete"), F.count_if(~full).alias("still_empty"), F.count_if(full & (F.col("nfc") != F.col("t"))).alias("not_nfc"), F.count_if(full & ~has_script(F.col("t"))).alias("no_script"))
    sizes = images.agg(F.countDistinct(key).alias("images")).join(F.broadcast(texts.agg(F.countDistinct(key).alias("transcriptions"))))
    return sizes.join(F.broadcast(counts))


def todo(items: DataFrame, done: DataFrame, key: str, size: Column | None = None) -> DataFrame:
    """Items without a finished output; an output of size 0 does not count."""
    finished = done if size is None else done.where(size > 0)
    return items.join(finished.select(key), key, "left_anti")


def resume_counts(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Images, recognised ones and those skipped as already done."""
    flagged = items.select(key).join(done.select(key).distinct().withColumn("done", F.lit(True)), key, "left")
    return flagged.agg(F.count("*").alias("images"), F.count_if(F.col("done").isNull()).alias("recognised"), F.count_if(F.col("done")).alias("skipped"))


def status_tally(statuses: DataFrame) -> DataFrame:
    """Rows by kind of status (what stands before a colon), and whether the kind is a problem."""
    kind = F.substring_index("status", ":", 1)
    return statuses.groupBy(kind.alias("status")).agg(F.count("*").alias("n")).withColumn("problem", ~F.col("status").isin("ok", "skip"))


def first_problems(statuses: DataFrame, order: str, n: int = 10) -> DataFrame:
    """The first `n` rows, by `order`, whose status is a problem: a bounded top-n."""
    kind = F.substring_index("status", ":", 1)
    return statuses.where(~kind.isin("ok", "skip")).orderBy(order).limit(n)
