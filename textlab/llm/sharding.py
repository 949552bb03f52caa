"""Sharding by vector bin packing.

Rows are gathered into cells by a hash of their text, so that equal texts share a cell and so a shard; only a group of equal
texts with more than 1/`HOT_PARTS` of a shard's bytes is cut, into parts of about that size, by a hash of its rows' ids. The
cells' vectors (bytes, tokens, rows) are placed one after another, largest first, each in the shard where the dot product of
the vector with the shard's residual capacity is highest. A group with more rows or bytes than `HOT_CELLS` ordinary cells is
a cell of its own and is ranked in sub-cells of an ordinary cell's size, wherever it is placed.
Law `bytes`: the shards' sizes are near equal (they differ by less than one cell's share, about 1 in `CELLS`/shards).

The table is read twice at most by two narrow passes: one row of numbers a document is written to the shared folder, the
rest works on those. Only the cells and sub-cells (under 4 * MOST_CELLS rows) reach the driver and are broadcast
back. Slots are the rank within the sub-cell plus the number of rows in the shard's earlier ones, so no task needs more than
a sub-cell at a time.

Defined results: a null text has no bytes (size 1) and the checksum of no bytes (0); repeated rows get slots of their own;
empty tables give no rows; other columns are not read; ties are broken by doc_id, then by the row's hash.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stash, table

SHARDS, CELLS, MOST_CELLS, ROWS_A_CELL, HOT_PARTS, HOT_CELLS = 8, 2_048, 65_536, 5_000, 4, 4


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, tokens, text_crc32 and text_hash of each row."""
    t = F.coalesce(docs[text], F.lit(""))
    return docs.select(docs[key].alias("key"), (F.octet_length(t).cast("long") + 1).alias("size"), F.regexp_count(t, F.lit("[^ \\t-\\r]+")).cast("long").alias("tokens"), F.crc32(t.cast("binary")).alias("text_crc32"), F.xxhash64(t).alias("text_hash"))


def pack(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each vector: largest first, where the dot product with the residual capacity is highest."""
    if not len(vectors):
        return np.empty(0, int)
    share = vectors / np.maximum(vectors.sum(0), 1e-12)
    share = share * np.array([4.0, 1.0, 1.0])[: share.shape[1]]  # the law is about bytes, the first component
    left = np.tile(share.sum(0) / shards, (shards, 1))
    out = np.empty(len(vectors), int)
    for i in np.lexsort((np.arange(len(share)), -share.sum(1))):
        out[i] = b = int((left @ share[i]).argmax())
        left[b] -= share[i]
    return out


def assign(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text", cells: int | None = None) -> DataFrame:
    """key, size, tokens, text_crc32, shard and slot of each row."""
    rows = stash(measures(docs, key, text))
    n, total = rows.agg(F.count("*"), F.sum("size")).first()
    total = max(1, total or 0)
    cells = cells or min(MOST_CELLS, max(CELLS, math.ceil(n / ROWS_A_CELL)))
    groups = rows.groupBy("text_hash").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    weight = F.greatest(F.col("bytes") / total, F.col("n") / max(1, n))
    hot = groups.where((F.col("n") > 1) & (weight > HOT_CELLS / cells))
    hot = hot.select("text_hash", F.ceil(F.col("bytes") / (total / (shards * HOT_PARTS))).alias("parts"), F.ceil(weight * cells).alias("subs"))
    sub = F.coalesce(F.pmod(F.xxhash64(F.lit(17), "key"), F.col("subs")), F.lit(0))
    part = F.floor(F.col("sub") * F.col("parts") / F.col("subs"))
    own = F.lit(cells) + F.pmod(F.xxhash64("text_hash", part), F.lit(1 << 60))
    cell = F.when(F.col("subs").isNull(), F.pmod(F.col("text_hash"), F.lit(cells))).otherwise(own)
    placed = rows.join(F.broadcast(hot), "text_hash", "left").withColumn("sub", sub).withColumn("cell", cell).drop("parts", "subs")
    found = placed.groupBy("cell", "sub").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()
    found.sort(key=lambda r: (r.cell, r.sub))
    vectors: dict[int, list[int]] = {}
    for r in found:
        v = vectors.setdefault(r.cell, [0, 0, 0])
        v[:] = v[0] + r.b, v[1] + r.t, v[2] + r.n
    shard = dict(zip(vectors, pack(np.array(list(vectors.values()), float).reshape(-1, 3), shards).tolist(), strict=True))
    begin, plan = [0] * shards, []
    for r in found:
        s = shard[r.cell]
        plan.append((r.cell, r.sub, s, begin[s]))
        begin[s] += r.n
    where = docs.sparkSession.createDataFrame(plan, "cell long, sub long, shard int, begin long")
    rank = F.row_number().over(Window.partitionBy("cell", "sub").orderBy("key", "text_crc32", "size"))
    return placed.join(F.broadcast(where), ["cell", "sub"]).select(F.col("key").alias(key), "size", "tokens", "text_crc32", "shard", (F.col("begin") + rank - 1).alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
