"""Quality classification by importance resampling.

Two generative models over hashed word uni- and bigrams (`BUCKETS` buckets): the target is learned from documents labelled
as good (a hash sample of about `TARGET_DOCS` of them), the raw model from all documents; both are plain bucket counts. A
document's log weight is the log ratio of the two models summed over its n-grams. Resampling without replacement in
proportion to the weights is Gumbel top-k: standard Gumbel noise, seeded by the document's id and text, is added to the log
weights, and the k largest sums are selected. The chance that a document is in depends on its weight: one whose log weight is
d below the last selected value comes in with probability 1 - exp(-exp(-d)).

k is the number of documents whose log weight reaches a cut calibrated on all labelled rows: midway between the quantile that
`KEEP_GOOD` of quality 1 reach and the largest weight of quality 0 below it. The k-th largest value is found by counting a
histogram, refined within one bin, so the selection is exact and nothing is gathered but the bins; ties at the cut are all
kept.

Defined results: null and empty texts have no n-grams and are rejected; repeated rows (equal id and text) are kept or rejected
alike, and so are rows without an id and with equal texts; without labels of both classes every document with a word is kept;
extra columns, whatever their names, are kept by `keep_good`.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, bounded_sample, stash, table, text_map

TOKEN = re.compile(r"\w+|[^\w\s]+")
BUCKETS, TARGET_DOCS, KEEP_GOOD, BINS = 1 << 14, 20_000, 0.997, 4_096
SALT = np.uint64(0x9E3779B97F4A7C15)


def shape(token: str) -> str:
    """Length class and letter case of a word, so that unseen words count too."""
    if token.isalpha():
        kind = "A" if token.isupper() and len(token) > 1 else "a"
        return kind + str(min(4, len(token) // 4))
    return "0" if token.isdigit() else token[:3] if not token[0].isalnum() else "x"


class Tokens(dict):
    """Numbers of the tokens seen; `hash` and `shape` hold the hashes of the token and of its shape by number."""

    MOST = 200_000

    def __init__(self):
        super().__init__()
        self.hash, self.shape = np.zeros(self.MOST, np.uint64), np.zeros(self.MOST, np.uint64)

    def __missing__(self, token: str) -> int:
        n = len(self)
        if n == len(self.hash):
            self.hash, self.shape = (np.concatenate([x, np.zeros(n, np.uint64)]) for x in (self.hash, self.shape))
        self.hash[n] = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"))
        self.shape[n] = xxhash.xxh64_intdigest(b"\0" + shape(token).encode("utf-8", "surrogatepass"))
        self[token] = n
        return n


class Grams:
    """Bucket numbers of a text's n-grams: words, word pairs, pairs of shapes, and whether a word repeats its predecessor.
    Tokens are forgotten between texts when there are more than Tokens.MOST."""

    def __init__(self):
        self.tokens = Tokens()

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = TOKEN.findall(text) if text else []
        if not tokens:
            return np.empty(0, np.int64)
        if len(self.tokens) > Tokens.MOST:
            self.tokens = Tokens()
        at = np.fromiter(map(self.tokens.__getitem__, tokens), np.int64, len(tokens))
        a, s = self.tokens.hash[at], self.tokens.shape[at]
        same = (at[1:] == at[:-1]).astype(np.uint64)
        pairs = (a[:-1] * SALT) ^ (a[1:] >> np.uint64(3))
        both = ((s[:-1] * SALT) ^ (s[1:] >> np.uint64(5))) + same * np.uint64(0x1234567)
        every = np.concatenate([a, pairs, both, both + np.uint64(77)])
        every = (every ^ (every >> np.uint64(29))) * SALT
        return (every >> np.uint64(64 - 14)).astype(np.int64)


def bucket_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the n-grams of all rows, and of the rows with `target`; each task sends two rows a bucket at most."""

    def make():
        grams = Grams()

        def fn(batch):
            total, mine = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
            for t, target in zip(batch.column("text").to_pylist(), batch.column("target").to_pylist(), strict=True):
                found = np.bincount(grams(t), minlength=BUCKETS)
                total += found
                if target:
                    mine += found
            at = np.flatnonzero(total)
            yield {"bucket": at, "n": total[at], "n_target": mine[at]}

        return fn

    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    found = arrow_map(docs.select("text", "target"), make, "bucket int, n long, n_target long")
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target")).collect():
        raw[r.bucket], target[r.bucket] = r.n, r.n_target
    return raw, target


def weights(docs: DataFrame, ratio: np.ndarray, keep: list[str]) -> DataFrame:
    """The columns `keep`, __n_grams and __log_weight of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def make():
        grams, ratio = Grams(), shared.value

        def fn(texts):
            found = [grams(t) for t in texts]
            return {"__n_grams": [len(g) for g in found], "__log_weight": [float(ratio[g].sum()) for g in found]}

        return fn

    return text_map(docs, keep, make, "__n_grams long, __log_weight double")


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """The k-th largest value: a histogram is counted and its one bin counted again until the bin is one value wide."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None or k <= 0:
        return float("inf")
    above = 0
    for _ in range(12):
        width = (high - low) / BINS
        if width <= 0 or low + width == low:
            break
        number = F.least(F.floor((F.col(column) - low) / width), F.lit(BINS - 1))
        counts = {r.b: (r.n, r.lo, r.hi) for r in df.where(F.col(column).between(low, high)).groupBy(number.alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()}
        for b in sorted(counts, reverse=True):
            n, lo, hi = counts[b]
            if above + n >= k:
                break
            above += n
        low, high = lo, hi
        if low == high:
            break
    return low


def gumbel(seed: int, *columns: Column) -> Column:
    """A standard Gumbel variate that depends on the columns' values alone."""
    u = (F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit((1 << 40) - 1)) + 1) / float(1 << 40)
    return -F.log(-F.log(u))


def top_k(scored: DataFrame, k: int, weight: str, seed: int, *identity: Column) -> Column:
    """Whether a row of `scored` is among the k drawn by Gumbel top-k on its log weight; rows without a weight are not."""
    drawn = F.col(weight) + gumbel(seed, *identity)
    return F.coalesce(drawn >= F.lit(kth_largest(scored.select(drawn.alias("drawn")).where("drawn is not null"), "drawn", k)), F.lit(False))


def judged(labels: DataFrame) -> DataFrame:
    """(doc_id, y): the quality of each labelled document."""
    return labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray | None:
    """The log ratio of target and raw by bucket, from one pass over the texts; none without words in labelled good
    documents. The ids of the target's documents are a bounded broadcast."""
    good = bounded_sample(judged(labels).where("y = 1"), TARGET_DOCS, "doc_id").select("doc_id", F.lit(True).alias("target"))
    raw, target = bucket_counts(docs.select("doc_id", "text").join(F.broadcast(good), "doc_id", "left"))
    if not raw.sum() or not target.sum():
        return None
    prior = (raw + 1) / (raw.sum() + BUCKETS)
    return np.log((target + 20 * prior) / (target.sum() + 20)) - np.log(prior)


def calibrate(scored: DataFrame, labels: DataFrame) -> float:
    """The cut on log_weight from all labelled rows of `scored` (doc_id, log_weight): midway between the quantile of the good
    ones and the largest bad weight below it. Weights join the labels, no text does."""
    rows = stash(scored.join(judged(labels), "doc_id").select("y", "log_weight"))
    good = rows.where("y = 1")
    n = good.count()
    if not n or rows.where("y = 0").isEmpty():
        return float("-inf")
    at = (1 - KEEP_GOOD) * (n - 1)
    low, high = (kth_largest(good, "log_weight", n - k) for k in (int(at), min(int(at) + 1, n - 1)))
    most = low + (high - low) * (at - int(at))
    bad = rows.where((F.col("y") == 0) & (F.col("log_weight") < most)).agg(F.max("log_weight")).first()[0]
    return most if bad is None else (most + bad) / 2


def select(docs: DataFrame, labels: DataFrame, keep: list[str], seed: int = 11) -> DataFrame:
    """The columns `keep` (doc_id among them), __n_grams, __log_weight and __kept of each document."""
    ratio = fit(docs, labels)
    own = docs.withColumn("__text_hash", F.xxhash64("text"))
    scored = weights(own, np.zeros(BUCKETS) if ratio is None else ratio, [*keep, "__text_hash"])
    any_word = F.col("__n_grams") > 0
    if ratio is None:
        return scored.withColumn("__kept", any_word).drop("__text_hash")
    scored = stash(scored.withColumn("__log_weight", F.when(any_word, F.col("__log_weight"))))
    cut = calibrate(scored.where(any_word).select("doc_id", F.col("__log_weight").alias("log_weight")), labels)
    if cut == float("-inf"):
        return scored.withColumn("__kept", any_word).drop("__text_hash")
    k = scored.where(F.col("__log_weight") >= cut).count()
    kept = top_k(scored, k, "__log_weight", seed, F.col("doc_id"), F.col("__text_hash"))
    return scored.withColumn("__kept", kept).drop("__text_hash")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that are selected, with all their columns."""
    return select(docs, labels, docs.columns).where("__kept").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    return found.select("doc_id", F.col("__n_grams").alias("n_grams"), F.coalesce("__log_weight", F.lit(0.0)).alias("log_weight"), F.col("__kept").alias("kept"))
