"""Quality rules judged by an isolation forest.

Exact rule counts of a text (words, symbols, repeated lines, words in repeated 3-word windows) and rates derived from them
form a small feature vector. An isolation forest grown on a bounded hash sample of the documents gives each document the
mean path length over random splits; short paths mean anomalous. Only rates that tell the labelled classes apart are split
on (at least `TELLING` of quality 0 lies outside nearly all of quality 1); without labels all are. These rates are chosen on a bounded
sample of labelled rows; the cut is calibrated on the scores of all of them: it removes as much of quality 0 as it can while it keeps at least `KEEP_GOOD` of quality 1.

Defined results: null and empty texts have no words and fail the base rule; repeated rows are judged alike; without labels
of both classes only the base rule removes; without documents the result is empty; other columns are ignored by the
operator and kept by `filter_documents`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, bounded_sample, labelled_sample, stash, table
from .importance import judged, kth_largest
from .kernels import WordHashes, grams

SYMBOLS = "#*$%&|<>"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE = " \t\n\r\x0b\x0c"
SAMPLE, LABELLED, TREES, PSI, KEEP_GOOD, TELLING = 4_096, 3_000, 100, 64, 0.995, 0.05
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
N_FEATURES = 8


def rule_counts(text: str | None, hashes: WordHashes) -> tuple[list[int], list[float]]:
    """The five counts and the features of one text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, chars = len(words), len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACE)] if n else []
    dup = len(lines) - len(set(lines))
    repeat = 0
    a = hashes.array(words)
    if n > 3:
        _, which, times = np.unique(grams(a, 3), return_inverse=True, return_counts=True)
        again = times[which] > 1
        if again.any():
            hit = np.zeros(n, bool)
            for i in range(3):
                hit[i : i + n - 2] |= again
            repeat = int(hit.sum())
    upper = (len(raw) - len(raw.translate(None, CAPITALS))) / max(1, chars)
    features = [np.log1p(n), chars / max(1, n), symbols / max(1, chars), dup / max(1, len(lines)), repeat / max(1, n), len(np.unique(a)) / max(1, n) ** 0.8, upper, (text.count("!") + text.count("|")) / max(1, n)]
    return [n, chars, symbols, dup, repeat], features


def rule_statistics(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The key, the five counts and `features` of each document."""

    def make():
        hashes = WordHashes()

        def fn(batch):
            keys, texts = batch.column("key").to_pylist(), batch.column("text").to_pylist()
            for at in range(0, len(keys), 1000):
                rows = [rule_counts(t, hashes) for t in texts[at : at + 1000]]
                yield {key: keys[at : at + 1000], "features": [r[1] for r in rows]} | {c: [r[0][i] for r in rows] for i, c in enumerate(COUNTS)}

        return fn

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs.select(docs[key].alias("key"), docs[text].alias("text")), make, f"`{key}` {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", features array<double>")


class IsolationForest:
    """Random axis splits down to depth log2(psi); a score in (0, 1), higher for shorter mean paths."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, psi: int = PSI, seed: int = 7, columns: list[int] | None = None):
        rng = np.random.default_rng(seed)
        self.columns = list(range(rows.shape[1])) if columns is None else columns
        rows = rows[:, self.columns]
        self.psi = min(psi, len(rows))
        self.depth = max(1, int(np.ceil(np.log2(max(2, self.psi)))))
        size = 2 ** (self.depth + 1)
        self.feature, self.cut, self.length = (np.zeros((trees, size), t) for t in (np.int16, np.float64, np.float64))
        self.feature[:] = -1
        for t in range(trees):
            self._grow(t, 1, 0, rows[rng.choice(len(rows), self.psi, replace=False)], rng)

    @staticmethod
    def mean_path(n: int) -> float:
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, t: int, node: int, depth: int, rows: np.ndarray, rng) -> None:
        low, high = (rows.min(0), rows.max(0)) if len(rows) else (np.zeros(1), np.zeros(1))
        open_ = np.flatnonzero(high > low)
        if depth >= self.depth or len(rows) < 2 or not len(open_):
            self.length[t, node] = depth + self.mean_path(len(rows))
            return
        f = rng.choice(open_)
        cut = rng.uniform(low[f], high[f])
        self.feature[t, node], self.cut[t, node] = f, cut
        left = rows[:, f] < cut
        self._grow(t, 2 * node, depth + 1, rows[left], rng)
        self._grow(t, 2 * node + 1, depth + 1, rows[~left], rng)

    def score(self, rows: np.ndarray) -> np.ndarray:
        rows = rows[:, self.columns]
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for feature, cut, length in zip(self.feature, self.cut, self.length, strict=True):
            node = np.ones(len(rows), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                inner = f >= 0
                node = np.where(inner, 2 * node + (rows[every, np.maximum(f, 0)] >= cut[node]), node)
            total += length[node]
        return 2 ** (-total / len(self.feature) / max(1e-9, self.mean_path(self.psi)))


def _collect(stats: DataFrame) -> np.ndarray:
    rows = stats.select("features").collect()
    return np.array([r.features for r in rows], float).reshape(len(rows), N_FEATURES)


def fit(docs: DataFrame, labels: DataFrame | None) -> tuple[IsolationForest | None, bool]:
    """The forest, and whether there are labels of both classes to calibrate it."""
    rows = _collect(rule_statistics(bounded_sample(docs.where(F.col("text").isNotNull()), SAMPLE, "doc_id")))
    if not len(rows):
        return None, False
    rows = rows[np.lexsort(rows.T)]
    if labels is None:
        return IsolationForest(rows), False
    found = labelled_sample(docs, labels, "quality", LABELLED).select(F.struct("doc_id", "y").alias("key"), "text")
    got = rule_statistics(found, key="key").select(F.col("key.y").alias("y"), "features").collect()
    good, bad = (np.array([r.features for r in got if r.y == y], float).reshape(-1, N_FEATURES) for y in (1, 0))
    if not len(good) or not len(bad):
        return IsolationForest(rows), False
    low, high = np.quantile(good, [(1 - KEEP_GOOD) / 2, (1 + KEEP_GOOD) / 2], axis=0)
    telling = np.flatnonzero(((bad < low) | (bad > high)).mean(0) >= TELLING).tolist()
    return IsolationForest(rows, columns=telling or None), True


def calibrate(scored: DataFrame, labels: DataFrame) -> float:
    """The score from which a document is rejected: just over the KEEP_GOOD quantile of all good rows of `scored` (doc_id,
    anomaly). Scores join the labels, no text does."""
    good = stash(scored.join(judged(labels).where("y = 1"), "doc_id").select("anomaly"))
    n = good.count()
    at = KEEP_GOOD * (n - 1)
    low, high = (kth_largest(good, "anomaly", n - k) for k in (int(at), min(int(at) + 1, n - 1)))
    return low + (high - low) * (at - int(at)) + 1e-9


def judge(docs: DataFrame, labels: DataFrame | None, key: str = "doc_id") -> DataFrame:
    """The key, the five counts, anomaly (the forest's score), base_failed and kept of each document."""
    forest, labelled = fit(docs, labels)
    model = docs.sparkSession.sparkContext.broadcast(forest)
    whole = docs.select(F.struct(F.col(key).alias("key"), "doc_id").alias("key"), "text")
    stats = rule_statistics(whole, key="key")

    def make():
        def fn(batch):
            rows = np.array(batch.column("features").to_pylist(), float).reshape(-1, N_FEATURES)
            score = model.value.score(rows) if model.value else np.zeros(len(rows))
            yield {c: batch.column(c).to_pylist() for c in ("key", *COUNTS)} | {"anomaly": score.tolist()}

        return fn

    kind = whole.schema["key"].dataType.simpleString()
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = arrow_map(stats, make, f"key {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", anomaly double")
    scored = stash(scored) if labelled else scored
    cut = calibrate(scored.select("key.doc_id", "anomaly"), labels) if labelled else 2.0
    out = scored.select(F.col("key.key").alias(key), *COUNTS, "anomaly")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("anomaly") < cut))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
