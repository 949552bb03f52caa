"""Whole jobs composed of operators: evaluation of pairs and construction of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import NormProfile
from ..operators import corpus, coverage, evaluate


def evaluation(pairs: DataFrame, profile: NormProfile = NormProfile(), n_boot: int | None = None, key: str = "name") -> DataFrame:
    """One row of rates (with intervals, if n_boot is given); raises where there is no pair."""
    if pairs.isEmpty():
        raise evaluate.NoPairsError("no pairs to score")
    scored = evaluate.score(pairs, profile)
    out = evaluate.aggregate(scored).withColumn("profile", F.lit(profile.name))
    if n_boot:
        ends = evaluate.bootstrap(scored, key, n_boot=n_boot)
        wide = ends.agg(*[F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{m}_{c}") for m in ("grapheme", "word") for c in ("lo", "hi")])
        out = out.join(F.broadcast(wide))
    return out


def build_corpus(docs: DataFrame, coverage_points: DataFrame, n_lines: int | None = None, seed: int = 0, filter_first: bool = False) -> DataFrame:
    """Pool, selection and coverage filter. `filter_first` drops unrenderable lines before truncation (as sweeps do), else
    after it (as regeneration does)."""
    pool = corpus.chunk(docs)
    picked = corpus.select(pool, n_lines=None if filter_first else n_lines, seed=seed)
    kept = coverage.split_renderable(picked, coverage_points).where("renderable").drop("renderable")
    if filter_first:
        kept = kept if n_lines is None else kept.orderBy("rank").limit(n_lines)
    return kept
