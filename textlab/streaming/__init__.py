"""Streams: following the append-only journal of an experiment sweep as it grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

JOURNAL = "experiment string, variant string, status string, error string, n_lines bigint, n_faces int, cer_grapheme_micro double, wer_micro double, timestamp string"


def follow_journal(spark: SparkSession, path: str) -> DataFrame:
    """A streaming table of journal rows: files that appear are read once, rows of both shapes under one schema."""
    return spark.readStream.schema(JOURNAL).json(path)
