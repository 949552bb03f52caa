"""From raw documents to token ids: quality classifier, near-duplicate removal, benchmark decontamination, redaction of
personal data, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes every stage's result as
Parquet in the shared folder and rereads it, so a lost executor costs one stage's work at most. All stages but the last
return the columns of documents. Null and empty texts have no words: the classifier rejects them. Extra columns of documents
travel along up to the last stage. An empty table stays empty throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textlab.llm import importance, neardup, pii, sentencepiece_codec, winnowing
from textlab.llm.common import release, stash, stashed, table

SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects."""
    return importance.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    return neardup.keep_one(docs, SHINGLE_WORDS, SIMILARITY_PERCENT)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages they share with the benchmark; documents that are mostly such passages go."""
    return winnowing.cut_hits(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the number of ids, the ids, and the digest of the decoded text."""
    return sentencepiece_codec.encode_decode(docs, outputs=("n_tokens", "ids", "decoded_sha256"), keep=["doc_id", "lang", "source"])


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("redact", redact), ("encode", encode)]
#: Classifiers and tokenizers are not SQL; tests/llm/test_pipeline.py compares the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before = stashed()
        docs = stash(stage(spark, docs, sf_dir))
        release(spark, before)  # the stage's own tables; its result stays
    return STAGES[-1][1](spark, docs, sf_dir)
