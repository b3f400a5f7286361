"""A corpus pipeline: each stage keeps or rewrites documents, and the next works on what it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnloom.llm import decontaminate, jaccard, langid, secrets, sentencepieces
from turnloom.llm.common import materialize, shared_dir, table
from turnloom.llm.queries import tokenizer


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models of these documents recognize."""
    return langid.keep_known(docs, langid.fit(langid.training(docs)))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard.representatives(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return secrets.redact(docs)


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's SentencePiece ids."""
    return sentencepieces.encode(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("language_id", known_language),
    ("jaccard_join", without_near_copies),
    ("decontamination", without_benchmark),
    ("secret_scan", without_secrets),
    ("sentencepiece", as_pieces),
]

#: No SQL: language models and the tokenizer are not expressible. Tested against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), shared_dir(spark)
    for i, (name, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"{i}_{name}", folder)
    return docs
