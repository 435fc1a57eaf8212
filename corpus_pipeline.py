"""A training corpus from documents: reject, deduplicate, redact, mix and tokenize.

Each stage takes (spark, docs, sf_dir) and returns a table; ``run`` writes each as Parquet in the shared folder and
reads it back for the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from levelstone.llm import bpe, minhash, mixing, quality, secrets
from levelstone.llm.common import Scratch, table
from levelstone.llm.queries import vocabulary_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. Null and empty texts get the model's bias; equal texts go or
    stay together; a null doc_id is kept as it is; without labels nothing is rejected."""
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one of the least doc_id. Texts without words are linked with
    nothing; equal rows of one doc_id stay once; rows with a null doc_id all stay."""
    return minhash.deduplicated(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets redacted. Null texts stay null; repeated rows stay."""
    return secrets.redacted(docs, dictionary=vocabulary_path())


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of training. Null and empty texts, of which nothing can be
    taken, and documents beyond their source's target leave; a null source is a source."""
    return mixing.mixed_documents(docs, schedule=mixing.CURRICULUM)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens, and digests of ids and of decoded text, for each document of the mix; repeats have rows of their
    own, a null text is empty."""
    return bpe.encode_documents(docs, vocabulary_path())


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("secrets", secrets_stage), ("mixing", mixing_stage), ("bpe", bpe_stage)]

#: SQL can't express the classifier, the forest or the encoding; tests/llm checks the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
