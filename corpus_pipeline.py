"""From raw documents to token ids: five stages over all documents, each written and reread.

Toxic documents go, one document of each group of near duplicates stays, personal data is
masked, sources are mixed to their weights, and texts are encoded to ids, which are kept with
their source and the digest of what they decode to.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe, mixing, pii, simhash, toxicity
from millrace.llm.common import load, vocabulary
from millrace.session import checkpoint_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, load(spark, sf_dir, "labels"), load(spark, sf_dir, "documents"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.tokenized(docs, vocabulary("byte_bpe_multi_50k.tiktoken"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_copies), ("personal_data", mask_personal_data),
          ("mixing", mix_sources), ("tokens", tokenize)]

#: A trained network and a merge loop have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result is written as Parquet and read again."""
    folder, docs = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}", load(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
