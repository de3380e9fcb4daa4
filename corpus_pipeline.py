"""Pipeline over `documents`: toxic texts, copies, near copies and benchmark leaks go; the rest is tokenised."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pollwarden.llm import op01_decontaminate, op02_exact_dedup, op04_toxicity, op06_byte_bpe, op07_simhash
from pollwarden.llm.common import documents, table
from pollwarden.session import ensure_checkpoint_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold; the model is fitted on the labelled ones among docs."""
    return op04_toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return op02_exact_dedup.first_of_each(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by fingerprints of three-word shingles that differ in at most two bits the row with the smallest doc_id."""
    return op07_simhash.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return op01_decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and hashes of what is left."""
    return op06_byte_bpe.with_tokens(docs, ["doc_id"], op06_byte_bpe.vocabulary_path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies),
          ("decontamination", drop_leaks), ("byte_bpe", tokenise)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared checkpoint folder and read again."""
    docs = documents(spark, sf_dir)
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
