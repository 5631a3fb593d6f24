"""The corpus pipeline: quality, near duplicates, decontamination, mixing, token files.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return rows of
``documents`` with all their columns. ``run`` writes each stage's result to shared scratch and reads it
back as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wattspark.llm import common, crf, decontaminate, groupjoin, mixing, token_files
from wattspark.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line CRF keep."""
    common.ship(spark)
    return crf.keep_good(docs, crf.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of 0.8-similar documents."""
    common.ship(spark)
    return groupjoin.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window that matches a benchmark item."""
    common.ship(spark)
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by weights raked to source, language and topic."""
    return mixing.sample(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the documents, read back: ``doc_id, start, n_tokens, ids_crc32``."""
    common.ship(spark)
    path = token_files.write_token_files(docs, common.scratch(spark, "token-files"), vocabulary(), end_id=2)
    return token_files.read_token_files(spark, path, digest=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminated), ("mixing", mixed), ("token_ids", token_ids)]

#: the CRF, the tokenizer and the join can't be expressed in SQL; tests compare with a brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
