"""A pipeline over documents: quality, line dedup, near-duplicates, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from biblens.llm import bpe, line_dedup, minhash, mixing, quality
from biblens.llm.queries import table, vocabulary_path
from biblens.runtime import ship, write_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    ship(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of runs of lines."""
    ship(spark)
    return line_dedup.dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    ship(spark)
    return minhash.without_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, a row for each copy of a document that it takes, with the words that it takes."""
    ship(spark)
    return mixing.mixed_documents(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each row."""
    ship(spark)
    return bpe.encode_documents(docs, vocabulary_path())


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("near-duplicates", near_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: SQL can not express the classifier and the stages after it work on what that kept.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs, _ = write_table(docs, name.replace(" ", "-"))
    return docs
