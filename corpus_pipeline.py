"""A corpus pipeline of five stages, each of one operator of recallgrid.llm.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a
DataFrame, which run() writes as Parquet to the shared folder and reads again for the next one. All
stages but the last return the columns of docs, whatever their names.

Every stage works on rows: a null or repeated doc_id drops nothing that another row would keep. Null and empty
texts fail the quality rules; the stages after it, called by themselves, keep them (the mix takes
nothing of them). Texts of any length are read whole, and an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallgrid.llm import decontaminate, mixing, ngram_join, quality, secrets
from recallgrid.llm.common import documents, free, kept, scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go. Null or empty texts fail them; every row is judged by itself, whatever its doc_id."""
    return quality.accepted(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: the one with the smallest doc_id, null last. Rows that share a doc_id are rows of their own."""
    return ngram_join.first_of_groups(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts."""
    return secrets.masked(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How much of each document the mix takes; documents that it doesn't take go."""
    return mixing.mix(docs).filter("taken > 0")


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("decontamination", decontamination_stage), ("secrets", secrets_stage), ("mixing", mixing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what a stage needs meanwhile, and its input, are deleted once its result is written."""
    docs = documents(spark, sf_dir)
    for name, f in STAGES:
        with scratch():
            last, docs = docs, kept(f(spark, docs, sf_dir), name)
        free(last)
    return docs


#: The robust estimates, similarity components and regular expressions of Python have no SQL; see tests/llm.
ORACLE_SQL = None
