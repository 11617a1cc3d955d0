"""A corpus pipeline: quality rules, line dedup, near-duplicates, decontamination and mixing, one after the other.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; between
stages the documents are written as Parquet to the shared folder and read again, so that a lost executor never costs
more than its stage. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from plumbline.functions.frames import ensure_checkpoint_dir
from plumbline.functions.session import ship_package
from plumbline.llm import decontaminate, line_dedup, mixing, quality, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the guards and look like a language of the corpus."""
    ship_package(spark)
    return quality.keep_good(docs)


def fuzzy_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that resemble an earlier one; a document that has no line left is kept, empty."""
    ship_package(spark)
    return line_dedup.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates by SimHash: that with the smallest id."""
    ship_package(spark)
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark's words."""
    ship_package(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks for, copies numbered."""
    ship_package(spark)
    return mixing.mix(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", fuzzy_lines),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source mixing", source_mixing),
]
#: Fuzzy lines and SimHash groups need functions that DuckDB lacks; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents table."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
