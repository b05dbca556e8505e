"""A corpus pipeline: quality rules, near-duplicate removal, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns documents again, the last one with their slot and shard.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import decontam, mixing, quality, sharding, simhash
from corpusloom.llm.common import read
from corpusloom.sources.io import shared_folder


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go; documents that lose too much, are too short or repeat themselves go.

    Null and empty texts have no words and go; rows with a null id and repeated rows are judged like any other.
    """
    return quality.clean(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays: that of the least id, nulls last, and of rows with one id any.

    Rows are told apart by number, so one id with different texts loses none of them; null texts are one group.
    """
    return simhash.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with benchmark passages go, whatever their id; null texts and tables without items leave all as it is."""
    return decontam.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are thinned or repeated by their rate; without labelled documents every rate is 1.

    Rows of one id, and those without one, share a draw; repeated rows are drawn each.
    """
    return mixing.mixed(docs, read(spark, sf_dir, "labels"))


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows get a slot and a shard by their id, null ids those of the empty string; columns of these names are replaced."""
    return sharding.assign_shards(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The second stage links fingerprints whose hash DuckDB lacks; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each written as Parquet and read again; an empty table stays empty."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
