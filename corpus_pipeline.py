"""A corpus from raw documents to packed training sequences, stage by stage.

Every stage reads the whole output of the one before, written as Parquet in the shared
folder.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.llm import exact_dedup, line_crf, mixing, near_dedup, packing, registry
from stratafold.llm.common import documents
from stratafold.session import staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier accepts; it learns from ``labels``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return line_crf.keep_good(docs, labels)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest stays."""
    return exact_dedup.keep_exact(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the one with the smallest id stays."""
    return near_dedup.keep_one(docs)


def weighted_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each copy that the mix draws, shard by shard; documents stay whole."""
    return mixing.mixed(docs, whole=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, a row for each piece, with a digest of its ids."""
    return packing.pack(docs, registry.TOKENIZER).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", good_quality),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("source_mix", weighted_mix),
    ("packing", packed),
]

#: Trained scores, sketches and random draws are not for SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each over the whole output of the one before."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
