"""Small pieces that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.session import staged

__all__ = ["WHITE", "documents", "pages", "staged", "text_of", "cells_for", "checked"]

#: The white space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def text_of(column: str = "text") -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def cells_for(frame: DataFrame, column: str, megabytes: float = 3.0) -> int:
    """How many cells of about that size hold all texts: one pass over one column."""
    total = frame.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0
    return max(1, -(-int(total) // int(megabytes * 1e6)))


def checked(frame: DataFrame, *needed: str) -> DataFrame:
    """Only the needed columns, so that other columns of whatever name cannot clash."""
    missing = [c for c in needed if c not in frame.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return frame.select(*needed)
