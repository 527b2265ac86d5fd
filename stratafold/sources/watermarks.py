"""Stored high-water marks: one row per source."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from stratafold.schemas import WATERMARKS
from stratafold.sources.layers import Layers

TABLE = "control.watermarks"


def read_watermark(layers: Layers, source: str) -> str | None:
    """The stored mark, or None on a first run.

    A missing table and unreadable JSON both mean a first run; other errors raise.
    """
    if not layers.exists(TABLE):
        return None
    row = layers.read(TABLE).filter(F.col("source") == source).agg(F.max("last_updated_at")).first()
    return row[0]


def write_watermark(layers: Layers, source: str, last_updated_at: str) -> None:
    """Replace the mark of one source and keep the others."""
    layers.create(TABLE)
    now = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    fresh = layers.spark.createDataFrame([(source, last_updated_at, now)], WATERMARKS)
    others = layers.read(TABLE).filter(F.col("source") != source)
    layers.swap(TABLE, others.unionByName(fresh).coalesce(1))
