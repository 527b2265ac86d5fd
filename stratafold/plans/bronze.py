"""Raw files to Bronze: lineage columns, drift tolerance, idempotent per batch."""

from __future__ import annotations

import logging
from datetime import datetime

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratafold.functions import lineage
from stratafold.schemas import RAW_CUSTOMERS, RAW_EVENTS
from stratafold.sources import files, landing
from stratafold.sources.layers import Layers

logger = logging.getLogger(__name__)

RAW_SCHEMAS: dict[str, T.StructType] = {"events": RAW_EVENTS, "customers": RAW_CUSTOMERS}


def with_lineage(
    raw: DataFrame, batch_id: str, source: str, run_at: datetime | None = None
) -> DataFrame:
    """Raw rows with the control columns.  A boolean ``is_active`` becomes text; the
    typed value belongs to Silver."""
    if "is_active" in raw.columns and raw.schema["is_active"].dataType == T.BooleanType():
        raw = raw.withColumn("is_active", raw["is_active"].cast("string"))
    return raw.withColumns(lineage(batch_id, source, run_at))


def bronze_batch(
    layers: Layers, source: str, batch_id: str, run_at: datetime | None = None
) -> DataFrame:
    raw = landing.read_raw(layers.spark, layers.root, source, batch_id, RAW_SCHEMAS[source])
    folder = landing.batch_folder(layers.root, source, batch_id) + "/"
    return with_lineage(raw, batch_id, folder, run_at)


def load_bronze(layers: Layers, source: str, batch_id: str) -> int:
    """Replace the batch in ``bronze.<source>`` with what the raw zone holds for it.

    Raw files may expire: without a raw folder a stored batch stays as it is.  The
    number of rows written is counted by the write itself.
    """
    table = f"bronze.{source}"
    layers.create(table)
    folder = landing.batch_folder(layers.root, source, batch_id)
    if not files.exists(layers.spark, folder) and not layers.batch(table, batch_id).isEmpty():
        logger.warning("%s: no raw files for %s, the stored batch stays", table, batch_id)
        return 0
    seen = Observation()
    rows = bronze_batch(layers, source, batch_id).observe(seen, F.count("*").alias("rows"))
    layers.replace_batch(table, rows, batch_id)
    count = seen.get["rows"]
    logger.info("%s: %d rows for %s", table, count, batch_id)
    return count
