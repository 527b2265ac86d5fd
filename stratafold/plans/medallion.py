"""The gated run over all layers, and the replay of a range of batch dates."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.plans import activity, marts
from stratafold.plans.bronze import load_bronze
from stratafold.plans.gate import run_gate
from stratafold.plans.silver import load_silver_customers, load_silver_events
from stratafold.sources import files
from stratafold.sources.ingest import Feeds, ingest
from stratafold.sources.layers import Layers

logger = logging.getLogger(__name__)


def build_marts(layers: Layers, bounds: str = "closed") -> None:
    """Rebuild the three marts from all of Silver; retention from its state where that is kept."""
    layers.recover("silver.events", "silver.customers")
    events = layers.read("silver.events", physical=True)
    customers = layers.read("silver.customers")
    if activity.kept(layers):
        activity.refresh(layers)
        retention = activity.retention(layers)
    else:
        retention = marts.cohort_retention(events, customers)
    built: dict[str, DataFrame] = {
        "gold.top_customers_30d": marts.top_customers(events, customers, bounds=bounds),
        "gold.response_time": marts.response_time(events, customers, bounds=bounds),
        "gold.cohort_retention": retention,
    }
    for table, mart in built.items():
        layers.create(table)
        layers.swap(table, mart.withColumn("_generated_at", F.current_timestamp()))


def _marker(layers: Layers, batch_id: str) -> str:
    return f"{layers.root}/control/unfinished/{batch_id}"


def unfinished(layers: Layers) -> list[str]:
    """Batches whose raw files may not have reached Silver, oldest first."""
    return files.names(layers.spark, f"{layers.root}/control/unfinished")


def _to_silver(layers: Layers, batch_id: str, history_mode: str) -> None:
    for source in ("events", "customers"):
        load_bronze(layers, source, batch_id)
    load_silver_events(layers, batch_id)
    load_silver_customers(layers, batch_id, history_mode)
    files.delete(layers.spark, _marker(layers, batch_id))


def run_batch(layers: Layers, feeds: Feeds, batch_id: str, history_mode: str = "one_pass") -> None:
    """ingest -> bronze -> silver -> gate -> marts.

    The marts are rebuilt only when no blocking check failed.  Every step is
    idempotent for a batch id, so a run that died can be started again.  Its mark
    may have moved already, so a later batch first takes to Silver what earlier ones
    have left in the raw zone.
    """
    date.fromisoformat(batch_id)
    files.write_text(layers.spark, _marker(layers, batch_id), history_mode)
    ingest(layers, feeds, batch_id)
    for earlier in unfinished(layers):
        if earlier < batch_id:
            logger.warning("batch %s had stopped before Silver and is finished first", earlier)
            _to_silver(layers, earlier, history_mode)
    _to_silver(layers, batch_id, history_mode)
    run_gate(layers, batch_id)
    build_marts(layers)
    logger.info("batch %s done", batch_id)


def backfill(
    layers: Layers, feeds_for: Callable[[str], Feeds], batch_ids: Iterable[str], **options
) -> list[str]:
    """Replay batch dates in order, one at a time; returns the ids that ran."""
    ordered = sorted(batch_ids)
    for batch_id in ordered:
        run_batch(layers, feeds_for(batch_id), batch_id, **options)
    return ordered
