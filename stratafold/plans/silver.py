"""Bronze to Silver: typed rows, newest-wins events, customer history."""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from stratafold.functions import iso_date, iso_timestamp, truth
from stratafold.operators.dedup import keep_latest, null_key_rows
from stratafold.operators.keyfilter import key_filter, maybe_held
from stratafold.operators.merge import newest_wins
from stratafold.operators.scd2 import apply_one_pass, apply_two_step
from stratafold.operators.sizing import BROADCAST_BYTES, fits_broadcast
from stratafold.schemas import BRONZE_EVENTS, BUCKET, EVENT_DATE, SILVER_EVENTS
from stratafold.session import staged
from stratafold.sources import files
from stratafold.sources.layers import Layers

logger = logging.getLogger(__name__)

HISTORY = "silver.customers"
# Day of rows whose event time is missing or malformed.
NO_DAY = "1970-01-01"


def typed_events(bronze: DataFrame, null_keys: str = "collapse") -> DataFrame:
    """Latest row per event id, typed and cut to the fixed Silver columns.

    Versions are compared as instants, so text that names none never wins; equal ones
    are settled by their text and the remaining payload, so a rerun picks the same row.
    """
    ties = ["updated_at", *[c for c in BRONZE_EVENTS.fieldNames() if c not in ("event_id", "updated_at")]]
    timed = bronze.withColumn("_instant", iso_timestamp("updated_at"))
    latest = keep_latest(timed, ["event_id"], "_instant", [F.col(c).desc() for c in ties], null_keys)
    return latest.drop("_instant").withColumns(
        {
            "occurred_at": iso_timestamp("occurred_at"),
            "updated_at": iso_timestamp("updated_at"),
            "_customer_exists": F.col("customer_id").isNotNull(),
        }
    ).select(*SILVER_EVENTS.fieldNames())


def typed_customers(bronze: DataFrame) -> DataFrame:
    return bronze.withColumns(
        {
            "updated_at": iso_timestamp("updated_at"),
            "signup_date": iso_date("signup_date"),
            "is_active": truth("is_active"),
        }
    )


def with_day(events: DataFrame) -> DataFrame:
    day = F.coalesce(F.to_date("occurred_at"), F.lit(NO_DAY).cast("date"))
    return events.withColumn(EVENT_DATE, day)


def held_days(target: DataFrame, batch: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(event_id, day) of the table's rows whose key is in the batch, a staged table.

    A batch of more keys than may be broadcast is first put to the scan as a filter of
    fixed size, so that about as many rows are shuffled as the batch has.
    """
    keys = batch.select("event_id").filter(F.col("event_id").isNotNull())
    scan = target.select("event_id", EVENT_DATE)
    if fits_broadcast(keys, broadcast_bytes):
        keys = F.broadcast(keys)
    else:
        scan = maybe_held(scan, ["event_id"], key_filter(keys, ["event_id"]))
    return scan.join(keys, "event_id", "left_semi")


def upsert_events(layers: Layers, batch: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> None:
    """Newest-wins upsert of a deduplicated batch, rewriting only the days it touches.

    A correction may move an event to another day, so the touched days are those of
    the batch and those its keys have in the table.  The table is scanned once for
    keys alone; full rows are read for touched days only.
    """
    table = "silver.events"
    layers.create(table)
    # A run that stopped between two days is completed before anything is read.
    layers.recover(table)
    batch = staged(with_day(batch), "events-batch")
    target = layers.read(table, physical=True)
    held = held_days(target, batch, broadcast_bytes)
    # Days only: bounded by the calendar span of the table.
    days = batch.select(EVENT_DATE).union(held.select(EVENT_DATE)).distinct()
    touched = sorted(row[0] for row in days.collect())
    if not touched:
        return
    kept_days = target.filter(F.col(EVENT_DATE).isin(touched))
    merged = newest_wins(kept_days, batch, ["event_id"], "updated_at", broadcast_bytes)
    if layers.exists("state.active_customers"):
        note_changed_days(layers, touched)
    layers.swap_partitions(table, merged, touched)


def _changed_days(layers: Layers) -> str:
    return f"{layers.root}/control/changed_days"


def note_changed_days(layers: Layers, days: Iterable[date]) -> None:
    """Tell the state that is kept by day which days are about to change."""
    text = json.dumps([str(day) for day in days])
    files.write_text(layers.spark, f"{_changed_days(layers)}/{uuid.uuid4().hex}", text)


def changed_days(layers: Layers) -> dict[str, list[date]]:
    """Notes of changed days that no state has taken up, by name; half-written ones preceded no change."""
    notes = {}
    for name in files.names(layers.spark, _changed_days(layers)):
        if name.endswith(".half"):
            continue
        days = json.loads(files.read_text(layers.spark, f"{_changed_days(layers)}/{name}") or "[]")
        notes[name] = [date.fromisoformat(day) for day in days]
    return notes


def forget_changed_days(layers: Layers, names: Iterable[str]) -> None:
    for name in names:
        files.delete(layers.spark, f"{_changed_days(layers)}/{name}")


def load_silver_events(layers: Layers, batch_id: str, null_keys: str = "quarantine") -> None:
    """Upsert the events of a batch.

    Rows without an event id cannot be matched on a rerun.  "quarantine" keeps them
    apart, in files replaced with their batch; "collapse" and "drop" are those of
    ``keep_latest``.
    """
    bronze = layers.batch("bronze.events", batch_id)
    if null_keys == "quarantine":
        quarantine(layers, "events", null_key_rows(bronze, ["event_id"]), batch_id)
        null_keys = "drop"
    upsert_events(layers, typed_events(bronze, null_keys))


def quarantine(layers: Layers, source: str, rows: DataFrame, part: str) -> int:
    """Replace what a batch, or a part of a stream, has set aside; no folder without rows."""
    folder = quarantine_folder(layers, source, part)
    seen = Observation()
    rows.observe(seen, F.count("*").alias("rows")).write.mode("overwrite").parquet(folder)
    count = seen.get["rows"]
    if count:
        logger.warning("%d %s rows without a key in %s", count, source, folder)
    else:
        files.delete(layers.spark, folder)
    return count


def quarantine_folder(layers: Layers, source: str, part: str) -> str:
    return f"{layers.root}/quarantine/{source}/part={part}"


def load_silver_customers(layers: Layers, batch_id: str, mode: str = "one_pass") -> None:
    """Apply a batch to the customer history; only the buckets of its keys are read and rewritten.

    "one_pass" rebuilds the intervals of the batch's keys and so takes late and
    repeated versions as they come; "two_step" closes and inserts in two separate
    merges and refuses several newer versions of a key.
    """
    layers.create(HISTORY)
    layers.recover(HISTORY)
    batch = staged(layers.bucketed(HISTORY, typed_customers(layers.batch("bronze.customers", batch_id))), "customers-batch")
    # Bucket numbers: at most as many as the table has buckets.
    touched = sorted(row[0] for row in batch.select(BUCKET).distinct().collect())
    if not touched:
        return
    history = layers.read(HISTORY, physical=True).filter(F.col(BUCKET).isin(touched)).drop(BUCKET)
    apply = {"two_step": apply_two_step, "one_pass": apply_one_pass}[mode]
    changed = apply(history, batch.drop(BUCKET), "customer_id")
    layers.swap_partitions(HISTORY, layers.bucketed(HISTORY, changed), touched)
