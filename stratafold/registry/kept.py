"""Queries over state that is kept between batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.functions import lineage
from stratafold.plans import activity
from stratafold.plans.silver import upsert_events
from stratafold.registry import fixtures as fx
from stratafold.schemas import SILVER_CUSTOMERS, SILVER_EVENTS
from stratafold.sources.layers import Layers

HALF = "2024-01-16"


def _batches(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Two halves of the events, spread over three months, then corrections: purchases move
    on by two months, and views lose their customer.  The batch of a row is the day of its
    version; logins have no legal type."""
    events = fx.silver_events(spark, sf_dir)
    spread = F.col("occurred_at") + F.make_interval(months=(F.col("event_id").cast("long") % 3).cast("int"))
    kind = F.when(F.col("event_type") == "login", "sign_up").otherwise(F.col("event_type"))
    events = events.withColumns({"occurred_at": spread, "event_type": kind}).withColumns(lineage("2024-01-20", "events"))
    purchase = F.col("event_type") == "purchase"
    late = events.filter(purchase | (F.col("event_type") == "page_view")).withColumns(
        {
            "occurred_at": F.when(purchase, F.col("occurred_at") + F.expr("INTERVAL 2 MONTHS")).otherwise(F.col("occurred_at")),
            "customer_id": F.when(purchase, F.col("customer_id")),
            "_customer_exists": F.col("_customer_exists") & purchase,
            "updated_at": F.col("updated_at") + F.expr("INTERVAL 5 DAYS"),
        }
    )
    early = F.col("updated_at") < F.lit(HALF)
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in SILVER_EVENTS]
    batch = F.date_format("updated_at", "yyyy-MM-dd")
    parts = (events.filter(early), events.filter(~early), late)
    return [df.withColumn("_batch_id", batch).select(*columns) for df in parts]


def _customers(spark: SparkSession, sf_dir: str, layers: Layers) -> None:
    raw = fx.raw_customers(spark, sf_dir).filter(F.col("updated_at") < "2024-01-10")
    open_versions = fx.silver_customers(spark, sf_dir).select("customer_id", "valid_from", "valid_to", "is_current")
    rows = raw.join(open_versions, "customer_id").withColumns(lineage("2024-01-20", "customers"))
    layers.create("silver.customers")
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in SILVER_CUSTOMERS]
    layers.swap("silver.customers", rows.select(*columns))


def _after_batches(spark: SparkSession, sf_dir: str) -> Layers:
    """Layers after three batches, of which each refreshed the days that it touched."""
    layers = fx.scratch_layers(spark, "kept")
    _customers(spark, sf_dir, layers)
    for batch in _batches(spark, sf_dir):
        upsert_events(layers, batch)
        activity.refresh(layers)
    return layers


def retention_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.retention(_after_batches(spark, sf_dir))


def profiles_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = activity.batch_profiles(_after_batches(spark, sf_dir))
    return profiles.withColumn("newest", F.col("newest").cast("timestamp_ntz"))


QUERIES = {f.__name__: f for f in (retention_kept, profiles_kept)}
