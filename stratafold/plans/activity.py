"""Cohort retention and batch profiles from kept state, by day of Silver.

The state has, for every day of Silver and month of its events, the customers seen, as
bitmaps, and the rows of each batch.  A day's state is rebuilt whenever an upsert rewrites the day, so a correction
that takes an event away takes the customer and the row out as well; days that no upsert touched are
never read again.  The months are unions of their days.

Upserts note the days they are about to change, and a note goes only once the state of
its days is stored: a run that stops in between is made up for by the next refresh.
"""

from __future__ import annotations

import logging
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold import domains
from stratafold.functions import month_of, percent
from stratafold.operators import bitmaps
from stratafold.operators.quality import outside
from stratafold.plans.silver import changed_days, forget_changed_days, note_changed_days
from stratafold.schemas import EVENT_DATE
from stratafold.session import staged
from stratafold.sources.layers import Layers

logger = logging.getLogger(__name__)

NUMBERS = "state.customer_numbers"
PROFILES = "state.batch_profiles"
DAYS = "state.active_customers"


def kept(layers: Layers) -> bool:
    """Whether this set of layers keeps the state; the first ``refresh`` starts it."""
    return layers.exists(DAYS)


def refresh(layers: Layers) -> list[date]:
    """Bring the state up to date with Silver; returns the days that were read.

    The first time all days are read: they are noted before the state begins to exist.
    """
    layers.create("silver.events")
    layers.recover("silver.events")
    events = layers.read("silver.events", physical=True)
    layers.create(NUMBERS)
    layers.create(PROFILES)
    if not kept(layers):
        # Partition values only: bounded by the calendar span of the table.
        note_changed_days(layers, sorted(row[0] for row in events.select(EVENT_DATE).distinct().collect()))
        layers.create(DAYS)
    layers.recover(PROFILES, DAYS)
    notes = changed_days(layers)
    days = sorted({day for noted in notes.values() for day in noted})
    if days:
        _rebuild(layers, events.filter(F.col(EVENT_DATE).isin(days)), days)
    forget_changed_days(layers, notes)
    logger.info("state of %d days read anew", len(days))
    return days


def _rebuild(layers: Layers, events: DataFrame, days: list[date]) -> None:
    """Replace the state of ``days`` by that of their events.

    The events are read once; what is kept of them is a row for each customer, month,
    batch and day.
    """
    seen = staged(
        events.withColumn("month", F.trunc("occurred_at", "month"))
        .withColumn("_known", F.col("_customer_exists") & F.col("customer_id").isNotNull())
        .groupBy("customer_id", "_known", "month", F.col("_batch_id").alias("batch"), EVENT_DATE)
        .agg(
            F.count("*").alias("rows"),
            F.count_if(outside("event_type", domains.EVENT_TYPES)).alias("illegal"),
            F.max("occurred_at").alias("newest"),
        ),
        "seen",
    )
    layers.swap_partitions(PROFILES, _summed(seen, "batch", EVENT_DATE), days)
    active = seen.filter("_known").select("customer_id", "month", EVENT_DATE).distinct()
    # Staged: the plan reads the table that it is appended to.
    fresh = staged(bitmaps.new_numbers(layers.read(NUMBERS), active, "customer_id"), "numbers")
    layers.append(NUMBERS, fresh)
    numbered = active.join(layers.read(NUMBERS), "customer_id")
    layers.swap_partitions(DAYS, bitmaps.construct(numbered, [EVENT_DATE, "month"]), days)


def _summed(profiles: DataFrame, *by: str) -> DataFrame:
    return profiles.groupBy(*by).agg(
        F.sum("rows").alias("rows"), F.sum("illegal").alias("illegal"), F.max("newest").alias("newest")
    )


def batch_profiles(layers: Layers) -> DataFrame:
    """``quality.batch_profile`` of the kept state; no event is read."""
    return _summed(layers.read(PROFILES), "batch")


def retention(layers: Layers) -> DataFrame:
    """``marts.cohort_retention`` of the kept state and the current customers; no event is read."""
    months = bitmaps.united(layers.read(DAYS), ["month"]).withColumnRenamed("month", "_month")
    cohorts = (
        layers.read("silver.customers")
        .filter(F.col("is_current") & F.col("customer_id").isNotNull() & F.col("signup_date").isNotNull())
        .select("customer_id", F.trunc("signup_date", "month").alias("_cohort"))
        .distinct()
    )
    sizes = cohorts.groupBy(F.col("_cohort").alias("_of")).agg(F.count("*").alias("cohort_customers"))
    sets = bitmaps.construct(cohorts.join(layers.read(NUMBERS), "customer_id"), ["_cohort"])
    active = bitmaps.common_counts(sets, months, ["_cohort", "_month"])
    return active.join(sizes, F.col("_cohort") == F.col("_of")).select(
        month_of("_cohort").alias("cohort_month"),
        month_of("_month").alias("activity_month"),
        "cohort_customers",
        F.col("members").alias("active_customers"),
        percent(F.col("members"), F.col("cohort_customers"), 2).alias("retention_pct"),
    )
