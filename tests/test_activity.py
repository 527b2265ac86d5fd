"""Retention from kept state: equal to the mart over all events, with old days unread."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from stratafold.functions import lineage
from stratafold.operators import bitmaps, quality
from stratafold.plans import activity, marts
from stratafold.plans.gate import run_gate
from stratafold.plans.medallion import build_marts
from stratafold.plans.silver import changed_days, upsert_events
from stratafold.schemas import SILVER_CUSTOMERS, SILVER_EVENTS
from tests.conftest import rows


def batch(spark, *data, day="2026-09-01"):
    """(event_id, customer_id, occurred_at, updated_at), days as text."""
    df = spark.createDataFrame(list(data), "event_id string, customer_id string, occurred_at string, updated_at string")
    df = df.withColumns(lineage(day, "events")).withColumn("_customer_exists", F.col("customer_id").isNotNull())
    more = {c: F.lit("x") for c in ("event_type", "channel", "properties")}
    return df.withColumns(more).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SILVER_EVENTS])


def customers(spark, layers, *data):
    """(customer_id, signup_date, is_current)"""
    df = spark.createDataFrame(list(data), "customer_id string, signup_date string, is_current boolean")
    for f in SILVER_CUSTOMERS:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None))
    layers.create("silver.customers")
    layers.swap("silver.customers", df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SILVER_CUSTOMERS]))


def check(layers):
    layers.recover("silver.events")
    full = marts.cohort_retention(layers.read("silver.events"), layers.read("silver.customers"))
    assert rows(activity.retention(layers), *full.columns) == rows(full)
    assert rows(activity.batch_profiles(layers)) == rows(quality.batch_profile(layers.read("silver.events")))
    return full.count()


CUSTOMERS = [
    ("c1", "2026-01-05", True),
    ("c1", "2025-12-05", False),
    ("c2", "2026-01-20", True),
    ("c3", "2026-02-01", True),
    ("c3", "2026-02-01", True),
    ("c4", "2026-02-01", False),
    ("quiet", "2026-02-01", True),
    ("c5", None, True),
    (None, "2026-01-01", True),
]
FIRST = [
    ("e1", "c1", "2026-01-10", "2026-01-10"),
    ("e2", "c1", "2026-01-10", "2026-01-10"),
    ("e3", "c2", "2026-02-10", "2026-02-10"),
    ("e4", None, "2026-02-10", "2026-02-10"),
    ("e5", "stranger", "2026-02-10", "2026-02-10"),
    ("e6", "c3", None, "2026-02-10"),
    ("e7", "c3", "1970-01-01", "2026-02-10"),
    ("e8", "c4", "2026-02-11", "2026-02-11"),
    ("e9", "c5", "2026-02-11", "2026-02-11"),
]


def test_three_batches_equal_the_full_mart_and_read_only_touched_days(spark, layers):
    customers(spark, layers, *CUSTOMERS)
    upsert_events(layers, batch(spark, *FIRST))
    assert len(activity.refresh(layers)) == 4
    assert check(layers) == 4
    # A new event and a new customer; then an event moves to another month and one loses its customer.
    upsert_events(layers, batch(spark, ("e10", "quiet", "2026-03-01", "2026-03-01")))
    assert activity.refresh(layers) == [date(2026, 3, 1)]
    assert check(layers) == 5
    upsert_events(layers, batch(spark, ("e3", "c2", "2026-03-02", "2026-03-02"), ("e8", None, "2026-02-11", "2026-03-02")))
    assert activity.refresh(layers) == [date(2026, 2, 10), date(2026, 2, 11), date(2026, 3, 2)]
    check(layers)
    assert activity.refresh(layers) == []
    customers(spark, layers, *CUSTOMERS[:3], ("c3", "2026-01-02", True))
    check(layers)


def test_numbers_stay_and_are_dense(spark, layers):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("customer_id"))
    none = spark.createDataFrame([], "customer_id string, number long")
    first = bitmaps.new_numbers(none, keys.filter("length(customer_id) < 5"), "customer_id")
    known = spark.createDataFrame(first.collect(), first.schema)
    more = bitmaps.new_numbers(known, keys.unionByName(spark.createDataFrame([(None,)], "customer_id string")), "customer_id")
    every = known.unionByName(more)
    assert every.count() == 5000 == every.select("number").distinct().count() == every.select("customer_id").distinct().count()
    assert every.agg(F.min("number") > 0, F.max("number") < 3 * 5000 + 2 * bitmaps.LANES).first()[:] == (True, True)
    assert more.join(known, "customer_id").count() == 0


def test_common_counts_over_several_slots(spark):
    sets = spark.range(1, 200_001).select(F.col("id").alias("number"), (F.col("id") % 3).alias("a"), (F.col("id") % 5).alias("b"))
    left, right = bitmaps.construct(sets, ["a"]), bitmaps.construct(sets.filter("b < 2"), ["b"])
    expected = sets.filter("b < 2").groupBy("a", "b").count()
    assert left.select("slot").distinct().count() == 7
    assert rows(bitmaps.common_counts(left, right, ["a", "b"])) == rows(expected)
    apart = bitmaps.united(right.union(right), ["b"])
    assert rows(apart) == rows(right)


def test_a_stopped_upsert_or_refresh_is_made_up_for(spark, layers, monkeypatch):
    customers(spark, layers, *CUSTOMERS)
    upsert_events(layers, batch(spark, *FIRST))
    activity.refresh(layers)

    def stopped(*_):
        raise RuntimeError("stopped")

    later = batch(spark, ("e1", "c2", "2026-01-10", "2026-03-01"), ("e11", "c3", "2026-03-05", "2026-03-05"))
    monkeypatch.setattr(type(layers), "_apply", stopped)
    with pytest.raises(RuntimeError):
        upsert_events(layers, later)
    monkeypatch.undo()
    monkeypatch.setattr(activity, "forget_changed_days", stopped)
    with pytest.raises(RuntimeError):
        activity.refresh(layers)
    monkeypatch.undo()
    assert changed_days(layers)
    assert activity.refresh(layers) == [date(2026, 1, 10), date(2026, 3, 5)]
    check(layers)


def test_marts_take_retention_from_the_state_where_it_is_kept(spark, layers, monkeypatch):
    customers(spark, layers, *CUSTOMERS)
    assert activity.refresh(layers) == [] and activity.retention(layers).count() == 0
    upsert_events(layers, batch(spark, *FIRST))
    expected = rows(marts.cohort_retention(layers.read("silver.events"), layers.read("silver.customers")))
    monkeypatch.setattr(marts, "cohort_retention", lambda *_: pytest.fail("read all events"))
    build_marts(layers)
    assert rows(layers.read("gold.cohort_retention").drop("_generated_at")) == expected


@pytest.mark.parametrize("n", [0, 1, 3, 40])
def test_a_stored_profile_gives_the_same_summary(spark, n):
    data = [(f"2026-{1 + i // 28:02d}-{1 + i % 28:02d}", 7 * i % 11, i % 2, None if i == 2 else f"2026-01-{1 + i % 28:02d}") for i in range(n)]
    data += [(None, 5, 1, None)] * (n > 2)
    profile = spark.createDataFrame(data, "batch string, rows long, illegal long, newest string")
    profile = profile.withColumn("newest", F.col("newest").cast("timestamp"))
    for day in ("2026-01-03", "2026-02-12", "2025-01-01"):
        assert rows(quality.batch_summary(profile, day, stored=True)) == rows(quality.batch_summary(profile, day))


def test_the_gate_takes_profiles_from_the_state_where_it_is_kept(spark, layers, monkeypatch):
    customers(spark, layers, *CUSTOMERS)
    activity.refresh(layers)
    upsert_events(layers, batch(spark, *FIRST, day="2026-02-11"))
    # The correction takes e9 into the later batch.
    upsert_events(layers, batch(spark, ("e9", "c2", "2026-02-11", "2026-02-12"), day="2026-02-12"))
    expected = rows(quality.report(layers.read("silver.events"), layers.read("silver.customers"), "2026-02-12"))
    monkeypatch.setattr(quality, "batch_profile", lambda *_: pytest.fail("read all events"))
    monkeypatch.setattr(quality, "blocking_failures", lambda df: df.limit(0).select("check_name"))
    assert rows(run_gate(layers, "2026-02-12")) == expected
