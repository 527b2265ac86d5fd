"""Bad input, interrupted runs, and paths that must agree whatever the size."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from stratafold.operators.scd2 import apply_one_pass, apply_two_step, stamp_versions
from stratafold.operators.sizing import fits_broadcast, memory_bytes, plan_bytes
from stratafold.operators.skew import salted_join
from stratafold.plans.bronze import load_bronze
from stratafold.plans.medallion import run_batch, unfinished
from stratafold.plans.silver import load_silver_events, quarantine_folder, typed_customers, typed_events, upsert_events
from stratafold.schemas import RAW_CUSTOMERS, RAW_EVENTS
from stratafold.sources import landing
from stratafold.sources.ingest import Feeds, feed_of, ingest_source
from stratafold.sources.relational import changed_since, high_water_mark
from stratafold.sources.watermarks import read_watermark
from tests.conftest import rows

B1, B2, B3 = "2026-03-01", "2026-03-02", "2026-03-03"


def events(spark, *records):
    fields = RAW_EVENTS.fieldNames()
    return spark.createDataFrame([tuple(r.get(f) for f in fields) for r in records], RAW_EVENTS)


def event(key, at, day="2026-03-01", channel="web"):
    return {
        "event_id": key, "customer_id": "c1", "event_type": "login",
        "occurred_at": f"{day}T08:00:00Z", "updated_at": at, "channel": channel, "properties": "{}",
    }


def customers(spark, *records):
    full = [(k, k, "pro", "smb", "2025-01-01", "BR", "true", at) for k, at in records]
    return spark.createDataFrame(full, RAW_CUSTOMERS)


def test_marks_compare_instants_not_text(spark):
    df = spark.createDataFrame([("a", "2026-01-01T00:00:00.500000Z"), ("b", "2026-01-01T00:00:00Z")], "k string, updated_at string")
    assert rows(changed_since(df, "2026-01-01T00:00:00Z"), "k") == [("a",)]
    bad = df.union(spark.createDataFrame([("c", "nope")], "k string, updated_at string"))
    assert high_water_mark(bad).first()[0] == "2026-01-01T00:00:00.500000Z"


def test_unreadable_times_are_set_aside_and_are_no_mark(spark, layers):
    feed = feed_of(events(spark, event("e1", "2026-03-01T09:00:00Z"), event("e2", "nope")))
    assert ingest_source(layers, "events", feed, B1)
    assert read_watermark(layers, "events") == "2026-03-01T09:00:00Z"
    rejected = spark.read.json(f"{layers.root}/rejected/events/ingestion_date={B1}")
    assert [r["event_id"] for r in rejected.collect()] == ["e2"]


def test_broken_lines_keep_their_text(spark, layers):
    folder = f"{landing.batch_folder(layers.root, 'events', B1)}/since=0"
    os.makedirs(folder)
    with open(f"{folder}/a.json", "w") as out:
        out.write(json.dumps(event("e1", "2026-03-01T09:00:00Z")) + '\n{"event_id": \nnot json\n')
    load_bronze(layers, "events", B1)
    found = {tuple(r) for r in layers.read("bronze.events").select("event_id", "_corrupt_record").collect()}
    assert found == {(None, '{"event_id": '), (None, "not json"), ("e1", None)}


def test_names_that_differ_by_case_are_one_column(spark, layers):
    folder = f"{landing.batch_folder(layers.root, 'events', B1)}/since=0"
    os.makedirs(folder)
    one = {**event("e1", "2026-03-01T09:00:00Z"), "source_app": "x"}
    two = {**event("e2", "2026-03-01T09:00:00Z"), "Source_App": "y"}
    two["Channel"] = two.pop("channel")
    with open(f"{folder}/a.json", "w") as out:
        out.write(json.dumps(one) + "\n" + json.dumps(two) + "\n")
    load_bronze(layers, "events", B1)
    name = next(c for c in layers.read("bronze.events").columns if c.lower() == "source_app")
    assert rows(layers.read("bronze.events"), "event_id", "channel", name) == [("e1", "web", "x"), ("e2", "web", "y")]


def test_expired_raw_files_leave_a_stored_batch_alone(spark, layers):
    landing.save_raw(events(spark, event("e1", "2026-03-01T09:00:00Z")), layers.root, "events", B1)
    assert load_bronze(layers, "events", B1) == 1
    landing.files.delete(spark, f"{layers.root}/raw")
    assert load_bronze(layers, "events", B1) == 0
    assert layers.read("bronze.events").count() == 1


def test_rows_without_a_key_are_quarantined_once(spark, layers):
    landing.save_raw(
        events(spark, event("e1", "2026-03-01T09:00:00Z"), event(None, "2026-03-01T09:00:00Z")), layers.root, "events", B1
    )
    for _ in range(2):
        load_bronze(layers, "events", B1)
        load_silver_events(layers, B1)
    assert rows(layers.read("silver.events"), "event_id") == [("e1",)]
    assert spark.read.parquet(quarantine_folder(layers, "events", B1)).count() == 1


def test_unreadable_versions_never_win(spark):
    lineage = {"_ingested_at": F.current_timestamp(), "_source_file": F.lit("f"), "_batch_id": F.lit(B1)}
    df = events(spark, event("e1", "zzz", channel="bad"), event("e1", "2026-03-01T09:00:00Z", channel="good"))
    assert rows(typed_events(df.withColumns(lineage)), "channel") == [("good",)]


@pytest.mark.parametrize("days", [("2026-03-02", "2026-03-01"), ("2026-03-01", "2026-03-02")])
@pytest.mark.parametrize("stop_after", [0, 1, 2])
def test_an_interrupted_upsert_is_completed(spark, layers, monkeypatch, days, stop_after):
    def batch(at, day):
        lineage = {"_ingested_at": F.current_timestamp(), "_source_file": F.lit("f"), "_batch_id": F.lit(B1)}
        return typed_events(events(spark, event("e1", at, day)).withColumns(lineage))

    upsert_events(layers, batch("2026-03-01T09:00:00Z", days[0]))
    sql, seen = type(spark).sql, []

    def stopping(self, text, *args, **more):
        if text.startswith("ALTER"):
            if len(seen) == stop_after:
                raise KeyboardInterrupt
            seen.append(text)
        return sql(self, text, *args, **more)

    with monkeypatch.context() as patch:
        patch.setattr(type(spark), "sql", stopping)
        try:
            upsert_events(layers, batch("2026-03-03T09:00:00Z", days[1]))
        except KeyboardInterrupt:
            pass
    upsert_events(layers, batch("2026-03-03T09:00:00Z", days[1]))
    assert rows(layers.read("silver.events", physical=True), "event_id", F.col("event_date").cast("string")) == [("e1", days[1])]


def test_a_later_run_finishes_an_earlier_batch(spark, layers):
    feed = lambda *c: Feeds(feed_of(events(spark, event("e1", "2026-03-01T09:00:00Z"))), feed_of(customers(spark, *c)))
    first, twice = ("c1", "2026-03-01T00:00:00Z"), ("c1", "2026-03-02T01:00:00Z")
    run_batch(layers, feed(first), B1)
    with pytest.raises(Exception, match="several newer rows"):
        run_batch(layers, feed(first, twice, ("c1", "2026-03-02T02:00:00Z")), B2, history_mode="two_step")
    assert unfinished(layers) == [B2]
    run_batch(layers, feed(first, twice, ("c1", "2026-03-02T02:00:00Z"), ("c1", "2026-03-03T00:00:00Z")), B3)
    assert unfinished(layers) == []
    assert layers.read("silver.customers").count() == 4
    assert layers.read("silver.customers").filter("is_current").count() == 1


def test_one_pass_means_the_same_at_every_size(spark):
    def batch(*records):
        raw = customers(spark, *records)
        lineage = {"_ingested_at": F.lit(None).cast("timestamp"), "_source_file": F.lit("f"), "_batch_id": F.lit(B1)}
        return typed_customers(raw.withColumns(lineage))

    empty = stamp_versions(batch()).limit(0)
    first = apply_two_step(empty, batch(("c1", "2026-01-05T00:00:00Z"), ("c2", "2026-01-01T00:00:00Z")), "customer_id")
    # A late row stays open beside the current one.
    dirty = apply_two_step(first, batch(("c1", "2026-01-02T00:00:00Z")), "customer_id")
    change = batch(("c2", "2026-02-01T00:00:00Z"), (None, "2026-02-01T00:00:00Z"))
    small = apply_one_pass(dirty, change, "customer_id")
    large = apply_one_pass(dirty, change, "customer_id", broadcast_bytes=0)
    assert rows(small) == rows(large)
    assert small.filter("customer_id = 'c1' and is_current").count() == 2


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_takes_map_columns(spark, how):
    left = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "k string, n int").withColumn("m", F.create_map(F.lit("x"), "n"))
    right = spark.createDataFrame([("a", 10), ("b", 20)], "k string, v int")
    small = salted_join(left, right, ["k"], how)
    large = salted_join(left, right, ["k"], how, hot_rows=1, small_bytes=0, broadcast_bytes=0)
    assert rows(small, "k", "n", "v") == rows(large, "k", "n", "v")


def test_guards_count_rows_not_files(spark, tmp_path):
    spark.range(200_000).select(F.lit("x" * 200).alias("t")).write.parquet(f"{tmp_path}/same")
    df = spark.read.parquet(f"{tmp_path}/same")
    assert plan_bytes(df) < 1_000_000 < memory_bytes(df)
    assert not fits_broadcast(df, 1_000_000)
    wide = spark.range(100).select(F.explode(F.sequence(F.lit(1), F.lit(10_000))).alias("n"))
    assert not fits_broadcast(wide, 1_000_000)
