import json
import os

import pytest
from pyspark.sql import functions as F

from stratafold import schemas
from stratafold.functions import canonical_order, iso_date, iso_timestamp, json_attribute, lineage, truth
from stratafold.plans.bronze import bronze_batch, load_bronze, with_lineage
from stratafold.plans.silver import load_silver_events, typed_events
from stratafold.sources import landing
from stratafold.sources.ingest import Feeds, feed_of, ingest, ingest_source
from stratafold.sources.layers import Layers, export_delimited, read_delimited
from stratafold.sources.relational import changed_since, customer_extract, jdbc_options
from stratafold.sources.watermarks import read_watermark, write_watermark
from stratafold.streaming.silver_stream import stream_events
from tests.conftest import rows

B1, B2 = "2026-03-11", "2026-09-01"


def record(event_id, at, updated=None, **more):
    fields = {
        "event_id": event_id,
        "customer_id": "c1",
        "event_type": "login",
        "occurred_at": at,
        "updated_at": updated or at,
        "channel": "web",
        "properties": {"z": 1, "ticket_id": "t1", "gone": None},
    }
    return {k: v for k, v in {**fields, **more}.items() if v is not ...}


def drop_raw(root, source, day, records, since="a"):
    folder = f"{landing.batch_folder(root, source, day)}/since={since}"
    os.makedirs(folder)
    with open(f"{folder}/part-0.json", "w", encoding="utf-8") as out:
        out.writelines(json.dumps(r, ensure_ascii=False) + "\n" for r in records)


def files(folder):
    return sorted(os.path.join(d, f) for d, _, fs in os.walk(folder) for f in fs)


def test_nested_json_keeps_its_text(spark, layers):
    drop_raw(layers.root, "events", B1, [record("e1", "2026-03-01T10:00:00Z", channel="wéb")])
    row = bronze_batch(layers, "events", B1).first()
    assert json.loads(row["properties"]) == {"z": 1, "ticket_id": "t1", "gone": None}
    assert row["channel"] == "wéb"
    ticket = bronze_batch(layers, "events", B1).select(json_attribute("properties", "ticket_id"))
    assert ticket.first()[0] == "t1"
    assert row["_batch_id"] == B1 and row["_source_file"].endswith(f"ingestion_date={B1}/")


def test_lineage_is_one_instant(spark):
    stamped = spark.range(100).repartition(8).withColumns(lineage(B1, "raw/"))
    assert stamped.select("_ingested_at").distinct().count() == 1


def test_boolean_flag_becomes_text(spark):
    raw = spark.createDataFrame([(True,), (None,)], "is_active boolean")
    assert rows(with_lineage(raw, B1, "raw/"), "is_active") == [(None,), ("true",)]


def test_missing_day_is_an_empty_batch(spark, layers):
    load_bronze(layers, "events", B1)
    load_silver_events(layers, B1)
    assert layers.read("bronze.events").count() == 0
    assert layers.read("silver.events").count() == 0


def test_batch_replace_twice_is_once_and_leaves_others_alone(spark, layers):
    drop_raw(layers.root, "events", B1, [record("e1", "2026-03-01T10:00:00Z"), record("e2", "2026-03-01T10:00:00Z")])
    drop_raw(layers.root, "events", B2, [record("e3", "2026-08-01T10:00:00Z")])
    for day in (B1, B2, B1, B1):
        load_bronze(layers, "events", day)
    assert rows(layers.count_by_batch("bronze.events")) == [(B1, 2), (B2, 1)]
    assert layers.batch("bronze.events", B1).count() == 2


@pytest.mark.parametrize("source", ["events", "customers"])
def test_drift_columns_are_added_and_stop_at_bronze(spark, layers, source):
    key = "event_id" if source == "events" else "customer_id"
    drop_raw(layers.root, source, B1, [{key: "a", "updated_at": "2026-03-01T10:00:00Z"}])
    drop_raw(
        layers.root, source, B2, [{key: "b", "updated_at": "2026-08-01T10:00:00Z", "zeta": {"n": 1}, "app": "x"}]
    )
    for day in (B1, B2):
        load_bronze(layers, source, day)
    bronze = layers.read(f"bronze.{source}")
    known = schemas.TABLES[f"bronze.{source}"][0].fieldNames()
    assert bronze.columns == [*known, "app", "zeta"]
    text = json.dumps({"n": 1})
    assert rows(bronze, key, "app", "zeta") == [("a", None, None), ("b", "x", text)]
    if source == "events":
        assert typed_events(bronze).columns == schemas.SILVER_EVENTS.fieldNames()


def test_canonical_order():
    assert canonical_order(["z", "b", "a", "k"], ["k", "b"]) == ["k", "b", "a", "z"]


def test_malformed_text_becomes_null(spark):
    df = spark.createDataFrame([("nope", "x", "maybe"), ("2026-03-01T10:00:00.123456Z", "2026-03-01", "true")], "t string, d string, b string")
    typed = df.select(iso_timestamp("t").cast("string"), iso_date("d").cast("string"), truth("b"))
    assert rows(typed) == [(None, None, None), ("2026-03-01 10:00:00.123456", "2026-03-01", True)]


def load_events(layers, day, *records):
    drop_raw(layers.root, "events", day, records)
    load_bronze(layers, "events", day)
    load_silver_events(layers, day)


def test_correction_moves_a_row_to_its_batch_and_its_day(spark, layers):
    load_events(
        layers,
        B1,
        record("e1", "2026-03-01T10:00:00Z"),
        record("e2", "2026-03-02T10:00:00Z"),
        record("e1", "2026-03-01T09:00:00Z", "2026-03-01T09:00:00Z"),
    )
    before = layers.read("silver.events")
    load_events(layers, B2, record("e1", "2026-03-05T10:00:00Z", "2026-03-06T10:00:00Z"))
    day = F.date_format("occurred_at", "dd")
    expected = [("e1", B2, "05"), ("e2", B1, "02")]
    assert rows(layers.read("silver.events").select("event_id", "_batch_id", day)) == expected
    # The emptied day is gone, and a reader that started earlier still sees its rows.
    days = rows(layers.read("silver.events", physical=True).select(F.col("event_date").cast("string")))
    assert days == [("2026-03-02",), ("2026-03-05",)]
    assert before.count() == 2
    load_silver_events(layers, B1)
    load_silver_events(layers, B2)
    assert rows(layers.read("silver.events").select("event_id", "_batch_id", day)) == expected


def test_untouched_days_are_not_rewritten(spark, layers):
    load_events(layers, B1, record("e1", "2026-03-01T10:00:00Z"), record("e2", "2026-03-02T10:00:00Z"))
    kept = {f for f in layers.read("silver.events", physical=True).filter("event_date = '2026-03-02'").inputFiles()}
    load_events(layers, B2, record("e3", "2026-03-01T11:00:00Z"))
    silver = layers.read("silver.events", physical=True)
    assert kept <= set(silver.inputFiles())
    assert silver.count() == 3


def test_rows_without_a_time_have_a_place(spark, layers):
    load_events(layers, B1, record("e1", "nope", "2026-03-02T10:00:00Z"), record("e2", "2026-03-02T10:00:00Z"))
    assert rows(layers.read("silver.events"), "event_id") == [("e1",), ("e2",)]
    load_events(layers, B2, record("e1", "2026-03-03T10:00:00Z", "2026-03-04T10:00:00Z"))
    assert layers.read("silver.events").filter("occurred_at is null").count() == 0


def test_event_day_filter_prunes_partitions(spark, layers):
    load_events(layers, B1, record("e1", "2026-03-01T10:00:00Z"), record("e2", "2026-03-02T10:00:00Z"))
    plan = layers.read("silver.events", physical=True).filter("event_date >= date'2026-03-02'")
    assert "PartitionFilters: [isnotnull(event_date" in plan._jdf.queryExecution().executedPlan().toString()


# -- extract ------------------------------------------------------------------------


def text_feed(spark, *pairs):
    return spark.createDataFrame(list(pairs), "event_id string, updated_at string")


def test_boundary_is_strict_and_missing_times_are_dropped(spark):
    df = text_feed(spark, ("a", "2026-03-01T00:00:00Z"), ("b", "2026-03-01T00:00:01Z"), ("c", None))
    assert rows(changed_since(df, "2026-03-01T00:00:00Z"), "event_id") == [("b",)]
    assert rows(changed_since(df, None), "event_id") == [("a",), ("b",)]


def test_extract_filter_reaches_the_scan(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    plan = changed_since(orders, "2001-01-01T00:00:00", "o_orderdate").select("o_orderkey", "o_orderdate")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_orderdate" in text
    assert "o_totalprice" not in text


def test_marks_of_sources_are_independent(spark, layers):
    assert read_watermark(layers, "events") is None
    write_watermark(layers, "events", "2026-03-11T14:00:00Z")
    write_watermark(layers, "customers", "2026-03-10T09:00:00Z")
    write_watermark(layers, "events", "2026-03-12T00:00:00Z")
    assert read_watermark(layers, "events") == "2026-03-12T00:00:00Z"
    assert read_watermark(layers, "customers") == "2026-03-10T09:00:00Z"
    assert read_watermark(layers, "other") is None
    assert layers.read("control.watermarks").filter("updated_at is not null").count() == 2


def test_unreadable_marks_mean_a_first_run(spark, layers):
    write_watermark(layers, "events", "2026-03-11T14:00:00Z")
    broken = f"{layers.root}/broken"
    spark.createDataFrame([("{not json",)], "value string").write.text(broken)
    spark.sql(f"ALTER TABLE {layers.name('control.watermarks')} SET LOCATION '{broken}'")
    assert read_watermark(layers, "events") is None


def test_second_pass_extracts_nothing(spark, layers):
    df = text_feed(spark, ("a", "2026-03-01T00:00:00Z"), ("b", "2026-03-01T00:00:01Z"))
    assert ingest_source(layers, "events", feed_of(df), B1)
    stored = files(f"{layers.root}/raw")
    assert not ingest_source(layers, "events", feed_of(df), B1)
    assert files(f"{layers.root}/raw") == stored
    assert read_watermark(layers, "events") == "2026-03-01T00:00:01Z"
    assert any(name.endswith(".json.gz") for name in stored)


def test_second_extract_of_a_day_adds_to_the_first(spark, layers):
    early = text_feed(spark, ("a", "2026-03-01T00:00:00Z"))
    late = early.unionByName(text_feed(spark, ("b", "2026-03-01T00:00:01Z")))
    for df in (early, late):
        ingest_source(layers, "events", feed_of(df), B1)
        load_bronze(layers, "events", B1)
    assert rows(layers.read("bronze.events"), "event_id") == [("a",), ("b",)]


def test_empty_extract_writes_nothing(spark, layers):
    empty = text_feed(spark, ("a", None))
    done = ingest(layers, Feeds(feed_of(empty), feed_of(empty)), B1)
    assert done == {"events": False, "customers": False}
    assert not os.path.exists(f"{layers.root}/raw")


def test_customer_extract_keeps_microseconds(spark):
    df = spark.createDataFrame(
        [("c1", "2026-03-01 10:00:00.123456"), ("c2", "2026-03-01 10:00:00")], "customer_id string, at string"
    ).select(
        "customer_id",
        *[F.lit("x").alias(c) for c in ("company_name", "plan", "segment", "country", "other")],
        F.lit("2026-01-01").cast("date").alias("signup_date"),
        F.lit(True).alias("is_active"),
        F.col("at").cast("timestamp").alias("updated_at"),
    )
    out = customer_extract(df, "2026-03-01T10:00:00Z")
    assert out.columns[0] == "customer_id" and "other" not in out.columns
    assert rows(out, "customer_id", "signup_date", "updated_at") == [("c1", "2026-01-01", "2026-03-01T10:00:00.123456Z")]


def test_jdbc_options():
    plain = jdbc_options("jdbc:x", "crm.customers")
    assert plain == {"url": "jdbc:x", "dbtable": "crm.customers", "fetchsize": "10000"}
    split = jdbc_options("jdbc:x", "t", "updated_at", "2026-01-01", "2026-02-01", 16, user="u")
    assert (split["numPartitions"], split["partitionColumn"], split["user"]) == ("16", "updated_at", "u")
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", "t", "updated_at")


# -- tables -------------------------------------------------------------------------


def test_create_is_repeatable_and_inspectable(spark, layers):
    layers.create_all()
    layers.create_all()
    assert len(layers.tables()) == len(schemas.TABLES)
    assert layers.describe("silver.customers").filter("col_name = 'is_current'").count() >= 1
    counts = {r["table_name"]: r["rows"] for r in layers.row_counts().collect()}
    assert set(counts.values()) == {0}
    assert layers.preview("gold.response_time").columns == schemas.RESPONSE_TIME.fieldNames()


def test_two_sets_of_tables_do_not_mix(spark, layers, tmp_path):
    other = Layers(spark, str(tmp_path / "other"), prefix="other_")
    write_watermark(layers, "events", "a")
    assert read_watermark(other, "events") is None


def test_swap_may_read_the_table_itself(spark, layers):
    layers.create("control.watermarks")
    write_watermark(layers, "events", "a")
    same = layers.read("control.watermarks")
    layers.swap("control.watermarks", same.unionByName(same))
    assert layers.read("control.watermarks").count() == 2
    assert same.count() == 1


def test_export_keeps_microseconds(spark, tmp_path):
    df = spark.sql("select 'a\tb' s, timestamp'2026-03-01 10:00:00.123456' t, 1.5d x")
    export_delimited(df, str(tmp_path / "out"))
    back = read_delimited(spark, str(tmp_path / "out"), df.schema)
    assert rows(back) == rows(df)
    with open([f for f in files(str(tmp_path / "out")) if f.endswith(".csv")][0], encoding="utf-8") as out:
        assert out.readline() == "s\tt\tx\n"


def test_batch_ids_are_checked(spark, layers):
    layers.create("bronze.events")
    with pytest.raises(ValueError):
        layers.replace_batch("bronze.events", layers.read("bronze.events"), "x'; drop")


# -- stream -------------------------------------------------------------------------


def test_stream_handles_each_file_once_and_then_idles(spark, layers):
    layers.create("silver.events")
    checkpoint = f"{layers.root}/checkpoint"
    drop_raw(layers.root, "events", B1, [record("e1", "2026-03-01T10:00:00Z"), record("e2", "2026-03-01T10:00:00Z")])
    assert stream_events(layers, checkpoint).lastProgress["batchId"] == 0
    drop_raw(layers.root, "events", B2, [record("e1", "2026-03-02T10:00:00Z", channel="app")])
    stream_events(layers, checkpoint)
    expected = [("e1", "app", B2), ("e2", "web", B1)]
    assert rows(layers.read("silver.events"), "event_id", "channel", "_batch_id") == expected
    before = files(f"{layers.root}/silver")
    stream_events(layers, checkpoint)
    assert files(f"{layers.root}/silver") == before


def test_a_repeated_micro_batch_changes_nothing(spark, layers):
    layers.create("silver.events")
    drop_raw(layers.root, "events", B1, [record("e1", "2026-03-01T10:00:00Z")])
    stream_events(layers, f"{layers.root}/first")
    once = rows(layers.read("silver.events").drop("_ingested_at"))
    stream_events(layers, f"{layers.root}/second")
    assert rows(layers.read("silver.events").drop("_ingested_at")) == once
