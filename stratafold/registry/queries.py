"""One callable per operator: (session, folder of the tables) -> DataFrame."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratafold import domains, schemas
from stratafold.functions import (
    canonical_order,
    iso_date,
    iso_timestamp,
    json_attribute,
    lineage,
    truth,
    utc_text,
)
from stratafold.operators import quality
from stratafold.operators.dedup import keep_latest
from stratafold.operators.matching import first_response
from stratafold.operators.merge import insert_if_absent, newest_wins
from stratafold.operators.pit import pit_join
from stratafold.operators.scd2 import (
    apply_one_pass,
    apply_two_step,
    close_superseded,
    rebuild,
    stamp_versions,
)
from stratafold.plans import delivery, marts
from stratafold.plans.gate import log_results
from stratafold.plans.medallion import backfill, run_batch
from stratafold.plans.silver import held_days, load_silver_customers, load_silver_events, with_day
from stratafold.registry import faults, kept
from stratafold.registry import fixtures as fx
from stratafold.session import new_folder, staged
from stratafold.sources import landing
from stratafold.sources.ingest import feed_of, ingest_source
from stratafold.sources.layers import export_delimited, read_delimited, register_view
from stratafold.sources.relational import changed_since, high_water_mark
from stratafold.sources.watermarks import read_watermark, write_watermark
from stratafold.streaming.silver_stream import stream_events

WINDOW_DAYS = 365
BATCH_DAY = "2024-01-20"
SPLIT_DAY = "1998-01-01"

HISTORY = ("customer_id", "plan", "o_orderkey", "updated_at")


def _history_rows(history: DataFrame) -> DataFrame:
    return history.select(*HISTORY, "valid_from", fx.text_time("valid_to"), "is_current")


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Order versions before the split day, and from it on."""
    versions = fx.order_versions(spark, sf_dir)
    early = F.col("updated_at") < F.lit(SPLIT_DAY).cast("timestamp_ntz")
    return versions.filter(early), versions.filter(~early)


# -- history ------------------------------------------------------------------------


def scd2_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history_rows(fx.order_history(spark, sf_dir))


def scd2_tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History that opens a version only when the plan changes."""
    versions = fx.order_versions(spark, sf_dir)
    return _history_rows(rebuild(versions, "customer_id", track=["plan"]))


def scd2_two_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches applied one after the other give the history of all versions."""
    early, late = _split(spark, sf_dir)
    return _history_rows(apply_one_pass(rebuild(early, "customer_id"), late, "customer_id"))


def scd2_one_pass_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late rows that two-step merges left open are put in their place by one pass."""
    early, late = _split(spark, sf_dir)
    dirty = apply_two_step(stamp_versions(late), early, "customer_id")
    return _history_rows(apply_one_pass(dirty, early.unionByName(late), "customer_id"))


def scd2_two_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Close and insert as two merges: the early history and each customer's last version."""
    early, late = _split(spark, sf_dir)
    last = keep_latest(late, ["customer_id"], "updated_at")
    return _history_rows(apply_two_step(rebuild(early, "customer_id"), last, "customer_id"))


def scd2_stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history_rows(stamp_versions(fx.order_versions(spark, sf_dir)))


def close_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Early history closed by each customer's last later version."""
    early, late = _split(spark, sf_dir)
    last = stamp_versions(keep_latest(late, ["customer_id"], "updated_at"))
    return _history_rows(close_superseded(rebuild(early, "customer_id"), last, "customer_id"))


def insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Early versions plus those of all versions that are not among them."""
    early, _ = _split(spark, sf_dir)
    everything = fx.order_versions(spark, sf_dir)
    return insert_if_absent(early, everything, ["customer_id", "updated_at"]).select(*HISTORY)


# -- dedup and upsert ---------------------------------------------------------------

LINE = ["l_orderkey", "l_linenumber"]
LINE_TIES = ("l_partkey", "l_suppkey", "l_extendedprice")
LINE_COLUMNS = [*LINE, "l_partkey", "l_suppkey", "l_extendedprice", "l_linestatus", "l_shipdate"]


def _latest_lines(lines: DataFrame) -> DataFrame:
    return keep_latest(lines.select(*LINE_COLUMNS), LINE, "l_shipdate", [F.col(c).desc() for c in LINE_TIES])


def dedup_keep_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest_lines(fx.table(spark, sf_dir, "lineitem"))


def upsert_newest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished lines as the table, open lines as the batch."""
    lines = fx.table(spark, sf_dir, "lineitem")
    target = _latest_lines(lines.filter(F.col("l_linestatus") == "F"))
    source = _latest_lines(lines.filter(F.col("l_linestatus") == "O"))
    return newest_wins(target, source, LINE, "l_shipdate")


# -- point in time ------------------------------------------------------------------

PIT_COLUMNS = ("customer_id", "l_orderkey", "l_linenumber", "l_partkey", "occurred_at", "plan", "valid_from")


def _pit(spark: SparkSession, sf_dir: str, **how: str) -> DataFrame:
    facts = fx.shipments(spark, sf_dir).drop("_customer_exists")
    versions = fx.order_history(spark, sf_dir).select("customer_id", "plan", "valid_from", "valid_to")
    return pit_join(facts, versions, "customer_id", "occurred_at", **how).select(*PIT_COLUMNS)


def pit_join_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pit(spark, sf_dir)


def pit_join_half_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pit(spark, sf_dir, bounds="half_open")


def pit_join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipments before the first version stay, without a plan."""
    return _pit(spark, sf_dir, bounds="half_open", how="left")


def pit_join_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders open for a month or for ever at the time of each supplier's visit: many overlapping versions of few keys."""
    orders = fx.table(spark, sf_dir, "orders")
    start = F.col("o_orderdate").cast("timestamp_ntz")
    ends = F.when(F.col("o_orderkey") % 20 == 0, F.lit(domains.OPEN_END).cast("timestamp_ntz"))
    versions = orders.select(
        F.col("o_orderpriority").alias("priority"),
        "o_orderkey",
        start.alias("valid_from"),
        F.coalesce(ends, start + F.expr("INTERVAL 30 DAYS")).alias("valid_to"),
    )
    names = F.array(*[F.lit(p) for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "no such")])
    visits = fx.table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        F.element_at(names, (F.col("s_suppkey") % 6 + 1).cast("int")).alias("priority"),
        F.expr("timestamp_ntz'1992-01-01 00:00:00' + make_dt_interval(cast(s_suppkey * 7 % 2500 as int))").alias("at"),
    )
    met = pit_join(visits, versions, "priority", "at", how="left", totals="o_orderkey")
    return met.groupBy("s_suppkey").agg(
        F.sum("n").alias("orders"), F.min("least").alias("least"), F.max("greatest").alias("greatest")
    )


# -- marts and deliveries -----------------------------------------------------------


def top_customers_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.top_customers(fx.shipments(spark, sf_dir), fx.named_history(spark, sf_dir), WINDOW_DAYS)


def delivery_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.top_customers(top_customers_window(spark, sf_dir))


def top_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.top_share(top_customers_window(spark, sf_dir), fx.shipments(spark, sf_dir), WINDOW_DAYS)


def ticket_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every opened ticket with its first reply and the minutes in between."""
    events = fx.silver_events(spark, sf_dir).withColumn(
        "ticket_id", json_attribute("properties", "ticket_id")
    )
    opened = events.filter(F.col("event_type") == domains.OPENED)
    replies = events.filter(F.col("event_type") == domains.REPLIED)
    matched = first_response(
        opened.select("event_id", "ticket_id", "occurred_at"),
        replies.select("ticket_id", "occurred_at"),
        "ticket_id",
        "occurred_at",
    )
    minutes = F.col("response_minutes").cast("double").alias("response_minutes")
    return matched.select("event_id", "ticket_id", "occurred_at", "first_reply_at", minutes)


def first_response_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.response_time(fx.silver_events(spark, sf_dir), fx.silver_customers(spark, sf_dir))


def delivery_response_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.response_time(first_response_time(spark, sf_dir))


def cohort_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohort = month of the first order, activity = month of any order."""
    orders = fx.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").alias("occurred_at")
    )
    customers = orders.groupBy("customer_id").agg(
        F.min("occurred_at").alias("signup_date"), F.lit(True).alias("is_current")
    )
    return marts.cohort_retention(orders.withColumn("_customer_exists", F.lit(True)), customers)


def delivery_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.retention(cohort_retention(spark, sf_dir))


def events_by_month_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A projected view of events, grouped in SQL by a month expression and the type."""
    register_view(
        fx.table(spark, sf_dir, "events"), "stratafold_events", ["ts", "event_type", "user_id", "value"]
    )
    return spark.sql(
        """
        SELECT date_format(ts, 'yyyy-MM') AS month, event_type, count(*) AS events,
               count(DISTINCT user_id) AS users, round(avg(value), 6) AS avg_value
        FROM stratafold_events
        GROUP BY date_format(ts, 'yyyy-MM'), event_type
        """
    )


# -- quality ------------------------------------------------------------------------

FIXTURE_TYPES = ("click", "view", "purchase")


def check_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.surplus_keys(fx.table(spark, sf_dir, "lineitem"), LINE)


def check_referential(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, suppliers = fx.table(spark, sf_dir, "events"), fx.table(spark, sf_dir, "supplier")
    return quality.missing_references(events, suppliers, "user_id", "s_suppkey")


def _daily_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fx.table(spark, sf_dir, "events").withColumn("_batch_id", F.date_format("ts", "yyyy-MM-dd"))
    return quality.batch_profile(events, at="ts", legal=FIXTURE_TYPES)


def batch_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily_profile(spark, sf_dir)


def check_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.volume_deviation(_daily_profile(spark, sf_dir), BATCH_DAY)
    return found.select(
        "volume",
        F.round("average", 6).alias("average"),
        F.round("deviation_pct", 2).alias("deviation_pct"),
    )


def check_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with an illegal event type and with an illegal order status."""
    events = fx.table(spark, sf_dir, "events").agg(
        F.count_if(quality.outside("event_type", FIXTURE_TYPES)).alias("illegal")
    )
    orders = fx.table(spark, sf_dir, "orders").agg(
        F.count_if(quality.outside("o_orderstatus", ("F", "O"))).alias("illegal")
    )
    tagged = events.withColumn("domain", F.lit("event_type")).unionByName(
        orders.withColumn("domain", F.lit("o_orderstatus"))
    )
    return tagged.select("domain", "illegal")


def check_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lag of each day's events when every batch is dated one day after its day."""
    events = fx.table(spark, sf_dir, "events")
    dated = events.withColumn("_batch_id", F.date_format(F.date_add("ts", 1), "yyyy-MM-dd"))
    profile = quality.batch_profile(dated, at="ts", legal=FIXTURE_TYPES)
    return quality.freshness_lag(profile, "2024-01-21")


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(fx.silver_events(spark, sf_dir), fx.silver_customers(spark, sf_dir), BATCH_DAY)


def _logged_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = fx.scratch_layers(spark, "audit")
    events, customers = fx.silver_events(spark, sf_dir), fx.silver_customers(spark, sf_dir)
    for day in ("2024-01-19", BATCH_DAY):
        log_results(layers, quality.report(events, customers, day))
    return layers.read("quality.check_results")


AUDIT = ("check_name", "severity", "status", "metric_value", "threshold_value", "batch_id")


def latest_audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five log rows after the checks of two days: those of the second."""
    return quality.latest_rows(_logged_twice(spark, sf_dir)).select(*AUDIT)


def failed_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.failed_rows(_logged_twice(spark, sf_dir)).select(*AUDIT)


# -- extract and control ------------------------------------------------------------


def incremental_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = fx.table(spark, sf_dir, "orders")
    fresh = changed_since(orders, "2001-01-01T00:00:00", "o_orderdate")
    return fresh.select("o_orderkey", "o_custkey", utc_text("o_orderdate", "second").alias("updated_at"))


def extract_mixed_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text times with and without a fraction, against a mark without one."""
    fraction = F.when(F.col("o_orderkey") % 2 == 0, "Z").otherwise(".500000Z")
    at = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), fraction)
    orders = fx.table(spark, sf_dir, "orders").withColumn("updated_at", at)
    return changed_since(orders, "2001-01-01T00:00:00Z").select("o_orderkey", "updated_at")


def high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = [
        high_water_mark(fx.table(spark, sf_dir, name), column).select(
            F.lit(name).alias("source"), utc_text("last_updated_at").alias("last_updated_at")
        )
        for name, column in (("events", "ts"), ("orders", "o_orderdate"))
    ]
    return marks[0].unionByName(marks[1])


def watermark_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of two sources, one moved afterwards; each is taken from a whole table."""
    layers = fx.scratch_layers(spark, "marks")
    marks = {row["source"]: row["last_updated_at"] for row in high_water(spark, sf_dir).collect()}
    write_watermark(layers, "events", domains.FIRST_RUN)
    write_watermark(layers, "orders", marks["orders"])
    write_watermark(layers, "events", marks["events"])
    return layers.read("control.watermarks").select("source", "last_updated_at")


def ingest_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two passes over one feed: the second finds nothing and leaves raw rows and mark alone."""
    layers = fx.scratch_layers(spark, "ingest")
    feed = feed_of(fx.raw_events(spark, sf_dir))
    passes = [ingest_source(layers, "events", feed, BATCH_DAY) for _ in range(2)]
    raw = landing.read_raw(spark, layers.root, "events", BATCH_DAY, schemas.RAW_EVENTS)
    return raw.agg(F.count("*").alias("raw_rows")).select(
        "raw_rows",
        F.lit(passes[0]).alias("first_pass"),
        F.lit(passes[1]).alias("second_pass"),
        F.lit(read_watermark(layers, "events")).alias("mark"),
    )


def raw_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events through gzip JSON lines and back, microseconds and nested text included."""
    events = fx.table(spark, sf_dir, "events")
    saved = landing.save_raw(events, new_folder(spark, "raw"), "events", BATCH_DAY, updated_at="ts")
    return landing.read_json(spark, saved.folder, events.schema)


def batch_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches of raw events, the middle one written again; rows by batch."""
    layers = fx.scratch_layers(spark, "batches")
    layers.create("bronze.events")
    raw = staged(fx.raw_events(spark, sf_dir), "feed")
    borders = ("2024-01-11", "2024-01-21", "2024-02-01")
    for batch_id in (*borders, borders[1]):
        first = max((b for b in borders if b < batch_id), default="")
        rows = raw.filter((F.col("updated_at") >= first) & (F.col("updated_at") < batch_id))
        layers.replace_batch(
            "bronze.events", rows.withColumns(lineage(batch_id, "events")), batch_id
        )
    return layers.count_by_batch("bronze.events")


def drift_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second batch brings a new field; rows of the first hold NULL there."""
    layers = fx.scratch_layers(spark, "drift")
    layers.create("bronze.events")
    raw = staged(fx.raw_events(spark, sf_dir), "feed")
    early = F.col("updated_at") < F.lit("2024-01-16")
    wider = raw.filter(~early).withColumn("source_app", F.concat(F.lit("app-"), F.col("channel")))
    for batch_id, rows in (("2024-01-16", raw.filter(early)), ("2024-02-01", wider)):
        rows = rows.withColumns(lineage(batch_id, "events"))
        ordered = rows.select(*canonical_order(rows.columns, schemas.BRONZE_EVENTS.fieldNames()))
        layers.replace_batch("bronze.events", ordered, batch_id)
    rows = layers.read("bronze.events")
    return rows.groupBy("_batch_id", "source_app").agg(F.count("*").alias("rows"))


def lineage_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    run_at = datetime.fromisoformat("2024-02-01T00:00:00+00:00")
    stamped = fx.raw_events(spark, sf_dir).withColumns(lineage("2024-02-01", "raw/events/", run_at))
    return stamped.select(
        "event_id", "updated_at", "_batch_id", "_source_file", fx.text_time("_ingested_at")
    )


def typed_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text to typed values over all orders; the text is malformed for open orders."""
    broken = F.col("o_orderstatus") == "O"
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    text = fx.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(broken, "nope").otherwise(iso).alias("at"),
        F.when(broken, "2024-13-45").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"),
        F.when(broken, "maybe").otherwise((F.col("o_totalprice") > 200000).cast("string")).alias("flag"),
    )
    return text.select(
        "o_orderkey",
        iso_timestamp("at").cast("timestamp_ntz").alias("at"),
        iso_date("day").alias("day"),
        truth("flag").alias("flag"),
    )


def orphan_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fx.silver_events(spark, sf_dir)
    return events.groupBy("_customer_exists").agg(
        F.count("*").alias("events"), F.count_distinct("customer_id").alias("customers")
    )


# -- tables -------------------------------------------------------------------------


def layer_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of all layer tables, created and then filled with the Silver events."""
    layers = fx.scratch_layers(spark, "catalog")
    layers.create_all()
    events = fx.silver_events(spark, sf_dir).withColumns(lineage(BATCH_DAY, "events"))
    for column in ("occurred_at", "updated_at"):
        events = events.withColumn(column, F.col(column).cast("timestamp"))
    days = [row[0] for row in with_day(events).select("event_date").distinct().collect()]
    layers.swap_partitions("silver.events", with_day(events), days)
    filled = layers.row_counts().select("table_name", "rows")
    return layers.columns().join(filled, "table_name")


def partitioned_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events stored by day; the slice of a range of days reads only their partitions."""
    events = fx.table(spark, sf_dir, "events")
    folder = new_folder(spark, "by-day")
    dated = events.withColumn("event_date", F.to_date("ts")).hint("rebalance", "event_date")
    dated.write.partitionBy("event_date").parquet(folder)
    schema = T.StructType([*events.schema, T.StructField("event_date", T.DateType(), True)])
    stored = spark.read.schema(schema).parquet(folder)
    days = [F.lit(day).cast("date") for day in ("2024-01-10", "2024-01-19")]
    return stored.filter(F.col("event_date").between(*days))


def overwrite_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mart written twice holds the rows of the second write only."""
    layers = fx.scratch_layers(spark, "mart")
    layers.create("gold.cohort_retention")
    mart = cohort_retention(spark, sf_dir).withColumn("_generated_at", F.current_timestamp())
    layers.swap("gold.cohort_retention", mart.filter(F.col("retention_pct") > 50))
    layers.swap("gold.cohort_retention", mart)
    return layers.read("gold.cohort_retention").drop("_generated_at")


def export_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mart through tab-separated text with a header."""
    mart = delivery_response_pct(spark, sf_dir)
    folder = new_folder(spark, "export")
    export_delimited(mart, folder)
    return read_delimited(spark, folder, mart.schema)


# -- runs ---------------------------------------------------------------------------


def gated_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches, each run twice; row counts of every layer table afterwards."""
    layers = fx.scratch_layers(spark, "gated")
    for day, drift in (("2024-01-16", False), ("2024-01-31", True)):
        feeds = fx.feeds_until(spark, sf_dir, day, drift)
        for _ in range(2):
            run_batch(layers, feeds, day)
    return layers.row_counts()


def backfill_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replay of three dates, given out of order; the response mart at the end."""
    layers = fx.scratch_layers(spark, "backfill")
    days = ("2024-01-31", "2024-01-16", "2024-01-23")
    backfill(layers, lambda day: fx.feeds_until(spark, sf_dir, day), days, history_mode="one_pass")
    return delivery.response_time(layers.read("gold.response_time"))


def stream_to_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw files in two drops through the stream; a third run finds nothing."""
    layers = fx.scratch_layers(spark, "stream")
    layers.create("silver.events")
    checkpoint = f"{layers.root}/checkpoint"
    raw = staged(fx.raw_events(spark, sf_dir), "feed")
    early = F.col("updated_at") < F.lit("2024-01-16")
    for day, drop in (("2024-01-16", raw.filter(early)), ("2024-02-01", raw.filter(~early))):
        landing.save_raw(drop, layers.root, "events", day)
        stream_events(layers, checkpoint)
    stream_events(layers, checkpoint)
    return layers.read("silver.events").select(
        "event_id",
        "customer_id",
        "event_type",
        F.col("occurred_at").cast("timestamp_ntz").alias("occurred_at"),
        F.col("updated_at").cast("timestamp_ntz").alias("updated_at"),
        "channel",
        "_batch_id",
    )


def silver_upsert_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two Bronze batches upserted into Silver, corrections moving rows to another day."""
    layers = fx.scratch_layers(spark, "upsert")
    layers.create("bronze.events")
    raw = staged(fx.raw_events(spark, sf_dir), "feed")
    early = F.col("updated_at") < F.lit("2024-01-16")
    for day, rows in (("2024-01-16", raw.filter(early)), ("2024-02-01", raw.filter(~early))):
        layers.replace_batch("bronze.events", rows.withColumns(lineage(day, "events")), day)
        load_silver_events(layers, day)
    rows = layers.read("silver.events", physical=True)
    return rows.groupBy("event_date", "channel", "_batch_id").agg(F.count("*").alias("rows"))


def history_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three Bronze batches of customers through the bucketed history: moves before first versions, then one again."""
    layers = fx.scratch_layers(spark, "buckets")
    layers.create("bronze.customers")
    feed = fx.raw_customers(spark, sf_dir).withColumn("is_active", F.col("is_active").cast("string"))
    raw = staged(feed, "feed")
    moved = F.col("updated_at") > F.lit("2024-01-02")
    small = moved & F.col("customer_id").endswith("11")
    for day, rows in (("2024-01-16", raw.filter(moved)), ("2024-01-17", raw.filter(~moved)), ("2024-01-18", raw.filter(small))):
        layers.replace_batch("bronze.customers", rows.withColumns(lineage(day, "customers")), day)
        load_silver_customers(layers, day)
    return layers.read("silver.customers").select(
        "customer_id",
        "plan",
        F.col("valid_from").cast("timestamp_ntz").alias("valid_from"),
        fx.text_time("valid_to"),
        "is_current",
    )


def upsert_touched_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days of events that a batch of late corrections and new ids meets, through the key filter."""
    events = with_day(fx.silver_events(spark, sf_dir))
    late = events.filter(F.dayofmonth("occurred_at") == 7).select("event_id")
    fresh = events.select(F.concat(F.lit("new"), "event_id").alias("event_id"))
    batch = staged(late.unionByName(fresh), "corrections")
    held = held_days(events, batch, broadcast_bytes=0)
    return held.groupBy(schemas.EVENT_DATE).agg(F.count("*").alias("rows"))


QUERIES = {
    f.__name__: f
    for f in (
        scd2_history,
        scd2_tracked,
        scd2_two_batches,
        scd2_one_pass_repair,
        scd2_two_step,
        scd2_stamped,
        close_versions,
        dedup_keep_latest,
        upsert_newest_wins,
        pit_join_closed,
        pit_join_half_open,
        pit_join_left,
        pit_join_overlapping,
        top_customers_window,
        delivery_top,
        top_share,
        ticket_matching,
        first_response_time,
        delivery_response_pct,
        cohort_retention,
        delivery_retention,
        events_by_month_type,
        check_uniqueness,
        check_referential,
        batch_profile,
        check_volume,
        check_domains,
        check_freshness,
        quality_report,
        latest_audit_rows,
        failed_checks,
        incremental_extract,
        extract_mixed_precision,
        watermark_upsert,
        ingest_step,
        raw_roundtrip,
        batch_replace,
        drift_append,
        lineage_columns,
        typed_parse,
        orphan_flag,
        layer_catalog,
        partitioned_slice,
        overwrite_mart,
        gated_run,
        backfill_range,
        stream_to_silver,
        silver_upsert_by_day,
        upsert_touched_days,
        history_by_bucket,
    )
} | {
    "insert_if_absent": insert_absent,
    "high_water_mark": high_water,
    "export_delimited": export_mart,
} | faults.QUERIES | kept.QUERIES
