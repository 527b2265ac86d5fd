"""Layer-shaped relations derived from the star-schema and event tables.

Every function reads whole tables; nothing is sampled or cut.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafold.functions import json_attribute, utc_text
from stratafold.operators.dedup import keep_latest
from stratafold.operators.scd2 import rebuild
from stratafold.session import new_folder, staged
from stratafold.sources.ingest import Feeds, feed_of
from stratafold.sources.layers import Layers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Months, days and ISO text depend on the session time zone.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_time(name: str) -> Column:
    """A timestamp as text, for ends of time beyond the range of some readers."""
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def scratch_layers(spark: SparkSession, label: str) -> Layers:
    """A new set of layer tables in the shared folder."""
    return Layers(spark, new_folder(spark, label), prefix=f"t{uuid.uuid4().hex[:12]}_")


# -- customer history from orders ---------------------------------------------------


def order_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One version per customer and order day; the highest order key wins."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderpriority").alias("plan"),
        F.col("o_orderdate").alias("updated_at"),
        "o_orderkey",
    )
    return keep_latest(orders, ["customer_id", "updated_at"], "o_orderkey")


def order_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuild(order_versions(spark, sf_dir), "customer_id")


def named_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order history with the customer's name and segment."""
    names = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("company_name"),
        F.col("c_mktsegment").alias("segment"),
    )
    return order_history(spark, sf_dir).join(names, "customer_id")


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as events of the ordering customer at the day of shipment."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("customer_id"))
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_shipdate").alias("occurred_at")
    )
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
        "customer_id", "l_orderkey", "l_linenumber", "l_partkey", "occurred_at", F.lit(True).alias("_customer_exists")
    )


# -- typed events and customers -----------------------------------------------------

EVENT_NAMES = {
    "error": "ticket_opened",
    "click": "ticket_replied",
    "view": "page_view",
    "purchase": "purchase",
    "signup": "login",
}
PLAN_OF_SEGMENT = {
    "AUTOMOBILE": "enterprise",
    "BUILDING": "pro",
    "FURNITURE": "free",
    "HOUSEHOLD": "free",
    "MACHINERY": "pro",
}
# Events above this value are anonymous.
ANONYMOUS_ABOVE = 100.0


def _renamed(column: str, names: dict[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return pairs[F.col(column)]


def silver_events(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Events in Silver columns; the batch is the day, tickets are (user, k).

    ``dealt`` spreads the rows of a file with few row groups over all tasks.
    """
    ticket = F.concat_ws("-", "user_id", json_attribute("props", "k"))
    customer = F.when(F.col("value") <= ANONYMOUS_ABOVE, F.col("user_id").cast("string"))
    events = table(spark, sf_dir, "events")
    events = events.hint("repartition") if dealt else events
    return events.select(
        F.col("event_id").cast("string").alias("event_id"),
        customer.alias("customer_id"),
        _renamed("event_type", EVENT_NAMES).alias("event_type"),
        F.col("ts").alias("occurred_at"),
        F.col("ts").alias("updated_at"),
        F.lit("web").alias("channel"),
        F.to_json(F.struct(ticket.alias("ticket_id"))).alias("properties"),
        customer.isNotNull().alias("_customer_exists"),
        F.date_format("ts", "yyyy-MM-dd").alias("_batch_id"),
    )


def silver_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as one open version each; the segment names the plan."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("customer_id"),
        F.col("c_name").alias("company_name"),
        _renamed("c_mktsegment", PLAN_OF_SEGMENT).alias("plan"),
        F.col("c_mktsegment").alias("segment"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("valid_from"),
        F.lit("9999-12-31T23:59:59").cast("timestamp_ntz").alias("valid_to"),
        F.lit(True).alias("is_current"),
    )


# -- raw feeds ----------------------------------------------------------------------


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All event records a feed ever shows, in text columns.

    Purchases of 2024-01-15 come a second time, five days newer, on another channel
    and moved to the next day.
    """
    first = silver_events(spark, sf_dir, dealt=True).select(
        "event_id", "customer_id", "event_type", "occurred_at", "updated_at", "channel", "properties"
    )
    wrong = (F.col("event_type") == "purchase") & (F.to_date("occurred_at") == F.lit("2024-01-15").cast("date"))
    again = first.filter(wrong).withColumns(
        {
            "occurred_at": F.col("occurred_at") + F.expr("INTERVAL 1 DAY"),
            "updated_at": F.col("updated_at") + F.expr("INTERVAL 5 DAYS"),
            "channel": F.lit("corrected"),
        }
    )
    return first.unionByName(again).withColumns(
        {"occurred_at": utc_text("occurred_at"), "updated_at": utc_text("updated_at")}
    )


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customer records: one each from the start, and a move to the enterprise plan
    on 2024-01-16 for those with a negative balance."""
    signup = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_order"))
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    customers = table(spark, sf_dir, "customer")
    first = (
        customers.join(signup, F.col("c_custkey") == F.col("o_custkey"), "left")
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.col("c_custkey").cast("string").alias("customer_id"),
            F.col("c_name").alias("company_name"),
            _renamed("c_mktsegment", PLAN_OF_SEGMENT).alias("plan"),
            F.col("c_mktsegment").alias("segment"),
            F.date_format("first_order", "yyyy-MM-dd").alias("signup_date"),
            F.col("n_name").alias("country"),
            (F.col("c_acctbal") >= 0).alias("is_active"),
            F.lit("2024-01-01T00:00:00.000000Z").alias("updated_at"),
        )
    )
    moved = first.filter(~F.col("is_active")).withColumns(
        {"plan": F.lit("enterprise"), "updated_at": F.lit("2024-01-16T00:00:00.000000Z")}
    )
    return first.unionByName(moved)


def feeds_until(spark: SparkSession, sf_dir: str, day: str, drift: bool = False) -> Feeds:
    """The feeds as they look at the start of ``day``; with drift, events carry a new field."""
    seen = F.col("updated_at") < F.lit(day)
    events = raw_events(spark, sf_dir).filter(seen)
    if drift:
        events = events.withColumn("source_app", F.concat(F.lit("app-"), F.col("channel")))
    events = staged(events, "feed")
    return Feeds(feed_of(events), feed_of(raw_customers(spark, sf_dir).filter(seen)))
