"""Delivery queries over the marts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold import domains
from stratafold.functions import percent
from stratafold.plans.marts import trailing_events


def top_customers(mart: DataFrame) -> DataFrame:
    return mart.select("customer_id", "company_name", "plan", "segment", "total_events").orderBy(
        F.col("total_events").desc(), "customer_id", "plan"
    )


def response_time(mart: DataFrame, group: str = "plan") -> DataFrame:
    """The response mart with the share of unanswered tickets, one decimal."""
    tickets = F.col("answered_tickets") + F.col("unanswered_tickets")
    return mart.select(
        group,
        "month",
        "avg_response_minutes",
        "answered_tickets",
        "unanswered_tickets",
        percent(F.col("unanswered_tickets"), tickets, 1).alias("unanswered_pct"),
    ).orderBy("month", group)


def retention(mart: DataFrame) -> DataFrame:
    return mart.select(
        "cohort_month", "activity_month", "cohort_customers", "active_customers", "retention_pct"
    ).orderBy("cohort_month", "activity_month")


def top_share(mart: DataFrame, events: DataFrame, days: int = domains.TRAILING_DAYS) -> DataFrame:
    """Events of the top customers, events of the window, and their share in percent.

    Both totals are one row; they meet in a union and one more aggregate.
    """
    top = mart.agg(F.sum("total_events").alias("top_events")).select(
        "top_events", F.lit(None).cast("long").alias("window_events")
    )
    window = trailing_events(events, days).agg(F.count("*").alias("window_events"))
    window = window.select(F.lit(None).cast("long").alias("top_events"), "window_events")
    totals = top.unionByName(window).agg(
        F.coalesce(F.sum("top_events"), F.lit(0)).alias("top_events"),
        F.coalesce(F.sum("window_events"), F.lit(0)).alias("window_events"),
    )
    return totals.withColumn("share_pct", percent(F.col("top_events"), F.col("window_events"), 1))
