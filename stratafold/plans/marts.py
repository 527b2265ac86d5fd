"""Gold marts.  Pure DataFrame plans over Silver-shaped inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold import domains
from stratafold.functions import json_attribute, month_of, percent, trailing_start
from stratafold.operators.matching import first_response
from stratafold.operators.pit import pit_join
from stratafold.schemas import EVENT_DATE


def trailing_events(events: DataFrame, days: int = domains.TRAILING_DAYS) -> DataFrame:
    """Events of known customers in the last ``days`` days.

    The window ends at the newest of all events and includes its first instant.  A
    table with the physical day column gets the same bound on it, which prunes
    partitions.
    """
    start = trailing_start(events, "occurred_at", days)
    recent = events.filter(F.col("occurred_at") >= start)
    if EVENT_DATE in events.columns:
        newest_day = events.agg(F.max(EVENT_DATE).alias("newest"))
        first_day = newest_day.select(F.date_sub("newest", days)).scalar()
        recent = recent.filter(F.col(EVENT_DATE) >= first_day)
    return recent.filter(F.col("_customer_exists"))


def customer_totals(
    events: DataFrame, customers: DataFrame, days: int = domains.TRAILING_DAYS, bounds: str = "closed"
) -> DataFrame:
    """Events in the trailing window per customer, with attributes as of the event."""
    recent = trailing_events(events, days).select("customer_id", "occurred_at")
    versions = customers.select(
        "customer_id", "company_name", "plan", "segment", "valid_from", "valid_to"
    )
    joined = pit_join(recent, versions, "customer_id", "occurred_at", bounds=bounds)
    return joined.groupBy("customer_id", "company_name", "plan", "segment").agg(
        F.count("*").alias("total_events")
    )


def top_customers(
    events: DataFrame,
    customers: DataFrame,
    days: int = domains.TRAILING_DAYS,
    n: int = domains.TOP_CUSTOMERS,
    bounds: str = "closed",
) -> DataFrame:
    totals = customer_totals(events, customers, days, bounds)
    return totals.orderBy(
        F.col("total_events").desc(), "customer_id", "plan", "company_name", "segment"
    ).limit(n)


def response_time(
    events: DataFrame,
    customers: DataFrame,
    opened: str = domains.OPENED,
    replied: str = domains.REPLIED,
    bounds: str = "closed",
) -> DataFrame:
    """First-response time by plan at opening and by month of opening."""
    tickets = events.select(
        json_attribute("properties", "ticket_id").alias("ticket_id"),
        "customer_id",
        "occurred_at",
        "event_type",
    )
    matched = first_response(
        tickets.filter(F.col("event_type") == opened).drop("event_type"),
        tickets.filter(F.col("event_type") == replied).select("ticket_id", "occurred_at"),
        "ticket_id",
        "occurred_at",
    ).select("customer_id", "occurred_at", "response_minutes")
    versions = customers.select("customer_id", "plan", "valid_from", "valid_to")
    joined = pit_join(matched, versions, "customer_id", "occurred_at", bounds=bounds)
    return response_summary(joined, "plan")


def response_summary(matched: DataFrame, group: str) -> DataFrame:
    return matched.groupBy(group, month_of("occurred_at").alias("month")).agg(
        F.round(F.avg("response_minutes"), 2).cast("double").alias("avg_response_minutes"),
        F.count("response_minutes").alias("answered_tickets"),
        F.count_if(F.col("response_minutes").isNull()).alias("unanswered_tickets"),
    )


def cohort_retention(events: DataFrame, customers: DataFrame) -> DataFrame:
    """Active customers by signup month and month of activity.

    Both sides are made distinct before the join, with a partial step ahead of the
    shuffle, so a customer with very many events sends a few month rows.  After that
    each (customer, cohort, month) occurs once and the distinct counts are plain ones.
    """
    activity = (
        events.filter(F.col("_customer_exists"))
        .select("customer_id", F.trunc("occurred_at", "month").alias("_month"))
        .distinct()
    )
    cohorts = (
        customers.filter(
            F.col("is_current") & F.col("customer_id").isNotNull() & F.col("signup_date").isNotNull()
        )
        .select("customer_id", F.trunc("signup_date", "month").alias("_cohort"))
        .distinct()
    )
    sizes = cohorts.groupBy(F.col("_cohort").alias("_of")).agg(F.count("*").alias("cohort_customers"))
    active = (
        cohorts.join(activity, "customer_id")
        .groupBy("_cohort", "_month")
        .agg(F.count("*").alias("active_customers"))
    )
    return active.join(sizes, F.col("_cohort") == F.col("_of")).select(
        month_of("_cohort").alias("cohort_month"),
        month_of("_month").alias("activity_month"),
        "cohort_customers",
        "active_customers",
        percent(F.col("active_customers"), F.col("cohort_customers"), 2).alias("retention_pct"),
    )
