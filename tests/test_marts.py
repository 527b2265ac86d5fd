from pyspark.sql import functions as F

from stratafold.operators.scd2 import rebuild
from stratafold.plans import delivery, marts
from tests.conftest import rows


def events(spark, *data):
    """(customer, type, instant, ticket)"""
    df = spark.createDataFrame(list(data), "customer_id string, event_type string, at string, ticket string")
    return df.select(
        "customer_id",
        "event_type",
        F.col("at").cast("timestamp").alias("occurred_at"),
        F.to_json(F.struct(F.col("ticket").alias("ticket_id"))).alias("properties"),
        F.col("customer_id").isNotNull().alias("_customer_exists"),
    )


def customers(spark, *data):
    """(customer, plan, first day)"""
    df = spark.createDataFrame(list(data), "customer_id string, plan string, day string")
    df = df.select(
        "customer_id",
        "plan",
        F.concat(F.lit("Name "), "customer_id").alias("company_name"),
        F.lit("S").alias("segment"),
        F.lit("2026-01-15").cast("date").alias("signup_date"),
        F.col("day").cast("timestamp").alias("updated_at"),
    )
    return rebuild(df, "customer_id")


def test_window_ends_at_the_newest_of_all_events_and_includes_its_start(spark):
    data = events(
        spark,
        ("c1", "login", "2026-03-01 12:00:00", None),  # exactly the start
        ("c1", "login", "2026-03-01 11:59:59", None),  # just before it
        (None, "login", "2026-03-31 12:00:00", None),  # newest, without a customer
        ("c1", "login", "2026-03-20 00:00:00", None),
    )
    top = marts.top_customers(data, customers(spark, ("c1", "pro", "2026-01-01")))
    assert rows(top, "customer_id", "total_events") == [("c1", 2)]


def test_plan_change_in_the_window_gives_two_rows(spark):
    data = [("c1", "login", f"2026-03-0{d} 10:00:00", None) for d in range(1, 6)]
    history = customers(spark, ("c1", "free", "2026-01-01"), ("c1", "pro", "2026-03-04"))
    top = marts.top_customers(events(spark, *data), history)
    assert [tuple(r) for r in top.select("plan", "total_events").collect()] == [("free", 3), ("pro", 2)]


def test_top_ten_has_a_total_order(spark):
    data = [(f"c{i:02}", "login", "2026-03-05 10:00:00", None) for i in range(15)]
    history = customers(spark, *[(f"c{i:02}", "pro", "2026-01-01") for i in range(15)])
    top = marts.top_customers(events(spark, *data), history)
    assert [r[0] for r in top.collect()] == [f"c{i:02}" for i in range(10)]
    share = delivery.top_share(top, events(spark, *data)).first()
    assert tuple(share) == (10, 15, 66.7)


def test_first_response_counts(spark):
    data = events(
        spark,
        ("c1", "ticket_opened", "2026-03-01 10:00:00", "t1"),
        ("c1", "ticket_replied", "2026-03-01 10:30:00", "t1"),
        ("c1", "ticket_replied", "2026-03-01 10:10:00", "t1"),  # the first reply
        ("c1", "ticket_opened", "2026-03-02 10:00:00", "t2"),  # unanswered
        ("c1", "ticket_opened", "2026-03-03 10:00:00", None),  # no ticket id
        ("c2", "ticket_replied", "2026-03-04 09:00:00", None),
        ("c1", "ticket_opened", "2026-03-05 10:00:00", "t3"),  # replied before it was opened
        ("c1", "ticket_replied", "2026-03-05 09:50:00", "t3"),
        ("c1", "ticket_opened", "2026-03-01 10:05:00", "t1"),  # opened twice
        ("c0", "ticket_opened", "2026-03-01 10:00:00", "t1"),  # customer without a version
        ("c1", "ticket_opened", "2026-04-01 10:00:00", "t4"),  # next month
    )
    mart = marts.response_time(data, customers(spark, ("c1", "pro", "2026-01-01")))
    assert rows(mart) == [("pro", "2026-03", 1.67, 3, 2), ("pro", "2026-04", None, 0, 1)]
    shown = delivery.response_time(mart)
    assert [r["unanswered_pct"] for r in shown.collect()] == [40.0, 100.0]


def test_minutes_are_exact_decimals(spark):
    # 1/60 min cut to six digits is 0.016667; three of them and one of 0 average 0.01250025.
    opened = [("c1", "ticket_opened", "2026-03-01 10:00:00", f"t{i}") for i in range(2)]
    replies = [("c1", "ticket_replied", "2026-03-01 10:00:01", "t0"), ("c1", "ticket_replied", "2026-03-01 10:00:02", "t1")]
    mart = marts.response_time(events(spark, *opened, *replies), customers(spark, ("c1", "pro", "2026-01-01")))
    # (0.016667 + 0.033333) / 2 = 0.025 rounds half up; in binary 1/60 and 2/60 it is just below.
    assert mart.first()["avg_response_minutes"] == 0.03


def test_plan_at_opening_not_the_current_one(spark):
    data = events(spark, ("c1", "ticket_opened", "2026-03-01 10:00:00", "t1"))
    history = customers(spark, ("c1", "free", "2026-01-01"), ("c1", "pro", "2026-03-10"))
    assert rows(marts.response_time(data, history), "plan") == [("free",)]


def test_retention(spark):
    data = events(
        spark,
        *[("c1", "login", f"2026-02-{d:02} 10:00:00", None) for d in range(1, 20)],
        ("c1", "login", "2025-12-01 10:00:00", None),  # before the cohort month
        ("c2", "login", "2026-03-01 10:00:00", None),
        ("c9", "login", "2026-03-01 10:00:00", None),  # not a customer
        (None, "login", "2026-03-01 10:00:00", None),
    )
    history = customers(
        spark,
        ("c1", "free", "2026-01-01"),
        ("c1", "pro", "2026-02-01"),
        ("c2", "pro", "2026-01-01"),
        ("c3", "pro", "2026-01-01"),
    )
    expected = [
        ("2026-01", "2025-12", 3, 1, 33.33),
        ("2026-01", "2026-02", 3, 1, 33.33),
        ("2026-01", "2026-03", 3, 1, 33.33),
    ]
    assert rows(marts.cohort_retention(data, history)) == expected
    # A second current row of a customer does not count the customer twice.
    doubled = history.unionByName(history.filter("customer_id = 'c1' and is_current"))
    assert rows(marts.cohort_retention(data, doubled)) == expected
