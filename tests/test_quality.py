import pytest
from pyspark.sql import functions as F

from stratafold.operators import quality
from stratafold.plans.gate import LOG, GateFailed, run_gate
from stratafold.schemas import SILVER_CUSTOMERS, SILVER_EVENTS
from tests.conftest import rows

DAY = "2026-03-11"


def silver_events(spark, *data):
    """(event_id, customer_id, event_type, occurred_at, batch)"""
    df = spark.createDataFrame(
        list(data), "event_id string, customer_id string, event_type string, at string, _batch_id string"
    )
    df = df.withColumn("occurred_at", F.col("at").cast("timestamp")).drop("at")
    for field in SILVER_EVENTS:
        if field.name not in df.columns:
            df = df.withColumn(field.name, F.lit(None).cast(field.dataType))
    return df.select(*SILVER_EVENTS.fieldNames())


def silver_customers(spark, *data):
    """(customer_id, plan, is_current)"""
    df = spark.createDataFrame(list(data), "customer_id string, plan string, is_current boolean")
    for field in SILVER_CUSTOMERS:
        if field.name not in df.columns:
            df = df.withColumn(field.name, F.lit(None).cast(field.dataType))
    return df.select(*SILVER_CUSTOMERS.fieldNames())


def result(spark, events, customers=None, batch=DAY):
    customers = customers if customers is not None else silver_customers(spark, ("c1", "pro", True))
    found = quality.report(events, customers, batch).collect()
    assert len(found) == 5
    assert tuple(found[0].asDict()) == quality.RESULT_COLUMNS
    return {r["check_name"]: r for r in found}


def of_size(n, batch, day="2026-03-10"):
    return [(f"{batch}-{i}", "c1", "login", f"{day} 10:00:00", batch) for i in range(n)]


def test_null_ids_count_as_duplicates(spark):
    ids = [("a", "c1", "login", "2026-03-11", DAY)] + [(None, "c1", "login", "2026-03-11", DAY)] * 2
    row = result(spark, silver_events(spark, *ids))["event_id_uniqueness"]
    assert (row["metric_value"], row["status"], row["severity"]) == (2.0, "FAILED", "BLOCKING")


def test_references_need_a_current_customer(spark):
    events = silver_events(
        spark, *[(str(i), c, "login", "2026-03-11", DAY) for i, c in enumerate(["c1", "c2", "c2", "c3", None])]
    )
    customers = silver_customers(spark, ("c1", "pro", True), ("c2", "pro", False))
    row = result(spark, events, customers)["customer_reference"]
    assert (row["metric_value"], row["status"], row["severity"]) == (3.0, "FAILED", "WARNING")


def test_domains_ignore_nulls_and_closed_versions(spark):
    events = silver_events(
        spark, *[(str(i), "c1", t, "2026-03-11", DAY) for i, t in enumerate(["login", "x", None, "feature_used"])]
    )
    customers = silver_customers(
        spark, ("c1", "gold", True), ("c2", "gold", False), ("c3", None, True), ("c4", "free", True)
    )
    row = result(spark, events, customers)["domain_values"]
    assert (row["metric_value"], row["status"]) == (2.0, "FAILED")
    assert row["details"] == "1 illegal event types | 1 illegal plans"


@pytest.mark.parametrize(
    "sizes, metric, threshold, status",
    [
        ([], 3.0, 0.0, "PASSED"),  # no history
        ([2, 2], 50.0, 50.0, "PASSED"),  # exactly the limit
        ([6], 50.0, 50.0, "PASSED"),
        ([1], 200.0, 50.0, "FAILED"),
    ],
)
def test_volume(spark, sizes, metric, threshold, status):
    history = [row for i, n in enumerate(sizes) for row in of_size(n, f"2026-03-0{i + 1}")]
    row = result(spark, silver_events(spark, *of_size(3, DAY), *history))["event_volume"]
    assert (row["metric_value"], row["threshold_value"], row["status"]) == (metric, threshold, status)


def test_volume_looks_at_the_seven_greatest_other_ids(spark):
    # Two old large batches fall out of the history; a later batch counts.
    data = of_size(2, DAY) + of_size(40, "2026-01-01") + of_size(40, "2026-01-02")
    data += [r for i in range(6) for r in of_size(2, f"2026-02-0{i + 1}")] + of_size(2, "2026-09-01")
    row = result(spark, silver_events(spark, *data))["event_volume"]
    assert (row["metric_value"], row["status"]) == (0.0, "PASSED")


@pytest.mark.parametrize(
    "day, metric, status",
    [("2026-03-09", 2.0, "PASSED"), ("2026-03-08", 3.0, "FAILED"), ("2026-03-13", -2.0, "PASSED"), (None, 0.0, "PASSED")],
)
def test_freshness(spark, day, metric, status):
    data = of_size(2, "2026-03-10") + (of_size(2, DAY, day) if day else [])
    row = result(spark, silver_events(spark, *data))["event_freshness"]
    assert (row["metric_value"], row["status"]) == (metric, status)


def test_empty_tables(spark):
    found = result(spark, silver_events(spark), silver_customers(spark))
    assert {r["status"] for r in found.values()} == {"PASSED"}


def fill(layers, events, customers):
    layers.create_all()
    days = [r[0] for r in events.select(F.to_date("occurred_at")).distinct().collect()]
    layers.swap_partitions("silver.events", events.withColumn("event_date", F.to_date("occurred_at")), days)
    layers.swap("silver.customers", customers)


def test_a_warning_passes_the_gate_and_the_log_grows(spark, layers):
    events = silver_events(spark, ("a", "c9", "login", "2026-03-11", DAY))
    fill(layers, events, silver_customers(spark, ("c1", "pro", True)))
    run_gate(layers, DAY)
    run_gate(layers, DAY)
    log = layers.read(LOG)
    assert log.count() == 10
    assert log.filter("executed_at is null").count() == 0
    assert rows(quality.failed_rows(log), "check_name") == [("customer_reference",)] * 2
    assert quality.latest_rows(log, 5).count() == 5


@pytest.mark.parametrize(
    "data, stopped",
    [
        ([("a", "c1", "login", "2026-03-11", DAY)] * 2, "event_id_uniqueness"),
        ([("a", "c1", "login", "2026-03-01", DAY)], "event_freshness"),
    ],
)
def test_a_blocking_failure_raises_after_all_rows_are_logged(spark, layers, data, stopped):
    fill(layers, silver_events(spark, *data), silver_customers(spark, ("c1", "pro", True)))
    with pytest.raises(GateFailed) as error:
        run_gate(layers, DAY)
    assert error.value.checks == [stopped]
    assert layers.read(LOG).count() == 5
