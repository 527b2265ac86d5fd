"""Acceptance of the gated run: batch 1 twice, batch 2 twice."""

import pytest
from pyspark.sql import functions as F

from stratafold.plans.gate import GateFailed
from stratafold.plans.medallion import backfill, run_batch
from stratafold.session import new_folder, shared_folder, staged
from stratafold.sources.ingest import Feeds, feed_of
from stratafold.sources.layers import Layers
from tests.conftest import rows

B1, B2 = "2026-03-11", "2026-09-01"


def feeds(spark, *, second):
    events = [
        ("e1", "c1", "ticket_opened", "2026-03-10T10:00:00Z", "2026-03-10T10:00:00Z", "t1"),
        ("e2", "c1", "ticket_replied", "2026-03-10T10:30:00Z", "2026-03-10T10:30:00Z", "t1"),
        ("e3", "c2", "login", "2026-03-10T11:00:00Z", "2026-03-10T11:00:00Z", None),
        ("e3", "c2", "logout", "2026-03-10T11:00:00Z", "2026-03-10T11:05:00Z", None),
        ("e4", None, "page_view", "2026-03-10T12:00:00Z", "2026-03-10T12:00:00Z", None),
    ]
    customers = [
        ("c1", "free", "2026-03-01T00:00:00Z"),
        ("c2", "pro", "2026-03-01T00:00:00Z"),
    ]
    if second:
        events += [
            ("e5", "c1", "login", "2026-08-31T10:00:00Z", "2026-08-31T10:00:00Z", None),
            ("e1", "c1", "ticket_opened", "2026-03-10T10:10:00Z", "2026-08-30T00:00:00Z", "t1"),
        ]
        customers += [("c1", "pro", "2026-08-01T00:00:00Z")]
    e = spark.createDataFrame(
        events, "event_id string, customer_id string, event_type string, occurred_at string, updated_at string, t string"
    )
    e = e.withColumns({"channel": F.lit("web"), "properties": F.struct(F.col("t").alias("ticket_id"))}).drop("t")
    if second:
        e = e.withColumn("source_app", F.lit("mobile"))
    c = spark.createDataFrame(customers, "customer_id string, plan string, updated_at string").withColumns(
        {
            "company_name": F.col("customer_id"),
            "segment": F.lit("S"),
            "signup_date": F.lit("2026-03-01"),
            "country": F.lit("BR"),
            "is_active": F.lit(True),
        }
    )
    return Feeds(feed_of(e), feed_of(c))


def counts(layers):
    return {r["table_name"]: (r["rows"], r["current_rows"]) for r in layers.row_counts().collect()}


@pytest.mark.parametrize("mode", ["two_step", "one_pass"])
def test_acceptance_sequence(spark, layers, mode):
    seen = []
    for day, second in ((B1, False), (B1, False), (B2, True), (B2, True)):
        run_batch(layers, feeds(spark, second=second), day, history_mode=mode)
        seen.append(counts(layers))
    first, again, third, last = seen
    log = "quality.check_results"
    for before, after in ((first, again), (third, last)):
        assert after.pop(log)[0] == before.pop(log)[0] + 5
        assert after == before
    assert first["bronze.events"] == (5, None)
    assert first["silver.events"] == (4, None)
    assert first["silver.customers"] == (2, 2)
    assert third["bronze.events"] == (7, None)
    assert third["silver.events"] == (5, None)
    assert third["silver.customers"] == (3, 2)
    assert "source_app" in layers.read("bronze.events").columns
    assert "source_app" not in layers.read("silver.events").columns
    # The correction of e1 shortened the wait and took the event into the second batch.
    mart = layers.read("gold.response_time")
    assert rows(mart.drop("_generated_at")) == [("free", "2026-03", 20.0, 1, 0)]
    assert mart.filter("_generated_at is null").count() == 0
    assert rows(layers.count_by_batch("silver.events")) == [(B1, 3), (B2, 2)]


def test_a_blocked_run_leaves_the_marts_alone(spark, layers):
    run_batch(layers, feeds(spark, second=False), B1)
    before = rows(layers.read("gold.top_customers_30d"))
    with pytest.raises(GateFailed) as error:
        # Dated weeks after its newest event.
        run_batch(layers, feeds(spark, second=True), "2026-10-01")
    assert error.value.checks == ["event_freshness"]
    assert rows(layers.read("gold.top_customers_30d")) == before
    assert layers.read("quality.check_results").count() == 10
    assert layers.read("silver.events").count() == 5


def test_backfill_runs_in_date_order(spark, layers):
    asked = []

    def feeds_for(day):
        asked.append(day)
        return feeds(spark, second=day == B2)

    assert backfill(layers, feeds_for, [B2, B1]) == [B1, B2]
    assert asked == [B1, B2]
    assert layers.read("silver.customers").filter("is_current").count() == 2


class FakeSession:
    """Just enough of a session to ask for its folder."""

    def __init__(self, master, named=None):
        self.master, self.named, self.made = master, named, None
        self.sparkContext = self.conf = self

    def get(self, name, default):
        assert name == "spark.checkpoint.dir"
        return self.named or default

    def getCheckpointDir(self):
        return self.made

    def setCheckpointDir(self, folder):
        self.made = folder


def test_working_folder_is_the_one_the_session_names():
    assert shared_folder(FakeSession("yarn", "hdfs://shared/points/")) == "hdfs://shared/points"
    assert new_folder(FakeSession("yarn", "hdfs://shared/points")).startswith("hdfs://shared/points/stratafold/")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(FakeSession("yarn"))
    local = FakeSession("local[2]")
    assert shared_folder(local) == shared_folder(local)


def test_staged_rows_are_files_in_that_folder(spark):
    df = staged(spark.range(5).toDF("n"))
    assert df.count() == 5
    assert all(shared_folder(spark).split(":")[-1] in f for f in df.inputFiles())


def test_layers_of_one_root_can_be_used_by_name(spark, layers):
    layers.create("gold.response_time")
    same = Layers(spark, layers.root, layers.prefix)
    assert same.exists("gold.response_time")
    assert not same.exists("gold.cohort_retention")
