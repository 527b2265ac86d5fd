"""The filter of a batch's keys loses none and lets few others through."""

import pytest
from pyspark.sql import functions as F

from stratafold.operators.keyfilter import key_filter, maybe_held
from stratafold.plans.silver import held_days
from stratafold.schemas import EVENT_DATE
from tests.conftest import rows


@pytest.fixture(scope="module")
def target(spark):
    return spark.range(60_000).selectExpr(
        "if(id % 997 = 0, null, concat('e', id)) event_id", f"date_add(date'2026-01-01', int(id % 90)) {EVENT_DATE}", "id n"
    )


@pytest.mark.parametrize("most_words", [1, 64, 1 << 20])
def test_no_key_is_lost_at_any_size(spark, target, most_words):
    batch = spark.range(0, 60_000, 37).selectExpr("concat('e', id) event_id")
    found = maybe_held(target, ["event_id"], key_filter(batch, ["event_id"], most_words))
    exact = target.join(batch, "event_id", "left_semi")
    assert found.join(batch, "event_id", "left_semi").count() == exact.count()
    assert found.columns == target.columns


def test_few_others_pass(spark, target):
    batch = spark.range(0, 60_000, 37).selectExpr("concat('e', id) event_id")
    filter_ = key_filter(batch, ["event_id"])
    assert filter_.count() <= 512
    assert batch.count() <= maybe_held(target, ["event_id"], filter_).count() < 1.1 * batch.count() + 1500


def test_several_columns_and_nulls(spark):
    batch = spark.createDataFrame([(1, "a"), (2, None), (None, "b")], "x long, y string")
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (None, "b"), (2, "a")], "x long, y string")
    found = maybe_held(df, ["x", "y"], key_filter(batch, ["x", "y"]))
    assert (1, "a") in rows(found) and (2, None) not in rows(found)
    assert rows(maybe_held(df, ["x", "y"], key_filter(batch.limit(0), ["x", "y"]))) == []


def test_days_of_a_large_batch_are_found_with_little_shuffled(spark, target):
    batch = spark.range(5, 60_000, 601).selectExpr("concat('e', id) event_id")
    batch = batch.unionByName(spark.createDataFrame([(None,), ("new",)], "event_id string"))
    large = held_days(target, batch, broadcast_bytes=0)
    assert rows(large) == rows(held_days(target, batch))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = held_days(target, batch, broadcast_bytes=0)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    # From the root down: the exact join, its shuffle, and below that the broadcast filter.
    assert plan.index("SortMergeJoin") < plan.index("hashpartitioning(event_id") < plan.index("BroadcastHashJoin")
    filter_ = key_filter(batch.filter(F.col("event_id").isNotNull()), ["event_id"])
    assert maybe_held(target, ["event_id"], filter_).count() < 60_000 * 0.03 + 200
