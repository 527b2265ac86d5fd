import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stratafold.operators.scd2 import apply_one_pass, apply_two_step, rebuild, stamp_versions
from tests.conftest import rows

END = "9999-12-31 23:59:59"


def batch(spark, *data):
    df = spark.createDataFrame([(k, f"2026-01-0{d}" if d else None, p) for k, d, p in data], "c string, d string, plan string")
    return df.select("c", F.col("d").cast("timestamp").alias("updated_at"), "plan")


def empty(spark):
    return stamp_versions(batch(spark, ("x", 1, "x"))).limit(0)


def shown(history):
    """(key, plan, first day, end day or None, current)"""
    day = F.dayofmonth("valid_to")
    return rows(
        history.select(
            "c",
            "plan",
            F.dayofmonth("valid_from").alias("a"),
            F.when(F.date_format("valid_to", "yyyy-MM-dd HH:mm:ss") != END, day).alias("b"),
            "is_current",
        )
    )


@pytest.mark.parametrize("apply", [apply_two_step, apply_one_pass])
class TestBothModes:
    def run(self, spark, apply, *batches):
        history = empty(spark)
        for data in batches:
            history = apply(history, batch(spark, *data), "c")
        return history

    def test_change(self, spark, apply):
        history = self.run(spark, apply, [("c1", 1, "free")], [("c1", 5, "pro")])
        assert shown(history) == [("c1", "free", 1, 5, False), ("c1", "pro", 5, None, True)]

    def test_no_attribute_change_still_opens_a_version(self, spark, apply):
        history = self.run(spark, apply, [("c1", 1, "free")], [("c1", 5, "free")])
        assert history.count() == 2

    def test_rerun_changes_nothing(self, spark, apply):
        first, second = [("c1", 1, "free"), ("c2", 1, "pro")], [("c1", 5, "pro")]
        once = self.run(spark, apply, first, second)
        again = self.run(spark, apply, first, first, second, second)
        assert shown(once) == shown(again)

    def test_untouched_keys_stay(self, spark, apply):
        history = self.run(spark, apply, [("c1", 1, "free"), ("c2", 2, "pro")], [("c1", 5, "pro")])
        assert ("c2", "pro", 2, None, True) in shown(history)

    def test_rows_without_a_key_are_kept(self, spark, apply):
        history = self.run(spark, apply, [(None, 1, "free")], [("c1", 1, "pro")])
        assert (None, "free", 1, None, True) in shown(history)


def test_late_version_two_step_leaves_two_current_rows(spark):
    history = apply_two_step(empty(spark), batch(spark, ("c1", 5, "pro")), "c")
    history = apply_two_step(history, batch(spark, ("c1", 1, "free")), "c")
    assert shown(history) == [("c1", "free", 1, None, True), ("c1", "pro", 5, None, True)]


@pytest.mark.parametrize("limit", [0, 1 << 40])
def test_late_version_one_pass_finds_its_place(spark, limit):
    history = apply_one_pass(empty(spark), batch(spark, ("c1", 5, "pro")), "c", broadcast_bytes=limit)
    history = apply_one_pass(history, batch(spark, ("c1", 1, "free")), "c", broadcast_bytes=limit)
    assert shown(history) == [("c1", "free", 1, 5, False), ("c1", "pro", 5, None, True)]


def test_two_versions_in_a_batch(spark):
    both = batch(spark, ("c1", 2, "pro"), ("c1", 3, "enterprise"))
    start = apply_two_step(empty(spark), batch(spark, ("c1", 1, "free")), "c")
    with pytest.raises(PySparkException, match="several newer rows"):
        apply_two_step(start, both, "c").collect()
    assert shown(apply_one_pass(start, both, "c")) == [
        ("c1", "enterprise", 3, None, True),
        ("c1", "free", 1, 2, False),
        ("c1", "pro", 2, 3, False),
    ]
    # Only versions newer than the current one count: a repeat beside a change is fine.
    one_new = batch(spark, ("c1", 1, "free"), ("c1", 3, "pro"))
    assert len(shown(apply_two_step(start, one_new, "c"))) == 2
    # For a new key both are inserted open.
    fresh = apply_two_step(empty(spark), both, "c")
    assert [r[-1] for r in shown(fresh)] == [True, True]


def test_tracked_columns_open_a_version_only_on_change(spark):
    versions = batch(spark, ("c1", 1, "free"), ("c1", 2, "free"), ("c1", 3, "pro"), ("c1", 4, None), ("c1", 5, None))
    assert shown(rebuild(versions, "c", track=["plan"])) == [
        ("c1", None, 4, None, True),
        ("c1", "free", 1, 3, False),
        ("c1", "pro", 3, 4, False),
    ]
